"""SimHash near duplicates, found by Golay-code fuzzy hashing of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, side, table, written
from .components import components
from .url_filter import possibly_in

SEED = 42
#: Bits of the three segments of a fingerprint, from the lowest.
SEGMENTS = (22, 21, 21)
#: Fixed value: the generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b110001110101
#: A key with more fingerprints isn't paired up: its fingerprints meet at the points of their unit balls.
PAIRED = 16


def fingerprints(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is set in over half of the shingles' XXH64; no words: zero."""
    import xxhash

    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        if len(words) > shingle:
            parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
        else:
            parts = iter([b" ".join(words)])
        total, count = np.zeros(64, np.int64), 0
        while len(block := np.fromiter((digest(x, SEED) for x, _ in zip(parts, range(8192))), np.uint64)):  # noqa: B905
            total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            count += len(block)
        out[i] = np.packbits(2 * total > count, bitorder="little").view(np.uint64)[0]
    return out


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the single bits, and for each syndrome the error of least weight."""
    bits = np.arange(23)
    syndrome = np.zeros(23, np.int64)
    for b in bits:
        x = 1 << int(b)
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        syndrome[b] = x
    errors = np.zeros(2048, np.int64)
    for a in range(-1, 23):
        for b in range(a, 23):
            for c in range(b, 23):
                chosen = {x for x in (a, b, c) if x >= 0}
                value, error = 0, 0
                for x in chosen:
                    value, error = value ^ int(syndrome[x]), error | 1 << x
                if value and (not errors[value] or bin(error).count("1") < bin(int(errors[value])).count("1")):
                    errors[value] = error
    return syndrome, errors


def golay_index(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Index (upper 12 bits) of the code word at distance 3 or less; the code is perfect, so there is just one."""
    syndrome, errors = tables
    total = np.zeros_like(words)
    for b in range(23):
        total ^= np.where(words >> b & 1, syndrome[b], 0)
    return (words ^ errors[total]) >> 11


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: any two fingerprints that differ in 2 bits or fewer share a key.

    Two errors leave one of three segments whole: it enters the key as it is. The next segment has two errors
    at most, so some word differs in one bit at most from both sides; both list its code word among those that
    the words at distance 0 and 1 decode to.
    """
    tables, rows, keys = golay_tables(), [], []
    prints = prints.astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(SEGMENTS)])[:-1]
    parts = [((prints >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in zip(starts, SEGMENTS, strict=True)]
    for c in range(3):
        fuzzy, n = parts[(c + 1) % 3], SEGMENTS[(c + 1) % 3]
        flips = np.concatenate([[0], 1 << np.arange(n)]).astype(np.int64)
        index = np.sort(golay_index((fuzzy[:, None] ^ flips[None, :]).ravel(), tables).reshape(len(prints), -1), axis=1)
        fresh = np.ones_like(index, bool)
        fresh[:, 1:] = index[:, 1:] != index[:, :-1]
        row, column = np.nonzero(fresh)
        rows.append(row)
        keys.append((np.int64(c) << 40) | (parts[c][row] << 12) | index[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def document_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, *also: str) -> DataFrame:
    """(doc_id, fp long) of every row, and the columns named besides."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                prints = pa.array(fingerprints(byte_texts(part.column(1)), shingle).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), prints, *part.columns[2:]], ["doc_id", "fp", *also])

    kinds = [f"{docs.schema[id_col].dataType.simpleString()}, fp long", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in also)]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *also).mapInArrow(work, "doc_id " + ", ".join(kinds))


def print_keys(nodes: DataFrame) -> DataFrame:
    """(fp, node) -> (key, fp, node), several rows each."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                fp, node = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                row, key = fuzzy_keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(node[row])], ["key", "fp", "node"])

    return nodes.select("fp", "node").mapInArrow(work, "key long, fp long, node long")


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all links at 2 or fewer differing bits.

    Keys with few fingerprints are paired up and verified. A key may gather a great many (one document's many
    near copies); its fingerprints instead meet at every point of their unit balls. Fingerprints that share such
    a point differ in 2 bits at most, and those that differ in 2 at most share one, so each is linked to the
    least at that point: no pair is lost and none is made in vain.
    """
    keys = written(print_keys(nodes))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = written(sizes)
    sizes = side(sizes)
    few = keys.join(sizes.filter(F.col("n") <= PAIRED).select("key"), "key", "left_semi")
    pairs = few.alias("x").join(few.alias("y"), "key").filter("x.node < y.node AND bit_count(x.fp ^ y.fp) <= 2").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    many = keys.join(sizes.filter(F.col("n") > PAIRED).select("key"), "key", "left_semi").select("fp", "node").distinct()
    points = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)))
    balls = many.select("node", F.explode(points).alias("point"))
    least = balls.groupBy("point").agg(F.min("node").alias("a"), F.max("node").alias("top")).filter("a < top").drop("top")
    stars = balls.join(least, "point").filter("a < node").select("a", F.col("node").alias("b"))
    return pairs.union(stars).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id it reaches over links.

    Documents link when their fingerprints differ in 2 bits or fewer; equal fingerprints always link, and texts
    without a word (null, empty) have fingerprint zero and link like any other. Exact copies meet by fingerprint
    first, so only distinct fingerprints are compared. Ids must be whole numbers; rows with a null id keep a
    null component and link nothing. Repeated rows are all returned; an empty table gives no rows; other columns
    aren't read.
    """
    prints = written(document_prints(docs, id_col, text_col, shingle))
    nodes = written(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").cast("long").alias("node")))
    found = components(links(nodes))
    classes = written(nodes.join(side(found), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    out = prints.join(side(classes).withColumnRenamed("fp", "fp2"), F.col("fp") == F.col("fp2"), "left")
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The documents that are the smallest of their group; all columns as they are. Repeated rows of one id and text all stay.

    A row is known by its id and its text (or its fingerprint, where the groups have no text_print), so where rows
    share an id each is judged by its own group. Rows with a null id belong to no group and all stay. Rows that a
    Bloom filter of the rows to drop doesn't hit stay without a shuffle.
    """
    other = groups.filter(F.col(id_col) != F.col("component_id"))
    if "text_print" not in groups.columns:
        own = document_prints(docs.withColumn("wayloom_print", F.xxhash64(text_col)), id_col, text_col, shingle, "wayloom_print")
        own = own.select(F.col("doc_id").alias("i"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), F.col("wayloom_print").alias("text_print"))
        other = other.select(id_col, "fingerprint").distinct().join(own, (F.col(id_col) == F.col("i")) & (F.col("fingerprint") == F.col("f")))
    other = written(other.select(F.col(id_col).alias("wayloom_dropped_id"), F.col("text_print").alias("wayloom_dropped_print")).distinct())
    hit = possibly_in(other.select(F.xxhash64("wayloom_dropped_id", "wayloom_dropped_print").alias("key")), F.xxhash64(F.col(id_col), F.xxhash64(text_col)))
    kept = docs.filter(hit).join(side(other), (F.col(id_col) == F.col("wayloom_dropped_id")) & (F.xxhash64(text_col) == F.col("wayloom_dropped_print")), "left_anti")
    return kept.unionByName(docs.filter(~hit))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all whole `documents`, and the smallest id that each reaches over links of 2 bits or fewer."""
    return near_groups(table(spark, sf_dir, "documents"))
