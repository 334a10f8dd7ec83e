"""Removal of long passages that an earlier document holds, by compaction of the corpus's de Bruijn graph.

The edges of the graph are all sequences of WINDOW words. Every edge is dealt to its minimizer, the sequence
of SEED words inside it of least hash; edges that follow each other in a text and share the minimizer's place
form a path. Minimizers seen in one text only are dropped at once, so about one place in sixteen is shuffled.
Paths with equal words are compacted to one by a grouping. A minimizer with one path doesn't branch: all edges
of the path are repeated alike. Where it branches, the edges of its paths, once for each distinct path, are
grouped one by one. Joins take the outcome back to the places of the paths in their texts.

All this goes by hashes, and yields spans with the coordinates of their source (text and first word). A span counts
only if the words at both places have the same SHA-256; exact copies of whole texts go by 64 bits of that of the text and 64 of another hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, table, written
from .url_filter import possibly_in

#: Words of an edge and of a seed.
WINDOW, SEED = 50, 20
#: Fixed odd multipliers of the rolling hashes.
SEED_BASE, EDGE_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
KEY = ["d", "h1", "h2"]
#: Parts into which the paths of one minimizer, and the copies of one text, are dealt.
SALT = 64
SPAN = "start int, words int, d2 long, p1 long, p2 long, at int"


def span_hashes(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of every run of `length` items, from runs of doubling length."""
    level, size, done, taken = h, 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                if done is None:
                    done = level
                else:
                    n = min(len(level), max(0, len(done) - size))
                    done = level[:n] * np.uint64(pow(base, taken, 1 << 64)) + done[size : size + n]
                taken += size
            if 2 * size > length:
                return done
            level = level[: max(0, len(level) - size)] * np.uint64(pow(base, size, 1 << 64)) + level[size:]
            size *= 2


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value in every run of `width`."""
    place, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        size += step
    return place


def paths_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; and of each path its seed hash, its first edge, and the edge after its last."""
    import xxhash

    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < WINDOW:
        none = np.zeros(0, np.int64)
        return h, none.astype(np.uint64), none, none
    seeds = span_hashes(h, SEED, SEED_BASE)
    with np.errstate(over="ignore"):
        rank = (seeds ^ (seeds >> np.uint64(31))) * np.uint64(EDGE_BASE)
        rank ^= rank >> np.uint64(29)
    place = leftmost_least(rank, WINDOW - SEED + 1)
    start = np.nonzero(np.concatenate([[True], place[1:] != place[:-1]]))[0]
    return h, seeds[place[start]], start, np.concatenate([start[1:], [len(place)]])


def seeds_by_text(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            counts, seeds = [], []
            for text in byte_texts(part.column(3)):
                words = text.split()
                counts.append(len(words))
                seeds.append(np.unique(paths_of(words)[1]).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in seeds])]), pa.int32()), pa.array(np.concatenate(seeds)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(counts, pa.int64()), lists], [*KEY, "n_words", "seeds"])


def paths_by_text(batches: Iterator) -> Iterator:
    """The paths of the wanted seeds: equal ones of a text come once, with all their places."""
    import pyarrow as pa
    import xxhash

    for batch in batches:
        for begin in range(0, batch.num_rows, 64):
            part = batch.slice(begin, 64)
            out: dict[str, list] = {x: [] for x in ("row", "m", "c", "starts", "edges")}
            wanted_lists = part.column(4).to_pylist()
            for row, text in enumerate(byte_texts(part.column(3))):
                words = text.split()
                h, seeds, first, after = paths_of(words)
                if not len(seeds):
                    continue
                edges = span_hashes(h, WINDOW, EDGE_BASE).view(np.int64)
                seeds = seeds.view(np.int64)
                found: dict[tuple[int, int], list[int]] = {}
                for i in np.nonzero(np.isin(seeds, np.array(wanted_lists[row], np.int64)))[0].tolist():
                    a, b = int(first[i]), int(after[i])
                    content = xxhash.xxh3_64_intdigest(b" ".join(words[a : b + WINDOW - 1]))
                    key = (int(seeds[i]), content - (1 << 64) if content >> 63 else content)
                    if key in found:
                        found[key].append(a)
                        continue
                    found[key] = [a]
                    out["edges"].append(edges[a:b])
                for (m, c), starts in found.items():
                    out["row"].append(row)
                    out["m"].append(m)
                    out["c"].append(c)
                    out["starts"].append(starts)
            if out["row"]:
                rows = pa.array(out["row"], pa.int32())
                edges = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out["edges"]])]), pa.int32()), pa.array(np.concatenate(out["edges"])))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(rows) for k in range(3)), pa.array(out["m"], pa.int64()), pa.array(out["c"], pa.int64()), pa.array(out["starts"], pa.list_(pa.int32())), edges], [*KEY, "m", "c", "starts", "edges"])


def text_sha(text: Column) -> Column:
    """Sixty-four bits of a text's SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, -10).cast("long")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and text with two digests of the text (the second from its SHA-256): together they name a row (rows that agree in all are alike)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text).alias("h1"), text_sha(text).alias("h2"), text.alias("text"))


def repeats(rows: DataFrame) -> DataFrame:
    """(d, h1, h2, whole, spans): which texts hold edges that also start in a document of smaller id, and where.

    whole: the text is an exact copy of one with a smaller id and has WINDOW words or more. spans: first word, number
    of words and SHA-256 of the words at the source.
    """
    wide = rows.filter("d is not null")
    texts = written(wide.mapInArrow(seeds_by_text, "d long, h1 long, h2 long, n_words long, seeds array<long>").filter(f"n_words >= {WINDOW}"))
    # Copies of one text are dealt over parts, so no task gets a large group of them.
    dealt = texts.select(*KEY, F.pmod(F.xxhash64("d"), F.lit(SALT)).cast("int").alias("s"))
    parts = written(dealt.groupBy("h1", "h2", "s").agg(F.min("d").alias("low"), F.max("d").alias("high")))
    firsts = parts.groupBy("h1", "h2").agg(F.min("low").alias("first"), F.max("high").alias("last")).filter("first < last").select("h1", "h2", "first")
    several = written(parts.select("h1", "h2", "s").join(firsts, ["h1", "h2"]))
    copies = written(dealt.join(several, ["h1", "h2", "s"]).filter("d > first").select(*KEY).distinct())
    seeds = texts.select(*KEY, F.explode("seeds").alias("m"))
    shared = written(seeds.groupBy("m").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("m"))
    wanted = seeds.join(shared, "m", "left_semi").groupBy(*KEY).agg(F.collect_set("m").alias("wanted")).join(copies, KEY, "left_anti")
    wanted = written(wanted)
    near = touched(rows, wanted)[0].join(wanted, KEY)
    places = near.select(*KEY, "text", "wanted").mapInArrow(paths_by_text, "d long, h1 long, h2 long, m long, c long, starts array<int>, edges array<long>")
    places = written(places.dropDuplicates([*KEY, "m", "c"]))
    spans = written(sourced(places))
    proven = written(spans.join(digests(rows, spans), ["d2", "p1", "p2", "at", "words"]).groupBy(*KEY).agg(F.collect_list(F.struct("start", "words", "sha")).alias("spans")))
    none = F.array().cast("array<struct<start:int,words:int,sha:binary>>")
    return written(proven.select(*KEY, F.lit(False).alias("whole"), "spans").unionByName(copies.select(*KEY, F.lit(True).alias("whole"), none.alias("spans"))))


def sourced(places: DataFrame) -> DataFrame:
    """Spans of texts whose edges start in a text of smaller id, by hashes: KEY, then SPAN with the source's key and first word."""
    source = lambda at: F.struct(F.col("d").alias("d2"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), at.alias("at"))
    paths = written(places.groupBy("m", "c").agg(F.min(source(F.array_min("starts"))).alias("src"), F.first("edges").alias("edges")).withColumn("s", F.pmod("c", F.lit(SALT)).cast("int")))
    # A minimizer of many paths is told by its parts, so no task gets all its paths.
    parts = written(paths.groupBy("m", "s").agg(F.count(F.lit(1)).alias("n")))
    branching = parts.groupBy("m").agg(F.sum("n").alias("n")).filter("n > 1").select("m")
    marked = written(parts.join(branching, "m", "left_semi").select("m", "s"))
    edges = paths.join(marked, ["m", "s"], "left_semi").select("m", "c", "src", F.posexplode("edges").alias("i", "edge"))
    edges = written(edges.select("m", "c", "i", "edge", F.col("src").withField("at", F.col("src.at") + F.col("i")).alias("src")))
    least = edges.groupBy("m", "edge").agg(F.min("src").alias("edge_src"))
    by_path = edges.select("m", "c", "i", "edge").join(least, ["m", "edge"]).groupBy("m", "c").agg(F.array_sort(F.collect_list(F.struct("i", "edge_src"))).alias("x")).select("m", "c", F.transform("x", lambda x: x["edge_src"]).alias("edge_srcs"))
    known = written(paths.select("m", "c", "src").join(by_path, ["m", "c"], "left"))
    hits = places.select(*KEY, "m", "c", "starts", F.size("edges").alias("n")).join(known, ["m", "c"])
    span = lambda start, n, src: F.struct(start.cast("int").alias("start"), n.cast("int").alias("n"), src.alias("src"))
    alike = F.transform("starts", lambda s: span(s, F.col("n"), F.col("src")))
    one_by_one = F.flatten(F.transform("starts", lambda s: F.filter(F.transform("edge_srcs", lambda x, i: F.when(x["d2"] < F.col("d"), span(s + i, F.lit(1), x))), lambda x: x.isNotNull())))
    found = F.when(F.col("edge_srcs").isNotNull(), one_by_one).when(F.col("src.d2") < F.col("d"), alike)
    by_text = hits.select(*KEY, found.alias("spans")).filter(F.size("spans") > 0).groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return by_text.mapInArrow(joined_spans, f"d long, h1 long, h2 long, {SPAN}")


def joined_spans(batches: Iterator) -> Iterator:
    """Runs of edges that follow each other both in the text and in the same source become one span."""
    import pyarrow as pa

    for batch in batches:
        for begin in range(0, batch.num_rows, 1024):
            part = batch.slice(begin, 1024)
            flat = part.column(3).flatten()
            row = np.repeat(np.arange(part.num_rows), part.column(3).value_lengths().to_numpy(zero_copy_only=False))
            start, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            d2, p1, p2, at = (flat.field(2).field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            shift = start - at
            order = np.lexsort((start, shift, p2, p1, d2, row))
            keys = [x[order] for x in (row, d2, p1, p2, shift)]
            start, end = start[order], (start + n)[order]
            other = np.ones(len(order), bool)
            other[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
            level = np.cumsum(other) << 32  # so that ends of one group lie below all places of the next
            reached = np.maximum.accumulate(end + level)
            first = other.copy()
            first[1:] |= (start + level)[1:] > reached[:-1]
            head = np.nonzero(first)[0]
            last = np.append(head[1:], len(order)) - 1
            words = (reached - level)[last] - start[head] + WINDOW - 1
            which = pa.array(keys[0][head])
            found = [pa.array(start[head].astype(np.int32)), pa.array(words.astype(np.int32)), *(pa.array(x[head]) for x in keys[1:4]), pa.array((start - keys[4])[head].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(which) for i in range(3)), *found], [*KEY, "start", "words", "d2", "p1", "p2", "at"])


def digests(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(d2, p1, p2, at, words, sha): SHA-256 of the words of every span at its source."""
    asked = spans.select(F.col("d2").alias("d"), F.col("p1").alias("h1"), F.col("p2").alias("h2"), "at", "words").distinct().groupBy(*KEY).agg(F.collect_list(F.struct("at", "words")).alias("asked"))
    asked = written(asked)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part, out = batch.slice(begin, 64), []
                for row, (text, wanted) in enumerate(zip(byte_texts(part.column(3)), part.column(4).to_pylist(), strict=True)):
                    words = text.split()
                    out += [(row, x["at"], x["words"], span_sha(words, x["at"], x["words"])) for x in wanted]
                which, at, n, sha = zip(*out, strict=True)
                keys = [part.column(k).take(pa.array(which, pa.int32())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(sha, pa.binary())], ["d2", "p1", "p2", "at", "words", "sha"])

    sources = touched(rows, asked)[0].join(asked, KEY).dropDuplicates(KEY)
    return sources.select(*KEY, "text", "asked").mapInArrow(work, "d2 long, p1 long, p2 long, at int, words int, sha binary")


def span_sha(words: list[bytes], start: int, n: int) -> bytes:
    return hashlib.sha256(b" ".join(words[start : start + n])).digest()


def touched(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id may be among those found, and the rest: a Bloom filter of bounded size keeps the rest's texts out of a join."""
    hit = possibly_in(found.select(F.col("d").alias("key")), F.col("d"))
    return rows.filter(hit), rows.filter(~hit)


def strip(batches: Iterator) -> Iterator:
    """Leaves out the words of the found spans whose words are those of their source."""
    import pyarrow as pa

    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            counts, removed, kept = [], [], []
            wholes, found = part.column(2).to_pylist(), part.column(3).to_pylist()
            for row, text in enumerate(byte_texts(part.column(1))):
                words = text.split()
                counts.append(len(words))
                if wholes[row] or not found[row]:
                    removed.append(len(words) if wholes[row] else 0)
                    kept.append(b"" if wholes[row] else b" ".join(words))
                    continue
                gone = np.zeros(len(words), bool)
                for x in found[row]:
                    if span_sha(words, x["start"], x["words"]) == x["sha"]:
                        gone[x["start"] : x["start"] + x["words"]] = True
                removed.append(int(gone.sum()))
                kept.append(b" ".join([words[i] for i in np.nonzero(~gone)[0].tolist()]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["d", "n_words", "n_removed", "kept"])


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept (the words that stay, joined by one space).

    A word goes if some WINDOW consecutive words around it also start, in the same order, in a document of
    smaller id; all is judged on the input. Texts of fewer words, null and empty ones lose nothing. Rows that
    share an id don't count as smaller than each other, and are all returned; a null id neither loses nor gives
    anything. Ids must be whole numbers. An empty table gives no rows; other columns aren't read. What two 64-bit
    hashes (of seed and edge, or of seed and path) hold to be equal is verified at the coordinates of its source.
    """
    rows = keyed(docs, id_col, text_col)
    found = repeats(rows)
    may, rest = touched(rows, found)
    joined = may.join(found, KEY, "left").select("d", "text", "whole", "spans")
    plain = rest.select("d", "text", F.lit(False).alias("whole"), F.lit(None).cast(found.schema["spans"].dataType).alias("spans"))
    out = joined.unionByName(plain).mapInArrow(strip, "d long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("d", id_col)


def strip_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the words of repeated passages taken out of the text (see strip_repeats), all columns kept.

    A text that loses words becomes the rest joined by single spaces; others, null ones too, stay as they are.
    """
    rows = keyed(docs, id_col, text_col)
    found = repeats(rows)
    text, names = F.coalesce(F.col(text_col), F.lit("")), docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(id_col).cast("long").alias("d"), F.xxhash64(text).alias("h1"), text_sha(text).alias("h2"))
    may, rest = touched(whole, found)
    spread = may.join(found, KEY).select("d", F.col(f"row.`{text_col}`").alias("text"), "whole", "spans", "row")
    changed = spread.mapInArrow(strip_rows, spread.select("row").withColumn("kept", F.lit("")).schema)
    new = changed.select(*(F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names))
    same = may.join(found, KEY, "left_anti").unionByName(rest).select(*(F.col(f"row.`{c}`").alias(c) for c in names))
    return new.unionByName(same)


def strip_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            kept = pa.concat_arrays([x.column(3) for x in strip(iter([part]))])
            yield pa.RecordBatch.from_arrays([part.column(4), kept], ["row", "kept"])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` without the words of 50-word windows that also start in a document with a smaller id."""
    return strip_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
