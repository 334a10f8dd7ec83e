"""Near copies by the Jaccard similarity of word shingles: SimHash fingerprints find candidates, the shingles decide.

The fingerprints of whole texts meet by Golay keys, as in simhash.py, which find all that differ in 2 bits or fewer. At
a similarity of 0.8 they differ in about ten of 64 bits. So a text also gets a fingerprint of each of several small
samples of its shingles, those of least hash under a permutation; texts that share all shingles of a sample have the
same fingerprint, which is a key without error (banding of min-hashes; one other shingle of four changes a dozen bits,
so Golay keys of samples would find no more).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, side, written
from .components import components
from .simhash import links as golay_links
from .url_filter import possibly_in

SEED = 42
#: Words of a shingle, and the similarity from which texts are near copies.
SHINGLE, SIMILAR = 5, 0.8
#: Permutations, and shingles of a sample (the least of BAND permutations): at 0.8, all 24 samples miss 3 pairs in a million.
HASHES, BAND = 96, 4
#: A key with more texts isn't paired up. Each of its texts is compared with HUBS of them; what isn't linked then
#: meets by its rarest shingles.
PAIRED, HUBS = 16, 1
#: Rounds in which the texts of a rare shingle are compared with one of them, before those left apart are paired up.
STAR_ROUNDS = 2
#: Candidates that are compared agree in so many min-hashes at least; a pair at 0.8 has 77 in the mean, with a deviation of 4.
AGREED = 60

RNG = np.random.default_rng(SEED)
MULTIPLIERS = RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = RNG.integers(0, 2**64, HASHES, dtype=np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles; a shorter text is one shingle, one without a word has none."""
    import xxhash

    words, digest = text.lower().split(), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    parts = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    return np.unique(np.fromiter((digest(x, SEED) for x in parts), np.uint64, len(words) - SHINGLE + 1))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def min_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sixteen bits of the least value under each permutation, as uint16, and the shingle that has it."""
    least, held = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64), np.zeros(HASHES, np.uint64)
    for start in range(0, len(hashes), 1024):
        part = hashes[start : start + 1024]
        values = (part[None, :] ^ MASKS[:, None]) * MULTIPLIERS[:, None]
        at = values.argmin(1)
        own = values[np.arange(HASHES), at]
        better = own < least
        least, held = np.where(better, own, least), np.where(better, part[at], held)
    return ((least >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.uint16), held


def sample_prints(held: np.ndarray) -> np.ndarray:
    """SimHash fingerprint of each sample of BAND shingles: a bit is set if it is set in over half of them."""
    bits = np.unpackbits(held.reshape(-1, BAND).view(np.uint8).reshape(-1, BAND, 8), axis=2)
    return np.packbits(2 * bits.sum(1) > BAND, axis=1).view(np.uint64).ravel()


def whole_print(hashes: np.ndarray) -> int:
    """SimHash fingerprint of a whole set of shingles; of an empty one zero."""
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[start : start + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view(np.int64)[0])


def text_print(docs: DataFrame, text_col: str = "text"):
    """A row's text in 64 bits: with the id it tells apart rows that share an id."""
    return F.xxhash64(docs[text_col])


def document_signs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_print, node, fp, signs, prints) of every row; node is a hash of the whole set of shingles, fp its fingerprint."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                sets = [shingles(x) for x in byte_texts(part.column(2))]
                node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
                fp = np.array([whole_print(x) for x in sets], np.int64)
                found = [min_hashes(x) for x in sets]
                signs, prints = [x.tobytes() for x, _ in found], [sample_prints(x).tobytes() for _, x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node), pa.array(fp), pa.array(signs, pa.binary()), pa.array(prints, pa.binary())], ["doc_id", "text_print", "node", "fp", "signs", "prints"])
            pa.default_memory_pool().release_unused()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_print(docs, text_col).alias("text_print"), F.col(text_col).alias("text")).mapInArrow(work, f"doc_id {kind}, text_print long, node long, fp long, signs binary, prints binary")


def with_keys(nodes: DataFrame, source: str, keys_of) -> DataFrame:
    """(key, node) of each node, by keys_of(its bytes in the column source)."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                keys = keys_of(part.column(1).to_pylist())
                node = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(node, keys.shape[1]))], ["key", "node"])

    return nodes.select("node", source).mapInArrow(work, "key long, node long")


def print_keys(prints: list[bytes]) -> np.ndarray:
    """Fingerprints of the samples, told apart by the sample's number."""
    prints_ = np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)
    return ((prints_ ^ (np.arange(1, prints_.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def rare_shingles(texts: DataFrame) -> DataFrame:
    """(shingle, node, size, at): the rarest shingles of each text (node, text), and each one's place from the rarest on.

    Similar texts share a shingle among the rarest of each: if size - SIMILAR * size + 1 of them, rounded down, aren't in
    the other, too few are left. Those that no other text has come first and bring nobody together, so they have no row.
    """

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                sets = [shingles(x) for x in byte_texts(part.column(1))]
                sizes = np.array([len(x) for x in sets], np.int64)
                node = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(node, sizes)), pa.array(np.repeat(sizes, sizes))], ["shingle", "node", "size"])
            pa.default_memory_pool().release_unused()

    held = written(texts.select("node", "text").mapInArrow(work, "shingle long, node long, size long"))
    common = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ranked = held.join(common, "shingle").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("ranked"))
    own = F.col("size") - F.size("ranked")
    first = F.col("size") - F.ceil(F.col("size") * SIMILAR - 1e-9) + 1 - own
    rare = ranked.withColumn("own", own).select("node", "size", "own", F.posexplode(F.slice("ranked", 1, F.greatest(first, F.lit(0)).cast("int"))).alias("at", "x"))
    return written(rare.select("x.shingle", "node", "size", (F.col("own") + F.col("at")).alias("at")))


def may_be_similar(x: str, y: str):
    """Whether texts whose first common shingle is at these places can still share enough."""
    return F.least(F.col(f"{x}.size") - F.col(f"{x}.at"), F.col(f"{y}.size") - F.col(f"{y}.at")) >= (F.col(f"{x}.size") + F.col(f"{y}.size")) * (SIMILAR / (1 + SIMILAR)) - 1e-9


def agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in AGREED min-hashes."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, HASHES) for k in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).sum(1) >= AGREED))

    of = lambda c: nodes.select(F.col("node").alias(c), F.col("signs").alias(f"signs_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "signs_a", "signs_b").mapInArrow(work, "a long, b long")


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) have a similarity of SIMILAR or more."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            part = columns = known = None
            for start in range(0, batch.num_rows, 64):
                part, keep = batch.slice(start, 64), []
                known = {}
                columns = [(part.column(k).to_pylist(), byte_texts(part.column(k + 2))) for k in (0, 1)]
                for i in range(part.num_rows):
                    for node, text in columns:
                        if node[i] not in known:
                            known[node[i]] = shingles(text[i])
                    keep.append(similarity(*(known[node[i]] for node, _ in columns)) >= SIMILAR)
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            del batch, part, columns, known
            pa.default_memory_pool().release_unused()  # texts of a batch; the worker goes on to other tasks

    of = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_print and component_id, the smallest doc_id it reaches over links.

    Texts link when the Jaccard similarity of their sets of SHINGLE words (ASCII lower case) is SIMILAR or more;
    texts without a word link with each other. Candidates come by fingerprints of samples; those that also agree in
    AGREED min-hashes are compared by the shingles, so no link is false; a pair at exactly 0.8 is missed by all samples
    in 3 of a million cases. Texts of a key with more than PAIRED first link to some of its members; those that then are
    in one component need no comparison. The others meet by their rarest shingles, which miss none: first each with one
    text of a shingle, then all that are still apart and may share enough by the shingles' places. Equal sets meet
    before any of this. Rows with
    a null id keep a null component and link nothing; repeated rows are all returned; an empty table gives no
    rows; other columns aren't read.
    """
    rows = written(document_signs(docs, id_col, text_col))
    nodes = written(rows.filter("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_print")).alias("held"), F.first("fp").alias("fp"), F.first("signs").alias("signs"), F.first("prints").alias("prints")))
    keys = written(with_keys(nodes, "prints", print_keys))
    sizes = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = written(keys.join(side(sizes), "key"))
    few, many = shared.filter(F.col("n") <= PAIRED), shared.filter(F.col("n") > PAIRED)
    pairs_of = lambda k: k.alias("x").join(k.alias("y"), "key").filter("x.node < y.node").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    hubs = many.groupBy("key").agg(F.array_distinct(F.array(*(F.min_by("node", F.xxhash64("node", F.lit(k), "key")) for k in range(HUBS)))).alias("hubs"))
    stars = many.join(hubs, "key").select("node", F.explode("hubs").alias("hub")).filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    close = golay_links(nodes.select("fp", "node"))
    pairs = written(agreeing(pairs_of(few).union(stars).union(close).distinct(), nodes))

    def with_texts(some: DataFrame) -> DataFrame:
        held = written(nodes.join(some, "node", "left_semi").select("node", F.col("held.doc_id").alias("i"), F.col("held.text_print").alias("p")))
        own = docs.select(F.col(id_col).alias("i2"), text_print(docs, text_col).alias("p2"), F.col(text_col).alias("text"))
        own = own.filter(possibly_in(held.select(F.col("p").alias("key")), F.col("p2")))
        return written(side(held).join(own, (F.col("i") == F.col("i2")) & (F.col("p") == F.col("p2"))).dropDuplicates(["node"]).select("node", "text"))

    links = written(similar(pairs, with_texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())))
    found = components(links)
    crowd = written(many.select("node").distinct())
    texts = None if crowd.isEmpty() else with_texts(crowd)
    rare = None if texts is None else rare_shingles(texts)
    last = False
    for turn in count(1) if rare is not None else ():
        label = written(crowd.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("c")))
        keyed = rare.join(side(label), "node")
        drawn = F.xxhash64("node", F.lit(turn), "shingle")
        near = F.struct(F.col("at") / F.col("size"), drawn)  # the text with the least of its own is similar to most
        mixed = keyed.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("size").alias("least"), F.min_by(F.struct("node", "c", "size", "at"), near if turn == 1 else drawn).alias("hub")).filter("low < high").select("shingle", "least", "hub")
        within = (F.col("size") - F.col("at")) >= (F.col("size") + F.col("least")) * (SIMILAR / (1 + SIMILAR)) - 1e-9
        apart = written(keyed.alias("x").join(mixed, "shingle").filter(within).select("x.*", "hub"))
        if apart.isEmpty():
            break
        if last:
            left = apart.drop("hub")
            cross = left.alias("x").join(left.alias("y"), "shingle").filter("x.node < y.node AND x.c <> y.c").filter(may_be_similar("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        else:
            cross = apart.alias("x").filter("c <> hub.c").filter(may_be_similar("x", "hub")).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
        more = written(similar(written(cross.distinct()), texts))
        if not more.isEmpty():
            links = written(links.union(more))
            found = components(links)
        if last:
            break
        last = turn >= STAR_ROUNDS or more.isEmpty()
    classes = nodes.select("node", "first_id").join(found, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("c"))
    classes = written(classes)
    least = classes.groupBy("c").agg(F.min("first_id").alias("component_id"))
    named = classes.join(least, "c").select(F.col("node").alias("node2"), "component_id")
    out = rows.join(named, F.col("node") == F.col("node2"), "left")
    return out.select(F.col("doc_id").alias(id_col), "text_print", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
