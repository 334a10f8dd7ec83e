"""Benchmark decontamination by the q-gram lemma over overlapping diagonal bands, verified by banded alignment."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import table

#: Code points of a gram; of a block of an item, and between block starts; share of a block's code points that may be edited.
GRAM, BLOCK, STEP, EDITS = 8, 72, 24, 0.1
#: Grams that a block and its place must share at least; short blocks may have fewer edits for it.
LEAST_GRAMS = 12
#: Items shorter than this (after normalising) are searched for as they are, between blanks; with fewer words than SHORT_WORDS they are too short to tell.
SHORTEST, SHORT_WORDS = 40, 3
#: Code points of benchmark text that one broadcast index covers (about 40 bytes each); more are searched in rounds.
INDEX_CHARS = 4_000_000
#: Code points of text that are searched at a time; a longer text is cut into pieces that overlap by LAP.
PIECE, LAP = 1 << 19, 1024
#: Shared grams that are listed at a time.
LISTED = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 24


def normal(text: str | None) -> str:
    """Lower case, white space runs as one blank; edits of these kinds don't count."""
    return " ".join((text or "").replace("\x00", " ").lower().split())


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """Hash of the GRAM code points from each place on, doubling the length step by step."""
    h, power, length = points.astype(np.uint64) + np.uint64(1), BASE, 1
    with np.errstate(over="ignore"):
        while length < GRAM:
            h = h[:-length] * power + h[length:]
            power, length = power * power, 2 * length
        return h * BASE ^ (h >> np.uint64(29))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def budget(length: int) -> int:
    """Edits that a block may have: a tenth, but no more than leave LEAST_GRAMS grams in common by the lemma."""
    return max(0, min(int(EDITS * length), (length - GRAM + 1 - LEAST_GRAMS) // GRAM))


def blocks_of(text: str) -> list[str]:
    if len(text) <= BLOCK:
        return [text]
    starts = [*range(0, len(text) - BLOCK, STEP), len(text) - BLOCK]
    return [text[s : s + BLOCK] for s in starts]


def banded_distance(block: str, region: str, most: int) -> tuple[int, int]:
    """Least edits that turn block into some substring of region, and where it ends; most + 1 if over most.

    One row of the alignment at a time. A cell depends on the row before and, for insertions, on those left of
    it, which a running minimum settles. Cells outside the region's own diagonals don't exist, so the band is
    the region's width beyond the block's.
    """
    a, b = code_points(block), code_points(region)
    across = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    for i, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (b != x), row[1:] + 1)
        row = np.minimum.accumulate(new - across) + across
        if row.min() > most:
            return most + 1, 0
    end = int(row.argmin())
    return int(row[end]), end


@dataclass
class Index:
    """Grams of all blocks, sorted by hash, with block and offset of each."""

    items: list
    texts: list[str]
    owner: np.ndarray
    hashes: np.ndarray
    block: np.ndarray
    offset: np.ndarray
    short: dict[str, list]

    @classmethod
    def build(cls, rows: list[tuple]) -> Index:
        items, texts, owner, short = [], [], [], {}
        for item, text in rows:
            whole = normal(text)
            if len(whole) < SHORTEST:
                if whole.count(" ") + 1 >= SHORT_WORDS:
                    short.setdefault(f" {whole} ", []).append(len(items))
                    items.append(item)
                continue
            for block in blocks_of(whole):
                texts.append(block)
                owner.append(len(items))
            items.append(item)
        grams = [gram_hashes(code_points(x)) for x in texts]
        hashes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        block = np.repeat(np.arange(len(texts)), [len(g) for g in grams]).astype(np.int64)
        offset = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        return cls(items, texts, np.array(owner, np.int64), hashes[order], block[order], offset[order].astype(np.int64), short)

    def prepare(self) -> None:
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True
        lengths = np.array([len(x) for x in self.texts], np.int64)
        self.edits = np.array([budget(n) for n in lengths], np.int64)
        self.needed = lengths - GRAM + 1 - GRAM * self.edits
        self.reach = int((lengths + self.edits).max(initial=1))
        self.least = int(self.needed.min(initial=1))
        self.width = int(self.edits.max(initial=0)) + 1
        self.exact = None
        if self.short:
            import ahocorasick

            self.exact = ahocorasick.Automaton()
            for text, owners in self.short.items():
                self.exact.add_word(text, (len(text) - 2, owners))
            self.exact.make_automaton()

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """(block, first diagonal of the band) of all bands with as many shared grams as the lemma asks."""
        if len(points) < GRAM or not len(self.hashes):
            return np.zeros((0, 2), np.int64)
        grams = gram_hashes(points)
        at = np.nonzero(self.filter[grams >> np.uint64(64 - FILTER_BITS)])[0]
        # a region within budget has at least the least number of grams within its own length
        near = np.searchsorted(at, at + self.reach) - np.arange(len(at))
        dense = np.zeros(len(at) + 1, np.int64)
        for start in np.nonzero(near >= self.least)[:1]:
            np.add.at(dense, start, 1)
            np.add.at(dense, start + near[start], -1)
        at = at[np.cumsum(dense)[:-1] > 0]
        low = np.searchsorted(self.hashes, grams[at], "left")
        count = np.searchsorted(self.hashes, grams[at], "right") - low
        bands, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        cuts = np.searchsorted(np.cumsum(count), np.arange(LISTED, int(count.sum()) + LISTED, LISTED), "left") + 1
        for first, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
            part, many = at[first:stop], count[first:stop]
            if not len(part):
                continue
            place = np.repeat(part, many)
            entry = np.repeat(low[first:stop] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            block, diagonal = self.block[entry], place - self.offset[entry] + BLOCK
            band = diagonal // self.width
            key, own = np.unique(np.concatenate([block * (1 << 40) + band, block * (1 << 40) + band - 1]), return_counts=True)
            bands, inverse = np.unique(np.concatenate([bands, key]), return_inverse=True)
            found = np.bincount(inverse, np.concatenate([found, own]), len(bands)).astype(np.int64)
        bands = bands[found >= self.needed[bands >> 40]]
        return np.column_stack([bands >> 40, (bands & ((1 << 40) - 1)) * self.width - BLOCK])

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(row of the text, item, start, end, edits) of every block that aligns within its budget."""
        if self.exact is not None:
            for row, text in enumerate(texts):
                for end, (length, owners) in self.exact.iter(f" {text} "):
                    yield from ((row, owner, end - 1 - length, end - 1, 0) for owner in owners)
        joined = "\x00".join(texts)
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
        for block, diagonal in self.candidates(code_points(joined)).tolist():
            text, most = self.texts[block], int(self.edits[block])
            low, high = diagonal - most, diagonal + 2 * self.width + len(text) + most
            row = int(np.searchsorted(starts, max(0, diagonal + self.width + len(text) // 2), "right")) - 1
            row = min(row, len(texts) - 1)
            low, high = max(low, int(starts[row])), min(high, int(starts[row + 1]) - 1)
            region = joined[max(0, low) : max(0, high)]
            exact = region.find(text)
            edits, end = (0, exact + len(text)) if exact >= 0 else banded_distance(text, region, most)
            if edits <= most:
                stop = low + end - int(starts[row])
                yield row, int(self.owner[block]), max(0, stop - len(text)), stop, edits


INDEXES: dict[str, Index] = {}


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item of which the document holds a passage: n_blocks, edits, start_char, end_char.

    Items are cut into blocks of BLOCK code points, STEP apart (a shorter item is one block). A block
    is found where the text, both normalised, aligns with it with at most a tenth of its code points edited and
    shares LEAST_GRAMS q-grams or more with it: for a block of 72 that holds for up to 6 edits wherever they are, for one of
    40 for up to 2. Within those no place is missed, and so no passage of BLOCK + STEP - 1 code points or more. n_blocks counts the item's
    places, edits is their least, the span covers them. Items under SHORTEST code points are found as they are,
    between blanks; under SHORT_WORDS words, null and empty ones find nothing; neither do null and empty texts.
    Repeated rows of a document count as one; an empty table on either side gives no rows; other columns aren't read. A null
    doc_id is kept as null. The items are the query set: they are broadcast in rounds of bounded size.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    wanted = items.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).filter("t is not null")
    size = wanted.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    rounds = max(1, -(-int(size) // INDEX_CHARS))
    out = None
    for part in range(rounds):
        rows = wanted.filter(F.pmod(F.xxhash64("t"), F.lit(rounds)) == part).collect()
        shared, call = spark.sparkContext.broadcast(Index.build([(r.i, r.t) for r in rows])), uuid.uuid4().hex
        found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(search_with(shared, call, items.schema[item_col].dataType), f"doc_id {kind}, item_id {item_kind}, start_char long, end_char long, edits long")
        out = found if out is None else out.unionByName(found)
    merged = out.distinct().groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("edits").alias("edits"), F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"))
    return merged.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else merged


def search_with(shared, call: str, item_type: DataType):
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if call not in INDEXES:
            INDEXES.clear()
            INDEXES[call] = shared.value
            INDEXES[call].prepare()
        index = INDEXES[call]
        kind = to_arrow_type(item_type)
        for batch in batches:
            ids, held, size = batch.column(0), [], 0
            for i, value in enumerate(batch.column(1)):
                text = normal(value.as_py())
                for piece in range(0, max(1, len(text) - LAP), PIECE):
                    held.append((i, piece, text[piece : piece + PIECE + LAP]))
                    size += len(held[-1][2])
                    if size > PIECE:
                        yield from found_in(index, ids, held, kind)
                        held, size = [], 0
            if held:
                yield from found_in(index, ids, held, kind)

    return work


def found_in(index: Index, ids, held: list[tuple[int, int, str]], kind) -> Iterator:
    """A batch of what the pieces (row, first place, text) hold; in the middle of a lap, one piece hands over to the next."""
    import pyarrow as pa

    found = set()
    for n, item, low, high, edits in index.matches([x for *_, x in held]):
        row, piece, text = held[n]
        if (piece == 0 or high > LAP // 2) and (len(text) < PIECE + LAP or high <= PIECE + LAP // 2):
            found.add((row, item, piece + low, piece + high, edits))
    if found:
        row, item, low, high, edits = map(list, zip(*sorted(found), strict=True))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array([index.items[x] for x in item], kind), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(edits, pa.int64())], ["doc_id", "item_id", "start_char", "end_char", "edits"])


def drop_leaks(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents with no leak; all columns as they are. A null id matches nothing: judge rows that may have one by a hash of the text."""
    bad = leaks.select(F.col(id_col).alias("wayloom_leaking_id")).distinct()
    return docs.join(bad, F.col(id_col) == F.col("wayloom_leaking_id"), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of `benchmark` items in all whole `documents`: a row for each document and item found."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
