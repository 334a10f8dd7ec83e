"""Toxicity by compression distance: which of two trained zstandard dictionaries shortens the windows of a text more.

Both dictionaries are trained by zstandard: the ordinary one on windows of ordinary text, the toxic one on short
windows of toxic text, with the ordinary one behind it so that ordinary words cost the same under both. Most windows
of a toxic text are ordinary, so the toxic dictionary is trained in rounds: each round keeps, of every toxic text,
the windows that it shortens most by a dictionary trained on the other folds' texts, and trains on those.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, crc_of_id, table, written

#: Bounds of the training sample: toxic and ordinary documents, and code points of one (longer ones aren't drawn).
TOXIC_DOCS, ORDINARY_DOCS, DOC_CHARS = 2_000, 8_000, 20_000
#: Words of a window, and of a window that a dictionary is trained on; level and shortest match of the compressor.
WINDOW, SHORT, LEVEL, MATCH = 8, 2, 13, 6
#: Bytes of the ordinary and the toxic dictionary, and of the text around a window; segment and match length of their training.
ORDINARY_BYTES, TOXIC_BYTES, LEAD, SEGMENT, SHARED = 65_536, 4_096, 64, 24, 6
#: Windows that the first dictionaries are trained on at most, those of least hash.
FIRST_WINDOWS = 60_000
#: Folds of the toxic sample, rounds of training, windows that a text gives in a round.
FOLDS, ROUNDS, BEST = 5, 5, 3
#: Gains that evidence tells apart.
LEAST, MOST = -3, 12
LEVELS = MOST - LEAST + 1
#: ASCII but letters and digits becomes blank.
BLANK = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(BLANK).split()


def windows_of(text: bytes, size: int = WINDOW) -> list[bytes]:
    """Consecutive windows of the whole text, each between blanks."""
    words = words_of(text)
    return [b" %b " % b" ".join(words[i : i + size]) for i in range(0, len(words), size)]


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of the samples, taken in the order of their hashes; none (empty) where they are too few to train one."""
    import xxhash
    import zstandard

    try:
        return zstandard.train_dictionary(size, sorted(samples, key=lambda x: (xxhash.xxh3_64_intdigest(x), x)), k=SEGMENT, d=SHARED).as_bytes()
    except zstandard.ZstdError:
        return b""


def compressor(dictionary: bytes):
    import zstandard

    data = zstandard.ZstdCompressionDict(dictionary or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=MATCH, strategy=zstandard.STRATEGY_BTLAZY2)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params).compress


class Scorer:
    """Two dictionaries with a calibrated threshold: a logistic curve over what the windows of a text gain."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = toxic + ordinary, ordinary
        self.weights, self.center, self.spread = np.zeros(4), np.zeros(3), np.ones(3)
        self.evidence = np.zeros(LEVELS)
        self.own = self.common = None
        #: Stands around each window: both dictionaries end in it, so a window is never stored as it is for lack of gain,
        #: and zstandard looks for no match in an input's last bytes.
        self.lead = ordinary[-LEAD:]

    def gains(self, windows: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves against the ordinary one, window by window."""
        if self.own is None:
            self.own, self.common = compressor(self.toxic), compressor(self.ordinary)
        own, common, lead = self.own, self.common, self.lead
        return np.fromiter((len(common(w)) - len(own(w)) for w in (b"%b%b%b" % (lead, w, lead[:16]) for w in windows)), np.int64, len(windows))

    def best(self, text: bytes) -> list[bytes]:
        """The short windows that gain most."""
        windows = windows_of(text, SHORT)
        gains = self.gains(windows)
        return [windows[i] for i in np.argsort(-gains, kind="stable")[:BEST].tolist() if gains[i] > 0]

    def levels(self, text: bytes) -> np.ndarray:
        """How many windows of a text have each gain, from LEAST or less to MOST or more."""
        return np.bincount(np.clip(self.gains(windows_of(text)), LEAST, MOST) - LEAST, minlength=LEVELS)

    def features(self, levels: np.ndarray) -> np.ndarray:
        """Evidence of all windows and of the strongest, and the logarithm of their number, of each text (a row of levels)."""
        strongest = np.where(levels > 0, self.evidence, 0).max(1, initial=0)
        return np.column_stack([levels @ self.evidence, strongest, np.log1p(levels.sum(1))])

    def calibrate(self, levels: np.ndarray, labels: np.ndarray) -> None:
        """Evidence of each gain, by its shares among toxic and ordinary texts, and a logistic regression by Newton steps with a small ridge."""
        if not len(levels) or labels.min() == labels.max():
            self.weights = np.array([0, 0, 0, 4.0 if labels.any() else -4.0])
            return
        share = [levels[labels == y].sum(0) + 1.0 for y in (0, 1)]
        self.evidence = np.log(share[1] / share[1].sum()) - np.log(share[0] / share[0].sum())
        rows = self.features(levels)
        self.center, self.spread = rows.mean(0), np.maximum(rows.std(0), 1e-9)
        x = np.column_stack([(rows - self.center) / self.spread, np.ones(len(rows))])
        weight = np.where(labels == 1, 1.0, 2.0)  # half of the ordinary texts aren't here, since a dictionary is trained on them
        w, ridge = np.zeros(x.shape[1]), np.diag([1.0] * 3 + [1e-6])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (weight * (p - labels)) + ridge @ w
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w))
            w = w - np.linalg.solve(hessian, gradient)
        self.weights = w

    def scores(self, texts: list[bytes]) -> np.ndarray:
        rows = self.features(np.array([self.levels(x) for x in texts], np.int64).reshape(-1, LEVELS))
        z = ((rows - self.center) / self.spread) @ self.weights[:3] + self.weights[3]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"own": None, "common": None}


def sample(docs: DataFrame, labels: DataFrame, toxic_docs: int, ordinary_docs: int) -> DataFrame:
    """(text, toxic, fold, half) of whole labelled texts, at most so many of each label: those of the least hash of the id.

    An id with several labels counts as toxic if one says so; equal texts of one label count once.
    """
    rows = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(F.col("doc_id").cast("long")), F.col("doc_id")]
    chosen = rows.filter("toxic = 1").orderBy(*order).limit(toxic_docs).union(rows.filter("toxic = 0").orderBy(*order).limit(ordinary_docs))
    texts = docs.select(F.col("doc_id").alias("d"), "text").filter((F.col("text") != "") & (F.length("text") <= DOC_CHARS))
    found = texts.join(F.broadcast(chosen), F.col("d") == F.col("doc_id")).select("text", "toxic").distinct()
    return written(found.select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), F.pmod(F.xxhash64("text", F.lit(1)), F.lit(2)).cast("int").alias("half")))


def first_windows(texts: DataFrame, size: int) -> list[tuple[int, bytes]]:
    """(fold, window) of the texts (text, fold): FIRST_WINDOWS distinct ones at most, those of least hash."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            folds, windows = batch.column(1).to_pylist(), [windows_of(x, size) for x in byte_texts(batch.column(0))]
            flat = [(f, w) for f, ws in zip(folds, windows, strict=True) for w in ws]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in flat], pa.int32()), pa.array([w for _, w in flat], pa.binary())], ["fold", "w"])

    rows = texts.select("text", "fold").mapInArrow(work, "fold int, w binary").distinct().orderBy(F.xxhash64("w"), "w", "fold").limit(FIRST_WINDOWS).toArrow().to_pydict()
    return list(zip(rows["fold"], rows["w"], strict=True))


def by_fold(texts: DataFrame, scorers: list[Scorer], schema: str, of_text) -> DataFrame:
    """Rows that of_text(scorer of the text's fold, text) gives, with fold and label before them."""
    shared = texts.sparkSession.sparkContext.broadcast(scorers)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            rows = [(f, y, x) for f, y, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), byte_texts(batch.column(0)), strict=True) for x in of_text(own[f], t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["fold", "toxic", "found"])

    return texts.select("text", "fold", "toxic").mapInArrow(work, schema)


def fit(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS) -> Scorer:
    """Dictionaries and threshold from a bounded sample of labelled rows (see the bounds above).

    Half of the ordinary texts train the ordinary dictionary. The toxic windows are found fold by fold, as the module
    says. The threshold is set by the other half of the ordinary texts, and by every toxic text under the dictionary
    of the other folds, so no text sets it that its dictionary was trained on. The sample stays in Spark; the driver
    gets windows of bounded number and LEVELS counts a text. No label of one kind gives a constant score.
    """
    rows = sample(docs, labels, toxic_docs, ordinary_docs)
    toxic = rows.filter("toxic = 1")
    ordinary = trained([w for _, w in first_windows(rows.filter("toxic = 0 and half = 0"), WINDOW)], ORDINARY_BYTES)
    found = first_windows(toxic, SHORT)

    def without(fold: int | None) -> Scorer:
        return Scorer(trained([w for f, w in found if f != fold], TOXIC_BYTES), ordinary)

    schema = "fold int, toxic int, found binary"
    for _ in range(ROUNDS):
        best = by_fold(toxic, [without(f) for f in range(FOLDS)], schema, lambda scorer, text: scorer.best(text)).toArrow().to_pydict()
        found = list(zip(best["fold"], best["found"], strict=True))
    scorer = without(None)
    judged = by_fold(rows.filter("toxic = 1 or half = 1"), [without(f) for f in range(FOLDS)], schema, lambda own, text: [own.levels(text).tobytes()]).toArrow().to_pydict()
    scorer.calibrate(np.frombuffer(b"".join(judged["found"]), np.int64).reshape(-1, LEVELS), np.array(judged["toxic"], np.int64))
    return scorer


SCORERS: dict[str, Scorer] = {}


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1) and predicted (1 if score >= 0.5). Only the text enters a score.

    All of a text counts. A null or empty text has no window and gets what the threshold says of no gain.
    Repeated rows are all returned; an empty table gives no rows; other columns aren't read.
    """
    shared, call, kind = docs.sparkSession.sparkContext.broadcast(scorer), uuid.uuid4().hex, docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if call not in SCORERS:
            SCORERS.clear()
            SCORERS[call] = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = SCORERS[call].scores(byte_texts(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, score double, predicted int")


def held_out() -> Column:
    return crc_of_id(F.col("doc_id")) % 5 == 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of `documents`, learned from the labelled ones that aren't held out. A score of 0.5 counts as toxic."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels.filter(~held_out()))).select("doc_id", held_out().alias("held_out"), "score", "predicted")
