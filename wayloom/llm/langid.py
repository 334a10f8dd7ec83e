"""Language identification by prediction by partial matching: the language whose byte model codes a text shortest.

Each language has a tree of byte contexts of up to ORDER bytes. A context seen n times with d distinct next bytes
gives a seen byte c / (n + d) and leaves d / (n + d), the escape, to the context that is one byte shorter, which
shares it out among all bytes; the empty context falls back on a uniform choice. So probabilities sum to one after
every context, and a text has an exact code length under statistics that are frozen after training.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_texts, crc_of_id, table

#: Longest context in bytes.
ORDER = 4
#: Bounds of the training sample of each language: documents, and their code points together.
TRAIN_DOCS, TRAIN_CHARS = 3_000, 500_000
#: Languages whose trees share one set of tables; more languages have more sets.
TOGETHER = 8
#: Bytes that are looked up at a time, and bytes of a window of a text.
SLICE, WINDOW = 1 << 17, 256
PAD = b"\n" * ORDER


def codes_of(stream: np.ndarray, length: int) -> np.ndarray:
    """Every run of so many bytes of the stream as a number, by the place of its last byte, from place ORDER on."""
    n, code = len(stream) - ORDER, np.zeros(max(0, len(stream) - ORDER), np.uint64)
    for back in range(length - 1, -1, -1):
        code = (code << np.uint64(8)) | stream[ORDER - back : ORDER - back + n]
    return code


def places(table_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted number in a sorted table, and whether it is there."""
    at = np.minimum(np.searchsorted(table_, wanted), max(0, len(table_) - 1))
    return at, (table_[at] == wanted) if len(table_) else np.zeros(len(wanted), bool)


class Trees:
    """Context trees of some languages: for each order, the seen runs (context and byte) and the seen contexts.

    bits: code length of each seen run in each language; escapes: bits that a byte not seen after a context costs
    in each language before the shorter context codes it (none where a language hasn't the context).
    """

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        own = [np.frombuffer(b"".join(PAD + x for x in samples[k]), np.uint8).astype(np.uint64) for k in self.languages]
        fresh = [np.concatenate([np.arange(len(PAD) + len(x)) >= ORDER for x in samples[k]])[ORDER:] for k in self.languages]
        self.runs, self.bits, self.contexts, self.escapes = [], [], [], []
        for order in range(ORDER + 1):
            counted = [np.unique(codes_of(x, order + 1)[f], return_counts=True) for x, f in zip(own, fresh, strict=True)]
            runs = np.unique(np.concatenate([r for r, _ in counted]))
            counts = np.zeros((len(runs), len(own)))
            for k, (r, c) in enumerate(counted):
                counts[np.searchsorted(runs, r), k] = c
            contexts, first, inverse = np.unique(runs >> np.uint64(8), return_index=True, return_inverse=True)
            seen = np.add.reduceat(counts, first)
            distinct = np.add.reduceat((counts > 0).astype(float), first)
            below = 1.0 / 256
            if order:
                at, _ = places(self.runs[-1], runs & np.uint64((1 << 8 * order) - 1))
                below = np.exp2(-self.bits[-1][at].astype(float))
            total = (seen + distinct)[inverse]
            shared = np.where(total > 0, (counts + distinct[inverse] * below) / np.maximum(total, 1), below)
            self.runs.append(runs)
            self.bits.append((-np.log2(shared)).astype(np.float32))
            self.contexts.append(contexts)
            self.escapes.append(np.where(seen > 0, np.log2(np.maximum(seen + distinct, 1) / np.maximum(distinct, 1)), 0).astype(np.float32))

    def cost(self, stream: np.ndarray) -> np.ndarray:
        """Bits of every byte of the stream (rows), from place ORDER on, under every language (columns)."""
        code = codes_of(stream, ORDER + 1)
        out, left = np.zeros((len(code), len(self.languages)), np.float32), np.arange(len(code))
        for order in range(ORDER, -1, -1):
            at, found = places(self.runs[order], code)
            out[left[found]] += self.bits[order][at[found]]
            left, code = left[~found], code[~found]
            if not len(left):
                return out
            at, known = places(self.contexts[order], code >> np.uint64(8))
            out[left[known]] += self.escapes[order][at[known]]
            code = code & np.uint64((1 << 8 * order) - 1)
        out[left] += 8
        return out


class Models:
    """Frozen statistics of all languages, in sets of trees, and the frequencies of single bytes over all of them."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        folded = {k: [x.lower() for x in v] for k, v in samples.items()}
        self.sets = [Trees({k: folded[k] for k in self.languages[i : i + TOGETHER]}) for i in range(0, len(self.languages), TOGETHER)]
        counts = np.bincount(np.frombuffer(b"".join(x for v in folded.values() for x in v), np.uint8), minlength=256) + 1.0
        self.single = -np.log2(counts / counts.sum())

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every text (A-Z as a-z): its code length in bits under every language (columns), that of its bytes one
        by one, and the share of its windows that the language of the shortest length also codes shortest."""
        texts = [x.lower() for x in texts]
        stream = np.frombuffer(b"".join(PAD + x for x in texts), np.uint8)
        sizes = np.array([len(x) for x in texts], np.int64)
        many = np.maximum(1, -(-sizes // WINDOW))
        first = np.cumsum(many) - many
        window = np.concatenate([f + np.maximum(np.arange(-ORDER, n), 0) // WINDOW for f, n in zip(first.tolist(), sizes.tolist(), strict=True)])[ORDER:]
        real = np.concatenate([np.arange(ORDER + n) >= ORDER for n in sizes.tolist()])[ORDER:]
        bits, single = np.zeros((int(many.sum()), len(self.languages))), np.zeros(int(many.sum()))
        for start in range(0, max(0, len(stream) - ORDER), SLICE):
            part, own = stream[start : start + SLICE + ORDER], real[start : start + SLICE]
            which = window[start : start + SLICE][own]
            cost = np.concatenate([x.cost(part.astype(np.uint64)) for x in self.sets], axis=1)[own]
            for k in range(len(self.languages)):
                bits[:, k] += np.bincount(which, cost[:, k], len(bits))
            single += np.bincount(which, self.single[part[ORDER:]][own], len(bits))
        total = np.add.reduceat(bits, first)
        agree = bits.argmin(1) == np.repeat(total.argmin(1), many)
        return total, np.add.reduceat(single, first), np.add.reduceat(agree.astype(float), first) / many


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", docs: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Models:
    """Models from a bounded sample of whole labelled texts: of each language those of least hash of the id, while
    they are docs at most and have chars code points at most together (one text at least). Rows without text or
    language don't count.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h")).filter("lang is not null and text <> ''")
    n = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # A bound on the hash that lets some more than wanted through, so that what is sorted stays small.
    share = F.least(F.lit(1.0), (2 * docs + 200) / F.col("n"))
    near = rows.join(F.broadcast(n.withColumnRenamed("lang", "of")), F.col("lang") == F.col("of")).filter(F.col("h").cast("double") / 2.0**64 + 0.5 <= share)
    order = Window.partitionBy("lang").orderBy("h", "text")
    ranked = near.select("lang", "text", F.row_number().over(order).alias("r"), F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    samples: dict[str, list[bytes]] = {}
    for lang, text in ranked.filter((F.col("r") == 1) | (F.col("r") <= docs) & (F.col("c") <= chars)).select("lang", "text").toLocalIterator():
        samples.setdefault(lang, []).append(text.encode())
    return Models({k: sorted(v) for k, v in samples.items()})


MODELS: dict[str, Models] = {}


def judged(column, models: Models) -> dict[str, list]:
    """lang_pred, score, bits_per_byte, single_bits_per_byte and window_share of each text of an Arrow column."""
    texts = byte_texts(column)
    out = {"lang_pred": ["und"] * len(texts), **{x: [0.0] * len(texts) for x in ("score", "bits_per_byte", "single_bits_per_byte", "window_share")}}
    if models.languages and texts:
        bits, single, agree = models.judge(texts)
        best, least = bits.argmin(1), bits.min(1)
        share = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)
        for i, value in enumerate(column):
            if any(map(str.isalpha, value.as_py() or "")):
                found = (models.languages[best[i]], float(share[i]), least[i] / len(texts[i]), single[i] / len(texts[i]), float(agree[i]))
                for name, x in zip(out, found, strict=True):
                    out[name][i] = x
    return out


def shared_models(spark: SparkSession, models: Models):
    """A function that gives a worker the models, read once."""
    shared, call = spark.sparkContext.broadcast(models), uuid.uuid4().hex

    def get() -> Models:
        if call not in MODELS:
            MODELS.clear()
            MODELS[call] = shared.value
        return MODELS[call]

    return get


def predict(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (0 to 1, the share of the best among the languages' likelihoods), bits_per_byte
    under that language, single_bits_per_byte under the frequencies of single bytes, and window_share, the share of
    the text's windows that the same language codes shortest.

    lang_pred is `und`, and the figures 0, if the text is null or has no letter, or if no language was learned. All
    of a text counts. Equal likelihoods go to the language first by name. Repeated rows are all returned; an
    empty table gives no rows; other columns aren't read.
    """
    get, kind = shared_models(docs.sparkSession, models), docs.schema[id_col].dataType.simpleString()
    figures = ("score", "bits_per_byte", "single_bits_per_byte", "window_share")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                found = judged(part.column(1), get())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found["lang_pred"], pa.string()), *(pa.array(found[x], pa.float64()) for x in figures)], [id_col, "lang_pred", *figures])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, lang_pred string, " + ", ".join(f"{x} double" for x in figures))


def keep_identified(docs: DataFrame, models: Models, least_score: float = 0.5, least_windows: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows in one language; all columns as they are, no shuffle.

    Rejected are texts that are `und`, of which no language has least_score of the likelihood, that their language
    codes no shorter than the frequencies of single bytes or plain bytes do (random strings), or of which under least_windows
    of the windows are in the language of the whole (mixed texts). Null and empty texts are `und`; repeated rows are
    judged alike; an empty table gives no rows.
    """
    get, names = shared_models(docs.sparkSession, models), docs.columns

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                found = judged(part.column(names.index(text_col)), get())
                keep = [lang != "und" and score >= least_score and bits < min(8, single) and windows >= least_windows for lang, score, bits, single, windows in zip(*found.values(), strict=True)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def held_out() -> Column:
    return crc_of_id(F.col("doc_id")) % 3 == 1


def identify(docs: DataFrame) -> DataFrame:
    """Predictions for documents by models of those of them that aren't held out."""
    learned = train(docs.filter(~held_out()))
    found = predict(docs, learned)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of `documents`, learned from those that aren't held out."""
    return identify(table(spark, sf_dir, "documents"))
