"""LM scoring: a log-bilinear model trained by noise-contrastive estimation, with exactly normalised log-probabilities.

The model predicts the class of a token from the classes of the two tokens before it. A class is one frequent
token, or all the rest together; in the rest, a token's share is (c + 1) / (N' + V' + 1), where one unseen token
is allowed for as in the base score, so the probabilities of all tokens sum to one. Since the score of a class
is a sum of one term for each context place, the normalisers of all pairs of context classes come from one
product of two matrices of exponentials.

Training covers all training tokens. A hash of id and text deals documents to shards of about SHARD tokens, and
orders them inside a shard; each round takes the shared parameters through every shard, and averages what comes out
(parameters and squared gradients) by tokens. So all of the corpus is learned from, whatever its files; but averaging
costs some of the gain, more with more shards, and the size of the model is fixed.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, crc_of_id, most_frequent, table, written

#: Classes (the first is the rest, the second the end), dimensions, noise tokens of a step, tokens of a step, rounds over the corpus.
CLASSES, DIM, NOISE, STEP, ROUNDS = 1024, 16, 64, 512, 2
RATE, SPREAD = 0.1, 0.1
#: Tokens of a shard, shards at most (beyond, shards get larger), documents of a shard that are shuffled together.
SHARD, MOST_SHARDS, BLOCK = 1_000_000, 65_536, 512
#: Tokens whose counts every executor gets (at most about 8 MB); the counts of others come by a join.
HEAD = 200_000
#: Bytes of a token; a longer one stands as a blank (which no word holds) and a 128-bit digest.
LONGEST = 64
#: Distinct tokens that a task counts before it passes them on.
COUNTED = 500_000
END = b""


def tokens_of(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, then the end (an empty byte string, which no word is)."""
    words = text.lower().split()
    if len(text) > LONGEST and max(map(len, words), default=0) > LONGEST:
        import xxhash

        words = [w if len(w) <= LONGEST else b" " + xxhash.xxh3_128_digest(w) for w in words]
    return [*words, END]


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, c) over all rows; each task adds up its own tokens first."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])
            seen.clear()
            return out

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for text in byte_texts(batch.slice(start, 64).column(0)):
                    seen.update(tokens_of(text))
                if len(seen) > COUNTED:
                    yield flush()
        yield flush()

    return texts.mapInArrow(work, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Model:
    """Parameters as rows of DIM numbers: context and target vectors of the classes, a matrix for each context place, biases."""

    def __init__(self, counts: np.ndarray, rows: np.ndarray | None = None):
        """counts: training tokens of each class."""
        self.noise = (counts + 1.0) / (counts.sum() + len(counts))
        k, rng = len(counts), np.random.default_rng(7)
        if rows is None:
            bias = np.zeros(-(-k // DIM) * DIM)
            bias[:k] = np.log(self.noise)
            rows = np.concatenate([rng.normal(0, SPREAD, (2 * k, DIM)), np.eye(DIM), np.eye(DIM), bias.reshape(-1, DIM)])
        self.rows = rows.astype(np.float32)

    def parts(self) -> tuple[np.ndarray, ...]:
        k = len(self.noise)
        r, t, c1, c2, b = np.split(self.rows, np.cumsum([k, k, DIM, DIM]))
        return r, t, c1, c2, b.reshape(-1)

    def train(self, before: np.ndarray, last: np.ndarray, token: np.ndarray, past: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of noise-contrastive steps over (class two before, class before, class); past: squared gradients so far."""
        k, log_noise = len(self.noise), np.log(NOISE * self.noise).astype(np.float32)
        r, t, c1, c2, b = self.parts()
        past_r, past_t, past_1, past_2, past_b = np.split(past, np.cumsum([k, k, DIM, DIM]))
        past_b, cumulated = past_b.reshape(-1), np.cumsum(self.noise)

        def move(value: np.ndarray, total: np.ndarray, gradient: np.ndarray, at=slice(None)) -> None:
            sums = total[at] + gradient * gradient
            total[at] = sums
            value[at] += RATE * gradient / np.sqrt(sums + 1e-6)

        def by_class(classes: np.ndarray, gradients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Classes that occur, and the sum of the gradients of each."""
            order = np.argsort(classes, kind="stable")
            ordered = classes[order]
            first = np.nonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))[0]
            return ordered[first], np.add.reduceat(gradients[order], first)

        with np.errstate(over="ignore"):
            for start in range(0, len(token), STEP):
                w2, w1, w = before[start : start + STEP], last[start : start + STEP], token[start : start + STEP]
                noise = np.minimum(np.searchsorted(cumulated, rng.random(NOISE)), k - 1)
                r1, r2, tw, tn = r[w1], r[w2], t[w], t[noise]
                h = r1 @ c1 + r2 @ c2
                scale = np.float32(1 / len(w))
                good = scale / (1 + np.exp(np.einsum("ij,ij->i", h, tw) + b[w] - log_noise[w]))
                bad = h @ tn.T
                bad += b[noise] - log_noise[noise]
                np.exp(np.negative(bad, out=bad), out=bad)
                bad += 1
                np.divide(-scale, bad, out=bad)
                dh = good[:, None] * tw + bad @ tn
                target, gradient = by_class(np.concatenate([w, noise]), np.concatenate([np.column_stack([good[:, None] * h, good]), np.column_stack([bad.T @ h, bad.sum(0)])]))
                context, back = by_class(np.concatenate([w1, w2]), np.concatenate([dh @ c1.T, dh @ c2.T]))
                move(r, past_r, back, context)
                move(t, past_t, gradient[:, :DIM], target)
                move(b, past_b, gradient[:, DIM], target)
                move(c1, past_1, r1.T @ dh)
                move(c2, past_2, r2.T @ dh)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by the class before, scores by the one two before (with bias), and log normaliser of each pair."""
        k = len(self.noise)
        r, t, c1, c2, b = self.parts()
        near, far = (r @ c1) @ t.T, (r @ c2) @ t.T + b[:k]
        a, c = near.max(1, keepdims=True), far.max(1, keepdims=True)
        z = np.log(np.exp(near - a) @ np.exp(far - c).T) + a + c.T
        return near, far, z


def class_stream(texts: list[bytes], index: dict[bytes, int]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Tokens of each text and their numbers in index (-1: none)."""
    for text in texts:
        words = tokens_of(text)
        yield words, np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))


def with_context(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two before, before, token) of all texts; two ends stand before each."""
    flat = np.concatenate([x for c in classes for x in (np.ones(2, np.int64), c)])
    fresh = np.zeros(len(flat), bool)
    at = np.cumsum([0, *(len(c) + 2 for c in classes)])[:-1]
    fresh[at] = fresh[at + 1] = True
    own = np.nonzero(~fresh)[0]
    return flat[own - 2], flat[own - 1], flat[own]


def encoded(docs: DataFrame, head: list[bytes], shards: int) -> DataFrame:
    """(shard, h, classes) of the rows (h, shard_hash, text): the classes of the tokens as two bytes each."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = {w: i + 1 for i, w in enumerate(shared.value)}
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                classes = [np.maximum(x, 0).astype(np.uint16).tobytes() for _, x in class_stream(byte_texts(part.column(2)), index)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(classes, pa.binary())], ["shard", "h", "classes"])

    return docs.select(F.pmod("shard_hash", F.lit(shards)).cast("int").alias("shard"), "h", "text").mapInArrow(work, "shard int, h long, classes binary")


def blocks_by_shard(batches: Iterator) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(shard, classes of BLOCK documents) from rows in the order of their shards; the cut of batches doesn't matter."""
    shard, held = None, []
    for batch in batches:
        for own, classes in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if held and (own != shard or len(held) == BLOCK):
                yield shard, held
                held = []
            shard = own
            held.append(np.frombuffer(classes, np.uint16).astype(np.int64))
    if held:
        yield shard, held


def train_model(rows: DataFrame, class_counts: np.ndarray, shards: int) -> Model:
    """Rounds over all shards (see the module). What reaches the driver is one row of sums for each row of parameters."""
    model = Model(class_counts)
    n_rows, past = len(model.rows), np.zeros_like(model.rows)
    names = [f"{x}{d}" for x in "vp" for d in range(DIM)]
    for turn in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast((class_counts, model.rows, past))

        def work(batches: Iterator, shared=shared, turn=turn) -> Iterator:
            import pyarrow as pa

            counts, parameters, squares = shared.value

            def sums() -> pa.RecordBatch:
                columns = np.concatenate([own.rows, own_past], axis=1).astype(np.float64) * total
                return pa.RecordBatch.from_arrays([pa.array(np.arange(n_rows)), pa.array(np.full(n_rows, float(total))), *(pa.array(columns[:, d]) for d in range(2 * DIM))], ["i", "n", *names])

            current, own, own_past, total, rng = None, None, None, 0, None
            for shard, classes in blocks_by_shard(batches):
                if shard != current:
                    if own is not None:
                        yield sums()
                    current, own, own_past, total, rng = shard, Model(counts, parameters.copy()), squares.copy(), 0, np.random.default_rng([turn, shard])
                before, last, token = with_context(classes)
                order = rng.permutation(len(token))
                own.train(before[order], last[order], token[order], own_past, rng)
                total += len(token)
            if own is not None:
                yield sums()

        dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "h", "classes")
        found = dealt.mapInArrow(work, "i long, n double, " + ", ".join(f"{x} double" for x in names)).groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in names)).toArrow().to_pydict()
        if found["i"]:
            mean = (np.array([found[x] for x in names]).T / np.array(found["n"])[:, None])[np.argsort(found["i"])]
            model, past = Model(class_counts, mean[:, :DIM].round(6)), mean[:, DIM:].astype(np.float32)
    return model


SCORERS: dict[str, tuple] = {}


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, trained_on, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    training (a condition on docs) says which rows counts and model come from; all of their tokens count, and the
    result doesn't depend on how the rows are split. A null
    or empty text is just the end token. With no training row, every token is unseen. Repeated rows are all
    returned; an empty table gives no rows; other columns aren't read.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    texts = docs.filter(training).select(F.col(text_col).alias("text"))
    counts = written(count_tokens(texts))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    found = most_frequent(counts.filter(F.length("token") > 0), "c", HEAD).toArrow().to_pydict()
    top = sorted(zip(found["token"], found["c"], strict=True), key=lambda x: (-x[1], x[0]))
    ends = counts.filter(F.length("token") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    head, head_counts = [END, *(w for w, _ in top)], np.array([ends, *(k for _, k in top)], np.int64)
    named = head_counts[: CLASSES - 1]
    class_counts = np.concatenate([[n - named.sum()], named])
    rest_mass = np.log10(float((n - named.sum()) + (v - (named > 0).sum()) + 1))
    shards = min(MOST_SHARDS, max(1, -(-int(n) // SHARD)))
    own = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.filter(training).select(F.xxhash64(id_col, own).alias("shard_hash"), F.xxhash64(own, id_col).alias("h"), F.col(text_col).alias("text"))
    model = train_model(written(encoded(keyed, head[: CLASSES - 1], shards)), class_counts, shards)
    shared, call = spark.sparkContext.broadcast((head, head_counts, model)), uuid.uuid4().hex

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if call not in SCORERS:
            SCORERS.clear()
            words, c, trained = shared.value
            SCORERS[call] = ({w: i for i, w in enumerate(words)}, np.log10(np.append(c, 0) + 1.0), np.append(c, 0) > 0, trained.tables())
        index, logs, seen, (near, far, z) = SCORERS[call]
        k = len(near)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                numbers, missing = [], []
                for words, number in class_stream(byte_texts(part.column(3)), index):
                    numbers.append(number)
                    missing.append([words[i] for i in np.nonzero(number < 0)[0].tolist()])
                w2, w1, w = with_context([np.where(x + 1 < k, x + 1, 0) for x in numbers])
                model_logs = (near[w1, w] + far[w2, w] - z[w1, w2]) / np.log(10)
                flat, at = np.concatenate(numbers), np.cumsum([0, *(len(x) for x in numbers)])[:-1]
                within = np.where(w == 0, logs[flat] - rest_mass, 0)
                sizes = np.array([len(x) for x in numbers])
                sums = [np.add.reduceat(x.astype(np.float64), at) for x in (logs[flat], model_logs + within)]
                known = np.add.reduceat(seen[flat].astype(np.int64), at)
                gaps = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, missing)]), pa.int32()), pa.array(list(chain.from_iterable(missing)), pa.binary()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(sizes), pa.array(known), pa.array(sums[0]), pa.array(sums[1]), gaps], ["row", id_col, "trained_on", "n_tokens", "known", "base", "score", "missing"])

    named_rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), F.coalesce(training, F.lit(False)).alias("trained_on"), F.col(text_col).alias("text"))
    rows = written(named_rows.mapInArrow(work, f"row long, `{id_col}` {kind}, trained_on boolean, n_tokens long, known long, base double, score double, missing array<binary>"))
    looked_up = rows.select("row", F.explode("missing").alias("token")).join(counts, "token")
    more = looked_up.groupBy("row").agg(F.count(F.lit(1)).alias("more_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("more"))
    out = rows.drop("missing").join(more.withColumnRenamed("row", "row2"), F.col("row") == F.col("row2"), "left")
    extra = F.coalesce("more", F.lit(0.0))
    return out.select(
        id_col, "trained_on", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * F.lit(float(np.log10(float(n + v + 1))))).alias("base_score"), (F.col("score") + extra).alias("score"),
    )


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every whole text of `documents`; held-out ones (crc32 of the id modulo 7 is 2) aren't learned from."""
    held = crc_of_id(F.col("doc_id")) % 7 == 2
    scored = score_texts(table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", (~F.col("trained_on")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
