"""Embedding whitening: leading eigenpairs of the covariance by spectrum slicing and Rayleigh quotient iteration.

Spark sums counts, totals and centred products in whole numbers, so they don't depend on the layout; the driver
sees one matrix of dimensions squared; the projection runs on Spark again.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Entries become whole numbers: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rows that a task multiplies at once.
BLOCK = 1024
#: Largest whole number that doubles hold exactly, and the room of a long.
EXACT, ROOM = 2**53, 2**62


# ---- eigenpairs of a symmetric matrix -------------------------------------------------------------------------------


def negatives(a: np.ndarray) -> int:
    """Negative eigenvalues of a symmetric matrix: those of D in P A P' = L D L' (Sylvester), D of 1x1 and 2x2 blocks.

    Pivots are chosen from the whole rest (Bunch and Parlett), so growth is bounded whatever the shift.
    """
    a, found, limit = a.copy(), 0, (1 + 17**0.5) / 8
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        most = int(off.argmax()) if len(a) > 1 else 0
        r, s = divmod(most, len(a))
        if len(a) == 1 or diagonal[p] >= limit * off[r, s]:
            if a[p, p] == 0:  # all that is left is zero
                return found
            found += int(a[p, p] < 0)
            rest = np.arange(len(a)) != p
            column = a[rest, p]
            a = a[np.ix_(rest, rest)] - np.outer(column, column) / a[p, p]
        else:
            pair, rest = [r, s], np.setdiff1d(np.arange(len(a)), [r, s])
            block = a[np.ix_(pair, pair)]
            determinant = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            found += 1 if determinant < 0 else 2 * int(block[0, 0] < 0)
            columns = a[np.ix_(rest, pair)]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(block, columns.T)
    return found


def above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues that are larger than the shift, by inertia."""
    return negatives(shift * np.eye(len(v)) - v)


def slices(v: np.ndarray, most: int) -> list[tuple[float, float, int, int]]:
    """(low, high, first, last): intervals that hold the eigenvalues numbered first to last by falling value, in order.

    Each is halved until it holds one eigenvalue and is narrow beside its distance from zero, or is too narrow to
    tell its eigenvalues apart. Those up to number `most` are told apart; what is no larger than rounding is left.
    """
    size = float(np.abs(v).sum(1).max(initial=0))
    least = size * len(v) * np.finfo(float).eps
    if not size > 0:
        return []
    done: list[tuple[float, float, int, int]] = []
    todo = [(least, size * (1 + 1e-12) + least, above(v, least), 0)]
    while todo:
        low, high, n_low, n_high = todo.pop()
        if n_low == n_high or n_high >= most:
            continue
        if (n_low - n_high == 1 and high - low <= 0.25 * low) or high - low <= 4 * least:
            done.append((low, high, n_high + 1, n_low))
            continue
        middle = (low + high) / 2
        n = above(v, middle)
        todo += [(low, middle, n_low, n), (middle, high, n, n_high)]
    return sorted(done, key=lambda x: x[2])


def rayleigh(v: np.ndarray, low: float, high: float, number: int, others: list[np.ndarray]) -> np.ndarray:
    """The eigenvector of that number, whose value lies in (low, high), orthogonal to the others.

    Two steps of inverse iteration at the middle, then Rayleigh quotients. Where they leave the interval, or don't
    settle, the interval is halved by an inertia count and the iteration goes on from its new middle.
    """

    def clean(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for o in others:
                x = x - (o @ x) * o
            x = x / np.linalg.norm(x)
        return x

    def towards(x: np.ndarray, shift: float) -> np.ndarray:
        try:
            y = np.linalg.solve(v - shift * np.eye(len(v)), x)
        except np.linalg.LinAlgError:  # the shift is the eigenvalue to the last bit
            y = np.linalg.solve(v - (shift + rounding) * np.eye(len(v)), x)
        return clean(y / np.linalg.norm(y))

    size = float(np.abs(v).sum(1).max())
    rounding = size * np.finfo(float).eps
    x, slack = clean(np.random.default_rng(number).standard_normal(len(v))), rounding * len(v)
    while True:
        x = towards(towards(x, (low + high) / 2), (low + high) / 2)
        best, residual = x, np.inf
        for _ in range(12):
            quotient = float(x @ v @ x)
            now = float(np.linalg.norm(v @ x - quotient * x))
            if not low - slack <= quotient <= high + slack or now >= residual:
                break
            best, residual = x, now
            x = towards(x, quotient)
        if residual <= slack or high - low <= 2 * slack:
            return best
        middle = (low + high) / 2
        low, high = (middle, high) if above(v, middle) >= number else (low, middle)


def eigenpairs(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Up to `most` leading eigenvalues by falling value, and their unit eigenvectors as columns.

    The inertia counts on both sides of each value certify its number; ValueError if they don't. Zero eigenvalues
    (up to rounding) have no component. Of each vector the entry of largest size is positive.
    """
    values, vectors = [], []
    rounding = np.abs(v).sum(1).max(initial=0) * len(v) * np.finfo(float).eps
    for low, high, first, last in slices(v, most):
        for number in range(first, min(last, most) + 1):
            near = [x for e, x in zip(values, vectors, strict=True) if e - high <= 1e-3 * e]
            x = rayleigh(v, low, high, number, near)
            value = float(x @ v @ x)
            if not (above(v, value + 8 * rounding) < number <= above(v, value - 8 * rounding)):
                raise ValueError(f"eigenvalue {value} isn't number {number}")
            values.append(value)
            vectors.append(x * np.sign(x[np.abs(x).argmax()]))
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors).reshape(len(vectors), len(v)).T[:, order]


# ---- sums on Spark ---------------------------------------------------------------------------------------------------


#: Entries of this size or more have no exact whole number; their vectors are left out like non-finite ones.
LARGEST = 2.0**52 / SCALE


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST))


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, x array<long>) of the usable rows, and their number of dimensions: the most frequent length, ties the least."""
    chosen = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter((F.size("v") > 0) & F.forall("v", finite))
    wide = chosen.agg(F.mode(F.size("v"), True)).first()[0] or 0
    return chosen.filter(F.size("v") == wide).select("id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + OFFSET).alias("x")), wide


def blocks(column, wide: int) -> Iterator[np.ndarray]:
    """Rows of an Arrow list column, some at a time."""
    for start in range(0, len(column), BLOCK):
        yield column.slice(start, BLOCK).flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)


def totals(vectors: DataFrame, wide: int) -> tuple[int, np.ndarray, int, int]:
    """n, the sum of every dimension as Python's whole numbers, and the least and largest entry."""

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, sums, low, high = 0, np.zeros(wide, object), 0, 0
        for batch in batches:
            for x in blocks(batch.column(0), wide):
                low, high = min(low, int(x.min())) if n else int(x.min()), max(high, int(x.max())) if n else int(x.max())
                n += len(x)
                sums += (x.sum(0) if max(abs(low), abs(high)) * len(x) < ROOM else x.astype(object).sum(0)).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * wide), pa.array(range(wide), pa.int32()), pa.array(map(Decimal, sums), pa.decimal128(38, 0)), pa.array([low] * wide), pa.array([high] * wide)], ["n", "i", "s", "low", "high"])

    parts = vectors.select("x").mapInArrow(add, "n long, i int, s decimal(38,0), low long, high long")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    sums = np.zeros(wide, object)
    for r in found:
        sums[r.i] = int(r.s)
    return (found[0].n, sums, found[0].low, found[0].high) if found else (0, sums, 0, 0)


def covariance(vectors: DataFrame, wide: int, n: int, sums: np.ndarray, low: int, high: int) -> np.ndarray:
    """Covariance with divisor n. Tasks centre by the whole part of the means and add exact products; the fractions follow."""
    means = np.array([s // n for s in sums], np.int64)
    most = max(1, *(abs(int(low) - int(m)) for m in means), *(abs(int(high) - int(m)) for m in means))
    rows = max(0, EXACT // most**2)

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        products, seen = np.zeros((wide, wide), object), np.zeros((wide, wide), np.int64)
        room = 0

        for batch in batches:
            for x in blocks(batch.column(0), wide):
                y = x - means
                if len(y) > rows:  # products beyond what doubles hold exactly
                    products += y.astype(object).T @ y.astype(object)
                    continue
                y = y.astype(np.float64)
                seen += (y.T @ y).astype(np.int64)
                room += len(y) * most**2
                if room + EXACT > ROOM:
                    products, room = products + seen.astype(object), 0
                    seen[:] = 0
        products = products + seen.astype(object)
        i, j = np.triu_indices(wide)
        for at in range(0, len(i), 65536):
            cut = slice(at, at + 65536)
            yield pa.RecordBatch.from_arrays([pa.array(i[cut], pa.int32()), pa.array(j[cut], pa.int32()), pa.array(map(Decimal, products[i[cut], j[cut]]), pa.decimal128(38, 0))], ["i", "j", "g"])

    parts = vectors.select("x").mapInArrow(add, "i int, j int, g decimal(38,0)").filter("g <> 0")
    v = np.zeros((wide, wide))
    rest = [int(s) - n * int(m) for s, m in zip(sums, means, strict=True)]
    found = {(r.i, r.j): int(r.g) for r in parts.groupBy("i", "j").agg(F.sum("g").alias("g")).toLocalIterator()}
    for i in range(wide):
        for j in range(i, wide):
            v[i, j] = v[j, i] = (n * found.get((i, j), 0) - rest[i] * rest[j]) / (n * n)
    return v


class Whitening:
    """Means and scaled eigenvectors of a table's vectors; explained shares of the trace."""

    def __init__(self, n: int, sums: np.ndarray, v: np.ndarray, low: int = 0, high: int = 0, most: int = COMPONENTS):
        self.n, self.sums, self.wide = n, sums, len(v)
        self.values, vectors = eigenpairs(v, most)
        self.vectors = vectors / np.sqrt(self.values)
        self.explained = self.values / np.trace(v) if len(self.values) else self.values
        span = max((abs(n * x - int(s)) for s in sums for x in (int(low), int(high))), default=0)
        self.kind = np.int64 if max(span, 1) * max(span, 1) * max(1, self.wide) < ROOM and max(abs(low), abs(high)) * max(n, 1) < ROOM else object

    def moved(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        return x.astype(self.kind) * self.n - self.sums.astype(self.kind)

    def whitened(self, moved: np.ndarray) -> np.ndarray:
        return (moved / self.n).astype(np.float64) @ self.vectors


def fit(vectors: DataFrame, wide: int, most: int = COMPONENTS) -> Whitening:
    n, sums, low, high = totals(vectors, wide)
    return Whitening(n, sums, covariance(vectors, wide, n, sums, low, high) if n else np.zeros((wide, wide)), low, high, most)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured over all of them."""
    k = len(model.values)

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        products, sums, n = np.zeros((k, k)), np.zeros(k), 0
        for batch in batches:
            for x in blocks(batch.column(0), model.wide):
                w = model.whitened(model.moved(x))
                products, sums, n = products + w.T @ w, sums + w.sum(0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(k * k + k), pa.int32()), pa.array(np.concatenate([products.ravel(), sums]))], ["i", "g"])

    found = np.zeros(k * k + k)
    for r in vectors.select("x").mapInArrow(add, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect():
        found[r.i] = r.g
    means = found[k * k :] / model.n
    return float(np.abs(found[: k * k].reshape(k, k) / model.n - np.outer(means, means) - np.eye(k)).max(initial=0))


def whiten(rows: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation decimal, whitened, explained, identity_error): a row for each vector and component.

    Vectors that are null, or hold null or non-finite entries (or some beyond LARGEST), are left out, and so are those of another length than
    the most frequent one. Components are numbered from 1 by falling eigenvalue, up to `most`; equal ones in any
    order of their plane. Where the vectors vary in fewer directions there are fewer components: none at all for a
    single vector or equal ones, and then no rows. Repeated rows and ids count and come back as often as they
    occur; null ids are kept; an empty table gives no rows; other columns aren't read.
    """
    vectors, wide = whole_vectors(rows, id_col, vector_col)
    model = fit(vectors, wide, most)
    k, kind = len(model.values), rows.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double"
    error = identity_error(vectors, model) if k else 0.0

    def project(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows if k else 0, BLOCK):
                part = batch.slice(start, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, model.wide)
                moved = model.moved(x)
                deviation = [Decimal(int(d)) for d in (moved * moved).sum(1)]
                row = np.repeat(np.arange(len(x)), k)
                arrays = [part.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(row), model.n, np.int64)), pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(row)), pa.array(model.whitened(moved).ravel()), pa.array(np.tile(model.explained, len(x)))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "component", "n", "deviation", "whitened", "explained"])

    out = vectors.mapInArrow(project, schema)
    return out.select(F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector of `embeddings` on the 32 leading components of all; deviation as a long (an error if it doesn't fit)."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
