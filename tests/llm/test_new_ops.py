"""Whitening, sharding and conversation repair against brute force and on awkward tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from wayloom.llm import conversations, queries, sharding, whitening
from wayloom.llm.common import table

# ---- whitening


def symmetric(kind, rng):
    if kind == "spread":
        a = rng.standard_normal((500, 40)) * np.linspace(1, 30, 40)
        return a.T @ a / 500
    if kind == "clusters":
        q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
        e = np.ones(40)
        e[:6] = [7, 7, 7, 3, 3 - 1e-9, 2]
        v = q @ np.diag(e) @ q.T
        return (v + v.T) / 2
    if kind == "deficient":
        a = rng.standard_normal((12, 40))
        return a.T @ a / 12
    return np.zeros((5, 5)) if kind == "zero" else np.diag([4.0, 0, 0])


@pytest.mark.parametrize("kind", ["spread", "clusters", "deficient", "zero", "single"])
def test_eigenpairs(kind):
    v = symmetric(kind, np.random.default_rng(3))
    values, vectors = whitening.eigenpairs(v, 32)
    wanted = np.linalg.eigvalsh(v)[::-1]
    assert len(values) == min(32, np.linalg.matrix_rank(v))
    scale = max(1.0, np.abs(v).max())
    assert np.allclose(values, wanted[: len(values)], rtol=0, atol=1e-12 * scale)
    assert np.allclose(v @ vectors, vectors * values, rtol=0, atol=1e-11 * scale)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), rtol=0, atol=1e-10)


def test_inertia_counts():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = rng.standard_normal((9, 9)) * (rng.random((9, 9)) < 0.5)
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        if np.abs(values).min() > 1e-9:
            assert whitening.negatives(a) == (values < 0).sum()


def usable(vectors):
    return [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def check_whitened(found, vectors, most=32):
    """Against numpy over the same rows, up to signs."""
    rows = usable(vectors)
    x = np.array([[math.floor(64 * np.float64(c)) + 1_000_000 for c in v] for _, v in rows])
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    v = centred.T @ centred / n
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1][:most], basis[:, ::-1][:, :most]
    by = defaultdict(list)
    for r in found:
        by[r.component].append(r)
    assert sorted(by) == list(range(1, len(values) + 1))
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    for k, (e, b) in enumerate(zip(values, basis.T, strict=True), 1):
        own = sorted((r.vec_id is not None, r.vec_id or 0, r.whitened, int(r.deviation)) for r in by[k])
        sign = 1
        for _ in range(2):
            wanted = sorted((i is not None, i or 0, sign * w, int(d)) for (i, _), w, d in zip(rows, centred @ b / math.sqrt(e), deviation, strict=True))
            if all(a[:2] == w[:2] and abs(a[2] - w[2]) < 1e-6 and a[3] == w[3] for a, w in zip(own, wanted, strict=True)):
                break
            sign = -1
        else:
            raise AssertionError(f"component {k} differs")
        assert all(abs(r.explained / (e / np.trace(v)) - 1) < 1e-9 and r.n == n and r.identity_error < 1e-8 for r in by[k])


def test_op11(spark):
    vectors = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    check_whitened(queries.QUERIES["op11_whitening"](spark, SF).collect(), vectors)


def test_whitening_on_odd_tables(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.gauss(0, 1 + j) for j in range(4)]) for i in range(60)]
    vectors += [(None, [1.0, 2.0, 3.0, 4.0]), (7, None), (8, [1.0, None, 2.0, 3.0]), (9, [float("nan"), 1.0, 1.0, 1.0]), (10, [1.0, float("inf"), 1.0, 1.0]), *vectors[:3]]
    schema = "vec_id long, embedding array<double>, id int, x int, n int, component int, whitened int"
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in [*vectors, (11, [1.0, 2.0]), (12, [])]], schema)
    found = whitening.whiten(df).collect()
    check_whitened(found, vectors, 4)
    again = {(r.vec_id, r.component, r.whitened) for r in whitening.whiten(df.repartition(7)).collect()}
    assert again == {(r.vec_id, r.component, r.whitened) for r in found}  # the layout doesn't matter
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.filter("vec_id = 7")).collect() == []
    assert whitening.whiten(df.filter("vec_id = 20")).collect() == []  # one vector varies in no direction
    line = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}
    large = spark.createDataFrame([(i, [rng.gauss(0, 1e9), rng.gauss(0, 1e9)]) for i in range(50)], "vec_id long, embedding array<double>")
    own = [(r.vec_id, r.embedding) for r in large.collect()]
    check_whitened(whitening.whiten(large).collect(), own, 2)  # beyond what a long holds


# ---- sharding


def check_shards(found, texts, n_shards):
    """found: (id, text, size, shard, slot) tuples."""
    assert sorted((str(i), str(t)) for i, t, *_ in found) == sorted((str(i), str(t)) for i, t in texts)
    slots, sums = defaultdict(list), [0] * n_shards
    for _, text, size, shard, slot in found:
        assert size == len((text or "").encode()) + 8 and 0 <= shard < n_shards
        slots[shard].append(slot)
        sums[shard] += size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(sums) - min(sums) <= max((x[2] for x in found), default=0) + 1


def plain_rows(df):
    return [(r.record.doc_id, r.record.text, r.size, r.shard, r.slot) for r in df.collect()]


def test_op12(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = queries.QUERIES["op12_sharding"](spark, SF).collect()
    check_shards([(r.doc_id, texts[r.doc_id], r.size, r.shard, r.slot) for r in rows], texts.items(), 24)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in rows)


@pytest.mark.parametrize("n_rows, n_shards", [(0, 5), (1, 4), (3, 24), (2000, 7)])
def test_shards_of_odd_tables(spark, tmp_path, n_rows, n_shards):
    """A third of the rows are one row, another third copies of one text; nulls, a giant text, clashing names."""
    rng = random.Random(n_rows)
    made = [(1, "same row") if k % 3 == 0 else (k, "copy " * 3) if k % 3 == 1 else (None if k % 7 == 2 else k, rng.choice([None, "", "x" * rng.randrange(300), "é" * 40])) for k in range(n_rows)]
    if n_rows > 100:
        made[0] = (0, "long " * 3000)
    df = spark.createDataFrame([(i, t, 9, 9, 9, 9) for i, t in made], "doc_id long, text string, shard int, slot int, part int, record int").repartition(5)
    sharded = sharding.shards(df, n_shards)
    check_shards(plain_rows(sharded), made, n_shards)
    if n_rows > 1000:
        path = str(tmp_path / "out")
        sharding.write_shards(sharded.select(F.struct("record.doc_id", "record.text").alias("record"), "size", "shard", "slot"), path)
        back = spark.read.parquet(path)
        assert sorted((r.shard, r.shard_slot, str(r.doc_id)) for r in back.collect()) == sorted((s, slot, str(i)) for i, _, _, s, slot in plain_rows(sharded))


def test_overfull_ranges_are_cut(spark, monkeypatch):
    """With two samples a range many ranges come out too large; all but single records are cut again."""
    monkeypatch.setattr(sharding, "SAMPLES", 2)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 50 as int))").alias("text"))
    records = df.select((F.octet_length("text") + 8).cast("long").alias("size"), F.xxhash64("text").alias("k1"), F.xxhash64("doc_id").alias("k2"), F.monotonically_increasing_id().alias("k3"))
    splitters, total = sharding.ranges_of(records, 4)
    sizes = sharding.placed(records, "part", splitters).groupBy("part").agg(F.sum("size").alias("s")).collect()
    assert len(sizes) > 200 and max(r.s for r in sizes) <= 2 * total / 256 + 60


# ---- conversations

LEGAL = re.compile("(s?(ua)+)?")


def brute_audit(rows):
    """Cheapest edits of (role, fault) rows, least in ASCII order, by enumeration of whole strings with a bound."""
    best = [None]

    def go(i, state, cost, edits):
        if best[0] is not None and cost > best[0][0]:
            return
        if i == len(rows) and state in (0, 3) and (best[0] is None or (cost, edits) < best[0]):
            best[0] = (cost, edits)
        if not edits.endswith("III"):
            go(i, 3 if state == 2 else 2, cost + 5, edits + "I")
        if i < len(rows):
            role, fault = rows[i]
            stays = 5 if fault == "truncated" else 0
            if fault not in ("blank", "duplicate"):
                to = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(role[:1])
                if to:
                    go(i + 1, to, cost + stays, edits + "K")
                go(i + 1, 3 if state == 2 else 2, cost + 1 + stays, edits + "R")
            go(i + 1, state, cost + 2, edits + "D")

    go(0, 0, 0, "")
    return best[0]


def brute_repair(rows):
    """rows: (turn, role, text) of a conversation after damage."""
    rows = sorted(((t is not None, t or 0, r, x) for t, r, x in rows))
    rows = [(t if known else None, r, x) for known, t, r, x in rows]
    faults, seen = [], set()
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    cost, audit = brute_audit([(r, f) for (_, r, _), f in zip(rows, faults, strict=True)])
    lines, left, names = [], iter(rows), ""
    for edit in audit:
        row = next(left) if edit != "I" else None
        if edit == "D":
            continue
        role = row[1] if edit == "K" else "assistant" if names.endswith("u") else "user"
        names += role[:1]
        lines.append(f"{role}:{row[2] if row else ''}")
    assert LEGAL.fullmatch(names)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def brute_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        own = out[conv]
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if harm:
            row = (turn, "user" if harm == 4 else role, "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text)
            own += [row, row] if harm == 3 else [row]
    return out


def test_op13(spark):
    rows = table(spark, SF, "conversations").collect()
    wanted = {conv: brute_repair(own)[0] for conv, own in brute_damage([tuple(r) for r in rows]).items()}
    assert {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op13_conversation_repair"](spark, SF).collect()} == wanted
    assert {len(x[6]) > 0 for x in wanted.values()} == {True}


def made_conversations(n):
    rng, rows = random.Random(6), []
    for conv in range(n):
        for _ in range(rng.randrange(1, 9)):
            rows.append((conv if conv else None, rng.choice([None, *range(6)]), rng.choice([None, "system", "user", "user", "assistant", "assistant", "tool", "", "s", "a"]), rng.choice([None, "", " \t", "Yes.", "No! ", "why?\n", "cut", "cut off", "é漢."])))
    return rows


def test_repair_of_made_conversations(spark, monkeypatch):
    """Nulls, ties, repeated rows, odd roles, many batches, edits that go to a file."""
    rows = made_conversations(400)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, id int, fault int")
    monkeypatch.setattr(conversations, "REMEMBERED", 3)
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn, role if role is not None else " ", text if text is not None else " "))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {r.conv_id: tuple(r)[1:] for r in conversations.repair(df).collect()}
        lines = defaultdict(list)
        for r in conversations.repaired(df).orderBy("conv_id", "position").collect():
            assert r.position == len(lines[r.conv_id])
            lines[r.conv_id].append(f"{r.role}:{r.text}")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for conv, rest in own.items():
        figures, wanted = brute_repair(rest)
        assert found[conv] == figures and lines[conv] == wanted
    assert len(found) == len(own)
    assert conversations.repair(df.limit(0)).collect() == [] and conversations.repaired(df.limit(0)).collect() == []


def test_damage(spark):
    rows = made_conversations(300)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    harmed, dropped = conversations.damaged(df)
    found = {r.conv_id: tuple(r)[1:] for r in conversations.repair(harmed, absent=dropped).collect()}
    wanted = {conv: brute_repair(own)[0] for conv, own in brute_damage(rows).items()}
    assert found == wanted and any(x[6] == "" for x in wanted.values())


def test_one_giant_conversation(spark):
    """50,000 rows of one conversation in several batches: sound ones stay, and the faults are found."""
    n = 50_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") % 1000 == 999, "cut").otherwise(F.concat(F.lit("line "), "id", F.lit("."))).alias("text"))
    r = conversations.repair(df.repartition(8)).first()
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == (0, 0, n // 1000 - 1, 1, 0)
    assert len(r.audit.replace("I", "")) == n and r.cost == sum({"D": 2, "R": 1, "I": 5, "K": 0}[x] for x in r.audit)
