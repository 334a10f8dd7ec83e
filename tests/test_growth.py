"""Work that must not grow faster than the tables, and orders that must not hang on the last bit of a float."""

import random
import re

import pytest
from oracle import connect, mismatch

from wayloom import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_gates_are_judged_once_for_equal_walks(spark, con, monkeypatch):
    """1,500 customers have 525 kinds of walks; each customer still has its row."""
    from wayloom.plans import routes

    seen, judge = [], routes.co.candidate_gates
    monkeypatch.setattr(routes.co, "candidate_gates", lambda walk, *more: seen.append(walk.select("route_id").distinct().count()) or judge(walk, *more))
    assert mismatch(catalog.QUERIES["candidate_gate_join"](spark, SF), con, catalog.ORACLE_SQL["candidate_gate_join"]) is None
    assert seen == [525]


def test_last_bits_break_no_tie(spark, tmp_path):
    """Point 4090 lies as far from segments 5130 and 3050 in everything but the last bit; the smaller id comes first."""
    import duckdb

    con = duckdb.connect()
    for name, sql in (("customer", "SELECT unnest([4090, 80132])::BIGINT AS c_custkey"), ("supplier", "SELECT range AS s_suppkey FROM range(6000)")):
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    df = catalog.QUERIES["candidate_topk_overflow"](spark, str(tmp_path))
    assert {(r.segment_id, r.r) for r in df.filter("point_id = 4090").collect()} >= {(3050, 2), (5130, 3)}
    assert mismatch(df, con, catalog.ORACLE_SQL["candidate_topk_overflow"]) is None


def test_cells_with_many_pairs_are_split(spark, con, monkeypatch):
    """With 20 candidates a task, most cells are listed in shares; the rows are the same."""
    from wayloom.operators import geometry

    monkeypatch.setattr(geometry, "PAIRS", 20)
    for name in ("grid_near_join", "segment_projection", "endpoint_snap_pairs"):
        df = catalog.QUERIES[name](spark, SF)
        assert mismatch(df, con, catalog.ORACLE_SQL[name]) is None
        assert df.rdd.getNumPartitions() > 4


def test_nearest_compares_few_nodes(spark):
    """A thousand nodes in one place and 40,000 on a grid: cells shrink, ties go to the least id, far points find none."""
    from wayloom.operators.geometry import nearest

    nodes = spark.range(40000).selectExpr("id AS node_id", "id % 200 * 1.0 AS x", "floor(id / 200) * 1.0 AS y").union(spark.range(50000, 51000).selectExpr("id", "0.25D", "0.25D"))
    points = spark.createDataFrame([(1, 10.5, 10.5), (2, 0.25, 0.25), (3, 209.0, 199.0), (4, 260.0, 0.0), (5, 219.0, 199.0)], "point_id long, px double, py double")
    found = {r.point_id: r.node_id for r in nearest(points, nodes, 20.0).collect()}
    assert found == {1: 2010, 2: 50000, 3: 39999, 5: 39999}


@pytest.mark.parametrize("name", ["junction_degree", "undirected_edge_union", "dangling_endpoint_anti_join", "arc_partition_check", "segment_decision"])
def test_tasks_go_by_rows(spark, con, monkeypatch, name):
    """Rows are dealt by their number, over more tasks than the session's partitions where there are many."""
    from wayloom.operators import lineage

    monkeypatch.setattr(lineage, "TASK_ROWS", 5000)
    df = catalog.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert any(int(x) >= 12 for x in re.findall(r"RepartitionByExpression .*, (\d+)", plan))
    assert mismatch(df, con, catalog.ORACLE_SQL[name]) is None


def test_partners_are_found_without_a_sort(spark, con):
    """The rows of the cross join go into plain minima: no sort of them, whose memory grows with pairs."""
    df = catalog.QUERIES["seed_pair_cross_join"](spark, SF)
    assert mismatch(df, con, catalog.ORACLE_SQL["seed_pair_cross_join"]) is None
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["route_pair_overlap", "overlap_review_filter"])
def test_pairs_of_routes_are_not_shuffled(spark, con, name):
    """The two length columns come with the lists; the plan joins nothing to the pairs."""
    df = catalog.QUERIES[name](spark, SF)
    assert mismatch(df, con, catalog.ORACLE_SQL[name]) is None
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_of_components_are_stored_as_columns(spark, monkeypatch):
    """No round is a checkpoint of rows; a chain of nine and a pair keep their least nodes."""
    from wayloom.operators import network

    monkeypatch.setattr(network, "checkpoint", None)
    edges = spark.range(1, 9).selectExpr("id AS a", "id + 1 AS b").union(spark.sql("SELECT 20L, 30L"))
    found = {r.node: r.component for r in network.weak_components(edges).collect()}
    assert found == {**dict.fromkeys(range(1, 10), 1), 20: 20, 30: 20}


def test_repeats_inside_a_batch_of_tiles(spark, tmp_path):
    """Tiles are read in one pass; a tile that lands twice at once is new once, and later batches know the first content."""
    import json

    from pyspark.sql import functions as F
    from test_sources import NODES, payload

    from wayloom.sources.tiles import checked_tiles, landed_objects
    from wayloom.streaming import jobs

    path, root, other = str(tmp_path / "landing"), jobs.stream_root(spark), {**NODES[0], "lat": 20.0}
    for batch in ([(2, payload(*NODES)), (2, payload(*NODES)), (1, payload(other))], [(3, payload(NODES[0])), (4, payload(other)), (5, payload({**NODES[0], "id": 0}))]):
        spark.createDataFrame([(t, json.dumps(x)) for t, x in batch], "tile long, body string").coalesce(1).write.mode("append").parquet(path)
        landed = checked_tiles(spark.readStream.schema("tile long, body string").parquet(path), F.lit("2024-02-01T00:00:00Z").cast("timestamp"))
        found = jobs.ingest(landed_objects(landed), root)
    rows = sorted((r.tile, r.id or 0, r.outcome) for r in found.collect())
    assert rows == [(1, 1, "new"), (2, 1, "conflict"), (2, 1, "conflict"), (2, 2, "new"), (2, 2, "repeat"), (3, 1, "conflict"), (4, 1, "repeat"), (5, 0, "not_whole")]


def test_rules_of_tiles_name_each_list_once(spark):
    """The texts of elements' times are read in one place, not in every rule that needs them."""
    from pyspark.sql import functions as F

    from wayloom.sources.tiles import checked_tiles

    plan = checked_tiles(spark.createDataFrame([(1, "{}")], "tile long, body string"), F.lit("2024-01-15T00:00:00Z").cast("timestamp"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RLIKE\(lambda \w+#\d+\.timestamp", plan)) == 1


def test_csv_files_hold_many_events(spark, con):
    """10,000 events are in five files, one for each header, not in twenty."""
    df = catalog.QUERIES["schema_quarantine"](spark, SF)
    assert len(df.inputFiles()) == 5
    assert mismatch(df, con, catalog.ORACLE_SQL["schema_quarantine"]) is None


def test_pool_reads_walks_once(spark, monkeypatch):
    """Vectors, lengths, features and parts of routes come from one pass over the walks."""
    from wayloom.plans import selection

    seen, walks = [], selection.walks
    monkeypatch.setattr(selection, "walks", lambda *x: seen.append(1) or walks(*x))
    pool, own, _ = selection.base_pool(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and pool.count() > 0 and own.count() == own.select("route_id", "part_id").distinct().count()


def test_gap_of_pairs_is_compiled(spark):
    """D of a pair by columns equals D by lambdas to the last bit, and the plan has no lambda."""
    from wayloom.operators import selection as sel

    q = [0.5, 0.3, 0.2]
    rows = spark.sql("SELECT array(id * 1.1, id / 3D, 7D - id) AS a, array(0.1D, id / 7D, 0D) AS b FROM range(8)").unionAll(spark.sql("SELECT array(0D, 0D, 0D), array(0D, 0D, 0D)"))
    found = sel.with_gap(rows, [sel.F.col("a")[i] + sel.F.col("b")[i] for i in range(3)], q, "d")
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.d == r.e for r in found.withColumn("e", sel.gap_of(sel.plus(sel.F.col("a"), sel.F.col("b")), q)).collect())


def test_rounds_of_swaps_store_little(spark, monkeypatch):
    """Routes lie in as many files as there are partitions, so a round's pairs are worked on by all tasks; a round stores nothing but the blocked pairs of new routes."""
    from test_selection import World

    from wayloom.operators import selection as sel

    kept, stored = [], sel.stored
    monkeypatch.setattr(sel, "stored", lambda df: kept.append(df) or stored(df))
    world = World(1)
    tables = world.tables(spark)
    rng = random.Random(8)
    sets = {f"{s}-{k}": (s, [r for b, n in world.rules.quota for r in rng.sample([r for r in range(16) if "ABC"[r % 3] == b], n)]) for s in world.scenarios for k in range(4)}
    problems = spark.createDataFrame([(k, s) for k, (s, _) in sets.items()], "problem_id string, scenario string")
    members = spark.createDataFrame([(k, r) for k, (_, own) in sets.items() for r in own], "problem_id string, route_id long")
    after, done = sel.swaps(problems, members, *tables, world.rules, world.network)
    rounds = max(r["round"] for r in done.collect())
    assert kept[0].rdd.getNumPartitions() == 4 and rounds > 0 and len(kept) <= 3 + rounds
    for name, (scenario, routes) in sets.items():
        assert {r.route_id for r in after.filter(after.problem_id == name).collect()} == set(world.swap(scenario, routes)[0])


def test_rounds_of_greedy_store_little(spark, monkeypatch):
    """A round stores what its picks share with routes, and its criteria; before, it stored six tables, most of them by one task."""
    from test_selection import World

    from wayloom.operators import selection as sel

    kept, stored = [], sel.stored
    monkeypatch.setattr(sel, "stored", lambda df: kept.append(df) or stored(df))
    world = World(1)
    starts = {f"{s}-{a}-{b}": (s, (a, b)) for s in world.scenarios for a, b in ((0, 1), (3, 4))}
    problems = spark.createDataFrame([(k, s) for k, (s, _) in starts.items()], "problem_id string, scenario string")
    members = spark.createDataFrame([(k, r) for k, (_, own) in starts.items() for r in own], "problem_id string, route_id long")
    found = sel.greedy(problems, members, *world.tables(spark), world.rules, world.network).members.collect()
    rounds = max(r["round"] for r in found)
    assert rounds > 2 and len(kept) <= 5 + 2 * (rounds + 1)
    for name, (scenario, start) in starts.items():
        assert [r.route_id for r in sorted(found, key=lambda r: r["round"]) if r.problem_id == name and r["round"]] == world.greedy(scenario, start)[1]


@pytest.mark.parametrize("most", [500_000, 10])
def test_pairs_of_routes_are_packed(spark, con, monkeypatch, most):
    """Lists of routes cost under three bytes a pair, and are the same by both ways to the lengths of routes; a task holds a share of the pairs."""
    from wayloom.operators import commons, composition
    from wayloom.plans import sets

    monkeypatch.setattr(composition, "ROUTES", most)
    monkeypatch.setattr(composition, "PAIRS", 20_000)
    monkeypatch.setattr(commons, "AT_ONCE", 50_000)
    df = composition.pair_overlap(sets.walks(spark, SF), sets.parts(spark, SF))
    assert mismatch(catalog.QUERIES["route_pair_overlap"](spark, SF), con, catalog.ORACLE_SQL["route_pair_overlap"]) is None
    assert df.rdd.getNumPartitions() > 30
    rows = [[5, 9, 2.5], [7, 2, 0.5], [1 << 40, 0, 1.0]]
    owners, counts, lengths = (commons.np.array([r[i] for r in rows], dtype=kind) for i, kind in ((0, "int64"), (1, "int64"), (2, "float64")))
    others = commons.np.array([1, 2, 3, 4, 6, 8, 9, 11, 1 << 50, 3, 9], dtype="int64")
    assert all((a == b).all() for a, b in zip(commons.unpacked(commons.packed(owners, lengths, counts, others)), (owners, lengths, counts, others), strict=True))
    many = commons.np.arange(0, 1_000_000, 7)
    assert len(commons.packed(many[:1], commons.np.ones(1), commons.np.array([len(many)]), many)) < 3 * len(many)
