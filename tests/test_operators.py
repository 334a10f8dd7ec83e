"""Rules on hand-worked values."""

import math
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from wayloom.functions import scalar
from wayloom.operators import composition, geometry, kinematics, lines, network, selection, sets
from wayloom.operators.lineage import checkpoint
from wayloom.sources import files

RULES = kinematics.TripRules()


def trip(spark, seconds, speeds, unit="m/s"):
    rows = [("T", i + 2, float(t), 21.0, 105.8, float(v), unit) for i, (t, v) in enumerate(zip(seconds, speeds, strict=True))]
    return spark.createDataFrame(rows, "trip_id string, source_row long, t double, lat double, lon double, speed double, speed_unit string")


@pytest.mark.parametrize(
    ("seconds", "speeds", "valid_s", "metres", "rpa", "pke"),
    [
        ((0, 1, 3), (0, 0, 0), 3, 0, None, None), ((0, 1, 3), (2, 2, 2), 3, 6, 0, 0), ((0, 2, 4, 6), (0, 2, 2, 0), 6, 8, 0.25, 0.5),
        ((0, 1, 3), (0, 1, 3), 3, 4.5, 1, 2), ((0, 10, 11), (0, 2, 2), 1, 2, 0, 0),
    ],
)
def test_kinematic_profiles(spark, seconds, speeds, valid_s, metres, rpa, pke):
    rows = kinematics.with_intervals(kinematics.check_points(trip(spark, seconds, speeds), RULES), RULES)
    r = kinematics.kinematic_sums(kinematics.interval_audit(rows, RULES), RULES, "trip_id").first()
    close = lambda a, b: (a is None and b is None) or a == pytest.approx(b)
    assert close(r.duration_s, valid_s) and close(r.distance_m, metres) and close(r.rpa, rpa) and close(r.pke, pke)


def test_cells_hold_all_valid_time(spark):
    rows = kinematics.with_intervals(kinematics.check_points(trip(spark, (0, 1, 3, 5), (0, 3, 9, 2)), RULES), RULES)
    audit = kinematics.interval_audit(rows, RULES)
    seconds = kinematics.speed_acceleration_cells(audit, RULES).agg(F.sum("seconds")).first()[0]
    assert seconds == pytest.approx(audit.agg(F.sum("used_s")).first()[0])


def test_order_and_unit_flags(spark):
    flags = [r.flags for r in kinematics.check_points(trip(spark, (1, 1, 0), (1, 1, 1)), RULES).orderBy("source_row").collect()]
    assert flags == [[], ["duplicate_timestamp", "nonmonotonic_time"], ["nonmonotonic_time"]]
    r = kinematics.check_points(trip(spark, (0,), (30,), "mph"), RULES).first()
    assert r.flags == ["invalid_speed_unit"] and r.gps_valid and not r.speed_valid


def test_outlier_and_gap(spark):
    rows = kinematics.with_intervals(kinematics.check_points(trip(spark, (0, 1, 30), (0, 100, 100), "km/h"), RULES), RULES).orderBy("source_row").collect()
    assert "acceleration_outlier" in rows[1].flags and not rows[1].speed_interval_valid and rows[2].flags == ["sampling_gap"]


@pytest.mark.parametrize(
    ("tags", "status", "ways"),
    [
        ({"highway": "residential", "access": "no", "motorcycle": "yes"}, "provisionally_allowed", ["forward", "backward"]), ({"highway": "residential", "motorcycle:conditional": "no @ night"}, "review_required", ["forward", "backward"]),
        ({"highway": "residential", "oneway": "-1"}, "provisionally_allowed", ["backward"]), ({"highway": "residential", "oneway": "yes", "oneway:motorcycle": "no"}, "provisionally_allowed", ["forward", "backward"]),
        ({"highway": "residential", "oneway:motorcycle": "yes", "motorcycle:backward": "yes"}, "provisionally_allowed", []), ({"highway": "trunk", "motorcycle": "yes"}, "review_required", ["forward", "backward"]),
        ({"highway": "motorway", "motorcycle": "yes"}, "excluded", ["forward"]),
    ],
)
def test_access(spark, tags, status, ways):
    r = spark.createDataFrame([(tags,)], "tags map<string,string>").select(network.way_status(F.col("tags")).alias("s"), network.directions(F.col("tags")).alias("d")).first()
    assert (r.s, r.d) == (status, ways)


@pytest.mark.parametrize(("tags", "status"), [({"barrier": "gate"}, "review_required"), ({"barrier": "gate", "motorcycle": "yes"}, "provisionally_allowed"), ({"barrier": "gate", "motorcycle": "yes", "locked": "yes"}, "review_required"), ({"x": "y"}, "provisionally_allowed")])
def test_node_access(spark, tags, status):
    assert spark.createDataFrame([(tags,)], "tags map<string,string>").select(network.node_status(F.col("tags"))).first()[0] == status


def test_segment_rules(spark):
    """Steps of a segment beyond the worst of way and node: untold directions, areas, restrictions, levels, access by direction."""
    road = {"highway": "residential"}
    ways = {
        1: (road, "provisionally_allowed"), 2: ({**road, "oneway": "reversible"}, "review_required"), 3: ({**road, "area": "yes"}, "review_required"), 4: (road, "review_required"),
        5: ({**road, "motorcycle:backward": "no"}, "provisionally_allowed"), 6: ({**road, "motorcycle:backward": "no", "oneway": "-1"}, "excluded"), 7: ({**road, "access": "no", "motorcycle:forward": "yes"}, "provisionally_allowed"),
        8: ({"highway": "motorway", "area": "yes"}, "excluded"), 9: ({**road, "access": "destination"}, "review_required"), 10: ({**road, "layer": "1"}, "review_required"), 11: (road, "review_required"), 12: ({**road, "layer": "1"}, "provisionally_allowed"),
        13: (road, "review_required"), 14: (road, "excluded"),
    }
    nodes = {10: [1, 50, 2], 11: [3, 50, 4], 12: [50, 51, 52], 13: [5, 53, 6]}  # way 12 only ends at node 50
    t = spark.createDataFrame([(k, tags) for k, (tags, _) in ways.items()], "way_id long, tags map<string,string>")
    refs = spark.createDataFrame([(w, i, x) for w, own in nodes.items() for i, x in enumerate(own)], "way_id long, pos int, node_id long")
    clash = network.level_clashes(refs, t.select("way_id", F.coalesce(F.col("tags")["layer"], F.lit("0")).alias("level")))
    assert {r.way_id for r in clash.collect()} == {10, 11}
    held = F.when(F.col("way_id") == 13, "review_required").when(F.col("way_id") == 14, "excluded").otherwise("provisionally_allowed")
    known = t.select("way_id", "tags", network.reviewed_policy(F.col("tags"), F.col("way_id") == 4, F.col("way_id").isin(10, 11)).alias("policy"), held.alias("node"))
    own = spark.createDataFrame([(100 + k, k) for k in ways] + [(200, 1), (200, 7), (201, 1), (201, 9), (202, 7), (202, 13)], "segment_id long, way_id long")
    found = {r.segment_id: r.status for r in network.segment_status(own, known).collect()}
    assert found == {**{100 + k: status for k, (_, status) in ways.items()}, 200: "provisionally_allowed", 201: "review_required", 202: "review_required"}


def test_way_split_and_turns(spark):
    refs = spark.createDataFrame([("w", i, n, n in (2, 3)) for i, n in enumerate([1, 2, 3, 4])], "way_id string, pos long, node_id long, cut boolean")
    assert sorted((r.start_index, r.end_index) for r in network.split_ways(refs).collect()) == [(0, 1), (1, 2), (2, 3)]
    arcs = spark.createDataFrame([("a", 1, 2, 1.0), ("b", 2, 3, 1.0), ("c", 2, 4, 1.0)], "arc_id string, from_node long, to_node long, length_m double")
    for kind, legal in (("no", ("a", "c")), ("only", ("a", "b"))):
        rules = spark.createDataFrame([(1, "a", "b", kind)], "restriction_id long, from_arc string, to_arc string, kind string")
        assert [tuple(r) for r in network.successors(arcs, rules).collect()] == [legal]


def test_shortest_paths(spark):
    arcs = spark.createDataFrame([(i, i, i + 1, 1.0) for i in range(5)] + [(9, 0, 3, 2.5)], "arc_id long, from_node long, to_node long, length_m double")
    rules = spark.createDataFrame([], "restriction_id long, from_arc long, to_arc long, kind string")
    legal = checkpoint(network.successors(arcs, rules))
    best = network.shortest_paths(legal, arcs, spark.createDataFrame([(0, 0), (0, 9)], "origin long, arc_id long"))
    assert {r.arc_id: r.cost for r in best.collect()} == {0: 1.0, 1: 2.0, 2: 3.0, 9: 2.5, 3: 3.5, 4: 4.5}


def brute_path(arcs, legal, origin, anchors, once):
    """Least (cost, path) over all label-free walks, with the cost of the best known as the only bound."""
    best = [None]

    def go(path, parts, done, cost):
        if best[0] is not None and (cost, path) > best[0] and cost >= best[0][0]:
            return
        if done == len(anchors):
            best[0] = min(best[0] or (cost, path), (cost, path))
            return
        if len(path) > 8:
            return
        for a, (part, start, end, step) in arcs.items():
            if (path and ((path[-1], a) not in legal or part == parts[-1])) or (not path and start != origin) or (once and part in parts):
                continue
            go((*path, a), (*parts, part), done + (end == anchors[done]), cost + step)

    go((), (), 0, 0.0)
    return best[0]


@pytest.mark.parametrize("once", [False, True])
def test_anchored_paths(spark, once):
    """Random graphs with turn rules and parts of several arcs: the same costs as all walks of up to eight arcs."""
    import random

    rng, found, wanted = random.Random(11), {}, {}
    arcs, problems, legal = {}, {}, set()
    for g in range(6):
        own = {g * 100 + i: (g * 100 + i // 2, g * 10 + rng.randrange(6), g * 10 + rng.randrange(6), float(rng.randrange(1, 5))) for i in range(20)}
        arcs |= own
        legal |= {(x, y) for x in own for y in own if own[x][2] == own[y][1] and rng.random() < 0.9}
        for _ in range(3):
            problems[len(problems)] = (g * 10 + rng.randrange(6), rng.sample([g * 10 + i for i in range(6)], 2))
    for k, (origin, anchors) in problems.items():
        wanted[k] = brute_path(arcs, legal, origin, anchors, once)
    table = spark.createDataFrame([(a, *rest) for a, rest in arcs.items()], "arc_id long, part_id long, from_node long, to_node long, cost double")
    asked = spark.createDataFrame([(k, o, a) for k, (o, a) in problems.items()], "problem_id long, origin long, anchors array<long>")
    found = {r.problem_id: (r.cost, tuple(r.arc_ids)) for r in network.anchored_paths(table, spark.createDataFrame(sorted(legal), "from_arc long, to_arc long"), asked, once).collect()}
    for k, best in wanted.items():
        if best is None:
            assert k not in found or len(found[k][1]) > 8
        else:
            assert found[k][0] == best[0]
            path = found[k][1]
            assert all(pair in legal for pair in zip(path, path[1:])) and (not once or len({arcs[a][0] for a in path}) == len(path))
    assert 8 < sum(x is not None for x in wanted.values())


def least_path(arcs, after, origin, anchors):
    """Least (cost, path) over the states (arc, anchors passed), cheapest first."""
    import heapq

    def step(cost, path, done, a):
        return cost + arcs[a][3], (*path, a), done + (arcs[a][2] == anchors[done])

    heap, seen = [step(0.0, (), 0, a) for a in arcs if arcs[a][1] == origin], set()
    heapq.heapify(heap)
    while heap:
        cost, path, done = heapq.heappop(heap)
        if done == len(anchors):
            return cost, path
        if (path[-1], done) not in seen:
            seen.add((path[-1], done))
            for a in after.get(path[-1], ()):
                heapq.heappush(heap, step(cost, path, done, a))
    return None


@pytest.mark.parametrize("costs", [(1.0, 2.0, 3.0), (0.25, 2.0, 7.5)])
def test_anchored_paths_write_few_labels(spark, monkeypatch, costs):
    """Equal costs give the least path; labels stay near the anchors: fewer than a third of problems times arcs are written where a step is the least cost."""
    import random

    rng, nodes = random.Random(5), 400
    arcs = {i: (i // 2, rng.randrange(nodes), rng.randrange(1, nodes), rng.choice(costs)) for i in range(4 * nodes)}
    starting = {}
    for a, (_, start, _, _) in arcs.items():
        starting.setdefault(start, []).append(a)
    legal = sorted((x, y) for x in arcs if rng.random() < 0.9 for y in starting.get(arcs[x][2], ()) if rng.random() < 0.9)
    after = {}
    for x, y in legal:
        if arcs[x][0] != arcs[y][0]:
            after.setdefault(x, []).append(y)
    # node 0 is never reached; one anchor, three, the same twice, and the origin itself are asked for as well
    problems = {k: (rng.randrange(nodes), [rng.randrange(1, nodes) for _ in range(2)]) for k in range(30)}
    problems |= {30: (7, [0, 9]), 31: (7, [9, 0]), 32: (8, [21]), 33: (9, [5, 77, 130]), 34: (11, [42, 42]), 35: (12, [12, 60])}
    wanted = {k: least_path(arcs, after, o, found) for k, (o, found) in problems.items()}
    written, keep = [], network.stored
    monkeypatch.setattr(network, "stored", lambda df: written.append(keep(df)) or written[-1])
    table = spark.createDataFrame([(a, *rest) for a, rest in arcs.items()], "arc_id long, part_id long, from_node long, to_node long, cost double")
    asked = spark.createDataFrame([(k, o, a) for k, (o, a) in problems.items()], "problem_id long, origin long, anchors array<long>")
    rows = network.anchored_paths(table, spark.createDataFrame(legal, "from_arc long, to_arc long"), asked).collect()
    assert {r.problem_id: (r.cost, tuple(r.arc_ids)) for r in rows} == {k: x for k, x in wanted.items() if x}
    assert len(rows) > 25
    feasible = {k for k, x in wanted.items() if x}
    labels = sum(df.filter(df.problem_id.isin(*feasible)).count() for df in written if {"problem_id", "arc_id", "path"} <= set(df.columns))
    assert costs[0] < 1 or labels < len(feasible) * len(arcs) / 3  # steps wider than the least cost write their labels again


@pytest.mark.parametrize(("lengths", "caps", "slots"), [((46, 25, 24, 5), (10, 10, 10, 10), (5, 3, 2, 0)), ((40, 30, 20, 10), (0, 3, 10, 10), (0, 3, 5, 2))])
def test_largest_remainder(spark, lengths, caps, slots):
    rows = [("A", f"RC{i + 1}", float(m), c) for i, (m, c) in enumerate(zip(lengths, caps, strict=True))]
    out = sets.largest_remainder(spark.createDataFrame(rows, "zone string, rc string, length_m double, cap long"), 10, "zone")
    assert tuple(r.slots for r in out.orderBy("rc").collect()) == slots


def test_midrank(spark):
    rows = spark.createDataFrame([("g", 1), ("g", 1), ("g", 10), ("h", 7)], "k string, v long")
    assert sorted((r.v, r.m) for r in rows.select("v", composition.midrank("v", "k").alias("m")).collect()) == [(1, 0.25), (1, 0.25), (7, 0.5), (10, 1.0)]


def test_sets_are_uniform(spark):
    candidates = spark.createDataFrame([(i, "A") for i in range(4)], "route_id long, bucket string")
    drawn = sets.sampled_sets(candidates, 6000, spark.createDataFrame([("A", 2)], "bucket string, slots int"), seed=3)
    counts = [r["count"] for r in drawn.groupBy("sample_id").agg(F.array_sort(F.collect_list("route_id")).alias("s")).groupBy("s").count().collect()]
    assert len(counts) == 6 and all(850 <= n <= 1150 for n in counts)


def test_greedy_against_brute_force(spark):
    cells = [("A", "RC1", 5.0), ("A", "RC2", 3.0), ("B", "RC1", 2.0)]
    lengths = {1: (9, 0, 1), 2: (0, 8, 1), 3: (4, 4, 4), 4: (1, 1, 6), 5: (5, 3, 2), 6: (7, 1, 0)}
    schema = "scenario string, route_id long, bucket string, stratum string, eligible boolean, v array<double>, p array<double>, bins array<string>, unique_m double"
    pool = spark.createDataFrame([("x", i, "x" if i < 5 else "y", "s", True, [float(m) for m in row], [0.0] * 3, [], 1.0) for i, row in lengths.items()], schema)
    chosen = [2, 4, 6]
    problems, members = spark.createDataFrame([(0, "x")], "problem_id long, scenario string"), spark.createDataFrame([(0, i) for i in chosen], "problem_id long, route_id long")
    rules = selection.Rules((("x", 2), ("y", 1)), diversity=0.0, domain_worse=9.0)  # no guard binds
    scenarios, parts = spark.createDataFrame([("x", 0.5)], "scenario string, fraction double"), spark.createDataFrame([], "route_id long, part_id long, length_m double")
    network_ = selection.Network(tuple(q for *_, q in cells), tuple(z for z, *_ in cells))
    found = selection.swaps(problems, members, pool, parts, scenarios, rules, network_)[1].orderBy("round").collect()

    def gap(ids):
        total = [sum(lengths[j][k] for j in ids) for k in range(3)]
        return 0.5 * sum(abs(q / 10 - t / sum(total)) for (_, _, q), t in zip(cells, total, strict=True))

    for r in found:
        options = {(round(gap([*(set(chosen) - {o}), i]), 10), i, o) for o in chosen for i in lengths if i not in chosen and (o < 5) == (i < 5)}
        d, i, o = min(options)
        assert (r.in_id, r.out_id) == (i, o) and d < gap(chosen)
        chosen = [*(set(chosen) - {o}), i]
    assert found and not any(gap([*(set(chosen) - {o}), i]) < gap(chosen) - 1e-9 for o in chosen for i in lengths if i not in chosen and (o < 5) == (i < 5)) or len(found) == 4


def test_components_of_a_path_take_few_rounds(spark, monkeypatch):
    made, checkpoint = [], network.checkpoint
    monkeypatch.setattr(network, "checkpoint", lambda df: made.append(df.columns) or checkpoint(df))
    edges = spark.createDataFrame([(i, i + 1) for i in range(256)] + [(1000, 1001)], "a long, b long")
    found = {r.node: r.component for r in network.weak_components(edges).collect()}
    assert found == {**dict.fromkeys(range(257), 0), 1000: 1000, 1001: 1000}
    assert sum(c == ["a", "b"] for c in made) - 1 <= 12


def test_national_grid_there_and_back(spark):
    """Within a millimetre over the zone; the datum shift moves places by some 200 m; zero shift at the map's own origin."""
    rows = spark.createDataFrame([(float(lat), 105.0 + dlon) for lat in (8, 15.5, 21, 23.4) for dlon in (-3.0, -0.4, 0.0, 1.7, 3.0)], "lat double, lon double")
    rows = rows.select("lat", "lon", scalar.national_grid(F.col("lat"), F.col("lon")).alias("n"), *(v.alias(n) for v, n in zip(scalar.metric_grid(F.col("lat"), F.col("lon")), ("gx", "gy"), strict=True)))
    la, lo = scalar.metric_degrees(F.col("gx"), F.col("gy"))
    rows = rows.select("lat", "lon", "n.x", "n.y", "gx", "gy", scalar.national_degrees(F.col("n.x"), F.col("n.y")).alias("w"), la.alias("lat3"), lo.alias("lon3"))
    for r in rows.select("*", F.col("w.lat").alias("lat2"), F.col("w.lon").alias("lon2")).collect():
        for a, b in ((r.lat2, r.lon2), (r.lat3, r.lon3)):
            assert abs(a - r.lat) * 111_000 < 1e-3 and abs(b - r.lon) * 111_000 < 1e-3
        assert 100 < math.hypot(r.x - r.gx, r.y - r.gy) < 300


def test_lines(spark):
    """A bent line with a repeated point: places, tangents that look past the bend, and a closed line."""
    line = "array(named_struct('x', 0d, 'y', 0d), named_struct('x', 0d, 'y', 0d), named_struct('x', 10d, 'y', 0d), named_struct('x', 10d, 'y', 10d))"
    closed = "array(named_struct('x', 0d, 'y', 0d), named_struct('x', 3d, 'y', 0d), named_struct('x', 0d, 'y', 0d))"
    df = spark.range(1).select(F.expr(line).alias("a"), F.expr(closed).alias("c"))
    at = lambda m: lines.point_at(F.col("a"), F.lit(m))
    r = df.select(*(at(m).alias(f"p{i}") for i, m in enumerate((0.0, 4.0, 10.0, 15.0, 20.0, 21.0))), lines.tangent(F.col("a"), 12.0).alias("t"), lines.tangent(F.col("a"), 12.0, True).alias("i"), lines.tangent(F.col("c"), 6.0).alias("k"), lines.turn_angle(F.col("a"), F.col("a"), 5.0).alias("turn")).first()
    assert [tuple(r[f"p{i}"]) for i in range(5)] == [(0, 0), (4, 0), (10, 0), (10, 5), (10, 10)] and r.p5 is None
    assert tuple(r.t) == (10, 2) and tuple(r.i) == (2, 10) and tuple(r.k) == (3, 0) and abs(r.turn + 90) < 1e-9
