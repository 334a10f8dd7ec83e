"""Linear referencing of polylines (array<struct<x, y>>): measures, places along a line, tangents, turns, route steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import scalar


def let(value: Column, body) -> Column:
    """body(value), computed once."""
    return F.transform(F.array(value), body)[0]


def measures(line: Column) -> Column:
    """Length from the start to each point; sums go along the line once."""
    start = F.struct(F.array().cast("array<double>").alias("m"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def further(s: Column, p: Column) -> Column:
        total = s["sum"] + F.coalesce(F.hypot(p["x"] - s["x"], p["y"] - s["y"]), F.lit(0.0))
        return F.struct(F.array_append(s["m"], total).alias("m"), total.alias("sum"), p["x"].alias("x"), p["y"].alias("y"))

    return F.aggregate(line, start, further, lambda s: s["m"])


def search(sorted_values: Column, at: Column, most: int = 20) -> Column:
    """How many of the sorted values lie before `at`, by bisection; up to 2 ** most values."""
    steps = F.array(*(F.lit(1 << b) for b in range(most - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.get(sorted_values, p + s - 1) < at, p + s).otherwise(p))


def point_at(line: Column, at: Column) -> Column:
    """The place at a length along the line; null before its start and beyond its end (half a micrometre is let pass)."""

    def placed(m: Column) -> Column:
        i = F.least(F.greatest(search(m, at), F.lit(1)), F.size(m) - 1)
        a, b = F.get(line, i - 1), F.get(line, i)
        length = F.get(m, i) - F.get(m, i - 1)
        f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(at - F.get(m, i - 1), length), F.lit(0.0))))
        inside = (F.size(m) > 1) & (at >= 0) & (at <= F.element_at(m, -1) + 5e-7)
        return F.when(inside, F.struct((a["x"] + f * (b["x"] - a["x"])).alias("x"), (a["y"] + f * (b["y"] - a["y"])).alias("y")))

    return let(measures(line), placed)


def tangent(line: Column, ahead: float, incoming: bool = False) -> Column:
    """Direction at the start (incoming: at the end), towards the place `ahead` along the line, or its other end if it is shorter.

    A chord of no length (a closed line) gives the first point that differs instead; a line of one place has no direction.
    """

    def of(pts: Column) -> Column:
        origin = F.get(pts, F.lit(0))
        chord = lambda p: F.struct((p["x"] - origin["x"]).alias("x"), (p["y"] - origin["y"]).alias("y"))
        place = F.coalesce(point_at(pts, F.lit(float(ahead))), F.element_at(pts, -1))
        far = lambda v: F.hypot(v["x"], v["y"]) >= 1e-8
        other = F.get(F.filter(pts, lambda p: F.hypot(p["x"] - origin["x"], p["y"] - origin["y"]) > 1e-8), F.lit(0))
        return let(chord(place), lambda v: F.when(far(v), v).when(other.isNotNull(), chord(other)))

    if not incoming:
        return let(line, of)
    return let(let(F.reverse(line), of), lambda v: F.when(v.isNotNull(), F.struct((-v["x"]).alias("x"), (-v["y"]).alias("y"))))


def turn_angle(before: Column, after: Column, ahead: float) -> Column:
    """Signed degrees from the direction at the end of one line to that at the start of the next; positive is left."""
    pair = F.struct(tangent(before, ahead, True).alias("a"), tangent(after, ahead).alias("b"))
    return let(pair, lambda t: F.degrees(F.atan2(t["a"]["x"] * t["b"]["y"] - t["a"]["y"] * t["b"]["x"], t["a"]["x"] * t["b"]["x"] + t["a"]["y"] * t["b"]["y"])))


def route_steps(arcs: DataFrame, network: DataFrame, ahead: float, slight: float = 45.0) -> DataFrame:
    """Steps of each route, in order, and an arrive row at its end.

    arcs: route_id, pos, line, road_key, road_name, unnamed, roundabout, from_node, to_node; network: from_node, to_node of
    all arcs. A step begins with the first arc, where the road's key or the roundabout changes, at a junction (more than one
    way on, the way back not counted) and at a turn of `slight` degrees or more. Flags say what a person should look at.
    """
    order = Window.partitionBy("route_id").orderBy("pos")
    before = lambda c: F.lag(c).over(order)
    ways = network.select("from_node", "to_node").groupBy("from_node").agg(F.collect_list("to_node").alias("ways"))
    rows = arcs.select("route_id", "pos", "line", "road_key", "road_name", F.coalesce("unnamed", F.lit(False)).alias("unnamed"), F.coalesce("roundabout", F.lit(False)).alias("roundabout"), "from_node", scalar.polyline_length(F.col("line")).alias("length_m"))
    rows = rows.withColumns({"first": F.row_number().over(order) == 1, "line0": before("line"), "key0": before("road_key"), "round0": before("roundabout"), "node0": before("from_node"), "start_m": F.coalesce(F.sum("length_m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    rows = rows.join(ways, "from_node", "left").withColumn("angle", F.when(~F.col("first"), turn_angle(F.col("line0"), F.col("line"), ahead)))
    onward = F.size(F.filter(F.coalesce("ways", F.array().cast("array<bigint>")), lambda v: v != F.col("node0")))
    rows = rows.withColumn("junction", ~F.col("first") & (onward > 1)).drop("line0", "ways")
    split = F.col("first") | ~F.col("road_key").eqNullSafe(F.col("key0")) | F.col("junction") | (F.col("round0") != F.col("roundabout")) | (F.abs("angle") >= slight)
    rows = rows.withColumn("split", F.coalesce(split, F.lit(False))).withColumn("step_no", F.sum(F.col("split").cast("int")).over(order))
    kind = F.when(F.col("first"), "start").when(F.col("roundabout") & ~F.col("round0"), "roundabout_enter").when(~F.col("roundabout") & F.col("round0"), "roundabout_exit").when(F.col("roundabout"), "roundabout_continue").otherwise(scalar.maneuver(F.col("angle")))
    rows = rows.withColumn("maneuver", F.when(F.col("split"), kind))
    flag = lambda condition, name: F.when(condition, name)
    review = F.array_compact(F.array(
        flag(F.col("unnamed"), "unnamed_road"), flag(F.col("first"), "start_unverified"), flag(F.col("maneuver").startswith("roundabout"), "roundabout_review"), flag(F.col("junction"), "junction_review"),
        flag(F.col("maneuver") == "uturn", "uturn_review"), flag(F.col("maneuver").startswith("sharp_"), "sharp_turn_review"),
    ))
    start = F.struct("maneuver", "road_name", "start_m", "angle", review.alias("flags"), F.get("line", F.lit(0)).alias("at"))
    steps = rows.withColumn("start", start).groupBy("route_id", "step_no").agg(F.min_by("start", "pos").alias("s"), F.sum("length_m").alias("length_m"), F.count(F.lit(1)).alias("n_arcs"))
    steps = steps.select("route_id", F.col("step_no").cast("int").alias("step_no"), "s.maneuver", "s.road_name", "s.start_m", "length_m", "s.angle", "n_arcs", "s.flags", F.col("s.at.x").alias("x"), F.col("s.at.y").alias("y"))
    end = F.struct(F.element_at("line", -1).alias("at"), "road_name")
    arrive = rows.groupBy("route_id").agg(F.max("step_no").alias("n"), F.max_by(end, "pos").alias("e"), F.sum("length_m").alias("m"))
    arrive = arrive.select("route_id", (F.col("n") + 1).cast("int").alias("step_no"), F.lit("arrive").alias("maneuver"), "e.road_name", F.col("m").alias("start_m"), F.lit(0.0).alias("length_m"), F.lit(None).cast("double").alias("angle"), F.lit(0).cast("bigint").alias("n_arcs"), F.array(F.lit("end_unverified")).alias("flags"), F.col("e.at.x").alias("x"), F.col("e.at.y").alias("y"))
    return steps.unionByName(arrive)


def quadtree(points: DataFrame, side: float, least_side: float, limit: int) -> DataFrame:
    """points with their leaf: depth, cx, cy (cell numbers at that depth). Square cells of `side` are cut in four while they hold
    more than `limit` points, but not below least_side.

    Points are counted once, in cells of the least side; coarser counts are sums of those, and only full cells are kept, so
    the tree costs as much as it has full cells. A point's leaf is the first of its cells that isn't full.
    """
    depth = 0
    while side / 2 ** (depth + 1) >= least_side:
        depth += 1
    fine = side / 2**depth
    cell = lambda c: F.floor(F.col(c) / fine).cast("long")
    placed = points.withColumns({"fx": cell("x"), "fy": cell("y")})
    cells = placed.groupBy("fx", "fy").agg(F.count(F.lit(1)).alias("n"))
    at = lambda c, d: F.shiftright(F.col(c), depth - d)
    leaf = cells
    for d in range(depth):
        full = cells.groupBy(at("fx", d).alias(f"x{d}"), at("fy", d).alias(f"y{d}")).agg(F.sum("n").alias("t")).filter(F.col("t") > limit).select(f"x{d}", f"y{d}", F.lit(True).alias(f"full{d}"))
        leaf = leaf.join(full, (at("fx", d) == F.col(f"x{d}")) & (at("fy", d) == F.col(f"y{d}")), "left").drop(f"x{d}", f"y{d}")
    own = F.coalesce(*(F.when(F.col(f"full{d}").isNull(), d) for d in range(depth)), F.lit(depth)) if depth else F.lit(0)
    leaf = leaf.withColumn("depth", own).select(F.col("fx").alias("lx"), F.col("fy").alias("ly"), "depth")
    out = placed.join(leaf, (F.col("fx") == F.col("lx")) & (F.col("fy") == F.col("ly"))).drop("lx", "ly")
    return out.withColumns({c: F.floor(F.col(f) / F.pow(F.lit(2.0), F.lit(depth) - F.col("depth"))).cast("long") for c, f in (("cx", "fx"), ("cy", "fy"))}).drop("fx", "fy")
