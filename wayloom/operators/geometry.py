"""Distance and range joins by grid cells, containment, matching of points to routes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions.scalar import segment_projection

from .lineage import stored

#: Candidate pairs that a task of a cell join makes in the mean.
PAIRS = 4_000_000
#: Nodes of a cell in the mean with which the search of the nearest begins.
CELL_NODES = 2


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def cell_join(left: DataFrame, right: DataFrame, keys: list[str], own: str) -> DataFrame:
    """left and right joined on the cells in keys, in so many tasks that each makes PAIRS candidates in the mean.

    A cell with more is split by own, a column of left, and lists its right rows for each share. So neither a task's
    time nor its memory grows with the tables.
    """
    spark, count = left.sparkSession, lambda rows, name: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    work = stored(count(left, "n_left").join(count(right, "n_right"), keys).withColumn("n", F.col("n_left") * F.col("n_right")))
    total = work.agg(F.sum("n")).first()[0] or 0
    shares = work.filter(F.col("n") > PAIRS).select(*keys, F.ceil(F.col("n") / PAIRS).alias("shares"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // PAIRS))
    dealt = lambda rows, share: rows.join(F.broadcast(shares), keys, "left").withColumn("share", share).drop("shares").repartition(n, *keys, "share")
    one = F.coalesce("shares", F.lit(1))
    a, b = dealt(left, F.pmod(F.xxhash64(own), one)), dealt(right, F.explode(F.sequence(F.lit(0).cast("long"), one - 1)))
    return a.join(b.hint("merge"), [*keys, "share"]).drop("share")


def near_segments(points: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """Segments within radius of points: segments are listed under all cells they may reach, points under their own.
    Cells of half the radius keep the candidates to about twice what is found.

    points: point_id, route_id, x, y; segments: segment_id, route_id, ax, ay, bx, by, start_m. Adds distance,
    fraction, progress.
    """
    size = radius / 2
    span = lambda a, b: F.sequence(cell(F.least(a, b) - radius, size), cell(F.greatest(a, b) + radius, size))
    listed = segments.withColumn("cx", F.explode(span(F.col("ax"), F.col("bx")))).withColumn("cy", F.explode(span(F.col("ay"), F.col("by"))))
    found = cell_join(points.withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)}), listed, ["route_id", "cx", "cy"], "point_id")
    fraction, distance = segment_projection(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return found.withColumns({"fraction": fraction, "distance": distance}).filter(F.col("distance") <= radius).withColumn("progress", F.col("start_m") + F.col("fraction") * length).drop("cx", "cy")


def near_pairs(nodes: DataFrame, tolerance: float) -> DataFrame:
    """Pairs u < v of nodes within the tolerance: one side is listed under its own cell and all around it."""
    own = nodes.select(F.col("node_id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"), cell(F.col("x"), tolerance).alias("cx"), cell(F.col("y"), tolerance).alias("cy"))
    around = lambda c: F.explode(F.sequence(cell(F.col(c), tolerance) - 1, cell(F.col(c), tolerance) + 1))
    other = nodes.select(F.col("node_id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"), around("x").alias("cx"), "y").select("v", "vx", "vy", "cx", around("y").alias("cy"))
    return cell_join(own, other, ["cx", "cy"], "u").filter("u < v").withColumn("distance", F.hypot(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy"))).filter(F.col("distance") <= tolerance).select("u", "v", "distance")


def nearest(points: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """(point_id, node_id) of the nearest node within radius: the least distance, to nine digits, then the least id.

    points: point_id, px, py; nodes: node_id, x, y. Nodes of one place count by their least id. The search begins with
    cells that hold CELL_NODES of them in the mean. A point that finds a node no farther than a cell's side is settled,
    since all nodes as near as that were compared; cells double for the others, up to the radius.
    """
    places = stored(nodes.groupBy("x", "y").agg(F.min("node_id").alias("node_id")))
    box = places.agg(F.count("node_id").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    size, dense = radius, (box.n or 0) / (max(box.w or 0, radius) * max(box.h or 0, radius))
    while dense * size * size > 2 * CELL_NODES:
        size /= 2
    left, found = stored(points.select("point_id", "px", "py")), []
    while True:
        last = size >= radius
        around = lambda c, size=size: F.explode(F.sequence(cell(F.col(c), size) - 1, cell(F.col(c), size) + 1))
        asked = left.withColumn("cx", around("px")).withColumn("cy", around("py"))
        held = places.withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)})
        near = asked.join(held.hint("merge"), ["cx", "cy"]).withColumn("d", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")))
        # A node just beyond the side may tie to nine digits with one within it, so the last 1e-6 is left to the next round.
        near = near.filter(F.col("d") <= (radius if last else size - 1e-6))
        found.append(stored(near.groupBy("point_id").agg(F.min_by("node_id", F.struct(F.round("d", 9), "node_id")).alias("node_id"))))
        if last:
            return reduce(DataFrame.unionByName, found)
        left, size = stored(left.join(found[-1], "point_id", "left_anti")), size * 2


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """polygon_id, array<struct<x, y>> ring (not closed) -> polygon_id, ax, ay, bx, by."""
    p = F.col("ring")
    pairs = F.transform(p, lambda a, i: F.struct(a.alias("a"), F.get(p, (i + 1) % F.size(p)).alias("b")))
    return polygons.select("polygon_id", F.explode(pairs).alias("e")).select("polygon_id", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def points_in_polygons(points: DataFrame, edges: DataFrame, strip: float) -> DataFrame:
    """(point_id, polygon_id) of all points inside, by ray casting.

    Edges are listed under the horizontal strips they cross and points under their own, so the join is on the strip.
    """
    listed = edges.filter("ay <> by").withColumn("s", F.explode(F.sequence(cell(F.least("ay", "by"), strip), cell(F.greatest("ay", "by"), strip))))
    rows = points.withColumn("s", cell(F.col("y"), strip)).join(listed, "s")
    crosses = ((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & (F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax"))
    return rows.groupBy("point_id", "polygon_id").agg(F.count_if(crosses).alias("n")).filter("n % 2 = 1").select("point_id", "polygon_id")


def overlay_length(segments: DataFrame, edges: DataFrame, strip: float) -> DataFrame:
    """Length of every segment in every polygon: it is cut where it crosses edges, and each piece belongs where its middle lies.

    Pieces that lie in two polygons (a shared border) go to the first polygon by id.
    """
    span = lambda a, b: F.explode(F.sequence(cell(F.least(a, b), strip), cell(F.greatest(a, b), strip)))
    s = segments.select("segment_id", "ax", "ay", "bx", "by", span(F.col("ay"), F.col("by")).alias("s"))
    e = edges.select(*(F.col(c).alias(f"e{c}") for c in ("ax", "ay", "bx", "by")), span(F.col("ay"), F.col("by")).alias("s"))
    dx, dy, ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("ebx") - F.col("eax"), F.col("eby") - F.col("eay")
    det = dx * ey - dy * ex
    t = ((F.col("eax") - F.col("ax")) * ey - (F.col("eay") - F.col("ay")) * ex) / det
    u = ((F.col("eax") - F.col("ax")) * dy - (F.col("eay") - F.col("ay")) * dx) / det
    cuts = s.join(e, "s").filter(F.abs(det) > 1e-12).select("segment_id", t.alias("t"), u.alias("u")).filter("t > 0 and t < 1 and u >= 0 and u <= 1").select("segment_id", F.round("t", 12).alias("t"))
    ends = segments.select("segment_id", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    pieces = cuts.union(ends).distinct().withColumn("t2", F.lead("t").over(Window.partitionBy("segment_id").orderBy("t"))).filter("t2 is not null")
    rows = pieces.join(segments, "segment_id")
    mid = (F.col("t") + F.col("t2")) / 2
    placed = rows.select("segment_id", F.struct("segment_id", "t").alias("point_id"), (F.col("ax") + mid * dx).alias("x"), (F.col("ay") + mid * dy).alias("y"), ((F.col("t2") - F.col("t")) * F.hypot(dx, dy)).alias("length_m"))
    inside = points_in_polygons(placed.select("point_id", "x", "y"), edges, strip).groupBy("point_id").agg(F.min("polygon_id").alias("polygon_id"))
    return placed.join(inside, "point_id", "left").groupBy("segment_id", "polygon_id").agg(F.sum("length_m").alias("length_m"))


@dataclass(frozen=True)
class MatchRules:
    """Metres, metres a second and shares that decide on a match."""

    radius: float = 40.0
    most: int = 12
    max_speed: float = 50.0
    slack: float = 75.0
    backward: float = 5.0
    heading_move: float = 5.0
    heading_cosine: float = 0.0
    unsure_distance: float = 3.0
    unsure_progress: float = 25.0


def match_trips(points: DataFrame, candidates: DataFrame, rules: MatchRules = MatchRules()) -> DataFrame:  # noqa: B008
    """Matches the points of each trip in order; what the last point chose limits the next one's progress.

    points: trip_id, source_row, known_route, gps_valid, interval_valid, interval_s, gps_m, x, y; candidates: trip_id,
    source_row, segment_id, distance, progress, dx, dy (unit direction). Trips are dealt over tasks, and a task goes
    along its rows in order with the state of one point, so memory doesn't grow with a trip. Returns trip_id,
    source_row, segment_id, progress, distance (to the nearest candidate, or to the chosen one), status and confidence.
    """
    near = Window.partitionBy("trip_id", "source_row").orderBy("distance", "progress", "segment_id")
    ranked = candidates.filter(F.col("distance") <= rules.radius).withColumns({"r": F.row_number().over(near), "n": F.count(F.lit(1)).over(Window.partitionBy("trip_id", "source_row"))}).filter(F.col("r") <= rules.most)
    lists = ranked.groupBy("trip_id", "source_row").agg(F.array_sort(F.collect_list(F.struct("r", "segment_id", "distance", "progress", "dx", "dy"))).alias("c"), F.max("n").alias("n"))
    columns = ["trip_id", "source_row", "known_route", "gps_valid", "interval_valid", "interval_s", "gps_m", "x", "y"]
    rows = points.select(*columns).join(lists, ["trip_id", "source_row"], "left").select(*columns, "c", "n")
    kind = points.schema["trip_id"].dataType.simpleString()

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        trip, last, before = None, None, None
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                if p["trip_id"] != trip:
                    trip, last, before = p["trip_id"], None, None
                found, last, before = match_point(p, last, before, rules)
                out.append(found)
            names = ["segment_id", "progress", "distance", "status", "confidence"]
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], ["trip_id", "source_row", *names])

    ordered = rows.repartition("trip_id").sortWithinPartitions("trip_id", "source_row")
    return ordered.mapInArrow(work, f"trip_id {kind}, source_row long, segment_id long, progress double, distance double, status string, confidence double")


def match_point(p: dict, last: float | None, before: tuple[float, float] | None, rules: MatchRules) -> tuple[tuple, float | None, tuple[float, float] | None]:
    """Outcome of one point, the progress that binds the next one, and the place that its heading starts from."""
    if not p["gps_valid"] or p["x"] is None:
        return (None, None, None, "unknown_bad_gps", None), None, None if not p["gps_valid"] else before
    here = (p["x"], p["y"])
    if not p["known_route"]:
        return (None, None, None, "unknown_route", None), None, here
    if not p["c"]:
        return (None, None, None, "off_route", None), None, here
    heading, prior = None, last if p["interval_valid"] else None
    if before is not None and p["interval_valid"]:
        moved = math.hypot(here[0] - before[0], here[1] - before[1])
        if moved >= rules.heading_move:
            heading = ((here[0] - before[0]) / moved, (here[1] - before[1]) / moved)
    nearest = p["c"][0]["distance"]
    possible = [c for c in p["c"] if heading is None or c["dx"] * heading[0] + c["dy"] * heading[1] >= rules.heading_cosine]
    if not possible:
        return (None, None, nearest, "opposite_direction", None), None, here
    if prior is not None:
        possible = [c for c in possible if -rules.backward <= c["progress"] - prior <= rules.max_speed * p["interval_s"] + rules.slack]
    if not possible:
        return (None, None, nearest, "continuity_unresolved", None), None, here
    best = min(possible, key=lambda c: c["distance"] + (0.05 * abs(c["progress"] - prior - (p["gps_m"] or 0.0)) if prior is not None else 0.0))
    unsure = p["n"] > rules.most or any(c["distance"] <= best["distance"] + rules.unsure_distance and abs(c["progress"] - best["progress"]) >= rules.unsure_progress for c in possible)
    row = (best["segment_id"], best["progress"], best["distance"], "ambiguous" if unsure else "matched", 0.0 if unsure else max(0.0, 1 - best["distance"] / rules.radius))
    return row, None if unsure else best["progress"], here
