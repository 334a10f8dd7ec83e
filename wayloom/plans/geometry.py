"""Queries of geometry, route instructions and text rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayloom.functions import scalar
from wayloom.operators import geometry as g
from wayloom.operators import lines
from wayloom.operators.lineage import dealt

from .registry import query
from .views import table

NODES = "nodes AS (SELECT c_custkey AS node_id, (c_custkey * 7919 % 10007) / 10.0 AS x, (c_custkey * 104729 % 10009) / 10.0 AS y FROM customer)"
POLYGONS = [(1, [(100.0, 100.0), (600.0, 150.0), (500.0, 700.0), (50.0, 500.0)]), (2, [(600.0, 150.0), (950.0, 120.0), (900.0, 800.0), (500.0, 700.0)]), (3, [(20.0, 720.0), (480.0, 740.0), (300.0, 990.0)])]
EDGES = "edges(polygon_id, ax, ay, bx, b_y) AS (VALUES " + ", ".join(f"({i}, {r[k][0]}::DOUBLE, {r[k][1]}::DOUBLE, {r[(k + 1) % len(r)][0]}::DOUBLE, {r[(k + 1) % len(r)][1]}::DOUBLE)" for i, r in POLYGONS for k in range(len(r))) + ")"


def nodes(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("node_id"), (k * 7919 % 10007 / 10.0).alias("x"), (k * 104729 % 10009 / 10.0).alias("y"))


def edges(spark):
    rows = [(i, [{"x": x, "y": y} for x, y in r]) for i, r in POLYGONS]
    return g.polygon_edges(spark.createDataFrame(rows, "polygon_id int, ring array<struct<x:double,y:double>>"))


SEGMENTS = "segs AS (SELECT s_suppkey AS segment_id, s_suppkey % 5 AS route_id, (s_suppkey * 7919 % 10007) / 10.0 AS ax, (s_suppkey * 104729 % 10009) / 10.0 AS ay, (s_suppkey * 7919 % 10007) / 10.0 + s_suppkey % 90 - 40 AS bx, (s_suppkey * 104729 % 10009) / 10.0 + s_suppkey % 70 - 30 AS b_y, s_suppkey * 1.0 AS start_m FROM supplier)"


def segments(spark, sf_dir):
    k = F.col("s_suppkey")
    x, y = k * 7919 % 10007 / 10.0, k * 104729 % 10009 / 10.0
    return table(spark, sf_dir, "supplier").select(k.alias("segment_id"), (k % 5).alias("route_id"), x.alias("ax"), y.alias("ay"), (x + k % 90 - 40).alias("bx"), (y + k % 70 - 30).alias("by"), (k * 1.0).alias("start_m"))


NEAR = f"""{NODES}, {SEGMENTS}, j AS (SELECT n.node_id AS point_id, s.segment_id, n.x, n.y, s.ax, s.ay, s.bx, s.b_y, start_m, pow(bx - ax, 2) + pow(b_y - ay, 2) AS len2 FROM nodes n JOIN segs s ON n.node_id % 5 = s.route_id),
f AS (SELECT *, CASE WHEN len2 > 0 THEN greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / len2)) ELSE 0 END AS fraction FROM j),
near AS (SELECT *, sqrt(pow(x - ax - fraction * (bx - ax), 2) + pow(y - ay - fraction * (b_y - ay), 2)) AS distance, start_m + fraction * sqrt(len2) AS progress FROM f)"""


def near(spark, sf_dir):
    points = nodes(spark, sf_dir).select(F.col("node_id").alias("point_id"), (F.col("node_id") % 5).alias("route_id"), "x", "y")
    return g.near_segments(points, segments(spark, sf_dir), 40.0)


@query(f"WITH {NEAR} SELECT point_id, segment_id, round(distance, 5) AS distance, round(progress, 5) AS progress FROM near WHERE distance <= 40")
def grid_near_join(spark, sf_dir):
    return near(spark, sf_dir).select("point_id", "segment_id", F.round("distance", 5).alias("distance"), F.round("progress", 5).alias("progress"))


@query(f"WITH {NEAR} SELECT point_id, segment_id, round(fraction, 6) AS fraction FROM near WHERE distance <= 40")
def segment_projection(spark, sf_dir):
    return near(spark, sf_dir).select("point_id", "segment_id", F.round("fraction", 6).alias("fraction"))


@query(f"WITH {NEAR}, r AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY point_id) AS n FROM near WHERE distance <= 40 WINDOW w AS (PARTITION BY point_id ORDER BY round(distance, 9), round(progress, 9), segment_id)) SELECT point_id, segment_id, CAST(r AS INT) AS r, n > 12 AS overflow FROM r WHERE r <= 12")
def candidate_topk_overflow(spark, sf_dir):
    """The first 12 segments of each point by distance, progress and id; distances and progress count to nine digits, so equal ones tie."""
    order = Window.partitionBy("point_id").orderBy(F.round("distance", 9), F.round("progress", 9), "segment_id")
    rows = near(spark, sf_dir).withColumns({"r": F.row_number().over(order), "overflow": F.count(F.lit(1)).over(Window.partitionBy("point_id")) > 12})
    return rows.filter("r <= 12").select("point_id", "segment_id", "r", "overflow")


@query(f"WITH {NODES} SELECT a.node_id AS u, b.node_id AS v, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 5) AS distance FROM nodes a JOIN nodes b ON a.node_id < b.node_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 16")
def endpoint_snap_pairs(spark, sf_dir):
    return g.near_pairs(nodes(spark, sf_dir), 4.0).select("u", "v", F.round("distance", 5).alias("distance"))


@query(f"""WITH {NODES}, p AS (SELECT s_suppkey AS point_id, (s_suppkey * 613 % 9973) / 10.0 AS px, (s_suppkey * 977 % 9967) / 10.0 AS py FROM supplier)
SELECT point_id, node_id FROM (SELECT point_id, node_id, row_number() OVER (PARTITION BY point_id ORDER BY round(sqrt(pow(x - px, 2) + pow(y - py, 2)), 9), node_id) AS r FROM p JOIN nodes ON pow(x - px, 2) + pow(y - py, 2) <= 2500) WHERE r = 1""")
def nearest_node(spark, sf_dir):
    k = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").select(k.alias("point_id"), (k * 613 % 9973 / 10.0).alias("px"), (k * 977 % 9967 / 10.0).alias("py"))
    return g.nearest(p, nodes(spark, sf_dir), 50.0)


INSIDE = f"""{NODES}, {EDGES}, inside AS (SELECT node_id AS point_id, polygon_id FROM nodes, edges GROUP BY ALL HAVING count(*) FILTER ((ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / (b_y - ay) + ax) % 2 = 1)"""


def inside(spark, sf_dir):
    return g.points_in_polygons(nodes(spark, sf_dir).withColumnRenamed("node_id", "point_id"), edges(spark), 100.0)


@query(f"WITH {INSIDE} SELECT point_id, polygon_id FROM inside")
def point_in_polygon_join(spark, sf_dir):
    return inside(spark, sf_dir)


@query(f"WITH {INSIDE} SELECT polygon_id, count(*) AS n, count(*) FILTER (point_id % 3 = 0) AS n_food, round(count(*) / 0.25, 4) AS per_km2 FROM inside GROUP BY polygon_id")
def activity_density(spark, sf_dir):
    n = F.count(F.lit(1))
    return inside(spark, sf_dir).groupBy("polygon_id").agg(n.alias("n"), F.count_if(F.col("point_id") % 3 == 0).alias("n_food"), F.round(n / 0.25, 4).alias("per_km2"))


@query("SELECT s_nationkey AS unit, count(*) AS n_parts, round(sum(s_acctbal) / sum(s_suppkey), 6) AS density FROM supplier GROUP BY s_nationkey HAVING count(*) >= 2")
def population_density(spark, sf_dir):
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("unit")).agg(n.alias("n_parts"), F.round(F.try_divide(F.sum(F.col("s_acctbal").cast("double")), F.sum("s_suppkey")), 6).alias("density")).filter("n_parts >= 2")


@query()
def line_polygon_overlay(spark, sf_dir):
    """Cut at crossings, placed by middle points; checked against hand values in tests."""
    return g.overlay_length(segments(spark, sf_dir).select("segment_id", "ax", "ay", "bx", "by"), edges(spark), 100.0)


@query()
def sequential_map_match(spark, sf_dir):
    """In order along each trip with the state of one point; checked against hand values for every outcome in tests."""
    e = F.col("event_id")
    points = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trip_id"), e.alias("source_row"), (F.col("user_id") % 19 != 0).alias("known_route"), (e % 13 != 0).alias("gps_valid"), (e % 5 != 0).alias("interval_valid"),
        F.lit(2.0).alias("interval_s"), (e % 9 * 1.0).cast("double").alias("gps_m"), (e % 1000 * 1.0).cast("double").alias("x"), (e % 777 * 1.0).cast("double").alias("y"),
    )
    ids = points.select("trip_id", "source_row", F.explode(F.sequence(F.lit(0), (F.col("source_row") % 4 - 1).cast("int"))).alias("i")).filter("source_row % 4 > 0")
    turn = (F.col("i") + F.col("source_row") % 7) * 0.9
    candidates = ids.select("trip_id", "source_row", (F.col("i") + F.col("source_row") % 3).cast("long").alias("segment_id"), (F.col("i") * 7.0 + F.col("source_row") % 5).alias("distance"), (F.col("i") * 30.0 + F.col("source_row") % 50).alias("progress"), F.cos(turn).alias("dx"), F.sin(turn).alias("dy"))
    return g.match_trips(points, candidates)


@query("""SELECT l_orderkey AS route_id, l_linenumber AS pos, l_partkey AS part_id, l_suppkey AS s, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) - l_quantity, 4) AS start_m FROM lineitem""")
def cumulative_measure(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("s"), F.round(F.sum("l_quantity").over(w) - F.col("l_quantity"), 4).alias("start_m"))


STEPS = """o AS (SELECT l_suppkey AS route_id, l_returnflag || l_linestatus AS name, l_quantity AS m, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS pos FROM lineitem),
c AS (SELECT *, CASE WHEN name IS DISTINCT FROM lag(name) OVER (PARTITION BY route_id ORDER BY pos) THEN 1 ELSE 0 END AS starts FROM o), s AS (SELECT *, sum(starts) OVER (PARTITION BY route_id ORDER BY pos) AS step FROM c)"""


KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


def steps(spark, sf_dir):
    row = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*KEYS))
    items = dealt(table(spark, sf_dir, "lineitem").select("l_suppkey", *KEYS, "l_returnflag", "l_linestatus"), "l_suppkey")
    rows = items.select(F.col("l_suppkey").alias("route_id"), F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_quantity").alias("m"), row.alias("pos"))
    order = Window.partitionBy("route_id").orderBy("pos")
    rows = rows.withColumn("starts", (~F.col("name").eqNullSafe(F.lag("name").over(order))).cast("int"))
    return rows.withColumn("step", F.sum("starts").over(order))


@query(f"WITH {STEPS} SELECT route_id, sum(starts)::BIGINT AS n_runs, string_agg(CASE WHEN starts = 1 THEN name END, '>' ORDER BY pos) AS names FROM s GROUP BY route_id")
def run_collapse(spark, sf_dir):
    shown = F.array_sort(F.collect_list(F.when(F.col("starts") == 1, F.struct("pos", "name"))))
    return steps(spark, sf_dir).groupBy("route_id").agg(F.sum("starts").alias("n_runs"), F.array_join(F.transform(shown, lambda x: x["name"]), ">").alias("names"))


@query(f"""WITH {STEPS} SELECT route_id, bool_and(m >= 0) AND count(*) = max(pos) AS complete, round(sum(m), 3) AS length_m FROM s GROUP BY route_id""")
def arc_partition_check(spark, sf_dir):
    by_step = steps(spark, sf_dir).groupBy("route_id", "step").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"), F.sum("m").alias("m"), F.min("m").alias("least"))
    return by_step.groupBy("route_id").agg((F.bool_and(F.col("least") >= 0) & (F.sum("n") == F.max("last"))).alias("complete"), F.round(F.sum("m"), 3).cast("double").alias("length_m"))


@query("""SELECT event_id, CASE WHEN abs(a) <= 15 THEN 'straight' WHEN abs(a) <= 45 THEN 'slight_' || side WHEN abs(a) < 135 THEN side WHEN abs(a) < 165 THEN 'sharp_' || side ELSE 'uturn' END AS maneuver,
['north', 'northeast', 'east', 'southeast', 'south', 'southwest', 'west', 'northwest'][CAST(floor((event_id % 360 + 22.5) / 45) AS BIGINT) % 8 + 1] AS compass FROM (SELECT event_id, event_id % 361 - 180 AS a, CASE WHEN event_id % 361 - 180 > 0 THEN 'left' ELSE 'right' END AS side FROM events)""")
def maneuver_compass(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", scalar.maneuver(e % 361 - 180).alias("maneuver"), scalar.compass(e % 360).alias("compass"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Start on ' || event_type WHEN event_id % 4 = 1 THEN 'Turn left onto ' || event_type WHEN event_id % 4 = 2 THEN 'Continue on ' || event_type ELSE 'Arrive' END AS text FROM events""")
def instruction_text(spark, sf_dir):
    k = F.col("event_id") % 4
    return table(spark, sf_dir, "events").select("event_id", F.when(k == 0, F.format_string("Start on %s", "event_type")).when(k == 1, F.format_string("Turn left onto %s", "event_type")).when(k == 2, F.format_string("Continue on %s", "event_type")).otherwise("Arrive").alias("text"))


@query("""SELECT vec_id, round(list_sum([sqrt(pow(embedding[i + 2]::DOUBLE - embedding[i]::DOUBLE, 2) + pow(embedding[i + 3]::DOUBLE - embedding[i + 1]::DOUBLE, 2)) FOR i IN range(1, 62, 2)]), 5) AS length FROM embeddings""")
def polyline_length(spark, sf_dir):
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get("embedding", i * 2).cast("double").alias("x"), F.get("embedding", i * 2 + 1).cast("double").alias("y")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(scalar.polyline_length(pts), 5).alias("length"))


@query("SELECT vec_id, round(CASE WHEN vec_id % 2 = 0 THEN embedding[1] ELSE embedding[64] END::DOUBLE, 6) AS first FROM embeddings")
def reverse_by_direction(spark, sf_dir):
    e = F.when(F.col("vec_id") % 2 == 0, F.col("embedding")).otherwise(F.reverse("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(e, F.lit(0)).cast("double"), 6).alias("first"))


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0) SELECT q.vec_id AS a, e.vec_id AS b, round(sqrt(list_sum([pow(x[1]::DOUBLE - x[2]::DOUBLE, 2) FOR x IN list_zip(q.embedding, e.embedding)])), 4) AS distance FROM q, embeddings e WHERE e.vec_id <> q.vec_id AND e.label = q.label""")
def feature_distance(spark, sf_dir):
    """Every fiftieth vector is a query, against all vectors of its label."""
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("u"))
    squares = F.zip_with("u", "embedding", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    d = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    return q.join(v, "label").filter("a <> vec_id").select("a", F.col("vec_id").alias("b"), F.round(d, 4).alias("distance"))


@query(f"WITH {NODES} SELECT node_id % 10 AS tile, round(floor(min(x) / 1e-6) * 1e-6 - 1e-6, 5) AS west, round(ceil(max(x) / 1e-6) * 1e-6 + 1e-6, 5) AS east FROM nodes GROUP BY 1")
def outward_bbox(spark, sf_dir):
    rows = nodes(spark, sf_dir).groupBy((F.col("node_id") % 10).alias("tile")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    west, east = scalar.outward(F.col("lo"), F.col("hi"))
    return rows.select("tile", F.round(west, 5).alias("west"), F.round(east, 5).alias("east"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM pages")
def error_text_plain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalar.text_without_tags(F.col("html")).alias("text"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'rate|too many requests') THEN 'rate_limit' WHEN regexp_matches(lower(text), 'memory|timeout|timed out') THEN 'resource' WHEN regexp_matches(lower(text), 'parse|static error|query') THEN 'query_error' WHEN regexp_matches(lower(text), 'incomplete|truncated') THEN 'incomplete' ELSE 'other' END AS class FROM documents")
def error_text_class(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalar.error_class(F.col("text")).alias("class"))


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","key":' || p_partkey || ',"size":' || p_size || '}') AS digest FROM part""")
def canonical_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalar.canonical_hash({"size": F.col("p_size"), "key": F.col("p_partkey"), "brand": F.col("p_brand")}).alias("digest"))


@query("SELECT p_brand, sha256(string_agg(sha256(p_partkey || '|' || p_size), ',' ORDER BY sha256(p_partkey || '|' || p_size))) AS fingerprint FROM part GROUP BY p_brand")
def dataset_fingerprint(spark, sf_dir):
    row = F.sha2(F.concat_ws("|", F.col("p_partkey").cast("string"), F.col("p_size").cast("string")), 256)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ","), 256).alias("fingerprint"))


@query("""WITH t AS (SELECT p_partkey, ['2', '3.5', '0', '50', 'x', '60 mph', '40 km/h'][p_partkey % 7 + 1] AS text FROM part)
SELECT p_partkey, CASE text WHEN '2' THEN 2.0 WHEN '50' THEN 50.0 END::DOUBLE AS lanes, round(CASE text WHEN '2' THEN 2.0 WHEN '3.5' THEN 3.5 WHEN '50' THEN 50.0 WHEN '60 mph' THEN 60 * 1.609344 WHEN '40 km/h' THEN 40.0 END::DOUBLE, 6) AS speed FROM t""")
def tag_number(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, ("2", "3.5", "0", "50", "x", "60 mph", "40 km/h"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", scalar.tag_number(text).alias("lanes"), F.round(scalar.tag_number(text, speed=True), 6).alias("speed"))


@query("SELECT p_partkey, len([x FOR x IN string_split(lower(p_type), ' ') IF x IN ('standard', 'economy', 'promo')]) > 0 AS overlaps FROM part")
def tag_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.arrays_overlap(F.split(F.lower("p_type"), " "), F.array(F.lit("standard"), F.lit("economy"), F.lit("promo"))).alias("overlaps"))


@query("SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END), ''), nullif(CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END, ''), 'way ' || p_partkey) AS label, p_partkey % 3 <> 0 AND p_partkey % 2 <> 0 AS unnamed FROM part")
def road_identity(spark, sf_dir):
    k = F.col("p_partkey")
    name, ref = F.nullif(F.trim(F.when(k % 3 == 0, F.col("p_name")).otherwise("")), F.lit("")), F.nullif(F.when(k % 2 == 0, F.col("p_brand")).otherwise(""), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(name, ref, F.concat(F.lit("way "), k.cast("string"))).alias("label"), (name.isNull() & ref.isNull()).alias("unnamed"))


@query("SELECT p_brand, string_agg(p_size || ':' || n, ',' ORDER BY p_size) AS counts FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand")
def counter_as_json(spark, sf_dir):
    n = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("p_size", "n")))
    return n.groupBy("p_brand").agg(F.array_join(F.transform(pairs, lambda x: F.concat(x["p_size"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",").alias("counts"))


@query("SELECT p_partkey, trim(regexp_replace(replace('  ' || p_name || ' – x', '–', '-'), '[ \\t]+', ' ', 'g')) AS name FROM part")
def normalise_admin_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalar.clean_label(F.concat(F.lit("  "), "p_name", F.lit(" – x"))).alias("name"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(t, '^[=+\\-@]') THEN '''' || t ELSE t END AS cell FROM (SELECT p_partkey, ['=1', '+a', 'plain', '-x', '@y'][p_partkey % 5 + 1] AS t FROM part)")
def csv_sink_safe(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, ("=1", "+a", "plain", "-x", "@y"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", scalar.spreadsheet_safe(text).alias("cell"))


@query("SELECT s_suppkey, round(CASE WHEN s_acctbal < 0 THEN NULL ELSE 0.6 * (s_acctbal / 10000) + 0.4 * (s_nationkey / 25.0) END, 7) AS score, CASE WHEN s_acctbal < 0 THEN 'reference' WHEN 0.6 * (s_acctbal / 10000) + 0.4 * (s_nationkey / 25.0) >= 0.5 THEN 'inside' ELSE 'outside' END AS side FROM supplier")
def boundary_score_rule(spark, sf_dir):
    p, a = F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal").cast("double") / 10000), F.col("s_nationkey") / 25.0
    score = 0.6 * p + 0.4 * a
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(score, 7).alias("score"), F.when(score.isNull(), "reference").when(score >= 0.5, "inside").otherwise("outside").alias("side"))


@query("SELECT s_suppkey, round(greatest(0, least(10, 0.7 * s_nationkey + 0.3 * (s_nationkey + 4)))::DOUBLE, 6) AS shifted FROM supplier")
def missing_part_shift(spark, sf_dir):
    """Only the imputed share (here 0.3) of a feature is shifted, then clamped."""
    v = F.col("s_nationkey").cast("double")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), 0.7 * v + 0.3 * (v + 4))), 6).alias("shifted"))


LINES = """pts AS (SELECT vec_id, label, t.i, embedding[2 * t.i + 1]::DOUBLE AS x, embedding[2 * t.i + 2]::DOUBLE AS y FROM embeddings, range(32) t(i)),
seg AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS m FROM pts WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
fore AS (SELECT *, sum(m) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop FROM seg WHERE m IS NOT NULL),
back AS (SELECT *, sum(m) OVER (PARTITION BY vec_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS stop FROM seg WHERE m IS NOT NULL),
t_out AS (SELECT f.vec_id, f.x + (1.2 - (f.stop - f.m)) / f.m * (f.x1 - f.x) - p.x AS tx, f.y + (1.2 - (f.stop - f.m)) / f.m * (f.y1 - f.y) - p.y AS ty FROM fore f JOIN pts p ON p.vec_id = f.vec_id AND p.i = 0 WHERE 1.2 > f.stop - f.m AND 1.2 <= f.stop),
t_in AS (SELECT b.vec_id, p.x - (b.x1 + (1.2 - (b.stop - b.m)) / b.m * (b.x - b.x1)) AS tx, p.y - (b.y1 + (1.2 - (b.stop - b.m)) / b.m * (b.y - b.y1)) AS ty FROM back b JOIN pts p ON p.vec_id = b.vec_id AND p.i = 31 WHERE 1.2 > b.stop - b.m AND 1.2 <= b.stop),
arc AS (SELECT e.vec_id, label AS route_id, row_number() OVER (PARTITION BY label ORDER BY e.vec_id) AS pos, lag(e.vec_id) OVER (PARTITION BY label ORDER BY e.vec_id) AS before, e.vec_id % 12 AS from_node, (e.vec_id * 5 + 1) % 12 AS to_node, CASE WHEN e.vec_id % 11 = 0 THEN 'none' ELSE 'road' || e.vec_id % 3 END AS name, e.vec_id % 11 = 0 AS unnamed, e.vec_id % 7 = 0 AS round, l.m FROM embeddings e JOIN (SELECT vec_id, sum(m) AS m FROM fore GROUP BY vec_id) l USING (vec_id)),
ang AS (SELECT arc.*, degrees(atan2(a.tx * b.ty - a.ty * b.tx, a.tx * b.tx + a.ty * b.ty)) AS angle FROM arc LEFT JOIN t_in a ON a.vec_id = arc.before LEFT JOIN t_out b ON b.vec_id = arc.vec_id)"""
#: How far along a line its direction is looked up here (12 m on roads).
AHEAD = 1.2


def line_of(embedding: str = "embedding"):
    """A vector of 64 numbers as a line of 32 points."""
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get(embedding, i * 2).cast("double").alias("x"), F.get(embedding, i * 2 + 1).cast("double").alias("y")))


def line_arcs(spark, sf_dir):
    """Vectors as arcs: those of a label, in order, are a route over twelve nodes, with named roads and roundabouts."""
    k = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("route_id"), k.alias("pos"), line_of().alias("line"), F.when(k % 11 == 0, "none").otherwise(F.concat(F.lit("road"), (k % 3).cast("string"))).alias("road_name"), (k % 11 == 0).alias("unnamed"), (k % 7 == 0).alias("roundabout"), (k % 12).alias("from_node"), ((k * 5 + 1) % 12).alias("to_node"))
    return rows.withColumn("road_key", F.col("road_name"))


@query(f"""WITH {LINES}, ends AS (SELECT vec_id, max(stop) AS len FROM fore GROUP BY vec_id), asked AS (SELECT vec_id, unnest(range(0, floor(len / 0.5)::BIGINT + 1)) * 0.5::DOUBLE AS measure FROM ends),
found AS (SELECT asked.vec_id, measure, x, y, x1, y1, (measure - (stop - m)) / m AS f, row_number() OVER (PARTITION BY asked.vec_id, measure ORDER BY i) AS r FROM asked JOIN fore ON fore.vec_id = asked.vec_id AND measure >= stop - m - 1e-12 AND measure <= stop)
SELECT vec_id, measure, round(x + f * (x1 - x), 6) AS x, round(y + f * (y1 - y), 6) AS y FROM found WHERE r = 1""")
def point_at_measure(spark, sf_dir):
    """Coordinates every half unit along each line."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", line_of().alias("line")).withColumn("m", lines.measures(F.col("line")))
    asked = rows.select("vec_id", "line", F.explode(F.sequence(F.lit(0), F.floor(F.element_at("m", -1) / 0.5).cast("int"))).alias("k")).withColumn("measure", F.col("k") * 0.5)
    return asked.withColumn("p", lines.point_at(F.col("line"), F.col("measure"))).select("vec_id", "measure", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(f"WITH {LINES} SELECT vec_id, before, round(angle, 5) AS angle FROM ang WHERE before IS NOT NULL")
def turn_angle(spark, sf_dir):
    """Turn from each line of a route to the next, by directions looked up along both."""
    arcs = line_arcs(spark, sf_dir)
    order = Window.partitionBy("route_id").orderBy("pos")
    rows = arcs.withColumns({"before": F.lag("pos").over(order), "line0": F.lag("line").over(order)}).filter("before is not null")
    return rows.select(F.col("pos").alias("vec_id"), "before", F.round(lines.turn_angle(F.col("line0"), F.col("line"), AHEAD), 5).alias("angle"))


STEP_ROWS = f"""{LINES}, ways AS (SELECT from_node, list(to_node) AS ways FROM arc GROUP BY from_node),
p AS (SELECT ang.*, lag(name) OVER w AS name0, lag(round) OVER w AS round0, len([x FOR x IN ways IF x <> lag(ang.from_node) OVER w]) > 1 AS junction FROM ang JOIN ways USING (from_node) WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
q AS (SELECT *, before IS NULL AS first, before IS NULL OR name <> name0 OR coalesce(junction, false) OR round0 <> round OR abs(angle) >= 45 AS split FROM p), s AS (SELECT *, sum(split::INT) OVER (PARTITION BY route_id ORDER BY pos) AS step FROM q),
k AS (SELECT *, CASE WHEN first THEN 'start' WHEN round AND NOT round0 THEN 'roundabout_enter' WHEN NOT round AND round0 THEN 'roundabout_exit' WHEN round THEN 'roundabout_continue' WHEN abs(angle) <= 15 THEN 'straight' ELSE CASE WHEN abs(angle) <= 45 THEN 'slight_' WHEN abs(angle) < 135 THEN '' WHEN abs(angle) < 165 THEN 'sharp_' ELSE 'uturn' END || CASE WHEN abs(angle) >= 165 THEN '' WHEN angle > 0 THEN 'left' ELSE 'right' END END AS man FROM s),
st AS (SELECT route_id, step, min_by(man, pos) AS maneuver, min_by(name, pos) AS road_name, sum(m) AS length_m, count(*) AS n_arcs,
  min_by(array_to_string([x FOR x IN [CASE WHEN unnamed THEN 'unnamed_road' END, CASE WHEN first THEN 'start_unverified' END, CASE WHEN man LIKE 'roundabout%' THEN 'roundabout_review' END, CASE WHEN NOT first AND junction THEN 'junction_review' END, CASE WHEN man = 'uturn' THEN 'uturn_review' END, CASE WHEN man LIKE 'sharp%' THEN 'sharp_turn_review' END] IF x IS NOT NULL], ';'), pos) AS flags FROM k GROUP BY route_id, step),
every AS (SELECT route_id, step, maneuver, road_name, length_m, n_arcs, flags FROM st UNION ALL SELECT route_id, max(step) + 1, 'arrive', max_by(name, pos), 0, 0, 'end_unverified' FROM k GROUP BY route_id)"""


@query(f"WITH {STEP_ROWS} SELECT route_id, step::INT AS step_no, maneuver, road_name, round(length_m, 5) AS length_m, n_arcs::BIGINT AS n_arcs, flags FROM every")
def step_segmentation(spark, sf_dir):
    """Steps of routes by road, junction, roundabout and turn, with flags and an arrive row."""
    arcs = line_arcs(spark, sf_dir)
    steps = lines.route_steps(arcs, arcs, AHEAD)
    return steps.select("route_id", "step_no", "maneuver", "road_name", F.round("length_m", 5).alias("length_m"), "n_arcs", F.array_join("flags", ";").alias("flags"))


@query(f"WITH {STEP_ROWS} SELECT route_id, count(*) AS n_steps, count(*) FILTER (maneuver NOT IN ('start', 'arrive', 'straight')) AS n_turns, count(*) FILTER (flags <> '') AS n_review, count(*) FILTER (contains(flags, 'unnamed_road')) AS n_unnamed, count(*) FILTER (starts_with(maneuver, 'roundabout')) AS n_roundabout, round(sum(length_m), 4) AS length_m FROM every GROUP BY route_id")
def instruction_summary(spark, sf_dir):
    """Steps, turns, steps to review, unnamed roads, roundabouts and length of each route."""
    arcs = line_arcs(spark, sf_dir)
    steps = lines.route_steps(arcs, arcs, AHEAD)
    n = F.count_if
    return steps.groupBy("route_id").agg(F.count(F.lit(1)).alias("n_steps"), n(~F.col("maneuver").isin("start", "arrive", "straight")).alias("n_turns"), n(F.size("flags") > 0).alias("n_review"), n(F.array_contains("flags", "unnamed_road")).alias("n_unnamed"), n(F.col("maneuver").startswith("roundabout")).alias("n_roundabout"), F.round(F.sum("length_m"), 4).alias("length_m"))


@query(f"""WITH {NODES}, c AS (SELECT *, {", ".join(f"floor(x / {400 / 2**d}) AS x{d}, floor(y / {400 / 2**d}) AS y{d}" for d in range(4))} FROM nodes),
n AS (SELECT *, {", ".join(f"count(*) OVER (PARTITION BY x{d}, y{d}) AS n{d}" for d in range(4))} FROM c), l AS (SELECT *, CASE WHEN n0 <= 20 THEN 0 WHEN n1 <= 20 THEN 1 WHEN n2 <= 20 THEN 2 ELSE 3 END AS depth FROM n)
SELECT depth, CASE depth WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END::BIGINT AS cx, CASE depth WHEN 0 THEN y0 WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE y3 END::BIGINT AS cy, count(*) AS n FROM l GROUP BY ALL""")
def grid_tiles(spark, sf_dir):
    """Cells of 400 m, cut in four down to 50 m while they hold more than twenty nodes."""
    return lines.quadtree(nodes(spark, sf_dir), 400.0, 50.0, 20).groupBy("depth", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))


@query()
def crs_transform(spark, sf_dir):
    """Degrees to the national grid with its datum shift, and back; there and back is checked in tests to a millimetre."""
    from .views import points

    rows = points(spark, sf_dir).select("trip_id", "source_row", scalar.national_grid(F.col("lat"), F.col("lon")).alias("g"))
    rows = rows.withColumn("w", scalar.national_degrees(F.col("g.x"), F.col("g.y")))
    return rows.select("trip_id", "source_row", F.round("g.x", 3).alias("x"), F.round("g.y", 3).alias("y"), F.round("w.lat", 7).alias("lat"), F.round("w.lon", 7).alias("lon"))
