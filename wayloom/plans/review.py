"""Queries of checks, reconciliations and small reports over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayloom.operators import sets as s
from wayloom.operators.composition import network_cells
from wayloom.operators.kinematics import flag_array
from wayloom.operators.lineage import checkpoint, stored

from .registry import query
from .sets import GAP, SETS, baseline, candidates, drawn, gaps, scores, vectors
from .views import EVIDENCE, PARTS, TRIPS, WALKS, arcs, evidence, parts, table, trips, walks


@query("WITH wanted AS (SELECT p_partkey FROM part WHERE p_size < 10) SELECT DISTINCT l_suppkey AS from_node, l_partkey AS to_node FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM wanted)")
def network_tables_scan(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").filter("p_size < 10").select(F.col("p_partkey").alias("to_node"))
    return arcs(spark, sf_dir).join(wanted, "to_node", "left_semi").select("from_node", "to_node")


@query("""SELECT o_orderkey AS tile, array_to_string([x FOR x IN [CASE WHEN n IS NULL THEN 'absent' END, CASE WHEN n IS NOT NULL AND n IS DISTINCT FROM o_orderkey % 7 + 1 THEN 'count_differs' END] IF x IS NOT NULL], ';') AS problems
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def tile_cache_rules(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "orders").join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rules = {"absent": F.col("n").isNull(), "count_differs": F.col("n").isNotNull() & ~F.col("n").eqNullSafe(F.col("o_orderkey") % 7 + 1)}
    return rows.select(F.col("o_orderkey").alias("tile"), F.array_join(flag_array(rules), ";").alias("problems"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#]+') THEN 'ok' ELSE 'bad_uri' END AS outcome FROM pages")
def evidence_uri_rule(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("url").rlike("^https?://[^/?#]+"), "ok").otherwise("bad_uri").alias("outcome"))


@query("SELECT p_name AS name, count(*) AS n, count(DISTINCT p_brand) > 1 AS in_two_strata FROM part GROUP BY p_name HAVING count(*) > 1")
def strata_rule_checks(spark, sf_dir):
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(n.alias("n"), (F.count_distinct("p_brand") > 1).alias("in_two_strata")).filter("n > 1")


@query(f"WITH {PARTS}, grid AS (SELECT z.zone, r.rc FROM (VALUES ('A'), ('B'), ('C')) z(zone), (VALUES ('RC1'), ('RC2'), ('RC3'), ('RC4'), ('RC5')) r(rc)) SELECT zone, rc FROM grid EXCEPT SELECT zone, rc FROM parts WHERE length_m >= 0")
def matrix_rules(spark, sf_dir):
    """Cells of the expected grid that the table lacks."""
    grid = spark.createDataFrame([(z, f"RC{r}") for z in "ABC" for r in range(1, 6)], "zone string, rc string")
    return grid.join(parts(spark, sf_dir).filter("length_m >= 0").select("zone", "rc").distinct(), ["zone", "rc"], "left_anti")


@query("SELECT l_partkey AS part_id, count(DISTINCT l_suppkey) AS n_zones, max(l_suppkey) AS zone FROM lineitem WHERE l_quantity > 30 GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) = 1")
def scope_purity_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").groupBy(F.col("l_partkey").alias("part_id"))
    return rows.agg(F.count_distinct("l_suppkey").alias("n_zones"), F.max("l_suppkey").alias("zone")).filter("n_zones = 1")


@query("""WITH f AS (SELECT l_suppkey AS id, count(*) AS n, sum((l_orderkey * 31 + l_linenumber * 7 + l_partkey) % 1000003) AS mark, count(*) FILTER (l_linenumber < 7) AS qc_n, sum((l_orderkey * 31 + l_linenumber * 7 + l_partkey) % 1000003) FILTER (l_linenumber < 7) AS qc_mark FROM lineitem GROUP BY 1)
SELECT id, CASE WHEN id % 10 = 9 THEN 'no_qc' WHEN n = qc_n AND mark = qc_mark THEN 'usable' ELSE 'awaiting_trip_qc' END AS state FROM f""")
def stale_qc_rule(spark, sf_dir):
    """A check counts only for the rows that it saw: the last one saw no seventh lines, and a tenth of the routes have none."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), "l_linenumber", ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7 + F.col("l_partkey")) % 1000003).alias("k"))
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))
    now, checked = rows.groupBy("id").agg(mark.alias("now")), rows.filter("l_linenumber < 7 and id % 10 <> 9").groupBy(F.col("id").alias("checked_id")).agg(mark.alias("then"))
    state = F.when(F.col("id") % 10 == 9, "no_qc").when(F.col("now").eqNullSafe(F.col("then")), "usable").otherwise("awaiting_trip_qc")
    return now.join(checked, F.col("id") == F.col("checked_id"), "left").select("id", state.alias("state"))


@query("SELECT l.l_suppkey AS route_id, count(*) AS n_passes, count(p.p_partkey) AS n_found, round(sum(p.p_retailprice), 2)::DOUBLE AS length_m FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p.p_size > 3 GROUP BY 1")
def walk_join(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_size > 3").select("p_partkey", "p_retailprice")
    rows = table(spark, sf_dir, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey"), "left")
    return rows.groupBy(F.col("l_suppkey").alias("route_id")).agg(F.count(F.lit(1)).alias("n_passes"), F.count("p_partkey").alias("n_found"), F.round(F.sum("p_retailprice"), 2).cast("double").alias("length_m"))


TURNS = """a AS (SELECT c_custkey AS arc_id, c_custkey % 40 AS way_id, c_custkey % 200 AS from_node, (c_custkey * 7 + 3) % 200 AS to_node FROM customer), r AS (SELECT s_suppkey AS id, s_suppkey % 40 AS from_way, (s_suppkey * 3 + 1) % 40 AS to_way, (s_suppkey * 11) % 200 AS via FROM supplier)"""


@query(f"""WITH {TURNS}, p AS (SELECT r.id, x.arc_id AS from_arc, y.arc_id AS to_arc FROM r JOIN a x ON x.way_id = r.from_way AND x.to_node = r.via JOIN a y ON y.way_id = r.to_way AND y.from_node = r.via WHERE NOT (r.from_way = r.to_way AND x.from_node = y.to_node))
SELECT id, from_arc, to_arc, count(*) OVER (PARTITION BY id) > 1 AS ambiguous FROM p""")
def turn_pair_theta_join(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    a = table(spark, sf_dir, "customer").select(k.alias("arc_id"), (k % 40).alias("way_id"), (k % 200).alias("from_node"), ((k * 7 + 3) % 200).alias("to_node"))
    r = table(spark, sf_dir, "supplier").select(s.alias("id"), (s % 40).alias("from_way"), ((s * 3 + 1) % 40).alias("to_way"), (s * 11 % 200).alias("via"))
    x = a.select(F.col("arc_id").alias("from_arc"), F.col("way_id").alias("from_way"), F.col("to_node").alias("via"), F.col("from_node").alias("start"))
    y = a.select(F.col("arc_id").alias("to_arc"), F.col("way_id").alias("to_way"), F.col("from_node").alias("via"), F.col("to_node").alias("end"))
    found = r.join(x, ["from_way", "via"]).join(y, ["to_way", "via"]).filter("not (from_way = to_way and start = end)")
    return found.select("id", "from_arc", "to_arc", (F.count(F.lit(1)).over(Window.partitionBy("id")) > 1).alias("ambiguous"))


@query("SELECT l_partkey AS part_id FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) = 1")
def one_direction_parts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part_id")).agg(F.count_distinct("l_returnflag").alias("n")).filter("n = 1").select("part_id")


@query(f"""WITH {GAP}, stored AS (SELECT route_id, CASE WHEN route_id % 10 = 0 THEN d + 0.01 ELSE d + 1e-12 END AS d FROM gap WHERE route_id % 13 <> 0)
SELECT route_id, CASE WHEN s.route_id IS NULL THEN 'not_stored' WHEN abs(s.d - g.d) <= 1e-9 THEN 'same' ELSE 'differs' END AS outcome FROM gap g LEFT JOIN stored s USING (route_id)""")
def history_recompute_join(spark, sf_dir):
    now = gaps(spark, sf_dir)
    r = F.col("route_id")
    stored = now.filter(r % 13 != 0).select(r.alias("old"), F.when(r % 10 == 0, F.col("d") + 0.01).otherwise(F.col("d") + 1e-12).alias("old_d"))
    rows = now.join(stored, F.col("route_id") == F.col("old"), "full")
    return rows.select("route_id", F.when(F.col("old").isNull(), "not_stored").when(F.abs(F.col("old_d") - F.col("d")) <= 1e-9, "same").otherwise("differs").alias("outcome"))


@query(f"""WITH {PARTS}, x AS (SELECT zone, rc, connector, lanes IS NULL AS unknown, length_m FROM parts) SELECT zone, rc, connector, unknown, round(sum(length_m), 2)::DOUBLE AS length_m FROM x GROUP BY ALL""")
def fine_cross_matrix(spark, sf_dir):
    return parts(spark, sf_dir).groupBy("zone", "rc", "connector", F.col("lanes").isNull().alias("unknown")).agg(F.round(F.sum("length_m"), 2).cast("double").alias("length_m"))


@query("""WITH e AS (SELECT l_orderkey AS relation, l_suppkey AS endpoint FROM lineitem UNION ALL SELECT l_orderkey, l_partkey FROM lineitem) SELECT relation, endpoint, count(*) AS degree FROM e GROUP BY ALL HAVING count(*) <> 2""")
def endpoint_degree_check(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    ends = l.select(F.col("l_orderkey").alias("relation"), F.col("l_suppkey").alias("endpoint")).union(l.select("l_orderkey", "l_partkey"))
    return ends.groupBy("relation", "endpoint").agg(F.count(F.lit(1)).alias("degree")).filter("degree <> 2")


@query("""SELECT coalesce(a.s, 'none') AS first_state, coalesce(b.s, 'none') AS second_state, count(*) AS n FROM (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT l_orderkey AS k, max(l_linestatus) AS s FROM lineitem GROUP BY 1) b USING (k) GROUP BY ALL""")
def tile_audit(spark, sf_dir):
    a = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("a"), F.col("o_orderstatus").alias("x"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("b")).agg(F.max("l_linestatus").alias("y"))
    rows = a.join(b, F.col("a") == F.col("b"), "full")
    return rows.groupBy(F.coalesce("x", F.lit("none")).alias("first_state"), F.coalesce("y", F.lit("none")).alias("second_state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (SELECT count(*) FROM (SELECT l_orderkey, l_partkey FROM lineitem EXCEPT ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity < 50)) AS n_lost, 0::BIGINT AS n_extra")
def cache_input_reconciliation(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem")
    stored, all_rows = raw.filter("l_quantity < 50").select("l_orderkey", "l_partkey"), raw.select("l_orderkey", "l_partkey")
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return spark.range(1).select(n(all_rows.exceptAll(stored)).alias("n_lost"), n(stored.exceptAll(all_rows)).alias("n_extra"))


@query("""WITH p AS (SELECT user_id AS trip_id, event_id, event_id % 1000 * 1.0 AS x, event_id % 777 * 1.0 AS y FROM events), l AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p WINDOW w AS (PARTITION BY trip_id ORDER BY event_id))
SELECT trip_id, event_id, round(CASE WHEN sqrt(dx * dx + dy * dy) >= 5 THEN dx / sqrt(dx * dx + dy * dy) END::DOUBLE, 7) AS ux, round(CASE WHEN sqrt(dx * dx + dy * dy) >= 5 THEN dy / sqrt(dx * dx + dy * dy) END::DOUBLE, 7) AS uy FROM l""")
def heading(spark, sf_dir):
    w = Window.partitionBy("trip_id").orderBy("event_id")
    e = F.col("event_id")
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("trip_id"), "event_id", (e % 1000 * 1.0).cast("double").alias("x"), (e % 777 * 1.0).cast("double").alias("y"))
    rows = p.select("trip_id", "event_id", (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy")).withColumn("m", F.hypot("dx", "dy"))
    return rows.select("trip_id", "event_id", *(F.round(F.when(F.col("m") >= 5, F.col(f"d{a}") / F.col("m")), 7).alias(f"u{a}") for a in "xy"))


@query(f"""WITH {SETS}, chosen AS (SELECT route_id, bucket FROM sets WHERE sample_id = 0), rest AS (SELECT c.route_id, c.bucket FROM cand c WHERE c.route_id NOT IN (SELECT route_id FROM chosen)),
tot AS (SELECT zone, rc, q, coalesce(length_m, 0) AS m FROM net LEFT JOIN (SELECT * FROM setvec WHERE sample_id = 0) USING (zone, rc)),
swap AS (SELECT r.route_id, b.route_id AS out_id, t.q, t.m - coalesce(o.length_m, 0) + coalesce(i.length_m, 0) AS m FROM rest r JOIN chosen b USING (bucket) CROSS JOIN tot t LEFT JOIN vec i ON i.route_id = r.route_id AND i.zone = t.zone AND i.rc = t.rc LEFT JOIN vec o ON o.route_id = b.route_id AND o.zone = t.zone AND o.rc = t.rc),
sd AS (SELECT route_id, out_id, 0.5 * sum(abs(q - m / w)) AS d FROM (SELECT *, sum(m) OVER (PARTITION BY route_id, out_id) AS w FROM swap) GROUP BY ALL)
SELECT route_id, out_id, round(d - v, 9) AS change FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY round(d, 10), out_id) AS r FROM sd), base WHERE r = 1""")
def reserve_replacement(spark, sf_dir):
    """For each route outside the chosen set, the member of its bucket that it best replaces: the least D of the set after the swap."""
    members = drawn(spark, sf_dir).filter("sample_id = 0").select("bucket", F.col("route_id").alias("out_id"))
    d = s.swapped(checkpoint(members), candidates(spark, sf_dir), checkpoint(vectors(spark, sf_dir)), checkpoint(network_cells(parts(spark, sf_dir))))
    best = d.groupBy("route_id").agg(F.min_by(F.struct("out_id", "d"), F.struct(F.round("d", 10), "out_id")).alias("b"))
    return best.select("route_id", "b.out_id", F.round(F.col("b.d") - baseline(spark, sf_dir), 9).alias("change"))


@query("""WITH p AS (SELECT p_partkey, [x FOR x IN string_split(p_type, ' ') IF x <> ''] AS names FROM part) SELECT p_partkey, CASE WHEN len(names) = 1 THEN names[1] ELSE names[1] || ' -> ' || names[len(names)] END AS label FROM p""")
def street_label(spark, sf_dir):
    names = F.filter(F.array_distinct(F.split("p_type", " ")), lambda x: x != "")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.size(names) == 1, names[0]).otherwise(F.concat(names[0], F.lit(" -> "), F.element_at(names, -1))).alias("label"))


@query(f"""WITH {SETS}, x AS (SELECT s.sample_id, s.route_id, t.q, t.v - coalesce(o.length_m, 0) AS m FROM sets s JOIN setdense t USING (sample_id) LEFT JOIN vec o ON o.route_id = s.route_id AND o.zone = t.zone AND o.rc = t.rc),
l AS (SELECT sample_id, route_id, 0.5 * sum(abs(q - m / w)) AS d FROM (SELECT *, sum(m) OVER (PARTITION BY sample_id, route_id) AS w FROM x) WHERE w > 0 GROUP BY ALL)
SELECT sample_id, route_id, round(d - value, 9) AS change FROM l JOIN scores USING (sample_id)""")
def leave_one_out_scores(spark, sf_dir):
    """Change of a set's D without each of its routes."""
    members, v, net = checkpoint(drawn(spark, sf_dir)), checkpoint(vectors(spark, sf_dir)), checkpoint(network_cells(parts(spark, sf_dir)))
    left = s.without_each(members.select("sample_id", "route_id"), v, net)
    return left.join(s.scored(members, v, net), "sample_id").select("sample_id", "route_id", F.round(F.col("d") - F.col("value"), 9).alias("change"))


@query(f"""WITH {SETS}, m AS (SELECT sample_id // 20 AS method, min_by(sample_id, (round(value, 10), sample_id)) AS sample_id FROM scores GROUP BY 1)
SELECT method, m.sample_id, round(value, 8) AS d, round(value - v, 8) AS difference, round(top, 8) AS d_domain_mean, abs(length_m / base_m - 1) <= 0.1 AS length_matched FROM m JOIN scores USING (sample_id), base""")
def method_comparison(spark, sf_dir):
    """The best set of each method (a block of starts), against the chosen set."""
    rows = checkpoint(scores(spark, sf_dir))
    base = lambda name: rows.filter("sample_id = 0").select(name).scalar()
    best = rows.groupBy(F.floor(F.col("sample_id") / 20).alias("method")).agg(F.min_by(F.struct(*rows.columns), F.struct(F.round("value", 10), "sample_id")).alias("b"))
    return best.select("method", "b.sample_id", F.round("b.value", 8).alias("d"), F.round(F.col("b.value") - base("value"), 8).alias("difference"), F.round("b.top", 8).alias("d_domain_mean"), (F.abs(F.col("b.length_m") / base("length_m") - 1) <= 0.1).alias("length_matched"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def metrics_flatten(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"""WITH {GAP}, len AS (SELECT route_id, sum(length_m) AS m, count(DISTINCT part_id) AS n_parts, count(*) AS n FROM walks GROUP BY route_id)
SELECT route_id, array_to_string([x FOR x IN [CASE WHEN d > 0.2 THEN 'gap' END, CASE WHEN m < 5000 THEN 'length' END, CASE WHEN (n - n_parts) / n::DOUBLE >= 0.2 THEN 'repeated' END] IF x IS NOT NULL], ';') AS reasons FROM gap JOIN len USING (route_id)""")
def candidate_acceptance(spark, sf_dir):
    length = walks(spark, sf_dir).groupBy("route_id").agg(F.sum("length_m").alias("m"), F.count_distinct("part_id").alias("n_parts"), F.count(F.lit(1)).alias("n"))
    rules = {"gap": F.col("d") > 0.2, "length": F.col("m") < 5000, "repeated": (F.col("n") - F.col("n_parts")) / F.col("n") >= 0.2}
    return gaps(spark, sf_dir).join(length, "route_id").select("route_id", F.array_join(flag_array(rules), ";").alias("reasons"))


@query(f"""WITH {EVIDENCE}, w AS (SELECT *, max(day) FILTER (NOT passed) OVER g AS last_fail, max(day) OVER g AS newest FROM evidence WINDOW g AS (PARTITION BY route_id, field)),
g AS (SELECT route_id, field, any_value(last_fail) AS last_fail, any_value(newest) AS newest, count(DISTINCT CASE WHEN passed AND (last_fail IS NULL OR day > last_fail) THEN day END) AS days FROM w GROUP BY ALL)
SELECT route_id, field, CASE WHEN last_fail = newest THEN 'repair' ELSE 'observe' END AS task, 2 - days AS days_needed FROM g WHERE last_fail = newest OR days < 2""")
def field_worklists(spark, sf_dir):
    """What is left to do in the field: gates of a route that failed last, or lack passing days."""
    from wayloom.operators.coverage import gate_states

    states = gate_states(evidence(spark, sf_dir), 2).filter("state <> 'passed'")
    return states.select("route_id", "field", F.when(F.col("state") == "failed", "repair").otherwise("observe").alias("task"), (2 - F.col("passing_days")).alias("days_needed"))


@query(f"""WITH {GAP}, cand AS (SELECT route_id, d FROM gap), a AS (SELECT * FROM cand WHERE route_id % 50 = 0) SELECT a.route_id AS seed, b.route_id AS partner FROM a, LATERAL (SELECT route_id, row_number() OVER (ORDER BY round(abs(cand.d - a.d), 10), route_id) AS r FROM cand WHERE cand.route_id <> a.route_id) b WHERE b.r = 1""")
def seed_pair_cross_join(spark, sf_dir):
    """The nearest partner by gap of every seed: seeds are the ids divisible by 50, a stated query set."""
    d = stored(gaps(spark, sf_dir))
    seeds = d.filter("route_id % 50 = 0").select(F.col("route_id").alias("seed"), F.col("d").alias("seed_d"))
    rows = seeds.join(d, F.col("seed") != F.col("route_id")).withColumn("far", F.round(F.abs(F.col("d") - F.col("seed_d")), 10))
    # Two plain minima, which keep a number for each seed; the least of a struct would sort all rows of the join.
    least = F.broadcast(stored(rows.groupBy("seed").agg(F.min("far").alias("least"))).withColumnRenamed("seed", "of"))
    return rows.join(least, F.col("seed") == F.col("of")).filter("far = least").groupBy("seed").agg(F.min("route_id").alias("partner"))


@query(f"WITH {WALKS}, {PARTS} SELECT p.rc, count(*) AS n, round(avg(w.length_m), 6) AS mean_m FROM walks w JOIN parts p USING (part_id) GROUP BY p.rc ORDER BY p.rc")
def stable_orderings(spark, sf_dir):
    rows = walks(spark, sf_dir).join(parts(spark, sf_dir).select("part_id", "rc"), "part_id").groupBy("rc").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("length_m"), 6).alias("mean_m"))
    return rows.orderBy("rc")
