"""Queries of coverage (orders as trips) and evidence (events as observations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.operators import coverage as c

from .registry import query
from .views import EVIDENCE, TRIPS, evidence, table, trips

BLOCKS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRIORITIES = "(SELECT DISTINCT o_orderpriority AS time_block FROM orders)"


def grid(spark, sf_dir):
    """Routes, blocks and day types: small dimensions found in the data."""
    t = trips(spark, sf_dir)
    days = F.explode(F.array(F.lit("weekday"), F.lit("weekend"))).alias("day_type")
    blocks = t.agg(F.collect_set("time_block")).scalar()
    return t.select("route_id").distinct().select("route_id", F.explode(blocks).alias("time_block")).select("*", days)


GRID = f"grid AS (SELECT r.route_id, b.time_block, d.day_type FROM (SELECT DISTINCT route_id FROM trips) r, {PRIORITIES} b, (VALUES ('weekday'), ('weekend')) d(day_type))"
CELLS = f"""{TRIPS}, {GRID}, n AS (SELECT route_id, time_block, day_type, count(*) AS n_trips, count(DISTINCT started) AS n_dates FROM trips WHERE status <> 'P' GROUP BY ALL),
cells AS (SELECT g.*, coalesce(n_trips, 0) AS n_trips, coalesce(n_dates, 0) AS n_dates, CASE WHEN g.route_id % 5 = 0 THEN NULL ELSE 40 END AS target FROM grid g LEFT JOIN n USING (route_id, time_block, day_type)),
done AS (SELECT *, CASE WHEN n_trips = 0 THEN 'not_observed' WHEN target IS NULL THEN 'observed_target_unset' WHEN n_trips >= target THEN 'target_met' ELSE 'below_target' END AS status FROM cells)"""


def cells(spark, sf_dir):
    target = F.when(F.col("route_id") % 5 != 0, F.lit(40))
    return c.coverage_cells(grid(spark, sf_dir), trips(spark, sf_dir).filter("status <> 'P'"), ["route_id", "time_block", "day_type"], target)


@query("""SELECT r.route_id, b.b AS time_block, d.d AS day_type, CAST(n.n AS INT) AS repeat, 'P-' || left(sha256(r.route_id || '|' || b.b || '|' || d.d || '|' || n.n), 16) AS plan_id
FROM (SELECT DISTINCT o_custkey % 30 AS route_id FROM orders) r, (VALUES ('morning'), ('noon'), ('evening')) b(b), (VALUES ('weekday'), ('weekend')) d(d), (VALUES (1), (2)) n(n)""")
def schedule_cross_join(spark, sf_dir):
    return c.schedule(trips(spark, sf_dir).select("route_id").distinct(), ["morning", "noon", "evening"], ["weekday", "weekend"], 2)


@query(f"""WITH {TRIPS} SELECT trip_id, device_id, coalesce(max(ended) OVER (PARTITION BY device_id ORDER BY started, ended, trip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > started, false)
 OR coalesce(lead(started) OVER (PARTITION BY device_id ORDER BY started, ended, trip_id) < ended, false) AS conflict FROM trips""")
def interval_overlap_join(spark, sf_dir):
    return c.resource_conflicts(trips(spark, sf_dir), "device_id").select("trip_id", "device_id", "conflict")


@query(f"WITH {CELLS} SELECT route_id, time_block, day_type, n_trips, n_dates, status FROM done")
def coverage_dense_left_join(spark, sf_dir):
    return cells(spark, sf_dir).select("route_id", "time_block", "day_type", "n_trips", "n_dates", "status")


@query(f"WITH {CELLS} SELECT route_id, count(*) AS n_cells, count(*) FILTER (status = 'target_met') AS n_met, bool_and(status = 'target_met') AS complete FROM done GROUP BY route_id")
def coverage_rollup(spark, sf_dir):
    met = F.col("status") == "target_met"
    return cells(spark, sf_dir).groupBy("route_id").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(met).alias("n_met"), F.bool_and(met).alias("complete"))


@query(f"WITH {CELLS} SELECT route_id, time_block, day_type, status FROM done WHERE status <> 'target_met'")
def incomplete_cells_filter(spark, sf_dir):
    return cells(spark, sf_dir).filter("status <> 'target_met'").select("route_id", "time_block", "day_type", "status")


@query(f"WITH {TRIPS} SELECT day_type, status, time_block, count(*) AS n, count(*) FILTER (trip_id % 2 = 0) AS n_even FROM trips GROUP BY ALL")
def condition_summary(spark, sf_dir):
    return trips(spark, sf_dir).groupBy("day_type", "status", "time_block").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("trip_id") % 2 == 0).alias("n_even"))


@query("""WITH b(block, lo, hi) AS (VALUES ('morning', '07:00:00', '09:00:00'), ('noon', '10:00:00', '12:00:00'), ('evening', '17:00:00', '19:00:00'))
SELECT event_id, block FROM events LEFT JOIN b ON strftime(ts, '%H:%M:%S') >= lo AND strftime(ts + INTERVAL 5 MINUTE, '%H:%M:%S') <= hi AND strftime(ts, '%H:%M:%S') < hi""")
def time_block_range_join(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("a"), F.date_format(F.expr("timestampadd(MINUTE, 5, ts)"), "HH:mm:ss").alias("b"))
    inside = lambda lo, hi: (F.col("a") >= lo) & (F.col("a") < hi) & (F.col("b") <= hi)
    block = F.when(inside("07:00:00", "09:00:00"), "morning").when(inside("10:00:00", "12:00:00"), "noon").when(inside("17:00:00", "19:00:00"), "evening")
    return rows.select("event_id", block.alias("block"))


@query(f"""WITH {TRIPS}, plans AS (SELECT trip_id AS plan_id, route_id, day_type FROM trips WHERE trip_id % 4 = 0), x AS (SELECT t.trip_id, t.trip_id // 8 * 8 AS plan_id, t.route_id, t.day_type FROM trips t)
SELECT x.trip_id, CASE WHEN p.plan_id IS NULL THEN 'unknown_plan' WHEN count(*) OVER (PARTITION BY x.plan_id) > 1 THEN 'plan_used_twice' WHEN p.route_id <> x.route_id THEN 'route_differs' ELSE 'ok' END AS outcome FROM x LEFT JOIN plans p ON p.plan_id = x.plan_id""")
def plan_slot_join(spark, sf_dir):
    from pyspark.sql import Window

    t = trips(spark, sf_dir)
    plans = t.filter("trip_id % 4 = 0").select(F.col("trip_id").alias("known_plan"), F.col("route_id").alias("plan_route"))
    used = F.count(F.lit(1)).over(Window.partitionBy("plan_id"))
    rows = t.withColumn("plan_id", F.floor(F.col("trip_id") / 8) * 8).withColumn("used", used).join(plans, F.col("plan_id") == F.col("known_plan"), "left")
    return rows.select("trip_id", F.when(F.col("known_plan").isNull(), "unknown_plan").when(F.col("used") > 1, "plan_used_twice").when(F.col("plan_route") != F.col("route_id"), "route_differs").otherwise("ok").alias("outcome"))


@query("""WITH m AS (SELECT l_orderkey AS trip_id, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey AS trip_id, coalesce(n, 0) AS n_metrics, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'several' ELSE 'one' END AS outcome, CASE WHEN n = 1 THEN q END AS value FROM orders LEFT JOIN m ON trip_id = o_orderkey""")
def metrics_join_exactly_one(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trip_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).cast("double").alias("q"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip_id")).join(m, "trip_id", "left")
    return rows.select("trip_id", F.coalesce("n", F.lit(0)).alias("n_metrics"), F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "several").otherwise("one").alias("outcome"), F.when(F.col("n") == 1, F.col("q")).alias("value"))


@query(f"""WITH {TRIPS} SELECT trip_id, array_to_string([x FOR x IN [CASE WHEN status = 'P' THEN 'collection_stage_pilot' END, CASE WHEN route_id % 7 = 0 THEN 'route_version_mismatch' END, CASE WHEN day_type = 'weekend' AND time_block = '5-LOW' THEN 'time_block_not_planned' END] IF x IS NOT NULL], ';') AS reasons FROM trips""")
def coverage_audit_rules(spark, sf_dir):
    from wayloom.operators.kinematics import flag_array

    rules = {"collection_stage_pilot": F.col("status") == "P", "route_version_mismatch": F.col("route_id") % 7 == 0, "time_block_not_planned": (F.col("day_type") == "weekend") & (F.col("time_block") == "5-LOW")}
    return trips(spark, sf_dir).select("trip_id", F.array_join(flag_array(rules), ";").alias("reasons"))


@query(f"""WITH {TRIPS}, first_row AS (SELECT trip_id, status FROM trips) SELECT e.event_id, t.trip_id, CASE WHEN t.trip_id IS NULL THEN 'unknown_trip_id' WHEN t.status = 'P' THEN 'invalid_trip_metadata' ELSE 'ok' END AS outcome FROM events e LEFT JOIN first_row t ON t.trip_id = e.event_id""")
def points_to_trips(spark, sf_dir):
    t = c.latest(trips(spark, sf_dir), ["trip_id"], F.col("started"), F.col("device_id")).select("trip_id", "status")
    rows = table(spark, sf_dir, "events").select("event_id").join(t, F.col("event_id") == F.col("trip_id"), "left")
    return rows.select("event_id", "trip_id", F.when(F.col("trip_id").isNull(), "unknown_trip_id").when(F.col("status") == "P", "invalid_trip_metadata").otherwise("ok").alias("outcome"))


@query(f"""WITH {TRIPS}, r AS (SELECT c_custkey % 30 AS route_id, min(c_nationkey) AS zone FROM customer WHERE c_custkey % 30 < 25 GROUP BY 1)
SELECT t.trip_id, array_to_string([x FOR x IN [CASE WHEN r.route_id IS NOT NULL AND t.device_id % 4 <> r.zone % 4 THEN 'sampling_zone_mismatch' END, CASE WHEN r.route_id IS NULL THEN 'unknown_route_id' END] IF x IS NOT NULL], ';') AS flags FROM trips t LEFT JOIN r USING (route_id)""")
def trips_to_routes(spark, sf_dir):
    from wayloom.operators.kinematics import flag_array

    r = table(spark, sf_dir, "customer").filter("c_custkey % 30 < 25").groupBy((F.col("c_custkey") % 30).alias("known")).agg(F.min("c_nationkey").alias("zone"))
    rows = trips(spark, sf_dir).join(r, F.col("route_id") == F.col("known"), "left")
    known = F.col("known").isNotNull()
    rules = {"sampling_zone_mismatch": known & (F.col("device_id") % 4 != F.col("zone") % 4), "unknown_route_id": ~known}
    return rows.select("trip_id", F.array_join(flag_array(rules), ";").alias("flags"))


TRIP_TEXT = """k AS (SELECT o_orderkey AS k, o_custkey AS c, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day FROM orders),
tt AS (SELECT CAST(k - CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS trip_id, CAST(c % 30 AS VARCHAR) AS route_id, CASE WHEN k % 67 = 0 THEN '' ELSE 'V' || c % 9 END AS vehicle_id, day || CASE WHEN k % 31 = 0 THEN 'T02:00:00' ELSE 'T02:00:00+07:00' END AS started_at,
  CASE WHEN k % 41 = 0 THEN NULL WHEN k % 37 = 0 THEN day || 'T02:00:00+07:00' ELSE day || 'T03:30:00+07:00' END AS ended_at, CASE WHEN k % 43 = 0 THEN next_day WHEN k % 47 = 0 THEN '2024-13-01' ELSE day END AS measurement_date,
  chr(65 + CAST((c + CASE WHEN k % 53 = 0 THEN 1 ELSE 0 END) % 3 AS INT)) AS sampling_zone, CASE WHEN k % 59 = 0 THEN 'p2' ELSE 'p1' END AS policy_version, CASE WHEN k % 23 = 0 THEN 'r2' ELSE 'r1' END AS route_version, CASE WHEN k % 19 = 0 THEN NULL ELSE 'b1' END AS source_bundle_sha256, CASE WHEN k % 61 = 0 THEN 'maybe' ELSE 'unknown' END AS lez_status FROM k)"""


def trip_texts(spark, sf_dir):
    """Trips as a file would state them: all fields are text, some of them faulty."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    fault = lambda n: k % n == 0
    day, next_day = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 1), "yyyy-MM-dd")
    fields = {
        "trip_id": (k - F.when(fault(29), 1).otherwise(0)).cast("string"), "route_id": (c % 30).cast("string"), "vehicle_id": F.when(fault(67), "").otherwise(F.concat(F.lit("V"), (c % 9).cast("string"))),
        "started_at": F.concat(day, F.when(fault(31), "T02:00:00").otherwise("T02:00:00+07:00")), "ended_at": F.when(~fault(41), F.concat(day, F.when(fault(37), "T02:00:00+07:00").otherwise("T03:30:00+07:00"))),
        "measurement_date": F.when(fault(43), next_day).when(fault(47), "2024-13-01").otherwise(day), "sampling_zone": F.char(65 + (c + F.when(fault(53), 1).otherwise(0)) % 3),
        "policy_version": F.when(fault(59), "p2").otherwise("p1"), "route_version": F.when(fault(23), "r2").otherwise("r1"), "source_bundle_sha256": F.when(~fault(19), "b1"), "lez_status": F.when(fault(61), "maybe").otherwise("unknown"),
    }
    return table(spark, sf_dir, "orders").select(*(v.alias(n) for n, v in fields.items()))


@query(f"""WITH {TRIP_TEXT}, r AS (SELECT DISTINCT CAST(c_custkey % 30 AS VARCHAR) AS route, chr(65 + CAST(c_custkey % 3 AS INT)) AS zone FROM customer WHERE c_custkey % 30 < 27),
x AS (SELECT tt.*, r.route IS NOT NULL AS known, r.zone, count(*) OVER (PARTITION BY trip_id) AS n_rows FROM tt LEFT JOIN r ON r.route = tt.route_id)
SELECT trip_id, route_id, started_at, n_rows, array_to_string(list_sort([f FOR f IN [CASE WHEN vehicle_id = '' THEN 'missing:vehicle_id' END, CASE WHEN ended_at IS NULL THEN 'missing:ended_at' END, CASE WHEN n_rows > 1 THEN 'duplicate_trip_id' END, CASE WHEN NOT known THEN 'unknown_route_id' END,
  CASE WHEN length(started_at) < 20 THEN 'invalid_started_at' END, CASE WHEN ended_at IS NULL THEN 'invalid_ended_at' END, CASE WHEN length(started_at) > 20 AND ended_at <= started_at THEN 'invalid_trip_time_range' END,
  CASE WHEN try_cast(measurement_date AS DATE) IS NULL THEN 'invalid_measurement_date' END, CASE WHEN length(started_at) > 20 AND try_cast(measurement_date AS DATE) <> try_cast(started_at[:10] AS DATE) THEN 'measurement_date_mismatch' END,
  CASE WHEN known AND sampling_zone <> zone THEN 'sampling_zone_mismatch' END, CASE WHEN known AND policy_version <> 'p1' THEN 'policy_version_mismatch' END, CASE WHEN known AND route_version <> 'r1' THEN 'route_version_mismatch' END, CASE WHEN known AND source_bundle_sha256 IS NULL THEN 'source_bundle_sha256_mismatch' END,
  CASE WHEN lez_status <> 'unknown' THEN 'invalid_lez_status' END] IF f IS NOT NULL]), ';') AS flags FROM x""")
def trip_qc_flags(spark, sf_dir):
    """All checks of a trip's record: its own fields, its id, and what its route asks for."""
    from wayloom.operators.kinematics import check_trips

    k = F.col("c_custkey")
    routes = table(spark, sf_dir, "customer").filter(k % 30 < 27).select((k % 30).cast("string").alias("route_id"), F.char(65 + k % 3).alias("sampling_zone"), F.lit("p1").alias("policy_version"), F.lit("r1").alias("route_version"), F.lit("b1").alias("source_bundle_sha256")).distinct()
    checked = check_trips(trip_texts(spark, sf_dir), routes, "Asia/Bangkok")
    return checked.select("trip_id", "route_id", "started_at", "n_rows", F.array_join("flags", ";").alias("flags"))


@query(f"""WITH {EVIDENCE}, w AS (SELECT *, max(day) FILTER (NOT passed) OVER g AS last_fail, max(day) OVER g AS newest FROM evidence WINDOW g AS (PARTITION BY route_id, field)),
s AS (SELECT route_id, field, any_value(last_fail) AS last_fail, any_value(newest) AS newest, count(DISTINCT CASE WHEN passed AND (last_fail IS NULL OR day > last_fail) THEN day END) AS passing_days FROM w GROUP BY ALL)
SELECT route_id, field, passing_days, CASE WHEN last_fail = newest THEN 'failed' WHEN passing_days >= 2 THEN 'passed' ELSE 'unknown' END AS state FROM s""")
def gate_assessment(spark, sf_dir):
    return c.gate_states(evidence(spark, sf_dir), 2).select("route_id", "field", "passing_days", "state")


@query(f"""WITH {EVIDENCE}, w AS (SELECT *, max(day) FILTER (NOT passed) OVER g AS last_fail, max(day) OVER g AS newest FROM evidence WINDOW g AS (PARTITION BY route_id, field)),
s AS (SELECT route_id, field, any_value(last_fail) AS last_fail, any_value(newest) AS newest, count(DISTINCT CASE WHEN passed AND (last_fail IS NULL OR day > last_fail) THEN day END) AS passing_days FROM w GROUP BY ALL),
t AS (SELECT *, CASE WHEN last_fail = newest THEN 'failed' WHEN passing_days >= 2 THEN 'passed' ELSE 'unknown' END AS state FROM s)
SELECT state, count(*) AS n, count(DISTINCT route_id) AS n_routes FROM t GROUP BY state""")
def status_counts(spark, sf_dir):
    return c.gate_states(evidence(spark, sf_dir), 2).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("route_id").alias("n_routes"))


@query(f"WITH {EVIDENCE} SELECT route_id, field, part_id, day, count(DISTINCT value) AS n_values FROM evidence GROUP BY ALL HAVING count(DISTINCT value) > 1")
def simultaneous_conflicts(spark, sf_dir):
    return evidence(spark, sf_dir).groupBy("route_id", "field", "part_id", "day").agg(F.count_distinct("value").alias("n_values")).filter("n_values > 1")


@query(f"WITH {EVIDENCE} SELECT route_id, field, observation_id, value FROM (SELECT *, row_number() OVER (PARTITION BY route_id, field ORDER BY day DESC, observation_id DESC) AS r FROM evidence) WHERE r = 1")
def latest_per_scope(spark, sf_dir):
    return c.latest(evidence(spark, sf_dir), ["route_id", "field"], F.desc("day"), F.desc("observation_id")).select("route_id", "field", "observation_id", "value")


@query(f"""WITH {EVIDENCE}, s AS (SELECT *, CASE observation_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS rank_of FROM evidence)
SELECT route_id, part_id, observation_id FROM (SELECT *, row_number() OVER (PARTITION BY route_id, part_id ORDER BY day DESC, rank_of DESC, observation_id) AS r FROM s) WHERE r = 1""")
def latest_specific_evidence(spark, sf_dir):
    rows = evidence(spark, sf_dir).withColumn("specific", 3 - F.col("observation_id") % 3)
    return c.latest(rows, ["route_id", "part_id"], F.desc("day"), F.desc("specific"), F.col("observation_id")).select("route_id", "part_id", "observation_id")


KNOWN = f"""{EVIDENCE}, known AS (SELECT observation_id, route_id, field, value FROM evidence WHERE observation_id % 3 = 0),
new_rows AS (SELECT observation_id, route_id, field, CASE WHEN observation_id % 30 = 0 THEN value + 1 ELSE value END AS value FROM evidence WHERE observation_id % 2 = 0)"""


def import_tables(spark, sf_dir):
    e = evidence(spark, sf_dir).select("observation_id", "route_id", "field", "value")
    return e.filter("observation_id % 3 = 0"), e.filter("observation_id % 2 = 0").withColumn("value", F.when(F.col("observation_id") % 30 == 0, F.col("value") + 1).otherwise(F.col("value")))


@query(f"""WITH {KNOWN} SELECT n.observation_id, CASE WHEN k.observation_id IS NULL THEN 'new' WHEN n.route_id = k.route_id AND n.field = k.field AND n.value IS NOT DISTINCT FROM k.value THEN 'same' ELSE 'conflict' END AS outcome FROM new_rows n LEFT JOIN known k USING (observation_id)""")
def idempotent_import(spark, sf_dir):
    return c.import_rows(*import_tables(spark, sf_dir), "observation_id").select("observation_id", "outcome")


@query(f"WITH {KNOWN} SELECT * FROM known UNION ALL SELECT * FROM new_rows WHERE observation_id NOT IN (SELECT observation_id FROM known)")
def observation_append(spark, sf_dir):
    known, new = import_tables(spark, sf_dir)
    return known.unionByName(c.import_rows(known, new, "observation_id").filter("outcome = 'new'").drop("outcome"))


@query(f"WITH {KNOWN} SELECT 'removed' AS change, count(*) AS n FROM (SELECT observation_id FROM known EXCEPT SELECT observation_id FROM new_rows) UNION ALL SELECT 'added', count(*) FROM (SELECT observation_id FROM new_rows EXCEPT SELECT observation_id FROM known)")
def membership_changes(spark, sf_dir):
    known, new = (x.select("observation_id") for x in import_tables(spark, sf_dir))
    n = lambda x, name: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("change"), "n")
    return n(known.exceptAll(new), "removed").union(n(new.exceptAll(known), "added"))


@query(f"WITH {KNOWN} SELECT (SELECT count(*) FROM (SELECT route_id FROM known EXCEPT SELECT route_id FROM new_rows)) = 0 AND (SELECT count(*) FROM (SELECT route_id FROM new_rows EXCEPT SELECT route_id FROM known)) = 0 AS equal")
def id_set_equality(spark, sf_dir):
    known, new = (x.select("route_id").distinct() for x in import_tables(spark, sf_dir))
    rest = known.exceptAll(new).union(new.exceptAll(known))
    return rest.agg((F.count(F.lit(1)) == 0).alias("equal"))


@query(f"WITH {EVIDENCE} SELECT e.observation_id, array_to_string([x FOR x IN [CASE WHEN p.p_partkey IS NULL THEN 'part_not_on_route' END, CASE WHEN s.s_suppkey IS NULL THEN 'route_unknown' END] IF x IS NOT NULL], ';') AS problems FROM evidence e LEFT JOIN part p ON p.p_partkey = e.part_id AND p.p_size > 10 LEFT JOIN supplier s ON s.s_suppkey = e.route_id")
def linkage_checks(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_size > 10").select("p_partkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    rows = evidence(spark, sf_dir).join(p, F.col("p_partkey") == F.col("part_id"), "left").join(s, F.col("s_suppkey") == F.col("route_id"), "left")
    problems = F.array_compact(F.array(F.when(F.col("p_partkey").isNull(), "part_not_on_route"), F.when(F.col("s_suppkey").isNull(), "route_unknown")))
    return rows.select("observation_id", F.array_join(problems, ";").alias("problems"))


@query("""WITH l AS (SELECT l_suppkey AS route_id, l_quantity::DOUBLE AS m, CASE WHEN l_linenumber % 3 = 0 THEN l_tax::DOUBLE * 100 END AS obs, CASE WHEN l_linenumber % 2 = 0 THEN l_discount::DOUBLE * 100 END AS tag FROM lineitem)
SELECT route_id, round(sum(obs * m) / sum(m) FILTER (obs IS NOT NULL), 7) AS observed, round(coalesce(sum(m) FILTER (obs IS NOT NULL), 0) / sum(m), 7) AS covered, round(sum(coalesce(obs, tag, 5) * m) / sum(m), 7) AS hybrid FROM l GROUP BY route_id""")
def evidence_length_weighting(spark, sf_dir):
    m, n = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("route_id"), m.alias("m"), F.when(n % 3 == 0, F.col("l_tax").cast("double") * 100).alias("obs"), F.when(n % 2 == 0, F.col("l_discount").cast("double") * 100).alias("tag"))
    seen = F.sum(F.when(F.col("obs").isNotNull(), F.col("m")))
    return rows.groupBy("route_id").agg(F.round(F.try_divide(F.sum(F.col("obs") * F.col("m")), seen), 7).alias("observed"), F.round(F.coalesce(seen, F.lit(0.0)) / F.sum("m"), 7).alias("covered"), F.round(F.sum(F.coalesce("obs", "tag", F.lit(5.0)) * F.col("m")) / F.sum("m"), 7).alias("hybrid"))


@query(f"WITH {EVIDENCE} SELECT route_id, string_agg(DISTINCT field, ';' ORDER BY field) AS reasons FROM evidence WHERE NOT passed GROUP BY route_id")
def blocked_routes(spark, sf_dir):
    return evidence(spark, sf_dir).filter("not passed").groupBy("route_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ";").alias("reasons"))


@query("SELECT s_suppkey AS route_id, round((CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END) / 2.0 + s_nationkey / 10.0, 6) AS priority FROM supplier")
def desk_priority(spark, sf_dir):
    s = F.col("s_suppkey")
    missing = (s % 2 == 0).cast("int") + (s % 3 == 0).cast("int")
    return table(spark, sf_dir, "supplier").select(s.alias("route_id"), F.round(missing / 2.0 + F.col("s_nationkey") / 10.0, 6).alias("priority"))


@query(f"WITH {EVIDENCE} SELECT observation_id, field, CASE WHEN field IN ('click', 'view') THEN 'overlay' ELSE 'rebuild' END AS action FROM evidence WHERE passed AND field <> 'purchase'")
def update_plan(spark, sf_dir):
    rows = evidence(spark, sf_dir).filter("passed and field <> 'purchase'")
    return rows.select("observation_id", "field", F.when(F.col("field").isin("click", "view"), "overlay").otherwise("rebuild").alias("action"))
