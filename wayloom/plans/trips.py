"""Queries of the trip family over points (events) and trips (orders)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import scalar
from wayloom.operators import kinematics as k

from .registry import query
from .views import POINTS, points, table

RULES = k.TripRules(max_gap_s=86400.0)
EDGES = "[" + ", ".join(f"{x:.1f}" for x in RULES.speed_edges) + "]"

CHECKED = f"""{POINTS},
kmh AS (SELECT *, CASE speed_unit WHEN 'km/h' THEN speed WHEN 'm/s' THEN speed * 3.6 END AS speed_kmh FROM points),
lagged AS (SELECT *, t - lag(t) OVER w AS interval_s, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(speed_kmh) OVER w AS start_kmh,
  row_number() OVER (PARTITION BY trip_id, t ORDER BY source_row) > 1 AS repeated, row_number() OVER w - 1 AS "order" FROM kmh WINDOW w AS (PARTITION BY trip_id ORDER BY source_row)),
moved AS (SELECT *, CASE WHEN interval_s > 0 THEN 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))) END AS distance_m,
  CASE WHEN interval_s > 0 THEN (speed_kmh - start_kmh) / 3.6 / interval_s END AS acceleration FROM lagged),
flagged AS (SELECT *, [x FOR x IN [
  CASE WHEN abs(acceleration) > 8 THEN 'acceleration_outlier' END, CASE WHEN repeated THEN 'duplicate_timestamp' END,
  CASE WHEN distance_m / interval_s * 3.6 > 180 THEN 'gps_jump' END, CASE WHEN speed IS NULL THEN 'invalid_speed' END,
  CASE WHEN speed_kmh IS NULL AND speed IS NOT NULL THEN 'invalid_speed_unit' END, CASE WHEN speed < 0 THEN 'negative_speed' END,
  CASE WHEN interval_s <= 0 THEN 'nonmonotonic_time' END, CASE WHEN interval_s > 86400 THEN 'sampling_gap' END, CASE WHEN speed_kmh > 180 THEN 'speed_outlier' END] IF x IS NOT NULL] AS flags FROM moved),
checked AS (SELECT *, NOT list_has_any(flags, ['duplicate_timestamp', 'nonmonotonic_time', 'gps_jump']) AS gps_valid,
  NOT list_has_any(flags, ['negative_speed', 'speed_outlier', 'invalid_speed', 'invalid_speed_unit', 'duplicate_timestamp', 'nonmonotonic_time']) AS speed_valid FROM flagged),
intervals AS (SELECT *, coalesce(interval_s > 0 AND interval_s <= 86400, false) AND coalesce(lag(gps_valid) OVER w, false) AND gps_valid AS gps_interval_valid,
  coalesce(interval_s > 0 AND interval_s <= 86400, false) AND coalesce(lag(speed_valid) OVER w, false) AND speed_valid AND NOT list_contains(flags, 'acceleration_outlier') AS speed_interval_valid FROM checked WINDOW w AS (PARTITION BY trip_id ORDER BY source_row)),
reasoned AS (SELECT *, acceleration AS a, [x FOR x IN [
  CASE WHEN NOT speed_interval_valid THEN 'QC_speed_interval_invalid' END, CASE WHEN NOT coalesce(interval_s > 0 AND interval_s <= 86400, false) THEN 'invalid_or_gap_interval' END,
  CASE WHEN NOT coalesce(abs(acceleration) <= 8 + 1e-12, false) THEN 'invalid_or_outlier_acceleration' END,
  CASE WHEN start_kmh IS NULL OR speed_kmh IS NULL OR least(start_kmh, speed_kmh) < 0 OR greatest(start_kmh, speed_kmh) > 180 THEN 'invalid_speed_endpoints' END] IF x IS NOT NULL] AS reasons FROM intervals WHERE "order" > 0),
audit AS (SELECT *, len(reasons) = 0 AS used, CASE WHEN len(reasons) = 0 THEN interval_s END AS used_s, CASE WHEN len(reasons) = 0 THEN (start_kmh + speed_kmh) / 7.2 END AS mean FROM reasoned),
amounts AS (SELECT *, mean * used_s AS used_m, CASE WHEN used THEN CASE WHEN a > 0 THEN mean * a * used_s ELSE 0 END END AS rpa_n,
  CASE WHEN used THEN greatest(pow(speed_kmh / 3.6, 2) - pow(start_kmh / 3.6, 2), 0) END AS pke_n, mean * 3.6 AS mean_kmh FROM audit)
"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.with_intervals(k.check_points(points(spark, sf_dir), RULES), RULES)


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.interval_audit(intervals(spark, sf_dir), RULES)


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


@query(f"WITH {CHECKED} SELECT trip_id, source_row, round(interval_s, 4) AS interval_s, round(distance_m, 4) AS distance_m, round(acceleration, 7) AS acceleration FROM moved")
def prev_row_kinematics(spark, sf_dir):
    rows = k.with_previous(points(spark, sf_dir), RULES)
    return rows.select("trip_id", "source_row", F.round("interval_s", 4).alias("interval_s"), F.round("distance_m", 4).alias("distance_m"), F.round("acceleration", 7).alias("acceleration"))


@query(f"""WITH {CHECKED}, known AS (SELECT DISTINCT c_custkey AS id, c_custkey % 17 <> 0 AS valid FROM customer),
more AS (SELECT f.trip_id, f.source_row, list_sort(f.flags || [x FOR x IN [CASE WHEN source_row % 101 = 0 THEN 'invalid_gps_accuracy' END, CASE WHEN source_row % 101 <> 0 AND source_row % 2 = 0 AND source_row % 23 > 10 THEN 'poor_gps_accuracy' END, CASE WHEN id IS NULL THEN 'unknown_trip_id' END, CASE WHEN NOT valid THEN 'invalid_trip_metadata' END,
  CASE WHEN id IS NOT NULL AND NOT t BETWEEN epoch(TIMESTAMP '2024-01-02') AND epoch(TIMESTAMP '2024-01-28') THEN 'outside_trip_time_range' END] IF x IS NOT NULL]) AS flags FROM flagged f LEFT JOIN known ON id = trip_id)
SELECT trip_id, source_row, array_to_string(flags, ';') AS flags, NOT list_has_any(flags, ['duplicate_timestamp', 'nonmonotonic_time', 'gps_jump', 'invalid_gps_accuracy', 'poor_gps_accuracy', 'unknown_trip_id', 'invalid_trip_metadata', 'outside_trip_time_range']) AS gps_valid,
  NOT list_has_any(flags, ['negative_speed', 'speed_outlier', 'invalid_speed', 'invalid_speed_unit', 'duplicate_timestamp', 'nonmonotonic_time', 'unknown_trip_id', 'invalid_trip_metadata', 'outside_trip_time_range']) AS speed_valid FROM more""")
def point_qc_flags(spark, sf_dir):
    """Every check of a point: order, place, speed, accuracy, and its trip."""
    row = F.col("source_row")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 17 != 0).alias("trip_valid")).distinct()
    accuracy = F.when(row % 101 == 0, -1.0).when(row % 2 == 0, (row % 23 * 10).cast("double"))
    at = lambda day: F.when(F.col("id").isNotNull(), F.lit(day).cast("double"))
    rows = points(spark, sf_dir).join(known, F.col("trip_id") == F.col("id"), "left").withColumns({"accuracy_m": accuracy, "trip_start": at(1704153600), "trip_end": at(1706400000)}).drop("id")
    return k.check_points(rows, RULES).select("trip_id", "source_row", F.array_join("flags", ";").alias("flags"), "gps_valid", "speed_valid")


@query(f"WITH {CHECKED} SELECT gps_valid, speed_valid, len(flags) = 0 AS valid, count(*) AS n FROM checked GROUP BY ALL")
def channel_validity(spark, sf_dir):
    return k.check_points(points(spark, sf_dir), RULES).groupBy("gps_valid", "speed_valid", "valid").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CHECKED} SELECT trip_id, source_row, repeated AS duplicate_timestamp, coalesce(interval_s <= 0, false) AS nonmonotonic_time FROM lagged")
def order_flags(spark, sf_dir):
    rows = k.with_previous(points(spark, sf_dir), RULES)
    return rows.select("trip_id", "source_row", F.col("repeated").alias("duplicate_timestamp"), F.coalesce(F.col("interval_s") <= 0, F.lit(False)).alias("nonmonotonic_time"))


@query(f"WITH {CHECKED} SELECT trip_id, count(*) AS n, count(*) FILTER (gps_interval_valid) AS n_gps, count(*) FILTER (speed_interval_valid) AS n_speed FROM intervals GROUP BY trip_id")
def interval_validity(spark, sf_dir):
    return intervals(spark, sf_dir).groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("gps_interval_valid").alias("n_gps"), F.count_if("speed_interval_valid").alias("n_speed"))


@query(f"""WITH {CHECKED} SELECT trip_id, source_row, "order", used, array_to_string(reasons, ';') AS reasons, round(used_s, 4) AS used_s, round(used_m, 3) AS used_m, round(rpa_n, 5) AS rpa_n, round(pke_n, 4) AS pke_n FROM amounts""")
def interval_audit(spark, sf_dir):
    rows = audit(spark, sf_dir)
    return rows.select("trip_id", "source_row", F.col("order").cast("long").alias("order"), "used", F.array_join("reasons", ";").alias("reasons"), F.round("used_s", 4).alias("used_s"), F.round("used_m", 3).alias("used_m"), F.round("rpa_n", 5).alias("rpa_n"), F.round("pke_n", 4).alias("pke_n"))


SUMS = """count(*) FILTER (used) AS n_used, count(*) FILTER (NOT used) AS n_excluded, round(sum(used_s), 3) AS duration_s, round(sum(used_m), 2) AS distance_m,
  round(CASE WHEN sum(used_m) > 1e-9 THEN sum(rpa_n) / sum(used_m) END, 9) AS rpa, round(CASE WHEN sum(used_m) > 1e-9 THEN sum(pke_n) / sum(used_m) END, 9) AS pke,
  round(sqrt(sum(CASE WHEN used THEN a * a * used_s END) / nullif(sum(used_s), 0)), 8) AS rms_acceleration"""


def measures(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n_used", "n_excluded", F.round("duration_s", 3).alias("duration_s"), F.round("distance_m", 2).alias("distance_m"), F.round("rpa", 9).alias("rpa"), F.round("pke", 9).alias("pke"), F.round("rms_acceleration", 8).alias("rms_acceleration"))


@query(f"WITH {CHECKED} SELECT trip_id, {SUMS} FROM amounts GROUP BY trip_id")
def kinematic_totals(spark, sf_dir):
    return measures(k.kinematic_sums(audit(spark, sf_dir), RULES, "trip_id"), "trip_id")


@query(f"WITH {CHECKED} SELECT sampling_zone, time_block, {SUMS} FROM amounts GROUP BY ALL")
def pooled_ratios(spark, sf_dir):
    return measures(k.kinematic_sums(audit(spark, sf_dir), RULES, "sampling_zone", "time_block"), "sampling_zone", "time_block")


SETS = [(), ("route_id",), ("sampling_zone",), ("time_block",), ("sampling_zone", "time_block"), ("sampling_zone", "time_block", "day_type"), ("route_id", "time_block", "day_type")]
SET_KEYS = ["route_id", "sampling_zone", "time_block", "day_type"]


@query(f"""WITH {CHECKED}, keyed AS (SELECT *, trip_id % 30 AS route_id, CASE WHEN source_row % 7 < 2 THEN 'weekend' ELSE 'weekday' END AS day_type FROM amounts)
SELECT route_id, sampling_zone, time_block, day_type, CAST(grouping_id(route_id, sampling_zone, time_block, day_type) AS BIGINT) AS grouping, count(DISTINCT trip_id) AS n_trips, round(sum(used_s), 3) AS duration_s, round(sum(used_m), 2) AS distance_m,
  round(CASE WHEN sum(used_m) > 1e-9 THEN sum(rpa_n) / sum(used_m) END, 9) AS rpa, round(CASE WHEN sum(used_m) > 1e-9 THEN sum(pke_n) / sum(used_m) END, 9) AS pke
FROM keyed GROUP BY GROUPING SETS ((), (route_id), (sampling_zone), (time_block), (sampling_zone, time_block), (sampling_zone, time_block, day_type), (route_id, time_block, day_type))""")
def operating_summary(spark, sf_dir):
    rows = audit(spark, sf_dir).withColumns({"route_id": F.col("trip_id") % 30, "day_type": F.when(F.col("source_row") % 7 < 2, "weekend").otherwise("weekday")})
    out = k.pooled_summary(rows, RULES, SETS, SET_KEYS)
    return out.select(*SET_KEYS, F.col("grouping").cast("long").alias("grouping"), "n_trips", F.round("duration_s", 3).alias("duration_s"), F.round("distance_m", 2).alias("distance_m"), F.round("rpa", 9).alias("rpa"), F.round("pke", 9).alias("pke"))


CELLS = f"""{CHECKED}, bounds AS (SELECT unnest(range(0, 36)) AS speed_bin),
cells AS (SELECT trip_id, speed_bin, least(31, CAST(floor((a + 8) / 0.5) AS INT)) AS acceleration_bin,
  CASE WHEN start_kmh <> speed_kmh THEN greatest(0, least(greatest(start_kmh, speed_kmh), 5.0 * speed_bin + 5) - greatest(least(start_kmh, speed_kmh), 5.0 * speed_bin)) / abs(speed_kmh - start_kmh) * used_s
       WHEN least(35, floor(start_kmh / 5)) = speed_bin THEN used_s ELSE 0 END AS seconds
  FROM amounts, bounds WHERE used AND a BETWEEN -8 AND 8)"""


@query(f"WITH {CELLS} SELECT speed_bin, acceleration_bin, round(sum(seconds), 3) AS seconds FROM cells WHERE seconds > 0 GROUP BY ALL")
def safd_histogram(spark, sf_dir):
    return k.speed_acceleration_cells(audit(spark, sf_dir), RULES).select("speed_bin", "acceleration_bin", F.round("seconds", 3).alias("seconds"))


@query(f"WITH {CELLS} SELECT trip_id, speed_bin, acceleration_bin, round(sum(seconds), 3) AS seconds FROM cells WHERE seconds > 0 GROUP BY ALL")
def safd_bin_range_join(spark, sf_dir):
    return k.speed_acceleration_cells(audit(spark, sf_dir), RULES, "trip_id").select("trip_id", "speed_bin", "acceleration_bin", F.round("seconds", 3).alias("seconds"))


@query(f"WITH {CHECKED} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM checked) GROUP BY flag")
def flag_counts(spark, sf_dir):
    return k.check_points(points(spark, sf_dir), RULES).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CHECKED}, stated AS (SELECT *, CASE WHEN mean_kmh <= 1 THEN 'idle' WHEN a > 0.1 THEN 'accelerating' WHEN a < -0.1 THEN 'braking' ELSE 'cruise' END AS state FROM amounts WHERE used),
s AS (SELECT trip_id, sum(used_s) FILTER (state = 'idle') AS idle_s, sum(used_s) FILTER (state = 'cruise') AS cruise_s, sum(used_s) AS valid_s FROM stated GROUP BY trip_id)
SELECT i.trip_id, count(*) AS n_points, count(*) FILTER (gps_valid) AS n_gps_valid, count(*) FILTER (speed_valid) AS n_speed_valid, round(max(speed_kmh), 6) AS max_kmh,
  round(CASE WHEN any_value(valid_s) IS NOT NULL THEN coalesce(any_value(idle_s), 0) END, 3) AS idle_s, round(CASE WHEN any_value(valid_s) IS NOT NULL THEN coalesce(any_value(cruise_s), 0) END, 3) AS cruise_s,
  round(any_value(valid_s), 3) AS valid_s FROM intervals i LEFT JOIN s USING (trip_id) GROUP BY i.trip_id""")
def trip_operating_metrics(spark, sf_dir):
    rows = intervals(spark, sf_dir)
    out = k.trip_metrics(rows, k.interval_audit(rows, RULES), RULES)
    return out.select("trip_id", "n_points", "n_gps_valid", "n_speed_valid", F.round("max_kmh", 6).alias("max_kmh"), *(F.round(c, 3).alias(c) for c in ("idle_s", "cruise_s", "valid_s")))


@query("""WITH p AS (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, round(sum(CASE WHEN value >= before THEN value - before END), 4) AS progress FROM p GROUP BY user_id""")
def matched_progress_delta(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").withColumn("before", before)
    return rows.groupBy("user_id").agg(F.round(F.sum(F.when(F.col("value") >= F.col("before"), F.col("value") - F.col("before"))), 4).alias("progress"))


@query(f"WITH {POINTS} SELECT trip_id, source_row, round(CASE speed_unit WHEN 'km/h' THEN speed WHEN 'm/s' THEN speed * 3.6 END, 6) AS speed_kmh FROM points")
def speed_units(spark, sf_dir):
    return points(spark, sf_dir).select("trip_id", "source_row", F.round(scalar.speed_kmh(F.col("speed"), F.col("speed_unit")), 6).alias("speed_kmh"))


@query(f"WITH {POINTS} SELECT trip_id, source_row, CASE WHEN speed BETWEEN 0 AND 180 THEN least(35, CAST(floor(speed / 5) AS INT)) END AS bin FROM points")
def bin_index(spark, sf_dir):
    return points(spark, sf_dir).select("trip_id", "source_row", scalar.bin_index(F.col("speed"), RULES.speed_edges).alias("bin"))


@query(f"""WITH {POINTS} SELECT trip_id, source_row, round(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(lat - 21) / 2), 2) + cos(radians(21)) * cos(radians(lat)) * pow(sin(radians(lon - 105.8) / 2), 2)))), 4) AS metres FROM points""")
def haversine(spark, sf_dir):
    return points(spark, sf_dir).select("trip_id", "source_row", F.round(scalar.haversine(F.lit(21.0), F.lit(105.8), F.col("lat"), F.col("lon")), 4).alias("metres"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'inf' WHEN 2 THEN 'x' || value ELSE CAST(floor(value) AS BIGINT)::VARCHAR END AS text FROM events)
SELECT event_id, CASE WHEN event_id % 5 > 2 THEN CAST(text AS DOUBLE) END AS number FROM x""")
def finite_number(spark, sf_dir):
    e = F.col("event_id") % 5
    text = F.when(e == 0, "NaN").when(e == 1, "Infinity").when(e == 2, F.concat(F.lit("x"), F.col("value").cast("string"))).otherwise(F.floor("value").cast("long").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", scalar.finite_number(text).alias("number"))


@query("""SELECT event_id, CASE WHEN event_id % 3 < 2 THEN epoch_us(date_trunc('second', ts) - CASE event_id % 3 WHEN 1 THEN INTERVAL 7 HOUR ELSE INTERVAL 0 HOUR END) // 1000000 END AS seconds FROM events""")
def parse_time_strict(spark, sf_dir):
    stamp, kind = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_id") % 3
    text = F.when(kind == 0, F.concat(stamp, F.lit("Z"))).when(kind == 1, F.concat(stamp, F.lit("+07:00"))).otherwise(stamp)
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(scalar.parse_time_strict(text)).alias("seconds"))


@query("""SELECT event_id, CAST(ts + INTERVAL 7 HOUR AS DATE) AS local_date, CASE WHEN isodow(ts + INTERVAL 7 HOUR) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, strftime(ts + INTERVAL 7 HOUR, '%H:%M:%S') AS local_time FROM events""")
def local_calendar(spark, sf_dir):
    local = F.expr("timestampadd(HOUR, 7, ts)")  # the zone has no daylight saving time
    return table(spark, sf_dir, "events").select("event_id", local.cast("date").alias("local_date"), F.when(F.weekday(local) >= 5, "weekend").otherwise("weekday").alias("day_type"), F.date_format(local, "HH:mm:ss").alias("local_time"))
