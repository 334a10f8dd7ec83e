"""Points of trips: checks, intervals, kinematic measures, pooling."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions.scalar import haversine, parse_time_strict, speed_kmh


@dataclass(frozen=True)
class TripRules:
    max_gap_s: float = 5.0
    max_speed_kmh: float = 180.0
    max_jump_kmh: float = 180.0
    max_acceleration: float = 8.0
    max_accuracy_m: float = 100.0
    positive_threshold: float = 0.0
    state_threshold: float = 0.1
    idle_kmh: float = 1.0
    distance_epsilon: float = 1e-9
    speed_edges: list[float] = field(default_factory=lambda: [float(x) for x in range(0, 185, 5)])
    acceleration_edges: list[float] = field(default_factory=lambda: [x / 2 for x in range(-16, 17)])


HARD_GPS = ("invalid_coordinate", "poor_gps_accuracy", "invalid_gps_accuracy", "invalid_timestamp", "duplicate_timestamp", "nonmonotonic_time", "gps_jump", "outside_trip_time_range", "unknown_trip_id", "invalid_trip_metadata", "extra_csv_fields", "short_csv_row")
HARD_SPEED = ("negative_speed", "speed_outlier", "invalid_speed", "invalid_speed_unit", "invalid_timestamp", "duplicate_timestamp", "nonmonotonic_time", "outside_trip_time_range", "unknown_trip_id", "invalid_trip_metadata", "extra_csv_fields", "short_csv_row")


def flag_array(rules: dict[str, Column]) -> Column:
    """Sorted names of the rules that hold."""
    return F.array_compact(F.array(*(F.when(rules[name], F.lit(name)) for name in sorted(rules))))


def with_previous(points: DataFrame, rules: TripRules) -> DataFrame:
    """Adds interval_s, distance and acceleration against the row before in file order, whatever its time."""
    order = Window.partitionBy("trip_id").orderBy("source_row")
    same = Window.partitionBy("trip_id", "t").orderBy("source_row")
    kmh = speed_kmh(F.col("speed"), F.col("speed_unit"))
    rows = points.withColumn("speed_kmh", kmh)
    before = F.lag(F.struct("t", "lat", "lon", "speed_kmh")).over(order)
    rows = rows.withColumns({"before": before, "repeated": (F.row_number().over(same) > 1) & F.col("t").isNotNull()})
    dt = F.col("t") - F.col("before.t")
    rows = rows.withColumn("interval_s", dt)
    forward = F.col("interval_s") > 0
    return rows.withColumns(
        {
            "distance_m": F.when(forward, haversine(F.col("before.lat"), F.col("before.lon"), F.col("lat"), F.col("lon"))),
            "acceleration": F.when(forward, (F.col("speed_kmh") - F.col("before.speed_kmh")) / 3.6 / F.col("interval_s")),
        }
    ).drop("before")


def check_points(points: DataFrame, rules: TripRules) -> DataFrame:
    """Adds flags (sorted names), valid, gps_valid, speed_valid. No row is dropped; order is never changed.

    Optional columns: accuracy_m of the position; trip_valid (null for an unknown trip), trip_start and trip_end in
    seconds like t.
    """
    rows = with_previous(points, rules)
    here = {
        "invalid_timestamp": F.col("t").isNull(),
        "duplicate_timestamp": F.col("repeated"),
        "invalid_coordinate": ~F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False)),
        "invalid_speed": F.col("speed").isNull() | F.isnan("speed"),
        "invalid_speed_unit": F.col("speed_kmh").isNull() & F.col("speed").isNotNull(),
        "negative_speed": F.col("speed") < 0,
        "speed_outlier": F.col("speed_kmh") > rules.max_speed_kmh,
        "nonmonotonic_time": F.col("interval_s") <= 0,
        "sampling_gap": F.col("interval_s") > rules.max_gap_s,
        "gps_jump": F.col("distance_m") / F.col("interval_s") * 3.6 > rules.max_jump_kmh,
        "acceleration_outlier": F.abs("acceleration") > rules.max_acceleration,
    }
    if "accuracy_m" in points.columns:
        known = F.col("accuracy_m").isNotNull()
        here["invalid_gps_accuracy"] = known & (F.isnan("accuracy_m") | (F.col("accuracy_m") < 0))
        here["poor_gps_accuracy"] = known & ~F.isnan("accuracy_m") & (F.col("accuracy_m") > rules.max_accuracy_m)
    if "trip_valid" in points.columns:
        here["unknown_trip_id"] = F.col("trip_valid").isNull()
        here["invalid_trip_metadata"] = ~F.col("trip_valid")
        here["outside_trip_time_range"] = ~F.col("t").between(F.col("trip_start"), F.col("trip_end"))
    hard = lambda names: ~F.arrays_overlap("flags", F.array(*map(F.lit, names)))
    return rows.withColumn("flags", flag_array(here)).drop("repeated").withColumns({"valid": F.size("flags") == 0, "gps_valid": hard(HARD_GPS), "speed_valid": hard(HARD_SPEED)})


#: States of a low-emission zone that a trip may name.
LEZ_STATES = ("unknown", "inside", "outside")
TRIP_FIELDS = ("trip_id", "route_id", "vehicle_id", "started_at", "ended_at", "measurement_date", "sampling_zone")
VERSIONS = ("policy_version", "route_version", "source_bundle_sha256")


def check_trips(trips: DataFrame, routes: DataFrame, zone: str, required: tuple[str, ...] = TRIP_FIELDS) -> DataFrame:
    """Adds flags (sorted names) and valid to trips, whose fields are text; every row stays.

    routes: route_id, sampling_zone and the versions that a trip of the route must name. zone: time zone of the
    measurement date. Times must state their offset.
    """
    names = ["sampling_zone", *VERSIONS]
    wanted = routes.select(F.col("route_id").alias("known_route"), *(F.col(c).alias(f"wanted_{c}") for c in names))
    rows = trips.withColumn("n_rows", F.count(F.lit(1)).over(Window.partitionBy("trip_id"))).join(wanted, F.col("route_id") == F.col("known_route"), "left")
    start, end, known = parse_time_strict(F.col("started_at")), parse_time_strict(F.col("ended_at")), F.col("known_route").isNotNull()
    date = F.when(F.col("measurement_date").rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.col("measurement_date").try_cast("date"))
    local = F.from_utc_timestamp(F.to_utc_timestamp(start, F.current_timezone()), F.lit(zone))
    rules = {f"missing:{c}": F.coalesce(F.col(c), F.lit("")) == "" for c in required}
    rules |= {"duplicate_trip_id": F.col("n_rows") > 1, "unknown_route_id": ~known, "invalid_started_at": start.isNull(), "invalid_ended_at": end.isNull(), "invalid_trip_time_range": end <= start}
    rules |= {"invalid_measurement_date": date.isNull(), "measurement_date_mismatch": local.cast("date") != date}
    rules |= {f"{c}_mismatch": known & ~F.col(c).eqNullSafe(F.col(f"wanted_{c}")) for c in names}
    rules["invalid_lez_status"] = ~F.coalesce(F.col("lez_status").isin(*LEZ_STATES), F.lit(False))
    out = rows.withColumn("flags", flag_array(rules))
    return out.select(*trips.columns, "n_rows", "flags", (F.size("flags") == 0).alias("valid"))


def with_intervals(checked: DataFrame, rules: TripRules) -> DataFrame:
    """Adds whether the interval that ends at a row counts; the end of a gap can start a new interval."""
    order = Window.partitionBy("trip_id").orderBy("source_row")
    timely = F.coalesce((F.col("interval_s") > 0) & (F.col("interval_s") <= rules.max_gap_s), F.lit(False))
    calm = ~F.array_contains("flags", "acceleration_outlier")
    prior = lambda c: F.coalesce(F.lag(c).over(order), F.lit(False))
    return checked.withColumns(
        {
            "gps_interval_valid": timely & prior("gps_valid") & F.col("gps_valid"),
            "speed_interval_valid": timely & prior("speed_valid") & F.col("speed_valid") & calm,
            "start_kmh": F.lag("speed_kmh").over(order),
        }
    )


def interval_audit(intervals: DataFrame, rules: TripRules) -> DataFrame:
    """Every interval with its status, reasons and contributions; trips keep all their rows but the first."""
    v0, v1, dt = F.col("start_kmh") / 3.6, F.col("speed_kmh") / 3.6, F.col("interval_s")
    a = F.when(dt > 0, (v1 - v0) / dt)
    reasons = {
        "QC_speed_interval_invalid": ~F.col("speed_interval_valid"),
        "invalid_or_gap_interval": ~F.coalesce((dt > 0) & (dt <= rules.max_gap_s), F.lit(False)),
        "invalid_speed_endpoints": ~F.coalesce((F.least(v0, v1) >= 0) & (F.greatest("start_kmh", "speed_kmh") <= rules.max_speed_kmh) & v0.isNotNull() & v1.isNotNull(), F.lit(False)),
        "invalid_or_outlier_acceleration": ~F.coalesce(F.abs(a) <= rules.max_acceleration + 1e-12, F.lit(False)),
    }
    mean = (v0 + v1) / 2
    first = F.row_number().over(Window.partitionBy("trip_id").orderBy("source_row"))
    rows = intervals.withColumn("order", first - 1).filter("order > 0").withColumn("reasons", flag_array(reasons)).withColumn("used", F.size("reasons") == 0)
    used = lambda c: F.when(F.col("used"), c)
    return rows.withColumns(
        {
            "a": a, "used_s": used(dt), "used_m": used(mean * dt), "rpa_n": used(F.when(a > rules.positive_threshold, mean * a * dt).otherwise(0.0)),
            "pke_n": used(F.greatest(v1 * v1 - v0 * v0, F.lit(0.0))), "a_dt": used(a * dt), "a2_dt": used(a * a * dt), "mean_kmh": used(mean * 3.6),
        }
    )


def kinematic_sums(audit: DataFrame, rules: TripRules, *keys: str) -> DataFrame:
    """Numerators and denominators by key, and their ratios: always from sums, null where a denominator is empty."""
    a, dt = F.col("a"), F.col("used_s")
    some = lambda cond, c: F.sum(F.when(cond & F.col("used"), c))
    up, down = a > rules.state_threshold, a < -rules.state_threshold
    sums = audit.groupBy(*keys).agg(
        F.count_if("used").alias("n_used"), F.count_if(~F.col("used")).alias("n_excluded"), F.sum(dt).alias("duration_s"), F.sum("used_m").alias("distance_m"),
        F.sum("rpa_n").alias("rpa_n"), F.sum("pke_n").alias("pke_n"), some(up, dt).alias("up_s"), some(down, dt).alias("down_s"), some(up, F.col("a_dt")).alias("up_a"), some(down, F.col("a_dt")).alias("down_a"),
        F.sum("a2_dt").alias("a2"),
    )
    far = F.col("distance_m") > rules.distance_epsilon
    return sums.withColumns(
        {
            "rpa": F.when(far, F.col("rpa_n") / F.col("distance_m")), "pke": F.when(far, F.col("pke_n") / F.col("distance_m")),
            "mean_acceleration": F.try_divide("up_a", "up_s"), "mean_deceleration": F.try_divide("down_a", "down_s"), "rms_acceleration": F.sqrt(F.try_divide("a2", "duration_s")),
        }
    )


def pooled_summary(audit: DataFrame, rules: TripRules, sets: list[tuple[str, ...]], keys: list[str]) -> DataFrame:
    """One row per grouping set and group; grouping says which keys are left out (bit 1 from the right: the last key)."""
    audit.createOrReplaceTempView("wayloom_audit")
    clause = ", ".join(f"({', '.join(s)})" for s in sets)
    text = f"""SELECT {', '.join(keys)}, grouping_id({', '.join(keys)}) AS grouping, count(DISTINCT trip_id) AS n_trips, sum(used_s) AS duration_s, sum(used_m) AS distance_m, sum(rpa_n) AS rpa_n, sum(pke_n) AS pke_n
      FROM wayloom_audit GROUP BY GROUPING SETS ({clause})"""
    far = F.col("distance_m") > rules.distance_epsilon
    return audit.sparkSession.sql(text).withColumns({"rpa": F.when(far, F.col("rpa_n") / F.col("distance_m")), "pke": F.when(far, F.col("pke_n") / F.col("distance_m"))})


def speed_acceleration_cells(audit: DataFrame, rules: TripRules, *keys: str) -> DataFrame:
    """Seconds in each cell of speed and acceleration, split exactly where an interval crosses a speed edge; what lies outside has null bins."""
    edges, accelerations = rules.speed_edges, rules.acceleration_edges
    v0, v1 = F.col("start_kmh"), F.col("speed_kmh")
    low, high = F.least(v0, v1), F.greatest(v0, v1)
    step, last = edges[1] - edges[0], len(edges) - 2
    # an even grid: the bins that an interval meets follow from arithmetic, so no join with all bins is needed
    first_bin = F.greatest(F.lit(0), F.least(F.lit(last), F.floor((low - edges[0]) / step))).cast("int")
    last_bin = F.greatest(F.lit(0), F.least(F.lit(last), F.when(high > low, F.ceil((high - edges[0]) / step) - 1).otherwise(F.floor((high - edges[0]) / step)))).cast("int")
    a_step, a_last = accelerations[1] - accelerations[0], len(accelerations) - 2
    ai = F.when(F.col("a").between(accelerations[0], accelerations[-1]), F.least(F.lit(a_last), F.floor((F.col("a") - accelerations[0]) / a_step)).cast("int"))
    rows = audit.filter("used").select(*keys, v0.alias("v0"), v1.alias("v1"), low.alias("low"), high.alias("high"), "used_s", ai.alias("acceleration_bin"), F.explode(F.sequence(first_bin, F.greatest(first_bin, last_bin))).alias("speed_bin"))
    inside = F.greatest(F.lit(0.0), F.least(F.col("high"), edges[0] + step * (F.col("speed_bin") + 1)) - F.greatest(F.col("low"), edges[0] + step * F.col("speed_bin")))
    seconds = F.when(F.col("high") > F.col("low"), inside / (F.col("high") - F.col("low")) * F.col("used_s")).otherwise(F.when(F.col("low").between(edges[0], edges[-1]), F.col("used_s")).otherwise(0.0))
    return rows.withColumn("seconds", seconds).filter("acceleration_bin is not null and seconds > 0").groupBy(*keys, "speed_bin", "acceleration_bin").agg(F.sum("seconds").alias("seconds"))


def trip_metrics(intervals: DataFrame, audit: DataFrame, rules: TripRules) -> DataFrame:
    """Time in each state by an interval's mean speed; trips without a valid interval stay, with nulls."""
    state = F.when(F.col("mean_kmh") <= rules.idle_kmh, "idle").when(F.col("a") > rules.state_threshold, "accelerating").when(F.col("a") < -rules.state_threshold, "braking").otherwise("cruise")
    sums = audit.filter("used").withColumn("state", state).groupBy("trip_id").agg(*(F.sum(F.when(F.col("state") == s, F.col("used_s")).otherwise(0.0)).alias(f"{s}_s") for s in ("idle", "accelerating", "braking", "cruise")), F.sum("used_s").alias("valid_s"))
    counts = intervals.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n_points"), F.count_if("gps_valid").alias("n_gps_valid"), F.count_if("speed_valid").alias("n_speed_valid"), F.max("speed_kmh").alias("max_kmh"))
    return counts.join(sums, "trip_id", "left").withColumn("idle_fraction", F.try_divide("idle_s", "valid_s"))
