"""Survey coverage and field evidence: schedules, overlaps, dense grids, gates, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def schedule(routes: DataFrame, blocks: list[str], days: list[str], repeats: int) -> DataFrame:
    """One planned slot per route, block, day type and repeat, with a stable id. The parameter lists are exploded, not joined."""
    lists = routes.select("route_id", F.explode(F.array(*map(F.lit, blocks))).alias("time_block")).select("*", F.explode(F.array(*map(F.lit, days))).alias("day_type")).select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    text = F.concat_ws("|", F.col("route_id").cast("string"), "time_block", "day_type", F.col("repeat").cast("string"))
    return lists.withColumn("plan_id", F.concat(F.lit("P-"), F.left(F.sha2(text, 256), F.lit(16))))


def resource_conflicts(trips: DataFrame, resource: str) -> DataFrame:
    """Trips that overlap another of the same resource in time; touching ends don't. One window pass, no pairs."""
    order = Window.partitionBy(resource).orderBy("started", "ended", "trip_id")
    back = order.rowsBetween(Window.unboundedPreceding, -1)
    hit = F.coalesce(F.max("ended").over(back) > F.col("started"), F.lit(False)) | F.coalesce(F.lead("started").over(order) < F.col("ended"), F.lit(False))
    return trips.filter(F.col(resource).isNotNull() & (F.col("started") < F.col("ended"))).withColumn("conflict", hit)


def coverage_cells(grid: DataFrame, counted: DataFrame, keys: list[str], target: Column) -> DataFrame:
    """Counts for every cell of the grid, empty ones too, and the status against a target (null: undecided)."""
    sums = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trips"), F.count_distinct("started").alias("n_dates"))
    rows = grid.join(sums, keys, "left").fillna(0, ["n_trips", "n_dates"]).withColumn("target", target)
    status = F.when(F.col("n_trips") == 0, "not_observed").when(F.col("target").isNull(), "observed_target_unset").when(F.col("n_trips") >= F.col("target"), "target_met").otherwise("below_target")
    return rows.withColumn("status", status)


def gate_states(observations: DataFrame, least_dates: int) -> DataFrame:
    """Per route and field: failed if the newest day has a failure, passed with enough passing days after the last failure, else unknown."""
    w = Window.partitionBy("route_id", "field")
    rows = observations.withColumns({"last_fail": F.max(F.when(~F.col("passed"), F.col("day"))).over(w), "newest": F.max("day").over(w)})
    later = F.col("passed") & (F.col("last_fail").isNull() | (F.col("day") > F.col("last_fail")))
    sums = rows.groupBy("route_id", "field").agg(F.any_value("last_fail").alias("last_fail"), F.any_value("newest").alias("newest"), F.count_distinct(F.when(later, F.col("day"))).alias("passing_days"))
    return sums.withColumn("state", F.when(F.col("last_fail") == F.col("newest"), "failed").when(F.col("passing_days") >= least_dates, "passed").otherwise("unknown"))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def import_rows(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Each new row as new, same (known with equal fields) or conflict (known with different fields)."""
    fields = [c for c in new.columns if c != key]
    digest = lambda: F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    old = known.select(F.col(key).alias("_key"), digest().alias("_old"))
    rows = new.withColumn("_new", digest()).join(old, F.col(key) == F.col("_key"), "left")
    return rows.withColumn("outcome", F.when(F.col("_key").isNull(), "new").when(F.col("_old") == F.col("_new"), "same").otherwise("conflict")).drop("_key", "_old", "_new")
