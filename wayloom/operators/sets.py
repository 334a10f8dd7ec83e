"""Sets of routes: quota sampling, their statistics, quotas, greedy selection of many problems at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .composition import CELL, gap, unique_parts
from .lineage import stored

PRIME = 2147483647


def mix(*keys: Column) -> Column:
    """A number from keys by integer arithmetic that any engine repeats."""
    out = F.lit(17).cast("long")
    for k in keys:
        out = ((out * 48271 + F.pmod(k.cast("long"), F.lit(PRIME)) + 1) * 69621) % PRIME
    for _ in range(3):  # squares, or the order of near keys would be that of the keys
        out = F.transform(F.array(out), lambda x: (x * x + 7 * x + 12345) % PRIME)[0]
    return out


def sampled_sets(candidates: DataFrame, n_sets: int, quota: DataFrame, seed: int, attempt: int = 0) -> DataFrame:
    """n_sets independent draws without replacement: in each, quota.slots routes of every bucket, all equally likely.

    candidates (route_id, bucket) are joined with the set numbers only here: n_sets is the size asked for.
    """
    sets = candidates.sparkSession.range(n_sets).withColumnRenamed("id", "sample_id")
    draws = candidates.join(quota, "bucket").crossJoin(sets).withColumn("h", mix(F.lit(seed), F.col("sample_id"), F.lit(attempt), F.col("route_id")))
    rank = F.row_number().over(Window.partitionBy("sample_id", "bucket").orderBy("h", "route_id"))
    return draws.withColumn("r", rank).filter("r <= slots").select("sample_id", "bucket", "route_id")


def overlap_within(members: DataFrame, parts: DataFrame, *by: str) -> DataFrame:
    """(by, left, right, fraction) of the pairs of routes inside each set that share parts: common length over the shorter one's.

    members: by, route_id; parts: route_id, part_id, length_m, a part once a route. Only members are expanded to parts, and
    only inside their set, so pairs of routes that are in no set together are never made.
    """
    own = members.select(*by, "route_id").join(parts, "route_id")
    length = parts.groupBy("route_id").agg(F.sum("length_m").alias("m"))
    a, b = own.withColumnRenamed("route_id", "left"), own.select(*by, F.col("route_id").alias("right"), "part_id")
    common = a.join(b, [*by, "part_id"]).filter(F.col("left") < F.col("right")).groupBy(*by, "left", "right").agg(F.sum("length_m").alias("common_m"))
    named = lambda side: length.select(F.col("route_id").alias(side), F.col("m").alias(f"{side}_m"))
    return common.join(named("left"), "left").join(named("right"), "right").select(*by, "left", "right", F.try_divide("common_m", F.least("left_m", "right_m")).alias("fraction"))


def accepted_sets(candidates: DataFrame, n_sets: int, quota: DataFrame, seed: int, required: list[str], parts: DataFrame, most_overlap: float, most_attempts: int) -> tuple[DataFrame, DataFrame]:
    """n_sets random sets that keep all rules: (sets: sample_id, attempt, bucket, route_id; attempts: sample_id, attempt, reason).

    Each draw is as in sampled_sets, keyed by set and attempt. A set that fails a rule is rejected whole, never repaired, and
    only rejected sets are drawn again, until all are accepted or most_attempts are used up. Reasons, in this order: too
    few candidates for the quota, a required stratum missing, two routes that overlap too much; accepted: null.
    candidates: route_id, bucket, stratum.
    """
    spark = candidates.sparkSession
    candidates, parts, quota = stored(candidates), stored(parts), stored(quota)
    open_ = spark.range(n_sets).withColumnRenamed("id", "sample_id")
    whole = quota.agg(F.sum("slots")).scalar()
    kept, log = [], []
    for attempt in range(most_attempts):
        draws = candidates.join(quota, "bucket").join(F.broadcast(open_)).withColumn("h", mix(F.lit(seed), F.col("sample_id"), F.lit(attempt), F.col("route_id")))
        rank = F.row_number().over(Window.partitionBy("sample_id", "bucket").orderBy("h", "route_id"))
        drawn = stored(draws.withColumn("r", rank).filter("r <= slots").select("sample_id", "bucket", "route_id", "stratum"))
        close = overlap_within(drawn, parts, "sample_id").groupBy("sample_id").agg(F.max("fraction").alias("top"))
        facts = drawn.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("stratum").alias("strata")).join(close, "sample_id", "left").withColumn("whole", whole)
        lacking = F.size(F.array_except(F.array(*map(F.lit, required)), "strata")) > 0 if required else F.lit(False)
        reason = F.when(F.col("n") < F.col("whole"), "insufficient").when(lacking, "required_strata").when(F.coalesce("top", F.lit(0.0)) >= most_overlap, "overlap")
        judged = stored(open_.join(facts, "sample_id", "left").select("sample_id", F.lit(attempt).alias("attempt"), F.when(F.col("n").isNull(), "insufficient").otherwise(reason).alias("reason")))
        log.append(judged)
        kept.append(drawn.join(judged.filter("reason is null").select("sample_id", "attempt"), "sample_id").select("sample_id", "attempt", "bucket", "route_id"))
        open_ = judged.filter("reason is not null").select("sample_id")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, kept), reduce(DataFrame.unionByName, log)


def scored(members: DataFrame, vectors: DataFrame, network: DataFrame) -> DataFrame:
    """Per set: D of the summed vectors of its routes (value), mean of D over the zones it reaches (top), length_m.

    members: sample_id, route_id. Routes that count several times in a walk count so here; D isn't a mean of the
    routes' own gaps.
    """
    summed = members.join(vectors, "route_id").groupBy("sample_id", *CELL).agg(F.sum("length_m").alias("length_m"))
    zones = gap(summed, network, "sample_id", within="zone").groupBy("sample_id").agg(F.avg("d").alias("top"))
    length = summed.groupBy("sample_id").agg(F.sum("length_m").alias("length_m"))
    return gap(summed, network, "sample_id").withColumnRenamed("d", "value").join(zones, "sample_id").join(length, "sample_id")


def changed_gap(changes: DataFrame, summed: DataFrame, network: DataFrame, *keys: str) -> DataFrame:
    """D of sets after changes of their cells: keys (sample_id among them), cell and change; d is null where nothing is left.

    Cells without a change enter through the set's totals, so only changed cells are listed.
    """
    totals = network.select(*CELL, "q").crossJoin(F.broadcast(summed.select("sample_id").distinct())).join(summed.withColumnRenamed("length_m", "m"), ["sample_id", *CELL], "left").fillna(0.0, ["m"])
    whole = totals.groupBy("sample_id").agg(F.sum("m").alias("all_m"))
    moved = changes.groupBy(*keys).agg(F.sum("change").alias("moved_m")).join(whole, "sample_id").withColumn("w", F.col("all_m") + F.col("moved_m"))
    grid = moved.join(totals, "sample_id").join(changes, [*keys, *CELL], "left")
    return grid.groupBy(*keys).agg((0.5 * F.sum(F.abs(F.col("q") - F.try_divide(F.col("m") + F.coalesce("change", F.lit(0.0)), F.col("w"))))).alias("d")).filter("d is not null")


def without_each(members: DataFrame, vectors: DataFrame, network: DataFrame) -> DataFrame:
    """sample_id, route_id and D of the set without that route."""
    own = members.join(vectors, "route_id")
    summed = own.groupBy("sample_id", *CELL).agg(F.sum("length_m").alias("length_m"))
    return changed_gap(own.select("sample_id", "route_id", *CELL, (-F.col("length_m")).alias("change")), summed, network, "sample_id", "route_id")


def swapped(members: DataFrame, pool: DataFrame, vectors: DataFrame, network: DataFrame) -> DataFrame:
    """route_id (of the pool, not a member), out_id (a member of its bucket) and D of the set after their swap."""
    summed = members.withColumnRenamed("out_id", "route_id").join(vectors, "route_id").groupBy(F.lit(0).alias("sample_id"), *CELL).agg(F.sum("length_m").alias("length_m"))
    pairs = pool.join(members.select(F.col("out_id").alias("route_id")), "route_id", "left_anti").join(members, "bucket").select("route_id", "out_id")
    into = pairs.join(vectors, "route_id").select("route_id", "out_id", *CELL, "length_m")
    out = pairs.join(vectors.withColumnRenamed("route_id", "out_id"), "out_id").select("route_id", "out_id", *CELL, (-F.col("length_m")).alias("length_m"))
    changes = into.unionByName(out).groupBy("route_id", "out_id", *CELL).agg(F.sum("length_m").alias("change")).withColumn("sample_id", F.lit(0))
    return changed_gap(changes, summed, network, "sample_id", "route_id", "out_id").drop("sample_id")


def summary(members: DataFrame, vectors: DataFrame, network: DataFrame, walks: DataFrame, parts: DataFrame, bins: DataFrame, material: float) -> DataFrame:
    """One row of figures for each set (sample_id, bucket, route_id).

    bins: quartile group of each route and feature. A cell is
    material if one member has that share of its whole length in it.
    """
    full = walks.join(parts.select("part_id"), "part_id").groupBy("route_id").agg(F.sum("length_m").alias("full_m"))
    n = lambda b: F.count_if(F.col("bucket") == b)
    counts = members.join(full, "route_id", "left").groupBy("sample_id").agg(F.count(F.lit(1)).alias("route_count"), n("A").alias("bucket_a"), n("B").alias("bucket_b"), n("C").alias("bucket_c"), F.sum("full_m").alias("traversed_m"))
    own = members.join(vectors.join(full, "route_id"), "route_id")
    cell = F.struct(*CELL)
    cells = own.groupBy("sample_id").agg(F.count_distinct("zone").alias("represented_strata"), F.count_distinct(F.when(F.col("length_m") / F.col("full_m") >= material, cell)).alias("material_cells"), F.count_distinct(cell).alias("touched_cells"))
    road = parts.filter("not connector")
    covered = members.join(unique_parts(walks), "route_id").select("sample_id", "part_id").distinct().join(road.select("part_id", "length_m"), "part_id")
    unique = covered.groupBy("sample_id").agg(F.sum("length_m").alias("unique_rc_m")).withColumn("unique_rc_fraction", F.col("unique_rc_m") / network.agg(F.sum("network_m")).scalar())
    groups = members.join(bins, "route_id").groupBy("sample_id").agg(F.count_distinct("feature", "bin").alias("quantile_groups"))
    own_parts = unique_parts(walks).join(parts.select("part_id", "length_m"), "part_id")
    overlap = overlap_within(members, own_parts, "sample_id").groupBy("sample_id").agg(F.max("fraction").alias("max_corridor_overlap"))
    scores = scored(members, vectors, network).select("sample_id", F.col("value").alias("d_combined"), F.col("top").alias("d_domain_mean"), F.col("length_m").alias("rc_traversed_m"))
    out = scores.join(counts, "sample_id").join(cells, "sample_id").join(unique, "sample_id").join(groups, "sample_id").join(overlap, "sample_id", "left")
    return out.fillna(0.0, ["max_corridor_overlap"])


def distribution(long: DataFrame, *by: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and linear quantiles of value."""
    q = F.expr("percentile(value, array(0.025, 0.25, 0.5, 0.75, 0.975))")
    rows = long.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"), q.alias("q"))
    return rows.select(*by, "n", "mean", "sd", "min", *(F.col("q")[i].alias(name) for i, name in enumerate(("q025", "q25", "median", "q75", "q975"))), "max")


def against_baseline(long: DataFrame, baseline: Column, tolerance: float, *by: str) -> DataFrame:
    """How many values lie below, tie with, and don't lie above a baseline."""
    v = F.col("value")
    return long.groupBy(*by).agg(F.count_if(v < baseline - tolerance).alias("below"), F.count_if(F.abs(v - baseline) <= tolerance).alias("tied"), F.count_if(v <= baseline + tolerance).alias("not_above"), F.count(F.lit(1)).alias("n"))


def fixed_histogram(values: DataFrame, n_bins: int) -> DataFrame:
    """Equal bins on [0, 1]; the last is closed, empty bins stay."""
    at = F.least(F.lit(n_bins - 1), F.floor(F.round(F.col("value") * n_bins, 9)).cast("int"))
    found = values.filter("value between 0 and 1").groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = values.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    rows = grid.join(found, "bin", "left").fillna(0, ["n"])
    return rows.withColumn("percent", F.try_divide(100 * F.col("n"), F.sum("n").over(Window.partitionBy())))


def linear_fit(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Slope, intercept and R2; null where x is constant."""
    spread = F.max(x) - F.min(x) > 1e-12
    fit = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), spread.alias("varies"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    return fit.select(*by, "n", *(F.when(F.col("varies"), F.col(c)).alias(c) for c in ("slope", "intercept", "r2")))


def largest_remainder(classes: DataFrame, slots: int, *by: str) -> DataFrame:
    """Whole slots in proportion to length_m under cap: full classes are fixed first, then largest remainders.

    Ties go to the class first in order. Classes without length or cap get none. by: independent problems. There
    are as many rounds as the largest problem has classes, since each may fill up only after another has.
    """
    rounds = classes.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    w = Window.partitionBy(*by)
    rows = classes.withColumns({"slots": F.lit(0).cast("long"), "open": (F.col("cap") > 0) & (F.col("length_m") > 0)})
    for _ in range(rounds):
        free = F.lit(slots) - F.sum(F.when(F.col("open"), 0).otherwise(F.col("slots"))).over(w)
        ideal = free * F.col("length_m") / F.sum(F.when(F.col("open"), F.col("length_m"))).over(w)
        rows = rows.withColumn("ideal", ideal)
        full = F.col("open") & (F.col("ideal") >= F.col("cap"))
        rows = rows.withColumns({"slots": F.when(full, F.col("cap")).otherwise(F.col("slots")), "open": F.col("open") & ~full})
    fraction = F.round(F.col("ideal") - F.floor("ideal"), 12)
    rows = rows.withColumn("slots", F.when(F.col("open"), F.floor("ideal")).otherwise(F.col("slots")))
    rest = F.lit(slots) - F.sum("slots").over(w)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("open"), F.desc("fraction"), "rc"))
    rows = rows.withColumn("fraction", fraction).withColumn("extra", (F.col("open") & (rank <= rest)).cast("long"))
    return rows.select(*by, "rc", (F.col("slots") + F.col("extra")).cast("long").alias("slots"))


def ranked_fill(candidates: DataFrame, slots: DataFrame, cell: list[str]) -> DataFrame:
    """The first routes of each cell by purity (high), length (low) and id, as many as the cell has slots."""
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("purity"), "length_m", "route_id"))
    return candidates.join(slots, cell).withColumn("r", rank).filter("r <= slots").drop("r", "slots")


def best_within(rows: DataFrame, objective: str, tie: str, tolerance: float, *by: str) -> DataFrame:
    """The row of least objective; those within the tolerance of it tie, and the least tie column wins."""
    least = F.min(objective).over(Window.partitionBy(*by))
    near = rows.withColumn("least", least).filter(F.col(objective) <= F.col("least") + tolerance)
    return near.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), F.col(tie)).alias("b")).select("b.*")


def greedy_gap(vectors: DataFrame, network: DataFrame, problems: DataFrame, size: int, checkpoint) -> DataFrame:
    """For every problem at once, `size` rounds that each add the candidate with the least new composition gap.

    vectors: route_id, zone, rc, length_m; problems: problem_id, route_id (its candidates). One row per round and
    problem: round, route_id, d. Totals of the chosen routes are kept per problem and cell, so a round joins
    candidates with totals, never with the members. checkpoint cuts the lineage of a round's state.
    """
    cells = vectors.join(network.select("zone", "rc", "q"), ["zone", "rc"])
    totals = problems.select("problem_id").distinct().crossJoin(network.select("zone", "rc", "q")).withColumn("total", F.lit(0.0))
    chosen, history = None, None
    left = problems
    for turn in range(1, size + 1):
        sums = totals.groupBy("problem_id").agg(F.sum("total").alias("all"))
        own = cells.groupBy("route_id").agg(F.sum("length_m").alias("own"))
        # |q - (total + v) / (all + own)| over all cells: cells that the candidate lacks enter through the totals
        open_ = left.join(own, "route_id").join(sums, "problem_id").withColumn("whole", F.col("all") + F.col("own"))
        grid = open_.join(totals, "problem_id").join(vectors, ["route_id", "zone", "rc"], "left")
        d = grid.groupBy("problem_id", "route_id").agg((0.5 * F.sum(F.abs(F.col("q") - (F.col("total") + F.coalesce("length_m", F.lit(0.0))) / F.col("whole")))).alias("d"))
        best = checkpoint(d.groupBy("problem_id").agg(F.min_by(F.struct("route_id", "d"), F.struct(F.round("d", 10), "route_id")).alias("b")).select("problem_id", "b.route_id", "b.d"))
        step = best.withColumn("round", F.lit(turn))
        history = step if history is None else history.unionByName(step)
        added = best.select("problem_id", "route_id").join(vectors, "route_id").select("problem_id", "zone", "rc", "length_m")
        totals = checkpoint(totals.join(added, ["problem_id", "zone", "rc"], "left").select("problem_id", "zone", "rc", "q", (F.col("total") + F.coalesce("length_m", F.lit(0.0))).alias("total")))
        chosen = history.select("problem_id", "route_id")
        left = problems.join(chosen, ["problem_id", "route_id"], "left_anti")
    return history


def greedy_coverage(members: DataFrame, size: int, checkpoint) -> DataFrame:
    """Rounds that each add the route with the most new unique length; members: route_id, part_id, length_m (distinct)."""
    history, left = None, members
    for turn in range(1, size + 1):
        gain = left.groupBy("route_id").agg(F.sum("length_m").alias("gain_m"))
        best = checkpoint(gain.orderBy(F.desc(F.round("gain_m", 6)), "route_id").limit(1).withColumn("round", F.lit(turn)))
        history = best if history is None else history.unionByName(best)
        covered = members.join(best.select("route_id"), "route_id", "left_semi").select("part_id")
        left = checkpoint(left.join(covered, "part_id", "left_anti"))
    return history
