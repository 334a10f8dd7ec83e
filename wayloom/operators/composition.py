"""Composition of road length by cell (zone and road class), features of routes, overlap."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import commons
from .lineage import dealt, stored

#: Pairs of routes that a task sums in the mean.
PAIRS = 2_000_000

#: Routes whose lengths are sent with the code instead of joined: 16 bytes each.
ROUTES = 500_000

CELL = ["zone", "rc"]


def route_cells(walks: DataFrame, parts: DataFrame) -> DataFrame:
    """Traversed length of each route in each cell; every pass counts, connectors don't."""
    return walks.join(parts.filter("not connector").select("part_id", "zone", "rc"), "part_id").groupBy("route_id", *CELL).agg(F.sum("length_m").alias("length_m"))


def unique_parts(walks: DataFrame) -> DataFrame:
    return walks.select("route_id", "part_id").distinct()


def network_cells(parts: DataFrame) -> DataFrame:
    """Length and share of every cell of the network."""
    return parts.filter("not connector").groupBy(*CELL).agg(F.sum("length_m").alias("network_m")).withColumn("q", F.col("network_m") / F.sum("network_m").over(Window.partitionBy()))


def gap(vectors: DataFrame, network: DataFrame, *keys: str, within: str | None = None) -> DataFrame:
    """D of each key: half the sum of absolute share differences over all cells of the network.

    vectors: keys, cell, length_m. Cells that a key lacks keep their network share, so the sum over the key's own
    cells is completed by the share it misses; no dense grid is made. within: a cell column inside which shares
    are taken.
    """
    extra = [within] if within else []
    if within:
        network = network.withColumn("q", F.col("network_m") / F.sum("network_m").over(Window.partitionBy(within)))
    totals = Window.partitionBy(*keys, *extra)
    rows = vectors.join(network.select(*CELL, "q"), CELL).withColumn("share", F.col("length_m") / F.sum("length_m").over(totals))
    return rows.groupBy(*keys, *extra).agg((0.5 * (F.sum(F.abs(F.col("q") - F.col("share"))) + 1 - F.sum("q"))).alias("d"))


def composition_matrix(walks: DataFrame, parts: DataFrame) -> DataFrame:
    """Per cell of the network: network, traversed and unique length, shares, gap, coverage; null where nothing is below."""
    passes = walks.join(parts.filter("not connector").select("part_id", *CELL, F.col("length_m").alias("full_m")), "part_id")
    traversed = passes.groupBy(*CELL).agg(F.sum("length_m").alias("traversed_m"))
    once = passes.select("part_id", *CELL, "full_m").distinct().groupBy(*CELL).agg(F.sum("full_m").alias("unique_m"))
    grid = network_cells(parts).join(traversed, CELL, "left").join(once, CELL, "left").fillna(0.0, ["traversed_m", "unique_m"])
    share = F.try_divide("traversed_m", F.sum("traversed_m").over(Window.partitionBy()))
    return grid.withColumns({"share": share, "coverage": F.try_divide("unique_m", "network_m")}).withColumn("gap", F.col("share") - F.col("q"))


def pair_overlap(walks: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs of routes with parts in common: common length, and its share of the shorter one (unique parts). Ids are whole numbers.

    A part sends each of its routes the list of those that are longer (of equal ones, have larger ids), packed into a few
    bytes a pair, so pairs are made and summed where their shorter route is, in tasks of PAIRS pairs in the mean. Pairs
    themselves are never shuffled, and of the longer route nothing but its id is needed. Lengths of up to ROUTES routes go
    along with the code that sends the lists; those of more are joined to the parts.
    """
    spark = walks.sparkSession
    own = dealt(walks.select("route_id", "part_id"), "part_id").distinct().groupBy("part_id").agg(F.collect_list("route_id").alias("routes"))
    lists = stored(own.join(parts.select("part_id", "length_m"), "part_id"))
    n = F.size("routes").cast("long")
    total = lists.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // PAIRS) + 1)
    whole = stored(lists.select("length_m", F.explode("routes").alias("route_id")).groupBy("route_id").agg(F.sum("length_m").alias("m")))
    if whole.count() <= ROUTES:
        known = whole.toArrow().sort_by("route_id")
        ordered, known = lists.select("length_m", "routes"), tuple(known.column(c).to_numpy() for c in ("route_id", "m"))
    else:
        each = lists.select("part_id", F.col("length_m").alias("length"), F.explode("routes").alias("route_id")).join(whole, "route_id")
        order = F.array_sort(F.collect_list(F.struct("m", "route_id")))
        ordered, known = stored(each.groupBy("part_id", F.col("length").alias("length_m")).agg(F.transform(order, lambda x: x["route_id"]).alias("routes")).drop("part_id")), None
    sent = ordered.mapInArrow(partial(commons.sent, tasks=tasks, known=known), "task int, data binary").repartition(tasks, "task")
    return sent.mapInArrow(commons.met, "left long, right long, common_m double, fraction double")


def median_filled(parts: DataFrame, value: str, by: str) -> DataFrame:
    """value where known, else the median of its class, else of all; the raw value stays."""
    medians = parts.groupBy(by).agg(F.expr(f"percentile({value}, 0.5)").alias("class_median"))
    whole = parts.agg(F.expr(f"percentile({value}, 0.5)").alias("m")).scalar()
    return parts.join(medians, by, "left").withColumn("model", F.coalesce(value, "class_median", whole))


def route_features(walks: DataFrame, parts: DataFrame) -> DataFrame:
    """Length-weighted lanes over the known part, known share, class shares."""
    return feature_sums(walks.join(parts.select("part_id", "rc", "lanes"), "part_id"))


def feature_sums(rows: DataFrame) -> DataFrame:
    """The same from walks that know rc and lanes of their parts."""
    known = F.col("lanes").isNotNull()
    sums = rows.groupBy("route_id").agg(
        F.sum("length_m").alias("m"), F.sum(F.when(known, F.col("length_m"))).alias("known_m"), F.sum(F.col("lanes") * F.col("length_m")).alias("lane_m"),
        *(F.sum(F.when(F.col("rc") == c, F.col("length_m")).otherwise(0.0)).alias(c) for c in ("RC1", "RC2", "RC3", "RC4")), F.count_distinct("part_id").alias("n_parts"),
    )
    return sums.select("route_id", "n_parts", F.try_divide("lane_m", "known_m").alias("lanes"), F.coalesce(F.try_divide("known_m", "m"), F.lit(0.0)).alias("known_fraction"), *(F.try_divide(c, "m").alias(f"share_{c}") for c in ("RC1", "RC2", "RC3", "RC4")))


def midrank(value: str, *by: str) -> Column:
    """Mean position of ties over n - 1; 0.5 for a single value."""
    order, ties, whole = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value), Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(whole)
    return F.when(n == 1, 0.5).otherwise((F.rank().over(order) - 1 + (F.count(F.lit(1)).over(ties) - 1) / 2) / (n - 1))


def scaled(long: DataFrame, *by: str) -> DataFrame:
    """Min-max and z-score (population) of long-form features; constant features are dropped."""
    w = Window.partitionBy(*by, "feature")
    spread = F.max("value").over(w) - F.min("value").over(w)
    rows = long.withColumns({"span": spread, "low": F.min("value").over(w), "mean": F.avg("value").over(w), "sd": F.stddev_pop("value").over(w)}).filter("span > 1e-12")
    return rows.withColumns({"minmax": (F.col("value") - F.col("low")) / F.col("span"), "z": (F.col("value") - F.col("mean")) / F.col("sd")}).drop("span", "low", "mean", "sd")


def quartile_groups(long: DataFrame, *by: str) -> DataFrame:
    """Number of distinct quartile cuts of the feature that the value reaches."""
    cuts = long.groupBy(*by, "feature").agg(F.array_distinct(F.expr("percentile(value, array(0.25, 0.5, 0.75))")).alias("cuts"))
    return long.join(cuts, [*by, "feature"]).withColumn("bin", F.size(F.filter("cuts", lambda c: c <= F.col("value")))).drop("cuts")
