"""Shards of nearly equal size: splitters from size-weighted samples of the keys, ranges between them, overfull ones cut again.

Records are ordered by a hash of their text, then of their id, so copies of a text lie together; the order of a hash is
as good as a shuffle for training. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SHARDS = 24
#: Bytes that a record takes besides its text.
OVERHEAD = 8
#: Ranges a shard at least, bytes of a range beyond that, ranges at most (they are one array of splitters), sampled keys a range.
LEAST_RANGES, RANGE_BYTES, MOST_RANGES, SAMPLES = 64, 16 << 20, 65_536, 16
KEY = ("k1", "k2", "k3")


def key() -> Column:
    return F.struct(*KEY)


def placed(records: DataFrame, name: str, splitters: DataFrame) -> DataFrame:
    """records with the number of sorted splitters (one row, one array) at or before their key: halving, some ten steps a row."""
    steps = F.array(*(F.lit(1 << b) for b in range(17, -1, -1)))
    found = F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.get(F.col("splitters"), p + s - 1) <= key(), p + s).otherwise(p))
    return records.withColumn("splitters", splitters.scalar()).withColumn(name, found).drop("splitters")


def as_array(keys: DataFrame) -> DataFrame:
    """Key rows as one row with their sorted array."""
    return written(keys.select(key().alias("k")).agg(F.array_sort(F.array_distinct(F.collect_list("k"))).alias("keys")))


def sampled_splitters(records: DataFrame, totals: DataFrame, turn: int) -> DataFrame:
    """Keys that cut each range in totals (part, size, pieces) into pieces of about equal size.

    A record is drawn with a chance in proportion to its size, SAMPLES a piece, by a hash of its key; one larger than
    that is drawn for certain and weighs its own size. Boundaries are the quantiles of the drawn weights.
    """
    step = F.col("total") / (F.col("pieces") * SAMPLES)
    chance = F.xxhash64(*KEY, F.lit(turn)).cast("double") / 2.0**64 + 0.5
    drawn = records.join(F.broadcast(totals), "part").filter(chance < F.col("size") / step).select("part", *KEY, "pieces", F.greatest(F.col("size").cast("double"), step).alias("weight"))
    order = Window.partitionBy("part").orderBy(*KEY)
    upto = F.sum("weight").over(order) / F.sum("weight").over(Window.partitionBy("part")) * F.col("pieces")
    ranked = drawn.withColumn("piece", F.floor(upto)).withColumn("before", F.lag("piece", 1, 0).over(order))
    return ranked.filter("piece > before").select(*KEY)


def ranges_of(records: DataFrame, n_shards: int) -> tuple[DataFrame, int]:
    """One row with the splitters of all ranges, and the sum of sizes. Ranges that came out over twice their size are sampled and cut again.

    A range whose excess is a single record can't be cut. What reaches the driver are two sums and a count.
    """
    total, n = records.agg(F.sum("size"), F.count(F.lit(1))).first()
    pieces = max(1, min(MOST_RANGES // 2, max(n_shards * LEAST_RANGES, (total or 0) // RANGE_BYTES), n))
    target = (total or 0) / pieces
    whole = records.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(float(total or 0)).alias("total"), F.lit(pieces).alias("pieces"))
    splitters = as_array(sampled_splitters(records.withColumn("part", F.lit(0)), whole, 0))
    for turn in range(1, 64):
        cut = placed(records, "part", splitters)
        sums = cut.groupBy("part").agg(F.sum("size").alias("total"), F.max("size").alias("largest"), F.count(F.lit(1)).alias("n"))
        over = written(sums.filter((F.col("n") > 1) & (F.col("total") > 2 * target) & (F.col("total") - F.col("largest") > target)).select("part", F.col("total").cast("double"), F.least(F.col("n"), F.ceil(F.col("total") / target)).cast("int").alias("pieces")))
        if over.isEmpty():
            break
        more = sampled_splitters(cut, over, turn)
        splitters = as_array(splitters.select(F.explode("keys").alias("k")).select("k.*").union(more))
    return splitters, total or 0


def shards(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(record struct of all columns, size long, shard int, slot long): every row in one of n_shards shards, 0 first.

    Size: UTF-8 bytes of the text (null: none) plus OVERHEAD. The sums of sizes of two shards differ by less than
    the largest record's size plus one: shard boundaries are exact quantiles of the order, of which the sampled ranges
    only say where they lie. slot counts a shard's rows from 0 without a gap, in the same order. Copies of a text
    lie together unless a boundary cuts them; repeated rows (of one id too) each get a slot of their own and can be
    cut as well. Null ids and texts are allowed; an empty table gives no rows; fewer rows than shards leave some
    empty. Columns stay inside the record, so their names can't clash.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + OVERHEAD
    keyed = docs.select(F.struct("*").alias("record"), size.alias("size"), F.xxhash64(text_col).alias("k1"), F.xxhash64(id_col).alias("k2"))
    # written once: texts are hashed once, and the number that tells repeated rows apart stays the same in each retry
    records = written(keyed.withColumn("k3", F.monotonically_increasing_id()))
    narrow = records.select("size", *KEY)
    splitters, total = ranges_of(narrow, n_shards)
    parted = placed(narrow, "part", splitters)
    sums = parted.groupBy("part").agg(F.sum("size").alias("bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sums.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("part").orderBy(*KEY)
    upto = F.col("offset") + F.sum("size").over(inside) - F.col("size")
    # the middle of a record decides, so a shard ends within half a record of its exact share
    share = F.least(F.lit(n_shards - 1), F.floor((upto + F.col("size") / 2) * n_shards / F.lit(total))).cast("int")
    cut = written(parted.join(F.broadcast(offsets), "part").withColumn("shard", share).groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"), F.min(key()).alias("first")))
    bounds = as_array(cut.groupBy("shard").agg(F.min("first").alias("first")).filter("shard > 0").select("first.*"))
    used = sorted(r.shard for r in cut.select("shard").distinct().collect())  # n_shards at most
    start = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(cut.select("part", "shard", F.coalesce(start, F.lit(0)).alias("start")))
    # with fewer rows than shards some are empty, the first too
    whole = placed(placed(records, "part", splitters), "index", bounds)
    whole = whole.withColumn("shard", F.get(F.lit(used or [0]), F.col("index") - (0 if 0 in used else 1)))
    rank = F.row_number().over(Window.partitionBy("part", "shard").orderBy(*KEY)).cast("long") - 1
    return whole.withColumn("rank", rank).join(F.broadcast(starts), ["part", "shard"]).select("record", "size", "shard", (F.col("start") + F.col("rank")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder for each shard, with the record's columns and the slot; the rows of a file are in order of slots."""
    sharded.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").select("record.*", F.col("slot").alias("shard_slot"), "shard").write.partitionBy("shard").parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in 24 shards of near equal bytes (the law `bytes`, so grown_shard is null)."""
    rows = shards(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("record.text"), F.lit("")).cast("binary"))
    return rows.select(F.col("record.doc_id").alias("doc_id"), "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
