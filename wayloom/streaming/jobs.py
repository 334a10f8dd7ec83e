"""Structured Streaming jobs: point checks with state, windowed measures, imports without repeats, tile ingest."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from wayloom.operators.lineage import checkpoint_folder


BATCH = "wayloom_batch"


def stream_root(spark) -> str:
    """A new place for a job's state and table."""
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, mode: str, keys: list[str] | None = None, root: str | None = None) -> DataFrame:
    """Drains what the source holds now into a table of the shared folder; with keys, each key's newest batch counts.

    A root of an earlier run goes on where that one ended: state and batches are kept, and only what landed since is read.
    """
    spark, root = stream.sparkSession, root or stream_root(stream.sparkSession)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table/{BATCH}={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField(BATCH, IntegerType())])).option("basePath", f"{root}/table").parquet(f"{root}/table")
    if keys:
        newest = F.max(BATCH).over(Window.partitionBy(*keys))
        rows = rows.withColumn("wayloom_newest", newest).filter(F.col(BATCH) == F.col("wayloom_newest")).drop("wayloom_newest")
    return rows.drop(BATCH)


def checked_points(points: DataFrame, max_gap_s: float, max_acceleration: float) -> DataFrame:
    """Flags of each point against the last one of its trip, which is kept as state; late rows aren't dropped but flagged."""

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("source_row")
        t0, v0 = state.get if state.exists else (np.nan, np.nan)
        t, v = rows.t.to_numpy(float), rows.speed.to_numpy(float)
        dt = t - np.append(t0, t[:-1])
        with np.errstate(divide="ignore", invalid="ignore"):
            rough = (dt > 0) & (np.abs((v - np.append(v0, v[:-1])) / 3.6 / dt) > max_acceleration)
        order = np.where(dt <= 0, "nonmonotonic_time", np.where(dt > max_gap_s, "sampling_gap", ""))
        flags = np.where(rough, np.where(order == "", "acceleration_outlier", np.char.add("acceleration_outlier;", order)), order)
        state.update((float(t[-1]), float(v[-1])))
        yield pd.DataFrame({"trip_id": key[0], "source_row": rows.source_row, "flags": flags})

    return points.groupBy("trip_id").applyInPandasWithState(work, "trip_id long, source_row long, flags string", "t double, v double", "append", GroupStateTimeout.NoTimeout)


def windowed_sums(points: DataFrame, width: str, lateness: str) -> DataFrame:
    """Tumbling sums of each trip; what comes later than the watermark allows is left out."""
    return points.withWatermark("ts", lateness).groupBy("trip_id", F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.sum("speed").alias("total")).select("trip_id", F.col("window.start").alias("start"), "n", "total")


def new_rows(rows: DataFrame, key: str, time: str, lateness: str) -> DataFrame:
    """The first row of every key within the watermark."""
    return rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def first_contents(objects: DataFrame) -> DataFrame:
    """(kind, id, tile, version, outcome) of each object that lands: new, repeat (the content that is known), or conflict.

    The state of an object is the digest of the first content that came; a differing one never replaces it. Inside
    a batch tiles count in the order of their ids. Rows of one object in one batch are the tiles that share it.
    """

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["tile", "digest"], kind="stable")
        known = state.get[0] if state.exists else None
        outcome = np.where(rows.digest == (known or rows.digest.iloc[0]), "repeat", "conflict").astype(object)
        if known is None:
            outcome[0] = "new"
            state.update((rows.digest.iloc[0],))
        yield pd.DataFrame({"kind": key[0], "id": key[1], "tile": rows.tile, "version": rows.version, "outcome": outcome})

    tile = objects.schema["tile"].dataType.simpleString()
    return objects.groupBy("kind", "id").applyInPandasWithState(work, f"kind string, id long, tile {tile}, version long, outcome string", "digest string", "append", GroupStateTimeout.NoTimeout)


def ingest(landed: DataFrame, root: str) -> DataFrame:
    """Drains landed objects (kind, id, tile, version, digest; a null kind for a tile that isn't whole) into a table below root.

    Outcomes are those of first_contents, and not_whole. What is known of an object is a row of a table that grows with
    the objects, not with what lands; a batch is joined with it, so no object costs a call of Python. A batch that is
    run again sees only what the batches before it left, and writes over its own rows.
    """
    spark, at = landed.sparkSession, {x: f"{root}/{x}" for x in ("landed", "known", "table")}
    known_schema = StructType([landed.schema[c] for c in ("kind", "id", "digest")])

    def read(name: str, number: int, schema: StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{at[name]}/{BATCH}={number}")

    def store(batch: DataFrame, number: int) -> None:
        path = f"{at['landed']}/{BATCH}={number}"
        batch.withColumn("place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
        rows = spark.read.schema(StructType([*landed.schema.fields, StructField("place", LongType())])).parquet(path)
        objects = rows.filter("kind is not null")
        first = objects.groupBy("kind", "id").agg(F.min(F.struct("tile", "digest", "place")).alias("first"))
        earlier = reduce(DataFrame.unionByName, (read("known", n, known_schema) for n in range(number))) if number else spark.createDataFrame([], known_schema)
        states = first.join(earlier.withColumnRenamed("digest", "known"), ["kind", "id"], "left")
        states.filter("known is null").select("kind", "id", "first.digest").write.mode("overwrite").parquet(f"{at['known']}/{BATCH}={number}")
        outcome = F.when(F.col("known").isNull() & (F.col("place") == F.col("first.place")), "new").when(F.col("digest") == F.coalesce("known", "first.digest"), "repeat").otherwise("conflict")
        judged = objects.join(states, ["kind", "id"]).select("kind", "id", "tile", "version", outcome.alias("outcome"))
        faulty = rows.filter("kind is null").select("kind", "id", "tile", "version", F.lit("not_whole").alias("outcome"))
        judged.unionByName(faulty).write.mode("overwrite").parquet(f"{at['table']}/{BATCH}={number}")

    landed.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    schema = StructType([*(landed.schema[c] for c in ("kind", "id", "tile", "version")), StructField("outcome", StringType()), StructField(BATCH, IntegerType())])
    return spark.read.schema(schema).option("basePath", at["table"]).parquet(at["table"]).drop(BATCH)
