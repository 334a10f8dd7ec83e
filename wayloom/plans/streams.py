"""Queries of streaming jobs, and of scans and sinks over files that Spark writes from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayloom.operators.lineage import checkpoint_folder, stored
from wayloom.sources import files
from wayloom.sources.tiles import checked_tiles, landed_objects
from wayloom.streaming import jobs

from .registry import query
from .views import table


def stream(spark, sf_dir, name):
    """A table as a stream of files. The pattern lets it be one file: a plain path must be a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


SECONDS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1e6"


@query("""WITH l AS (SELECT user_id AS trip_id, event_id AS source_row, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS dt, value - lag(value) OVER w AS dv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT trip_id, source_row, array_to_string([x FOR x IN [CASE WHEN dt > 0 AND abs(dv / 3.6 / dt) > 0.001 THEN 'acceleration_outlier' END, CASE WHEN dt <= 0 THEN 'nonmonotonic_time' END, CASE WHEN dt > 86400 THEN 'sampling_gap' END] IF x IS NOT NULL], ';') AS flags FROM l""")
def stream_point_qc(spark, sf_dir):
    points = stream(spark, sf_dir, "events").select(F.col("user_id").alias("trip_id"), F.col("event_id").alias("source_row"), F.expr(SECONDS).alias("t"), F.col("value").alias("speed"))
    return jobs.run_to_table(jobs.checked_points(points, 86400.0, 0.001), "append")


@query("""SELECT user_id AS trip_id, epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) // 1000000 AS start, count(*) AS n, round(sum(value), 5) AS total FROM events GROUP BY ALL""")
def stream_trip_metrics(spark, sf_dir):
    points = stream(spark, sf_dir, "events").select(F.col("user_id").alias("trip_id"), F.expr(f"timestamp_seconds({SECONDS})").alias("ts"), F.col("value").alias("speed"))
    sums = jobs.windowed_sums(points, "5 minutes", "1 hour").select("trip_id", F.unix_seconds("start").alias("start"), "n", "total")
    return jobs.run_to_table(sums, "update", ["trip_id", "start"]).withColumn("total", F.round("total", 5))


@query("SELECT DISTINCT event_id AS observation_id FROM events")
def stream_observation_import(spark, sf_dir):
    rows = stream(spark, sf_dir, "events").select(F.col("event_id").alias("observation_id"), F.expr(f"timestamp_seconds({SECONDS})").alias("ts"))
    return jobs.run_to_table(jobs.new_rows(rows, "observation_id", "ts", "1 day").select("observation_id"), "append")


#: Tiles of the stand-in: an order's parts as nodes, in the words of a server's answer. Faults go by the order's number.
TILE_TIME, TILE_BASE = "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z"


def tiles(spark, sf_dir):
    """(tile, body): the parts of an order are nodes, their name tells apart contents, and a count record ends it."""
    tile = F.col("o_orderkey")
    node = lambda part: F.struct(
        F.lit("node").alias("type"), (part + 1).alias("id"), F.when(tile % 17 == 0, 0).otherwise(1).alias("version"), F.lit(TILE_TIME).alias("timestamp"),
        F.when(tile % 13 == 0, 91.0).otherwise(21.0).alias("lat"), F.lit(105.8).alias("lon"), F.create_map(F.lit("name"), F.when(tile % 50 == 7, "new").otherwise("old")).alias("tags"),
    )
    # Numbers are shuffled, not texts: a tile's nodes are written out where its parts have met.
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_partkey").alias("parts"))
    own = F.coalesce("parts", F.array().cast(rows.schema["parts"].dataType))
    grouped = table(spark, sf_dir, "orders").select("o_orderkey").join(rows, tile == F.col("k"), "left").select("o_orderkey", F.array_sort(F.transform(own, lambda x: F.to_json(node(x)))).alias("nodes"))
    n = F.size("nodes")
    stated = F.to_json(F.struct(F.lit("count").alias("type"), F.lit(0).alias("id"), F.struct(n.cast("string").alias("nodes"), F.lit("0").alias("ways"), F.lit("0").alias("relations"), (n + F.when(tile % 11 == 0, 1).otherwise(0)).cast("string").alias("total")).alias("tags")))
    parts = F.when(tile % 19 == 0, F.col("nodes")).otherwise(F.array_append("nodes", stated))
    base = F.when(tile % 23 == 0, TILE_TIME).otherwise(TILE_BASE)
    remark = F.when(tile % 29 == 0, F.lit('"remark": "runtime error", ')).otherwise("")
    body = F.concat(F.lit("{"), remark, F.lit('"osm3s": {"timestamp_osm_base": "'), base, F.lit('"}, "elements": ['), F.array_join(parts, ", "), F.lit("]}"))
    return grouped.select(tile.alias("tile"), F.when(tile % 31 == 0, F.substring(body, F.lit(1), F.length(body) - 2)).otherwise(body).alias("body"))


SNAPSHOT = "2024-01-15T00:00:00Z"
TILE_FAULTS = """n AS (SELECT DISTINCT l_orderkey AS k, l_partkey FROM lineitem), c AS (SELECT k, count(*) AS n FROM n GROUP BY 1), f AS (SELECT o_orderkey AS t, coalesce(n, 0) AS n FROM orders LEFT JOIN c ON k = o_orderkey),
tiles AS (SELECT t AS tile, CASE WHEN t % 31 = 0 THEN NULL ELSE array_to_string([x FOR x IN [CASE WHEN t % 13 = 0 AND n > 0 THEN 'bad_place' END, CASE WHEN t % 17 = 0 AND n > 0 THEN 'bad_version' END, CASE WHEN t % 19 = 0 AND n = 0 THEN 'no_elements' END,
  CASE WHEN t % 19 = 0 THEN 'no_final_count' END, CASE WHEN t % 23 = 0 THEN 'old_base' END, CASE WHEN t % 29 = 0 THEN 'remark' END, CASE WHEN t % 11 = 0 AND t % 19 <> 0 THEN 'wrong_count' END] IF x IS NOT NULL], ';') END AS problems FROM f)"""


@query(f"""WITH {TILE_FAULTS}, r AS (SELECT tile, l_partkey + 1 AS id, CASE WHEN tile % 50 = 7 THEN 'new' ELSE 'old' END AS body, row_number() OVER w AS rn, first_value(CASE WHEN tile % 50 = 7 THEN 'new' ELSE 'old' END) OVER w AS known FROM tiles JOIN n ON k = tile WHERE problems = '' WINDOW w AS (PARTITION BY l_partkey ORDER BY tile % 3, tile))
SELECT tile, id, CASE WHEN rn = 1 THEN 'new' WHEN body = known THEN 'repeat' ELSE 'conflict' END AS outcome FROM r UNION ALL SELECT tile, NULL, 'not_whole' FROM tiles WHERE problems IS DISTINCT FROM ''""")
def stream_tile_ingest(spark, sf_dir):
    """Tiles land in three parts, each read when it is there: those with a problem are marked, the objects of the others
    are new, repeat or conflict by what is known from the parts before."""
    path, root = scratch(spark), jobs.stream_root(spark)
    made = stored(tiles(spark, sf_dir))
    for part in range(3):
        made.filter(F.col("tile") % 3 == part).write.mode("append").parquet(path)
        landed = checked_tiles(spark.readStream.schema(made.schema).parquet(path), F.lit(SNAPSHOT).cast("timestamp"))
        found = jobs.ingest(landed_objects(landed), root)
    return found.select("tile", "id", "outcome")


@query(f"WITH {TILE_FAULTS} SELECT tile, coalesce(problems, 'not_json') AS flags FROM tiles")
def tile_payload_rules(spark, sf_dir):
    """Every tile with the rules of a whole answer that it breaks."""
    return checked_tiles(tiles(spark, sf_dir), F.lit(SNAPSHOT).cast("timestamp")).select("tile", F.array_join("problems", ";").alias("flags"))


def scratch(spark):
    return f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"


LINES = """CASE p_partkey % 5 WHEN 0 THEN p_partkey || ',"' || p_brand || ', x",' || p_size || ',extra' WHEN 1 THEN p_partkey || ',' || p_brand ELSE p_partkey || ',"' || p_brand || '",' || p_size END"""


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, CASE p_partkey % 5 WHEN 0 THEN p_brand || ', x' ELSE p_brand END AS brand, CASE WHEN p_partkey % 5 <> 1 THEN CAST(p_size AS VARCHAR) END AS size, CASE p_partkey % 5 WHEN 0 THEN 'extra_csv_fields' WHEN 1 THEN 'short_csv_row' ELSE '' END AS flags FROM part""")
def csv_scan_flagged(spark, sf_dir):
    path = scratch(spark)
    lines = table(spark, sf_dir, "part").selectExpr(f"{LINES} AS value")
    lines.write.text(f"{path}/body")
    spark.createDataFrame([("id,brand,size",)], "value string").coalesce(1).write.text(f"{path}/head")
    header = files.csv_header(spark, f"{path}/head")
    rows, _ = files.scan_lines(spark.read.text(f"{path}/body"), header)
    return rows.withColumn("flags", F.array_join("flags", ";"))


@query("SELECT p_partkey AS id, p_brand AS brand, CAST(p_size AS INT) AS size FROM part")
def csv_scan_strict(spark, sf_dir):
    path = scratch(spark)
    files.write_csv(table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_brand AS brand", "p_size AS size", "p_name AS unused"), path, ["id", "brand", "size"])
    return files.scan_csv_strict(spark, path, "id long, brand string, size int")


@query("SELECT s_suppkey AS tile, row_number() OVER (PARTITION BY s_suppkey ORDER BY 1) - 1 AS pos, 'node' AS type FROM supplier")
def json_elements_scan(spark, sf_dir):
    path = scratch(spark)
    tiles = table(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.array(F.struct(F.lit("node").alias("type"), F.col("s_suppkey").alias("id"), F.lit(21.0).alias("lat"))).alias("elements"))).alias("value"))
    tiles.write.text(path)
    raw = spark.read.schema(f"elements array<{files.ELEMENT}>").json(path, allowNonNumericNumbers=False)
    return raw.select(F.posexplode("elements").alias("pos", "e")).select(F.col("e.id").alias("tile"), F.col("pos").cast("long").alias("pos"), F.col("e.type").alias("type"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 2.0 END::DOUBLE AS half FROM nation")
def json_sink(spark, sf_dir):
    path = scratch(spark)
    k = F.col("n_nationkey")
    files.write_json(table(spark, sf_dir, "nation").select(k.cast("long").alias("id"), F.when(k % 2 == 0, k / 2.0).otherwise(F.lit(float("nan"))).alias("half")), path)
    return spark.read.schema("id long, half double").json(path)


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def versioned_snapshot_sink(spark, sf_dir):
    root, rows = scratch(spark), table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    files.snapshot(rows, root, "a1")
    return files.snapshot(rows.limit(0), root, "a1")


@query("SELECT 'same' AS outcome, 1::BIGINT AS n")
def file_hash_check(spark, sf_dir):
    """Hashes of a written file against a manifest of them."""
    path = scratch(spark)
    table(spark, sf_dir, "part").select("p_partkey").coalesce(1).write.parquet(path)
    actual = files.file_hashes(spark, f"{path}/*.parquet")
    return files.check_hashes(actual, actual).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n_bronze, count(*) AS n_silver, true AS equal FROM events")
def raw_archive_check(spark, sf_dir):
    path, rows = scratch(spark), table(spark, sf_dir, "events")
    rows.write.parquet(path)
    stored = spark.read.parquet(path).agg(F.count(F.lit(1))).scalar()
    out = rows.agg(F.count(F.lit(1)).alias("n_bronze"))
    return out.select("n_bronze", stored.alias("n_silver"), (F.col("n_bronze") == stored).alias("equal"))


#: Files of the stand-in: headers go by the number of 500 ids, faults by the event's id. A file has FILE_GROUPS such groups of one header.
HEADERS = ("event_id,user_id,event_type,value", "event_id,user_id,event_type", "event_id,user_id,event_type,event_type,value", "value,event_id,user_id,event_type", '"event_id",user_id,event_type,value')


FILE_GROUPS = 500


def csv_files(spark, sf_dir, path):
    """The events as CSV files, each under its own header, quoted where a value has a comma."""
    name, value = F.concat(F.lit('"'), "event_type", F.lit(', x"')), F.floor("value").cast("string")
    number = F.floor(F.col("event_id") / 500).cast("long")
    cells = {"event_id": F.col("event_id").cast("string"), "user_id": F.col("user_id").cast("string"), "event_type": name, "value": value}
    bodies = [[cells[c.strip('"')] for c in h.split(",")] for h in HEADERS]
    cut = (F.col("event_id") % 13 != 0) & (F.col("event_id") % 17 == 0)
    line = F.lit(None)
    for k, body in enumerate(bodies):
        whole = F.concat_ws(",", *body, F.when(F.col("event_id") % 13 == 0, F.lit("more")))
        line = F.when(number % len(HEADERS) == k, F.when(cut, F.concat_ws(",", *body[:-1])).otherwise(whole)).otherwise(line)
    kinds = len(HEADERS)
    file = F.floor(number / (kinds * FILE_GROUPS)).cast("long") * kinds + number % kinds
    rows = table(spark, sf_dir, "events").select(file.alias("file"), F.col("event_id").alias("at"), line.alias("value"))
    header = F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("file") % len(HEADERS) + 1).cast("int"))
    heads = rows.select("file").distinct().select("file", F.lit(-1).cast("long").alias("at"), header.alias("value"))
    ordered = heads.unionByName(rows).repartition("file").sortWithinPartitions("file", "at").select("file", "value")
    ordered.write.partitionBy("file").option("quote", "").option("sep", "\x01").option("escape", "").option("emptyValue", "").csv(path)


@query("""WITH e AS (SELECT *, (event_id // 500) % 5 AS kind, event_id % 13 = 0 AS long, event_id % 13 <> 0 AND event_id % 17 = 0 AS short FROM events)
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN NOT (short AND kind IN (1, 3)) THEN event_type || ', x' END AS event_type,
  CASE WHEN kind <> 1 AND NOT (short AND kind <> 3) THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value, kind NOT IN (1, 2) AS valid,
  array_to_string([x FOR x IN [CASE WHEN long THEN 'extra_csv_fields' END, CASE WHEN kind IN (1, 2) THEN 'invalid_source_schema' END, CASE WHEN short THEN 'short_csv_row' END] IF x IS NOT NULL], ';') AS flags FROM e""")
def schema_quarantine(spark, sf_dir):
    """All events through CSV files of five headers, of which two are faulty: their rows are kept and marked."""
    path = scratch(spark)
    csv_files(spark, sf_dir, path)
    return files.scan_quarantined(spark, path, ["event_id", "user_id", "event_type", "value"]).select("event_id", "user_id", "event_type", "value", "valid", F.array_join("flags", ";").alias("flags"))


@query("""SELECT event_id, array_to_string([x FOR x IN [CASE WHEN event_id % 97 = 0 THEN 'column' END, CASE WHEN event_id % 5 IN (1, 2) THEN 'path' END, CASE WHEN event_id % 5 = 3 THEN 'sidecar' END] IF x IS NOT NULL], ';') AS marks FROM events""")
def test_data_guard(spark, sf_dir):
    """All events from five folders: two are test data by their names, one by the file beside it, one says it isn't."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 97 == 0).alias("is_test_data"))
    for k, folder in enumerate(("live", "fixtures", "north_demo", "told", "denied")):
        rows.filter(F.col("event_id") % 5 == k).write.parquet(f"{path}/{folder}")
    for folder, told in (("told", "true"), ("denied", "false")):
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}/{files.SIDECAR}")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray(f'{{"is_test_data": {told}}}'.encode()))
        out.close()
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
    return files.test_data_marks(read, path).select("event_id", F.array_join("marks", ";").alias("marks"))
