"""Reading and writing files: scans that keep faulty rows, safe sinks, snapshots, hashes."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions.scalar import spreadsheet_safe


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first line; a byte order mark is dropped."""
    first = spark.read.text(path).limit(1).collect()
    return next(csv.reader([first[0][0].lstrip(chr(0xFEFF))]), []) if first else []


def scan_csv(spark: SparkSession, path: str, required: list[str]) -> tuple[DataFrame, list[str]]:
    """All rows as text with flags for a wrong width, and the schema's issues. No row is dropped.

    One column more than the header tells long rows from whole ones; Spark fills short rows with nulls, so the
    width is counted on the raw line.
    """
    header = csv_header(spark, path)
    issues = [f"duplicate_header:{c}" for c in dict.fromkeys(c for c in header if header.count(c) > 1)] + [f"missing_column:{c}" for c in required if c not in header]
    lines = spark.read.text(path)
    return scan_lines(lines.filter(F.regexp_replace("value", "^\ufeff", "") != ",".join(header)), header)[0], issues


def scan_lines(lines: DataFrame, header: list[str]) -> tuple[DataFrame, int]:
    """Rows of CSV lines (column value) under a header, with flags; and the header's width."""
    schema = ", ".join(f"c{i} string" for i in range(len(header)))
    width = F.size(F.regexp_extract_all("value", F.lit(FIELD), F.lit(1)))
    rows = lines.filter(F.col("value") != "").select(F.from_csv("value", schema).alias("f"), width.alias("width"))
    flags = F.array_compact(F.array(F.when(F.col("width") > len(header), "extra_csv_fields"), F.when(F.col("width") < len(header), "short_csv_row")))
    return rows.select(*(F.col(f"f.c{i}").alias(c) for i, c in enumerate(header) if header.index(c) == i), flags.alias("flags")), len(header)


def scan_csv_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fails on any row that doesn't fit the schema, or a header that differs from it."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


ELEMENT = "struct<type:string,id:bigint,version:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>,count:bigint>"


def scan_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of tile responses with their file and place; NaN and infinity aren't numbers."""
    raw = spark.read.schema(f"elements array<{ELEMENT}>").json(path, multiLine=True, allowNonNumericNumbers=False)
    return raw.select(F.col("_metadata.file_path").alias("tile"), F.posexplode("elements").alias("pos", "e")).select("tile", "pos", "e.*")


def write_csv(df: DataFrame, path: str, fields: list[str], safe: bool = False) -> None:
    """Chosen fields only; the header is there even without rows. safe: nested values as JSON, and no cell that runs."""
    out = df.select(*fields)
    if safe:
        cells = {}
        for name, kind in out.dtypes:
            text = F.to_json(name) if kind.startswith(("array", "map", "struct")) else F.col(name).cast("string")
            cells[name] = spreadsheet_safe(text) if kind == "string" else text
        out = out.withColumns(cells)
    out.write.csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line; NaN becomes null first, since JSON has none."""
    doubles = {c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")}
    df.withColumns(doubles).write.json(path)


def snapshot(df: DataFrame, root: str, fingerprint: str) -> DataFrame:
    """The result stored under its fingerprint once; a later call reads what is stored and never writes over it."""
    spark, path = df.sparkSession, f"{root}/fp={fingerprint}"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def check_hashes(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Each file as same, changed, missing or unexpected; both sides have path and sha256."""
    a, e = actual.select(F.col("path").alias("a"), F.col("sha256").alias("ah")), expected.select(F.col("path").alias("e"), F.col("sha256").alias("eh"))
    rows = a.join(e, F.col("a") == F.col("e"), "full")
    return rows.select(F.coalesce("a", "e").alias("path"), F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("ah") == F.col("eh"), "same").otherwise("changed").alias("outcome"))


#: A field of a CSV line: quoted, with doubled quotes inside, or up to the next comma.
FIELD = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'


def csv_fields(line: Column) -> Column:
    """The fields of a line as an array; quotes around a field are taken off."""
    found = F.regexp_extract_all(line, F.lit(FIELD), F.lit(1))
    return F.transform(found, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def _lines(spark: SparkSession, path: str, skip_first: bool) -> DataFrame:
    """Lines (file, block, value) of all files in a folder and below; blank lines are left out."""
    read = spark.read.schema("value string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    read = read.option("sep", "\x01").option("quote", "").option("escape", "").option("header", skip_first)
    return read.csv(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").filter("value <> ''")


def file_schemas(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """(file, header, issues) of each CSV file: duplicate_header, and missing_column of what is required and not there.

    Only the first block of a file can hold its header; of that block one line is kept while it is read, so one row
    a file is shuffled. A byte order mark is dropped. Files without a line have no row.
    """
    first = _lines(spark, path, False).filter("block = 0").withColumn("at", F.monotonically_increasing_id())
    heads = first.groupBy("file").agg(F.min_by("value", "at").alias("line"))
    heads = heads.select("file", csv_fields(F.regexp_replace("line", "^\ufeff", "")).alias("header"))
    missing = [F.when(~F.array_contains("header", c), F.lit(f"missing_column:{c}")) for c in required]
    repeated = F.when(F.size(F.array_distinct("header")) < F.size("header"), F.lit("duplicate_header"))
    return heads.select("file", "header", F.array_compact(F.array(repeated, *missing)).alias("issues"))


def scan_quarantined(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Every data row of the CSV files: file, the required columns as text, flags (sorted), valid.

    Files may differ in the order and number of their columns: a value is found by its file's own header, the last
    of columns of one name. A file whose header has an issue is quarantined whole: its rows are kept, marked
    invalid_source_schema and not valid. Rows too long or too short for their header are marked too, and stay valid
    as far as the file is concerned. A value that isn't there is null. Line breaks inside quotes aren't supported.
    """
    heads = file_schemas(spark, path, required).withColumnRenamed("file", "of_file")
    rows = _lines(spark, path, True).select("file", csv_fields(F.col("value")).alias("f")).join(heads, F.col("file") == F.col("of_file"))
    width, wanted, faulty = F.size("f"), F.size("header"), F.size("issues") > 0
    flags = F.array_compact(F.array(F.when(width > wanted, F.lit("extra_csv_fields")), F.when(faulty, F.lit("invalid_source_schema")), F.when(width < wanted, F.lit("short_csv_row"))))
    place = {c: F.array_position(F.reverse("header"), c) for c in required}
    values = [F.when(at > 0, F.get("f", (wanted - at).cast("int"))).alias(c) for c, at in place.items()]
    return rows.select("file", *values, flags.alias("flags"), (~faulty).alias("valid"))


#: Folders of test data, and the file beside data that says whether it is.
TEST_FOLDERS, SIDECAR = "(^|/)(fixtures|demo|[^/]*_demo)/", "fixture_provenance.json"


def test_data_marks(rows: DataFrame, path: str) -> DataFrame:
    """rows (read from files below path) with marks, an array of why a row is test data: path, sidecar, column.

    path: a folder of its file is called fixtures, demo or ..._demo. sidecar: a fixture_provenance.json in its folder
    has is_test_data true. column: its own is_test_data is true or 1. Sidecars that can't be read mark nothing.
    """
    spark = rows.sparkSession
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", SIDECAR).option("wholetext", True).text(path)
    told = found.select(folder(F.col("_metadata.file_path")).alias("marked_folder"), F.from_json("value", "is_test_data boolean")["is_test_data"].alias("told")).filter("told").select("marked_folder").distinct()
    file = F.col("_metadata.file_path")
    own = F.lower(F.col("is_test_data").cast("string")).isin("true", "1") if "is_test_data" in rows.columns else F.lit(False)
    at = rows.select("*", file.alias("of_file"))
    at = at.join(told, folder(F.col("of_file")) == F.col("marked_folder"), "left")
    marks = F.array_compact(F.array(F.when(own, F.lit("column")), F.when(F.col("of_file").rlike(TEST_FOLDERS), F.lit("path")), F.when(F.col("marked_folder").isNotNull(), F.lit("sidecar"))))
    return at.select(*rows.columns, marks.alias("marks"))


def refuse_test_data(rows: DataFrame, path: str) -> DataFrame:
    """rows, if none is test data by test_data_marks; an error otherwise."""
    if not test_data_marks(rows, path).filter("size(marks) > 0").isEmpty():
        raise ValueError("test data in a real run")
    return rows
