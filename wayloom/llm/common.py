"""What the operators share: reading tables, cutting lineage, exact words of a text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than these (ASCII white space); bytes.split() cuts at exactly these.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it (tests set one)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="wayloom-"))
    return context.getCheckpointDir()


#: Where written() notes its tables, inside a noting() block.
NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage is cut, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (noted := NOTED.get()) is not None:
        noted.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def noting() -> Iterator[list[str]]:
    """A list of the tables that written() makes inside the block."""
    token = NOTED.set(paths := [])
    try:
        yield paths
    finally:
        NOTED.reset(token)


def drop_tables(spark: SparkSession, paths: list[str], *kept: DataFrame) -> None:
    """Deletes tables of written(), but for those that a kept DataFrame reads."""
    read = {x.rsplit("/", 2)[1] for df in kept for x in df.inputFiles()} if paths else set()
    for path in paths:
        if path.rsplit("/", 1)[1] not in read:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows up to which Spark may choose to broadcast a side of a join (some 20 MB of numbers).
BROADCAST_ROWS = 500_000


def side(written_rows: DataFrame) -> DataFrame:
    """A written table as one side of a join: beyond BROADCAST_ROWS rows it is merged, for the size of compressed Parquet says little about memory."""
    return written_rows.hint("merge") if written_rows.count() > BROADCAST_ROWS else written_rows


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_of_id(c: Column) -> Column:
    """crc32 of the id as decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def byte_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column's texts; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def most_frequent(counts: DataFrame, count_col: str, most: int) -> DataFrame:
    """The rows of highest count, at most `most` of them, without a sort: only a histogram of counts reaches the driver.

    Counts are told apart in steps of a sixteenth of an octave (some thousand steps at most); the rows are those
    of all steps that fit in whole.
    """
    step = F.floor(F.log2(F.col(count_col).cast("double")) * 16).cast("int")
    sizes = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = None, 0
    for s, n in sorted(((r.s, r.n) for r in sizes if r.s is not None), reverse=True):
        total += n
        if total > most:
            break
        least = s
    return counts.filter(step >= least) if least is not None else counts.limit(0)
