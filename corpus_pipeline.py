"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame.

language_id drops documents without a letter, in no language that stands out, or in several; simhash keeps the
smallest id of each group of near copies; substring_dedup takes out words of long passages that an earlier document
holds; decontaminate drops documents that hold a benchmark passage; byte_bpe encodes what is left, and decodes it.
All but the last return the columns of documents. Each is written as Parquet and read again by the next.

In every stage a null text counts as empty, repeated rows are judged alike, an empty table gives an empty one, and
columns beyond id and text are carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from itertools import count

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import bpe, decontaminate, langid, near_copies, simhash, substring_dedup
from wayloom.llm.common import drop_tables, noting, table, written

#: Share of the likelihood below which no language stands out, and of the windows below which a text is mixed.
LEAST_SHARE, LEAST_WINDOWS = 0.5, 0.5


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: By application the tables that stages worked with, each with the place of its stage.
EARLIER: dict[str, list[tuple[int, str]]] = {}
PLACES = count()
#: Rows of an Arrow batch at most: Spark's own 10,000 rows of whole texts would fill a worker, and the JVM's buffers beside it.
BATCH_ROWS, BATCH_CONF = 128, "spark.sql.execution.arrow.maxRecordsPerBatch"


def stage(f: Stage) -> Stage:
    """Drops what the stages before worked with: their results have been written by then, and docs is the last of them.

    The session keeps BATCH_ROWS afterwards (or a smaller bound of its own), since a stage's result is written later."""
    place = next(PLACES)

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
            spark.conf.set(BATCH_CONF, BATCH_ROWS)
        known = EARLIER.setdefault(spark.sparkContext.applicationId, [])
        drop_tables(spark, [path for at, path in known if at < place], docs)
        with noting() as paths:
            result = f(spark, docs, sf_dir)
        known[:] = [x for x in known if x[0] >= place] + [(place, path) for path in paths]
        return result

    return run_stage


def with_texts(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """docs with another text and its length; texts has every column of docs but these two."""
    changed = texts.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else texts
    return changed.select(*docs.columns)


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is `und` (null and empty texts, no letter), of which no learned language has
    LEAST_SHARE of the likelihood or LEAST_WINDOWS of the windows, or that the best one codes no shorter than single
    bytes do. Without a labelled row no language is learned, so all are dropped."""
    return langid.keep_identified(docs, langid.train(docs.filter(~langid.held_out())), LEAST_SHARE, LEAST_WINDOWS)


@stage
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies: a similarity of 0.8 or more over 5-word shingles. Texts
    without a word are copies of each other; rows with a null id stay; repeated rows of the kept id all stay."""
    return simhash.keep_one(docs, near_copies.near_copies(docs))


@stage
def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the words of repeated passages; a text that loses none stays as it is, and every document stays.
    Rows with a null id lose nothing, and rows that share an id lose nothing to each other."""
    return with_texts(docs, substring_dedup.strip_documents(docs))


@stage
def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a benchmark passage; each row is judged by its text, so null and shared ids don't matter.
    Null and empty texts hold none and stay."""
    marked = docs.withColumn("wayloom_text_print", F.xxhash64("text"))
    leaks = decontaminate.find_leaks(marked, table(spark, sf_dir, "benchmark"), id_col="wayloom_text_print")
    return decontaminate.drop_leaks(marked, leaks, "wayloom_text_print").select(*docs.columns)


@stage
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; of a null or empty text no tokens and the digests of no bytes."""
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("byte_bpe", byte_bpe),
]

#: Models, fingerprints and alignments are beyond SQL; tests/llm checks the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, apply in STAGES[:-1]:
        result = apply(spark, docs, sf_dir)
        with noting() as paths:
            docs = written(result)
        drop_tables(spark, before, docs)
        before = paths
    return STAGES[-1][1](spark, docs, sf_dir)
