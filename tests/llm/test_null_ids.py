"""What the stages that drop documents do with rows that have a null id, or share one."""

from collections import Counter

import corpus_pipeline
from conftest import SF

from wayloom.llm import simhash
from wayloom.llm.common import table


def test_kept_rows_of_null_and_shared_ids(spark):
    """A null id belongs to no group and stays; rows that share an id are judged each by its own text."""
    same, other = "the of and " * 20, "one two three four five six seven eight nine ten " * 3
    rows = [(1, other), (2, same), (2, other), (3, same), (None, same), (None, other), (4, None), (5, ""), (2, same)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = Counter([(1, other), (2, same), (2, same), (None, same), (None, other), (4, None)])
    assert Counter((r.doc_id, r.text) for r in simhash.keep_one(docs, simhash.near_groups(docs)).collect()) == wanted


def test_leaks_of_null_and_shared_ids(spark):
    """A leaking row goes and a clean one stays, whatever their ids."""
    leak, clean = "some words before " + table(spark, SF, "benchmark").first().text, "nothing of that kind is in here at all " * 5
    rows = [(1, clean), (2, leak), (2, clean), (None, leak), (None, clean), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.decontaminate_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, clean), (2, clean), (None, clean), (3, None)])
