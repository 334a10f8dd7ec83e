"""Quality rules whose thresholds come from quantile sketches of each language and source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, table, written

SYMBOLS = "#*$%&|<>"
#: Buckets of a sketch grow by this factor, so a quantile is right to within half of it (0.1 %), whatever the number of
#: rows; a group has under 14,000 buckets from a millionth to a million.
GROWTH = 1.002
#: Measure -> ranks of the edge and of the middle that the gap to it is taken from, and gaps beyond the edge that are
#: far out. No value is fixed. Symbols are rare in prose, so the edge is a quartile; repeats are common in few texts,
#: so theirs is the 98th percentile.
HIGH = {"symbol_rate": (0.75, 0.5, 6.0), "dup_line_rate": (0.98, 0.5, 2.0), "repeat_rate": (0.98, 0.5, 2.0), "mean_word": (0.75, 0.25, 6.0)}
LOW = {"mean_word": (0.25, 0.75, 6.0)}
#: Rates have a largest value; their threshold lies half way from the edge to it at most, so it always can be passed.
RATES = ("symbol_rate", "dup_line_rate", "repeat_rate")
#: Groups with fewer rows take the thresholds of their language, and then those of all rows.
LEAST_ROWS = 50


def let(value: Column, body) -> Column:
    """body(value) with value computed once, though body names it several times or inside a lambda."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the text.

    Windows are told apart by 64-bit hashes. Where some repeat, they are sorted with their positions, so equal
    windows meet; covered words are then counted from the sorted positions.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(p, i)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(p, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

        def total(q: Column) -> Column:
            gaps = F.transform(q, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(q, i + 1) - x, F.lit(3))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(placed, places), total))

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return let(windows, covered)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per input row: id, group keys, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(k).alias(f"key{i}") for i, k in enumerate(keys))).select(
        "id",
        *(f"key{i}" for i in range(len(keys))),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeats"))).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(lines, F.size).cast("long").alias("n_lines"),
    ).select("*", F.col("w.n").alias("n_words"), F.col("w.repeats").alias("n_repeat_words")).drop("w")


def with_rates(rows: DataFrame) -> DataFrame:
    rate = lambda a, b: F.try_divide(F.col(a), F.col(b)).cast("double")
    return rows.select("*", rate("n_symbols", "word_chars").alias("symbol_rate"), rate("n_dup_lines", "n_lines").alias("dup_line_rate"), rate("n_repeat_words", "n_words").alias("repeat_rate"), rate("word_chars", "n_words").alias("mean_word"))


def sketch(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, bucket, n): counts of values by logarithmic bucket; zero has a bucket of its own.

    Sketches merge by adding counts, so no order of rows or tasks can change them.
    """
    bucket = lambda v: F.when(v <= 0, -(1 << 30)).otherwise(F.ceil(F.log(v) / math.log(GROWTH))).cast("int")
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in HIGH)))
    return rows.select(*keys, values.alias("x")).select(*keys, "x.*").groupBy(*keys, "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, n, q): q has the value at each rank of RANKS, the middle of its bucket."""
    order = Window.partitionBy(*keys, "measure").orderBy("bucket")
    whole = Window.partitionBy(*keys, "measure")
    rows = counts.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(whole)})
    value = lambda b: F.when(b > -(1 << 30), 2 * F.pow(F.lit(GROWTH), b) / (GROWTH + 1)).otherwise(0.0)
    at = [F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("all") * p)), F.col("bucket"))) for p in RANKS]
    return rows.groupBy(*keys, "measure").agg(F.max("all").alias("n"), F.array(*at).alias("b")).select(*keys, "measure", "n", F.transform("b", value).alias("q"))


#: All ranks that thresholds are made of.
RANKS = sorted({p for ranks in (HIGH, LOW) for edge, middle, _ in ranks.values() for p in (edge, middle)})


def fences(rows: DataFrame, n_keys: int = 2) -> DataFrame:
    """Low and high threshold of each measure for each group, from sketches that merge upwards.

    A threshold lies some gaps beyond the edge of the group's own distribution. Small groups take edge and gap of a
    coarser one (all keys, then the first, then all rows), and so does a group's gap alone where it is zero; a gap
    that is zero for all rows too puts the threshold at the edge. Rows with no word or that fail the base rules
    don't enter the sketches.
    """
    keys, measured = [f"key{i}" for i in range(n_keys)], list(HIGH)
    sketches = written(sketch(rows, *keys))
    merged = lambda *by: sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))

    def cut(counts: DataFrame, by: list[str], name: str, least: int) -> DataFrame:
        found = quantiles(counts, *by).groupBy(*by).agg(F.max("n").alias("n"), *(F.first(F.when(F.col("measure") == m, F.col("q")), True).alias(m) for m in measured))
        parts = []
        for side, ranks in (("high", HIGH), ("low", LOW)):
            for m, (edge, middle, _) in ranks.items():
                q = lambda p, m=m: F.col(m)[RANKS.index(p)]
                parts.append(F.struct(q(edge).alias("edge"), F.abs(q(edge) - q(middle)).alias("gap")).alias(f"{side}_{m}"))
        return found.filter(F.col("n") >= least).select(*by, F.struct(*parts).alias(name))

    fine, coarse, whole = cut(sketches, keys, "fine", LEAST_ROWS), cut(merged(keys[0]), keys[:1], "coarse", LEAST_ROWS), cut(merged(), [], "whole", 1)
    named = lambda df, prefix: df.select(*(F.col(k).alias(f"{prefix}_{k}") for k in keys if k in df.columns), *(c for c in df.columns if c not in keys))
    fine, coarse = named(fine, "f"), named(coarse, "c")
    on = [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in keys]
    out = sketches.select(*keys).distinct().join(fine, on, "left").join(coarse, F.col(keys[0]).eqNullSafe(F.col(f"c_{keys[0]}")), "left").withColumn("whole", whole.scalar())

    def bound(side: str, measure: str) -> Column:
        if measure not in (ranks := HIGH if side == "high" else LOW):
            return F.lit(None).cast("double").alias(side)
        of = lambda level, part: F.col(f"{level}.{side}_{measure}.{part}")
        levels = ("fine", "coarse", "whole")
        gap = F.coalesce(*(F.when(of(x, "gap") > 0, of(x, "gap")) for x in levels), F.lit(0.0)) * ranks[measure][2]
        edge = F.coalesce(*(of(x, "edge") for x in levels))
        if measure in RATES:
            return F.least(edge + gap, (edge + 1) / 2).alias(side)
        return (edge + (gap if side == "high" else -gap)).alias(side)

    return out.select(*keys, F.struct(*(F.struct(bound("low", m), bound("high", m)).alias(m) for m in measured)).alias("bounds"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Per row: id, measures, base_failed, thresholds' verdict kept, and reasons (measures that lie outside).

    A value is outside when it lies beyond a threshold of its group (see fences), which only quantiles set. Null
    keys form groups of their own. A null or empty text has no words and
    fails the base rule. Repeated rows are judged alike and all returned; an empty table gives no rows; other
    columns aren't read, so their names can't clash.
    """
    rows = with_rates(written(measures(docs, id_col, text_col, keys)))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    limits = fences(rows.filter(~base), len(keys))
    match = F.lit(True)
    for i in range(len(keys)):
        match = match & F.col(f"r.key{i}").eqNullSafe(F.col(f"t.key{i}"))
    outside = [F.when((F.col(m) < F.col(f"bounds.{m}.low")) | (F.col(m) > F.col(f"bounds.{m}.high")), F.lit(m)) for m in HIGH]
    joined = rows.alias("r").join(limits.alias("t"), match, "left")
    reasons = F.array_compact(F.array(*outside))
    return joined.select(F.col("r.id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (F.size(reasons) == 0)).alias("kept"), reasons.alias("reasons"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all `documents`, with thresholds of each language and source."""
    return judge(table(spark, sf_dir, "documents"))
