"""URL rules and host lists by a cascade of Bloom filters that is exact over the corpus's own keys."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table, written

#: Keys of one part of a filter (12 bits each at the first level, so 6 MB); a larger filter has several parts.
PART_KEYS = 4_000_000
#: Keys of a list at most (150 MB of filters reach every executor); a longer list is refused.
MOST_LISTED = 100_000_000
#: Hash functions of the first level, and of the others.
FIRST_HASHES, NEXT_HASHES = 4, 1


@dataclass(frozen=True)
class Rule:
    """Fits host and all its subdomains, if the url's path starts with path."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def shape(self) -> tuple[int, int]:
        return self.host.count(".") + 1, len(self.path)


def parse_rule(text: str) -> Rule:
    """`block net/` -> Rule('block', 'net', '/')."""
    action, _, rest = text.partition(" ")
    host, slash, path = rest.partition("/")
    return Rule(action, host, slash + path)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without `://`."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    return lower_ascii(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def host_suffix(host: Column, labels: int) -> Column:
    """The last labels of a host; null if it has fewer."""
    return F.when((host != "") & (F.size(F.split(host, r"\.")) >= labels), F.substring_index(host, ".", -labels))


def rule_key(host: Column, path: Column, shape: tuple[int, int]) -> Column:
    labels, length = shape
    return F.when(F.length(path) >= length, F.concat(host_suffix(host, labels), F.substring(path, 1, length)))


def bit_places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)).cast("long") for j in range(hashes)]


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    parts: list[DataFrame]

    def hit(self, key: Column) -> Column:
        words = self.parts[0].scalar() if len(self.parts) == 1 else F.coalesce(*(F.when(part_of(key, self.number, len(self.parts)) == i, x.scalar()) for i, x in enumerate(self.parts)))
        tests = [F.call_function("shiftright", F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1 for p in bit_places(key, self.number, self.bits, self.hashes)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def part_of(key: Column, level: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit("part")), F.lit(parts))


def filter_of(keys: DataFrame, n: int, number: int, part_keys: int = PART_KEYS) -> Level:
    """One filter over n keys, as one-row tables of an array of 64-bit words."""
    hashes, parts = FIRST_HASHES if number == 1 else NEXT_HASHES, max(1, math.ceil(n / part_keys))
    bits = 64 * max(1, math.ceil(max(1, n / parts) * hashes / math.log(2) / 64))

    def part(own: DataFrame) -> DataFrame:
        places = own.select(F.explode(F.array(*bit_places(F.col("key"), number, bits, hashes))).alias("p"))
        words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
        every = keys.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("w"), "left")
        dense = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("x"))
        return written(dense.select(F.transform("x", lambda x: x["b"]).alias("words")))

    return Level(number, bits, hashes, [part(keys if parts == 1 else keys.filter(part_of(F.col("key"), number, parts) == i)) for i in range(parts)])


def possibly_in(keys: DataFrame, key: Column, most: int = 20_000_000) -> Column:
    """Whether a key may be among the keys (column key), by a single filter of 15 MB at most; more keys make it less sharp, not wrong."""
    keys = keys.distinct()
    return F.coalesce(filter_of(keys, min(keys.count(), most), 1, most).hit(key), F.lit(False))


class Cascade:
    """Exact membership of the keys of a universe in a listed set.

    The first level holds the list. What it lets through of the universe is told apart by one grouping with the list:
    wrong keys, which the second level holds, and right ones. From there on each level holds the keys that the one
    before it wrongly passes. Building stops when a level passes no wrong key, so the first level that lacks a key
    decides on it without error. Keys that the first level stops are never compared with the list.
    """

    def __init__(self, universe: DataFrame, listed: DataFrame, part_keys: int = PART_KEYS):
        listed = written(listed.select("key").filter("key is not null").distinct())
        n = listed.count()
        if n > MOST_LISTED:
            raise ValueError(f"{n} listed keys; at most {MOST_LISTED} fit into filters")
        self.levels = [filter_of(listed, n, 1, part_keys)]
        passed = universe.filter(self.levels[0].hit(F.col("key"))).select("key", F.lit(0).alias("of_list")).unionByName(listed.withColumn("of_list", F.lit(1)))
        told = written(passed.groupBy("key").agg(F.max("of_list").alias("listed"), F.min("of_list").alias("lacking")).filter("lacking = 0"))
        inside, wrong = told.filter("listed = 1").select("key"), told.filter("listed = 0").select("key")
        while wrong_n := wrong.count():
            level = filter_of(wrong, wrong_n, len(self.levels) + 1, part_keys)
            self.levels.append(level)
            inside, wrong = wrong, written(inside.filter(level.hit(F.col("key"))))

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed; a null key isn't."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(level.hit(key), answer).otherwise(F.lit(level.number % 2 == 0))
        return F.when(key.isNotNull(), answer).otherwise(F.lit(False))


def judge_urls(pages: DataFrame, rules: list[Rule], blocked_hosts: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule (text of the longest that fits, else null), verdict, by_list.

    Of the rules that fit, the one with the longest text wins (then the longer host). Where none fits, the
    verdict is block if blocked_hosts (a column key of hosts, which count with their subdomains) lists the
    host, else allow. Keys carry their list (b: block rule, a: allow rule, h: host), so one cascade serves
    all; more than MOST_LISTED keys are refused. A null or malformed url has
    empty parts and is allowed. Repeated rows are judged alike and all returned; an empty table gives no rows;
    other columns aren't read, so their names can't clash.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    kinds = {"block": "b:", "allow": "a:"}
    keyed = [(kinds[r.action] + r.text,) for r in rules]
    listed = spark.createDataFrame(keyed, "key string")
    if blocked_hosts is not None:
        listed = listed.unionByName(blocked_hosts.select(F.concat(F.lit("h:"), "key").alias("key")).filter("key is not null"))
    listed = written(listed.distinct())
    shapes = {kind: sorted({r.shape for r in rules if kinds[r.action] == kind}) for kind in kinds.values()}
    candidates = {f"{kind}{a}.{b}": F.concat(F.lit(kind), rule_key(F.col("host"), F.col("path"), (a, b))) for kind in shapes for a, b in shapes[kind]}
    labels = listed.filter("key like 'h:%'").select(F.size(F.split("key", r"\.")).alias("n")).distinct()
    for x in sorted(r.n for r in labels.collect()):  # a host has 127 labels at most
        candidates[f"h:{x}"] = F.concat(F.lit("h:"), host_suffix(F.col("host"), x))
    universe = rows.select(F.explode(F.array_compact(F.array(*candidates.values()))).alias("key")).distinct() if candidates else listed.limit(0)
    cascade = Cascade(written(universe), listed)
    found = {name: F.when(cascade.listed(key), key) for name, key in candidates.items()}
    rank = lambda name, c: F.when(c.isNotNull(), F.struct(F.length(c).alias("n"), F.lit(int(name[2:].split(".")[0])).alias("labels"), c.alias("key")))
    fitting = F.array_compact(F.array(*(rank(name, c) for name, c in found.items() if name[0] != "h")))
    by_host = F.lit(False)
    for name, c in found.items():
        if name[0] == "h":
            by_host = by_host | c.isNotNull()
    out = rows.select("id", "host", "path", (F.array_max(fitting)["key"] if rules else F.lit(None).cast("string")).alias("best"), by_host.alias("by_list"))
    verdict = F.when(F.col("best").isNotNull(), F.when(F.col("best").startswith("b:"), "block").otherwise("allow")).when(F.col("by_list"), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", F.expr("substring(best, 3)").alias("rule"), verdict.alias("verdict"), "by_list")


RULES = ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")
#: Hosts with a label of which a hyphen-separated part is one of these words are listed as blocked.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")


def suspicious_hosts(pages: DataFrame, words: tuple[str, ...] = LISTED_WORDS, url_col: str = "url") -> DataFrame:
    """Distinct hosts of the pages with a hyphenated label that holds one of the words."""
    host, _ = url_parts(F.col(url_col))
    alternatives = "|".join(words)
    return pages.select(host.alias("key")).distinct().filter(F.col("key").rlike(rf"(^|[.-])({alternatives})-|-({alternatives})([.-]|$)"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every url of `pages`: by the longest rule that fits, else by the cascade."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, [parse_rule(x) for x in RULES], suspicious_hosts(pages))


OP2_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(rule, host, path, action) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
judged AS (
  SELECT p.*, (SELECT max(length(r.rule)) FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS n FROM parts p),
named AS (
  SELECT j.*, r.rule, r.action,
         regexp_matches(j.host, '(^|[.-])(ads|adult|bets|casino|pills|spam)-|-(ads|adult|bets|casino|pills|spam)([.-]|$)') AS by_list
  FROM judged j LEFT JOIN rules r ON length(r.rule) = j.n AND (j.host = r.host OR ends_with(j.host, '.' || r.host)) AND starts_with(j.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN by_list THEN 'block' ELSE 'allow' END) AS verdict, by_list FROM named
"""
