"""Queries of composition, features and sets over line items (walks) and parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayloom.operators import composition as c
from wayloom.operators import sets as s
from wayloom.operators.lineage import checkpoint

from .registry import query
from .views import PARTS, WALKS, parts, table, walks

NET = """net AS (SELECT zone, rc, sum(length_m) AS network_m, sum(length_m) / sum(sum(length_m)) OVER () AS q FROM parts WHERE NOT connector GROUP BY zone, rc)"""
VEC = f"""{PARTS}, {WALKS}, {NET}, vec AS (SELECT route_id, zone, rc, sum(w.length_m) AS length_m FROM walks w JOIN parts p USING (part_id) WHERE NOT connector GROUP BY ALL)"""
GAP = f"""{VEC}, dense AS (SELECT r.route_id, n.zone, n.rc, n.q, coalesce(v.length_m, 0) AS v FROM (SELECT DISTINCT route_id FROM vec) r CROSS JOIN net n LEFT JOIN vec v USING (route_id, zone, rc)),
gap AS (SELECT route_id, 0.5 * sum(abs(q - share)) AS d FROM (SELECT *, v / sum(v) OVER (PARTITION BY route_id) AS share FROM dense) GROUP BY route_id)"""


def vectors(spark, sf_dir):
    return c.route_cells(walks(spark, sf_dir), parts(spark, sf_dir))


def gaps(spark, sf_dir):
    return c.gap(vectors(spark, sf_dir), c.network_cells(parts(spark, sf_dir)), "route_id")


def rnd(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@query(f"WITH {VEC} SELECT route_id, zone, rc, round(length_m, 3) AS length_m FROM vec")
def route_cell_vector(spark, sf_dir):
    return vectors(spark, sf_dir).select("route_id", "zone", "rc", rnd("length_m", 3))


@query(f"WITH {GAP} SELECT route_id, round(d, 9) AS d FROM gap")
def composition_gap_d(spark, sf_dir):
    return gaps(spark, sf_dir).select("route_id", rnd("d", 9))


@query(f"""WITH {VEC}, zq AS (SELECT *, network_m / sum(network_m) OVER (PARTITION BY zone) AS qz FROM net),
dense AS (SELECT r.route_id, n.zone, n.rc, n.qz, coalesce(v.length_m, 0) AS v FROM (SELECT DISTINCT route_id, zone FROM vec) r JOIN zq n USING (zone) LEFT JOIN vec v USING (route_id, zone, rc))
SELECT route_id, zone, round(0.5 * sum(abs(qz - share)), 9) AS d FROM (SELECT *, v / sum(v) OVER (PARTITION BY route_id, zone) AS share FROM dense) GROUP BY route_id, zone""")
def domain_and_zone_d(spark, sf_dir):
    return c.gap(vectors(spark, sf_dir), c.network_cells(parts(spark, sf_dir)), "route_id", within="zone").select("route_id", "zone", rnd("d", 9))


@query(f"""WITH {PARTS}, {WALKS}, {NET}, passes AS (SELECT w.part_id, p.zone, p.rc, w.length_m, p.length_m AS full_m FROM walks w JOIN parts p USING (part_id) WHERE NOT connector),
t AS (SELECT zone, rc, sum(length_m) AS traversed_m FROM passes GROUP BY ALL), u AS (SELECT zone, rc, sum(full_m) AS unique_m FROM (SELECT DISTINCT part_id, zone, rc, full_m FROM passes) GROUP BY ALL)
SELECT zone, rc, round(network_m, 2) AS network_m, round(coalesce(traversed_m, 0), 2) AS traversed_m, round(coalesce(unique_m, 0), 2) AS unique_m, round(q, 9) AS q,
  round(coalesce(traversed_m, 0) / sum(traversed_m) OVER (), 9) AS share, round(coalesce(unique_m, 0) / network_m, 9) AS coverage, round(coalesce(traversed_m, 0) / sum(traversed_m) OVER () - q, 9) AS gap
FROM net LEFT JOIN t USING (zone, rc) LEFT JOIN u USING (zone, rc)""")
def composition_matrix(spark, sf_dir):
    return c.composition_matrix(walks(spark, sf_dir), parts(spark, sf_dir)).select("zone", "rc", rnd("network_m", 2), rnd("traversed_m", 2), rnd("unique_m", 2), rnd("q", 9), rnd("share", 9), rnd("coverage", 9), rnd("gap", 9))


@query(f"""WITH {PARTS}, {WALKS} SELECT route_id, round(sum(length_m), 2) AS unique_m, round(sum(length_m) / (SELECT sum(length_m) FROM parts WHERE NOT connector), 9) AS fraction
FROM (SELECT DISTINCT w.route_id, p.part_id, p.length_m FROM walks w JOIN parts p USING (part_id) WHERE NOT connector) GROUP BY route_id""")
def unique_coverage(spark, sf_dir):
    road = parts(spark, sf_dir).filter("not connector")
    total = road.agg(F.sum("length_m")).scalar()
    own = c.unique_parts(walks(spark, sf_dir)).join(road.select("part_id", "length_m"), "part_id").groupBy("route_id").agg(F.sum("length_m").alias("m"))
    return own.select("route_id", F.round("m", 2).alias("unique_m"), F.round(F.col("m") / total, 9).alias("fraction"))


@query(f"""WITH {PARTS}, {WALKS}, own AS (SELECT DISTINCT w.route_id, p.part_id, p.length_m FROM walks w JOIN parts p USING (part_id)), len AS (SELECT route_id, sum(length_m) AS m FROM own GROUP BY route_id),
pairs AS (SELECT a.route_id AS "left", b.route_id AS "right", sum(a.length_m) AS common_m FROM own a JOIN own b USING (part_id) WHERE a.route_id < b.route_id GROUP BY ALL)
SELECT p."left", p."right", round(common_m, 2) AS common_m, round(common_m / least(x.m, y.m), 9) AS fraction FROM pairs p JOIN len x ON x.route_id = p."left" JOIN len y ON y.route_id = p."right" """)
def route_pair_overlap(spark, sf_dir):
    return c.pair_overlap(walks(spark, sf_dir), parts(spark, sf_dir)).select("left", "right", rnd("common_m", 2), rnd("fraction", 9))


@query(f"""WITH {PARTS}, {WALKS}, own AS (SELECT DISTINCT w.route_id, p.part_id, p.length_m FROM walks w JOIN parts p USING (part_id)), len AS (SELECT route_id, sum(length_m) AS m FROM own GROUP BY route_id),
pairs AS (SELECT a.route_id AS l, b.route_id AS r, sum(a.length_m) AS m FROM own a JOIN own b USING (part_id) WHERE a.route_id < b.route_id GROUP BY ALL),
f AS (SELECT pairs.m / least(x.m, y.m) AS fraction FROM pairs JOIN len x ON x.route_id = l JOIN len y ON y.route_id = r)
SELECT threshold, count(*) FILTER (fraction >= threshold) AS n FROM f, (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.7::DOUBLE)) t(threshold) GROUP BY threshold""")
def overlap_review_filter(spark, sf_dir):
    pairs, levels = c.pair_overlap(walks(spark, sf_dir), parts(spark, sf_dir)), (0.02, 0.05, 0.1, 0.7)
    counts = pairs.agg(*(F.count_if(F.col("fraction") >= t).alias(f"n{i}") for i, t in enumerate(levels)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n")) for i, t in enumerate(levels)))).alias("x")).select("x.*")


@query(f"WITH {WALKS} SELECT count(*) - count(DISTINCT parts) AS n_duplicates FROM (SELECT route_id, string_agg(part_id::VARCHAR, ',' ORDER BY part_id) AS parts FROM (SELECT DISTINCT route_id, part_id FROM walks) GROUP BY route_id)")
def duplicate_corridors(spark, sf_dir):
    digest = F.sha2(F.array_join(F.array_sort(F.collect_set("part_id")).cast("array<string>"), ","), 256)
    sets = walks(spark, sf_dir).groupBy("route_id").agg(digest.alias("parts"))
    return sets.agg((F.count(F.lit(1)) - F.count_distinct("parts")).alias("n_duplicates"))


@query(f"""WITH {PARTS}, m AS (SELECT rc, quantile_cont(lanes, 0.5) AS med FROM parts GROUP BY rc) SELECT part_id, lanes, coalesce(lanes, med, (SELECT quantile_cont(lanes, 0.5) FROM parts)) AS model FROM parts LEFT JOIN m USING (rc)""")
def median_imputation(spark, sf_dir):
    return c.median_filled(parts(spark, sf_dir), "lanes", "rc").select("part_id", "lanes", "model")


FEATURES = f"""{PARTS}, {WALKS}, feat AS (SELECT route_id, count(DISTINCT part_id) AS n_parts, sum(lanes * w.length_m) / sum(w.length_m) FILTER (lanes IS NOT NULL) AS lanes, coalesce(sum(w.length_m) FILTER (lanes IS NOT NULL) / sum(w.length_m), 0) AS known_fraction,
  coalesce(sum(w.length_m) FILTER (rc = 'RC1'), 0) / sum(w.length_m) AS share_RC1, coalesce(sum(w.length_m) FILTER (rc = 'RC2'), 0) / sum(w.length_m) AS share_RC2 FROM walks w JOIN parts p USING (part_id) GROUP BY route_id),
long AS (SELECT route_id, 'lanes' AS feature, lanes AS value FROM feat UNION ALL SELECT route_id, 'known', known_fraction FROM feat UNION ALL SELECT route_id, 'rc1', share_RC1 FROM feat UNION ALL SELECT route_id, 'one', 1.0 FROM feat)"""


def long_features(spark, sf_dir):
    f = c.route_features(walks(spark, sf_dir), parts(spark, sf_dir))
    pairs = {"lanes": F.col("lanes"), "known": F.col("known_fraction"), "rc1": F.col("share_RC1"), "one": F.lit(1.0)}
    return f.select("route_id", F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in pairs.items()))).alias("x")).select("route_id", "x.*")


@query(f"WITH {FEATURES} SELECT route_id, n_parts, round(lanes, 7) AS lanes, round(known_fraction, 7) AS known_fraction, round(share_RC1, 7) AS share_RC1, round(share_RC2, 7) AS share_RC2 FROM feat")
def route_features(spark, sf_dir):
    return c.route_features(walks(spark, sf_dir), parts(spark, sf_dir)).select("route_id", "n_parts", rnd("lanes", 7), rnd("known_fraction", 7), rnd("share_RC1", 7), rnd("share_RC2", 7))


@query(f"""WITH {FEATURES}, w AS (SELECT *, min(value) OVER p AS lo, max(value) OVER p AS hi, avg(value) OVER p AS m, stddev_pop(value) OVER p AS sd FROM long WINDOW p AS (PARTITION BY feature))
SELECT route_id, feature, round((value - lo) / (hi - lo), 6) AS minmax, round((value - m) / sd, 5) AS z FROM w WHERE hi - lo > 1e-12""")
def minmax_zscore(spark, sf_dir):
    return c.scaled(long_features(spark, sf_dir)).select("route_id", "feature", rnd("minmax", 6), rnd("z", 5))


@query(f"""WITH {FEATURES}, r AS (SELECT route_id, feature, round(value, 9) AS value FROM long), q AS (SELECT feature, list_distinct(quantile_cont(value, [0.25, 0.5, 0.75])) AS cuts FROM r GROUP BY feature)
SELECT route_id, feature, CAST(len([x FOR x IN cuts IF x <= value]) AS INT) AS bin FROM r JOIN q USING (feature)""")
def quartile_bins(spark, sf_dir):
    rows = long_features(spark, sf_dir).withColumn("value", F.round("value", 9))
    return c.quartile_groups(rows).select("route_id", "feature", "bin")


@query("""WITH x AS (SELECT p_partkey, p_brand, p_size FROM part) SELECT p_partkey, round(CASE WHEN count(*) OVER b = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / (count(*) OVER b - 1) END, 9) AS midrank FROM x WINDOW b AS (PARTITION BY p_brand)""")
def midrank(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(c.midrank("p_size", "p_brand"), 9).alias("midrank"))


@query(f"""WITH {PARTS} SELECT abs(sum(CASE WHEN lvl = 'zone' THEN m END) - sum(CASE WHEN lvl = 'cell' THEN m END)) <= 0.01 AS agrees, count(*) AS n_groups FROM (
SELECT 'zone' AS lvl, sum(length_m) AS m FROM parts GROUP BY zone UNION ALL SELECT 'cell', sum(length_m) FROM parts GROUP BY zone, rc)""")
def partition_reconciliation(spark, sf_dir):
    p = parts(spark, sf_dir)
    both = p.groupBy("zone").agg(F.sum("length_m").alias("m")).select(F.lit("zone").alias("lvl"), "m").union(p.groupBy("zone", "rc").agg(F.sum("length_m").alias("m")).select(F.lit("cell").alias("lvl"), "m"))
    total = lambda x: F.sum(F.when(F.col("lvl") == x, F.col("m")))
    return both.agg((F.abs(total("zone") - total("cell")) <= 0.01).alias("agrees"), F.count(F.lit(1)).alias("n_groups"))


@query(f"""WITH {PARTS}, grid AS (SELECT z.zone, r.rc FROM (VALUES ('A'), ('B'), ('C')) z(zone), (VALUES ('RC1'), ('RC2'), ('RC3'), ('RC4')) r(rc)),
e AS (SELECT zone, rc, sum(length_m) AS m FROM parts WHERE NOT connector AND lanes IS NOT NULL GROUP BY ALL) SELECT zone, rc, round(coalesce(m, 0), 2) AS eligible_m, CASE WHEN coalesce(m, 0) > 0 THEN 'available' ELSE 'unavailable' END AS status FROM grid LEFT JOIN e USING (zone, rc)""")
def eligible_routing_matrix(spark, sf_dir):
    p = parts(spark, sf_dir)
    grid = spark.createDataFrame([(z, f"RC{r}") for z in "ABC" for r in range(1, 5)], "zone string, rc string")
    sums = p.filter("not connector and lanes is not null").groupBy("zone", "rc").agg(F.sum("length_m").alias("m"))
    m = F.coalesce("m", F.lit(0.0))
    return grid.join(sums, ["zone", "rc"], "left").select("zone", "rc", F.round(m, 2).alias("eligible_m"), F.when(m > 0, "available").otherwise("unavailable").alias("status"))


@query(f"""WITH {VEC} SELECT route_id, round(coalesce(sum(v.length_m) FILTER (zone = CASE route_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AND rc = 'RC' || CAST(route_id % 4 + 1 AS VARCHAR)), 0) / sum(v.length_m), 9) AS purity FROM vec v GROUP BY route_id""")
def target_purity(spark, sf_dir):
    r = F.col("route_id")
    target = (F.col("zone") == F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (r % 3 + 1).cast("int"))) & (F.col("rc") == F.concat(F.lit("RC"), (r % 4 + 1).cast("string")))
    return vectors(spark, sf_dir).groupBy("route_id").agg(F.round(F.try_divide(F.sum(F.when(target, F.col("length_m")).otherwise(0.0)), F.sum("length_m")), 9).alias("purity"))


@query(f"""WITH {PARTS}, {WALKS}, passes AS (SELECT route_id, p.zone, p.rc, w.length_m, connector FROM walks w JOIN parts p USING (part_id)), full_m AS (SELECT route_id, sum(length_m) AS m FROM passes GROUP BY route_id),
v AS (SELECT route_id, zone, rc, sum(length_m) AS m FROM passes WHERE NOT connector GROUP BY ALL) SELECT v.zone, v.rc, bool_or(v.m / f.m >= 0.12) AS material, bool_or(v.m > 0) AS reachable, count(*) AS n_routes FROM v JOIN full_m f USING (route_id) GROUP BY v.zone, v.rc""")
def set_cell_matrix(spark, sf_dir):
    w, p = walks(spark, sf_dir), parts(spark, sf_dir)
    full = w.join(p.select("part_id"), "part_id").groupBy("route_id").agg(F.sum("length_m").alias("full_m"))
    rows = c.route_cells(w, p).join(full, "route_id")
    return rows.groupBy("zone", "rc").agg(F.bool_or(F.col("length_m") / F.col("full_m") >= 0.12).alias("material"), F.bool_or(F.col("length_m") > 0).alias("reachable"), F.count(F.lit(1)).alias("n_routes"))


SETS = f"""{GAP}, cand AS (SELECT s_suppkey AS route_id, CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS bucket FROM supplier), quota(bucket, slots) AS (VALUES ('A', 3), ('B', 2), ('C', 4)),
draws AS (SELECT cand.*, slots, g.sample_id, (((((((((((17::BIGINT * 48271 + 7 + 1) * 69621) % 2147483647) * 48271 + g.sample_id + 1) * 69621) % 2147483647) * 48271 + 0 + 1) * 69621) % 2147483647) * 48271 + cand.route_id + 1) * 69621) % 2147483647 AS h0 FROM cand JOIN quota USING (bucket) CROSS JOIN (SELECT unnest(range(0, 200)) AS sample_id) g),
h1 AS (SELECT *, (h0 * h0 + 7 * h0 + 12345) % 2147483647 AS x1 FROM draws), h2 AS (SELECT *, (x1 * x1 + 7 * x1 + 12345) % 2147483647 AS x2 FROM h1), h3 AS (SELECT *, (x2 * x2 + 7 * x2 + 12345) % 2147483647 AS h FROM h2),
sets AS (SELECT sample_id, bucket, route_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, bucket ORDER BY h, route_id) AS r FROM h3) WHERE r <= slots),
setvec AS (SELECT sample_id, zone, rc, sum(length_m) AS length_m FROM sets JOIN vec USING (route_id) GROUP BY ALL), setdense AS (SELECT i.sample_id, n.zone, n.rc, n.q, n.q / sum(n.q) OVER (PARTITION BY i.sample_id, n.zone) AS qz, coalesce(v.length_m, 0) AS v FROM (SELECT DISTINCT sample_id FROM setvec) i CROSS JOIN net n LEFT JOIN setvec v USING (sample_id, zone, rc)),
setshare AS (SELECT *, v / sum(v) OVER (PARTITION BY sample_id) AS share, sum(v) OVER (PARTITION BY sample_id, zone) AS zm FROM setdense),
domains AS (SELECT sample_id, zone, 0.5 * sum(abs(qz - v / zm)) AS d FROM setshare WHERE zm > 0 GROUP BY ALL),
scores AS (SELECT * FROM (SELECT sample_id, 0.5 * sum(abs(q - share)) AS value, sum(v) AS length_m FROM setshare GROUP BY sample_id) JOIN (SELECT sample_id, avg(d) AS top FROM domains GROUP BY sample_id) USING (sample_id)),
base AS (SELECT value AS v, length_m AS base_m FROM scores WHERE sample_id = 0)"""


QUOTA = {"A": 3, "B": 2, "C": 4}


def candidates(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("route_id"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("bucket"))


def drawn(spark, sf_dir):
    return s.sampled_sets(candidates(spark, sf_dir), 200, spark.createDataFrame(list(QUOTA.items()), "bucket string, slots int"), seed=7)


def scores(spark, sf_dir):
    """Of each set: D of its summed vectors (value), the mean of D over the domains it reaches (top), traversed length."""
    return s.scored(drawn(spark, sf_dir), checkpoint(vectors(spark, sf_dir)), checkpoint(c.network_cells(parts(spark, sf_dir))))


def baseline(spark, sf_dir, column: str = "value"):
    """A figure of the chosen set (number 0)."""
    return scores(spark, sf_dir).filter("sample_id = 0").select(column).scalar()


TRIES = f"""{GAP}, cand AS (SELECT s_suppkey AS route_id, CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS bucket, 'S' || s_nationkey % 3 AS stratum FROM supplier), quota(bucket, slots) AS (VALUES ('A', 3), ('B', 2), ('C', 4)),
draws AS (SELECT cand.*, slots, g.sample_id, t.attempt, (((((((((((17::BIGINT * 48271 + 7 + 1) * 69621) % 2147483647) * 48271 + g.sample_id + 1) * 69621) % 2147483647) * 48271 + t.attempt + 1) * 69621) % 2147483647) * 48271 + cand.route_id + 1) * 69621) % 2147483647 AS h0 FROM cand JOIN quota USING (bucket) CROSS JOIN (SELECT unnest(range(0, 100)) AS sample_id) g CROSS JOIN (SELECT unnest(range(0, 6)) AS attempt) t),
h1 AS (SELECT *, (h0 * h0 + 7 * h0 + 12345) % 2147483647 AS x1 FROM draws), h2 AS (SELECT *, (x1 * x1 + 7 * x1 + 12345) % 2147483647 AS x2 FROM h1), h3 AS (SELECT *, (x2 * x2 + 7 * x2 + 12345) % 2147483647 AS h FROM h2),
tried AS (SELECT sample_id, attempt, bucket, route_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, attempt, bucket ORDER BY h, route_id) AS r FROM h3) WHERE r <= slots),
own AS (SELECT DISTINCT w.route_id, p.part_id, p.length_m FROM walks w JOIN parts p USING (part_id)), len AS (SELECT route_id, sum(length_m) AS m FROM own GROUP BY route_id),
pairs AS (SELECT a.route_id AS l, b.route_id AS r, sum(a.length_m) AS m FROM own a JOIN own b USING (part_id) WHERE a.route_id < b.route_id GROUP BY ALL), f AS (SELECT l, r, pairs.m / least(x.m, y.m) AS fraction FROM pairs JOIN len x ON x.route_id = l JOIN len y ON y.route_id = r),
tops AS (SELECT a.sample_id, a.attempt, max(fraction) AS top FROM tried a JOIN tried b ON a.sample_id = b.sample_id AND a.attempt = b.attempt AND a.route_id < b.route_id JOIN f ON l = a.route_id AND r = b.route_id GROUP BY ALL),
judged AS (SELECT t.sample_id, t.attempt, CASE WHEN count(*) < 9 THEN 'insufficient' WHEN count(DISTINCT stratum) < 3 THEN 'required_strata' WHEN coalesce(max(top), 0) >= 0.28 THEN 'overlap' END AS reason, string_agg(t.route_id::VARCHAR, ';' ORDER BY t.route_id) AS routes FROM tried t LEFT JOIN tops USING (sample_id, attempt) GROUP BY t.sample_id, t.attempt),
first_ok AS (SELECT sample_id, min(attempt) AS ok FROM judged WHERE reason IS NULL GROUP BY sample_id)"""


@query(f"WITH {TRIES} SELECT j.sample_id, j.attempt::INT AS attempt, reason, CASE WHEN reason IS NULL THEN routes END AS routes FROM judged j LEFT JOIN first_ok USING (sample_id) WHERE ok IS NULL OR j.attempt <= ok")
def stratified_set_sampling(spark, sf_dir):
    """A hundred random sets with all strata and a cap on overlap: every attempt with its reason, and the routes of the accepted ones."""
    pool = candidates(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("route_id"), F.concat(F.lit("S"), (F.col("s_nationkey") % 3).cast("string")).alias("stratum")), "route_id")
    own = c.unique_parts(walks(spark, sf_dir)).join(parts(spark, sf_dir).select("part_id", "length_m"), "part_id")
    quota = spark.createDataFrame(list(QUOTA.items()), "bucket string, slots int")
    found, attempts = s.accepted_sets(pool, 100, quota, 7, ["S0", "S1", "S2"], own, 0.28, 6)
    routes = found.groupBy("sample_id", "attempt").agg(F.array_join(F.array_sort(F.collect_list("route_id")).cast("array<string>"), ";").alias("routes"))
    return attempts.join(routes, ["sample_id", "attempt"], "left")


@query(f"""WITH {SETS} SELECT count(*) AS n, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS sd, round(min(value), 8) AS "min", round(quantile_cont(value, 0.025), 8) AS q025, round(quantile_cont(value, 0.25), 8) AS q25, round(quantile_cont(value, 0.5), 8) AS median, round(quantile_cont(value, 0.75), 8) AS q75, round(quantile_cont(value, 0.975), 8) AS q975, round(max(value), 8) AS "max" FROM scores""")
def distribution_summary(spark, sf_dir):
    return s.distribution(scores(spark, sf_dir)).select("n", *(rnd(x, 8) for x in ("mean", "sd", "min", "q025", "q25", "median", "q75", "q975", "max")))


@query(f"""WITH {SETS}, x AS (SELECT 'all' AS scope, value FROM scores UNION ALL SELECT 'length_matched', value FROM scores, base WHERE abs(length_m / base_m - 1) <= 0.1)
SELECT scope, count(*) FILTER (value < v - 1e-9) AS below, count(*) FILTER (abs(value - v) <= 1e-9) AS tied, count(*) FILTER (value <= v + 1e-9) AS not_above, count(*) AS n FROM x, base GROUP BY scope""")
def baseline_comparison(spark, sf_dir):
    """Sets below, tied with and not above the chosen one, over all sets and over those of like length."""
    rows = checkpoint(scores(spark, sf_dir))
    base = lambda name: rows.filter("sample_id = 0").select(name).scalar()
    like = F.abs(F.col("length_m") / base("length_m") - 1) <= 0.1
    scoped = rows.select("value", F.explode(F.array_compact(F.array(F.lit("all"), F.when(like, "length_matched")))).alias("scope"))
    return s.against_baseline(scoped, base("value"), 1e-9, "scope")


@query(f"WITH {SETS} SELECT c.route_id, count(s.sample_id) AS selected_count, round(count(s.sample_id) / 200.0, 6) AS selected_fraction FROM cand c LEFT JOIN sets s USING (route_id) GROUP BY c.route_id")
def route_frequency(spark, sf_dir):
    routes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("route_id"))
    n = F.count("sample_id")
    return routes.join(drawn(spark, sf_dir), "route_id", "left").groupBy("route_id").agg(n.alias("selected_count"), F.round(n / 200.0, 6).alias("selected_fraction"))


@query(f"WITH {SETS}, n AS (SELECT least(19, CAST(floor(round(value * 20, 9)) AS INT)) AS bin, count(*) AS n FROM scores GROUP BY 1) SELECT CAST(g.bin AS INT) AS bin, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / sum(n) OVER (), 6) AS percent FROM (SELECT unnest(range(0, 20)) AS bin) g LEFT JOIN n USING (bin)")
def fixed_histogram(spark, sf_dir):
    return s.fixed_histogram(scores(spark, sf_dir), 20).select("bin", "n", rnd("percent"))


@query(f"WITH {SETS} SELECT count(*) AS n, round(regr_slope(value, top), 6) AS slope, round(regr_intercept(value, top), 6) AS intercept, round(regr_r2(value, top), 6) AS r2 FROM scores")
def linear_fit(spark, sf_dir):
    return s.linear_fit(scores(spark, sf_dir), "top", "value").select("n", rnd("slope"), rnd("intercept"), rnd("r2"))


COMPARED = """a AS (SELECT sample_id, list(route_id) AS ids FROM sets GROUP BY sample_id), b AS (SELECT ids AS base_ids FROM a WHERE sample_id = 0),
compared AS (SELECT sample_id, len(ids) AS n, len(list_intersect(ids, base_ids)) AS retained, len(list_intersect(ids, base_ids)) / (len(ids) + len(base_ids) - len(list_intersect(ids, base_ids)))::DOUBLE AS jaccard FROM a, b)"""


@query(f"""WITH {SETS}, {COMPARED}, need AS (SELECT sum(slots) AS slots FROM quota)
SELECT sample_id // 20 AS family, count(*) AS total, count(*) FILTER (n = slots) AS done, count(*) FILTER (n < slots) AS infeasible, count(*) FILTER (jaccard = 1) AS unchanged, CAST(min(retained) AS INT) AS min_retained, round(min(jaccard), 8) AS min_jaccard, round(min(value), 8) AS min_d, round(max(value), 8) AS max_d
FROM scores JOIN compared USING (sample_id), need GROUP BY 1""")
def family_summary(spark, sf_dir):
    """Runs of each family against the chosen set: done, infeasible (slots left open), unchanged, least kept, extremes of D."""
    sets = checkpoint(drawn(spark, sf_dir)).groupBy("sample_id").agg(F.collect_list("route_id").alias("ids"))
    rows = sets.withColumn("base", sets.filter("sample_id = 0").select("ids").scalar()).withColumn("retained", F.size(F.array_intersect("ids", "base")))
    rows = rows.withColumn("jaccard", F.col("retained") / F.size(F.array_union("ids", "base"))).join(scores(spark, sf_dir), "sample_id")
    n, slots = F.count(F.lit(1)), sum(QUOTA.values())
    return rows.groupBy(F.floor(F.col("sample_id") / 20).alias("family")).agg(
        n.alias("total"), F.count_if(F.size("ids") == slots).alias("done"), F.count_if(F.size("ids") < slots).alias("infeasible"), F.count_if(F.col("jaccard") == 1).alias("unchanged"),
        F.min("retained").alias("min_retained"), F.round(F.min("jaccard"), 8).alias("min_jaccard"), F.round(F.min("value"), 8).alias("min_d"), F.round(F.max("value"), 8).alias("max_d"),
    )


@query(f"WITH {SETS}, f AS (SELECT sample_id // 20 AS family, sample_id, route_id FROM sets), n AS (SELECT family, count(DISTINCT sample_id) AS n_sets FROM f GROUP BY family) SELECT family, route_id FROM f JOIN n USING (family) GROUP BY family, route_id, n_sets HAVING count(*) = n_sets")
def common_core(spark, sf_dir):
    """Routes that every set of a family holds."""
    rows = checkpoint(drawn(spark, sf_dir)).withColumn("family", F.floor(F.col("sample_id") / 20))
    sets = rows.groupBy("family").agg(F.count_distinct("sample_id").alias("n_sets"))
    return rows.groupBy("family", "route_id").agg(F.count(F.lit(1)).alias("n")).join(sets, "family").filter("n = n_sets").select("family", "route_id")


@query(f"""WITH {SETS}, a AS (SELECT sample_id, list_sort(list(route_id)) AS ids FROM sets GROUP BY sample_id), b AS (SELECT ids AS base FROM a WHERE sample_id = 0)
SELECT sample_id, CAST(len(list_intersect(ids, base)) AS INT) AS retained, round(len(list_intersect(ids, base)) / (len(ids) + len(base) - len(list_intersect(ids, base)))::DOUBLE, 9) AS jaccard,
  array_to_string(list_sort([x FOR x IN base IF NOT list_contains(ids, x)]), ';') AS removed, array_to_string(list_sort([x FOR x IN ids IF NOT list_contains(base, x)]), ';') AS added FROM a, b""")
def set_compare(spark, sf_dir):
    sets = drawn(spark, sf_dir).groupBy("sample_id").agg(F.collect_list("route_id").alias("ids"))
    rows = sets.withColumn("base", sets.filter("sample_id = 0").select("ids").scalar())
    text = lambda x: F.array_join(F.array_sort(x).cast("array<string>"), ";")
    kept = F.size(F.array_intersect("ids", "base"))
    return rows.select("sample_id", kept.alias("retained"), F.round(kept / F.size(F.array_union("ids", "base")), 9).alias("jaccard"), text(F.array_except("base", "ids")).alias("removed"), text(F.array_except("ids", "base")).alias("added"))


@query(f"""WITH {SETS} SELECT sample_id, count(*) = 9 AND count(DISTINCT route_id) = 9 AND count(*) FILTER (bucket = 'A') = 3 AND count(*) FILTER (bucket = 'B') = 2 AS valid FROM sets GROUP BY sample_id""")
def random_set_rules(spark, sf_dir):
    n = lambda b: F.count_if(F.col("bucket") == b)
    return drawn(spark, sf_dir).groupBy("sample_id").agg(((F.count(F.lit(1)) == 9) & (F.count_distinct("route_id") == 9) & (n("A") == 3) & (n("B") == 2)).alias("valid"))


@query(f"""WITH {SETS}, own AS (SELECT DISTINCT w.route_id, p.part_id, p.length_m FROM walks w JOIN parts p USING (part_id)), len AS (SELECT route_id, sum(length_m) AS m FROM own GROUP BY route_id),
pairs AS (SELECT a.route_id AS l, b.route_id AS r, sum(a.length_m) AS m FROM own a JOIN own b USING (part_id) WHERE a.route_id < b.route_id GROUP BY ALL),
f AS (SELECT l, r, pairs.m / least(x.m, y.m) AS fraction FROM pairs JOIN len x ON x.route_id = l JOIN len y ON y.route_id = r),
t AS (SELECT a.sample_id, max(fraction) AS top FROM sets a JOIN sets b ON a.sample_id = b.sample_id AND a.route_id < b.route_id JOIN f ON l = a.route_id AND r = b.route_id GROUP BY a.sample_id)
SELECT s.sample_id, CASE WHEN coalesce(top, 0) >= 0.06 THEN 'overlap' END AS reason FROM (SELECT DISTINCT sample_id FROM sets) s LEFT JOIN t USING (sample_id)""")
def hard_set_constraints(spark, sf_dir):
    members = checkpoint(drawn(spark, sf_dir))
    own = c.unique_parts(walks(spark, sf_dir)).join(parts(spark, sf_dir).select("part_id", "length_m"), "part_id")
    top = s.overlap_within(members, own, "sample_id").groupBy("sample_id").agg(F.max("fraction").alias("top"))
    return members.select("sample_id").distinct().join(top, "sample_id", "left").select("sample_id", F.when(F.coalesce("top", F.lit(0.0)) >= 0.06, "overlap").alias("reason"))


@query(f"""WITH {SETS} SELECT CAST(sample_id AS BIGINT) AS sample_id, round(value, 8) AS value FROM (SELECT *, row_number() OVER (ORDER BY round(value, 10), round(top, 10), sample_id) AS r FROM scores) WHERE r = 1""")
def best_run_lexicographic(spark, sf_dir):
    best = scores(spark, sf_dir).agg(F.min_by(F.struct("sample_id", "value"), F.struct(F.round("value", 10), F.round("top", 10), "sample_id")).alias("b"))
    return best.select("b.sample_id", F.round("b.value", 8).alias("value"))


@query(f"""WITH {SETS}, f AS (SELECT sample_id // 20 AS family, sample_id, value FROM scores), n AS (SELECT *, min(value) OVER (PARTITION BY family) AS least FROM f) SELECT family, min(sample_id) AS sample_id FROM n WHERE value <= least + 0.005 GROUP BY family""")
def argbest_with_tolerance(spark, sf_dir):
    rows = scores(spark, sf_dir).select(F.floor(F.col("sample_id") / 20).alias("family"), "sample_id", "value")
    return s.best_within(rows, "value", "sample_id", 0.005, "family").select("family", "sample_id")


@query(f"""WITH {SETS}, x AS (SELECT sample_id, value, lag(value, 2) OVER (ORDER BY sample_id) AS two FROM scores) SELECT sample_id, round((two - value) / two, 7) AS improvement, (two - value) / two < 0.02 AS flat FROM x WHERE two IS NOT NULL""")
def saturation_lag2(spark, sf_dir):
    rows = scores(spark, sf_dir).withColumn("two", F.lag("value", 2).over(Window.orderBy("sample_id"))).filter("two is not null")
    gain = (F.col("two") - F.col("value")) / F.col("two")
    return rows.select("sample_id", F.round(gain, 7).alias("improvement"), (gain < 0.02).alias("flat"))


@query()
def largest_remainder_quota(spark, sf_dir):
    """Loops of shares under caps; checked against hand values in tests."""
    caps = parts(spark, sf_dir).filter("not connector").groupBy("zone", "rc").agg(F.sum("length_m").alias("length_m"), (F.count(F.lit(1)) % 9).alias("cap"))
    return s.largest_remainder(caps, 10, "zone")


@query(f"""WITH {VEC}, tot AS (SELECT route_id, sum(length_m) AS length_m FROM vec GROUP BY route_id), cand AS (SELECT v.route_id, v.zone, v.rc, v.length_m / t.length_m AS purity, t.length_m FROM vec v JOIN tot t USING (route_id))
SELECT zone, rc, route_id FROM (SELECT *, row_number() OVER (PARTITION BY zone, rc ORDER BY round(purity, 9) DESC, length_m, route_id) AS r FROM cand) WHERE r <= 3""")
def ranked_fill(spark, sf_dir):
    v = vectors(spark, sf_dir)
    total = v.groupBy("route_id").agg(F.sum("length_m").alias("all_m"))
    cand = v.join(total, "route_id").select("route_id", "zone", "rc", F.round(F.col("length_m") / F.col("all_m"), 9).alias("purity"), F.col("all_m").alias("length_m"))
    slots = cand.select("zone", "rc").distinct().withColumn("slots", F.lit(3))
    return s.ranked_fill(cand, slots, ["zone", "rc"]).select("zone", "rc", "route_id")


@query(f"""WITH {SETS}, {FEATURES.replace(f"{PARTS}, {WALKS}, ", "")}, r9 AS (SELECT route_id, feature, round(value, 9) AS value FROM long), cut AS (SELECT feature, list_distinct(quantile_cont(value, [0.25, 0.5, 0.75])) AS cuts FROM r9 GROUP BY feature),
bins AS (SELECT route_id, feature, len([x FOR x IN cuts IF x <= value]) AS bin FROM r9 JOIN cut USING (feature)),
own AS (SELECT DISTINCT w.route_id, p.part_id, p.length_m, p.connector FROM walks w JOIN parts p USING (part_id)), len AS (SELECT route_id, sum(length_m) AS m FROM own GROUP BY route_id),
pairs AS (SELECT a.route_id AS l, b.route_id AS r, sum(a.length_m) AS m FROM own a JOIN own b USING (part_id) WHERE a.route_id < b.route_id GROUP BY ALL),
f AS (SELECT l, r, pairs.m / least(x.m, y.m) AS fraction FROM pairs JOIN len x ON x.route_id = l JOIN len y ON y.route_id = r),
t AS (SELECT a.sample_id, max(fraction) AS top FROM sets a JOIN sets b ON a.sample_id = b.sample_id AND a.route_id < b.route_id JOIN f ON l = a.route_id AND r = b.route_id GROUP BY a.sample_id),
full_m AS (SELECT route_id, sum(w.length_m) AS m FROM walks w JOIN parts USING (part_id) GROUP BY route_id),
counts AS (SELECT sample_id, count(*) AS route_count, count(*) FILTER (bucket = 'A') AS bucket_a, count(*) FILTER (bucket = 'B') AS bucket_b, count(*) FILTER (bucket = 'C') AS bucket_c, sum(m) AS traversed_m FROM sets LEFT JOIN full_m USING (route_id) GROUP BY sample_id),
cells AS (SELECT sample_id, count(DISTINCT (zone, rc)) AS touched_cells, count(DISTINCT (zone, rc)) FILTER (vec.length_m / m >= 0.12) AS material_cells, count(DISTINCT zone) AS represented_strata FROM sets JOIN vec USING (route_id) JOIN full_m USING (route_id) GROUP BY sample_id),
uniq AS (SELECT sample_id, sum(length_m) AS unique_m FROM (SELECT DISTINCT sample_id, part_id, length_m FROM sets JOIN own USING (route_id) WHERE NOT connector) GROUP BY sample_id),
qg AS (SELECT sample_id, count(DISTINCT (feature, bin)) AS quantile_groups FROM sets JOIN bins USING (route_id) GROUP BY sample_id),
wide AS (SELECT sample_id, round(value, 8)::DOUBLE AS d_combined, round(scores.top, 8)::DOUBLE AS d_domain_mean, route_count::DOUBLE AS route_count, bucket_a::DOUBLE AS bucket_a, bucket_b::DOUBLE AS bucket_b, bucket_c::DOUBLE AS bucket_c, round(traversed_m, 3)::DOUBLE AS traversed_m, round(scores.length_m, 3)::DOUBLE AS rc_traversed_m,
  represented_strata::DOUBLE AS represented_strata, material_cells::DOUBLE AS material_cells, touched_cells::DOUBLE AS touched_cells, round(unique_m, 2)::DOUBLE AS unique_rc_m, round(unique_m / (SELECT sum(network_m) FROM net), 8)::DOUBLE AS unique_rc_fraction, quantile_groups::DOUBLE AS quantile_groups, round(coalesce(t.top, 0), 8)::DOUBLE AS max_corridor_overlap
  FROM scores JOIN counts USING (sample_id) JOIN cells USING (sample_id) JOIN uniq USING (sample_id) JOIN qg USING (sample_id) LEFT JOIN t USING (sample_id))
UNPIVOT wide ON COLUMNS(* EXCLUDE (sample_id)) INTO NAME metric VALUE value""")
def set_summary(spark, sf_dir):
    """Every figure of a set in long form; one grouping by set over members, cells, parts and pairs."""
    w, p = walks(spark, sf_dir), parts(spark, sf_dir)
    members, v = checkpoint(drawn(spark, sf_dir)), checkpoint(vectors(spark, sf_dir))
    bins = c.quartile_groups(long_features(spark, sf_dir).withColumn("value", F.round("value", 9)))
    wide = s.summary(members, v, checkpoint(c.network_cells(p)), w, p, bins, 0.12)
    digits = {"d_combined": 8, "d_domain_mean": 8, "traversed_m": 3, "rc_traversed_m": 3, "unique_rc_m": 2, "unique_rc_fraction": 8, "max_corridor_overlap": 8}
    figures = [x for x in wide.columns if x != "sample_id"]
    cells = F.array(*(F.struct(F.lit(x).alias("metric"), (F.round(x, digits[x]) if x in digits else F.col(x)).cast("double").alias("value")) for x in figures))
    return wide.select("sample_id", F.explode(cells).alias("x")).select("sample_id", "x.*")


@query()
def greedy_min_d(spark, sf_dir):
    """Iterative: three problems of candidates at once, four rounds; checked by brute force in tests."""
    v, net = vectors(spark, sf_dir), c.network_cells(parts(spark, sf_dir))
    problems = v.select("route_id").distinct().select((F.col("route_id") % 3).alias("problem_id"), "route_id")
    return s.greedy_gap(checkpoint(v), checkpoint(net), checkpoint(problems), 4, checkpoint)


@query()
def greedy_max_coverage(spark, sf_dir):
    """Iterative: four rounds; checked by brute force in tests."""
    members = c.unique_parts(walks(spark, sf_dir)).join(parts(spark, sf_dir).select("part_id", "length_m"), "part_id")
    return s.greedy_coverage(checkpoint(members), 4, checkpoint)
