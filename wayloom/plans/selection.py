"""Queries of selection: criteria, greedy rounds of many problems, swaps, slots, scenarios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayloom.operators import composition as c
from wayloom.operators import scenarios as sc
from wayloom.operators import selection as sel
from wayloom.operators import sets as s
from wayloom.operators.lineage import stored

from .registry import query
from .sets import FEATURES, QUOTA, SETS, candidates, drawn, rnd, vectors
from .views import PARTS, WALKS, parts, table, walks

RULES = sel.Rules(tuple(QUOTA.items()), ("S0", "S1", "S2"), (), most_corridor=0.29)
DESIGN = sc.Design()
WEIGHTS = DESIGN.weights
FRACTION = 0.12


def network(spark, sf_dir) -> sel.Network:
    """The cells in order, with zones as domains; there are as many as zones and road classes."""
    rows = sorted(c.network_cells(parts(spark, sf_dir)).select("zone", "rc", "network_m").collect())
    return sel.Network(tuple(r.network_m for r in rows), tuple(r.zone for r in rows))


def passed(spark, sf_dir):
    """Each route's parts once, with the times and the length they are passed: line items are read and joined only here."""
    p = parts(spark, sf_dir).withColumnRenamed("length_m", "part_m")
    once = walks(spark, sf_dir).groupBy("route_id", "part_id").agg(F.count(F.lit(1)).alias("n"), F.sum("length_m").alias("length_m"))
    return stored(once.join(p, "part_id"))


def routes(spark, sf_dir, own=None):
    """Routes with everything that doesn't depend on a case: dense vectors, shares, lengths, features; own: passed()."""
    p, own = parts(spark, sf_dir), own if own is not None else passed(spark, sf_dir)
    cells = F.array_sort(F.collect_list(F.struct("zone", "rc")))
    grid = c.network_cells(p).agg(cells.alias("g")).scalar()
    full = own.groupBy("route_id").agg(F.sum("length_m").alias("walk_m"), F.sum(F.col("n") * F.col("part_m")).alias("full_m"), F.sum("part_m").alias("unique_m"))
    lengths = own.filter("not connector").groupBy("route_id", "zone", "rc").agg(F.sum("length_m").alias("length_m"))
    vector = lengths.groupBy("route_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "zone", "rc"), "length_m"))).alias("m"))
    dense = vector.withColumn("g", grid).select("route_id", F.transform("g", lambda x: F.coalesce(F.element_at("m", F.concat_ws("|", x["zone"], x["rc"])), F.lit(0.0))).alias("v"))
    known = c.feature_sums(own)
    features = known.select("route_id", F.col("known_fraction").alias("known"), F.array(*(F.struct(F.lit(n).alias("feature"), v.cast("double").alias("value")) for n, v in (("lanes", F.col("lanes")), ("speed", 30 + 40 * F.col("share_RC1")), ("known", F.col("known_fraction")), ("rc2", F.col("share_RC2"))))).alias("features"))
    k = F.col("s_suppkey")
    named = table(spark, sf_dir, "supplier").select(k.alias("route_id"), F.concat(F.lit("S"), (F.col("s_nationkey") % 3).cast("string")).alias("stratum"), F.concat(F.lit("RC"), (k % 4 + 1).cast("string")).alias("rc"), F.when(k % 4 != 0, k % 6).cast("double").alias("c6"))
    rows = candidates(spark, sf_dir).join(named, "route_id").join(full, "route_id").join(dense, "route_id").join(features, "route_id")
    return rows.withColumn("p", F.transform("v", lambda x: x / F.col("walk_m"))).drop("walk_m")


def route_parts(own):
    return own.select("route_id", "part_id", F.col("part_m").alias("length_m"))


def base_case(spark):
    """The one case of a plain selection."""
    return sc.case_table(spark, [sc.Case(0, "baseline", "baseline", WEIGHTS, fraction=FRACTION)])


def base_pool(spark, sf_dir):
    """Pool, parts and cases of the baseline alone."""
    once, cases = passed(spark, sf_dir), base_case(spark)
    own = stored(routes(spark, sf_dir, once))
    pool = sc.fitted(own, sc.per_route(own.select("route_id"), cases, [], DESIGN), cases, DESIGN)
    return stored(pool), route_parts(once), cases


def open_problems(spark, sf_dir, n_open: int):
    """The drawn sets without their n_open largest ids, as problems with slots left."""
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("route_id")))
    members = stored(drawn(spark, sf_dir).withColumn("r", rank).filter(F.col("r") > n_open).select(F.col("sample_id").alias("problem_id"), "route_id"))
    return members.select("problem_id").distinct().withColumn("scenario", F.lit("baseline")), members


POOL = f"""{SETS}, {FEATURES.replace(f"{PARTS}, {WALKS}, ", "")},
fl AS (SELECT route_id, 'lanes' AS feature, lanes AS value FROM feat UNION ALL SELECT route_id, 'speed', 30 + 40 * share_RC1 FROM feat UNION ALL SELECT route_id, 'known', known_fraction FROM feat UNION ALL SELECT route_id, 'rc2', share_RC2 FROM feat),
clipped AS (SELECT route_id, feature, CASE feature WHEN 'lanes' THEN greatest(1, least(8, value)) WHEN 'speed' THEN greatest(10, least(90, value)) ELSE value END AS value FROM fl),
mm AS (SELECT route_id, feature, (value - lo) / (hi - lo) AS x FROM (SELECT *, min(value) OVER (PARTITION BY feature) AS lo, max(value) OVER (PARTITION BY feature) AS hi FROM clipped) WHERE hi - lo > 1e-12),
cuts AS (SELECT feature, list_distinct(quantile_cont(round(x, 9), [0.25, 0.5, 0.75])) AS cuts FROM mm GROUP BY feature),
groups AS (SELECT route_id, feature || ':' || len([y FOR y IN cuts IF y <= round(x, 9)]) AS g FROM mm JOIN cuts USING (feature)),
full_l AS (SELECT route_id, sum(w.length_m) AS walk_m, sum(p.length_m) AS full_m FROM walks w JOIN parts p USING (part_id) GROUP BY route_id),
own AS (SELECT DISTINCT w.route_id, p.part_id, p.length_m FROM walks w JOIN parts p USING (part_id)), uniq AS (SELECT route_id, sum(length_m) AS unique_m FROM own GROUP BY route_id),
pool AS (SELECT s_suppkey AS route_id, CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS bucket, 'S' || s_nationkey % 3 AS stratum, 'RC' || (s_suppkey % 4 + 1) AS rc, CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey % 6)::DOUBLE END AS c6, walk_m, full_m, unique_m
  FROM supplier JOIN full_l ON full_l.route_id = s_suppkey JOIN uniq ON uniq.route_id = s_suppkey)"""


def opened(n_open: int) -> str:
    return f"mem AS (SELECT sample_id, route_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY route_id DESC) AS r FROM sets) WHERE r > {n_open}), att AS (SELECT mem.sample_id, pool.* FROM mem JOIN pool USING (route_id))"


FEASIBLE = """used AS (SELECT i.sample_id, b.bucket, b.slots - count(att.route_id) AS room FROM (SELECT DISTINCT sample_id FROM mem) i CROSS JOIN quota b LEFT JOIN att ON att.sample_id = i.sample_id AND att.bucket = b.bucket GROUP BY i.sample_id, b.bucket, b.slots),
opt AS (SELECT i.sample_id, p.route_id, p.bucket, p.stratum FROM (SELECT DISTINCT sample_id FROM mem) i CROSS JOIN pool p ANTI JOIN mem ON mem.sample_id = i.sample_id AND mem.route_id = p.route_id),
room AS (SELECT opt.*, used.bucket AS b, used.room - (used.bucket = opt.bucket)::INT AS room FROM opt JOIN used USING (sample_id)),
stock AS (SELECT i.sample_id, p.bucket AS b, p.stratum AS s, count(*) AS n FROM (SELECT DISTINCT sample_id FROM mem) i CROSS JOIN pool p ANTI JOIN mem ON mem.sample_id = i.sample_id AND mem.route_id = p.route_id GROUP BY ALL),
seen AS (SELECT sample_id, list(DISTINCT stratum) AS strata FROM att GROUP BY sample_id),
enough AS (SELECT r.sample_id, r.route_id, bool_and(r.room >= 0 AND coalesce(n.n, 0) - (r.b = r.bucket)::INT >= r.room) AS ok FROM room r LEFT JOIN (SELECT sample_id, b, sum(n) AS n FROM stock GROUP BY ALL) n USING (sample_id, b) GROUP BY ALL),
miss AS (SELECT opt.sample_id, opt.route_id, opt.bucket, opt.stratum, [x FOR x IN ['S0', 'S1', 'S2'] IF NOT list_contains(strata, x) AND x <> opt.stratum] AS missing FROM opt JOIN seen USING (sample_id)),
ways AS (SELECT x.a, y.b, z.c FROM (VALUES ('A'), ('B'), ('C')) x(a), (VALUES ('A'), ('B'), ('C')) y(b), (VALUES ('A'), ('B'), ('C')) z(c)),
plan AS (SELECT m.sample_id, m.route_id, m.bucket, m.stratum, unnest([{'w': a || b || c, 's': missing[1], 'b': a}, {'w': a || b || c, 's': missing[2], 'b': b}, {'w': a || b || c, 's': missing[3], 'b': c}], recursive := true) FROM miss m CROSS JOIN ways),
per AS (SELECT p.sample_id, p.route_id, p.w, p.b, bool_and(coalesce(k.n, 0) - (p.b = p.bucket AND p.s = p.stratum)::INT > 0) AS there, count(*) AS n FROM plan p LEFT JOIN stock k ON k.sample_id = p.sample_id AND k.b = p.b AND k.s = p.s WHERE p.s IS NOT NULL GROUP BY ALL),
way AS (SELECT per.sample_id, per.route_id, per.w, bool_and(there AND per.n <= r.room) AS ok FROM per JOIN room r ON r.sample_id = per.sample_id AND r.route_id = per.route_id AND r.b = per.b GROUP BY ALL),
feas AS (SELECT e.sample_id, e.route_id, e.ok AND (len(m.missing) = 0 OR coalesce(w.ok, false)) AS feasible FROM enough e JOIN miss m USING (sample_id, route_id) LEFT JOIN (SELECT sample_id, route_id, bool_or(ok) AS ok FROM way GROUP BY ALL) w USING (sample_id, route_id))"""


@query(f"WITH {POOL}, {opened(3)}, {FEASIBLE} SELECT sample_id, route_id, feasible FROM feas")
def quota_feasibility(spark, sf_dir):
    """Whether the drawn sets without three of their routes can be completed with each other route (Hall's condition; the SQL tries all ways)."""
    pool, _, cases = base_pool(spark, sf_dir)
    problems, members = open_problems(spark, sf_dir, 3)
    state = stored(sel.states(members, problems, pool, cases.select("scenario", "fraction"), RULES, network(spark, sf_dir)))
    rows = state.join(pool, "scenario").filter(~F.array_contains("members", F.col("route_id")))
    return rows.select(F.col("problem_id").alias("sample_id"), "route_id", sel.feasible(RULES, F.col("bucket"), F.col("stratum"), None, None).alias("feasible"))


@query(f"""WITH {POOL}, {opened(2)}, {FEASIBLE},
pairs AS (SELECT a.route_id AS l, b.route_id AS r, sum(a.length_m) AS m FROM own a JOIN own b USING (part_id) WHERE a.route_id <> b.route_id GROUP BY ALL),
close AS (SELECT f.sample_id, f.route_id, max(coalesce(m, 0) / least(x.full_m, y.full_m)) AS c4, max(coalesce(m, 0) / least(x.unique_m, y.unique_m)) AS corridor FROM feas f JOIN mem ON mem.sample_id = f.sample_id JOIN pool x ON x.route_id = f.route_id JOIN pool y ON y.route_id = mem.route_id LEFT JOIN pairs ON l = f.route_id AND r = mem.route_id GROUP BY ALL),
dist AS (SELECT sample_id, route_id, min(d) AS c5 FROM (SELECT f.sample_id, f.route_id, mem.route_id AS other, sqrt(sum((a.x - b.x) ** 2)) AS d FROM feas f JOIN mem ON mem.sample_id = f.sample_id JOIN mm a ON a.route_id = f.route_id JOIN mm b ON b.route_id = mem.route_id AND b.feature = a.feature GROUP BY ALL) GROUP BY ALL),
mv AS (SELECT i.sample_id, n.zone, n.rc, n.q, coalesce(sum(v.length_m), 0) AS v FROM (SELECT DISTINCT sample_id FROM mem) i CROSS JOIN net n LEFT JOIN mem ON mem.sample_id = i.sample_id LEFT JOIN vec v ON v.route_id = mem.route_id AND v.zone = n.zone AND v.rc = n.rc GROUP BY ALL),
ms AS (SELECT *, v / sum(v) OVER (PARTITION BY sample_id) AS share FROM mv), old AS (SELECT sample_id, 0.5 * sum(abs(q - share)) AS d FROM ms GROUP BY sample_id),
nv AS (SELECT f.sample_id, f.route_id, ms.q, ms.share, ms.v + coalesce(vec.length_m, 0) AS v, coalesce(vec.length_m, 0) / walk_m AS p FROM feas f JOIN ms USING (sample_id) JOIN pool ON pool.route_id = f.route_id LEFT JOIN vec ON vec.route_id = f.route_id AND vec.zone = ms.zone AND vec.rc = ms.rc),
c12 AS (SELECT sample_id, route_id, 0.5 * sum(abs(q - v / t)) AS d, sum(p * greatest(0, q - share)) AS c2 FROM (SELECT *, sum(v) OVER (PARTITION BY sample_id, route_id) AS t FROM nv) GROUP BY ALL),
have AS (SELECT DISTINCT mem.sample_id, g FROM mem JOIN groups USING (route_id)),
c3 AS (SELECT f.sample_id, f.route_id, count(*) FILTER (have.g IS NULL) / count(*)::DOUBLE AS c3 FROM feas f JOIN groups ON groups.route_id = f.route_id LEFT JOIN have ON have.sample_id = f.sample_id AND have.g = groups.g GROUP BY ALL),
mat AS (SELECT vec.route_id, vec.zone, vec.rc FROM vec JOIN pool USING (route_id) WHERE length_m / walk_m >= {FRACTION}), hm AS (SELECT DISTINCT sample_id, zone, rc FROM mem JOIN mat USING (route_id)),
c7m AS (SELECT f.sample_id, f.route_id, count(*) FILTER (hm.zone IS NULL) / count(*)::DOUBLE AS new FROM feas f JOIN mat ON mat.route_id = f.route_id LEFT JOIN hm ON hm.sample_id = f.sample_id AND hm.zone = mat.zone AND hm.rc = mat.rc GROUP BY ALL),
hp AS (SELECT sample_id, list(stratum) AS strata, list(stratum || '|' || rc) AS pairs FROM att GROUP BY sample_id),
raw AS (SELECT f.sample_id, f.route_id, CASE WHEN NOT feasible THEN 'quota_or_strata' WHEN corridor >= 0.29 THEN 'corridor_overlap' END AS reason, old.d - c12.d AS c1, c2, c3, c4, c5, c6, 2.0 * (NOT list_contains(strata, stratum))::INT + 2.0 * (NOT list_contains(hp.pairs, stratum || '|' || rc))::INT + coalesce(new, 0) AS c7
  FROM feas f JOIN close USING (sample_id, route_id) JOIN dist USING (sample_id, route_id) JOIN old USING (sample_id) JOIN c12 USING (sample_id, route_id) JOIN c3 USING (sample_id, route_id) LEFT JOIN c7m USING (sample_id, route_id) JOIN hp USING (sample_id) JOIN pool ON pool.route_id = f.route_id),
fit AS (SELECT * FROM raw WHERE reason IS NULL),
z AS (SELECT sample_id, route_id, c6, coalesce(c6, 2.5) / 5 AS z6, c7 / 5 AS z7, {", ".join(f"CASE WHEN max(c{i}) OVER w - min(c{i}) OVER w <= 1e-10 THEN 1 ELSE ({f'max(c{i}) OVER w - c{i}' if i == 4 else f'c{i} - min(c{i}) OVER w'}) / (max(c{i}) OVER w - min(c{i}) OVER w) END AS z{i}" for i in range(1, 6))} FROM fit WINDOW w AS (PARTITION BY sample_id)),
sc AS (SELECT sample_id, route_id, 25 * z1 + 15 * z2 + 15 * z3 + 15 * z4 + 10 * z5 + 10 * z6 + 10 * z7 AS score, CASE WHEN c6 IS NULL THEN 10 * z6 ELSE 0 END AS assumed, CASE WHEN c6 IS NULL THEN 10 ELSE 0 END AS open FROM z)
SELECT r.sample_id, r.route_id, reason, round(c1, 8) AS c1, round(c2, 8) AS c2, round(c3, 8) AS c3, round(c4, 8) AS c4, round(c5, 8) AS c5, c6, round(c7, 8) AS c7, round(score, 5) AS score, round(score - assumed, 5) AS score_low, round(score - assumed + open, 5) AS score_high FROM raw r LEFT JOIN sc USING (sample_id, route_id)""")
def criteria_scores(spark, sf_dir):
    """All seven criteria and scores of every route for the drawn sets without two of their routes, and why a route can't be added."""
    pool, own, cases = base_pool(spark, sf_dir)
    problems, members = open_problems(spark, sf_dir, 2)
    net = network(spark, sf_dir)
    near = stored(sel.closeness(members, problems, pool, own))
    state = stored(sel.states(members, problems, pool, cases, RULES, net))
    rows = stored(sel.judged(near, state, pool, cases, RULES, net))
    scores = sel.scored(rows, RULES).select("problem_id", "route_id", "score", "score_low", "score_high")
    found = rows.join(scores, ["problem_id", "route_id"], "left")
    return found.select(F.col("problem_id").alias("sample_id"), "route_id", "reason", *(rnd(x, 8) for x in ("c1", "c2", "c3", "c4", "c5")), "c6", rnd("c7", 8), *(rnd(x, 5) for x in ("score", "score_low", "score_high")))


def greedy_runs(spark, sf_dir, most: int = 10):
    """Greedy rounds of the baseline from its best starts."""
    pool, own, cases = base_pool(spark, sf_dir)
    net = network(spark, sf_dir)
    begun = stored(sc.starts(pool, net, "A", "C", most))
    problems = begun.select("problem_id", "scenario").distinct()
    return sel.greedy(problems, begun.select("problem_id", "route_id"), pool, own, cases, RULES, net), stored(problems), pool, own, cases, net


@query()
def batched_greedy(spark, sf_dir):
    """Iterative: ten starts at once, by all seven criteria, with the round each route came in; failed starts have a reason. Checked by brute force."""
    run = greedy_runs(spark, sf_dir)[0]
    return run.members.withColumn("reason", F.lit(None).cast("string")).unionByName(run.failures.withColumn("route_id", F.lit(None).cast("long")))


@query()
def multi_start_best(spark, sf_dir):
    """All starts with their outcome: the best by D, mean of domain D and ids, the others, and those that failed."""
    run, problems, pool, _, _, net = greedy_runs(spark, sf_dir)
    whole = run.members.join(run.failures.select("problem_id"), "problem_id", "left_anti")
    found = stored(sel.outcomes(whole, problems, pool, net))
    best = sel.best_start(found).select("problem_id", F.lit("best").alias("status"))
    rows = problems.select("problem_id").join(found, "problem_id", "left").join(best, "problem_id", "left").join(run.failures.select("problem_id", "reason"), "problem_id", "left")
    status = F.coalesce("status", F.when(F.col("reason").isNotNull(), F.concat(F.lit("failed:"), F.col("reason"))), F.lit("other"))
    return rows.select("problem_id", status.alias("status"), rnd("d", 9), rnd("d_domain_mean", 9), F.array_join(F.col("ids").cast("array<string>"), ";").alias("routes"))


@query()
def history_flatten(spark, sf_dir):
    """A row for each round and candidate: criteria, weights that held, score and its interval, and whether it was chosen."""
    history = greedy_runs(spark, sf_dir)[0].history
    return history.select("problem_id", "round", "route_id", "chosen", *sel.CRITERIA, *(f"w_{x}" for x in sel.CRITERIA), rnd("score", 7), rnd("score_low", 7), rnd("score_high", 7))


@query()
def swap_improve(spark, sf_dir):
    """Iterative: all drawn sets at once, the best guarded swap a round; checked by brute force in tests."""
    pool, own, cases = base_pool(spark, sf_dir)
    members = stored(drawn(spark, sf_dir).select(F.col("sample_id").alias("problem_id"), "route_id"))
    problems = members.select("problem_id").distinct().withColumn("scenario", F.lit("baseline"))
    return sel.swaps(problems, members, pool, own, cases, RULES, network(spark, sf_dir))[1].withColumn("d", F.round("d", 9))


@query()
def quota_slot_selection(spark, sf_dir):
    """Slots of each zone by length under caps, filled by the purest routes of each cell."""
    v = vectors(spark, sf_dir)
    total = v.groupBy("route_id").agg(F.sum("length_m").alias("all_m"))
    cand = v.join(total, "route_id").select("route_id", "zone", "rc", F.round(F.col("length_m") / F.col("all_m"), 9).alias("purity"), F.col("all_m").alias("length_m"))
    caps = cand.groupBy("zone", "rc").agg(F.count(F.lit(1)).alias("cap"))
    lengths = c.network_cells(parts(spark, sf_dir)).select("zone", "rc", F.col("network_m").alias("length_m"))
    slots = s.largest_remainder(lengths.join(caps, ["zone", "rc"]), 10, "zone")
    return s.ranked_fill(cand, slots, ["zone", "rc"]).select("zone", "rc", "route_id")


def chosen_routes(spark, sf_dir) -> list[int]:
    """The baseline set (draw 0): as many ids as the quota has slots."""
    return sorted(r.route_id for r in drawn(spark, sf_dir).filter("sample_id = 0").select("route_id").collect())


def blocked_routes(spark, sf_dir) -> list[int]:
    """All but three routes of bucket C, which has four slots. The list of a diagnostic case: as long as a bucket."""
    rows = candidates(spark, sf_dir).filter("bucket = 'C'").withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("route_id"))))
    return [r.route_id for r in rows.filter("r > 3").select("route_id").collect()]


def all_cases(spark, sf_dir, families: tuple[str, ...] = ()):
    design = sc.Design(fractions=(0.1, 0.12, 0.15))
    chosen = chosen_routes(spark, sf_dir)
    found = [sc.replace(x, fraction=FRACTION) if x.fraction == 0.3 else x for x in sc.cases(design, chosen, blocked_routes(spark, sf_dir))]
    return design, chosen, [x for x in found if not families or x.family in families]


def mix_sql(alias: str, k: int) -> str:
    """The draw number k of each case and route as chained tables; the last has the column x{k}."""
    start = 17
    for x in (DESIGN.seed,):
        start = ((start * 48271 + x + 1) * 69621) % s.PRIME
    first = f"((((((({start}::BIGINT * 48271 + number + 1) * 69621) % {s.PRIME}) * 48271 + {100 + k} + 1) * 69621) % {s.PRIME}) * 48271 + route_id + 1) * 69621 % {s.PRIME}"
    chain = [f"m{k}0 AS (SELECT *, {first} AS y{k}0 FROM {alias})"]
    chain += [f"m{k}{i} AS (SELECT *, (y{k}{i - 1} * y{k}{i - 1} + 7 * y{k}{i - 1} + 12345) % {s.PRIME} AS y{k}{i} FROM m{k}{i - 1})" for i in (1, 2, 3)]
    return ", ".join(chain)


CASES = """cs AS (SELECT number::BIGINT AS number, scenario, family, per_route, shifted, lane, speed FROM (
SELECT 0 AS number, 'baseline' AS scenario, 'baseline' AS family, '' AS per_route, false AS shifted, 0 AS lane, 0 AS speed UNION ALL SELECT 1, 'zscore', 'scaling', '', false, 0, 0
UNION ALL SELECT 2 + 2 * i + j, 'weight_' || (['c1', 'c2', 'c3', 'c4', 'c5', 'c6', 'c7', 'c1_c2', 'c4_c5'])[i + 1] || (['_minus', '_plus'])[j + 1], 'weights', '', false, 0, 0 FROM range(9) a(i), range(2) b(j)
UNION ALL SELECT 20, 'constant_dropped', 'constant_rule', '', false, 0, 0
UNION ALL SELECT 21 + i, 'fraction_' || (['0.1', '0.12', '0.15'])[i + 1], 'cell_threshold', '', false, 0, 0 FROM range(3) a(i)
UNION ALL SELECT 24 + i, 'omit_' || (['lanes', 'speed', 'lanes_speed'])[i + 1], 'missing_features', '', false, 0, 0 FROM range(3) a(i)
UNION ALL SELECT 27 + 3 * j + i, (['lanes', 'speed', 'both'])[i + 1] || (['_low', '_high'])[j + 1], 'imputation', '', false, CASE WHEN i <> 1 THEN 2 * j - 1 ELSE 0 END, CASE WHEN i <> 0 THEN 10 * (2 * j - 1) ELSE 0 END FROM range(3) a(i), range(2) b(j)
UNION ALL SELECT 33, 'c6_dropped', 'c6_policy', '', false, 0, 0 UNION ALL SELECT 34, 'c6_others', 'c6_adversarial', 'others', false, 0, 0 UNION ALL SELECT 35, 'c6_favoured', 'c6_adversarial', 'favoured', false, 0, 0
UNION ALL SELECT 36 + 16 * j + i, 'c6_random_' || (['minmax', 'zscore'])[j + 1] || '_' || lpad((i + 1)::VARCHAR, 2, '0'), 'c6_random', 'random', false, 0, 0 FROM range(16) a(i), range(2) b(j)
UNION ALL SELECT 68 + i, 'combined_' || lpad((i + 1)::VARCHAR, 2, '0'), 'combined_random', 'random', true, 0, 0 FROM range(16) a(i)
UNION ALL SELECT 83 + row_number() OVER (ORDER BY route_id), 'without_' || route_id, 'availability', '', false, 0, 0 FROM sets WHERE sample_id = 0
UNION ALL SELECT 84 + count(*), 'infeasible', 'diagnostic', '', false, 0, 0 FROM sets WHERE sample_id = 0)),
gone AS (SELECT route_id, 'without_' || route_id AS scenario FROM sets WHERE sample_id = 0 UNION ALL SELECT route_id, 'infeasible' FROM (SELECT *, row_number() OVER (ORDER BY route_id DESC) AS r FROM cand WHERE bucket = 'C') WHERE r > 3),
fav AS (SELECT route_id FROM sets WHERE sample_id = 0), cr AS (SELECT cs.*, cand.route_id FROM cs CROSS JOIN cand)"""


@query(f"""WITH {SETS}, {CASES}, {mix_sql("cr", 0)}, {mix_sql("m03", 1)}, {mix_sql("m13", 2)}
SELECT scenario, family, route_id, CASE per_route WHEN 'random' THEN y03 % 5 + 1 WHEN 'favoured' THEN CASE WHEN route_id IN (SELECT route_id FROM fav) THEN 5 ELSE 1 END WHEN 'others' THEN CASE WHEN route_id IN (SELECT route_id FROM fav) THEN 1 ELSE 5 END END::DOUBLE AS c6_assumed,
  NOT EXISTS (SELECT 1 FROM gone WHERE gone.route_id = m.route_id AND gone.scenario = m.scenario) AS eligible, round(CASE WHEN shifted THEN -1 + 2 * y13 / {s.PRIME}.0::DOUBLE ELSE lane END, 9)::DOUBLE AS lane_shift, round(CASE WHEN shifted THEN -10 + 20 * y23 / {s.PRIME}.0::DOUBLE ELSE speed END, 9)::DOUBLE AS speed_shift FROM m23 m""")
def scenario_grid(spark, sf_dir):
    """What every case assumes of every route: field score, whether it can be had, shifts of unknown lanes and speeds."""
    design, chosen, found = all_cases(spark, sf_dir)
    cases = sc.case_table(spark, found)
    rows = sc.per_route(candidates(spark, sf_dir).select("route_id"), cases, chosen, design)
    return rows.join(F.broadcast(cases.select("scenario", "family")), "scenario").select("scenario", "family", "route_id", "c6_assumed", "eligible", rnd("lane_shift", 9), rnd("speed_shift", 9))


def sweep(spark, sf_dir, families: tuple[str, ...] = ()):
    design, chosen, found = all_cases(spark, sf_dir, families)
    cases = stored(sc.case_table(spark, found))
    once = passed(spark, sf_dir)
    own = stored(routes(spark, sf_dir, once))
    pool = sc.fitted(own, stored(sc.per_route(own.select("route_id"), cases, chosen, design)), cases, design)
    return sc.compared(stored(sc.swept(cases, pool, route_parts(once), RULES, network(spark, sf_dir), "A", "C")))


def text_of(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ";").alias(column)


@query()
def scenario_sweep(spark, sf_dir):
    """Iterative: every case refitted, selected from three starts and swapped on, all in the same rounds; the parts are checked by brute force."""
    return sweep(spark, sf_dir).select("scenario", "family", "status", rnd("d_greedy", 9), rnd("d", 9), "n_swaps", "retained", rnd("jaccard", 9), text_of("removed"), text_of("added"))


@query()
def removal_replacements(spark, sf_dir):
    """For each route of the chosen set that is missing: routes added, routes that go as well, and the new D."""
    rows = sweep(spark, sf_dir, ("baseline", "availability")).filter("family = 'availability'")
    missing = F.substring("scenario", len("without_") + 1, 20).cast("long")
    return rows.select(missing.alias("route_id"), "status", text_of("added"), F.array_join(F.array_remove("removed", missing).cast("array<string>"), ";").alias("also_dropped"), rnd("d", 9))
