"""Feasibility, criteria, greedy rounds and guarded swaps of many problems against enumeration and plain loops."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from wayloom.operators import selection as sel

CELLS, DOMAINS = 6, ("in", "in", "in", "out", "out", "out")
WEIGHTS = [25.0, 15.0, 15.0, 15.0, 10.0, 10.0, 10.0]


def d_of(v, q):
    s = sum(v)
    return 0.5 * sum(abs(x / s - y) for x, y in zip(v, q, strict=True)) if s > 0 else None


class World:
    """A made pool of routes, with the rules worked out by plain loops."""

    def __init__(self, seed, n=16, rules=None, scenarios=2):
        rng = random.Random(seed)
        self.rules = rules or sel.Rules((("A", 3), ("B", 2), ("C", 1)), ("S0", "S1"), (), most_corridor=0.6)
        self.network = sel.Network(tuple(rng.uniform(1, 9) for _ in range(CELLS)), DOMAINS)
        self.lengths = {p: rng.choice([1.0, 2.0, 3.0]) for p in range(14)}
        self.parts = {r: rng.sample(range(14), rng.randrange(2, 7)) for r in range(n)}
        self.scenarios, self.pool = {}, {}
        for k in range(scenarios):
            name = f"case{k}"
            self.scenarios[name] = ([w * rng.choice([0.8, 1.0, 1.2]) for w in WEIGHTS], bool(k % 2), 2.5, (0.3, 0.25)[k % 2])
            for r in range(n):
                v = [rng.choice([0.0, rng.uniform(1, 9)]) for _ in range(CELLS)]
                full = sum(v) + rng.uniform(0, 4) + 1e-6
                self.pool[name, r] = {
                    "bucket": "ABC"[r % 3], "stratum": f"S{rng.randrange(3)}", "rc": f"RC{rng.randrange(2)}", "eligible": rng.random() > 0.1, "c6": rng.choice([None, 1.0, 4.0]),
                    "c6_assumed": rng.choice([None, 3.0]), "v": v, "p": [x / full for x in v], "x": [rng.random() for _ in range(3)], "bins": [f"f{i}:{rng.randrange(4)}" for i in range(rng.choice([0, 2, 3]))],
                    "full_m": full, "unique_m": sum(self.lengths[p] for p in self.parts[r]),
                }

    def tables(self, spark):
        pool = [(s, r, *(row[c] for c in ("bucket", "stratum", "rc", "eligible", "c6", "c6_assumed", "v", "p", "x", "bins", "full_m", "unique_m"))) for (s, r), row in self.pool.items()]
        schema = "scenario string, route_id long, bucket string, stratum string, rc string, eligible boolean, c6 double, c6_assumed double, v array<double>, p array<double>, x array<double>, bins array<string>, full_m double, unique_m double"
        parts = [(r, p, self.lengths[p]) for r, own in self.parts.items() for p in own]
        scenarios = [(s, *row) for s, row in self.scenarios.items()]
        return spark.createDataFrame(pool, schema), spark.createDataFrame(parts, "route_id long, part_id long, length_m double"), spark.createDataFrame(scenarios, "scenario string, weights array<double>, drop_constant boolean, c6_neutral double, fraction double")

    def common(self, a, b):
        return sum(self.lengths[p] for p in set(self.parts[a]) & set(self.parts[b]))

    def corridor(self, s, a, b):
        return self.common(a, b) / min(self.pool[s, a]["unique_m"], self.pool[s, b]["unique_m"])

    def overlap(self, s, a, b):
        return self.common(a, b) / min(self.pool[s, a]["full_m"], self.pool[s, b]["full_m"])

    def cells(self, s, r):
        return {i for i, x in enumerate(self.pool[s, r]["p"]) if x >= self.scenarios[s][3]}

    def total(self, s, members):
        return [sum(self.pool[s, r]["v"][i] for r in members) for i in range(CELLS)]

    def completes(self, s, members, route):
        """By enumeration: strata to distinct routes of buckets with slots left; mandatory cells one by one."""
        trial = [*members, route]
        slots = {b: n - sum(self.pool[s, r]["bucket"] == b for r in trial) for b, n in self.rules.quota}
        rest = [r for (t, r), row in self.pool.items() if t == s and row["eligible"] and r not in trial]
        if min(slots.values()) < 0 or any(sum(self.pool[s, r]["bucket"] == b for r in rest) < n for b, n in slots.items()):
            return False
        missing = sorted(set(self.rules.required) - {self.pool[s, r]["stratum"] for r in trial})
        ways = ({b: m.count(b) for b in slots} for m in itertools.product(slots, repeat=len(missing)) if all(any(self.pool[s, r]["bucket"] == b and self.pool[s, r]["stratum"] == x for r in rest) for b, x in zip(m, missing, strict=True)))
        if not any(all(n <= slots[b] for b, n in used.items()) for used in ways):
            return False
        pending = [c for c in self.rules.mandatory if not any(c in self.cells(s, r) for r in trial)]
        return all(any(slots[self.pool[s, r]["bucket"]] > 0 and c in self.cells(s, r) for r in rest) for c in pending)

    def raw(self, s, members, route):
        row, q = self.pool[s, route], self.network.q
        v = self.total(s, members)
        share = [x / sum(v) if sum(v) else 0.0 for x in v]
        seen = {b for r in members for b in self.pool[s, r]["bins"]}
        strata = {self.pool[s, r]["stratum"] for r in members}
        pairs = {(self.pool[s, r]["stratum"], self.pool[s, r]["rc"]) for r in members}
        own = self.cells(s, route)
        fresh = own - set().union(*(self.cells(s, r) for r in members))
        return [
            d_of(v, q) - d_of([a + b for a, b in zip(v, row["v"], strict=True)], q), sum(p * max(0, y - x) for p, x, y in zip(row["p"], share, q, strict=True)),
            len(set(row["bins"]) - seen) / len(row["bins"]) if row["bins"] else None, max(self.overlap(s, route, r) for r in members),
            min(math.dist(row["x"], self.pool[s, r]["x"]) for r in members), row["c6"], 2 * (row["stratum"] not in strata) + 2 * ((row["stratum"], row["rc"]) not in pairs) + (len(fresh) / len(own) if own else 0),
        ]

    def round(self, s, members):
        """Raw criteria, scores and intervals of the routes that fit, and reasons of the others."""
        weights, drop, neutral, _ = self.scenarios[s]
        reasons, raws = {}, {}
        for (t, r), row in self.pool.items():
            if t != s or r in members or not row["eligible"]:
                continue
            if not self.completes(s, members, r):
                reasons[r] = "quota_or_strata"
            elif max(self.corridor(s, r, m) for m in members) >= self.rules.most_corridor:
                reasons[r] = "corridor_overlap"
            else:
                raws[r] = self.raw(s, members, r)
        w, spans = list(weights), []
        for c in range(5):
            known = [x[c] for x in raws.values() if x[c] is not None]
            spans.append((min(known, default=0), max(known, default=0)))
            if drop and spans[c][1] - spans[c][0] <= 1e-10:
                w[c] = 0.0
        w = [x / sum(w) for x in w]
        scores = {}
        for r, x in raws.items():
            z = []
            for c, (low, high) in enumerate(spans):
                z.append((0.0 if drop else 1.0) if high - low <= 1e-10 else 0.0 if x[c] is None else ((high - x[c]) if c == 3 else (x[c] - low)) / (high - low))
            assumed = self.pool[s, r]["c6_assumed"]
            z += [(x[5] if x[5] is not None else assumed if assumed is not None else neutral) / 5, x[6] / 5]
            score = 100 * sum(a * b for a, b in zip(w, z, strict=True))
            low = score - (100 * w[5] * z[5] if x[5] is None else 0)
            scores[r] = (score, low, low + 100 * w[5] if x[5] is None else score)
        return raws, scores, reasons

    def greedy(self, s, start):
        members, picks = list(start), []
        while len(members) < self.rules.size:
            raws, scores, _ = self.round(s, members)
            if not scores:
                return members, picks, len(picks) + 1
            top = max(x[0] for x in scores.values())
            best = min((r for r in scores if top - scores[r][0] <= 1e-10), key=lambda r: (-round(raws[r][0], 10), round(raws[r][3], 10), r))
            members.append(best)
            picks.append(best)
        return members, picks, None

    def swap(self, s, members):
        q, done = self.network.q, []
        groups = lambda ms: {b for r in ms for b in self.pool[s, r]["bins"]}
        cells = lambda ms: set().union(*(self.cells(s, r) for r in ms))

        def domains(ms):
            v = self.total(s, ms)
            return [d_of([v[i] for i in at], share) for at, share in (self.network.within(g) for g in sorted(set(DOMAINS)))]

        first_groups, first = len(groups(members)), domains(members)
        while True:
            now, options = d_of(self.total(s, members), q), []
            for old in members:
                rest = [r for r in members if r != old]
                for (t, new), row in self.pool.items():
                    if t != s or new in members or not row["eligible"] or row["bucket"] != self.pool[s, old]["bucket"]:
                        continue
                    trial = [*rest, new]
                    d = d_of(self.total(s, trial), q)
                    if not d < now - 1e-9 or max((self.corridor(s, new, r) for r in rest), default=0) >= self.rules.most_corridor:
                        continue
                    if not set(self.rules.required) <= {self.pool[s, r]["stratum"] for r in trial} or not set(self.rules.mandatory) <= cells(trial):
                        continue
                    if len(groups(trial)) < first_groups * 0.9 or len(cells(trial)) < len(cells(members)):
                        continue
                    if any(a is not None and b is not None and a > b + 0.02 for a, b in zip(domains(trial), first, strict=True)):
                        continue
                    options.append((round(d, 10), new, old))
            if not options:
                return members, done
            d, new, old = min(options)
            members = [r for r in members if r != old] + [new]
            done.append((old, new, d))


MANDATORY = sel.Rules((("A", 2), ("B", 2), ("C", 1)), ("S0", "S1", "S2"), (0, 4), most_corridor=0.9)


@pytest.fixture(scope="module")
def runs(spark):
    """Two worlds, two scenarios each, many starts: the engine's rounds over all of them at once."""
    out = []
    for seed, rules in ((1, None), (2, MANDATORY)):
        world = World(seed, rules=rules)
        pool, parts, scenarios = world.tables(spark)
        starts = {f"{s}-{a}-{b}": (s, (a, b)) for s in world.scenarios for a, b in ((0, 1), (3, 4), (5, 8), (9, 10))}
        problems = spark.createDataFrame([(k, s) for k, (s, _) in starts.items()], "problem_id string, scenario string")
        members = spark.createDataFrame([(k, r) for k, (_, own) in starts.items() for r in own], "problem_id string, route_id long")
        out.append((world, starts, problems, (pool, parts, scenarios), sel.greedy(problems, members, pool, parts, scenarios, world.rules, world.network)))
    return out


def test_greedy_rounds(runs):
    ended = set()
    for world, starts, _, _, found in runs:
        picked = {}
        for r in found.members.filter("round > 0").orderBy("round").collect():
            picked.setdefault(r.problem_id, []).append(r.route_id)
        failed = {r.problem_id: r["round"] for r in found.failures.collect()}
        for name, (scenario, start) in starts.items():
            _, picks, failure = world.greedy(scenario, start)
            assert picked.get(name, []) == picks and failed.get(name) == failure
            ended.add(failure)
    assert None in ended and len(ended) > 1


def test_criteria_scores_and_reasons(runs):
    for world, starts, _, _, found in runs:
        history, rejected, chosen = {}, {}, {}
        for r in found.history.collect():
            history.setdefault((r.problem_id, r["round"]), {})[r.route_id] = r
        for r in found.rejected.collect():
            rejected.setdefault((r.problem_id, r["round"]), {})[r.route_id] = r.reason
        for r in found.members.collect():
            chosen.setdefault(r.problem_id, {}).setdefault(r["round"], []).append(r.route_id)
        for (name, turn), rows in history.items():
            members = [r for t, own in chosen[name].items() if t < turn for r in own]
            raws, scores, reasons = world.round(starts[name][0], members)
            assert set(rows) == set(scores) and rejected.get((name, turn), {}) == reasons
            for route, r in rows.items():
                for a, b in zip(raws[route], (r.c1, r.c2, r.c3, r.c4, r.c5, r.c6, r.c7), strict=True):
                    assert (a is None and b is None) or abs(a - b) < 1e-9
                assert all(abs(a - b) < 1e-7 for a, b in zip(scores[route], (r.score, r.score_low, r.score_high), strict=True))
                assert r.chosen == (route in chosen[name].get(turn, []))


def test_swaps(spark, runs):
    """From random whole sets: every step is the one that a scan of all pairs finds, until none is left."""
    rng, made = random.Random(8), 0
    for world, _, _, tables, _ in runs:
        sets = {f"{s}-{k}": (s, [r for b, n in world.rules.quota for r in rng.sample([r for r in range(16) if "ABC"[r % 3] == b], n)]) for s in world.scenarios for k in range(4)}
        problems = spark.createDataFrame([(k, s) for k, (s, _) in sets.items()], "problem_id string, scenario string")
        members = spark.createDataFrame([(k, r) for k, (_, own) in sets.items() for r in own], "problem_id string, route_id long")
        after, done = sel.swaps(problems, members, *tables, world.rules, world.network)
        steps, last = {}, {}
        for r in done.orderBy("round").collect():
            steps.setdefault(r.problem_id, []).append((r.out_id, r.in_id))
        for r in after.collect():
            last.setdefault(r.problem_id, set()).add(r.route_id)
        for name, (scenario, routes) in sets.items():
            end, wanted = world.swap(scenario, routes)
            assert steps.get(name, []) == [(a, b) for a, b, _ in wanted] and last[name] == set(end)
            made += len(wanted)
    assert made > 5


def test_best_start(spark, runs):
    world, starts, problems, tables, found = runs[0]
    full = {}
    for r in found.members.collect():
        full.setdefault(r.problem_id, []).append(r.route_id)
    result = sel.best_start(sel.outcomes(found.members, problems, tables[0], world.network).join(problems, "problem_id"), "scenario").collect()
    for r in result:
        best = min((round(d_of(world.total(r.scenario, own), world.network.q), 10), name) for name, own in full.items() if starts[name][0] == r.scenario)
        assert abs(r.d - best[0]) < 1e-9 and sorted(r.ids) == sorted(full[r.problem_id])


def test_feasibility_of_all_small_sets(spark):
    """Every set of two routes and every third one, by Hall's condition and by enumeration."""
    world = World(5, n=12, rules=sel.Rules((("A", 2), ("B", 2), ("C", 1)), ("S0", "S1", "S2"), (1,)), scenarios=1)
    pool, _, scenarios = world.tables(spark)
    sets = list(itertools.combinations(range(12), 2))
    problems = spark.createDataFrame([(k, "case0") for k in range(len(sets))], "problem_id long, scenario string")
    members = spark.createDataFrame([(k, r) for k, own in enumerate(sets) for r in own], "problem_id long, route_id long")
    state = sel.states(members, problems, pool, scenarios, world.rules, world.network)
    rows = state.join(pool, "scenario").join(scenarios, "scenario").filter(~F.array_contains("members", F.col("route_id")))
    found = rows.select("problem_id", "route_id", sel.feasible(world.rules, F.col("bucket"), F.col("stratum"), F.col("p"), F.col("fraction")).alias("ok")).collect()
    verdicts = {(r.problem_id, r.route_id): r.ok for r in found}
    assert len(verdicts) == len(sets) * 10
    assert all(ok == world.completes("case0", sets[k], r) for (k, r), ok in verdicts.items())
    assert set(verdicts.values()) == {True, False}
