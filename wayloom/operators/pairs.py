"""Pairs of problems and routes in numpy: routes stream by in Arrow batches, and the problems, which are few, go along with the code.

A problem is a Problem with its members; all that is known of them is worked out once a round (told, outs). Sums go over
the cells in their order, as the column rules of `selection` do, so both give the same numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs that are worked on at once.
AT_ONCE = 200_000


@dataclass
class Problem:
    """members: rows of route_id, bucket, stratum, rc, v, x, bins and cells (of those that a task asks for)."""

    at: int
    scenario: str
    members: list = field(default_factory=list)

    @property
    def ids(self) -> list:
        return [m["route_id"] for m in self.members]

    def all_of(self, name: str) -> list:
        return [x for m in self.members for x in m[name]]

    def sum_v(self, cells: int) -> np.ndarray:
        out = np.zeros(cells)
        for m in self.members:
            out = out + np.asarray(m["v"], dtype=float)
        return out


def gap(cells: list[np.ndarray], q: list[float]) -> np.ndarray:
    """D for cells given one by one, each for all pairs; NaN where nothing is travelled."""
    whole = sum(cells[1:], cells[0])
    with np.errstate(divide="ignore", invalid="ignore"):
        d = 0.5 * sum((np.abs(x / whole - y) for x, y in zip(cells[1:], q[1:], strict=True)), np.abs(cells[0] / whole - q[0]))
    return np.where(whole > 0, d, np.nan)


def columns(m: np.ndarray) -> list[np.ndarray]:
    return [m[..., i] for i in range(m.shape[-1])]


def domain_gaps(v: np.ndarray, network) -> list[np.ndarray]:
    """D inside each domain; NaN where the set or the network has no length there."""
    found = []
    for domain in sorted(set(network.domains)):
        at, q = network.within(domain)
        found.append(gap([v[..., i] for i in at], q) if q else np.full(v.shape[:-1], np.nan))
    return found


# ---- columns of a batch ----------------------------------------------------------------------------------------------


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(int)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of that width; what is null or lacking is NaN."""
    n, flat = lengths(lists), lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out, row = np.full((len(n), width), np.nan), np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    out[row[pos < width], pos[pos < width]] = flat[pos < width]
    return out


def coded(values: pa.Array) -> tuple[list, np.ndarray]:
    """Distinct values and the number of each row's value."""
    d = values.dictionary_encode(null_encoding="encode")
    return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False)


def holds(lists: pa.Array) -> tuple[list, np.ndarray]:
    """Distinct elements of lists, and whether each row has each."""
    values, at = coded(lists.flatten())
    out, n = np.zeros((len(lists), len(values)), dtype=bool), lengths(lists)
    out[np.repeat(np.arange(len(n)), n), at] = True
    return values, out


def by_scenario(batches: Iterable[pa.RecordBatch], known) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of each known scenario of each batch."""
    for batch in batches:
        names, at = coded(batch.column("scenario"))
        for i, name in enumerate(names):
            if name in known:
                yield name, batch.take(pa.array(np.flatnonzero(at == i)))


def strings(batch: pa.RecordBatch, name: str) -> tuple[list, np.ndarray]:
    return coded(batch.column(name))


# ---- criteria --------------------------------------------------------------------------------------------------------


def completes(rules, own: dict, bucket, stratum, cells: tuple[bool, ...]) -> bool:
    """selection.feasible for one kind of route; own: counts and what is left, see told()."""
    if bucket not in rules.buckets:
        return False
    slots = {b: n - own["n_bucket"][b] - (b == bucket) for b, n in rules.quota}
    if any(n < 0 or own["left_bucket"][b] - (b == bucket) < n for b, n in slots.items()):
        return False
    missing = [s for s in rules.required if s not in own["strata"] and s != stratum]
    there = lambda b, s: own["left_stratum"][b, s] - (b == bucket and s == stratum) > 0
    for n in range(1, len(missing) + 1):
        if any(sum(slots[b] for b in slots if any(there(b, s) for s in group)) < n for group in combinations(missing, n)):
            return False
    pending = [c for c, has in zip(rules.mandatory, cells, strict=True) if c not in own["cells"] and not has]
    return all(any(slots[b] > 0 and own["left_cell"][b, c] > 0 for b in slots) for c in pending)


def told(problem: Problem, stock: dict, rules, q: list[float]) -> dict:
    """What a round needs of a problem. stock: counts of the scenario's eligible routes by bucket, (bucket, stratum) and (bucket, cell)."""
    v, m = problem.sum_v(len(q)), problem.members
    whole = sum(v[1:], v[0])
    share = v / whole if whole else np.zeros(len(q))
    n_bucket, n_stratum = Counter(x["bucket"] for x in m), Counter((x["bucket"], x["stratum"]) for x in m)
    n_cell = Counter((x["bucket"], c) for x in m for c in x["cells"])
    return {
        "at": problem.at, "ids": problem.ids, "v": v, "now": float(gap(list(v), q)), "lacking": np.maximum(0.0, np.asarray(q) - share), "x": [np.asarray([np.nan if a is None else a for a in x["x"]], dtype=float) for x in m],
        "covered": set(problem.all_of("bins")), "strata": {x["stratum"] for x in m}, "pairs": {(x["stratum"], x["rc"]) for x in m}, "cells": set(problem.all_of("cells")), "n_bucket": n_bucket,
        "left_bucket": {b: stock["bucket"].get(b, 0) - n_bucket[b] for b in rules.buckets}, "left_stratum": {(b, s): stock["stratum"].get((b, s), 0) - n_stratum[b, s] for b in rules.buckets for s in rules.required},
        "left_cell": {(b, c): stock["cell"].get((b, c), 0) - n_cell[b, c] for b in rules.buckets for c in rules.mandatory},
    }


def judge(batches: Iterable[pa.RecordBatch], problems: dict[str, list[dict]], fractions: dict[str, float], rules, q: list[float], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Reasons and raw criteria (see selection.judged) of each problem of a scenario and each route that isn't a member, but c4 and the corridor cap.

    problems: told() by scenario.
    """
    for scenario, rows in by_scenario(batches, problems):
        n, own = rows.num_rows, problems[scenario]
        v, p = (matrix(rows.column(c), len(q)) for c in ("v", "p"))
        groups, has_group = holds(rows.column("bins"))
        n_groups = lengths(rows.column("bins"))
        has_cell = p >= fractions[scenario]
        (buckets, b_at), (strata, s_at), (classes, r_at) = (strings(rows, c) for c in ("bucket", "stratum", "rc"))
        kind = (b_at * len(strata) + s_at) * 2 ** len(rules.mandatory) + sum((has_cell[:, c].astype(int) << i for i, c in enumerate(rules.mandatory)), np.zeros(n, dtype=int))
        kinds, kind_at = np.unique(kind, return_inverse=True)
        width = len(own[0]["x"][0]) if own[0]["x"] else 0
        x = matrix(rows.column("x"), width)
        ids = rows.column("route_id").to_numpy(zero_copy_only=False)
        for t in own:
            fits = []
            for k in kinds.tolist():
                bs, bits = divmod(k, 2 ** len(rules.mandatory))
                fits.append(completes(rules, t, buckets[bs // len(strata)], strata[bs % len(strata)], tuple(bool(bits >> i & 1) for i in range(len(rules.mandatory)))))
            fit = np.array(fits, dtype=bool)[kind_at]
            reason = np.where(fit, None, "quota_or_strata")
            c2 = p[:, 0] * t["lacking"][0]
            for i in range(1, len(q)):
                c2 = c2 + p[:, i] * t["lacking"][i]
            c5 = np.full(n, np.nan)
            for other in t["x"]:
                square = np.zeros(n)
                for i in range(width):
                    square = square + (x[:, i] - other[i]) * (x[:, i] - other[i])
                c5 = np.fmin(c5, np.sqrt(square))
            fresh_cells = (has_cell & ~np.isin(np.arange(len(q)), list(t["cells"]))).sum(axis=1)
            fresh_groups = (has_group & np.array([g not in t["covered"] for g in groups], dtype=bool)).sum(axis=1)
            new_stratum = np.array([s not in t["strata"] for s in strata])[s_at]
            new_pair = np.array([[(s, r) not in t["pairs"] for r in classes] for s in strata])[s_at, r_at]
            with np.errstate(divide="ignore", invalid="ignore"):
                c3 = np.where(n_groups > 0, fresh_groups / n_groups, np.nan)
                c7 = 2.0 * new_stratum + 2.0 * new_pair + np.where(has_cell.any(axis=1), fresh_cells / has_cell.sum(axis=1), 0.0)
            found = {
                "at": np.full(n, t["at"]), "route_id": ids, "reason": reason, "c1": t["now"] - gap([t["v"][i] + v[:, i] for i in range(len(q))], q), "c2": c2, "c3": c3, "c5": c5,
                "c6": rows.column("c6"), "c7": c7, "c6_assumed": rows.column("c6_assumed"),
            }
            out = pa.record_batch([a if isinstance(a, pa.Array) else pa.array(a, type=schema.field(c).type, from_pandas=True) for c, a in found.items()], schema=schema)
            yield out.filter(pa.array(~np.isin(ids, t["ids"])))


def best(batches: Iterable[pa.RecordBatch], told: dict[int, tuple], tie: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Scores as in selection.scored, of rows without a reason; of each batch only the rows within the tolerance of a problem's best.

    told: by problem the lowest and highest of c1 to c5, the weights, whether constant criteria are dropped, and the neutral c6.
    """
    for batch in batches:
        numbers, at = coded(batch.column("at"))
        low, high, weights = (np.array([[np.nan if x is None else x for x in told[a][k]] for a in numbers], dtype=float).reshape(len(numbers), -1) for k in range(3))
        drop, neutral = (np.array([told[a][k] for a in numbers]) for k in (3, 4))
        span = np.nan_to_num(high - low, nan=0.0)
        constant = span <= tie
        weights[:, :5] = np.where(drop[:, None] & constant, 0.0, weights[:, :5])
        whole = sum(columns(weights)[1:], weights[:, 0])
        c = {name: batch.column(name).to_numpy(zero_copy_only=False).astype(float) for name in ("c1", "c2", "c3", "c4", "c5", "c6", "c7", "c6_assumed")}
        score = np.zeros(batch.num_rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            weights = np.where(whole[:, None] != 0, weights / whole[:, None], 0.0)
            for i in range(7):
                if i < 5:
                    value = c[f"c{i + 1}"]
                    z = (high[at, i] - value if i == 3 else value - low[at, i]) / span[at, i]
                    z = np.where(constant[at, i], np.where(drop[at], 0.0, 1.0), np.nan_to_num(z, nan=0.0))
                else:
                    z = (np.where(np.isnan(c["c6"]), np.where(np.isnan(c["c6_assumed"]), neutral[at], c["c6_assumed"]), c["c6"]) if i == 5 else c["c7"]) / 5
                score = score + weights[at, i] * z
        score = 100 * score
        top = np.full(len(numbers), -np.inf)
        np.maximum.at(top, at, score)
        near = np.flatnonzero(top[at] - score <= tie)
        kept = batch.take(pa.array(near))
        yield pa.record_batch([kept.column("at"), kept.column("route_id"), pa.array(score[near]), kept.column("c1"), kept.column("c4")], schema=schema)


# ---- swaps -----------------------------------------------------------------------------------------------------------


def outs(problem: Problem, first: dict, q: list[float]) -> list[dict]:
    """What each member's removal leaves of a problem, by reference counts. first: groups and domain D at the start."""
    v = problem.sum_v(len(q))
    counts = {c: Counter(x for m in problem.members for x in set(m[c])) for c in ("bins", "cells")}
    strata = Counter(m["stratum"] for m in problem.members)
    rest = lambda m, c: {x for x, n in counts[c].items() if n > 1 or x not in m[c]}
    return [
        {
            "at": problem.at, "out_id": m["route_id"], "bucket": m["bucket"], "v": v - np.asarray(m["v"], dtype=float), "bins": rest(m, "bins"), "cells": rest(m, "cells"), "strata": {s for s, n in strata.items() if n > 1 or s != m["stratum"]},
            "n_material": len(counts["cells"]), "members": problem.ids, "now": float(gap(list(v), q)), **first,
        }
        for m in problem.members
    ]


def swap(batches: Iterable[pa.RecordBatch], problems: dict[str, list[dict]], rules, network, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pairs (at, scenario, out_id, in_id, d) that lower D and keep all guards but the corridor cap. problems: outs() by scenario."""
    q = network.q
    for scenario, rows in by_scenario(batches, problems):
        buckets, b_at = strings(rows, "bucket")
        for b, bucket in enumerate(buckets):
            own, at = [o for o in problems[scenario] if o["bucket"] == bucket], np.flatnonzero(b_at == b)
            step = max(1, AT_ONCE // max(1, len(own)))
            for begin in range(0, len(at) if own else 0, step):
                found = swap_some(rows.take(pa.array(at[begin : begin + step])), own, rules, network, q)
                if found is not None:
                    i, j, d, ids = found
                    told = [pa.array([own[x]["at"] for x in j], pa.int32()), pa.array([scenario] * len(j), pa.string()), pa.array([own[x]["out_id"] for x in j], schema.field("out_id").type), pa.array(ids[i], schema.field("in_id").type), pa.array(d)]
                    yield pa.record_batch(told, schema=schema)


def swap_some(rows: pa.RecordBatch, own: list[dict], rules, network, q: list[float]):
    v, ids = matrix(rows.column("v"), len(q)), rows.column("route_id").to_numpy(zero_copy_only=False)
    left = np.stack([o["v"] for o in own])
    d = gap([left[None, :, c] + v[:, None, c] for c in range(len(q))], q)
    i, j = np.nonzero(d < np.array([o["now"] for o in own])[None, :] - rules.least_gain)
    most = max(len(o["members"]) for o in own)
    members = np.array([o["members"] + o["members"][:1] * (most - len(o["members"])) for o in own])
    keep = ~(ids[i][:, None] == members[j]).any(axis=1)
    i, j = i[keep], j[keep]
    (strata, s_at), (groups, has_group), (cells, has_cell) = strings(rows, "stratum"), holds(rows.column("bins")), holds(rows.column("cells"))
    tests = [np.array([s in o["strata"] for o in own])[j] | np.array([x == s for x in strata])[s_at][i] for s in rules.required]
    tests += [np.array([c in o["cells"] for o in own])[j] | (has_cell[i, cells.index(c)] if c in cells else False) for c in rules.mandatory]
    after = lambda c, values, has: np.array([len(o[c]) for o in own])[j] + (has[i] & np.array([[x not in o[c] for x in values] for o in own], dtype=bool).reshape(len(own), len(values))[j]).sum(axis=1)
    tests += [after("bins", groups, has_group) >= np.array([o["first_groups"] for o in own])[j] * rules.diversity, after("cells", cells, has_cell) >= np.array([o["n_material"] for o in own])[j]]
    for k, now in enumerate(domain_gaps(left[j] + v[i], network)):
        tests.append(~(now > np.array([o["first_domains"][k] for o in own], dtype=float)[j] + rules.domain_worse))
    keep = np.logical_and.reduce(tests)
    return (i[keep], j[keep], d[i[keep], j[keep]], ids) if keep.any() else None
