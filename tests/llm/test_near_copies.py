"""The near-dedup stage against brute force over 5-word shingles."""

import random

import corpus_pipeline
from conftest import SF

from wayloom.llm import near_copies
from wayloom.llm.common import table


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = text.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a]) > 0.79 * len(sets[b]) and len(sets[b]) > 0.79 * len(sets[a]):
                both = len(sets[a] & sets[b])
                if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: root(i) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def test_stage_keeps_one_of_each_group_of_near_copies(spark):
    """Pairs at all similarities, and one crowd whose keys are too large to pair up."""
    rng, rows = random.Random(7), []
    made = lambda: [f"v{rng.randrange(5000)}" for _ in range(150)]
    for _ in range(60):
        base = made()
        for n in (0, *rng.sample(range(1, 9), 3)):
            rows.append(" ".join(edited(rng, base, n)))
    base = made()
    rows += [" ".join(edited(rng, base, rng.randrange(1, 9))) for _ in range(150)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    wanted = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == wanted
    kept = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, SF).collect()}
    assert kept == set(wanted.values()) and len(kept) < len(rows) - 100


def test_stage_equals_brute_force_on_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    wanted = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == wanted


def test_groups_of_null_and_shared_ids(spark):
    same, other = "the of and " * 20, "one two three four five six seven eight nine ten " * 3
    docs = spark.createDataFrame([(1, other), (2, same), (2, other), (3, same), (None, same), (None, other), (4, None), (5, ""), (2, same)], "doc_id long, text string")
    kept = sorted(((r.doc_id or 0, r.text or "") for r in corpus_pipeline.simhash_dedup(spark, docs, SF).collect()))
    assert kept == sorted([(1, other), (2, same), (2, same), (0, same), (0, other), (4, "")])


def test_crowd_of_unlike_texts_is_not_paired_up(spark, monkeypatch):
    """Copies of one text that are nearly all too unlike each other: the groups are those of brute force, from some pairs a text."""
    rng, compared, similar = random.Random(11), [], near_copies.similar
    base = [f"v{rng.randrange(5000)}" for _ in range(200)]
    rows = list(enumerate(" ".join(edited(rng, base, n)) for n in [0, 2, 4] * 20 + [5, 6] * 120))

    def counted(pairs, texts):
        compared.append(pairs.count())
        return similar(pairs, texts)

    monkeypatch.setattr(near_copies, "similar", counted)
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == brute_components(rows)
    assert sum(compared[1:]) < 5 * len(rows)  # the first are those of small keys and hubs


def test_golay_keys_of_whole_fingerprints_find_copies(spark, monkeypatch):
    """Long texts that differ in one word meet by Golay keys, with no sample in common."""
    import numpy as np

    rng, rows = random.Random(5), []
    for _ in range(20):
        words = [f"v{rng.randrange(10**6)}" for _ in range(6000)]
        rows += [" ".join(words), " ".join(edited(rng, words, 1))]
    rows = list(enumerate(rows))

    def no_samples(prints):
        return np.random.default_rng(hash(prints[0]) % 2**32).integers(-(2**62), 2**62, (len(prints), 1))

    monkeypatch.setattr(near_copies, "print_keys", no_samples)
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == brute_components(rows) == {i: i - i % 2 for i, _ in rows}
