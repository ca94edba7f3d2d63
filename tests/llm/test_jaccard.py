"""The Jaccard join against brute force, and its search against plain counting."""

import random
import re

import numpy as np
import pytest

from sidematch.llm import jaccard_join as jj
from sidematch.llm.components import components


def brute(rows, width=5, percent=75):
    sets = []
    for doc_id, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
        sets.append(frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[find(i)] = min(smallest.get(find(i), doc_id), doc_id)
    return sorted((str(d), len(s), str(smallest.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, leader long")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jj.join(docs).collect())
    assert got == brute(rows)


def word(rng):
    return "".join(rng.choice("abcdeÉ") for _ in range(rng.randint(1, 4)))


@pytest.mark.parametrize("seed", range(3))
def test_join(spark, seed, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 4)
    monkeypatch.setattr(jj, "COUNT_SHINGLES", 500)
    rng = random.Random(seed)
    passage = [word(rng) for _ in range(60)]
    rows = []
    for i in range(12):
        base = [word(rng) for _ in range(rng.choice([3, 5, 8, 40, 120]))]
        if i % 3 == 0:
            base = base[:20] + passage
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word(rng)
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "A b"), (5004, "a B"), (None, "a b"), (None, "alone"),
             (5005, "x" * 5000), rows[0], rows[0]]
    rng.shuffle(rows)
    check(spark, rows)


def test_long_chain(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(100 - k, " ".join([*(f"v{i}" for i in range(4 * k)), *base[4 * k:]])) for k in range(20)]
    check(spark, rows)


def test_empty(spark):
    assert jj.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_divide_skip(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(40)]
    known = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    by = np.lexsort((owner, known))
    for _ in range(60):
        query = np.unique(np.concatenate([sets[rng.integers(40)], rng.integers(0, 60, 3).astype(np.uint64)]))
        want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, query)) >= 75 * len(np.union1d(s, query))}
        groups, asked = [i % 7 for i in range(40)], {0, 2, 3, 5}
        hits = jj.divide_skip(query, (known[by], owner[by]), sets, groups, asked)
        assert set(hits) <= want and sorted(groups[i] for i in hits) == sorted({groups[i] for i in want} & asked)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in nodes}


def test_keep_one(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", "s"), (1, "A b c d e f", "t"), (1, "A b c d e f", "t"), (None, None, None), (9, "q", "s")],
                                 "doc_id long, text string, source string")
    assert sorted(map(str, jj.keep_one(docs).collect())) == sorted(map(str, [r for r in docs.distinct().collect() if r.doc_id != 3]))
