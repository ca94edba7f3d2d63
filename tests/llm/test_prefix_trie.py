"""The conversation trie against plainly rebuilt conversations."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sidematch.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, rep string, i int"


def plain(rows):
    stored = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            stored[conv].append((turn is not None, turn or 0, role or "", text or ""))
    stored = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: y[:2])] for c, x in stored.items()}
    rebuilt = {}
    for c, own in stored.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = stored.get(c - c % 20, [])[:h] + own[h:]
    held = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            held[tuple(turns[:d])].append(c)
    out = Counter()
    for path, convs in held.items():
        below = [p for p in held if p[:len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[:-1] == p for q in held) for p in below)
        saved = sum((len(held[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in convs if rebuilt[c] == list(path))))
        out[min(convs), len(path), min(held[path[:-1]]) if path else None, len(convs),
            sum(len(q) == len(path) + 1 and q[:-1] == path for q in held), leaves, saved,
            hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def family(start, n, turns):
    return [(start + c, t, ["user", None][t % 2], f"turn {t} of {(c * (t > 4)) % 3} two  words") for c in range(n) for t in range(turns(c))]


ROWS = [
    (None, 1, "user", "x"), (203, None, None, None), (203, 0, "", ""), (204, 1, "a", None), (220, None, "a", "b c"),
    *family(0, 20, lambda c: 6), *family(20, 9, lambda c: c % 5), *family(41, 6, lambda c: c + 1),
    *((c, 0, "user", "only turn") for c in range(321, 330)), *((c, t, "user", f"same {t}") for c in range(100, 140) for t in range(5)),
    *((c, t, "user", "x" * 50_000 if t == 7 else f"{t}") for c in (60, 61, 65) for t in range(40)),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", 5) for r in rows], SCHEMA)


def test_equals_plain(spark):
    """Nulls, families, copies, long and turnless conversations; slices of three turns."""
    got = Counter(map(tuple, prefix_trie.build(frame(spark, ROWS), chunk=3).collect()))
    assert got == plain(ROWS)


def test_empty_table(spark):
    assert prefix_trie.build(frame(spark, [])).count() == 0


def test_ties_and_repeats_are_turns(spark):
    rows = [(20, 1, "user", "b"), (20, 1, "user", "a"), (20, 1, "user", "a"), (20, 0, "user", "first")]
    got = prefix_trie.build(frame(spark, rows)).collect()
    assert sorted(r.depth for r in got) == [0, 1, 2, 3, 4]


def test_colliding_points_are_left(spark):
    """With the base 1 turns add up whatever their place, so different orders collide."""
    rows = [(1000 + c, t, "u", x) for c, order in enumerate(["abc", "bac", "cba"]) for t, x in enumerate(order)]
    bad = [[1] * 4]
    with pytest.raises(RuntimeError):
        prefix_trie.build(frame(spark, rows), heads=1, points=bad)
    got = Counter(map(tuple, prefix_trie.build(frame(spark, rows), points=bad + prefix_trie.POINTS).collect()))
    assert got == plain(rows)
