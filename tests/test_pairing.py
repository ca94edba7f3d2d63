"""Pairing of names, titles, keyed rows and blocks against direct statements."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sidematch.functions.dates import mask_dates
from sidematch.functions.keys import key_parts, sort_value
from sidematch.operators import align, pairing, stats
from sidematch.operators.fuzzy import fuzzy_pairs, similar_names
from sidematch.functions import text
from sidematch.operators import titles
from sidematch.operators.titles import match_titles

WORDS = ["page", "total", "cash", "card", "fees", "the", "of", "net", "12", "7"]


def distance(a, b):
    if not a or not b:
        return len(a) + len(b)
    rows = {(0, j): j for j in range(len(b) + 1)} | {(i, 0): i for i in range(len(a) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i, j] = min(
                rows[i - 1, j] + 1, rows[i, j - 1] + 1, rows[i - 1, j - 1] + (a[i - 1] != b[j - 1])
            )
    return rows[len(a), len(b)]


def ratio(a, b):
    return 1 - distance(a, b) / max(len(a), len(b), 1)


@pytest.mark.parametrize("least", [0.3, 0.7])
def test_fuzzy_pairs(spark, least):
    rng = random.Random(2)
    a = {"".join(rng.choice("abc1_") for _ in range(rng.randint(1, 14))) + ".txt" for _ in range(45)}
    b = {"".join(rng.choice("abc1_") if rng.random() < 0.2 else c for c in x) for x in sorted(a)} - a
    b |= {"q" + x for x in sorted(a)[:9]} | {"zzzz"}
    scored = sorted(
        ((ratio(x, y), x, y) for x in a for y in b if ratio(x, y) >= least), key=lambda t: (-t[0], t[1], t[2])
    )
    want, used = {}, set()
    for r, x, y in scored:
        if x not in want and y not in used:
            want[x] = (y, round(r, 4))
            used.add(y)
    names = [spark.createDataFrame([(x,) for x in sorted(s)], "name string") for s in (a, b)]
    got = {r.name_a: (r.name_b, round(r.ratio, 4)) for r in fuzzy_pairs(*names, least).collect()}
    assert got == want
    one = [spark.createDataFrame([(f"report_v{i}.txt",)], "name string") for i in (1, 2)]
    assert [(r.name_b, r.ratio) for r in fuzzy_pairs(*one).collect()] == [("report_v2.txt", 0.9231)]


def test_substrings_of_names_stay_out_of_the_driver(spark):
    """Few names have many substrings: whatever size Spark expects, no join sends them to all tasks."""
    names = [spark.range(50).selectExpr(f"concat('{side}_', md5(cast(id AS string)), '.txt') AS name") for side in "ab"]
    pairs = similar_names(*names, 0.8)
    assert pairs.count() > 0
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_names_without_a_partner_meet_in_few_segments(spark, monkeypatch):
    """Names that look alike nowhere share fewer segments than there are pairs."""
    a, b = (spark.range(120).selectExpr(f"concat('en_', {x}, '.txt') AS name") for x in (
        "md5(cast(id AS string))", "replace(md5(cast(id + 1000 AS string)), 'a', '99')"))
    joins, real = [], type(a).join
    monkeypatch.setattr(type(a), "join", lambda x, y, on=None, how=None: joins.append((x, y, on, how)) or real(x, y, on, how))
    assert similar_names(a, b, 0.7).count() == 0
    met = sum(real(x, y, on).count() for x, y, on, how in joins if how is None and "_gram" in on)
    assert 0 < met < a.count() * b.count()


def tokens(title, stops=("the", "of")):
    words = [w for w in title.split() if len(w) > 1]
    return sorted({w for w in words if w not in stops} or set(words) or {title})


def title_turns(a, b, keep, threshold=0.6):
    """Every A title scores every free B title, keeps some or all, takes the closest."""
    sets_a, sets_b = [tokens(t) for t in a], [tokens(t) for t in b]
    both = sets_a + sets_b
    weight = {
        t: math.log((1 + len(both)) / (1 + sum(t in s for s in both))) + 1 for s in both for t in s
    }

    def norm(s):
        return math.sqrt(math.fsum(weight[t] ** 2 for t in s))

    out, free = [], set(range(len(b)))
    for title, mine in zip(a, sets_a):
        scored = {
            j: round(math.fsum(weight[t] ** 2 for t in mine if t in sets_b[j]) / norm(mine) / norm(sets_b[j]), 12)
            for j in free
        }
        top = sorted(((s, j) for j, s in scored.items() if s > 0), reverse=True)[:keep]
        if not top:
            size = max(len(title), 1)
            top = sorted(
                ((min(size, max(len(b[j]), 1)) / max(size, len(b[j]), 1), j) for j in free), reverse=True
            )[:keep]
        best = max(((ratio(title, b[j]), -k, j) for k, (_, j) in enumerate(top)), default=(0, 0, None))
        choice = best[2] if best[0] >= threshold else None
        free.discard(choice)
        out.append(choice)
    return out


@pytest.mark.parametrize("keep", [10, None])
def test_match_titles(spark, keep):
    rng = random.Random(4)
    groups = {"same": (["Page 0", "Page 1", "Page 12"], ["Page 12", "Page 1", "Page 0", "Page 3"])}
    groups["golden"] = (["Page 1", "Page 2"], ["Page 2"])
    groups["many"] = ([f"Page {i}" for i in range(30)], [f"Page {i}" for i in range(1, 32)])
    groups["empty"] = (["Page 0"], [])
    groups["copies"] = (["Total"] * 9 + ["Totals", "Page 1"], ["Totals"] * 3 + ["Total"] * 4 + ["Page 1"] * 2)
    groups["blank"] = (["", "Page 1", " "], ["", "x", "  "])
    groups["typing"] = (["Introduction", "Sumary", "Index of pages"], ["Introductoin", "Summary", "Indices", "Summary"])
    for g in range(60):
        size, words = rng.choice([3, 8, 30]), rng.randint(1, 3)
        groups[f"g{g}"] = tuple(
            [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, words))) for _ in range(rng.randint(0, size))]
            for _ in range(2)
        )
    groups = {g: pair for g, pair in groups.items() if pair[0] or pair[1]}
    sides = [
        spark.createDataFrame(
            [(g, i, t) for g, pair in groups.items() for i, t in enumerate(pair[k])],
            "pair string, ordinal long, title string",
        )
        for k in range(2)
    ]
    got = {}
    for r in match_titles(*sides, ["pair"], top=keep, chunk=4).collect():
        got.setdefault(r.pair, set()).add((r.ordinal_a, r.ordinal_b, r.status))
    for g, (a, b) in groups.items():
        taken = title_turns([t.lower().strip() for t in a], [t.lower().strip() for t in b], keep)
        want = {(i, j, "removed" if j is None else "matched") for i, j in enumerate(taken)}
        want |= {(None, j, "added") for j in range(len(b)) if j not in taken}
        assert got[g] == want, g


def keyed(spark, side, lines):
    rows = [("f", i + 1, x) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "pair string, line_no int, line string")
    key = F.array_join(key_parts(F.col("line"), [(0, 7)]), "|")
    return df.withColumn("key", key).withColumn("sort_vals", F.array(sort_value(F.col("key"))))


@pytest.mark.parametrize("chunk", [None, 1])
def test_compare_rows(spark, chunk):
    a = keyed(spark, "A", ["TXN0045,2026-03-12,10", "TXN0012,2026-01-20,20", "TXN0012,2026-01-21,25"])
    b = keyed(spark, "B", ["TXN0101,2026-01-08,5", "TXN0045,2026-03-13,10", "TXN0012,2026-01-20,20"])

    def run(normalize):
        rows = pairing.compare_rows(a, b, ["pair", "key"], normalize=normalize, chunk=chunk)
        return {(r.key, r.occ): (r.status, r.similarity_ratio, r.lines_added, r.lines_deleted) for r in rows.collect()}

    want = {
        ("TXN0012", 1): ("matched", 1.0, 0, 0), ("TXN0012", 2): ("removed", None, 0, 1),
        ("TXN0045", 1): ("matched", 0.0, 1, 1), ("TXN0101", 1): ("added", None, 1, 0),
    }
    assert run(None) == want
    assert run(mask_dates) == want | {("TXN0045", 1): ("matched", 1.0, 0, 0)}
    rows = pairing.compare_rows(a, b, ["pair", "key"], chunk=chunk)
    cells = pairing.changed_fields(rows, ["key", "occ"]).collect()
    assert [(r.key, r.field_no, r.value_a, r.value_b) for r in cells] == [("TXN0045", 2, "2026-03-12", "2026-03-13")]
    diff = align.sorted_diff(align.in_key_order(rows, ["pair"]), ["pair"], "place", chunk=chunk)
    assert [(r.kind, r.text[:7]) for r in diff.orderBy("row_no").collect()] == [
        (0, "TXN0012"), (1, "TXN0012"), (2, "TXN0045"), (1, "TXN0045"), (2, "TXN0101")]


@pytest.mark.parametrize("chunk", [None, 2])
def test_compare_blocks(spark, chunk):
    def side(rows):
        return spark.createDataFrame(
            [("p", i + 1, *r) for i, r in enumerate(rows)],
            "pair string, line_no int, sort_key string, txn_id int, line string",
        )

    a = side([("9", 1, "x"), ("9", 1, "y"), ("10", 2, "z"), ("9", 3, "x")])
    b = side([("9", 1, "x"), ("9", 1, "q"), ("11", 2, "z"), ("9", 3, "x")])
    out = pairing.compare_transactions(a, b, ["pair"], chunk=chunk)
    got = [
        (r.sort_key, r.occ, r.status, r.similarity_ratio, r.lines_added, r.lines_deleted)
        for r in out.orderBy("sort_val", "occ").collect()
    ]
    assert got == [
        ("9", 1, "matched", 0.5, 1, 1), ("9", 2, "matched", 1.0, 0, 0),
        ("10", 1, "removed", 0.0, 0, 1), ("11", 1, "added", 0.0, 1, 0),
    ]


def test_text_cosine(spark):
    def side(text):
        rows = [(g, i, x) for g, t in text.items() for i, x in enumerate(t)]
        return spark.createDataFrame(rows, "pair string, line_no int, line string")

    a = side({"golden": ["alpha beta"], "same": ["one two", "three"], "blank": [" "], "split": ["aa bb", "cc"]})
    b = side({"golden": ["alpha gamma"], "same": ["one", "two three"], "blank": ["x yy"], "split": ["aa bb cc"]})
    for chunk in (None, 1):
        got = {r.pair: r.text_similarity for r in stats.text_cosine(a, b, ["pair"], chunk=chunk).collect()}
        assert got == {"golden": 0.202, "same": 1.0, "blank": 0.0, "split": 1.0}


def test_line_stats_mirror(spark):
    a = spark.createDataFrame([("p", x) for x in "xxy"], "pair string, line string")
    b = spark.createDataFrame([("p", x) for x in "xzxx"], "pair string, line string")
    one, two = (stats.line_stats(*s, ["pair"]).first() for s in ((a, b), (b, a)))
    assert (one.lines_common, one.lines_added, one.lines_deleted) == (2, 2, 1)
    assert (one.similarity_ratio, one.change_pct) == (0.5714, 75.0)
    assert (two.lines_added, two.lines_deleted, two.similarity_ratio) == (1, 2, 0.5714)
    assert stats.line_stats(a, a, ["pair"]).first().similarity_ratio == 1.0
    only = {(r.side, r.line, r.copies) for r in stats.lines_only_in(a, b, ["pair"]).collect()}
    assert only == {("A", "y", 1), ("B", "x", 1), ("B", "z", 1)}


def test_null_keys_pair_in_two_shuffles(spark):
    rows = [(None, 1, "x"), (None, 2, "y"), ("k", 3, "z"), (None, 200_000, "far")]
    a, b = (spark.createDataFrame(r, "key string, pos long, v string") for r in (rows, rows[:3]))
    pairs = pairing.pair_rows(a, b, ["key"], "pos")
    got = sorted((str(r.key), r.occ, r.v_a, str(r.v_b), r.status) for r in pairs.collect())
    assert got == [("None", 1, "x", "x", "matched"), ("None", 2, "y", "y", "matched"),
                   ("None", 3, "far", "None", "removed"), ("k", 1, "z", "z", "matched")]
    plan = pairing.pair_rows(a, b, ["key"], "pos", chunk=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_few_long_titles_are_paired_without_letters(spark, monkeypatch):
    """Groups of few titles go without the prefix filter, long titles without JVM distances,
    and both ways give the same pairs."""
    rng = random.Random(9)
    a, b = [], []
    for g in range(6):
        for k in range(5):
            t = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 160)))
            a.append((g, k, t))
            b.append((g, k, "".join(rng.choice("xyz") if rng.random() < 0.08 * k else c for c in t)))
    sides = [spark.createDataFrame(rows, "g int, ordinal int, title string") for rows in (a, b)]
    found = []
    for few, long in ((titles.FEW, titles.LONG), (0, 1000)):
        monkeypatch.setattr(titles, "FEW", few)
        monkeypatch.setattr(titles, "LONG", long)
        found.append(sorted(map(repr, match_titles(*sides, ["g"]).collect())))
    assert found[0] == found[1] and any("matched" in x for x in found[0])
    monkeypatch.undo()
    monkeypatch.setattr(titles, "_alike", None)
    assert sorted(map(repr, match_titles(*sides, ["g"]).collect())) == found[0]
    for _ in range(300):
        x, y = ("".join(rng.choice("abé") for _ in range(rng.randint(0, 12))) for _ in "ab")
        d, most = distance(x, y), rng.randint(0, 12)
        assert text.distance(x, y) == d and text.distance(x, y, most) == (d if d <= most else None)
