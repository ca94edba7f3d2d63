"""How much is moved: rows of small groups once, short tables not at all."""

import pytest
from pyspark.sql import functions as F

from sidematch.functions import dates, text
from sidematch.operators import pairing, rollup, stats
from sidematch.plans import compare
from sidematch.sources.keyed import parse_keyed_rows
from sidematch.sources.reports import slice_width
from sidematch.sources.rules import Rule
from workload import summary_queries


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_header_rows_leave_lines_in_place(spark):
    lines = spark.createDataFrame(
        [("A", "d", i, x) for i, x in enumerate(["", "key,v", "2024-01-02,x", "7,y"])], "side string, doc_id string, line_no int, line string")
    rows, header = parse_keyed_rows(lines, [(0, None)], has_header=True)
    assert [r.line for r in header.collect()] == ["key,v"]
    assert sorted((r.key, r.sort_vals[0].rank) for r in rows.collect()) == [("2024-01-02", 0), ("7", 1)]
    assert "SortMergeJoin" not in plan_of(rows) and "Exchange hashpartitioning" not in plan_of(rows)


def test_rows_of_small_keys_are_moved_once(spark, monkeypatch):
    rows = [(k % 3, k, str(k % 5), "unused") for k in range(30)]
    a = spark.createDataFrame(rows, "key int, pos long, v string, w string")
    b = a.where("pos % 4 <> 0")
    once = pairing.pair_rows(a, b, ["key"], "pos", chunk=2).select("key", "occ", "v_a", "v_b", "status")
    assert plan_of(once).count("Exchange hashpartitioning") == 1
    assert "_v_w" not in plan_of(once)
    monkeypatch.setattr(pairing, "MAX_GROUP_ROWS", 3)
    sliced = pairing.pair_rows(a, b, ["key"], "pos", chunk=2).select("key", "occ", "v_a", "v_b", "status")
    assert plan_of(sliced).count("Exchange hashpartitioning") > 1
    assert sorted(once.collect(), key=str) == sorted(sliced.collect(), key=str)


def test_terms_of_a_text_are_moved_with_its_lines(spark):
    a = spark.createDataFrame(
        [("d", 1, "one two"), ("d", 2, ""), ("d", 3, "three two"), ("e", 1, "")], "doc_id string, line_no int, line string")
    b = spark.createDataFrame([("d", 1, "one two three"), ("f", 1, "only")], "doc_id string, line_no int, line string")
    plain, sliced = (stats.text_cosine(a, b, ["doc_id"], stop_words=[], chunk=c) for c in (None, 1))
    assert plan_of(plain).count("Exchange hashpartitioning") == 1
    found = {r.doc_id: r.text_similarity for r in plain.collect()}
    assert found == {r.doc_id: r.text_similarity for r in sliced.collect()}
    assert set(found) == {"d", "e", "f"} and found["e"] == found["f"] == 0.0 and 0 < found["d"] < 1


def test_slices_only_for_long_texts(spark):
    docs = spark.createDataFrame([("a\nb",), (None,)], "text string")
    assert slice_width(docs, width=64) is None
    assert slice_width(docs.selectExpr("repeat('\r\n', 40000) AS text"), width=64) == 64
    assert slice_width(docs, width=64, growth=1 << 16) == 64


@pytest.mark.parametrize("line", [
    "due MAY 5, 2024 x", "sunday and wedge", "3:45 pm", "on 2024/01/02 - 2024-01-03", "nothing in july", "12/1/2024", "apr.", "Sept 1 2020"])
def test_fast_date_pattern_finds_the_same(spark, line):
    row = spark.createDataFrame([(line,)], "line string").select(
        dates.has_dates(F.col("line")) == F.col("line").rlike(dates.DATE_RE),
        dates.first_date(F.col("line")) == F.coalesce(F.regexp_substr("line", F.lit(dates.DATE_RE)), F.lit("")),
    ).first()
    assert row[0] and row[1]


def test_strip_takes_every_space(spark):
    value = text.SPACES + "a" + text.SPACES + "b" + text.SPACES[::-1]
    row = spark.createDataFrame([(value,)], "v string").select(
        text.strip(F.col("v")) == F.regexp_replace("v", rf"^{text.SPACE}+|{text.SPACE}+\z", "")).first()
    assert row[0]


def test_pairs_are_aligned_when_asked(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(s, "1", "r.txt", "r.txt", "PAGE 1\nx\ny" + extra) for s, extra in (("A", ""), ("B", "\nz"))],
        "side string, doc_id string, file_name string, match_name string, text string")
    calls, real = [], compare.align.align_lines
    monkeypatch.setattr(compare.align, "align_lines", lambda *a, **k: calls.append(1) or real(*a, **k))
    result = compare.compare(docs)
    assert result.summary.count() == 1 and not calls
    assert result.diff_rows.where("text = 'z'").count() == 1 and result.unified_diff.count() > 0
    assert len(calls) == 1


def test_section_lists_stay_out_of_the_driver(spark):
    """Stored section lists look smaller than they are: no join sends them to all tasks."""
    def listed(n):
        return spark.range(n).selectExpr("'d' AS doc", "id AS section_id", "concat('Page ', id) AS section_title", "4L AS n_lines", "3L AS n_filled")

    def lines(n, text):
        return spark.range(n * 4).selectExpr(
            "'d' AS doc", "id AS line_no", "id div 4 AS section_id", "id % 4 = 0 AS is_marker", f"{text} AS line")

    sides = listed(100), listed(90), lines(100, "concat('x ', id % 3)"), lines(90, "concat('X ', id % 3, repeat(' ', id % 2))")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        found = {c: rollup.compare_sections(*sides, ["doc"], normalize=lambda x: F.trim(F.lower(x)), chunk=c) for c in (None, 2)}
        assert all("BroadcastExchange" not in plan_of(df) for df in found.values())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain, sliced = (df.collect() for df in found.values())
    assert sorted(plain, key=str) == sorted(sliced, key=str)
    assert sorted((r.status, r.similarity_ratio) for r in plain) == [("matched", 1.0)] * 90 + [("removed", None)] * 10


def test_pair_summary_gives_both_verdicts(spark, tmp_path):
    long = "\n".join(f"line {i}" for i in range(60))
    spark.createDataFrame([(i, t) for i, t in enumerate(("one", long, "\n".join("abcdefgh")), 1)], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    rows = summary_queries.pair_summary(spark, str(tmp_path)).collect()
    want = {r: s for r, s in ((1.0, "IDENTICAL"), (0.85, "MINOR"), (0.6, "MODERATE"), (0.0, "SIGNIFICANT"))}
    assert len(rows) == 3
    assert all(r.verdict_strict == next(s for least, s in want.items() if r.similarity_ratio >= least) for r in rows)
    assert len({r.verdict_strict for r in rows}) > 1


def test_lines_of_reports_are_written_once(spark, monkeypatch):
    """Pages of one kind go through without being stored; both kinds give what each gives alone."""
    text = "PAGE 1\nhead\na\nb\nc\nd\ne\nPAGE 2\nhead\nf\n\ng"
    docs = spark.createDataFrame(
        [(s, n, n, n, text + extra) for n in ("one.txt", "two.txt") for s, extra in (("A", ""), ("B", "\nz"))],
        "side string, doc_id string, file_name string, match_name string, text string")
    written, real = [], compare.materialize
    monkeypatch.setattr(compare, "materialize", lambda df: written.append("line_no" in df.columns) or real(df))

    def run(df, rules):
        written.clear()
        result = compare.compare(df, rules)
        return sorted(map(str, result.summary.collect() + result.pages.collect())), sum(written)

    rules = [Rule("one.*", split_pattern=r"PAGE (\d+)")]
    one, two, both = run(docs.where("doc_id = 'one.txt'"), rules), run(docs.where("doc_id = 'two.txt'"), rules), run(docs, rules)
    assert one[1] == two[1] == 1
    assert sorted(one[0] + two[0]) == both[0] and len(both[0]) > 4
