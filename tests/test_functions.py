"""Text, date and key functions, rules and keyed rows."""

import re

import pytest
from pyspark.sql import functions as F

from sidematch.functions import dates, keys, text
from sidematch.operators.stats import diff_columns, verdict, verdict_strict
from sidematch.sources.keyed import parse_keyed_rows
from sidematch.sources.rules import Rule, read_rules, resolve_rules


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_dates(spark):
    lines = [
        "run 2026-05-17T12:34:56 ok", "Tuesday 5/7/2026 3:45 PM x", "borrowed Monitor", "06/02/26 PAGE 341",
        "2026-05-17 - 2026-05-18", "May 17, 2026 a", "sept. 3 2026", "none",
    ]
    assert apply(spark, dates.mask_dates, lines) == [
        "run T ok", "sday x", "borro itor", "06/02/26 PAGE 341", "-", "a", "", "none"
    ]
    assert apply(spark, dates.first_date, lines)[:2] == ["2026-05-17", "Tue"]
    assert apply(spark, dates.has_dates, lines) == [True, True, True, False, True, True, True, False]


def test_titles(spark):
    assert apply(spark, text.normalize_title, ["  The \t PAGE 1 "]) == ["the page 1"]
    assert apply(spark, lambda c: F.array_sort(text.title_tokens(c)), ["the page 12 of page", "the of", "7 x"]) == [
        ["12", "page"], ["of", "the"], ["7 x"]
    ]
    pair = spark.createDataFrame([("page 1", "page 2"), ("", "x"), ("", "")], "a string, b string")
    got = [r[0] for r in pair.select(text.edit_ratio(F.col("a"), F.col("b"))).collect()]
    assert [round(x, 4) for x in got] == [0.8333, 0.0, 1.0]


def test_sort_order(spark):
    raw = ["INV-9", "10", "9", "2026-01-05", "1/2/2026", "1,000", "17-MAY-2026", "Jan 3, 2026", "nan", "1d",
           "2026-02-30", "25/12/2025", "2026-01-05T00:00:01"]
    df = spark.createDataFrame([(v,) for v in raw], "v string")
    got = [r.v for r in df.orderBy(keys.sort_value(F.col("v"))).collect()]
    assert got == [
        "25/12/2025", "1/2/2026", "Jan 3, 2026", "2026-01-05", "2026-01-05T00:00:01", "17-MAY-2026",
        "9", "10", "1,000", "1d", "2026-02-30", "INV-9", "nan",
    ]


def test_keys(spark):
    assert keys.parse_key_spec("1:2, 4:") == [(0, 2), (3, None)]
    assert keys.parse_key_spec("7") == [(6, None)]
    for bad in ("0", "0:7,14:", "5:0", "x:3", "3:x"):
        with pytest.raises(ValueError):
            keys.parse_key_spec(bad)
    lines = spark.createDataFrame(
        [("A", "f", 1, "h1,h2,h3"), ("A", "f", 2, ""), ("A", "f", 3, 'AB,2026-01-20,"x, ""y"""'), ("A", "f", 4, "Q")],
        "side string, doc_id string, line_no int, line string",
    )
    rows, header = parse_keyed_rows(lines, keys.parse_key_spec("1:2,4:"), has_header=True)
    assert [r.fields for r in header.collect()] == [["h1", "h2", "h3"]]
    got = {r.line_no: (r.key, r.fields) for r in rows.collect()}
    assert got == {3: ("AB|2026-01-20", ["AB", "2026-01-20", 'x, "y"']), 4: ("Q|", ["Q"])}


def test_verdicts(spark):
    ratios = spark.createDataFrame([(x,) for x in (1.0, 0.9999, 0.98, 0.9799, 0.85, 0.6, 0.5999)], "r double")
    got = [tuple(r) for r in ratios.select(verdict(F.col("r")), verdict_strict(F.col("r"))).collect()]
    assert [g[0].split()[0] for g in got] == [
        "IDENTICAL", "IDENTICAL", "IDENTICAL", "MINOR", "MINOR", "MODERATE", "SIGNIFICANT"]
    assert [g[1] for g in got] == [
        "IDENTICAL", "MINOR", "MINOR", "MINOR", "MINOR", "MODERATE", "SIGNIFICANT"]


def test_stats(spark):
    counts = spark.createDataFrame([(2, 3, 4), (0, 1, 1), (0, 0, 0), (9999, 9999, 10000)], "c long, a long, b long")
    stats = diff_columns(F.col("c"), F.col("a"), F.col("b"))
    got = [tuple(r) for r in counts.select(*[v.alias(k) for k, v in stats.items()]).collect()]
    assert got == [(2, 1, 2, 0.5714, 75.0), (1, 1, 0, 0.0, 200.0), (0, 0, 0, 1.0, 0.0), (1, 0, 9999, 0.9999, 0.01)]


RULES = """report_pattern,split_pattern,sort_pattern,max_txn_lines,separator_pattern,csv_key_col,csv_has_header
ledger_.*,^Ledger\\s+no (\\w+),^Booked (.+)$,,,,
SHIFT.*,Sheet (\\d+),^Till\\s(\\d+),4,"={12,}$",,
SUM.*,,,,"^[=]{12,}",,
.*\\.csv,,,,,"1:7",true
"""


def test_rules(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text(RULES)
    rules = read_rules(spark, str(path))
    assert rules[1] == Rule("SHIFT.*", r"Sheet (\d+)", r"^Till\s(\d+)", 4, "={12,}$")
    assert rules[3].key_slices == ((0, 7),) and rules[3].has_header
    names = ["ledger_1.txt", "SHIFT_SUM.txt", "a.csv", "x.txt"]
    docs = spark.createDataFrame([(n,) for n in names], "file_name string")
    got = {r.file_name: r.rule_no for r in resolve_rules(docs, rules).collect()}
    assert got == dict(zip(names, [1, 2, 4, None]))
    for bad in ('x,,,,,"0",', 'x,,,,,"0:7,14:",', 'x,,,,,"5:0",', 'x,,,,,"x:3",', "*.csv,,,,,,"):
        path.write_text(RULES.splitlines()[0] + "\n" + bad + "\n")
        with pytest.raises(ValueError, match="row 2"):
            read_rules(spark, str(path))


@pytest.mark.parametrize("pattern, line", [
    (r"^\w+ \d", "Étude 7"), (r"(?i)^étude", "ÉTUDE 7"), (r"(?i)straße (\w+)", "STRAßE Öl"), (r"\bÖl\b", "das Öl."),
    (r"^(?:INV|BILL) (\d*)", "INV "), (r"^(?:INV|BILL) (\d*)", "BILL 7"), (r"(a)?b", "b"), (r"(a)?b", "xab"),
    (r"(x)|(y)", "y"), (r"(x)|(y)", "yx"), (r"(?P<n>\d+)-(?P=n)", "a 12-12"), (r"(\w)\1", "aabb"), (r"(b)(\w)\2", "bcc"),
    (r"[(](\d)?[)]", "f()"), (r"[(](\d)?[)]", "f(3)"), (r"\((\d)?\)", "f()"), (r"[]()](z)?", "a)"),
    (r"(?=(a))?b", "b"), (r"(?:(a)|b)+", "ba"), (r"no (match)", "nothing"), (r"(a(b)?)+c", "abac"), (r"x$|(\d)", "1x"),
])
def test_captured_value_as_in_python(spark, pattern, line):
    found = re.search(pattern, line)
    want = found and (found.group(1) if found.lastindex else found.group(0))
    row = spark.createDataFrame([(line,)], "line string")
    assert row.select(text.matched_value(F.col("line"), pattern)).first()[0] == want
    assert row.select(text.search(F.col("line"), pattern)).first()[0] == bool(found)
