"""Pages, headers, footers, blocks and sections, sliced and plain."""

import random
from itertools import accumulate, groupby

import pytest
from pyspark.sql import functions as F

from sidematch.operators import blocks, pages
from sidematch.operators.pages import EDGE_LINES
from sidematch.sources.reports import explode_lines

CHUNKS = [None, 3]


def lines_of(spark, *docs):
    rows = [("A", f"d{d}", i + 1, line) for d, ls in enumerate(docs) for i, line in enumerate(ls)]
    return spark.createDataFrame(rows, "side string, doc_id string, line_no int, line string")


def by_doc(df, *cols):
    out = {}
    for r in df.orderBy("doc_id", "line_no").collect():
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in cols))
    return out


def split_by_value(lines):
    """Pages as the stretches of lines under one value, blank edges cut off."""
    current = list(accumulate((x if x.startswith("k") else None for x in lines), lambda old, new: new or old))
    first = next((v for v in current if v), None)
    stretches = groupby(enumerate(lines, 1), key=lambda il: current[il[0] - 1] or first)
    out = []
    for _, stretch in stretches:
        stretch = list(stretch)
        full = [i for i, x in stretch if x.strip()]
        out += [[i for i, _ in stretch if full[0] <= i <= full[-1]]] if full else []
    return out or [list(range(1, len(lines) + 1))]


@pytest.mark.parametrize("chunk", CHUNKS)
def test_pages_by_value_change(spark, chunk):
    rng = random.Random(11)
    docs = [["k1", "-", "k1", "-", "k2", "-"], ["k1", "k2", "k1"], ["", " "]]
    docs += [[rng.choice(["k1", "k2", "k3", "x", "", " "]) for _ in range(rng.randint(1, 12))] for _ in range(40)]
    got = by_doc(
        pages.pages_by_value_change(lines_of(spark, *docs), r"k(\d)", chunk=chunk), "page_no", "line_no"
    )
    for d, ls in enumerate(docs):
        want = split_by_value(ls)
        assert got[f"d{d}"] == [(n + 1, i) for n, page in enumerate(want) for i in page]


def test_pages_by_delimiter(spark):
    texts = {
        "marks": "hdr\nPAGE 1\na\n\nb\n\nPAGE 2\nc\n",
        "feeds": "x\fy\r\n\r\n\fz",
        "rules": "a\n----------\nb\n\n__________\n",
        "of": "Page 1 of 2\na\n Page 2 of 2 \nb",
        "inline": "LIST PAGE 1\na\nLIST PAGE 2\nb",
        "none": "\na\n",
        "blank": " \n ",
    }
    docs = spark.createDataFrame([("A", k, v) for k, v in texts.items()], "side string, doc_id string, text string")
    got = {}
    for r in pages.pages_by_delimiter(docs).orderBy("pos").collect():
        got.setdefault(r.doc_id, []).append((r.page_no, r.line_no, r.line))
    assert got == {
        "marks": [(1, 1, "hdr"), (2, 3, "a"), (2, 4, ""), (2, 5, "b"), (3, 8, "c")],
        "feeds": [(1, 1, "x"), (2, 1, "y"), (3, 3, "z")],
        "rules": [(1, 1, "a"), (2, 3, "b")],
        "of": [(1, 2, "a"), (2, 4, "b")],
        "inline": [(1, 2, "a"), (2, 4, "b")],
        "none": [(1, 1, ""), (1, 2, "a"), (1, 3, "")],
        "blank": [(1, 1, " "), (1, 2, " ")],
    }


def strip_page(page, headers, footers):
    """Peel the page: the first header among its top lines, again and again; then up
    to as many times the last footer among its bottom lines."""
    left = dict(enumerate(x.strip() for x in page))
    role = {}
    while hits := [k for k in list(left)[:EDGE_LINES] if left[k] in headers]:
        role[hits[0]] = "header"
        del left[hits[0]]
    for _ in range(EDGE_LINES):
        hits = [k for k in list(left)[-EDGE_LINES:] if left[k] in footers]
        if hits:
            role[hits[-1]] = "footer"
            del left[hits[-1]]
    return [role.get(k, "body") for k in range(len(page))]


@pytest.mark.parametrize("chunk", CHUNKS)
def test_strip_repeating(spark, chunk):
    rng = random.Random(5)
    sheets = [[rng.choice(["H", "F", "a", "b", "----", " H "]) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    sheets.append(list("HHHHabcH"))
    rows, n = [], 0
    for p, sheet in enumerate(sheets):
        for line in sheet:
            n += 1
            rows.append(("A", "d0", n, line, p + 1))
    paged = spark.createDataFrame(rows, "side string, doc_id string, line_no int, line string, page_no int")
    repeating = spark.createDataFrame(
        [("A", "d0", "header", "H"), ("A", "d0", "footer", "F"), ("A", "d0", "footer", "H"), ("A", "d0", "footer", "----")],
        "side string, doc_id string, kind string, line string",
    )
    got = pages.strip_repeating(paged, repeating, r"-{4}", chunk=chunk).orderBy("line_no").collect()
    want = [
        r for s in sheets
        for r in strip_page(s, {"H"}, {"F", "H"})
    ]
    assert [r.role for r in got] == want


@pytest.mark.parametrize("chunk", CHUNKS)
def test_repeating_lines(spark, chunk):
    sheets = ["HabF", "HcdF", "HegF"]
    rows = [("A", "d0", p * 4 + i + 1, x, p + 1) for p, s in enumerate(sheets) for i, x in enumerate(s)]
    rows += [("A", "one", 1, "H", 1), ("A", "one", 2, "H", 1)]
    paged = spark.createDataFrame(rows, "side string, doc_id string, line_no int, line string, page_no int")
    got = {(r.doc_id, r.kind, r.line, r.n) for r in pages.repeating_lines(paged, chunk=chunk).collect()}
    assert got == {("d0", "header", "H", 3), ("d0", "footer", "F", 3)}
    kept = pages.repeating_lines(paged, "F", chunk=chunk).collect()
    assert [(r.kind, r.line) for r in kept] == [("header", "H")]


@pytest.mark.parametrize("chunk", CHUNKS)
def test_transactions(spark, chunk):
    doc = ["FND509B 009000", "a", "b", "total 1", "FND509B 009002", "c", ""]
    lines = lines_of(spark, doc)
    got = blocks.transactions(lines, r"FN[A-Z0-9]+\s(\d+)", 3, chunk=chunk)
    assert by_doc(got, "line_no", "txn_id", "sort_key")["d0"] == [
        (1, 1, "009000"), (2, 1, "009000"), (3, 1, "009000"), (5, 2, "009002"), (6, 2, "009002")
    ]
    dated = ["INVOICE NO: 7", "DATE: 2026-05-17", "x", "", "note", "", "5/7/2026 y"]
    got = blocks.transactions_by_date(lines_of(spark, dated), chunk=chunk)
    assert by_doc(got, "line_no", "txn_id", "sort_key")["d0"] == [
        (1, 1, "2026-05-17"), (2, 1, "2026-05-17"), (3, 1, "2026-05-17"), (7, 2, "5/7/2026")
    ]


@pytest.mark.parametrize("chunk", CHUNKS)
def test_sections(spark, chunk):
    recap = ["RECAP TOTALS", "x 1", "-" * 20, "", "CARD TOTALS", "y 2", "-" * 20, " "]
    got = blocks.summary_sections(lines_of(spark, recap), r"[-]{20,}$", chunk=chunk)
    assert by_doc(got, "line_no", "block_no", "block_name")["d0"] == [
        (1, 1, "RECAP TOTALS"), (2, 1, "RECAP TOTALS"), (4, 2, "CARD TOTALS"),
        (5, 2, "CARD TOTALS"), (6, 2, "CARD TOTALS"),
    ]
    marked = pages.page_sections(lines_of(spark, ["x", "PAGE 1", "a", "Page 2"]), chunk=chunk)
    docs = spark.createDataFrame([("A", "d0"), ("A", "empty")], "side string, doc_id string")
    listed = pages.section_list(marked, docs, chunk=chunk).orderBy("doc_id", "ordinal").collect()
    assert [(r.doc_id, r.ordinal, r.section_title, r.n_lines) for r in listed] == [
        ("d0", 1, "Page 0", 1), ("d0", 2, "Page 1", 1), ("d0", 3, "Page 2", 0), ("empty", 1, "Page 0", 0)
    ]


def test_explode_lines(spark):
    docs = spark.createDataFrame([("A", "d", "a\r\nb\rc\n")], "side string, doc_id string, text string")
    assert [(r.line_no, r.line) for r in explode_lines(docs).collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "")]


def test_filters(spark):
    lines = lines_of(spark, ["keep", "drop me", " ", "x1", " "])
    kept = pages.non_blank(pages.drop_matching(lines, ["^drop", r"\d"]))
    assert [r.line for r in kept.collect()] == ["keep"]
    assert lines.where(F.col("line") == "keep").count() == 1


@pytest.mark.parametrize("chunk", CHUNKS)
def test_sections_among_other_lines(spark, chunk):
    """Headers between body lines open no section, so roles and sections are written together."""
    lines = ["x", "PAGE 1", "a", "PAGE 7", "b", "PAGE 2", "c", "", "PAGE 3", "d"]
    rows = [(s, 1, i + 1, x, "header" if x == "PAGE 7" or s == "B" and i < 3 else "body") for s in "AB" for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "side string, doc_id long, line_no long, line string, role string")
    body = F.col("role") == "body"
    want = pages.page_sections(df.where(body), chunk=chunk)
    got = pages.page_sections(df, chunk=chunk, among=body).where(body)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
