"""Two folders end to end: files in, result tables and CSV files out."""

import csv
import glob

from sidematch.plans.compare import Options, compare_files, compare_folders, write_results
from sidematch.sources.reports import read_lines, read_reports
from sidematch.sources.rules import Rule


def ledger(n, amounts, total):
    out = []
    for p in range(n):
        out += [f"PAGE {p + 1}", "LEDGER", f"FN1 00{p + 1}", f"amount {amounts[p]}", "note 2026-01-02", "LAST LINE"]
    return "\r\n".join(out + ["-" * 20, "TOTALS", f"sum {total}", "-" * 20]) + "\r\n"


def test_compare_folders(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for d in (a, b, a / "sub"):
        d.mkdir(exist_ok=True)
    (a / "TER 1.TXT").write_text(ledger(3, [1, 2, 3], 6))
    (b / "ter 1.txt").write_text(ledger(3, [1, 5, 3], 9))
    (a / "same.txt").write_text("x\ny")
    (b / "same.txt").write_text("x\ny")
    (a / "list_v1.csv").write_text("key,val\nK000002,b\nK000001,a\n")
    (b / "list_v2.csv").write_text("key,val\nK000001,a\nK000002,c\nK000003,d\n")
    (a / "lonely_document.txt").write_bytes(b"bad \xff byte")
    (a / "sub" / "deep.txt").write_text("never read")
    (b / "skipped.log").write_text("other kind")
    rules = [
        Rule("(?i)^ter", r"PAGE\s+(\d+)", r"^FN\d\s(\d+)", 2, "[-]{20,}$"),
        Rule(r".*\.csv", key_slices=((0, 7),), has_header=True),
    ]
    docs = read_reports(spark, str(a), "A", [".txt", ".CSV"])
    assert {r.file_name for r in docs.collect()} == {"TER 1.TXT", "same.txt", "list_v1.csv", "lonely_document.txt"}
    result = compare_folders(
        spark, str(a), str(b), rules, Options(fuzzy=True, transactions=True, extract=True, semantic=True, part_diffs=True),
        [".txt", ".csv"],
    )
    pairs = {r.pair_name: (r.match_type, r.name_ratio) for r in result.pairs.collect() if r.pair_name}
    assert pairs == {
        "TER 1": ("exact", 1.0), "same": ("exact", 1.0), "list_v1_vs_list_v2": ("fuzzy", 0.9091),
        "lonely_document": ("only_in_a", None),
    }
    summary = {r.pair_id[2:]: r for r in result.summary.collect()}
    ter = summary["ter 1.txt"]
    assert (ter.page_count_a, ter.page_count_b, ter.sections_matched, ter.sections_with_changes) == (3, 3, 3, 2)
    assert ter.headers_common == ["LEDGER"]
    assert (summary["same.txt"].verdict_strict, summary["same.txt"].similarity_ratio) == ("IDENTICAL", 1.0)
    folder = result.folder.first()
    assert (folder.files_a, folder.files_b, folder.exact_pairs, folder.fuzzy_pairs, folder.only_in_a) == (4, 3, 2, 1, 1)
    assert (result.dashboard.first().pairs, result.dashboard.first().identical) == (3, 1)
    page = {r.page_no: r.similarity_ratio for r in result.pages.where("pair_id = 'A:ter 1.txt'").collect()}
    assert page[1] == 1.0 and page[2] < 1.0 and len(page) == 3
    assert result.diff_rows.where("pair_id = 'A:same.txt'").count() == 0
    ordered = result.diff_rows.where("pair_id = 'A:list_v1.csv'").orderBy("row_no").collect()
    assert [(r.kind, r.text) for r in ordered] == [
        (0, "key,val"), (0, "K000001,a"), (1, "K000002,b"), (2, "K000002,c"), (2, "K000003,d")]
    text = [r.text for r in result.unified_diff.where("pair_id = 'A:ter 1.txt'").orderBy("row_pos").collect()]
    assert "-amount 2" in text and "+amount 5" in text

    counts = {(r.pair_id[2:], r.part): (r.identical, r.minor + r.moderate + r.significant, r.added, r.removed)
              for r in result.status_counts.collect()}
    assert counts["ter 1.txt", "transaction"] == (2, 1, 0, 0) and counts["ter 1.txt", "summary"][1] == 1
    assert counts["list_v1.csv", "row"] == (1, 1, 1, 0)
    diffs = {}
    for r in result.part_diff_rows.where("pair_id = 'A:ter 1.txt' AND kind IN (1, 2)").orderBy("row_no").collect():
        diffs.setdefault((r.part, r.part_no), []).append(r.text)
    assert diffs["transaction", 2] == diffs["section", 2] == diffs["page", 2] == ["amount 2", "amount 5"]
    assert [x for (part, _), x in diffs.items() if part == "summary"] == [["sum 6", "sum 9"]]

    out = str(tmp_path / "out")
    write_results(result, out)

    def read(kind, pair, key="pair_name"):
        rows = []
        for path in sorted(glob.glob(f"{out}/{kind}/{key}={pair}/*.csv")):
            with open(path, newline="") as f:
                rows += [r for r in csv.reader(f)]
        return rows

    assert read("transactions", "TER 1") == [
        ["sort_key", "status", "similarity_pct", "lines_added", "lines_deleted"],
        ["001", "matched", "100.0", "0", "0"], ["002", "matched", "50.0", "1", "1"],
        ["003", "matched", "100.0", "0", "0"]]
    assert read("sections", "TER 1")[1:][-1] == ["TOTALS", "changed", "50.0", "1", "1"]
    assert read("rows", "list_v1_vs_list_v2") == [
        ["key", "status", "similarity_pct", "lines_added", "lines_deleted"],
        ["K000001", "matched", "100.0", "0", "0"], ["K000002", "matched", "0.0", "1", "1"],
        ["K000003", "added", "", "1", "0"]]
    assert read("extracts", "A_TER 1", "extract_name")[:2] == [["001", "FN1 001"], ["001", "amount 1"]]


def test_faults_names_and_two_files(spark, tmp_path):
    """An over-long and a vanished file spoil their own pairs only; equal stems give two
    results; two files are compared whatever their names."""
    a, b = tmp_path / "a", tmp_path / "b"
    for d in (a, b):
        d.mkdir()
        for name in ("report.txt", "Report.csv", "gone.txt"):
            (d / name).write_text("TXN 1\nsame\n" + ("TXN 2\n" if d is b else ""))
    (a / "huge.txt").write_text("x" * 500)
    (b / "huge.txt").write_text("x")
    rules = [Rule(".*", sort_pattern=r"^TXN (\d+)")]
    import sidematch.plans.compare as plan

    reading = plan.read_reports

    def vanishing(spark, path, *rest):
        docs = reading(spark, path, *rest)
        (a / "gone.txt").unlink(missing_ok=True)
        return docs

    plan.read_reports = vanishing
    try:
        result = compare_folders(spark, str(a), str(b), rules, Options(transactions=True), [".txt", ".csv"], max_bytes=400)
    finally:
        plan.read_reports = reading
    errors = {r.doc_a: r.error for r in result.pairs.collect()}
    assert errors == {"report.txt": None, "report.csv": None, "gone.txt": "could not be read", "huge.txt": "longer than 400 bytes"}
    folder = result.folder.first()
    assert (folder.exact_pairs, folder.errors) == (4, 2)
    assert {r.pair_id for r in result.summary.collect()} == {"A:report.txt", "A:report.csv"}
    assert {r.pair_name for r in result.pairs.collect()} == {"report.txt", "Report.csv", "gone", "huge"}
    out = str(tmp_path / "out")
    write_results(result, out)
    manifest = {(r.kind, r.name) for r in spark.read.csv(f"{out}/manifest", header=True).collect()}
    assert manifest == {("transactions", "report.txt"), ("transactions", "Report.csv")}

    two = compare_files(spark, str(a / "report.txt"), str(b / "Report.csv"), rules)
    assert [(r.file_a, r.file_b, r.match_type, r.error) for r in two.pairs.collect()] == [("report.txt", "Report.csv", "exact", None)]
    assert two.summary.first().lines_added == 1


def test_long_files_by_lines(spark, tmp_path):
    """Files too long for a cell are compared line by line, with the same results."""
    a, b = tmp_path / "a", tmp_path / "b"
    for d, amounts in ((a, [1, 2, 3]), (b, [1, 5, 3])):
        d.mkdir()
        (d / "ter [1].txt").write_text(ledger(3, amounts, 6))
        (d / "tiny.txt").write_text("x")
    rules = [Rule("(?i)^ter", r"PAGE\s+(\d+)", r"^FN\d\s(\d+)", 2)]
    by_text = compare_folders(spark, str(a), str(b), rules, Options(transactions=True))
    by_line = compare_folders(spark, str(a), str(b), rules, Options(transactions=True, stream_long=True), max_bytes=50)
    assert by_line.pairs.where("error IS NOT NULL").count() == 0
    for name in ("summary", "pages", "transactions"):
        left, right = (sorted(map(str, getattr(x, name).collect())) for x in (by_text, by_line))
        assert left == right and left, name


def test_read_lines(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = read_lines(spark, str(path), "A")
        assert got.rdd.getNumPartitions() > 1
        assert got.where("line = concat('line ', cast(line_no AS string))").count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
