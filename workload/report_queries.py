"""Queries over paged reports: pages, headers, blocks and their comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from sidematch.functions.dates import mask_dates
from sidematch.operators import blocks, pages, pairing, rollup
from sidematch.operators.pages import non_blank
from sidematch.session import materialize
from sidematch.sources.reports import explode_lines
from workload.registry import query
from workload.sides import REPORT_GROWTH, REPORT_SQL, line_slices, report_docs
from workload.text_queries import DATE_SQL, STATS_SQL, SLICE_LINES, WS, mask_sql, strip_sql

SPLIT = r"PAGE (\d+)"
SORT = r"^TXN (\d+)"
SEPARATOR = r"[-]{20,}$"
CAP = 2
DOC = ["side", "doc_id"]
NB = f"regexp_matches(line, '[^{WS}]')"


def reports(spark, sf_dir):
    """Report documents, their lines, and the slice width for them."""
    docs = report_docs(spark, sf_dir)
    return docs, explode_lines(docs), line_slices(spark, sf_dir, REPORT_GROWTH, SLICE_LINES)


def _trim_sql(source, block, out):
    """Trim the blank edges of ``block`` and number the blocks left."""
    return f"""
    e_{out} AS (SELECT *, min(CASE WHEN {NB} THEN line_no END) OVER w AS lo,
                  max(CASE WHEN {NB} THEN line_no END) OVER w AS hi
                FROM {source} WINDOW w AS (PARTITION BY side, doc_id, {block})),
    {out} AS (SELECT side, doc_id, line_no, line, {block},
                dense_rank() OVER (PARTITION BY side, doc_id ORDER BY {block}) AS page_no
              FROM e_{out} WHERE line_no BETWEEN lo AND hi)"""


@query("trim_blocks", f"""WITH {REPORT_SQL},
    x AS (SELECT *, (line_no - 1) // 6 AS block FROM lines WHERE line <> 'LEDGER REPORT'),
    {_trim_sql('x', 'block', 'kept')}
    SELECT side, doc_id, line_no, line, block, page_no AS block_no FROM kept""")
def trim_blocks(spark, sf_dir):
    _, lines, chunk = reports(spark, sf_dir)
    cut = lines.where("line <> 'LEDGER REPORT'").withColumn("block", F.expr("(line_no - 1) div 6"))
    return pages.trim_blocks(cut, "block", "block_no", chunk=chunk)


VALUE_PAGES_SQL = f"""
    m AS (SELECT *, nullif(regexp_extract(line, '{SPLIT}', 1), '') AS v FROM lines),
    c AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY side, doc_id ORDER BY line_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM m),
    p AS (SELECT side, doc_id, line_no, line, count(*) FILTER (WHERE v <> pv) OVER (
            PARTITION BY side, doc_id ORDER BY line_no) AS raw_page FROM c),
    {_trim_sql('p', 'raw_page', 'paged')}"""


@query("pages_value_change", f"""WITH {REPORT_SQL}, {VALUE_PAGES_SQL}
    SELECT side, doc_id, line_no, line, page_no FROM paged""")
def pages_value_change(spark, sf_dir):
    _, lines, chunk = reports(spark, sf_dir)
    return pages.pages_by_value_change(lines, SPLIT, chunk=chunk)


@query("pages_delimiter", f"""WITH {REPORT_SQL},
    d AS (SELECT *, regexp_matches(line, '^\\s*PAGE\\s+\\d+\\s*$') AS cut FROM lines),
    p AS (SELECT side, doc_id, line_no, line, cut, count(*) FILTER (WHERE cut) OVER (
            PARTITION BY side, doc_id ORDER BY line_no) AS raw_page FROM d),
    q AS (SELECT * FROM p WHERE NOT cut),
    {_trim_sql('q', 'raw_page', 'paged')}
    SELECT side, doc_id, line_no, line, page_no FROM paged""")
def pages_delimiter(spark, sf_dir):
    return pages.pages_by_delimiter(report_docs(spark, sf_dir)).drop("pos")


HEADERS_SQL = f"""
    edge AS (SELECT *, row_number() OVER (PARTITION BY side, doc_id, page_no ORDER BY line_no) AS t,
               row_number() OVER (PARTITION BY side, doc_id, page_no ORDER BY line_no DESC) AS b FROM paged),
    np AS (SELECT side, doc_id, max(page_no) AS n_pages FROM paged GROUP BY ALL),
    ec AS (SELECT side, doc_id, 'header' AS kind, {strip_sql('line')} AS line FROM edge WHERE t <= 3
           UNION ALL
           SELECT side, doc_id, 'footer', {strip_sql('line')} FROM edge
           WHERE b <= 3 AND NOT regexp_matches(line, '^(?:{SEPARATOR})')),
    repeating AS (
      SELECT ec.side, ec.doc_id, kind, line, count(*) AS n FROM ec JOIN np
        ON ec.side = np.side AND ec.doc_id = np.doc_id
      WHERE n_pages >= 2 AND line <> '' GROUP BY ec.side, ec.doc_id, kind, line, n_pages
      HAVING count(*) >= greatest(2, floor(n_pages * 0.6::DOUBLE)))"""


def _paged(spark, sf_dir):
    docs, lines, chunk = reports(spark, sf_dir)
    return pages.pages_by_value_change(lines, SPLIT, chunk=chunk), chunk


@query("repeating_headers", f"""WITH {REPORT_SQL}, {VALUE_PAGES_SQL}, {HEADERS_SQL}
    SELECT * FROM repeating""")
def repeating_headers(spark, sf_dir):
    paged, chunk = _paged(spark, sf_dir)
    return pages.repeating_lines(paged, SEPARATOR, chunk=chunk)


ROLES_SQL = f"""
    f0 AS (SELECT p.side, p.doc_id, p.page_no, p.line_no, p.line,
             EXISTS (SELECT 1 FROM repeating r WHERE r.kind = 'header' AND r.side = p.side
                     AND r.doc_id = p.doc_id AND r.line = {strip_sql('p.line')}) AS h,
             EXISTS (SELECT 1 FROM repeating r WHERE r.kind = 'footer' AND r.side = p.side
                     AND r.doc_id = p.doc_id AND r.line = {strip_sql('p.line')})
               AND NOT regexp_matches(p.line, '^(?:{SEPARATOR})') AS f
           FROM paged p),
    f1 AS (SELECT *, h AND count(*) FILTER (WHERE NOT h) OVER (
             PARTITION BY side, doc_id, page_no ORDER BY line_no) < 3 AS is_h FROM f0),
    f2 AS (SELECT *, count(*) FILTER (WHERE NOT is_h AND NOT f) OVER w AS kept,
             count(*) FILTER (WHERE NOT is_h AND f) OVER w AS cut FROM f1
           WINDOW w AS (PARTITION BY side, doc_id, page_no ORDER BY line_no DESC
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    roles AS (SELECT side, doc_id, page_no, line_no, line,
                CASE WHEN is_h THEN 'header'
                     WHEN f AND coalesce(kept, 0) < 3 AND coalesce(cut, 0) < 3 THEN 'footer'
                     ELSE 'body' END AS role FROM f2)"""

PARSE_SQL = f"{REPORT_SQL}, {VALUE_PAGES_SQL}, {HEADERS_SQL}, {ROLES_SQL}"


def _roles(spark, sf_dir):
    paged, chunk = _paged(spark, sf_dir)
    # without slices both uses find the lines where the pages were counted
    paged = paged if chunk is None else materialize(paged)
    repeating = pages.repeating_lines(paged, SEPARATOR, chunk=chunk)
    return pages.strip_repeating(paged, repeating, SEPARATOR, chunk=chunk), chunk


@query("strip_headers", f"WITH {PARSE_SQL} SELECT * FROM roles")
def strip_headers(spark, sf_dir):
    return _roles(spark, sf_dir)[0]


TXN_SQL = f"""
    t0 AS (SELECT side, doc_id, line_no, line, nullif(regexp_extract(line, '{SORT}', 1), '') AS v
           FROM lines WHERE {NB}),
    t1 AS (SELECT *, count(v) OVER w AS t, last_value(v IGNORE NULLS) OVER w AS k FROM t0
           WINDOW w AS (PARTITION BY side, doc_id ORDER BY line_no)),
    t2 AS (SELECT *, row_number() OVER (PARTITION BY side, doc_id, t ORDER BY line_no) AS r FROM t1),
    txn AS (SELECT side, doc_id, line_no, line, t AS txn_id, k AS sort_key FROM t2
            WHERE t > 0 AND r <= {CAP})"""


def _transactions(spark, sf_dir, **kw):
    _, lines, chunk = reports(spark, sf_dir)
    found = blocks.transactions(non_blank(lines), SORT, CAP, chunk=chunk, has_blanks=False, **kw)
    return found, chunk


@query("txn_blocks", f"""WITH {REPORT_SQL}, {TXN_SQL} SELECT * FROM txn""")
def txn_blocks(spark, sf_dir):
    return _transactions(spark, sf_dir)[0]


@query("txn_date_blocks", f"""WITH {REPORT_SQL},
    g AS (SELECT *, count(*) FILTER (WHERE NOT {NB}) OVER (PARTITION BY side, doc_id ORDER BY line_no) AS run
          FROM lines),
    k AS (SELECT side, doc_id, run, arg_min(regexp_extract(line, '{DATE_SQL}'), line_no) AS sort_key
          FROM g WHERE {NB} AND regexp_matches(line, '{DATE_SQL}') GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY side, doc_id ORDER BY run) AS txn_id FROM k)
    SELECT g.side, g.doc_id, line_no, line, txn_id, sort_key FROM g JOIN n
      ON g.side = n.side AND g.doc_id = n.doc_id AND g.run = n.run WHERE {NB}""")
def txn_date_blocks(spark, sf_dir):
    _, lines, chunk = reports(spark, sf_dir)
    return blocks.transactions_by_date(lines, chunk=chunk)


@query("txn_extract", f"""WITH {REPORT_SQL}, {TXN_SQL}
    SELECT side, doc_id, sort_key, sort_key::DOUBLE AS key_number, txn_id, line_no, line FROM txn""")
def txn_extract(spark, sf_dir):
    found, _ = _transactions(spark, sf_dir)
    return blocks.extract_transactions(found).select(
        "side", "doc_id", "sort_key", F.col("sort_val.num").alias("key_number"), "txn_id", "line_no", "line"
    )


SUMMARY_SQL = f"""{TXN_SQL},
    s0 AS (SELECT l.side, l.doc_id, l.line_no, l.line, t.txn_id,
             regexp_matches(l.line, '^(?:{SEPARATOR})') AS sep
           FROM lines l LEFT JOIN txn t ON l.side = t.side AND l.doc_id = t.doc_id AND l.line_no = t.line_no
           WHERE regexp_matches(l.line, '[^{WS}]')),
    s1 AS (SELECT *, count(*) FILTER (WHERE sep) OVER (PARTITION BY side, doc_id ORDER BY line_no) AS raw
           FROM s0),
    s2 AS (SELECT * FROM s1 WHERE NOT sep AND txn_id IS NULL),
    summary AS (SELECT side, doc_id, line_no, line,
      dense_rank() OVER (PARTITION BY side, doc_id ORDER BY raw) AS block_no,
      {strip_sql('first_value(line) OVER (PARTITION BY side, doc_id, raw ORDER BY line_no)')} AS block_name
      FROM s2)"""


def _summary(spark, sf_dir):
    found, chunk = _transactions(spark, sf_dir, keep_unowned=True)
    return blocks.summary_sections(found, SEPARATOR, chunk=chunk).drop("txn_id", "sort_key"), chunk


@query("summary_blocks", f"WITH {REPORT_SQL}, {SUMMARY_SQL} SELECT * FROM summary")
def summary_blocks(spark, sf_dir):
    return _summary(spark, sf_dir)[0]


@query("page_sections", f"""WITH {REPORT_SQL},
    x AS (SELECT *, nullif(regexp_extract(line, '{pages.PAGE_MARKER}', 1), '') AS v FROM lines),
    y AS (SELECT *, count(v) OVER w AS section_id, last_value(v IGNORE NULLS) OVER w AS n FROM x
          WINDOW w AS (PARTITION BY side, doc_id ORDER BY line_no)),
    z AS (SELECT side, doc_id, section_id, 'Page ' || coalesce(any_value(n), '0') AS section_title,
            count(*) FILTER (WHERE v IS NULL) AS n_lines,
            count(*) FILTER (WHERE v IS NULL AND {NB}) AS n_filled FROM y GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY side, doc_id ORDER BY section_id) AS ordinal FROM z""")
def page_sections(spark, sf_dir):
    docs, lines, chunk = reports(spark, sf_dir)
    return pages.section_list(pages.page_sections(lines, chunk=chunk), docs, chunk=chunk)


def one_side(df, side):
    return df.where(F.col("side") == side).drop("side")


def _counts_sql(source, group, line="line"):
    """na, nb and common per group of a table with a side column."""
    return f"""
    kc AS (SELECT {group}, {line} AS line, count(*) FILTER (WHERE side = 'A') AS a,
             count(*) FILTER (WHERE side = 'B') AS b FROM {source} GROUP BY ALL),
    ks AS (SELECT {group}, sum(a)::BIGINT AS na, sum(b)::BIGINT AS nb,
             sum(least(a, b))::BIGINT AS common FROM kc GROUP BY ALL)"""


_STATUS_SQL = "CASE WHEN na > 0 AND nb > 0 THEN 'matched' WHEN na > 0 THEN 'removed' ELSE 'added' END"

COMPARE_TXN_SQL = f"""{TXN_SQL},
    o0 AS (SELECT DISTINCT side, doc_id, sort_key, txn_id FROM txn),
    o1 AS (SELECT *, row_number() OVER (PARTITION BY side, doc_id, sort_key ORDER BY txn_id) AS occ FROM o0),
    o2 AS (SELECT txn.*, occ FROM txn JOIN o1 USING (side, doc_id, txn_id)),
    {_counts_sql('o2', 'doc_id, sort_key, occ', mask_sql('line'))},
    txn_cmp AS (SELECT doc_id, sort_key, occ, na AS lines_a, nb AS lines_b, {STATS_SQL},
                  {_STATUS_SQL} AS status FROM ks)"""


def _compare_txns(spark, sf_dir):
    found, chunk = _transactions(spark, sf_dir)
    found = materialize(found)
    return pairing.compare_transactions(
        one_side(found, "A"), one_side(found, "B"), ["doc_id"], normalize=mask_dates, chunk=chunk
    )


@query("compare_txns", f"""WITH {REPORT_SQL}, {COMPARE_TXN_SQL} SELECT * FROM txn_cmp""")
def compare_txns(spark, sf_dir):
    return _compare_txns(spark, sf_dir).drop("sort_val")


_PCT_SQL = "CASE WHEN status IN ('added', 'removed') THEN 0.0::DOUBLE ELSE round(similarity_ratio * 100, 1) END"


@query("txn_compare_csv", f"""WITH {REPORT_SQL}, {COMPARE_TXN_SQL}
    SELECT doc_id, sort_key, occ, status, {_PCT_SQL} AS similarity_pct, lines_added, lines_deleted
    FROM txn_cmp""")
def txn_compare_csv(spark, sf_dir):
    return pairing.txn_result(_compare_txns(spark, sf_dir), ["doc_id"])


COMPARE_SUMMARY_SQL = f"""{SUMMARY_SQL},
    {_counts_sql('summary', 'doc_id, block_no')},
    nm AS (SELECT doc_id, block_no, coalesce(max(block_name) FILTER (WHERE side = 'A'),
             max(block_name) FILTER (WHERE side = 'B')) AS section_name FROM summary GROUP BY ALL),
    k2 AS (SELECT doc_id, block_no, na, nb, {STATS_SQL}, {_STATUS_SQL} AS st FROM ks),
    sum_cmp AS (SELECT k2.doc_id, k2.block_no, section_name, lines_added, lines_deleted, similarity_ratio,
      CASE WHEN st <> 'matched' THEN st WHEN similarity_ratio = 1 THEN 'identical' ELSE 'changed' END AS status
      FROM k2 JOIN nm ON k2.doc_id = nm.doc_id AND k2.block_no = nm.block_no)"""


def _compare_summary(spark, sf_dir):
    found, _ = _summary(spark, sf_dir)
    found = materialize(found)
    return rollup.compare_summary_sections(one_side(found, "A"), one_side(found, "B"), ["doc_id"])


@query("summary_section_compare", f"""WITH {REPORT_SQL}, {COMPARE_SUMMARY_SQL}
    SELECT doc_id, block_no, section_name, status, similarity_ratio, lines_added, lines_deleted
    FROM sum_cmp""")
def summary_section_compare(spark, sf_dir):
    return _compare_summary(spark, sf_dir).select(
        "doc_id", "block_no", "section_name", "status", "similarity_ratio", "lines_added", "lines_deleted"
    )


@query("section_compare_csv", f"""WITH {REPORT_SQL}, {COMPARE_SUMMARY_SQL}
    SELECT doc_id, section_name, block_no, status, {_PCT_SQL} AS similarity_pct, lines_added, lines_deleted
    FROM sum_cmp""")
def section_compare_csv(spark, sf_dir):
    return pairing.section_result(_compare_summary(spark, sf_dir), ["doc_id"])


COMPARE_PAGES_SQL = f"""
    body AS (SELECT * FROM roles WHERE role = 'body'),
    filled AS (SELECT * FROM body WHERE {NB}),
    both_docs AS (SELECT doc_id FROM lines GROUP BY doc_id HAVING count(DISTINCT side) = 2),
    pg AS (SELECT doc_id, page_no, bool_or(side = 'A') AS in_a, bool_or(side = 'B') AS in_b
           FROM paged GROUP BY ALL),
    multi AS (SELECT doc_id FROM paged JOIN both_docs USING (doc_id) GROUP BY doc_id HAVING max(page_no) > 1),
    {_counts_sql('filled', 'doc_id, page_no')},
    raw_n AS (SELECT doc_id, page_no, count(*) AS raw_lines FROM body GROUP BY ALL),
    rng AS (SELECT doc_id, page_no, min(line_no) FILTER (WHERE side = 'A') AS first_a,
              max(line_no) FILTER (WHERE side = 'A') AS last_a,
              min(line_no) FILTER (WHERE side = 'B') AS first_b,
              max(line_no) FILTER (WHERE side = 'B') AS last_b FROM filled GROUP BY ALL),
    pj AS (SELECT pg.doc_id, pg.page_no, in_a, in_b, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb,
             coalesce(common, 0) AS common, coalesce(raw_lines, 0) AS raw_lines,
             first_a, last_a, first_b, last_b
           FROM pg JOIN multi USING (doc_id) LEFT JOIN ks ON ks.doc_id = pg.doc_id AND ks.page_no = pg.page_no
           LEFT JOIN raw_n r ON r.doc_id = pg.doc_id AND r.page_no = pg.page_no
           LEFT JOIN rng ON rng.doc_id = pg.doc_id AND rng.page_no = pg.page_no),
    page_cmp AS (SELECT *, {STATS_SQL}, CASE WHEN in_a AND in_b THEN 'matched' WHEN in_a THEN 'removed'
                   ELSE 'added' END AS status FROM pj)"""


def _compare_pages(spark, sf_dir):
    rows, _ = _roles(spark, sf_dir)
    rows = materialize(rows)
    return rollup.compare_pages(one_side(rows, "A"), one_side(rows, "B"), ["doc_id"])


@query("compare_pages", f"""WITH {PARSE_SQL}, {COMPARE_PAGES_SQL}
    SELECT doc_id, page_no, status,
      CASE WHEN status = 'matched' THEN similarity_ratio END AS similarity_ratio,
      CASE WHEN status = 'matched' THEN lines_added END AS lines_added,
      CASE WHEN status = 'matched' THEN lines_deleted END AS lines_deleted,
      CASE WHEN status <> 'matched' THEN raw_lines END AS n_lines,
      CASE WHEN status = 'matched' THEN first_a END AS first_a,
      CASE WHEN status = 'matched' THEN last_a END AS last_a,
      CASE WHEN status = 'matched' THEN first_b END AS first_b,
      CASE WHEN status = 'matched' THEN last_b END AS last_b
    FROM page_cmp""")
def compare_pages(spark, sf_dir):
    return _compare_pages(spark, sf_dir)


@query("status_counts", f"""WITH {PARSE_SQL}, {COMPARE_PAGES_SQL},
    st AS (SELECT doc_id, CASE WHEN status <> 'matched' THEN status WHEN similarity_ratio = 1 THEN 'identical'
             WHEN similarity_ratio >= 0.85 THEN 'minor' WHEN similarity_ratio >= 0.6 THEN 'moderate'
             ELSE 'significant' END AS s FROM page_cmp)
    SELECT doc_id, count(*) FILTER (WHERE s = 'identical') AS identical,
      count(*) FILTER (WHERE s = 'minor') AS minor, count(*) FILTER (WHERE s = 'moderate') AS moderate,
      count(*) FILTER (WHERE s = 'significant') AS significant, count(*) FILTER (WHERE s = 'added') AS added,
      count(*) FILTER (WHERE s = 'removed') AS removed FROM st GROUP BY doc_id""")
def status_counts(spark, sf_dir):
    return rollup.status_counts(_compare_pages(spark, sf_dir), ["doc_id"])


@query("header_footer_diff", f"""WITH {REPORT_SQL}, {VALUE_PAGES_SQL}, {HEADERS_SQL},
    hf AS (SELECT doc_id, kind, line, bool_or(side = 'A') AS a, bool_or(side = 'B') AS b
          FROM repeating GROUP BY ALL)
    SELECT doc_id,
      coalesce(list(line ORDER BY line) FILTER (WHERE kind = 'header' AND a AND NOT b), []) AS headers_only_in_a,
      coalesce(list(line ORDER BY line) FILTER (WHERE kind = 'header' AND b AND NOT a), []) AS headers_only_in_b,
      coalesce(list(line ORDER BY line) FILTER (WHERE kind = 'header' AND a AND b), []) AS headers_common,
      coalesce(list(line ORDER BY line) FILTER (WHERE kind = 'footer' AND a AND NOT b), []) AS footers_only_in_a,
      coalesce(list(line ORDER BY line) FILTER (WHERE kind = 'footer' AND b AND NOT a), []) AS footers_only_in_b,
      coalesce(list(line ORDER BY line) FILTER (WHERE kind = 'footer' AND a AND b), []) AS footers_common
    FROM hf GROUP BY doc_id""")
def header_footer_diff(spark, sf_dir):
    paged, chunk = _paged(spark, sf_dir)
    return rollup.header_footer_diff(pages.repeating_lines(paged, SEPARATOR, chunk=chunk), ["doc_id"])
