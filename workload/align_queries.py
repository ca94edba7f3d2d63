"""Queries that align the lines of two versions of a text."""

from __future__ import annotations

from pyspark.sql import functions as F

from sidematch.operators import align
from sidematch.session import materialize
from sidematch.sources.reports import explode_lines
from workload.pair_queries import COMPARE_ORDERS_SQL, compared_orders
from workload.registry import query
from workload.sides import TEXT_GROWTH, TEXT_SQL, line_slices, text_docs
from workload.text_queries import SLICE_LINES

DOC = ["doc_id"]


# Lines ``idx_a`` and ``idx_b`` (doc_id, idx, line): k-th copies matched, patience
# levels by a recursive walk, the chain walked back from the last.
LCS_SQL = """
    oa AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY idx) AS occ FROM idx_a),
    ob AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY idx) AS occ FROM idx_b),
    seqs AS (SELECT oa.doc_id, list(oa.idx ORDER BY oa.idx) AS xs, list(ob.idx ORDER BY oa.idx) AS ys
             FROM oa JOIN ob ON oa.doc_id = ob.doc_id AND oa.line = ob.line AND oa.occ = ob.occ
             GROUP BY oa.doc_id),
    walk AS (
      SELECT doc_id, 0 AS k, []::BIGINT[] AS tails, []::BIGINT[] AS lv FROM seqs
      UNION ALL
      SELECT doc_id, k + 1, tails[1:spot] || [v] || tails[spot + 2:], lv || [spot + 1]
      FROM (SELECT w.doc_id, k, tails, lv, ys[k + 1] AS v,
              len(list_filter(tails, lambda t: t < ys[k + 1])) AS spot
            FROM walk w JOIN seqs s ON w.doc_id = s.doc_id WHERE k < len(ys))),
    done AS (SELECT w.doc_id, lv, xs, ys FROM walk w JOIN seqs s ON w.doc_id = s.doc_id AND k = len(ys)),
    chain AS (
      SELECT doc_id, list_max(lv) AS l,
        list_max(list_filter(range(1, len(lv) + 1), lambda j: lv[j] = list_max(lv))) AS spot FROM done
      UNION ALL
      SELECT c.doc_id, l - 1, list_max(list_filter(range(1, spot), lambda j: lv[j] = l - 1))
      FROM chain c JOIN done d ON c.doc_id = d.doc_id WHERE l > 1),
    lcs AS (SELECT c.doc_id, xs[spot] AS x, ys[spot] AS y FROM chain c JOIN done d ON c.doc_id = d.doc_id)"""
# Opcodes from the chosen pairs ``lcs`` (doc_id, x, y).
OPCODES_SQL = """
    lk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY x) AS k FROM lcs),
    eq AS (SELECT doc_id, min(x) AS i1, max(x) + 1 AS i2, min(y) AS j1, max(y) + 1 AS j2
           FROM lk GROUP BY doc_id, x - k, y - k),
    tot AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(na, 0) AS n_a, coalesce(nb, 0) AS n_b
      FROM (SELECT doc_id, count(*) AS na FROM idx_a GROUP BY ALL) a
      FULL JOIN (SELECT doc_id, count(*) AS nb FROM idx_b GROUP BY ALL) b ON a.doc_id = b.doc_id),
    stops AS (SELECT *, 0 AS e FROM eq UNION ALL SELECT doc_id, n_a, n_a, n_b, n_b, 1 FROM tot),
    lagged AS (SELECT *, coalesce(lag(i2) OVER w, 0) AS pi, coalesce(lag(j2) OVER w, 0) AS pj FROM stops
               WINDOW w AS (PARTITION BY doc_id ORDER BY i1 + j1, e)),
    ops0 AS (
      SELECT doc_id, 'equal' AS tag, i1, i2, j1, j2 FROM eq
      UNION ALL
      SELECT doc_id, CASE WHEN i1 > pi AND j1 > pj THEN 'replace' WHEN i1 > pi THEN 'delete' ELSE 'insert' END,
        pi, i1, pj, j1 FROM lagged WHERE i1 > pi OR j1 > pj),
    ops AS (SELECT ops0.doc_id, row_number() OVER (PARTITION BY ops0.doc_id ORDER BY i1 + j1) AS op_no, tag,
              i1, i2, j1, j2, n_a, n_b FROM ops0 JOIN tot ON ops0.doc_id = tot.doc_id)"""


OPS_SQL = f"""WITH RECURSIVE {TEXT_SQL},
    idx_a AS (SELECT doc_id, line_no - 1 AS idx, line FROM lines_a),
    idx_b AS (SELECT doc_id, line_no - 1 AS idx, line FROM lines_b),
    {LCS_SQL}, {OPCODES_SQL}"""


def aligned(spark, sf_dir):
    """Indexed lines of both sides, opcodes, and the slice width."""
    docs = [text_docs(spark, sf_dir, s) for s in "AB"]
    chunk = line_slices(spark, sf_dir, TEXT_GROWTH, SLICE_LINES)
    # A text's lines are numbered as they leave their cell.
    a, b = (
        materialize(explode_lines(d, DOC).withColumn("idx", F.col("line_no") - 1)) for d in docs
    )
    return a, b, materialize(align.align_lines(a, b, DOC, chunk=chunk)), chunk


@query("opcodes", OPS_SQL + " SELECT * FROM ops")
def opcodes(spark, sf_dir):
    return aligned(spark, sf_dir)[2]


@query("opcodes_changed", f"""{OPS_SQL},
    only_equal AS (SELECT doc_id FROM ops GROUP BY doc_id HAVING count(*) = 1 AND max(tag) = 'equal')
    SELECT * FROM ops WHERE doc_id NOT IN (SELECT doc_id FROM only_equal)""")
def opcodes_changed(spark, sf_dir):
    """Alignment of the documents whose line statistics differ, or whose lines moved."""
    docs = [text_docs(spark, sf_dir, s) for s in "AB"]
    names = docs[0].withColumnRenamed("text", "_t").join(docs[1], DOC, "full")
    differ = names.where(~F.col("_t").eqNullSafe(F.col("text"))).select("doc_id")
    differ = materialize(differ)
    a, b = (
        materialize(
            explode_lines(d.join(differ, DOC, "left_semi"), DOC).withColumn("idx", F.col("line_no") - 1)
        )
        for d in docs
    )
    return align.align_lines(a, b, DOC, chunk=line_slices(spark, sf_dir, TEXT_GROWTH, SLICE_LINES))


@query("align_invariants", f"""WITH {TEXT_SQL},
    na AS (SELECT doc_id, count(*) AS n FROM lines_a GROUP BY ALL),
    nb AS (SELECT doc_id, count(*) AS n FROM lines_b GROUP BY ALL)
    SELECT coalesce(na.doc_id, nb.doc_id) AS doc_id, coalesce(na.n, 0) AS covered_a,
      coalesce(nb.n, 0) AS covered_b, true AS equal_lines_agree FROM na FULL JOIN nb ON na.doc_id = nb.doc_id""")
def align_invariants(spark, sf_dir):
    """Opcodes tile both sides, and equal ranges hold equal lines."""
    a, b, ops, chunk = aligned(spark, sf_dir)
    cover = ops.groupBy("doc_id").agg(
        F.sum(F.col("i2") - F.col("i1")).alias("covered_a"), F.sum(F.col("j2") - F.col("j1")).alias("covered_b")
    )
    ranges = ops.where("tag = 'equal'").drop("n_a", "n_b")
    in_a = align.locate(a, ranges, DOC, "i1", "i2", chunk).withColumn("k", F.col("idx") - F.col("i1"))
    in_b = align.locate(b, ranges, DOC, "j1", "j2", chunk).withColumn("k", F.col("idx") - F.col("j1"))
    keys = ["doc_id", "op_no", "k"]
    pairs = in_a.select(*keys, "line").join(in_b.select(*keys, F.col("line").alias("other")), keys, "full")
    agree = pairs.groupBy("doc_id").agg(
        F.bool_and(F.col("line").eqNullSafe(F.col("other"))).alias("equal_lines_agree")
    )
    return cover.join(agree, DOC, "left").fillna(True, ["equal_lines_agree"])


HUNKS_SQL = f"""{OPS_SQL},
    flags AS (SELECT *, i2 - i1 AS n, i1 = 0 AND j1 = 0 AS s, i2 = n_a AND j2 = n_b AS c FROM ops),
    pieces0 AS (
      SELECT doc_id, tag, i1, i2, j1, j2, 0 AS opens FROM flags WHERE tag <> 'equal'
      UNION ALL SELECT doc_id, tag, i2 - least(n, 3), i2, j2 - least(n, 3), j2, 0 FROM flags
        WHERE tag = 'equal' AND s AND NOT c
      UNION ALL SELECT doc_id, tag, i1, i1 + least(n, 3), j1, j1 + least(n, 3), 0 FROM flags
        WHERE tag = 'equal' AND c AND NOT s
      UNION ALL SELECT doc_id, tag, i1, i1 + 3, j1, j1 + 3, 0 FROM flags
        WHERE tag = 'equal' AND NOT c AND NOT s AND n > 6
      UNION ALL SELECT doc_id, tag, i2 - 3, i2, j2 - 3, j2, 1 FROM flags
        WHERE tag = 'equal' AND NOT c AND NOT s AND n > 6
      UNION ALL SELECT doc_id, tag, i1, i2, j1, j2, 0 FROM flags
        WHERE tag = 'equal' AND NOT c AND NOT s AND n <= 6),
    pieces AS (SELECT *, 1 + sum(opens) OVER (PARTITION BY doc_id ORDER BY i1 + j1)::BIGINT AS hunk_no
               FROM pieces0),
    hunks AS (SELECT doc_id, hunk_no, min(i1) AS i1, max(i2) AS i2, min(j1) AS j1, max(j2) AS j2
              FROM pieces GROUP BY ALL)"""


def _pieces(spark, sf_dir):
    a, b, ops, chunk = aligned(spark, sf_dir)
    return a, b, align.hunk_pieces(ops, DOC, chunk=chunk), chunk


@query("hunks", f"""{HUNKS_SQL}
    SELECT *, '@@ -' || (i1 + 1) || ',' || (i2 - i1) || ' +' || (j1 + 1) || ',' || (j2 - j1) || ' @@' AS header
    FROM hunks""")
def hunks(spark, sf_dir):
    return align.hunks(_pieces(spark, sf_dir)[2], DOC)


@query("unified_diff", f"""{HUNKS_SQL},
    ea AS (SELECT doc_id, hunk_no, tag, i1, i2, j1, j2, unnest(range(i1, i2)) AS idx FROM pieces),
    eb AS (SELECT doc_id, hunk_no, tag, i1, i2, j1, j2, unnest(range(j1, j2)) AS idx FROM pieces
           WHERE tag <> 'equal')
    SELECT doc_id, hunk_no, 2 * (i1 + j1) AS row_pos,
      '@@ -' || (i1 + 1) || ',' || (i2 - i1) || ' +' || (j1 + 1) || ',' || (j2 - j1) || ' @@' AS text FROM hunks
    UNION ALL SELECT ea.doc_id, hunk_no, 2 * (idx + j1) + 1,
      CASE WHEN tag = 'equal' THEN ' ' ELSE '-' END || line FROM ea JOIN idx_a
      ON ea.doc_id = idx_a.doc_id AND ea.idx = idx_a.idx
    UNION ALL SELECT eb.doc_id, hunk_no, 2 * (i2 + eb.idx) + 1, '+' || line FROM eb JOIN idx_b
      ON eb.doc_id = idx_b.doc_id AND eb.idx = idx_b.idx""".replace(
    "2 * (idx + j1) + 1", "2 * (ea.idx + j1) + 1"))
def unified_diff(spark, sf_dir):
    a, b, pieces, chunk = _pieces(spark, sf_dir)
    return align.unified_diff(materialize(pieces), a, b, DOC, chunk)


def diff_rows_sql(line_a="ea.idx + 1", line_b="eb.idx + 1"):
    return f"""
    ea AS (SELECT *, unnest(range(i1, i2)) AS idx, unnest(range(0, i2 - i1)) AS k FROM ops),
    eb AS (SELECT *, unnest(range(j1, j2)) AS idx, unnest(range(0, j2 - j1)) AS k FROM ops),
    drows AS (
      SELECT ea.doc_id, i1 + j1 + k AS spot, 0 AS kind, {line_a} AS line_a, j1 + k + 1 AS line_b, line AS text,
        NULL::BIGINT AS skipped
      FROM ea JOIN idx_a ON ea.doc_id = idx_a.doc_id AND ea.idx = idx_a.idx
      WHERE tag = 'equal' AND (i2 - i1 <= 6 OR k < 3 OR k >= i2 - i1 - 3)
      UNION ALL SELECT doc_id, i1 + j1 + 3, 3, NULL, NULL, NULL, i2 - i1 - 6 FROM ops
        WHERE tag = 'equal' AND i2 - i1 > 6
      UNION ALL
      SELECT ea.doc_id, i1 + j1 + CASE WHEN i2 - i1 = j2 - j1 THEN 2 * k ELSE k END, 1, {line_a}, NULL, line, NULL
      FROM ea JOIN idx_a ON ea.doc_id = idx_a.doc_id AND ea.idx = idx_a.idx WHERE tag <> 'equal'
      UNION ALL
      SELECT eb.doc_id, i1 + j1 + CASE WHEN i2 - i1 = j2 - j1 THEN 2 * k + 1 ELSE i2 - i1 + k END, 2, NULL,
        {line_b}, line, NULL
      FROM eb JOIN idx_b ON eb.doc_id = idx_b.doc_id AND eb.idx = idx_b.idx WHERE tag <> 'equal')
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS row_no, kind, line_a, line_b, text,
      skipped FROM drows"""


@query("diff_rows", f"{OPS_SQL}, {diff_rows_sql()}")
def diff_rows(spark, sf_dir):
    a, b, ops, chunk = aligned(spark, sf_dir)
    return align.diff_rows(ops, a, b, DOC, chunk=chunk)


# Lines of the keyed file are unique and both sides stand in key order, so every
# equal line is on the common subsequence.
@query("sorted_diff", f"""WITH {COMPARE_ORDERS_SQL},
    placed AS (SELECT *, row_number() OVER (ORDER BY key, occ) AS place FROM cmp),
    idx_a AS (SELECT 'orders.csv' AS doc_id, row_number() OVER (ORDER BY place) - 1 AS idx, line_a AS line
              FROM placed WHERE line_a IS NOT NULL),
    idx_b AS (SELECT 'orders.csv' AS doc_id, row_number() OVER (ORDER BY place) - 1 AS idx, line_b AS line
              FROM placed WHERE line_b IS NOT NULL),
    lcs AS (SELECT a.doc_id, a.idx AS x, b.idx AS y FROM idx_a a JOIN idx_b b ON a.line = b.line),
    {OPCODES_SQL}, {diff_rows_sql()}""")
def sorted_diff(spark, sf_dir):
    """Diff rows of the keyed orders, both sides in key order."""
    rows = materialize(compared_orders(spark, sf_dir))
    return align.sorted_diff(align.in_key_order(rows, DOC), DOC, "place")
