"""Queries that pair names, titles, keyed rows and table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sidematch.functions import text
from sidematch.functions.dates import mask_dates
from sidematch.operators import pairing
from sidematch.operators.fuzzy import fuzzy_pairs
from sidematch.operators.titles import match_titles as pair_titles
from sidematch.sources.keyed import parse_keyed_rows
from sidematch.sources.rules import Rule, resolve_rules
from workload.registry import query
from workload.sides import (
    ITEM_COLUMNS, ITEM_SQL, NAME_SQL, ORDER_SQL, item_slice, items, named_docs, order_lines, table,
)
from workload.text_queries import ONE_BYTE, TOKENS_SQL, mask_sql, norm_sql, strip_sql

RULES = [
    Rule(r"^src1_.*", split_pattern=r"^INVOICE NO:\s+(\S+)"),
    Rule(r"_(fr|de)_", sort_pattern=r"FN[A-Z0-9]+\s(\d+)", max_txn_lines=3),
    Rule(r"7\.txt$", separator_pattern=r"\s*[-]{20,}\s*$"),
    Rule(r"^src[02468]_.*\.txt", key_slices=((0, 7),), has_header=True),
]


@query("rule_resolution", r"""SELECT doc_id, source || '_' || lang || '_' || doc_id || '.txt' AS file_name,
    CASE WHEN regexp_matches(file_name, '^src1_.*') THEN 1 WHEN regexp_matches(file_name, '_(fr|de)_') THEN 2
         WHEN regexp_matches(file_name, '7\.txt$') THEN 3
         WHEN regexp_matches(file_name, '^src[02468]_.*\.txt') THEN 4 END AS rule_no FROM documents""")
def rule_resolution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat(source, '_', lang, '_', cast(doc_id AS string), '.txt') AS file_name"
    )
    return resolve_rules(docs, RULES)


@query("pair_docs", f"""WITH {NAME_SQL}
    SELECT coalesce(a.match_name, b.match_name) AS match_name, a.doc_id::VARCHAR AS doc_a,
      b.doc_id::VARCHAR AS doc_b, CASE WHEN b.match_name IS NULL THEN 'only_in_a'
        WHEN a.match_name IS NULL THEN 'only_in_b' ELSE 'exact' END AS match_type
    FROM names_a a FULL JOIN names_b b ON a.match_name = b.match_name""")
def pair_docs(spark, sf_dir):
    return pairing.pair_docs(named_docs(spark, sf_dir, "A"), named_docs(spark, sf_dir, "B"))


@query("fuzzy_names", f"""WITH RECURSIVE {NAME_SQL},
    la AS (SELECT match_name AS a FROM names_a WHERE match_name NOT IN (SELECT match_name FROM names_b)),
    lb AS (SELECT match_name AS b FROM names_b WHERE match_name NOT IN (SELECT match_name FROM names_a)),
    ed AS (SELECT a, b, 1.0::DOUBLE - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) AS r
           FROM la, lb),
    edges AS (SELECT * FROM ed WHERE r >= 0.7::DOUBLE),
    rounds AS (
      SELECT a, b, r, row_number() OVER (PARTITION BY a ORDER BY r DESC, b) = 1
        AND row_number() OVER (PARTITION BY b ORDER BY r DESC, a) = 1 AS won FROM edges
      UNION ALL
      SELECT a, b, r, row_number() OVER (PARTITION BY a ORDER BY r DESC, b) = 1
        AND row_number() OVER (PARTITION BY b ORDER BY r DESC, a) = 1 AS won
      FROM rounds x WHERE NOT won AND a NOT IN (SELECT a FROM rounds WHERE won)
        AND b NOT IN (SELECT b FROM rounds WHERE won))
    SELECT a AS name_a, b AS name_b, round(r, 4) AS ratio FROM rounds WHERE won""")
def fuzzy_names(spark, sf_dir):
    names = pair_docs(spark, sf_dir)
    only = {
        t: names.where(F.col("match_type") == t).select(F.col("match_name").alias("name"))
        for t in ("only_in_a", "only_in_b")
    }
    return fuzzy_pairs(only["only_in_a"], only["only_in_b"])


ORDER_KEYS = [(0, 8)]


@query("keyed_parse", f"""WITH {ORDER_SQL}
    SELECT side, line_no, substr(line, 1, 8) || '|' || split_part(substr(line, 10), ',', 1) AS key,
      substr(line, 1, 8)::DOUBLE AS key_number, split_part(substr(line, 10), ',', 1)::DATE AS key_date,
      [substr(line, 1, 8), split_part(line, ',', 2), split_part(line, ',', 3),
       regexp_extract(line, '"(.*)"$', 1)] AS fields
    FROM order_rows WHERE NOT (side = 'A' AND line_no = (SELECT min(line_no) FROM order_rows WHERE side = 'A'))
      AND NOT (side = 'B' AND line_no = (SELECT min(line_no) FROM order_rows WHERE side = 'B'))""")
def keyed_parse(spark, sf_dir):
    lines = order_lines(spark, sf_dir, "A").withColumn("side", F.lit("A")).unionByName(
        order_lines(spark, sf_dir, "B").withColumn("side", F.lit("B"))
    )
    rows, _ = parse_keyed_rows(lines, [(0, 8), (9, None)], has_header=True)
    return rows.select(
        "side", "line_no", "key", F.col("sort_vals")[0]["num"].alias("key_number"),
        F.to_date(F.col("sort_vals")[1]["ts"]).alias("key_date"), "fields",
    )


def compared_orders(spark, sf_dir):
    sides = [
        parse_keyed_rows(order_lines(spark, sf_dir, s), ORDER_KEYS, by=["doc_id"])[0] for s in "AB"
    ]
    rows = [df.select("doc_id", "key", "line_no", "line", "sort_vals") for df in sides]
    return pairing.compare_rows(*rows, ["doc_id", "key"], normalize=mask_dates)


COMPARE_ORDERS_SQL = f"""{ORDER_SQL},
    kr AS (SELECT side, substr(line, 1, 8) AS key, line_no, line,
             row_number() OVER (PARTITION BY side, substr(line, 1, 8) ORDER BY line_no) AS occ FROM order_rows),
    cmp AS (SELECT coalesce(a.key, b.key) AS key, coalesce(a.occ, b.occ) AS occ, a.line AS line_a,
              b.line AS line_b, a.line_no AS no_a, b.line_no AS no_b,
              CASE WHEN b.key IS NULL THEN 'removed' WHEN a.key IS NULL THEN 'added' ELSE 'matched' END AS status,
              {mask_sql('a.line')} = {mask_sql('b.line')} AS same
            FROM (SELECT * FROM kr WHERE side = 'A') a FULL JOIN (SELECT * FROM kr WHERE side = 'B') b
              ON a.key = b.key AND a.occ = b.occ)"""


@query("row_compare_csv", f"""WITH {COMPARE_ORDERS_SQL}
    SELECT 'orders.csv' AS doc_id, key, occ, status,
      CASE WHEN status = 'matched' THEN CASE WHEN same THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END END
        AS similarity_pct,
      (status = 'added' OR (status = 'matched' AND NOT same))::BIGINT AS lines_added,
      (status = 'removed' OR (status = 'matched' AND NOT same))::BIGINT AS lines_deleted FROM cmp""")
def row_compare_csv(spark, sf_dir):
    return pairing.keyed_result(compared_orders(spark, sf_dir), ["doc_id"])


@query("changed_fields", rf"""WITH {COMPARE_ORDERS_SQL},
    f AS (SELECT key, occ, regexp_split_to_array(line_a, '[,;|]|\s+') AS fa,
            regexp_split_to_array(line_b, '[,;|]|\s+') AS fb FROM cmp WHERE status = 'matched'),
    g AS (SELECT key, occ, unnest(range(1, greatest(len(fa), len(fb)) + 1)) AS field_no, fa, fb FROM f),
    h AS (SELECT key, occ, field_no, fa[field_no] AS value_a, fb[field_no] AS value_b FROM g)
    SELECT * FROM h WHERE {mask_sql('value_a')} IS DISTINCT FROM {mask_sql('value_b')}""")
def changed_fields(spark, sf_dir):
    return pairing.changed_fields(compared_orders(spark, sf_dir), ["key", "occ"], mask_dates)


def paired_items(spark, sf_dir):
    a, b = items(spark, sf_dir, "A"), items(spark, sf_dir, "B")
    return pairing.pair_rows(a, b, ["l_orderkey"], "place", chunk=item_slice())


ITEM_PAIRS_SQL = f"""{ITEM_SQL},
    ip AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.occ, b.occ) AS occ,
      CASE WHEN b.occ IS NULL THEN 'removed' WHEN a.occ IS NULL THEN 'added' ELSE 'matched' END AS status,
      {', '.join(f'a.{c} AS {c}_a, b.{c} AS {c}_b' for c in ITEM_COLUMNS)}
      FROM (SELECT * FROM item_ranked WHERE side = 'A') a
      FULL JOIN (SELECT * FROM item_ranked WHERE side = 'B') b
        ON a.l_orderkey = b.l_orderkey AND a.occ = b.occ)"""


@query("compare_rows_dup", f"""WITH {ITEM_PAIRS_SQL}
    SELECT l_orderkey, occ, status, l_partkey_a, l_partkey_b, l_quantity_a, l_quantity_b FROM ip""")
def compare_rows_dup(spark, sf_dir):
    return paired_items(spark, sf_dir).select(
        "l_orderkey", "occ", "status", "l_partkey_a", "l_partkey_b", "l_quantity_a", "l_quantity_b"
    )


@query("changed_columns", f"""WITH {ITEM_PAIRS_SQL},
    d AS (
      SELECT l_orderkey, occ, 'l_partkey' AS column_name, l_partkey_a::VARCHAR AS value_a,
        l_partkey_b::VARCHAR AS value_b FROM ip
        WHERE status = 'matched' AND l_partkey_a IS DISTINCT FROM l_partkey_b
      UNION ALL
      SELECT l_orderkey, occ, 'l_quantity', l_quantity_a::VARCHAR, l_quantity_b::VARCHAR FROM ip
        WHERE status = 'matched' AND l_quantity_a IS DISTINCT FROM l_quantity_b
      UNION ALL
      SELECT l_orderkey, occ, 'l_returnflag', l_returnflag_a, l_returnflag_b FROM ip
        WHERE status = 'matched' AND l_returnflag_a IS DISTINCT FROM l_returnflag_b)
    SELECT * FROM d""")
def changed_columns(spark, sf_dir):
    return pairing.changed_columns(
        paired_items(spark, sf_dir), ["l_orderkey", "occ"], ["l_partkey", "l_quantity", "l_returnflag"]
    )


TITLES_SQL = f"""WITH RECURSIVE
    ta AS (SELECT conv_id, turn AS ordinal, text AS title FROM conversations),
    tb AS (SELECT conv_id, ordinal, CASE WHEN (conv_id + ordinal) % 3 = 0
             THEN replace(title, 'an', 'en') || ' II' ELSE title END AS title
           FROM ta WHERE (conv_id + ordinal) % 7 <> 0),
    titles AS (SELECT 'A' AS side, *, {norm_sql('title')} AS norm FROM ta
               UNION ALL SELECT 'B', *, {norm_sql('title')} FROM tb),
    worded AS (SELECT *, regexp_extract_all(norm, '{text.WORD}{{2,}}') AS ws FROM titles),
    tokens AS (SELECT * EXCLUDE ws, {TOKENS_SQL} AS toks FROM worded),
    n AS (SELECT conv_id, count(*) AS n FROM tokens GROUP BY conv_id),
    each AS (SELECT side, conv_id, ordinal, unnest(toks) AS token FROM tokens),
    w AS (SELECT conv_id, token, (ln((1 + any_value(n))::DOUBLE / (1 + count(*))) + 1) ** 2 AS w
          FROM each JOIN n USING (conv_id) GROUP BY conv_id, token),
    weighed AS (SELECT * FROM each JOIN w USING (conv_id, token)),
    lens AS (SELECT side, conv_id, ordinal, sqrt(sum(w)) AS len FROM weighed GROUP BY ALL),
    dots AS (SELECT a.conv_id, a.ordinal AS i, b.ordinal AS j, sum(a.w) AS dot
             FROM weighed a JOIN weighed b ON a.conv_id = b.conv_id AND a.token = b.token
             WHERE a.side = 'A' AND b.side = 'B' GROUP BY ALL),
    pairs AS (SELECT a.conv_id, a.ordinal AS i, b.ordinal AS j, a.norm AS na, b.norm AS nb, dot IS NOT NULL AS shares,
                coalesce(round(dot / (la.len * lb.len), 12), least(length(a.norm), length(b.norm))::DOUBLE
                  / greatest(length(a.norm), length(b.norm), 1)) AS near
              FROM tokens a JOIN tokens b ON a.conv_id = b.conv_id AND a.side = 'A' AND b.side = 'B'
              JOIN lens la ON la.side = 'A' AND la.conv_id = a.conv_id AND la.ordinal = a.ordinal
              JOIN lens lb ON lb.side = 'B' AND lb.conv_id = b.conv_id AND lb.ordinal = b.ordinal
              LEFT JOIN dots d ON d.conv_id = a.conv_id AND d.i = a.ordinal AND d.j = b.ordinal),
    edges AS (SELECT conv_id, i, j, near, shares, CASE WHEN na = nb THEN 1.0 WHEN na = '' OR nb = '' THEN 0.0
                ELSE 1.0 - levenshtein({ONE_BYTE.format('na')}, {ONE_BYTE.format('nb')})::DOUBLE
                  / greatest(length(na), length(nb)) END::DOUBLE AS ratio FROM pairs),
    turn AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ordinal) AS k FROM ta),
    walk AS (
      SELECT conv_id, 0::BIGINT AS k, NULL::BIGINT AS i, NULL::BIGINT AS got, []::BIGINT[] AS used
      FROM turn WHERE k = 1
      UNION ALL
      SELECT conv_id, k, i, got, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END
      FROM (
        SELECT conv_id, k, i, used, CASE WHEN best.ratio >= 0.6 THEN best.j END AS got
        FROM (
          SELECT r.conv_id, r.k + 1 AS k, t.ordinal AS i, any_value(r.used) AS used,
                 coalesce(max({{'ratio': ratio, 'near': near, 'j': j}}) FILTER (shares AND NOT list_contains(r.used, j)),
                          max({{'ratio': ratio, 'near': near, 'j': j}}) FILTER (NOT list_contains(r.used, j))) AS best
          FROM walk r JOIN turn t ON t.conv_id = r.conv_id AND t.k = r.k + 1
          LEFT JOIN edges e ON e.conv_id = r.conv_id AND e.i = t.ordinal
          GROUP BY r.conv_id, r.k, t.ordinal))),
    took AS (SELECT conv_id, i, got FROM walk WHERE k > 0)
    SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, a.ordinal AS ordinal_a, b.ordinal AS ordinal_b,
           a.title AS title_a, b.title AS title_b,
           CASE WHEN b.ordinal IS NULL THEN 'removed' WHEN a.ordinal IS NULL THEN 'added' ELSE 'matched' END AS status,
           {strip_sql('a.title')} <> {strip_sql('b.title')} AS title_changed
    FROM (SELECT ta.*, got FROM ta JOIN took ON took.conv_id = ta.conv_id AND took.i = ta.ordinal) a
    FULL JOIN tb b ON a.conv_id = b.conv_id AND a.got = b.ordinal"""


@query("match_titles", TITLES_SQL)
def match_titles(spark, sf_dir):
    """Conversations as documents, turns as sections titled by their text."""
    turns = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn AS ordinal", "text AS title"
    )
    b = turns.where("(conv_id + ordinal) % 7 <> 0").withColumn(
        "title", F.expr("if((conv_id + ordinal) % 3 = 0, concat(replace(title, 'an', 'en'), ' II'), title)")
    )
    return pair_titles(turns, b, ["conv_id"])
