"""Queries over two versions of the document texts, and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sidematch.functions import dates, keys, text
from sidematch.operators import stats
from sidematch.operators.order import value_places
from sidematch.operators.pages import drop_matching, non_blank
from sidematch.sources.reports import explode_lines
from workload.registry import query
from workload.sides import TEXT_GROWTH, TEXT_SQL, line_slices, table, text_docs

WS = text.SPACE_CHARS
DATE_SQL = dates.DATE_RE


def strip_sql(x):
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+\z', '', 'g')"


def mask_sql(x):
    bare = f"regexp_replace({x}, '{DATE_SQL}', '', 'g')"
    return strip_sql(f"regexp_replace({bare}, ' {{2,}}', ' ', 'g')")


def norm_sql(x):
    return f"lower(regexp_replace({strip_sql(x)}, '[{WS}]+', ' ', 'g'))"


STATS_SQL = """
         nb - common AS lines_added, na - common AS lines_deleted, common AS lines_common,
         CASE WHEN na + nb - 2 * common > 0
              THEN least(round(2.0::DOUBLE * common / (na + nb), 4), 0.9999::DOUBLE) ELSE 1.0::DOUBLE END
           AS similarity_ratio,
         round((na + nb - 2 * common)::DOUBLE / greatest(na, nb, 1) * 100, 2) AS change_pct"""


# Lines per slice: short, so that the slices of most documents must be put together.
SLICE_LINES = 64


def line_sides(spark, sf_dir):
    return tuple(explode_lines(text_docs(spark, sf_dir, s), ["doc_id"]) for s in "AB")


def both_sides(spark, sf_dir):
    a, b = line_sides(spark, sf_dir)
    return a.withColumn("side", F.lit("A")).unionByName(b.withColumn("side", F.lit("B")))


BOTH_SQL = f"""{TEXT_SQL},
    both_lines AS (SELECT 'A' AS side, doc_id, line_no, line FROM lines_a
                   UNION ALL SELECT 'B', doc_id, line_no, line FROM lines_b)"""


@query("line_explode", f"WITH {BOTH_SQL} SELECT side, doc_id, line_no, line FROM both_lines")
def line_explode(spark, sf_dir):
    return both_sides(spark, sf_dir)


@query(
    "ignore_lines",
    f"""WITH {BOTH_SQL} SELECT side, doc_id, line_no, line FROM both_lines
    WHERE NOT regexp_matches(line, '[0-9]{{3}}') AND NOT regexp_matches(line, '^(The|Le|Das) ')
      AND regexp_matches(line, '[^{WS}]')""",
)
def ignore_lines(spark, sf_dir):
    lines = both_sides(spark, sf_dir)
    return non_blank(drop_matching(lines, [r"[0-9]{3}", r"^(The|Le|Das) "]))


def _line_stats_sql(line="line"):
    return f"""WITH {TEXT_SQL},
    ca AS (SELECT doc_id, {line} AS line, count(*) AS n FROM lines_a GROUP BY ALL),
    cb AS (SELECT doc_id, {line} AS line, count(*) AS n FROM lines_b GROUP BY ALL),
    c AS (SELECT coalesce(ca.doc_id, cb.doc_id) AS doc_id, coalesce(ca.n, 0) AS a, coalesce(cb.n, 0) AS b
          FROM ca FULL JOIN cb ON ca.doc_id = cb.doc_id AND ca.line = cb.line),
    s AS (SELECT doc_id, sum(a)::BIGINT AS na, sum(b)::BIGINT AS nb, sum(least(a, b))::BIGINT AS common
          FROM c GROUP BY doc_id),
    stats AS (SELECT doc_id, na AS lines_a, nb AS lines_b, {STATS_SQL} FROM s)"""


@query("line_stats", _line_stats_sql() + " SELECT * FROM stats")
def line_stats(spark, sf_dir):
    a, b = line_sides(spark, sf_dir)
    return stats.line_stats(a, b, ["doc_id"])


@query("line_stats_masked", _line_stats_sql(mask_sql("line")) + " SELECT * FROM stats")
def line_stats_masked(spark, sf_dir):
    a, b = line_sides(spark, sf_dir)
    return stats.line_stats(a, b, ["doc_id"], normalize=dates.mask_dates)


@query("changed_docs", _line_stats_sql() + """
    SELECT doc_id, similarity_ratio FROM stats WHERE similarity_ratio < 1.0""")
def changed_docs(spark, sf_dir):
    return stats.changed(line_stats(spark, sf_dir)).select("doc_id", "similarity_ratio")


@query("verdicts", _line_stats_sql() + """
    SELECT doc_id, similarity_ratio,
      CASE WHEN similarity_ratio >= 0.98 THEN 'IDENTICAL or near-identical'
           WHEN similarity_ratio >= 0.85 THEN 'MINOR differences'
           WHEN similarity_ratio >= 0.60 THEN 'MODERATE differences'
           ELSE 'SIGNIFICANT differences' END AS verdict,
      CASE WHEN similarity_ratio = 1.0 THEN 'IDENTICAL' WHEN similarity_ratio >= 0.85 THEN 'MINOR'
           WHEN similarity_ratio >= 0.60 THEN 'MODERATE' ELSE 'SIGNIFICANT' END AS verdict_strict
    FROM stats""")
def verdicts(spark, sf_dir):
    ratio = F.col("similarity_ratio")
    return line_stats(spark, sf_dir).select(
        "doc_id", "similarity_ratio", stats.verdict(ratio).alias("verdict"),
        stats.verdict_strict(ratio).alias("verdict_strict"),
    )


@query("lines_only", f"""WITH {TEXT_SQL},
    oa AS (SELECT doc_id, line, count(*) AS n FROM
      (SELECT doc_id, line FROM lines_a EXCEPT ALL SELECT doc_id, line FROM lines_b) GROUP BY ALL),
    ob AS (SELECT doc_id, line, count(*) AS n FROM
      (SELECT doc_id, line FROM lines_b EXCEPT ALL SELECT doc_id, line FROM lines_a) GROUP BY ALL)
    SELECT doc_id, 'A' AS side, line, n AS copies FROM oa
    UNION ALL SELECT doc_id, 'B', line, n FROM ob""")
def lines_only(spark, sf_dir):
    a, b = line_sides(spark, sf_dir)
    return stats.lines_only_in(a, b, ["doc_id"])


# Stop words of the SQL check; any list will do for it.
STOPS = ["the", "and", "of", "to", "in", "le", "la", "der", "die", "und", "et", "est"]
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOPS) + "]"


def _terms_sql(side):
    return f"""
    w_{side} AS (
      SELECT doc_id, line_no, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (
        SELECT doc_id, line_no, list_filter(regexp_extract_all(lower(line), '{text.WORD}{{2,}}'),
          lambda x: NOT list_contains({_STOP_SQL}, x)) AS ws FROM lines_{side})),
    o_{side} AS (
      SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY line_no, k) AS p FROM w_{side}),
    t_{side} AS (
      SELECT doc_id, term, count(*) AS n FROM (
        SELECT doc_id, w AS term FROM o_{side}
        UNION ALL SELECT doc_id, p || ' ' || w FROM o_{side} WHERE p IS NOT NULL) GROUP BY ALL)"""


@query("text_cosine", f"""WITH {TEXT_SQL}, {_terms_sql('a')}, {_terms_sql('b')},
    t AS (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.n, 0)::DOUBLE AS a,
                 coalesce(y.n, 0)::DOUBLE AS b
          FROM t_a x FULL JOIN t_b y ON x.doc_id = y.doc_id AND x.term = y.term),
    s AS (SELECT doc_id, sum(a * b) AS d,
                 sum(a * a * CASE WHEN a > 0 AND b > 0 THEN 1 ELSE (1 + ln(1.5)) ** 2 END) AS aa,
                 sum(b * b * CASE WHEN a > 0 AND b > 0 THEN 1 ELSE (1 + ln(1.5)) ** 2 END) AS bb
          FROM t GROUP BY doc_id),
    g AS (SELECT doc_id FROM lines_a UNION SELECT doc_id FROM lines_b)
    SELECT g.doc_id, round(CASE WHEN aa > 0 AND bb > 0 THEN d / (sqrt(aa) * sqrt(bb)) ELSE 0 END, 4)
      AS text_similarity FROM g LEFT JOIN s ON g.doc_id = s.doc_id""")
def text_cosine(spark, sf_dir):
    docs = [text_docs(spark, sf_dir, s) for s in "AB"]
    a, b = (explode_lines(d, ["doc_id"]) for d in docs)
    return stats.text_cosine(
        a, b, ["doc_id"], stop_words=STOPS, chunk=line_slices(spark, sf_dir, TEXT_GROWTH, SLICE_LINES)
    )


# Texts with dates in them: events carry a time stamp.
_EVENT_TEXT = """concat(event_type, CASE event_id % 5
    WHEN 0 THEN concat(' run ', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), ' ok')
    WHEN 1 THEN concat('  Tuesday ', date_format(ts, 'M/d/yyyy'), ' 3:45 PM x')
    WHEN 2 THEN ' borrowed Monitor 06/02/26 PAGE 341'
    WHEN 3 THEN concat(' ', date_format(ts, 'MMM'), ' ', day(ts), ', ', year(ts), ' done')
    ELSE concat(' ', cast(cast(ts AS date) AS string), ' - ', cast(cast(ts AS date) AS string)) END)"""
_EVENT_SQL = """(SELECT event_id, event_type || CASE event_id % 5
    WHEN 0 THEN ' run ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ok'
    WHEN 1 THEN '  Tuesday ' || strftime(ts, '%-m/%-d/%Y') || ' 3:45 PM x'
    WHEN 2 THEN ' borrowed Monitor 06/02/26 PAGE 341'
    WHEN 3 THEN ' ' || strftime(ts, '%b') || ' ' || day(ts) || ', ' || year(ts) || ' done'
    ELSE ' ' || ts::DATE::VARCHAR || ' - ' || ts::DATE::VARCHAR END AS line FROM events)"""


def _event_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_EVENT_TEXT} AS line")


@query("mask_dates", f"SELECT event_id, {mask_sql('line')} AS masked FROM {_EVENT_SQL}")
def mask_dates(spark, sf_dir):
    line = F.col("line")
    return _event_lines(spark, sf_dir).select("event_id", dates.mask_dates(line).alias("masked"))


@query("first_date", f"""SELECT event_id, regexp_matches(line, '{DATE_SQL}') AS dated,
    regexp_extract(line, '{DATE_SQL}') AS first_date FROM {_EVENT_SQL}""")
def first_date(spark, sf_dir):
    line = F.col("line")
    return _event_lines(spark, sf_dir).select(
        "event_id", dates.has_dates(line).alias("dated"), dates.first_date(line).alias("first_date")
    )


_KEY_TEXT = """CASE o_orderkey % 8
    WHEN 0 THEN cast(cast(o_orderdate AS date) AS string)
    WHEN 1 THEN {mdy}
    WHEN 2 THEN concat('INV-', cast(o_orderkey AS {s}))
    WHEN 3 THEN concat(cast(o_custkey // 7 AS {s}), ',', '500')
    WHEN 4 THEN {dmy}
    WHEN 5 THEN concat(cast(o_custkey AS {s}), '.25')
    WHEN 6 THEN concat(cast(cast(o_orderdate AS date) AS {s}), 'T01:02:03')
    ELSE concat(' ', {long}, ' ') END"""
_KEY_SQL = _KEY_TEXT.format(
    s="VARCHAR", mdy="strftime(o_orderdate, '%-m/%-d/%Y')", dmy="strftime(o_orderdate, '%-d-%b-%Y')",
    long="strftime(o_orderdate, '%B %-d, %Y')",
).replace("AS string", "AS VARCHAR")
_KEY_SPARK = _KEY_TEXT.format(
    s="STRING", mdy="date_format(o_orderdate, 'M/d/yyyy')", dmy="date_format(o_orderdate, 'd-MMM-yyyy')",
    long="date_format(o_orderdate, 'MMMM d, yyyy')",
).replace("//", "div")


@query("sort_value_order", f"""WITH k AS (SELECT o_orderkey, o_orderdate, {_KEY_SQL} AS raw, o_orderkey % 8 AS m
      FROM orders),
    v AS (SELECT *, CASE WHEN m IN (2) THEN 2 WHEN m IN (3, 5) THEN 1 ELSE 0 END AS rank,
      CASE WHEN m IN (0, 1, 4, 7) THEN o_orderdate::DATE::TIMESTAMP
           WHEN m = 6 THEN o_orderdate::DATE::TIMESTAMP + INTERVAL '1:02:03' HOUR TO SECOND END AS ts,
      CASE WHEN m IN (3, 5) THEN replace(raw, ',', '')::DOUBLE END AS num,
      CASE WHEN m = 2 THEN raw END AS str FROM k)
    SELECT o_orderkey, raw, rank::INT AS key_rank, num, str,
      dense_rank() OVER (ORDER BY rank, ts NULLS FIRST, num NULLS FIRST, str NULLS FIRST) AS place
    FROM v""".replace("INTERVAL '1:02:03' HOUR TO SECOND", "INTERVAL 3723 SECOND"))
def sort_value_order(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_KEY_SPARK} AS raw")
    val = value_places(raw.withColumn("v", keys.sort_value(F.col("raw"))), "v", "place")
    return val.select(
        "o_orderkey", "raw", F.col("v.rank").alias("key_rank"), F.col("v.num").alias("num"),
        F.col("v.str").alias("str"), "place",
    )


_TITLE_STOPS = "[" + ", ".join(f"'{w}'" for w in text.TITLE_STOP_WORDS) + "]"
_USEFUL = f"list_filter(ws, lambda x: NOT list_contains({_TITLE_STOPS}, x))"
TOKENS_SQL = f"""list_distinct(CASE WHEN len(ws) = 0 THEN [norm] WHEN len({_USEFUL}) = 0 THEN ws
    ELSE {_USEFUL} END)"""

# Every line of a text taken as a title.
@query("title_tokens_idf", f"""WITH {BOTH_SQL},
    t AS (SELECT {norm_sql('line')} AS norm FROM both_lines),
    w AS (SELECT norm, regexp_extract_all(norm, '{text.WORD}{{2,}}') AS ws FROM t),
    k AS (SELECT unnest({TOKENS_SQL}) AS token FROM w),
    d AS (SELECT token, count(*) AS titles FROM k GROUP BY token)
    SELECT token, titles, round(ln((1 + n)::DOUBLE / (1 + titles)) + 1, 6) AS idf
    FROM d, (SELECT count(*) AS n FROM both_lines)""")
def title_tokens_idf(spark, sf_dir):
    from sidematch.operators.titles import idf_weights

    titles = both_sides(spark, sf_dir).select(text.normalize_title(F.col("line")).alias("norm"))
    tokens = titles.select(F.explode(text.title_tokens(F.col("norm"))).alias("token"))
    return idf_weights(tokens, titles.agg(F.count("*").alias("n"))).select(
        "token", "titles", F.round("idf", 6).alias("idf")
    )


# Edit distance in SQL counts bytes, so letters beyond ASCII become capitals, which a
# lower-cased title has none of.
ONE_BYTE = "translate({}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"


@query("edit_ratio", f"""WITH {TEXT_SQL},
    s AS (SELECT a.doc_id, a.line_no, {ONE_BYTE.format(norm_sql('a.line'))} AS a,
            {ONE_BYTE.format(norm_sql('b.line'))} AS b
          FROM lines_a a JOIN lines_b b ON a.doc_id = b.doc_id AND a.line_no = b.line_no)
    SELECT doc_id, line_no, round(CASE WHEN a = b THEN 1.0::DOUBLE WHEN a = '' OR b = '' THEN 0.0::DOUBLE
      ELSE 1.0::DOUBLE - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END, 6) AS ratio FROM s""")
def edit_ratio(spark, sf_dir):
    title = text.normalize_title(F.col("line"))
    a, b = line_sides(spark, sf_dir)
    rows = a.select("doc_id", "line_no", title.alias("a")).join(
        b.select("doc_id", "line_no", title.alias("b")), ["doc_id", "line_no"]
    )
    ratio = text.edit_ratio(F.col("a"), F.col("b"))
    return rows.select("doc_id", "line_no", F.round(ratio, 6).alias("ratio"))
