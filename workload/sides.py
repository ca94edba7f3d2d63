"""Two sides of the same data, derived from the given tables row by row.

The same arithmetic is stated once in Spark and once as SQL for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidematch.sources.reports import slice_width


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table.  One so small that fewer tasks read it than there are cores is dealt
    out to all of them before the work on its rows; larger ones stay as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Some documents are on one side only, none on neither.
IN_A, IN_B = "(doc_id % 23 <> 0 OR doc_id % 19 = 0)", "doc_id % 19 <> 0"


def _texts(spark, sf_dir, side):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.where(IN_A if side == "A" else IN_B)
    return docs.selectExpr(
        "doc_id", r"split(regexp_replace(text, '\\r\\n?', '\n'), '\n', -1) AS arr"
    )


# Lines that one line of a document becomes at most in the sides made of it.
TEXT_GROWTH, REPORT_GROWTH = 2, 8


def line_slices(spark: SparkSession, sf_dir: str, growth: int, width: int):
    """Slices of ``width`` lines where a document is too long for one task, else none."""
    return slice_width(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=width, growth=growth)


def text_docs(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """``doc_id, text``: the documents as they are, and with lines dropped, revised,
    repeated and moved."""
    docs = _texts(spark, sf_dir, side)
    if side == "A":
        edited = "arr"
    else:
        docs = docs.selectExpr("doc_id", """transform(arr, (l, i) ->
            CASE WHEN (doc_id * 31 + i + 1) % 13 = 0 THEN array()
                 WHEN (doc_id * 7 + i + 1) % 17 = 0
                   THEN array_repeat(if((doc_id + i + 1) % 11 = 0, concat(l, ' [rev]'), l), 2)
                 ELSE array(if((doc_id + i + 1) % 11 = 0, concat(l, ' [rev]'), l)) END) AS arr""")
        edited = """flatten(if(doc_id % 4 = 0,
            concat(slice(arr, 4, size(arr)), slice(arr, 1, 3)), arr))"""
    return docs.selectExpr("doc_id", f"array_join({edited}, '\\n') AS text")


TEXT_SQL = rf"""
txt AS (
  SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS arr
  FROM documents),
raw AS (SELECT doc_id, unnest(arr) AS line, generate_subscripts(arr, 1) AS n FROM txt),
lines_a AS (SELECT doc_id, n AS line_no, line FROM raw WHERE {IN_A}),
edited AS (
  SELECT doc_id, n, CASE WHEN (doc_id + n) % 11 = 0 THEN line || ' [rev]' ELSE line END AS line,
         unnest(CASE WHEN (doc_id * 7 + n) % 17 = 0 THEN [1, 2] ELSE [1] END) AS c,
         CASE WHEN doc_id % 4 = 0 AND n <= 3 THEN n + 1000000000 ELSE n END AS place
  FROM raw WHERE doc_id % 19 <> 0 AND (doc_id * 31 + n) % 13 <> 0),
lines_b AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, c) AS line_no, line FROM edited
  UNION ALL
  SELECT doc_id, 1, '' FROM txt
  WHERE doc_id % 19 <> 0 AND doc_id NOT IN (SELECT doc_id FROM edited))
"""


def report_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``side, doc_id, file_name, match_name, text``: every document as a paged ledger
    with transactions, page totals and rules between pages."""
    def side(tag: str) -> DataFrame:
        b = tag == "B"
        day = "(doc_id + i) % 700" + (" + if((doc_id + i) % 5 = 0, 1, 0)" if b else "")
        amount = "(doc_id * i) % 97" + (" + if((doc_id + i) % 11 = 0, 1, 0)" if b else "")
        has_txn = "i % 3 = 0" + (" AND (doc_id + i) % 17 <> 0" if b else "")
        has_line = "(doc_id * 31 + i) % 13 <> 0" if b else "true"
        report = f"""flatten(transform(arr, (l, i) -> concat(
            if(i % 10 = 0,
               array(concat('PAGE ', cast(i div 10 + 1 AS string)), 'LEDGER REPORT', ''), array()),
            if({has_txn},
               array(concat('TXN ', lpad(cast(i % 12 AS string), 3, '0'), ' ',
                            cast(date_add(date'2024-01-01', cast({day} AS int)) AS string),
                            ' amount ', cast({amount} AS string))), array()),
            if({has_line}, array(l), array()),
            if(i % 10 = 9,
               array(concat('PAGE TOTAL ', cast(i + 1 AS string)), repeat('-', 24), 'END OF PAGE'),
               array()))))"""
        return _texts(spark, sf_dir, tag).selectExpr(
            f"'{tag}' AS side", "doc_id",
            "concat('REP_', cast(doc_id AS string), '.txt') AS file_name",
            "concat('rep_', cast(doc_id AS string), '.txt') AS match_name",
            f"array_join({report}, '\\n') AS text",
        )

    return side("A").unionByName(side("B"))


REPORT_SQL = rf"""
txt AS (
  SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS arr
  FROM documents),
raw AS (SELECT doc_id, unnest(arr) AS l, generate_subscripts(arr, 1) - 1 AS i FROM txt),
both_sides AS (
  SELECT 'A' AS side, doc_id, l, i FROM raw WHERE {IN_A}
  UNION ALL SELECT 'B', doc_id, l, i FROM raw WHERE doc_id % 19 <> 0),
parts AS (
  SELECT side, doc_id, i,
    list_concat(list_concat(
      CASE WHEN i % 10 = 0 THEN ['PAGE ' || (i // 10 + 1), 'LEDGER REPORT', ''] ELSE []::VARCHAR[] END,
      CASE WHEN i % 3 = 0 AND (side = 'A' OR (doc_id + i) % 17 <> 0)
           THEN ['TXN ' || lpad((i % 12)::VARCHAR, 3, '0') || ' ' ||
                 (DATE '2024-01-01' + ((doc_id + i) % 700
                   + CASE WHEN side = 'B' AND (doc_id + i) % 5 = 0 THEN 1 ELSE 0 END)::INT)::DATE::VARCHAR
                 || ' amount ' || ((doc_id * i) % 97
                   + CASE WHEN side = 'B' AND (doc_id + i) % 11 = 0 THEN 1 ELSE 0 END)]
           ELSE []::VARCHAR[] END), list_concat(
      CASE WHEN side = 'A' OR (doc_id * 31 + i) % 13 <> 0 THEN [l] ELSE []::VARCHAR[] END,
      CASE WHEN i % 10 = 9 THEN ['PAGE TOTAL ' || (i + 1), repeat('-', 24), 'END OF PAGE']
           ELSE []::VARCHAR[] END)) AS p
  FROM both_sides),
cells AS (SELECT side, doc_id, i, unnest(p) AS line, generate_subscripts(p, 1) AS k FROM parts),
lines AS (
  SELECT side, doc_id, row_number() OVER (PARTITION BY side, doc_id ORDER BY i, k) AS line_no, line
  FROM cells)
"""


def order_lines(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """``doc_id, line_no, line``: every order as one delimited line of one large keyed
    file; B has rows dropped, edited and added."""
    orders = table(spark, sf_dir, "orders")
    if side == "A":
        rows = orders.selectExpr("*", "0 AS extra", "o_orderstatus AS status")
    else:
        rows = orders.where("o_orderkey % 13 <> 0").selectExpr(
            "*", "explode(if(o_orderkey % 17 = 0, array(0, 1), array(0))) AS extra",
            "if(o_orderkey % 11 = 0, 'X', o_orderstatus) AS status",
        )
    return rows.selectExpr(
        "'orders.csv' AS doc_id",
        "o_orderkey * 2 + extra AS line_no",
        """concat_ws(',', lpad(cast(o_orderkey + extra * 50000000 AS string), 8, '0'),
           cast(cast(o_orderdate AS date) AS string), status,
           concat('"', o_orderpriority, ', ', cast(floor(o_totalprice) AS string), '"')) AS line""",
    )


ORDER_SQL = """
order_a AS (SELECT *, 0 AS extra, o_orderstatus AS status FROM orders),
order_b AS (
  SELECT *, unnest(CASE WHEN o_orderkey % 17 = 0 THEN [0, 1] ELSE [0] END) AS extra,
         CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS status
  FROM orders WHERE o_orderkey % 13 <> 0),
order_rows AS (
  SELECT side, o_orderkey * 2 + extra AS line_no,
         lpad((o_orderkey + extra * 50000000)::VARCHAR, 8, '0') || ',' || o_orderdate::DATE::VARCHAR
         || ',' || status || ',"' || o_orderpriority || ', ' || floor(o_totalprice)::BIGINT || '"' AS line
  FROM (SELECT 'A' AS side, * FROM order_a UNION ALL SELECT 'B', * FROM order_b))
"""

ITEM_COLUMNS = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def items(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Line items, several per order key and no unique key; B has rows dropped and
    quantities edited.  ``place`` orders the rows of a key, ``slice`` grows with it."""
    rows = table(spark, sf_dir, "lineitem")
    if side == "B":
        rows = rows.where("(l_orderkey * 31 + l_linenumber) % 13 <> 0").withColumn(
            "l_quantity", F.expr("if(l_partkey % 11 = 0, l_quantity + 1, l_quantity)")
        )
    return rows.withColumn("place", F.struct(*ITEM_COLUMNS))


def item_slice():
    """Slices of the rows of one order key: line number, then blocks of part keys."""
    return F.expr("l_linenumber * 1000000000000L + l_partkey div 1000")


ITEM_SQL = """
item_rows AS (
  SELECT 'A' AS side, * FROM lineitem
  UNION ALL
  SELECT 'B', * REPLACE (CASE WHEN l_partkey % 11 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity)
  FROM lineitem WHERE (l_orderkey * 31 + l_linenumber) % 13 <> 0),
item_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY side, l_orderkey ORDER BY l_linenumber, l_partkey,
    l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
    l_shipdate) AS occ
  FROM item_rows)
"""


def named_docs(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """``doc_id, match_name``: one name per distinct text and language; B renames."""
    names = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat(lang, '_', md5(text), '.txt') AS name"
    )
    names = names.groupBy("name").agg(F.min("doc_id").alias("doc_id"))
    if side == "A":
        return names.selectExpr("name AS match_name", "cast(doc_id AS string) AS doc_id")
    renamed = names.where("doc_id % 5 <> 4").selectExpr(
        """CASE doc_id % 5 WHEN 0 THEN name
             WHEN 1 THEN concat(substring(name, 1, 5), '_v2', substring(name, 9))
             WHEN 2 THEN concat('x', name)
             ELSE replace(name, 'a', '99') END AS match_name""",
        "doc_id",
    )
    return renamed.groupBy("match_name").agg(F.min("doc_id").cast("string").alias("doc_id"))


NAME_SQL = r"""
names AS (
  SELECT name, min(doc_id) AS doc_id
  FROM (SELECT doc_id, lang || '_' || md5(text) || '.txt' AS name FROM documents) GROUP BY name),
names_a AS (SELECT name AS match_name, doc_id FROM names),
names_b AS (
  SELECT match_name, min(doc_id) AS doc_id FROM (
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN name
             WHEN 1 THEN substr(name, 1, 5) || '_v2' || substr(name, 9)
             WHEN 2 THEN 'x' || name
             ELSE replace(name, 'a', '99') END AS match_name
    FROM names WHERE doc_id % 5 <> 4) GROUP BY match_name)
"""
