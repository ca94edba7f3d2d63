"""Line dedup: lines that many documents share stay in one of them.

Texts are exploded into lines; a line's key is hashed, documents are counted per hash, and
the lines to drop come back to their documents as positions, by which the rest is put
together again.  Texts are shuffled once, with their lists of positions; everything else
that is shuffled is a few numbers per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidematch.session import materialize

MIN_CHARS = 20
MIN_DOCS = 3
# Parts of the lines of one key, so that a line of all documents meets many tasks.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` for every row of ``docs`` (``doc_id, text``).

    A key of at least ``min_chars`` code points that at least ``min_docs`` different
    ``doc_id`` hold loses all its lines, except in the largest ``doc_id`` that holds it,
    which keeps all of them.  ``kept`` is what remains, joined by ``\\n``.  Keys are told
    apart by 128 bits.

    A null or empty text is one empty line.  Rows with one ``doc_id`` are one document when
    documents are counted; rows without ``doc_id`` are never counted, and lose the lines
    that others lose.  Repeated rows give repeated results; an empty table gives none.
    Texts of any length are worked line by line; other columns of ``docs`` are ignored.
    """
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    # the rows of one id and one text have the same lines to lose
    docs = docs.withColumn("_text", F.xxhash64("text"))
    lines = docs.select("doc_id", "_text", F.posexplode(lines_of(F.col("text"))).alias("_at", "_line"))
    keys = materialize(
        lines.select("doc_id", "_text", "_at", line_key(F.col("_line")).alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select("doc_id", "_text", "_at", F.xxhash64("_key").alias("_h"),
                F.xxhash64(F.lit(1), "_key").alias("_g")))
    # one row per key and document first, so that a line of a third of all documents is
    # counted by many tasks
    held = keys.where(F.col("doc_id").isNotNull()).select("_h", "_g", "doc_id").distinct()
    shared = held.groupBy("_h", "_g").agg(F.count("*").alias("_n"), F.max("doc_id").alias("_last"))
    shared = shared.where(F.col("_n") >= min_docs).select("_h", "_g", "_last")
    shared = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = keys.withColumn("_salt", F.pmod("_text", F.lit(SALTS)).cast("int"))
    lost = (
        salted.join(shared, ["_h", "_g", "_salt"]).where(~F.col("doc_id").eqNullSafe(F.col("_last")))
        .groupBy(F.col("doc_id").alias("_doc"), F.col("_text").alias("_of"))
        .agg(F.collect_set("_at").alias("_lost")))
    both = docs.join(lost, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_of")), "left")
    n_lines = F.size(lines_of(F.col("text"))).cast("long")
    # a lambda's argument is worked out once, not once per line
    kept = F.transform(
        F.array(F.struct(lines_of(F.col("text")).alias("all"), F.col("_lost").alias("lost"))),
        lambda x: F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(x["all"]) - 1), x["lost"]),
            lambda i: F.get(x["all"], i)), "\n"))[0]
    return both.select(
        "doc_id", n_lines.alias("n_lines"),
        F.when(F.col("_lost").isNull(), 0).otherwise(F.size("_lost")).cast("long").alias("n_dropped"),
        F.when(F.col("_lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept"))
