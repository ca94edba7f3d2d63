"""Pairing of the two sides by name, key and position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidematch.functions.keys import sort_value
from sidematch.operators.scan import CHUNK, Chunk, number_rows, slice_of, spread_join
from sidematch.operators.stats import Normalize, compared, diff_columns, line_stats, similarity_pct
from sidematch.session import MAX_GROUP_ROWS, largest_group


def pair_docs(a: DataFrame, b: DataFrame) -> DataFrame:
    """``match_name, doc_a, doc_b, match_type``: documents with the same lower-cased
    name, and those found on one side only."""
    left = a.select("match_name", F.col("doc_id").alias("doc_a"))
    right = b.select("match_name", F.col("doc_id").alias("doc_b"))
    kind = (
        F.when(F.col("doc_b").isNull(), "only_in_a")
        .when(F.col("doc_a").isNull(), "only_in_b")
        .otherwise("exact")
    )
    return left.join(right, "match_name", "full").withColumn("match_type", kind)


def status_of(in_a: Column, in_b: Column) -> Column:
    return F.when(in_a & in_b, "matched").when(in_a, "removed").otherwise("added")


def pair_rows(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    pos: str,
    unique: bool = False,
    chunk: Chunk = CHUNK,
) -> DataFrame:
    """Full outer pairing on ``keys``, the k-th row of a key with the k-th (``occ``).
    Other columns come out as ``x_a`` and ``x_b``, with a ``status``.

    While the rows of every key are seen to fit one task, they are moved there once, ranked
    and paired.  Else both sides are ranked in one shuffle, by slices, and meet in a second one, on the
    key and ``occ``, so a key with a third of all rows still spreads.  NULL keys pair like
    any other value.  ``unique`` skips the ranking for keys known to occur once per side.
    """
    rest = {tag: [c for c in df.columns if c not in keys] for tag, df in (("a", a), ("b", b))}
    types = dict(b.dtypes)
    # columns of both sides are moved as one; those not asked for later are not moved at all
    alike = {c for c, t in a.dtypes if types.get(c) == t}

    def moved(c: str, tag: str) -> str:
        return f"_v_{c}" if c in alike else f"_{tag}_{c}"

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            F.struct(*keys).alias("_key"), F.lit(tag).alias("_side"), F.col(pos).alias("_pos"),
            (F.lit(0) if chunk is None else slice_of(pos, chunk)).alias("_cut"),
            *[F.col(c).alias(moved(c, tag)) for c in rest[tag]],
        )

    rows = side(a, "a").unionByName(side(b, "b"), allowMissingColumns=True)
    if unique:
        rows = rows.withColumn("occ", F.lit(1).cast("long"))
    elif chunk is None:
        rows = number_rows(rows, ["_key", "_side"], "_pos", "occ", None)
    elif largest_group(rows, ["_key"]) <= MAX_GROUP_ROWS:
        rows = number_rows(rows.repartition("_key"), ["_key", "_side"], "_pos", "occ", None)
    else:
        rows = number_rows(rows, ["_key", "_side"], "_pos", "occ", F.col("_cut"))

    def found(c: str, tag: str) -> Column:
        value = F.when(F.col("_side") == tag, F.col(moved(c, tag)))
        return F.first(value, ignorenulls=True).alias(f"{c}_{tag}")

    pairs = rows.groupBy("_key", "occ").agg(
        *[found(c, tag) for tag in "ab" for c in rest[tag]],
        F.max(F.col("_side") == "a").alias("_in_a"), F.max(F.col("_side") == "b").alias("_in_b"),
    )
    status = status_of(F.col("_in_a"), F.col("_in_b"))
    return pairs.withColumn("status", status).select(
        *[F.col("_key")[k].alias(k) for k in keys], "occ",
        *[f"{c}_{tag}" for tag in "ab" for c in rest[tag]], "status",
    )


def compare_rows(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    pos: str = "line_no",
    normalize: Normalize | None = None,
    unique: bool = False,
    chunk: Chunk = CHUNK,
) -> DataFrame:
    """Pair keyed rows (``keys, pos, line, ...``) and add the line statistics of each
    pair: one line on each side, equal or not.  Statistics of unmatched rows are
    NULL but for the one line added or deleted."""
    equal = compared(F.col("line_a"), normalize) == compared(F.col("line_b"), normalize)
    pairs = pair_rows(a, b, keys, pos, unique, chunk).withColumn("_same", equal)
    same = F.col("_same")
    matched = F.col("status") == "matched"
    one = F.lit(1).cast("long")
    stats = diff_columns(F.when(same, 1).otherwise(0).cast("long"), one, one)
    added = F.when(matched, stats["lines_added"]).when(F.col("status") == "added", 1).otherwise(0)
    deleted = F.when(matched, stats["lines_deleted"]).when(F.col("status") == "removed", 1).otherwise(0)
    return pairs.withColumns(
        {
            "similarity_ratio": F.when(matched, stats["similarity_ratio"]),
            "lines_added": added.cast("long"),
            "lines_deleted": deleted.cast("long"),
        }
    ).drop("_same")


def compare_blocks(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str],
    key: str,
    block: str,
    pos: str = "line_no",
    normalize: Normalize | None = None,
    chunk: Chunk = CHUNK,
) -> DataFrame:
    """Pair blocks of lines by ``key``, k-th with k-th, and compare their lines:
    ``by, key, occ, status`` and the line statistics.

    Every block has a line, so the counts of both sides tell the status and no
    separate join of the blocks is needed.
    """
    def ranked(df: DataFrame) -> DataFrame:
        blocks = df.select(*by, key, block).distinct()
        ranks = number_rows(blocks, [*by, key], block, "occ", chunk).drop(key)
        return spread_join(df, ranks, [*by, block], pos, chunk, how="inner")

    out = line_stats(ranked(a), ranked(b), [*by, key, "occ"], normalize)
    return out.withColumn("status", status_of(F.col("lines_a") > 0, F.col("lines_b") > 0))


def compare_transactions(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str],
    pos: str = "line_no",
    normalize: Normalize | None = None,
    chunk: Chunk = CHUNK,
) -> DataFrame:
    """Transactions paired by sort key; ``sort_val`` is the typed order of the keys."""
    out = compare_blocks(a, b, by, "sort_key", "txn_id", pos, normalize, chunk)
    return out.withColumn("sort_val", sort_value(F.col("sort_key")))


def compare_positional(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str],
    ordinal: str,
    normalize: Normalize | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """The i-th part of A against the i-th of B: ``by, ordinal, status`` and the line
    statistics.  ``groups`` (``by, ordinal, in_a, in_b``) lists parts that may have
    no lines left."""
    keys = [*by, ordinal]
    out = line_stats(a, b, keys, normalize, groups)
    if groups is None:
        in_a, in_b = F.col("lines_a") > 0, F.col("lines_b") > 0
    else:
        out = out.join(groups.select(*keys, "in_a", "in_b"), keys)
        in_a, in_b = F.col("in_a"), F.col("in_b")
    return out.withColumn("status", status_of(in_a, in_b)).drop("in_a", "in_b")


def changed_fields(
    matched: DataFrame, id_cols: Sequence[str], normalize: Normalize | None = None
) -> DataFrame:
    """``id_cols, field_no, value_a, value_b`` for the fields of paired lines that
    differ.  Fields end at ``,``, ``;``, ``|`` or white space."""
    def fields(c: str) -> Column:
        return F.split(F.col(c), r"[,;|]|\s+", -1)

    zipped = F.arrays_zip(fields("line_a").alias("a"), fields("line_b").alias("b"))
    out = matched.where("status = 'matched'").select(
        *id_cols, F.posexplode(zipped).alias("field_no", "_f")
    )
    out = out.select(
        *id_cols, (F.col("field_no") + 1).alias("field_no"),
        F.col("_f.a").alias("value_a"), F.col("_f.b").alias("value_b"),
    )
    same = compared(F.col("value_a"), normalize).eqNullSafe(compared(F.col("value_b"), normalize))
    return out.where(~same)


def changed_columns(
    matched: DataFrame, id_cols: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """The same for two tables paired by ``pair_rows``: ``id_cols, column_name,
    value_a, value_b`` (as text) for named columns that differ."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"{c}_a").cast("string").alias("value_a"),
                F.col(f"{c}_b").cast("string").alias("value_b"),
                F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")).alias("same"),
            )
            for c in columns
        ]
    )
    differing = F.filter(cells, lambda c: ~c["same"])
    return (
        matched.where("status = 'matched'")
        .select(*id_cols, F.explode(differing).alias("_c"))
        .select(*id_cols, "_c.column_name", "_c.value_a", "_c.value_b")
    )


def txn_result(compared_txns: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, sort_key, occ, status, similarity_pct, lines_added, lines_deleted``."""
    return _result(compared_txns, by, "sort_key")


def section_result(compared_sections: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, section_name, ...`` with statuses identical, changed, added, removed."""
    return _result(compared_sections, by, "section_name")


def keyed_result(compared_rows: DataFrame, by: Sequence[str], key: str = "key") -> DataFrame:
    """``by, key, occ, status, similarity_pct (NULL when unmatched), ...``."""
    return compared_rows.select(
        *by, key, "occ", "status", similarity_pct(F.col("similarity_ratio")).alias("similarity_pct"),
        "lines_added", "lines_deleted",
    )


def _result(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    both = ~F.col("status").isin("added", "removed")
    order = "occ" if "occ" in df.columns else "block_no"
    pct = F.when(both, similarity_pct(F.col("similarity_ratio"))).otherwise(F.lit(0.0))
    return df.select(*by, key, order, "status", pct.alias("similarity_pct"), "lines_added", "lines_deleted")
