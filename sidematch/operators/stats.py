"""Line statistics, text similarity and verdicts."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidematch.functions.text import WORD
from sidematch.operators.scan import CHUNK, Chunk, Last, scan

Normalize = Callable[[Column], Column]

# Parts that terms are dealt to, for each shuffle partition.
TERM_PARTS = 16
STATS = ["lines_added", "lines_deleted", "lines_common", "similarity_ratio", "change_pct"]


def compared(line: Column, normalize: Normalize | None) -> Column:
    """The value lines are compared by; output keeps the original line."""
    return line if normalize is None else normalize(line)


def line_counts(
    a: DataFrame, b: DataFrame, by: Sequence[str], normalize: Normalize | None = None
) -> DataFrame:
    """``by, line, n_a, n_b``: how often each line occurs on each side.  A line that
    fills a third of the data is combined before the shuffle."""
    line = compared(F.col("line"), normalize).alias("line")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = a.select(*by, line, one.alias("_a"), zero.alias("_b")).unionByName(
        b.select(*by, line, zero.alias("_a"), one.alias("_b"))
    )
    return both.groupBy(*by, "line").agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"))


def diff_columns(common: Column, n_a: Column, n_b: Column) -> dict[str, Column]:
    """The five statistics from the three counts."""
    added, deleted = n_b - common, n_a - common
    total = n_a + n_b
    ratio = F.when(total == 0, F.lit(1.0)).otherwise(F.try_divide(common * 2.0, total))
    ratio = F.round(ratio, 4)
    longest = F.greatest(n_a, n_b, F.lit(1))
    return {
        "lines_added": added,
        "lines_deleted": deleted,
        "lines_common": common,
        "similarity_ratio": F.when(added + deleted > 0, F.least(ratio, F.lit(0.9999))).otherwise(ratio),
        "change_pct": F.round((added + deleted) / longest * 100, 2),
    }


def line_stats(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str],
    normalize: Normalize | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Multiset line difference per group: ``by, lines_a, lines_b`` and the columns of
    ``STATS``.  ``groups`` lists groups that must appear even without lines."""
    return stats_of(line_counts(a, b, by, normalize), by, groups)


def stats_of(counts: DataFrame, by: Sequence[str], groups: DataFrame | None = None) -> DataFrame:
    """``line_stats`` from ``by, line, n_a, n_b``."""
    totals = (
        counts.groupBy(*by)
        .agg(
            F.sum(F.least("n_a", "n_b")).alias("_common"),
            F.sum("n_a").alias("lines_a"),
            F.sum("n_b").alias("lines_b"),
        )
    )
    if groups is not None:
        totals = groups.select(*by).join(totals, list(by), "left").fillna(
            0, ["_common", "lines_a", "lines_b"]
        )
    stats = diff_columns(F.col("_common"), F.col("lines_a"), F.col("lines_b"))
    return totals.withColumns(stats).drop("_common")


def changed(stats: DataFrame) -> DataFrame:
    """Only the groups that differ: nothing else is worth aligning."""
    return stats.where(F.col("similarity_ratio") < 1.0)


def lines_only_in(
    a: DataFrame, b: DataFrame, by: Sequence[str], normalize: Normalize | None = None
) -> DataFrame:
    """``by, side, line, copies``: lines with more copies on one side than the other."""
    extra = F.col("n_a") - F.col("n_b")
    return (
        line_counts(a, b, by, normalize)
        .where(extra != 0)
        .select(
            *by, F.when(extra > 0, "A").otherwise("B").alias("side"), "line",
            F.abs(extra).alias("copies"),
        )
    )


def verdict(ratio: Column) -> Column:
    return (
        F.when(ratio >= 0.98, "IDENTICAL or near-identical")
        .when(ratio >= 0.85, "MINOR differences")
        .when(ratio >= 0.60, "MODERATE differences")
        .otherwise("SIGNIFICANT differences")
    )


def verdict_strict(ratio: Column) -> Column:
    return (
        F.when(ratio == 1.0, "IDENTICAL")
        .when(ratio >= 0.85, "MINOR")
        .when(ratio >= 0.60, "MODERATE")
        .otherwise("SIGNIFICANT")
    )


def similarity_pct(ratio: Column) -> Column:
    return F.round(ratio * 100, 1)


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def terms(
    lines: DataFrame,
    by: Sequence[str],
    pos: str,
    stop_words: Sequence[str],
    chunk: Chunk = CHUNK,
    together: Sequence[str] | None = None,
) -> DataFrame:
    """``by, term``: the words and word pairs of a text given as ordered lines.  Stop
    words go first, and pairs run on from one line to the next.  A line without any has
    the term NULL.  Without slices, texts with the same ``together`` (by default ``by``)
    come out in one task."""
    words = F.regexp_extract_all(F.lower("line"), F.lit(f"({WORD}{{2,}})"), F.lit(1))
    kept = F.filter(words, lambda w: ~w.isin(list(stop_words))) if stop_words else words
    rows = lines.select(*by, pos, kept.alias("_w"))
    if chunk is None:
        # one exchange for the words of a text and, after it, for its terms; many parts,
        # as terms take a multiple of the room of their lines
        parts = TERM_PARTS * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(parts, *(together or by))
    last = F.try_element_at("_w", F.lit(-1))
    rows = scan(rows, by, pos, {"_prev": Last(last, inclusive=False)}, chunk)
    chain = F.concat(F.array_compact(F.array("_prev")), F.col("_w"))
    pairs = F.zip_with(
        F.slice(chain, 1, F.size(chain) - 1),
        F.slice(chain, 2, F.size(chain)),
        lambda x, y: F.concat_ws(" ", x, y),
    )
    found = F.when(F.size("_w") > 0, F.concat("_w", pairs))
    return rows.select(*by, F.explode_outer(found).alias("term"))


def text_cosine(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str],
    pos: str = "line_no",
    stop_words: Sequence[str] | None = None,
    chunk: Chunk = CHUNK,
) -> DataFrame:
    """``by, text_similarity``: TF-IDF cosine of the two texts of each group.

    With two texts the smooth inverse document frequency is 1 for a shared term and
    1 + ln 1.5 for a one-sided one, so term counts are all that is needed.
    """
    stop_words = english_stop_words() if stop_words is None else stop_words

    def side(lines: DataFrame, in_a: bool) -> DataFrame:
        return lines.select(*by, pos, "line", F.lit(in_a).alias("_in_a"))

    lines = side(a, True).unionByName(side(b, False))
    found = terms(lines, [*by, "_in_a"], pos, stop_words, chunk, by)
    counts = found.groupBy(*by, "term").agg(
        F.count_if(F.col("term").isNotNull() & F.col("_in_a")).alias("_a"),
        F.count_if(F.col("term").isNotNull() & ~F.col("_in_a")).alias("_b"),
    )
    rare = (1 + math.log(1.5)) ** 2
    weight = F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.lit(1.0)).otherwise(F.lit(rare))
    sums = counts.groupBy(*by).agg(
        F.sum(F.col("_a") * F.col("_b")).alias("_dot"),
        F.sum(F.col("_a") * F.col("_a") * weight).alias("_aa"),
        F.sum(F.col("_b") * F.col("_b") * weight).alias("_bb"),
    )
    cosine = F.try_divide(F.col("_dot"), F.sqrt("_aa") * F.sqrt("_bb"))
    return sums.select(
        *by, F.round(F.coalesce(cosine, F.lit(0.0)), 4).alias("text_similarity")
    )
