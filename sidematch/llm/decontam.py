"""Benchmark decontamination by templates.

Texts become templates: numbers, capitalised names inside a sentence (not words in capitals) and units behind a
number turn into typed placeholders, everything else into lower-case words.  All windows
of an item's template meet equal windows of documents in a hash join.  Where those at nearly
one distance cover enough of the item's words, what fills the placeholders in them is
compared: a re-parameterised question replaces equal values by equal values.

All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidematch.session import materialize

WINDOW = 8
# Share of an item's words that has to lie in windows the document has too.
COVERAGE = 0.6
# Matches count together if words put in or left out between them shift them by this many at most.
SHIFT = 8
# Benchmark windows are sent to every task up to this number (24 bytes each).
BROADCAST_WINDOWS = 1 << 20

UNITS = ("mm|cm|m|km|in|ft|mi|mg|g|kg|lb|oz|ml|l|s|ms|min|h|hr|hz|khz|mhz|w|kw|v|a|pa|kpa|"
         "seconds?|minutes?|hours?|days?|weeks?|months?|years?|meters?|metres?|kilometers?|kilometres?|"
         "grams?|kilograms?|liters?|litres?|dollars?|euros?|cents?|percent|degrees?")
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*+"
NUMBER = _EDGE + _NUMBER + _END
NAME = r"(?<=[\p{L}\p{N},;]\s)\p{Lu}\p{Ll}++(?![\p{L}\p{N}])"
UNIT = _EDGE + "(" + _NUMBER + r")\x20?(?:(?i:" + UNITS + r")" + _END + "|[%€$£])"
# placeholders cannot be words of the text: numbers have become 0 before
A_NUMBER, A_NAME, A_UNIT = "0", "1n", "1u"


def unit_marked(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNIT, f"$1 {A_UNIT}")


def template(marked: Column) -> Column:
    """Words and placeholders in order."""
    text = F.regexp_replace(F.regexp_replace(marked, NAME, A_NAME), NUMBER, A_NUMBER)
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: w != "")


def slots(marked: Column) -> Column:
    """What fills the number and name placeholders, in order."""
    return F.regexp_extract_all(marked, F.lit(f"({NUMBER}|{NAME})"), 1)


def windows(words: str, width: str | int) -> str:
    """SQL of an array of ``struct(at, h)``, all windows of ``words``."""
    return (f"if(size({words}) >= {width}, transform(sequence(0, greatest(size({words}) - {width}, 0)), "
            f"i -> struct(i AS at, xxhash64(slice({words}, i + 1, {width})) AS h)), array())")


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``item_id, total, width, at, h``; an item shorter than ``width`` is one window."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # in a document the first word may stand behind another one and look like a name
    alone, behind = template(unit_marked(text)), template(unit_marked(F.concat(F.lit("x "), text)))
    words = items.select("item_id", F.explode(F.array_distinct(F.array(
        alone, F.slice(behind, 2, F.greatest(F.size(behind), F.lit(1)))))).alias("_w")).where(F.size("_w") > 0)
    words = words.withColumn("total", F.size("_w")).withColumn("width", F.least("total", F.lit(width)))
    return words.select("item_id", "total", "width", F.explode(F.expr(windows("_w", "width"))).alias("_x")).select(
        "item_id", "total", "width", "_x.at", "_x.h").distinct()


def find(docs: DataFrame, items: DataFrame, width: int = WINDOW, coverage: float = COVERAGE, shift: int = SHIFT) -> DataFrame:
    """``doc_id, item_id, position, matched, total, slots_changed``: documents that hold an
    item of ``items`` (``item_id, text``), as it is, lightly edited or with other values.

    A document holds an item if at least ``coverage`` of the item's words lie in windows
    that occur in it at distances at most ``shift`` apart, and the values on the
    placeholders in these windows map one to one.  An item of fewer than ``width`` words
    has to occur whole, and with its values if it has no other word.  ``position`` is the
    template word where the item would begin by most of its windows, ``matched`` and
    ``total`` are words, and ``slots_changed`` tells whether any value differs.  Null and
    empty texts match nothing; rows that share a ``doc_id`` count as one document of
    several texts; repeated rows give one row; empty tables give none.
    """
    wanted = materialize(item_windows(items, width))
    keys = wanted.select("h").distinct()
    small = wanted.count() <= BROADCAST_WINDOWS
    widths = sorted(r["width"] for r in wanted.select("width").distinct().collect())
    every = [windows("w", w) for w in widths or [width]]
    # the template is a lambda's argument, so that it is made once; a filter on its size
    # would make it a second time
    texts = docs.select("doc_id", F.array(template(unit_marked(F.col("text")))).alias("_w"))
    seen = texts.select("doc_id", F.explode(F.expr(f"flatten(transform(_w, w -> concat({', '.join(every)})))")).alias("_x")).select(
        "doc_id", F.col("_x.at").alias("_doc_at"), F.col("_x.h").alias("h"))
    hits = materialize(seen.join(F.broadcast(keys) if small else keys, "h"))
    lines = (
        hits.join(F.broadcast(wanted) if small else wanted, "h")
        .groupBy("doc_id", "item_id", "total", "width", (F.col("_doc_at") - F.col("at")).alias("_shift"))
        .agg(F.collect_set("at").alias("_ats"))
    )
    # distances at most ``shift`` apart share one of two overlapping ranges; of the windows
    # that occur at several distances in it the one on the longest line counts
    of_longest = F.expr("""aggregate(_lines, cast(array() AS array<struct<at: int, shift: int>>), (taken, l) -> concat(taken,
        transform(filter(l.ats, a -> NOT exists(taken, t -> t.at = a)), a -> struct(a AS at, -l.back AS shift))))""")
    ranges = (
        lines.withColumn("_range", F.explode(F.expr(f"array(floor(_shift / {shift + 1}), floor(_shift / {shift + 1}) + 1)")))
        .groupBy("doc_id", "item_id", "total", "width", "_range")
        .agg(F.sort_array(F.collect_list(F.struct(F.size("_ats").alias("n"), (-F.col("_shift")).alias("back"), F.col("_ats").alias("ats"))), False).alias("_lines"))
        .select("doc_id", "item_id", "total", "width", (-F.col("_lines")[0]["back"]).alias("position"), of_longest.alias("_at"))
    )
    alone = lines.select("doc_id", "item_id", "total", "width", F.col("_shift").alias("position"),
                         F.expr("transform(_ats, a -> struct(a AS at, _shift AS shift))").alias("_at"))
    covered = "array_distinct(flatten(transform(_at, x -> transform(sequence(0, width - 1), k -> struct(x.at + k AS at)))))"
    candidates = materialize(
        ranges.unionByName(alone).withColumn("matched", F.size(F.expr(covered)))
        .where(F.col("matched") >= F.ceil(coverage * F.col("total")))
        .withColumn("_at", F.array_sort("_at")).distinct())

    def with_slots(df, key, words, values):
        marked = df.withColumn("_m", unit_marked(F.col("text")))
        return marked.select(key, template(F.col("_m")).alias(words), slots(F.col("_m")).alias(values))

    chosen = candidates.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.select("doc_id", "text").join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    found = (
        candidates.join(with_slots(texts, "doc_id", "_w", "_v").withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")))
        .join(with_slots(items.select("item_id", "text"), "item_id", "_iw", "_iv"), "item_id")
    )

    # the k-th placeholder of a template has the k-th value
    def placeholders(words):
        return F.expr(f"filter(sequence(0, greatest(size({words}) - 1, 0)), i -> get({words}, i) IN ('{A_NUMBER}', '{A_NAME}'))")

    def value(places, values, at):
        return f"if(array_contains({places}, {at}), get({values}, cast(array_position({places}, {at}) - 1 AS int)), NULL)"

    pairs = f"""array_distinct(filter(flatten(transform(_at, x -> transform(sequence(0, width - 1), k -> struct(
        {value('_ip', '_iv', 'x.at + k')} AS a, {value('_dp', '_v', 'x.at + k + x.shift')} AS b)))), x -> x.a IS NOT NULL AND x.b IS NOT NULL))"""
    # stored, so that neither the places nor the pairs are worked out once per use
    placed = materialize(found.withColumns({"_dp": placeholders("_w"), "_ip": placeholders("_iw")}).drop("_w"))
    paired = materialize(placed.withColumn("_p", F.expr(pairs)).drop("_dp", "_ip", "_v", "_iv", "_at"))
    held = (
        paired.where("size(_p) = size(array_distinct(_p.a)) AND size(_p) = size(array_distinct(_p.b))")
        .withColumn("slots_changed", F.exists("_p", lambda x: x["a"] != x["b"]))
        .where(f"NOT slots_changed OR exists(_iw, w -> w NOT IN ('{A_NUMBER}', '{A_NAME}', '{A_UNIT}'))")
    )
    best = F.max_by(F.struct("position", "matched", "slots_changed"), F.struct("matched", ~F.col("slots_changed"), -F.col("position")))
    return held.groupBy("doc_id", "item_id", "total").agg(best.alias("_b")).select(
        "doc_id", "item_id", "_b.position", "_b.matched", "total", "_b.slots_changed")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold none of ``items``, with all columns, whatever their
    names.  Null and empty texts stay, repeated rows stay or go together, rows without
    ``doc_id`` are one document."""
    key = "_held" + "_" * max(map(len, docs.columns))
    held = materialize(find(docs, items).select(F.col("doc_id").alias(key)).distinct())
    return docs.join(held, F.col("doc_id").eqNullSafe(F.col(key)), "left_anti")
