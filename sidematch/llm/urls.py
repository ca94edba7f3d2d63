"""URL filter: explicit rules first, then two character models.

URLs that a rule allows or blocks train one smoothed variable-order Markov model each.
Any other URL is judged by the difference of its log-likelihoods per character, against
a threshold calibrated on the URLs with a rule.

Everything is counted on the different windows of ``ORDER`` characters: lower orders are
sums over them, so all probabilities are a few joins of short tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidematch.session import materialize

ORDER = 4
ALPHABET = 128
# Share of the allowed URLs that the threshold may block.
FALSE_BLOCKS = 0.01
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# verdict, host, path
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def url_parts(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, text``; text is what follows ``://``, lower-cased."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.col("url").substr(at + 3, F.length("url"))).otherwise("")
    host = F.regexp_extract("_rest", "^[^/?#]*", 0)
    return (
        pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
        .withColumn("_rest", F.coalesce(rest, F.lit("")))
        .withColumn("_host", host)
        .select(
            "page_id", F.translate("_host", UPPER, LOWER).alias("host"),
            F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), "^[^?#]*", 0).alias("path"),
            F.translate("_rest", UPPER, LOWER).alias("text"),
        )
    )


def rule_columns(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def windows(urls: DataFrame, *keep: str) -> DataFrame:
    """A row per character of ``text`` and one for its end: the character and those before it."""
    text = F.concat(F.lit("\u0002" * (ORDER - 1)), F.col("text"), F.lit("\u0003"))
    return urls.select(*keep, text.alias("_padded"), F.explode(
        F.sequence(F.lit(1), F.length("text") + 1)).alias("_i")).select(
        *keep, F.col("_padded").substr(F.col("_i"), F.lit(ORDER)).alias("gram"))


def log_ratios(grams: DataFrame) -> DataFrame:
    """``gram, ratio``: log2 of its last character's probability among allowed URLs over
    that among blocked ones.

    ``grams``: ``gram, a, b``, every window that occurs with its counts on both sides.
    Order k gives ``(n + kinds * shorter) / (total + kinds)`` (Witten-Bell), and the
    shorter context's probability where its own was never seen.
    """
    levels = [grams]
    for _ in range(ORDER - 1):
        levels.append(
            levels[-1].groupBy(F.expr("substring(gram, 2)").alias("gram"))
            .agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    known = None
    for level in reversed(levels):
        here = level.withColumn("_ctx", F.expr("substring(gram, 1, length(gram) - 1)"))
        totals = here.groupBy("_ctx").agg(
            F.sum("a").alias("_na"), F.sum("b").alias("_nb"),
            F.sum((F.col("a") > 0).cast("long")).alias("_ta"), F.sum((F.col("b") > 0).cast("long")).alias("_tb"))
        here = here.join(totals, "_ctx")
        if known is None:
            here = here.withColumns({"_pa": F.lit(1.0 / ALPHABET), "_pb": F.lit(1.0 / ALPHABET)})
        else:
            here = here.withColumn("_short", F.expr("substring(gram, 2)")).join(known, "_short")
        mixed = {
            s: F.when(F.col(f"_n{s}") > 0, (F.col(s) + F.col(f"_t{s}") * F.col(f"_p{s}")) / (F.col(f"_n{s}") + F.col(f"_t{s}")))
            .otherwise(F.col(f"_p{s}")) for s in "ab"
        }
        here = here.select("gram", mixed["a"].alias("_pa"), mixed["b"].alias("_pb"))
        known = here.withColumnRenamed("gram", "_short")
    return known.select(F.col("_short").alias("gram"), F.log2(F.col("_pa") / F.col("_pb")).alias("ratio"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
          false_blocks: float = FALSE_BLOCKS) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages``.

    ``score`` is the log-likelihood difference per character (the end counts as one) to
    three places; scores below the ``false_blocks`` quantile of the allowed URLs are
    blocked.  Without any URL allowed or any blocked by rule, nothing else is blocked.
    A null URL, or one without ``://``, is an empty text and judged like any other;
    repeated rows each get a row; an empty table gives none.
    """
    rule, verdict = rule_columns(rules)
    urls = url_parts(pages).withColumns({"rule": rule, "_by_rule": verdict})
    texts = materialize(urls.groupBy("text").agg(
        F.sum((F.col("_by_rule") == "allow").cast("long")).alias("a"),
        F.sum((F.col("_by_rule") == "block").cast("long")).alias("b"),
    ).select("text", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")))
    grams = materialize(windows(texts, "a", "b").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    ratios = log_ratios(grams)
    scores = materialize(
        windows(texts, "text", "a", "b").groupBy("text", "a", "b", "gram").agg(F.count("*").alias("_k"))
        .join(ratios, "gram").groupBy("text", "a", "b")
        .agg(F.round(F.sum(F.col("_k") * F.col("ratio")) / F.sum("_k"), 3).alias("score")))
    # the score at which the allowed URLs reach the share; one row per score, in thousandths
    counted = scores.groupBy("score").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    steps = counted.selectExpr(
        "score", "sum(a) OVER (ORDER BY score) AS upto", "sum(a) OVER () AS allowed", "sum(b) OVER () AS blocked")
    cut = steps.where((F.col("allowed") > 0) & (F.col("blocked") > 0) & (F.col("upto") >= false_blocks * F.col("allowed")))
    threshold = cut.agg(F.min("score")).first()[0]
    below = F.col("score") < threshold if threshold is not None else F.lit(False)
    return urls.join(scores.select("text", "score"), "text").select(
        "page_id", "host", "path", "rule",
        F.coalesce("_by_rule", F.when(below, "block").otherwise("allow")).alias("verdict"), "score")
