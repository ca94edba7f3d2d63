"""Quality rules of documents, and of the hosts that send them.

Each document is measured on its whole text.  Failures are counted per host, the
failure rate of a host is shrunk towards the rate of all hosts with a beta prior fitted
to the hosts themselves, and the verdict on the host is joined back to its documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from sidematch.session import materialize
from .common import add_columns

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
# A host whose shrunk failure rate reaches this loses all its documents.
MAX_HOST_RATE = 0.5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key = (key ^ codes[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    edges[starts] += 1
    np.subtract.at(edges, starts + width, 1)
    return int((np.cumsum(edges) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """``MEASURES`` of one text; all 0 for null and empty."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def with_measures(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with the five measures of ``text`` as long columns."""
    def compute(texts):
        found = np.array([measure(t) for t in texts], np.int64).reshape(-1, len(MEASURES))
        return list(found.T)

    return add_columns(docs, "text", [StructField(prefix + m, LongType()) for m in MEASURES], compute)


def base_failed(prefix: str = "") -> Column:
    n_words, repeat = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)


def host_verdicts(measured: DataFrame, host: str = "source", failed: str = "base_failed",
                  max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host, n_docs, n_failed, shrunk_rate, host_failed``, a row per host (one for null).

    The prior's mean is the rate over all documents; its weight comes from how far the
    rates of hosts spread beyond what their sizes explain (method of moments).  With
    one host, or no spread left, the prior outweighs any host and nobody is singled out.
    """
    hosts = materialize(measured.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed")))
    mean, weight = hosts.agg(
        F.sum("n_docs").alias("_n"), F.sum("n_failed").alias("_k"), F.count("*").alias("_h"),
        F.sum(F.col("n_docs") * F.col("n_docs")).alias("_n2"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("_kk"),
    ).selectExpr(
        "_n", "_h", "_n2", "_k / _n AS _mean",
        # spread of the rates: sum of n (rate - mean)^2
        "_kk - _k * (_k / _n) AS _spread",
    ).selectExpr(
        "_mean",
        """CASE WHEN _h > 1 AND _mean > 0 AND _mean < 1 AND _n * _n > _n2 THEN
             (_spread - (_h - 1) * _mean * (1 - _mean)) / (_n - _n2 / _n) END AS _between""",
    ).selectExpr(
        "coalesce(_mean, 0D)",
        """CASE WHEN _between > 0 THEN greatest(_mean * (1 - _mean) / _between - 1, 0D)
           ELSE 1e12D END""",
    ).first()
    return hosts.withColumn("shrunk_rate", (F.col("n_failed") + weight * mean) / (F.col("n_docs") + weight)).withColumn(
        "host_failed", F.col("shrunk_rate") >= max_rate)


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """Measures and verdict of every row of ``docs`` (``doc_id, text`` and the host).

    ``kept`` is false if the base rules fail, else unless the host failed.  A null or
    empty text has no word and fails; documents without a host form one group; repeated
    rows are judged one by one; an empty table gives none.
    """
    docs = docs.select("doc_id", "text", F.col(host).alias("_host"))
    measured = materialize(with_measures(docs).drop("text").withColumn("base_failed", base_failed()))
    hosts = host_verdicts(measured, "_host").select("host", "n_docs", "n_failed", "shrunk_rate", "host_failed")
    joined = measured.join(hosts, F.col("_host").eqNullSafe(F.col("host")))
    return joined.select(
        "doc_id", *MEASURES, "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"),
        F.col("host").alias("host"), F.col("n_docs").alias("host_docs"),
        F.col("n_failed").alias("host_failures"), "shrunk_rate",
    )


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Texts are measured twice - for the hosts, then for the rows - instead of being
    shuffled or stored in between.
    """
    counted = with_measures(docs.select("text", F.col(host).alias("_host")), "_q_")
    counted = counted.select("_host", base_failed("_q_").alias("_failed"))
    hosts = host_verdicts(counted, "_host", "_failed").where("host_failed").select("host")
    kept = with_measures(docs, "_q_").where(~base_failed("_q_"))
    kept = kept.drop(*("_q_" + m for m in MEASURES))
    return kept.join(hosts, kept[host].eqNullSafe(hosts["host"]), "left_anti")
