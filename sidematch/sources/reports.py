"""Report files as documents and lines."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sidematch.functions.text import unix_newlines
from sidematch.operators.scan import CHUNK, SLICE, Chunk
from sidematch.session import MAX_GROUP_ROWS

DOC_KEYS = ["side", "doc_id"]
TOO_LONG = "longer than"


def read_reports(
    spark: SparkSession, path: str, side: str, exts: Sequence[str] = (".txt",), max_bytes: int | None = None
) -> DataFrame:
    """Files directly inside ``path`` with one of the extensions (any case), one row
    per lower-cased file name: ``side, doc_id, file_name, match_name, ext, text, error``.

    When names differ in case only, the last one in file-name order is kept.  Bytes
    that are not UTF-8 become replacement characters.  A file longer than ``max_bytes``
    (by default what Spark puts into one cell), or one that fails while it is read, has
    no text but an ``error``; the former are marked ``long``, for ``read_lines``.
    """
    wanted = [e.lower() for e in exts]
    # A glob that ignores case, so that other files are not even listed for reading.
    globs = ["*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in wanted]
    return _files(spark, path, side, max_bytes, "{" + ",".join(globs) + "}").where(F.col("ext").isin(wanted))


def read_file(spark: SparkSession, path: str, side: str, max_bytes: int | None = None) -> DataFrame:
    """One file of any name, as ``read_reports`` gives it."""
    return _files(spark, path, side, max_bytes, None)


def _files(spark: SparkSession, path: str, side: str, max_bytes: int | None, names: str | None) -> DataFrame:
    def source() -> DataFrame:
        reader = spark.read.format("binaryFile").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
        return (reader.option("pathGlobFilter", names) if names else reader).load(path)

    found = source()
    longest = max_bytes or int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str((1 << 31) - 1)))
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name")
    text = F.make_valid_utf8(F.col("content").cast("string")).alias("text")
    is_long = F.col("error").startswith(TOO_LONG)
    read = found.where(F.col("length") <= longest).select(name, text, F.lit(None).cast("string").alias("error"))
    over = found.where(F.col("length") > longest).select(
        name, F.lit(None).cast("string").alias("text"), F.lit(f"{TOO_LONG} {longest} bytes").alias("error"))
    # the list of files, which Spark made when it opened the folder
    listed = spark.createDataFrame([(unquote(p.rsplit("/", 1)[-1]),) for p in found.inputFiles()], "file_name string")
    failed = listed.select("file_name", F.lit(None).cast("string").alias("text"), F.lit("could not be read").alias("error"))
    newest = Window.partitionBy("match_name").orderBy(F.col("file_name").desc(), F.col("_failed"))
    files = read.unionByName(over).withColumn("_failed", F.lit(0)).unionByName(failed.withColumn("_failed", F.lit(1)))
    return (
        files.withColumns({
            "match_name": F.lower("file_name"),
            "ext": F.lower(F.regexp_extract("file_name", r"[^.](\.[^.]+)$", 1)),
        })
        .withColumn("_k", F.row_number().over(newest))
        .where("_k = 1")
        .select(
            F.lit(side).alias("side"),
            F.col("match_name").alias("doc_id"),
            "file_name",
            "match_name",
            "ext",
            "text",
            "error",
            F.coalesce(is_long, F.lit(False)).alias("long"),
        )
    )


def explode_lines(docs: DataFrame, keys: Sequence[str] = DOC_KEYS, text: str = "text") -> DataFrame:
    """``keys, line_no, line``: the text cut at line ends, ``line_no`` from 1."""
    lines = F.split(unix_newlines(F.col(text)), "\n", -1)
    return docs.select(*keys, F.posexplode(lines).alias("_p", "line")).select(
        *keys, (F.col("_p") + 1).alias("line_no"), "line"
    )


def slice_width(docs: DataFrame, text: str = "text", width: int = CHUNK, growth: int = 1) -> Chunk:
    """Slices for the lines of ``docs``: None, so that plain windows are used, while the
    longest text has no more lines than one task may sort, else ``width``.  ``growth`` is
    how many lines one line of the text may become."""
    ends = sum(F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit(""))) for c in "\n\r")
    longest = docs.agg(F.max(ends)).first()[0] or 0
    return None if (longest + 1) * growth <= MAX_GROUP_ROWS else width


def read_lines(spark: SparkSession, path: str | list[str], side: str) -> DataFrame:
    """Lines of files too large for one cell: ``side, doc_id, line_no, line``.

    Spark splits the files; a line's number is its offset inside the split plus the
    lines of the splits before it, so nothing is sorted and no file is one task.
    Bytes that are not UTF-8 become replacement characters.
    """
    name = F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))
    raw = spark.read.text(path).select(
        F.lit(side).alias("side"),
        F.lower(F.url_decode(name)).alias("doc_id"),
        F.col("_metadata.file_block_start").alias(SLICE),
        F.monotonically_increasing_id().alias("_id"),
        F.make_valid_utf8("value").alias("line"),
    )
    splits = raw.groupBy(*DOC_KEYS, SLICE).agg(
        F.min("_id").alias("_first"), F.count("*").alias("_n")
    )
    before = Window.partitionBy(*DOC_KEYS).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return raw.join(splits, [*DOC_KEYS, SLICE]).select(
        *DOC_KEYS, (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "line"
    )
