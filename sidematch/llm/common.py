"""Helpers the operators share: batches, shared files, two-level ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sidematch.session import _app_folder, ship_package

BATCH_ROWS = 1024


def python_ready(spark: SparkSession) -> None:
    """Executors get the package; Arrow batches stay small, whatever the texts' length."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: StructType | str) -> DataFrame:
    python_ready(df.sparkSession)
    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, source: str, fields: list[StructField],
                compute: Callable[[list], list]) -> DataFrame:
    """``df`` with columns that ``compute`` derives from one column, batch by batch."""
    at = df.columns.index(source)

    def run(batches):
        for batch in batches:
            added = compute(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(x) for x in added)],
                names=[*batch.schema.names, *(f.name for f in fields)],
            )

    return map_batches(df, run, StructType([*df.schema.fields, *fields]))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files below ``spark.checkpoint.dir``."""
    import uuid

    return f"{_app_folder(spark)}/{name}-{uuid.uuid4().hex}"


def create_file(path: str):
    """An output stream on a shared file system; its folder is made if it is missing."""
    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(place, compression=None)


def open_file(path: str):
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def ranked(df: DataFrame, by: str, order: list[str], rows: int, per_slice: int = 200_000) -> DataFrame:
    """``df`` with ``_rank``, from 0 within ``by``: slices of a group are numbered on
    their own and start after the rows of the slices before, so that no task holds
    a whole group.  ``rows`` is the number of rows; ``df`` has to be stored."""
    from pyspark.sql import Window

    n = max(1, -(-rows // per_slice))
    df = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    before = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(by, "_slice").agg(F.count("*").alias("_n")).select(
        by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(by, "_slice").orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(inside) - 1)
        .join(starts, [by, "_slice"])
        .withColumn("_rank", F.col("_base") + F.col("_row"))
        .drop("_slice", "_row", "_base")
    )


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
