"""Session helpers: where intermediate tables go, and size checks."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one group that a single task may sort and scan; larger ones are cut into blocks
# of as many.
MAX_GROUP_ROWS = 1 << 16

_SHIPPED: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster the
    folder has to be reachable from every executor, so it must be configured.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="sidematch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a parquet table and read it back.

    Used where a result feeds several branches of a plan: lineage is cut, later
    reads prune columns, and a lost executor costs a re-read, not a re-parse.
    """
    spark = df.sparkSession
    path = f"{_app_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _app_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/sidematch/{spark.sparkContext.applicationId}"


def drop_intermediate(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once its results are
    written: results not yet written still read them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_app_folder(spark))
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.delete(path, True)


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Row count of the largest group (partial counts are combined map-side)."""
    row = df.groupBy(*by).count().agg(F.max("count").alias("n")).first()
    return row["n"] or 0


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors, once per application.

    Functions that run in Python workers are found by name there, and a worker's
    path need not hold the folder the driver was started from.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    folder = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="sidematch-"), "sidematch_package.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for root, _, files in os.walk(folder):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(root, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(folder)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
