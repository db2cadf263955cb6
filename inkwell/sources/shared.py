"""What every Python operator needs of the cluster: the package on all workers, and a folder that all of them see."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch handed to Python: whole texts must fit, so the default of 10,000 is too many.
BATCH_ROWS = 400
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Workers anywhere can import this package; the session's Arrow batches hold few enough whole texts (a smaller setting is left as it is)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        made = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(made))
        _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where that is unset on one machine (tests), a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "inkwell-shared")
    return root.rstrip("/")


def written(df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and executors may be lost.

    The table goes when the driver's JVM ends; results may be read until then. ``small`` tables of ids or links are written in
    files of Spark's advisory size, not in one for each core.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    name = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(name)
    spark.conf.set(name, "false" if small else before)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(name, before)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
