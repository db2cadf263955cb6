"""Reading tables and keeping intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared
from ..sources.shared import ship as small_batches  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """A table in the shared folder (``shared.written``); shuffle files that no table in use still needs are dropped, when the driver collects garbage."""
    out = shared.written(df, label, small)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def let_go(spark: SparkSession) -> None:
    """Collect once more when listeners are done with the last query: until then they hold it, and its shuffle files stay through the next."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def buckets(spark: SparkSession, size: int = 0, bucket: int = 64_000_000) -> int:
    """Groups of a shuffle that is planned by hand: as many as the session's shuffle partitions, 32 at least, and so many that of ``size`` counted bytes each holds ``bucket``."""
    return max(32, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket))


def text_bytes(documents: DataFrame) -> int:
    """Bytes of all texts."""
    return documents.agg(F.sum(F.octet_length(documents["text"]).cast("long"))).first()[0] or 0


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just the columns an operator works on; extra ones, whatever their names, never reach its joins."""
    return df.select(*[df[c] for c in columns])
