"""Session helper and ingest rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(name: str = "tallygrid", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session as the tests use it; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").getOrCreate()
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing means null: NaN in floating columns becomes null."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floating else F.col(f"`{c}`") for c in df.columns])
