"""Monthly trends of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.operators.levels import as_time
from tallygrid.operators.profile import long_form
from tallygrid.operators.quantiles import exact_quantiles
from tallygrid.session import nan_to_null


def temporal_trends(df: DataFrame, time: str, measures: Sequence[str] = ()) -> DataFrame:
    """``period`` (YYYY-MM), ``count`` and each measure's ``_mean`` and ``_median``; rows whose
    date cannot be read are left out."""
    dated = nan_to_null(df).withColumn("period", F.date_format(as_time(df, time), "yyyy-MM")).where("period IS NOT NULL")
    out = dated.groupBy("period").agg(F.count(F.lit(1)).alias("count"), *[F.round(F.avg(F.col(f"`{c}`").cast("double")), 4).alias(f"{c}_mean") for c in measures])
    if not measures:
        return out
    values = long_form(dated, measures, ["period"]).where("value IS NOT NULL")
    medians = exact_quantiles(values, ["period", "variable"], "value", [0.5])
    # A row per month, with a column per measure.
    wide = medians.groupBy("period").agg(*[F.round(F.first(F.when(F.col("variable") == c, F.col("q")[0]), ignorenulls=True), 4).alias(f"{c}_median") for c in measures])
    return out.join(wide, "period", "left")
