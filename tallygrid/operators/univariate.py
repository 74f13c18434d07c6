"""Descriptives and frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygrid.functions.stats import Z95, kurtosis, percent, skewness, wald_limits
from tallygrid.operators.profile import long_form, outliers
from tallygrid.operators.quantiles import exact_quantiles
from tallygrid.session import nan_to_null

PROBS = (0.1, 0.25, 0.5, 0.75, 0.9)


def describe(df: DataFrame, columns: Sequence[str], level: str, digits: int = 4, digits_large: int | None = None) -> DataFrame:
    """Full descriptives of numeric columns of one level (E4), a row per column.

    The mean is ``M``, for ordinal columns ``M_quasi_interval`` and without outer percentiles.
    A column with one valid value has no dispersion and a note; one with none has only counts.
    Moments, modes, quantiles and outliers are group-bys over (variable, value) rows, all with
    partial aggregation.
    """
    large = digits if digits_large is None else digits_large
    every = long_form(df, columns)
    values = every.where("value IS NOT NULL")
    n = F.count("value")
    nd = n.cast("double")
    moments = every.groupBy("variable").agg(
        F.count(F.lit(1)).alias("_all"), n.alias("N_valid"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"), F.var_samp("value").alias("var"),
        F.min("value").alias("lo"), F.max("value").alias("hi"), skewness("value", nd).alias("sk"), kurtosis("value", nd).alias("ku"),
    )
    q = exact_quantiles(values, ["variable"], "value", PROBS)
    q = q.select("variable", *[F.col("q")[i].alias(name) for i, name in enumerate(("p10", "q1", "med", "q3", "p90"))])
    histogram = values.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("k"))
    modes = histogram.groupBy("variable").agg(F.max(F.struct("k", (-F.col("value")).alias("v"))).alias("best")).select("variable", (-F.col("best.v")).alias("mode"))
    # Each side is a row per column of the table.
    all_facts = moments.join(q, "variable", "left").join(modes, "variable", "left").join(outliers(values, q), "variable", "left")
    some, more = F.col("N_valid") > 0, F.col("N_valid") > 1
    se = F.col("sd") / F.sqrt("N_valid")
    mean_name = "M_quasi_interval" if level == "ordinal" else "M"

    def rounded(x, name, when=some, d=digits):
        return F.when(when, F.round(x, d)).alias(name)

    return all_facts.select(
        "variable", F.lit(level).alias("level"), "N_valid", (F.col("_all") - F.col("N_valid")).alias("missing_count"),
        percent(F.col("_all") - F.col("N_valid"), F.col("_all")).alias("missing_pct"),
        rounded(F.col("m"), mean_name), rounded(F.col("med"), "Mdn"), rounded(F.col("mode"), "Mode"), rounded(F.col("sd"), "SD", more),
        rounded(F.col("var"), "Variance", more, large), rounded(F.col("hi") - F.col("lo"), "Range", more), rounded(F.col("q3") - F.col("q1"), "IQR", more),
        rounded(F.try_divide(F.col("sd"), F.col("m")) * 100, "CV_pct", more, 2), rounded(F.col("lo"), "Min"), rounded(F.col("q1"), "Q1_25th"),
        rounded(F.col("q3"), "Q3_75th"), rounded(F.col("hi"), "Max"), rounded(F.col("sk"), "Skewness", more), rounded(F.col("ku"), "Kurtosis", more),
        rounded(se, "SE", more), rounded(F.col("m") - Z95 * se, "CI95_lower", more), rounded(F.col("m") + Z95 * se, "CI95_upper", more),
        F.when(more, F.col("mild_outliers")).alias("mild_outliers"), F.when(more, F.col("extreme_outliers")).alias("extreme_outliers"),
        *([] if level == "ordinal" else [rounded(F.col("p10"), "P10"), rounded(F.col("p90"), "P90")]),
        F.when(F.col("N_valid") == 1, "single valid value").alias("note"),
    )


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column``, ``value`` (as text), ``count`` and ``total`` of non-null values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    values = nan_to_null(df).select(F.explode(pairs).alias("p")).select("p.column", "p.value").where("value IS NOT NULL")
    counts = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("column").agg(F.sum("count").alias("total"))
    return counts.join(F.broadcast(totals), "column")  # a row per column of the table


def nominal_frequencies(df: DataFrame, columns: Sequence[str], top_n: int = 10) -> DataFrame:
    """The most frequent values of each column (E5, W4); ties by value."""
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    ranked = frequencies(df, columns).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_n)
    return ranked.select("column", "value", "count", percent(F.col("count"), F.col("total")).alias("pct"))


def binary_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Proportions of two-valued columns with 95 % limits."""
    counts = frequencies(df, columns)
    p = F.col("count") / F.col("total")
    low, high = wald_limits(p, F.col("total"))
    return counts.select("column", "value", "count", F.round(p, 4).alias("proportion"), F.round(low, 4).alias("CI95_lower"), F.round(high, 4).alias("CI95_upper"))


def ordinal_frequency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequencies in order of the value with cumulative shares."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    counts = nan_to_null(df).select(F.explode(pairs).alias("p")).select("p.column", "p.value").where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy("column")
    upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("count").over(whole)
    return counts.select("column", "value", "count", percent(F.col("count"), total).alias("pct"), percent(F.sum("count").over(upto), total).alias("cumulative_pct"))
