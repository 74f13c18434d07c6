"""Dataset profile, data quality, duplicates and attention flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.stats import percent
from tallygrid.operators.levels import Level, column_facts, of_level
from tallygrid.operators.quantiles import exact_quantiles
from tallygrid.session import nan_to_null


def level_column(levels: Mapping[str, Level]) -> Column:
    """The level of the column named in ``column``."""
    pairs = [F.lit(str(x)) for item in levels.items() for x in item]
    return F.element_at(F.create_map(*pairs), F.col("column"))


def dataset_profile(df: DataFrame, levels: Mapping[str, Level]) -> DataFrame:
    """One row per profiled column."""
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return column_facts(df).select(
        F.col("n").alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"), "column", level_column(levels).alias("detected_type"),
        F.element_at(kinds, F.col("column")).alias("dtype"), "nunique", F.col("missing").alias("missing_count"),
        F.coalesce(percent(F.col("missing"), F.col("n")), F.lit(0.0)).alias("missing_pct"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``duplicate_rows``: rows beyond the first of each kind, nulls equal.

    Hashes find the rows that may have a double; only those are compared whole.
    """
    hashed = nan_to_null(df).select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("_h"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    suspects = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("_h")
    kinds = hashed.join(suspects, "_h", "left_semi").groupBy("_h", "_row").agg(F.count(F.lit(1)).alias("k"))
    return kinds.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def long_form(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per value: ``keys``, ``variable`` and ``value`` (double)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    return nan_to_null(df).select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.variable", "_p.value")


def outliers(values: DataFrame, quartiles: DataFrame) -> DataFrame:
    """Per ``variable`` the values outside 1.5 and 3 interquartile ranges; fences are strict.

    ``quartiles`` has one row per variable and is broadcast.
    """
    fences = quartiles.select("variable", F.col("q1").alias("_a"), F.col("q3").alias("_b"), (F.col("q3") - F.col("q1")).alias("_r"))
    x = F.col("value")

    def outside(k: float) -> Column:
        return F.count_if((x < F.col("_a") - k * F.col("_r")) | (x > F.col("_b") + k * F.col("_r")))

    return values.join(F.broadcast(fences), "variable").groupBy("variable").agg(outside(1.5).alias("mild_outliers"), outside(3.0).alias("extreme_outliers"))


def data_quality(df: DataFrame, levels: Mapping[str, Level]) -> DataFrame:
    """Missing, duplicate, constant and outlying values per column."""
    numeric = of_level(levels, Level.CONTINUOUS, Level.DISCRETE)
    facts = column_facts(df).crossJoin(F.broadcast(duplicate_rows(df)))  # one row
    base = facts.select(
        "column", level_column(levels).alias("type"), F.col("missing").alias("missing_count"),
        F.coalesce(percent(F.col("missing"), F.col("n")), F.lit(0.0)).alias("missing_pct"), "duplicate_rows",
        (F.col("nunique") <= 1).alias("is_constant"), (F.col("n") - F.col("missing")).alias("_valid"),
    )
    if not numeric:
        return base.select(*[c for c in base.columns if c != "_valid"], F.lit(None).cast("long").alias("mild_outliers"), F.lit(None).cast("long").alias("extreme_outliers"))
    values = long_form(df, numeric).where("value IS NOT NULL")
    q = exact_quantiles(values, ["variable"], "value", [0.25, 0.75]).select("variable", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    found = outliers(values, q)
    enough = F.col("_valid") > 3
    return base.join(F.broadcast(found), base["column"] == found["variable"], "left").select(
        *[c for c in base.columns if c != "_valid"], F.when(enough, F.col("mild_outliers")).alias("mild_outliers"), F.when(enough, F.col("extreme_outliers")).alias("extreme_outliers"),
    )


def type_counts(levels: Mapping[str, Level], spark) -> DataFrame:
    """How many columns have each level."""
    rows = spark.createDataFrame([(c, str(level)) for c, level in levels.items()], "column string, detected_type string")
    return rows.groupBy("detected_type").agg(F.count(F.lit(1)).alias("n_columns"))


def attention_flags(profile: DataFrame, described: DataFrame | None = None, correlations: DataFrame | None = None) -> DataFrame:
    """What needs a look (P14): ``subject``, ``flag`` and ``value``."""
    found = [
        profile.where("missing_pct > 20").select(F.col("column").alias("subject"), F.lit("missing over 20 %").alias("flag"), F.col("missing_pct").alias("value")),
        profile.where("detected_type = 'id' AND nunique > 0.95 * n_rows").select(F.col("column").alias("subject"), F.lit("unique like an id").alias("flag"), F.col("nunique").cast("double").alias("value")),
    ]
    if described is not None:
        for column, limit, flag in (("Skewness", 2, "skewness over 2"), ("Kurtosis", 7, "kurtosis over 7"), ("CV_pct", 100, "variation over 100 %")):
            found.append(described.where(F.abs(column) > limit).select(F.col("variable").alias("subject"), F.lit(flag).alias("flag"), F.col(column).alias("value")))
    if correlations is not None:
        found.append(correlations.where(F.abs("r") > 0.7).select(F.concat_ws(" ~ ", "col1", "col2").alias("subject"), F.lit("correlation over .7").alias("flag"), F.col("r").alias("value")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def schema_summary(profile: DataFrame) -> DataFrame:
    """``line``: a column's name, level, different and missing values, from its profile."""
    return profile.select(F.format_string("%s: %s, %d different, %.2f %% missing", "column", "detected_type", "nunique", "missing_pct").alias("line"))


#: Rows of a dry run, a fixed value.
DRY_ROWS = 10


def limited(df: DataFrame, limit: int | None = None, dry_run: bool = False) -> DataFrame:
    """The first ``limit`` rows, or a few for a dry run (T5); all rows without either."""
    rows = [n for n in (limit, DRY_ROWS if dry_run else None) if n is not None]
    return df.limit(min(rows)) if rows else df


def preview(df: DataFrame, rows: int = 5) -> dict[str, object]:
    """First rows and types of a table."""
    return {"head": df.limit(rows), "dtypes": dict(df.dtypes), "facts": column_facts(df)}
