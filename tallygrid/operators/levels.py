"""Measurement levels (C1, C2, P1) and the column facts they rest on.

A column's value histogram (one group-by per column over that column alone) gives its rows,
missing values and distinct values at once. The branches read disjoint columns of a columnar
source, so together they read it once, and counts combine before each shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from enum import StrEnum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.session import nan_to_null


class Level(StrEnum):
    """Measurement level of a column."""

    ID = "id"
    BINARY = "binary"
    NOMINAL = "nominal"
    ORDINAL = "ordinal"
    DISCRETE = "discrete"
    CONTINUOUS = "continuous"
    TEMPORAL = "temporal"
    TEXT = "text"
    UNKNOWN = "unknown"
    AMBIGUOUS_INTEGER = "ambiguous_integer"


#: Levels that a user may assign.
ASSIGNABLE = frozenset(Level) - {Level.UNKNOWN, Level.AMBIGUOUS_INTEGER}
#: Date formats that a text column may hold: fixed values.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy")
#: Values tried as dates, and the share of them that must parse.
DATE_SAMPLE, DATE_SHARE = 20, 0.8
UNIQUE_SHARE, UNIQUE_ROWS, FEW_VALUES, LONG_TEXT = 0.95, 10, 20, 50

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONS = (T.FloatType, T.DoubleType, T.DecimalType)
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def parse_time(text: Column) -> Column:
    """A date or time in one of the known formats (D1); anything else is null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def as_time(df: DataFrame, column: str) -> Column:
    """A column as a timestamp, whatever its type."""
    if isinstance(df.schema[column].dataType, _TIMES):
        return F.col(f"`{column}`").cast("timestamp_ntz")
    return parse_time(F.col(f"`{column}`").cast("string")).cast("timestamp_ntz")


def plain_columns(df: DataFrame) -> list[str]:
    """Columns that can be profiled: neither nested nor binary."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, _NESTED)]


def column_facts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: ``position``, ``column``, ``n``, ``missing``, ``nunique``, ``whole``
    (all values are whole numbers) and ``mean_length`` (of the text form)."""
    df = nan_to_null(df)
    branches = []
    for i, c in enumerate(columns or plain_columns(df)):
        kind, v = df.schema[c].dataType, F.col("v")
        whole = F.bool_and(v == F.floor(v)) if isinstance(kind, _FRACTIONS) else F.lit(isinstance(kind, _INTEGERS))
        length = F.try_divide(F.sum(F.length(v) * F.col("k")), F.sum(F.when(v.isNotNull(), F.col("k")))) if isinstance(kind, T.StringType) else F.lit(None).cast("double")
        branches.append(
            df.select(F.col(f"`{c}`").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("k")).agg(
                F.lit(i).alias("position"), F.lit(c).alias("column"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("n"),
                F.coalesce(F.sum(F.when(v.isNull(), F.col("k"))), F.lit(0)).cast("long").alias("missing"), F.count("v").alias("nunique"),
                F.coalesce(whole, F.lit(False)).alias("whole"), length.cast("double").alias("mean_length"),
            )
        )
    return reduce(DataFrame.unionByName, branches)


def level_of(kind: T.DataType, n: int, nunique: int, whole: bool, mean_length: float | None, dated: bool) -> Level:
    """The level of a column that no override settles."""
    numeric = isinstance(kind, (*_INTEGERS, *_FRACTIONS))
    if isinstance(kind, _NESTED):
        return Level.UNKNOWN
    if isinstance(kind, _TIMES) or dated:
        return Level.TEMPORAL
    if n > UNIQUE_ROWS and nunique > UNIQUE_SHARE * n:
        if not numeric:
            return Level.ID
        return Level.DISCRETE if whole else Level.CONTINUOUS
    if nunique == 2:
        return Level.BINARY
    if isinstance(kind, T.StringType):
        return Level.TEXT if (mean_length or 0) > LONG_TEXT else Level.NOMINAL
    if numeric and nunique == 0:
        return Level.UNKNOWN if isinstance(kind, _INTEGERS) else Level.CONTINUOUS
    if numeric and whole:
        return Level.AMBIGUOUS_INTEGER if nunique <= FEW_VALUES else Level.DISCRETE
    return Level.CONTINUOUS if isinstance(kind, _FRACTIONS) else Level.UNKNOWN


def classify(df: DataFrame, overrides: Mapping[str, str] | None = None, ambiguous: Level = Level.DISCRETE) -> dict[str, Level]:
    """The level of every column. One small row per column reaches the driver."""
    overrides = dict(overrides or {})
    for column, level in overrides.items():
        if column not in df.columns:
            raise ValueError(f"no such column: {column}")
        if level not in ASSIGNABLE:
            raise ValueError(f"no such level: {level}")
    open_columns = [c for c in plain_columns(df) if c not in overrides]
    facts = {r["column"]: r for r in column_facts(df, open_columns).collect()} if open_columns else {}
    found = {}
    for f in df.schema.fields:
        if f.name in overrides:
            found[f.name] = Level(overrides[f.name])
            continue
        r = facts.get(f.name)
        dated = isinstance(f.dataType, T.StringType) and r["nunique"] > 0 and _looks_dated(df, f.name)
        found[f.name] = level_of(f.dataType, r["n"], r["nunique"], r["whole"], r["mean_length"], dated) if r else Level.UNKNOWN
        if found[f.name] == Level.AMBIGUOUS_INTEGER:
            found[f.name] = ambiguous
    return found


def _looks_dated(df: DataFrame, column: str) -> bool:
    """Whether enough of the first values parse as dates; the sample is the feature."""
    sample = [r[0] for r in df.select(F.col(f"`{column}`").alias("v")).where("v IS NOT NULL").limit(DATE_SAMPLE).select(parse_time(F.col("v")).isNotNull()).collect()]
    return bool(sample) and sum(sample) >= DATE_SHARE * len(sample)


def of_level(levels: Mapping[str, Level], *wanted: Level) -> list[str]:
    """Columns of the wanted levels, in order."""
    return [c for c, level in levels.items() if level in wanted]


def with_levels(df: DataFrame, levels: Mapping[str, Level]) -> DataFrame:
    """The frame with each column's level in its metadata."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={**df.schema[c].metadata, "level": str(levels.get(c, Level.UNKNOWN))}) for c in df.columns])
