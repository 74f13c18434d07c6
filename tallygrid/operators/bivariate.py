"""Correlations, grouped statistics and cross-tabulations.

All Pearson correlations are aggregates of one pass, and so are Spearman's over ranks. Ranks come
from value histograms, so no window ever orders the data itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.stats import correlation_p_value
from tallygrid.operators.profile import long_form
from tallygrid.operators.quantiles import exact_quantiles
from tallygrid.operators.ranks import with_ranks
from tallygrid.session import nan_to_null


#: Pairs of columns in one pass.
PAIRS = 200


def kept_rows(df: DataFrame, columns: Sequence[str], deletion: str) -> DataFrame:
    """Missing as null; for listwise deletion only the rows in which all columns are known."""
    if deletion not in ("pairwise", "listwise"):
        raise ValueError("deletion is 'pairwise' or 'listwise'")
    df = nan_to_null(df)
    return df.dropna(subset=list(columns)) if deletion == "listwise" else df


def pearson(df: DataFrame, columns: Sequence[str], deletion: str = "pairwise", p_values: bool = True) -> DataFrame:
    """Pearson correlations (E8): ``col1``, ``col2``, ``r``, ``p_value``, ``N``; pairs with
    under 3 rows are left out, and r is null for a constant column."""
    df = kept_rows(df, columns, deletion)
    p = [F.round(correlation_p_value("r", "N"), 4).alias("p_value")] if p_values else []
    found, pairs = [], list(combinations(columns, 2))
    for at in range(0, len(pairs), PAIRS):  # an aggregate of thousands of columns is no use
        some = F.array(*[pair_row(a, b, *(F.col(f"`{c}`").cast("double") for c in (a, b))) for a, b in pairs[at:at + PAIRS]])
        found.append(df.agg(some.alias("pairs")).select(F.explode("pairs").alias("p")).select("p.*").where("N >= 3"))
    return reduce(DataFrame.unionByName, found).select("col1", "col2", F.round("r", 4).alias("r"), *p, "N")


def pair_row(a: str, b: str, x: Column, y: Column) -> Column:
    """``col1``, ``col2``, ``r`` and ``N`` of the rows in which both numbers are known."""
    both = x.isNotNull() & y.isNotNull()
    # Not ``corr``, which divides by zero where a column is constant.
    r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(F.when(both, x)) * F.stddev_samp(F.when(both, y)))
    return F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"), r.alias("r"), F.count_if(both).alias("N"))


def spearman(df: DataFrame, columns: Sequence[str], deletion: str = "pairwise", p_values: bool = True) -> DataFrame:
    """Spearman correlations (E9) over average ranks of each pair's complete rows. Every column is
    ranked once, and all pairs are aggregates of one pass over the ranks."""
    df = kept_rows(df, columns, deletion)
    # After listwise deletion all columns are known everywhere; pairs may each leave out other rows.
    ranked = with_ranks(df, columns, [[]] if deletion == "listwise" else [[c] for c in columns])
    place = {c: i for i, c in enumerate(columns)}

    def rank(c: str, other: str) -> Column:
        of = F.get(F.col(f"r{place[c]}"), F.lit(0 if deletion == "listwise" else place[other]))
        return F.when(F.col(f"`{other}`").isNotNull(), of)

    found, pairs = [], list(combinations(columns, 2))
    for at in range(0, len(pairs), PAIRS):
        some = F.array(*[pair_row(a, b, rank(a, b), rank(b, a)) for a, b in pairs[at:at + PAIRS]])
        found.append(ranked.agg(some.alias("pairs")).select(F.explode("pairs").alias("p")).select("p.*").where("N >= 3"))
    p = [F.round(correlation_p_value("r", "N"), 4).alias("p_value")] if p_values else []
    return reduce(DataFrame.unionByName, found).select("col1", "col2", F.round("r", 4).alias("rho"), *p, "N")


def grouped_stats(df: DataFrame, groups: Sequence[str], measures: Sequence[str], ordinal: Sequence[str] = ()) -> DataFrame:
    """Statistics of measures within the values of each group column (E10); rows with a null
    group are left out. Ordinal measures have their mean in ``M_quasi_interval``."""
    pairs = F.array(*[F.struct(F.lit(g).alias("group_col"), F.col(f"`{g}`").cast("string").alias("group_value")) for g in groups])
    columns = [*measures, *ordinal]
    keyed = nan_to_null(df).select(*[F.col(f"`{c}`") for c in columns], F.explode(pairs).alias("g")).where("g.group_value IS NOT NULL")
    values = long_form(keyed.select(*columns, "g.group_col", "g.group_value"), columns, ["group_col", "group_value"]).where("value IS NOT NULL")
    keys = ["group_col", "group_value", "variable"]
    moments = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("N"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    q = exact_quantiles(values, keys, "value", [0.25, 0.5, 0.75])
    is_ordinal = F.col("variable").isin(list(ordinal)) if ordinal else F.lit(False)
    return moments.join(q, keys).select(
        "group_col", "group_value", F.col("variable").alias("measure_col"), "N", F.when(~is_ordinal, F.round("m", 4)).alias("M"),
        F.when(is_ordinal, F.round("m", 4)).alias("M_quasi_interval"), F.round("sd", 4).alias("SD"), F.round(F.col("q")[1], 4).alias("Mdn"),
        F.round(F.col("q")[2] - F.col("q")[0], 4).alias("IQR"),
    )


def cross_tabulate_all(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Counts of pairs of columns with ``Total`` margins, in long form (E11): ``row_column``,
    ``column_column``, ``row``, ``column``, ``count``. One scan makes one histogram over pair and
    values, which combines before the shuffle; rows with a null on either side count nowhere.
    ``row_margin`` and ``column_margin`` tell a margin from a value ``Total``."""
    text = {c: F.col(f"`{c}`").cast("string") for pair in pairs for c in pair}
    each = F.array(*[F.struct(F.lit(i).alias("pair"), text[a].alias("row_value"), text[b].alias("column_value")) for i, (a, b) in enumerate(pairs)])
    both = df.select(F.explode(each).alias("p")).select("p.*").where("row_value IS NOT NULL AND column_value IS NOT NULL")
    cells = both.groupBy("pair", "row_value", "column_value").agg(F.count(F.lit(1)).alias("count"))
    margins = F.array(*[
        F.struct(F.when(F.lit(not r), F.col("row_value")).alias("r"), F.when(F.lit(not c), F.col("column_value")).alias("c"), F.lit(r).alias("row_margin"), F.lit(c).alias("column_margin"))
        for r in (False, True) for c in (False, True)])
    summed = cells.select("pair", "count", F.explode(margins).alias("m")).groupBy("pair", "m").agg(F.sum("count").alias("count"))
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    named = summed.withColumn("names", F.get(names, F.col("pair")))
    return named.select(
        F.col("names.a").alias("row_column"), F.col("names.b").alias("column_column"), F.when(F.col("m.row_margin"), "Total").otherwise(F.col("m.r")).alias("row"),
        F.when(F.col("m.column_margin"), "Total").otherwise(F.col("m.c")).alias("column"), "count", "m.row_margin", "m.column_margin")


def cross_tabulate(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of two columns with ``Total`` margins, in long form (E11), as in :func:`cross_tabulate_all`."""
    return cross_tabulate_all(df, [(row, column)]).drop("row_column", "column_column")


def contingency_table(df: DataFrame, row: str, column: str) -> DataFrame:
    """The same as a table with a column per value and the margin last; a value ``Total`` is
    named ``Total (value)``."""
    cells = cross_tabulate(df, row, column)
    for c in ("row", "column"):
        cells = cells.withColumn(c, F.when((F.col(c) == "Total") & ~F.col(f"{c}_margin"), "Total (value)").otherwise(F.col(c)))
    return cells.groupBy("row").pivot("column").agg(F.first("count")).na.fill(0)
