"""The exploratory profile of a table: one classification, then lazy result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame

from tallygrid.operators import bivariate, profile, text_tables, trends, univariate
from tallygrid.operators.levels import Level, classify, of_level
from tallygrid.session import nan_to_null


class Profiler:
    """Result tables of a DataFrame, by measurement level.

    ``overrides`` assigns levels, ``groups`` the grouping columns (default: all nominal ones),
    ``deletion`` how correlations treat missing values.
    """

    def __init__(
        self, df: DataFrame, overrides: Mapping[str, str] | None = None, groups: Sequence[str] | None = None,
        top_n: int = 10, deletion: str = "pairwise", stopwords: Sequence[str] = (),
    ):
        self.df, self.top_n, self.deletion, self.stopwords = nan_to_null(df), top_n, deletion, list(stopwords)
        self.levels = classify(df, overrides)
        self.groups = list(groups) if groups is not None else of_level(self.levels, Level.NOMINAL)

    def tables(self) -> dict[str, DataFrame]:
        """All tables that the columns' levels allow, in report order."""
        df, levels = self.df, self.levels
        discrete, continuous, ordinal, nominal, binary, text, temporal = (
            of_level(levels, x) for x in (Level.DISCRETE, Level.CONTINUOUS, Level.ORDINAL, Level.NOMINAL, Level.BINARY, Level.TEXT, Level.TEMPORAL))
        numeric = of_level(levels, Level.DISCRETE, Level.CONTINUOUS)
        out = {"01_dataset_profile": profile.dataset_profile(df, levels), "02_data_quality": profile.data_quality(df, levels)}
        if nominal:
            out["03_nominal_frequencies"] = univariate.nominal_frequencies(df, nominal, self.top_n)
        if binary:
            out["04_binary_summary"] = univariate.binary_summary(df, binary)
        if ordinal:
            out["05_ordinal_frequencies"] = univariate.ordinal_frequency(df, ordinal)
            out["06_ordinal_descriptives"] = univariate.describe(df, ordinal, "ordinal")
        if discrete:
            out["07_discrete_descriptives"] = univariate.describe(df, discrete, "discrete")
        if continuous:
            out["08_continuous_descriptives"] = univariate.describe(df, continuous, "continuous")
        if len(numeric) > 1:
            out["09_pearson"] = bivariate.pearson(df, numeric, self.deletion)
        if len(ordinal) > 1:
            out["10_spearman"] = bivariate.spearman(df, ordinal, self.deletion)
        if self.groups and (numeric or ordinal):
            out["11_grouped_stats"] = bivariate.grouped_stats(df, self.groups, numeric, ordinal)
        if pairs := list(combinations(of_level(levels, Level.NOMINAL, Level.BINARY), 2)):
            out["12_crosstabs"] = bivariate.cross_tabulate_all(df, pairs)
        if text:
            out["13_text_analysis"] = text_tables.text_analysis(df, text, self.top_n, self.stopwords)
        if temporal:
            out["14_temporal_trends"] = trends.temporal_trends(df, temporal[0], numeric)
        return out
