"""Profiler rules on hand-made frames, with pandas as an independent result."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallygrid.functions import stats
from tallygrid.operators import bivariate, profile, text_tables, trends, univariate
from tallygrid.operators.levels import Level, classify, level_of, with_levels
from tallygrid.operators.quantiles import exact_quantiles
from tallygrid.plans.profiler import Profiler


@pytest.fixture(scope="module")
def survey(spark):
    rows = []
    for i in range(40):
        rows.append((
            f"r{i:03d}", None if i == 3 else "abc"[i % 3], None if i % 9 == 0 else ("x", "y")[i % 2], None if i % 8 == 0 else 1 + i * 7 % 5,
            None if i % 6 == 0 else 1 + i * 3 % 5, (i * 37 % 11) ** 3, None if i == 1 else float("nan") if i % 5 == 0 else i * 0.37, float(i % 4 + i),
            7, 1.5 if i == 4 else None, None, f"2024-{1 + i % 12:02d}-03" if i % 10 else "soon", "long words " * 6 + str(i % 7),
        ))
    return spark.createDataFrame(rows, "record_id string, platform string, tier string, rating int, satisfaction int, views long, duration double, whole_dbl double, const int, one_valid double, all_null double, posted string, description string")


def test_levels(survey):
    found = classify(survey, {"rating": "ordinal", "satisfaction": "ordinal"})
    assert found["record_id"] == Level.ID and found["platform"] == Level.NOMINAL and found["tier"] == Level.BINARY
    assert found["rating"] == Level.ORDINAL and found["duration"] == Level.CONTINUOUS and found["posted"] == Level.TEMPORAL
    assert found["description"] == Level.TEXT and found["const"] == Level.DISCRETE and found["whole_dbl"] == Level.DISCRETE
    assert with_levels(survey, found).schema["tier"].metadata["level"] == "binary"
    assert classify(survey.limit(10))["record_id"] == Level.NOMINAL  # too few rows for an id
    with pytest.raises(ValueError):
        classify(survey, {"rating": "unknown"})
    with pytest.raises(ValueError):
        classify(survey, {"nothing": "id"})


def test_nested_columns_are_unknown(spark):
    df = spark.createDataFrame([([1.0], 1)], "v array<double>, k int")
    assert classify(df)["v"] == Level.UNKNOWN
    assert level_of(df.schema["k"].dataType, 1, 1, True, None, False) == Level.AMBIGUOUS_INTEGER


def test_profile_and_quality(spark, survey):
    doubled = survey.union(survey.limit(2))
    levels = classify(doubled)
    rows = {r["column"]: r for r in profile.dataset_profile(doubled, levels).collect()}
    pdf = doubled.toPandas()
    for c, r in rows.items():
        assert (r["n_rows"], r["nunique"], r["missing_count"]) == (42, pdf[c].nunique(), int(pdf[c].isna().sum())), c
    assert profile.duplicate_rows(doubled).first()[0] == 2
    quality = {r["column"]: r for r in profile.data_quality(doubled, levels).collect()}
    assert quality["const"]["is_constant"] and quality["all_null"]["is_constant"] and not quality["tier"]["is_constant"]
    v = pdf["views"]
    q1, q3 = v.quantile(0.25), v.quantile(0.75)
    assert quality["views"]["mild_outliers"] == int(((v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))).sum())


def test_describe_matches_pandas(survey):
    pdf = survey.toPandas()
    for r in univariate.describe(survey, ["views", "duration", "whole_dbl", "const", "one_valid", "all_null"], "continuous").collect():
        v = pdf[r["variable"]].dropna().astype(float)
        assert r["N_valid"] == len(v) and r["missing_count"] == 40 - len(v)
        if len(v) == 0:
            assert r["M"] is None and r["note"] is None
        elif len(v) == 1:
            assert r["M"] == 1.5 and r["SD"] is None and r["note"]
        else:
            for name, want in (("M", v.mean()), ("Mdn", v.median()), ("Mode", v.mode().iloc[0]), ("SD", v.std()), ("Skewness", v.skew()), ("Kurtosis", v.kurt()), ("P10", v.quantile(0.1)), ("IQR", v.quantile(0.75) - v.quantile(0.25))):
                assert r[name] == pytest.approx(want, abs=1e-3), (r["variable"], name)
    ordinal = univariate.describe(survey, ["rating"], "ordinal")
    assert "M_quasi_interval" in ordinal.columns and "P10" not in ordinal.columns


def test_frequencies(survey):
    rows = univariate.nominal_frequencies(survey, ["platform"], 2).collect()
    assert len(rows) == 2 and rows[0]["count"] == 13
    assert sum(r["proportion"] for r in univariate.binary_summary(survey, ["tier"]).collect()) == pytest.approx(1, abs=1e-3)
    ordered = sorted(univariate.ordinal_frequency(survey, ["rating"]).collect(), key=lambda r: r["value"])
    assert ordered[-1]["cumulative_pct"] == 100


def test_correlations(survey):
    pdf = survey.toPandas()
    for deletion in ("pairwise", "listwise"):
        columns = ["rating", "satisfaction"]
        both = pdf[columns].dropna()
        r = bivariate.spearman(survey, columns, deletion).first()
        assert r["N"] == len(both) and r["rho"] == pytest.approx(both["rating"].rank().corr(both["satisfaction"].rank()), abs=1e-4)
    found = {(r["col1"], r["col2"]): r for r in bivariate.pearson(survey, ["views", "duration", "const", "one_valid"]).collect()}
    both = pdf[["views", "duration"]].dropna()
    assert found["views", "duration"]["r"] == pytest.approx(both["views"].corr(both["duration"]), abs=1e-4)
    assert found["views", "const"]["r"] is None and ("views", "one_valid") not in found


def test_ranks_of_many_columns(spark):
    """All pairs of columns with missing values in different rows, against ranks by pandas."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({c: np.where(rng.random(400) < 0.15, np.nan, rng.integers(0, high, 400)) for c, high in (("a", 4), ("b", 300), ("c c", 12), ("d", 2))})
    pdf["whole"] = rng.integers(0, 9, 400).astype(float)
    df = spark.createDataFrame(pdf).repartition(3)
    for deletion in ("pairwise", "listwise"):
        found = {(r["col1"], r["col2"]): (r["rho"], r["N"]) for r in bivariate.spearman(df, list(pdf.columns), deletion, p_values=False).collect()}
        assert len(found) == 10
        for (a, b), (rho, n) in found.items():
            both = (pdf if deletion == "listwise" else pdf[[a, b]]).dropna()
            assert n == len(both) and rho == pytest.approx(both[a].rank().corr(both[b].rank()), abs=1e-4)
    assert bivariate.spearman(df.where("false"), ["a", "b"]).count() == 0


def test_all_cross_tables_in_one_scan(survey):
    pairs = [("platform", "tier"), ("platform", "rating"), ("tier", "rating")]
    every = bivariate.cross_tabulate_all(survey, pairs)
    for a, b in pairs:
        one = every.where((F.col("row_column") == a) & (F.col("column_column") == b)).drop("row_column", "column_column")
        assert sorted(map(str, one.collect())) == sorted(map(str, bivariate.cross_tabulate(survey, a, b).collect()))
    crossed = pd.crosstab(survey.toPandas()["platform"], survey.toPandas()["tier"], margins=True, margins_name="Total")
    assert {(r["row"], r["column"]): r["count"] for r in every.where("row_column = 'platform' AND column_column = 'tier'").collect()} == {(i, c): n for i, row in crossed.iterrows() for c, n in row.items() if n}
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 + plan.count("AdaptiveSparkPlan") * 2


def test_p_values():
    assert stats.correlation_p(0.632, 10) == pytest.approx(0.05, abs=1e-3)
    assert stats.correlation_p(0.765, 10) == pytest.approx(0.01, abs=1e-3)
    assert stats.correlation_p(0.0, 10) == pytest.approx(1) and stats.correlation_p(-1.0, 5) == 0 and stats.correlation_p(None, 9) is None


def test_crosstab_margins(survey):
    cells = {(r["row"], r["column"]): r["count"] for r in bivariate.cross_tabulate(survey, "platform", "tier").collect()}
    inner = sum(v for (a, b), v in cells.items() if "Total" not in (a, b))
    assert inner == cells["Total", "Total"] == len(survey.toPandas()[["platform", "tier"]].dropna())
    assert bivariate.contingency_table(survey, "platform", "tier").where("row = 'Total'").first()["Total"] == inner


def test_grouped_and_trends(survey):
    rows = {(r["group_value"], r["measure_col"]): r for r in bivariate.grouped_stats(survey, ["platform"], ["views"], ["rating"]).collect()}
    pdf = survey.toPandas()
    assert rows["a", "views"]["M"] == pytest.approx(pdf[pdf.platform == "a"].views.mean(), abs=1e-4) and rows["a", "views"]["M_quasi_interval"] is None
    assert rows["b", "rating"]["M"] is None and rows["b", "rating"]["Mdn"] == pdf[pdf.platform == "b"].rating.median()
    months = trends.temporal_trends(survey, "posted", ["views"]).collect()
    assert sum(r["count"] for r in months) == 36 and all(r["views_median"] is not None for r in months)


def test_text(spark):
    df = spark.createDataFrame([("The cat, the Cat sat.",), ("a dog",), (None,), ("",)], "t string")
    s = text_tables.text_summary(df, "t", ["the"]).first()
    assert (s["total_docs"], s["vocab_size"]) == (3, 3)
    assert [tuple(r) for r in text_tables.top_ngrams(df, "t", 1, 2, ["the"]).collect()] == [("cat", 2), ("dog", 1)]
    assert {r["item"] for r in text_tables.ngram_counts(df, "t", 2, ["the"]).collect()} == {"cat cat", "cat sat"}
    assert {r["type"] for r in text_tables.text_analysis(df, ["t"]).collect()} == {"summary", "unigram", "bigram"}


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_bracketed_quantiles(spark, keys):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.hash("id") % 977).cast("double").alias("v")).union(spark.createDataFrame([(0, 5.0)] * 600, "g long, v double"))
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    direct = {tuple(r[k] for k in keys): r["q"] for r in exact_quantiles(df, keys, "v", probs).collect()}
    narrow = {tuple(r[k] for k in keys): r["q"] for r in exact_quantiles(df, keys, "v", probs, direct_rows=40).collect()}
    assert direct.keys() == narrow.keys()
    for k, q in direct.items():
        assert q == pytest.approx(narrow[k])


def test_tables_are_lazy_and_complete(survey):
    tables = Profiler(survey, {"rating": "ordinal", "satisfaction": "ordinal"}).tables()
    assert list(tables) == sorted(tables) and {n[:2] for n in tables} == {f"{i:02d}" for i in range(1, 15)}
    for name, t in tables.items():
        assert len(t.limit(3).collect()) > 0, name


def test_flags(survey):
    levels = classify(survey)
    flags = profile.attention_flags(profile.dataset_profile(survey, levels), univariate.describe(survey, ["views"], "discrete"), bivariate.pearson(survey, ["duration", "whole_dbl"]))
    assert ("all_null", "missing over 20 %") in {(r["subject"], r["flag"]) for r in flags.collect()}


def test_empty_table(survey):
    none = survey.where("false")
    levels = classify(none)
    assert {r["n_rows"] for r in profile.dataset_profile(none, levels).collect()} == {0}
    assert profile.duplicate_rows(none).first()[0] == 0
    assert pd.notna(math.pi)
