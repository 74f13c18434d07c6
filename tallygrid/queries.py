"""Registered queries of the profiler, topic, checkpoint and batch operators, and their SQL.

Every query reads whole tables. Topics and codes for the topic queries are derived from ``part``
(a topic per part size, sizes above 45 are outliers), so they grow with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid import queries_large, queries_more, queries_sources
from tallygrid.functions import jsons, text
from tallygrid.operators import batches, bivariate, checkpoints, greedy_batches, levels, profile, text_tables, topics, trends, univariate
from tallygrid.operators.levels import Level

#: Stop words of the text queries, the same on both sides.
STOPWORDS = ("the", "of", "and", "to", "in", "is", "it", "that", "de", "la", "les", "der", "die", "und", "que")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDERS_LEVELS = {"o_orderkey": Level.DISCRETE, "o_custkey": Level.DISCRETE, "o_orderstatus": Level.NOMINAL, "o_totalprice": Level.CONTINUOUS, "o_orderdate": Level.TEMPORAL, "o_orderpriority": Level.NOMINAL}
LINE_LEVELS = {"l_linenumber": Level.DISCRETE, "l_quantity": Level.DISCRETE, "l_discount": Level.CONTINUOUS, "l_tax": Level.CONTINUOUS, "l_returnflag": Level.NOMINAL, "l_linestatus": Level.BINARY}


def eda_grouped_event_type(spark, d):
    return bivariate.grouped_stats(table(spark, d, "events"), ["event_type"], ["value"]).drop("M_quasi_interval")


def eda_profile_orders(spark, d):
    return profile.dataset_profile(table(spark, d, "orders"), ORDERS_LEVELS).drop("dtype")


def eda_levels(spark, d):
    """Levels of the columns of several tables, as rows."""
    rows = [(t, c, str(level)) for t in ("orders", "lineitem", "events", "customer", "conversations") for c, level in levels.classify(table(spark, d, t)).items()]
    return spark.createDataFrame(rows, "table_name string, column string, level string")


def eda_quality_lineitem(spark, d):
    return profile.data_quality(table(spark, d, "lineitem").select(*LINE_LEVELS), LINE_LEVELS)


def eda_duplicates(spark, d):
    return profile.duplicate_rows(table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity"))


def eda_desc_continuous(spark, d):
    return univariate.describe(table(spark, d, "lineitem"), ["l_discount", "l_tax"], "continuous").drop("note", "Skewness", "Kurtosis")


def eda_desc_shape(spark, d):
    return univariate.describe(table(spark, d, "lineitem"), ["l_discount", "l_tax", "l_quantity"], "continuous").select("variable", F.round("Skewness", 3).alias("Skewness"), F.round("Kurtosis", 3).alias("Kurtosis"))


def eda_desc_discrete(spark, d):
    return univariate.describe(table(spark, d, "lineitem"), ["l_quantity", "l_linenumber"], "discrete").drop("note", "Skewness", "Kurtosis")


def eda_desc_ordinal(spark, d):
    return univariate.describe(table(spark, d, "lineitem"), ["l_linenumber"], "ordinal").drop("note", "Skewness", "Kurtosis")


def eda_nominal_freq(spark, d):
    return univariate.nominal_frequencies(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


def eda_binary(spark, d):
    return univariate.binary_summary(table(spark, d, "labels"), ["quality", "toxic"])


def eda_ordinal_dist(spark, d):
    return univariate.ordinal_frequency(table(spark, d, "lineitem"), ["l_linenumber"])


def eda_pearson(spark, d):
    return bivariate.pearson(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], p_values=False)


def eda_pearson_listwise(spark, d):
    return bivariate.pearson(table(spark, d, "lineitem").withColumn("l_tax", F.nullif("l_tax", F.lit(0.0))), ["l_quantity", "l_discount", "l_tax"], "listwise", False)


def eda_pearson_p(spark, d):
    return bivariate.pearson(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])


def eda_spearman(spark, d):
    return bivariate.spearman(table(spark, d, "lineitem"), ["l_linenumber", "l_quantity", "l_discount"], p_values=False)


def eda_crosstab(spark, d):
    return bivariate.cross_tabulate(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


def eda_trend_monthly(spark, d):
    return trends.temporal_trends(table(spark, d, "events"), "ts", ["value"])


def eda_text_summary(spark, d):
    return text_tables.text_summary(table(spark, d, "documents"), "text", STOPWORDS)


def eda_text_unigrams(spark, d):
    return text_tables.top_ngrams(table(spark, d, "documents"), "text", 1, 10, STOPWORDS)


def eda_text_bigrams(spark, d):
    return text_tables.top_ngrams(table(spark, d, "documents"), "text", 2, 10, STOPWORDS)


def eda_type_counts(spark, d):
    return profile.type_counts(levels.classify(table(spark, d, "lineitem")), spark)


FLAG_LEVELS = {"c_name": Level.ID, "part_known": Level.CONTINUOUS, "steep": Level.CONTINUOUS, "c_acctbal": Level.CONTINUOUS}


def eda_flags(spark, d):
    """Customers with a column that is often missing and one that is steep."""
    t = table(spark, d, "customer").select("c_name", F.when(F.col("c_acctbal") > 3000, F.col("c_acctbal")).alias("part_known"), F.exp(F.col("c_acctbal") / 1000).alias("steep"), "c_acctbal")
    found = profile.attention_flags(
        profile.dataset_profile(t, FLAG_LEVELS), univariate.describe(t, ["part_known", "steep", "c_acctbal"], "continuous"), bivariate.pearson(t, ["part_known", "steep", "c_acctbal"], p_values=False))
    return found.withColumn("value", F.round("value", 2))


def topic_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with topics, topic counts, and codes that overlap and leave topics out."""
    docs = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 45, topics.OUTLIER).otherwise(F.col("p_size")).alias("Topic"))
    counts = docs.groupBy("Topic").agg(F.count(F.lit(1)).alias("Count"))
    size = F.col("Topic")
    code = F.explode(F.array_compact(F.array(F.when(size % 9 != 0, F.format_string("C%02d", size % 7)), F.when(size % 5 == 0, F.lit("X5")))))
    pairs = counts.where(size != topics.OUTLIER).select(size.alias("t"), code.alias("code"))
    theme = F.when(F.col("code") == "X5", "Game-Specific").otherwise(F.concat(F.lit("Theme"), (F.substring("code", 2, 2).cast("int") % 3).cast("string"), F.lit("-"), F.col("code")))
    codes = pairs.groupBy("code").agg(F.collect_set("t").alias("sources")).select("code", F.concat(F.lit("Label "), "code").alias("label"), theme.alias("theme"), "sources")
    return docs, counts, codes


def topic_label_docs(spark, d):
    docs, _, codes = topic_tables(spark, d)
    return topics.label_documents(docs, codes)


def topic_totals(spark, d):
    _, counts, codes = topic_tables(spark, d)
    return topics.code_totals(counts, codes)


def topic_overlap(spark, d):
    _, counts, codes = topic_tables(spark, d)
    return topics.overlap(counts, codes)


def topic_unassigned(spark, d):
    _, counts, codes = topic_tables(spark, d)
    return topics.unassigned(counts, codes)


def topic_reconcile(spark, d):
    _, counts, codes = topic_tables(spark, d)
    return topics.reconciliation(counts, codes)


def topic_plan(spark, d):
    """The consolidation plan as lines."""
    _, counts, codes = topic_tables(spark, d)
    return topics.plan_lines(counts, codes).where("section IN (1, 3, 5)").select("section", "line")


def topic_theme_counts(spark, d):
    docs, _, codes = topic_tables(spark, d)
    return topics.theme_counts(topics.label_documents(docs, codes))


def checkpoint_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders as checkpoint rows: a subject per status, some failed, some with retries."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("subject"), F.concat(F.lit("media\\"), k.cast("string"), F.lit(".jpg")).alias("file_path"),
        F.when(k % 10 == 0, "").otherwise(F.col("o_orderpriority")).alias("label"), (k % 100).cast("string").alias("quality_score"),
        (k % 7 != 0).alias("model_ok"), F.when(k % 7 == 0, (k % 5).cast("int")).alias("retry_count"),
    )


def ckpt_keep_last(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    return checkpoints.keep_last(lines, ["l_orderkey"], [F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")])


def ckpt_pending_anti(spark, d):
    return checkpoints.pending(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def ckpt_retry_merge(spark, d):
    rows = checkpoint_rows(spark, d)
    again = checkpoints.retryable(rows).select("file_path", F.lit("again").alias("label"), (F.length("file_path") % 2 == 0).alias("model_ok"))
    return checkpoints.apply_retries(rows, again, "file_path", ["label"])


def ckpt_coverage(spark, d):
    rows = checkpoint_rows(spark, d)
    return checkpoints.coverage(rows, rows.where("model_ok"), "subject", "file_path", 0.5)


def ckpt_review(spark, d):
    found = checkpoints.review(checkpoint_rows(spark, d), ["label"])
    return found.withColumn("issues", F.array_join("issues", "; "))


def ckpt_field_coverage(spark, d):
    return checkpoints.field_coverage(checkpoint_rows(spark, d), ["label", "quality_score", "retry_count"])


def ckpt_scores(spark, d):
    return checkpoints.score_distribution(checkpoint_rows(spark, d))


def ckpt_retry_summary(spark, d):
    return checkpoints.retry_summary(checkpoint_rows(spark, d))


def ckpt_subjects(spark, d):
    """Subjects, keys and file types of paths made from page addresses."""
    pages = table(spark, d, "pages").select("page_id", F.split_part("url", F.lit("?"), F.lit(1)).alias("file_path"))
    return pages.select("page_id", text.derive_subject(F.col("file_path")).alias("subject"), text.has_extension(F.col("file_path"), [".jpg", ".com"]).alias("media"))


def json_parse_fallback(spark, d):
    """Event properties behind prose, read back by the first-object rule."""
    said = table(spark, d, "events").select("event_id", F.concat(F.lit("Here {you are: "), "props", F.lit(" - done")).alias("t"))
    return said.select("event_id", jsons.field(jsons.response_fields("t"), "k").alias("k"))


def json_greedy(spark, d):
    said = table(spark, d, "events").select("event_id", F.concat(F.lit("answer: "), "props").alias("t"))
    return said.select("event_id", F.try_variant_get(jsons.greedy_json(F.col("t")), "$.k", "bigint").alias("k"))


def jsonl_build(spark, d):
    rows = checkpoint_rows(spark, d)
    uris = rows.where(~F.col("model_ok")).select("subject", F.col("file_path").alias("path"), F.concat(F.lit("u:"), "file_path").alias("uri"))
    built = batches.requests(rows, uris, "file_path", "Describe it.", [("Label", "label")])
    return built.select("key", F.get_json_object("line", "$.request.contents[0].parts[0].file_data.file_uri").alias("uri"), F.get_json_object("line", "$.request.contents[0].parts[1].text").alias("block"))


def results_join(spark, d):
    rows = checkpoint_rows(spark, d).select("subject", "file_path")
    results = checkpoint_rows(spark, d).where("model_ok").select(F.replace("file_path", F.lit("\\"), F.lit("/")).alias("path"), F.create_map(F.lit("label"), "label").alias("fields"))
    return checkpoints.join_results(rows, results, "file_path", ["label", "tone"])


def document_bytes(spark: SparkSession, d: str) -> DataFrame:
    return batches.bytes_per_subject(table(spark, d, "documents").select(F.concat("source", F.lit("/"), "lang").alias("subject"), F.col("n_chars").alias("length")))


def batch_bytes(spark, d):
    return document_bytes(spark, d)


def batch_quota_prefix(spark, d):
    return batches.quota_prefix(document_bytes(spark, d), 2_000_000)


def batch_split_bytes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return greedy_batches.split_by_size(docs, "source", "n_chars", 20_000, ["doc_id"])


def batch_bin_pack(spark, d):
    return batches.spread_over_keys(document_bytes(spark, d), 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        eda_grouped_event_type, eda_profile_orders, eda_levels, eda_quality_lineitem, eda_duplicates, eda_desc_continuous, eda_desc_shape,
        eda_desc_discrete, eda_desc_ordinal, eda_nominal_freq, eda_binary, eda_ordinal_dist, eda_pearson, eda_pearson_listwise, eda_pearson_p,
        eda_spearman, eda_crosstab, eda_trend_monthly, eda_text_summary, eda_text_unigrams, eda_text_bigrams, eda_type_counts, eda_flags,
        topic_label_docs, topic_totals, topic_overlap, topic_unassigned, topic_reconcile, topic_plan, topic_theme_counts,
        ckpt_keep_last, ckpt_pending_anti, ckpt_retry_merge, ckpt_coverage, ckpt_review, ckpt_field_coverage, ckpt_scores, ckpt_retry_summary, ckpt_subjects,
        json_parse_fallback, json_greedy, jsonl_build, results_join, batch_bytes, batch_quota_prefix, batch_split_bytes, batch_bin_pack,
    )
    return {f.__name__: f for f in made} | queries_more.queries() | queries_large.queries() | queries_sources.queries()


def unpivoted(tbl: str, columns: list[str], cast: str = "DOUBLE") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS {cast}) AS value FROM {tbl}" for c in columns)


def describe_sql(tbl: str, columns: list[str], level: str) -> str:
    """Descriptives of numeric columns without shape."""
    outer = "" if level == "ordinal" else ", round(quantile_cont(value, 0.1), 4) AS P10, round(quantile_cont(value, 0.9), 4) AS P90"
    mean = "M_quasi_interval" if level == "ordinal" else "M"
    return f"""
WITH v AS ({unpivoted(tbl, columns)}),
q AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY variable),
o AS (SELECT v.variable, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS mild_outliers,
      count(*) FILTER (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)) AS extreme_outliers FROM v JOIN q USING (variable) GROUP BY v.variable),
m AS (SELECT variable, value AS mode FROM (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY count(*) DESC, value) AS r FROM v GROUP BY variable, value) WHERE r = 1),
s AS (SELECT variable, count(value) AS "N_valid", count(*) - count(value) AS missing_count, round((count(*) - count(value)) * 100.0 / count(*), 2)::DOUBLE AS missing_pct,
      round(avg(value), 4) AS {mean}, round(median(value), 4) AS "Mdn", round(stddev_samp(value), 4) AS "SD", round(var_samp(value), 4) AS "Variance",
      round(max(value) - min(value), 4) AS "Range", round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS "IQR",
      round(stddev_samp(value) / avg(value) * 100, 2) AS "CV_pct", min(value) AS "Min", round(quantile_cont(value, 0.25), 4) AS "Q1_25th",
      round(quantile_cont(value, 0.75), 4) AS "Q3_75th", max(value) AS "Max", round(stddev_samp(value) / sqrt(count(value)), 4) AS "SE",
      round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)), 4) AS "CI95_lower", round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value)), 4) AS "CI95_upper"{outer}
      FROM v GROUP BY variable)
SELECT s.*, '{level}' AS level, mode AS "Mode", mild_outliers, extreme_outliers FROM s JOIN o USING (variable) JOIN m USING (variable)
"""


def pearson_sql(source: str, columns: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    return " UNION ALL ".join(f"SELECT '{a}' AS col1, '{b}' AS col2, round(corr({a}, {b}), 4) AS r, count(*) AS \"N\" FROM {source}" for a, b in pairs)


def spearman_sql(tbl: str, columns: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
    return " UNION ALL ".join(f"SELECT '{a}' AS col1, '{b}' AS col2, round(corr(x, y), 4) AS rho, count(*) AS \"N\" FROM (SELECT {rank.format(a)} AS x, {rank.format(b)} AS y FROM {tbl})" for a, b in pairs)


#: Columns by kind of the tables whose levels are asked for.
LEVEL_COLUMNS = {
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "double", "o_orderdate": "time", "o_orderpriority": "text"},
    "lineitem": {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
                 "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time"},
    "events": {"event_id": "int", "ts": "time", "user_id": "int", "event_type": "text", "value": "double", "props": "text"},
    "customer": {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "text"},
    "conversations": {"conv_id": "int", "turn": "int", "role": "text", "text": "text"},
}


def level_sql(tbl: str, column: str, kind: str) -> str:
    unique = f"count(*) > 10 AND count(DISTINCT {column}) > 0.95 * count(*)"
    rule = {
        "time": "max('temporal')",
        "int": f"CASE WHEN {unique} THEN 'discrete' WHEN count(DISTINCT {column}) = 2 THEN 'binary' WHEN count({column}) = 0 THEN 'unknown' ELSE 'discrete' END",
        "double": f"CASE WHEN NOT ({unique}) AND count(DISTINCT {column}) = 2 THEN 'binary' WHEN bool_and({column} = floor({column})) THEN 'discrete' ELSE 'continuous' END",
        "text": f"CASE WHEN {unique} THEN 'id' WHEN count(DISTINCT {column}) = 2 THEN 'binary' WHEN avg(length({column})) > 50 THEN 'text' ELSE 'nominal' END",
    }[kind]
    return f"SELECT '{tbl}' AS table_name, '{column}' AS column, {rule} AS level FROM {tbl}"


FLAGS_SQL = """
WITH t AS (SELECT c_name, CASE WHEN c_acctbal > 3000 THEN c_acctbal END AS part_known, exp(c_acctbal / 1000) AS steep, c_acctbal FROM customer),
v AS (SELECT 'part_known' AS subject, part_known AS x FROM t UNION ALL SELECT 'steep', steep FROM t UNION ALL SELECT 'c_acctbal', c_acctbal FROM t),
s AS (SELECT subject, round(skewness(x), 4) AS sk, round(kurtosis(x), 4) AS ku, round(stddev_samp(x) / avg(x) * 100, 2) AS cv, round((count(*) - count(x)) * 100.0 / count(*), 2)::DOUBLE AS missing FROM v GROUP BY subject),
r AS (SELECT 'part_known ~ steep' AS subject, round(corr(part_known, steep), 4) AS r FROM t UNION ALL SELECT 'part_known ~ c_acctbal', round(corr(part_known, c_acctbal), 4) FROM t UNION ALL SELECT 'steep ~ c_acctbal', round(corr(steep, c_acctbal), 4) FROM t),
f AS (SELECT subject, 'missing over 20 %' AS flag, missing AS value FROM s WHERE missing > 20
  UNION ALL SELECT 'c_name', 'unique like an id', count(DISTINCT c_name)::DOUBLE FROM t HAVING count(DISTINCT c_name) > 0.95 * count(*)
  UNION ALL SELECT subject, 'skewness over 2', sk FROM s WHERE abs(sk) > 2 UNION ALL SELECT subject, 'kurtosis over 7', ku FROM s WHERE abs(ku) > 7
  UNION ALL SELECT subject, 'variation over 100 %', cv FROM s WHERE abs(cv) > 100 UNION ALL SELECT subject, 'correlation over .7', r FROM r WHERE abs(r) > 0.7)
SELECT subject, flag, round(value, 2) AS value FROM f
"""
#: Student's t as a normal z (error of the order of 1 / rows squared); the tail is Zelen and Severo's approximation.
P_VALUE_SQL = """
WITH p AS ({pairs}), s AS (SELECT *, abs(r) * sqrt(("N" - 2) / (1 - r * r)) AS t FROM p),
t AS (SELECT *, t * (1 - 0.25 / ("N" - 2)) / sqrt(1 + t * t / 2 / ("N" - 2)) AS z FROM s), k AS (SELECT *, 1 / (1 + 0.2316419 * z) AS k FROM t)
SELECT col1, col2, round(r, 4) AS r, "N", round(2 * exp(-z * z / 2) * 0.3989422804014327 * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))), 4) AS p_value FROM k
"""
STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS)
WORDS_SQL = f"""list_filter(list_transform(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]+')), lambda x: lower(x)),
      lambda x: length(x) > 1 AND x NOT IN ({STOP_SQL}))"""
TOPICS_SQL = """
d AS (SELECT p_partkey, CASE WHEN p_size > 45 THEN -1 ELSE p_size END AS "Topic" FROM part),
t AS (SELECT "Topic", count(*) AS "Count" FROM d GROUP BY "Topic"),
a AS (SELECT "Topic" AS topic_id, 'C0' || ("Topic" % 7) AS code, "Count" FROM t WHERE "Topic" <> -1 AND "Topic" % 9 <> 0
      UNION ALL SELECT "Topic", 'X5', "Count" FROM t WHERE "Topic" <> -1 AND "Topic" % 5 = 0),
n AS (SELECT *, 'Label ' || code AS label, CASE WHEN code = 'X5' THEN 'Game-Specific' ELSE 'Theme' || (CAST(substr(code, 2, 2) AS INT) % 3) || '-' || code END AS theme FROM a)"""
CKPT_SQL = r"""
c AS (SELECT o_orderstatus AS subject, 'media\' || o_orderkey || '.jpg' AS file_path, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE o_orderpriority END AS label,
      CAST(o_orderkey % 100 AS VARCHAR) AS quality_score, o_orderkey % 7 <> 0 AS model_ok, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 5 AS INT) END AS retry_count FROM orders)"""
BYTES_SQL = "b AS (SELECT source || '/' || lang AS subject, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) AS files FROM documents GROUP BY 1)"


def oracle_sql() -> dict[str, str]:
    profile_rows = " UNION ALL ".join(
        f"SELECT count(*) AS n_rows, 6 AS n_cols, '{c}' AS \"column\", '{level}' AS detected_type, count(DISTINCT {c}) AS nunique, count(*) - count({c}) AS missing_count, 0.0::DOUBLE AS missing_pct FROM orders"
        for c, level in ORDERS_LEVELS.items())
    quality_rows = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{level}' AS type, count(*) - count({c}) AS missing_count, 0.0::DOUBLE AS missing_pct,
        (SELECT CAST(sum(k - 1) AS BIGINT) FROM (SELECT count(*) AS k FROM lineitem GROUP BY {', '.join(LINE_LEVELS)})) AS duplicate_rows, count(DISTINCT {c}) <= 1 AS is_constant, """ + (
            f"(SELECT count(*) FROM lineitem, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b FROM lineitem) WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS mild_outliers, "
            f"(SELECT count(*) FROM lineitem, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b FROM lineitem) WHERE {c} < a - 3 * (b - a) OR {c} > b + 3 * (b - a)) AS extreme_outliers"
            if level in (Level.CONTINUOUS, Level.DISCRETE) else "NULL::BIGINT AS mild_outliers, NULL::BIGINT AS extreme_outliers") + " FROM lineitem"
        for c, level in LINE_LEVELS.items())
    return queries_more.oracle_sql() | queries_large.oracle_sql() | queries_sources.oracle_sql() | {
        "eda_levels": " UNION ALL ".join(level_sql(t, c, kind) for t, columns in LEVEL_COLUMNS.items() for c, kind in columns.items()),
        "eda_type_counts": f"SELECT level AS detected_type, count(*) AS n_columns FROM ({' UNION ALL '.join(level_sql('lineitem', c, kind) for c, kind in LEVEL_COLUMNS['lineitem'].items())}) GROUP BY level",
        "eda_flags": FLAGS_SQL,
        "eda_pearson_p": P_VALUE_SQL.format(pairs=pearson_sql("lineitem", ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]).replace("round(corr", "(corr").replace(", 4) AS r", ") AS r")),
        "batch_bin_pack": f"""WITH RECURSIVE {BYTES_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, subject) AS i FROM b),
            w AS (SELECT CAST(0 AS BIGINT) AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, '' AS subject, CAST(0 AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS files, CAST(-1 AS BIGINT) AS key_id UNION ALL
            SELECT o.i, list_transform(range(5), lambda k: loads[k + 1] + CASE WHEN k = best THEN o.bytes ELSE 0 END), o.subject, o.bytes, o.files, best
            FROM (SELECT *, CAST(list_position(loads, list_min(loads)) - 1 AS BIGINT) AS best FROM w) AS x JOIN o ON o.i = x.i + 1)
            SELECT subject, bytes, files, key_id FROM w WHERE i > 0""",
        "eda_grouped_event_type": """SELECT 'event_type' AS group_col, event_type AS group_value, 'value' AS measure_col, count(value) AS "N", round(avg(value), 4) AS "M",
            round(stddev_samp(value), 4) AS "SD", round(median(value), 4) AS "Mdn", round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS "IQR" FROM events GROUP BY event_type""",
        "eda_profile_orders": profile_rows,
        "eda_quality_lineitem": quality_rows,
        "eda_duplicates": "SELECT CAST(sum(k - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_suppkey, l_linenumber, l_quantity)",
        "eda_desc_continuous": describe_sql("lineitem", ["l_discount", "l_tax"], "continuous"),
        "eda_desc_discrete": describe_sql("lineitem", ["l_quantity", "l_linenumber"], "discrete"),
        "eda_desc_ordinal": describe_sql("lineitem", ["l_linenumber"], "ordinal"),
        "eda_desc_shape": f"SELECT variable, round(round(skewness(value), 4), 3) AS \"Skewness\", round(round(kurtosis(value), 4), 3) AS \"Kurtosis\" FROM ({unpivoted('lineitem', ['l_discount', 'l_tax', 'l_quantity'])}) GROUP BY variable",
        "eda_nominal_freq": f"""SELECT variable AS "column", value, n AS count, round(n * 100.0 / total, 2)::DOUBLE AS pct FROM (
            SELECT *, sum(n) OVER (PARTITION BY variable) AS total, row_number() OVER (PARTITION BY variable ORDER BY n DESC, value) AS r
            FROM (SELECT variable, value, count(*) AS n FROM ({unpivoted('orders', ['o_orderstatus', 'o_orderpriority'], 'VARCHAR')}) GROUP BY ALL)) WHERE r <= 10""",
        "eda_binary": f"""SELECT variable AS "column", value, n AS count, round(p, 4) AS proportion, round(greatest(0, p - 1.96 * sqrt(p * (1 - p) / total)), 4) AS "CI95_lower",
            round(least(1, p + 1.96 * sqrt(p * (1 - p) / total)), 4) AS "CI95_upper" FROM (SELECT *, n::DOUBLE / total AS p FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY variable) AS DOUBLE) AS total
            FROM (SELECT variable, value, count(*) AS n FROM ({unpivoted('labels', ['quality', 'toxic'], 'VARCHAR')}) GROUP BY ALL)))""",
        "eda_ordinal_dist": """SELECT 'l_linenumber' AS "column", value, n AS count, round(n * 100.0 / sum(n) OVER (), 2)::DOUBLE AS pct,
            round(sum(n) OVER (ORDER BY value) * 100.0 / sum(n) OVER (), 2)::DOUBLE AS cumulative_pct FROM (SELECT l_linenumber::DOUBLE AS value, count(*) AS n FROM lineitem GROUP BY 1)""",
        "eda_pearson": pearson_sql("lineitem", ["l_quantity", "l_discount", "l_tax"]),
        "eda_pearson_listwise": pearson_sql("(SELECT * FROM lineitem WHERE l_tax <> 0)", ["l_quantity", "l_discount", "l_tax"]),
        "eda_spearman": spearman_sql("lineitem", ["l_linenumber", "l_quantity", "l_discount"]),
        "eda_crosstab": """SELECT coalesce(o_orderstatus, 'Total') AS "row", coalesce(o_orderpriority, 'Total') AS "column", count(*) AS count,
            grouping(o_orderstatus) = 1 AS row_margin, grouping(o_orderpriority) = 1 AS column_margin FROM orders
            WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
        "eda_trend_monthly": "SELECT strftime(ts, '%Y-%m') AS period, count(*) AS count, round(avg(value), 4) AS value_mean, round(median(value), 4) AS value_median FROM events GROUP BY 1",
        "eda_text_summary": f"""SELECT round(avg(len(regexp_extract_all(text, '\\S+'))), 2) AS avg_word_count, count(*) AS total_docs,
            (SELECT count(DISTINCT w) FROM (SELECT unnest({WORDS_SQL}) AS w FROM documents)) AS vocab_size FROM documents WHERE text IS NOT NULL""",
        "eda_text_unigrams": f"SELECT item, count(*) AS count FROM (SELECT unnest({WORDS_SQL}) AS item FROM documents) GROUP BY item ORDER BY count DESC, item LIMIT 10",
        "eda_text_bigrams": f"SELECT item, count(*) AS count FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS item FROM (SELECT {WORDS_SQL} AS w FROM documents)) GROUP BY item ORDER BY count DESC, item LIMIT 10",
        "topic_label_docs": f"""WITH {TOPICS_SQL}, m AS (SELECT topic_id, string_agg(code, '; ' ORDER BY code) AS codes, string_agg(label, '; ' ORDER BY code) AS labels, string_agg(theme, '; ' ORDER BY code) AS themes FROM n GROUP BY topic_id)
            SELECT p_partkey, "Topic", coalesce(codes, 'Unknown') AS "Final_Code", coalesce(labels, 'Unknown') AS "Final_Label", coalesce(themes, 'Unknown') AS "Category_Theme" FROM d LEFT JOIN m ON "Topic" = topic_id""",
        "topic_totals": f"""WITH {TOPICS_SQL}, g AS (SELECT CASE WHEN theme = 'Game-Specific' THEN theme ELSE split_part(theme, '-', 1) END AS theme_group, theme AS sub_theme, code, "Count" FROM n)
            SELECT theme_group, sub_theme, code, CASE grouping(theme_group, sub_theme, code) WHEN 0 THEN 'code' WHEN 1 THEN 'sub_theme' WHEN 3 THEN 'theme' ELSE 'total' END AS level, CAST(sum("Count") AS BIGINT) AS n_docs, count(*) AS n_sources
            FROM g GROUP BY ROLLUP (theme_group, sub_theme, code)""",
        "topic_overlap": f"""WITH {TOPICS_SQL} SELECT topic_id, count(*) AS n_codes, max("Count") AS "Count", max("Count") * (count(*) - 1) AS extra_docs FROM n GROUP BY topic_id HAVING count(*) > 1""",
        "topic_unassigned": f"""WITH {TOPICS_SQL} SELECT "Topic", "Count" FROM t WHERE "Topic" <> -1 AND "Topic" NOT IN (SELECT topic_id FROM n)""",
        "topic_reconcile": f"""WITH {TOPICS_SQL}, x AS (SELECT (SELECT CAST(sum("Count") AS BIGINT) FROM t) AS total_docs, (SELECT CAST(coalesce(sum("Count"), 0) AS BIGINT) FROM t WHERE "Topic" = -1) AS outlier_docs,
            (SELECT CAST(sum("Count") AS BIGINT) FROM n) AS grand_total, (SELECT CAST(sum(c * (k - 1)) AS BIGINT) FROM (SELECT max("Count") AS c, count(*) AS k FROM n GROUP BY topic_id)) AS overlap_docs,
            (SELECT CAST(coalesce(sum("Count"), 0) AS BIGINT) FROM t WHERE "Topic" <> -1 AND "Topic" NOT IN (SELECT topic_id FROM n)) AS unassigned_docs,
            (SELECT count(*) FROM t WHERE "Topic" <> -1 AND "Topic" NOT IN (SELECT topic_id FROM n)) AS topics_missing)
            SELECT total_docs, outlier_docs, total_docs - outlier_docs AS non_outlier_docs, grand_total, overlap_docs, unassigned_docs, topics_missing, total_docs - outlier_docs - unassigned_docs + overlap_docs = grand_total AS reconciles FROM x""",
        "topic_plan": f"""WITH {TOPICS_SQL}, x AS (SELECT (SELECT sum("Count") FROM t) AS a, (SELECT coalesce(sum("Count"), 0) FROM t WHERE "Topic" = -1) AS b, (SELECT sum("Count") FROM n) AS g,
            (SELECT sum(c * (k - 1)) FROM (SELECT max("Count") AS c, count(*) AS k FROM n GROUP BY topic_id)) AS o, (SELECT coalesce(sum("Count"), 0) FROM t WHERE "Topic" <> -1 AND "Topic" NOT IN (SELECT topic_id FROM n)) AS u),
            g AS (SELECT CASE WHEN theme = 'Game-Specific' THEN theme ELSE split_part(theme, '-', 1) END AS theme_group, theme AS sub_theme, code, "Count" FROM n)
            SELECT 1 AS section, '| ' || name || ' | ' || format('{{:,}}', v::BIGINT) || ' |' AS line FROM (SELECT unnest(['total docs', 'outlier docs', 'non outlier docs', 'overlap docs', 'unassigned docs', 'grand total']) AS name,
            unnest([a, b, a - b, o, u, g]) AS v FROM x)
            UNION ALL SELECT 3, '| ' || coalesce(theme_group, 'Total') || ' | ' || coalesce(sub_theme, '') || ' | ' || coalesce(code, '') || ' | ' || format('{{:,}}', sum("Count")::BIGINT) || ' |' FROM g GROUP BY ROLLUP (theme_group, sub_theme, code)
            UNION ALL SELECT 5, '| ' || topic_id || ' | ' || count(*) || ' | ' || format('{{:,}}', max("Count")::BIGINT) || ' |' FROM n GROUP BY topic_id HAVING count(*) > 1""",
        "topic_theme_counts": f"""WITH {TOPICS_SQL}, m AS (SELECT topic_id, string_agg(theme, '; ' ORDER BY code) AS themes FROM n GROUP BY topic_id)
            SELECT coalesce(themes, 'Unknown') AS "Category_Theme", count(*) AS count FROM d LEFT JOIN m ON "Topic" = topic_id GROUP BY 1 ORDER BY count DESC, 1 LIMIT 10""",
        "ckpt_keep_last": """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS r FROM lineitem) WHERE r = 1""",
        "ckpt_pending_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
        "ckpt_retry_merge": f"""WITH {CKPT_SQL} SELECT subject, file_path, CASE WHEN hit AND length(file_path) % 2 = 0 THEN 'again' ELSE label END AS label, quality_score,
            model_ok OR (hit AND length(file_path) % 2 = 0) AS model_ok, CASE WHEN hit THEN coalesce(retry_count, 0) + 1 ELSE retry_count END AS retry_count
            FROM (SELECT *, NOT model_ok AND coalesce(retry_count, 0) < 3 AS hit FROM c)""",
        "ckpt_coverage": f"""WITH {CKPT_SQL} SELECT subject, count(*) AS expected, count(*) FILTER (model_ok) AS found, round(count(*) FILTER (model_ok)::DOUBLE / count(*), 4) AS coverage,
            CASE WHEN count(*) FILTER (model_ok)::DOUBLE / count(*) < 0.5 THEN 'skip' WHEN count(*) FILTER (model_ok)::DOUBLE / count(*) < 0.9 THEN 'warn' ELSE 'write' END AS step FROM c GROUP BY subject""",
        "ckpt_review": f"""WITH {CKPT_SQL}, s AS (SELECT subject, count(*) AS total, count(*) FILTER (model_ok) AS ok_count, count(*) FILTER (model_ok AND label = '') AS blank FROM c GROUP BY subject),
            p AS (SELECT *, round(ok_count * 100.0 / total, 2)::DOUBLE AS ok_pct FROM s)
            SELECT subject, total, ok_count, ok_pct, concat_ws('; ', CASE WHEN ok_count = 0 THEN 'no good rows' END, CASE WHEN ok_pct < 90 THEN 'under 90 % good' END, CASE WHEN blank > 0 THEN 'blank label in good rows' END) AS issues FROM p""",
        "ckpt_field_coverage": f"""WITH {CKPT_SQL} SELECT * FROM (SELECT 'label' AS field, count(*) FILTER (label <> '') AS n_filled, round(count(*) FILTER (label <> '') * 100.0 / count(*), 2)::DOUBLE AS pct FROM c
            UNION ALL SELECT 'quality_score', count(*) FILTER (quality_score <> ''), round(count(*) FILTER (quality_score <> '') * 100.0 / count(*), 2)::DOUBLE FROM c
            UNION ALL SELECT 'retry_count', count(retry_count), round(count(retry_count) * 100.0 / count(*), 2)::DOUBLE FROM c)""",
        "ckpt_scores": f"WITH {CKPT_SQL} SELECT 'quality_score' AS field, round(avg(quality_score::DOUBLE), 4) AS mean, round(median(quality_score::DOUBLE), 4) AS median, count(*) AS n FROM c",
        "ckpt_retry_summary": f"""WITH {CKPT_SQL} SELECT subject, count(*) AS total, count(*) FILTER (NOT model_ok AND coalesce(retry_count, 0) < 3) AS retryable,
            count(*) FILTER (NOT model_ok AND coalesce(retry_count, 0) >= 3) AS exhausted, round(count(*) FILTER (NOT model_ok) * 100.0 / count(*), 2)::DOUBLE AS error_pct FROM c GROUP BY ROLLUP (subject)""",
        "ckpt_subjects": r"""SELECT page_id, CASE WHEN s <> '' THEN s ELSE 'default' END AS subject, coalesce(lower(regexp_extract(p, '\.[^./\\]+$')) IN ('.jpg', '.com'), false) AS media
            FROM (SELECT page_id, p, trim(regexp_replace(coalesce(string_split(rtrim(p, '/'), '/')[-2], ''), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '. ') AS s FROM (SELECT page_id, split_part(url, '?', 1) AS p FROM pages))""",
        "json_parse_fallback": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
        "json_greedy": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "jsonl_build": rf"WITH {CKPT_SQL} SELECT subject || '::' || replace(file_path, '\', '/') AS key, 'u:' || file_path AS uri, 'Label: ' || CASE WHEN label = '' THEN 'Unknown' ELSE label END AS block FROM c WHERE NOT model_ok",
        "results_join": f"WITH {CKPT_SQL} SELECT subject, file_path, CASE WHEN model_ok THEN label ELSE '' END AS label, '' AS tone, model_ok FROM c",
        "batch_bytes": f"WITH {BYTES_SQL} SELECT * FROM b",
        "batch_quota_prefix": f"WITH {BYTES_SQL} SELECT * FROM (SELECT *, CAST(sum(bytes) OVER (ORDER BY bytes, subject ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_bytes FROM b) WHERE running_bytes <= 2000000",
        "batch_split_bytes": """WITH RECURSIVE o AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
            w AS (SELECT *, CAST(0 AS BIGINT) AS batch, n_chars AS total FROM o WHERE i = 1 UNION ALL
            SELECT o.*, CASE WHEN total > 0 AND total + o.n_chars > 20000 THEN batch + 1 ELSE batch END, CASE WHEN total > 0 AND total + o.n_chars > 20000 THEN o.n_chars ELSE total + o.n_chars END
            FROM w JOIN o ON o.source = w.source AND o.i = w.i + 1) SELECT doc_id, source, n_chars, batch FROM w""",
    }
