"""Registered queries of the operators that are built for one hot key or a few changed rows, and
their SQL. Each reads whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions import jsons, text
from tallygrid.operators import batches, bivariate, checkpoints, greedy_batches, levels, media, profile, text_tables
from tallygrid.queries_more import job_log, table
from tallygrid.shared import shared_folder
from tallygrid.sources import writers
from tallygrid.sources.file_table import FileTable


def batch_split_hot(spark, d):
    """All order lines as one key."""
    lines = table(spark, d, "lineitem").select(F.lit("all").alias("key"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("n"))
    return greedy_batches.split_by_size(lines, "key", "n", 30_000, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], hot=5_000).select("l_orderkey", "l_linenumber", "l_partkey", "batch")


def new_table(spark: SparkSession, name: str) -> FileTable:
    return FileTable(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def ckpt_file_merge(spark, d):
    """Retries of some orders merged into a table of files, of which each holds a range of orders."""
    rows = table(spark, d, "orders").select(
        F.concat(F.lit("m\\"), F.col("o_orderkey").cast("string")).alias("file"), F.col("o_orderpriority").alias("field"), (F.col("o_orderstatus") != "F").alias("model_ok"),
        F.when(F.col("o_orderkey") % 4 == 0, 1).alias("retry_count"), "o_orderkey")
    held = new_table(spark, "checkpoint")
    held.append(rows.repartitionByRange(8, "o_orderkey"))
    failed = rows.where("NOT model_ok AND o_orderkey % 50 = 0")
    retries = failed.select(F.replace("file", F.lit("\\"), F.lit("/")).alias("file"), F.lit("again").alias("field"), (F.col("o_orderkey") % 100 == 0).alias("model_ok"))
    checkpoints.merge_retries(held, retries, "file", ["field"])
    return held.read()


def job_file_merge(spark, d):
    log, new = job_log(spark, d)
    held = new_table(spark, "log")
    held.append(log.repartitionByRange(8, "job_name"))
    batches.merge_jobs(held, new, "t2")
    return held.read()


RANKED = "SELECT l_linenumber AS a, nullif(l_quantity, 7) AS b, CASE WHEN l_discount > 0.02 THEN l_discount END AS c, CASE WHEN l_orderkey % 3 > 0 THEN l_extendedprice END AS d FROM lineitem"


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """Columns of order lines, three with missing values in different rows."""
    return table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("a"), F.nullif("l_quantity", F.lit(7)).alias("b"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("c"),
        F.when(F.col("l_orderkey") % 3 > 0, F.col("l_extendedprice")).alias("d"))


def eda_spearman_pairwise(spark, d):
    return bivariate.spearman(ranked(spark, d), ["a", "b", "c", "d"], p_values=False)


def eda_spearman_listwise(spark, d):
    return bivariate.spearman(ranked(spark, d), ["a", "b", "c", "d"], "listwise", p_values=False)


NOMINAL = ("l_returnflag", "l_linestatus", "l_linenumber", "l_tax")


def eda_crosstabs(spark, d):
    """All pairs of four columns of order lines; one of them is null where it is 1."""
    rows = table(spark, d, "lineitem").withColumn("l_linenumber", F.nullif("l_linenumber", F.lit(1)))
    return bivariate.cross_tabulate_all(rows, list(combinations(NOMINAL, 2)))


def eda_text_report(spark, d):
    """Summary, words and pairs of the documents and of the conversations."""
    both = table(spark, d, "documents").select("text", F.lit(None).cast("string").alias("said")).unionByName(table(spark, d, "conversations").select(F.lit(None).cast("string").alias("text"), F.col("text").alias("said")))
    return text_tables.text_analysis(both, ["text", "said"], 12, ["the", "de", "la"])


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames of videos, one a user."""
    return table(spark, d, "events").select("user_id", "value", (F.col("event_id") % 97).cast("double").alias("tone"), "event_type", (F.col("event_id") % 3 > 0).alias("ok"))


def media_videos(spark, d):
    found = media.video_features(frames(spark, d), "user_id", ["value", "tone"], ["event_type"])
    return found.select("user_id", *[F.round(c, 9).alias(c) for c in found.columns if c.startswith(("value_", "tone_", "ok_"))], "event_type", "frame_count", "ok")


def media_functionals(spark, d):
    found = media.frame_functionals(frames(spark, d), "event_type", ["value", "tone"])
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in found.columns if c != "event_type"])


def checkpoint_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    return rows.select(F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderpriority")).alias("subject"), "o_orderkey", F.when(F.col("o_orderkey") % 6 > 0, F.col("o_orderstatus") == "F").alias("ok"),
                       F.when(F.col("o_custkey") % 3 == 0, " ").when(F.col("o_custkey") % 3 == 1, F.col("o_orderstatus")).alias("field"))


def ckpt_outcomes(spark, d):
    return checkpoints.outcome_counts(checkpoint_rows(spark, d))


def ckpt_observed_write(spark, d):
    """The same counts in total and a field's coverage, made while the checkpoint is written."""
    path = f"{shared_folder(spark)}/checkpoint-{uuid.uuid4().hex}"
    seen = writers.observed_write(checkpoint_rows(spark, d), path, ["field"])
    total = spark.createDataFrame([(seen["total"]["ok"], seen["total"]["failed"], seen["fields"]["field"]["n_filled"], seen["fields"]["field"]["pct"])], "ok long, failed long, n_filled long, pct double")
    return total.crossJoin(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("written")))  # one row each


def ckpt_requested(spark, d):
    rows = checkpoint_rows(spark, d)
    wanted = table(spark, d, "customer").select(F.when(F.col("c_nationkey") % 2 == 0, "1-URGENT").otherwise("3-MEDIUM").alias("subject"))
    return checkpoints.requested(rows, wanted, "subject").select("subject", "o_orderkey")


def batch_subject_count(spark, d):
    return batches.subject_count(checkpoint_rows(spark, d))


def jsonl_whole(spark, d):
    """Events as lines that appear whole, read back."""
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    writers.write_lines_whole(table(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type", "user_id")).alias("line")), path)
    return writers.read_lines_whole(spark, path)


def json_keys(spark, d):
    """All keys that the answers about events hold."""
    name = F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string"))
    answers = table(spark, d, "events").select(F.map_from_arrays(F.array(F.col("event_type"), name), F.array(F.lit("a"), F.lit("b"))).alias("fields"))
    return spark.createDataFrame([(k,) for k in jsons.observed_keys(answers, "fields")], "key string")


def fn_ordered_distinct(spark, d):
    """Different words of each conversation turn in order of their first place (U8)."""
    words = text.tokens(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_distinct(words), " ").alias("words"))


def eda_grouped_mixed(spark, d):
    """Measures and an ordinal column within groups, as one table."""
    return bivariate.grouped_stats(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"], ["l_linenumber"])


def eda_schema_summary(spark, d):
    orders = table(spark, d, "orders")
    return profile.schema_summary(profile.dataset_profile(orders, levels.classify(orders)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (batch_split_hot, ckpt_file_merge, job_file_merge, eda_spearman_pairwise, eda_spearman_listwise, eda_crosstabs, eda_text_report, media_videos, media_functionals,
            ckpt_outcomes, ckpt_observed_write, ckpt_requested, batch_subject_count, jsonl_whole, json_keys, fn_ordered_distinct, eda_grouped_mixed, eda_schema_summary)
    return {f.__name__: f for f in made}


def spearman_sql(pairs_of: str) -> str:
    """Spearman by ranks within each pair's rows, of ``t`` with columns a to d."""
    parts = []
    for x, y in combinations("abcd", 2):
        parts.append(f"""SELECT '{x}' AS col1, '{y}' AS col2, round(corr(rx, ry), 4) AS rho, count(*) AS "N" FROM (
            SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry
            FROM t WHERE {x} IS NOT NULL AND {y} IS NOT NULL {pairs_of})""")
    return f"WITH t AS ({RANKED}) " + " UNION ALL ".join(parts)


def crosstabs_sql() -> str:
    parts = [f"""SELECT '{a}' AS row_column, '{b}' AS column_column, coalesce({a}, 'Total') AS "row", coalesce({b}, 'Total') AS "column", count(*) AS count, grouping({a}) = 1 AS row_margin, grouping({b}) = 1 AS column_margin
        FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY CUBE ({a}, {b})""" for a, b in combinations(NOMINAL, 2)]
    return "WITH t AS (SELECT l_returnflag, l_linestatus, nullif(l_linenumber, 1)::VARCHAR AS l_linenumber, l_tax::VARCHAR AS l_tax FROM lineitem) " + " UNION ALL ".join(parts)


def report_sql() -> str:
    """Words are of two ASCII letters or more, in lower case, without three stop words."""
    words = r"""list_filter(list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]+')), lambda x: lower(x)),
        lambda w: len(w) > 1 AND w NOT IN ('the', 'de', 'la'))"""
    parts = []
    for column, source in (("text", "documents"), ("said", "conversations")):
        pairs = f"SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS item FROM (SELECT {words} AS w FROM {source})"
        summary = f"SELECT round(avg(len(regexp_extract_all(text, '\\S+'))), 2) AS a, (SELECT count(DISTINCT w) FROM (SELECT unnest({words}) AS w FROM {source}))::DOUBLE AS v, count(*)::DOUBLE AS t FROM {source} WHERE text IS NOT NULL"
        parts += [f"SELECT '{column}' AS \"column\", 'summary' AS type, unnest(['avg_word_count', 'vocab_size', 'total_docs']) AS item, unnest([a, v, t]) AS count FROM ({summary})"]
        for kind, items in (("unigram", f"SELECT unnest({words}) AS item FROM {source}"), ("bigram", pairs)):
            parts.append(f"SELECT * FROM (SELECT '{column}', '{kind}', item, count(*)::DOUBLE FROM ({items}) GROUP BY item ORDER BY count(*) DESC, item LIMIT 12)")
    return " UNION ALL ".join(parts)


def summary_sql() -> str:
    from tallygrid.queries import ORDERS_LEVELS

    return " UNION ALL ".join(f"SELECT printf('{c}: {level}, %d different, %.2f %% missing', count(DISTINCT {c}), 100.0 - count({c}) * 100.0 / count(*)) AS line FROM orders" for c, level in ORDERS_LEVELS.items())


def oracle_sql() -> dict[str, str]:
    from tallygrid.queries_more import JOBS_SQL

    rows = """c AS (SELECT CASE WHEN o_orderkey % 11 > 0 THEN o_orderpriority END AS subject, o_orderkey, CASE WHEN o_orderkey % 6 > 0 THEN o_orderstatus = 'F' END AS ok,
        CASE WHEN o_custkey % 3 = 0 THEN ' ' WHEN o_custkey % 3 = 1 THEN o_orderstatus END AS field FROM orders)"""
    frame = "f AS (SELECT *, (event_id % 97)::DOUBLE AS tone, event_id % 3 > 0 AS ok FROM events)"
    numbers = ", ".join(f"round({f}({c}) FILTER (ok), 9) AS {c}_{n}" for c in ("value", "tone") for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
    grouped = " UNION ALL ".join(f"""SELECT '{g}' AS group_col, {g} AS group_value, '{m}' AS measure_col, count({m}) AS "N", {f"round(avg({m}), 4)" if m == "l_quantity" else "NULL::DOUBLE"} AS "M",
        {"NULL::DOUBLE" if m == "l_quantity" else f"round(avg({m}), 4)"} AS "M_quasi_interval", round(stddev_samp({m}), 4) AS "SD", round(median({m}), 4) AS "Mdn",
        round(quantile_cont({m}, 0.75) - quantile_cont({m}, 0.25), 4) AS "IQR" FROM lineitem GROUP BY {g}""" for g in ("l_returnflag", "l_linestatus") for m in ("l_quantity", "l_linenumber"))
    return {
        "media_videos": f"""WITH {frame}, m AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS i FROM f WHERE ok GROUP BY 1, 2)
            SELECT f.user_id, {numbers}, m.event_type, count(*) AS frame_count, round(avg(ok::INT), 9) AS ok_ratio, bool_or(ok) AS ok FROM f LEFT JOIN m ON f.user_id = m.user_id AND i = 1 GROUP BY f.user_id, m.event_type""",
        "media_functionals": f"WITH {frame} SELECT event_type, " + ", ".join(f"round({f}({c}), 6) AS {c}_{n}" for c in ("value", "tone") for n, f in (("mean", "avg"), ("std", "stddev_pop"))) + " FROM f GROUP BY 1",
        "ckpt_outcomes": f"WITH {rows} SELECT subject, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT coalesce(ok, false)) AS failed, count(*) AS total FROM c GROUP BY ROLLUP (subject)",
        "ckpt_observed_write": f"""WITH {rows} SELECT count(*) FILTER (ok) AS ok, count(*) FILTER (NOT coalesce(ok, false)) AS failed, count(*) FILTER (trim(field) <> '') AS n_filled,
            round(count(*) FILTER (trim(field) <> '') * 100.0 / count(*), 2)::DOUBLE AS pct, count(*) AS written FROM c""",
        "ckpt_requested": f"WITH {rows} SELECT subject, o_orderkey FROM c WHERE subject IN (SELECT CASE WHEN c_nationkey % 2 = 0 THEN '1-URGENT' ELSE '3-MEDIUM' END FROM customer)",
        "batch_subject_count": f"WITH {rows} SELECT count(DISTINCT subject) AS subjects FROM c",
        "jsonl_whole": """SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS value FROM events""",
        "json_keys": "SELECT event_type AS key FROM events UNION SELECT 'k' || (event_id % 7) FROM events",
        "fn_ordered_distinct": r"""WITH w AS (SELECT conv_id, turn, list_filter(list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]+')), lambda x: lower(x)),
            lambda x: len(x) > 1) AS w FROM conversations)
            SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM w""",
        "eda_grouped_mixed": grouped,
        "eda_schema_summary": summary_sql(),
        "eda_spearman_pairwise": spearman_sql(""), "eda_spearman_listwise": spearman_sql("AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL"),
        "eda_crosstabs": crosstabs_sql(), "eda_text_report": report_sql(),
        "batch_split_hot": """WITH RECURSIVE o AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS n, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
            p AS (SELECT *, sum(n) OVER (ORDER BY i) AS t FROM o),
            b(batch, i, t0) AS (SELECT 0::BIGINT, 1::BIGINT, 0::HUGEINT UNION ALL SELECT batch + 1, j, tj FROM (SELECT b.batch, min(p.i) AS j, min(p.t - p.n) AS tj FROM b JOIN p ON p.t > b.t0 + 30000 AND p.i > b.i GROUP BY b.batch)),
            e AS (SELECT batch, i, lead(i) OVER (ORDER BY i) AS e FROM b)
            SELECT l_orderkey, l_linenumber, l_partkey, batch FROM p ASOF JOIN b ON p.i >= b.i""",
        "ckpt_file_merge": r"""SELECT 'm\' || o_orderkey AS file, CASE WHEN r AND o_orderkey % 100 = 0 THEN 'again' ELSE o_orderpriority END AS field, o_orderstatus <> 'F' OR r AND o_orderkey % 100 = 0 AS model_ok,
            CASE WHEN r THEN CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END WHEN o_orderkey % 4 = 0 THEN 1 END AS retry_count, o_orderkey
            FROM (SELECT *, o_orderstatus = 'F' AND o_orderkey % 50 = 0 AS r FROM orders)""",
        "job_file_merge": f"""WITH {JOBS_SQL} SELECT coalesce(l.job_name, e.job_name) AS job_name, CASE WHEN e.job_name IS NULL THEN state ELSE 'JOB_STATE_FAILED' END AS state, coalesce(created_at, 't1') AS created_at,
            CASE WHEN e.job_name IS NULL THEN updated_at ELSE 't2' END AS updated_at, note FROM l FULL JOIN e ON l.job_name = e.job_name""",
    }
