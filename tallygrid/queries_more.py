"""Registered queries of single functions and of merges, logs and topic inputs, and their SQL.

Each reads whole tables, so its work grows with them; paths, logs and merge groups are derived from
the tables' columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions import jsons, measures, text
from tallygrid.operators import batches, checkpoints, topics


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fn_text(spark, d):
    """Names, labels, integers, keys, file types and slide numbers of page addresses."""
    url, n = F.col("url"), F.col("page_id")
    slide = F.concat(n.cast("string"), F.when(n % 3 == 0, "-slide-a.PNG").otherwise("-page.png"))
    subject, path = text.split_key(F.when(n % 2 == 0, F.concat(F.lit("s"), (n % 7).cast("string"), F.lit("::"), url)).otherwise(F.concat(F.lit("x/assets/player_"), (n % 5).cast("string"), F.lit("/a.jpg"))))
    return table(spark, d, "pages").select(
        "page_id", text.safe_name(url).alias("name"), F.array_join(text.integers(F.concat(F.lit("-3 "), url)), ",").alias("integers"),
        text.undecorated(F.concat(F.lit("['"), url, F.lit("']"))).alias("label"), text.slide_index(slide).alias("slide"), text.mime_type(F.concat(url, F.when(n % 4 == 0, ".MP4").otherwise(".jpg"))).alias("mime"),
        subject.alias("subject"), path.alias("path"), text.listed(F.array(url, n.cast("string"))).alias("listed"),
    )


def fn_measures(spark, d):
    """Levels, colours, boxes and scene frames from the numbers of order lines."""
    q, tax, line, off = F.col("l_quantity"), F.col("l_tax"), F.col("l_linenumber"), F.col("l_discount")
    code = measures.rgb_hex(q * 5, tax * 1000, off * 2000)
    box = measures.overlay_box(q * 40, q * 30, F.lit(0.4), F.when(line % 2 == 0, "bottom-right").otherwise("top-left"))
    known = F.when(line % 7 == 0, "none").otherwise(code)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(measures.intensity_db(tax), 6).alias("intensity"), F.round(measures.dbfs(off), 6).alias("level"), code.alias("code"),
        F.round(measures.hex_luminance(known), 6).alias("luminance"), measures.should_invert(known, line == 3).alias("invert"), F.concat_ws(",", box["x"].cast("long"), box["y"].cast("long"), box["w"].cast("long"), box["h"].cast("long")).alias("box"),
        F.array_join(measures.scene_frames(line, line + q.cast("long"), "even", 4), ",").alias("frames"), F.array_join(measures.scene_frames(line, line + q.cast("long")), ",").alias("middle"),
        F.array_join(measures.scene_frames(line, line + q.cast("long") - 1, "boundaries"), ",").alias("ends"), measures.signal_status(measures.dbfs(off) - 70).alias("status"),
    )


def fn_hues(spark, d):
    """Circular means and deviations of angles."""
    angle = (F.col("l_quantity") * 7.2).cast("double")
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.round(measures.hue_mean(angle), 6).alias("mean"), F.round(measures.hue_deviation(angle), 6).alias("deviation"))


def fn_json(spark, d):
    """Flat fields and text parts of answers made from events."""
    part = F.struct(F.concat(F.col("event_type"), F.lit("!")).alias("text"))
    response = F.struct(F.array(F.struct(F.struct(F.array(part, part).alias("parts")).alias("content"))).alias("candidates"))
    nested = F.to_json(F.struct(F.struct(F.col("event_type").alias("kind"), F.array("user_id", "event_id").alias("ids"), F.array("event_type").alias("one")).alias("a")))
    rows = table(spark, d, "events").select("event_id", jsons.response_fields(F.concat(F.lit("so: "), nested)).alias("f"), jsons.response_text(response).alias("said"))
    return rows.select("event_id", "said", *[jsons.field(F.col("f"), k, "-").alias(k.replace(".", "_")) for k in ("a.kind", "a.ids", "a.one", "b")])


def parts_of(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Orders as three checkpoints whose keys overlap."""
    rows = table(spark, d, "orders").select(F.concat(F.lit("m/"), F.col("o_orderkey").cast("string")).alias("file_path"), "o_orderkey", "o_totalprice")
    score = {name: F.round(F.col("o_totalprice") + shift, 2).alias("score") for name, shift in (("c1", 1), ("c2", 2), ("c3", 3))}
    kept = {"c1": "0, 1, 2", "c2": "2, 3", "c3": "0, 3, 4"}
    return {name: rows.where(f"o_orderkey % 5 IN ({keep})").select("file_path", F.lit(name).alias("made"), score[name]) for name, keep in kept.items()}


def ckpt_merge(spark, d):
    return checkpoints.merge_checkpoints(parts_of(spark, d), ["file_path"])[0]


def ckpt_merge_removed(spark, d):
    return checkpoints.merge_checkpoints(parts_of(spark, d), ["file_path"])[1]


def ckpt_merge_lenient(spark, d):
    parts = parts_of(spark, d)
    merged = checkpoints.merge_lenient([parts["c1"].drop("score"), parts["c2"].withColumn("extra", F.lit(1))])
    return merged.groupBy("made", "extra").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scores"))


def job_log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as a log of jobs, and some of them as newer entries."""
    name = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "batch-").otherwise("live-"), F.col("o_orderkey").cast("string")).alias("job_name")
    rows = table(spark, d, "orders")
    log = rows.where("o_orderkey % 3 <> 0").select(name, F.when(F.col("o_orderstatus") == "F", "JOB_STATE_SUCCEEDED").otherwise("JOB_STATE_RUNNING").alias("state"), F.lit("t0").alias("created_at"), F.lit("t0").alias("updated_at"), F.col("o_orderpriority").alias("note"))
    new = rows.where("o_orderkey % 4 = 0").select(name, F.lit("JOB_STATE_FAILED").alias("state"), F.lit("t1").alias("created_at"), F.lit(7).alias("key_id"))
    return log, new


def job_upsert(spark, d):
    return batches.upsert_jobs(*job_log(spark, d), "t2")


def job_live(spark, d):
    return checkpoints.live_jobs(job_log(spark, d)[0], prefix="batch-").select("job_name", "state")


def batch_failed_sources(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("m\\"), F.col("o_orderkey").cast("string")).alias("file"))
    return batches.failed_sources(rows, rows.where("o_orderkey % 6 = 0").select(F.replace("file", F.lit("\\"), F.lit("/")).alias("file")), "file")


def batch_next_number(spark, d):
    return batches.next_number(table(spark, d, "orders").select(F.concat(F.lit("b_"), (F.col("o_orderkey") % 977).cast("string"), F.lit("_x")).alias("name")), "b_")


def batch_subjects(spark, d):
    return batches.subjects_of(table(spark, d, "documents").select(text.build_key(F.concat("source", F.lit("-"), F.coalesce("lang", F.lit("?"))), F.col("doc_id").cast("string")).alias("key")))


def batch_split_rows(spark, d):
    """Rows of each subject, from request keys of documents."""
    keys = table(spark, d, "documents").select("n_chars", text.build_key(F.concat("source", F.lit("-"), F.coalesce("lang", F.lit("?"))), F.concat(F.lit("d\\"), F.col("doc_id").cast("string"))).alias("key"))
    return batches.split_rows(keys).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"), F.sum("n_chars").cast("long").alias("chars"))


def batch_strategy(spark, d):
    """Batch or live for each day's orders, as one row per rule."""
    sizes = table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").cast("long").alias("bytes"))
    failed = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return batches.strategy(sizes).select(F.lit("size").alias("rule"), "strategy").unionByName(batches.retry_strategy(failed).select(F.lit("retry").alias("rule"), "strategy"))


def batch_remaining_uris(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("subject"), F.col("o_orderkey").cast("string").alias("path"), F.concat(F.lit("u:"), F.col("o_orderkey").cast("string")).alias("uri"))
    return checkpoints.remaining_uris(rows, rows.where("CAST(path AS BIGINT) % 3 <> 1"))


def merge_groups(spark: SparkSession, d: str) -> DataFrame:
    """Parts as groups of topics: decorated labels, some blank, and member lists as text."""
    rows = table(spark, d, "part").groupBy((F.col("p_size") % 9).alias("g")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("p_size")), lambda x: x.cast("string")), ", ").alias("member_topics"))
    return rows.select(F.when(F.col("g") == 4, "['']").otherwise(F.concat(F.lit("['Group "), F.col("g").cast("string"), F.lit("']"))).alias("final_topic_label"), "member_topics")


def topic_merged(spark, d):
    return topics.merged_topics(merge_groups(spark, d)).select("label", F.array_join("members", ";").alias("members"))


def topic_listed_twice(spark, d):
    independent = table(spark, d, "part").where("p_size % 10 = 0").select(F.col("p_size").alias("topic_id")).distinct()
    return topics.listed_twice(merge_groups(spark, d), independent)


def topic_outliers(spark, d):
    docs = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 45, topics.OUTLIER).otherwise(F.col("p_size")).alias("Topic"))
    return topics.outlier_documents(docs).select("p_partkey", topics.valid_topic(F.when(F.col("p_partkey") % 3 == 0, " MANUAL").when(F.col("p_partkey") % 3 == 1, "Group 1").otherwise("none"), ["Group 1"]).alias("valid"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        fn_text, fn_measures, fn_hues, fn_json, ckpt_merge, ckpt_merge_removed, ckpt_merge_lenient, job_upsert, job_live, batch_failed_sources, batch_next_number,
        batch_subjects, batch_split_rows, batch_strategy, batch_remaining_uris, topic_merged, topic_listed_twice, topic_outliers,
    )
    return {f.__name__: f for f in made}


LUMA = "0.299 * ('0x' || substr(c, 2, 2))::INT + 0.587 * ('0x' || substr(c, 4, 2))::INT + 0.114 * ('0x' || substr(c, 6, 2))::INT"
PARTS_SQL = """
p AS (SELECT 'm/' || o_orderkey AS file_path, 'c1' AS made, round(o_totalprice + 1, 2) AS score FROM orders WHERE o_orderkey % 5 IN (0, 1, 2)
      UNION ALL SELECT 'm/' || o_orderkey, 'c2', round(o_totalprice + 2, 2) FROM orders WHERE o_orderkey % 5 IN (2, 3)
      UNION ALL SELECT 'm/' || o_orderkey, 'c3', round(o_totalprice + 3, 2) FROM orders WHERE o_orderkey % 5 IN (0, 3, 4))"""
GROUPS_SQL = "g AS (SELECT p_size % 9 AS g, array_sort(array_agg(DISTINCT p_size)) AS m FROM part GROUP BY 1)"
JOBS_SQL = """
l AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'batch-' ELSE 'live-' END || o_orderkey AS job_name, CASE WHEN o_orderstatus = 'F' THEN 'JOB_STATE_SUCCEEDED' ELSE 'JOB_STATE_RUNNING' END AS state,
      't0' AS created_at, 't0' AS updated_at, o_orderpriority AS note FROM orders WHERE o_orderkey % 3 <> 0),
e AS (SELECT 'batch-' || o_orderkey AS job_name FROM orders WHERE o_orderkey % 4 = 0)"""


def oracle_sql() -> dict[str, str]:
    return {
        "fn_text": r"""SELECT page_id, regexp_replace(url, '[^\p{L}\p{M}\p{N}_]', '_', 'g') AS name, array_to_string(regexp_extract_all('-3 ' || url, '-?\d+'), ',') AS integers, url AS label,
            CASE WHEN page_id % 3 = 0 THEN page_id::INT END AS slide, CASE WHEN page_id % 4 = 0 THEN 'video/mp4' ELSE 'image/jpeg' END AS mime,
            CASE WHEN page_id % 2 = 0 THEN 's' || (page_id % 7) ELSE 'player_' || (page_id % 5) END AS subject,
            CASE WHEN page_id % 2 = 0 THEN url ELSE 'x/assets/player_' || (page_id % 5) || '/a.jpg' END AS path, url || '; ' || page_id AS listed FROM pages""",
        "fn_measures": f"""WITH t AS (SELECT *, '#' || printf('%02X%02X%02X', CAST(trunc(l_quantity * 5) AS INT), CAST(trunc(l_tax * 1000) AS INT), CAST(trunc(l_discount * 2000) AS INT)) AS c,
            floor(l_quantity * 40 * 0.06) AS w, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
            u AS (SELECT *, floor(w * 0.4) AS h, floor(l_quantity * 40 * 0.005) + floor(floor(w * 0.4) * 0.33) AS m, CASE WHEN l_linenumber % 7 = 0 THEN 128.0 ELSE CAST({LUMA} AS DOUBLE) END AS lum FROM t)
            SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax <= 0 THEN 0 ELSE round(10 * log10(l_tax / 1e-12), 6) END AS intensity,
            CASE WHEN l_discount > 0 THEN round(greatest(-120, 20 * log10(l_discount)), 6) ELSE -120 END AS level, c AS code, round(lum, 6) AS luminance, l_linenumber = 3 OR lum < 128 AS invert,
            concat_ws(',', CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 40 - w - m ELSE m END AS BIGINT), CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 30 - h - m ELSE m END AS BIGINT), CAST(w AS BIGINT), CAST(h AS BIGINT)) AS box,
            array_to_string(list_sort(list_distinct(list_transform(range(4), lambda k: l_linenumber + CAST(round_even(k * q / 3.0, 0) AS BIGINT)))), ',') AS frames, CAST(floor((2 * l_linenumber + q) / 2) AS BIGINT)::VARCHAR AS middle,
            CASE WHEN q = 1 THEN l_linenumber::VARCHAR ELSE l_linenumber || ',' || (l_linenumber + q - 1) END AS ends,
            CASE WHEN l_discount > 0 AND greatest(-120, 20 * log10(l_discount)) - 70 > -80 THEN 'ok' ELSE 'silent_or_near_silent' END AS status FROM u""",
        "fn_hues": """WITH a AS (SELECT l_linenumber, avg(sin(radians(l_quantity * 7.2))) AS s, avg(cos(radians(l_quantity * 7.2))) AS c FROM lineitem GROUP BY 1)
            SELECT l_linenumber, round((degrees(atan2(s, c)) + 360) % 360, 6) AS mean, round(degrees(sqrt(-2 * ln(greatest(sqrt(s * s + c * c), 1e-10)))), 6) AS deviation FROM a""",
        "fn_json": "SELECT event_id, event_type || '!' || event_type || '!' AS said, event_type AS a_kind, user_id || '; ' || event_id AS a_ids, event_type AS a_one, '-' AS b FROM events",
        "ckpt_merge": f"WITH {PARTS_SQL} SELECT file_path, made, score FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY made DESC) AS i FROM p) WHERE i = 1",
        "ckpt_merge_removed": f"WITH {PARTS_SQL} SELECT count(*) - count(DISTINCT file_path) AS removed FROM p",
        "ckpt_merge_lenient": f"WITH {PARTS_SQL} SELECT made, CASE WHEN made = 'c2' THEN 1 END AS extra, count(*) AS n, CASE WHEN made = 'c2' THEN count(*) ELSE 0 END AS scores FROM p WHERE made <> 'c3' GROUP BY made",
        "job_upsert": f"""WITH {JOBS_SQL} SELECT coalesce(l.job_name, e.job_name) AS job_name, CASE WHEN e.job_name IS NULL THEN state ELSE 'JOB_STATE_FAILED' END AS state, coalesce(created_at, 't1') AS created_at,
            CASE WHEN e.job_name IS NULL THEN updated_at ELSE 't2' END AS updated_at, note, CASE WHEN e.job_name IS NOT NULL THEN 7 END AS key_id FROM l FULL JOIN e ON l.job_name = e.job_name""",
        "job_live": f"WITH {JOBS_SQL} SELECT job_name, state FROM l WHERE state = 'JOB_STATE_RUNNING' AND job_name LIKE 'batch-%'",
        "batch_failed_sources": r"SELECT o_orderkey, 'm\' || o_orderkey AS file FROM orders WHERE o_orderkey % 6 = 0",
        "batch_next_number": "SELECT max(o_orderkey % 977) + 1 AS next FROM orders",
        "batch_subjects": "SELECT DISTINCT source || '-' || coalesce(lang, '?') AS subject FROM documents",
        "batch_split_rows": "SELECT source || '-' || coalesce(lang, '?') AS subject, count(*) AS n, min('d/' || doc_id) AS first_path, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1",
        "batch_strategy": """SELECT 'size' AS rule, CASE WHEN sum(b) > 5368709120 OR count(*) > 10 THEN 'batch' ELSE 'live' END AS strategy FROM (SELECT sum(n_chars) AS b FROM documents GROUP BY source)
            UNION ALL SELECT 'retry', CASE WHEN count(*) > 500 THEN 'batch' ELSE 'live' END FROM orders WHERE o_orderstatus = 'F'""",
        "batch_remaining_uris": "SELECT o_orderstatus AS subject, o_orderkey::VARCHAR AS path, 'u:' || o_orderkey AS uri FROM orders WHERE o_orderkey % 3 = 1",
        "topic_merged": f"WITH {GROUPS_SQL} SELECT 'Group ' || g AS label, array_to_string(m, ';') AS members FROM g WHERE g <> 4",
        "topic_listed_twice": f"WITH {GROUPS_SQL} SELECT DISTINCT t AS topic_id FROM (SELECT unnest(m) AS t FROM g WHERE g <> 4) WHERE t % 10 = 0",
        "topic_outliers": "SELECT p_partkey, p_partkey % 3 <> 2 AS valid FROM part WHERE p_size > 45",
    }
