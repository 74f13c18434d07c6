"""Registered queries of sources, sinks and the pipelines between them, and their SQL: tables go out
through a writer and come back through a reader."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.operators import checkpoints, levels, model_calls
from tallygrid.plans import extraction
from tallygrid.queries_more import table
from tallygrid.shared import shared_folder
from tallygrid.sources import readers, writers


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}"


def source_csv(spark, d):
    """Orders as one CSV table, whose keys stay text."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.concat(F.col("o_orderstatus"), F.lit(', "so"')).alias("status"), "o_totalprice", F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderpriority")).alias("priority"))
    path = new_path(spark, "orders.csv")
    writers.save_csv(rows, path)
    return readers.read_table(spark, path, ["o_orderkey"])


def source_lines(spark, d):
    """Events as JSON lines, of which a tenth is cut off and some are blank."""
    line = F.to_json(F.struct("event_id", "event_type", "user_id"))
    odd = F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 14)).when(F.col("event_id") % 10 == 1, F.lit("")).otherwise(line)
    path = new_path(spark, "events.jsonl")
    writers.write_lines(table(spark, d, "events").select(odd.alias("line")), path)
    return readers.read_lines(spark, path, "event_id long, event_type string, user_id long").select("event_id", "event_type", "user_id")


#: Rows that the documents of one block hold together.
BLOCK_ROWS = 100_000


def uri_documents(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """URI maps of customers by subject. A subject has a document for each block of rows, so that no
    document grows with the table; Spark numbers the rows of a partition without a gap."""
    path, key = F.concat(F.lit("m\\"), F.col("c_custkey").cast("string")), F.col("c_custkey").cast("string")
    blocks = rows.select(F.col("c_mktsegment").alias("subject"), path.alias("path"), F.concat(F.lit("u:"), key).alias("uri"), "c_name", F.floor(F.monotonically_increasing_id() / block_rows).alias("block"))
    return blocks.groupBy("subject", "block").agg(
        F.map_from_entries(F.collect_list(F.struct("path", "uri"))).alias("uri_map"), F.map_from_entries(F.collect_list(F.struct("path", "c_name"))).alias("name_map"), F.lit(3).alias("key_id")).drop("block")


def source_documents(spark, d):
    """URI maps as JSON documents of one subject each, read back as rows."""
    rows = uri_documents(table(spark, d, "customer"))
    path = new_path(spark, "maps")
    rows.select(F.to_json(F.struct("subject", "uri_map", "name_map", "key_id")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.uri_rows(readers.read_document(spark, path, "subject string, uri_map map<string, string>, name_map map<string, string>, key_id int"))


def source_checkpoints(spark, d):
    """Orders written by subject; the second write replaces the subjects at hand only."""
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("subject"), "o_orderkey", F.lit(1).alias("round"))
    path = new_path(spark, "checkpoints")
    writers.write_subjects(rows, path)
    writers.write_subjects(rows.where("subject = 'F' AND o_orderkey % 2 = 0").withColumn("round", F.lit(2)), path)
    found = readers.read_checkpoints(spark, f"{path}/subject=*/*.parquet")
    return found.where(F.col("checkpoint").startswith("part-")).select("o_orderkey", "round")


def source_ids(spark, d):
    path = new_path(spark, "ids")
    ids = F.when(F.col("c_custkey") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")))
    table(spark, d, "customer").select(ids.alias("value")).write.text(path)
    return readers.read_ids(spark, path)


def source_log(spark, d):
    """A log that does not exist yet, then one that is written anew over itself."""
    path = new_path(spark, "log.csv")
    none = readers.read_log(spark, path, ["job_name", "state"])
    nations = table(spark, d, "nation").select(F.col("n_name").alias("job_name"), F.lit("NEW").alias("state"))
    writers.rewrite_log(none.unionByName(nations), path)
    again = readers.read_log(spark, path, ["job_name", "state"]).withColumn("state", F.concat("state", F.lit("ER")))
    writers.rewrite_log(again, path)
    return readers.read_log(spark, path, ["job_name", "state"])


def source_merged(spark, d):
    path = new_path(spark, "merged")
    writers.write_merged(table(spark, d, "supplier").select("s_suppkey", "s_name"), path)
    writers.write_merged(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return readers.read_table(spark, f"{path}/*.parquet", ["s_suppkey"])


def ckpt_reordered(spark, d):
    """Key columns once and first, then fields, trailing columns last, without the retry count."""
    rows = table(spark, d, "orders").select(F.lit(2).alias("retry_count"), F.col("o_orderstatus").alias("raw_json"), F.col("o_orderpriority").alias("field"), "o_orderkey", F.col("o_custkey").alias("file"))
    source = checkpoints.source_columns(["o_orderkey", "file", "o_orderkey"], "file")
    return checkpoints.reordered(rows.drop("retry_count"), source, ["field"])


def fn_parse_time(spark, d):
    """Dates as texts, a fifth of which are none."""
    day = F.date_format("ts", "yyyy-MM-dd")
    odd = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("on "), day)).otherwise(day)
    return table(spark, d, "events").select("event_id", F.date_format(levels.parse_time(odd), "yyyy-MM-dd").alias("day"))


def model_expired(spark, d):
    """Uploads of two days and more before a time."""
    uris = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    last = uris.agg(F.max("at")).first()[0]
    return model_calls.expired(uris, "at", last).select("event_id")


def extract_subjects(spark, d):
    """Features of the documents as files, by source, in two runs: the second finds all done."""
    manifest = table(spark, d, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".txt").otherwise(".JPG")).alias("file"), "n_chars")
    planned, folder = extraction.plan(manifest, "file", [".jpg"]), new_path(spark, "features")
    extraction.extract(planned, lambda rows: rows.withColumn("ok", F.col("n_chars") % 3 > 0), folder)
    return extraction.extract(planned, lambda rows: rows.withColumn("ok", F.lit(False)), folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (source_csv, source_lines, source_documents, source_checkpoints, source_ids, source_log, source_merged, ckpt_reordered, fn_parse_time, model_expired, extract_subjects)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {
        "source_csv": """SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey, o_orderstatus || ', "so"' AS status, o_totalprice, CASE WHEN o_custkey % 5 > 0 THEN o_orderpriority END AS priority FROM orders""",
        "source_lines": "SELECT event_id, event_type, user_id FROM events WHERE event_id % 10 > 1",
        "source_documents": "SELECT c_mktsegment AS subject, 'm/' || c_custkey AS path, 'u:' || c_custkey AS uri, c_name AS name, 3 AS key_id FROM customer",
        "source_checkpoints": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS round FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0",
        "source_ids": "SELECT c_name AS subject FROM customer WHERE c_custkey % 4 <> 0",
        "source_log": "SELECT n_name AS job_name, 'NEWER' AS state FROM nation",
        "source_merged": "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_acctbal FROM supplier",
        "ckpt_reordered": "SELECT o_orderkey, o_custkey AS file, o_orderpriority AS field, o_orderstatus AS raw_json FROM orders",
        "fn_parse_time": "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN strftime(ts, '%Y-%m-%d') END AS day FROM events",
        "model_expired": "SELECT event_id FROM events WHERE date_trunc('second', ts) <= (SELECT date_trunc('second', max(ts)) FROM events) - INTERVAL 48 HOUR",
        "extract_subjects": """SELECT coalesce(source, 'none') AS subject, count(*) FILTER (n_chars % 3 > 0) AS ok, count(*) FILTER (n_chars % 3 = 0) AS failed, count(*) AS total
            FROM documents WHERE doc_id % 7 > 0 GROUP BY ROLLUP (coalesce(source, 'none'))""",
    }
