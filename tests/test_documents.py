"""URI map documents: bounded when written, matched in one pass when read."""

import json
import time

from pyspark.sql import functions as F

from tallygrid import queries_sources
from tallygrid.sources import readers

SCHEMA = "subject string, uri_map map<string, string>, name_map map<string, string>, key_id int"


def rows_of(spark, path):
    return sorted((tuple(r) for r in readers.uri_rows(readers.read_document(spark, str(path), SCHEMA)).collect()), key=str)


def test_a_large_document_takes_one_pass(spark, tmp_path):
    n = 100_000
    keys = [f"m\\{i:06d}" for i in range(n)]
    (tmp_path / "a.json").write_text(json.dumps({"subject": "s", "uri_map": {k: f"u{k}" for k in keys}, "name_map": {k: f"n{k}" for k in reversed(keys)}, "key_id": 1}))
    rows = readers.uri_rows(readers.read_document(spark, str(tmp_path), SCHEMA))
    began = time.perf_counter()
    assert rows.agg(F.count_if(F.substring("uri", 2, 99) == F.substring("name", 2, 99)), F.count(F.lit(1))).first() == (n, n)
    assert time.perf_counter() - began < 25  # look-ups take n * n / 2 comparisons


def test_odd_documents_keep_their_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"subject": "s", "uri_map": {"a\\\\x": "1", "a\\\\x": "2", "b": null, "c": "3"}, "name_map": {"a\\\\x": "n", "z": "q", "b": "nb"}, "key_id": 1}')
    (tmp_path / "b.json").write_text('{"subject": "t", "uri_map": {"a": null, "b": "2"}, "key_id": 2}')
    (tmp_path / "c.json").write_text('[{"subject": "u", "uri_map": {}, "name_map": {"k": "v"}}, {"subject": "v", "name_map": {"k": "v"}}, {"uri_map": {"k": "v"}, "name_map": {"k": null, "z": "q"}}]')
    want = [("s", "a/x", "1", "n", 1), ("s", "a/x", "2", "n", 1), ("s", "b", None, "nb", 1), ("s", "c", "3", None, 1), ("t", "a", None, None, 2), ("t", "b", "2", None, 2), (None, "k", "v", None, None)]
    assert rows_of(spark, tmp_path) == sorted(want, key=str)


def test_no_document_grows_with_the_table(spark, tmp_path):
    customers = spark.range(0, 1000, 1, 3).select(F.col("id").alias("c_custkey"), F.when(F.col("id") % 10 > 0, "big").alias("c_mktsegment"), F.concat(F.lit("c"), "id").alias("c_name"))
    made = queries_sources.uri_documents(customers, block_rows=50)
    assert 0 < made.agg(F.max(F.size("uri_map"))).first()[0] <= 50
    made.select(F.to_json(F.struct("subject", "uri_map", "name_map", "key_id")).alias("value")).write.option("maxRecordsPerFile", 1).text(str(tmp_path / "maps"))
    assert rows_of(spark, tmp_path / "maps") == sorted(((None if i % 10 == 0 else "big", f"m/{i}", f"u:{i}", f"c{i}", 3) for i in range(1000)), key=str)
