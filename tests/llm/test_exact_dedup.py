"""Groups of equal texts, collisions and later batches."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallygrid.llm import _filter, exact_dedup


def want(rows, best):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    out = []
    for r in rows:
        ids = [i for i in groups[r["text"] or ""] if i is not None]
        keep = best(ids) if ids else None
        out.append((str(r["doc_id"]), keep, len(groups[r["text"] or ""]), r["doc_id"] == keep))
    return sorted(map(str, out))


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 5), 4, "0"))])
def test_groups(docs, keep, digest, tmp_path):
    found = exact_dedup.exact_dedup(docs, keep=keep, digest=digest, root=str(tmp_path)).collect()
    assert sorted(str((str(r["id"]), r["keep_id"], r["group_size"], r["kept"])) for r in found) == want(docs.collect(), min if keep == "min" else max)


def test_batches_add_up(spark, docs, none, tmp_path):
    rows = docs.select(F.col("doc_id").alias("id"), exact_dedup.sha256(F.coalesce("text", F.lit(""))).alias("digest"))
    index = exact_dedup.DigestIndex(spark, str(tmp_path), "min")
    with pytest.raises(ValueError):
        index.compact()
    index.flush(rows.where("id < 60"))
    index.compact()
    index.flush(rows.where("id >= 60 OR id IS NULL"))
    whole = {bytes(r["digest"]): (r["keep_id"], r["n"]) for r in rows.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).collect()}
    assert {bytes(r["digest"]): (r["keep_id"], r["n"]) for r in index.compact().collect()} == whole
    assert exact_dedup.exact_dedup(none).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, keep="any")


def test_levels(spark, docs, tmp_path):
    """Flushes fill the levels; runs are sorted, and all levels together hold every row."""
    rows = docs.select(F.col("doc_id").alias("id"), exact_dedup.sha256(F.coalesce("text", F.lit(""))).alias("digest"))
    index = exact_dedup.DigestIndex(spark, str(tmp_path), "max", fanout=2, memtable_rows=7)
    for k in range(11):
        index.flush(rows.where(F.pmod(F.coalesce("id", F.lit(0)), F.lit(11)) == k))
        assert all(len(level) < 2 for level in index.levels)
    assert [len(level) for level in index.levels] == [1, 1, 0, 1]  # eleven in binary
    for level in index.levels[1:]:
        for path in level:
            merged = [bytes(r["digest"]) for r in spark.read.parquet(path).collect()]
            assert len(set(merged)) == len(merged)
            for part in spark.read.parquet(path).select("digest", F.input_file_name().alias("f")).groupBy("f").agg(F.collect_list("digest").alias("d")).collect():
                assert list(part["d"]) == sorted(part["d"])
    whole = {bytes(r["digest"]): (r["keep_id"], r["n"]) for r in rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("n")).collect()}
    assert {bytes(r["digest"]): (r["keep_id"], r["n"]) for r in index.compact().collect()} == whole
    assert sum(map(len, index.levels)) == 1


def test_sorted_run():
    pa = exact_dedup.pa
    batch = pa.record_batch({"digest": [b"b", b"a", b"b", b"a", b"c"], "id": pa.array([3, None, 5, 4, None], "int64"), "n": pa.array([1, 1, 2, 1, 1], "int64")})
    for keep, ids in (("min", [4, 3, None]), ("max", [4, 5, None])):
        assert exact_dedup.sorted_run([batch], keep).to_pydict() == {"digest": [b"a", b"b", b"c"], "id": ids, "n": [2, 3, 1]}


@pytest.mark.parametrize("bits", [1 << 15, 1 << 18, 1 << 27])
def test_filter(spark, monkeypatch, bits):
    monkeypatch.setattr(_filter, "MOST_BITS", bits)
    rows = spark.range(4000).select("id", exact_dedup.sha256(F.col("id").cast("string")).alias("digest"))
    found = _filter.BitmapFilter(rows.where("id % 2 = 0"), "digest").probe(rows)
    assert found.where("id % 2 = 0 AND NOT maybe").count() == 0
    assert found.where("id % 2 = 1 AND maybe").count() < (400 if bits == 1 << 15 else 100)
