"""Exact deduplication with a log-structured merge index of text digests.

* **Memtable and flush.** Each task gathers the digests of its rows in memtables of
  ``memtable_rows`` rows. A full one is sorted, equal digests become one entry (the identifier that
  stays, the number of rows) and the run is flushed: a stretch of a Parquet file in digest order. A
  flush shuffles nothing, and a lost task only writes its own runs again.
* **Levels and compaction.** Whenever a level holds ``fanout`` sets of runs they are merged into
  one set of the next level: a range exchange brings each stretch of digests of all runs together,
  the smallest (or largest) identifier is kept, and a sorted run per range is written. A digest with
  a third of all rows is an entry per memtable by then.
* **Filters.** A compacted set of runs has a filter: bitmaps over hashes of the digests that
  several rows have. Its size is bounded (16 MiB), so it can be broadcast, and documents
  are probed where they are read. Those that it rules out are single and go no further; only the
  others are looked up in the runs, on the digest, of which the runs have one row each, so Spark
  splits a hot one freely. In a corpus with more copies than the filter has room for, more texts
  are looked up; the result is the same.
* **Byte verification.** Each hit's text is compared with the text of the document that stays.
  Rows whose bytes differ (a digest collision) are grouped again by their whole texts.

Later batches can be flushed to the same index and compacted with it.

Edge cases: a null text counts as empty; null ids lose against any id, and a group of null ids
keeps its null; repeated rows with one id count as separate members, and all rows that have the
id that stays are kept; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm._common import shared_dir, stored
from tallygrid.llm._filter import BitmapFilter

def sha256(text: Column) -> Column:
    """The digest of a text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def sorted_run(batches: list[pa.RecordBatch], keep: str) -> pa.Table:
    """Rows ``digest``, ``id``, ``n`` in digest order, one per digest: the id that stays, the sum of n."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    rows = rows.sort_by([("digest", "ascending"), ("id", "ascending" if keep == "min" else "descending")])  # nulls come last
    names = rows["digest"].to_numpy()
    first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    return rows.take(pa.array(first)).set_column(2, "n", pa.array(np.add.reduceat(rows["n"].to_numpy(), first)))


class DigestIndex:
    """Sorted digest runs, level by level, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str | None = None, keep: str = "min", fanout: int = 4, memtable_rows: int = 200_000):
        if keep not in ("min", "max"):
            raise ValueError("keep is 'min' or 'max'")
        self.spark, self.keep, self.fanout, self.memtable_rows = spark, keep, fanout, memtable_rows
        self.root = root or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]

    def _write(self, df: DataFrame) -> str:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return path

    def flush(self, digests: DataFrame) -> None:
        """Add rows ``(digest, id)`` as sorted runs, one for each memtable."""
        keep, most = self.keep, self.memtable_rows

        def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                if sum(b.num_rows for b in held) >= most:
                    yield from sorted_run(held, keep).to_batches()
                    held = []
            if held:
                yield from sorted_run(held, keep).to_batches()

        rows = digests.select("digest", "id", F.lit(1).cast("long").alias("n"))
        self.levels[0].append(self._write(rows.mapInArrow(memtables, rows.schema)))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._merge(level)
            level += 1

    def _merge(self, level: int) -> None:
        """Merge the sets of runs of a level into one set of the next."""
        best = (F.min if self.keep == "min" else F.max)("id").alias("id")
        runs = self.spark.read.parquet(*self.levels[level]).repartitionByRange("digest")
        merged = runs.groupBy("digest").agg(best, F.sum("n").alias("n")).sortWithinPartitions("digest")
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(self._write(merged))
        self.levels[level] = []

    def compact(self) -> DataFrame:
        """Merge every run: one row ``(digest, keep_id, n)`` per digest."""
        if not any(self.levels):
            raise ValueError("the index is empty: flush first")
        for level in range(len(self.levels)):
            if self.levels[level] and (level + 1 < len(self.levels) or len(self.levels[level]) > 1 or level == 0):
                self._merge(level)
        return self.spark.read.parquet(*self.levels[-1]).select("digest", F.col("id").alias("keep_id"), "n")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest=sha256, root: str | None = None,
) -> DataFrame:
    """One row per document: ``id``, ``digest``, ``keep_id``, ``group_size``, ``kept``."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", digest(F.col("text")).alias("digest"))
    keys = stored(rows.select("id", "digest"))
    index = DigestIndex(docs.sparkSession, root, keep)
    index.flush(keys)
    repeated = index.compact().where("n > 1")
    several = BitmapFilter(repeated, "digest")
    alone = several.probe(keys).where("NOT maybe").select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))

    # Only texts that may have a copy are moved, and written once for the comparison.
    looked = stored(several.probe(rows).where("maybe").join(repeated, "digest", "left").select("id", "text", "digest", "keep_id", F.coalesce("n", F.lit(1)).alias("n")))
    hits = looked.where("n > 1")
    alone = alone.unionByName(looked.where("n = 1").select("id", "digest", F.col("id").alias("keep_id"), "n"))
    # Written before the join: a row per digest, which lets Spark split a large group of copies.
    stays = stored(hits.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("text").alias("keep_text")))
    odd = stored(hits.join(stays, "digest").where(F.col("text") != F.col("keep_text")).select("digest"))
    found = alone.unionByName(hits.select("id", "digest", "keep_id", "n"))
    if not odd.isEmpty():
        # Digests that hold different texts: group their rows by whole texts instead.
        odd = odd.distinct()
        best = (F.min if keep == "min" else F.max)("id").alias("keep_id")
        again = hits.select("digest", "id", "text").join(odd, "digest", "left_semi")
        exact = stored(again.groupBy("digest", "text").agg(best, F.count(F.lit(1)).alias("n")))
        regrouped = again.join(exact, ["digest", "text"]).select("id", "digest", "keep_id", "n")
        found = found.join(odd, "digest", "left_anti").unionByName(regrouped)
    return found.select("id", "digest", "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))
