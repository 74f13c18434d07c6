"""Streaming forms of the trend, keep-last and ingestion operators.

They use the batch expressions; late rows are bounded by watermarks, so state is too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallygrid.operators.checkpoints import keep_last
from tallygrid.sources.file_table import FileTable


def windowed_trend(stream: DataFrame, time: str, measure: str, every: str = "1 day", late: str = "7 days", keys: Sequence[str] = ()) -> DataFrame:
    """``start``, count and mean of a measure per tumbling window (and keys)."""
    timed = stream.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late)
    out = timed.groupBy(F.window("_ts", every).alias("w"), *keys).agg(F.count(F.lit(1)).alias("count"), F.avg(measure).alias(f"{measure}_mean"))
    return out.select(F.col("w.start").alias("start"), *keys, "count", f"{measure}_mean")


def distinct_events(stream: DataFrame, keys: Sequence[str], time: str, late: str = "7 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(list(keys)).drop("_ts")


def read_new_files(spark: SparkSession, path: str, schema: str | T.StructType, format: str = "parquet") -> DataFrame:
    """Files of a folder as a stream: each is taken once."""
    return spark.readStream.schema(schema).format(format).load(path)


def ingest_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that is there now and stop; the next run goes on from there."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def upsert_last(stream: DataFrame, keys: Sequence[str], order: str, table: FileTable, checkpoint: str) -> StreamingQuery:
    """Keep the last row of each key in a table of files: a micro-batch rewrites the files that hold
    one of its keys and adds new keys. The table's manifest notes the batch, so one that runs again
    after a failure changes nothing."""
    name = F.struct(*[F.col(k) for k in keys])

    def later(rows: DataFrame, changes: DataFrame) -> DataFrame:
        met = changes.join(rows.select(*keys), list(keys), "left_semi")
        return keep_last(rows.unionByName(met), keys, [F.col(order)])

    def merge(batch: DataFrame, number: int) -> None:
        note, rows = f"{checkpoint}:{number}", keep_last(batch, keys, [F.col(order)])
        own = FileTable(batch.sparkSession, table.path)  # of the batch's session
        held = own.manifest()
        if held["note"] == note:
            return
        if held["schema"] is None:
            own.append(rows, note)
        else:
            own.merge(rows, name, name, later, lambda fresh: fresh, note)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
