"""Writers (K1-K9)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallygrid.operators.checkpoints import not_blank
from tallygrid.sources.atomic_lines import AtomicLines
from tallygrid.sources.xlsx import workbook

#: A sheet holds so many rows; larger tables belong in Parquet.
SHEET_ROWS = 1_048_575


#: Rows of one CSV file: a reader that allows line breaks in fields reads a file in one task.
CSV_ROWS = 1_000_000


def save_csv(df: DataFrame, path: str, parts: int | None = None, rows: int = CSV_ROWS) -> bool:
    """A table as CSV with a header, quotes doubled (K1); an empty one is not written.

    The frame's partitions are written side by side, in files of at most ``rows`` rows that each have
    the header. ``parts`` brings a small result table into so many partitions, usually one.
    """
    if df.isEmpty():
        return False
    made = df if parts is None else df.coalesce(parts)
    made.write.mode("overwrite").option("header", True).option("escape", '"').option("maxRecordsPerFile", rows).csv(path)
    return True


def write_subjects(df: DataFrame, path: str, subject: str = "subject") -> None:
    """Checkpoints, one partition per subject; only the subjects at hand are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(subject).parquet(path)


def write_merged(df: DataFrame, path: str) -> None:
    """A merged table (K5, K9); Spark's committer makes it appear whole."""
    df.write.mode("overwrite").parquet(path)


def write_lines(df: DataFrame, path: str, line: str = "line") -> None:
    """JSON lines (K6)."""
    df.select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def write_lines_whole(df: DataFrame, path: str, line: str = "line", append: bool = False) -> None:
    """JSON lines that appear all together or not at all (K5, K6)."""
    df.sparkSession.dataSource.register(AtomicLines)
    df.select(F.col(line).alias("value")).write.format(AtomicLines.name()).mode("append" if append else "overwrite").save(path)


def read_lines_whole(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines that :func:`write_lines_whole` committed last."""
    spark.dataSource.register(AtomicLines)
    return spark.read.format(AtomicLines.name()).load(path)


def observed_write(df: DataFrame, path: str, fields: Sequence[str] = (), subjects: Sequence[str] = (), subject: str = "subject", ok: str = "ok") -> dict[str, dict]:
    """Write a checkpoint and count it meanwhile (E18, E24, E27): the rows are not read again.

    ``total``: ``ok``, ``failed`` and ``total``; ``fields``: per field the ``n_filled`` and ``pct`` of
    :func:`field_coverage`; ``subjects``: the same counts for each subject asked for. The metrics are
    of the stage that writes, so a task that runs again is counted once.
    """
    good, metrics = F.coalesce(F.col(ok), F.lit(False)), {"total": F.lit(True)} | {f"s{i}": F.col(subject).eqNullSafe(s) for i, s in enumerate(subjects)}
    wanted = [F.count_if(where & good).alias(f"{name}_ok") for name, where in metrics.items()] + [F.count_if(where).alias(f"{name}_all") for name, where in metrics.items()]
    seen = Observation()
    df.observe(seen, *wanted, *[F.count_if(not_blank(F.col(f))).alias(f"f{i}") for i, f in enumerate(fields)]).write.mode("overwrite").parquet(path)
    got = seen.get

    def outcome(name: str) -> dict[str, int]:
        return {"ok": got[f"{name}_ok"], "failed": got[f"{name}_all"] - got[f"{name}_ok"], "total": got[f"{name}_all"]}

    n = got["total_all"]
    return {
        "total": outcome("total"), "subjects": {s: outcome(f"s{i}") for i, s in enumerate(subjects)},
        "fields": {f: {"n_filled": got[f"f{i}"], "pct": round(got[f"f{i}"] * 100.0 / n, 2) if n else None} for i, f in enumerate(fields)}}


def save_workbook(tables: Mapping[str, DataFrame], path: str, note: str | None = None, widest: int = 40) -> None:
    """Small result tables as one workbook (K2, K3); a table beyond a sheet's rows is refused."""
    sheets = {}
    for name, df in tables.items():
        rows = df.limit(SHEET_ROWS + 1).collect()
        if len(rows) > SHEET_ROWS:
            raise ValueError(f"{name} has more rows than a sheet holds")
        sheets[name] = (df.columns, [[v if isinstance(v, (int, float, type(None))) else str(v) for v in r] for r in rows])
    with open(path, "wb") as f:
        f.write(workbook(sheets, note, widest))


def rewrite_log(df: DataFrame, path: str) -> None:
    """A small log in place of the old one (K8); its rows are read before they are replaced."""
    spark, rows = df.sparkSession, df.collect()
    spark.createDataFrame(rows, df.schema).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
