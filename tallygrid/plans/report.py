"""Reports of a profile: numbered CSV files and a workbook."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallygrid.operators.profile import type_counts
from tallygrid.plans.profiler import Profiler
from tallygrid.sources.writers import save_csv, save_workbook

#: Columns with more missing values than so many percent are listed in the summary.
MUCH_MISSING = 20


def summary(profiler: Profiler) -> DataFrame:
    """``item`` and ``value``: columns by level, and columns with many missing values."""
    counts = type_counts(profiler.levels, profiler.df.sparkSession).selectExpr("concat('columns: ', detected_type) AS item", "CAST(n_columns AS DOUBLE) AS value")
    missing = profiler.tables()["01_dataset_profile"].where(f"missing_pct > {MUCH_MISSING}").selectExpr("concat('missing: ', `column`) AS item", "missing_pct AS value")
    return counts.unionByName(missing).orderBy("item")


def write_report(profiler: Profiler, folder: str, workbook: str | None = None) -> list[str]:
    """Write every table that has rows as ``<folder>/<name>.csv``; the names of those written.

    With ``workbook`` the same tables, behind a summary, go to one xlsx file on the driver.
    """
    tables = {name: df.cache() for name, df in profiler.tables().items()}  # small results, written twice
    written = [name for name, df in tables.items() if save_csv(df, f"{folder}/{name}.csv", parts=1)]
    if workbook:
        save_workbook({"Summary": summary(profiler)} | {n: tables[n] for n in written}, workbook, note="Counts and statistics are computed over all rows.")
    for df in tables.values():
        df.unpersist()
    return written
