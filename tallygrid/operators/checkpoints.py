"""Per-subject checkpoints: merge, retry, review and coverage
(U1, U2, U6, W3, X2, X3, X8, X9, X12, X13, J3, J6-J9, J11, E18, E24-E28, C8, P2-P4, P7, P12, P13).

A checkpoint is a table with key columns, a file column, analysis fields and ``ok``. Everything
is a join, an anti join or a group-by on keys; nothing but lists of problems reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygrid.functions.text import slashes
from tallygrid.sources.file_table import FileTable

#: Failed rows are retried so often, and results below this share of a subject need a look.
MOST_RETRIES, GOOD_COVERAGE = 3, 0.9


def source_columns(id_cols: Sequence[str], file_col: str, extra: Sequence[str] = ()) -> list[str]:
    """Key columns in order, each once, the file column always among them."""
    return list(dict.fromkeys([*id_cols, file_col, *extra]))


def reordered(df: DataFrame, source: Sequence[str], fields: Sequence[str], trailing: Sequence[str] = ("raw_json", "model_ok")) -> DataFrame:
    """Source columns, analysis fields, others, trailing columns."""
    first = [c for c in dict.fromkeys([*source, *fields]) if c in df.columns]
    last = [c for c in trailing if c in df.columns and c not in first]
    return df.select(*first, *[c for c in df.columns if c not in first and c not in last], *last)


def column_order_issues(columns: Sequence[str], expected: Sequence[str]) -> list[str]:
    """What is wrong with the order of a checkpoint's columns."""
    issues = [f"missing column: {c}" for c in expected if c not in columns]
    issues += [f"duplicate column: {c}" for c in dict.fromkeys(columns) if list(columns).count(c) > 1]
    common = [c for c in dict.fromkeys(columns) if c in expected]
    if common != [c for c in expected if c in columns]:
        issues.append("columns out of order")
    return issues


class MergeError(ValueError):
    """Everything that keeps checkpoints from being merged."""

    def __init__(self, problems: Sequence[str]):
        super().__init__("; ".join(problems))
        self.problems = list(problems)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the last by ``order``.

    The latest row is a maximum, which combines before the shuffle; no window is needed.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("_o"), row.alias("_row"))
    return best.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.max_by("_row", "_o").alias("_row")).select("_row.*")


def merge_checkpoints(parts: Mapping[str, DataFrame], keys: Sequence[str], order: Sequence[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """All checkpoints as one table and the ``removed`` count (X2, U1): the last row of a key,
    by name of the checkpoint and then by ``order`` (for files ``_metadata.file_path`` and
    ``_metadata.row_index``; without it by Spark's order of reading), stays. Raises :class:`MergeError` with every problem at once."""
    names = sorted(n for n in parts if not n.startswith("_"))
    problems = [] if names else ["no checkpoints"]
    first = parts[names[0]].columns if names else []
    for n in names:
        columns = parts[n].columns
        if len(set(columns)) < len(columns):
            problems.append(f"{n}: duplicate column names")
        elif columns != first:
            problems.append(f"{n}: columns differ from {names[0]}")
        problems += [f"{n}: no key column {k}" for k in keys if k not in columns]
    if problems:
        raise MergeError(problems)
    rows = reduce(DataFrame.union, [parts[n].withColumn("_part", F.lit(n)).withColumn("_at", F.struct(*order) if order else F.monotonically_increasing_id()) for n in names])
    kept = keep_last(rows, keys, [F.col("_part"), F.col("_at")]).drop("_part", "_at")
    counts = rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(rows.select(*keys).distinct().agg(F.count(F.lit(1)).alias("k")))  # single rows
    return kept, counts.select((F.col("n") - F.col("k")).alias("removed"))


def merge_lenient(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items not yet done."""
    return items.join(done.select(F.col(key)).distinct(), key, "left_anti")


def requested(items: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """Items of the requested subjects."""
    return items.join(subjects.select(F.col(key)).distinct(), key, "left_semi")


def live_jobs(log: DataFrame, terminal: Sequence[str] = ("JOB_STATE_SUCCEEDED", "JOB_STATE_FAILED", "JOB_STATE_CANCELLED", "JOB_STATE_EXPIRED"), prefix: str = "") -> DataFrame:
    """Jobs that have not ended, by prefix of their name."""
    return log.where(~F.coalesce("state", F.lit("")).isin(list(terminal)) & F.col("job_name").startswith(prefix))


def join_results(source: DataFrame, results: DataFrame, file_col: str, fields: Sequence[str]) -> DataFrame:
    """Source rows with the model's fields by normalised path (J3, N7); rows without a result
    have blanks and ``model_ok`` false. ``results`` has ``path`` and ``fields``, a map."""
    found = results.select(slashes(F.col("path")).alias("_path"), F.col("fields").alias("_fields")).groupBy("_path").agg(F.max_by("_fields", F.size("_fields")).alias("_fields"))
    joined = source.join(found, slashes(F.col(file_col)) == F.col("_path"), "left")
    return joined.select(*source.columns, *[F.coalesce(F.try_element_at("_fields", F.lit(f)), F.lit("")).alias(f) for f in fields], F.col("_fields").isNotNull().alias("model_ok"))


def retryable(df: DataFrame, most: int = MOST_RETRIES) -> DataFrame:
    """Failed rows with retries left."""
    return df.where(~F.coalesce("model_ok", F.lit(False)) & (F.coalesce("retry_count", F.lit(0)) < most))


def exhausted(df: DataFrame, most: int = MOST_RETRIES) -> DataFrame:
    """Failed rows without retries left."""
    return df.where(~F.coalesce("model_ok", F.lit(False)) & (F.coalesce("retry_count", F.lit(0)) >= most))


def apply_retries(checkpoint: DataFrame, retries: DataFrame, file_col: str, fields: Sequence[str]) -> DataFrame:
    """A checkpoint with retry results (J6, X9): ``retry_count`` grows for every matched row,
    fields change only where the retry is ok. ``retries`` has one row per path."""
    again = retries.select(slashes(F.col(file_col)).alias("_path"), F.col("model_ok").alias("_ok"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = checkpoint.join(again, slashes(F.col(file_col)) == F.col("_path"), "left")
    matched, good = F.col("_path").isNotNull(), F.coalesce("_ok", F.lit(False))
    changed = {f: F.when(good, F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}
    changed["model_ok"] = F.when(good, F.lit(True)).otherwise(F.col("model_ok"))
    changed["retry_count"] = F.when(matched, F.coalesce("retry_count", F.lit(0)) + 1).otherwise(F.col("retry_count"))
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in checkpoint.columns])


def merge_retries(table: FileTable, retries: DataFrame, file_col: str, fields: Sequence[str]) -> dict[str, int]:
    """:func:`apply_retries` on a table of files: only files with a retried row are rewritten."""
    path = slashes(F.col(file_col))
    return table.merge(retries, path, path, lambda rows, changes: apply_retries(rows, changes, file_col, fields))


def not_blank(x: Column) -> Column:
    """Neither null nor white space."""
    return F.coalesce(F.trim(x.cast("string")) != "", F.lit(False))


def row_issues(rules: Mapping[str, Column]) -> Column:
    """Messages of the rules that a row breaks (P13); a rule is true where the row is wrong."""
    return F.filter(F.array(*[F.when(rule, F.lit(message)) for message, rule in rules.items()]), lambda m: m.isNotNull())


def outcome_counts(df: DataFrame, subject: str = "subject", ok: str = "ok") -> DataFrame:
    """Good, failed and all rows per subject and in total (E18); the total has a null subject."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return df.rollup(subject).agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"), F.count(F.lit(1)).alias("total"))


def field_coverage(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field``, ``n_filled`` and ``pct``."""
    filled = F.array(*[F.struct(F.lit(f).alias("field"), not_blank(F.col(f)).alias("filled")) for f in fields])
    return df.select(F.explode(filled).alias("f")).groupBy("f.field").agg(F.count_if("f.filled").alias("n_filled"), F.round(F.count_if("f.filled") * 100.0 / F.count(F.lit(1)), 2).alias("pct"))


def score_distribution(df: DataFrame, suffix: str = "_score") -> DataFrame:
    """Mean, median and number of the readable values of score columns."""
    scores = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).try_cast("double").alias("v")) for c in df.columns if c.endswith(suffix)])
    values = df.select(F.explode(scores).alias("s")).select("s.*").where("v IS NOT NULL AND NOT isnan(v)")
    return values.groupBy("field").agg(F.round(F.avg("v"), 4).alias("mean"), F.round(F.percentile("v", F.lit(0.5)), 4).alias("median"), F.count(F.lit(1)).alias("n"))


def review(df: DataFrame, fields: Sequence[str], subject: str = "subject", least_ok: float = 90.0) -> DataFrame:
    """Totals and issues per subject (E26): ``total``, ``ok_count``, ``ok_pct``, ``issues``."""
    good = F.coalesce("model_ok", F.lit(False))
    counts = df.groupBy(subject).agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("ok_count"), *[F.count_if(good & ~not_blank(F.col(f))).alias(f"_{f}") for f in fields])
    share = F.round(F.col("ok_count") * 100.0 / F.col("total"), 2)
    rules = {"no good rows": F.col("ok_count") == 0, f"under {least_ok:g} % good": share < least_ok} | {f"blank {f} in good rows": F.col(f"_{f}") > 0 for f in fields}
    return counts.select(subject, "total", "ok_count", share.alias("ok_pct"), row_issues(rules).alias("issues"))


def blocked(reviewed: DataFrame, fix: bool = False) -> bool:
    """Whether issues keep a merge from running."""
    return not fix and not reviewed.where(F.size("issues") > 0).isEmpty()


def coverage(expected: DataFrame, results: DataFrame, subject: str, key: str, least: float = 0.0) -> DataFrame:
    """Share of a subject's rows with results (E27) and the step to take: skip, warn or write."""
    found = results.select(subject, key).distinct().withColumn("_found", F.lit(1))
    share = F.col("found") / F.col("expected")
    out = expected.select(subject, key).distinct().join(found, [subject, key], "left").groupBy(subject).agg(F.count(F.lit(1)).alias("expected"), F.count("_found").alias("found"))
    return out.select(subject, "expected", "found", F.round(share, 4).alias("coverage"), F.when(share < least, "skip").when(share < GOOD_COVERAGE, "warn").otherwise("write").alias("step"))


def retry_summary(df: DataFrame, subject: str = "subject", most: int = MOST_RETRIES) -> DataFrame:
    """Retryable and exhausted rows per subject and in total."""
    bad = ~F.coalesce("model_ok", F.lit(False))
    spent = F.coalesce("retry_count", F.lit(0)) >= most
    return df.rollup(subject).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(bad & ~spent).alias("retryable"), F.count_if(bad & spent).alias("exhausted"),
        F.round(F.count_if(bad) * 100.0 / F.count(F.lit(1)), 2).alias("error_pct"),
    )


def remaining_uris(uri_map: DataFrame, good_paths: DataFrame) -> DataFrame:
    """Uploaded files that still have no good result (X12): exploded (subject, path, uri) rows."""
    return uri_map.join(good_paths.select("subject", "path").distinct(), ["subject", "path"], "left_anti")
