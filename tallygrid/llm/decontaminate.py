"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item becomes windows of ``window`` consecutive words (an item of fewer words is
one window). A document word is hit if it lies inside any occurrence of a window.

* Tokens are shingles of up to ``shingle`` consecutive words. One pass over all documents
  counts the occurrences of the shingles that the benchmark has: the rarity order.
* Exact containment of a window allows no missing token, so the necessary prefix of its tokens
  in rarity order is one token long: its rarest shingle, at a known offset.
* Document shingles join the prefix tokens. The positional bound (the window must start at or
  after the first word) and the length bound (it must end within the document) come from the
  offset and the length; what passes is verified word for word.

Documents are never shuffled: the join with the prefix tokens and the verification run inside
the scan, in one generated stage. The benchmark side is broadcast only where its windows and
item ids take at most ``broadcast_bytes``; beyond, the same join shuffles 8-byte tokens with document ids
and positions, and verification meets the words again by document.

Edge cases: a null or empty text has no words; a null or empty item has no windows; items with
equal words are all counted; rows with equal id and text are one document and each gets its
result; null document ids are allowed; an empty benchmark leaves every document clean. Columns
other than id and text are never read by the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygrid.llm._common import ascii_lower, cut

#: What separates words once A-Z are in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows_of(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: ``win`` (array of words) and ``items`` (ids of the items that have it)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return (
        items.select("item", "w", F.explode(starts).alias("s"))
        .select("item", F.slice("w", F.col("s") + 1, window).alias("win"))
        .groupBy("win").agg(F.collect_set("item").alias("items"))
    )


def shingle_key(words: Column, at: Column, size: Column, shingle: int) -> Column:
    """A 64-bit key of up to ``shingle`` words from position ``at`` (from 0) on."""
    return F.xxhash64(*[F.when(F.lit(k) < size, F.get(words, at + k)) for k in range(shingle)])


def find_windows(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 10, shingle: int = 3, broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """Occurrences of benchmark windows: ``id``, ``h`` (hash of the text), ``start``, ``len``, ``items``."""
    windows = cut(windows_of(benchmark, item_col, item_text_col, window).withColumn("len", F.size("win")))
    held = F.octet_length(F.array_join("win", " ")) + F.octet_length(F.array_join("items", ",")) + 64
    small = (windows.agg(F.sum(held.cast("long"))).first()[0] or 0) <= broadcast_bytes
    hint = F.broadcast if small else (lambda df: df)

    # A window's shingles; windows shorter than a shingle are one shingle of their length.
    size = F.least(F.col("len"), F.lit(shingle))
    spots = windows.select(
        "win", "items", "len", size.alias("size"), F.explode(F.sequence(F.lit(0), F.col("len") - size)).alias("offset")
    ).withColumn("key", shingle_key(F.col("win"), F.col("offset"), F.col("size"), shingle))
    sizes = sorted(r["size"] for r in spots.select("size").distinct().collect())  # at most `shingle` numbers
    wanted = spots.select("key").distinct()

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), words_of(F.col(text_col)).alias("w"))
    at = rows.select("id", "h", "w", F.posexplode("w").alias("p", "word"))
    # The first word of a shingle is the exploded one; the others are read from the array.
    keyed = at.select("id", "h", "w", "p", F.explode(F.array(*[
        F.when(F.col("p") + s <= F.size("w"), F.xxhash64("word", *[F.get("w", F.col("p") + k) if k < s else F.lit(None).cast("string") for k in range(1, shingle)]))
        for s in sizes])).alias("key")) if len(sizes) > 1 else at.select("id", "h", "w", "p", F.xxhash64(
            "word", *[F.get("w", F.col("p") + k) for k in range(1, sizes[0] if sizes else 1)],
            *[F.lit(None).cast("string")] * (shingle - (sizes[0] if sizes else 1))).alias("key"))

    counts = keyed.select("key").join(hint(wanted), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("win").orderBy("n", "offset")
    prefix = cut(
        spots.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("place", F.row_number().over(rarest)).where("place = 1 AND n > 0")
        .select("key", "offset", "win", "len", "items")
    )
    start = F.col("p") - F.col("offset")
    bounds = (start >= 0) & (start + F.col("len") <= F.size("w"))
    if small:
        found = keyed.join(F.broadcast(prefix), "key").where(bounds).where(F.slice("w", start + 1, F.col("len")) == F.col("win"))
        return found.select("id", "h", start.alias("start"), "len", "items")
    near = keyed.select("id", "h", "p", F.size("w").alias("n_words"), "key").join(prefix, "key")
    near = near.where((start >= 0) & (start + F.col("len") <= F.col("n_words"))).select("id", "h", start.alias("start"), "len", "win", "items")
    both = near.alias("a").join(rows.dropDuplicates(["id", "h"]).alias("r"), (F.col("a.h") == F.col("r.h")) & F.col("a.id").eqNullSafe(F.col("r.id")))
    return both.where(F.slice("w", F.col("start") + 1, F.col("len")) == F.col("win")).select("a.id", "a.h", "start", "len", "items")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: Sequence[str] | None = None, **kwargs,
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (struct of ``columns``, by default of all),
    ``n_words``, ``n_hit`` and ``items`` (sorted ids, as strings, of the items with occurring
    windows)."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row"),
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"),
        F.size(words_of(F.col(text_col))).cast("long").alias("n_words"),
    )
    hits = find_windows(docs, benchmark, id_col, text_col, **kwargs)
    # Rows with equal id and text give the same occurrences more than once.
    spans = hits.groupBy("id", "h", "start").agg(F.max("len").alias("len"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    so_far = Window.partitionBy("id", "h").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reached", F.coalesce(F.max(F.col("start") + F.col("len")).over(so_far), F.lit(0)))
    new = F.greatest(F.col("start") + F.col("len") - F.greatest("start", "reached"), F.lit(0))
    found = spans.groupBy("id", "h").agg(F.sum(new).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return (
        rows.alias("r").join(found.alias("f"), (F.col("r.h") == F.col("f.h")) & F.col("r.id").eqNullSafe(F.col("f.id")), "left")
        .select("row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kwargs) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    return contamination(docs, benchmark, **kwargs).where("n_hit = 0").select("row.*")
