"""Text summaries and n-gram tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygrid.functions.text import bigrams, tokens, word_count
from tallygrid.operators.heavy_items import top_items


def text_summary(df: DataFrame, column: str, stopwords: Sequence[str] = ()) -> DataFrame:
    """``avg_word_count``, ``vocab_size`` and ``total_docs`` of the non-null texts."""
    texts = df.select(F.col(f"`{column}`").cast("string").alias("t")).where("t IS NOT NULL")
    totals = texts.agg(F.round(F.avg(word_count(F.col("t"))), 2).alias("avg_word_count"), F.count(F.lit(1)).alias("total_docs"))
    vocabulary = texts.select(F.explode(tokens(F.col("t"), stopwords)).alias("w")).groupBy("w").agg(F.lit(1).alias("one")).agg(F.count("one").alias("vocab_size"))
    return totals.crossJoin(F.broadcast(vocabulary)).select("avg_word_count", "vocab_size", "total_docs")  # one row each


def ngrams(column: str, n: int = 1, stopwords: Sequence[str] = ()) -> Column:
    """The words of a text, or its pairs of neighbouring words left by the stop words."""
    words = tokens(F.col(f"`{column}`").cast("string"), stopwords)
    return words if n == 1 else bigrams(words)


def ngram_counts(df: DataFrame, column: str, n: int = 1, stopwords: Sequence[str] = ()) -> DataFrame:
    """``item`` and ``count`` of all words, or of all pairs of neighbouring words."""
    # Pairs name the words several times, so these are a column of their own, made once.
    words = df.select(ngrams(column, 1, stopwords).alias("w"))
    return words.select(F.explode("w" if n == 1 else bigrams(F.col("w"))).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("count"))


def top_ngrams(df: DataFrame, column: str, n: int = 1, top_n: int = 10, stopwords: Sequence[str] = ()) -> DataFrame:
    """The ``top_n`` most frequent, ties by item; only items that can be among them are counted."""
    words = df.select(ngrams(column, 1, stopwords).alias("w"))
    return top_items(words, F.col("w") if n == 1 else bigrams(F.col("w")), top_n)


def text_analysis(df: DataFrame, columns: Sequence[str], top_n: int = 10, stopwords: Sequence[str] = ()) -> DataFrame:
    """Summary, word and word-pair rows of text columns (C3): ``column``, ``type``, ``item``, ``count``."""
    parts = []
    for c in columns:
        s = text_summary(df, c, stopwords)
        rows = F.array(*[F.struct(F.lit(k).alias("item"), F.col(k).cast("double").alias("count")) for k in ("avg_word_count", "vocab_size", "total_docs")])
        parts.append(s.select(F.lit(c).alias("column"), F.lit("summary").alias("type"), F.explode(rows).alias("r")).select("column", "type", "r.item", "r.count"))
        for n, kind in ((1, "unigram"), (2, "bigram")):
            parts.append(top_ngrams(df, c, n, top_n, stopwords).select(F.lit(c).alias("column"), F.lit(kind).alias("type"), "item", F.col("count").cast("double")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def top_per_column(counts: DataFrame, column: str, top_n: int) -> DataFrame:
    """The ``top_n`` rows by ``count`` of each value of ``column``."""
    order = Window.partitionBy(column).orderBy(F.desc("count"), "item")
    return counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_n).drop("_r")
