"""Topic consolidation.

Tables: ``topics`` (Topic, Count; -1 holds the outliers), ``merge_groups`` (final_topic_label,
member_topics), ``independent`` (topic_id) and ``codes`` (code, label, theme, sources).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.text import integers, undecorated

OUTLIER = -1
UNKNOWN, MANUAL = "Unknown", "MANUAL"


def merged_topics(merge_groups: DataFrame) -> DataFrame:
    """``label`` and ``members`` of groups that have both."""
    found = merge_groups.select(undecorated(F.col("final_topic_label").cast("string")).alias("label"), integers(F.coalesce(F.col("member_topics").cast("string"), F.lit(""))).alias("members"))
    return found.where("label <> '' AND size(members) > 0")


def listed_twice(merge_groups: DataFrame, independent: DataFrame) -> DataFrame:
    """Topics both merged and independent (U4)."""
    return merged_topics(merge_groups).select(F.explode("members").alias("topic_id")).intersect(independent.select(F.col("topic_id").cast("int")))


def assignments(codes: DataFrame) -> DataFrame:
    """One row per topic and code (N6): ``topic_id``, ``code``, ``label``, ``theme``."""
    return codes.select(F.explode("sources").alias("topic_id"), "code", "label", "theme").distinct()


def topic_map(codes: DataFrame) -> DataFrame:
    """``topic_id`` with ordered arrays of ``codes``, ``labels`` and ``themes``."""
    item = F.struct("code", "label", "theme")
    grouped = assignments(codes).groupBy("topic_id").agg(F.array_sort(F.collect_set(item)).alias("a"))
    return grouped.select("topic_id", F.col("a.code").alias("codes"), F.transform("a", lambda x: F.coalesce(x["label"], x["code"])).alias("labels"), F.array_distinct("a.theme").alias("themes"))


def label_documents(docs: DataFrame, codes: DataFrame, topic: str = "Topic") -> DataFrame:
    """Documents with ``Final_Code``, ``Final_Label`` and ``Category_Theme`` (J1, J2); several
    are joined by a semicolon, topics without any are Unknown.

    The mapping has a row per topic; Spark broadcasts it while it is small, and otherwise
    shuffles it with the documents.
    """
    mapped = topic_map(codes).select(F.col("topic_id").alias("_topic"), *[F.array_join(c, "; ").alias(f"_{c}") for c in ("codes", "labels", "themes")])
    joined = docs.join(mapped, docs[topic] == F.col("_topic"), "left")
    return joined.select(*[docs[c] for c in docs.columns], *[F.coalesce(f"_{c}", F.lit(UNKNOWN)).alias(name) for c, name in (("codes", "Final_Code"), ("labels", "Final_Label"), ("themes", "Category_Theme"))])


def document_totals(topics: DataFrame) -> DataFrame:
    """``total_docs``, ``outlier_docs`` and ``non_outlier_docs``."""
    n = F.coalesce(F.sum("Count"), F.lit(0))
    out = F.coalesce(F.sum(F.when(F.col("Topic") == OUTLIER, F.col("Count"))), F.lit(0))
    return topics.agg(n.cast("long").alias("total_docs"), out.cast("long").alias("outlier_docs"), (n - out).cast("long").alias("non_outlier_docs"))


def counted(topics: DataFrame, codes: DataFrame) -> DataFrame:
    """Assignments with the documents of their topics; unknown topics count 0."""
    a = assignments(codes)
    known = topics.where(F.col("Topic") != OUTLIER).select(F.col("Topic").alias("topic_id"), "Count")
    return a.join(known, "topic_id", "left").na.fill({"Count": 0})


def theme_group(theme: Column, whole: Sequence[str] = ()) -> Column:
    """The theme above a sub-theme: the part before the hyphen, unless the name is ``whole``."""
    return F.when(theme.isin(list(whole)), theme).otherwise(F.trim(F.split_part(theme, F.lit("-"), F.lit(1)))) if whole else F.trim(F.split_part(theme, F.lit("-"), F.lit(1)))


def code_totals(topics: DataFrame, codes: DataFrame, whole: Sequence[str] = ("Game-Specific",)) -> DataFrame:
    """Documents per code with subtotals per sub-theme and theme and a grand total (E20);
    ``level`` says which: code, sub_theme, theme or total."""
    per_code = counted(topics, codes).select(theme_group(F.col("theme"), whole).alias("theme_group"), F.col("theme").alias("sub_theme"), "code", "Count")
    depth = F.grouping_id()
    level = F.when(depth == 0, "code").when(depth == 1, "sub_theme").when(depth == 3, "theme").otherwise("total")
    return per_code.rollup("theme_group", "sub_theme", "code").agg(level.alias("level"), F.sum("Count").cast("long").alias("n_docs"), F.count(F.lit(1)).alias("n_sources"))


def overlap(topics: DataFrame, codes: DataFrame) -> DataFrame:
    """Topics in several codes, largest first (E21, T3): ``topic_id``, ``n_codes``, ``Count``, ``extra_docs``."""
    found = counted(topics, codes).groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_codes"), F.max("Count").cast("long").alias("Count")).where("n_codes > 1")
    return found.withColumn("extra_docs", F.col("Count") * (F.col("n_codes") - 1)).orderBy(F.desc("Count"), "topic_id")


def unassigned(topics: DataFrame, codes: DataFrame) -> DataFrame:
    """Topics in no code, without the outliers."""
    return topics.where(F.col("Topic") != OUTLIER).join(assignments(codes).select(F.col("topic_id").alias("Topic")), "Topic", "left_anti")


def reconciliation(topics: DataFrame, codes: DataFrame) -> DataFrame:
    """The identity non-outlier + overlap = grand total, less what no code takes."""
    grand = counted(topics, codes).agg(F.coalesce(F.sum("Count"), F.lit(0)).cast("long").alias("grand_total"))
    extra = overlap(topics, codes).agg(F.coalesce(F.sum("extra_docs"), F.lit(0)).cast("long").alias("overlap_docs"))
    missing = unassigned(topics, codes).agg(F.coalesce(F.sum("Count"), F.lit(0)).cast("long").alias("unassigned_docs"), F.count(F.lit(1)).alias("topics_missing"))
    one_row = document_totals(topics).crossJoin(grand).crossJoin(extra).crossJoin(missing)  # single rows
    return one_row.withColumn("reconciles", F.col("non_outlier_docs") - F.col("unassigned_docs") + F.col("overlap_docs") == F.col("grand_total"))


def theme_counts(labelled: DataFrame, top_n: int = 10) -> DataFrame:
    """The most frequent themes of labelled documents."""
    return labelled.groupBy("Category_Theme").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "Category_Theme").limit(top_n)


def outlier_documents(docs: DataFrame, topic: str = "Topic") -> DataFrame:
    """The documents without a topic, or all if there is no topic column (P10)."""
    return docs.where(F.col(topic) == OUTLIER) if topic in docs.columns else docs


def valid_topic(topic: Column, valid: Sequence[str]) -> Column:
    """Whether an answer is a known topic or asks for manual work."""
    return F.coalesce(F.trim(topic).isin([*valid, MANUAL]), F.lit(False))


def classify_with_retry(docs: DataFrame, classify: Callable[[DataFrame, int], DataFrame], valid: Sequence[str], retries: int = 3) -> DataFrame:
    """Classify, and again where the answer is no valid topic, at most ``retries`` more times.

    ``classify(rows, attempt)`` adds a ``topic`` column. The last answer is kept, with
    ``attempts`` and ``valid_topic``. Each round's rows are cut off by a checkpoint, so no
    answer is asked for twice.
    """
    done, left = None, docs
    for attempt in range(retries + 1):
        answered = classify(left, attempt).withColumn("attempts", F.lit(attempt + 1)).withColumn("valid_topic", valid_topic(F.col("topic"), valid)).checkpoint()
        good = answered if attempt == retries else answered.where("valid_topic")
        done = good if done is None else done.unionByName(good)
        left = answered.where(~F.col("valid_topic")).select(*docs.columns)
        if attempt < retries and left.isEmpty():
            break
    return done


#: Rows of the plan's first table, in order.
PLAN_TOTALS = ("total_docs", "outlier_docs", "non_outlier_docs", "overlap_docs", "unassigned_docs", "grand_total")


def plan_lines(topics: DataFrame, codes: DataFrame) -> DataFrame:
    """The consolidation as lines of Markdown in order (K7): ``section``, ``k1`` to ``k3`` (what
    orders a section's lines) and ``line``. Lines are made where their rows are, so a plan of any
    number of topics is written like any table."""

    def n(c: str) -> Column:
        return F.format_number(c, 0)

    def fixed(section: int, k1: int, line: Column | str) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(f"{k1:06}").alias("k1"), F.lit("").alias("k2"), F.lit("").alias("k3"), (F.lit(line) if isinstance(line, str) else line).alias("line"))

    head = [fixed(0, i, x) for i, x in enumerate(["# Topic consolidation", "", "| Documents | n |", "|---|---:|"])]
    head += [fixed(1, i, F.concat(F.lit(f"| {c.replace('_', ' ')} | "), n(c), F.lit(" |"))) for i, c in enumerate(PLAN_TOTALS)]
    told = F.concat(F.lit("Reconciles: "), F.when(F.col("reconciles"), "yes").otherwise("no"), F.lit("; topics missing: "), F.col("topics_missing").cast("string"))
    head += [fixed(2, i, x) for i, x in enumerate(["", told, "", "| Theme | Sub-theme | Code | Documents |", "|---|---|---|---:|"])]
    head += [fixed(4, i, x) for i, x in enumerate(["", "| Topic in several codes | Codes | Documents |", "|---|---:|---:|"])]
    first = reconciliation(topics, codes).select(F.explode(F.array(*head)).alias("l")).select("l.*")
    # Totals come behind what they sum: a null sorts last.
    parts = [F.coalesce(F.concat(F.lit("0"), c), F.lit("1")).alias(f"k{i}") for i, c in enumerate(("theme_group", "sub_theme", "code"), 1)]
    cells = F.concat(F.lit("| "), F.coalesce("theme_group", F.lit("Total")), F.lit(" | "), F.coalesce("sub_theme", F.lit("")), F.lit(" | "), F.coalesce("code", F.lit("")), F.lit(" | "), n("n_docs"), F.lit(" |"))
    second = code_totals(topics, codes).select(F.lit(3).alias("section"), *parts, cells.alias("line"))
    # Largest first: the number of nines less the count sorts as text.
    largest = F.lpad((F.lit(10**18 - 1) - F.col("Count")).cast("string"), 18, "0")
    row = F.concat(F.lit("| "), F.col("topic_id").cast("string"), F.lit(" | "), F.col("n_codes").cast("string"), F.lit(" | "), n("Count"), F.lit(" |"))
    third = overlap(topics, codes).select(F.lit(5).alias("section"), largest.alias("k1"), F.lpad(F.col("topic_id").cast("string"), 20, "0").alias("k2"), F.lit("").alias("k3"), row.alias("line"))
    return first.unionByName(second).unionByName(third)


def consolidation_plan(topics: DataFrame, codes: DataFrame) -> str:
    """The lines of :func:`plan_lines` as one text, for plans that a person reads."""
    lines = plan_lines(topics, codes).orderBy("section", "k1", "k2", "k3").select("line")
    return "\n".join(r[0] for r in lines.toLocalIterator()) + "\n"
