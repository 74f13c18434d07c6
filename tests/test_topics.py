"""Topic consolidation on hand-made tables, with the reconciliation identity."""

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import topics


@pytest.fixture(scope="module")
def tables(spark):
    t = spark.createDataFrame([(-1, 100), (0, 40), (1, 30), (2, 20), (3, 10), (9, 5)], "Topic int, Count long")
    codes = spark.createDataFrame([
        ("P01", "Skill", "Pragmatic-Ability", [0, 1]), ("P02", "Luck", "Pragmatic-Chance", [1]), ("M01", "Fair", "Moral", [2, 77]), ("G01", "Maps", "Game-Specific", [3]),
    ], "code string, label string, theme string, sources array<int>")
    return t, codes


def test_labels(spark, tables):
    docs = spark.createDataFrame([(1, 1), (2, 0), (3, 9), (4, -1), (5, None)], "doc_id long, Topic int")
    rows = {r["doc_id"]: r for r in topics.label_documents(docs, tables[1]).collect()}
    assert rows[1]["Final_Code"] == "P01; P02" and rows[1]["Category_Theme"] == "Pragmatic-Ability; Pragmatic-Chance"
    assert rows[2]["Final_Label"] == "Skill" and all(rows[i]["Final_Code"] == "Unknown" for i in (3, 4, 5))
    assert topics.theme_counts(topics.label_documents(docs, tables[1]), 1).first()["Category_Theme"] == "Unknown"


def test_totals(tables):
    t, codes = tables
    assert tuple(topics.document_totals(t).first()) == (205, 100, 105)
    rows = {(r["level"], r["theme_group"], r["sub_theme"], r["code"]): r["n_docs"] for r in topics.code_totals(t, codes).collect()}
    assert rows["theme", "Pragmatic", None, None] == 100 and rows["theme", "Game-Specific", None, None] == 10
    assert rows["total", None, None, None] == 130 and rows["code", "Moral", "Moral", "M01"] == 20
    assert [tuple(r) for r in topics.overlap(t, codes).collect()] == [(1, 2, 30, 30)]
    assert [r["Topic"] for r in topics.unassigned(t, codes).collect()] == [9]
    r = topics.reconciliation(t, codes).first()
    assert r["reconciles"] and r["grand_total"] == 105 - 5 + 30 and r["topics_missing"] == 1
    plan = topics.consolidation_plan(t, codes)
    assert "Reconciles: yes" in plan and "| 1 | 2 | 30 |" in plan


def test_no_outliers(tables):
    t, codes = tables
    r = topics.reconciliation(t.where("Topic >= 0"), codes).first()
    assert r["outlier_docs"] == 0 and r["reconciles"]


def test_groups(spark):
    groups = spark.createDataFrame([("['Skill']", "3, 17, -1"), (None, "4"), ("Empty", "none")], "final_topic_label string, member_topics string")
    assert [tuple(r) for r in topics.merged_topics(groups).collect()] == [("Skill", [3, 17, -1])]
    independent = spark.createDataFrame([(17,), (5,), (None,)], "topic_id int")
    assert [r[0] for r in topics.listed_twice(groups, independent).collect()] == [17]


def test_outliers_are_classified_again(spark):
    docs = spark.createDataFrame([(i, i % 4) for i in range(20)], "doc_id long, hard int")

    def answer(rows, attempt):
        return rows.withColumn("topic", F.when(F.col("hard") <= attempt, "known").otherwise("made up"))

    done = {r["doc_id"]: r for r in topics.classify_with_retry(docs, answer, ["known"], 2).collect()}
    assert len(done) == 20 and all(done[i]["attempts"] == min(i % 4, 2) + 1 and done[i]["valid_topic"] == (i % 4 < 3) for i in done)
    assert topics.classify_with_retry(docs.where("false"), answer, ["known"]).count() == 0
    assert topics.outlier_documents(docs).count() == 20
    assert spark.range(1).select(topics.valid_topic(F.lit(" MANUAL "), [])).first()[0]
