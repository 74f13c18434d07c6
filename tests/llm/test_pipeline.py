"""The stages one after another, and the SQL of the operators."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tallygrid.llm import queries as q
from tests.llm.test_resemblance import slow_groups
from tests.test_contract import assert_same

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", list(q.oracle_sql()))
def test_sql(spark, sf_dir, name):
    df = q.queries()[name](spark, sf_dir)
    assert_same(df.collect(), df.columns, q.oracle_sql()[name], sf_dir)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == NAMES, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] > counts[3] > 0 and counts[4] == counts[5]
    assert counts[1] == counts[0]  # every text of the table is in one of its languages
    run = corpus_pipeline.run(spark, sf_dir)
    key = lambda r: (r["out_shard"], r["out_slot"])
    assert sorted(run.collect(), key=key) == sorted(docs.collect(), key=key)


def stages(spark, start, sf_dir, path):
    """The rows after each stage, each written and read again."""
    out, now = [], start
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, sf_dir)
        assert {*NAMES, "row", "h"} <= set(now.columns), name
        now.write.parquet(f"{path}/{k}")
        now = spark.read.parquet(f"{path}/{k}")
        out.append(now.collect())
    return out


def test_edge_documents(spark, docs, sf_dir, tmp_path):
    """Null and repeated ids, empty and repeated texts, by brute force through all stages."""
    clash = [(500, "one text of its own, with an id that another has too"), (500, "and a second text that is not like it at all, same id"), (None, "a text without an id that no other is like"), (None, "another text without an id, of other words")]
    more = spark.createDataFrame([(i, t, "en", "s0", len(t), "r", 1) for i, t in clash], "doc_id long, text string, lang string, source string, n_chars long, row string, h long")
    start = docs.select(*NAMES, "row", "h").unionByName(more)
    known, near, clean, mixed, sharded = stages(spark, start, sf_dir, tmp_path)
    key = lambda r: tuple(map(str, (r[c] for c in (*NAMES, "row", "h"))))
    assert Counter(map(key, known)) == Counter(key(r) for r in start.collect() if any(c.isalpha() for c in r["text"] or ""))

    groups = slow_groups([r["text"] for r in known])
    left = Counter(map(key, known))
    assert all(left[key(r)] for r in near)  # rows as they were
    kept = defaultdict(list)
    for r in near:
        kept[groups[[x["text"] for x in known].index(r["text"])]].append(r["doc_id"])
    assert kept.keys() == set(groups) and all(len(ids) == 1 for ids in kept.values())
    for g, (one,) in kept.items():
        ids = [r["doc_id"] for r, mine in zip(known, groups, strict=True) if mine == g and r["doc_id"] is not None]
        assert one == (min(ids) if ids else None)
    assert {t for _, t in clash} <= {r["text"] for r in near}

    assert Counter(map(key, clean)) == Counter(map(key, near))  # none holds a benchmark window
    copies = Counter(map(key, mixed))
    assert copies.keys() <= set(map(key, clean)) and max(copies.values()) <= 3
    assert Counter(map(key, sharded)) == copies
    slots = defaultdict(list)
    for r in sharded:
        slots[r["out_shard"]].append(r["out_slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < 24 for s in slots)


def test_empty_table(spark, none, sf_dir, tmp_path):
    assert [len(rows) for rows in stages(spark, none.select(*NAMES, "row", "h"), sf_dir, tmp_path)] == [0] * 5
