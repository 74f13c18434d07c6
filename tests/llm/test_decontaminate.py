"""Windows against brute force."""

import re

import pytest

from tallygrid.llm import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def slow(text, items, n):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        k = min(n, len(iw))
        for s in range(len(iw) - k + 1 if iw else 0):
            for at in range(len(w) - k + 1):
                if w[at:at + k] == iw[s:s + k]:
                    hit.update(range(at, at + k))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def items(texts):
    whole = texts[14].split()
    return [(1, " ".join(whole[:30])), (20, " ".join(whole[10:40])), (3, "one"), (4, "two THREE"), (5, None), (6, "  "), (7, " ".join(texts[9].split()[5:17])), (8, "loop " * 12), (9, "loop " * 12), (10, "nowhere at all to be seen in any of these texts ever"), (11, "é")]


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_windows(spark, docs, items, bound):
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    found = decontaminate.contamination(docs, benchmark, window=10, broadcast_bytes=bound).collect()
    got = sorted((str(r["row"]["doc_id"]), r["row"]["text"] or "", r["n_words"], r["n_hit"], r["items"]) for r in found)
    want = sorted((str(r["doc_id"]), r["text"] or "", *slow(r["text"], items, 10)) for r in docs.collect())
    assert got == want
    assert any(r[3] for r in got) and not all(r[3] for r in got)


def test_filter(spark, docs, none, items):
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not slow(r["text"], items, 10)[1] for r in docs.collect())
    assert decontaminate.decontaminate(docs, benchmark.where("false")).count() == docs.count()
    assert decontaminate.contamination(none, benchmark).count() == 0
