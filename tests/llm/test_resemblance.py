"""Groups by shingle similarity against brute force."""

import random

import pytest

import corpus_pipeline
from tallygrid.llm import resemblance


def slow_groups(texts, k=5, least=0.8):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    return root


@pytest.fixture(scope="module")
def near():
    """Texts and copies with one to four changed words in a hundred: similarities around 0.8."""
    rng = random.Random(4)
    out = []
    for _ in range(25):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        out.append(" ".join(words))
        for changed in (1, 2, 3, 4, 6):
            copy = list(words)
            for at in rng.sample(range(100), changed):
                copy[at] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("tile", [None, 1_000_000, 150])
def test_similar_texts_go(spark, near, tile):
    groups = slow_groups(near)
    want = sorted({groups.index(g) for g in groups})
    docs = spark.createDataFrame(list(enumerate(near)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "") if tile is None else resemblance.drop_near_duplicates(docs, tile=tile)
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_edges(spark, near):
    rows = [(None, near[0]), (None, near[6]), (5, near[12]), (5, near[18]), (9, near[18]), (None, None), (7, ""), (8, "a b"), (3, "A  b")]
    kept = resemblance.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["text"]) for r in kept} == {(None, near[0]), (None, near[6]), (5, near[12]), (5, near[18]), (7, ""), (3, "A  b")}
    assert len(kept) == 6


def test_no_similar_pair_exceeds_the_radius():
    rng = resemblance.np.random.default_rng(5)
    for n in (4, 9, 30, 200):
        for _ in range(300):
            common = rng.integers(0, 2**63, n, dtype="uint64")
            more = rng.integers(0, 2**63, max(round(n * 0.25), 1), dtype="uint64")  # similarity 0.8
            cut = rng.integers(0, len(more) + 1)
            a, b = (resemblance.fingerprint(resemblance.np.concatenate((common, x))) for x in (more[:cut], more[cut:]))
            assert int(a ^ b).bit_count() <= resemblance.radius_for(0.8)


@pytest.mark.parametrize("small", [0, 3, 1000])
def test_files(near, monkeypatch, small):
    """Links of small and large files, with and without queries, are those of all pairs."""
    monkeypatch.setattr(resemblance, "SMALL_FILE", small)
    sets = [resemblance.shingle_set(t.encode(), 5) for t in near]
    for files, asks in (([0] * 150, [1] * 150), ([i // 60 for i in range(150)], [1] * 150), ([i // 60 for i in range(150)], [i % 3 == 0 for i in range(150)])):
        got = resemblance.link_sets(sets, resemblance.np.array(files), 0.8, resemblance.np.array(asks, bool)).tolist()
        want = list(range(150))
        for i in range(150):
            for j in range(i):
                similar = len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j])) - 1e-9
                if similar and files[i] == files[j] and (asks[i] or asks[j]) and want[i] != want[j]:
                    want = [want[j] if r == want[i] else r for r in want]
        assert [got.index(g) for g in got] == [want.index(w) for w in want]
