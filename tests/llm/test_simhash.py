"""Fingerprints and links against brute force."""

import re

import numpy as np
import pytest
import xxhash

from tallygrid.llm import simhash


def slow_print(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    k = min(k, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_labels(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (int(prints[i]) ^ int(prints[j])).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 7, 8])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 2**64, 700, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 11), replace=False)) for _ in a], np.uint64)
    want = np.array([int(f).bit_count() <= radius for f in flips])
    assert (simhash.pairs_within(a, a ^ flips, radius) == want).all()


def test_file_links(monkeypatch):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**64, 60, dtype=np.uint64)
    dense = np.array([int(seeds[0]) ^ (1 << i) ^ (1 << j) for i in range(30) for j in range(i)], np.uint64)
    chain = np.array([int(seeds[1]) ^ ((1 << k) - 1) for k in range(0, 64, 3)], np.uint64)
    values = np.unique(np.concatenate([seeds, dense, chain]))
    want = slow_labels(values, 4)
    for small in (1, 10_000):
        monkeypatch.setattr(simhash, "SMALL_FILE", small)
        a, b = simhash.forest(np.zeros(len(values), int), values, 4)
        assert len(a) == len(values) - len(set(want))  # a forest, not all pairs
        labels = simhash.settle(np.arange(len(values)), np.searchsorted(values, a), np.searchsorted(values, b))
        assert len(set(zip(want, labels.tolist(), strict=True))) == len(set(want)) == len(set(labels.tolist()))


def test_fingerprints(texts, monkeypatch):
    want = [slow_print(t) for t in texts]
    assert [simhash.simhash(t and t.encode(), 4) for t in texts] == want
    monkeypatch.setattr(simhash, "SHINGLE_BLOCK", 7)
    assert [simhash.simhash(t and t.encode(), 4) for t in texts[:-2]] == want[:-2]


@pytest.mark.parametrize("tile", [8192, 2])
def test_groups(docs, tile):
    rows = docs.select("doc_id", "text").collect()
    found = simhash.near_duplicates(docs, tile=tile).collect()
    assert len(found) == len(rows)
    prints = [slow_print(r["text"]) for r in rows]
    least = {}
    for r, label in zip(rows, slow_labels(prints, 4), strict=True):
        if r["doc_id"] is not None:
            least[label] = min(least.get(label, r["doc_id"]), r["doc_id"])
    want = sorted((str(r["doc_id"]), p, least[label]) for r, p, label in zip(rows, prints, slow_labels(prints, 4), strict=True))
    assert sorted((str(r["id"]), r["fp"] % 2**64, r["component_id"]) for r in found) == want


def test_one_stays(docs, none):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    groups = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(groups)
    assert simhash.near_duplicates(none).count() == 0
    with pytest.raises(ValueError):
        simhash.link(docs, radius=4, blocks=4)


def test_each_group_keeps_a_row(spark):
    rng = np.random.default_rng(9)
    one, two, three, four = (" ".join(map(str, rng.integers(0, 10**6, 60))) for _ in range(4))
    rows = [(None, one), (None, one), (None, two), (5, three), (5, four), (9, four)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in kept) == sorted([one, two, three, four])
    assert {r["text"]: r["doc_id"] for r in kept} == {one: None, two: None, three: 5, four: 5}


def test_more_fingerprints_take_more_blocks():
    assert [simhash.blocks_for(n, 4) for n in (0, 10**6, 10**8, 10**10, 10**11)] == [6, 6, 7, 8, 9]
    assert simhash.blocks_for(10**12, 63) == 64 and simhash.blocks_for(5, 0) == 2
