"""Removed words against a set of all earlier windows."""

import hashlib

import pytest

from tallygrid.llm import substring


def slow(rows, n):
    """Rows (id, text) in order; equal rows are one document."""
    seen, out = set(), {}
    for i, t in rows:
        if (i, t) in out:
            continue
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            k = tuple(w[s:s + n])
            if k in seen:
                gone[s:s + n] = [True] * n
            seen.add(k)
        out[i, t] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("window", "gram", "piece"), [(20, 8, 200_000), (20, 8, 50), (5, 2, 11), (3, 3, 7)])
def test_removal(docs, monkeypatch, window, gram, piece):
    monkeypatch.setattr(substring, "PIECE_WORDS", piece)
    monkeypatch.setattr(substring, "SLICE_BYTES", piece * 20)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = slow(order, window)
    found = substring.removal(docs.drop("t"), window=window, gram=gram).collect()
    assert len(found) == len(rows)
    got = sorted((str(r["id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found)
    assert got == sorted((str(i), *want[i, t]) for i, t in rows)
    for r in found:
        if r["spans"] is not None:
            assert sum(b - a for a, b in r["spans"]) == r["n_removed"]


def test_empty(none):
    assert substring.removal(none).count() == 0


def test_names_collide(docs, monkeypatch):
    """Names of four bits nominate nearly everything; only compared words go."""
    monkeypatch.setattr(substring, "NAME_BITS", 4)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = slow(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), 20)
    for exact in (False, True):
        found = substring.removal(docs, exact=exact).collect()
        assert sorted((str(r["id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == sorted((str(i), *want[i, t]) for i, t in rows)


def test_thue_morse(spark):
    """Sequences that collide under any polynomial modulo a power of two."""
    one, other = "ab", "ba"
    for _ in range(9):
        one, other = one + other, other + one
    head = " ".join(f"w{i}" for i in range(19))
    words = [("a b" if c == "a" else "b a") for c in one[:64]]
    swapped = [("a b" if c == "a" else "b a") for c in other[:64]]
    rows = [(1, f"{head} {one}"), (2, f"{head} {other}"), (3, " ".join(words)), (4, " ".join(swapped))]
    found = {r["id"]: r["n_removed"] for r in substring.removal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = slow(rows, 20)
    assert found == {i: want[i, t][1] for i, t in rows} and found[2] == 0


def test_greedy_factors():
    array = substring.np.array
    # Two sources: the farther run first, the other from where it ends.
    assert substring.greedy_factors(array([0, 3, 0, 2]), array([3, 4, 2, 8]), array([7, 7, 9, 5]), array([10, 13, 4, 1])) == [(0, 7, 7, 10), (7, 3, 5, 6)]
    assert substring.greedy_factors(array([5, 5]), array([1, 1]), array([1, 1]), array([0, 0])) == [(5, 1, 1, 0)]


def test_parse_goes_on_and_counts_failures():
    words = [b"%d" % i for i in range(30)]
    assert substring.parse(words, [(0, 2, words[:9]), (3, 1, words[3:8])], 5) == ([[0, 9]], 0)
    assert substring.parse(words, [(0, 3, [*words[:6], b"x"])], 5) == ([[0, 6]], 1)
    assert substring.parse(words, [(0, 1, [b"x"] * 5)], 5) == ([], 1)


def test_leftmost_least():
    values = substring.np.array([3, 1, 1, 2, 0, 5, 0], "uint64")
    for width in (1, 2, 3, 5, 7):
        assert substring.leftmost_least(values, width).tolist() == [i + int(values[i:i + width].argmin()) for i in range(8 - width)]
