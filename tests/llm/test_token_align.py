"""Groups, links and counts of a plain two-pointer walk over the libraries' tokens."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallygrid.llm import token_align

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    byte = {s: n for n, s in enumerate(token_align.byte_symbols())}
    vocabulary = {i: t for t, i in json.load(open(PATHS[0], encoding="utf-8"))["model"]["vocab"].items()}

    def one(text):
        """Groups (lists of A's and of B's ids) of a text; none if it has no tokens."""
        if not text:
            return []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        of_a = [bytes(byte[c] for c in vocabulary[i]) for i in x]
        of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
        if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            return []
        i = j = at_a = at_b = 0
        groups = [([], [])]
        while i < len(x) or j < len(y):
            if at_a <= at_b and i < len(x):
                groups[-1][0].append(x[i])
                at_a, i = at_a + len(of_a[i]), i + 1
            else:
                groups[-1][1].append(y[j])
                at_b, j = at_b + len(of_b[j]), j + 1
            if at_a == at_b:
                groups.append(([], []))
        return groups[:-1]

    return one


def want(rows, plain):
    found = [(i, plain(t)) for i, t in rows]
    count, best = Counter((g[0][-1], g[1][-1]) for _, groups in found for g in groups), defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for i, groups in found:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == best[p[1]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out, count


ODD = [*" \t\n\rabzAé日1'sdmt.,!-\x00́\U0001f600", "▁", "<s>", "<|endoftext|>", "  ", "'ll", "\n\n ", " a", "don't", "the", "tion", "　", "<0x41>"]


def test_tables(spark, docs, none, plain):
    rng = random.Random(8)
    odd = [(10_000 + k, "".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))), *["x"] * 2, 1, "r", 1, 2, 3, "k", 4, "w", 5, "f") for k in range(400)]
    every = docs.unionByName(spark.createDataFrame(odd, docs.schema)).persist()
    rows = [(r["doc_id"], r["text"]) for r in every.collect()]
    answer, count = want(rows, plain)
    for work in (7, 4096):
        found = token_align.align(every, *PATHS, work=work).select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, answer))
    pairs = token_align.pair_counts(every, *PATHS).collect()
    assert {(r["a_id"], r["b_id"]): r["n"] for r in pairs} == count
    assert token_align.align(none, *PATHS).count() == 0
    kept = token_align.align(every.where("doc_id = 15"), *PATHS, columns=["row", "text"], keep_groups=True).select("row.*", "groups").first()
    assert kept["row"] == "r" and kept["groups"].startswith("257|")


def test_not_utf8(spark):
    df = spark.createDataFrame([(1, b"a\xffb"), (2, b"ab")], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    assert {r["row"]["doc_id"]: (r["n_a"], r["groups_sha256"] == "") for r in token_align.align(df, *PATHS, columns=["doc_id"]).collect()}[1] == (0, True)


def test_chunks(monkeypatch, plain):
    """Long texts in chunks, long white space and long words give the tokens of the whole."""
    words, rng = token_align.vocabularies(*PATHS), random.Random(4)
    texts = ["".join(rng.choice(ODD) for _ in range(600)) for _ in range(60)] + ["a " * 3000, "x" * 5000 + " y", " " * 4000 + "b", "a" + "\n" * 3000]
    monkeypatch.setattr(token_align, "CHUNK", 40)
    for text in texts:
        assert words.encode(text) == (words.a_whole.encode(" " + text, add_special_tokens=False).ids, words.b.encode(text))


def test_every_kind_of_character():
    """The rank form gives the library's tokens around any character."""
    words = token_align.vocabularies(*PATHS)
    points = [c for c in [*range(0x30000), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}\n{chr(c)} " for c in points[at:at + 20_000]]
        whole = words.a_whole.encode_batch(texts, add_special_tokens=False)
        assert [e.ids for e in whole] == [words.a_ranks.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("work", [1, 2, 3, 10, 64])
def test_pieces(work):
    """Pieces of equal work, and their stitched cuts, for lists of any shape."""
    rng = np.random.default_rng(work)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 80, rng.integers(0, 60))) for _ in range(2))
        i, j = token_align.diagonals(a, b, work)
        assert list(np.diff(i + j)[:-1]) == [work] * (len(i) - 2) and (i[-1], j[-1]) == (len(a), len(b))
        x, y = token_align.common_ends(a, b, work)
        assert list(a[x]) == list(b[y]) == sorted(set(a) & set(b))


def test_pairs_are_all_that_can_be_linked():
    words = token_align.vocabularies(*PATHS)
    a, b = words.pairs()
    for k in np.random.default_rng(0).integers(0, len(a), 2000):
        x, y = words.a_bytes[a[k]], words.b_bytes[b[k]]
        assert x.endswith(y) or y.endswith(x)
    assert len(a) < 500_000
