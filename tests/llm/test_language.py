"""Codes, decoding and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import language
from tallygrid.llm.queries import op4_language_id


def test_codewords_differ():
    for n in (2, 3, 4, 5, 6, 12):
        code = language.codewords(n)
        assert all((code[i] != code[j]).sum() >= min(2 ** (n - 2), 3) for i in range(n) for j in range(i))


def test_decoding_mends_a_wrong_bit():
    code = language.codewords(4)
    model = language.LanguageModel(list("abcd"), code, np.zeros((1, 7)), np.zeros(7), np.ones((4, 7)))
    for i in range(4):
        for wrong in range(7):
            margins = 4 * code[i].copy()
            margins[wrong] *= -1
            best, score = model.decode(margins[None])
            assert best[0] == i and 0 < score[0] <= 1
    assert model.decode(np.zeros((1, 7)))[1][0] == pytest.approx(0.25)


def test_pieces_do_not_matter(monkeypatch):
    text = "Größe und Maß, été " * 50
    whole = language.features(text)
    monkeypatch.setattr(language, "PIECE", 17)
    assert np.allclose(language.features(text), whole)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = op4_language_id(spark, sf_dir).join(lang, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(docs, none):
    model = language.fit(docs)
    found = language.identify(docs, model).collect()
    assert len(found) == docs.count()
    for r in found:
        letters = any(c.isalpha() for c in r["row"]["text"] or "")
        assert (r["found"]["lang"] in ("en", "de")) == letters and (letters or r["found"]["score"] == 0)
    kept = language.keep_identified(docs, model, clear=0.0)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in r["text"] or "") for r in docs.collect())
    assert language.identify(none, model).count() == 0
    unlabelled = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["found"]["lang"] for r in language.identify(docs, unlabelled).collect()} == {"und"}
    single = language.fit(docs.withColumn("lang", F.lit("xx")))
    assert {r["found"]["lang"] for r in language.identify(docs, single).collect()} == {"xx", "und"}
    with pytest.raises(ValueError):
        language.fit(docs, languages_most=1)


def test_hot_texts_do_not_fill_the_sample(spark, monkeypatch):
    """A language whose rows are copies of one text keeps it, and the driver's rows stay bounded."""
    rows = [("a", "immer der gleiche Satz hier")] * 6000 + [(k, f"{w} {i} {w * 2} {chr(97 + i % 26) * 3}") for i in range(3000) for k, w in (("b", "the words of"), ("c", "las palabras"))]
    rows += [("d", "123"), ("d", None), (None, "no label")]
    seen = []
    monkeypatch.setattr(language, "train", lambda x, labels, **kw: seen.append((len(x), sorted(set(labels)), labels.count("a"))))
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    language.fit(frame, sample_rows=600)
    assert seen == [(401, ["a", "b", "c"], 1)]
    with pytest.raises(ValueError):
        language.fit(frame, sample_rows=2)


def test_decoding_by_hand(spark, sf_dir):
    """Predictions of the query are those of a plain decoding: n-grams counted one by one, and for
    each language the loss of its codeword's bits, weighted by how far each bit is trusted."""
    from math import exp, log1p, sqrt

    from pyspark.sql import functions as F

    from tallygrid.llm.queries import held_out, op4_language_id

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))))
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").limit(25).collect()}
    found = {r["doc_id"]: r for r in op4_language_id(spark, sf_dir).where(F.col("doc_id").isin(list(rows))).collect()}
    for i, text in rows.items():
        data = b" " + bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in text.encode()) + b" "
        counts = {}
        for factors in language.MULTIPLIERS:
            for at in range(len(data) - len(factors) + 1):
                mixed = sum(data[at + k] * m for k, m in enumerate(factors)) % 2**32
                slot = (mixed * 2654435769 % 2**32) >> 20
                counts[slot] = counts.get(slot, 0) + 1
        whole = sum(counts.values())
        margins = [model.bias[b] + sum(sqrt(n / whole) * float(model.weights[s, b]) for s, n in counts.items()) for b in range(model.code.shape[1])]
        losses = [sum(model.trust[k][b] * log1p(exp(-model.code[k][b] * m)) for b, m in enumerate(margins)) for k in range(len(model.languages))]
        best = min(range(len(losses)), key=losses.__getitem__)
        assert found[i]["lang_pred"] == model.languages[best]
        assert abs(found[i]["score"] - 1 / sum(exp(losses[best] - x) for x in losses)) < 1e-4
