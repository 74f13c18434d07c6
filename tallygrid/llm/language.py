"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1 bits. One binary classifier per bit (logistic
regression over hashed byte n-grams of the whole text) predicts its bit, and decoding chooses
the language whose codeword has the least weighted loss. A bit weighs for a language what its
classifier achieved on that language's training texts. A text whose two best codewords are close
is flagged as ambiguous.

Training uses a bounded sample: at most ``sample_rows`` different texts in all, the same number
of each language where it has them, those with the least hashes. Copies of a text count once, so a
text that fills a language's rows is one example of it, and no language that has a text with
letters is left out. Features are made where the rows are, so the driver gets at most
``sample_rows`` vectors of ``FEATURES`` numbers and no text.

Edge cases: a text that is null or has no letter is ``und`` with score 0, and so is every text
when no labelled row exists; with one language alone every other text is that language. Nulls
in the label or the text, and texts without letters, keep a row out of training; a text with
two labels is an example of both. An empty table gives an empty result. Very long texts are counted in pieces and
whole. Repeated rows get equal results. Extra columns travel unread.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

FEATURES = 4096
#: Bytes counted at a time.
PIECE = 1 << 18
UNDETERMINED = "und"
#: Letters in lower case, other ASCII as a space, bytes of longer characters unchanged.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))
#: Odd multipliers that hash byte n-grams, for n = 1, 2 and 3.
MULTIPLIERS = ((40503,), (2654435761, 2246822519), (3266489917, 668265263, 374761393))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte 1-, 2- and 3-grams, one vector of unit length."""
    folded = np.frombuffer(b" " + text.encode("utf-8", "replace").translate(FOLD) + b" ", np.uint8)
    counts = np.zeros(FEATURES)
    for at in range(0, len(folded), PIECE):
        piece = folded[at:at + PIECE + 2].astype(np.uint32)
        for factors in MULTIPLIERS:
            n = min(PIECE, len(piece) - len(factors) + 1)
            if n > 0:
                mixed = sum(piece[k:k + n] * np.uint32(m) for k, m in enumerate(factors))
                counts += np.bincount((mixed * np.uint32(2654435769)) >> np.uint32(20), minlength=FEATURES)
    return np.sqrt(counts / max(counts.sum(), 1)).astype(np.float32)


def codewords(languages: int, random_bits: int = 31, seed: int = 7) -> np.ndarray:
    """(languages, bits) of +1 and -1: every split of the languages while those are few, else
    the best of some random codes, by least distance between codewords."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 5:
        rest = range(1, languages)
        splits = [c for k in range(1, languages) for c in combinations(rest, k)]
        return np.array([[-1.0 if i in c else 1.0 for c in splits] for i in range(languages)])
    rng = np.random.default_rng(seed)
    best, widest = None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(languages, random_bits))
        varied = (np.abs(code.sum(axis=0)) < languages).all()
        gap = min((code[i] != code[j]).sum() for i in range(languages) for j in range(i))
        if varied and gap > widest:
            best, widest = code, gap
    return best


@dataclass
class LanguageModel:
    """Codewords, bit classifiers and the weight of each bit for each language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its score, for rows of bit margins."""
        loss = (self.trust[None] * np.logaddexp(0, -self.code[None] * margins[:, None, :])).sum(axis=2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return loss.argmin(axis=1), 1 / share.sum(axis=1)


def train(x: np.ndarray, labels: Sequence[str], steps: int = 300, rate: float = 30.0, decay: float = 1e-5) -> LanguageModel:
    """Fit the bit classifiers by gradient descent; languages weigh alike."""
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels) if languages else np.zeros(0, int)
    code = codewords(len(languages))
    target = code[y]
    share = 1.0 / np.bincount(y, minlength=len(languages))[y] / len(languages) if len(y) else np.zeros(0)
    x, target, share = x.astype(np.float32, copy=False), target.astype(np.float32), share.astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    pace_w, pace_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps if len(languages) > 1 else 0):
        pull = target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * share[:, None]
        pace_w = np.float32(0.9) * pace_w + x.T @ pull - np.float32(decay) * w
        pace_b = np.float32(0.9) * pace_b + pull.sum(axis=0)
        w, b = w + np.float32(rate) * pace_w, b + np.float32(rate * 0.01) * pace_b
    right = (target * (x @ w + b) > 0).astype(float)
    trust = np.array([right[y == i].mean(axis=0) for i in range(len(languages))]) if languages else np.zeros((0, 1))
    trust = trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9) * trust.shape[1] if languages else trust
    return LanguageModel(languages, code, w.astype(np.float32), b.astype(np.float32), trust)


def fit(docs: DataFrame, label_col: str = "lang", text_col: str = "text", sample_rows: int = 2000, languages_most: int = 500) -> LanguageModel:
    """Train on a bounded sample of the labelled texts of ``docs``.

    ``languages_most`` bounds the labels; more, or more than ``sample_rows``, raise an error rather
    than being dropped.
    """
    known = docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    known = known.where("label IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text", F.lit("sample")))
    most = min(languages_most, sample_rows)
    per_label = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).limit(most + 1).collect()}
    if len(per_label) > most:
        raise ValueError(f"more than {most} labels")
    if not per_label:
        return train(np.zeros((0, FEATURES)), [])
    each = sample_rows // len(per_label)
    # Twice as many are drawn by a threshold on the hash, whose copies combine before the shuffle;
    # the window over them has a few thousand rows and sets the bound.
    rate = F.create_map(*[F.lit(v) for k, n in per_label.items() for v in (k, min(1.0, (2 * each + 20) / max(n, 1)))])
    draw = F.shiftrightunsigned("h", 34) / F.lit(float(1 << 30))
    drawn = known.where(draw < rate[F.col("label")]).groupBy("label", "h").agg(F.first("text").alias("text"))
    order = Window.partitionBy("label").orderBy("h")
    chosen = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)

    @pandas_udf("binary")
    def vector(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t).tobytes())

    sample = chosen.select("label", vector("text").alias("x"), "h").toPandas().sort_values(["label", "h"])
    x = np.frombuffer(b"".join(sample["x"]), np.float32).reshape(-1, FEATURES)
    return train(x, sample["label"].tolist())


def predict(text: Column, model: LanguageModel, clear: float = 0.35) -> Column:
    """Struct ``lang``, ``score`` (0 to 1) and ``ambiguous`` (score below ``clear``)."""
    names = model.languages

    @pandas_udf("struct<lang string, score double, ambiguous boolean>")
    def of(texts: pd.Series) -> pd.DataFrame:
        known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool) & bool(names)
        lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        rows = np.flatnonzero(known)
        if len(rows):
            margins = np.stack([model.margins(features(texts.iloc[i])) for i in rows])
            best, score[rows] = model.decode(margins)
            lang[rows] = [names[k] for k in best]
        return pd.DataFrame({"lang": lang, "score": score, "ambiguous": known & (score < clear)})

    return of(text)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", clear: float = 0.35) -> DataFrame:
    """``row`` (struct of all columns) and ``found`` (struct of :func:`predict`)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, predict(F.col(text_col), model, clear).alias("found"))


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", clear: float = 0.35) -> DataFrame:
    """``docs`` without texts that have no language or no clear one."""
    found = predict(F.col(text_col), model, clear)
    return docs.where((found["lang"] != UNDETERMINED) & ~found["ambiguous"])
