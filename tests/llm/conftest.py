import random

import pytest

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, h long, size long, key string, t long, w string, copies long, found string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "ea", "ion", "st", "Re", "ou", "é", "ing", "x9"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, empties, copies, near copies, shared passages and one very long text."""
    rng = random.Random(5)
    passage, base = prose(rng, 45), prose(rng, 120)
    out = [None, None, "", "", "  \t\n", "a", "one two three", "...!?", "12 34", base, base, base, base.replace("the", "THE", 1), base + " end", passage]
    for i in range(60):
        body = prose(rng, rng.randint(5, 80))
        out.append(body if i % 3 else f"{body} {passage}\n{prose(rng, 10)}")
    words = base.split()
    for i in range(12):  # near copies
        w = list(words)
        w[i * 7] = f"new{i}"
        out.append(" ".join(w))
    out.append(" ".join([prose(rng, 900)] * 30))
    out.append("loop " * 70)
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents with columns of clashing names, repeated rows and null columns."""
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 3, t, None if i % 11 == 5 else ["en", "de"][i % 2], None if i % 10 == 9 else f"s{min(i % 13, 4)}", len(t or ""), "r", 1, 2, 3, "k", 4, "w", 5, "f"))
    rows += [rows[9], rows[20], (None, texts[21], None, None, None, *rows[0][5:]), (None, None, None, None, None, *rows[0][5:])]
    return spark.createDataFrame(rows, CLASHING).repartition(5).persist()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
