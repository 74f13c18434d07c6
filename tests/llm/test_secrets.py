"""Base spans against Python's patterns, and the battery on random and regular strings."""

import base64
import math
import random
import re
import time

import pytest

from tallygrid.llm import secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def slow(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate((("assign", ASSIGN, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(out)


@pytest.fixture(scope="module")
def found(spark, texts):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(texts)]
    more = [
        "token=token:abcdefg é secret: abc", "Password = 'hunter22' AKIA" + "B7" * 9 + " AKIAX", "api_key=" + "".join(rng.choices("0123456789abcdef", k=40)),
        "passwd:x passwd:longer-one api-key=123456789", "é" * 9 + " 0123456789abcdef0123456789 " + "f" * 24, "AKIA" + "A" * 15,
        "k " + base64.b64encode(rng.randbytes(33)).decode() + " and", "abcdefghijklmnopqrstuvwxyz0123456789abcd", "aaaaaaaaaaaaaaaaaaaa11111111111111111111", " ".join(["token: value123"] * 300),
    ]
    rows += [(1000 + i, t) for i, t in enumerate(more)] + [(1001, more[1]), (None, more[2])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kind string, h int").repartition(3)
    return rows, secrets.scan(df).collect()


def test_base_spans(found):
    rows, got = found
    base = lambda r: [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["found"] if s["kind"] != "random"]
    assert sorted((str(r["id"]), base(r)) for r in got) == sorted((str(i), slow(t)) for i, t in rows)


def test_battery(found):
    rows, got = found
    text = dict(rows)
    flagged = {r["id"]: [text[r["id"]][s["start"]:s["end"]] for s in r["found"] if s["kind"] == "random"] for r in got}
    assert len(flagged[1006]) == 1 and len(flagged[1006][0]) == 44
    assert not flagged[1007] and not flagged[1008]
    assert not flagged[None]  # inside a base span


def test_false_discoveries_are_rare(spark):
    rng = random.Random(8)
    rows = [(i, "v " + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=rng.choice([32, 40, 64])))) for i in range(400)]
    rows += [(1000 + i, "v " + f"item{i % 10}" * 8) for i in range(100)]
    hits = {r["id"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if any(s["kind"] == "random" for s in r["found"])}
    assert sum(i < 400 for i in hits) >= 370 and not any(i >= 1000 for i in hits)


def test_random_values_after_an_equals_sign(spark):
    key = "wJalrXUtnFEMI7K9MDENGbPxRfiCYqT3sZ5hLdGv8"
    names = ["?sig=", "pwd=", "client_key=", "AWS_SECRET_ACCESS_KEY=", "x==", "a=b&c=", " ", ": "]
    rows = [(i, f"see {name}{key} and") for i, name in enumerate(names)]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    assert {r["id"]: [text[r["id"]][s["start"]:s["end"]] for s in r["found"] if s["kind"] == "random"] for r in found} == {i: [key] for i in text}


def test_very_long_tokens(spark):
    """Millions of characters in one run take seconds: the work is linear in a token's length."""
    rng = random.Random(6)
    noise = base64.b64encode(rng.randbytes(3_000_000)).decode()
    rows = [(1, f"data:image/png;base64,{noise} end"), (2, "z1" * 1_000_000), (3, "x" * 4_000_000), (4, "token = " + "zy9" * 100_000)]
    began = time.monotonic()
    found = {r["id"]: [(s["kind"], s["start"], s["end"]) for s in r["found"]] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.monotonic() - began < 60
    assert found == {1: [("random", 22, 22 + len(noise))], 2: [], 3: [], 4: [("assign", 0, 8 + 300_000)]}


def test_pieces(spark, monkeypatch):
    """Sums over pieces of any length are those of the whole."""
    rng = random.Random(7)
    tokens = ["".join(rng.choices(a, k=rng.randint(20, 80))) for a in ALPHABETS.values() for _ in range(4)]
    for piece in (1, 7, 20, 1000):
        monkeypatch.setattr(secrets, "PIECE", piece)
        for r in secrets.randomness(spark.createDataFrame([(t,) for t in tokens], "match string"), "match").collect():
            assert r["r"]["p"] == pytest.approx(slow_battery(r["match"])[1], abs=2e-6) and r["r"]["gain"] == pytest.approx(slow_battery(r["match"])[2], abs=1e-6)


def test_empty(none):
    assert secrets.scan(none).count() == 0


WORDS = "get set user account balance customer order invoice payment gateway session manager factory builder service client request response handler listener adapter provider database connection pool buffer stream reader writer parser token index value total count email address street number update delete create fetch remote local cache config option default version".split()
ALPHABETS = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


def test_recall_and_names(spark):
    """Random keys of every encoding are found, invented identifiers are not."""
    rng = random.Random(21)
    rows, kind = [], {}
    for name, alphabet in ALPHABETS.items():
        for _ in range(200):
            kind[len(rows)] = name
            rows.append((len(rows), "key " + "".join(rng.choices(alphabet, k=rng.randint(32, 64))) + " end"))
    for _ in range(1500):
        words = rng.choices(WORDS, k=rng.randint(4, 8))
        number = str(rng.randint(1, 99))
        for name, joined in (("camel", words[0] + "".join(w.title() for w in words[1:]) + number), ("snake", "_".join([*words, number])), ("kebab", "-".join([*words[:2], number, *words[2:]]))):
            kind[len(rows)] = name
            rows.append((len(rows), f"call {joined} now"))
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    share = {}
    for name in {*kind.values()}:
        mine = [any(s["kind"] in ("random", "hex") for s in r["found"]) for r in found if kind[r["id"]] == name]
        share[name] = sum(mine) / len(mine)
    assert all(share[name] >= 0.95 for name in ALPHABETS), share
    assert all(share[name] < 0.02 for name in ("camel", "snake", "kebab")), share


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def slow_battery(token):
    core = token.rstrip("=")
    name = next(n for n, _, a in secrets.ENCODINGS if set(core) <= set(a))
    alphabet = next(a for n, _, a in secrets.ENCODINGS if n == name)
    n, k, x = len(core), len(alphabet), [alphabet.index(c) for c in core]
    counts = [core.count(c) for c in alphabet]
    chi = sum((c - n / k) ** 2 / (n / k) for c in counts)
    chi = (chi - (k - 1)) / math.sqrt((n - 1) / n) + k - 1
    z = ((max(chi, 0) / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    ps = [tail(z)]
    high = [v >= k / 2 for v in x]
    both = 2 * sum(high) * (n - sum(high))
    spread = both * (both - n) / (n * n * (n - 1))
    ps.append(2 * tail(abs(sum(a != b for a, b in zip(high, high[1:])) - both / n) / math.sqrt(spread)) if spread > 0 else 0)
    mean = sum(x) / n
    energy = sum((v - mean) ** 2 for v in x)
    ps.append(2 * tail(abs(sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / energy + 1 / n) * math.sqrt(n)) if energy else 0)
    kinds = ["0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "-" for c in core]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    shares = dict(zip("abcdefghijklmnopqrstuvwxyz", secrets.LETTER_SHARES))
    text = 2 + sum(-math.log2(shares[c.lower()] / sum(shares.values())) if c.isalpha() else math.log2(10) if c.isdigit() else 2 for c in core)
    text += min(-(n - 1 - changes) * math.log2(s) - changes * math.log2((1 - s) / 3) for s in (0.6, 0.75, 0.9))
    return name, min(1, 3 * min(ps)), text - n * math.log2(k)


def test_battery_by_hand(spark):
    rng = random.Random(4)
    tokens = ["".join(rng.choices(a, k=rng.randint(20, 80))) for a in ALPHABETS.values() for _ in range(20)]
    tokens += ["getUserAccount2" * 2, "aaaaaaaaaaaaaaaaaaaa1", "some_long_name_of_thing_2", "ab12" * 9 + "=="]
    found = secrets.randomness(spark.createDataFrame([(t,) for t in tokens], "match string"), "match").collect()
    assert len(found) == len(tokens)
    for r in found:
        name, p, gain = slow_battery(r["match"])
        assert r["r"]["encoding"] == name and r["r"]["p"] == pytest.approx(p, abs=2e-6) and r["r"]["gain"] == pytest.approx(gain, abs=1e-6)
