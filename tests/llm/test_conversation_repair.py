"""Edits of a plain search over (cost, letters), with conversations in one segment and in many."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallygrid.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, copies long, part int, number string"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 4:
            role = "user"
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(c for c in text if c not in ".!?")
        for _ in range({0: 0, 3: 2}.get(k, 1)):
            yield conv, turn, role, text


def want(rows):
    """The contract, by the cheapest and least letters to each number of rows and last initial."""
    of = defaultdict(list)
    for r in rows:
        of[r[0]]
    for r in damaged(rows):
        of[r[0]].append(r[1:])
    out = {}
    for conv, own in of.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {"": (0, "", ())}

        def inserted(best):
            for last in ("", "s", "a", "u", "a", "u"):
                if last in best:
                    to, role = ("a", "assistant") if last == "u" else ("u", "user")
                    cost, letters, lines = best[last]
                    best[to] = min(best.get(to, (10**9,)), (cost + 5, letters + "I", (*lines, f"{role}:")))
            return best

        for (_, role, text), fault in zip(own, faults, strict=True):
            after = {}
            for last, (cost, letters, lines) in inserted(best).items():
                to, other = ("a", "assistant") if last == "u" else ("u", "user")
                ways = [(cost + 2, letters + "D", lines, last)]
                if fault in ("", "truncated"):
                    cost += 5 * (fault == "truncated")
                    if role[:1] == to or (role[:1], last) == ("s", ""):
                        ways.append((cost, letters + "K", (*lines, f"{role}:{text}"), role[:1]))
                    ways.append((cost + 1, letters + "R", (*lines, f"{other}:{text}"), to))
                for *way, at in ways:
                    after[at] = min(after.get(at, (10**9,)), tuple(way))
            best = after
        cost, letters, lines = min(b for last, b in inserted(best).items() if last in ("", "a"))
        turns = [r[0] for r in own if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, letters,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, n=120):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(n)]:
        turns = rng.sample(range(40), rng.randint(1, 9))
        for t in turns:
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "u2"])
            text = rng.choice(["Yes.", "Yes.", "No", "", None, " \n", "Why? ", "é!\t", "So.  ", f"All {t}.", "x" * 30 + "."])
            rows += [(conv, rng.choice([t, t, t, None]), role, text)] * rng.choice([1, 1, 1, 1, 2])
    long = [(500, t, ("user", "assistant")[t % 2] if rng.random() < 0.8 else "user", rng.choice(["On.", f"Word {t}.", f"Word {t % 30}", ""])) for t in range(160)]
    return rows + long + [(500, 161, "user", "Same.")] * 70 + [(501, None, "system", "Hot.")] * 50


def result(found):
    return {r["conv"]: tuple(r)[1:] for r in found.collect()}


@pytest.mark.parametrize("segment", [3, 7, 4096])
def test_repair(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = conversations(segment)
    df = spark.createDataFrame([(*r, 9, 1, "n") for r in rows], SCHEMA).repartition(3)
    found = result(repair.repair(repair.damage(df), copies=F.col("copies")))
    assert found == want(rows)


def test_edges(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 9, 1, "n")], SCHEMA)
    assert repair.repair(df.where("false")).count() == 0
    nothing = ("", hashlib.sha256(b"").hexdigest())
    assert result(repair.repair(df, copies=F.lit(0))) == {1: (0, 0, 0, 0, 0, 0, *nothing)}
    assert result(repair.repair(df)) == {1: (0, 0, 0, 0, 0, 2, "D", nothing[1])}
    two = spark.createDataFrame([(1, 0, "system", "Be good.", 9, 1, "n"), (1, 4, "user", "Hi.", 9, 1, "n")], SCHEMA)
    assert result(repair.repair(two))[1][:-1] == (3, 0, 0, 0, 0, 2, "RR")


def test_very_long_text(spark):
    rows = [(7, 0, "user", "a. " * 1_000_000), (7, 1, "assistant", " " * 1_000_000 + "b" + "\n" * 1_000_000)]
    df = spark.createDataFrame([(*r, 9, 1, "n") for r in rows], SCHEMA)
    assert result(repair.repair(df))[7][3:7] == (1, 0, 4, "DD")


@pytest.mark.parametrize("block", [1, 4, 16, 64])
def test_auction(monkeypatch, block):
    """Prices at the ends of blocks are distances, and traces of equal cost are the least, for any block."""
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(60):
        rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", f"{t}.", f"{t}", ""])) for t in range(rng.randint(0, 40))]
        answer = want(rows).get(1)
        own = repair.Segment(1, 0, True)
        for _, t, role, text in damaged(rows):
            fault = repair.BLANK if not text else repair.CLEAN if text.endswith(".") else repair.TRUNCATED
            own.add({"turn": t, "role": role, "text": text, "digest": text, "copies": 1, "fault": fault})
        if answer:
            assert tuple(own.result()) == answer
