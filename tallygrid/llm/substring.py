"""Substring deduplication by relative Lempel-Ziv parsing over a shared block index.

A word is removed if it lies in a window of ``window`` consecutive words whose sequence also
starts earlier: in a document with a smaller id, or earlier in the same document. The reference
of a document is thus everything before it. It is indexed by blocks at content-defined places:

1. **Index.** In every window the least of the hashes of its ``gram``-word sequences marks an
   anchor, so equal windows have equal anchors wherever they stand. An anchor's block is the run
   of windows that it marks. Blocks are named by 128 bits over all their words; the index holds
   the earliest place of every kind of block. Where an anchor has blocks of several kinds, which
   agree in part only, it also holds the earliest place of each window of theirs. Anchors that
   occur once in all documents are left out where a filter of bounded size tells.
2. **Parsing.** Looked up in the index, a document's blocks and windows point at earlier places.
   Pointers that go on in one source document with one shift make up runs, and the greedy parse
   takes at each position the run that reaches farthest as the next factor. The words of the
   source are brought to each factor and compared word by word; a factor goes on beyond its
   pointers as long as the words agree, by up to a window.
3. **Factor boundaries.** A next factor starts with the first window that the last one does not
   hold whole, so every window across a boundary is looked up and compared on its own account.
   Factors of ``window`` words or more are the duplicate spans.

Hashes only nominate: nothing is removed but words that were compared. If a nominated window
fails the comparison (two sequences of one name), the whole job runs again with the words
themselves for names.

Texts that are equal (by SHA-256) take part once, through the least id; their copies are repeats
throughout. Documents are numbered in order by a sort of ids; the index moves hashes and numbers
only. Texts are shuffled to a bucketed table, which every later join of texts reads in place;
after that only the segments that factors copy are. Repeats within a document are found where it
is read, so a name comes once from each document; counts and minima combine before a shuffle, and
hot names meet a written table with one row per name, which lets Spark split them.

Edge cases: a null or empty text has no words; texts of fewer words than a window keep all;
rows with equal id and text are one document and each gets its result; equal ids with different
texts are ordered by a digest of the text; null ids come first. Very long texts are hashed in
pieces. An empty table gives an empty result. Columns other than id and text are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallygrid.llm._common import bucketed, stored
from tallygrid.llm._filter import BitmapFilter

#: Words hashed at a time; the pieces of a longer text overlap by what a block can span.
PIECE_WORDS = 200_000
#: Words whose hashes are remembered in a task.
REMEMBERED = 200_000
#: Words of a segment that is brought from a source document to what copies it.
SEGMENT_WORDS = 64
#: Bytes of texts whose words are held at a time.
SLICE_BYTES = 4 << 20
#: Bits of a name that are used; fewer only in tests of collisions.
NAME_BITS = 64
_random = np.random.default_rng(11)
#: Bits of a block's length below its place.
PLACE_SHIFT = 12
#: A random number and an odd factor per place in a run of words.
PLACE = _random.integers(0, 2**63, 1 << PLACE_SHIFT, dtype=np.uint64)
FACTOR = _random.integers(0, 2**63, 1 << PLACE_SHIFT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word, 5)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def names(hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names for each run of ``count`` words from ``first`` on."""
    one, two = np.empty(len(first), np.uint64), np.empty(len(first), np.uint64)
    for at in range(0, len(first), 1 << 14):
        begin, size = first[at:at + (1 << 14)], count[at:at + (1 << 14)]
        step = np.arange(size.max())
        each = mixed(hashes[np.minimum(begin[:, None] + step, len(hashes) - 1)] + PLACE[step])
        each[step >= size[:, None]] = 0
        one[at:at + (1 << 14)], two[at:at + (1 << 14)] = each.sum(axis=1), (each * FACTOR[step]).sum(axis=1)
    keep = np.uint64((1 << NAME_BITS) - 1)
    return (mixed(one + count.astype(np.uint64)) & keep).view(np.int64), (mixed(two) & keep).view(np.int64)


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` neighbouring values stands, the leftmost of equal ones."""
    where, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        later = values[step:] < values[:-step]
        where = np.where(later, where[step:], where[:-step])
        values = np.where(later, values[step:], values[:-step])
        reach += step
    return where


def pieces(texts: list[list[bytes]], window: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Lists of (text, offset, words) of about ``PIECE_WORDS`` words, none without a window."""
    held, size = [], 0
    for i, words in enumerate(texts):
        for at in range(0, max(len(words) - window + 1, 0), PIECE_WORDS):
            held.append((i, at, words[at:at + PIECE_WORDS + window - 1]))
            size += len(held[-1][2])
            if size >= PIECE_WORDS:
                yield held
                held, size = [], 0
    if held:
        yield held


def slices(texts: list[bytes]) -> Iterator[slice]:
    """Stretches of texts of about ``SLICE_BYTES``."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_BYTES or i + 1 == len(texts):
            yield slice(begin, i + 1)
            begin, size = i + 1, 0


def blocks_of(texts: list[list[bytes]], window: int, gram: int, hashes: WordHashes, exact: bool) -> pd.DataFrame:
    """All blocks of some texts: ``text`` (number), ``a`` (hash of the anchor) and ``k`` (of all words),
    which are its name, ``at`` (first window), ``n`` (windows) and, if exact, ``words``."""
    parts = []
    for held in pieces(texts, window):
        words = [w for _, _, some in held for w in some]
        sizes = np.array([len(some) for _, _, some in held])
        base = np.cumsum(sizes) - sizes
        h = hashes.of(words)
        n = len(h) - gram + 1
        grams = sum(mixed(h[j:n + j] + PLACE[j]) for j in range(gram))
        own = sizes - window + 1
        starts = np.repeat(base - np.cumsum(own) + own, own) + np.arange(own.sum())
        place = leftmost_least(grams, window - gram + 1)[starts]
        new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (np.diff(starts) != 1))))
        first, count = starts[new], np.diff(np.concatenate((new, [len(starts)])))
        k, _ = names(h, first, count + window - 1)
        piece = np.searchsorted(base, first, "right") - 1
        part = {"text": np.array([i for i, _, _ in held])[piece], "a": grams[place[new]].view(np.int64), "k": k,
                "at": first - base[piece] + np.array([at for _, at, _ in held])[piece], "n": count}
        if exact:
            part["words"] = [b" ".join(words[f:f + c + window - 1]) for f, c in zip(first.tolist(), count.tolist(), strict=True)]
        parts.append(pd.DataFrame(part))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in ("text", "a", "k", "at", "n", "words")}, dtype="int64")


def earlier_in_text(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """For rows ordered by place: the place of the first row of the same text and name, or -1."""
    first = rows.groupby(keys, sort=False)["at"].transform("first").to_numpy()
    return np.where(first == rows["at"].to_numpy(), -1, first)


def windows_of(texts: list[list[bytes]], places: list[np.ndarray], window: int, hashes: WordHashes, exact: bool) -> pd.DataFrame:
    """The windows at ``places`` of some texts: ``text``, ``k``, ``k2``, ``at`` and, if exact, ``words``."""
    parts = []
    for held in pieces(texts, window):
        for i, at, words in held:
            mine = places[i][(places[i] >= at) & (places[i] < at + PIECE_WORDS)] - at
            if len(mine):
                k, k2 = names(hashes.of(words), mine, np.full(len(mine), window))
                part = {"text": np.full(len(mine), i), "k": k, "k2": k2, "at": at + mine}
                if exact:
                    part["words"] = [b" ".join(words[f:f + window]) for f in mine.tolist()]
                parts.append(pd.DataFrame(part))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in ("text", "k", "k2", "at", "words")}, dtype="int64")


def greedy_factors(at: np.ndarray, n: np.ndarray, source: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Factors (first window, windows, source document, first window there) from pointers of
    ``n`` windows at ``at`` to ``place`` in ``source``: at each window that no factor holds yet,
    the run of pointers that reaches farthest."""
    shift = place - at
    order = np.lexsort((at, shift, source))
    at, n, source, shift = at[order], n[order], source[order], shift[order]
    new = np.concatenate(([True], (source[1:] != source[:-1]) | (shift[1:] != shift[:-1]) | (at[1:] > at[:-1] + n[:-1])))
    begin = np.flatnonzero(new)
    last = np.concatenate((begin[1:], [len(at)])) - 1
    runs = sorted(zip(at[begin].tolist(), (at[last] + n[last]).tolist(), source[begin].tolist(), shift[begin].tolist(), strict=True))
    out, i, upto = [], 0, -1
    while i < len(runs):
        start = max(upto, runs[i][0])
        best = None
        while i < len(runs) and runs[i][0] <= start:
            if runs[i][1] > start and (best is None or runs[i][1] > best[1]):
                best = runs[i]
            i += 1
        if best:
            out.append((start, best[1] - start, best[2], start + best[3]))
            upto = best[1]
    return out


def agreeing(words: list[bytes], at: int, reference: list[bytes]) -> int:
    """How many words from ``at`` on are those of ``reference``."""
    own = words[at:at + len(reference)]
    if own == reference:
        return len(own)
    return next((i for i, (a, b) in enumerate(zip(own, reference)) if a != b), min(len(own), len(reference)))


def parse(words: list[bytes], factors: list[tuple[int, int, list[bytes]]], window: int) -> tuple[list[list[int]], int]:
    """Removed spans (first and end word), and nominated windows whose words differ."""
    spans, upto, failed = [], 0, 0
    for at, n, reference in sorted(factors, key=lambda f: f[:2]):
        if at + n <= upto:
            continue  # the last factor went on to here
        held = max(agreeing(words, at, reference) - window + 1, 0)
        failed += max(n - held, 0)
        if held:
            upto = max(upto, at + held)
            if spans and at <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], at + held + window - 1)
            else:
                spans.append([at, at + held + window - 1])
    return spans, failed


def at(place: str) -> Column:
    """The first window of a block, from its place and length in one number."""
    return F.shiftright(place, PLACE_SHIFT).cast("int")


def n(place: str) -> Column:
    """The windows of a block."""
    return F.col(place).bitwiseAND((1 << PLACE_SHIFT) - 1).cast("int")


def removal(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 8, exact: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_words``, ``n_removed``, ``kept_sha256`` and
    ``spans`` (first and end word of each removed span; null for a copy of an earlier text).

    ``exact`` names runs by their words instead of hashes, as the job does by itself where names collide.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.struct("id").alias("who"), F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    keys = stored(rows.select("who", "digest"))
    # A struct of a null orders as the least and is equal to itself.
    each = keys.groupBy("digest", "who").agg(F.count(F.lit(1)).alias("n"))
    standing = each.groupBy("digest").agg(F.min("who").alias("who"), F.min_by("n", "who").alias("n"))
    # Numbers in the order of ids, then of digests: partitions of the sort are numbered in its order.
    standing = stored(standing.orderBy("who", "digest").select("who", "digest", "n", F.monotonically_increasing_id().alias("r")))
    texts = rows.join(standing, ["digest", "who"]).select("r", F.col("text").cast("binary").alias("text"))
    if not standing.where("n > 1").isEmpty():  # rows with equal id and text
        texts = texts.groupBy("r").agg(F.first("text").alias("text"))
    texts = bucketed(texts, "r")
    parsed = _parsed(texts, window, gram, exact)
    if not exact and not parsed.where("failed > 0").isEmpty():
        parsed = _parsed(texts, window, gram, True)

    each = stored(standing.join(parsed, "r").select("digest", F.col("who").alias("own"), "n_words", "n_removed", "sha", "spans"))
    joined = keys.join(each, "digest")
    copy = (F.col("who") != F.col("own")) & (F.col("n_words") >= window)
    return joined.select(
        "who.id", F.col("n_words").cast("long").alias("n_words"),
        F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(~copy, F.col("spans")).alias("spans"),
    )


def _parsed(texts: DataFrame, window: int, gram: int, exact: bool) -> DataFrame:
    """``r``, ``n_words``, ``n_removed``, ``sha``, ``spans`` and ``failed`` of every text."""
    words = ["words"] if exact else []
    kind, name = ["a", "k", *words], ["k", "k2", *words]
    as_words = ", words array<binary>" if exact else ""

    @pandas_udf(f"struct<n_words int, sha string, a array<long>, k array<long>, p array<long>, src array<int>{as_words}>")
    def survey(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for some in series:
            data = {c: [] for c in ("n_words", "sha", "a", "k", "p", "src", *words)}
            for part in slices(some):
                split = [t.split() for t in some[part]]
                found = blocks_of(split, window, gram, hashes, exact)
                found["src"] = earlier_in_text(found, ["text", *kind])
                found["p"] = (found["at"].to_numpy() << PLACE_SHIFT) + found["n"].to_numpy()
                ends = np.searchsorted(found["text"].to_numpy(), np.arange(len(split) + 1))
                data["n_words"] += [len(w) for w in split]
                data["sha"] += [hashlib.sha256(b" ".join(w)).hexdigest() for w in split]
                for c in ("a", "k", "p", "src", *words):
                    whole = found[c].to_numpy()
                    data[c] += [whole[a:b] for a, b in zip(ends, ends[1:])]
            yield pd.DataFrame(data)

    facts = stored(texts.select("r", survey("text").alias("s")).select("r", "s.*"))
    every = facts.select("r", F.explode(F.arrays_zip(*kind, "p", "src")).alias("z")).select("r", "z.*")
    blocks = every.where("src < 0").drop("src")
    # Each step is written before the next begins, so the shuffles of only one stand at a time.
    shared = stored(blocks.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"))
    blocks = BitmapFilter(shared, "a").probe(blocks).where("maybe").drop("maybe")
    kinds = stored(blocks.groupBy(*kind).agg(F.min("r").alias("r0"), F.min_by("p", "r").alias("p0"), F.count(F.lit(1)).alias("copies")))

    # Equal windows have equal anchors, so where an anchor has blocks of one kind only, no windows
    # need to be looked up one by one.
    varied = stored(kinds.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("a"))
    firsts = kinds.join(varied, "a", "left_semi").groupBy(F.col("r0").alias("r")).agg(F.collect_list(F.struct(at("p0").alias("at"), n("p0").alias("n"))).alias("b"))

    def list_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch["text"].tolist()):
                some = batch.iloc[part]
                places = [np.sort(np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) for a, n in zip(some["ats"], some["ns"], strict=True)]
                found = windows_of([t.split() for t in some["text"]], places, window, hashes, exact)
                found["src"] = earlier_in_text(found, ["text", *name])
                found["r"] = some["r"].to_numpy()[found["text"].to_numpy()]
                yield found[["r", *name, "at", "src"]]

    one_word = ", words binary" if exact else ""
    looked = texts.join(firsts, "r").select("r", "text", F.col("b.at").alias("ats"), F.col("b.n").alias("ns"))
    windows = stored(looked.mapInPandas(list_windows, f"r long, k long, k2 long{one_word}, at int, src int"))
    first_windows = windows.where("src < 0").groupBy(*name).agg(F.min("r").alias("r0"), F.min_by("at", "r").alias("at0"), F.count(F.lit(1)).alias("copies"))
    first_windows = stored(first_windows.where("copies > 1").drop("copies"))

    whole = blocks.join(kinds.where("copies > 1").drop("copies"), kind).where("r <> r0").select("r", at("p").alias("at"), n("p").alias("n"), "r0", at("p0").alias("at0"))
    parts = windows.where("src < 0").join(first_windows, name).where("r <> r0").select("r", "at", F.lit(1).alias("n"), "r0", "at0")
    within = every.where("src >= 0").select("r", at("p").alias("at"), n("p").alias("n"), F.col("r").alias("r0"), F.col("src").alias("at0"))
    within_parts = windows.where("src >= 0").select("r", "at", F.lit(1).alias("n"), F.col("r").alias("r0"), F.col("src").alias("at0"))
    pointers = whole.unionByName(parts).unionByName(within).unionByName(within_parts)
    of_text = pointers.groupBy("r").agg(F.collect_list(F.struct("at", "n", "r0", "at0")).alias("p"))

    def list_factors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(r, *f) for r, at, n, source, place in batch.itertuples(index=False) for f in greedy_factors(at, n, source, place)]
            yield pd.DataFrame(found, columns=["r", "at", "n", "r0", "at0"])

    factors = stored(of_text.select("r", "p.at", "p.n", "p.r0", "p.at0").mapInPandas(list_factors, "r long, at int, n int, r0 long, at0 int"))

    # Segments of source documents, each brought once however many factors copy from it; a
    # document has as many as its length allows.
    last = F.col("at0") + F.col("n") + 2 * window - 2
    copied = factors.where("r <> r0").withColumn("part", F.explode(F.sequence(F.expr(f"at0 div {SEGMENT_WORDS}"), F.floor(last / SEGMENT_WORDS))))
    wanted = copied.select(F.col("r0").alias("r"), "part").distinct().groupBy("r").agg(F.collect_list("part").alias("parts"))

    def list_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for r, text, parts in batch.itertuples(index=False):
                words = text.split()
                found += [(r, part, b" ".join(some)) for part in parts.tolist() if (some := words[part * SEGMENT_WORDS:(part + 1) * SEGMENT_WORDS])]
            yield pd.DataFrame(found, columns=["r0", "part", "words"])

    segments = stored(texts.join(wanted, "r").select("r", "text", "parts").mapInPandas(list_segments, "r0 long, part long, words binary"))
    # Factors within a document need no segment: their reference is its own words.
    near = factors.where("r = r0").select("r", "at", "n", "at0", F.lit(-1).cast("long").alias("part"), F.lit(None).cast("binary").alias("words"))
    far = copied.join(segments, ["r0", "part"]).select("r", "at", "n", "at0", "part", "words")
    listed = far.unionByName(near).groupBy("r").agg(F.collect_list(F.struct("at", "n", "at0", "part", "words")).alias("f"))

    @pandas_udf("struct<n_removed long, sha string, spans array<array<int>>, failed long>")
    def cut_out(texts: pd.Series, ats: pd.Series, ns: pd.Series, places: pd.Series, parts: pd.Series, refs: pd.Series) -> pd.DataFrame:
        out = []
        for text, at, n, place, part, ref in zip(texts, ats, ns, places, parts, refs, strict=True):
            words, held = text.split(), {}
            for a, m, p, k, w in sorted(zip(at.tolist(), n.tolist(), place.tolist(), part.tolist(), ref, strict=True), key=lambda f: (f[0], f[3])):
                if w is None:
                    held[a] = (m, p, 0, words)
                else:
                    held.setdefault(a, (m, p, k * SEGMENT_WORDS, []))[3].extend(w.split(b" "))
            given = [(a, m, source[p - first:p - first + m + 2 * window - 1]) for a, (m, p, first, source) in held.items()]
            spans, failed = parse(words, given, window)
            kept, upto = [], 0
            for a, b in spans:
                kept += words[upto:a]
                upto = b
            out.append((sum(b - a for a, b in spans), hashlib.sha256(b" ".join(kept + words[upto:])).hexdigest(), spans, failed))
        return pd.DataFrame(out, columns=["n_removed", "sha", "spans", "failed"])

    done = texts.join(listed, "r").select("r", cut_out("text", "f.at", "f.n", "f.at0", "f.part", "f.words").alias("d")).select("r", "d.*")
    both = facts.select("r", "n_words", F.col("sha").alias("whole")).join(done, "r", "left")
    return stored(both.select(
        "r", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("sha", "whole").alias("sha"),
        F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"), F.coalesce("failed", F.lit(0)).alias("failed"),
    ))
