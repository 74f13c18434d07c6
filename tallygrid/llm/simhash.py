"""SimHash near-duplicate groups, compared bit-sliced.

1. A fingerprint bit is set if it is set in over half of the XXH64 hashes of a text's shingles.
2. Equal fingerprints collapse; only distinct ones are compared.
3. The 64 bits fall into ``blocks`` blocks. Two fingerprints within the radius differ in at most
   ``radius`` blocks, so they agree on some ``blocks - radius`` of them: each fingerprint is
   filed once for every such choice, under those bits, and only files are compared. The more
   fingerprints, the more blocks, so that files stay a few fingerprints long (``FILE``).
4. A file's fingerprints stand as bit planes: word w of plane b holds bit b of 64 fingerprints.
   A query is compared with all of them at once; carry-save adders count the differing bits
   per lane, and a block of lanes is abandoned once every lane exceeds the radius.
5. Links of a file become a spanning forest before they leave the task, never all pairs.
   Queries are leaders first: members that a leader covers are linked by it, and of them only
   those outside the file's largest component are compared with the rest. Each pair of
   different components has a member outside the largest, so no link between components is lost,
   while a file of thousands of near copies costs little more than its size.
6. Files of more than ``tile`` fingerprints are cut into tiles by a hash, and each pair of tiles
   is a task of its own. Components are then found by Spark over the forest's edges.

Edge cases: a null or empty text has no shingles and fingerprint zero, linked like any other;
a text of fewer words than a shingle is one shingle; ties in a bit leave it unset; null ids get
their group's least id, or null if it has none; repeated rows get equal results; other columns
are never read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallygrid.llm._common import cut, stored
from tallygrid.llm._graph import components

BITS = 64
#: Fingerprints that a file may hold on average if they are spread evenly.
FILE = 8
#: Shingles hashed at a time, so that a very long text takes bounded memory.
SHINGLE_BLOCK = 50_000
#: Files of at most so many fingerprints are compared pair by pair of lanes, many files at once.
SMALL_FILE = 48
#: Lanes of a block, in words of 64, and queries compared with it at a time.
BLOCK_WORDS, QUERY_BATCH = 64, 64
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(text: bytes | None, shingle: int, seed: int = 42) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(joined)]))
    n, counts, digest = len(words) - k + 1, np.zeros(BITS, np.int64), xxhash.xxh64_digest
    for at in range(0, n, SHINGLE_BLOCK):
        upto = min(at + SHINGLE_BLOCK, n)
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at:upto].tolist(), ends[at + k - 1:upto + k - 1].tolist(), strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """The fingerprint of each text, as a signed long."""

    @pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        found = np.fromiter((simhash(t, shingle, seed) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return of(text.cast("binary"))


def exceeds(planes: Iterator[np.ndarray], radius: int) -> np.ndarray:
    """Lanes, as bits, in which more than ``radius`` of the difference planes are set.

    Planes come in pairs into carry-save adders. Stops once all lanes exceed the radius.
    """
    counters: list[np.ndarray] = []
    over = None
    for step, (one, two) in enumerate(zip(planes, planes, strict=True)):
        if over is None:
            counters = [np.zeros_like(one) for _ in range(radius.bit_length())]
            over = np.zeros_like(one)
        if counters:
            half = counters[0] ^ one
            carry = (counters[0] & one) | (half & two)
            counters[0] = half ^ two
            for i in range(1, len(counters)):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
            over |= carry
        else:
            over |= one | two
        if step % 4 == 3:
            far = _above(counters, over, radius)
            if (far == ONES).all():
                return far
    return _above(counters, over, radius)


def _above(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is above ``radius``."""
    above, equal = over.copy(), ~over
    for i in range(len(counters) - 1, -1, -1):
        if radius >> i & 1:
            equal = equal & counters[i]
        else:
            above |= equal & counters[i]
            equal = equal & ~counters[i]
    return above


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words) planes of unsigned values; lanes beyond the last value are zero."""
    lanes = -(-len(values) // 64) * 64
    padded = np.zeros(lanes, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    """Bits of the last axis as booleans, the first ``n``."""
    flat = np.ascontiguousarray(words).view(np.uint8)
    return np.unpackbits(flat, axis=-1, bitorder="little")[..., :n].astype(bool)


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) differ in at most ``radius`` bits; a lane per pair."""
    near = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        planes = bit_planes(a[at:at + (1 << 16)] ^ b[at:at + (1 << 16)])
        near[at:at + (1 << 16)] = ~_lanes(exceeds(iter(planes), radius), min(1 << 16, len(a) - at))
    return near


def lanes_within(queries: np.ndarray, values: np.ndarray, planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position in queries, position in values) within the radius."""
    masks = np.where(queries[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None] & np.uint64(1), ONES, np.uint64(0))
    left, right = [], []
    for at in range(0, planes.shape[1], BLOCK_WORDS):
        block = planes[:, at:at + BLOCK_WORDS]
        far = exceeds((block[b][None, :] ^ masks[b][:, None] for b in range(BITS)), radius)
        if (far == ONES).all():
            continue
        q, lane = np.nonzero(~_lanes(far, min(block.shape[1] * 64, len(values) - at * 64)))
        left.append(q)
        right.append(lane + at * 64)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def settle(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels of nodes joined by the links u-v: the least label of each component."""
    while True:
        least = np.minimum(labels[u], labels[v])
        new = labels.copy()
        np.minimum.at(new, labels[u], least)
        np.minimum.at(new, labels[v], least)
        new = np.minimum(new, new[labels])
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def link_file(values: np.ndarray, radius: int) -> np.ndarray:
    """A label per member of one large file; equal labels: joined by links within the file."""
    n, planes = len(values), bit_planes(values)
    labels, covered, asked = np.arange(n), np.zeros(n, bool), np.zeros(n, bool)

    def ask(members: np.ndarray) -> None:
        nonlocal labels
        q, lane = lanes_within(values[members], values, planes, radius)
        labels = settle(labels, members[q], lane)
        asked[members] = covered[members] = covered[lane] = True

    while not covered.all():
        ask(np.flatnonzero(~covered)[:QUERY_BATCH])
    while True:
        largest = np.bincount(labels).argmax()
        rest = np.flatnonzero(~asked & (labels != largest))
        if not len(rest):
            return labels
        ask(rest[:QUERY_BATCH])


def forest(files: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges over members of equal ``files`` numbers (rows stand file by file)."""
    starts = np.flatnonzero(np.concatenate(([True], files[1:] != files[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(files)])))
    labels = np.arange(len(values))
    small = np.repeat(sizes <= SMALL_FILE, sizes)
    u, v = [], []
    for lag in range(1, min(SMALL_FILE, int(sizes.max(initial=1)))):
        i = np.flatnonzero(small[:-lag] & (files[lag:] == files[:-lag]))
        if not len(i):
            break
        i = i[pairs_within(values[i], values[i + lag], radius)]
        u.append(i)
        v.append(i + lag)
    if u:
        labels = settle(labels, np.concatenate(u), np.concatenate(v))
    for k in np.flatnonzero(sizes > SMALL_FILE):
        at = slice(starts[k], starts[k] + sizes[k])
        labels[at] = starts[k] + link_file(values[at], radius)
    out = np.flatnonzero(labels != np.arange(len(values)))
    return values[out], values[labels[out]]


def blocks_for(n: int, radius: int) -> int:
    """Blocks for ``n`` fingerprints: two over the radius, or more until files are short."""
    blocks = min(radius + 2, BITS)
    while blocks < min(radius + 6, BITS) and n > FILE << (BITS * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def link(distinct: DataFrame, radius: int = 4, blocks: int | None = None, tile: int = 8192) -> DataFrame:
    """Edges ``a``, ``b`` that join all fingerprints (column ``fp``) within the radius."""
    blocks = blocks_for(distinct.count(), radius) if blocks is None else blocks
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("blocks must exceed the radius")
    edges = np.linspace(0, BITS, blocks + 1).round().astype(int)
    parts = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) - ((sum(c) >> 63) << 64) for c in combinations(parts, blocks - radius)]
    filed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)
    ])).alias("k")).select("k.t", "k.bits", "fp")

    large = cut(filed.groupBy("t", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile))
    n_large = large.count()
    if n_large:
        # A large file is cut into tiles by hash; each pair of tiles is a file of its own.
        hint = F.broadcast if n_large <= 100_000 else (lambda df: df)
        tiles = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(tile)).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        filed = (
            filed.join(hint(large), ["t", "bits"], "left").withColumn("tiles", tiles).withColumn("own", own)
            .select("t", "bits", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
            .select("t", "bits", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        )
    else:
        filed = filed.select("t", "bits", "fp", F.lit(0).alias("i"), F.lit(0).alias("j"))
    keys = ["t", "bits", "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of files that may go on in the next batch

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            files = np.concatenate(([0], np.cumsum((rows[keys].to_numpy()[1:] != rows[keys].to_numpy()[:-1]).any(axis=1))))
            a, b = forest(files, rows["fp"].to_numpy().view(np.uint64), radius)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for batch in batches:
            if not len(batch):
                continue
            last = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
            first_of_last = int(np.argmax(last))
            if first_of_last:
                yield done(pd.concat([*held, batch.iloc[:first_of_last]]))
                held = [batch.iloc[first_of_last:]]
            elif held and (held[-1][keys].iloc[-1] != batch[keys].iloc[-1]).any():
                yield done(pd.concat(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield done(pd.concat(held))

    return filed.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, blocks: int | None = None, tile: int = 8192,
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``fp`` (signed long) and ``component_id``."""
    prints = cut(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), shingle).alias("fp")))
    least = prints.groupBy("fp").agg(F.min("id").alias("id"))
    labelled = _labelled(least, radius, blocks, tile)
    # A written table of one row per group: Spark then splits the partition of a large group.
    groups = stored(labelled.groupBy("label").agg(F.min("id").alias("component_id")))
    of_print = labelled.join(groups, "label").select("fp", "component_id")
    return prints.join(of_print, "fp").select("id", "fp", "component_id")


def _labelled(distinct: DataFrame, radius: int, blocks: int | None, tile: int) -> DataFrame:
    """``distinct`` (a row per fingerprint) with the ``label`` of its component."""
    labels = components(link(distinct.select("fp"), radius, blocks, tile))
    return distinct.join(labels, F.col("fp") == F.col("node"), "left").select(*distinct.columns, F.coalesce("label", "fp").alias("label"))


def row_key(id_col: str, text_col: str) -> Column:
    """What names a document: its id, null ids last, and 128 bits of its text; never null."""
    text, known = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    return F.struct(known.isNull().alias("no_id"), known.alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit("k")).alias("h2"))


def keep_rows(docs: DataFrame, stays: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose :func:`row_key` is in ``stays`` (column ``k``), one for each."""
    # The key is never null: one exchange serves the join and what follows.
    rows = docs.select(row_key(id_col, text_col).alias("k"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(stays, "k", "left_semi").dropDuplicates(["k"]).select("row.*")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, blocks: int | None = None, tile: int = 8192,
) -> DataFrame:
    """``docs`` with one document of each group: the one with the group's least id, or one of
    those without an id if no document of the group has one."""
    prints = cut(docs.select(row_key(id_col, text_col).alias("k"), fingerprints(F.col(text_col), shingle).alias("fp")))
    least = prints.groupBy("fp").agg(F.min("k").alias("k"))
    stays = _labelled(least, radius, blocks, tile).groupBy("label").agg(F.min("k").alias("k")).select("k")
    return keep_rows(docs, stays, id_col, text_col)
