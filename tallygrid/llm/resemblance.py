"""SimHash near-duplicates at a similarity of shingle sets, confirmed on the sets themselves.

The form of :mod:`tallygrid.llm.simhash` for pipelines: two texts are linked if the Jaccard
similarity of their sets of shingles (runs of ``shingle`` words) is at least ``least``; groups are
the components. At 0.8 the fingerprints of two sets differ in about 10 of 64 bits, too many to be
found by agreeing blocks of bits, so candidates are filed by minima of shingles instead, and within
the files fingerprints are compared bit-sliced as in the fixed-radius form.

1. **Files.** Equal sets collapse. Each distinct set gets ``BANDS`` hashes of ``ROWS`` minima each;
   sets that share a band are candidates. At a similarity of 0.8 a pair shares none with
   probability (1 - 0.8 ** 5) ** 30 = 7e-6, so the candidates' components, the clusters, hold the
   links. Only the texts of clusters of two or more are read again. A cluster is cut into tiles of
   about ``tile`` shingles by a hash; each tile, with the cluster's first text, is a task's file.
2. **Bit-sliced comparison.** A fingerprint bit is set if it is set in over half of the set's
   shingle hashes. Bit planes of a file's fingerprints go through carry-save counters against
   each query, and blocks of lanes are abandoned once all exceed the radius, which leaves out
   pairs that differ by six standard deviations more than sets of similarity ``least`` do.
3. **Confirmation.** Pairs within the radius are compared on their sets, exactly.
4. Where a cluster has several tiles, the texts outside its largest component are compared with
   every tile. Each pair of different components has a text outside the largest, so no link
   between components is lost, while a great cluster of near copies costs about its size.

Edge cases: words and case are ASCII only, as in the fingerprints; a text of fewer words than a
shingle is one shingle; texts without words are equal; of a group without ids one text stays;
nulls, repeated rows and equal ids with different texts are as :func:`tallygrid.llm.simhash.row_key`
says; an empty table gives an empty result; extra columns travel along.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, pi, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallygrid.llm._common import cut, stored
from tallygrid.llm._graph import components
from tallygrid.llm.simhash import BITS, QUERY_BATCH, SHINGLE_BLOCK, SMALL_FILE, bit_planes, keep_rows, lanes_within, pairs_within, row_key, settle

BANDS, ROWS = 30, 5
#: Shingles whose minima are taken at a time.
MINIMA_BLOCK = 512
#: Odd factors, one for each minimum.
FACTORS = np.random.default_rng(20).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The sorted different hashes of a text's shingles."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    k, digest, parts = min(shingle, len(words)), xxhash.xxh64_digest, []
    for at in range(0, len(words) - k + 1 if words else 0, SHINGLE_BLOCK):
        some = words[at:at + SHINGLE_BLOCK + k - 1]
        hashes = b"".join([digest(b" ".join(some[i:i + k])) for i in range(len(some) - k + 1)])
        parts.append(np.frombuffer(hashes, ">u8").astype(np.uint64))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def band_hashes(hashes: np.ndarray) -> np.ndarray:
    """A hash per band of the set's minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), MINIMA_BLOCK):
        np.minimum(least, (FACTORS[:, None] * hashes[None, at:at + MINIMA_BLOCK]).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(one.tobytes(), i) for i, one in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """Each bit set if it is set in over half of the hashes."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).view(">u8").astype(np.uint64)[0]


def radius_for(least: float) -> int:
    """Bits in which fingerprints of sets of similarity ``least`` or more differ at most: the mean
    and six standard deviations."""
    p = acos(2 * least / (1 + least)) / pi
    return min(ceil(BITS * p + 6 * sqrt(BITS * p * (1 - p))), BITS - 1)


class Sets:
    """Shingle sets of some texts with their fingerprints."""

    def __init__(self, sets: list[np.ndarray], least: float):
        self.sizes = np.array([len(s) for s in sets])
        self.starts = np.cumsum(self.sizes) - self.sizes
        names, self.shingles = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(names), np.int64)
        self.prints = np.array([fingerprint(s) for s in sets], np.uint64)
        self.least, self.radius = least, radius_for(least)

    def similar(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of the ``others`` have the least similarity with a set, exactly."""
        own = self.shingles[self.starts[one]:self.starts[one] + self.sizes[one]]
        self.mark[own] = 1
        sizes = self.sizes[others]
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts[others] - ends + sizes, sizes) + np.arange(sizes.sum())
        shared = np.add.reduceat(self.mark[self.shingles[places]], ends - sizes)
        self.mark[own] = 0
        return shared >= self.least * (sizes + self.sizes[one] - shared) - 1e-9

    def small(self, members: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs of a small file's members of which one asks."""
        i, j = np.triu_indices(len(members), 1)
        some = asks[members[i]] | asks[members[j]]
        return members[i[some]], members[j[some]]

    def large(self, members: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links that join all that a large file's members that ask are linked to."""
        n, own = len(members), asks[members]
        planes = bit_planes(self.prints[members])
        labels, covered, asked, links = np.arange(n), np.zeros(n, bool), np.zeros(n, bool), []

        def ask(some: np.ndarray) -> None:
            nonlocal labels
            q, lane = lanes_within(self.prints[members[some]], self.prints[members], planes, self.radius)
            asked[some] = covered[some] = True
            for k in np.unique(q):
                near = lane[q == k]
                near = near[self.similar(members[some[k]], members[near])]
                covered[near] = True
                links.append((np.full(len(near), some[k]), near))
                labels = settle(labels, *links[-1])

        while len(rest := np.flatnonzero(own & ~covered)):
            ask(rest[:QUERY_BATCH])
        # Those that a leader covers need not ask if they are in the largest component, unless
        # others do not ask at all.
        while True:
            least_asking = np.bincount(labels).argmax() if own.all() else -1
            rest = np.flatnonzero(own & ~asked & (labels != least_asking))
            if not len(rest):
                break
            ask(rest[:QUERY_BATCH])
        u, v = (np.concatenate(x) for x in zip(*links, strict=True)) if links else (np.zeros(0, int),) * 2
        return members[u], members[v]


def link_sets(sets: list[np.ndarray], files: np.ndarray, least: float, asks: np.ndarray) -> np.ndarray:
    """A label per set; equal labels: joined by links, within files, of the sets that ask."""
    data, labels, left, right = Sets(sets, least), np.arange(len(sets)), [], []
    starts = np.flatnonzero(np.concatenate(([True], files[1:] != files[:-1])))
    for a, b in zip(starts, [*starts[1:], len(sets)]):
        members = np.arange(a, b)
        if b - a > SMALL_FILE:
            labels = settle(labels, *data.large(members, asks))
        else:
            i, j = data.small(members, asks)
            left.append(i)
            right.append(j)
    if left:
        i, j = np.concatenate(left), np.concatenate(right)
        near = pairs_within(data.prints[i], data.prints[j], data.radius)
        i, j = i[near], j[near]
        same = np.array([data.similar(a, j[k:k + 1])[0] for k, a in enumerate(i)], bool)
        labels = settle(labels, i[same], j[same])
    return labels


def _links(files: DataFrame, shingle: int, least: float) -> DataFrame:
    """Edges ``a``, ``b`` among the sets ``s`` of each file (``cluster``, ``i``, ``j``), those of
    its rows with ``query``, or of all rows if none has it."""
    keys = ["cluster", "i", "j"]

    def done(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True).sort_values([*keys, "query"], ascending=[True] * 3 + [False], kind="stable").drop_duplicates([*keys, "s"])
        s, file = rows["s"].to_numpy(), rows.groupby(keys).ngroup().to_numpy()
        asks = rows["query"].to_numpy(bool)
        asks |= ~np.bincount(file, asks).astype(bool)[file]  # where none is a query all are
        labels = link_sets([shingle_set(t, shingle) for t in rows["text"]], file, least, asks)
        out = np.flatnonzero(labels != np.arange(len(s)))
        return pd.DataFrame({"a": s[out], "b": s[labels[out]]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows whose last file may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            last = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
            first_of_last = int(np.argmax(last))
            if first_of_last:
                yield done([*held, batch.iloc[:first_of_last]])
                held = [batch.iloc[first_of_last:]]
            elif held and (held[-1][keys].iloc[-1] != batch[keys].iloc[-1]).any():
                yield done(held)
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield done(held)

    rows = files.select(*keys, "s", "query", F.col("text").cast("binary").alias("text"))
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "a long, b long")


def labels_of(docs: DataFrame, prints: DataFrame, text_col: str, shingle: int, least: float, tile: int) -> DataFrame:
    """``s`` and ``label`` for every set of ``prints`` (``k``, ``s``, ``n``, ``bands``) that is
    not itself its group's label."""
    sets = prints.groupBy("s").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    filed = cut(sets.select("s", F.explode("bands").alias("band")))
    shared = filed.groupBy("band").agg(F.min("s").alias("b"), F.max("s").alias("most")).where("b <> most").select("band", "b")
    near = components(filed.join(shared, "band").where("s <> b").select(F.col("s").alias("a"), "b"))
    clusters = near.select(F.col("node").alias("s"), F.col("label").alias("cluster")).unionByName(
        near.select(F.col("label").alias("s"), F.col("label").alias("cluster")).distinct())

    # One text of each set of a cluster.
    texts = prints.groupBy("s").agg(F.min(F.struct("k.h", "k.h2")).alias("t"), F.first("n").alias("n")).join(clusters, "s")
    whole = row_key("id", "text")
    rows = docs.select(F.lit(None).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.struct(whole["h"].alias("h"), whole["h2"].alias("h2")).alias("t"), "text")
    held = stored(rows.join(texts, "t").groupBy("t").agg(F.first("s").alias("s"), F.first("n").alias("n"), F.first("cluster").alias("cluster"), F.first("text").alias("text")))

    def pieces(weight: str):
        return F.greatest(F.ceil(F.col(weight) / F.lit(tile)), F.lit(1)).cast("int")

    # Clusters of one tile are not listed.
    large = cut(held.groupBy("cluster").agg(F.sum("n").alias("weight")).where(F.col("weight") > tile).select("cluster", pieces("weight").alias("tiles")))
    own = F.pmod(F.xxhash64("s"), F.coalesce("tiles", F.lit(1))).cast("int")
    tiled = held.join(large, "cluster", "left").withColumn("i", own)
    # The cluster's first text goes with every tile.
    first = tiled.where("s = cluster AND tiles > 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    files = tiled.select("cluster", "i", "s", "text").unionByName(first.select("cluster", "i", "s", "text"))
    edges = cut(_links(files.withColumn("j", F.lit(0)).withColumn("query", F.lit(False)), shingle, least))
    found = components(edges)
    if large.isEmpty():
        return found.select(F.col("node").alias("s"), "label")

    labelled = tiled.where("tiles > 1").join(found, F.col("s") == F.col("node"), "left").withColumn("label", F.coalesce("label", "s")).drop("node")
    sizes = labelled.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("cluster").agg(F.max_by("label", F.struct("m", "label")).alias("largest"))
    labelled = stored(labelled.join(largest, "cluster"))
    outside = labelled.where("label <> largest")
    chunks = outside.groupBy("cluster").agg(F.sum("n").alias("w")).select("cluster", pieces("w").alias("chunks"))
    asking = outside.join(chunks, "cluster").select(
        "cluster", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("i"), F.pmod(F.xxhash64("s", F.lit(1)), F.col("chunks")).cast("int").alias("j"), "s", F.lit(True).alias("query"), "text")
    asked = labelled.join(chunks, "cluster").select(
        "cluster", "i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), "s", F.lit(False).alias("query"), "text")
    more = _links(asking.unionByName(asked), shingle, least)
    return components(edges.unionByName(more)).select(F.col("node").alias("s"), "label")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, tile: int = 1_000_000,
) -> DataFrame:
    """``docs`` with one document of each group: the one with the group's least id, or one of
    those without an id if no document of the group has one."""

    @pandas_udf("struct<s long, n long, bands array<long>>")
    def marks(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            hashes = shingle_set(t, shingle)
            out.append((np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).astype(np.int64), len(hashes), band_hashes(hashes).view(np.int64) if len(hashes) else np.zeros(0, np.int64)))
        return pd.DataFrame(out, columns=["s", "n", "bands"])

    prints = stored(docs.select(row_key(id_col, text_col).alias("k"), marks(F.col(text_col).cast("binary")).alias("m")).select("k", "m.*"))
    labels = labels_of(docs, prints, text_col, shingle, least, tile).withColumnRenamed("label", "_label")
    firsts = prints.groupBy("s").agg(F.min("k").alias("k")).join(labels, "s", "left")
    stays = firsts.groupBy(F.coalesce("_label", "s").alias("label")).agg(F.min("k").alias("k")).select("k")
    return keep_rows(docs, stays, id_col, text_col)
