"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are turned into integers, so that every product is exact, and ordered by length. Runs of
them are **buckets**; a range of buckets is a **group**, of which there are as many as shuffle
partitions.

1. Every query is scored against the bucket of the longest vectors, which is broadcast: one bucket
   of at most ``bucket`` vectors and ``BUCKET_BYTES``. Its k-th best score is the query's floor.
2. A candidate shorter than floor / length of the query cannot reach the floor. Queries are ordered
   by that least length and packed into blocks; a block meets the groups, and in them the buckets,
   that hold longer vectors. Blocks and buckets are joined by the group's number, so the vectors
   move once per block and live group, never once per pair of vectors.
3. For each query and bucket the **local threshold** is floor / (length of the query * longest of
   the bucket), the cosine that a candidate must have. Above 1 the bucket is left out. From
   ``coordinate_from`` on candidates are told by coordinates: a unit vector at such an angle has
   each coordinate in an interval around the query's, so the query's ``focus`` largest coordinates
   cut ranges out of the bucket's coordinates in order, the narrowest is listed and the others
   filter it. Below, the threshold keeps most directions, and the bucket is cut by length alone.
4. What is left is verified by integer products. Floors rise while a block runs through a group;
   the best of each group meet in a window over at most ``k`` rows per query and group.

All bounds have a relative slack of 1e-9, and nothing is approximated: the pruning only leaves out
products that cannot be among the best.

Edge cases: a vector that is null or holds a null, NaN or infinity takes no part; an empty vector
scores 0; vectors of different lengths are compared as if the shorter ended in zeros; components
and scores beyond the range of a long are at its ends; rows that share the query's id are its own
and no candidates; a null id equals no other, and ties put it last; a repeated query row has its
results once per row; an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygrid.llm._common import stored

#: Vectors of a bucket and of a query block, and bytes of a bucket.
BUCKET, BLOCK, BUCKET_BYTES = 2048, 512, 8 << 20
#: The most groups of buckets: their lengths are the only thing that the driver gets.
MOST_GROUPS = 4096
#: Rows of a batch between Spark and Python: each may hold a bucket and a block.
PAYLOAD_ROWS = "8"
SLACK = 1e-9
EXACT = float(2**53)
LONG = np.iinfo(np.int64)
PACKED = "part int, number int, n int, width int, kind string, longest double, need double, ids array<long>, floors array<long>, vectors binary"


def integer_vectors(vector: Column, scale: float) -> Column:
    """The components times ``scale``, rounded down; null if a vector takes no part."""
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    odd = F.exists(scaled, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~odd, F.transform(scaled, lambda x: F.floor(x)))


def length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Runs of at most ``most`` rows (``id``, ``v``, ``length``, ``floor``, ``need``) of each
    partition, in order, as one row each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            width = max(int(sizes.max(initial=0)), 1)
            step = max(1, min(most, BUCKET_BYTES // (8 * width)))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                v, own = some.column("v"), np.diff(some.column("v").offsets.to_numpy())
                flat = v.flatten().to_numpy(zero_copy_only=False)
                wide = max(int(own.max(initial=0)), 1)
                dense = np.zeros((len(own), wide), np.int64)
                dense[np.arange(wide) < own[:, None]] = flat
                kind = next(t for t in ("int8", "int16", "int32", "int64") if flat.size == 0 or np.iinfo(t).min <= flat.min() and flat.max() <= np.iinfo(t).max)
                lengths, need = (some.column(c).to_numpy() for c in ("length", "need"))
                out = [part, number, len(own), wide, kind, float(lengths.max()), float(need.min()), some.column("id").to_pylist(), some.column("floor").to_pylist(), dense.astype(kind).tobytes()]
                types = [pa.int32()] * 4 + [pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                yield pa.record_batch([pa.array([x], t) for x, t in zip(out, types, strict=True)], PACKED_NAMES)
                number += 1

    return rows.select("id", "v", "length", "floor", "need").mapInArrow(pack, PACKED)


PACKED_NAMES = [c.split(" ")[0] for c in PACKED.split(", ")]


class Vectors:
    """Some packed vectors; a null id is the greatest long."""

    def __init__(self, n: int, width: int, kind: str, ids: list, vectors: bytes):
        self.known = np.array([i is not None for i in ids], bool)
        self.ids = np.array([LONG.max if i is None else i for i in ids], np.int64)
        self.whole = np.frombuffer(vectors, kind).reshape(n, width)
        self.x = self.whole.astype(float)
        self.lengths = np.sqrt((self.x * self.x).sum(axis=1))
        self._unit: np.ndarray | None = None
        self._orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @property
    def unit(self) -> np.ndarray:
        if self._unit is None:
            self._unit = np.divide(self.x, self.lengths[:, None], out=np.zeros_like(self.x), where=self.lengths[:, None] > 0)
        return self._unit

    def in_order(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in order of a coordinate of the unit vectors, and its values in that order."""
        if coordinate not in self._orders:
            order = np.argsort(self.unit[:, coordinate], kind="stable")
            self._orders[coordinate] = order, self.unit[order, coordinate]
        return self._orders[coordinate]

    def products(self, lanes: np.ndarray, other: Vectors, places: np.ndarray | slice) -> np.ndarray:
        """Integer inner products of some of these vectors with some of the others."""
        d = min(self.x.shape[1], other.x.shape[1])
        if self.lengths.max(initial=0) * other.lengths.max(initial=0) < EXACT:
            return np.rint(self.x[lanes, :d] @ other.x[places, :d].T).astype(np.int64)
        exact = self.whole[lanes, :d].astype(object) @ other.whole[places, :d].astype(object).T
        return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


def by_coordinates(query: np.ndarray, threshold: float, bucket: Vectors, focus: int) -> np.ndarray:
    """Places of the bucket's vectors whose coordinates allow a cosine of ``threshold`` with the
    unit vector ``query``: of its ``focus`` largest coordinates, each must lie in its interval."""
    width = min(len(query), bucket.x.shape[1])
    angle = np.arccos(min(1.0, threshold))
    spans, narrowest = [], None
    for f in np.argsort(-np.abs(query[:width]))[:focus]:
        own = np.arccos(np.clip(query[f], -1, 1))
        low, high = np.cos(min(np.pi, own + angle)) - SLACK, np.cos(max(0.0, own - angle)) + SLACK
        order, values = bucket.in_order(f)
        a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
        spans.append((f, low, high))
        if narrowest is None or b - a < len(narrowest):
            narrowest = order[a:b]
    for f, low, high in spans:
        x = bucket.unit[narrowest, f]
        narrowest = narrowest[(x >= low) & (x <= high)]
    return narrowest


class Best:
    """The best candidates of each query of a block so far."""

    def __init__(self, block: Vectors, floors: list, k: int):
        self.block, self.k = block, k
        self.floor = np.array([LONG.min if f is None else f for f in floors], np.int64)
        self.last = np.full(len(self.floor), LONG.max)
        self.found = np.zeros((0, 4), np.int64)  # query, score, candidate's id, whether it is known

    def add(self, lanes: np.ndarray, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Pairs of a query and a candidate; what the queries' floors leave is kept."""
        own = self.block.known[lanes] & known & (self.block.ids[lanes] == ids)
        stays = ~own & ((scores > self.floor[lanes]) | (scores == self.floor[lanes]) & (ids <= self.last[lanes]))
        if not stays.any():
            return
        rows = np.concatenate([self.found, np.stack([lanes[stays], scores[stays], ids[stays], known[stays]], axis=1)])
        # ~score falls where the score rises, without an overflow.
        rows = rows[np.lexsort((1 - rows[:, 3], rows[:, 2], ~rows[:, 1], rows[:, 0]))]
        starts = np.concatenate(([True], rows[1:, 0] != rows[:-1, 0]))
        place = np.arange(len(rows)) - np.maximum.accumulate(np.where(starts, np.arange(len(rows)), 0))
        self.found = rows[place < self.k]
        full = rows[place == self.k - 1]
        self.floor[full[:, 0]], self.last[full[:, 0]] = full[:, 1], full[:, 2]

    def meet(self, bucket: Vectors, coordinate_from: float, focus: int) -> dict[str, int]:
        """Retrieve from a bucket, whose vectors are in falling order of length; the number of
        queries that were ``left_out``, took ``coordinates`` or took ``lengths``."""
        longest = bucket.lengths.max(initial=0)
        reach = self.block.lengths * longest
        floor = self.floor.astype(float)
        local = np.divide(floor, reach, out=np.where(floor > 0, np.inf, -np.inf), where=reach > 0) * (1 - SLACK)
        out = local > 1
        narrow = ~out & (local >= coordinate_from)
        for q in np.flatnonzero(narrow):
            places = by_coordinates(self.block.unit[q], local[q], bucket, focus)
            if len(places):
                scores = self.block.products(np.array([q]), bucket, places)[0]
                self.add(np.full(len(places), q), scores, bucket.ids[places], bucket.known[places])
        wide = np.flatnonzero(~out & ~narrow)
        if len(wide):
            need = np.divide(floor[wide], self.block.lengths[wide], out=np.full(len(wide), -np.inf), where=self.block.lengths[wide] > 0).min() * (1 - SLACK)
            most = int(np.searchsorted(-bucket.lengths, -need, "right")) if need > 0 else len(bucket.ids)
            scores = self.block.products(wide, bucket, slice(0, most))
            lane, place = np.nonzero(scores >= self.floor[wide][:, None])
            self.add(wide[lane], scores[lane, place], bucket.ids[place], bucket.known[place])
        return {"left_out": int(out.sum()), "coordinates": int(narrow.sum()), "lengths": len(wide)}


def _read(batch: pa.RecordBatch, i: int, prefix: str) -> dict:
    return {c.removeprefix(prefix): batch.column(c)[i].as_py() for c in batch.schema.names if c.startswith(prefix)}


def _vectors(row: dict) -> Vectors:
    return Vectors(row["n"], row["width"], row["kind"], row["ids"], row["vectors"])


def _met(blocks: DataFrame, buckets: DataFrame) -> DataFrame:
    """Blocks (``q_`` columns) with the buckets (``b_`` columns) of their group that are long enough
    for one of their queries."""
    own, other = ([F.col(c).alias(f"{p}_{c}") for c in PACKED_NAMES] for p in "qb")
    joined = blocks.select("group", *own).hint("merge").join(buckets.select("group", *other), "group").drop("group")
    return joined.where(F.col("b_longest") * (1 + SLACK) >= F.col("q_need"))


def _blocks(batches: Iterator[pa.RecordBatch], k: int, coordinate_from: float, focus: int) -> Iterator[tuple[tuple, Best]]:
    """Each run of rows of one block, and its best over the run's buckets."""
    now, best, held, bucket = None, None, None, None
    for batch in batches:
        for i in range(batch.num_rows):
            key = batch.column("q_part")[i].as_py(), batch.column("q_number")[i].as_py()
            if key != now:
                if best is not None:
                    yield now, best
                q = _read(batch, i, "q_")
                now, best = key, Best(_vectors(q), q["floors"], k)
            key = batch.column("b_part")[i].as_py(), batch.column("b_number")[i].as_py()
            if key != held:
                held, bucket = key, _vectors(_read(batch, i, "b_"))
            best.meet(bucket, coordinate_from, focus)
    if best is not None:
        yield now, best


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0,
    bucket: int = BUCKET, block: int = BLOCK, coordinate_from: float = 0.7, focus: int = 4,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` candidates with the highest
    integer inner product for each query, ties to the smaller id."""
    spark = candidates.sparkSession
    groups = min(MOST_GROUPS, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def prepared(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("id"), integer_vectors(F.col(vector_col), scale).alias("v")).where("v IS NOT NULL")
        return v.withColumn("length", length(F.col("v"))).withColumn("floor", F.lit(None).cast("long")).withColumn("need", F.lit(0.0))

    def in_order(df: DataFrame, parts: int, *order: Column) -> DataFrame:
        return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, best in _blocks(batches, k, coordinate_from, focus):
            own, lengths = best.block, best.block.lengths
            some = np.bincount(best.found[:, 0], minlength=len(lengths)) == k
            need = np.divide(best.floor, lengths, out=np.zeros(len(lengths)), where=some & (best.floor > 0) & (lengths > 0))
            yield pa.record_batch(
                [pa.array(own.ids, mask=~own.known), pa.array(list(own.whole.astype(np.int64)), pa.list_(pa.int64())), pa.array(lengths), pa.array(best.floor, mask=~some), pa.array(need)],
                ["id", "v", "length", "floor", "need"])

    def retrieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, number), best in _blocks(batches, k, coordinate_from, focus):
            lane, score, ids, known = best.found.T
            of = [pa.array(np.full(len(lane), x, np.int32)) for x in (part, number)]
            yield pa.record_batch(
                [*of, pa.array(lane.astype(np.int32)), pa.array(best.block.ids[lane], mask=~best.block.known[lane]), pa.array(ids, mask=known == 0), pa.array(score)],
                ["part", "number", "lane", "query_id", "vec_id", "score"])

    by_length = in_order(prepared(candidates), groups, F.desc("length"), F.asc_nulls_last("id"))
    buckets = stored(packed(by_length, bucket).withColumn("group", F.col("part")), str(bucket))
    # One number a group.
    longest = [(r["group"], r["longest"]) for r in buckets.groupBy("group").agg(F.max("longest").alias("longest")).orderBy("group").collect()]
    nearest = longest[0][0] if longest else 0

    asked = stored(packed(prepared(queries), block).withColumn("group", F.lit(nearest)), str(block))
    n_blocks = asked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] // block + 1
    first = F.broadcast(buckets.where((F.col("group") == nearest) & (F.col("number") == 0)))
    seeds = stored(_met(asked, first).mapInArrow(seed, "id long, v array<long>, length double, floor long, need double"), PAYLOAD_ROWS)
    blocks = stored(packed(in_order(seeds, min(groups, n_blocks), F.desc("need"), F.asc_nulls_last("id")), block), str(block))
    alive = F.filter(F.array(*[F.struct(F.lit(g).alias("group"), F.lit(x).alias("longest")) for g, x in longest]), lambda g: g["longest"] * (1 + SLACK) >= F.col("need"))
    live = blocks.withColumn("group", F.explode(F.transform(alive, lambda g: g["group"]))) if longest else blocks.withColumn("group", F.lit(0))

    found = stored(_met(live, buckets).mapInArrow(retrieve, "part int, number int, lane int, query_id long, vec_id long, score long"), PAYLOAD_ROWS)
    best_first = Window.partitionBy("part", "number", "lane").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
