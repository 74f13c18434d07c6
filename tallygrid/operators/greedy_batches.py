"""Batches of consecutive items (W6) that spread one key over many tasks.

A batch ends before the item that would exceed the limit, so each start settles the next: a chain
of greedy jumps, sequential within a key. Here it is followed in parallel:

1. Items are dealt by ranges of key and order, and each task batches its own runs of keys by prefix
   sums, as if a batch began where the run does. That is right for every run but those that go on
   from the range before, of which a range has one at most.
2. Such a run keeps, for every place at which a batch could begin, the last start of the chain from
   there within the run (its **exit**) and how many starts there are. Chains soon meet, so a run has
   few exits.
3. What an exit carries on fixes the range and the place of the next start, and so the next exit:
   one edge per exit. The exits from a key's first item on are marked by pointer doubling, in as
   many rounds as the logarithm of the number of ranges.
4. Each run takes its first start and the number of batches before it from the marked edges, and
   batches its items again.

The driver gets numbers about at most two runs of each range, and no item.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.shared import stored

EXITS = "chain long, seq long, exit long, to_seq long, carry long, fresh boolean"
EDGES = "chain long, seq long, exit long, to_seq long, to_exit long, at long, starts long"
#: The last item of a run has no next start.
NONE = -1


def next_starts(sizes: np.ndarray, most: int) -> np.ndarray:
    """For each item as the start of a batch, the start of the next, or the number of items: the
    first item that would exceed ``most`` after something of a size."""
    n = len(sizes)
    ends = np.cumsum(sizes)
    over = np.searchsorted(ends, ends - sizes + most, "right")
    # Nothing of a size lies before the next item with one: it may exceed alone.
    sized = np.flatnonzero(sizes)
    at = np.searchsorted(sized, np.arange(n))
    after = np.append(sized, n)[np.minimum(at, len(sized))] + 1
    return np.minimum(np.maximum(over, after), n)


def chains(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item as a start, the last start of its chain and the number of starts."""
    n = len(following)
    last, count, hop = np.arange(n), np.ones(n, np.int64), following.copy()
    # Pointer doubling: hop is 1, 2, 4, ... starts on.
    while (on := hop < n).any():
        ahead = hop[on]
        last[on], count[on], hop[on] = last[ahead], count[on] + count[ahead], hop[ahead]
    return last, count


def numbered(sizes: np.ndarray, most: int, first: int = 0) -> np.ndarray:
    """Batches of the items from 0, the first start being ``first``; items before it are in -1."""
    starts, following = np.zeros(len(sizes), np.int64), next_starts(sizes, most)
    while first < len(sizes):
        starts[first] = 1
        first = following[first]
    return np.cumsum(starts) - 1


def own_runs(schema: T.StructType, most: int):
    """A function that gives the ordered rows of a task (``row``, ``k``, ``size``) their ``part``, ``run``
    of equal keys, ``pos`` in it and ``batch``, as if a batch began where each run does."""

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A run may go on in the next batch of rows: of it only the open batch's total is held.
        part, run, last, pos, batch, total = TaskContext.get().partitionId(), -1, None, 0, 0, 0
        for rows in batches:
            if not rows.num_rows:
                continue
            keys, sizes = rows.column("k").to_pylist(), rows.column("size").to_numpy()
            changes = {i for i in range(len(keys)) if (keys[i - 1] if i else last) != keys[i]}
            out = np.empty((3, len(keys)), np.int64)
            edges = sorted({0, *changes, len(keys)})
            for a, b in zip(edges, edges[1:]):
                if a in changes:
                    run, pos, batch, total = run + 1, 0, 0, 0
                own = numbered(np.concatenate([[total], sizes[a:b]]), most)[1:]
                out[0, a:b], out[1, a:b], out[2, a:b] = run, np.arange(pos, pos + b - a), batch + own
                total = int(sizes[a:b][own == own[-1]].sum()) + (total if own[-1] == 0 else 0)
                pos, batch = pos + b - a, batch + int(own[-1])
            last = keys[-1]
            yield pa.record_batch([*rows.columns, pa.array(np.full(len(keys), part)), *map(pa.array, out)], schema.names)

    return batched


def split_by_size(items: DataFrame, key: str, size: str, most: int, order: Sequence[str], hot: int = 1_000_000) -> DataFrame:
    """``items`` with ``batch`` from 0 within each key: consecutive items by ``order``, a new batch
    where the next item would exceed ``most``. A null key is a key, and a null size counts as 0.

    Keys of up to ``hot`` items are a run within one task; longer ones are spread over ranges, to
    the same result."""
    many = items.groupBy(F.struct(F.col(f"`{key}`").alias("key")).alias("k")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("k")
    named = items.select(
        F.struct(*[F.col(f"`{c}`") for c in items.columns]).alias("row"), F.struct(F.col(f"`{key}`").alias("key")).alias("k"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias("size"),
        *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)])
    by = ["k", *[f"o{i}" for i in range(len(order))]]
    schema = T.StructType([*named.schema.fields[:3], *T.StructType.fromDDL("part long, run long, pos long, batch long")])

    def in_tasks(rows: DataFrame) -> DataFrame:
        ordered = rows.repartition("k").sortWithinPartitions(*by).select("row", "k", "size")
        return ordered.mapInArrow(own_runs(schema, most), schema).select("row.*", "batch")

    if many.isEmpty():
        return in_tasks(named)
    return in_tasks(named.join(many, "k", "left_anti")).unionByName(_over_ranges(named.join(many, "k", "left_semi"), by, most, schema))


def _over_ranges(named: DataFrame, by: Sequence[str], most: int, schema: T.StructType) -> DataFrame:
    spark = named.sparkSession
    ranged = named.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).select("row", "k", "size")
    placed = stored(ranged.mapInArrow(own_runs(schema, most), schema))
    lasts = placed.groupBy("part").agg(F.max("run").alias("last"))
    ends = placed.join(F.broadcast(lasts), "part").where("run = 0 OR run = last").groupBy("part", "run", "last").agg(F.first("k").alias("k"), F.sum("size").alias("total"))
    found = ends.orderBy("part", "run").collect()  # at most two rows a range

    linked: list[list] = []
    for before, r in zip([None, *found], found):
        if before is not None and before["run"] == before["last"] and r["run"] == 0 and before["part"] != r["part"] and before["k"] == r["k"]:
            linked[-1].append(r)
        else:
            linked.append([r])
    linked = [c for c in linked if len(c) > 1]
    if not linked:
        return placed.select("row.*", "batch")
    runs = [(c, s, r["part"], r["run"]) for c, chain in enumerate(linked) for s, r in enumerate(chain)]
    sums = [np.cumsum([0] + [r["total"] for r in chain]).tolist() for chain in linked]
    of_run = F.broadcast(spark.createDataFrame(runs, "chain long, seq long, part long, run long"))
    held = placed.join(of_run, ["part", "run"])

    def exits(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Where the batches that a run leaves open go on."""
        chain, seq = (int(x) for x in group)
        sizes = rows.sort_values("pos")["size"].to_numpy()
        last, ahead = chains(next_starts(sizes, most))[0], np.cumsum(sizes[::-1])[::-1]
        out, known = [], sums[chain]
        for e in np.unique(last) if seq else last[:1]:
            carry = int(ahead[e])
            # With nothing of a size so far the batch goes on as if it began with the next run.
            to = max(bisect_right(known, known[seq + 1] + most - carry, seq + 1) - 1, seq + 1) if carry else seq + 1
            if to < len(known) - 1:
                out.append((chain, seq, e, to, carry + known[to] - known[seq + 1], carry > 0))
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in EXITS.split(", ")])

    def edges(group: tuple, rows: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        """The first start in a run of what each exit carries into it, and the chain from there."""
        if not len(came) or not len(rows):
            return pd.DataFrame({c.split(" ")[0]: [] for c in EDGES.split(", ")})
        sizes = rows.sort_values("pos")["size"].to_numpy()
        last, count = chains(next_starts(sizes, most))
        at = np.where(came["fresh"], np.searchsorted(np.cumsum(sizes), most - came["carry"].to_numpy(), "right"), 0)
        return pd.DataFrame({
            "chain": came["chain"], "seq": came["seq"], "exit": came["exit"], "to_seq": came["to_seq"], "to_exit": last[at],
            "at": np.where(came["fresh"], at, NONE), "starts": count[at] - ~came["fresh"].to_numpy(bool)})

    narrow = held.select("chain", "seq", "pos", "size")
    left = stored(narrow.groupBy("chain", "seq").applyInPandas(exits, EXITS))
    graph = stored(narrow.groupBy("chain", "seq").cogroup(left.groupBy("chain", "to_seq")).applyInPandas(edges, EDGES))
    node = ["chain", "seq", "exit"]
    pointers = graph.select(*node, "to_seq", "to_exit")
    marked = left.where("seq = 0").select(*node)
    for _ in range(max(len(c) for c in linked).bit_length()):
        reached = marked.join(pointers, node).select("chain", F.col("to_seq").alias("seq"), F.col("to_exit").alias("exit"))
        marked = stored(marked.unionByName(reached).distinct())
        onward = pointers.select("chain", *[F.col(a).alias(b) for a, b in (("seq", "to_seq"), ("exit", "to_exit"), ("to_seq", "far_seq"), ("to_exit", "far_exit"))])
        pointers = stored(pointers.join(onward, ["chain", "to_seq", "to_exit"]).select(*node, F.col("far_seq").alias("to_seq"), F.col("far_exit").alias("to_exit")))

    # One marked edge into a run at most.
    entered = {(r["chain"], r["to_seq"]): r for r in graph.join(marked, node).collect()}
    firsts = {r["chain"]: r["n"] for r in held.where("seq = 0").groupBy("chain").agg((F.max("batch") + 1).alias("n")).collect()}
    plan = []
    for c, s, _, _ in runs:
        before = firsts[c] if s == 0 else before
        if s:
            edge = entered.get((c, s))
            plan.append((c, s, before, None if edge is None else int(edge["at"])))
            before += int(edge["starts"]) if edge else 0
    planned = F.broadcast(spark.createDataFrame(plan, "chain long, seq long, before long, at long"))
    again = T.StructType([placed.schema["row"], T.StructField("batch", T.LongType())])

    def batched(group: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        before, at = rows.column("before")[0].as_py(), rows.column("at")[0].as_py()
        sizes = rows.column("size").to_numpy()
        if at is None:
            own = np.full(len(sizes), -1)
        else:
            own = numbered(sizes, most, max(at, 0)) - (at == NONE)
        return pa.table({"row": rows.column("row"), "batch": before + own})

    rest = placed.join(of_run.where("seq > 0"), ["part", "run"], "left_anti").select("row.*", "batch")
    fixed = held.where("seq > 0").join(planned, ["chain", "seq"]).select("row", "size", "pos", "before", "at", "chain", "seq").groupBy("chain", "seq").applyInArrow(batched, again)
    return rest.unionByName(fixed.select("row.*", "batch"))
