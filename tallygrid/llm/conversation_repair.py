"""Conversation repair by an auction algorithm for shortest paths.

A conversation's rows are kept, reroled or deleted, and rows without text inserted, so that the
roles' initials read ``(s?(ua)+)?`` at the least cost. The edits are paths through a lattice whose
nodes are a place in the conversation and a state: nothing yet, after ``s``, after ``u``, after
``a``.

**Auction.** Every node has a price, at first a lower bound of its distance to the end. From an
origin a path grows along the arc with the least cost and price; where the node's own price is
below that, the price rises to it and the path contracts by a node. A path that reaches a node of
known distance ends, and its origin's price is its distance. Auctions run in blocks of ``BLOCK``
rows from the conversation's end, so each ends at nodes that are known from the block behind it
and a path is never longer than a block. The prices are dual feasible and exact at the block's
start, so every cheapest path consists of **tight** arcs (cost = difference of the prices); of
those from which tight arcs go on to the block's end, the least letter is taken at each node.

**Scale.** Rows that are equal collapse into one with a number of copies. They are dealt by ranges
of conversation, turn, role and the text's digest and ordered within a task, so a conversation,
however long, spreads over tasks; a task cuts its rows into segments of at most ``SEGMENT`` rows
and ``SEGMENT_BYTES``. A conversation that lies within a segment is repaired there. The segments of
the others are chained:

1. the first place of each role and text, by a group-by, tells the duplicates across segments;
2. each segment's costs between the states at its two ends come from four auctions;
3. a stream over each conversation's segments from the last to the first, which holds four
   numbers, gives the distances at their ends;
4. with them each segment is traced for each state that it may be entered in;
5. a stream from the first to the last picks the traces and hashes the repaired rows.

Edge cases: a null role or text is one space; null turns come first; rows of one turn are ordered
by role and the text's MD5 digest; equal rows are duplicates of the first; roles are told by their
first character, and one other than s, u or a must be reroled or deleted; a conversation all of
whose rows are dropped has zeros, an empty audit and the hash of the empty string; a null
conversation id is a conversation; an empty table gives an empty result; other columns are never
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.llm._common import stored

BLOCK, SEGMENT, SEGMENT_BYTES = 16, 4096, 8 << 20
FAR = 1 << 60
#: States by the last initial: none, s, u, a; and what a conversation may still cost behind its last row.
NONE, AFTER_S, AFTER_U, AFTER_A = range(4)
LAST = [0, 10, 5, 0]
#: Faults of a row.
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs, fixed values.
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}


def onward(state: int) -> int:
    """The state after the role that a state allows next, user or assistant."""
    return AFTER_A if state == AFTER_U else AFTER_U


def arcs(initial: str, fault: int, state: int) -> list[tuple[str, int, int]]:
    """A row's edits in a state, by letter: letter, cost, next state."""
    out = [("D", DELETE, state)]
    if fault in (CLEAN, TRUNCATED):
        extra = UNFINISHED if fault == TRUNCATED else 0
        if (initial, state) == ("s", NONE):
            out.append(("K", extra, AFTER_S))
        elif initial in "ua" and initial and "__ua"[onward(state)] == initial:
            out.append(("K", extra, onward(state)))
        out.append(("R", REROLE + extra, onward(state)))
    return out


def kind(initial: str, fault: int) -> int:
    """A row as a number below 16, by what its arcs depend on."""
    return "suax".index(initial if initial in ("s", "u", "a") else "x") * 4 + fault


ARCS = [[arcs("suax"[k // 4], k % 4, state) for state in range(4)] for k in range(16)]
LEAST = [min(cost for own in of for _, cost, _ in own) for of in ARCS]


class Block:
    """The lattice of a block of rows: ``columns`` of a kind and a number of copies, and the known
    distances behind the last."""

    def __init__(self, columns: list[tuple[int, int]], ends: list[int]):
        self.columns, self.tight, n = columns, None, len(columns)
        self.out: list[list[tuple[str, int, int]]] = []
        for t, (k, copies) in enumerate(columns):
            for state in range(4):
                # Copies are one column: deleting them all first is the least of the equal ways.
                own = [(letter * copies, cost * copies, 4 * (t + 1) + to) for letter, cost, to in ARCS[k][state]]
                own.insert(1, ("I", INSERT, 4 * t + onward(state)))
                self.out.append(own)
        self.price = [FAR] * (4 * n) + ends
        bound = min(ends)
        for t in range(n - 1, -1, -1):
            bound += LEAST[columns[t][0]] * columns[t][1]
            for i in (4 * t + AFTER_A, 4 * t + AFTER_U, 4 * t + AFTER_A, 4 * t + AFTER_S, 4 * t):
                if any(self.price[j] < FAR for _, _, j in self.out[i]):
                    self.price[i] = bound
        for state in range(4):
            if self.price[state] < FAR:
                self.auction(state)

    def auction(self, origin: int) -> None:
        """Raise prices until a path of tight arcs leads from the origin to the end."""
        price, end, path = self.price, 4 * len(self.columns), [origin]
        while (i := path[-1]) < end:
            least, to = min((cost + price[j], j) for _, cost, j in self.out[i])
            if price[i] < least:
                price[i] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)

    def trace(self, state: int) -> tuple[str, int]:
        """The least letters of a cheapest path from a state, and the state in which it ends."""
        end, price = 4 * len(self.columns), self.price
        if self.tight is None:
            self.tight = [[(letter, j) for letter, cost, j in own if price[i] < FAR and price[i] == cost + price[j]] for i, own in enumerate(self.out)]
            on = [False] * end + [p < FAR for p in price[end:]]
            for t in range(len(self.columns) - 1, -1, -1):
                for _ in range(3):  # inserts lead to nodes of the same place
                    for i in range(4 * t, 4 * t + 4):
                        on[i] = on[i] or any(on[j] for _, j in self.tight[i])
            self.tight = [[x for x in own if on[x[1]]] for own in self.tight]
        letters, i = [], state
        while i < end:
            letter, i = min(self.tight[i])
            letters.append(letter)
        return "".join(letters), i - end


class Lattice:
    """The blocks of some rows in a row, from known distances behind the last."""

    def __init__(self, kinds: bytes, copies: list[int], ends: list[int]):
        columns = []
        for k, n in zip(kinds, copies, strict=True):
            forced = k % 4 in (BLANK, DUPLICATE)
            columns += [(k, n)] if forced else [(k, 1), (DUPLICATE, n - 1)] if n > 1 else [(k, 1)]
        self.blocks: list[Block] = []
        for at in reversed(range(0, len(columns), BLOCK)):
            self.blocks.append(Block(columns[at:at + BLOCK], ends))
            ends = self.blocks[-1].price[:4]
        self.starts = ends

    def trace(self, state: int) -> tuple[str, int]:
        letters = []
        for block in reversed(self.blocks):
            some, state = block.trace(state)
            letters.append(some)
        return "".join(letters), state


def last_inserts(state: int) -> str:
    """What is inserted behind the last row."""
    return "I" * (LAST[state] // INSERT)


def repaired(letters: str, state: int, rows: list[tuple[str, str, int]]) -> Iterator[bytes]:
    """The rows that the letters make of ``rows`` (role, text, copies)."""
    at, used = 0, 0
    for letter in letters:
        role, text = {AFTER_U: "user", AFTER_A: "assistant"}[onward(state)], ""
        if letter != "I":
            own_role, own_text, copies = rows[at]
            used += 1
            if used == copies:
                at, used = at + 1, 0
            if letter == "D":
                continue
            text = own_text
            if letter == "K":
                role = own_role
        state = AFTER_S if letter == "K" and role[:1] == "s" else onward(state)
        yield f"{role}:{text}".encode()


class Hash:
    """The digest of lines joined by newlines."""

    def __init__(self):
        self.sha, self.some = hashlib.sha256(), False

    def add(self, line: bytes) -> None:
        self.sha.update(b"\n" + line if self.some else line)
        self.some = True


class Facts:
    """What is counted in a conversation, segment after segment."""

    def __init__(self):
        self.faults = [0] * 4
        self.illegal = self.turns = 0
        self.first = self.last = None  # turns
        self.before = None  # the last initial

    def add(self, initials: list[str], faults: list[int], copies: list[int], turns: list[int | None]) -> None:
        for initial, fault, n, turn in zip(initials, faults, copies, turns, strict=True):
            self.faults[fault] += n if fault == BLANK or fault == DUPLICATE else 1
            self.faults[DUPLICATE] += 0 if fault == BLANK or fault == DUPLICATE else n - 1
            self.illegal += n - 1 + (self.before is not None and self.before + initial not in LEGAL)
            self.before = initial
            if turn is not None:
                self.turns += turn != self.last
                self.first, self.last = turn if self.first is None else self.first, turn

    def listed(self) -> list[int]:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return [gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal]


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PIECE = "part int, number int, turns array<long>, roles array<string>, texts array<string>, digests array<string>, copies array<long>, initials array<string>, faults array<int>"
RESULT_NAMES, PIECE_NAMES = ([c.split(" ")[0] for c in x.split(", ")] for x in (RESULT, PIECE))
TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def _batch(schema: str, conv: pa.DataType, rows: list[list]) -> pa.RecordBatch:
    fields = [c.split(" ") for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * (1 + len(fields))
    return pa.record_batch([pa.array(columns[0], conv), *[pa.array(c, TYPES[t]) for c, (_, t) in zip(columns[1:], fields, strict=True)]], ["conv", *[n for n, _ in fields]])


class Segment:
    """Rows of one conversation in order."""

    def __init__(self, conv, number: int, inside: bool):
        self.conv, self.number, self.inside, self.bytes = conv, number, inside, 0
        self.columns: dict[str, list] = {c: [] for c in PIECE_NAMES[2:]}
        self.seen: set[tuple[str, str]] = set()

    def add(self, row: dict) -> None:
        if row["copies"]:
            fault, key = row["fault"], (row["role"], row["digest"])
            if fault != BLANK:
                fault = DUPLICATE if key in self.seen else fault
                self.seen.add(key)
            self.bytes += len(row["text"])
            values = row["turn"], row["role"], row["text"], row["digest"], row["copies"], row["role"][:1], fault
            for c, v in zip(self.columns, values, strict=True):
                self.columns[c].append(v)

    @property
    def full(self) -> bool:
        return len(self.columns["turns"]) >= SEGMENT or self.bytes >= SEGMENT_BYTES

    def result(self) -> list:
        """The repair of a conversation that is whole."""
        c, facts, sha = self.columns, Facts(), Hash()
        facts.add(c["initials"], c["faults"], c["copies"], c["turns"])
        lattice = Lattice(bytes(map(kind, c["initials"], c["faults"])), c["copies"], LAST)
        letters, state = lattice.trace(NONE)
        letters += last_inserts(state)
        for line in repaired(letters, NONE, list(zip(c["roles"], c["texts"], c["copies"], strict=True))):
            sha.add(line)
        return [*facts.listed(), lattice.starts[NONE], letters, sha.sha.hexdigest()]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _segments(rows: DataFrame) -> DataFrame:
    """Ordered rows as results of whole conversations and as segments of the others."""
    conv = T.StructType([rows.schema["conv"]])
    schema = T.StructType([*conv, *T.StructType.fromDDL(RESULT), *T.StructType.fromDDL(PIECE)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, out, size, kept = TaskContext.get().partitionId(), None, [], 0, None

        def close(ended: bool) -> None:
            nonlocal size
            size += now.bytes
            if ended and now.inside:
                out.append([now.conv, *now.result(), *[None] * len(PIECE_NAMES)])
            else:
                out.append([now.conv, *[None] * len(RESULT_NAMES), part, now.number, *now.columns.values()])

        for batch in batches:
            kept = batch.schema.field("conv").type
            for row in batch.to_pylist():
                if now is None or row["conv"] != now.conv:
                    first = now is None
                    if not first:
                        close(True)
                    now = Segment(row["conv"], 0 if first else now.number + 1, not first)  # the first may go on from the task before
                elif now.full:
                    now.inside = False
                    close(False)
                    now = Segment(row["conv"], now.number + 1, False)
                now.add(row)
                if len(out) >= 512 or size > SEGMENT_BYTES:
                    yield _batch(f"{RESULT}, {PIECE}", kept, out)
                    out, size = [], 0
        if now is not None:
            close(False)
            yield _batch(f"{RESULT}, {PIECE}", kept, out)

    return rows.mapInArrow(cut, schema)


def _chained(pieces: DataFrame) -> DataFrame:
    """Results of conversations in several segments."""
    conv = pieces.schema["conv"]
    place = ["part", "number"]
    each = pieces.select("conv", *place, F.posexplode(F.arrays_zip("roles", "digests", "faults")).alias("i", "r")).select("conv", *place, "i", "r.*").where(F.col("faults").isin(CLEAN, TRUNCATED))
    key = [F.struct("conv").alias("k"), "roles", "digests"]
    first = each.groupBy(*key).agg(F.min(F.struct(*place)).alias("first"))
    later = each.select(*key, *place, "i").join(first, ["k", "roles", "digests"]).where(F.struct(*place) > F.col("first")).groupBy(*place).agg(F.collect_list("i").alias("later"))
    known = pieces.select("conv", *place, "initials", "faults", "copies").join(later, place, "left")
    known = known.withColumn("faults", F.transform("faults", lambda f, i: F.when(F.array_contains("later", i), DUPLICATE).otherwise(f)))
    known = stored(known.drop("later"))

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                kinds = bytes(map(kind, r["initials"], r["faults"]))
                # By the state at the end, the costs from each state at the start.
                out.append([r["conv"], r["part"], r["number"], [c for s in range(4) for c in Lattice(kinds, r["copies"], [0 if s == x else FAR for x in range(4)]).starts]])
            yield _batch("part int, number int, costs array<long>", batch.schema.field("conv").type, out)

    between = known.mapInArrow(costs, T.StructType([conv, *T.StructType.fromDDL("part int, number int, costs array<long>")]))

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ends = (), LAST
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["conv"],) != last:
                    last, ends = (r["conv"],), LAST
                out.append([r["conv"], r["part"], r["number"], ends])
                ends = [min(FAR, *(r["costs"][4 * s + x] + ends[s] for s in range(4))) for x in range(4)]
            yield _batch("part int, number int, ends array<long>", batch.schema.field("conv").type, out)

    distances = between.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("number")).mapInArrow(
        backward, T.StructType([conv, *T.StructType.fromDDL("part int, number int, ends array<long>")])).drop("conv")
    TRACES = "part int, number int, faults array<int>, price array<long>, letters array<string>, exits array<int>"

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                lattice = Lattice(bytes(map(kind, r["initials"], r["faults"])), r["copies"], r["ends"])
                found = [lattice.trace(s) if lattice.starts[s] < FAR else ("", s) for s in range(4)]
                out.append([r["conv"], r["part"], r["number"], r["faults"], lattice.starts, [f[0] for f in found], [f[1] for f in found]])
            yield _batch(TRACES, batch.schema.field("conv").type, out)

    traced = known.join(distances, place).mapInArrow(trace, T.StructType([conv, *T.StructType.fromDDL(TRACES)])).drop("conv")

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, facts, sha, letters, state, cost, kept = (), None, None, [], NONE, 0, None

        def done() -> list:
            end = last_inserts(state)
            for line in repaired(end, state, []):
                sha.add(line)
            return [last[0], *facts.listed(), cost, "".join(letters) + end, sha.sha.hexdigest()]

        for batch in batches:
            out, kept = [], batch.schema.field("conv").type
            for r in batch.to_pylist():
                if (r["conv"],) != last:
                    if last:
                        out.append(done())
                    last, facts, sha, letters, state, cost = (r["conv"],), Facts(), Hash(), [], NONE, r["price"][NONE]
                facts.add(r["initials"], r["faults"], r["copies"], r["turns"])
                some = r["letters"][state]
                for line in repaired(some, state, list(zip(r["roles"], r["texts"], r["copies"], strict=True))):
                    sha.add(line)
                letters.append(some)
                state = r["exits"][state]
            yield _batch(RESULT, kept, out)
        if last:
            yield _batch(RESULT, kept, [done()])

    whole = pieces.drop("digests", "faults").join(traced, place)
    return stored(whole.repartition("conv").sortWithinPartitions("conv", *place).mapInArrow(forward, T.StructType([conv, *T.StructType.fromDDL(RESULT)])), "16")


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``rows`` with faults by a checksum of the conversation and turn, and ``copies``: 0 for a
    dropped row, 2 for a repeated one."""
    space = F.lit(" ")
    role, text = F.coalesce(F.col(role_col), space), F.coalesce(F.col(text_col), space)
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    k = F.crc32(named.cast("binary")) % 20
    return rows.select(
        id_col, turn_col, F.when(k == 4, "user").otherwise(role).alias(role_col),
        F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias(text_col),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def fault(text: Column) -> Column:
    """A row's fault as far as its text tells it."""
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    return F.when(blank, BLANK).when(text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), CLEAN).otherwise(TRUNCATED)


def repair(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None,
) -> DataFrame:
    """A row per conversation: ``conv`` (its id), the ``gaps`` in its turns, its ``blank``,
    ``duplicate``, ``truncated`` and ``illegal`` places, the ``cost`` and letters (``audit``) of the
    cheapest edits, and the digest of the repaired rows. Rows of 0 ``copies`` name their
    conversation only."""
    space, n = F.lit(" "), (F.lit(1) if copies is None else copies).cast("long")
    there = n > 0
    named = rows.select(
        F.col(id_col).alias("conv"), F.when(there, F.col(turn_col).cast("long")).alias("turn"), F.when(there, F.coalesce(F.col(role_col), space)).alias("role"),
        F.when(there, F.coalesce(F.col(text_col), space)).alias("text"), n.alias("copies"))
    once = named.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", F.md5("text")).withColumn("fault", fault(F.col("text")))
    order = ["conv", "turn", "role", "digest"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(_segments(once.repartitionByRange(parts, *order).sortWithinPartitions(*order)))
    return found.where("part IS NULL").select("conv", *RESULT_NAMES).unionByName(_chained(found.where("part IS NOT NULL").select("conv", *PIECE_NAMES)))
