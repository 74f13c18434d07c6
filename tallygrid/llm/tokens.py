"""Token counts of a byte-level byte-pair encoding, by heap-and-linked-list merging.

A piece starts as one symbol per byte in a linked list. A heap holds the adjacent pairs that have
a merge rank; the lowest rank (leftmost first) is popped, stale entries are skipped, the two
symbols become one and the new neighbours' pairs are pushed. The count is the initial symbols
minus the merges: no identifiers are made.

Texts fall apart at single spaces between other characters, where a piece always begins, so
counts of such chunks are remembered. The memory is bounded: it is emptied when full.

Edge cases: a null or empty text has 0 tokens; added special tokens inside a text count as one
token each, as the library has it by default; very long texts are counted whole; a piece of n
bytes takes n log n steps; repeated rows get equal results; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import heapq
import json
import re

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from tallygrid.llm._common import once

#: Fixed values of byte-level encodings: how a text falls into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?=\p{White_Space}|\Z)|\p{White_Space}+"
#: A space between two characters that are not white space.
CHUNK_END = re.compile(r"(?<=\S) (?=\S)")
ODD_SPACE = re.compile(r" \s|\s ")
#: Chunks and pieces that are remembered, and characters of the longest: together they bound the bytes.
REMEMBERED, LONGEST = 400_000, 64


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where it prints, else the next from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class PairMerger:
    """Counts tokens with the merges of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.symbols, self.find = byte_symbols(), regex.compile(PIECES).findall
        self.pieces, self.chunks = _Memory(self.merge), _Memory(self.spaced)

    def merge(self, piece: str) -> int:
        """Tokens of one piece."""
        at = [self.symbols[b] for b in piece.encode("utf-8", "replace")]
        n = len(at)
        rank = self.ranks.get
        heap = [(r, i, at[i], at[i + 1]) for i in range(n - 1) if (r := rank((at[i], at[i + 1]))) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        before, after, count = list(range(-1, n - 1)), [*range(1, n), -1], n
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if at[i] != left or j < 0 or at[j] != right:
                continue
            at[i], at[j] = both, _ = left + right, ""
            count -= 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank((both, at[k]))) is not None:
                    heapq.heappush(heap, (r, i, both, at[k]))
            h = before[i]
            if h >= 0 and (r := rank((at[h], both))) is not None:
                heapq.heappush(heap, (r, h, at[h], both))
        return count

    def bare(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, self.find(text)))

    def spaced(self, chunk: str) -> int:
        """Tokens of a chunk behind a space."""
        return self.bare(" " + chunk)

    def count(self, text: str | None) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        total = 0
        parts = self.special.split(text) if self.special else [text]
        for part in parts:
            chunks = CHUNK_END.split(part) if ODD_SPACE.search(part) else part.split(" ")
            total += self.bare(chunks[0]) + sum(map(self.chunks.__getitem__, chunks[1:]))
        return total + len(parts) - 1


class _Memory(dict):
    """Values of a function for short keys, computed at the first use; emptied when full."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, key):
        value = self.of(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


def merger(path: str) -> PairMerger:
    """One merger per worker and file."""
    return once(PairMerger, path)


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of each text by the tokenizer file at ``path``."""

    @pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        count = merger(path).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    return of(text)
