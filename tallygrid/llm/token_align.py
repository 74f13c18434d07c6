"""Alignment of two tokenizers' tokens, by merge-path partitioning.

Encoding A is a byte-level vocabulary, encoding B one of pieces with byte fallback. Both encode a
space and the text, so the byte offsets at which their tokens end are two sorted lists over the
same bytes. Where both end, the text is cut into **groups**; the two tokens that end there are
**linked**.

1. Texts are encoded by the libraries. A batch's texts lie one behind another, so its two lists of
   ends are merged as one, however long or short the single texts are.
2. The merge is divided by its diagonals: a binary search along each finds how many ends of A and
   of B are among the first ``work``, 2 ``work``, ... of the merged list. Between two diagonals lies
   a piece, of equal work and independent of the others.
3. Each piece merges its ends and emits those in common. A cut whose two ends lie on both sides of
   a diagonal is found there when the pieces are stitched; groups run from cut to cut, over pieces.
4. The corpus-wide counts. Of two linked tokens one's bytes end with the other's, so the
   vocabularies alone list every pair that can be linked (some hundred thousand, ``Vocabularies.pairs``).
   Links are stored as indices into that list, counted per partition and summed by a group-by; what
   is sent to the tasks that look the counts up has one number for each such pair, whatever the
   corpus.

The byte-level encoding runs in the rank form of the same vocabulary, which gives the same tokens
several times faster; white space too long for its pattern goes to the library of the file itself.
Very long texts are encoded in chunks that end before a single space between two other characters,
where neither encoding ever joins (checked for B when the vocabulary is read).

Edge cases: a text that is null, empty, not UTF-8, or not given back by the bytes of either
encoding (U+2581 stands for a space in B) has no tokens, zeros and an empty ``groups_sha256``;
special tokens' strings are plain text; very long texts are aligned whole; repeated rows count as
often as they occur; an empty table gives an empty result; extra columns travel inside one struct
and cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.llm._common import once, stored
from tallygrid.llm.tokens import byte_symbols

#: Merged ends of a piece, and characters from which a text is encoded in chunks.
WORK, CHUNK = 4096, 1 << 20
#: White space that the rank library's pattern does not take.
LONG_SPACE = re.compile(r"\s{2000}")
SAFE = re.compile(r"(?<=[^\s\u2581]) (?=[^\s\u2581])")
SPACE = "\u2581"
#: How a text falls into the pieces of a byte-level encoding, in the rank library's notation: a fixed value.
RANK_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabularies:
    """The two encodings: bytes of each token, and the pairs of tokens that can be linked."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a_whole = Tokenizer.from_file(a_path)
        self.a_whole.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte = {s: b for b, s in enumerate(byte_symbols())}
        self.a_bytes = [b""] * self.a_whole.get_vocab_size()
        for token, i in vocabulary.items():
            # Added tokens are no bytes of the encoding.
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else b""
        added = {i for i, t in self.a_whole.get_added_tokens_decoder().items()}
        ranks = {w: i for i, w in enumerate(self.a_bytes) if w and i not in added}
        self.a_ranks = tiktoken.Encoding("ranks", pat_str=RANK_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.in_chunks = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.a_lengths, self.b_lengths = (np.array([len(w) for w in x]) for x in (self.a_bytes, self.b_bytes))
        self.keys = self._keys()

    def _keys(self) -> np.ndarray:
        """a * (number of B's tokens) + b for each pair that can be linked, in order."""
        by_bytes = [defaultdict(list), defaultdict(list)]
        for of, words in zip(by_bytes, (self.a_bytes, self.b_bytes), strict=True):
            for i, w in enumerate(words):
                of[w].append(i)
        n, keys = len(self.b_bytes), set()
        for a, w in enumerate(self.a_bytes):
            keys.update(a * n + b for at in range(len(w)) for b in by_bytes[1].get(w[at:], ()))
        for b, w in enumerate(self.b_bytes):
            keys.update(a * n + b for at in range(1, len(w)) for a in by_bytes[0].get(w[at:], ()))
        return np.array(sorted(keys), np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of A and of B of each pair."""
        return np.divmod(self.keys, len(self.b_bytes))

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """The tokens of a space and the text in A and in B."""
        if LONG_SPACE.search(text):
            return self.a_whole.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        a, b, at = [], [], 0
        while at < len(text):
            end = SAFE.search(text, at + CHUNK) if self.in_chunks and len(text) - at > CHUNK else None
            some = text[at:end.start()] if end else text[at:]
            a += self.a_ranks.encode_ordinary(" " + some)
            b += self.b.encode(some)
            at = end.end() if end else len(text)
        return a, b

    def tokens(self, raw: bytes | None) -> tuple[list[int], list[int]] | None:
        """The tokens of a text; None if it has none."""
        try:
            text = (raw or b"").decode()
        except UnicodeDecodeError:
            return None
        if not text:
            return None
        a, b = self.encode(text)
        want = b" " + raw
        same = b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want
        return (a, b) if same else None

    @property
    def labels(self) -> list[bytes]:
        """Ids as written in groups: A's and B's, each behind the sign that opens its side of a
        group and behind a comma."""
        return [sign + str(i).encode() for first, n in ((b";", len(self.a_bytes)), (b"|", len(self.b_bytes))) for i in range(n) for sign in (first, b",")]


def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """One pair of vocabularies per worker."""
    return once(Vocabularies, a_path, b_path)


def labels(a_path: str, b_path: str) -> list[bytes]:
    return once(_labels, a_path, b_path)


def _labels(a_path: str, b_path: str) -> list[bytes]:
    return vocabularies(a_path, b_path).labels


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of the sorted ``a`` and of the sorted ``b`` come first on each diagonal, a multiple
    of ``work`` or the end; of equal values those of ``a`` come first."""
    at = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = open_.copy()
        first[open_] = a[middle[open_]] <= b[(at - 1 - middle)[open_]]
        low, high = np.where(first, middle + 1, low), np.where(open_ & ~first, middle, high)
    return low, at - low


def merge_piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the values in common, by merging the two sorted runs."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    merged = both[order]
    twins = np.flatnonzero(merged[1:] == merged[:-1])
    return order[twins], order[twins + 1] - len(a)


def common_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Places in the strictly rising ``a`` and ``b`` of the values in common: pieces between
    diagonals, stitched."""
    i, j = diagonals(a, b, work)
    found = []
    for k in range(len(i) - 1):
        if k and i[k] and j[k] < len(b) and a[i[k] - 1] == b[j[k]]:  # its two ends lie across the diagonal
            found.append((np.array([i[k] - 1]), np.array([j[k]])))
        x, y = merge_piece(a[i[k]:i[k + 1]], b[j[k]:j[k + 1]])
        found.append((x + i[k], y + j[k]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = (np.concatenate(p) for p in zip(*found, strict=True))
    return x, y


class Aligned:
    """The groups and links of a batch of texts."""

    def __init__(self, texts: Sequence[bytes | None], words: Vocabularies, written: list[bytes], work: int = WORK):
        found = [words.tokens(t) or ((), ()) for t in texts]
        self.n_a, self.n_b = (np.array([len(f[side]) for f in found], np.int64) for side in (0, 1))
        self.a, self.b = (np.fromiter((i for f in found for i in f[side]), np.int64, int(n.sum())) for side, n in ((0, self.n_a), (1, self.n_b)))
        i, j = common_ends(np.cumsum(words.a_lengths[self.a]), np.cumsum(words.b_lengths[self.b]), work)
        self.links = np.searchsorted(words.keys, self.a[i] * len(words.b_bytes) + self.b[j]).astype(np.int32)
        # Every text ends with a cut, so groups never run from one text into the next.
        self.a_ends, self.b_ends = i + 1, j + 1
        self.group_ends = np.searchsorted(self.a_ends, np.cumsum(self.n_a), "right")
        self.group_starts = np.concatenate(([0], self.group_ends[:-1])).astype(np.int64)
        self.written, self.n_labels_a = written, 2 * len(words.a_bytes)

    def groups(self) -> list[bytes]:
        """Each text's groups: ``a1,a2|b1;a3|b2,b3``."""
        own_a, own_b = np.diff(self.a_ends, prepend=0), np.diff(self.b_ends, prepend=0)
        starts = np.cumsum(own_a + own_b) - own_a - own_b
        out = np.empty(len(self.a) + len(self.b), np.int64)
        first_a, first_b = (np.ones(len(x), np.int64) for x in (self.a, self.b))
        first_a[self.a_ends - own_a] = first_b[self.b_ends - own_b] = 0
        out[np.arange(len(self.a)) + np.repeat(starts - (self.a_ends - own_a), own_a)] = 2 * self.a + first_a
        out[np.arange(len(self.b)) + np.repeat(starts + own_a - (self.b_ends - own_b), own_b)] = self.n_labels_a + 2 * self.b + first_b
        ends = np.cumsum(self.n_a + self.n_b)
        get = self.written.__getitem__
        return [b"".join(map(get, out[e - n:e].tolist()))[1:] for e, n in zip(ends.tolist(), (self.n_a + self.n_b).tolist(), strict=True)]


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _aligned(docs: DataFrame, text_col: str, columns: Sequence[str] | None, a_path: str, b_path: str, work: int, keep_groups: bool) -> DataFrame:
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType([rows.schema["row"], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.BinaryType())])
    if keep_groups:
        schema = schema.add("groups", T.StringType())

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, written = vocabularies(a_path, b_path), labels(a_path, b_path)
        for batch in batches:
            found = Aligned(batch.column("text").to_pylist(), words, written, work)
            groups = found.groups()
            links = [found.links[s:e].tobytes() for s, e in zip(found.group_starts, found.group_ends, strict=True)]
            n = pa.array(found.group_ends - found.group_starts)
            hashes = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups])
            more = [pa.array([g.decode() for g in groups])] if keep_groups else []
            yield pa.record_batch([batch.column("row"), pa.array(found.n_a), pa.array(found.n_b), n, n, hashes, pa.array(links, pa.binary()), *more], schema.names)

    return rows.mapInArrow(align, schema)


def _counted(aligned: DataFrame, n_pairs: int) -> DataFrame:
    """``pair`` and ``n``: how many links hold each pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("links").to_pylist()), np.int32), minlength=n_pairs)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["pair", "n"])

    return aligned.select("links").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(
    docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", columns: Sequence[str] | None = None, work: int = WORK, keep_groups: bool = False,
) -> DataFrame:
    """``row`` (struct of ``columns``, by default of all), ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_best`` (links whose pair is the most frequent of its token of B), ``count_sum`` (the links'
    counts together), ``groups_sha256`` and, if asked for, ``groups``."""
    words = vocabularies(a_path, b_path)
    aligned = stored(_aligned(docs, text_col, columns, a_path, b_path, work, keep_groups))
    # One number for each pair that the vocabularies allow.
    found = _counted(aligned, len(words.keys)).toArrow()
    counts = np.zeros(len(words.keys), np.int64)
    counts[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    highest = np.zeros(len(words.b_bytes), np.int64)
    np.maximum.at(highest, words.pairs()[1], counts)
    best = counts == highest[words.pairs()[1]]
    kept = [f for f in aligned.schema.fields if f.name != "links"]
    schema = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [np.frombuffer(x, np.int32) for x in batch.column("links").to_pylist()]
            sums = [pa.array([int(of[x].sum()) for x in links], pa.int64()) for of in (best, counts)]
            yield pa.record_batch([*[batch.column(f.name) for f in kept], *sums], schema.names)

    return aligned.mapInArrow(weigh, schema)


def pair_counts(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", work: int = WORK) -> DataFrame:
    """``a_id``, ``b_id``, ``n``: how many links of the corpus hold each pair of tokens."""
    words = vocabularies(a_path, b_path)
    found = _counted(_aligned(docs, text_col, [text_col], a_path, b_path, work, False), len(words.keys))
    a, b = words.pairs()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = batch.column("pair").to_numpy()
            yield pa.record_batch([pa.array(a[pair]), pa.array(b[pair]), batch.column("n")], ["a_id", "b_id", "n"])

    return found.mapInArrow(named, "a_id long, b_id long, n long")
