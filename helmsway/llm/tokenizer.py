"""Encoding of texts by a public byte-level BPE vocabulary, through a pair occurrence index.

Each partition collects the distinct pieces of its texts and merges all of them together: every pair
of neighbouring symbols is mapped to all positions where it occurs; the ranks that occur are applied
in ascending order, each at all its positions, left to right; the pairs that a merge makes or breaks
update the lists of the ranks concerned. A merge makes a symbol that only later ranks use, so every
rank is applied once. Texts are then put together from the pieces' ids.

The vocabulary file's path is a parameter; the driver reads it and broadcasts the merges, whose size
is fixed by the file (about 1 MB), so executors need no access to it.
"""

from __future__ import annotations

import contextlib
import gc
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
#: The published split pattern of byte-level BPE; the second form is the same for ASCII text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Text may be cut before a line break that follows a visible ASCII character: no piece spans such a place.
LINES = re.compile(r"(?<=[!-~])\n")
#: Entries kept per worker; a full cache is emptied, which costs time only.
MOST_LINES, MOST_PIECES = 300_000, 600_000


def read_merges(path: str) -> tuple[list[int], np.ndarray]:
    """Ids of the 256 bytes, and a row (left id, right id, new id) for each merge in order of rank."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    vocab = model["vocab"]
    # printable Latin-1 characters stand for their own byte, the others are shifted past 255 in order
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(own)]
    sign = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(shifted)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dtype=np.int32)
    return [vocab[sign[b]] for b in range(256)], merges


class Numbers(dict):
    """Numbers strings in the order in which they are first asked for; ``new`` has those not yet merged."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n


class Encoder:
    """Encodes batches of texts; keeps what it has learned of lines and pieces between batches."""

    def __init__(self, byte_ids: list[int], merges: np.ndarray):
        self.byte_ids = np.array(byte_ids, np.int32)
        self.merges = [tuple(m) for m in merges.tolist()]
        self.rank = {a << 20 | b: r for r, (a, b, _) in enumerate(self.merges)}
        top = int(self.byte_ids.max()) + 1
        self.byte_pairs = np.full((top, top), -1, np.int32)
        single = np.flatnonzero((merges[:, 0] < top) & (merges[:, 1] < top))
        self.byte_pairs[merges[single, 0], merges[single, 1]] = single
        self.split = regex.compile(PATTERN).findall
        self.split_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
        self.later: dict[str, bytes] = {}
        self._forget()

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has, by one pair occurrence index."""
        raw = [p.encode("utf-8") for p in pieces]
        ends = np.cumsum([0, *map(len, raw)])
        starts = ends[:-1][np.diff(ends) > 0]
        first = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        n = first.size
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        before[starts] = -1
        after[ends[1:][np.diff(ends) > 0] - 1] = -1
        # the index of the pairs of single bytes: positions grouped by rank, in order within a rank
        ranks = np.full(n, -1, np.int32)
        ranks[:-1] = self.byte_pairs[first[:-1], first[1:]]
        ranks[after < 0] = -1
        at = np.argsort(ranks, kind="stable")[np.count_nonzero(ranks < 0) :]
        found, begin = np.unique(ranks[at], return_index=True)
        where: dict[int, list[int]] = dict(zip(found.tolist(), map(np.ndarray.tolist, np.split(at, begin[1:])), strict=False))
        sym, before, after = first.tolist(), before.tolist(), after.tolist()
        rank, merges = self.rank.get, self.merges
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, new = merges[r]
            for p in sorted(where.pop(r)):
                q = after[p]
                if q < 0 or sym[p] != a or sym[q] != b:
                    continue
                sym[p], sym[q] = new, -1
                after[p] = n = after[q]
                if n >= 0:
                    before[n] = p
                    if (x := rank(new << 20 | sym[n])) is not None:
                        if x not in where:
                            where[x] = []
                            heapq.heappush(active, x)
                        where[x].append(p)
                m = before[p]
                if m >= 0 and (x := rank(sym[m] << 20 | new)) is not None:
                    if x not in where:
                        where[x] = []
                        heapq.heappush(active, x)
                    where[x].append(m)
        left = np.array(sym, dtype="<i4")
        kept = left >= 0
        return left[kept], np.diff(np.r_[0, np.cumsum(kept)][ends])

    def _learn(self, lines: Iterable[str], known: dict[str, bytes], prefix: str) -> None:
        """Puts the ids of each line, as little-endian 32-bit integers, into ``known``."""
        flat: list[int] = []
        counts = []
        number = self.number.__getitem__
        for line in lines:
            found = self.split_ascii(prefix + line) if line.isascii() else self.split(prefix + line)
            flat += map(number, found)
            counts.append(len(found))
        ids, sizes = self.merged(self.number.new)
        self.number.new = []
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        at = np.array(flat, np.int64)
        size = self.size[at]
        total = np.r_[0, np.cumsum(size)]
        every = self.ids[np.repeat(self.start[at] - total[:-1], size) + np.arange(total[-1])].tobytes()
        cuts = (total[np.r_[0, np.cumsum(counts, dtype=np.int64)]] * 4).tolist()
        known.update(zip(lines, map(every.__getitem__, map(slice, cuts, cuts[1:])), strict=False))

    def _forget(self) -> None:
        """Starts with empty caches."""
        self.number = Numbers()
        self.ids = np.empty(0, "<i4")
        self.size, self.start = np.empty(0, np.int64), np.zeros(1, np.int64)
        self.later = {}

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; none for an empty or null text."""
        cut = [LINES.split(t) if t else [""] for t in texts]
        if len(self.number) > MOST_PIECES or len(self.later) > MOST_LINES:
            self._forget()
        first: dict[str, bytes] = {}
        self._learn(list({c[0] for c in cut}), first, "")
        self._learn(list({x for c in cut for x in c[1:] if x not in self.later}), self.later, "\n")
        later = self.later.__getitem__
        return [first[c[0]] + b"".join(map(later, c[1:])) for c in cut]


@contextlib.contextmanager
def _worker(shared) -> Iterator[Encoder]:
    """An encoder for this task. Its caches hold no reference cycles, so looking for some is left out meanwhile."""
    gc.disable()
    try:
        yield Encoder(*shared.value)
    finally:
        gc.enable()


def _slices(batches: Iterator[pa.RecordBatch], text: int, most_rows: int = 2048, most_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of so many rows and bytes of text at most (one row at least)."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(size, (size[at - 1] if at else 0) + most_bytes, "right"))
            end = min(max(upto, at + 1), at + most_rows)
            yield batch.slice(at, end - at)
            at = end


def encode(docs: DataFrame, doc_id: str, text: str, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """(doc_id, ``ids`` array<int>) of every row, without special tokens.

    Text that looks like a special token is ordinary text. Null and empty texts give an empty list.
    Repeated rows give repeated rows; a null doc_id is kept. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_merges(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _worker(shared) as encoder:
            for batch in _slices(batches, 1):
                parts = encoder.encode(batch.column(1).to_pylist())
                offsets = np.cumsum([0, *map(len, parts)], dtype=np.int64) // 4
                values = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)], ["id", "ids"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").select(F.col("id").alias(doc_id), "ids")


def token_counts(docs: DataFrame, keep: list[str], text: str, vocabulary: str = BYTE_BPE_50K, out: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the number of tokens of every row's text; 0 for null and empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(read_merges(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _worker(shared) as encoder:
            for batch in _slices(batches, len(keep)):
                n = [len(b) // 4 for b in encoder.encode(batch.column(len(keep)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], [f"k{i}" for i in range(len(keep))] + ["n"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"k{i} {kinds[c]}" for i, c in enumerate(keep)] + ["n bigint"])
    counted = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text")).mapInArrow(run, schema)
    return counted.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("n").alias(out))
