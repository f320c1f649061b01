"""Operator 6: sum-of-squares online packing into windows of a fixed length.

Documents come one by one. Full windows are cut off the front of a long one; the rest goes
to the fill level that makes the sum of the squared numbers of windows at each level
smallest (a new window being level 0), which keeps levels diverse so that later documents
find a level that they complete. The numbers are kept in an array by level.

A window's pieces are written when it is full. When more than ``OPEN`` windows are
partially filled, and at the end of a partition, the emptiest are cut up to fill the
fullest; what is left at the end of a partition is cut into sequences of powers of two,
which need no padding. Every partition packs for itself: no shuffle, bounded memory.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import column_bytes, find_words, hash_words, slices

WINDOW, OPEN, END = 4096, 512, 2
TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Token ids of whole texts, by words.

    The tokenizer splits at white space, drops it, and looks at nothing beyond it; so a text's
    ids are those of its words in turn. Words' ids stay in a direct-mapped cache by hash
    (bounded: a new word takes the place of another), and only new words reach the tokenizer,
    ``AT_ONCE`` of them in a call, since what it returns takes far more room than their ids.
    A worker keeps the cache from task to task, so it is small beside an executor's memory.
    """

    SLOTS, MOST_IDS, AT_ONCE = 1 << 21, 1 << 23, 1 << 12

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(self.SLOTS, dtype=np.uint64)
        self.at = np.zeros(self.SLOTS, dtype=np.int32)
        self.size = np.zeros(self.SLOTS, dtype=np.int32)
        self.ids, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and the number of ids of each."""
        sizes, out = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.uint32)]
        for k in range(0, len(words), self.AT_ONCE):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words[k : k + self.AT_ONCE], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)))
            out.append(np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(sizes[-1].sum())))
        return np.concatenate(out), np.concatenate(sizes)

    def _learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, size = self._encode([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        at = self.used + np.cumsum(size, dtype=np.int64) - size
        end = self.used + int(size.sum())
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(end, 2 * len(self.ids)) - len(self.ids), dtype=np.uint32)])
        self.ids[self.used : end] = ids
        self.used = end
        slot = (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        short = ends - starts <= 64  # long words are rarely met again
        slot, at32 = slot[short], at.astype(np.int32)[short]
        # Two new words of one slot: all three arrays must end with the same one.
        _, last = np.unique(slot[::-1], return_index=True)
        last = len(slot) - 1 - last
        self.key[slot[last]], self.at[slot[last]], self.size[slot[last]] = hashes[short][last], at32[last], size[short][last]
        return at, size

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of an Arrow string column, and the number of ids of each."""
        if self.used > self.MOST_IDS:
            self._clear()
        raw, offsets = column_bytes(column)
        starts, ends, counts = find_words(raw, offsets)
        hashes = hash_words(raw, starts, ends, lower=False)
        hashes[hashes == 0] = 1
        slot = (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        at, size = self.at[slot].astype(np.int64), self.size[slot]
        new = np.flatnonzero(self.key[slot] != hashes)
        if len(new):
            unique, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            where, long_ = self._learn(raw, starts[new[first]], ends[new[first]], unique)
            at[new], size[new] = where[back], long_[back]
        before = np.cumsum(size, dtype=np.int64) - size
        total = int(size.sum())
        ids = self.ids[np.repeat(at - before, size) + np.arange(total, dtype=np.int64)]
        row = np.concatenate([[0], np.cumsum(counts)])
        bound = np.concatenate([before, [total]])
        return ids, np.diff(bound[row])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class SumOfSquares:
    """Open windows by fill level. ``out`` gets (piece, sequence, offset) once a sequence is closed; a piece is (document, start, ids)."""

    def __init__(self, window: int, first_sequence: int, out, most_open: int = OPEN):
        self.window, self.sequence, self.out, self.most_open = window, first_sequence, out, most_open
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.n = 0

    def _close(self, pieces: list) -> None:
        offset = 0
        for piece in pieces:
            self.out(piece, self.sequence, offset)
            offset += len(piece[2])
        self.sequence += 1

    def _put(self, level: int, pieces: list) -> None:
        self.count[level] += 1
        self.open.setdefault(level, []).append(pieces)
        self.n += 1

    def _take(self, level: int) -> list:
        self.count[level] -= 1
        self.n -= 1
        windows = self.open[level]
        pieces = windows.pop()
        if not windows:
            del self.open[level]
        return pieces

    def add(self, document, ids: np.ndarray) -> None:
        start, n = 0, len(ids)
        while n - start >= self.window:
            self._close([(document, start, ids[start : start + self.window])])
            start += self.window
        if start == n:
            return
        size = n - start
        level = self._choose(size)
        pieces = self._take(level) if level else []
        pieces.append((document, start, ids[start:]))
        if level + size == self.window:
            self._close(pieces)
        else:
            self._put(level + size, pieces)
            if self.n > self.most_open:
                self._refill()

    def _choose(self, size: int) -> int:
        """The level for a piece of this size; 0 is a new window. Ties go to the fullest."""
        levels = np.flatnonzero(self.count[1 : self.window - size + 1]) + 1
        best, chosen = 2 * int(self.count[size]) + 1, 0
        if len(levels):
            then = self.count[levels + size]
            change = 2 * (then - self.count[levels]) + 2
            change[levels + size == self.window] -= 1
            k = len(levels) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= best:
                chosen = int(levels[k])
        return chosen

    def _refill(self) -> list:
        """Cuts up the emptiest windows to fill the fullest; leaves one at most, which it returns and keeps open."""
        windows = [w for level in sorted(self.open) for w in self.open[level]]
        self.open, self.n = {}, 0
        self.count[:] = 0
        pool: list = []  # pieces to pour, last first
        low, high = 0, len(windows) - 1
        rest: list = []
        while low <= high:
            target = windows[high]
            high -= 1
            room = self.window - sum(len(p[2]) for p in target)
            while room:
                if not pool:
                    if low > high:
                        break
                    pool = windows[low][::-1]
                    low += 1
                document, start, ids = pool.pop()
                if len(ids) > room:
                    pool.append((document, start + room, ids[room:]))
                    ids = ids[:room]
                target.append((document, start, ids))
                room -= len(ids)
            if room:
                rest = target
            else:
                self._close(target)
        if pool:
            rest = pool[::-1] if not rest else rest + pool[::-1]
        if rest:
            self._put(sum(len(p[2]) for p in rest), rest)
        return rest

    def finish(self) -> None:
        """Closes all: what is left becomes sequences of powers of two."""
        rest = self._refill()
        left = sum(len(p[2]) for p in rest)
        pool = rest[::-1]
        while left:
            room = size = 1 << (left.bit_length() - 1)
            pieces = []
            while room:
                document, start, ids = pool.pop()
                if len(ids) > room:
                    pool.append((document, start + room, ids[room:]))
                    ids = ids[:room]
                pieces.append((document, start, ids))
                room -= len(ids)
            self._close(pieces)
            left -= size
        self.open, self.n = {}, 0
        self.count[:] = 0


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for.

    ``docs`` needs doc_id and text; other columns are not read. Null text is empty (the end
    id alone). A repeated row is a document of its own. Sequence ids are unique; they grow by
    partition and are not gapless over all.
    """
    path = tokenizer or tokenizer_path()
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        rows: list[tuple] = []

        def out(piece, sequence: int, offset: int) -> None:
            (doc, tokens), start, ids = piece
            crc = zlib.crc32(ids.tobytes())
            rows.append((doc, start, len(ids), crc, tokens, sequence, offset, *([ids.astype(np.int32)] if with_ids else [])))

        kinds = [pa.int64()] * 7 + ([pa.list_(pa.int32())] if with_ids else [])
        names = [*(x.split()[0] for x in PIECES.split(", ")), *(["ids"] if with_ids else [])]

        def taken():
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return batch

        packer = SumOfSquares(window, TaskContext.get().partitionId() << 36, out)
        encode = encoder(path).encode
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, counts = encode(part["text"])
                at = 0
                for doc, n in zip(part["doc_id"].to_pylist(), counts.tolist(), strict=True):
                    own = np.empty(n + 1, dtype="<u4")
                    own[:n], own[n] = ids[at : at + n], end
                    at += n
                    packer.add((doc, n + 1), own)
                if len(rows) > 20000:
                    yield taken()
        packer.finish()
        if rows:
            yield taken()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
