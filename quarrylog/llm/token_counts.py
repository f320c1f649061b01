"""Operator 4: edit-aware token counts by segment trees.

A text is cut into leaves that can be encoded one by one, so that their counts add up. Most
cuts are where a byte-level pre-tokenizer begins a pre-token whatever lies further away:
before white space, or between a letter, a digit and another character. Where a stretch has
no such place (one word, or nothing but line ends) a leaf ends inside a pre-token. Merges of
byte pairs are local: two encodings joined are the encoding of the whole if the two tokens
at the joint, encoded as one piece, are again these two. That is checked for each such cut. (A
run of one character alone has tokens that an edit shifts up to its end: then so far.)

A tree over the leaves holds sums of lengths and of counts. An edit finds its leaves by the
lengths, re-encodes them alone, with one more leaf on a side where the joint no longer holds,
and updates the sums above them.
"""

from __future__ import annotations

import base64
import re
import string
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import slices

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Characters in a leaf, about.
LEAF = 512

Edit = tuple[int, int, str]
_CODERS: dict[str, "Counter"] = {}


class Counter:
    """Encodes text, special tokens being ordinary text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.coder.encode_ordinary
        self._joins: dict[tuple[int, int], bool] = {}

    def __call__(self, text: str) -> int:
        return len(self.encode(text))

    def joins(self, left: int, right: int) -> bool:
        """Whether two tokens stay what they are side by side in one pre-token."""
        if (found := self._joins.get((left, right))) is None:
            if len(self._joins) > 1 << 16:
                self._joins.clear()
            piece = self.coder.decode_bytes([left, right])
            found = self._joins[left, right] = list(self.coder._encode_single_piece(piece)) == [left, right]
        return found


def counter(path: str | None = None) -> Counter:
    """Counts a text's tokens, special ones being ordinary text."""
    import public_tokenizers

    path = path or public_tokenizers.path(TOKENIZER)
    if path not in _CODERS:
        _CODERS[path] = Counter(path)
    return _CODERS[path]


_SPACE = " \t\n\r"
_BREAK = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def _kind(c: str) -> str:
    """L, N, O (neither, nor space) or S as the pre-tokenizer tells them apart; empty if in doubt."""
    if c in _SPACE:
        return "S"
    if c.isspace():
        return ""
    category = unicodedata.category(c)[0]
    return category if category in "LN" else "O" if category in "PSM" else ""


def _joint(left: str, right: str) -> str:
    """What a cut between these two texts is: ``edge`` of pre-tokens that neither side can move, ``inside`` one pre-token, or empty."""
    if not left or not right:
        return ""
    a, b = _kind(left[-1]), _kind(right[0])
    if not a or not b:
        return ""
    if a != b:
        # White space reaches to its right, and an apostrophe may.
        return "" if a == "S" or left[-1] == "'" and b == "L" else "edge"
    if a == "L":  # beyond the reach of an apostrophe
        return "inside" if len(left) > 3 and all(_kind(c) == "L" for c in left[-4:-1]) else ""
    if a == "S":  # the last space of a run belongs to what follows
        return "inside" if len(right) > 1 and right[1] in _SPACE else ""
    return "" if right[0] == "'" else "inside"


def _next_cut(text: str, at: int, leaf: int, inside: Callable[[str], list[int]] | None) -> int:
    """A place at or after ``at`` to cut, the end if there is none."""
    m = _BREAK.search(text, at, at + leaf)
    if m:
        return m.start()
    for k in range(at, min(at + leaf, len(text))):
        if _joint(text[k - 4 : k] if k > 4 else text[:k], text[k : k + 2]) == "edge":
            return k
    if inside:  # ends of tokens around here, which most often hold
        first = max(0, at - 32)
        for k in inside(text[first : at + 64]):
            if first + k >= at and _joint(text[max(0, first + k - 4) : first + k], text[first + k : first + k + 2]):
                return first + k
    if at + leaf >= len(text):
        return len(text)
    return _next_cut(text, at + leaf, leaf, inside)


def cut(text: str, leaf: int = LEAF, inside: Callable[[str], list[int]] | None = None) -> list[str]:
    """Leaves of at least ``leaf`` characters, as far as there are places to cut. ``inside``: ends of a text's tokens, to cut in pre-tokens as well."""
    out, begin = [], 0
    while len(text) - begin > leaf:
        at = _next_cut(text, begin + leaf, leaf, inside)
        if at >= len(text):
            break
        out.append(text[begin:at])
        begin = at
    out.append(text[begin:])
    return out


class TokenTree:
    """A text's leaves with sums of lengths and token counts. An empty text is one empty leaf."""

    def __init__(self, text: str, count: Counter, leaf: int = LEAF):
        self.count, self.leaf, self.encoded = count, leaf, 0
        self._build(self._divided(text))

    def _ends(self, text: str) -> list[int]:
        """Ends of a text's tokens, where they are ends of characters."""
        out, data = [], b""
        for token in self.count.encode(text):
            data += self.count.coder.decode_single_token_bytes(token)
            try:
                out.append(len(data.decode()))
            except UnicodeDecodeError:
                continue
        return out

    def _leaf(self, text: str) -> tuple[str, int, int, int]:
        """Text, tokens, first and last token."""
        self.encoded += len(text)
        tokens = self.count.encode(text) if text else []
        return (text, len(tokens), tokens[0], tokens[-1]) if tokens else ("", 0, -1, -1)

    def _holds(self, left: tuple, right: tuple) -> bool:
        joint = _joint(left[0][-4:], right[0][:2])
        return joint == "edge" or joint == "inside" and self.count.joins(left[3], right[2])

    def _divided(self, text: str) -> list[tuple]:
        out: list[tuple] = []
        for part in cut(text, self.leaf, self._ends):
            new = self._leaf(part)
            while out and not self._holds(out[-1], new):
                new = self._leaf(out.pop()[0] + new[0])
            out.append(new)
        return out

    def _build(self, leaves: list[tuple]) -> None:
        self.leaves = leaves
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), dtype=np.int64)
        self.sums[self.size : self.size + len(leaves)] = [(len(x[0]), x[1]) for x in leaves]
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2

    @property
    def length(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def text(self) -> str:
        return "".join(x[0] for x in self.leaves)

    def _find(self, position: int) -> tuple[int, int]:
        """Leaf that holds a position, and where the leaf begins."""
        k, begin = 1, 0
        while k < self.size:
            k *= 2
            if position >= begin + self.sums[k, 0] and self.sums[k + 1, 0]:
                begin += int(self.sums[k, 0])
                k += 1
        return k - self.size, begin

    def _set(self, k: int, leaf: tuple) -> None:
        self.leaves[k] = leaf
        node = self.size + k
        self.sums[node] = len(leaf[0]), leaf[1]
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def _side(self, k: int, step: int) -> int | None:
        """The nearest leaf that isn't empty."""
        k += step
        while 0 <= k < len(self.leaves):
            if self.leaves[k][0]:
                return k
            k += step
        return None

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces [start, stop) of the current text. Out of range: clipped."""
        start = max(0, min(start, self.length))
        stop = max(start, min(stop, self.length))
        first, begin = self._find(start)
        last, end = self._find(max(start, stop - 1))
        parts = self._divided(self.leaves[first][0][: start - begin] + new + self.leaves[last][0][stop - end :])
        # What is at the joints is encoded together with its neighbour until the joint holds.
        while (k := self._side(first, -1)) is not None and not (parts[0][0] and self._holds(self.leaves[k], parts[0])):
            parts[:1] = self._divided(self.leaves[k][0] + parts[0][0])
            first = k
        while (k := self._side(last, 1)) is not None and not (parts[-1][0] and self._holds(parts[-1], self.leaves[k])):
            parts[-1:] = self._divided(parts[-1][0] + self.leaves[k][0])
            last = k
        while len(parts) > 1 and (broken := [k for k in range(1, len(parts)) if not self._holds(parts[k - 1], parts[k])]):
            k = broken[0]
            parts[k - 1 : k + 1] = [self._leaf(parts[k - 1][0] + parts[k][0])]
        if len(parts) > last - first + 1:
            self._build(self.leaves[:first] + parts + self.leaves[last + 1 :])
            return
        for k in range(first, last + 1):
            leaf = parts[k - first] if k - first < len(parts) else ("", 0, -1, -1)
            if leaf is not self.leaves[k]:
                self._set(k, leaf)


_DIGITS = re.compile(r"[0-9]{6,}")
_LEFT, _RIGHT = string.ascii_letters + string.digits + "._%+-", re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def scrub_edits(text: str) -> list[Edit]:
    """Edits that replace mail addresses and runs of six or more digits, last first, so that places stay true."""
    found = [(m.start(), m.end(), "<NUMBER>") for m in _DIGITS.finditer(text)]
    at = text.find("@")
    while at >= 0:
        start, width = at, 64
        while start and text[start - 1] in _LEFT:  # windows double, so long runs take linear time
            low = max(0, start - width)
            start, width = low + len(text[low:start].rstrip(_LEFT)), 2 * width
        right = _RIGHT.match(text, at + 1)
        if start < at and right:
            found.append((start, right.end(), "<MAIL>"))
        at = text.find("@", at + 1)
    out: list[Edit] = []
    for a, b, new in sorted(found, key=lambda e: (e[0], -e[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, new))
    return out[::-1]


def count_tokens(docs: DataFrame, edits: Callable[[str], list[Edit]] = scrub_edits, tokenizer: str | None = None) -> DataFrame:
    """A row for each document: doc_id, n_chars, n_tokens, n_edits, edited_chars, edited_tokens, reencoded_chars.

    Null text is empty. Edits are applied in turn, each to the text as the ones before left
    it. A text without white space, or of nothing else, is cut inside its pre-tokens. Other
    columns are not read; a repeated row is a document of its own; an empty table gives no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = counter(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    tree = TokenTree(text or "", count)
                    chars, before, encoded = tree.length, tree.tokens, tree.encoded
                    todo = edits(text or "")
                    for e in todo:
                        tree.edit(*e)
                    rows.append((doc, chars, before, len(todo), tree.length, tree.tokens, tree.encoded - encoded))
                names = ["doc_id", "n_chars", "n_tokens", "n_edits", "edited_chars", "edited_tokens", "reencoded_chars"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    schema = "doc_id long, n_chars long, n_tokens long, n_edits long, edited_chars long, edited_tokens long, reencoded_chars long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
