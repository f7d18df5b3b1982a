"""Byte-level BPE by prefix dynamic programming, exact to the merge order of tiktoken's ranks.

For each byte prefix of a pre-token there is one last token that its encoding can end with: the token t for which
(the last token of the prefix before t, t) would stay unmerged side by side. The table of these tokens is all that is
stored: reading it from the end back gives the ids, appending bytes only adds entries, and an edit keeps all
entries before it.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import chunks, shared
from strandline.llm import textbytes as tb

# Fixed value: the pattern of pre-tokens of GPT-2.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[tuple[str, str], Encoder] = {}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.sizes = [0] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.sizes[i] = len(t)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        #: Pairs looked at before, as a << 20 | b.
        self.known: dict[int, bool] = {}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.parts[i] = (i, i)
            for k in range(len(t) - 1, 0, -1):
                a, b = ranks.get(t[:k], i), ranks.get(t[k:], i)
                if a < i and b < i and self._apart(a, b):
                    self.parts[i], self.merged[a, b] = (a, b), i
                    break
        # A trie of the tokens that merges can make, read from their ends (any other token stands for a whole pre-token
        # only): from node << 8 | byte to the next node, and the token that a node completes, or -1.
        self.step: dict[int, int] = {}
        self.ends = [-1]
        for t, i in ranks.items():
            if len(t) == 1 or self.parts[i] != (i, i):
                node = 0
                for byte in reversed(t):
                    following = self.step.get(node << 8 | byte)
                    if following is None:
                        following = self.step[node << 8 | byte] = len(self.ends)
                        self.ends.append(-1)
                    node = following
                self.ends[node] = i

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def _apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay two tokens: walking back through their merges, newest first, no merge
        across the border may come before the merges that made its two sides."""
        before = 1 << 40
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            if a > b:  # a was made after b: look at the border as it was before
                before, last = a, self.parts[a][1]
                if last != a:
                    a = last
                    continue
                before, first = b + 1, self.parts[b][0]
                if first == b:
                    return True
                b = first
            else:
                before, first = b + 1, self.parts[b][0]
                if first != b:
                    b = first
                    continue
                before, last = a, self.parts[a][1]
                if last == a:
                    return True
                a = last

    def look(self, a: int, b: int) -> bool:
        """As ``_apart``, and kept for the next time."""
        if len(self.known) > 200_000:
            self.known.clear()
        found = self.known[a << 20 | b] = self._apart(a, b)
        return found


class PrefixTable:
    """Last tokens of all prefixes of one pre-token."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        if data:
            self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        """Exact: entries of old prefixes do not change. Of the tokens that end a new prefix exactly one fits."""
        old = len(self.data)
        self.data = data = self.data + more
        last, put = self.last, self.last.append
        step, ends, known, look = self.v.step, self.v.ends, self.v.known.get, self.v.look
        for i in range(old, len(data)):
            node = 0
            while True:
                node = step[node << 8 | data[i]]
                t = ends[node]
                if t >= 0:
                    if not i:
                        break
                    before = last[i]
                    fits = known(before << 20 | t)
                    if fits or fits is None and look(before, t):
                        break
                i -= 1
            put(t)
        return self

    def edit(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Replace bytes start to end; entries up to start are kept."""
        tail = new + self.data[end:]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        return self.append(tail)

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            t = self.last[at]
            out.append(t)
            at -= len(self.v.token[t])
        return out[::-1]


class Encoder:
    """Texts to ids and back; ``pattern`` cuts texts into pre-tokens, which are encoded one by one."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.v, self.find = vocabulary, regex.compile(pattern).findall
        self._known = chunks.Kept()
        #: Only with this pattern are the cuts of ``chunks`` safe, and a line feed must be one token.
        self.cuts = pattern == PATTERN and b"\n" in vocabulary.ranks
        self.marks = {m: vocabulary.ranks[m.encode()].to_bytes(4, "little") for m in chunks.MARKS}

    def pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens as little-endian unsigned 32-bit integers. In sorted order each one keeps the entries of the
        prefix that it shares with the one before: ``PrefixTable``, with all that it needs at hand."""
        v = self.v
        step, ends, sizes, known, look, rank = v.step, v.ends, v.sizes, v.known.get, v.look, v.ranks.get
        out, before, last = {}, b"", [-1]
        for data, piece in sorted([(p.encode(), p) for p in pieces]):
            whole = rank(data)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
                continue
            same, most = 0, min(len(before), len(data))
            while same < most and before[same] == data[same]:
                same += 1
            del last[same + 1 :]
            for i in range(same, len(data)):
                node = 0
                while True:
                    node = step[node << 8 | data[i]]
                    t = ends[node]
                    if t >= 0:
                        if not i:
                            break
                        left = last[i]
                        fits = known(left << 20 | t)
                        if fits or fits is None and look(left, t):
                            break
                    i -= 1
                last.append(t)
            before, at, ids = data, len(data), []
            while at:
                t = last[at]
                ids.append(t)
                at -= sizes[t]
            ids.reverse()
            out[piece] = array("I", ids).tobytes()
        return out

    def _parts(self, parts: list[str]) -> list[bytes]:
        return chunks.by_stems(parts, self._known, lambda some: self._cut([[" " + p] if p.isalpha() else self.find(chunks.shown(p)) for p in some]), self.marks)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return self._cut(list(map(self.find, texts)))

    def _cut(self, cut: list[list[str]]) -> list[bytes]:
        new = self.pieces({p for pieces in cut for p in pieces})
        return [new[pieces[0]] if len(pieces) == 1 else b"".join(map(new.__getitem__, pieces)) for pieces in cut]

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        return [ids.tobytes() for ids in chunks.encode(texts, chunks.kept_ids(self._known, self._parts, 4), self._whole, 4, self.cuts)]

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text], pa.string()))[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.v.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def reencode(self, text: str, ids: bytes, start: int, end: int, new: str) -> tuple[str, bytes]:
        """Text and ids after characters start to end became ``new``; pre-tokens away from the edit keep their ids."""
        edited = text[:start] + new + text[end:]
        old, at, used = self.find(text), 0, 0
        head = []
        for piece in old:  # pieces that end two characters before the edit cannot change
            if at + len(piece) > start - 2:
                break
            at, used = at + len(piece), used + len(self.encode(piece))
            head.append(piece)
        if head:  # but the last of them may have looked ahead
            last = head.pop()
            at, used = at - len(last), used - len(self.encode(last))
        return edited, ids[:used] + self.encode(edited[at:])


def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    tb.kept["bpe"] = _loaded.clear
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Encoder(Vocabulary.load(path), pattern)
    return _loaded[path, pattern]


def _encode(path: str, pattern: str, text: int | None, with_ids: bool, with_text: bool):
    @tb.task("bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            row = batch.column("__row")
            column = batch.column("__text") if text is None else tb.field(row, text)
            for i, j, _, _ in tb.chunks(batch, column, 3 << 19):
                n, ids_hash, text_hash, all_ids, texts = [], [], [], [], []
                for ids in e.encode_column(column.slice(i, j - i)):
                    back = e.decode(ids)
                    n.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(back).hexdigest())
                    all_ids.append(ids if with_ids else None)
                    texts.append(back.decode("utf-8", "replace") if with_text else None)
                yield pa.record_batch(
                    [row.slice(i, j - i), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string()), pa.array(all_ids, pa.binary()), pa.array(texts, pa.string())],
                    names=["__row", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"],
                )

    return run


def bpe_round_trip(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Encode and decode each whole text with the ranks in a tiktoken file; no special tokens.

    Each match of ``pattern`` is encoded by prefix dynamic programming (see above), and the ids are decoded again.
    A map over rows: nothing is shuffled, and each worker keeps a bounded number of pre-tokens that it has seen.

    Returns the columns of ``docs``, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256, and,
    unless switched off, ids (such bytes) and decoded (the text). Columns of these names are replaced. A null text
    counts as empty: no ids. Repeated rows each give a row; an empty table gives an empty one; other nulls pass through.
    """
    shared.lean(docs.sparkSession)
    columns = docs.columns if with_ids or with_text else [c for c in docs.columns if c != text] or docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), *([] if text in columns else [F.col(f"`{text}`").alias("__text")]))
    added = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else []), *(["decoded"] if with_text else [])]
    ddl = f"__row {rows.schema['__row'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string"
    out = rows.mapInArrow(_encode(vocabulary, pattern, columns.index(text) if text in columns else None, with_ids, with_text), ddl)
    return shared.unpacked(out, columns, added)
