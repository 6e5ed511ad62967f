"""Byte-pair encoding and decoding with a published vocabulary.

Each short word keeps a contiguous array of its parts and one of the merge ranks
of adjacent parts. The smallest rank is found by a scan, the boundary there is
deleted and the two ranks beside it are looked up anew. The arrays of many words
are the rows of two matrices, so one numpy step scans and merges all of them.
Words above ``_LONG_BYTES`` would make the scans quadratic and take the same
merges from a heap over linked parts.

The ids of words already met are kept in a table of bounded size.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The word pattern of the vocabulary's byte-level pre-tokeniser.
_WORD_PATTERN = (
    r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_LONG_BYTES = 64
_KEPT_WORDS = 400_000
_WORDS_AT_ONCE = 16_384
_ENCODED_NAMES = ["doc_id", "tokens", "decoded"]
_NO_RANK = np.iinfo(np.int32).max


def byte_alphabet() -> dict[str, int]:
    """Character of each byte in the vocabulary file: visible Latin-1 characters
    stand for themselves, all other bytes for the code points from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Coder:
    """Encoder and decoder of one vocabulary, given as the text of its file."""

    def __init__(self, vocabulary: str):
        data = json.loads(vocabulary)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        plain = {t: i for t, i in data["model"]["vocab"].items() if t not in special}
        self._ids = {raw(t): i for t, i in plain.items()}
        self._ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self._ranks[raw(left), raw(right)] = rank
        self._special = special
        self._cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self._words = regex.compile(_WORD_PATTERN)
        self._rows: dict[str, int] = {}  # of the words in the table
        self._table = np.empty(0, np.int32), np.zeros(1, np.int64)  # ids, ends
        size = max([*self._ids.values(), *special.values()], default=-1) + 1
        self._bytes = [b""] * size
        for token, i in self._ids.items():
            self._bytes[i] = token
        for token, i in special.items():
            self._bytes[i] = token.encode()
        # Ranks and results of all merges by pair of ids, for look-ups of many at once.
        self._size = size
        found = sorted(
            (self._ids[a] * size + self._ids[b], rank, self._ids[a + b])
            for (a, b), rank in self._ranks.items()
        )
        self._pairs = np.array([f[0] for f in found] or [-1], np.int64)
        self._pair_rank = np.array([f[1] for f in found] or [_NO_RANK], np.int32)
        self._merged = np.zeros(len(self._ranks) + 1, np.int32)
        for _, rank, i in found:
            self._merged[rank] = i
        self._byte_ids = np.array([self._ids[bytes([b])] for b in range(256)], np.int32)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        flat, ends = self.encode_flat(texts)
        return [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin and end. New words
        of all texts are merged together."""
        cut = [self._cut_words(text) for text in texts]
        asked = set().union(*cut)
        new = [w for w in asked if w not in self._rows]
        ids, ends, base = *self._table, len(self._rows)
        more, more_ends = self._encode_words(new)
        ids, ends = np.concatenate([ids, more]), np.concatenate([ends, ends[-1] + more_ends[1:]])
        fresh = dict(zip(new, range(base, base + len(new)), strict=True))
        if base + len(new) <= _KEPT_WORDS:
            self._rows.update(fresh)
            self._table, rows = (ids, ends), self._rows
        else:
            rows = {w: self._rows[w] for w in asked if w in self._rows} | fresh
        at = np.fromiter(map(rows.__getitem__, chain.from_iterable(cut)), np.int64)
        sizes = ends[at + 1] - ends[at]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(ends[at] - stops[:-1], sizes) + np.arange(stops[-1])
        return ids[take], stops[np.cumsum([0, *map(len, cut)])]

    def decode(self, ids) -> str:
        return b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")

    def _cut_words(self, text: str) -> list[str]:
        """Words of the text; special tokens are words of their own."""
        if self._cut is None or not any(s in text for s in self._special):
            return self._words.findall(text)
        words: list[str] = []
        for k, part in enumerate(self._cut.split(text)):
            words.extend([part] if k % 2 else self._words.findall(part))
        return words

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's begin and end."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        for k in np.flatnonzero(np.isin(sizes, [len(s.encode()) for s in self._special])):
            if words[k] in self._special:
                sizes[k] = 0
        order = np.argsort(sizes, kind="stable")
        found, counts = [], np.zeros(len(raw), np.int64)
        borders = [0, *(np.flatnonzero(np.diff(sizes[order])) + 1).tolist(), len(raw)]
        for a, b in zip(borders, borders[1:], strict=False):
            size = int(sizes[order[a]]) if a < b else 0
            for k in range(a, b, _WORDS_AT_ONCE):
                block = order[k : min(b, k + _WORDS_AT_ONCE)]
                if 0 < size <= _LONG_BYTES:
                    ids, counts[block] = self._merge_short([raw[i] for i in block], size)
                    found.append(ids)
                    continue
                for i in block:
                    own = self._merge_long(raw[i]) if size else [self._special[words[i]]]
                    counts[i] = len(own)
                    found.append(np.array(own, np.int32))
        # From the order by size back to the given one.
        starts = np.empty(len(raw), np.int64)
        starts[order] = np.concatenate([[0], np.cumsum(counts[order])])[:-1]
        ends = np.concatenate([[0], np.cumsum(counts)])
        flat = np.concatenate(found) if found else np.empty(0, np.int32)
        return flat[np.repeat(starts - ends[:-1], counts) + np.arange(ends[-1])], ends

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self._size + right
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        known = (self._pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self._pair_rank[at], _NO_RANK)

    def _merge_short(self, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one size, and how many each has. A row of ``parts`` holds a word's parts from the
        left and -1 after them, a row of ``ranks`` those of its adjacent parts."""
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size)
        parts = np.full((len(words), size + 1), -1, np.int32)
        parts[:, :size] = self._byte_ids[raw]
        ranks = self._rank_of(parts[:, :-1], parts[:, 1:])  # the last stands for no pair
        done = np.full((len(words), size), -1, np.int32)
        rows, column = np.arange(len(words)), np.arange(size + 1)
        while len(rows):
            at = ranks.argmin(1)
            line = np.arange(len(rows))
            least = ranks[line, at]
            over = least == _NO_RANK
            if over.any():
                done[rows[over]] = parts[over, :size]
                rows, parts, ranks = rows[~over], parts[~over], ranks[~over]
                at, least, line = at[~over], least[~over], np.arange(len(rows))
                if not len(rows):
                    break
            # The boundary after ``at`` goes: everything behind it moves up by one.
            take = np.minimum(column + (column > at[:, None]), size)
            parts[line, at] = self._merged[least]
            last = parts[:, -1:].copy()
            parts = np.take_along_axis(parts, take, 1)
            parts[:, -1:] = last
            ranks = np.take_along_axis(ranks, np.minimum(take[:, :-1], size - 1), 1)
            ranks[:, -1] = _NO_RANK
            ranks[line, at] = self._rank_of(parts[line, at], parts[line, at + 1])
            left = np.flatnonzero(at)
            before = at[left] - 1
            ranks[left, before] = self._rank_of(parts[left, before], parts[left, before + 1])
        return done[done >= 0], (done >= 0).sum(1)

    def _merge_long(self, raw: bytes) -> tuple[int, ...]:
        """The same merges, least rank first and leftmost on ties, from a heap."""
        size = len(raw)
        after = list(range(1, size + 1))  # start of the next part, by start of a part
        before = list(range(-1, size - 1))
        alive = [True] * size

        def rank(start: int) -> int | None:
            middle = after[start]
            return None if middle >= size else self._ranks.get(
                (raw[start:middle], raw[middle : after[middle]])
            )

        heap = [(r, k) for k in range(size - 1) if (r := rank(k)) is not None]
        heapq.heapify(heap)
        while heap:
            found, start = heapq.heappop(heap)
            if not alive[start] or rank(start) != found:
                continue
            middle = after[start]
            alive[middle] = False
            after[start] = after[middle]
            if after[start] < size:
                before[after[start]] = start
            for k in (start, before[start]):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return tuple(self._ids[raw[k : after[k]]] for k in range(size) if alive[k])


_coders: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    """The worker's coder of a broadcast vocabulary, built once."""
    key = shared.value[0]
    if key not in _coders:
        _coders[key] = Coder(shared.value[1])
    return _coders[key]


def share(spark: SparkSession, path: str):
    """Broadcast of a vocabulary file, which only the driver reads. Its size is that
    of the vocabulary (some MB) and does not depend on the data."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    return spark.sparkContext.broadcast((hash(text), text))


def encode(text: Column, vocabulary) -> Column:
    """array<int> of token ids; a null text gives an empty array."""

    @F.arrow_udf("array<int>")
    def encode_text(column: pa.Array) -> pa.Array:
        flat, ends = _coder(vocabulary).encode_flat([text or "" for text in column.to_pylist()])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    return encode_text(text)


def decode(tokens: Column, vocabulary) -> Column:
    """Text of token ids; bytes that are no UTF-8 become U+FFFD; null gives an empty text."""

    @F.arrow_udf("string")
    def decode_tokens(column: pa.Array) -> pa.Array:
        coder = _coder(vocabulary)
        return pa.array(
            [coder.decode(v.values.to_pylist() if v.is_valid else ()) for v in column], pa.string()
        )

    return decode_tokens(tokens)


def encoded(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, token ids and the text decoded from them, for each row of ``docs``.

    Repeated rows stay repeated; a null text counts as empty and gives no tokens;
    other columns are not looked at. Every row is handled alone: no shuffle.
    """
    vocabulary = share(docs.sparkSession, vocabulary_path)

    def both(batches):
        coder = _coder(vocabulary)
        for batch in batches:
            flat, ends = coder.encode_flat([t or "" for t in batch.column(1).to_pylist()])
            parts = zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            back = [coder.decode(flat[a:b].tolist()) for a, b in parts]
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), tokens, pa.array(back, pa.string())], _ENCODED_NAMES
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, tokens array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(both, schema)
