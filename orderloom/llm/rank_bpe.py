"""Byte-level BPE by ranks: encoding in padded matrices of equally long words, and decoding.

A rank file lists byte strings; the rank of one is its token id. A text is cut into words by
a pattern. A word that is listed is a token; any other starts as its bytes, and the leftmost of
its adjacent pairs whose bytes together have the lowest rank is merged until no pair is listed.

Words not met before are dealt out by length into matrices, a word a row, padded to the bucket's
width. In every round each row merges one pair: the row closes the gap, and only the two pairs
beside the merge are looked up again, in a hash table of all listed pairs with open addressing.
Rows that are done leave the matrix.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from orderloom.llm.words import slices, text_bytes

#: Bytes of the longest words that go into matrices; longer ones are merged one by one.
WIDEST = 256
#: Cells of a matrix at most.
CELLS = 1 << 19
#: Distinct words a task remembers before it starts afresh. Results do not depend on it.
WORDS_REMEMBERED = 200_000
#: Characters from which on a text's words are taken ``WORDS_AT_ONCE`` at a time.
LONG_TEXT = 1 << 20
WORDS_AT_ONCE = 100_000
#: More than any rank: a pair that is not listed.
_NONE = np.iinfo(np.int32).max
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Ranks of pairs of ids, found by hash: a power of two of slots, collisions in the next ones."""

    def __init__(self, left: np.ndarray, right: np.ndarray, ranks: np.ndarray):
        bits = max(4, (4 * len(ranks)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, np.int64)
        self._ranks = np.full(1 << bits, _NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        while len(keys):
            free = self._keys[slot] < 0
            # Of several keys for a free slot the first stays; the others go on.
            _, first = np.unique(slot, return_index=True)
            stays = np.zeros(len(keys), bool)
            stays[first] = True
            stays &= free
            self._keys[slot[stays]] = keys[stays]
            self._ranks[slot[stays]] = ranks[stays]
            keys, ranks, slot = keys[~stays], ranks[~stays], (slot[~stays] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> self._shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``_NONE`` if it is not listed. Both arrays have one shape."""
        keys = (left.astype(np.int64) << 32 | right).ravel()
        slot = self._slot(keys)
        met = self._keys[slot]
        found = np.where(met == keys, self._ranks[slot], np.int32(_NONE))
        again = np.flatnonzero((met != keys) & (met >= 0))
        while len(again):
            slot[again] = (slot[again] + 1) & self._mask
            at = slot[again]
            met = self._keys[at]
            hit = met == keys[again]
            found[again[hit]] = self._ranks[at[hit]]
            again = again[~hit & (met >= 0)]
        return found.reshape(left.shape)


class _Numbered(dict):
    """Words and their numbers; a word not met before takes the next."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class RankBpe:
    """The tokenizer of a rank file and a pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            lines = (line.split() for line in file if line.strip())
            self._listed = {base64.b64decode(text): int(rank) for text, rank in lines}
        missing = [b for b in range(256) if bytes([b]) not in self._listed]
        if missing:
            raise ValueError(f"bytes without a rank in {path}: {missing[:5]}")
        # White space is that of Unicode, which \s is not for every library.
        pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}")
        pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self._words = regex.compile(pattern)
        size = max(self._listed.values()) + 1
        texts = [b""] * size
        for text, rank in self._listed.items():
            texts[rank] = text
        self._lengths = np.array([len(t) for t in texts], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._bytes = np.frombuffer(b"".join(texts), np.uint8)
        self._byte_ids = np.array([self._listed[bytes([b])] for b in range(256)], np.int32)
        # A padding cell makes no listed pair.
        self._padding = size
        pairs = [
            (self._listed[text[:cut]], self._listed[text[cut:]], rank)
            for text, rank in self._listed.items()
            for cut in range(1, len(text))
            if text[:cut] in self._listed and text[cut:] in self._listed
        ]
        self._pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).astype(np.int32).T)
        self._forget()

    def _forget(self) -> None:
        self._numbers: dict[str, int] = _Numbered()
        self._ids = np.zeros(0, np.int32)
        self._from = np.zeros(0, np.int64)
        self._count = np.zeros(0, np.int64)

    # -- words ---------------------------------------------------------------

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, end to end, and the number of ids of each."""
        ids: list[np.ndarray | None] = [None] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            rank = self._listed.get(word)
            if rank is not None:
                ids[i] = np.array([rank], np.int32)
            elif len(word) > WIDEST:
                ids[i] = self._merge_long(word)
            else:
                # Widths 4, 6, 8, 12, 16, 24, 32, ...: a third of a row is padding at most.
                top = 1 << max(2, (len(word) - 1).bit_length())
                buckets.setdefault(top * 3 // 4 if len(word) <= top * 3 // 4 and top > 4 else top, []).append(i)
        for width, members in buckets.items():
            rows = max(1, CELLS // width)
            for first in range(0, len(members), rows):
                part = members[first : first + rows]
                for i, found in zip(part, self._merge_rows([words[j] for j in part], width)):
                    ids[i] = found
        counts = np.array([len(x) for x in ids], np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), counts

    def _merge_rows(self, words: list[bytes], width: int) -> list[np.ndarray]:
        lengths = np.array([len(w) for w in words], np.int64)
        inside = np.arange(width) < lengths[:, None]
        cells = np.full((len(words), width), self._padding, np.int32)
        cells[inside] = self._byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((len(words), width), _NONE, np.int32)
        ranks[:, :-1] = self._pairs.ranks(cells[:, :-1], cells[:, 1:])
        row_of, done = np.arange(len(words)), [np.zeros(0, np.int32)] * len(words)
        while len(row_of):
            at = ranks.argmin(axis=1)
            rows = np.arange(len(row_of))
            merged = ranks[rows, at]
            open_rows = merged != _NONE
            if not open_rows.all():
                for i in np.flatnonzero(~open_rows):
                    done[row_of[i]] = cells[i, : lengths[i]].copy()
                cells, ranks, lengths = cells[open_rows], ranks[open_rows], lengths[open_rows]
                row_of, at, merged = row_of[open_rows], at[open_rows], merged[open_rows]
                rows = np.arange(len(row_of))
                if not len(row_of):
                    break
            # The row closes up over the right one of the pair; its width shrinks by a cell.
            columns = np.arange(cells.shape[1] - 1)
            later = columns >= at[:, None]
            cells = np.where(later, cells[:, 1:], cells[:, :-1])
            ranks = np.where(later, ranks[:, 1:], ranks[:, :-1])
            cells[rows, at] = merged
            lengths -= 1
            ranks[rows, at] = _NONE
            right = np.flatnonzero(at + 1 < lengths)
            ranks[right, at[right]] = self._pairs.ranks(
                cells[right, at[right]], cells[right, at[right] + 1]
            )
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._pairs.ranks(
                cells[left, at[left] - 1], cells[left, at[left]]
            )
        return done

    def _merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: the pairs wait in a heap by rank and place.

        A part is known by where it starts; what the heap holds of parts merged since is passed over.
        """
        size, listed = len(word), self._listed
        ends, before = list(range(1, size + 1)), list(range(-1, size))
        heap = [
            (rank, i, i + 1, i + 2)
            for i in range(size - 1)
            if (rank := listed.get(word[i : i + 2])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            _, start, middle, end = heapq.heappop(heap)
            if ends[start] != middle or ends[middle] != end:
                continue
            ends[start], ends[middle] = end, 0
            if end < size:
                before[end] = start
                rank = listed.get(word[start : ends[end]])
                if rank is not None:
                    heapq.heappush(heap, (rank, start, end, ends[end]))
            if start:
                rank = listed.get(word[before[start] : end])
                if rank is not None:
                    heapq.heappush(heap, (rank, before[start], start, end))
        ids, start = [], 0
        while start < size:
            ids.append(listed[word[start : ends[start]]])
            start = ends[start]
        return np.array(ids, np.int32)

    # -- texts ---------------------------------------------------------------

    def _numbers_of(self, text: str) -> Iterator[np.ndarray]:
        """Numbers of a text's words, with the ids of new ones at hand."""
        if len(text) < LONG_TEXT:
            parts = iter([self._words.findall(text)])
        else:
            found = (m.group() for m in self._words.finditer(text))
            parts = iter(lambda: list(islice(found, WORDS_AT_ONCE)), [])
        for words in parts:
            yield np.fromiter(map(self._numbers.__getitem__, words), np.int64, len(words))

    def _learn(self) -> None:
        """Encodes the words that have a number but no ids yet."""
        fresh = list(islice(reversed(self._numbers), len(self._numbers) - len(self._count)))
        if fresh:
            ids, counts = self.merge([w.encode() for w in reversed(fresh)])
            self._from = np.append(self._from, len(self._ids) + np.cumsum(counts) - counts)
            self._ids = np.append(self._ids, ids)
            self._count = np.append(self._count, counts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the number of ids of each."""
        if len(self._numbers) > WORDS_REMEMBERED:
            self._forget()
        ids, counts, waiting = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), []

        def flush() -> None:
            self._learn()
            if waiting:
                numbers = np.concatenate([n for _, n in waiting])
                ids.append(ranges(self._ids, self._from[numbers], self._count[numbers]))
                for i, n in waiting:
                    counts[i] += int(self._count[n].sum())
                waiting.clear()

        for i, text in enumerate(texts):
            for numbers in self._numbers_of(text):
                waiting.append((i, numbers))
                if len(text) >= LONG_TEXT:
                    flush()
                    if len(self._numbers) > WORDS_REMEMBERED:
                        self._forget()
        flush()
        return np.concatenate(ids), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of lists of ids, end to end, and the number of bytes of each list."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self._lengths)):
            raise ValueError("an id is not in the rank file")
        lengths = self._lengths[ids]
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        ends = np.cumsum(counts)
        return ranges(self._bytes, self._starts[ids], lengths), total[ends] - total[ends - counts]


def ranges(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges of ``values`` of the given starts and lengths, end to end."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(total)]


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> RankBpe:
    """The tokenizer of a file, read once per Python worker."""
    return RankBpe(path, pattern)


#: A slice of the ids column, the ids of its texts end to end, and the number of each.
Encoded = tuple[pa.Array, np.ndarray, np.ndarray]


def _encoded(batches: Iterator[pa.RecordBatch], bpe: RankBpe) -> Iterator[Encoded]:
    """Batches of (id, text) in slices of about a million bytes."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(1))
        for first, last in slices(offsets):
            texts = batch.column(1).slice(first, last - first).to_pylist()
            yield batch.column(0).slice(first, last - first), *bpe.encode([t or "" for t in texts])


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def rank_encode(
    docs: DataFrame, ranks: str, pattern: str, row_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``row_id`` and ``ids``, the token ids of the whole text.

    ``ranks`` is the path of the rank file on every executor. A null or empty text has no ids,
    the longest is encoded whole. Rows do not depend on each other, so ties, repeated rows and
    null ids change nothing; other columns are not read; an empty table gives none.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, counts in _encoded(batches, tokenizer(ranks, pattern)):
            yield pa.RecordBatch.from_arrays([rows, _lists(ids, counts)], ["id", "ids"])

    schema = f"id {_kind(docs, row_id)}, ids array<int>"
    return docs.select(row_id, text).mapInArrow(encode, schema).withColumnRenamed("id", row_id)


def rank_decode(
    tokens: DataFrame, ranks: str, pattern: str, row_id: str = "doc_id", ids: str = "ids"
) -> DataFrame:
    """``row_id`` and ``bytes``, what the ids spell: text in UTF-8 if they are those of a whole text.

    Null or no ids spell nothing; an id that is not in the file fails the job.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks, pattern)
        for batch in batches:
            lists = pc.fill_null(batch.column(1), [])
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            values = lists.flatten().to_numpy()
            for first, last in slices(offsets):
                part = values[offsets[first] : offsets[last]]
                data, sizes = bpe.decode(part, np.diff(offsets[first : last + 1]))
                spelled = _runs(data, sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(spelled, pa.binary())],
                    ["id", "bytes"],
                )

    schema = f"id {_kind(tokens, row_id)}, bytes binary"
    return tokens.select(row_id, ids).mapInArrow(decode, schema).withColumnRenamed("id", row_id)


def rank_round_trip(
    docs: DataFrame, ranks: str, pattern: str, row_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encodes and decodes in one pass over the texts, and keeps digests of both.

    Returns ``row_id``, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned
    32-bit integers) and ``decoded_sha256`` (of the decoded bytes). Edge cases as in
    ``rank_encode``.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks, pattern)
        for rows, ids, counts in _encoded(batches, bpe):
            data, sizes = bpe.decode(ids, counts)
            columns = [rows, pa.array(counts), _digests(ids.astype("<u4"), counts), _digests(data, sizes)]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {_kind(docs, row_id)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(row_id, text).mapInArrow(digests, schema).withColumnRenamed("id", row_id)


def _digests(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.array([sha256(run).hexdigest() for run in _runs(values, counts)], pa.string())


def _runs(values: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
    """The bytes of every run of values."""
    ends = np.cumsum(counts)
    for a, z in zip((ends - counts).tolist(), ends.tolist()):
        yield values[a:z].tobytes()
