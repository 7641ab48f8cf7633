"""Byte-level BPE: encoding by merge rounds over many words at once, and decoding.

Texts are cut into words by the tokenizer's pattern. Words not met before are encoded
together: their symbols lie in one flat array, and in every round each word merges its pair
of lowest rank, found by binary search among the sorted keys of all mergeable pairs. A merge
makes a symbol that no other merge makes, so pairs with the new symbol rank after it, and
merging all copies of the lowest pair at once gives what merging one at a time gives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from orderloom.llm.words import slices, text_bytes

# Fixed value: the pattern of byte-level tokenizers, with white space spelled out.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Words of a text taken at a time, so that a very long text needs no long list.
WORDS_AT_ONCE = 100_000
#: Distinct words a task remembers before it starts afresh. Results do not depend on it.
WORDS_REMEMBERED = 250_000
#: Bytes of text encoded together.
CHARS_AT_ONCE = 1 << 20
_NONE = np.iinfo(np.int64).max


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file.

    Printable Latin-1 characters stand for themselves; the other bytes take, in order, the
    characters from U+0100 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """A byte-level BPE tokenizer read from a ``tokenizer.json``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"not a byte-level BPE tokenizer: {path}")
        to_byte, vocab = _byte_symbols(), model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self._split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self._words = regex.compile(WORD_PATTERN)

        texts = {i: bytes(to_byte[c] for c in name) for name, i in vocab.items()}
        texts |= {i: name.encode() for name, i in self.special.items()}
        size = max(texts) + 1
        self._lengths = np.array([len(texts.get(i, b"")) for i in range(size)], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._bytes = np.frombuffer(b"".join(texts.get(i, b"") for i in range(size)), np.uint8)
        self._byte_ids = np.zeros(256, np.int64)
        for name, byte in to_byte.items():
            self._byte_ids[byte] = vocab[name]

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys)
        self._keys, self._ranks, self._made = keys[order], order, made[order]
        self._forget()

    def _forget(self) -> None:
        self._codes: dict[str, int] = _Numbered(self.special)
        self._ids = np.array(list(self.special.values()), np.int32)
        self._from = np.arange(len(self.special), dtype=np.int64)
        self._count = np.ones(len(self.special), np.int64)

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, end to end, and the number of ids of each."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self._byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            joined = np.zeros(len(symbols), bool)
            joined[:-1] = owner[:-1] == owner[1:]
            pair = symbols << 32
            pair[:-1] |= symbols[1:]
            at = np.minimum(np.searchsorted(self._keys, pair), len(self._keys) - 1)
            known = joined & (self._keys[at] == pair)
            rank = np.where(known, self._ranks[at], _NONE)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            of_word = np.repeat(lowest, np.diff(np.r_[first, len(symbols)]))
            chosen = (rank == of_word) & known
            if (chosen[1:] & chosen[:-1]).any():
                # A run of one repeated symbol: take every other pair, from the left.
                begins = chosen & ~np.r_[False, chosen[:-1]]
                run = np.maximum.accumulate(np.where(begins, np.arange(len(chosen)), 0))
                chosen &= (np.arange(len(chosen)) - run) % 2 == 0
            symbols[chosen] = self._made[at[chosen]]
            keep = np.r_[True, ~chosen[:-1]]
            finished = of_word == _NONE
            done.append((owner[finished], symbols[finished]))
            keep &= ~finished
            symbols, owner = symbols[keep], owner[keep]
        if not done:
            return np.zeros(0, np.int32), lengths
        owners = np.concatenate([o for o, _ in done])
        ids = np.concatenate([s for _, s in done])[np.argsort(owners, kind="stable")]
        return ids.astype(np.int32), np.bincount(owners, minlength=len(words))

    def _pieces(self, text: str) -> Iterator[str]:
        parts = self._split.split(text) if self._split and self._split.search(text) else (text,)
        for part in parts:
            if part in self.special:
                yield part
            else:
                for match in self._words.finditer(part):
                    yield match.group()

    def _word_codes(self, text: str) -> np.ndarray:
        code = self._codes.__getitem__
        if len(text) <= CHARS_AT_ONCE and not (self._split and self._split.search(text)):
            words = self._words.findall(text)
            return np.fromiter(map(code, words), np.int64, len(words))
        pieces, blocks = self._pieces(text), [np.zeros(0, np.int64)]
        while block := list(islice(pieces, WORDS_AT_ONCE)):
            blocks.append(np.fromiter(map(code, block), np.int64, len(block)))
        return np.concatenate(blocks)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; strings of special tokens in a text are those tokens."""
        if len(self._codes) > WORDS_REMEMBERED:
            self._forget()
        codes = [self._word_codes(text) for text in texts]
        if new := self._codes.take_new():
            ids, counts = self._merge([w.encode() for w in new])
            starts = len(self._ids) + np.cumsum(counts) - counts
            self._ids = np.concatenate([self._ids, ids])
            self._from = np.concatenate([self._from, starts])
            self._count = np.concatenate([self._count, counts])
        return [_gather(self._ids, self._from[c], self._count[c]) for c in codes]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``, special tokens included; broken UTF-8 becomes U+FFFD."""
        found = _gather(self._bytes, self._starts[ids], self._lengths[ids])
        return found.tobytes().decode("utf-8", errors="replace")


class _Numbered(dict):
    """Numbers words in the order in which they are first looked up."""

    def __init__(self, first):
        super().__init__((w, i) for i, w in enumerate(first))
        self._new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self._new.append(word)
        return number

    def take_new(self) -> list[str]:
        new, self._new = self._new, []
        return new


def _gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + count]``, end to end."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(total)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    """The tokenizer of a file, read once per Python worker."""
    return ByteBpe(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Batches of (id, text) as batches of (id, ids)."""
    bpe = tokenizer(path)
    for batch in batches:
        _, offsets = text_bytes(batch.column(1))
        for first, last in slices(offsets, CHARS_AT_ONCE):
            part = batch.column(1).slice(first, last - first).to_pylist()
            ids = bpe.encode([t or "" for t in part])
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first), lists], ["id", "ids"]
            )


def _ids_of(lists: pa.ListArray) -> Iterator[np.ndarray]:
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    valid = lists.is_valid()
    for i in range(len(lists)):
        yield values[offsets[i] : offsets[i + 1]] if valid[i].as_py() else values[:0]


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Batches of (id, ids) as batches of (id, ids, text)."""
    bpe = tokenizer(path)
    for batch in batches:
        texts = [bpe.decode(ids) for ids in _ids_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(texts, pa.string())], ["id", "ids", "text"]
        )


def _pair(docs: DataFrame, row_id: str, value: str) -> tuple[DataFrame, str]:
    return docs.select(row_id, value), docs.schema[row_id].dataType.simpleString()


def bpe_encode(
    docs: DataFrame, vocabulary: str, row_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``row_id`` and ``ids``, the token ids of the whole text.

    ``vocabulary`` is the path of a ``tokenizer.json`` on every executor. A null or empty
    text has no ids. Rows are independent of each other, so ties, repeated rows and null
    ids change nothing; other columns are not read; an empty table gives none.
    """
    rows, kind = _pair(docs, row_id, text)
    return rows.mapInArrow(
        lambda batches: _encoded(batches, vocabulary), f"id {kind}, ids array<int>"
    ).withColumnRenamed("id", row_id)


def bpe_decode(
    tokens: DataFrame, vocabulary: str, row_id: str = "doc_id", ids: str = "ids"
) -> DataFrame:
    """``row_id``, ``ids`` and ``text``, what the ids spell. Null or no ids spell nothing."""
    rows, kind = _pair(tokens, row_id, ids)
    return rows.mapInArrow(
        lambda batches: _decoded(batches, vocabulary), f"id {kind}, ids array<int>, text string"
    ).withColumnRenamed("id", row_id).withColumnRenamed("ids", ids)


def bpe_round_trip(
    docs: DataFrame,
    vocabulary: str,
    row_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Encodes and decodes in one pass over the texts, and keeps digests of both.

    Returns ``row_id``, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned
    32-bit integers) and ``decoded_sha256`` (of the decoded text in UTF-8), and the ``ids``
    themselves if asked for. Edge cases as in ``bpe_encode``.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _decoded(_encoded(batches, vocabulary), vocabulary):
            ids = list(_ids_of(batch.column(1)))
            columns = [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                pa.array([sha256(t.encode()).hexdigest() for t in batch.column(2).to_pylist()]),
            ]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, batch.column(1)], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows, kind = _pair(docs, row_id, text)
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(
        digests, schema + (", ids array<int>" if with_ids else "")
    ).withColumnRenamed("id", row_id)
