"""Benchmark decontamination by greedy string tiling.

Benchmark items are a query set held against every document. Their seeds, runs of ``MIN_MATCH``
tokens, go to every task; a document that shares none with an item is passed over in a few
array operations. For the others, running Karp-Rabin hashes find the longest common runs of
tokens not yet marked, which are marked and cannot be used again, until none of the minimum
length is left. The share of an item's tokens that are marked is its coverage, whatever the
order of the runs in the document, so reordered passages count in full.

What is sent to the tasks is bounded: items are taken in blocks of ``BLOCK_TOKENS`` tokens, and every
block is one scan of the documents. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.components import stored
from orderloom.llm.words import (
    LOWER, PUNCTUATION, content_hashes, gram_hashes, powers, slices, text_bytes,
    word_spans,
)

MIN_MATCH = 5
MIN_COVERAGE = 0.5
#: Search length that the tiling starts with.
FIRST_LENGTH = 20
#: Tokens of benchmark items in a block; about 40 bytes of each task's memory per token.
BLOCK_TOKENS = 2_000_000
_PAIR = "doc {kind}, item_id bigint, item_tokens bigint, matched bigint, tiles bigint, coverage double"


def token_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Position and token hashes of every text. Tokens are runs of letters and digits."""
    data, offsets = text_bytes(column)
    for first, last in slices(offsets):
        at = offsets[first : last + 1] - offsets[first]
        part = LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, bounds = word_spans(part, at, PUNCTUATION)
        hashes = content_hashes(part, starts, ends)
        for i in range(last - first):
            yield first + i, hashes[bounds[i] : bounds[i + 1]]


def _windows(tokens: np.ndarray, marked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of ``length`` unmarked tokens, and their running Karp-Rabin hashes."""
    up, down = powers(len(tokens))
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * up[: len(tokens)], out=sums[1:])
    taken = np.concatenate([[0], np.cumsum(marked)])
    starts = np.flatnonzero(taken[length:] == taken[: len(taken) - length])
    return starts, (sums[starts + length] - sums[starts]) * down[starts]


def _matches(
    item: np.ndarray, doc: np.ndarray, item_marked: np.ndarray, doc_marked: np.ndarray, length: int
) -> np.ndarray:
    """Maximal common runs of at least ``length`` unmarked tokens: rows (run, in item, in doc)."""
    none = np.zeros((0, 3), np.int64)
    if length > min(len(item), len(doc)):
        return none
    i, item_hashes = _windows(item, item_marked, length)
    j, doc_hashes = _windows(doc, doc_marked, length)
    order = np.argsort(item_hashes, kind="stable")
    i, item_hashes = i[order], item_hashes[order]
    low = np.searchsorted(item_hashes, doc_hashes, "left")
    many = np.searchsorted(item_hashes, doc_hashes, "right") - low
    total = int(many.sum())
    if not total:
        return none
    at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(total)
    pairs = np.stack([i[at], np.repeat(j, many)], axis=1)
    # Equal running hashes are only a proposal.
    same = np.ones(len(pairs), bool)
    for k in range(length):
        same &= item[pairs[:, 0] + k] == doc[pairs[:, 1] + k]
    pairs = pairs[same]
    if not len(pairs):
        return none
    # Windows that follow each other on a diagonal are one run.
    diagonal = pairs[:, 1] - pairs[:, 0]
    order = np.lexsort((pairs[:, 0], diagonal))
    pairs, diagonal = pairs[order], diagonal[order]
    fresh = np.r_[True, (np.diff(diagonal) != 0) | (np.diff(pairs[:, 0]) != 1)]
    first = np.flatnonzero(fresh)
    runs = np.diff(np.r_[first, len(pairs)]) + length - 1
    return np.column_stack([runs, pairs[first]])


def greedy_tiles(
    item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH
) -> list[tuple[int, int, int]]:
    """Tiles (length, start in item, start in doc): non-overlapping, longest first."""
    item_marked, doc_marked = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    found: list[tuple[int, int, int]] = []
    length = max(min_match, min(FIRST_LENGTH, len(item)))
    while True:
        matches = _matches(item, doc, item_marked, doc_marked, length)
        if len(matches) and matches[:, 0].max() > 2 * length:
            length = int(matches[:, 0].max())
            continue
        order = np.lexsort((matches[:, 2], matches[:, 1], -matches[:, 0]))
        cut = False
        for run, i, j in matches[order].tolist():
            if item_marked[i : i + run].any() or doc_marked[j : j + run].any():
                # What is left of it is found again in the next round.
                cut = True
                continue
            item_marked[i : i + run] = doc_marked[j : j + run] = True
            found.append((run, i, j))
        if cut:
            continue
        if length == min_match:
            return found
        length = max(min_match, length // 2)


@dataclass(frozen=True)
class Block:
    """Items with their tokens end to end, and sorted seeds with the items that have them."""

    ids: np.ndarray
    bounds: np.ndarray
    tokens: np.ndarray
    seeds: np.ndarray
    seed_items: np.ndarray
    seed_places: np.ndarray

    def item(self, k: int) -> np.ndarray:
        return self.tokens[self.bounds[k] : self.bounds[k + 1]]


def make_block(items: list[tuple[int, np.ndarray]], min_match: int) -> Block:
    seeds, owners, places = [], [], []
    for k, (_, tokens) in enumerate(items):
        # An item shorter than a seed is sought whole.
        grams = gram_hashes(tokens, min(min_match, len(tokens)))
        seeds.append(grams)
        owners.append(np.full(len(grams), k))
        places.append(np.arange(len(grams)))
    seeds, owners, places = map(np.concatenate, (seeds, owners, places))
    order = np.argsort(seeds, kind="stable")
    return Block(
        np.array([i for i, _ in items]), np.cumsum([0, *(len(t) for _, t in items)]),
        np.concatenate([t for _, t in items]), seeds[order], owners[order], places[order],
    )


def _shared_items(block: Block, tokens: np.ndarray, widths: list[int], least: float) -> list[int]:
    """Items whose seeds in the document could cover the share ``least`` of their tokens."""
    covered: dict[int, set[int]] = {}
    for width in widths:
        grams = np.unique(gram_hashes(tokens, width))
        low = np.searchsorted(block.seeds, grams, "left")
        low = low[block.seeds[np.minimum(low, len(block.seeds) - 1)] == grams]
        for at in low.tolist():
            seed = block.seeds[at]
            while at < len(block.seeds) and block.seeds[at] == seed:
                place = int(block.seed_places[at])
                places = covered.setdefault(int(block.seed_items[at]), set())
                places.update(range(place, place + width))
                at += 1
    sizes = np.diff(block.bounds)
    return [k for k, places in sorted(covered.items()) if len(places) >= least * sizes[k]]


def _scan(
    batches: Iterator[pa.RecordBatch], block: Block, min_match: int, least: float
) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(block.bounds)
    widths = sorted({min(min_match, int(n)) for n in sizes})
    for batch in batches:
        rows = []
        for at, tokens in token_hashes(batch.column(1)):
            for k in _shared_items(block, tokens, widths, least):
                item = block.item(k)
                tiles = greedy_tiles(item, tokens, min(min_match, len(item)))
                matched = sum(run for run, _, _ in tiles)
                if tiles and matched >= least * len(item):
                    rows.append((at, int(block.ids[k]), len(item), matched, len(tiles), matched / len(item)))
        at, *columns = zip(*rows) if rows else [()] * 6
        kinds = [pa.int64()] * 4 + [pa.float64()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(at, pa.int64())),
                *[pa.array(c, k) for c, k in zip(columns, kinds)],
            ],
            ["doc", "item_id", "item_tokens", "matched", "tiles", "coverage"],
        )


def _blocks(
    benchmark: DataFrame, item_id: str, text: str, min_match: int, block_tokens: int
) -> Iterator[Block]:
    """Items with a token, a block at a time; no more than one block is on the driver."""
    hashed = stored(
        benchmark.where(F.col(item_id).isNotNull())
        .select(F.col(item_id).cast("bigint"), text)
        .mapInArrow(_item_tokens, "id bigint, tokens binary"),
        "benchmark",
    )
    items: list[tuple[int, np.ndarray]] = []
    held = 0
    for row in hashed.toLocalIterator():
        items.append((row["id"], np.frombuffer(bytes(row["tokens"]), np.uint64)))
        held += len(items[-1][1])
        if held >= block_tokens:
            yield make_block(items, min_match)
            items, held = [], 0
    if items:
        yield make_block(items, min_match)


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, t) for i, t in token_hashes(batch.column(1)) if len(t)]
        at = pa.array([i for i, _ in found], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), pa.array([t.tobytes() for _, t in found], pa.binary())],
            ["id", "tokens"],
        )


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    min_match: int = MIN_MATCH,
    min_coverage: float = MIN_COVERAGE,
    row_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Documents and the benchmark items that they hold, one row per pair.

    Returns ``row_id, item_id, item_tokens, matched`` (tokens under a tile), ``tiles`` (their
    number) and ``coverage`` (matched / item_tokens), for coverage of at least
    ``min_coverage``. Tokens are runs of letters, digits and non-ASCII characters, A-Z
    lower-cased. An item of fewer than ``min_match`` tokens must occur whole. Items without a
    token or an id are left out, null texts hold nothing; repeated documents and items give
    a row each; an empty table gives none.
    """
    kind = docs.schema[row_id].dataType.simpleString()
    schema, rows = _PAIR.format(kind=kind), docs.select(row_id, text)
    scans = [
        rows.mapInArrow(lambda batches, b=block: _scan(batches, b, min_match, min_coverage), schema)
        for block in _blocks(benchmark, item_id, item_text, min_match, block_tokens)
    ]
    if not scans:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("doc", row_id)
    return reduce(DataFrame.union, scans).withColumnRenamed("doc", row_id)


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    min_match: int = MIN_MATCH,
    min_coverage: float = MIN_COVERAGE,
    text: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are.

    The decision is made where the row is, so nothing is joined. Items need no id; other edge
    cases as in ``contaminated_pairs``.
    """
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays(
                [pa.array(np.arange(batch.num_rows)), batch.column(names.index(text))], ["id", "text"]
            )
            bad = next(_scan(iter([numbered]), block, min_match, min_coverage)).column(0)
            good = np.ones(batch.num_rows, bool)
            good[bad.to_numpy()] = False
            yield batch.filter(pa.array(good))

    # Which item it is does not matter here, so all have the same id.
    items = benchmark.select(F.lit(0).alias("item_id"), "text")
    for block in _blocks(items, "item_id", "text", min_match, block_tokens):
        docs = docs.mapInArrow(lambda batches, b=block: keep(batches, b), docs.schema)
    return docs
