"""Exact Jaccard join of documents by their word n-grams, closed to components.

A document is the set of 64-bit hashes of its n-grams. Documents with equal sets are one
*node* from the start. Nodes meet in tiles of a size band: the smaller of a linked pair lies
in the band, the larger in it or the next, so at most ``D`` n-grams of the tile's pairs differ.
A tile cuts the hash range into ``k > D`` equal cells; differing n-grams spoil at most D of
them, so a linked pair agrees in all n-grams of at least ``k - D`` cells. The hash of a cell's
n-grams is the signature under which nodes meet. It takes a whole cell in common to meet, so
a passage that very many documents share brings few of them together.

Cells with one n-gram or none say little and are left out wherever more of them than
``k - D`` would be needed to hide a link.

Pairs that meet are first held against each other by parity bitmaps: every differing n-gram
flips one bit, so the bits that differ bound the overlap from above. A bitmap grows with its set,
so that long documents do not fill theirs and pass for near; two of unlike size are compared at the
size of the smaller one. What remains is decided by intersecting the sorted sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.components import scratch, stored
from orderloom.llm.linkage import folded_hamming, linked_components, numpy_hamming
from orderloom.llm.words import (
    LOWER, content_hashes, gram_hashes, mix, slices, text_bytes, word_spans,
)

#: 64-bit words of a set's bitmap, at least and at most; always a power of two.
SKETCH_WORDS = 16
MOST_SKETCH_WORDS = 1024
#: Width of a size band: the next begins at half as much again.
BAND_GROWTH = 1.5
#: Row keys that are sent to every task at most, 16 bytes each; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Sets that a task knows to have passed on; it then starts afresh. Results do not depend on it.
NODES_REMEMBERED = 250_000
#: Pairs of one document that one task compares.
PAIRS_AT_ONCE = 512


def document_sets(
    column: pa.Array, n: int
) -> Iterator[tuple[int, np.ndarray]]:
    """Position and sorted distinct n-gram hashes of every text that has a word.

    A text of fewer than ``n`` words has one n-gram, all of its words.
    """
    data, offsets = text_bytes(column)
    for first, last in slices(offsets):
        at = offsets[first : last + 1] - offsets[first]
        part = LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, bounds = word_spans(part, at)
        hashes = content_hashes(part, starts, ends)
        for i in range(last - first):
            words = hashes[bounds[i] : bounds[i + 1]]
            if len(words):
                # A short text's n-gram must not look like one of full length.
                width = min(n, len(words))
                grams = gram_hashes(words, width) + np.uint64(n - width)
                yield first + i, np.unique(grams)


def node_of(grams: np.ndarray) -> np.int64:
    """One number for a set of n-grams."""
    total = mix(grams).sum(dtype=np.uint64) + np.uint64(len(grams))
    return mix(np.array([total]))[0].astype(np.int64)


def sketch_words(size: int, percent: int) -> int:
    """Words of the bitmap of a set of ``size``.

    A pair is ruled out if more bits differ than ``(100 - percent) / (100 + percent)`` of both sizes
    together. In full bitmaps half of the bits do, so it takes four times that share of one size
    at least; six times and more are given.
    """
    bits = 6 * size * (100 - percent) // (100 + percent)
    return min(MOST_SKETCH_WORDS, max(SKETCH_WORDS, 1 << (max(0, bits - 1) // 64).bit_length()))


def parity_bitmap(grams: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """``words`` numbers; each n-gram flips one of their bits."""
    size = 64 * words
    bits = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


class Tiles:
    """Size bands and cells for pairs with ``100 * overlap >= percent * union``."""

    def __init__(self, percent: int):
        self.percent = percent
        # Spare cells: the fewer n-grams a cell has, the more cells say little.
        self.spare = max(0.1, 3 * (1 - percent / 100) - 0.2)
        self.starts = [1]

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * BAND_GROWTH)))
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def cells(self, band: int) -> tuple[int, int]:
        """The tile's number of cells, and how many of them a linked pair may disagree in."""
        self.band(self.starts[min(band, len(self.starts) - 1)])
        differ = (self.starts[band + 1] - 1) * (100 - self.percent) // self.percent
        return differ + 1 + int(self.spare * differ), differ

    def of(self, size: int) -> list[int]:
        """Tiles in which a set of ``size`` may meet a partner."""
        band = self.band(size)
        smallest = -(-size * self.percent // 100)
        return [band, band - 1] if band and smallest < self.starts[band] else [band]

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        """Keys of a sorted set; linked sets have at least one in common."""
        spread, keys = mix(grams ^ np.uint64(0x5851F42D4C957F2D)), []
        for tile in self.of(len(grams)):
            cells, differ = self.cells(tile)
            # The high bits place an n-gram, so a sorted set has its cells in order.
            cell = ((grams >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
            filled, first, counts = np.unique(cell, return_index=True, return_counts=True)
            sums = np.add.reduceat(spread, first)
            spared = cells - differ
            if cells - int((counts >= 2).sum()) < spared:
                chosen = counts >= 2
                filled, sums = filled[chosen], sums[chosen]
            elif cells - len(filled) >= spared:
                every = np.zeros(cells, np.uint64)
                every[filled.astype(np.int64)] = sums
                filled, sums = np.arange(cells, dtype=np.uint64), every
            salt = np.uint64(tile << 32) + filled.astype(np.uint64)
            keys.append(mix(sums + mix(salt)).astype(np.int64))
        return np.concatenate(keys)


def _profiles(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Batches of (id, key, text) as (id, key, size, node, sketch); no node without words."""
    for batch in batches:
        count = batch.num_rows
        sizes, nodes = np.zeros(count, np.int64), np.zeros(count, np.int64)
        sketches, words = [np.zeros(0, np.int64)], np.zeros(count + 1, np.int32)
        for i, grams in document_sets(batch.column(2), n):
            sizes[i], nodes[i], words[i + 1] = len(grams), node_of(grams), sketch_words(len(grams), percent)
            sketches.append(parity_bitmap(grams, int(words[i + 1])))
        offsets = pa.array(np.cumsum(words, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(sizes),
                pa.array(nodes, mask=sizes == 0),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sketches))),
            ],
            ["id", "row_key", "size", "node", "sketch"],
        )


def _signed(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Batches of (text) as (key, node). A set met again in a task is passed over."""
    tiles, seen = Tiles(percent), set()
    for batch in batches:
        keys, nodes, held = [], [], 0
        for _, grams in document_sets(batch.column(0), n):
            node = node_of(grams)
            if node in seen:
                continue
            seen.add(node)
            keys.append(tiles.signatures(grams))
            nodes.append(np.full(len(keys[-1]), node))
            held += len(keys[-1])
            if held > 200_000:
                yield _arrays(["key", "node"], np.concatenate(keys), np.concatenate(nodes))
                keys, nodes, held = [], [], 0
        if keys:
            yield _arrays(["key", "node"], np.concatenate(keys), np.concatenate(nodes))
        if len(seen) > NODES_REMEMBERED:
            seen = set()


def _arrays(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Batches of (text) as (node, grams), the sorted hashes as bytes."""
    for batch in batches:
        nodes, grams, held = [], [], 0
        for _, found in document_sets(batch.column(0), n):
            nodes.append(node_of(found))
            grams.append(found.tobytes())
            held += len(grams[-1])
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(grams)], ["node", "grams"])
                nodes, grams, held = [], [], 0
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(grams)], ["node", "grams"])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (a, salt, b, grams): a row without b brings the set that those after it meet."""
    own, mine = None, None
    for batch in batches:
        lefts, rights = [], []
        for a, b, grams in zip(*[batch.column(i).to_pylist() for i in (0, 2)], batch.column(3)):
            theirs = np.frombuffer(grams.as_buffer(), np.uint64)
            if b is None:
                own, mine = a, theirs.copy()
                continue
            if own != a:
                raise AssertionError("a set is missing from its pairs")
            both = overlap(mine, theirs)
            if 100 * both >= percent * (len(mine) + len(theirs) - both):
                lefts.append(a)
                rights.append(b)
        yield _arrays(["a", "b"], np.array(lefts, np.int64), np.array(rights, np.int64))


def within(df: DataFrame, keys: DataFrame, name: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is among stored ``keys``, or is not (``left_anti``).

    Keys are broadcast if they are at most ``BROADCAST_KEYS``, so that the texts stay where
    they are; more keys are joined by a shuffle.
    """
    few = keys.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, name, how)


def row_key(row_id: str, text: str) -> Column:
    """A number for a row's id and text."""
    return F.xxhash64(F.col(row_id), F.col(text))


def ngram_components(
    docs: DataFrame, n: int, percent: int, row_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: ``row_id, row_key, n_shingles, node, component, component_id``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Documents link if
    ``100 * overlap >= percent * union`` of their n-gram sets. ``component_id`` is the smallest
    id reachable by links. A text with fewer than ``n`` words has one n-gram; one without
    words, null or empty, has none, no node, and its own id as component. Null ids are never
    the smallest; a component of null ids only has a null one. Repeated rows link like any
    copies. An empty table gives none. Columns other than id and text are not read.
    """
    rows = docs.select(
        F.col(row_id).cast("bigint").alias("_id"), row_key(row_id, text).alias("_key"),
        F.col(text).alias("_text"),
    )
    profile = stored(
        rows.mapInArrow(
            lambda batches: _profiles(batches, n, percent),
            "id bigint, row_key bigint, size bigint, node bigint, sketch array<bigint>",
        ),
        "profiles",
    )
    items = stored(
        profile.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min("id").alias("least_id"), F.min("row_key").alias("row_key"),
            F.first("size").alias("size"), F.first("sketch").alias("sketch"),
        ),
        "nodes",
    )
    signatures = rows.select("_text").mapInArrow(
        lambda batches: _signed(batches, n, percent), "key bigint, node bigint"
    )

    def possible_sql(a: str, b: str) -> Column:
        size, sizes = F.col(f"{a}_size"), F.col(f"{b}_size")
        both = size + sizes
        differ = folded_hamming(f"{a}_sketch", f"{b}_sketch", SKETCH_WORDS)
        # overlap <= (both - differ) / 2, union = both - overlap
        return (100 * F.least(size, sizes) >= percent * F.greatest(size, sizes)) & (
            (100 + percent) * (both - differ) >= 2 * percent * both
        )

    def possible(size, sketch, sizes, sketches):
        both = size + sizes
        differ = numpy_hamming(sketch, sketches)
        return (100 * np.minimum(size, sizes) >= percent * np.maximum(size, sizes)) & (
            (100 + percent) * (both - differ) >= 2 * percent * both
        )

    def verify(pairs: DataFrame) -> DataFrame:
        with scratch(rows.sparkSession):
            return stored(_verified(rows, items, pairs, n, percent), "links", lasting=True)

    linked = stored(linked_components(signatures, items, possible_sql, possible, verify), "linked")
    placed = items.join(linked, "node", "left").select(
        "node", "least_id", F.coalesce("component", "node").alias("component")
    )
    least = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_node = placed.join(least, "component").select("node", "component", "component_id")
    return profile.join(by_node, "node", "left").select(
        F.col("id").alias(row_id), "row_key", F.col("size").alias("n_shingles"), "node", "component",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _verified(
    rows: DataFrame, items: DataFrame, pairs: DataFrame, n: int, percent: int
) -> DataFrame:
    """The pairs ``a, b`` that link, by intersecting the whole sets.

    Sets are made anew from one text of each node. The set of ``a`` is shuffled once for
    ``PAIRS_AT_ONCE`` of its pairs and stays in memory while theirs stream past it.
    """
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stored(nodes.join(items, "node").select(F.col("row_key").alias("_key")), "wanted")
    sets = stored(
        within(rows, wanted, "_key")
        .select("_text")
        .mapInArrow(lambda batches: _sets(batches, n), "node bigint, grams binary")
        .dropDuplicates(["node"]),
        "sets",
    )
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_AT_ONCE).alias("salts"))
    salted = pairs.join(salts, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt")
    )
    firsts = salts.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
    # Always sorted and merged, as in ``linking_pairs``: the plan tried on a small table is that of a large one.
    brought = firsts.join(sets.withColumnRenamed("node", "a").hint("merge"), "a").select(
        "a", "salt", F.lit(None).cast("bigint").alias("b"), "grams"
    )
    met = salted.join(sets.withColumnRenamed("node", "b").hint("merge"), "b").select(
        "a", "salt", "b", "grams"
    )
    return (
        brought.union(met)
        .repartition("a", "salt")
        .sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        .mapInArrow(lambda batches: _linked(batches, percent), "a bigint, b bigint")
    )


def one_per_component(
    docs: DataFrame, n: int = 5, percent: int = 80, row_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The row of ``docs`` with the smallest id of each component.

    Documents without words link with nothing and all stay. Of rows with that id, and in a
    component of null ids, the one with the smallest row key stays, once if it is repeated.
    """
    with scratch(docs.sparkSession):
        placed = stored(
            ngram_components(docs.select(row_id, text), n, percent, row_id, text), "placed"
        )
        place = F.struct(F.col(row_id).isNull(), F.col(row_id), F.col("row_key"))
        kept_keys = (
            placed.where("node IS NOT NULL")
            .groupBy("component")
            .agg(F.min(place)["row_key"].alias("_key"))
            .select("_key")
            .distinct()
        )
        dropped = stored(
            placed.where("node IS NOT NULL")
            .select(F.col("row_key").alias("_key"))
            .distinct()
            .join(kept_keys, "_key", "left_anti"),
            "dropped", lasting=True,
        )
        repeated = stored(
            placed.where("node IS NOT NULL").groupBy(F.col("row_key").alias("_key"))
            .agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("_key"),
            "repeated", lasting=True,
        )
    # The row travels as one value, so none of its columns can clash with the key.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, row_key(row_id, text).alias("_key"))
    kept = within(rows, dropped, "_key", "left_anti")
    if not repeated.isEmpty():
        once = within(kept, repeated, "_key").dropDuplicates(["_key"])
        kept = within(kept, repeated, "_key", "left_anti").unionByName(once)
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
