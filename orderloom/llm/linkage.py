"""From signatures to linked groups, without ever emitting all pairs of a group.

Two items that link share a signature; the caller guarantees that. A signature may be
shared by thousands, so links are looked for in two steps:

1. Stars: in each group the item of smallest id is held against the others by their sketches, one
   pair per item. Of the pairs that an item is left with, that with the smallest id is verified, one per
   item however many groups it is in, and links are closed to components. In a group of copies all is
   settled here.
2. Tiles: groups that still span several components are cut into blocks of bounded size, and
   bit sketches of two blocks are held against each other in numpy, a longer one folded to the length
   of the other: its parts are added up without carry. Only pairs in different
   components whose sketches leave a link possible become rows, and are verified, as are the pairs
   left over from the stars. A tile sends all of its pairs if they are few for its items. In the first
   rounds one with more sends no more than would join its components, and the stars send two for any two
   components, so that a large group of copies of copies is closed with few; the last round sends all that
   are left. It is the first one that leaves nothing out, so mostly there is only one.

The last round passes every pair that could still join two components, so the components are
exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.components import (
    BROADCAST_ROWS, brought, connected_components, scratch, stored,
)

#: Items of a block: a task holds two blocks, a few hundred bytes an item. A group of up to one block
#: is one row an item; larger ones are one for each of their blocks.
BLOCK = 4096
#: Pairs for an item of a tile that are few.
PAIRS_AN_ITEM = 8
#: Sketches held against each other in one numpy call, and words of them.
COMPARED_AT_ONCE = 50_000
WORDS_AT_ONCE = 1_000_000

#: Sizes and sketches, of one length, of the left and of the right items of pairs; true where a link is
#: not ruled out.
Possible = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def linked_components(
    signatures: DataFrame,
    items: DataFrame,
    possible_sql: Callable[[str, str], Column],
    possible: Possible,
    verify: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``node, component`` for all nodes that link with another.

    ``signatures`` has ``key, node`` (bigint), ``items`` one row per node with ``node``,
    ``size`` and ``sketch`` (array<bigint>, of one length or of lengths that divide longer ones).
    ``possible_sql`` takes the prefixes of two items' columns; ``verify`` takes pairs ``a, b`` and
    returns those that link, best stored.
    """
    with scratch(items.sparkSession):
        groups = stored(_shared(signatures), "groups")
        pairs = groups.select(F.col("least_node").alias("a"), F.col("node").alias("b")).distinct()
        stars = stored(_possible_pairs(pairs, items, possible_sql), "stars")
        links = verify(stars.where("foremost").select("a", "b"))
        known = stored(connected_components(links), "components")
        known = _closed(groups, stars.where("NOT foremost"), known, items, possible, verify)
        return stored(known, "components", lasting=True)


def _closed(
    groups: DataFrame,
    stars: DataFrame,
    known: DataFrame,
    items: DataFrame,
    possible: Possible,
    verify: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``known`` with all that links found by the second step join."""
    sparing = 2
    while True:
        components = brought(known)
        rest = stored(_open_groups(groups, components), "open")
        tiles = _open_stars(stars, components, sparing > 0)
        if not rest.isEmpty():
            tiles = tiles.union(_tile_pairs(rest, items, possible, sparing > 0))
            tiles = tiles.groupBy("a", "b").agg(F.min("whole").alias("whole")) if sparing else tiles.distinct()
        tiles = stored(tiles, "tiles")
        if tiles.isEmpty():
            return known
        if sparing and tiles.where("NOT whole").isEmpty():
            sparing = 0
        found = verify(tiles.select("a", "b"))
        joined = not found.isEmpty()
        if joined:
            links = found.union(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
            known = stored(connected_components(links), "components")
        if not sparing:
            return known
        # A round that joins nothing would send the same pairs again.
        sparing = sparing - 1 if joined else 0


def _open_stars(stars: DataFrame, known: DataFrame, sparing: bool) -> DataFrame:
    """Pairs of ``stars`` that lie in different components; if ``sparing``, two for any two of them, and
    whether these are all (``whole``)."""
    pairs = stars.select("a", "b")
    for name in ("a", "b"):
        side = known.select(F.col("node").alias(name), F.col("component").alias(f"_{name}"))
        pairs = pairs.join(side, name, "left").withColumn(f"_{name}", F.coalesce(f"_{name}", name))
    pairs = pairs.where("_a <> _b")
    if sparing:
        pair = F.struct("a", "b")
        return (
            pairs.groupBy(F.least("_a", "_b").alias("_low"), F.greatest("_a", "_b").alias("_high"))
            .agg(F.array_distinct(F.array(F.min(pair), F.max(pair))).alias("_sent"), F.count(F.lit(1)).alias("_all"))
            .select(F.explode("_sent").alias("_pair"), (F.col("_all") <= 2).alias("whole"))
            .select("_pair.*", "whole")
        )
    return pairs.select("a", "b")


def _open_groups(groups: DataFrame, known: DataFrame) -> DataFrame:
    """``key, node, component, members`` of groups that span several components.

    Nodes without any link are components of their own. The least node of a group has
    been held against all others and needs no second look. Groups of the same members, as
    near copies have by the dozen, count once.
    """
    members = groups.join(known, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component")
    )
    open_keys = (
        members.groupBy("key")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.count(F.lit(1)).alias("members"),
            F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("_set"),
        )
        .where("low < high")
        .groupBy("members", "_set")
        .agg(F.min("key").alias("key"))
        .select("key", "members")
    )
    return members.join(open_keys, "key")


def _shared(signatures: DataFrame) -> DataFrame:
    """``key, node, least_node`` for every node of a key but the least.

    One shuffle of bare numbers; nearly all keys are met once and end here.
    """
    in_order = Window.partitionBy("key").orderBy("node")
    return (
        signatures.withColumn("least_node", F.min("node").over(in_order))
        .where("node > least_node")
        .dropDuplicates(["key", "node"])
    )


def _possible_pairs(
    pairs: DataFrame, items: DataFrame, possible: Callable[[str, str], Column]
) -> DataFrame:
    """Pairs whose sketches leave a link possible, and whether theirs is the least ``a`` of ``b``."""
    def side(name: str) -> DataFrame:
        return items.select(
            F.col("node").alias(name), F.col("size").alias(f"{name}_size"),
            F.col("sketch").alias(f"{name}_sketch"),
        )

    joined = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    # Rows lie by b already, and an item is in no more pairs than it has signatures.
    foremost = F.col("a") == F.min("a").over(Window.partitionBy("b"))
    return joined.where(possible("a", "b")).select("a", "b").withColumn("foremost", foremost)


def hamming(a: str, b: str, words: int, first: int = 0) -> Column:
    """Bits in which ``words`` words of the sketches in columns ``a`` and ``b`` differ."""
    total = F.lit(0)
    for i in range(first, first + words):
        total = total + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return total


def folded_hamming(a: str, b: str, words: int) -> Column:
    """Bits in which the sketches differ, the longer folded; most have ``words`` words."""
    fold = "aggregate(sequence(i, size({0}) - 1, least(size({1}), size({2}))), 0L, (x, j) -> x ^ get({0}, j))"
    unlike = F.expr(
        f"aggregate(sequence(0, least(size({a}), size({b})) - 1), 0, "
        f"(total, i) -> total + bit_count({fold.format(a, a, b)} ^ {fold.format(b, a, b)}))"
    )
    usual = (F.size(a) == words) & (F.size(b) == words)
    return F.when(usual, hamming(a, b, words)).otherwise(unlike)


def _tile_pairs(
    rest: DataFrame, items: DataFrame, possible: Possible, sparing: bool
) -> DataFrame:
    """Pairs of open groups that lie in different components and may link; if ``sparing``, a tile of
    more than ``PAIRS_AN_ITEM`` for each of its rows leaves out pairs whose components are joined by those
    that it sends, and ``whole`` tells whether it did not.

    Blocks of a group meet in pairs: item of block i goes to the tiles (min(i, j), max(i, j))
    for all j, so a tile holds two blocks at most however large the group is.
    """
    # Few items are in open groups; the sketches of the others stay where they are.
    nodes = rest.select("node")
    if nodes.count() > BROADCAST_ROWS:
        nodes = stored(nodes.distinct(), "open-nodes")
    nodes = brought(nodes)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = (
        rest.withColumn("_blocks", blocks)
        .withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            "key", "node", "component", "_block",
            F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"),
        )
        .join(items.join(nodes, "node", "left_semi"), "node")
    )

    return (
        dealt.repartition("key", "_low", "_high")
        .sortWithinPartitions("key", "_low", "_high")
        .select("key", "_low", "_high", "_block", "node", "component", "size", "sketch")
        .mapInArrow(
            lambda batches: _tiles(batches, possible, sparing),
            "a bigint, b bigint, whole boolean" if sparing else "a bigint, b bigint",
        )
    )


def _tiles(
    batches: Iterator[pa.RecordBatch], possible: Possible, sparing: bool
) -> Iterator[pa.RecordBatch]:
    """Pairs of sorted tile rows. A tile that goes on in the next batch waits for it."""
    waiting: pa.RecordBatch | None = None
    for batch in batches:
        if waiting is not None and waiting.num_rows:
            batch = pa.concat_batches([waiting, batch])
        if not batch.num_rows:
            continue
        tile = _numbered(batch)
        last = int(np.searchsorted(tile, tile[-1]))
        yield _pairs_of(batch.slice(0, last), tile[:last], possible, sparing)
        waiting = batch.slice(last)
    if waiting is not None and waiting.num_rows:
        yield _pairs_of(waiting, _numbered(waiting), possible, sparing)


def _numbered(batch: pa.RecordBatch) -> np.ndarray:
    fresh = np.zeros(batch.num_rows, bool)
    for i in range(3):
        column = batch.column(i).to_numpy()
        fresh[1:] |= column[1:] != column[:-1]
    return np.cumsum(fresh)


def _folded(column: pa.ListArray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """How many words each sketch has; and for every such number, the sketches that have as many or
    more, folded to it, and where each row's is among them."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    widths, found = np.diff(offsets), {}
    for words in np.unique(widths).tolist():
        wide = widths >= words
        starts, own = offsets[:-1][wide], widths[wide]
        sketches = np.zeros((len(own), words), np.uint64)
        for width in np.unique(own).tolist():
            alike = np.flatnonzero(own == width)
            for first in range(0, width, words):
                sketches[alike] ^= flat[(starts[alike] + first)[:, None] + np.arange(words)]
        found[words] = np.cumsum(wide) - 1, sketches
    return widths, found


def _pairs_of(
    batch: pa.RecordBatch, tile: np.ndarray, possible: Possible, sparing: bool
) -> pa.RecordBatch:
    """All tiles of a batch at once: rows are held against the row 1, 2, ... places further on,
    as long as that lies in the same tile."""
    low, high, block, node, component, size = [batch.column(i).to_numpy() for i in range(1, 7)]
    widths, folded = _folded(batch.column(7))
    found = [np.zeros((0, 2), np.int64)]
    left, step = np.arange(len(tile)), 1
    while True:
        left = left[left + step < len(tile)]
        left = left[tile[left] == tile[left + step]]
        if not len(left):
            break
        right = left + step
        open_pair = (component[left] != component[right]) & (
            (low[left] == high[left]) | (block[left] != block[right])
        )
        i, j = left[open_pair], right[open_pair]
        narrow = np.minimum(widths[i], widths[j])
        for words in np.unique(narrow).tolist():
            place, sketch = folded[words]
            alike, at_once = np.flatnonzero(narrow == words), min(COMPARED_AT_ONCE, -(-WORDS_AT_ONCE // words))
            for first in range(0, len(alike), at_once):
                x, y = i[alike[first : first + at_once]], j[alike[first : first + at_once]]
                hits = possible(size[x], sketch[place[x]], size[y], sketch[place[y]])
                found.append(np.stack([x[hits], y[hits]], axis=1))
        step += 1
    at = np.concatenate(found)
    if not sparing:
        nodes = np.unique(np.sort(node[at], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(nodes[:, 0]), pa.array(nodes[:, 1])], ["a", "b"])
    members = np.bincount(tile)
    of = tile[at[:, 0]]
    whole = (np.bincount(of, minlength=len(members)) <= PAIRS_AN_ITEM * members)[of]
    many = at[~whole]
    many = many[_forest(tile[many[:, 0]], component[many[:, 0]], component[many[:, 1]])]
    nodes = np.sort(node[np.concatenate([at[whole], many])], axis=1)
    whole = np.repeat([True, False], [int(whole.sum()), len(many)])
    nodes, whole = _unique_pairs(nodes, whole)
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes[:, 0]), pa.array(nodes[:, 1]), pa.array(whole)], ["a", "b", "whole"]
    )


def _unique_pairs(nodes: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs, and whether every one that is equal is ``whole``."""
    different, of = np.unique(nodes, axis=0, return_inverse=True)
    parts = np.zeros(len(different), bool)
    parts[of.ravel()[~whole]] = True
    return different, ~parts


def _forest(tile: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Positions of pairs that are enough to join, tile by tile, all that the pairs would join."""
    _, first = np.unique(
        np.stack([tile, np.minimum(left, right), np.maximum(left, right)], axis=1),
        axis=0, return_index=True,
    )
    parent: dict[tuple[int, int], tuple[int, int]] = {}

    def find(x: tuple[int, int]) -> tuple[int, int]:
        while (above := parent.setdefault(x, x)) != x:
            parent[x] = parent[above]
            x = above
        return x

    kept = []
    for at in first.tolist():
        a, b = find((int(tile[at]), int(left[at]))), find((int(tile[at]), int(right[at])))
        if a != b:
            parent[a] = b
            kept.append(at)
    return kept


def numpy_hamming(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sketch ^ others).sum(axis=-1).astype(np.int64)
