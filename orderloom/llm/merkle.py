"""Merkle manifest of a table: a root for all rows, and for every row the proof that it is in.

A *tree* is a list of nodes in order; while several remain, every three consecutive ones become
their digest. Rows are the leaves of their source's tree, the sources' roots are the leaves of
one more.

Trees are built in aligned blocks of 3^5 nodes. A block keeps each of its levels as one string,
the hex digests end to end: the parents of a level are the digests of its substrings of three
digests, and the siblings of a node are the two substrings around it in its run. What a block
comes down to is a node of a tree that is 243 times smaller, and so on up; the proofs are put
together on the way down again. So a task holds a few blocks at a time, whatever the size of a
source, and no more than numbers and digests are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.components import stored

ARITY = 3
#: Levels that a block is built up in one go.
BLOCK_LEVELS = 5
BLOCK = ARITY**BLOCK_LEVELS
#: Characters of a digest in hex.
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# monotonically_increasing_id: partition above, row of the partition in the lower bits.
_ROW_BITS = 33


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field as its length in bytes, a colon and its text, or ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    parts = [
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
        for t in texts
    ]
    return F.sha2(F.concat(*parts), 256)


def folded_root(leaf: Column, path: Column) -> Column:
    """What a leaf and the siblings on its path come down to; the root if the leaf is in the tree."""
    return F.aggregate(
        path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256)
    )


def merkle_manifest(
    docs: DataFrame,
    row_id: str = "doc_id",
    source: str = "source",
    fields: tuple[str, ...] = FIELDS,
    claims: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row: ``row_id, source, leaf, subroot, root, path, proof_sha256, claimed_leaf,
    folded_root, verified``.

    ``leaf`` is the digest of ``fields``, in the order given. In a source's tree leaves ascend
    by ``row_id``, null first, then by leaf; equal rows are leaves of their own. ``subroot`` is
    the root of that tree (of a lone row, its leaf), and ``root`` that of the subroots in the
    order of sources, null first, then by their bytes. ``path`` has a step per level from the
    leaf to ``root``, with the digests ``left`` and ``right`` of the node in its run of three,
    empty where it has none; ``proof_sha256`` is the digest of all of them.

    ``claims`` replaces fields for a second digest, ``claimed_leaf``, which is folded along the
    path of the first; ``verified`` tells whether that gives ``root``. A claim that is null
    stands for a null field. Null and empty texts are different leaves, long ones are digested
    whole. Columns other than ``fields``, ``row_id`` and ``source`` are not read; an empty table
    gives no rows.
    """
    claims = claims or {}
    own = [F.col(f) for f in fields]
    claimed = [claims.get(f, F.col(f)) for f in fields]
    same = F.lit(True)
    for name, claim in claims.items():
        same = same & claim.eqNullSafe(F.col(name))
    leaves = docs.select(
        F.col(source).cast("string").alias("tree"), F.col(row_id).alias("id"),
        leaf_digest(*own).alias("node"),
        F.when(~same, leaf_digest(*claimed)).alias("claim"),
    )
    # The running number only tells equal rows apart, so that they do not end up in one task.
    leaves = stored(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    numbered, largest = _numbered(leaves, "tree", ["id", "node", "tie"])
    stages = _climb(
        numbered.select("tree", "at", "n", "node", F.struct("id", "claim").alias("own")), largest
    )
    subroots = stored(
        stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), _root().alias("node")),
        "subroots",
    )
    numbered, largest = _numbered(subroots, "tree", ["source"])
    above = _climb(
        numbered.select("tree", "at", "n", "node", F.col("source").alias("own")), largest
    )
    top = above[-1].select(
        "tree", F.lit(0).cast("bigint").alias("at"), _root().alias("root"),
        F.expr("CAST(array() AS array<struct<left: string, right: string>>)").alias("path"),
    )
    tops = _descend(above, top, "root").select(
        F.col("own").alias("tree"), F.lit(0).cast("bigint").alias("at"),
        F.struct("root", F.col("node").alias("subroot")).alias("roots"), "path",
    )
    placed = _descend(stages, tops, "roots").select(
        F.col("own.id").alias(row_id), F.col("tree").alias(source), F.col("node").alias("leaf"),
        F.col("roots.subroot").alias("subroot"), F.col("roots.root").alias("root"), "path",
        F.coalesce("own.claim", "node").alias("claimed_leaf"),
    )
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return placed.withColumns(
        {
            "proof_sha256": F.sha2(siblings, 256),
            "folded_root": folded_root(F.col("claimed_leaf"), F.col("path")),
        }
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _numbered(nodes: DataFrame, tree: str, order: list[str]) -> tuple[DataFrame, int]:
    """Adds ``at``, the position in the tree from 0, and ``n``, the tree's size; and the largest size.

    Nodes are range-partitioned and sorted once over all trees, so a large tree lies in many
    partitions. Only their counts, one row per partition and tree, are summed up in order.
    """
    in_order = stored(
        nodes.repartitionByRange(tree, *order)
        .sortWithinPartitions(tree, *order)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row", _ROW_BITS)),
        "in-order",
    )
    runs = in_order.groupBy(tree, "_part").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    whole = Window.partitionBy(tree)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(
        runs.select(
            F.col(tree).alias("_tree"), F.col("_part").alias("_run"), "_first",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
            F.sum("_rows").over(whole).alias("n"),
        ),
        "starts",
    )
    largest = starts.agg(F.max("n")).first()[0] or 0
    same_run = F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_run"))
    numbered = in_order.join(starts, same_run).withColumn(
        "at", F.col("_start") + F.col("_row") - F.col("_first")
    )
    return numbered, largest


def _root() -> Column:
    return F.element_at("levels", -1)


def _climb(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """Stored blocks of each stage, from the leaves up to where every tree is a single block."""
    stages = []
    while True:
        stages.append(stored(_blocks(nodes), f"blocks-{len(stages)}"))
        if largest <= BLOCK:
            return stages
        largest = -(-largest // BLOCK)
        nodes = stages[-1].select(
            "tree", F.col("block").alias("at"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"),
            _root().alias("node"), F.lit(None).cast("string").alias("own"),
        )


def _blocks(nodes: DataFrame) -> DataFrame:
    """``tree, n, block, members, levels``: aligned blocks with all their levels as strings.

    A tree of one block ends at its root; a block of a larger one goes up all its levels, also
    where a single node is left of it, as in the whole tree.
    """
    width = ARITY * DIGEST
    last = "element_at(levels, -1)"
    parents = (
        f"array_join(transform(sequence(0, (length({last}) - 1) div {width}), "
        f"run -> sha2(substring({last}, run * {width} + 1, {width}), 256)), '')"
    )
    levels = (
        f"aggregate(sequence(1, {BLOCK_LEVELS}), array(array_join(members.node, '')), "
        f"(levels, i) -> IF(n <= {BLOCK} AND length({last}) = {DIGEST}, levels, "
        f"concat(levels, array({parents}))))"
    )
    return (
        nodes.groupBy("tree", "n", F.expr(f"at div {BLOCK}").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("at", "node", "own"))).alias("members"))
        .withColumn("levels", F.expr(levels))
    )


def _descend(stages: list[DataFrame], tops: DataFrame, carried: str) -> DataFrame:
    """``tree, at, node, own, path`` and ``carried`` of every leaf.

    ``tops`` has ``tree, at`` (0), ``path`` and ``carried``, one row per tree: what lies above
    its root.
    """
    steps = ", ".join(str(ARITY**level) for level in range(BLOCK_LEVELS))
    run = f"(at div power) div {ARITY}"
    place = f"(at div power) % {ARITY}"
    start = f"{run} * {ARITY * DIGEST}"
    left = f"substring(levels[level], {start} + 1, {place} * {DIGEST})"
    right = (
        f"substring(levels[level], {start} + ({place} + 1) * {DIGEST} + 1, "
        f"({ARITY - 1} - {place}) * {DIGEST})"
    )
    path = (
        f"transform(slice(array({steps}), 1, size(levels) - 1), (power, level) -> "
        f"named_struct('left', {left}, 'right', {right}))"
    ).replace("at div", f"CAST(member.at % {BLOCK} AS int) div")
    members = (
        "transform(members, member -> named_struct('at', member.at, 'node', member.node, "
        f"'own', member.own, 'path', concat({path}, above)))"
    )
    for blocks in reversed(stages):
        over = tops.select(
            F.col("tree").alias("_tree"), F.col("at").alias("_at"), F.col("path").alias("above"), carried
        )
        met = blocks.join(
            over, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_at"))
        )
        tops = met.select("tree", carried, F.explode(F.expr(members)).alias("leaf")).select(
            "tree", carried, "leaf.at", "leaf.node", "leaf.own", "leaf.path"
        )
    return tops
