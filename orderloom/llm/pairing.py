"""Bringing the payloads of candidate pairs together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of one left item that one task compares.
PAIRS_AT_ONCE = 512

#: A payload and those that it meets, as bytes; true for each that it links with.
Compare = Callable[[bytes, list[bytes]], np.ndarray]


def linking_pairs(pairs: DataFrame, payloads: DataFrame, compare: Compare) -> DataFrame:
    """The pairs ``a, b`` whose payloads ``compare`` links.

    ``payloads`` has ``node, payload`` (binary), one row per node. The payload of ``a`` is
    shuffled once for ``PAIRS_AT_ONCE`` of its pairs and stays in memory while the others
    stream past it, so an item with very many partners is spread over tasks.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_AT_ONCE).alias("salts"))
    salted = pairs.join(salts, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt")
    )
    firsts = salts.select(
        "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt")
    )
    # Payloads are large and the pairs many: always sorted and merged, so that a plan that was
    # tried on a small table is the one that runs on a large one.
    brought = firsts.join(payloads.withColumnRenamed("node", "a").hint("merge"), "a").select(
        "a", "salt", F.lit(None).cast("bigint").alias("b"), "payload"
    )
    met = salted.join(payloads.withColumnRenamed("node", "b").hint("merge"), "b").select(
        "a", "salt", "b", "payload"
    )
    return (
        brought.union(met)
        .repartition("a", "salt")
        .sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        .mapInArrow(lambda batches: _compared(batches, compare), "a bigint, b bigint")
    )


def _compared(batches: Iterator[pa.RecordBatch], compare: Compare) -> Iterator[pa.RecordBatch]:
    """Sorted rows (a, salt, b, payload): one without b brings what those after it meet."""
    own, mine = None, b""
    for batch in batches:
        lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        nodes, others = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        at = 0
        while at < len(nodes):
            if others[at] is None:
                own, mine = nodes[at], batch.column(3)[at].as_py()
                at += 1
                continue
            end = at
            while end < len(nodes) and others[end] is not None:
                end += 1
            if own != nodes[at]:
                raise AssertionError("a payload is missing from its pairs")
            links = compare(mine, [p.as_py() for p in batch.column(3).slice(at, end - at)])
            met = np.array(others[at:end], np.int64)[links]
            lefts.append(np.full(len(met), own, np.int64))
            rights.append(met)
            at = end
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(lefts)), pa.array(np.concatenate(rights))], ["a", "b"]
        )
