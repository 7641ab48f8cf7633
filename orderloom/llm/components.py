"""Connected components of an edge list, as Spark joins."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.session import staging_path

#: Rows of two numbers that are sent to every task at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000

#: Paths stored inside the ``scratch`` blocks that are open in this thread, the innermost last.
_open_blocks: ContextVar[tuple[list[str], ...]] = ContextVar("open_blocks", default=())


def stored(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there.

    The schema is known, so reading it back starts no job of its own. The shuffles of the job that
    wrote it are never read again, and their files go at its end. Inside ``scratch`` the rows last until
    the end of the block, ``lasting`` ones until that of the block around it.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    for block in _open_blocks.get()[-2:-1] if lasting else _open_blocks.get()[-1:]:
        block.append(path)
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is ``stored`` inside is deleted at the end; nothing may read it from then on."""
    paths: list[str] = []
    opened = _open_blocks.set((*_open_blocks.get(), paths))
    try:
        yield
    finally:
        _open_blocks.reset(opened)
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            # The folder above was made for this path alone.
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(hadoop).delete(folder, True)


def small_batches(spark: SparkSession, size: str = "8m"):
    """Rows of jobs run inside go to Python in Arrow batches of ``size`` instead of 64 MB.

    A batch lies in memory outside the JVM's heap, in the worker, and in what either makes of it.
    """
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def brought(df: DataFrame) -> DataFrame:
    """Stored rows of two numbers, to be sent to every task if they are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node that it is connected to.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; direction, copies, loops and
    null ends do not matter. Nodes without an edge do not appear. No edges, no rows.

    Alternates two steps until every edge leads straight to a node that leads nowhere: every node points its
    larger neighbours, then its smaller ones and itself, to the smallest node that it knows. Each step
    is an aggregate and a join on the node, so a node with very many edges is combined before the shuffle
    and split by the join. The number of rounds grows with the logarithm of the longest path. Edges are
    read several times in the first round.
    """
    links = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    while True:
        nodes, astray = _nodes_and_astray(links)
        if not astray:
            break
        few = nodes <= BROADCAST_ROWS
        links = stored(_small_star(_large_star(links, few), few), "links")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()


def _nodes_and_astray(links: DataFrame) -> tuple[int, int]:
    """How many nodes there are, and how many point to several, or point to one and are pointed to."""
    above = links.schema["v"].dataType
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("above")).union(
        links.select("v", F.lit(None).cast(above))
    )
    nodes = ends.groupBy("node").agg(
        F.min("above").alias("least"), F.max("above").alias("most"), F.max(F.col("above").isNull()).alias("target")
    )
    astray = F.coalesce((F.col("least") != F.col("most")) | F.col("target"), F.lit(False))
    counts = nodes.agg(
        F.count(F.lit(1)), F.count(F.when(F.col("least").isNotNull() & astray, 1))
    ).first()
    return counts[0], counts[1]


def _large_star(links: DataFrame, few: bool) -> DataFrame:
    """Points every larger neighbour of a node to the smallest of its neighbours and itself."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.where("v > u")
        .join(F.broadcast(least) if few else least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(links: DataFrame, few: bool) -> DataFrame:
    """Points every smaller neighbour of a node, and the node, to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(F.broadcast(least) if few else least, "u").select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    own = least.select("u", F.col("m").alias("v"))
    return moved.union(own).where("u <> v").distinct()
