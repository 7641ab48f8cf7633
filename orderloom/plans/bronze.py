"""Bronze: typed ingest, no quality rules beyond required values of database rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from orderloom.entities import Entity
from orderloom.operators.quality import drop_null_required, lacks_required
from orderloom.sources.parquet import observe, write_parquet
from orderloom.sources.spec import Source, read_source


@dataclass(frozen=True)
class IngestCount:
    entity: str
    written: int
    dropped: int


def run_bronze(
    spark: SparkSession, sources: Mapping[str, Source], entities: Mapping[str, Entity], out: str
) -> list[IngestCount]:
    """Writes every entity to ``out/<entity>``; each source is scanned once.

    All sources are opened before the first write, so a missing path or an unknown
    kind leaves earlier output alone.
    """
    opened = {n: read_source(spark, sources[n], e.raw) for n, e in entities.items()}
    counts = []
    for name, rows in opened.items():
        dropped = None
        if sources[name].kind == "jdbc":
            # Text never gets here without a value: its parser fails the job.
            required = entities[name].required
            rows, dropped = observe(
                rows, {"dropped": F.count_if(lacks_required(rows, required))}
            )
            rows = drop_null_required(rows, required)
        written = write_parquet(rows, f"{out}/{name}")
        counts.append(IngestCount(name, written, dropped.get["dropped"] if dropped else 0))
    return counts
