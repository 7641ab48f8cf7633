"""Bronze, silver and gold in a row. The layers meet only in Parquet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath
from posixpath import normpath
from urllib.parse import urlparse

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from orderloom.entities import Entity, order_entities
from orderloom.operators.sales import MONEY_SCALE
from orderloom.plans.bronze import IngestCount, run_bronze
from orderloom.plans.gold import run_gold
from orderloom.plans.silver import SilverRun, run_silver
from orderloom.sources.spec import Source


@dataclass(frozen=True)
class PipelineRun:
    ingested: list[IngestCount]
    cleansed: SilverRun
    gold_rows: dict[str, int]


def require_separate_paths(inputs: list[str], outputs: list[str]) -> None:
    """Raise ValueError if two outputs, or an output and an input, overlap.

    Overwriting a folder that the same job still reads destroys it before Spark
    notices.
    """

    for i, output in enumerate(outputs):
        for other in inputs + outputs[i + 1 :]:
            if _overlap(output, other):
                raise ValueError(f"paths overlap: {output} and {other}")


def _overlap(a: str, b: str) -> bool:
    a_url, b_url = urlparse(a), urlparse(b)
    # A path without a scheme may be on either file system.
    if a_url.scheme and b_url.scheme and a_url[:2] != b_url[:2]:
        return False
    a_path, b_path = PurePosixPath(normpath(a_url.path)), PurePosixPath(normpath(b_url.path))
    return a_path.is_relative_to(b_path) or b_path.is_relative_to(a_path)


def run_pipeline(
    spark: SparkSession,
    sources: Mapping[str, Source],
    bronze: str,
    silver: str,
    gold: str,
    entities: Mapping[str, Entity] | None = None,
    money_scale: int | None = MONEY_SCALE,
    timestamp_type: T.DataType | None = None,
    grains: Sequence[str] = (),
) -> PipelineRun:
    """Runs all layers and returns their counts; nothing is logged or kept in memory.

    ``grains`` adds weekly and monthly sales, see ``run_gold``.
    """
    entities = entities or order_entities()
    files = [s.path for s in sources.values() if s.path is not None]
    require_separate_paths(files, [bronze, silver, gold])
    ingested = run_bronze(spark, sources, entities, bronze)
    cleansed = run_silver(spark, entities, bronze, silver, timestamp_type)
    return PipelineRun(ingested, cleansed, run_gold(spark, silver, gold, money_scale, grains))
