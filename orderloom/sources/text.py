"""Comma-separated text with a header line and no quoting.

Not ``spark.read.csv``: a line equal to the header is dropped wherever it stands, a
file without a header keeps its first line, quotes are ordinary characters, an empty
field is an empty string, and surplus fields are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.functions.columns import field_or_null, is_padded_integer


def header_line(spark: SparkSession, path: str) -> str:
    """First line of the first file, by name, that has one.

    Files are found by Spark tasks, without their content, and only the first name with
    something in it comes back. ``first()`` on the lines would start with the largest file.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path")
    last = ""
    while True:
        found = files.where(F.col("path") > last).agg(F.min("path")).first()[0]
        if found is None:
            raise ValueError(f"no header line: no lines in {path}")
        # A name is no pattern, whatever characters it has.
        line = spark.read.text(re.sub(r"([\\{}\[\]*?])", r"\\\1", found)).first()
        if line is not None:
            return line[0]
        last = found


def read_body_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines under ``path`` that differ from the header, as column ``value``."""
    lines = spark.read.text(path).select("value")
    return lines.where(F.col("value") != header_line(spark, path))


def parse_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Lines as typed columns, by position. A bad or missing field fails the job.

    No column of a good line is null, so lines are tested once, not once per column,
    whether or not the session runs in ANSI mode. The test is a filter: which columns are
    read, if any, makes no difference to it.

    Cells are cast in a generator of one row per line. The optimizer merges projections and
    moves filters through them, and would so repeat every cast for the test and again for the result;
    it does neither through a generator.
    """
    cells = F.col("_cells")
    typed = [field_or_null(cells, i, f).alias(f"_{i}") for i, f in enumerate(schema.fields)]
    padded = F.lit(False)
    for i, f in enumerate(schema.fields):
        if isinstance(f.dataType, T.IntegralType):
            padded = padded | is_padded_integer(cells, i, F.col("_line").getField(f"_{i}"))
    parsed = lines.select("value", F.split("value", ",", -1).alias("_cells")).select(
        "value", "_cells", F.explode(F.array(F.struct(*typed))).alias("_line")
    )
    values = [F.col("_line").getField(f"_{i}") for i in range(len(schema.fields))]
    bad = padded
    for value in values:
        bad = bad | value.isNull()
    complaint = F.concat(F.lit(f"not a line of {schema.simpleString()}: "), F.col("value"))
    good = F.when(bad, F.raise_error(complaint).cast("boolean")).otherwise(F.lit(True))
    return parsed.where(good).select(*[v.alias(f.name) for v, f in zip(values, schema.fields)])


def read_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A text dataset as a typed frame."""
    return parse_lines(read_body_lines(spark, path), schema)
