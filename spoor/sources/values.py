"""Recorded values as VARIANT: dynamic, nested, and printable as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(df: DataFrame, column: str = "value") -> DataFrame:
    """df with the JSON text of a column as a VARIANT; text that is no JSON becomes an Undecodable value with its hex."""
    bad = F.to_json(F.struct(F.lit("Undecodable").alias("kind"), F.lower(F.hex(column)).alias("hex")))
    empty = F.lit('{"kind":"Empty"}')
    text = F.when(F.length(column) == 0, empty).when(F.try_parse_json(F.col(column)).isNull(), bad).otherwise(F.col(column))
    return df.withColumn(column, F.parse_json(text))


def type_id(value: Column) -> Column:
    """The top-level type of a value; 0 for cells and references, which have none."""
    return F.coalesce(F.try_variant_get(value, "$.type_id", "bigint"), F.lit(0).cast("long"))


def kind(value: Column) -> Column:
    return F.try_variant_get(value, "$.kind", "string")


def to_json(value: Column) -> Column:
    return F.to_json(value)
