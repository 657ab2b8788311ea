"""Indexes of a column: the row ids that hold each value, values compared by text.

An index is a DataFrame of entries (value, row_id), so that adding, removing and looking up are a union, a
filter and a predicate. Written to a folder it is parted by a hash of the value, so that a lookup opens one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.values import NIL, Literal, render, render_column

#: Parts of a written index.
PARTS = 64


def entries(rows: DataFrame, column: str) -> DataFrame:
    """The entries of ``rows`` (row_id and the column), a missing value under its text."""
    text = render_column(F.col(f"`{column}`"), rows.schema[column].dataType)
    return rows.select(F.coalesce(text, F.lit(NIL)).alias("value"), "row_id")


def added(index: DataFrame, value: Literal | None, row_id: int) -> DataFrame:
    """With one entry more, also if it is there already."""
    return index.unionByName(index.sparkSession.createDataFrame([(render(value), row_id)], "value string, row_id long"))


def removed(index: DataFrame, value: Literal | None, row_id: int) -> DataFrame:
    """Without the entries of this value and row."""
    return index.where((F.col("value") != render(value)) | (F.col("row_id") != row_id))


def lookup(index: DataFrame, value: Literal | None) -> DataFrame:
    """row_id of every row that holds the value."""
    if "part" in index.columns:
        index = index.where(F.col("part") == F.pmod(F.xxhash64(F.lit(render(value))), F.lit(PARTS)))
    return index.where(F.col("value") == render(value)).select("row_id")


def exists(index: DataFrame, value: Literal | None) -> bool:
    return not lookup(index, value).isEmpty()


def _part(value: str) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(PARTS)).alias("part")


def write(index: DataFrame, path: str) -> None:
    index.select("value", "row_id", _part("value")).write.mode("overwrite").partitionBy("part").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value string, row_id long, part long").parquet(path)
