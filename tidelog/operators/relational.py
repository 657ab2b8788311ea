"""Scans, equality filters and equi-joins over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.values import Literal, equals_column, equals_literal


def filter_equal(df: DataFrame, column: str, literal: Literal) -> DataFrame:
    """Rows whose column equals the literal by text; an unknown column equals nothing."""
    if column not in df.columns:
        return df.where(F.lit(False))
    return df.where(equals_literal(F.col(f"`{column}`"), df.schema[column].dataType, literal))


def join_equal(left: DataFrame, left_table: str, left_column: str, right: DataFrame, right_table: str, right_column: str, compat: bool = False) -> DataFrame:
    """Inner equi-join with qualified output columns.

    Nulls equal each other, and the text that stands for them. In a self-join both sides have the same names, and the right side's values
    are the output. An absent column raises; with ``compat`` it counts as null on all rows.
    """
    for df, table, column in ((left, left_table, left_column), (right, right_table, right_column)):
        if column not in df.columns and not compat:
            raise ValueError(f"join condition references unknown column '{table}.{column}'")
    missing = [left_column not in left.columns, right_column not in right.columns]
    a, b = left.alias("__l"), right.alias("__r")
    if any(missing):
        joined = a.crossJoin(b) if all(missing) else a.crossJoin(b).limit(0)
    else:
        kinds = left.schema[left_column].dataType, right.schema[right_column].dataType
        x, y = F.col(f"__l.`{left_column}`"), F.col(f"__r.`{right_column}`")
        joined = a.join(b, equals_column(x, kinds[0], y, kinds[1]))
    out = {f"{left_table}.{c}": F.col(f"__l.`{c}`") for c in left.columns}
    out |= {f"{right_table}.{c}": F.col(f"__r.`{c}`") for c in right.columns}
    return joined.select([v.alias(k) for k, v in out.items()])


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """value, n: the values of a key column that more than one row has."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where("n > 1")
