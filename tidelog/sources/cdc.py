"""A deterministic event log from the ``events`` table: the state of each user as a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.log import DELETED, INSERTED, UPDATED, with_checksum

TABLE = "users_state"


def user_events(spark: SparkSession, sf_dir: str, with_checksums: bool = False) -> DataFrame:
    """signup inserts {v, k}, click updates {v}, view and purchase update {k}, error deletes. Users of odd id write version 2, the others version 1."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "signup", INSERTED).when(F.col("event_type") == "error", DELETED).otherwise(UPDATED)
    v, k = F.col("value").cast("string"), F.get_json_object("props", "$.k")
    data = F.when(F.col("event_type") == "signup", F.create_map(F.lit("v"), v, F.lit("k"), k)).when(F.col("event_type") == "click", F.create_map(F.lit("v"), v)).when(F.col("event_type") != "error", F.create_map(F.lit("k"), k))
    log = e.select(
        (F.col("event_id") + 1).alias("id"),
        kind.alias("type"),
        F.col("ts").alias("timestamp"),
        F.when(F.col("user_id") % 2 == 0, 1).otherwise(2).alias("version"),
        F.lit(None).cast("string").alias("tx_id"),
        F.lit(TABLE).alias("table_name"),
        F.col("user_id").alias("row_id"),
        data.alias("data"),
        F.lit(None).cast("map<string,string>").alias("old"),
        F.lit(None).cast("string").alias("definition"),
        F.lit(None).cast("string").alias("checksum"),
    )
    return with_checksum(log) if with_checksums else log
