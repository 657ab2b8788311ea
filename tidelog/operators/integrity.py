"""Detecting, reporting and skipping corrupt events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.sources.log import CREATED, DELETED, EVOLVED, INSERTED, UPDATED, checksum

CHECKSUM, STRUCTURE = "checksum", "structure"


def structure_ok() -> Column:
    """Whether an event has what its type requires; unknown types require nothing."""
    has = {c: F.col(c).isNotNull() for c in ("table_name", "row_id", "data", "definition")}
    row = has["table_name"] & has["row_id"]
    return F.when(F.col("type").isin(INSERTED, UPDATED), row & has["data"]).when(F.col("type") == DELETED, row).when(F.col("type").isin(CREATED, EVOLVED), has["table_name"] & has["definition"]).otherwise(True)


def with_issues(log: DataFrame) -> DataFrame:
    """``issue``: null, or the first thing that is wrong with the event: its checksum, then its structure."""
    return log.withColumn("issue", F.when(~F.col("checksum").eqNullSafe(checksum()), CHECKSUM).when(~structure_ok(), STRUCTURE))


def issues(log: DataFrame) -> DataFrame:
    return with_issues(log).where("issue is not null").select("id", "type", "issue")


def report(log: DataFrame) -> DataFrame:
    """One row: total, corrupted, first_issue, last_valid, recovered (valid after the first issue), can_partial.

    Checksums are computed once. All events before the first issue are valid, so those after it follow from a count of ids.
    """
    bad = F.col("issue").isNotNull()
    r = with_issues(log).agg(F.count("*").alias("total"), F.count_if(bad).alias("corrupted"), F.min(F.when(bad, F.col("id"))).alias("cut"), F.max(F.when(~bad, F.col("id"))).alias("last_valid")).first()
    before = log.where(F.col("id") < r.cut).count() if r.corrupted else r.total
    row = (r.total, r.corrupted, r.cut or 0, r.last_valid or 0, r.total - r.corrupted - before, r.corrupted < r.total)
    return log.sparkSession.createDataFrame([row], "total long, corrupted long, first_issue long, last_valid long, recovered long, can_partial boolean")


def valid(log: DataFrame) -> DataFrame:
    """The events without an issue: what a partial recovery replays."""
    return with_issues(log).where("issue is null").drop("issue")


#: Issues that ``status`` spells out.
SPELLED_OUT = 20


def status(log: DataFrame) -> str:
    """The report in words; of many issues the first ones, and how many more there are."""
    r = report(log).first()
    lines = [f"{r.total - r.corrupted} of {r.total} events are usable"]
    if r.corrupted:
        lines.append(f"{r.corrupted} corrupt, from event {r.first_issue} on; {r.recovered} usable after it, the last one {r.last_valid}")
        lines += [f"event {i.id}, {i.type}: wrong {i.issue}" for i in issues(log).orderBy("id").limit(SPELLED_OUT).collect()]
        if r.corrupted > SPELLED_OUT:
            lines.append(f"and {r.corrupted - SPELLED_OUT} more")
    return "\n".join(lines)
