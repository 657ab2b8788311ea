"""The event log: an append-only table of checksummed events.

Values of a row are JSON texts in a map, so that a key that is present with null differs from an absent
key. The log is a folder of Parquet batches, each written whole by one commit and parted by table, so that
a statement reads its own table only.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampNTZType

from tidelog.functions.values import to_json

_MAP = MapType(StringType(), StringType())
SCHEMA = StructType(
    [
        StructField("id", LongType()),
        StructField("type", StringType()),
        StructField("timestamp", TimestampNTZType()),
        StructField("version", IntegerType()),
        StructField("tx_id", StringType()),
        StructField("table_name", StringType()),
        StructField("row_id", LongType()),
        StructField("data", _MAP),
        StructField("old", _MAP),
        StructField("definition", StringType()),
        StructField("checksum", StringType()),
    ]
)
CREATED, INSERTED, UPDATED, DELETED, EVOLVED = "SCHEMA_CREATED", "ROW_INSERTED", "ROW_UPDATED", "ROW_DELETED", "SCHEMA_EVOLVED"


def _entries(m: Column) -> Column:
    """A map in a form that doesn't depend on the order of its keys."""
    return F.concat_ws(",", F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))))


def checksum() -> Column:
    """SHA-256 of an event's canonical text; the one form that is written and verified."""
    parts = [F.col(c).cast("string") for c in ("id", "type", "version")]
    optional = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("tx_id", "table_name", "row_id", "definition")]
    stamp = F.coalesce(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))
    return F.sha2(F.concat_ws("|", *parts, stamp, *optional, F.coalesce(_entries(F.col("data")), F.lit("")), F.coalesce(_entries(F.col("old")), F.lit(""))), 256)


def with_checksum(events: DataFrame) -> DataFrame:
    return events.withColumn("checksum", checksum()).select(SCHEMA.names)


def event(kind: str, table: str, version: int, row_id: int | None = None, data: dict[str, Any] | None = None, old: dict[str, Any] | None = None, definition: Any = None, tx_id: str | None = None) -> dict:
    """One event without id, time and checksum."""
    maps = {k: None if v is None else {c: to_json(x) for c, x in v.items()} for k, v in (("data", data), ("old", old))}
    return {"type": kind, "version": version, "tx_id": tx_id, "table_name": table, "row_id": row_id, "definition": None if definition is None else json.dumps(definition), **maps}


def events_frame(spark: SparkSession, events: Iterable[dict], first_id: int) -> DataFrame:
    """Events with contiguous ids from ``first_id``, stamped now and checksummed."""
    now = datetime.now(UTC).replace(tzinfo=None)
    rows = [{"id": first_id + k, "timestamp": now, "checksum": None, **e} for k, e in enumerate(events)]
    return with_checksum(spark.createDataFrame([tuple(r[c] for c in SCHEMA.names) for r in rows], SCHEMA))


class EventLog:
    """A log folder with one writer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """All events; an empty frame where nothing was written."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path).select(SCHEMA.names)

    def append(self, events: DataFrame) -> None:
        """One atomic batch, in a folder for each table."""
        events.select(SCHEMA.names).write.mode("append").partitionBy("table_name").parquet(self.path)

    def last_id(self) -> int:
        return self.read().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]

    def since(self, first_id: int) -> DataFrame:
        """The tail, by a predicate that reaches the scan."""
        return self.read().where(F.col("id") >= first_id)


class CorruptLog(ValueError):
    pass


#: The names of a line's fields, and of the objects of values in a payload.
_LINE = "id LONG, type STRING, timestamp STRING, version INT, tx_id STRING, payload STRING, checksum STRING"
_DATA, _OLD = ("data", "changes", "deleted_data"), "old_values"


def _values(*names: str) -> Column:
    """The first of these objects in a payload, as a map of JSON texts. Values keep their types, so texts stay quoted."""
    found = F.coalesce(*[F.get_json_object("payload", f"$.{n}") for n in names])
    return F.transform_values(F.from_json(found, "map<string, variant>"), lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))


def _utc(text: str) -> Column:
    """A time with a zone as UTC; one without is UTC already."""
    zoned = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(text).cast("timestamp_ntz"))
    return F.when(F.col(text).rlike(r"(Z|[+-]\d\d:?\d\d)$"), zoned).otherwise(F.col(text).try_cast("timestamp_ntz"))


def _line_checksum(line: Column) -> Column:
    """SHA-256 of a line whose checksum is the empty text."""
    return F.sha2(F.regexp_replace(line, r'"checksum":"[^"]*"\}\s*$', r'"checksum":""}'), 256)


def _once(rows: DataFrame) -> DataFrame:
    """The same rows. What makes their columns runs once a row: no filter or projection above goes below a generator, where
    each of their uses of a column would make it again."""
    return rows.select(F.explode(F.array(F.struct("*"))).alias("row")).select("row.*")


def read_lines(spark: SparkSession, path: str, stop_at_error: bool = False) -> tuple[DataFrame, DataFrame]:
    """Events of a newline-delimited JSON log, and its quarantine: where the line stands (file, block, place), the line,
    a message, and id, type and time as far as they can be read.

    Lines that aren't events go to the quarantine and the rest is kept; ``stop_at_error`` drops what follows the first of
    them as well. An event whose line has the right checksum gets the log's own; any other keeps what the line
    says, so that ``integrity`` finds it.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    lines = spark.read.text(path).select("value", at.alias("at")).where(F.trim("value") != "")
    parsed = lines.withColumn("e", F.from_json("value", _LINE, {"mode": "PERMISSIVE"})).withColumn("bad", F.col("e.id").isNull() | F.col("e.type").isNull())

    def part(pattern: str) -> Column:
        return F.nullif(F.regexp_extract("value", pattern, 1), F.lit(""))

    guessed = part(r'"id":\s*(\d+)').cast("long").alias("id"), part(r'"type":\s*"(\w+)"').alias("type"), part(r'"timestamp":\s*"([^"]+)"').alias("timestamp")
    quarantine = parsed.where("bad").select("at.*", F.col("value").alias("line"), F.lit("the line is not an event").alias("message"), *guessed)
    if stop_at_error:
        first = parsed.where("bad").agg(F.min("at").alias("cut"))
        parsed = parsed.crossJoin(F.broadcast(first)).where("cut is null or at < cut")  # one row
    flat = _once(parsed).where("not bad").select("e.*", (F.col("e.checksum") == _line_checksum(F.col("value"))).alias("sound")).withColumn("timestamp", _utc("timestamp"))
    definition = F.when(F.col("type") == EVOLVED, F.col("payload")).otherwise(F.get_json_object("payload", "$.columns"))
    events = _once(flat).select(
        "id", "type", "timestamp", "version", "tx_id", F.get_json_object("payload", "$.table_name").alias("table_name"), F.get_json_object("payload", "$.row_id").cast("long").alias("row_id"),
        F.when(F.col("type") != DELETED, _values(*_DATA[:2])).alias("data"), F.when(F.col("type") == DELETED, _values(_DATA[2])).otherwise(_values(_OLD)).alias("old"), definition.alias("definition"), "checksum", "sound",
    )
    events = _once(events).withColumn("checksum", F.when(F.col("sound"), checksum()).otherwise(F.col("checksum")))
    return _once(events.select(SCHEMA.names)), quarantine


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """The events of a newline-delimited JSON log, all of them or an error."""
    events, quarantine = read_lines(spark, path)
    bad = quarantine.agg(F.count("*").alias("n"), F.min_by("message", F.struct("file", "block", "place")).alias("message")).first()
    if bad.n:
        raise CorruptLog(f"{bad.n} lines can't be read; the first: {bad.message}")
    return events


def write_lines(events: DataFrame, path: str) -> None:
    """The log as newline-delimited JSON. A sound event's line gets the checksum of the line, any other its own."""
    kind = F.col("type")

    def values(name: str) -> Column:
        return F.transform_values(name, lambda _, v: F.try_parse_json(v))

    row = [F.when(kind != UPDATED, values("data")).alias("data"), F.when(kind == UPDATED, values("data")).alias("changes"), F.when(kind == DELETED, values("old")).alias("deleted_data"), F.when(kind != DELETED, values("old")).alias("old_values")]
    plain = F.to_json(F.struct("table_name", "row_id", *row, F.try_parse_json("definition").alias("columns")))
    payload = F.try_parse_json(F.when(kind == EVOLVED, F.coalesce("definition", F.lit("{}"))).otherwise(plain))
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    body = F.to_json(F.struct("id", "type", stamp, "version", "tx_id", payload.alias("payload")))
    head = F.concat(body.substr(F.lit(1), F.length(body) - 1), F.lit(',"checksum":"'))
    mark = F.when(F.col("checksum").eqNullSafe(checksum()), F.sha2(F.concat(head, F.lit('"}')), 256)).otherwise(F.coalesce("checksum", F.lit("")))
    events.select(F.concat(head, mark, F.lit('"}')).alias("value")).write.text(path)
