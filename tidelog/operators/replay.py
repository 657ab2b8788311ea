"""Table state as a fold over events, expressed as keyed last-writer-wins aggregations.

A row is visible if it was ever inserted or updated and no deletion is later than its last insertion.
A column's value is its latest one since the last insertion, which replaces the whole row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.sources.log import DELETED, INSERTED, UPDATED

KEY = ("table_name", "row_id")
BOUNDS = ("__inserted", "__deleted", "__put")


@dataclass(frozen=True)
class Field:
    """A column of the replayed table, read from the events' maps of JSON texts as a Spark type."""

    name: str
    kind: str = "string"

    @property
    def value(self) -> Column:
        """Its value in an event."""
        raw = F.col("data")[self.name]
        return F.get_json_object(F.concat(F.lit('{"x":'), raw, F.lit("}")), "$.x") if self.kind == "string" else raw.try_cast(self.kind)

    @property
    def present(self) -> Column:
        """Whether an event has it, be it null."""
        return F.coalesce(F.map_contains_key("data", F.lit(self.name)), F.lit(False))


def field(name: str, kind: str = "string") -> Field:
    return Field(name, kind)


def up_to(log: DataFrame, event_id: int | None = None, timestamp: str | None = None) -> DataFrame:
    """Time travel: the events up to an id (0 and none mean all) or up to a time, both inclusive."""
    if event_id:
        log = log.where(F.col("id") <= event_id)
    if timestamp is not None:
        log = log.where(F.col("timestamp") <= F.lit(timestamp).cast("timestamp_ntz"))
    return log


def _bounds() -> list[Column]:
    def last(*kinds: str) -> Column:
        return F.max(F.when(F.col("type").isin(*kinds), F.col("id")))

    return [last(INSERTED).alias("__inserted"), last(DELETED).alias("__deleted"), last(INSERTED, UPDATED).alias("__put")]


HIDDEN = "__deleted is not null and (__inserted is null or __inserted <= __deleted)"


def state(log: DataFrame, fields: list[Field], include_deleted: bool = False) -> DataFrame:
    """table_name, row_id and the fields of every visible row; with ``include_deleted`` all rows and ``deleted``.

    One aggregation with partial sums and one exchange; a predicate on the key goes below it, fields that
    nobody reads are pruned.
    """
    put = F.col("type").isin(INSERTED, UPDATED)
    latest = [F.max(F.when(put & f.present, F.struct("id", f.value.alias("value")))).alias(f"__{f.name}") for f in fields]
    grouped = log.groupBy(*KEY).agg(*_bounds(), *latest).where("__put is not null or __deleted is not null" if include_deleted else f"__put is not null and not ({HIDDEN})")
    since = F.coalesce("__inserted", F.lit(0))
    values = [F.when(F.col(f"__{f.name}.id") >= since, F.col(f"__{f.name}.value")).alias(f.name) for f in fields]
    return grouped.select(*KEY, *values, *([F.expr(HIDDEN).alias("deleted")] if include_deleted else []))


_PAIR = "struct<key: string, value: string, id: bigint>"


def _gathered(entries: DataFrame) -> DataFrame:
    """Partial states from rows (key of the table's row, bounds, one column's key, id and value)."""
    by_key = entries.groupBy(*KEY, "key").agg(*[F.max(c).alias(c) for c in BOUNDS], F.max(F.when(F.col("key").isNotNull(), F.struct("id", "value"))).alias("latest"))
    pairs = F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", F.col("latest.value").alias("value"), F.col("latest.id").alias("id"))))
    return by_key.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in BOUNDS], pairs.cast(f"array<{_PAIR}>").alias("pairs"))


def partial_state(log: DataFrame) -> DataFrame:
    """Per row its bounds and each column's latest value with its event: states that merge in any order."""
    known = log.where(F.col("type").isin(INSERTED, UPDATED, DELETED))
    ids = [F.when(F.col("type").isin(*kinds), F.col("id")).alias(c) for c, kinds in zip(BOUNDS, ([INSERTED], [DELETED], [INSERTED, UPDATED]), strict=True)]
    return _gathered(known.select(*KEY, "id", *ids, F.explode_outer(F.when(F.col("type") != DELETED, F.col("data"))).alias("key", "value")))


def merged_states(*states: DataFrame) -> DataFrame:
    """One partial state of several. Merging a state twice changes nothing."""
    rows = reduce(DataFrame.unionByName, states)
    return _gathered(rows.select(*KEY, *BOUNDS, F.explode_outer("pairs").alias("p")).select(*KEY, *BOUNDS, "p.key", "p.value", "p.id"))


def finished(partial: DataFrame) -> DataFrame:
    """table_name, row_id, data, deleted, for every row ever put."""
    kept = F.filter("pairs", lambda p: p["id"] >= F.coalesce(F.col("__inserted"), F.lit(0)))
    data = F.map_from_entries(F.transform(kept, lambda p: F.struct(p["key"], p["value"])))
    return partial.where("__put is not null").select(*KEY, data.alias("data"), F.expr(HIDDEN).alias("deleted"))


def state_maps(log: DataFrame) -> DataFrame:
    """table_name, row_id, data (whatever keys the events have), deleted, for every row ever put."""
    return finished(partial_state(log))


def fold(log: DataFrame) -> DataFrame:
    """``state_maps`` as an ordered fold of each row's events; the reading that the aggregations are tested against."""
    events = log.where(F.col("type").isin(INSERTED, UPDATED, DELETED)).groupBy(*KEY).agg(F.collect_list(F.struct("id", "type", F.coalesce("data", F.create_map().cast("map<string,string>")).alias("m"))).alias("events"))
    ordered = F.array_sort("events", lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    start = F.struct(F.create_map().cast("map<string,string>").alias("data"), F.lit(False).alias("deleted"), F.lit(False).alias("put"))

    def merged(old: Column, new: Column) -> Column:
        return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)

    def step(acc: Column, e: Column) -> Column:
        data = F.when(e["type"] == INSERTED, e["m"]).when(e["type"] == UPDATED, merged(acc["data"], e["m"])).otherwise(acc["data"])
        deleted = F.when(e["type"] == INSERTED, F.lit(False)).when(e["type"] == DELETED, F.lit(True)).otherwise(acc["deleted"])
        return F.struct(data.alias("data"), deleted.alias("deleted"), (acc["put"] | (e["type"] != DELETED)).alias("put"))

    return events.select(*KEY, F.aggregate(ordered, start, step).alias("s")).where("s.put").select(*KEY, "s.data", "s.deleted")


def as_events(snapshot: DataFrame, base: int) -> DataFrame:
    """A snapshot's rows (table_name, row_id, data, deleted) as events at its base: an insertion, and a deletion for tombstones."""
    empty = F.create_map().cast("map<string,string>")
    put = snapshot.select(F.lit(base).cast("long").alias("id"), F.lit(INSERTED).alias("type"), *KEY, "data")
    gone = snapshot.where("deleted").select(F.lit(base).cast("long").alias("id"), F.lit(DELETED).alias("type"), *KEY, empty.alias("data"))
    return put.unionByName(gone)


def with_tail(snapshot: DataFrame, base: int, log: DataFrame) -> DataFrame:
    """Events that replay to the same state as the whole log: the snapshot's and those after its base."""
    return as_events(snapshot, base).unionByName(log.where(F.col("id") > base).select("id", "type", *KEY, "data"))


def row_versions(log: DataFrame) -> DataFrame:
    """The latest event of every row."""
    return log.where(F.col("type").isin(INSERTED, UPDATED, DELETED)).groupBy(*KEY).agg(F.max("id").alias("version"))


def next_row_ids(log: DataFrame) -> DataFrame:
    """Per table the next free row id, counting deleted rows."""
    return log.groupBy("table_name").agg(F.coalesce(F.max("row_id") + 1, F.lit(0)).alias("next_row_id"))


def index(rows: DataFrame, column: str) -> DataFrame:
    """value -> sorted row ids."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.array_sort(F.collect_list("row_id")).alias("row_ids"))
