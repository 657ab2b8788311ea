"""The engine: tables derived from an event log, changed by appending events."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import asdict
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidelog.functions.values import TYPES, Literal, render, to_json, type_matches
from tidelog.operators import evolution, integrity, relational, replay, snapshots
from tidelog.plans import statements
from tidelog.plans.statements import ColumnDef
from tidelog.sources import log as logs


class ConstraintError(ValueError):
    pass


class Engine:
    """One database in a folder. One writer; any number of readers.

    Every read is a DataFrame over the derived state; every change validates its whole statement before it
    appends one atomic batch. ``strict`` also checks uniqueness when rows are updated.
    """

    def __init__(self, spark: SparkSession, path: str, snapshot_interval: int = 1000, snapshots_enabled: bool = True, strict: bool = True):
        self.spark, self.path, self.strict = spark, path.rstrip("/"), strict
        self.log = logs.EventLog(spark, f"{self.path}/log")
        self.snapshots = snapshots.SnapshotStore(spark, f"{self.path}/snapshots")
        self.snapshot_interval, self.snapshots_enabled = snapshot_interval, snapshots_enabled
        self.registry = evolution.Registry()
        self.last_result: dict[str, Any] | None = None
        self._reload()

    def _reload(self) -> None:
        """The catalog and counters from the log, which is the only truth."""
        found = self.log.read()
        self._last = found.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        self._next = {r.table_name: r.next_row_id for r in replay.next_row_ids(found).collect()}  # one row a table
        self._tables: dict[str, list[ColumnDef]] = {}
        self.version = 1
        for e in found.where(F.col("type").isin(logs.CREATED, logs.EVOLVED)).orderBy("id").collect():  # schema events only
            columns = evolution.columns_of(e.definition)
            self.version += e.type == logs.EVOLVED
            self._tables[e.table_name] = [ColumnDef(**c) for c in columns]
            self.registry.register(e.table_name, self.version if e.type == logs.EVOLVED else e.version, columns)

    # tables

    def create_table(self, name: str, columns: list[ColumnDef]) -> None:
        if name in self._tables:
            raise ConstraintError(f"table '{name}' already exists")
        if sum(c.primary_key for c in columns) > 1:
            raise ConstraintError("a table has one primary key at most")
        definition = [asdict(c) for c in columns]
        self._append(logs.events_frame(self.spark, [logs.event(logs.CREATED, name, self.version, definition=definition, tx_id=f"tx_{self._last}")], self._last + 1), 1)
        self._tables[name] = columns
        self.registry.register(name, self.version, definition)

    def tables(self) -> list[str]:
        return sorted(self._tables)

    def get_table(self, name: str) -> list[ColumnDef]:
        if name not in self._tables:
            raise LookupError(f"table '{name}' does not exist")
        return self._tables[name]

    def table(self, name: str, event_id: int | None = None, timestamp: str | None = None, with_ids: bool = False) -> DataFrame:
        """The visible rows as typed columns, now or at an event or time."""
        columns = self.get_table(name)
        fields = [replay.field(c.name, TYPES[c.type].simpleString() if c.type in TYPES else "string") for c in columns]
        own = replay.up_to(self.log.read(), event_id, timestamp).where(F.col("table_name") == name)
        base = self.snapshots.newest_before(event_id) if timestamp is None else None
        if base is not None:
            try:
                snapshot, at = self.snapshots.restore(base, verify="once")
                own = replay.with_tail(snapshot.where(F.col("table_name") == name), at, own)
            except snapshots.CorruptSnapshot:
                pass  # the log has everything
        return replay.state(own, fields).select(*(["row_id"] if with_ids else []), *(f"`{c.name}`" for c in columns))

    def row(self, name: str, row_id: int) -> Row | None:
        return next(iter(self.table(name, with_ids=True).where(F.col("row_id") == row_id).limit(1).collect()), None)

    def view(self, name: str) -> None:
        """Make the table known to Spark SQL by its name."""
        self.table(name).createOrReplaceTempView(name)

    # reading

    def select(self, table: str, where: statements.Equality | None = None) -> DataFrame:
        df = self.table(table)
        return relational.filter_equal(df, where.column, where.value) if where else df

    def join(self, left: str, right: str, on: tuple[str, str], where: statements.Equality | None = None, compat: bool = False) -> DataFrame:
        out = relational.join_equal(self.table(left), left, on[0], self.table(right), right, on[1], compat)
        return relational.filter_equal(out, where.column, where.value) if where else out

    # changing

    def _append(self, events: DataFrame, n: int) -> None:
        self.log.append(events)
        self._last += n

    def _check_row(self, table: str, row: dict[str, Any]) -> None:
        columns = self.get_table(table)
        for c in columns:
            if c.name not in row:
                raise ConstraintError(f"missing column '{c.name}'")
            if not type_matches(c.type, row[c.name]):
                raise ConstraintError(f"column '{c.name}' expects {c.type}")
            to_json(row[c.name])
        if len(row) > len(columns):
            raise ConstraintError("row has extra columns")

    def _keys(self, table: str) -> list[ColumnDef]:
        return [c for c in self.get_table(table) if c.primary_key or c.unique]

    @staticmethod
    def _violation(column: ColumnDef, value: Any) -> ConstraintError:
        if column.primary_key:
            return ConstraintError(f"primary key violation: duplicate value '{render(value)}'")
        return ConstraintError(f"unique constraint violation on column '{column.name}'")

    def insert(self, table: str, row: dict[str, Any]) -> int:
        return self.insert_many(table, [row])[0]

    def insert_many(self, table: str, rows: list[dict[str, Any]]) -> list[int]:
        """Insert rows given on the driver, all or none; their row ids."""
        for row in rows:
            self._check_row(table, row)
        state = self.table(table) if rows else None
        for c in self._keys(table) if rows else ():
            counts = Counter(render(r[c.name]) for r in rows)
            double = next((r[c.name] for r in rows if counts[render(r[c.name])] > 1), None)
            if double is not None:
                raise self._violation(c, double)
            kind = TYPES.get(c.type, StringType())
            values = [(r[c.name] if isinstance(kind, type(TYPES["BOOL"])) else float(r[c.name]) if c.type in TYPES and not isinstance(kind, StringType) else render(r[c.name]),) for r in rows]
            new = self.spark.createDataFrame(values, f"`{c.name}` {kind.simpleString()}")
            found = state.select(f"`{c.name}`").join(F.broadcast(new), c.name, "left_semi").limit(1).collect()  # the rows are the driver's own
            if found:
                raise self._violation(c, found[0][0])
        first = self._next.get(table, 0)
        ids = list(range(first, first + len(rows)))
        tx = f"tx_{self._last}"
        self._append(logs.events_frame(self.spark, [logs.event(logs.INSERTED, table, self.version, i, r, tx_id=tx) for i, r in zip(ids, rows, strict=True)], self._last + 1), len(rows))
        self._next[table] = first + len(rows)
        self._after_insert(len(rows))
        return ids

    def insert_frame(self, table: str, rows: DataFrame) -> int:
        """Insert a whole DataFrame as one batch; how many rows. Keys are checked by aggregation and a semi-join."""
        columns = self.get_table(table)
        if set(rows.columns) != {c.name for c in columns}:
            raise ConstraintError("row has extra columns" if set(rows.columns) - {c.name for c in columns} else "missing column")
        held = rows.select([F.col(c.name).cast(TYPES[c.type]).alias(c.name) if c.type in TYPES else F.col(c.name) for c in columns])
        state = self.table(table)
        for c in self._keys(table):
            bad = relational.duplicates(held, c.name).select("value").unionByName(held.join(state.select(c.name), c.name, "left_semi").select(F.col(c.name).alias("value"))).limit(1).collect()
            if bad:
                raise self._violation(c, bad[0].value)
        empty = held.agg(*[F.count_if(F.col(c.name).isNull()).alias(c.name) for c in columns if c.type in TYPES]).first().asDict() if any(c.type in TYPES for c in columns) else {}
        for c in columns:
            if empty.get(c.name):
                raise ConstraintError(f"column '{c.name}' expects {c.type}")
        first, keys = self._next.get(table, 0), [c.name for c in self._keys(table)] or held.columns
        numbered, n, scratch = self._numbered(held, keys)
        data = F.map_from_arrays(F.array(*[F.lit(c) for c in held.columns]), F.array(*[self._json_text(c) for c in columns]))
        events = numbered.select(
            (F.col("__n") + self._last + 1).cast("long").alias("id"), F.lit(logs.INSERTED).alias("type"), F.current_timestamp().cast("timestamp_ntz").alias("timestamp"), F.lit(self.version).alias("version"), F.lit(f"tx_{self._last}").alias("tx_id"),
            F.lit(table).alias("table_name"), (F.col("__n") + first).cast("long").alias("row_id"), data.alias("data"), F.lit(None).cast("map<string,string>").alias("old"), F.lit(None).cast("string").alias("definition"), F.lit(None).cast("string").alias("checksum"),
        )
        self._append(logs.with_checksum(events), n)
        self._drop(scratch)
        self._next[table] = first + n
        self._after_insert(n)
        return n

    @staticmethod
    def _json_text(c: ColumnDef) -> Any:
        if c.type in TYPES and TYPES[c.type].simpleString() != "string":
            return F.coalesce(F.col(c.name).cast("string"), F.lit("null"))
        text = F.to_json(F.struct(F.col(c.name).cast("string").alias("x")))
        return F.coalesce(F.when(F.col(c.name).isNull(), F.lit("null")).otherwise(F.substring(text, 6, 1 << 30)).substr(F.lit(1), F.length(text) - 6), F.lit("null"))

    def _after_insert(self, n: int) -> None:
        interval = self.snapshot_interval
        if self.snapshots_enabled and interval and self._last // interval > (self._last - n) // interval:
            self.create_snapshot()

    def _matching(self, table: str, where: statements.Equality) -> DataFrame:
        return relational.filter_equal(self.table(table, with_ids=True), where.column, where.value)

    def _drop(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _numbered(self, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int, str]:
        """``rows`` with contiguous numbers ``__n`` from 0, in the order of ``keys``; how many; and the folder that holds them.

        Rows are sorted over partitions and staged, and each partition goes on where the one before ended.
        """
        path = f"{self.path}/staging-{uuid4().hex}"
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__p", F.spark_partition_id()).write.parquet(path)
        parts = self.spark.read.parquet(path)
        counts = {r["__p"]: r["n"] for r in parts.groupBy("__p").agg(F.count("*").alias("n")).collect()}  # one row a partition
        before, total = [], 0
        for p in sorted(counts):
            before.append((p, total))
            total += counts[p]
        starts = F.broadcast(self.spark.createDataFrame(before, "__p int, __start long"))
        place = F.row_number().over(Window.partitionBy("__p").orderBy(*keys))
        return parts.join(starts, "__p").withColumn("__n", F.col("__start") + place - 1), total, path

    def _change(self, table: str, kind: str, hit: DataFrame, data: Any, old: Any) -> int:
        """One event for each row that is hit, in the order of row ids."""
        numbered, n, scratch = self._numbered(hit, ["row_id"])
        events = numbered.select((F.col("__n") + self._last + 1).cast("long").alias("id"), F.lit(kind).alias("type"), F.current_timestamp().cast("timestamp_ntz").alias("timestamp"), F.lit(self.version).alias("version"), F.lit(f"tx_{self._last}").alias("tx_id"), F.lit(table).alias("table_name"), "row_id", data.cast("map<string,string>").alias("data"), old.cast("map<string,string>").alias("old"), F.lit(None).cast("string").alias("definition"), F.lit(None).cast("string").alias("checksum"))
        if n:
            self._append(logs.with_checksum(events), n)
        self._drop(scratch)
        return n

    def update(self, table: str, column: str, value: Literal, where: statements.Equality) -> int:
        """Set one column in all rows that match; how many."""
        declared = {c.name: c for c in self.get_table(table)}
        if column not in declared:
            raise ConstraintError("row has extra columns")
        c = declared[column]
        if not type_matches(c.type, value):
            raise ConstraintError(f"column '{column}' expects {c.type}")
        hit = self._matching(table, where)
        if self.strict and (c.primary_key or c.unique):
            n = hit.count()
            others = relational.filter_equal(self.table(table, with_ids=True), column, value).join(hit.select("row_id"), "row_id", "left_anti")
            if n > 1 or (n and not others.isEmpty()):
                raise self._violation(c, value)
        return self._change(table, logs.UPDATED, hit, F.create_map(F.lit(column), F.lit(to_json(value))), F.create_map(F.lit(column), self._json_text(c)))

    def delete(self, table: str, where: statements.Equality) -> int:
        columns = self.get_table(table)
        image = F.map_from_arrays(F.array(*[F.lit(c.name) for c in columns]), F.array(*[self._json_text(c) for c in columns]))
        return self._change(table, logs.DELETED, self._matching(table, where), F.lit(None), image)

    # statements

    def sql(self, text: str, compat: bool = False) -> DataFrame | str:
        """Run one statement: a DataFrame for SELECT and JOIN, a message for the others."""
        s = statements.parse(text, compat)
        if s.kind == "SELECT":
            return self.select(s.table, s.where)
        if s.kind == "JOIN":
            return self.join(s.table, s.join_table, s.join_on, s.where, compat)
        if s.kind == "CREATE_TABLE":
            self.create_table(s.table, s.columns)
            return f"Table '{s.table}' created"
        if s.kind == "INSERT":
            columns = self.get_table(s.table)
            if len(s.values) != len(columns):
                raise ConstraintError("value count mismatch")
            return f"Inserted row with ID {self.insert(s.table, {c.name: v for c, v in zip(columns, s.values, strict=True)})}"
        if s.kind == "UPDATE":
            return f"Updated {self.update(s.table, s.assignment.column, s.assignment.value, s.where)} row(s)"
        return f"Deleted {self.delete(s.table, s.where)} row(s)"

    def execute(self, text: str, compat: bool = False) -> str:
        """``sql`` as text, one line a row."""
        out = self.sql(text, compat)
        return out if isinstance(out, str) else format_rows(out)

    # history

    def state(self, event_id: int | None = None) -> DataFrame:
        return snapshots.current_state(self.log.read(), self.snapshots, event_id)

    def create_snapshot(self) -> str:
        """Of the state after the last event, so that a snapshot with its tail equals the whole log."""
        return self.snapshots.create(self.state(), self._last)

    def evolve(self, table: str, columns: list[ColumnDef], operations: list | None = None) -> int:
        """Give a table another schema; the new version. ``operations`` migrate rows of the version before."""
        old = self.registry.latest(table)
        self.get_table(table)
        definition = [asdict(c) for c in columns]
        payload = evolution.payload(table, [asdict(c) for c in self._tables[table]], definition, operations or [])
        self._append(logs.events_frame(self.spark, [logs.event(logs.EVOLVED, table, self.version, definition=payload, tx_id=f"tx_{self._last}")], self._last + 1), 1)
        self.version += 1
        self.registry.register(table, self.version, definition)
        for v in range(old, self.version):
            self.registry.register_migration(table, v, v + 1, (operations or []) if v == self.version - 1 else [])
        self._tables[table] = columns
        return self.version

    def replay(self, targets: dict[str, int] | None = None, on_error: str = "keep", recover: bool = False) -> DataFrame:
        """State from the log alone, rows migrated to ``targets``; ``recover`` skips corrupt events, else they raise."""
        found = self.log.read()
        r = integrity.report(found).first()
        if r.corrupted and not (recover and r.can_partial):
            raise ConstraintError(f"{r.corrupted} of {r.total} events are corrupt")
        usable = integrity.valid(found) if r.corrupted else found
        targets = targets or {}
        seen = {x.table_name: sorted(x.v) for x in found.groupBy("table_name").agg(F.collect_set("version").alias("v")).collect()} if targets else {}  # versions a table
        self.last_result = {"processed": r.total - r.corrupted, "report": r}
        return replay.state_maps(evolution.migrated(usable, self.registry, targets, seen, on_error))

    def report(self) -> Row:
        return integrity.report(self.log.read()).first()

    def status(self) -> str:
        return integrity.status(self.log.read())


def format_rows(df: DataFrame) -> str:
    """Every row as ``map[column:value ...]`` with columns by name, read one partition after the other."""
    lines = ["map[" + " ".join(f"{k}:{render(v)}" for k, v in sorted(r.asDict().items())) + "]" for r in df.toLocalIterator()]
    return "\n".join(lines) or "No rows returned"
