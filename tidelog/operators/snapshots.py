"""Snapshots of the derived state: a Parquet folder each, and an index of them."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import replay

_STATE = "table_name STRING, row_id LONG, data MAP<STRING, STRING>, deleted BOOLEAN"
_INDEX = "snapshot_id STRING, base_event_id LONG, created_at TIMESTAMP_NTZ, path STRING, state_hash STRING, rows LONG"


class CorruptSnapshot(ValueError):
    pass


def row_hash() -> Column:
    """A row's digest, whatever the order of its keys."""
    entries = F.concat_ws(",", F.array_sort(F.transform(F.map_entries("data"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))))
    return F.sha2(F.concat_ws("|", "table_name", F.col("row_id").cast("string"), F.col("deleted").cast("string"), entries), 256)


def state_hash(state: DataFrame) -> tuple[str, int]:
    """A digest that doesn't depend on the order of rows, and their number: sums of 60-bit parts of row digests, no row gathered."""
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    *sums, n = state.select(row_hash().alias("h")).agg(*parts, F.count("*")).first()
    return "-".join(f"{int(s or 0):x}" for s in sums), n


class SnapshotStore:
    """Snapshots under one folder. One writer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._sound: set[str] = set()

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def history(self) -> DataFrame:
        """The index in the order of creation. A pruning that stopped before its last step is brought to an end."""
        fs, p = self._fs(f"{self.path}/index")
        if not fs.exists(p) and fs.exists(self._fs(f"{self.path}/index.new/_SUCCESS")[1]):
            fs.rename(self._fs(f"{self.path}/index.new")[1], p)
        if not fs.exists(p):
            return self.spark.createDataFrame([], _INDEX)
        return self.spark.read.schema(_INDEX).parquet(f"{self.path}/index").orderBy("base_event_id", "created_at")

    def latest(self):
        """The newest entry, or None."""
        rows = self.history().orderBy(F.desc("base_event_id"), F.desc("created_at")).limit(1).collect()
        return rows[0] if rows else None

    def create(self, state: DataFrame, base_event_id: int) -> str:
        """Write ``state`` (table_name, row_id, data, deleted), as it is after the base event."""
        now = datetime.now(UTC).replace(tzinfo=None)
        name = f"snap_{base_event_id}_{now:%Y%m%d_%H%M%S_%f}"
        path = f"{self.path}/{name}"
        state.select("table_name", "row_id", "data", "deleted").write.partitionBy("table_name").parquet(path)
        digest, n = state_hash(self._read(path))
        self.spark.createDataFrame([(name, base_event_id, now, path, digest, n)], _INDEX).coalesce(1).write.mode("append").parquet(f"{self.path}/index")
        return name

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(_STATE).parquet(path).select("table_name", "row_id", "data", "deleted")

    def restore(self, snapshot_id: str | None = None, verify: bool | str = True) -> tuple[DataFrame, int]:
        """The state and base of a snapshot, of the newest if none is named. With ``verify`` its hash is checked; with
        "once", unless this store has done so before."""
        entry = self.latest() if snapshot_id is None else next(iter(self.history().where(F.col("snapshot_id") == snapshot_id).limit(1).collect()), None)
        if entry is None:
            raise LookupError("no such snapshot" if snapshot_id else "no snapshots")
        state = self._read(entry.path)
        if verify and not (verify == "once" and entry.snapshot_id in self._sound):
            if state_hash(state) != (entry.state_hash, entry.rows):
                raise CorruptSnapshot("snapshot data corruption detected: hash mismatch")
            self._sound.add(entry.snapshot_id)
        return state, entry.base_event_id

    def newest_before(self, event_id: int | None) -> str | None:
        """The newest snapshot whose base is not beyond an event."""
        found = self.history() if not event_id else self.history().where(F.col("base_event_id") <= event_id)
        rows = found.orderBy(F.desc("base_event_id"), F.desc("created_at")).limit(1).collect()
        return rows[0].snapshot_id if rows else None

    def prune(self, keep: int) -> int:
        """Drop all but the newest ``keep``; how many went."""
        entries = self.history().orderBy("base_event_id", "created_at").collect()  # metadata, one row a snapshot
        gone, kept = entries[: max(0, len(entries) - keep)], entries[max(0, len(entries) - keep) :]
        if gone:
            new = f"{self.path}/index.new"
            self.spark.createDataFrame(kept, _INDEX).coalesce(1).write.mode("overwrite").parquet(new)
            fs, old = self._fs(f"{self.path}/index")
            fs.delete(old, True)
            fs.rename(self._fs(new)[1], old)
            for e in gone:
                fs.delete(self._fs(e.path)[1], True)
        return len(gone)


def current_state(log: DataFrame, store: SnapshotStore, event_id: int | None = None) -> DataFrame:
    """State up to an event: the newest usable snapshot with the tail after it, or the whole log."""
    name = store.newest_before(event_id)
    log = replay.up_to(log, event_id)
    if name is not None:
        try:
            snapshot, base = store.restore(name)
            return replay.state_maps(replay.with_tail(snapshot, base, log))
        except CorruptSnapshot:
            pass  # the log has everything
    return replay.state_maps(log)
