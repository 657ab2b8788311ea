"""Incremental ingest: a stream of events maintains the derived state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators import integrity, replay
from tidelog.operators.snapshots import SnapshotStore
from tidelog.sources import log as logs


def events_stream(spark, path: str, max_files: int | None = None) -> DataFrame:
    """New Parquet batches of a log folder, in the order in which they appear."""
    reader = spark.readStream.schema(logs.SCHEMA)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path).select(logs.SCHEMA.names)


def maintain(stream: DataFrame, path: str, checkpoint: str, quarantine: str | None = None, available_now: bool = True, store: SnapshotStore | None = None, every: int = 1000) -> StreamingQuery:
    """Merge each micro-batch into the state kept under ``path``; corrupt events go to ``quarantine``.

    States merge by event id, so neither the order of arrival nor a repeated batch matters: each batch
    writes a folder of its own from the one before it, and folders older than that one go. With a ``store``,
    a batch that passes a multiple of ``every`` event ids leaves a snapshot.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        good = batch
        if quarantine:
            integrity.with_issues(batch).where("issue is not null").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
            good = integrity.valid(batch)
        new, before = replay.partial_state(good), _newest(spark, path, number)
        (new if before is None else replay.merged_states(before, new)).write.mode("overwrite").parquet(f"{path}/batch-{number}")
        if store:
            last = spark.read.parquet(f"{path}/batch-{number}").agg(F.max(F.greatest(*replay.BOUNDS))).first()[0] or 0
            newest = store.latest()
            if last // every > (newest.base_event_id // every if newest else 0):
                store.create(maintained(spark, path), last)
        _drop_before(spark, path, number - 1)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _drop_before(spark: SparkSession, path: str, number: int) -> None:
    """Drop the folders of batches that no batch, not even a repeated one, builds on."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.startswith("batch-") and int(name[6:]) < number:
            fs.delete(f.getPath(), True)


def _newest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The state after the last whole batch, of those before a number if one is given."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    done = [int(n[6:]) for n in names if n.startswith("batch-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    done = [n for n in done if before is None or n < before]
    return spark.read.parquet(f"{path}/batch-{max(done)}") if done else None


def maintained(spark: SparkSession, path: str) -> DataFrame:
    """table_name, row_id, data, deleted as of the last whole batch."""
    state = _newest(spark, path)
    if state is None:
        raise LookupError("no batch was merged yet")
    return replay.finished(state)


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events a type and window, late ones accepted for so long."""
    stamped = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return stamped.withWatermark("timestamp", late).groupBy(F.window("timestamp", width), "type").agg(F.count("*").alias("n"))
