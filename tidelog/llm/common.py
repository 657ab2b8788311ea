"""What the corpus operators share: the shared folder, staged tables, and text columns.

Staged tables cut lineage: they are written by Spark's committed Parquet writer into the folder
that the cluster names in ``spark.checkpoint.dir``, so a lost executor costs only a reread.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is dealt apart from the others if more than one row in so many of a sample has it; the sample takes one row in SAMPLE.
HOT_SHARE, SAMPLE, HOT_LEAST = 2_000, 32, 64
#: Bits of what tells rows apart before they are shipped: 1 MB to broadcast; and of one of its rows.
SLOTS, ROW_OF_SLOTS = 1 << 23, 1 << 15

_own_folder: list[str] = []


class _Scopes(threading.local):
    """The open scopes of a thread, each the paths that it drops; below them the paths that ``release`` drops."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []
        self.kept: list[str] = []


_scopes = _Scopes()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; on a local master without one, a temporary folder of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="tidelog-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def written(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and where; the caller drops it, or ``release`` does."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _scopes.kept.append(path)
    df.write.options(**options).parquet(path)
    spark._jvm.System.gc()  # Spark's cleaner drops the shuffle files of frames that the driver's JVM has collected
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back. Inside ``scratch`` the table goes at its end, unless it is
    to ``keep``; outside it stays for what is read from it, until ``release``."""
    out, path = written(df, name, **options)
    scope = len(_scopes.open) - 1 - keep
    if scope >= 0:
        _scopes.open[scope].append(path)
    return out


def drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in _scopes.kept:
            _scopes.kept.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Staged tables of the block are dropped at its end; what is returned from it must rest on kept ones."""
    _scopes.open.append([])
    try:
        yield
    finally:
        drop(spark, _scopes.open.pop())


def release(spark: SparkSession) -> None:
    """Drop every table that this thread staged and that is still there; frames that rest on them can't be read any more."""
    drop(spark, list(_scopes.kept))


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """At most HOT_SHARE values of ``key`` that many rows hold. They are found on a sample: that decides how rows
    are dealt to tasks, never what comes out."""
    sample = rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(SAMPLE)) == 0)
    least = max(HOT_LEAST, sample.count() // HOT_SHARE)
    found = sample.groupBy(key).count().where(F.col("count") > least).select(key).collect()
    return rows.sparkSession.createDataFrame(found, rows.select(key).schema)


def with_totals(rows: DataFrame, key: str, hot: DataFrame, **totals: Column) -> DataFrame:
    """``rows``, which are staged, with aggregates over the rows of the same ``key``.

    Rows of hot keys stay where they are: their aggregates are made by partial aggregation and broadcast, as there
    are at most HOT_SHARE of them. All other rows take one exchange.
    """
    per_key = Window.partitionBy(key)
    cold = rows.join(F.broadcast(hot), key, "left_anti").withColumns({k: a.over(per_key) for k, a in totals.items()})
    few = rows.join(F.broadcast(hot), key, "left_semi").groupBy(key).agg(*[a.alias(k) for k, a in totals.items()])
    return cold.unionByName(rows.join(F.broadcast(few), key).select(cold.columns))


def split_by(rows: DataFrame, keys: list[str], wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: all that have the ``keys`` of a row of ``wanted``, which is staged, with few others; and the rest.
    Nothing of ``rows`` is shipped for it: a bitmap of the wanted keys' digests is broadcast, of the same size whatever the tables.
    """
    slot = F.pmod(F.xxhash64(*[F.col(k).cast("long") for k in keys]), F.lit(SLOTS))
    row, held = (f"{x}_{uuid.uuid4().hex}" for x in ("row", "bits"))
    bits = wanted.select(slot.alias("s")).groupBy(F.expr(f"s div {ROW_OF_SLOTS}").alias(row)).agg(F.expr(f"bitmap_construct_agg(s % {ROW_OF_SLOTS})").alias(held))
    place = F.pmod(slot, F.lit(ROW_OF_SLOTS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(held), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = (F.floor(slot / ROW_OF_SLOTS) == F.col(row)) & (byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0)
    return rows.join(F.broadcast(bits), hit, "left_semi"), rows.join(F.broadcast(bits), hit, "left_anti")


def parts_of(rows: DataFrame, key: str, weight: Column, least: int) -> DataFrame:
    """``key``, ``parts``: keys of more than ``least`` and 1 / HOT_SHARE of all weight, at most HOT_SHARE of them, and in how many parts to deal each."""
    share = max(least, (rows.agg(F.sum(weight)).first()[0] or 0) // HOT_SHARE)
    return rows.groupBy(key).agg(F.sum(weight).alias("w")).where(F.col("w") > share).select(key, F.ceil(F.col("w") / share).alias("parts"))


#: What this worker process remembers between tasks, by the operator whose it is.
_memories: dict[str, dict] = {}


def memory(owner: str) -> dict:
    """What tasks of one operator remember in this process, until tasks of another begin."""
    return _memories.setdefault(owner, {})


def forget(but: str | None = None) -> None:
    """Drop what other operators' tasks left in this process, and give free pages back: workers outlive the steps of a pipeline."""
    for owner, held in _memories.items():
        if owner != but:
            held.clear()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512, owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what Python objects hold at once is bounded. Spark bounds a batch's bytes itself.
    Of what the process remembers only the ``owner``'s stays."""
    forget(owner)
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null counts as empty) and the named further columns; all else is pruned."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def id_remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``: the fold of a document."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % divisor
