"""Token ids as files of byte-aligned variable-length codes with separate control bytes.

Every file ranks its ids by frequency over all of its documents and writes ranks, so that the 256
commonest ids take one byte. Two control bits an id (four ids a control byte) give its length; they
stand apart from the data bytes, so a file is decoded by a table lookup of control bytes and one
gather, without a branch for an id. A file names its documents in ascending doc_id order and where
they start among the ids of its range of documents; it can be decoded alone.

Files are rows (part, seq, payload) of a Parquet table in the shared folder: Spark's committed writer
makes them appear whole or not at all. A task holds the ids of one file.

Defined cases: a null or empty text is the end id alone; rows that repeat an id are kept side by
side; null ids come first and stay null (the least 64-bit id stands for them in a file, so it can't be
told from them); an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, packing

#: Ids after which a task begins another file.
FILE_IDS = 4_000_000
MAGIC = b"TLV1"
#: What stands for a null id in a file.
NO_ID = -(1 << 63)
_HEAD = struct.Struct("<4sIQIQQ")  # magic, documents, ids, table, start in the part, data bytes
#: The four code lengths that a control byte stands for.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    lens = (1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    codes = np.zeros(-len(ranks) % 4 + len(ranks), np.uint8)
    codes[: len(ranks)] = lens - 1
    four = codes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    at = np.cumsum(lens, dtype=np.int64) - lens
    data = np.zeros(int(lens.sum(dtype=np.int64)), np.uint8)
    data[at] = ranks & np.uint32(0xFF)
    for k in range(1, 4):
        has = np.flatnonzero(lens > k)
        data[at[has] + k] = (ranks[has] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The values again: lengths by table lookup, then bytes by gathering."""
    lens = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(lens, dtype=np.int64) - lens
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(lens > k)
        out[has] |= data[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_file(doc_ids: list[int], ids: list[np.ndarray], start: int) -> bytes:
    """One file of these documents; ``start``: ids before them in their part."""
    flat = np.concatenate(ids).astype(np.uint32)
    counts = np.bincount(flat)
    used = np.flatnonzero(counts)
    by_rank = used[np.lexsort((used, -counts[used]))].astype("<u4")
    rank = np.zeros(len(counts), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    control, data = encode_ranks(rank[flat])
    head = _HEAD.pack(MAGIC, len(ids), len(flat), len(by_rank), start, len(data))
    return b"".join([head, by_rank.tobytes(), np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes(), np.array(list(map(len, ids)), "<u4").tobytes(), control, data])


def read_file(payload: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Start in the part, doc ids, lengths and all ids of a file."""
    magic, n_docs, n, n_table, start, n_data = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = _HEAD.size
    parts = []
    for kind, count in (("<u4", n_table), ("<i8", n_docs), ("<u4", n_docs), ("u1", -(-n // 4)), ("u1", n_data)):
        parts.append(np.frombuffer(payload, kind, count, at))
        at += parts[-1].nbytes
    by_rank, doc_ids, lengths, control, data = parts
    return start, doc_ids, lengths, by_rank[decode_ranks(control, data, n)]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = packing.END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode all documents into files; the table of files (part, seq, n_ids, payload)."""
    spark = docs.sparkSession

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start, held, doc_ids, ids = TaskContext.get().partitionId(), 0, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([held], pa.int64()), "payload": [write_file(doc_ids, ids, start)]})

        for doc, x in packing.encoded(batches, tokenizer_path, end_id):
            doc_ids.append(doc)
            ids.append(x)
            held += len(x)
            if held >= file_ids:
                yield flush()
                seq, start, held, doc_ids, ids = seq + 1, start + held, 0, [], []
        if ids:
            yield flush()

    ordered = common.texts(docs).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    return common.staged(ordered.mapInArrow(run, "part int, seq int, n_ids long, payload binary"), "token-files", compression="none")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start among all ids, n_tokens, ids_crc32."""
    spark = files.sparkSession
    per_part = dict(files.groupBy("part").agg(F.sum("n_ids")).collect())  # a number for each part
    base = np.zeros(max(per_part, default=-1) + 2, np.int64)
    for k, n in per_part.items():
        base[k + 1] = n
    base = np.cumsum(base)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # of 64 MB at most, or one file
            for part, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                start, doc_ids, lengths, ids = read_file(payload.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, mask=doc_ids == NO_ID), "start": base[part] + start + ends - lengths, "n_tokens": lengths.astype(np.int64), "ids_crc32": pa.array(crcs, pa.int64())})

    return files.select("part", "payload").mapInArrow(run, SCHEMA)


def token_file_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return read_token_files(write_token_files(docs, tokenizer_path))
