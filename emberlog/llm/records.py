"""Token ids as length-delimited binary records, with an offset index beside them.

A record is a frame: length (unsigned 64-bit), masked checksum of the length,
payload, masked checksum of the payload, and one newline byte, all integers
little-endian. The payload is one byte of flags, the document id (signed
64-bit) and its ids. The frames are written by Spark's own text writer, whose
committer survives lost executors on any file system that Spark can write;
it closes each frame with the newline. Checksums are CRC-32, masked as in
other record formats: rotated by 15 bits plus a constant.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.llm.common import fresh_path, stored, table, tasks
from emberlog.llm.textops import by_slice
from emberlog.llm.tokens import Encoder

#: Blocks of one file, each of the records of about 1 MB of text or of one longer text. Files are read whole, so their size is bounded by bytes.
FILE_BLOCKS = 64
#: Writing tasks whose files' sizes are summed up in order by one task.
BLOCK_TASKS = 256
VOCABULARY, END_ID = "word_bpe_49k.json", 1
#: The folder of the index beside the records.
INDEX = "_index"
_INDEX_SCHEMA = "file string, at long, size long, doc_id long, start long, n_tokens long, ids_crc32 long"
_HEAD = struct.Struct("<QI")
_BODY = struct.Struct("<Bq")
_WIDE, _NO_ID = 1, 2


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """Ids below 65,536 take two bytes each, if none is larger."""
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    flags = _WIDE * wide + _NO_ID * (doc_id is None)
    payload = _BODY.pack(flags, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def frames(content: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """Offset, length with everything, document id and ids of each record; a wrong checksum is an error."""
    at = 0
    while at < len(content):
        n, check = _HEAD.unpack_from(content, at)
        end = at + _HEAD.size + n
        if masked(content[at : at + 8]) != check or end + 5 > len(content):
            raise ValueError(f"damaged record length at byte {at}")
        payload = content[at + _HEAD.size : end]
        if masked(payload) != struct.unpack_from("<I", content, end)[0]:
            raise ValueError(f"damaged record at byte {at}")
        flags, doc_id = _BODY.unpack_from(payload)
        ids = np.frombuffer(payload, "<u4" if flags & _WIDE else "<u2", offset=_BODY.size).astype("<u4")
        yield at, end + 5 - at, None if flags & _NO_ID else doc_id, ids
        at = end + 5


def record_at(content: bytes, at: int) -> tuple[int | None, np.ndarray]:
    """Document id and ids of the record at an offset."""
    end = at + _HEAD.size + _HEAD.unpack_from(content, at)[0] + 5
    _, _, doc_id, ids = next(frames(content[at:end]))
    return doc_id, ids


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, file_blocks: int = FILE_BLOCKS) -> None:
    """Writes docs (doc_id, an integer, and text) in ascending doc_id order: null ids first, equal ids by text, null texts as empty ones.

    Repeated rows are records each; a text is encoded as a whole, however
    long; no rows make no records; other columns are ignored, whatever their names.
    """

    def encode(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        found = Encoder.of(tokenizer, spaces=False).encode(texts)
        end = np.array([end_id], "<u4")
        out = [frame(d, np.concatenate([x, end])) for d, x in zip(part.column(0).to_pylist(), found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([b"\n".join(out)], pa.binary())], names=["block"])

    ordered = (
        docs.select("doc_id", F.col("text").cast("binary").alias("text"))
        .repartitionByRange(tasks(docs), F.asc_nulls_first("doc_id"))
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    )
    (
        ordered.mapInArrow(by_slice(encode), "block binary").select(F.col("block").cast("string").alias("value"))
        .write.option("lineSep", "\n").option("maxRecordsPerFile", file_blocks).text(path)
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file (its name; files follow one another in this order), content."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
        .select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), "content")
    )


def file_place(file: Column) -> tuple[Column, Column]:
    """The writing task and its file's number; the name's middle is random and may look like either."""
    return F.regexp_extract(file, r"^part-(\d+)", 1).cast("long"), F.regexp_extract(file, r"-c(\d+)\.\w+$", 1).cast("long")


def write_index(spark: SparkSession, path: str) -> DataFrame:
    """Writes the index of the records under path into its folder _index, where readers of the records don't look, and reads it back."""
    build_index(spark, path).write.mode("overwrite").parquet(f"{path}/{INDEX}")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored index: file, at, size, doc_id, start, n_tokens, ids_crc32."""
    return spark.read.schema(_INDEX_SCHEMA).parquet(f"{path}/{INDEX}")


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """Reads all record files under path, checks every record and returns file, at (offset), size (bytes), doc_id, start (ids of all records before it), n_tokens, ids_crc32."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                before, rows = 0, []
                for at, size, doc_id, ids in frames(content.as_py()):
                    rows.append((file, at, size, doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
                    before += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.string() if k == 0 else pa.int64()) for k, x in enumerate(zip(*rows, strict=True))],
                        names=["file", "at", "size", "doc_id", "before", "n_tokens", "ids_crc32"],
                    )

    schema = "file string, at long, size long, doc_id long, before long, n_tokens long, ids_crc32 long"
    index = stored(_files(spark, path).mapInArrow(scan, schema), "record-index")
    # One row for each file; sums run within blocks of writing tasks, and over the blocks.
    part, chunk = file_place(F.col("file"))
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(part / BLOCK_TASKS))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = files.groupBy("block").agg(F.sum("n").alias("n")).select("block", before(W.orderBy("block")).alias("base"))
    totals = (
        files.withColumn("inside", before(W.partitionBy("block").orderBy(part, chunk))).join(blocks, "block")
        .select("file", (F.col("base") + F.col("inside")).alias("base"))
    )
    return index.join(totals, "file").select(
        "file", "at", "size", "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_records(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """doc_id and ids (array of long) of the records named by index rows (file, at), in any order: shuffled or partial reads. Of other files nothing is shuffled."""
    wanted = index.select("file", "at")
    files = _files(spark, path).join(wanted.select("file").distinct(), "file", "left_semi")

    def decode(key, left: pa.Table, right: pa.Table) -> pa.Table:
        docs, ids = [], []
        for content in right.column("content"):
            raw = content.as_py()
            for at in left.column("at").to_pylist():
                d, x = record_at(raw, at)
                docs.append(d)
                ids.append(x.astype(np.int64))
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64()))})

    return (
        wanted.groupBy("file").cogroup(files.groupBy("file"))
        .applyInArrow(decode, "doc_id long, ids array<long>")
    )


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and checksum of every document's ids, read back from the files. See write_records() for odd rows; doc_id is an integer."""
    path = fresh_path(spark, "records")
    write_records(table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    return write_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
