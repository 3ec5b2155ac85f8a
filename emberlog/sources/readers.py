"""Raw log files and pushed batches as lines."""

from __future__ import annotations

import codecs
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted extensions and sizes.
EXTENSIONS = [".log", ".txt", ".json", ".csv", ".zip", ".gz"]
MAX_BYTES, MAX_LINES = 500 * 1024 * 1024, 100_000


def accepted(files: DataFrame) -> DataFrame:
    """files (path, length) with valid and reason: known extension, size within the limit."""
    known = F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + ")$")
    reason = F.when(~known, "extension").when(F.col("length") > MAX_BYTES, "size")
    return files.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def magic(content: str = "content") -> Column:
    """gz or zip by signature, else null."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.startswith("1F8B"), "gz").when(head == "504B0304", "zip")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, value: lines of plain or gzip files (by suffix), read and split by Spark."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def row_as_line(*columns: str | Column) -> Column:
    """What a row of a CSV file becomes: one JSON object of texts."""
    return F.to_json(F.struct(*columns))


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object for each row of CSV files with a header."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(row_as_line(*rows.columns).alias("value"))


#: Bytes of text that are decompressed at a time.
_CHUNK = 1 << 20


def _inflated(data: bytes, method: str) -> Iterator[bytes]:
    """What gzip (any number of members), raw deflate or stored bytes hold, in pieces; damaged data raise an error."""
    if method == "stored":
        yield from (data[k : k + _CHUNK] for k in range(0, len(data), _CHUNK))
        return
    rest = data
    while rest:
        d = zlib.decompressobj(31 if method == "gzip" else -15)
        while not d.eof:
            piece = d.decompress(rest, _CHUNK)
            rest = d.unconsumed_tail if not d.eof else d.unused_data
            if not piece and not d.eof:
                raise zlib.error("the data end early")
            yield piece
        if method != "gzip":
            return
        rest = rest.lstrip(b"\0")


def _whole(data: bytes, method: str, crc: int | None = None) -> bool:
    """Whether the data can be decompressed to their end, and have the checksum, if one is known."""
    try:
        found = 0
        for piece in _inflated(data, method):
            found = zlib.crc32(piece, found)
        return crc is None or found == crc
    except zlib.error:
        return False


def _split(pieces: Iterator[bytes]) -> Iterator[list[str]]:
    """Lines of the text in pieces, as UTF-8 with odd bytes replaced, a list for each piece."""
    decode, rest = codecs.getincrementaldecoder("utf-8")("replace"), ""
    for piece in pieces:
        lines = (rest + decode.decode(piece)).splitlines(keepends=True)
        # the last line may go on, and so may a line end of two characters
        rest = lines.pop() if lines else ""
        if rest.endswith("\n"):
            lines, rest = [*lines, rest], ""
        yield [x.rstrip("\r\n") if x.endswith(("\n", "\r")) else x[:-1] for x in lines]
    yield (rest + decode.decode(b"", True)).splitlines()


def members(files: DataFrame) -> DataFrame:
    """file, member, nth, method, data: what is compressed in files (path, content), a row each and not decompressed yet.

    The signature decides: a zip archive has a row for each entry of its
    central directory (folders aside), gzip one, and any other content one of
    stored bytes. Damaged gzip and zip files are stored bytes too, whatever their names.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, rows = content.as_py() or b"", []
                if data[:2] == b"\x1f\x8b" and _whole(data, "gzip"):
                    rows = [(None, "gzip", data)]
                elif data[:4] == b"PK\x03\x04":
                    rows = _entries(data)
                for n, (name, method, part) in enumerate(rows or [(None, "stored", data)]):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([name], pa.string()), pa.array([n], pa.int32()), pa.array([method]), pa.array([part], pa.binary())], names=["file", "member", "nth", "method", "data"])

    return files.select("path", "content").mapInArrow(unpack, "file string, member string, nth int, method string, data binary")


def _entries(data: bytes) -> list[tuple[str, str, bytes]]:
    """Name, method and compressed bytes of the entries of a zip archive; none if it is damaged anywhere."""
    out = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for x in archive.infolist():
                if x.is_dir():
                    continue
                # behind the local header: 30 bytes, the name and extra fields, whose lengths it has
                at = x.header_offset + 30 + sum(struct.unpack_from("<HH", data, x.header_offset + 26))
                part = data[at : at + x.compress_size]
                method = {zipfile.ZIP_STORED: "stored", zipfile.ZIP_DEFLATED: "deflate"}.get(x.compress_type)
                if method is None or x.flag_bits & 1 or not _whole(part, method, x.CRC):
                    return []
                out.append((x.filename, method, part))
    except (zipfile.BadZipFile, struct.error, OSError, NotImplementedError):
        return []
    return out


def lines_of(files: DataFrame) -> DataFrame:
    """file, member, pos, value: the lines of files (path, content) of any kind, archives unpacked; pos grows with the place of a line in its file.

    Members are dealt to tasks of their own and decompressed a piece at a
    time, so an archive's text is never whole in one task; its compressed bytes are, which accepted() bounds.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, name, nth, method, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = nth << 40
                for lines in _split(_inflated(data, method)):
                    texts = [pa.array([x] * len(lines), pa.string()) for x in (file, name)]
                    yield pa.RecordBatch.from_arrays([*texts, pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["file", "member", "pos", "value"])
                    at += len(lines)

    # a number of its own, as adaptive execution would put members together by their compressed bytes
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    return members(files).repartition(tasks, "file", "nth").mapInArrow(read, "file string, member string, pos long, value string")


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, member, pos, value: lines of the files under path, gzip, zip or plain by their signatures."""
    return lines_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, value: the lines of all members of zip archives, which Spark has no codec for."""
    return archive_lines(spark, path).select("file", "value")


def pushed_lines(batches: DataFrame, column: str = "value") -> DataFrame:
    """service, pos, value of pushed JSON batches {service, lines[]}; batches without lines or with more than the limit are refused."""
    parsed = batches.select(F.from_json(column, "service string, lines array<string>").alias("b"))
    sized = parsed.where((F.size("b.lines") > 0) & (F.size("b.lines") <= MAX_LINES))
    return sized.select(F.col("b.service").alias("service"), F.posexplode("b.lines").alias("pos", "value"))
