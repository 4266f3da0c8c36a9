"""Framed chunks: messages of any kind in a stream of compressed chunks that can be entered anywhere.

A chunk is a codec byte, seven delimiter bytes, the length of the body as four bytes (big
endian) and the body. A chunk of length 0 ends a stream.
"""

from __future__ import annotations

import bz2
import gzip
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
DELIMITER = b"\xff" * 7
GZIP, BZIP2, PLAIN = 0xFF, 0xFD, 0xFA

#: Codec byte -> (compress, expand); more can be registered.
CODECS: dict[int, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {}


def register(code: int, compress: Callable[[bytes], bytes], expand: Callable[[bytes], bytes]) -> None:
    """Adds a codec; codes are one byte."""
    CODECS[code] = (compress, expand)


register(GZIP, lambda b: gzip.compress(b, mtime=0), gzip.decompress)
register(BZIP2, bz2.compress, bz2.decompress)
register(PLAIN, bytes, bytes)


def framed(bodies: list[bytes], code: int, closed: bool = True) -> bytes:
    """Chunks one behind the other."""
    compress = CODECS[code][0]
    parts = []
    for body in bodies:
        packed = compress(body)
        parts += [bytes([code]), DELIMITER, struct.pack(">I", len(packed)), packed]
    return b"".join([*parts, bytes([GZIP]), DELIMITER, struct.pack(">I", 0)] if closed else parts)


def chunks(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(offset, body) of the chunks that begin in [start, end), wherever ``start`` falls; damaged ones are left out."""
    end = len(data) if end is None else end
    at = max(start, 0)
    while at < min(end, len(data)):
        mark = data.find(DELIMITER, at + 1)
        if mark < 0:
            return
        # eight equal bytes are codec and delimiter
        mark += data[mark : mark + 8] == b"\xff" * 8
        if mark - 1 >= end:
            return
        code, at = data[mark - 1], mark - 1
        if at < start or code not in CODECS or mark + 11 > len(data):
            at = mark
            continue
        size = struct.unpack_from(">I", data, mark + 7)[0]
        body = data[mark + 11 : mark + 11 + size]
        if size and len(body) == size:
            try:
                yield at, CODECS[code][1](body)
                at = mark + 11 + size - 1
                continue
            except (OSError, EOFError, ValueError):
                pass
        at = mark


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, body) of all chunks of files, one task for each file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for at, body in chunks(data.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([body], pa.binary())], names=["file", "offset", "body"])

    return files.mapInArrow(run, "file string, offset bigint, body binary")


def in_chunks(df: DataFrame, body: str, code: int = GZIP) -> DataFrame:
    """(chunk): each row's bytes as one framed chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([framed([x or b""], code, False) for x in batch.column(0).to_pylist()], pa.binary())], names=["chunk"])

    return df.select(F.col(body).cast("binary").alias("b")).mapInArrow(run, "chunk binary")


def expanded(df: DataFrame, chunk: str) -> DataFrame:
    """(body) of each chunk in a binary column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [body for x in batch.column(0).to_pylist() if x for _, body in chunks(x)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], names=["body"])

    return df.select(chunk).mapInArrow(run, "body binary")
