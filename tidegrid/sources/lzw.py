"""Unix compress (.Z) and other compressed text files as DataFrames of lines."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"\x1f\x9d"


def expand(data: bytes) -> bytes:
    """The bytes that Unix ``compress`` packed: variable-width LZW codes, low bits first, in groups of eight codes."""
    if data[:2] != MAGIC or len(data) < 3:
        raise ValueError("not a compress file")
    most, block = data[2] & 0x1F, bool(data[2] & 0x80)
    if not 9 <= most <= 16:
        raise ValueError("unknown code width")
    table: list[bytes] = [bytes([i]) for i in range(256)] + ([b""] if block else [])
    out, before, width, at, buffer, held = bytearray(), b"", 9, 3, 0, 0
    in_group = 0

    def skip_group() -> None:
        nonlocal at, buffer, held, in_group
        # Codes come in groups of eight; a change of width starts a new group.
        if in_group % 8:
            missing = (8 - in_group % 8) * width
            drop = missing - held
            at += max(0, -(-drop // 8)) if drop > 0 else 0
        buffer = held = in_group = 0

    while True:
        while held < width and at < len(data):
            buffer |= data[at] << held
            held += 8
            at += 1
        if held < width:
            return bytes(out)
        code = buffer & ((1 << width) - 1)
        buffer >>= width
        held -= width
        in_group += 1
        if block and code == 256:
            skip_group()
            del table[257:]
            width, before = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise ValueError("broken code")
        out += entry
        if before and len(table) < (1 << most):
            table.append(before + entry[:1])
            if len(table) == (1 << width) and width < most:
                skip_group()
                width += 1
        before = entry


def to_text(name: str, data: bytes) -> str:
    """Text of a file by its ending: .Z, .gz, .asc or .txt; another ending fails."""
    low = name.lower()
    if low.endswith(".z"):
        data = expand(data)
    elif low.endswith(".gz"):
        data = gzip.decompress(data)
    elif not low.endswith((".asc", ".txt")):
        raise ValueError(f"unknown kind of file: {name}")
    return data.decode("utf-8", "replace")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file, through Spark's own reader, so any store works."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.record_batch([pa.array([name]), pa.array([to_text(name, raw)])], names=["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string")
