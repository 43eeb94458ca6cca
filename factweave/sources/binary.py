"""ELF files as relations: segments, symbols and initialised words."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of the ELF format.
MAGIC, PT_LOAD, SHT_SYMTAB, SHT_DYNSYM = b"\x7fELF", 1, 2, 11


class Elf(NamedTuple):
    wide: bool
    order: str
    entry: int
    segments: list[tuple[int, bytes, int, int]]  # address, content, memory size, flags
    symbols: list[tuple[str, int, int, int]]  # name, address, size, type


def read_elf(data: bytes) -> Elf | None:
    """The loaded segments and named symbols of an ELF file; None for anything else or a broken one."""
    try:
        if data[:4] != MAGIC:
            return None
        wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
        entry, phoff, shoff = struct.unpack_from(order + ("QQQ" if wide else "III"), data, 24)
        at = 54 if wide else 42
        phsize, phnum, shsize, shnum, _ = struct.unpack_from(order + "HHHHH", data, at)
        segments = []
        for i in range(phnum):
            if wide:
                kind, flags, off, vaddr, _, filesz, memsz, _ = struct.unpack_from(order + "IIQQQQQQ", data, phoff + i * phsize)
            else:
                kind, off, vaddr, _, filesz, memsz, flags, _ = struct.unpack_from(order + "IIIIIIII", data, phoff + i * phsize)
            if kind == PT_LOAD:
                segments.append((vaddr, data[off : off + filesz], memsz, flags))
        sections = []
        for i in range(shnum):
            if wide:
                _, kind, _, _, off, size, link, _, _, each = struct.unpack_from(order + "IIQQQQIIQQ", data, shoff + i * shsize)
            else:
                _, kind, _, _, off, size, link, _, _, each = struct.unpack_from(order + "IIIIIIIIII", data, shoff + i * shsize)
            sections.append((kind, off, size, link, each))
        symbols = []
        for kind, off, size, link, each in sections:
            if kind not in (SHT_SYMTAB, SHT_DYNSYM) or not each:
                continue
            names = sections[link][1]
            for place in range(off, off + size, each):
                if wide:
                    name, info, _, _, value, length = struct.unpack_from(order + "IBBHQQ", data, place)
                else:
                    name, value, length, info, _, _ = struct.unpack_from(order + "IIIBBH", data, place)
                if name:
                    text = data[names + name : data.index(b"\0", names + name)].decode("utf-8", "replace")
                    symbols.append((text, value, length, info & 15))
        return Elf(wide, order, entry, segments, symbols)
    except (struct.error, ValueError, IndexError):
        return None


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _flat(rows, schema: pa.Schema):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                elf = read_elf(content) if content else None
                held = [(path, *r) for r in rows(elf)] if elf else []
                for at in range(0, len(held), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held[at : at + 20_000]), schema)], schema=schema)

    return run


def segments(df: DataFrame) -> DataFrame:
    """(path, start, end, writable, executable) of the loaded segments."""
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("writable", pa.bool_()), ("executable", pa.bool_())])
    rows = lambda e: [(a, a + size, bool(flags & 2), bool(flags & 1)) for a, _, size, flags in e.segments]
    return df.select("path", "content").mapInArrow(_flat(rows, schema), "path string, start bigint, end bigint, writable boolean, executable boolean")


def symbols(df: DataFrame) -> DataFrame:
    """(path, name, address, size, type) of the named symbols."""
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("address", pa.int64()), ("size", pa.int64()), ("type", pa.int32())])
    return df.select("path", "content").mapInArrow(_flat(lambda e: e.symbols, schema), "path string, name string, address bigint, size bigint, type int")


def words(df: DataFrame, stride: int = 4) -> DataFrame:
    """(path, address, value) of the 32-bit words of the initialised bytes, in the file's byte order."""
    schema = pa.schema([("path", pa.string()), ("address", pa.int64()), ("value", pa.int64())])

    def rows(e: Elf):
        for start, content, _, _ in e.segments:
            first = -start % stride
            count = max(0, (len(content) - first - 4) // stride + 1)
            if count:
                at = np.lib.stride_tricks.as_strided(np.frombuffer(content, np.uint8, offset=first), ((count - 1) * stride + 4,), (1,))
                values = np.lib.stride_tricks.sliding_window_view(at, 4)[::stride].copy().view(e.order + "u4").ravel()
                yield from zip((start + first + np.arange(count) * stride).tolist(), values.tolist())

    return df.select("path", "content").mapInArrow(_flat(rows, schema), "path string, address bigint, value bigint")


def identity_symbols(df: DataFrame) -> DataFrame:
    """(path, name, addresses) of each symbol name, addresses without the mode bit, sorted."""
    return symbols(df).groupBy("path", "name").agg(F.array_sort(F.collect_set(F.col("address").bitwiseAND(F.lit(-2).cast("bigint")))).alias("addresses"))


def image(address: int, values: list[int], symbol: str) -> bytes:
    """A little-endian 32-bit ELF file: one executable segment of words at an address, and a symbol for it."""
    body = b"".join(struct.pack("<I", v & 0xFFFFFFFF) for v in values)
    names = b"\0" + symbol.encode() + b"\0"
    table = bytes(16) + struct.pack("<IIIBBH", 1, address, len(body), 18, 0, 1)
    at = 52 + 32
    name_at, table_at = at + len(body), at + len(body) + len(names)
    head = MAGIC + b"\x01\x01\x01" + bytes(9) + struct.pack("<HHIIIIIHHHHHH", 2, 40, 1, address, 52, table_at + len(table), 0, 52, 32, 1, 40, 3, 0)
    segment = struct.pack("<IIIIIIII", PT_LOAD, at, address, address, len(body), len(body), 5, 4)
    sections = bytes(40) + struct.pack("<IIIIIIIIII", 0, SHT_SYMTAB, 0, 0, table_at, len(table), 2, 0, 4, 16) + struct.pack("<IIIIIIIIII", 0, 3, 0, 0, name_at, len(names), 0, 0, 1, 0)
    return head + segment + body + names + table + sections


def images(df: DataFrame, path: str, address: str, values: str, symbol: str) -> DataFrame:
    """(path, content): an image of each row."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            p, a, v, n = (batch.column(i).to_pylist() for i in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array([image(*x) for x in zip(a, v, n)], pa.binary())], schema=schema)

    return df.select(path, F.col(address).cast("bigint"), F.col(values).cast("array<bigint>"), F.coalesce(symbol, F.lit("?"))).mapInArrow(run, "path string, content binary")
