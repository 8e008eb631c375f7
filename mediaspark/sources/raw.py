"""Raw byte sources: transport packets and PCM samples, cut into aligned ranges.

Files are listed and read through pyarrow's file systems, so local paths and
``hdfs://`` or ``s3://`` addresses work alike.  Each partition is a byte range that
begins on a record border; a short record at the end of a file is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20


def _files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    head = path[: len(path) - len(root)] if path.endswith(root) else ""
    names = [(head + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted(names)


def _read(path: str, start: int, size: int) -> bytes:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        return f.read_at(size, start)


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, size: int, earlier: int = 0):
        self.path, self.start, self.size, self.earlier = path, start, size, earlier


class _RangeReader(DataSourceReader):
    def __init__(self, path: str, record: int, span: int, one_stream: bool = False):
        self.path, self.record, self.one_stream = path, record, one_stream
        self.span = max(span // record, 1) * record

    def partitions(self):
        out, earlier = [], 0
        for name, size in _files(self.path):
            whole = size - size % self.record
            out += [ByteRange(name, at, min(self.span, whole - at), earlier) for at in range(0, whole, self.span)]
            if self.one_stream:  # the parts of a folder follow each other by name
                earlier += whole // self.record
        return out or [ByteRange("", 0, 0)]

    def blocks(self, part: ByteRange, records: int) -> Iterator[tuple[int, bytes]]:
        """(first record number, bytes) of at most ``records`` records each."""
        step = records * self.record
        for at in range(part.start, part.start + part.size, step):
            yield part.earlier + at // self.record, _read(part.path, at, min(step, part.start + part.size - at))


class TsReader(_RangeReader):
    def read(self, partition):
        for first, raw in self.blocks(partition, 16384):
            n = len(raw) // self.record
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(self.record), n, [None, pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.path] * n), pa.array(np.arange(first, first + n)), data], names=["path", "packet_no", "data"]
            )


class TsSource(DataSource):
    """``spark.read.format("ts_packets").load(path)``: one row per 188-byte record."""

    @classmethod
    def name(cls) -> str:
        return "ts_packets"

    def schema(self) -> str:
        return "path string, packet_no bigint, data binary"

    def reader(self, schema) -> DataSourceReader:
        return TsReader(self.options["path"], 188, int(self.options.get("rangebytes", RANGE_BYTES)), self.options.get("onestream") == "true")


def _alaw() -> np.ndarray:
    """G.711 A-law: sign, three bits of exponent, four of mantissa, even bits inverted."""
    v = np.arange(256) ^ 0x55
    exp, man = (v >> 4) & 7, v & 15
    mag = np.where(exp == 0, (man << 4) + 8, ((man << 4) + 0x108) << np.maximum(exp - 1, 0))
    return np.where(v & 0x80, mag, -mag)


def _mulaw() -> np.ndarray:
    """G.711 mu-law: all bits inverted, bias 0x84."""
    v = ~np.arange(256) & 0xFF
    mag = ((((v & 15) << 3) + 0x84) << ((v >> 4) & 7)) - 0x84
    return np.where(v & 0x80, -mag, mag)


def _pcm24(order: str, signed: bool):
    def decode(raw: bytes) -> np.ndarray:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        if order == "be":
            b = b[:, ::-1]
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        return np.where(v >= 1 << 23, v - (1 << 24), v) if signed else v

    return decode


def pcm_formats() -> dict[str, tuple[int, object]]:
    """Bytes per sample and decoder of every raw layout."""
    out: dict[str, tuple[int, object]] = {
        "alaw": (1, lambda r: _alaw()[np.frombuffer(r, np.uint8)]),
        "mulaw": (1, lambda r: _mulaw()[np.frombuffer(r, np.uint8)]),
    }
    for order, mark in (("be", ">"), ("le", "<")):
        for name, code, n in (("f64", "f8", 8), ("f32", "f4", 4), ("s32", "i4", 4), ("s16", "i2", 2), ("u32", "u4", 4), ("u16", "u2", 2)):
            out[name + order] = (n, lambda r, t=mark + code: np.frombuffer(r, t))
        out["s24" + order] = (3, _pcm24(order, True))
        out["u24" + order] = (3, _pcm24(order, False))
    out["s8"] = (1, lambda r: np.frombuffer(r, np.int8))
    out["u8"] = (1, lambda r: np.frombuffer(r, np.uint8))
    return out


class PcmReader(_RangeReader):
    def __init__(self, path, fmt, channels, span, one_stream=False):
        width, self.decode = pcm_formats()[fmt]
        self.channels = channels
        super().__init__(path, width * channels, span, one_stream)

    def read(self, partition):
        for first, raw in self.blocks(partition, 1 << 16):
            v = np.asarray(self.decode(raw), dtype=np.float64)
            n = len(v) // self.channels
            ch = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.channels), pa.array(v))
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.path] * n), pa.array(np.arange(first, first + n)), ch], names=["path", "sample_no", "ch"]
            )


class PcmSource(DataSource):
    """``format("pcm").option("fmt", "s16le").option("channels", 2)``: one row per sample."""

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return "path string, sample_no bigint, ch array<double>"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        fmt = o.get("fmt", "s16le")
        if fmt not in pcm_formats():
            raise ValueError(f"fmt must be one of {sorted(pcm_formats())}")
        return PcmReader(o["path"], fmt, int(o.get("channels", 1)), int(o.get("rangebytes", RANGE_BYTES)), o.get("onestream") == "true")


def scan_ts(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES, one_stream: bool = False) -> DataFrame:
    """188-byte records of a file or folder with their header fields.

    Records are numbered per file, or with ``one_stream`` on through the files of a
    folder in the order of their names.
    """
    from mediaspark.operators.transport import parse_header

    spark.dataSource.register(TsSource)
    return parse_header(spark.read.format("ts_packets").option("rangebytes", range_bytes).option("onestream", one_stream).load(path))


def scan_pcm(spark: SparkSession, path: str, fmt: str = "s16le", channels: int = 1, rate: int = 44100, *, range_bytes: int = RANGE_BYTES, one_stream: bool = False) -> DataFrame:
    """Raw samples with their time in seconds; numbered as ``scan_ts`` numbers records."""
    from pyspark.sql import functions as F

    spark.dataSource.register(PcmSource)
    df = spark.read.format("pcm").option("fmt", fmt).option("channels", channels).option("rangebytes", range_bytes).option("onestream", one_stream).load(path)
    return df.withColumn("seconds", F.col("sample_no") / F.lit(float(rate)))
