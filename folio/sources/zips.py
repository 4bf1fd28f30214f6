"""ZIP archives as a Spark data source: partitions are ranges of an archive's directory of entries, read by seeking.

The driver reads the directories at the archives' ends only. An entry that is stored as it is and larger than a partition is
split by bytes; a compressed one is read by one task as a stream. Content comes in pieces of PIECE bytes at most, numbered from
0, so an entry may be larger than a Spark value; most have one piece. A bad archive, or entry, gives one row with its error and
stops nothing. Paths are read by pyarrow's file systems: local ones, hdfs, s3, gs.
"""

from __future__ import annotations

import bz2
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, entry string, piece int, bytes binary, error string"
#: Bytes of one row, and compressed bytes of one partition, at most (about, for entries that cannot be split).
PIECE, PART = 16 << 20, 64 << 20
_FIELDS = pa.schema([("archive", pa.string()), ("entry", pa.string()), ("piece", pa.int32()), ("bytes", pa.binary()), ("error", pa.string())])


@dataclass(frozen=True)
class Span:
    """Bytes start to stop of an entry's stored data; all of it for a compressed entry. crc is None for a part of an entry."""

    name: str
    header: int
    method: int
    start: int
    stop: int
    size: int
    crc: int | None
    flags: int


@dataclass
class ZipPart(InputPartition):
    archive: str
    spans: tuple[Span, ...] = ()
    error: str | None = None


def _opened(path: str) -> pa.NativeFile:
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def archives(root: str) -> list[str]:
    system, inner = fs.FileSystem.from_uri(root)
    scheme = root[: len(root) - len(inner)] if root.endswith(inner) else ""
    if system.get_file_info(inner).type == fs.FileType.File:
        return [root]
    return sorted(scheme + x.path for x in system.get_file_info(fs.FileSelector(inner, recursive=True)) if x.type == fs.FileType.File and x.path.lower().endswith(".zip"))


def spans(info: zipfile.ZipInfo, part: int) -> Iterator[Span]:
    whole = info.compress_type != zipfile.ZIP_STORED or info.flag_bits & 1 or info.compress_size <= part
    step = max(1, info.compress_size if whole else part - part % PIECE or part)
    for at in range(0, max(1, info.compress_size), step):
        stop = min(info.compress_size, at + step)
        yield Span(info.filename, info.header_offset, info.compress_type, at, stop, info.file_size, info.CRC if whole else None, info.flag_bits)


def planned(path: str, suffix: str, part: int) -> Iterator[ZipPart]:
    """An archive's entries in runs of about `part` bytes."""
    try:
        with _opened(path) as f, zipfile.ZipFile(f) as z:
            held, total = [], 0
            for info in z.infolist():
                if info.is_dir() or not info.filename.lower().endswith(suffix.lower()):
                    continue
                for span in spans(info, part):
                    if held and total + span.stop - span.start > part:
                        yield ZipPart(path, tuple(held))
                        held, total = [], 0
                    held.append(span)
                    total += span.stop - span.start
            if held:
                yield ZipPart(path, tuple(held))
    except Exception as e:  # noqa: BLE001  a bad archive is told and passed over
        yield ZipPart(path, error=str(e) or type(e).__name__)


def content(f: pa.NativeFile, span: Span) -> Iterator[bytes]:
    """The span's bytes, decompressed, in blocks of any size."""
    if span.flags & 1:
        raise ValueError("entry is encrypted")
    if span.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2):
        raise ValueError(f"compression method {span.method} is not supported")
    f.seek(span.header)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no entry where the directory has one")
    f.seek(span.header + 30 + sum(struct.unpack("<HH", head[26:30])) + span.start)
    unpack = zlib.decompressobj(-15) if span.method == zipfile.ZIP_DEFLATED else bz2.BZ2Decompressor() if span.method == zipfile.ZIP_BZIP2 else None
    left, size, crc = span.stop - span.start, 0, 0
    while left:
        block = f.read(min(left, 1 << 20))
        if not block:
            raise ValueError("archive ends inside an entry")
        left -= len(block)
        block = unpack.decompress(block) if unpack else block
        size, crc = size + len(block), zlib.crc32(block, crc)
        yield block
    if unpack and span.method == zipfile.ZIP_DEFLATED:
        block = unpack.flush()
        size, crc = size + len(block), zlib.crc32(block, crc)
        yield block
    if span.crc is not None and (size, crc) != (span.size, span.crc):
        raise ValueError("entry does not have its size or checksum")


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.suffix, self.part = options["path"], options.get("suffix", ""), int(options.get("partitionbytes", PART))

    def partitions(self) -> list[ZipPart]:
        return [p for a in archives(self.root) for p in planned(a, self.suffix, self.part)] or [ZipPart("")]

    def read(self, part: ZipPart) -> Iterator[pa.RecordBatch]:
        row = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part.archive, *x), _FIELDS.types, strict=True)], schema=_FIELDS)
        if part.error is not None:
            yield row(None, None, None, part.error)
        if not part.spans:
            return
        with _opened(part.archive) as f:
            for span in part.spans:
                held, piece = bytearray(), span.start // PIECE
                try:
                    for block in content(f, span):
                        held += block
                        while len(held) > PIECE:
                            yield row(span.name, piece, bytes(held[:PIECE]), None)
                            del held[:PIECE]
                            piece += 1
                    yield row(span.name, piece, bytes(held), None)
                except Exception as e:  # noqa: BLE001  a bad entry is told and passed over
                    yield row(span.name, None, None, str(e) or type(e).__name__)


class ZipSource(DataSource):
    """spark.read.format("zip_entries").option("suffix", ".7z").load(folder or archive)"""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


def scan_zip(spark: SparkSession, root: str, suffix: str = "", part: int = PART) -> DataFrame:
    """(archive, entry, piece, bytes, error): the entries of every .zip below root whose name ends with suffix in any case. 7z needs an
    external program: extract first, then scan_tree."""
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_entries").option("suffix", suffix).option("partitionBytes", part).load(root)
