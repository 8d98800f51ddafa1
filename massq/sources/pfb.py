"""PFB files as a data source of several partitions: ``spark.read.format("pfb").load(path)``.

The addresses of all records stand at a file's end. The driver reads them, eight bytes a spectrum, and
cuts a file at record borders into ranges of about ``splitBytes``; a task reads its own range. Files that are
no larger aren't opened by the driver, and a task reads several of them.
A condition ``scan = k`` or ``scan IN (...)`` is pushed down: the first scan number of each range is looked up,
and ranges that can't hold a wanted scan are left out. Where the numbers of a file's ranges don't rise, none
is. Spark applies the condition to the rows again.

Files are opened through pyarrow's file systems (local, HDFS, S3, Google Cloud Storage). Others go through Spark's own
reader of binary files, a task a file (``spectra.read_pfb``).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from massq.operators.spectra import SCHEMA

HEADER = 24
SPLIT_BYTES = 32 << 20
#: What opening a file counts as, in bytes, where files share a partition; about how many partitions small files make, until each has ``SPLIT_BYTES``.
OPEN_BYTES, SHARED = 64 << 10, 64
#: Address schemes that pyarrow opens, by its own names for them.
SCHEMES = {"": "file", "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


class SpectrumFormatError(ValueError):
    """A file name or content that is of no known spectrum format."""


_PRECURSOR = pa.struct([("mz", pa.float64()), ("charge", pa.int32()), ("intensity", pa.float64()), ("isolation", pa.struct([("target", pa.float64()), ("lower", pa.float64()), ("upper", pa.float64())])), ("source_scan", pa.int32())])
_ARROW = pa.schema([("run", pa.string()), ("scan", pa.int32()), ("ms_level", pa.int32()), ("rt_min", pa.float64()), ("precursors", pa.list_(_PRECURSOR)), ("mz", pa.list_(pa.float64())), ("intensity", pa.list_(pa.float64())), ("representation", pa.string())])


def header(head: bytes, size: int) -> tuple[int, int]:
    """Where the addresses begin, and how many there are."""
    if len(head) < HEADER:
        raise SpectrumFormatError(f"a PFB header has {HEADER} bytes")
    addresses, count = struct.unpack_from("<qi", head, 12)
    if addresses < 0 or count < 0 or addresses + 8 * count != size:
        raise SpectrumFormatError("the PFB header doesn't fit the file's size")
    return addresses, count


def record(content: bytes, at: int) -> tuple[dict, int]:
    """The spectrum that begins at a place, and where it ends: properties, then as many m/z and intensities as stated."""
    (size,) = struct.unpack_from("<i", content, at)
    fields = content[at + 4 : at + 4 + size].decode("utf-8", "replace").rstrip("\0").split("\t")
    (n,) = struct.unpack_from("<i", content, at + 4 + size)
    at += 8 + size
    if n < 0 or at + 16 * n > len(content):
        raise SpectrumFormatError("peaks beyond the end of the PFB file")
    mz, intensity = np.frombuffer(content, "<f8", n, at), np.frombuffer(content, "<f8", n, at + 8 * n)

    def number(k: int, kind=float):
        try:
            return kind(fields[k].strip())
        except (IndexError, ValueError):
            return None

    scan, level = number(0, int), number(1, int)
    if scan is None or level is None:
        raise SpectrumFormatError("a PFB record without scan or level")
    order = np.argsort(mz, kind="stable")
    center, width, mono = number(7), number(10), number(12)
    isolation = {"target": center, "lower": width / 2, "upper": width / 2} if center is not None and width and width > 0 else None
    one = {"mz": mono if mono is not None else center or 0.0, "charge": number(4, int) or None, "intensity": None, "isolation": isolation, "source_scan": number(9, int)}
    row = {"scan": scan, "ms_level": level, "rt_min": (number(2) or 0.0) / 60, "precursors": [one] if level == 2 else [], "mz": mz[order], "intensity": intensity[order], "representation": "centroid"}
    return row, at + 16 * n


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of an address, and the place in it."""
    parts = urlsplit(path)
    if SCHEMES.get(parts.scheme) is None:
        raise SpectrumFormatError(f"no reader for addresses like {parts.scheme}://")
    if SCHEMES[parts.scheme] == "file":
        return pa.fs.LocalFileSystem(), parts.path
    return pa.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def splittable(spark: SparkSession, path: str) -> bool:
    """Whether pyarrow reaches an address; one without a scheme only where Spark takes it for a local one too."""
    scheme = urlsplit(path).scheme
    return scheme in SCHEMES and (scheme != "" or spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:"))


@dataclass
class Range(InputPartition):
    """Records of a file from one byte up to another."""

    path: str
    start: int
    end: int

    def __post_init__(self):
        super().__init__((self.path, self.start, self.end))


@dataclass
class Files(InputPartition):
    """Whole small files."""

    paths: tuple[str, ...]

    def __post_init__(self):
        super().__init__(self.paths)


class PfbReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split, self.scans = path, split, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("scan",) else set(f.value) if isinstance(f, In) and f.attribute == ("scan",) else None
            if wanted is not None:
                self.scans = wanted if self.scans is None else self.scans & wanted
            yield f  # Spark looks at the rows again

    def partitions(self) -> list[InputPartition]:
        fs, place = opened(self.path)
        info = fs.get_file_info(place)
        if info.type == pa.fs.FileType.NotFound:
            raise SpectrumFormatError(f"no file {self.path}")
        files = [info] if info.is_file else [x for x in fs.get_file_info(pa.fs.FileSelector(place, recursive=True)) if x.is_file and x.path.lower().endswith(".pfb")]
        files.sort(key=lambda x: x.path)
        small = [x for x in files if x.size <= self.split]
        found: list[InputPartition] = self._together(small)
        for file in (x for x in files if x.size > self.split):
            with fs.open_input_file(file.path) as f:
                end, count = header(f.read_at(HEADER, 0), file.size)
                at = np.frombuffer(f.read_at(8 * count, end), "<i8") if count else np.empty(0, np.int64)
                if len(at) and ((np.diff(at) <= 0).any() or at[0] < HEADER or at[-1] >= end):
                    raise SpectrumFormatError("PFB addresses that don't rise")
                starts = at[np.append(True, np.diff((at - HEADER) // self.split) > 0)] if len(at) else at
                ranges = [Range(file.path, a, b) for a, b in zip(starts.tolist(), np.append(starts[1:], end).tolist(), strict=False)]
                found += ranges if self.scans is None else self._holding(f, ranges)
        return found or [Range("", 0, 0)]

    def _together(self, files: list) -> list[InputPartition]:
        """Small files by path, as many in a partition as its bytes allow."""
        most = min(SPLIT_BYTES, max(self.split, sum(x.size + OPEN_BYTES for x in files) // SHARED))
        found, paths, held = [], [], 0
        for x in files:
            if paths and held + x.size + OPEN_BYTES > most:
                found.append(Files(tuple(paths)))
                paths, held = [], 0
            paths.append(x.path)
            held += x.size + OPEN_BYTES
        return found + ([Files(tuple(paths))] if paths else [])

    def _holding(self, f, ranges: list[Range]) -> list[Range]:
        """Those ranges that may hold a wanted scan."""
        firsts = []
        for r in ranges:
            (size,) = struct.unpack("<i", f.read_at(4, r.start))
            try:
                firsts.append(int(f.read_at(size, r.start + 4).split(b"\t")[0]))
            except ValueError:
                return ranges
        if any(a >= b for a, b in zip(firsts, firsts[1:], strict=False)):
            return ranges
        ends = [*firsts[1:], float("inf")]
        return [r for r, a, b in zip(ranges, firsts, ends, strict=True) if any(a <= s < b for s in self.scans)]

    def _contents(self, partition: Range | Files) -> Iterator[tuple[str, bytes]]:
        """(path, records) of a range or of each whole file."""
        fs, _ = opened(self.path)
        if isinstance(partition, Range):
            with fs.open_input_file(partition.path) as f:
                yield partition.path, f.read_at(partition.end - partition.start, partition.start)
            return
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                content = f.read()
            end, count = header(content[:HEADER], len(content))
            at = np.frombuffer(content, "<i8", count, end)
            if count and ((np.diff(at) <= 0).any() or at[0] < HEADER or at[-1] >= end):
                raise SpectrumFormatError("PFB addresses that don't rise")
            yield path, content[at[0] : end] if count else b""

    def read(self, partition: Range | Files) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Range) and not partition.path:
            return
        rows = []
        for path, content in self._contents(partition):
            run, at = path.rsplit("/", 1)[-1].rsplit(".", 1)[0], 0
            while at < len(content):
                row, at = record(content, at)
                if self.scans is None or row["scan"] in self.scans:
                    rows.append({"run": run, **row})
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class PfbSource(DataSource):
    """Option ``splitBytes``: about how many bytes of a file a partition reads."""

    @classmethod
    def name(cls) -> str:
        return "pfb"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PfbReader:
        return PfbReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def register(spark: SparkSession) -> None:
    """Make ``format("pfb")`` known to a session, and conditions reach it."""
    spark.dataSource.register(PfbSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
