"""A Python data source of dump archives: ``.tar.zst`` files with a member of JSON lines for each month.

Each archive is a partition, read front to back as a stream: its bytes are unpacked,
cut into members and lines, and handed on in batches, so memory is that of a batch and
the stream's window, however large the archive is. Filters on year, month and archive
reach the scan, which passes over the members they exclude. Every row has the archive's
window of submission times, from the two members that come before the lines.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import tarfile
import uuid
from calendar import timegm
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

#: Fixed values of the dumps' format: a month's member, the members with the window, the longest window of the stream.
MONTH_NAME = r"(?:^|/)listens/(\d{4})/(\d{1,2})\.listens$"
WINDOW_NAMES = ("START_TIMESTAMP", "END_TIMESTAMP")
MAX_WINDOW = 2**31
#: Lines and bytes of lines in a batch; bytes of a written member.
LINES, LINE_BYTES, MEMBER_BYTES = 8192, 1 << 23, 1 << 23
READ_BYTES = 1 << 20

LINES_SCHEMA = "archive string, started timestamp, ended timestamp, year int, month int, line string"
WINDOWS_SCHEMA = "archive string, started timestamp, ended timestamp"
CHECKSUMS_SCHEMA = "path string, archive string, sha256 string, expected string"


def month_wanted(year: int, month: int, start: int | None, end: int | None) -> bool:
    """Whether a month has seconds of [start, end); None is no bound."""
    first, after = timegm((year, month, 1, 0, 0, 0)), timegm((year + month // 12, month % 12 + 1, 1, 0, 0, 0))
    return (end is None or first < end) and (start is None or after > start)


def _opened(path: str) -> tuple[pf.FileSystem, str]:
    """The file system of a path or URI, and the path there; paths without a scheme are local (or mounted)."""
    return pf.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (pf.LocalFileSystem(), posixpath.abspath(path))


class _Hashed(io.RawIOBase):
    """A stream that hashes what is read of it."""

    def __init__(self, inner):
        self.inner, self.sha256 = inner, hashlib.sha256()

    def readable(self):
        return True

    def readinto(self, buffer):
        data = self.inner.read(len(buffer))
        self.sha256.update(data)
        buffer[: len(data)] = data
        return len(data)


def _expected(files: pf.FileSystem, path: str) -> str | None:
    """The digest in a file beside the archive with ``.sha256`` added to its name; None if there is none."""
    if files.get_file_info(f"{path}.sha256").type != pf.FileType.File:
        return None
    with files.open_input_stream(f"{path}.sha256", compression=None) as file:
        words = file.read(1 << 16).decode("utf-8", "replace").split()
    return words[0].lower() if words and re.fullmatch(r"[0-9a-fA-F]{64}", words[0]) else None


def _time(data: bytes) -> datetime:
    """A member's time; without a zone it is UTC."""
    found = datetime.fromisoformat(data.decode().strip())
    return found if found.tzinfo else found.replace(tzinfo=UTC)


@dataclass(frozen=True)
class Archive(ds.InputPartition):
    path: str
    name: str


_COMPARED = {ds.EqualTo: lambda a, b: a == b, ds.EqualNullSafe: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b, ds.In: lambda a, b: a in b}


class ArchiveReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        number = lambda name: int(options[name]) if options.get(name) else None
        self.path, self.what, self.verify = options["path"], options.get("what", "lines"), options.get("verify", "false") == "true"
        self.start, self.end, self.ending = number("start"), number("end"), options.get("ending", ".tar.zst")
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Comparisons of year, month and archive are done here; all others by Spark."""
        for f in filters:
            kind, column = type(f), f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if kind in _COMPARED and column in ("year", "month", "archive"):
                self.filters.append((column, kind.__name__, f.value))
            elif not (kind is ds.IsNotNull and column in ("year", "month", "archive")):
                yield f

    def wanted(self, column: str, value) -> bool:
        kinds = {kind.__name__: test for kind, test in _COMPARED.items()}
        return all(value is not None and kinds[kind](value, other) for c, kind, other in self.filters if c == column)

    def partitions(self):
        files, path = _opened(self.path)
        info = files.get_file_info(path)
        if info.type == pf.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pf.FileType.File else files.get_file_info(pf.FileSelector(path, recursive=True))
        scheme = re.match(r"[a-z][a-z0-9+.-]*://[^/]*", self.path)
        names = sorted(x.path for x in found if x.type == pf.FileType.File and x.path.endswith(self.ending) and not posixpath.basename(x.path).startswith(("_", ".")))
        parts = [Archive(f"{scheme[0]}{n if n.startswith('/') else '/' + n.partition('/')[2]}" if scheme else n, posixpath.basename(n)) for n in names]
        return [p for p in parts if self.wanted("archive", p.name)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in for a folder without archives
            return
        files, path = _opened(partition.path)
        with files.open_input_stream(path, compression=None, buffer_size=READ_BYTES) as raw:
            source = _Hashed(raw)
            if self.what == "checksums":
                while source.read(READ_BYTES):
                    pass
                yield pa.RecordBatch.from_pydict({"path": [partition.path], "archive": [partition.name], "sha256": [source.sha256.hexdigest()], "expected": [_expected(files, path)]}, pa.schema([(c, pa.string()) for c in ("path", "archive", "sha256", "expected")]))
                return
            yield from self.unpacked(source, partition.name)
            if self.what == "lines" and self.verify and (expected := _expected(files, path)):
                while source.read(READ_BYTES):  # what follows the archive's end
                    pass
                if source.sha256.hexdigest() != expected:
                    raise OSError(f"{partition.path}: its SHA-256 is {source.sha256.hexdigest()}, not {expected}")

    def unpacked(self, source: io.RawIOBase, name: str) -> Iterator[pa.RecordBatch]:
        import zstandard

        window: dict[str, datetime] = {}
        with zstandard.ZstdDecompressor(max_window_size=MAX_WINDOW).stream_reader(source, read_size=READ_BYTES, read_across_frames=True) as plain, tarfile.open(fileobj=plain, mode="r|", bufsize=READ_BYTES) as archive:
            for member in archive:
                base = posixpath.basename(member.name)
                if member.isfile() and base in WINDOW_NAMES:
                    window[base] = _time(archive.extractfile(member).read())
                    continue
                found = re.search(MONTH_NAME, member.name)
                if self.what == "windows":
                    if found or len(window) == 2:
                        break
                    continue
                if not found or not member.isfile():
                    continue
                year, month = int(found[1]), int(found[2])
                if 1 <= month <= 12 and month_wanted(year, month, self.start, self.end) and self.wanted("year", year) and self.wanted("month", month):
                    for lines in _batches(archive.extractfile(member)):
                        yield _rows(name, window, len(lines), {"year": pa.array([year] * len(lines), pa.int32()), "month": pa.array([month] * len(lines), pa.int32()), "line": pa.array(lines, pa.string())})
        if self.what == "windows":
            yield _rows(name, window, 1, {})


def _batches(member) -> Iterator[list[str]]:
    lines: list[str] = []
    size = 0
    for line in member:
        lines.append(line.removesuffix(b"\n").decode("utf-8", "replace"))
        size += len(line)
        if len(lines) == LINES or size >= LINE_BYTES:
            yield lines
            lines, size = [], 0
    if lines:
        yield lines


def _rows(name: str, window: dict[str, datetime], n: int, more: dict[str, pa.Array]) -> pa.RecordBatch:
    times = {c: pa.array([window.get(w)] * n, pa.timestamp("us", "UTC")) for c, w in zip(("started", "ended"), WINDOW_NAMES)}
    return pa.RecordBatch.from_pydict({"archive": pa.array([name] * n, pa.string()), **times, **more})


@dataclass
class Written(ds.WriterCommitMessage):
    unfinished: str
    finished: str


class ArchiveWriter(ds.DataSourceArrowWriter):
    """An archive for each task, with the lines in members of bounded size in the order of the rows.

    Archives appear under their own names when all tasks have ended, so what failed or
    repeated tasks have written is never read.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex
        self.started, self.ended = options.get("started"), options.get("ended")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import zstandard
        from pyspark import TaskContext

        files, folder = _opened(self.path)
        task = TaskContext.get()
        files.create_dir(folder, recursive=True)
        end = f"dump-{task.partitionId():05d}-{self.run}.tar.zst"
        place = Written(f"{folder}/_{task.taskAttemptId()}-{end}", f"{folder}/{end}")
        with files.open_output_stream(place.unfinished, compression=None) as raw, zstandard.ZstdCompressor().stream_writer(raw, closefd=False) as packed, tarfile.open(fileobj=packed, mode="w|") as archive:
            for name, value in zip(WINDOW_NAMES, (self.started, self.ended)):
                if value is not None:
                    _add(archive, f"dump/{name}", value.encode())
            held, size, now = [], 0, None
            for batch in iterator:
                for year, month, line in zip(*(batch.column(c).to_pylist() for c in ("year", "month", "line"))):
                    if now != (year, month) or size >= MEMBER_BYTES:
                        _month(archive, now, held)
                        held, size, now = [], 0, (year, month)
                    held.append((line or "").encode() + b"\n")
                    size += len(held[-1])
            _month(archive, now, held)
        return place

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _opened(self.path)
        if self.overwrite:
            new = {m.unfinished for m in messages if m}
            for old in files.get_file_info(pf.FileSelector(folder, allow_not_found=True)):
                if old.type == pf.FileType.File and old.path.endswith(".tar.zst") and old.path not in new:
                    files.delete_file(old.path)
        for m in messages:
            if m:
                files.move(m.unfinished, m.finished)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _opened(self.path)
        for m in messages:
            if m:
                files.delete_file(m.unfinished)


def _month(archive: tarfile.TarFile, month: tuple[int, int] | None, lines: list[bytes]) -> None:
    if lines:
        _add(archive, f"dump/listens/{month[0]}/{month[1]}.listens", b"".join(lines))


def _add(archive: tarfile.TarFile, name: str, data: bytes) -> None:
    info = tarfile.TarInfo(name)
    info.size = len(data)
    archive.addfile(info, io.BytesIO(data))


class ArchiveSource(ds.DataSource):
    """``spark.read.format("dump_archives")``: option ``what`` is lines, windows or checksums."""

    @classmethod
    def name(cls) -> str:
        return "dump_archives"

    def schema(self) -> str:
        return {"lines": LINES_SCHEMA, "windows": WINDOWS_SCHEMA, "checksums": CHECKSUMS_SCHEMA}[self.options.get("what", "lines")]

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        if [f.name for f in schema] != ["year", "month", "line"]:
            raise ValueError("archives are written from the columns year, month and line")
        return ArchiveWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
