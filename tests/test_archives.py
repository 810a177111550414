"""The archive source: members, windows, months, filters, checksums, long windows and bounded batches."""

import hashlib
import io
import json
import tarfile

import pytest
import zstandard

from sequoria.sources import archives, dumps


def archive(path, members, compressor=None):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as out:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            out.addfile(info, io.BytesIO(data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes((compressor or zstandard.ZstdCompressor()).compress(raw.getvalue()))


@pytest.fixture
def folder(tmp_path):
    archive(tmp_path / "a-20240201-000003.tar.zst", [("d/START_TIMESTAMP", b"2024-01-31 00:00:03.293870+00:00"), ("d/END_TIMESTAMP", b"2024-02-01 00:00:01+00:00\n"), ("d/listens/2024/1.listens", b"one\ntwo\n\nlast without end"), ("d/listens/2023/12.listens", b"old\n"), ("d/other/2024/1.listens.txt", b"no\n"), ("d/listens/2024/1.json", b"no\n")])
    archive(tmp_path / "sub" / "b.tar.zst", [("listens/2024/1.listens", "é�\n".encode() + b"\xff bytes\n"), ("listens/2024/13.listens", b"no such month\n")])
    archive(tmp_path / "c.tar.zst", [("readme", b"nothing")])
    (tmp_path / "_hidden.tar.zst").write_bytes(b"not an archive")
    (tmp_path / "notes.txt").write_bytes(b"x")
    return tmp_path


def test_lines_and_windows(spark, folder):
    rows = dumps.archive_lines(spark, str(folder)).collect()
    lines = {}
    for r in rows:
        lines.setdefault((r.archive, r.year, r.month), []).append(r.line)
    assert lines == {("a-20240201-000003.tar.zst", 2024, 1): ["one", "two", "", "last without end"], ("a-20240201-000003.tar.zst", 2023, 12): ["old"], ("b.tar.zst", 2024, 1): ["é�", "� bytes"]}
    assert {(r.archive, str(r.started), str(r.ended)) for r in rows} == {("a-20240201-000003.tar.zst", "2024-01-31 00:00:03.293870", "2024-02-01 00:00:01"), ("b.tar.zst", "None", "None")}
    windows = {r.archive: (str(r.started), str(r.named)) for r in dumps.dump_windows(spark, str(folder)).collect()}
    assert windows == {"a-20240201-000003.tar.zst": ("2024-01-31 00:00:03.293870", "2024-02-01 00:00:03"), "b.tar.zst": ("None", "None"), "c.tar.zst": ("None", "None")}
    assert [r.line for r in dumps.archive_lines(spark, f"file://{folder}/sub/b.tar.zst").collect()] == ["é�", "� bytes"]


@pytest.mark.parametrize("condition,n", [("year = 2024", 6), ("year = 2024 AND month < 2", 6), ("month = 12", 1), ("year IN (2022, 2023)", 1), ("archive = 'b.tar.zst'", 2), ("year < 2000", 0), ("year <> 2024", 1), ("line = 'one' AND year >= 2024", 1), ("year IS NULL", 0), ("year = 2023 OR month = 1", 7)])
def test_filters_keep_their_meaning(spark, folder, condition, n):
    assert dumps.archive_lines(spark, str(folder)).filter(condition).count() == n


def test_months_that_filters_exclude_are_not_read(folder):
    reader = archives.ArchiveReader({"path": str(folder)})
    left = list(reader.pushFilters([archives.ds.EqualTo(("year",), 2023), archives.ds.StringContains(("line",), "o"), archives.ds.IsNotNull(("year",)), archives.ds.EqualTo(("archive",), "a-20240201-000003.tar.zst")]))
    assert [type(f).__name__ for f in left] == ["StringContains"]
    parts = reader.partitions()
    assert [p.name for p in parts] == ["a-20240201-000003.tar.zst"]
    assert [r for b in reader.read(parts[0]) for r in b.column("line").to_pylist()] == ["old"]


def test_months_of_a_time_range(spark, folder):
    january = 1_704_067_200
    assert dumps.archive_lines(spark, str(folder), january, january + 1).count() == 6
    assert dumps.archive_lines(spark, str(folder), end=january).count() == 1
    assert dumps.archive_lines(spark, str(folder), january + 31 * 86_400).count() == 0


def test_checksums_are_compared(spark, folder):
    data = (folder / "c.tar.zst").read_bytes()
    (folder / "c.tar.zst.sha256").write_text(f"{hashlib.sha256(data).hexdigest().upper()}  c.tar.zst\n")
    (folder / "sub" / "b.tar.zst.sha256").write_text("no digest")
    found = {r.archive: (r.sha256, r.expected) for r in dumps.checksums(spark, str(folder), ".tar.zst").collect()}
    digest = hashlib.sha256(data).hexdigest()
    assert found["c.tar.zst"] == (digest, digest) and found["b.tar.zst"][1] is None and len(found) == 3
    assert dumps.archive_lines(spark, str(folder), verify=True).count() == 7
    (folder / "a-20240201-000003.tar.zst.sha256").write_text("0" * 64)
    with pytest.raises(Exception, match="its SHA-256 is"):
        dumps.archive_lines(spark, str(folder), verify=True).count()
    assert dumps.archive_lines(spark, str(folder)).count() == 7


def test_long_windows_and_bounded_batches(tmp_path, monkeypatch):
    """A stream made with a window of 2^28 bytes, which readers refuse by default; batches stay bounded."""
    settings = zstandard.ZstdCompressionParameters.from_level(1, window_log=28)
    data = b"".join(b"%d %s\n" % (k, b"x" * 40) for k in range(50_000))
    path = tmp_path / "wide.tar.zst"
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as out:
        info = tarfile.TarInfo("listens/2024/1.listens")
        info.size = len(data)
        out.addfile(info, io.BytesIO(data))
    packer = zstandard.ZstdCompressor(compression_params=settings).compressobj()
    path.write_bytes(packer.compress(raw.getvalue()) + packer.flush())
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().stream_reader(io.BytesIO(path.read_bytes())).read(1)
    monkeypatch.setattr(archives, "LINE_BYTES", 100_000)
    reader = archives.ArchiveReader({"path": str(tmp_path)})
    sizes = [b.num_rows for b in reader.read(reader.partitions()[0])]
    assert sum(sizes) == 50_000 and max(sizes) <= 100_000 // 40


def test_archives_are_read_as_streams(tmp_path):
    """The reader asks for a part of a file at a time, so a file's size does not matter."""
    archive(tmp_path / "a.tar.zst", [("listens/2024/1.listens", b"line of text %d\n" % k * 1000) for k in range(300)])

    class Counting(io.RawIOBase):
        most = 0

        def __init__(self):
            self.file = open(tmp_path / "a.tar.zst", "rb")

        def readable(self):
            return True

        def readinto(self, buffer):
            Counting.most = max(Counting.most, len(buffer))
            return self.file.readinto(buffer)

    reader = archives.ArchiveReader({"path": str(tmp_path)})
    assert sum(b.num_rows for b in reader.unpacked(Counting(), "a")) == 300_000
    assert 0 < Counting.most <= archives.READ_BYTES


def test_written_archives_come_back(spark, tmp_path):
    rows = [(2024, 1 + k % 3, json.dumps({"k": k})) for k in range(1000)] + [(2023, 12, None)]
    df = spark.createDataFrame(rows, "year int, month int, line string").repartition(3)
    dumps.write_archives(df, str(tmp_path / "out"), "2024-01-01 00:00:00+00:00", "2024-01-02 00:00:00")
    back = dumps.archive_lines(spark, f"{tmp_path}/out")
    assert sorted((r.year, r.month, r.line) for r in back.collect()) == sorted((y, m, line or "") for y, m, line in rows)
    assert back.select("archive").distinct().count() == 3 and {str(r.ended) for r in back.collect()} == {"2024-01-02 00:00:00"}
    dumps.write_archives(df.limit(0), str(tmp_path / "none"))
    assert dumps.archive_lines(spark, f"{tmp_path}/none").count() == 0
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_missing_folder_and_broken_archive(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        dumps.archive_lines(spark, str(tmp_path / "nowhere")).count()
    (tmp_path / "x.tar.zst").write_bytes(b"this is no archive")
    with pytest.raises(Exception):
        dumps.archive_lines(spark, str(tmp_path)).count()
