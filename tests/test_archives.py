"""Zip archives by ranges."""

import zipfile

import pytest
from pyspark.sql import functions as F

from nightjar.sources import archives, listening


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    with zipfile.ZipFile(tmp_path / "in/a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = b"x" * 3000
        z.writestr("MyData/one.json", "[1]" * 5000)
        z.writestr("MyData/", "")
        z.writestr("MyData/Technical.json", "no")
        z.writestr("MyData/photo.jpg", b"no")
        z.writestr("MyData/empty.csv", "")
        with z.open("MyData/large.csv", "w", force_zip64=True) as f:
            f.write("æ,ø\n".encode() * 9)
    with zipfile.ZipFile(tmp_path / "in/deep/b.ZIP", "w") as z:
        z.writestr("two.TXT", b"\xff stored")
    return tmp_path / "in"


def load(spark, path):
    listening.register(spark)
    return spark.read.format("zip_entries").option("path", str(path)).load()


def test_entries_of_a_folder(spark, folder):
    got = {(r["archive"].split("/")[-1], r["entry"]): (r["size"], r["text"]) for r in load(spark, folder).collect()}
    assert got == {("a.zip", "MyData/one.json"): (15000, "[1]" * 5000), ("a.zip", "MyData/empty.csv"): (0, ""), ("a.zip", "MyData/large.csv"): (54, "æ,ø\n" * 9), ("b.ZIP", "two.TXT"): (8, "� stored")}
    assert load(spark, f"file://{folder}/a.zip").count() == 3


def test_filters_leave_entries_and_archives_unread(spark, folder):
    raw = bytearray((folder / "a.zip").read_bytes())
    at = next(e.at for e in archives.directory(str(folder / "a.zip")) if e.name.endswith("one.json"))
    raw[at : at + 4] = b"gone"
    (folder / "a.zip").write_bytes(raw)
    (folder / "c.zip").write_bytes(b"no archive at all")
    df = load(spark, folder).filter(F.col("archive").endswith("a.zip"))
    assert [r["text"] for r in df.filter(F.col("entry").contains("large")).collect()] == ["æ,ø\n" * 9]
    assert df.filter("entry IN ('MyData/empty.csv', 'x') AND size < 5").count() == 1
    for broken, what in ((df, "Corrupt entry"), (load(spark, folder / "c.zip"), "Not a zip file")):
        with pytest.raises(Exception, match=what):
            broken.collect()


def test_large_entries_stand_alone(folder, monkeypatch):
    monkeypatch.setattr(archives, "TASK_BYTES", 20)
    parts = archives.ZipReader({"paths": f"{folder}/a.zip"}).partitions()
    assert sum(len(p.entries) for p in parts) == 3 and len(parts) > 1
