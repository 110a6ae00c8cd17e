"""Archives made here, read back."""

import io
import json
import sqlite3
import struct
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from cairn.sources import archives, catalog, datasource, parsers
from cairn.streaming import append


def tar(files, mode="w", **more):
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode=mode, format=tarfile.PAX_FORMAT) as t:
        for name, content in files.items():
            i = tarfile.TarInfo(name)
            i.size = len(content)
            i.pax_headers = more
            t.addfile(i, io.BytesIO(content))
    return b.getvalue()


def test_tar_equals_listing():
    data = tar({"./README": b"hi", "dist/a/b/t.sh": b"x" * 700, "README": b"new"}, **{"SCHILY.xattr.user.k": "v"})
    got = list(parsers.tar(data, {}))
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        assert [(r["offsetheader"], r["offset"], r["size"]) for r in got] == [(m.offset, m.offset_data, m.size) for m in t]
    assert [(r["path"], r["name"]) for r in got] == [("", "README"), ("/dist/a/b", "t.sh"), ("", "README")]
    assert got[0]["xattrs"] == {"user.k": b"v"} and got[1]["content"] == b"x" * 700
    assert [k for _, k in parsers.tar_offsets(io.BytesIO(data))] == ["x"] * 3


@pytest.mark.parametrize("mode", ["w:gz", "w:bz2", "w:xz"])
def test_compressed_tar(mode):
    assert [r["name"] for r in parsers.parse(tar({"a": b"1"}, mode), "t", {})] == ["a"]


def test_zip():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("d/f.txt", "content")
    (r,) = parsers.parse(b.getvalue(), "z.zip", {})
    assert (r["path"], r["name"], r["content"]) == ("/d", "f.txt", b"content")


def test_ar_long_names():
    def member(name, content):
        return f"{name:<16}{0:<12}{1:<6}{2:<6}{'100644':<8}{len(content):<10}`\n".encode() + content + b"\n" * (len(content) % 2)

    data = b"!<arch>\n" + member("//", b"a_very_long_member_name.txt/\n") + member("/0", b"abc") + member("short/", b"de") + member("#1/8", b"bsdname\0xyz")
    got = [(r["name"], r["content"]) for r in parsers.ar(data, {})]
    assert got == [("a_very_long_member_name.txt", b"abc"), ("short", b"de"), ("bsdname", b"xyz")]
    with pytest.raises(ValueError):
        list(parsers.ar(data[:-3], {}))


def test_asar():
    tree = json.dumps({"files": {"d": {"files": {"f": {"offset": "0", "size": 3}}}, "l": {"link": "d/f"}}}).encode()
    data = struct.pack("<4I", 4, len(tree) + 8, len(tree) + 4, len(tree)) + tree + b"abc"
    got = {f"{r['path']}/{r['name']}": (r["content"], r["linkname"]) for r in parsers.asar(data, {})}
    assert got == {"/d": (None, ""), "/d/f": (b"abc", ""), "/l": (None, "d/f")}


def test_sqlar(tmp_path, spark):
    with sqlite3.connect(tmp_path / "a.sqlar") as con:
        con.execute("CREATE TABLE sqlar(name, mode, mtime, sz, data)")
        rows = [("d", 0o40755, 1, 0, None), ("d/f", 0o100644, 2, 100, zlib.compress(b"x" * 100)), ("l", 0o120777, 3, -1, "d/f"), ("d/s/t", 0o100644, 2, 1, b"y")]
        con.executemany("INSERT INTO sqlar VALUES (?, ?, ?, ?, ?)", rows)
    con.close()
    got = {r["name"]: (r["content"], r["linkname"]) for r in parsers.parse((tmp_path / "a.sqlar").read_bytes(), "a", {})}
    assert got == {"d": (None, ""), "f": (b"x" * 100, ""), "l": (None, "d/f"), "t": (b"y", "")}
    table = spark.createDataFrame([(n, m, t, z, d.encode() if isinstance(d, str) else d) for n, m, t, z, d in rows], "name string, mode int, mtime long, sz long, data binary")
    assert sorted(r[0] for r in catalog.sqlar_listing(table, "/").select("name").collect()) == ["d", "l"]
    assert [r[0] for r in catalog.sqlar_listing(table, "d").select("name").collect()] == ["f"]


def test_html_and_others():
    page = b'<!DOCTYPE html><html><img src="data:image/png;base64,aGVsbG8" data-savepage-src="http://x/i.png"><a href="data:,a%20b">'
    got = [(r["name"], r["content"]) for r in parsers.parse(page, "p.html", {})]
    assert got[0] == ("i.png", b"hello") and got[1][1] == b"a b"
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://h/a.txt\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [(r["path"], r["name"], r["content"]) for r in parsers.parse(record * 2, "w", {})] == [("/h", "a.txt", b"hello")] * 2

    def page_(serial, body):
        return b"OggS\0\0" + bytes(8) + struct.pack("<I", serial) + bytes(8) + bytes([1, len(body)]) + body

    streams = list(parsers.parse(page_(1, b"\x01vorbis") + page_(2, b"OpusHead") + page_(1, b"xx"), "o.ogg", {}))
    assert [r["name"] for r in streams] == ["audio_00000001.oga", "audio_00000002.oga"]
    assert [r["content"] for r in streams] == [page_(1, b"\x01vorbis") + page_(1, b"xx"), page_(2, b"OpusHead")]


def test_read_recursive_and_errors(spark, tmp_path):
    inner = tar({"x/y.txt": b"hello"})
    (tmp_path / "top.tar").write_bytes(tar({"mid.tar.gz": tar({"in.tar": inner}, "w:gz"), "c": b"2"}))
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04nonsense")
    members = archives.read(spark, str(tmp_path))
    assert members.where("error is not null").count() == 1
    assert archives.files_of(members).count() == 2
    raw = spark.read.format("binaryFile").load(str(tmp_path)).select(F.col("path").alias("archive"), F.col("content").alias("data"))
    got = {(r["path"], r["name"]): r["recursiondepth"] for r in archives.recursive(raw).where("error is null").collect()}
    assert got == {("", "mid.tar.gz"): 0, ("", "c"): 0, ("/mid.tar.gz", "in.tar"): 1, ("/mid.tar.gz/in.tar/x", "y.txt"): 2}
    assert archives.recursive(raw, max_depth=1).count() == 4
    moved = archives.read(spark, str(tmp_path), glob="*.tar", transform=("^/c$", "/moved/c"))
    assert ("/moved", "c") in {(r["path"], r["name"]) for r in moved.collect()}


def test_ranged_tar(spark, tmp_path):
    (tmp_path / "a.tar").write_bytes(tar({f"f{i}": b"z" * i * 100 for i in range(40)}))
    datasource.register(spark)
    df = spark.read.format("cairn_tar").option("path", str(tmp_path / "a.tar")).option("rangeBytes", "4096").load()
    assert df.rdd.getNumPartitions() > 5
    assert sorted((r["name"], r["size"]) for r in df.collect()) == sorted((f"f{i}", i * 100) for i in range(40))


def test_append_and_catalog(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.tar").write_bytes(tar({"a": b"1"}))
    args = (spark, str(source), str(tmp_path / "cat"), str(tmp_path / "cp"))
    assert append.ingest(*args) == 1
    (source / "b.tar").write_bytes(tar({"b": b"1"}))
    assert append.ingest(*args) == 1 and append.ingest(*args) == 0
    now = append.current(spark, str(tmp_path / "cat"))
    assert sorted(r["name"] for r in now.collect()) == ["a", "b"]
    catalog.write(now.drop("archive", "ingest_seq", "istar"), str(tmp_path / "sorted"))
    back = catalog.read(spark, str(tmp_path / "sorted"))
    assert back.count() == 2 and back.where("istar").count() == 0
    folder = archives.indexed_folder(spark, str(source))
    assert [(r["name"], r["offsetheader"]) for r in folder.orderBy("offsetheader").collect()] == [("a.tar", 0), ("b.tar", 1)]
    old = F.struct(F.lit(100 << 20).alias("size"), F.lit(200).alias("files"), F.lit(1.0).alias("mtime"), F.lit("1").alias("version"), F.lit(False).alias("compressed"))
    for size, want in ((150 << 20, True), (400 << 20, False), (50 << 20, False)):
        new = F.struct(F.lit(size).alias("size"), F.lit(2.0).alias("mtime"), F.lit("1").alias("version"))
        assert spark.range(1).select(append.may_append(old, new)).first()[0] is want


def test_append_of_the_tail(spark):
    members = {f"m{i:03d}": bytes([i]) * (i * 37 + 1) for i in range(60)}
    first = tar(dict(list(members.items())[:40]))
    whole, other = tar(members), tar({f"n{i}": b"x" for i in range(60)})
    schema = "archive string, data binary"
    old = archives.files_of(archives.members_of(spark.createDataFrame([("grown", first), ("replaced", first), ("same", first)], schema)))
    now = spark.createDataFrame([("grown", whole), ("replaced", other), ("same", first), ("new", whole)], schema)
    rows, said = append.refresh(old, now, min_bytes=1, min_files=10)
    assert {r.archive: r.read_from > 0 for r in said.collect()} == {"grown": True, "replaced": False, "same": True, "new": False}
    full = archives.files_of(archives.members_of(now))
    assert sorted(map(str, rows.collect())) == sorted(map(str, full.collect()))
    small, _ = append.refresh(old, now)
    assert sorted(map(str, small.collect())) == sorted(map(str, full.collect()))


def test_catalog_life(spark, tmp_path):
    files = archives.files_of(archives.members_of(spark.createDataFrame([("a.tar", tar({"x": b"1"}))], "archive string, data binary"))).drop("archive")
    at = str(tmp_path / "c")
    assert not catalog.exists(spark, at)
    catalog.write(files, at)
    assert catalog.exists(spark, at) and catalog.drop(spark, at) and not catalog.exists(spark, at)
    meta = spark.createDataFrame([("backendName", "tar")], "key string, value string")
    catalog.check_backend(meta, "tar"), catalog.check_backend(meta.limit(0), "zip")
    with pytest.raises(catalog.WrongBackend):
        catalog.check_backend(meta, "zip")


def test_mount_transform(spark):
    rows = spark.createDataFrame([("a.tar", tar({"d/in.tar": tar({"f": b"1"})}))], "archive string, data binary")
    got = archives.recursive(rows, strip=True, mount_transform=("^/d/", "/moved/")).collect()
    assert ("/moved/in", "f") in {(r["path"], r["name"]) for r in got}
