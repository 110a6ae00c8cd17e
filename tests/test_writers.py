"""Every writer beside its parser, and damaged archives."""

import random
import struct
import tarfile
import zipfile
import io

import pytest
from pyspark.sql import functions as F

from cairn.sources import archives, images, parsers, writers

FILES = [("0a.txt", b"hello"), ("0b.txt", b""), ("0c.txt", bytes(range(256)) * 700), ("0d is a name that is much longer than eight and three.txt", "ä ß".encode() * 9)]


SINGLE = {"gz", "bz2", "xz", "zst", "zz", "lz4", "lz", "Z", "uu"}


@pytest.mark.parametrize("kind", sorted(SINGLE))
def test_single_files(kind):
    (r,) = parsers.parse(writers.WRITERS[kind](FILES[2:3]), f"0c.txt.{kind}", {})
    assert (r["name"], r["content"], r["size"], r["offsetheader"]) == ("0c.txt", FILES[2][1], len(FILES[2][1]), None)


@pytest.mark.parametrize("kind", sorted(set(writers.WRITERS) - SINGLE))
def test_round_trip(kind):
    files = [(f"{i:08x}", c) for i, (_, c) in enumerate(FILES)] if kind == "ogg" else FILES
    data = writers.WRITERS[kind](files)
    got = list(parsers.parse(data, f"a.{kind}", {}))
    bare = list(parsers.parse(data, f"a.{kind}", {"content": False}))
    assert [(r["path"], r["name"], r["size"]) for r in got] == [(r["path"], r["name"], r["size"]) for r in bare]
    if kind == "ogg":
        assert [r["name"] for r in got] == [f"unknown_{n}.ogg" for n, _ in files] and sum(r["size"] for r in got) == len(data)
        return
    assert sorted((r["name"], r["size"]) for r in got) == sorted((n, len(c)) for n, c in files)
    if kind != "catalog":
        assert sorted((r["name"], r["content"]) for r in got) == sorted(files)
    if kind in ("tar", "zip", "sqlar", "7z", "xar", "cab", "iso", "fat", "squashfs", "rar", "cpio", "ext4", "pdf"):
        assert all(r["content"] is None for r in bare)


def test_many_files_in_images():
    rng = random.Random(1)
    files = [(f"file {i:04d}.bin", rng.randbytes(rng.randrange(3000))) for i in range(700)]
    for kind in ("squashfs", "iso", "fat", "7z", "cab", "ext4", "pdf"):
        assert sorted((r["name"], r["content"]) for r in parsers.parse(writers.WRITERS[kind](files), "x", {})) == files, kind


def test_what_was_read_of_damaged_archives_stays(spark):
    data = writers.tar(FILES)
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        third = t.getmembers()[2].offset_data
    z = bytearray(writers.zip_([("a", b"one" * 50), ("b", b"two" * 50)]))
    with zipfile.ZipFile(io.BytesIO(bytes(z))) as a:
        i = a.infolist()[0]
    z[i.header_offset + 30 + len(i.filename) + 2] ^= 0xFF
    ar = writers.ar(FILES[:3])
    rows = [("t.tar", data[: third + 100]), ("z.zip", bytes(z)), ("x.a", ar[:-200]), ("none", b"?")]
    got = archives.members_of(spark.createDataFrame(rows, "archive string, data binary"), content=True).collect()
    by = {a: [r for r in got if r.archive == a] for a, _ in rows}
    assert [r["name"] for r in by["t.tar"]][:2] == ["0a.txt", "0b.txt"] and by["t.tar"][-1].error
    assert [r["name"] for r in by["z.zip"]] == ["a", "b", ""] and by["z.zip"][1].content == b"two" * 50 and by["z.zip"][2].error
    assert [r["name"] for r in by["x.a"]] == ["0a.txt", "0b.txt", ""] and by["none"][0].error


def test_names_that_are_not_text(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT, errors="surrogateescape") as t:
        i = tarfile.TarInfo(b"caf\xe9.txt".decode("utf-8", "surrogateescape"))
        t.addfile(i, io.BytesIO())
        t.addfile(tarfile.TarInfo("plain"), io.BytesIO())
    rows = archives.members_of(spark.createDataFrame([("a.tar", out.getvalue())], "archive string, data binary")).collect()
    assert [r["name"] for r in rows] == ["caf\\xe9.txt", "plain"] and all(r.error is None for r in rows)


def test_equal_urls_have_places_of_their_own():
    url = "data:text/plain;base64,aGVsbG8="
    page = f'<!DOCTYPE html><html>\n<a href="{url}">x</a>\n<a href="{url}">y</a>'
    got = [r["offset"] for r in parsers.parse(page.encode(), "p.html", {})]
    assert got == [i for i in range(len(page)) if page.startswith(url, i)] and len(got) == 2


def test_nested_archives_of_any_depth(spark):
    data = b"deep"
    for i in range(11):
        data = writers.tar([(f"n{i}.tar" if i else "leaf.txt", data)])
    bad = writers.tar([("bad.zip", b"PK\x03\x04nonsense"), ("ok", b"1")])
    rows = archives.recursive(spark.createDataFrame([("a.tar", data), ("b.tar", bad)], "archive string, data binary")).collect()
    assert max(r.recursiondepth or 0 for r in rows) == 10 and any(r["name"] == "leaf.txt" for r in rows)
    assert [r.path for r in rows if r.error and r.archive == "b.tar"] == ["/bad.zip"]


def test_fat_twelve_and_cut_off_images():
    data = writers.fat(FILES[:2])
    with pytest.raises((ValueError, struct.error, IndexError)):
        list(images.fat(data[:300], {}))
    for kind in ("xar", "cab", "7z", "squashfs", "iso"):
        with pytest.raises(Exception):
            list(parsers.PARSERS[{"iso": "iso9660"}.get(kind, kind)](writers.WRITERS[kind](FILES)[:40], {}))


def test_pack_and_read(spark):
    files = spark.range(40).select(F.concat("id", F.lit(".txt")).alias("name"), F.repeat(F.col("id").cast("string"), 5).cast("binary").alias("content"))
    packed = writers.pack(files, F.floor(F.regexp_extract("name", r"\d+", 0).cast("int") / 7), "tar")
    got = archives.members_of(packed, content=True).collect()
    assert {(r["name"], r.content.decode()) for r in got} == {(f"{i}.txt", str(i) * 5) for i in range(40)} and len({r.archive for r in got}) == 6


def test_codecs_beside_what_they_wrote():
    rng = random.Random(5)
    from cairn.sources import codecs

    text = " ".join(f"word{rng.randrange(300)}" for _ in range(60_000)).encode()
    for data in (b"", b"a", text, rng.randbytes(150_000)):
        for name in ("lz4", "lzip", "compress", "uu"):
            assert codecs.decompress(getattr(writers, name)(data)) == data, name
        assert codecs.decompress(writers.zstd_frames(data, 1000)) == data
    import zlib

    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = raw.compress(text) + raw.flush()
    (r,) = parsers.parse(packed, "t.txt.deflate", {})
    assert (r["name"], r["content"]) == ("t.txt", text)
    head = b"\x8e\xad\xe8\x01" + bytes(4) + struct.pack(">II", 1, 3) + bytes(16) + b"abc"
    package = b"\xed\xab\xee\xdb".ljust(96, b"\0") + head + bytes(-(96 + len(head)) % 8) + head + writers._zstd(writers.cpio(FILES))
    assert sorted((r["name"], r["content"]) for r in parsers.parse(package, "a.rpm", {})) == sorted(FILES)
