"""Bytes that look like another format's mark by chance."""

import gzip
import zlib

from pyspark.sql import functions as F

from cairn.functions import formats
from cairn.sources import archives, writers


def test_tar_whose_first_name_is_a_zlib_header(spark):
    data = [("16.tar", writers.tar([("8000.txt", b"x")])), ("a.zz", zlib.compress(b"x" * 600))]
    df = archives.checked(spark.createDataFrame(data, "archive string, data binary"))
    assert sorted((r.archive, r.formats, r.readable, r.problem) for r in df.collect()) == [("16.tar", ["tar"], True, None), ("a.zz", ["zlib"], True, None)]


def test_ext4_mark_by_chance(spark):
    body = bytearray(b"x" * 2000)
    body[0x438 - 512 : 0x43A - 512] = b"\x53\xef"
    data = [("a.tar", writers.tar([("f", bytes(body))])), ("b.ext4", writers.ext4([("f", b"x")]))]
    df = spark.createDataFrame(data, "archive string, data binary").select("archive", formats.detect(F.col("data")).alias("f"))
    assert sorted((r.archive, r.f) for r in df.collect()) == [("a.tar", ["tar"]), ("b.ext4", ["ext4"])]


def marked(head, make):
    """A compressed stream (stored, so that its bytes are those of the content) with the ext4 mark in its place."""
    body = bytearray(b"x" * 2000)
    body[0x438 - head : 0x43A - head] = b"\x53\xef"
    data = make(bytes(body))
    assert data[0x438:0x43A] == b"\x53\xef"
    return data, bytes(body)


def test_compressed_with_ext4_mark(spark):
    data, body = marked(15, lambda c: gzip.compress(c, 0, mtime=0))
    (r,) = archives.members_of(spark.createDataFrame([("7.gz", data)], "archive string, data binary"), content=True).collect()
    assert (r.name, r.error, bytes(r.content)) == ("7", None, body)


def test_tar_zst_with_ext4_mark(spark):
    import random

    def make(c):
        return writers.WRITERS["tar.zst"]([("f", c)])

    body = bytearray(random.Random(1).randbytes(3000))
    at = 0x438 + 200 - make(bytes(body)).index(body[200:216])  # literals of random bytes are stored as they are
    body[at : at + 2] = b"\x53\xef"
    data = make(bytes(body))
    assert data[0x438:0x43A] == b"\x53\xef"
    (r,) = archives.members_of(spark.createDataFrame([("7.tar.zst", data)], "archive string, data binary"), content=True).collect()
    assert (r.name, r.error, bytes(r.content)) == ("f", None, bytes(body))
