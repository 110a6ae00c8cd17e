"""Cases that the driver's tables do not hold: nulls, modes, links, overlays, names."""

from pyspark.sql import functions as F

from cairn.functions import formats, paths, values
from cairn.operators import attributes, compose, intervals, sequences, tree, versions
from cairn.plans import analytics


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_null_offsets(spark):
    df = spark.createDataFrame([("/a", "x", None, 1), ("/a", "x", None, 2), ("/a", "x", 5, 3), ("/a", "x", 5, 4)], "path string, name string, offsetheader long, ingest_seq int")
    assert rows(versions.upsert(df).select("ingest_seq")) == [(1,), (2,), (4,)]
    assert rows(versions.lookup(df.where("ingest_seq > 2"), 1).select("offsetheader")) == [(5,)]
    only_null = df.where("offsetheader is null and ingest_seq = 1")
    assert versions.listing(only_null, "/a").count() == 1  # a member whose only version has no offset
    assert versions.lookup_path(df.where("ingest_seq in (1, 4)"), "/a", "x", 1).first().offsetheader is None


def test_empty_catalog(spark):
    df = spark.createDataFrame([], "path string, name string, offsetheader long, offset long, mode int, size long, ingest_seq long")
    assert versions.lookup(df).count() == 0
    assert tree.with_parents(df).count() == 0
    assert rows(versions.file_count(df)) == [(0,)]
    assert tree.folder_sizes(df).count() == 0


def test_modes(spark):
    df = spark.createDataFrame([(0o100644,), (0o040755,), (0o120777,), (0o140755,), (0o060640,)], "mode int")
    m = F.col("mode")
    assert [r[0] for r in df.select(values.is_regular(m)).collect()] == [True, False, False, False, False]
    assert [r[0] for r in df.select(values.has_dir_bit(m)).collect()] == [False, True, False, True, True]
    assert [r[0] for r in df.select(values.is_dir(m)).collect()] == [False, True, False, False, False]


def test_hard_links(spark):
    links = [("", "a", 1, "b"), ("", "b", 2, "c"), ("", "c", 3, ""), ("", "p", 1, "q"), ("", "q", 2, "p"), ("", "s", 1, ""), ("", "s", 9, "s")]
    df = spark.createDataFrame(links, "path string, name string, offsetheader long, linkname string")
    got = {(r["name"], r["offsetheader"]): (r["target"], r["target_offset"]) for r in compose.resolve_links(df).collect()}
    assert got[("a", 1)] == ("/c", 3) and got[("c", 3)] == ("/c", 3)
    assert got[("p", 1)][0] is None  # a cycle ends nowhere
    assert got[("s", 9)] == ("/s", 1)  # a link to itself is the version before


def test_crc_names(spark):
    names = ["a [01234567].mkv", "b (89abcdef) [x].mkv", "c [0123456].mkv", "d [01234567", "e (x) [DEADBEEF].mkv", "f [DEADBEEF].srt", "g"]
    df = spark.createDataFrame([("/v", n, i) for i, n in enumerate(names)], "path string, name string, offsetheader long")
    got = [r[0] for r in df.orderBy("offsetheader").select(values.crc_from_name(F.col("name"))).collect()]
    assert got == ["01234567", None, None, None, "deadbeef", "deadbeef", None]
    x = df.select("offsetheader", F.lit("user.hash.crc32").alias("key"), F.lit(b"01234567").alias("value"))
    assert rows(analytics.crc_mismatches(df, x)) == [("/v/e (x) [DEADBEEF].mkv", "deadbeef", "01234567")]


def test_unbacked_files(spark):
    f = "path string, name string, offsetheader long, mode int"
    main = spark.createDataFrame([("/a", "x", 1, 0o100644), ("", "a", 1, 0o040755), ("/a", "y", 2, 0o100644), ("/a", "z", 3, 0o100644)], f)
    x = "offsetheader long, key string, value binary"
    mx = spark.createDataFrame([(1, "user.hash.sha256", b"s1"), (2, "user.hash.sha256", b"s2")], x)
    other = spark.createDataFrame([("", "k", 7, 0o100644)], f), spark.createDataFrame([(7, "user.hash.sha256", b"s2")], x)
    assert rows(analytics.unbacked_files(main, mx, [other])) == [("/a/x", 0)]
    assert rows(analytics.unbacked_files(main, mx, [other], any_kind=True)) == [("/a", 0), ("/a/x", 0)]


def test_overlay_and_rmdir(spark):
    base = spark.createDataFrame([("", "d", 0o040755), ("/d", "f", 0o100644), ("", "e", 0o040755)], "path string, name string, mode int").selectExpr("path", "name", "1.0d as mtime", "mode", "0 as uid", "0 as gid")
    ov = spark.createDataFrame([("/d", "f", None, None, None, None, True)], "path string, name string, mtime double, mode int, uid int, gid int, deleted boolean")
    assert rows(compose.overlay_merge(base, ov).select("path", "name")) == [("", "d"), ("", "e")]
    assert rows(compose.removable_folders(base, ov)) == [("", "d"), ("", "e")]
    assert rows(compose.removable_folders(base, ov.limit(0))) == [("", "e")]


def test_split_sequences(spark):
    names = ["v.001", "v.002", "v.004", "w.aa", "w.ab", "w.ac", "u.02", "t.00", "t.01"]
    df = spark.createDataFrame([("", n) for n in names], "path string, name string")
    got = {r["base"]: (r["alphabet"], r["first"], r["parts"]) for r in sequences.split_sequences(df).collect()}
    assert got == {"v": ("decimal", 1, 2), "w": ("alpha", 0, 3), "t": ("decimal", 0, 2)}


def test_paths(spark):
    df = spark.createDataFrame([("",), ("/a",), ("/a/b/c",)], "p string")
    assert [[(x["path"], x["name"]) for x in r[0]] for r in df.select(paths.ancestors("p")).collect()] == [[], [("", "a")], [("", "a"), ("/a", "b"), ("/a/b", "c")]]
    assert [r[0] for r in df.select(paths.prefixes("p")).collect()] == [[""], ["", "/a"], ["", "/a", "/a/b", "/a/b/c"]]
    assert spark.range(30).where("id = 27").select(paths.format_number("id", "abcdefghijklmnopqrstuvwxyz", 2)).first()[0] == "bb"


def test_digests(spark):
    df = spark.createDataFrame([(bytearray(b"foo\n"),), (None,)], "c binary")
    c = F.col("c")
    got = df.select(*(values.digest(n, c).alias(n) for n in ("crc32", "sha256", "md5", "sha3-256", "smplayer"))).collect()
    assert got[0]["crc32"] == "7e3265a8" and got[0]["sha256"].startswith("b5bb9d80")
    assert got[1]["sha256"] is None and got[1]["sha3-256"] is None


def test_formats(spark):
    import bz2
    import gzip
    import io
    import tarfile

    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w") as t:
        t.addfile(tarfile.TarInfo("x"))
    df = spark.createDataFrame([(1, bytearray(b.getvalue())), (2, bytearray(gzip.compress(b"x"))), (3, bytearray(bz2.compress(b"x"))), (4, bytearray(b"")), (5, bytearray(b"!<arch>\n"))], "i int, c binary")
    got = {r[0]: r[1] for r in df.select("i", formats.detect(F.col("c"))).collect()}
    assert got[1] == ["tar"] and got[2] == ["gzip"] and got[3] == ["bzip2"] and got[4] == [] and got[5] == ["ar"]
    rules = formats.suffix_rules(["/compressed/", "bz2/-"])
    assert spark.range(1).select(formats.strip_suffix(F.lit("a.bz2"), rules), formats.strip_suffix(F.lit("a.gz"), rules)).first()[:] == ("a.bz2", "a")
    assert formats.table(spark).where("name = 'gzip'").count() == 2


def test_attributes_dictionary(spark):
    x = spark.createDataFrame([(1, "b", b"1"), (1, "a", b"2")], "offsetheader long, key string, value binary")
    keys, data = attributes.dictionary(x)
    assert rows(keys) == [("a", 1), ("b", 2)] and data.count() == 2


def test_parts_and_chunks(spark):
    df = spark.createDataFrame([("a", 2, b"cd"), ("a", 1, b"ab"), ("b", 1, b"x")], "base string, n int, content binary")
    assert rows(intervals.joined_parts(df, ["base"], "n")) == [("a", b"abcd"), ("b", b"x")]
    got = df.where("base = 'b'").select(intervals.chunks(F.lit(b"abcde"), 2).alias("c")).first()["c"]
    assert [bytes(x["data"]) for x in got] == [b"ab", b"cd", b"e"]


def test_digests_beside_hashlib(spark):
    import hashlib
    import zlib

    from cairn.plans import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.queries()["other_hashes"](spark, sf).collect():
        x = texts[r.offsetheader]
        numbers = sum(int.from_bytes(p[k : k + 8], "little") for p in (x[:65536], x[-65536:]) for k in range(0, len(p) - 7, 8))
        want = {"crc32": f"{zlib.crc32(x):08x}", "smplayer": f"{(len(x) + numbers) % 2**64:016x}"}
        want |= {n: hashlib.new(n.replace("-", "_"), x).hexdigest() for n in ("sha224", "sha384", "sha512", "sha3-256", "blake2b")}
        assert all(r[n] == v for n, v in want.items())
