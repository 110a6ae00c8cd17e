"""File formats: extensions and leading bytes, as a table and as Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Format:
    name: str
    category: str
    extensions: tuple[str, ...]
    magic: bytes | None = None


# Formats with their usual extensions and magic bytes.
_COMPRESSED = (
    Format("bzip2", "compressed", ("bz2", "bzip2"), b"BZh"),
    Format("gzip", "compressed", ("gz", "gzip"), b"\x1f\x8b"),
    Format("xz", "compressed", ("xz",), b"\xfd7zXZ\x00"),
    Format("zstandard", "compressed", ("zst", "zstd", "pzstd"), b"\x28\xb5\x2f\xfd"),
    Format("zlib", "compressed", ("zz", "zlib")),
    Format("deflate", "compressed", ("deflate",)),
    Format("grzip", "compressed", ("grz", "grzip"), b"GRZipII\x00\x02\x04:)"),
    Format("lrzip", "compressed", ("lrz", "lrzip"), b"LRZI\x00"),
    Format("lz4", "compressed", ("lz4",), b"\x04\x22\x4d\x18"),
    Format("lzip", "compressed", ("lz", "lzip"), b"LZIP\x01"),
    Format("lzma", "compressed", ("lzma",), b"\x5d\x00\x00"),
    Format("lzop", "compressed", ("lzo", "lzop"), b"\x89LZO\x00\r\n\x1a\n"),
    Format("rpm", "compressed", ("rpm",), b"\xed\xab\xee\xdb"),
    Format("uu", "compressed", ("uu",), b"begin "),
    Format("compress", "compressed", ("Z",), b"\x1f\x9d"),
)
_TAR_SHORT = ("tar", "tb2", "tbz", "tbz2", "tz2", "taz", "tgz", "txz", "tzst", "cbt")
_TAR = _TAR_SHORT + tuple(p + e for p in ("t", "tar.") for f in _COMPRESSED for e in f.extensions)
FORMATS: tuple[Format, ...] = _COMPRESSED + (
    Format("7z", "archive", ("7z", "7zip", "cb7"), b"7z\xbc\xaf\x27\x1c"),
    Format("rar", "archive", ("rar", "cbr"), b"Rar!\x1a\x07"),
    Format("zip", "archive", ("zip", "cbz"), b"PK\x03\x04"),
    Format("sqlar", "archive", ("sqlar",), b"SQLite format 3\x00"),
    Format("cab", "archive", ("cab",), b"MSCF"),
    Format("aix-small", "archive", ("ar",), b"<aiaff>\n"),
    Format("ar", "archive", ("a", "ar", "lib", "deb"), b"!<arch>\n"),
    Format("ar-thin", "archive", ("a", "ar", "lib"), b"!<thin>\n"),
    Format("xar", "archive", ("xar",), b"xar!"),
    Format("cpio", "archive", ("cpio",), b"07070"),
    Format("tar", "archive", _TAR),
    Format("asar", "archive", ("asar",), b"\x04\x00\x00\x00"),
    Format("squashfs", "archive", ("squashfs", "AppImage", "snap"), b"hsqs"),
    Format("iso9660", "disk", ("iso",)),
    Format("fat", "disk", ("fat", "img", "dd", "fat12", "fat16", "fat32", "raw")),
    Format("ext4", "disk", ("ext4", "img", "dd", "raw")),
    Format("warc", "document", ("warc",), b"WARC/1."),
    Format("html", "document", ("html", "htm")),
    Format("pdf", "document", ("pdf",), b"%PDF-"),
    Format("catalog", "document", ("index.sqlite",), b"SQLite format 3\x00"),
    Format("avi", "multimedia", ("avi",), b"RIFF"),
    Format("mkv", "multimedia", ("mkv", "mka", "mks", "mk3d", "webm"), b"\x1a\x45\xdf\xa3"),
    Format("mp4", "multimedia", ("mp4",), b"ftypMSNV"),
    Format("rmvb", "multimedia", ("rmvb", "rmb"), b".RMF"),
    Format("ogg", "multimedia", ("ogm", "ogv"), b"OggS\x00"),
)


def table(spark: SparkSession) -> DataFrame:
    """(name, extension, magic, category), a row for each extension."""
    rows = [(f.name, e, bytearray(f.magic) if f.magic else None, f.category) for f in FORMATS for e in f.extensions]
    return spark.createDataFrame(rows, "name string, extension string, magic binary, category string")


def by_extension(name: Column, category: str | None = None) -> Column:
    """Names of all formats one of whose extensions ends the name, in the table's order."""
    tests = []
    for f in FORMATS:
        if category in (None, f.category):
            ends = "|".join(re.escape(e.lower()) for e in sorted(set(f.extensions)))
            tests.append(F.when(F.lower(name).rlike(rf"\.({ends})\z"), F.lit(f.name)))
    return F.array_compact(F.array(*tests))


def _starts(content: Column, magic: bytes) -> Column:
    return F.substring(content, 1, len(magic)) == F.lit(bytearray(magic))


def _number(content: Column, at: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("long")


def is_tar(content: Column) -> Column:
    """A first header block with the ustar mark, or whose check sum holds; bytes are summed only where there is a sum to compare with."""
    mark = F.substring(content, 258, 5) == F.lit(bytearray(b"ustar"))
    field = F.regexp_extract(F.decode(F.substring(content, 149, 8), "ISO-8859-1"), r"\A[ \x00]*([0-7]+)", 1)
    text = F.hex(F.substring(content, 1, 512))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(511)), F.lit(0).cast("long"), lambda a, i: a + F.when((i >= 148) & (i < 156), 32).otherwise(F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("long")))
    return F.when(F.octet_length(content) < 512, False).when(mark, True).when(field == "", False).otherwise(F.conv(field, 8, 10).cast("long") == total)


def is_html(content: Column) -> Column:
    head = F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    return head.rlike(r"\A[\s\x00-\x20]*(<!--.*?-->\s*)*<(!doctype\s+html|html|head|body)")


def is_zlib(content: Column) -> Column:
    """Deflate method, window of at most 32 KiB and a header divisible by 31; not a TAR, whose first name may begin so ("80")."""
    first = _number(content, 1, 1)
    return F.when((first.bitwiseAND(15) == 8) & (first <= 0x78) & (_number(content, 1, 2) % 31 == 0), ~is_tar(content)).otherwise(False)


def is_iso9660(content: Column) -> Column:
    return F.substring(content, 32770, 5) == F.lit(bytearray(b"CD001"))


def is_ext4(content: Column) -> Column:
    """The mark of a superblock, which other contents hold by chance, with a block size of at most 64 KiB and revision 0 or 1."""
    marked = F.substring(content, 1081, 2) == F.lit(bytearray(b"\x53\xef"))
    small = [(_number(content, at, 1) <= most) & (F.substring(content, at + 1, 3) == F.lit(bytearray(3))) for at, most in ((1049, 6), (1101, 1))]
    return marked & small[0] & small[1]


def is_fat(content: Column) -> Column:
    return (F.substring(content, 511, 2) == F.lit(bytearray(b"\x55\xaa"))) & ((F.substring(content, 55, 3) == F.lit(bytearray(b"FAT"))) | (F.substring(content, 83, 3) == F.lit(bytearray(b"FAT"))))


def is_avi(content: Column) -> Column:
    return _starts(content, b"RIFF") & (F.substring(content, 9, 4) == F.lit(bytearray(b"AVI ")))


def is_asar(content: Column) -> Column:
    return _starts(content, b"\x04\x00\x00\x00") & (F.substring(content, 17, 1) == F.lit(bytearray(b"{")))


_CHECKS = {"tar": is_tar, "html": is_html, "zlib": is_zlib, "iso9660": is_iso9660, "ext4": is_ext4, "fat": is_fat, "avi": is_avi, "asar": is_asar}


def detect(content: Column) -> Column:
    """Names of all formats whose leading bytes and header check fit, in the table's order."""
    tests = []
    for f in FORMATS:
        check = _CHECKS.get(f.name)
        if check or f.magic:
            fits = check(content) if check else _starts(content, f.magic)
            if f.name == "mp4":
                fits = F.substring(content, 5, 8) == F.lit(bytearray(f.magic))
            tests.append(F.when(fits, F.lit(f.name)))
    return F.array_compact(F.array(*tests))


def squashfs_offset(content: Column) -> Column:
    """Place of a little-endian superblock mark in the first MiB, -1 if there is none."""
    at = F.instr(F.hex(F.substring(content, 1, 1 << 20)), F.hex(F.lit(bytearray(b"hsqs"))))
    return F.when(at > 0, F.floor((at - 1) / 2)).otherwise(-1).cast("long")


# --- suffix rules ---------------------------------------------------------------------------


@dataclass(frozen=True)
class SuffixRule:
    include: bool
    pattern: str  # a Java regular expression for the suffix, dot and all


def suffix_rules(patterns: list[str]) -> list[SuffixRule]:
    """Globs such as 'bz2', '/archive/' for a category, a trailing '/-' for exclusion; in order."""
    import fnmatch

    out: list[SuffixRule] = []
    pending: list[str] = []
    sign = True

    def regex(glob: str) -> str:
        glob = glob if glob.startswith(".") else "." + glob
        return fnmatch.translate(glob).removesuffix(r"\z").removesuffix(r"\Z")

    def close() -> None:
        if pending:
            out.append(SuffixRule(sign, "|".join(map(regex, pending))))
            pending.clear()

    for p in patterns:
        negations = 0
        while p.endswith("/-"):
            p, negations = p[:-2], negations + 1
        include = negations % 2 == 0
        category = p.strip("/") if p.startswith("/") else ""
        if include != sign or category == "split":
            close()
            sign = include
        if category == "split":
            out.append(SuffixRule(include, r"\.(?:0*[01]|a+|0*[01a])"))
        elif category:
            pending += [e for f in FORMATS if f.category == category for e in f.extensions]
        else:
            pending.append(p)
    close()
    return out


def strip_suffix(path: Column, rules: list[SuffixRule]) -> Column:
    """The path without the longest suffix that a rule includes; an excluding rule restores it."""
    name = F.substring_index(path, "/", -1)
    head = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    now = name
    for r in rules:
        hit = name.rlike(rf"(?i)(?:{r.pattern})\z")
        if not r.include:
            now = F.when(hit, name).otherwise(now)
            continue
        stem = F.regexp_extract(name, rf"(?is)\A(.*?)(?:{r.pattern})\z", 1)
        better = (now == name) | ((now == "") & (stem != name)) | ((stem != "") & (F.length(stem) < F.length(now)))
        now = F.when(hit & better, stem).otherwise(now)
    return F.concat(head, now)
