"""Modes, digests, numbers, encodings and names that carry check sums."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

S_IFMT, S_IFREG, S_IFDIR = 0xF000, 0x8000, 0x4000


def is_regular(mode: Column) -> Column:
    return mode.bitwiseAND(S_IFMT) == S_IFREG


def has_dir_bit(mode: Column) -> Column:
    """Bit 14, which sockets and block devices have too."""
    return mode.bitwiseAND(S_IFDIR) != 0


def is_dir(mode: Column) -> Column:
    return mode.bitwiseAND(S_IFMT) == S_IFDIR


def folder_mode(mode: Column) -> Column:
    """Permissions of a folder that shows a file: execute wherever read is."""
    return mode.bitwiseAND(0o777).bitwiseOR(S_IFDIR).bitwiseOR(F.shiftright(mode.bitwiseAND(0o444), 2))


def stat_blocks(size: Column, unit: int = 512) -> Column:
    return ceil_div(size, F.lit(unit))


def ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b) if not isinstance(b, Column) else F.call_function("div", a + b - 1, b)


def crc32_hex(content: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0")


def _hashlib(name: str) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def digest(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else hashlib.new(name, bytes(x)).hexdigest())

    return lambda c: digest(c.cast("binary"))


def digest(name: str, content: Column) -> Column:
    """Hex digest by name: built in where Spark has it, a pandas function for the rest."""
    key = name.lower().replace("_", "-")
    if key in ("md5", "sha1"):
        return getattr(F, key)(content.cast("binary"))
    if key in ("sha224", "sha256", "sha384", "sha512"):
        return F.sha2(content.cast("binary"), int(key[3:]))
    if key == "crc32":
        return crc32_hex(content.cast("binary"))
    if key == "smplayer":
        return smplayer(content.cast("binary"))
    return _hashlib(key.replace("-", "_"))(content)


@F.pandas_udf(StringType())
def smplayer(data: pd.Series) -> pd.Series:
    """Size plus the 64-bit little-endian numbers of the first and last 64 KiB, modulo 2 ** 64."""
    import numpy as np

    def one(x: bytes | None) -> str | None:
        if x is None:
            return None
        parts = [x[: 1 << 16], x[-(1 << 16) :]]
        total = np.uint64(len(x))
        with np.errstate(over="ignore"):
            for p in parts:
                total += np.frombuffer(p[: len(p) // 8 * 8], "<u8").sum(dtype=np.uint64)
        return f"{int(total):016x}"

    return data.map(one)


#: Bytes that are counted at once; numpy takes eight for each.
COUNTED_BYTES = 1 << 20
#: Contents whose histograms are held together.
HISTOGRAMS = 512


def _histogram(x: bytes, lag: int = 0):
    """How often each byte occurs, or with a lag of 1 each difference of neighbours (modulo 256)."""
    import numpy as np

    raw, total = np.frombuffer(x, np.uint8), np.zeros(256, np.int64)
    for at in range(0, len(raw) - lag, COUNTED_BYTES):
        part = raw[at : at + COUNTED_BYTES + lag]
        total += np.bincount(part[1:] - part[:-1] if lag else part, minlength=256)
    return total


@F.pandas_udf(DoubleType())
def entropy(data: pd.Series) -> pd.Series:
    """Shannon entropy of the bytes, in bits."""
    import numpy as np

    def one(x: bytes | None) -> float | None:
        if x is None:
            return None
        counts = _histogram(x)
        p = counts[counts > 0] / max(1, len(x))
        return float(-(p * np.log2(p)).sum()) + 0.0

    return data.map(one)


# Fixed value, which results depend on: n random bytes may lack 8 (1 + m) / (m + n) bits of entropy, with this m.
RANDOM_M = 40


@F.pandas_udf(BooleanType())
def is_random(data: pd.Series) -> pd.Series:
    """Whether two bytes or more are as spread as random ones, and so are the differences of neighbours (modulo 256).

    One histogram of 256 bins a row, for a few rows at once.
    """
    import numpy as np

    out = np.zeros(len(data), bool)
    for at in range(0, len(data), HISTOGRAMS):
        raw = [x or b"" for x in data.iloc[at : at + HISTOGRAMS]]
        verdict = np.array([len(x) for x in raw], np.int64) > 1
        for lag in (0, 1):
            counts = np.stack([_histogram(x, lag) for x in raw])
            n = counts.sum(axis=1, keepdims=True)
            share = counts / np.maximum(n, 1)
            bits = -(share * np.log2(share, where=share > 0, out=np.zeros_like(share))).sum(axis=1)
            verdict &= 8 - bits < 8 * (1 + RANDOM_M) / (RANDOM_M + n[:, 0])
        out[at : at + len(raw)] = verdict
    return pd.Series(out)


def crc_from_name(name: Column) -> Column:
    """Eight hex digits in the last brackets of a name, [] or (), whichever opens later; null if none."""

    def last(c: str) -> Column:
        return F.when(F.instr(name, c) > 0, F.length(name) + 1 - F.instr(F.reverse(name), c)).otherwise(0)

    square, round_ = last("["), last("(")

    def inside(at: Column, close: str) -> Column:
        rest = F.substring(name, at + 1, F.length(name))
        return F.when(F.instr(rest, close) > 0, F.substring(rest, F.lit(1), F.instr(rest, close) - 1))

    found = F.when(square > round_, inside(square, "]")).when(round_ > square, inside(round_, ")"))
    return F.when(found.rlike(r"\A[0-9A-Fa-f]{8}\z"), F.lower(found))


def unbase64_loose(text: Column) -> Column:
    """base64 whose padding may be missing."""
    return F.unbase64(F.rpad(text, (F.floor((F.length(text) + 3) / 4) * 4).cast("int"), "="))


def percent_decode(text: Column) -> Column:
    """%xx decoded; a plus sign stays."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


_DATA_URL = r"(?is)\Adata:([^;,]*)((?:;[^;,]*)*),(.*)\z"


def data_url(url: Column) -> Column:
    """Struct of mime, charset, is_base64 and content of a data URL; null if it is none."""
    params = F.regexp_extract(url, _DATA_URL, 2)
    base64 = F.lower(params).rlike(r";\s*base64\s*\z")
    body = F.regexp_extract(url, _DATA_URL, 3)
    content = F.when(base64, unbase64_loose(F.regexp_replace(percent_decode(body), r"[^A-Za-z0-9+/]", ""))).otherwise(F.encode(percent_decode(body), "UTF-8"))
    mime = F.regexp_extract(url, _DATA_URL, 1)
    charset = F.regexp_extract(params, r"(?i);\s*charset=([^;]*)", 1)
    whole = F.struct(F.when(mime == "", "text/plain").otherwise(mime).alias("mime"), F.when(charset != "", charset).alias("charset"), base64.alias("is_base64"), content.alias("content"))
    return F.when(url.rlike(_DATA_URL), whole)


def octal(text: Column) -> Column:
    """A header's octal number, NULs and blanks round it; null if there are no digits."""
    digits = F.regexp_extract(text, r"([0-7]+)", 1)
    return F.when(digits != "", F.conv(digits, 8, 10).cast("long"))


def version_numbers(version: Column) -> Column:
    """Numbers of a version text, what isn't a digit left out."""
    return F.transform(F.split(version, r"\."), lambda x: F.regexp_replace(x, "[^0-9]", "").cast("int"))


def apply_transform(path: Column, pattern: str, replacement: str) -> Column:
    """Python-style substitution: \\1 and \\g<1> are groups."""
    import re

    return F.regexp_replace(path, F.lit(pattern), F.lit(re.sub(r"\\g<(\w+)>|\\(\d+)", lambda m: "$" + (m[1] or m[2]), replacement.replace("$", r"\$"))))
