"""Decoders of compressed streams by their leading bytes, in plain Python where the standard library has none."""

from __future__ import annotations

import binascii
import bz2
import gzip
import io
import lzma
import struct
import zlib
from collections.abc import Callable


def zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()


def lz4(data: bytes) -> bytes:
    """LZ4 frames."""
    import pyarrow as pa

    return pa.CompressedInputStream(pa.BufferReader(data), "lz4").read()


def lzip(data: bytes) -> bytes:
    """Members of LZMA with a fixed model; the size of each is in its last bytes, so they are found from the end."""
    members, end = [], len(data)
    while end:
        size = struct.unpack("<Q", data[end - 8 : end])[0]
        member = data[end - size : end]
        if size < 26 or size > end or member[:5] != b"LZIP\x01":
            raise ValueError("damaged lzip member")
        base = 1 << (member[5] & 31)
        filters = [{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": base - base // 16 * (member[5] >> 5)}]
        crc, length = struct.unpack("<IQ", member[-20:-8])
        plain = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(member[6:-20], length)
        if zlib.crc32(plain) != crc or len(plain) != length:
            raise ValueError("lzip check sum differs")
        members.append(plain)
        end -= size
    return b"".join(reversed(members))


def compress(data: bytes) -> bytes:
    """LZW as the Unix program compress writes it: codes of 9 bits and up, lowest bit first, in groups of eight."""
    most, block = data[2] & 31, bool(data[2] & 128)
    table: list[bytes] = []

    def fresh() -> list[bytes]:
        return [bytes([i]) for i in range(256)] + [b""] * block

    table = fresh()
    width, out, before = 9, [], b""
    bit, total, group = 0, (len(data) - 3) * 8, 0
    number = int.from_bytes
    while bit + width <= total:
        at = 3 + bit // 8
        code = number(data[at : at + 4], "little") >> bit % 8 & ((1 << width) - 1)
        bit += width
        group += 1
        if block and code == 256:
            bit += -group % 8 * width  # the rest of the group is not used
            table, width, before, group = fresh(), 9, b"", 0
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise ValueError("damaged LZW stream")
        out.append(entry)
        if before and len(table) < 1 << most:
            table.append(before + entry[:1])
            if len(table) == 1 << width and width < most:
                bit += -group % 8 * width
                width, group = width + 1, 0
        before = entry
    return b"".join(out)


def uu(data: bytes) -> bytes:
    lines = data.split(b"\n")
    return b"".join(binascii.a2b_uu(x.rstrip(b"\r")) for x in lines[1 : next(i for i, x in enumerate(lines) if x.strip() == b"end")] if x.strip(b"`\r "))


def deflate(data: bytes) -> bytes:
    return zlib.decompress(data, -15)


def rpm(data: bytes) -> bytes:
    """The payload of an RPM package, inflated: a CPIO archive."""
    at = 96
    for _ in range(2):  # signature, then header
        if data[at : at + 3] != b"\x8e\xad\xe8":
            raise ValueError("damaged RPM header")
        entries, size = struct.unpack(">II", data[at + 8 : at + 16])
        at += 16 + 16 * entries + size
        if _ == 0:
            at += -at % 8
    payload = data[at:]
    return decompress(payload) or payload


#: Leading bytes and decoder; raw deflate has none and is only tried by name.
DECODERS: tuple[tuple[bytes, Callable[[bytes], bytes]], ...] = (
    (b"\x1f\x8b", gzip.decompress), (b"BZh", bz2.decompress), (b"\xfd7zXZ\x00", lzma.decompress), (b"\x28\xb5\x2f\xfd", zstd), (b"\x5d\x00\x00", lzma.decompress),
    (b"\x04\x22\x4d\x18", lz4), (b"LZIP\x01", lzip), (b"\x1f\x9d", compress), (b"\xed\xab\xee\xdb", rpm), (b"begin ", uu),
)
#: Extensions of compressed single files.
SUFFIX = r"(?i)\.(gz|gzip|bz2|bzip2|xz|zst|zstd|zz|zlib|lzma|lz4|lz|lzip|z|rpm|uu|deflate)$"


def is_zlib(data: bytes) -> bool:
    return len(data) > 2 and data[0] & 15 == 8 and data[0] <= 0x78 and (data[0] << 8 | data[1]) % 31 == 0


def known(data: bytes) -> bool:
    return is_zlib(data) or any(data.startswith(m) for m, _ in DECODERS)


def decompress(data: bytes, name: str = "") -> bytes | None:
    """The content of a compressed stream; None if it is none that is known."""
    for magic, decode in DECODERS:
        if data.startswith(magic):
            return decode(data)
    if is_zlib(data):
        return zlib.decompress(data)
    return deflate(data) if name.lower().endswith(".deflate") else None
