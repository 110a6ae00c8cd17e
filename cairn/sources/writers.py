"""Archives from files: the sinks beside parsers.  Each writer takes (name, content) pairs and gives the bytes of one archive."""

from __future__ import annotations

import base64
import binascii
import bz2
import gzip
import io
import json
import lzma
import os
import sqlite3
import struct
import tarfile
import tempfile
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from ..functions.batches import small_batches

Files = list[tuple[str, bytes]]
Writer = Callable[[Files], bytes]

#: Modification time of all members: 2020-01-01.
MTIME = 1_577_836_800


def tar(files: Files) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for name, content in files:
            i = tarfile.TarInfo(name)
            i.size, i.mtime = len(content), MTIME
            t.addfile(i, io.BytesIO(content))
    return out.getvalue()


def tar_gz(files: Files) -> bytes:
    return gzip.compress(tar(files), mtime=MTIME)


def tar_xz(files: Files) -> bytes:
    return lzma.compress(tar(files))


def tar_zst(files: Files) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(tar(files))


def zip_(files: Files) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files:
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


def ar(files: Files) -> bytes:
    """GNU names: long ones are in a member of their own."""

    def member(name: str, content: bytes) -> bytes:
        return f"{name:<16}{MTIME:<12}{0:<6}{0:<6}{'100644':<8}{len(content):<10}`\n".encode() + content + b"\n" * (len(content) % 2)

    names, body = b"", []
    for name, content in files:
        if len(name.encode()) > 15:
            body.append(member(f"/{len(names)}", content))
            names += name.encode() + b"/\n"
        else:
            body.append(member(f"{name}/", content))
    return b"".join([b"!<arch>\n", member("//", names) if names else b"", *body])


def asar(files: Files) -> bytes:
    tree: dict = {"files": {}}
    at = 0
    for name, content in files:
        now = tree
        *folders, last = name.split("/")
        for f in folders:
            now = now["files"].setdefault(f, {"files": {}})
        now["files"][last] = {"offset": str(at), "size": len(content)}
        at += len(content)
    head = json.dumps(tree).encode()
    pad = -len(head) % 4
    return struct.pack("<4I", 4, len(head) + pad + 8, len(head) + pad + 4, len(head)) + head + bytes(pad) + b"".join(c for _, c in files)


def _sqlite(fill: Callable[[sqlite3.Connection], None]) -> bytes:
    with tempfile.TemporaryDirectory() as folder:
        file = os.path.join(folder, "a")
        con = sqlite3.connect(file)
        with con:
            fill(con)
        con.close()
        with open(file, "rb") as f:
            return f.read()


def sqlar(files: Files) -> bytes:
    def fill(con: sqlite3.Connection) -> None:
        con.execute("CREATE TABLE sqlar(name TEXT PRIMARY KEY, mode INT, mtime INT, sz INT, data BLOB)")
        for name, content in files:
            packed = zlib.compress(content)
            con.execute("INSERT INTO sqlar VALUES (?, ?, ?, ?, ?)", (name, 0o100644, MTIME, len(content), packed if len(packed) < len(content) else content))

    return _sqlite(fill)


def catalog(files: Files) -> bytes:
    """A catalog of files, without their contents, in SQLite."""

    def fill(con: sqlite3.Connection) -> None:
        con.execute("CREATE TABLE files(path VARCHAR(65535) NOT NULL, name VARCHAR(65535) NOT NULL, offsetheader INTEGER, offset INTEGER, size INTEGER, mtime REAL, mode INTEGER, type INTEGER, linkname VARCHAR(65535))")
        for i, (name, content) in enumerate(files):
            path, _, last = ("/" + name).rpartition("/")
            con.execute("INSERT INTO files VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", (path, last, i, i, len(content), float(MTIME), 0o100644, 0, ""))

    return _sqlite(fill)


def cpio(files: Files) -> bytes:
    out = b""
    for i, (name, content) in enumerate([*files, ("TRAILER!!!", b"")]):
        raw = name.encode() + b"\0"
        head = b"070701" + b"".join(b"%08X" % x for x in (i + 1, 0o100644, 0, 0, 1, MTIME, len(content), 0, 0, 0, 0, len(raw), 0))
        out += head + raw + bytes(-(len(head) + len(raw)) % 4) + content + bytes(-len(content) % 4)
    return out


def warc(files: Files) -> bytes:
    parts = []
    for name, content in files:
        parts.append(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: file://{name}\r\nContent-Length: {len(content)}\r\n\r\n".encode() + content + b"\r\n\r\n")
    return b"".join(parts)


def html(files: Files) -> bytes:
    links = (f'<a href="data:text/plain;base64,{base64.b64encode(c).decode()}" data-savepage-href="http://host/{escape(n)}">{escape(n)}</a>' for n, c in files)
    return ("<!DOCTYPE html><html><body>" + "\n".join(links) + "</body></html>").encode()


def ogg(files: Files) -> bytes:
    """One stream for each file, whose name is its serial number in hex; contents are a page each 255 segments long at most."""
    out = []
    for name, content in files:
        serial, number = int(name, 16), 0
        for at in range(0, max(1, len(content)), 255 * 255):
            part = content[at : at + 255 * 255]
            segments = bytes([255] * (len(part) // 255)) + (bytes([len(part) % 255]) if len(part) < 255 * 255 else b"")
            out.append(b"OggS\0" + bytes([0 if number else 2]) + bytes(8) + struct.pack("<III", serial, number, 0) + bytes([len(segments)]) + segments + part)
            number += 1
    return b"".join(out)


def xar(files: Files) -> bytes:
    heap, toc = b"", []
    for i, (name, content) in enumerate(files):
        packed = zlib.compress(content)
        toc.append(
            f'<file id="{i + 1}"><name>{escape(name)}</name><type>file</type><mode>0644</mode><mtime>2020-01-01T00:00:00Z</mtime><data><length>{len(packed)}</length>'
            f'<offset>{len(heap)}</offset><size>{len(content)}</size><encoding style="application/x-gzip"/></data></file>'
        )
        heap += packed
    plain = ('<?xml version="1.0"?><xar><toc>' + "".join(toc) + "</toc></xar>").encode()
    packed = zlib.compress(plain)
    return struct.pack(">4sHHQQI", b"xar!", 28, 1, len(packed), len(plain), 0) + packed + heap


def cab(files: Files) -> bytes:
    """One MSZIP folder."""
    whole, entries = b"".join(c for _, c in files), b""
    at = 0
    for name, content in files:
        entries += struct.pack("<IIHHHH", len(content), at, 0, 40 << 9 | 1 << 5 | 1, 0, 0x80) + name.encode() + b"\0"
        at += len(content)
    blocks, before = [], b""
    for at in range(0, len(whole), 32768):
        part = whole[at : at + 32768]
        c = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=before) if before else zlib.compressobj(9, zlib.DEFLATED, -15)
        packed = b"CK" + c.compress(part) + c.flush()
        blocks.append(struct.pack("<IHH", 0, len(packed), len(part)) + packed)
        before = part
    start = 36 + 8
    body = b"".join(blocks)
    head = struct.pack("<4sIIIIIBBHHHHH", b"MSCF", 0, start + len(entries) + len(body), 0, start, 0, 3, 1, 1, len(files), 0, 0, 0)
    return head + struct.pack("<IHH", start + len(entries), len(blocks), 1) + entries + body


def sevenzip(files: Files) -> bytes:
    """One solid LZMA2 folder; empty files have no stream."""

    def number(n: int) -> bytes:
        for i in range(8):
            if n < 1 << 7 * (i + 1):
                return bytes([0xFF << 8 - i & 0xFF | n >> 8 * i]) + (n & (1 << 8 * i) - 1).to_bytes(i, "little")
        return b"\xff" + n.to_bytes(8, "little")

    full = [c for _, c in files if c]
    whole = b"".join(full)
    packed = lzma.compress(whole, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}])
    head = b"\x01"
    if full:
        head += b"\x04\x06" + number(0) + number(1) + b"\x09" + number(len(packed)) + b"\0"
        head += b"\x07\x0b" + number(1) + b"\0" + number(1) + b"\x21\x21\x01" + bytes([16]) + b"\x0c" + number(len(whole)) + b"\0"
        head += b"\x08\x0d" + number(len(full)) + b"\x09" + b"".join(number(len(c)) for c in full[:-1])
        head += b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(c)) for c in full) + b"\0\0"
    names = b"\0" + "".join(f"{n}\0" for n, _ in files).encode("utf-16-le")
    bits = bytearray(-(-len(files) // 8))
    for i, (_, c) in enumerate(files):
        if not c:
            bits[i // 8] |= 0x80 >> i % 8
    head += b"\x05" + number(len(files))
    if len(full) < len(files):
        n = len(files) - len(full)
        head += b"\x0e" + number(len(bits)) + bytes(bits) + b"\x0f" + number(-(-n // 8)) + b"\xff" * (-(-n // 8))
    head += b"\x11" + number(len(names)) + names + b"\0\0"
    start = struct.pack("<QQI", len(packed), len(head), zlib.crc32(head))
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(start)) + start + packed + head


def rar(files: Files) -> bytes:
    """RAR 5 with stored members."""

    def vint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def block(body: bytes) -> bytes:
        body = vint(len(body)) + body
        return struct.pack("<I", zlib.crc32(body)) + body

    out = b"Rar!\x1a\x07\x01\x00" + block(vint(1) + vint(0) + vint(0))
    for name, content in files:
        raw = name.encode()
        own = vint(6) + vint(len(content)) + vint(0o100644) + struct.pack("<II", MTIME, zlib.crc32(content)) + vint(0) + vint(1) + vint(len(raw)) + raw
        out += block(vint(2) + vint(2) + vint(len(content)) + own) + content
    return out + block(vint(5) + vint(0) + vint(0))


def iso(files: Files) -> bytes:
    """One folder, with Rock Ridge names."""

    def record(name: bytes, at: int, size: int, folder: bool, more: bytes = b"") -> bytes:
        n = 33 + len(name) + (len(name) + 1) % 2 + len(more)
        n += n % 2
        out = struct.pack("<BBIIII", n, 0, at, 0, size, 0)
        out = out[:6] + struct.pack(">I", at) + out[10:14] + struct.pack(">I", size) + bytes([120, 1, 1, 0, 0, 0, 0, 2 * folder, 0, 0, 1, 0, 0, 1, len(name)]) + name
        return (out + bytes((len(name) + 1) % 2) + more).ljust(n, b"\0")

    def names(name: bytes) -> bytes:
        parts = [name[k : k + 200] for k in range(0, len(name), 200)] or [b""]
        return b"".join(b"NM" + bytes([5 + len(p), 1, p is not parts[-1]]) + p for p in parts)

    def listing(root_size: int) -> bytes:
        at, out = 19 + -(-root_size // 2048), b""
        out = record(b"\0", 19, root_size, True) + record(b"\1", 19, root_size, True)
        for i, (name, content) in enumerate(files):
            r = record(b"F%07d.;1" % i, at, len(content), False, names(name.encode()))
            if len(out) % 2048 + len(r) > 2048:
                out += bytes(-len(out) % 2048)
            out += r
            at += -(-len(content) // 2048)
        return out + bytes(-len(out) % 2048)

    root = listing(len(listing(0)))
    volume = (b"\1CD001\1\0" + b" " * 32 + b"CAIRN".ljust(32)).ljust(156, b"\0") + record(b"\0", 19, len(root), True)
    end = b"\xffCD001\1".ljust(2048, b"\0")
    body = b"".join(c + bytes(-len(c) % 2048) for _, c in files)
    return bytes(16 * 2048) + volume.ljust(2048, b"\0") + end + bytes(2048) + root + body


def fat(files: Files) -> bytes:
    """FAT16 with one folder and long names."""
    per, sector = 4, 512
    cluster = per * sector
    n_root = -(-sum(2 + -(-(len(n) + 1) // 13) for n, _ in files) // 16) * 16 or 16
    need = sum(-(-len(c) // cluster) for _, c in files)
    clusters = max(need, 4100)
    table = [0xFFF8, 0xFFFF]
    root, body = b"", b""
    for i, (name, content) in enumerate(files):
        first, n = len(table), -(-len(content) // cluster)
        table += [first + k + 1 for k in range(n - 1)] + [0xFFFF] * bool(n)
        body += content + bytes(-len(content) % cluster)
        short = b"F%07dTXT" % i
        check = 0
        for b in short:
            check = ((check & 1) << 7 | check >> 1) + b & 0xFF
        units = name.encode("utf-16-le") + b"\0\0"
        parts = [units[k : k + 26].ljust(26, b"\xff") for k in range(0, len(units), 26)]
        for k in range(len(parts), 0, -1):
            p = parts[k - 1]
            root += bytes([k | (0x40 if k == len(parts) else 0)]) + p[:10] + b"\x0f\0" + bytes([check]) + p[10:22] + b"\0\0" + p[22:]
        root += short + b"\x20" + bytes(8) + struct.pack("<HHHHI", 0, 0, 40 << 9 | 1 << 5 | 1, first if n else 0, len(content))
    n_root = -(-max(n_root, len(root) // 32 + 1) // 16) * 16
    size = -(-2 * (clusters + 2) // sector)
    total = 1 + size + n_root * 32 // sector + clusters * per
    boot = b"\xeb\x3c\x90CAIRN   " + struct.pack("<HBHBHHBH", sector, per, 1, 1, n_root, total if total < 65536 else 0, 0xF8, size) + struct.pack("<HHII", 32, 2, 0, total if total >= 65536 else 0)
    boot = boot.ljust(510, b"\0") + b"\x55\xaa"
    return boot + struct.pack(f"<{len(table)}H", *table).ljust(size * sector, b"\0") + root.ljust(n_root * 32, b"\0") + body.ljust(clusters * cluster, b"\0")


def squashfs(files: Files) -> bytes:
    """One folder, zlib, without fragments."""
    block = 1 << 17
    out = bytearray(96)
    inodes, listing = b"", []
    for i, (name, content) in sorted(enumerate(files), key=lambda x: x[1][0].encode()):
        start, sizes = len(out), []
        for at in range(0, len(content), block):
            part = zlib.compress(content[at : at + block])
            out += part
            sizes.append(len(part))
        listing.append((len(inodes), i + 2, name.encode()))
        inodes += struct.pack("<4HII", 2, 0o644, 0, 0, MTIME, i + 2) + struct.pack("<4I", start, 0xFFFFFFFF, 0, len(content)) + struct.pack(f"<{len(sizes)}I", *sizes)

    def metadata(data: bytes) -> tuple[bytes, list[int]]:
        """Blocks of at most 8 KiB, and where each begins."""
        done, at = b"", []
        for k in range(0, len(data) or 1, 8192):
            part = data[k : k + 8192]
            packed = zlib.compress(part)
            at.append(len(done))
            done += struct.pack("<H", len(packed)) + packed if len(packed) < len(part) else struct.pack("<H", len(part) | 0x8000) + part
        return done, at

    _, begin = metadata(inodes)
    folder = b""
    k = 0
    while k < len(listing):  # a header for entries of one block of inodes
        where = listing[k][0] // 8192
        same = [e for e in listing[k : k + 256] if e[0] // 8192 == where]
        folder += struct.pack("<III", len(same) - 1, begin[where], same[0][1])
        folder += b"".join(struct.pack("<HhHH", o % 8192, n - same[0][1], 2, len(name) - 1) + name for o, n, name in same)
        k += len(same)
    root_at = len(inodes)
    inodes += struct.pack("<4HII", 8, 0o755, 0, 0, MTIME, 1) + struct.pack("<IIIIHHI", 2, len(folder) + 3, 0, len(files) + 2, 0, 0, 0xFFFFFFFF)
    packed, begin = metadata(inodes)
    inodes_at = len(out)
    folders_at = inodes_at + len(packed)
    folders, _ = metadata(folder)
    ids = folders_at + len(folders)
    owner, _ = metadata(struct.pack("<I", 0))
    out += packed + folders + owner + struct.pack("<Q", ids)
    root = begin[root_at // 8192] << 16 | root_at % 8192
    none = 0xFFFFFFFFFFFFFFFF
    out[:96] = struct.pack("<5I6HQQQQQQQQ", 0x73717368, len(files) + 1, MTIME, block, 0, 1, 17, 0, 1, 4, 0, root, len(out), ids + len(owner), none, inodes_at, folders_at, none, none)
    return bytes(out)


def ext4(files: Files) -> bytes:
    """One group of 4 KiB blocks (so 128 MiB at most), one folder, extents."""
    block, inode_size = 4096, 256
    inodes = -(-(len(files) + 11) // 16) * 16
    table_blocks = inodes * inode_size // block
    listing = []
    now = b""
    for number, name in [(2, b"."), (2, b".."), *((i + 12, n.encode()) for i, (n, _) in enumerate(files))]:
        e = struct.pack("<IHBB", number, 8 + -(-len(name) // 4) * 4, len(name), 1) + name + bytes(-len(name) % 4)
        if len(now) + len(e) > block:
            listing.append(now)
            now = b""
        now += e
    listing.append(now)
    blocks = []
    for part in listing:  # the last entry of a block reaches its end
        at = k = 0
        while k < len(part):
            at, k = k, k + struct.unpack("<H", part[k + 4 : k + 6])[0]
        blocks.append(part[: at + 4] + struct.pack("<H", block - at) + part[at + 6 :].ljust(block - at - 6, b"\0"))
    first_data = 4 + table_blocks
    body, place = b"".join(blocks), first_data + len(blocks)

    def inode(mode: int, size: int, at: int, n: int) -> bytes:
        # an extent has 32,768 blocks at most, and four fit an inode
        parts = [(k, min(32768, n - k)) for k in range(0, n, 32768)]
        tree = struct.pack("<4HI", 0xF30A, len(parts), 4, 0, 0) + b"".join(struct.pack("<IHHI", k, c, 0, at + k) for k, c in parts)
        out = struct.pack("<HHIIIIIHHIII", mode, 0, size & 0xFFFFFFFF, MTIME, MTIME, MTIME, 0, 0, 1, n * block // 512, 0x80000, 0) + tree.ljust(60, b"\0")
        return (out + struct.pack("<III", 0, 0, size >> 32)).ljust(inode_size, b"\0")

    table = bytearray(inodes * inode_size)
    table[inode_size : 2 * inode_size] = inode(0o40755, len(blocks) * block, first_data, len(blocks))
    for i, (_, content) in enumerate(files):
        n = -(-len(content) // block)
        table[(i + 11) * inode_size : (i + 12) * inode_size] = inode(0o100644, len(content), place, n)
        body += content + bytes(-len(content) % block)
        place += n
    sb = bytearray(1024)
    struct.pack_into("<13I", sb, 0, inodes, place, 0, 0, 0, 0, 2, 2, 32768, 32768, inodes, MTIME, MTIME)
    struct.pack_into("<HHH", sb, 52, 0, 0xFFFF, 0xEF53)
    struct.pack_into("<I", sb, 76, 1)
    struct.pack_into("<IHHIII", sb, 84, 11, inode_size, 0, 0, 0x42, 0)
    group = struct.pack("<III", 2, 3, 4).ljust(32, b"\0")
    return bytes(1024) + bytes(sb).ljust(block - 1024, b"\0") + group.ljust(block, b"\0") + bytes(2 * block) + bytes(table) + body


def pdf(files: Files) -> bytes:
    """A page without text, with the files attached."""
    out = bytearray(b"%PDF-1.7\n")
    at: list[int] = []

    def add(body: bytes) -> int:
        at.append(len(out))
        out.extend(b"%d 0 obj\n" % len(at) + body + b"\nendobj\n")
        return len(at)

    names = []
    for name, content in files:
        packed = zlib.compress(content)
        stream = add(b"<< /Type /EmbeddedFile /Filter /FlateDecode /Length %d >>\nstream\n" % len(packed) + packed + b"\nendstream")
        title = b"(" + (b"\xfe\xff" + name.encode("utf-16-be")).replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"
        names.append(title + b" %d 0 R" % add(b"<< /Type /Filespec /UF " + title + b" /F " + title + b" /EF << /F %d 0 R >> >>" % stream))
    page = len(at) + 2
    pages = add(b"<< /Type /Pages /Kids [%d 0 R] /Count 1 >>" % page)
    add(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 200 200] >>" % pages)
    root = add(b"<< /Type /Catalog /Pages %d 0 R /Names << /EmbeddedFiles << /Names [" % pages + b" ".join(names) + b"] >> >> >>")
    start = len(out)
    out.extend(b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at))
    return bytes(out) + b"trailer << /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(at) + 1, root, start)


def lzip(data: bytes) -> bytes:
    """One member."""
    packed = lzma.compress(data, lzma.FORMAT_ALONE, filters=[{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 20}])[13:]
    tail = struct.pack("<IQQ", zlib.crc32(data), len(data), 6 + len(packed) + 20)
    return b"LZIP\x01" + bytes([20]) + packed + tail


def lz4(data: bytes) -> bytes:
    import pyarrow

    out = pyarrow.BufferOutputStream()
    with pyarrow.CompressedOutputStream(out, "lz4") as f:
        f.write(data)
    return out.getvalue().to_pybytes()


def uu(data: bytes) -> bytes:
    return b"begin 644 data\n" + b"".join(binascii.b2a_uu(data[k : k + 45]) for k in range(0, len(data), 45)) + b"`\nend\n"


def compress(data: bytes) -> bytes:
    """LZW of up to 16 bits, as compress writes it; the table is never cleared."""
    table = {bytes([i]): i for i in range(256)}
    width, n, now = 9, 257, b""
    bits = count = 0
    out = bytearray(b"\x1f\x9d\x90")

    def put(code: int, size: int) -> None:
        nonlocal bits, count
        bits |= code << count
        count += size
        while count >= 8:
            out.append(bits & 255)
            bits >>= 8
            count -= 8

    written = 0
    for b in data:
        longer = now + bytes([b])
        if longer in table:
            now = longer
            continue
        put(table[now], width)
        written += 1
        if n < 1 << 16:
            table[longer] = n
            n += 1
            if n > 1 << width and width < 16:  # the reader is one entry behind
                put(0, -written % 8 * width)
                width, written = width + 1, 0
        now = bytes([b])
    if now:
        put(table[now], width)
    put(0, -count % 8)
    return bytes(out)


def zstd_frames(data: bytes, chunk: int = 1 << 20) -> bytes:
    """A frame for each chunk, so that a reader may start at any of them."""
    return b"".join(_zstd(data[k : k + chunk]) for k in range(0, len(data), chunk)) or _zstd(b"")


def _single(compress: Callable[[bytes], bytes]) -> Writer:
    """A compressed single file: the first of files."""
    return lambda files: compress(files[0][1])


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


WRITERS: dict[str, Writer] = {
    "tar": tar, "tar.gz": tar_gz, "tar.xz": tar_xz, "tar.zst": tar_zst, "zip": zip_, "ar": ar, "asar": asar, "sqlar": sqlar, "catalog": catalog, "cpio": cpio, "warc": warc,
    "html": html, "ogg": ogg, "xar": xar, "cab": cab, "7z": sevenzip, "rar": rar, "iso": iso, "fat": fat, "squashfs": squashfs,
    "gz": _single(lambda c: gzip.compress(c, mtime=MTIME)), "bz2": _single(bz2.compress), "xz": _single(lzma.compress), "zst": _single(zstd_frames), "zz": _single(zlib.compress),
    "lz4": _single(lz4), "lz": _single(lzip), "Z": _single(compress), "uu": _single(uu), "ext4": ext4, "pdf": pdf,
}


def pack(files: DataFrame, by: Column, suffix: str) -> DataFrame:
    """files: name, content.  One archive for each value of `by`, whose files a task holds together: archive (its name), data."""
    small_batches(files.sparkSession)
    write = WRITERS[suffix]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("name", "ascending")])
        data = write(list(zip(table["name"].to_pylist(), [c or b"" for c in table["content"].to_pylist()], strict=True)))
        return pa.table({"archive": pa.array([f"{table['g'][0].as_py()}.{suffix}"]), "data": pa.array([data], pa.binary())})

    return files.select(by.cast("string").alias("g"), "name", "content").groupBy("g").applyInArrow(run, "archive string, data binary")
