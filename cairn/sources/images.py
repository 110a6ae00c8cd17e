"""Containers and disk images to catalog rows, in plain Python: 7z, RAR (stored members), XAR, CAB, ISO 9660, FAT,
SquashFS, ext4, attachments of PDF and catalogs in SQLite.

Each parser is a generator of parsers.row(); contents are read only if options["content"] asks for
them, or is not given.
"""

from __future__ import annotations

import bz2
import calendar
import lzma
import os
import re
import sqlite3
import stat
import struct
import tempfile
import time
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

from ..schema import DEFAULTS, FILES
from .rows import Row, row, wanted

FOLDER, FILE, LINK = stat.S_IFDIR, stat.S_IFREG, stat.S_IFLNK


class Bytes:
    """A reader over bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError(f"cut off at {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def get(self, form: str):
        values = struct.unpack(form, self.take(struct.calcsize(form)))
        return values[0] if len(values) == 1 else values

    def number(self) -> int:
        """A 7z number: as many more bytes as the first one has leading ones, its other bits on top."""
        first, mask, value = self.take(1)[0], 0x80, 0
        for i in range(8):
            if not first & mask:
                return value | (first & (mask - 1)) << 8 * i
            value |= self.take(1)[0] << 8 * i
            mask >>= 1
        return value

    def vint(self) -> int:
        """A RAR number: seven bits a byte, lowest first."""
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            if not b & 128:
                return value
            shift += 7


def _file_time(t: int) -> float:
    """Seconds since 1970 of 100 ns steps since 1601."""
    return t / 1e7 - 11_644_473_600


def _dos_time(date: int, clock: int) -> float:
    try:
        return float(calendar.timegm(((date >> 9) + 1980, date >> 5 & 15, date & 31, clock >> 11, clock >> 5 & 63, (clock & 31) * 2)))
    except ValueError:
        return 0.0


# --- 7z -------------------------------------------------------------------------------------


def _bits(r: Bytes, n: int) -> list[bool]:
    packed = r.take(-(-n // 8))
    return [bool(packed[i // 8] & 0x80 >> i % 8) for i in range(n)]


def _digests(r: Bytes, n: int) -> list[int | None]:
    known = [True] * n if r.take(1)[0] else _bits(r, n)
    return [r.get("<I") if k else None for k in known]


def _folder(r: Bytes) -> dict:
    coders = []
    for _ in range(r.number()):
        flags = r.take(1)[0]
        name = r.take(flags & 15)
        ins, outs = (r.number(), r.number()) if flags & 16 else (1, 1)
        if (ins, outs) != (1, 1):
            raise ValueError("7z coder with several streams")
        coders.append((name, r.take(r.number()) if flags & 32 else b""))
    bonds = dict((r.number(), r.number()) for _ in range(len(coders) - 1))  # input of a coder -> output of another
    return {"coders": coders, "bonds": bonds}


def _streams(r: Bytes) -> dict:
    out: dict = {"packs": [], "folders": [], "counts": None, "sizes": None}
    while (kind := r.take(1)[0]) != 0:
        if kind == 6:
            out["at"], n = r.number(), r.number()
            while (k := r.take(1)[0]) != 0:
                if k == 9:
                    out["packs"] = [r.number() for _ in range(n)]
                elif k == 10:
                    _digests(r, n)
        elif kind == 7:
            while (k := r.take(1)[0]) != 0:
                if k == 11:
                    n = r.number()
                    r.take(1)
                    out["folders"] = [_folder(r) for _ in range(n)]
                elif k == 12:
                    for f in out["folders"]:
                        f["sizes"] = [r.number() for _ in f["coders"]]
                elif k == 10:
                    _digests(r, len(out["folders"]))
        elif kind == 8:
            counts, sizes = [1] * len(out["folders"]), None
            while (k := r.take(1)[0]) != 0:
                if k == 13:
                    counts = [r.number() for _ in out["folders"]]
                elif k == 9:
                    sizes = []
                    for f, c in zip(out["folders"], counts, strict=True):
                        own = [r.number() for _ in range(c - 1)]
                        sizes.append([*own, _unpacked_size(f) - sum(own)] if c else [])
                elif k == 10:
                    _digests(r, sum(counts))
            out["counts"] = counts
            out["sizes"] = sizes or [[_unpacked_size(f)] * c for f, c in zip(out["folders"], counts, strict=True)]
    if out["sizes"] is None:
        out["sizes"] = [[_unpacked_size(f)] for f in out["folders"]]
    return out


def _unpacked_size(folder: dict) -> int:
    bound = set(folder["bonds"].values())
    return next(s for i, s in enumerate(folder["sizes"]) if i not in bound)


def _decoded(folder: dict, data: bytes) -> bytes:
    order = [i for i in range(len(folder["coders"])) if i not in folder["bonds"]]  # the coder that reads the packed stream
    by_output = {o: i for i, o in folder["bonds"].items()}
    while order[-1] in by_output:
        order.append(by_output[order[-1]])
    for i in order:
        name, props = folder["coders"][i]
        size = folder["sizes"][i]
        if name == b"\x00":
            continue
        if name == b"\x04\x01\x08":
            data = zlib.decompress(data, -15)
        elif name == b"\x04\x02\x02":
            data = bz2.decompress(data)
        else:
            if name == b"\x21":
                p = props[0]
                filters = {"id": lzma.FILTER_LZMA2, "dict_size": 0xFFFFFFFF if p == 40 else (2 | p & 1) << p // 2 + 11}
            elif name == b"\x03\x01\x01":
                p = props[0]
                filters = {"id": lzma.FILTER_LZMA1, "lc": p % 9, "lp": p // 9 % 5, "pb": p // 45, "dict_size": struct.unpack("<I", props[1:5])[0]}
            else:
                raise ValueError(f"7z coder {name.hex()}")
            data = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[filters]).decompress(data, size)
        data = data[:size]
    return data


def sevenzip(data: bytes, options: dict) -> Iterator[Row]:
    """7z archives with copied, LZMA, LZMA2, deflated or bzip2 streams."""
    if data[:6] != b"7z\xbc\xaf\x27\x1c":
        raise ValueError("not a 7z archive")
    offset, size, crc = struct.unpack("<QQI", data[12:32])
    head = data[32 + offset : 32 + offset + size]
    if zlib.crc32(head) != crc:
        raise ValueError("7z header is damaged")
    if not head:
        return
    r = Bytes(head)
    kind = r.take(1)[0]
    while kind == 0x17:  # the header is itself packed
        s = _streams(r)
        r = Bytes(_decoded(s["folders"][0], data[32 + s["at"] : 32 + s["at"] + s["packs"][0]]))
        kind = r.take(1)[0]
    streams: dict = {"folders": [], "sizes": [], "packs": [], "at": 0}
    files: list[dict] = []
    while (k := r.take(1)[0]) != 0:
        if k == 4:
            streams = _streams(r)
        elif k == 5:
            files = [{"empty": False, "folder": False} for _ in range(r.number())]
            while (p := r.number()) != 0:
                part = Bytes(r.take(r.number()))
                if p == 14:
                    for f, bit in zip(files, _bits(part, len(files)), strict=True):
                        f["empty"] = f["folder"] = bit
                elif p == 15:
                    empty = [f for f in files if f["empty"]]
                    for f, bit in zip(empty, _bits(part, len(empty)), strict=True):
                        f["folder"] = not bit
                elif p == 17:
                    part.take(1)
                    for f, name in zip(files, part.data[1:].decode("utf-16-le").split("\0"), strict=False):
                        f["name"] = name
                elif p in (20, 21):
                    known = [True] * len(files) if part.take(1)[0] else _bits(part, len(files))
                    part.take(1)
                    for f, have in zip(files, known, strict=True):
                        if have:
                            f["mtime" if p == 20 else "attributes"] = part.get("<Q") if p == 20 else part.get("<I")
    todo = iter([f for f in files if not f["empty"]])
    at = 32 + streams["at"]
    for folder, sizes, packed in zip(streams["folders"], streams["sizes"], streams["packs"], strict=False):
        body = _decoded(folder, data[at : at + packed]) if wanted(options) else b""
        start = 0
        for n in sizes:
            f = next(todo)
            f |= {"size": n, "at": at, "start": start, "content": body[start : start + n] if wanted(options) else None}
            start += n
        at += packed
    for i, f in enumerate(files):
        bits = f.get("attributes", 0)
        mode = bits >> 16 if bits & 0x8000 else FOLDER | 0o755 if f["folder"] else FILE | 0o644
        link = f["content"].decode("utf-8", "replace") if stat.S_ISLNK(mode) and f.get("content") else ""
        content = None if f["folder"] or link else f.get("content", b"" if wanted(options) else None)
        yield row(f.get("name", f"{i}"), offsetheader=i, offset=f.get("start"), size=f.get("size", 0), mtime=_file_time(f["mtime"]) if "mtime" in f else 0.0, mode=mode, linkname=link, content=content, type="5" if f["folder"] else "0")


# --- RAR ------------------------------------------------------------------------------------


def rar(data: bytes, options: dict) -> Iterator[Row]:
    """RAR 5 archives; a compressed member's content can't be read and is null."""
    if data[:8] != b"Rar!\x1a\x07\x01\x00":
        raise ValueError("not a RAR 5 archive")
    r = Bytes(data, 8)
    while r.at < len(data):
        begin = r.at
        r.take(4)
        size = r.vint()
        end = r.at + size
        kind, flags = r.vint(), r.vint()
        if flags & 1:
            r.vint()
        packed = r.vint() if flags & 2 else 0
        if kind == 4:
            raise ValueError("encrypted RAR headers")
        if kind == 2:
            own, unpacked, bits = r.vint(), r.vint(), r.vint()
            mtime = r.get("<I") if own & 2 else 0
            if own & 4:
                r.take(4)
            method, system = r.vint() >> 7 & 7, r.vint()
            name = r.take(r.vint()).decode("utf-8", "replace")
            folder = bool(own & 1)
            mode = bits if system == 1 else FOLDER | 0o755 if folder else FILE | 0o644
            content = data[end : end + packed] if not folder and not method and wanted(options) else None
            yield row(name, offsetheader=begin, offset=end, size=unpacked, mtime=float(mtime), mode=mode, content=content, type="5" if folder else "0")
        if kind == 5:
            return
        r.at = end + packed


# --- XAR and CAB ----------------------------------------------------------------------------


def xar(data: bytes, options: dict) -> Iterator[Row]:
    """XAR archives: a compressed XML table of contents before the heap."""
    magic, size, _, packed, _, _ = struct.unpack(">4sHHQQI", data[:28])
    if magic != b"xar!":
        raise ValueError("not a XAR archive")
    heap = size + packed
    todo = [("", f) for f in ElementTree.fromstring(zlib.decompress(data[size:heap])).findall("toc/file")]
    while todo:
        path, f = todo.pop(0)
        full = f"{path}/{f.findtext('name') or ''}"
        kind = f.findtext("type") or "file"
        mode = int(f.findtext("mode") or "644", 8) & 0o7777
        when = f.findtext("mtime")
        mtime = float(calendar.timegm(time.strptime(when[:19], "%Y-%m-%dT%H:%M:%S"))) if when else 0.0
        more = {"offsetheader": int(f.get("id") or 0), "mtime": mtime, "uid": int(f.findtext("uid") or 0), "gid": int(f.findtext("gid") or 0)}
        if kind == "directory":
            yield row(full, mode=FOLDER | mode, type="5", **more)
        elif kind == "symlink":
            yield row(full, mode=LINK | mode, type="2", linkname=f.findtext("link") or "", **more)
        else:
            n, at, length = (int(f.findtext(f"data/{k}") or 0) for k in ("size", "offset", "length"))
            how = f.find("data/encoding")
            style = "" if how is None else how.get("style", "")
            content = None
            if wanted(options):
                content = data[heap + at : heap + at + length]
                for word, decode in (("gzip", zlib.decompress), ("bzip2", bz2.decompress), ("xz", lzma.decompress), ("lzma", lzma.decompress)):
                    if word in style:
                        content = decode(content)
                        break
            yield row(full, mode=FILE | mode, offset=heap + at, size=n, content=content, **more)
        todo += [(full, k) for k in f.findall("file")]


def cab(data: bytes, options: dict) -> Iterator[Row]:
    """Cabinets with plain or MSZIP folders."""
    if data[:4] != b"MSCF":
        raise ValueError("not a cabinet")
    files_at, n_folders, n_files, flags = struct.unpack("<16xI6xHHH", data[:32])[0:4]
    r = Bytes(data, 36)
    head = body = 0
    if flags & 4:
        reserved, head, body = r.get("<HBB")
        r.take(reserved)
    for _ in range(2 * bool(flags & 1) + 2 * bool(flags & 2)):
        r.at = data.index(b"\0", r.at) + 1
    folders = []
    for _ in range(n_folders):
        folders.append(r.get("<IHH"))
        r.take(head)
    opened: dict[int, bytes] = {}

    def folder(i: int) -> bytes:
        if i not in opened:
            at, blocks, kind = folders[i]
            b, out = Bytes(data, at), b""
            for _ in range(blocks):
                _, packed, _ = b.get("<IHH")
                b.take(body)
                part = b.take(packed)
                if kind & 15 == 1:
                    part = zlib.decompressobj(-15, zdict=out[-32768:]).decompress(part[2:])
                elif kind & 15:
                    raise ValueError("cabinet compression is not supported")
                out += part
            opened[i] = out
        return opened[i]

    r.at = files_at
    for _ in range(n_files):
        begin = r.at
        size, start, i, date, clock, bits = r.get("<IIHHHH")
        end = data.index(b"\0", r.at)
        name = r.take(end - r.at).decode("utf-8" if bits & 0x80 else "latin-1", "replace").replace("\\", "/")
        r.take(1)
        yield row(name, offsetheader=begin, offset=start, size=size, mtime=_dos_time(date, clock), mode=FILE | 0o644, content=folder(i)[start : start + size] if wanted(options) and i < len(folders) else None)


# --- file systems ---------------------------------------------------------------------------


def iso(data: bytes, options: dict) -> Iterator[Row]:
    """ISO 9660 images; names of Rock Ridge before those of Joliet before plain ones."""
    root, joliet, at = None, False, 16 * 2048
    while data[at + 1 : at + 6] == b"CD001" and data[at] != 255:
        if data[at] == 1 and root is None:
            root = data[at + 156 : at + 190]
        at += 2048
    if root is None:
        raise ValueError("not an ISO 9660 image")

    def entries(record: bytes) -> Iterator[bytes]:
        begin, size = struct.unpack("<I4xI", record[2:14])
        at, end = begin * 2048, begin * 2048 + size
        while at < end:
            n = data[at]
            if not n:  # records don't cross sectors
                at = (at // 2048 + 1) * 2048
                continue
            yield data[at : at + n]
            at += n

    def ridge(record: bytes) -> dict[bytes, bytes]:
        n = record[32]
        at, found = 33 + n + (n + 1) % 2, {}
        while at + 4 <= len(record) and record[at + 2] >= 4:
            key, size = record[at : at + 2], record[at + 2]
            found[key] = found.get(key, b"") + record[at + 5 if key == b"NM" else at + 4 : at + size]
            at += size
        return found

    if not any(b"NM" in ridge(x) for x in entries(root)):
        at = 16 * 2048
        while data[at + 1 : at + 6] == b"CD001" and data[at] != 255:
            if data[at] == 2 and data[at + 88 : at + 91] in (b"%/@", b"%/C", b"%/E"):
                root, joliet = data[at + 156 : at + 190], True
            at += 2048
    todo, seen = [("", root)], set()
    while todo:
        path, folder = todo.pop(0)
        place = struct.unpack("<I", folder[2:6])[0]
        if place in seen:
            continue
        seen.add(place)
        for record in entries(folder):
            raw = record[33 : 33 + record[32]]
            if raw in (b"\0", b"\1"):
                continue
            more = {} if joliet else ridge(record)
            name = more[b"NM"].decode("utf-8", "replace") if b"NM" in more else raw.decode("utf-16-be" if joliet else "latin-1", "replace").split(";")[0].rstrip("." if not joliet else "\0")
            begin, size = struct.unpack("<I4xI", record[2:14])
            is_folder = bool(record[25] & 2)
            y, mo, dy, h, mi, s, zone = struct.unpack("<6Bb", record[18:25])
            mtime = float(calendar.timegm((y + 1900, mo or 1, dy or 1, h, mi, s)) - zone * 900)
            mode = struct.unpack("<I", more[b"PX"][:4])[0] if b"PX" in more else FOLDER | 0o555 if is_folder else FILE | 0o444
            full = f"{path}/{name}"
            content = data[begin * 2048 : begin * 2048 + size] if wanted(options) and not is_folder else None
            yield row(full, offsetheader=begin * 2048, offset=begin * 2048, size=0 if is_folder else size, mtime=mtime, mode=mode, content=content, type="5" if is_folder else "0")
            if is_folder:
                todo.append((full, record))


def fat(data: bytes, options: dict) -> Iterator[Row]:
    """FAT12, FAT16 and FAT32 volumes, with long names."""
    if data[510:512] != b"\x55\xaa":
        raise ValueError("not a FAT volume")
    sector, per, reserved, n_fats, n_root, total16, _, fat16 = struct.unpack("<HBHBHHBH", data[11:24])
    total32, fat32 = struct.unpack("<I", data[32:36])[0], struct.unpack("<I", data[36:40])[0]
    if sector not in (512, 1024, 2048, 4096) or not per or not n_fats or not reserved:
        raise ValueError("not a FAT volume")
    size = fat16 or fat32
    root_at = (reserved + n_fats * size) * sector
    data_at = root_at + -(-n_root * 32 // sector) * sector
    clusters = ((total16 or total32) * sector - data_at) // (per * sector)
    bits = 12 if clusters < 4085 else 16 if clusters < 65525 else 32
    table = data[reserved * sector : (reserved + size) * sector]

    def following(c: int) -> int | None:
        if bits == 12:
            pair = struct.unpack("<H", table[c * 3 // 2 : c * 3 // 2 + 2])[0]
            n = pair >> 4 if c & 1 else pair & 0xFFF
        else:
            n = struct.unpack("<H", table[2 * c : 2 * c + 2])[0] if bits == 16 else struct.unpack("<I", table[4 * c : 4 * c + 4])[0] & 0x0FFFFFFF
        return n if 2 <= n < clusters + 2 else None

    def chain(c: int | None) -> bytes:
        out, seen = [], set()
        while c is not None and c not in seen and c >= 2:
            seen.add(c)
            at = data_at + (c - 2) * per * sector
            out.append(data[at : at + per * sector])
            c = following(c)
        return b"".join(out)

    root = data[root_at:data_at] if bits < 32 else chain(struct.unpack("<I", data[44:48])[0])
    todo = [("", root)]
    while todo:
        path, table_ = todo.pop(0)
        long: list[str] = []
        for at in range(0, len(table_) - 31, 32):
            e = table_[at : at + 32]
            if not e[0]:
                break
            if e[0] == 0xE5:
                long = []
                continue
            if e[11] == 0x0F:
                long.insert(0, (e[1:11] + e[14:26] + e[28:32]).decode("utf-16-le", "replace").split("\0")[0].rstrip("￿"))
                continue
            if e[11] & 8 or e[0] == 0x2E:
                long = []
                continue
            short = e[:8].decode("latin-1").rstrip() + ("." + e[8:11].decode("latin-1").rstrip() if e[8:11].strip() else "")
            name, long = "".join(long) or short, []
            high, clock, date, low, length = struct.unpack("<HHHHI", e[20:32])
            first = low | (high << 16 if bits == 32 else 0)
            folder, full = bool(e[11] & 16), f"{path}/{name}"
            place = data_at + (first - 2) * per * sector if first >= 2 else None
            yield row(full, offsetheader=place, offset=place, size=0 if folder else length, mtime=_dos_time(date, clock), mode=FOLDER | 0o755 if folder else FILE | 0o644, content=chain(first)[:length] if wanted(options) and not folder else None, type="5" if folder else "0")
            if folder:
                todo.append((full, chain(first)))


def squashfs(data: bytes, options: dict) -> Iterator[Row]:
    """SquashFS 4 images compressed with zlib, xz, lzma or zstd, or not at all."""
    magic, _, _, block, n_fragments, kind, _, _, _, major, _, root = struct.unpack("<5I6HQ", data[:40])
    ids_at, _, inodes_at, folders_at, fragments_at = struct.unpack("<5Q", data[48:88])
    if magic != 0x73717368 or major != 4:
        raise ValueError("not a SquashFS 4 image")

    def unpack(part: bytes) -> bytes:
        if kind == 6:
            import zstandard

            return zstandard.ZstdDecompressor().decompress(part, max_output_size=max(block, 8192))
        return {1: zlib.decompress, 2: lzma.decompress, 4: lzma.decompress}[kind](part)

    blocks: dict[int, tuple[bytes, int]] = {}

    def metadata(at: int) -> tuple[bytes, int]:
        """A block and the place of the next one."""
        if at not in blocks:
            head = struct.unpack("<H", data[at : at + 2])[0]
            n = head & 0x7FFF
            part = data[at + 2 : at + 2 + n]
            blocks[at] = (part if head & 0x8000 else unpack(part), at + 2 + n)
        return blocks[at]

    def run(at: int, offset: int, n: int) -> bytes:
        out = b""
        while len(out) < n:
            part, at = metadata(at)
            out += part[offset:] if offset else part
            offset = 0
            if not part:
                break
        return out[:n]

    def reader(at: int, offset: int):
        held = bytearray()
        here = [at, offset]

        def more(n: int) -> bytes:
            while len(held) < n:
                part, following = metadata(here[0])
                held.extend(part[here[1] :])
                here[:] = [following, 0]
            got = bytes(held[:n])
            del held[:n]
            return got

        return more

    fragments = []
    for k in range(-(-n_fragments // 512)):
        at = struct.unpack("<Q", data[fragments_at + 8 * k : fragments_at + 8 * k + 8])[0]
        part = run(at, 0, 16 * min(512, n_fragments - 512 * k))
        fragments += list(struct.iter_unpack("<QII", part))

    def stored(at: int, size: int) -> bytes:
        n = size & 0xFFFFFF
        return data[at : at + n] if size & 1 << 24 else unpack(data[at : at + n])

    def owner(i: int) -> int:
        at = struct.unpack("<Q", data[ids_at + 8 * (i // 2048) : ids_at + 8 * (i // 2048) + 8])[0]
        return struct.unpack("<I", run(at, 4 * (i % 2048), 4))[0]

    todo = [("", root)]
    while todo:
        path, ref = todo.pop(0)
        more = reader(inodes_at + (ref >> 16), ref & 0xFFFF)
        what, mode, uid, gid, mtime, _ = struct.unpack("<4HII", more(16))
        common = {"offsetheader": ref, "mtime": float(mtime), "uid": owner(uid), "gid": owner(gid)}
        if what in (1, 8):
            if what == 1:
                start, _, size, offset, _ = struct.unpack("<IIHHI", more(16))
            else:
                _, size, start, _, _, offset, _ = struct.unpack("<IIIIHHI", more(24))
            if path:
                yield row(path, mode=FOLDER | mode, type="5", **common)
            listing = Bytes(run(folders_at + start, offset, size - 3))
            while listing.at < len(listing.data):
                count, at, _ = listing.get("<III")
                for _ in range(count + 1):
                    o, _, _, n = listing.get("<HhHH")
                    name = listing.take(n + 1).decode("utf-8", "replace")
                    todo.append((f"{path}/{name}", at << 16 | o))
        elif what in (2, 9):
            if what == 2:
                start, fragment, offset, size = struct.unpack("<4I", more(16))
            else:
                start, size, _, _, fragment, offset, _ = struct.unpack("<QQQIIII", more(40))
            n = size // block if fragment != 0xFFFFFFFF else -(-size // block)
            lengths = struct.unpack(f"<{n}I", more(4 * n))
            content = None
            if wanted(options):
                parts, at = [], start
                for length in lengths:
                    parts.append(stored(at, length) if length else bytes(block))
                    at += length & 0xFFFFFF
                if fragment != 0xFFFFFFFF:
                    parts.append(stored(*fragments[fragment][:2])[offset : offset + size % block])
                content = b"".join(parts)[:size]
            yield row(path, mode=FILE | mode, offset=start, size=size, content=content, **common)
        elif what in (3, 10):
            _, n = struct.unpack("<II", more(8))
            yield row(path, mode=LINK | mode, type="2", linkname=more(n).decode("utf-8", "replace"), **common)
        else:
            yield row(path, mode={4: stat.S_IFBLK, 5: stat.S_IFCHR, 6: stat.S_IFIFO, 7: stat.S_IFSOCK}.get(what if what < 8 else what - 7, 0) | mode, **common)


def is_ext4(data: bytes) -> bool:
    """The mark of a superblock, which other contents hold by chance, with a block size of at most 64 KiB and revision 0 or 1."""
    sb = data[1024:1104]
    return len(sb) == 80 and sb[56:58] == b"\x53\xef" and struct.unpack("<I", sb[24:28])[0] <= 6 and struct.unpack("<I", sb[76:80])[0] <= 1


def ext4(data: bytes, options: dict) -> Iterator[Row]:
    """ext2, ext3 and ext4 volumes: folders, files of extents or block maps, and symbolic links."""
    sb = data[1024:2048]
    if not is_ext4(data):
        raise ValueError("not an ext4 volume")
    block = 1024 << struct.unpack("<I", sb[24:28])[0]
    first, per_group = struct.unpack("<I", sb[20:24])[0], struct.unpack("<I", sb[40:44])[0]
    inode_size = struct.unpack("<H", sb[88:90])[0] if struct.unpack("<I", sb[76:80])[0] else 128
    wide = bool(struct.unpack("<I", sb[96:100])[0] & 0x80)
    entry = struct.unpack("<H", sb[254:256])[0] if wide else 32
    groups_at = (first + 1) * block

    def inode(number: int) -> tuple[int, bytes]:
        group, index = divmod(number - 1, per_group)
        at = groups_at + group * entry
        table = struct.unpack("<I", data[at + 8 : at + 12])[0] | (struct.unpack("<I", data[at + 40 : at + 44])[0] << 32 if wide and entry >= 64 else 0)
        at = table * block + index * inode_size
        return at, data[at : at + inode_size]

    def extents(node: bytes) -> Iterator[tuple[int, int, int]]:
        magic, n, _, depth = struct.unpack("<4H", node[:8])
        if magic != 0xF30A:
            raise ValueError("damaged extents")
        for k in range(n):
            e = node[12 + 12 * k : 24 + 12 * k]
            if depth:
                low, high = struct.unpack("<IH", e[4:10])
                yield from extents(data[(high << 32 | low) * block : ((high << 32 | low) + 1) * block])
            else:
                logical, count, high, low = struct.unpack("<IHHI", e)
                yield logical, count & 0x7FFF if count > 0x8000 else count, 0 if count > 0x8000 else high << 32 | low

    def mapped(numbers: bytes, level: int) -> Iterator[int]:
        for (b,) in struct.iter_unpack("<I", numbers):
            if not level:
                yield b
            elif b:
                yield from mapped(data[b * block : (b + 1) * block], level - 1)
            else:
                yield from [0] * (block // 4) ** level

    def content(i: bytes, size: int) -> bytes:
        out = bytearray(size)
        where = struct.unpack("<I", i[32:36])[0]
        if where & 0x10000000:  # held in the inode
            return i[40 : 40 + min(size, 60)]
        if where & 0x80000:
            parts = extents(i[40:100])
        else:
            numbers = (b for level, part in ((0, i[40:88]), (1, i[88:92]), (2, i[92:96]), (3, i[96:100])) for b in mapped(part, level))
            parts = ((k, 1, b) for k, b in zip(range(-(-size // block)), numbers, strict=False))
        for logical, count, b in parts:
            if b:
                piece = data[b * block : (b + count) * block][: max(0, size - logical * block)]
                out[logical * block : logical * block + len(piece)] = piece
        return bytes(out)

    todo, seen = [("", 2)], {2}
    while todo:
        path, number = todo.pop(0)
        at, i = inode(number)
        mode, uid, low = struct.unpack("<HHI", i[:8])
        size = low | (struct.unpack("<I", i[108:112])[0] << 32 if stat.S_ISREG(mode) else 0)
        common = {"offsetheader": at, "mtime": float(struct.unpack("<I", i[16:20])[0]), "uid": uid, "gid": struct.unpack("<H", i[24:26])[0], "mode": mode}
        if stat.S_ISDIR(mode):
            if path:
                yield row(path, type="5", **common)
            listing, k = content(i, size), 0
            while k + 8 <= len(listing):
                child, length, n = struct.unpack("<IHB", listing[k : k + 7])
                name = listing[k + 8 : k + 8 + n].decode("utf-8", "surrogateescape")
                if child and name not in (".", "..") and (child not in seen or not stat.S_ISDIR(struct.unpack("<H", inode(child)[1][:2])[0])):
                    seen.add(child)
                    todo.append((f"{path}/{name}", child))
                k += max(length, 8)
        elif stat.S_ISLNK(mode):
            link = i[40 : 40 + size] if size < 60 else content(i, size)
            yield row(path, type="2", linkname=link.decode("utf-8", "surrogateescape"), **common)
        else:
            yield row(path, size=size if stat.S_ISREG(mode) else 0, content=content(i, size) if wanted(options) and stat.S_ISREG(mode) else None, **common)


# --- documents ------------------------------------------------------------------------------


def pdf(data: bytes, options: dict) -> Iterator[Row]:
    """Files attached to a PDF: the streams that its file specifications embed, plain or deflated."""
    if not data.startswith(b"%PDF-"):
        raise ValueError("not a PDF")
    bodies = {int(m[1]): m.end() for m in re.finditer(rb"(?<![0-9])([0-9]+)\s+[0-9]+\s+obj\b", data)}
    for m in re.finditer(rb"/Type\s*/Filespec\b", data):
        begin, end = data.rfind(b" obj", 0, m.start()), data.find(b"endobj", m.end())
        spec = data[begin:end]
        name = re.search(rb"/UF?\s*\(((?:[^()\\]|\\.)*)\)", spec) or re.search(rb"/F\s*\(((?:[^()\\]|\\.)*)\)", spec)
        to = re.search(rb"/EF\s*<<[^>]*?/U?F\s+([0-9]+)\s+[0-9]+\s+R", spec)
        if not name or not to or int(to[1]) not in bodies:
            continue
        at = bodies[int(to[1])]
        start = data.index(b"stream", at)
        head = data[at:start]
        start += 8 if data[start + 6 : start + 8] == b"\r\n" else 7
        length = re.search(rb"/Length\s+([0-9]+)(?!\s+[0-9]+\s+R)", head)
        body = data[start : start + int(length[1])] if length else data[start : data.index(b"endstream", start)].rstrip(b"\r\n")
        content = zlib.decompress(body) if b"/FlateDecode" in head else body
        raw = re.sub(rb"\\(.)", rb"\1", name[1])
        text = raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")
        yield row(text, offsetheader=at, offset=start, size=len(content), content=content if wanted(options) else None)


# --- catalogs -------------------------------------------------------------------------------


def sqlite_catalog(data: bytes, options: dict) -> Iterator[Row]:
    """The rows of a catalog in a SQLite file, table files; columns that it lacks have their defaults."""
    with tempfile.TemporaryDirectory() as folder:
        file = os.path.join(folder, "catalog")
        with open(file, "wb") as f:
            f.write(data)
        with sqlite3.connect(f"file:{file}?mode=ro&immutable=1", uri=True) as con:
            have = [r[1] for r in con.execute("PRAGMA table_info(files)")]
            if not {"path", "name"} <= set(have):
                raise ValueError("no table files with path and name")
            con.text_factory = lambda b: b.decode("utf-8", "backslashreplace")
            use = [f.name for f in FILES if f.name in have]
            base = row("x")
            for values in con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in use)} FROM files"):
                found = dict(zip(use, values, strict=True))
                for c in ("istar", "issparse", "isgenerated"):
                    if c in found:
                        found[c] = bool(found[c])
                found |= {"type": str(found.get("type", "")), "mtime": float(found.get("mtime") or 0)}
                yield base | DEFAULTS | found
        con.close()
