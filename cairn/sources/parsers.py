"""Archive bytes to catalog rows, one generator per format, in plain Python.

A row is a dict of FILES columns, with `content` (bytes or None), and `xattrs` ({key: bytes}).
Bad input raises, after the members before it; the reader turns that into an error row.  Contents are
read and inflated only if options["content"] asks for them, or is not given.
"""

from __future__ import annotations

import base64
import calendar
import gzip
import hashlib
import html
import html.parser
import io
import json
import mimetypes
import os
import re
import sqlite3
import stat
import struct
import tarfile
import tempfile
import urllib.parse
import zipfile
import zlib
from collections.abc import Callable, Iterator

from . import images
from .codecs import SUFFIX, decompress, known
from .rows import Row, clean, row, wanted

Parser = Callable[[bytes, dict], Iterator[Row]]


# --- compression ----------------------------------------------------------------------------


def gzip_info(data: bytes) -> tuple[str | None, int]:
    """(original name, mtime) of a gzip header."""
    if data[:2] != b"\x1f\x8b":
        raise ValueError("not gzip")
    flags, mtime, at = data[3], struct.unpack("<I", data[4:8])[0], 10
    if flags & 4:
        at += 2 + struct.unpack("<H", data[at : at + 2])[0]
    if flags & 8:
        return data[at : data.index(b"\x00", at)].decode("latin-1"), mtime
    return None, mtime


def compressed(data: bytes, options: dict) -> Iterator[Row]:
    """A compressed single file as a catalog of one row, whose offsetheader is null."""
    name = options.get("name", "content")
    content = decompress(data, name)
    if content is None:
        raise ValueError("unknown compression")
    if data[:2] == b"\x1f\x8b":
        said, mtime = gzip_info(data)
    else:
        said, mtime = None, 0
    stem = said or re.sub(SUFFIX, "", name)
    yield row(stem, size=len(content), mtime=float(mtime), content=content, offset=0)


# --- formats --------------------------------------------------------------------------------

_TYPES = {tarfile.DIRTYPE: stat.S_IFDIR, tarfile.SYMTYPE: stat.S_IFLNK, tarfile.CHRTYPE: stat.S_IFCHR, tarfile.BLKTYPE: stat.S_IFBLK, tarfile.FIFOTYPE: stat.S_IFIFO, b"D": stat.S_IFDIR}
_XATTR_PREFIXES = ("SCHILY.xattr.", "LIBARCHIVE.xattr.")


def tar(data: bytes, options: dict) -> Iterator[Row]:
    """Members of a TAR, compressed or not; a hard link has its target's path in linkname."""
    plain = decompress(data, options.get("name", "")) if not is_tar(data) else None
    data = data if plain is None else plain
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:", ignore_zeros=options.get("ignoreZeros", False), encoding=options.get("encoding", "utf-8")) as archive:
        for m in archive:
            if m.isreg() and m.sparse is None and m.offset_data + m.size > len(data):
                raise ValueError(f"member at {m.offset} is cut off")
            xattrs = {}
            for key, value in m.pax_headers.items():
                for prefix in _XATTR_PREFIXES:
                    if key.startswith(prefix):
                        raw = value.encode("utf-8", "surrogateescape")
                        xattrs[urllib.parse.unquote(key[len(prefix) :])] = raw if prefix[0] == "S" else base64.b64decode(raw + b"=" * (-len(raw) % 4))
            kind = m.type.decode("latin-1")
            file = archive.extractfile(m) if m.isreg() and wanted(options) else None
            yield row(
                m.name, offsetheader=m.offset, offset=m.offset_data, size=m.size, mtime=float(m.mtime), mode=m.mode & 0o7777 | _TYPES.get(m.type, stat.S_IFREG), type=kind if kind != "\x00" else "0",
                linkname=m.linkname, uid=m.uid, gid=m.gid, issparse=m.sparse is not None, content=file.read() if file else None, xattrs=xattrs, istar=m.isreg() and m.name.lower().endswith(".tar"),
            )


def is_tar(data: bytes) -> bool:
    if len(data) < 512:
        return False
    try:
        tarfile.TarInfo.frombuf(data[:512], "utf-8", "surrogateescape")
    except tarfile.HeaderError:
        return False
    return True


def tar_offsets(file, ignore_zeros: bool = False) -> Iterator[tuple[int, str]]:
    """(offset, type) of every member header, by reading header blocks alone; split points of a TAR."""
    at, leading = 0, True
    while True:
        file.seek(at)
        block = file.read(512)
        if len(block) < 512:
            return
        if not block.strip(b"\x00"):
            if not ignore_zeros:
                return
            at += 512
            continue
        kind = chr(block[156] or 48)
        size = tarfile.nti(block[124:136])
        if leading:
            yield at, kind
        leading = kind not in "KLxXg"  # the header that follows belongs to the same member
        at += 512 + -(-size // 512) * 512


def zip_(data: bytes, options: dict) -> Iterator[Row]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for password in options.get("passwords", []):
            archive.setpassword(password)
        failed: Exception | None = None
        for m in archive.infolist():
            mode = m.external_attr >> 16
            folder = m.is_dir()
            if not mode:
                mode = 0o770 if folder else 0o660
            if not stat.S_IFMT(mode):
                mode |= stat.S_IFDIR if folder else stat.S_IFREG
            content, link = None, ""
            if not folder and (wanted(options) or stat.S_ISLNK(mode)):
                try:
                    content = archive.read(m)
                except Exception as e:  # noqa: BLE001  the other members are read; the first failure is told at the end
                    failed = failed or e
            if stat.S_ISLNK(mode) and content is not None:
                link = content.decode("utf-8", "surrogateescape")
            yield row(m.filename, offsetheader=m.header_offset, offset=m.header_offset, size=m.file_size, mtime=float(calendar.timegm((*m.date_time, 0, 0, 0))), mode=mode, linkname=link, content=None if link else content)
        if failed:
            raise failed


def ar(data: bytes, options: dict) -> Iterator[Row]:
    """Unix archives: GNU and BSD long names; members of a thin archive are symbolic links."""
    thin = data.startswith(b"!<thin>\n")
    if not thin and not data.startswith(b"!<arch>\n"):
        raise ValueError("not an ar archive")
    at, names = 8, b""
    while at + 60 <= len(data):
        head = data[at : at + 60]
        if head[58:60] != b"`\n":
            raise ValueError(f"bad member header at {at}")
        name, mtime, uid, gid, mode, size = (head[i:j].decode("latin-1").strip() for i, j in ((0, 16), (16, 28), (28, 34), (34, 40), (40, 48), (48, 58)))
        n, start = int(size), at + 60
        special = name in ("/", "//", "/SYM64/") or name.startswith("__.SYMDEF")
        stored = special or not thin
        if stored and start + n > len(data):
            raise ValueError(f"member at {at} is cut off")
        content = data[start : start + n] if stored else None
        if name == "//":
            names = content or b""
        elif not special:
            if re.fullmatch(r"/\d+", name):
                name = names[int(name[1:]) :].split(b"\n", 1)[0].decode("utf-8", "replace").removesuffix("/")
            elif name.startswith("#1/"):
                k = int(name[3:])
                name, content = content[:k].rstrip(b"\x00").decode("utf-8", "replace"), content[k:]
                start, n = start + k, n - k
            else:
                name = name.removesuffix("/")
            kind = stat.S_IFLNK if thin else stat.S_IFREG
            bits = int(mode or "0", 8) & 0o7777
            yield row(name, offsetheader=at, offset=start, size=n, mtime=float(mtime or 0), uid=int(uid or 0), gid=int(gid or 0), mode=kind | bits, linkname=name if thin else "", content=None if thin else content)
        at = start + (n if stored else 0)
        at += at % 2


def asar(data: bytes, options: dict) -> Iterator[Row]:
    """A JSON tree of files before their bytes, flattened depth first."""
    _, size, _, n = struct.unpack("<4I", data[:16])
    base = 8 + size
    todo = [("", json.loads(data[16 : 16 + n])["files"])]
    while todo:
        path, files = todo.pop()
        for name, f in files.items():
            full = f"{path}/{name}"
            if "files" in f:
                yield row(full, offsetheader=0, mode=stat.S_IFDIR | 0o755, type="5")
                todo.append((full, f["files"]))
            elif "link" in f:
                yield row(full, offsetheader=0, mode=stat.S_IFLNK | 0o755, linkname=f["link"], type="2")
            else:
                at = None if f.get("unpacked") else base + int(f["offset"])
                mode = 0o755 if f.get("executable") else 0o644
                yield row(full, offsetheader=0, offset=at, size=int(f["size"]), mode=stat.S_IFREG | mode, content=None if at is None else data[at : at + int(f["size"])])


def sqlar(data: bytes, options: dict) -> Iterator[Row]:
    """SQLite archives: sz -1 is a symbolic link, another sz than the data's length is deflated."""
    with tempfile.TemporaryDirectory() as folder:
        file = os.path.join(folder, "a.sqlar")
        with open(file, "wb") as f:
            f.write(data)
        with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as con:
            for i, (name, mode, mtime, sz, blob) in enumerate(con.execute("SELECT name, mode, mtime, sz, data FROM sqlar ORDER BY rowid")):
                folder_ = stat.S_ISDIR(mode or 0)
                if sz == -1:
                    yield row(name, offsetheader=i, mode=mode, mtime=float(mtime or 0), linkname=blob.decode() if isinstance(blob, bytes) else str(blob), type="2")
                else:
                    content = None if folder_ or not wanted(options) else zlib.decompress(blob) if blob is not None and len(blob) != sz else blob or b""
                    yield row(name, offsetheader=i, size=0 if folder_ else sz, mode=mode, mtime=float(mtime or 0), content=content, type="5" if folder_ else "0")


class _Urls(html.parser.HTMLParser):
    """data: URLs of attributes, with the name they were saved from if the page keeps it, and where they lie."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str, str | None]] = []
        self.lines = [0, *(m.end() for m in re.finditer("\n", page))]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named, source = dict(attrs), self.get_starttag_text() or ""
        line, column = self.getpos()
        begin, after = self.lines[line - 1] + column, 0
        for key, value in attrs:
            for url in re.findall(r"data:[^\s\"'()<>]+", value or "") if key == "style" else [value] if (value or "").startswith("data:") else []:
                at = source.find(url[:64], after)  # not there only if it is written with character references
                after = at + len(url) if at >= 0 else after
                self.found.append((begin + max(at, 0), url, named.get(f"data-savepage-{key}")))


def html_(data: bytes, options: dict) -> Iterator[Row]:
    """Files that a page holds as data: URLs; named by their saved URL or by digest and type.  Offsets count characters."""
    text = data.decode(options.get("encoding", "utf-8"), "replace")
    parser = _Urls(text)
    parser.feed(text)
    for i, (at, url, saved) in enumerate(parser.found):
        m = re.match(r"(?is)data:([^;,]*)((?:;[^;,]*)*),(.*)", url)
        if not m:
            continue
        body = urllib.parse.unquote_to_bytes(m[3])
        if ";base64" in m[2].lower():
            body = re.sub(rb"[^A-Za-z0-9+/_-]", b"", body)
            body = base64.b64decode(body + b"=" * (-len(body) % 4), altchars=b"-_" if b"-" in body or b"_" in body else None)
        ext = mimetypes.guess_extension(m[1] or "text/plain") or ""
        name = urllib.parse.urlparse(saved).path if saved else hashlib.sha256(body).hexdigest() + ext
        yield row(name or f"file{i}", offsetheader=at, offset=at, size=len(body), content=body)


# First bytes of a stream's first packet, by codec, as Xiph's list of media types in Ogg has them, and of OGM.
OGG_CODECS = (
    ("audio", "celt", b"CELT    "),
    ("audio", "flac", b"\x7fFLAC"),
    ("audio", "opus", b"OpusHead"),
    ("audio", "pcm", b"PCM     "),
    ("audio", "speex", b"Speex   "),
    ("audio", "vorbis", b"\x01vorbis"),
    ("audio", "ogm", b"\x01audio"),
    ("text", "cmml", b"CMML\x00\x00\x00\x00"),
    ("text", "kate", b"\x80kate\x00\x00\x00"),
    ("text", "midi", b"OggMIDI\x00"),
    ("text", "ogm", b"\x01text"),
    ("video", "dirac", b"BBCD\x00"),
    ("video", "jng", b"\x8bJNG\r\n\x1a\n"),
    ("video", "mng", b"\x8aMNG\r\n\x1a\n"),
    ("video", "png", b"\x89PNG\r\n\x1a\n"),
    ("video", "theora", b"\x80theora"),
    ("video", "yuv4mpeg", b"YUV4MPEG"),
    ("video", "ogm", b"\x01video"),
)


def ogg(data: bytes, options: dict) -> Iterator[Row]:
    """Streams of an Ogg file, each the whole pages of one serial number; linkname has their (offset, size)."""
    pages: dict[int, list[tuple[int, int]]] = {}
    first: dict[int, int] = {}
    at = 0
    while data[at : at + 4] == b"OggS":
        if len(data) < at + 27:
            raise ValueError(f"page at {at} is cut off")
        serial, n = struct.unpack("<I", data[at + 14 : at + 18])[0], data[at + 26]
        body = at + 27 + n
        end = body + sum(data[at + 27 : body])
        if end > len(data):
            raise ValueError(f"page at {at} is cut off")
        pages.setdefault(serial, []).append((at, end - at))
        first.setdefault(serial, body)
        at = end
    for serial, own in pages.items():
        head = data[first[serial] : first[serial] + 16]
        media, codec = next(((m, c) for m, c, magic in OGG_CODECS if head.startswith(magic)), ("unknown", ""))
        suffix = "ogm" if codec == "ogm" else {"audio": "oga", "video": "ogv"}.get(media, "ogg")
        content = b"".join(data[a : a + n] for a, n in own) if wanted(options) else None
        yield row(f"{media}_{serial:08x}.{suffix}", offsetheader=own[0][0], offset=first[serial], size=sum(n for _, n in own), mode=stat.S_IFREG | 0o644, content=content, linkname=json.dumps(own))


def cpio(data: bytes, options: dict) -> Iterator[Row]:
    """Portable (newc) CPIO archives."""
    at = 0
    while data[at : at + 6] in (b"070701", b"070702"):
        f = [int(data[at + 6 + 8 * i : at + 14 + 8 * i], 16) for i in range(13)]
        _, mode, uid, gid, _, mtime, size, _, _, _, _, n, _ = f
        name = data[at + 110 : at + 110 + n - 1].decode("utf-8", "replace")
        start = at + -(-(110 + n) // 4) * 4
        if name == "TRAILER!!!":
            return
        content = data[start : start + size]
        if len(content) < size:
            raise ValueError(f"member at {at} is cut off")
        link = content.decode("utf-8", "replace") if stat.S_ISLNK(mode) else ""
        yield row(name, offsetheader=at, offset=start, size=size, mtime=float(mtime), mode=mode, uid=uid, gid=gid, linkname=link, content=content if stat.S_ISREG(mode) and wanted(options) else None)
        at = start + -(-size // 4) * 4


def rpm(data: bytes, options: dict) -> Iterator[Row]:
    """Files of an RPM package; offsets are those in its inflated payload."""
    yield from cpio(decompress(data) or b"", options)


def warc(data: bytes, options: dict) -> Iterator[Row]:
    """Records of a WARC file, named by their target."""
    at = 0
    for i in range(len(data)):
        if data[at : at + 7] != b"WARC/1.":
            return
        end = data.index(b"\r\n\r\n", at) + 4
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(head["content-length"])
        target = head.get("warc-target-uri", "").split("://", 1)[-1] or f"{head.get('warc-type', 'record')}-{i}"
        yield row(target, offsetheader=at, offset=end, size=size, content=data[end : end + size])
        at = end + size + 4


PARSERS: dict[str, Parser] = {
    "tar": tar, "zip": zip_, "ar": ar, "ar-thin": ar, "asar": asar, "sqlar": sqlar, "html": html_, "ogg": ogg, "cpio": cpio, "warc": warc, "compressed": compressed,
    "7z": images.sevenzip, "rar": images.rar, "xar": images.xar, "cab": images.cab, "iso9660": images.iso, "fat": images.fat, "squashfs": images.squashfs, "catalog": images.sqlite_catalog, "ext4": images.ext4, "pdf": images.pdf, "rpm": rpm,
}


def recognise(data: bytes, name: str = "") -> list[str]:
    """Parsers that may fit, likeliest first."""
    out = []
    if is_tar(data):
        out.append("tar")
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        out.append("zip")
    if data.startswith(b"!<arch>\n") or data.startswith(b"!<thin>\n"):
        out.append("ar")
    if data.startswith(b"SQLite format 3\x00"):
        out += ["sqlar", "catalog"]
    if data.startswith(b"\x04\x00\x00\x00") and data[16:17] == b"{":
        out.append("asar")
    if data.startswith(b"OggS\x00"):
        out.append("ogg")
    if data[:6] in (b"070701", b"070702"):
        out.append("cpio")
    if data.startswith(b"WARC/1."):
        out.append("warc")
    out += [kind for kind, magic in (("7z", b"7z\xbc\xaf\x27\x1c"), ("rar", b"Rar!\x1a\x07\x01\x00"), ("xar", b"xar!"), ("cab", b"MSCF"), ("squashfs", b"hsqs")) if data.startswith(magic)]
    if data[0x8001:0x8006] == b"CD001":
        out.append("iso9660")
    if images.is_ext4(data):
        out.append("ext4")
    if data.startswith(b"%PDF-"):
        out.append("pdf")
    if data[510:512] == b"\x55\xaa" and data[:1] in (b"\xeb", b"\xe9"):
        out.append("fat")
    if re.match(rb"(?is)\s*<(!doctype html|html)", data[:1024]):
        out.append("html")
    if not out and (known(data) or name.lower().endswith(".deflate")):
        if re.search(r"(?i)\.(tar\.[a-z0-9]+|t(gz|bz2?|xz|zst|b2|z2))$", name) or is_tar(decompress(data, name) or b""):
            out.append("tar")
        if data.startswith(b"\xed\xab\xee\xdb"):
            out.append("rpm")
        out.append("compressed")
    return out


def parse(data: bytes, name: str, options: dict) -> Iterator[Row]:
    """Rows by the first parser that takes the data; the last error if none does.

    A parser that fails after its first row has taken the data: its rows stand, and its error follows.
    """
    error: Exception = ValueError("unknown format")
    for kind in options.get("formats") or recognise(data, name):
        rows = PARSERS[kind](data, options | {"name": name.rsplit("/", 1)[-1]})
        try:
            first = next(rows, None)
        except Exception as e:  # noqa: BLE001  the next parser may fit; the last error is reported
            error = e
            continue
        if first is not None:
            yield first
            yield from rows
        return
    raise error
