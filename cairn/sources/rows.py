"""Catalog rows as dicts, which all parsers yield."""

from __future__ import annotations

import posixpath
import stat

Row = dict


def clean(text: str, encoding: str = "utf-8") -> str:
    """text, with bytes that could not be decoded (surrogates) as backslash escapes."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode(encoding, "surrogateescape").decode(encoding, "backslashreplace")


def split(name: str) -> tuple[str, str]:
    """(parent path, name) of a member's name, made absolute and normal."""
    path, _, last = posixpath.normpath("/./" + name).rpartition("/")
    return path, last


def row(name: str, **more) -> Row:
    path, last = split(clean(name))
    base = {
        "path": path, "name": last, "offsetheader": None, "offset": None, "size": 0, "mtime": 0.0, "mode": stat.S_IFREG | 0o660, "type": "0", "linkname": "", "uid": 0, "gid": 0,
        "istar": False, "issparse": False, "isgenerated": False, "recursiondepth": 0, "content": None, "xattrs": {},
    }
    return base | more | {"linkname": clean(more.get("linkname", ""))}


def wanted(options: dict) -> bool:
    """Whether contents are asked for."""
    return options.get("content", True)
