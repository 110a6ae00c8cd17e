"""Schemas of the catalog tables."""

from __future__ import annotations

from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _schema(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _L, _D, _I, _B, _X = StringType(), LongType(), DoubleType(), IntegerType(), BooleanType(), BinaryType()

#: One row per archive member; key (path, name, offsetheader), where a null offsetheader equals nothing.
FILES = _schema(
    ("path", _S, False), ("name", _S, False), ("offsetheader", _L, True), ("offset", _L, True), ("size", _L, True), ("mtime", _D, True), ("mode", _I, True), ("type", _S, True),
    ("linkname", _S, True), ("uid", _I, True), ("gid", _I, True), ("istar", _B, True), ("issparse", _B, True), ("isgenerated", _B, True), ("recursiondepth", _I, True),
)
XATTRS = _schema(("offsetheader", _L, True), ("key", _S, False), ("value", _X, True))
METADATA = _schema(("key", _S, False), ("value", _S, False))
VERSIONS = _schema(("name", _S, False), ("version", _S, False), ("major", _I, True), ("minor", _I, True), ("patch", _I, True))
BLOCKS = _schema(("archive_id", _S, False), ("blockoffset", _L, False), ("dataoffset", _L, False))
OVERLAY = _schema(("path", _S, False), ("name", _S, False), ("mtime", _D, True), ("mode", _I, True), ("uid", _I, True), ("gid", _I, True), ("deleted", _B, True))
SQLAR = _schema(("name", _S, False), ("mode", _I, True), ("mtime", _L, True), ("sz", _L, True), ("data", _X, True))

#: What a column is in a catalog that was written without it.
DEFAULTS = {"offsetheader": 0, "istar": False, "issparse": False, "isgenerated": False, "recursiondepth": 0}
