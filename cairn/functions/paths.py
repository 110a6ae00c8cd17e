"""Paths: a row has a parent `path` (the root is the empty string) and a `name`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _resolved(parts: Column, keep_leading: bool) -> Column:
    """Fold '..' parts away; at the root they vanish, or stay if keep_leading."""

    def step(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        can_pop = (F.size(done) > 0) & (last != "..") if keep_leading else F.size(done) > 0
        grown = F.concat(done, F.array(part))
        up = F.when(can_pop, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(grown if keep_leading else done)
        return F.when(part == "..", up).otherwise(grown)

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))


def normpath(path: Column | str) -> Column:
    """Absolute, without empty, '.' and '..' parts."""
    return F.concat(F.lit("/"), F.array_join(_resolved(_parts(_col(path)), False), "/"))


def query_normpath(path: Column | str) -> Column:
    """normpath, but an input that starts with '../' keeps the '..' parts that lead out of the root."""
    p = _col(path)
    return F.when(p.startswith("../"), F.concat(F.lit("/"), F.array_join(_resolved(_parts(p), True), "/"))).otherwise(normpath(p))


def dirname(full: Column | str) -> Column:
    """What stands before the last slash."""
    p = _col(full)
    return F.substring(p, F.lit(1), F.greatest(F.length(p) - F.length(basename(p)) - 1, F.lit(0)))


def basename(full: Column | str) -> Column:
    return F.substring_index(_col(full), "/", -1)


def extension(name: Column | str) -> Column:
    """Lower-cased last extension without its dot, empty if there is none."""
    return F.lower(F.regexp_extract(_col(name), r"(?s)[^/.][^/]*\.([^./]*)\z", 1))


def join(path: Column | str, name: Column | str) -> Column:
    return F.concat(_col(path), F.lit("/"), _col(name))


def ancestors(path: Column | str) -> Column:
    """All (path, name) of the folders of a parent path, outermost first; none for the root."""
    parts = F.filter(F.split(_col(path), "/"), lambda x: x != "")
    n = F.size(parts)

    def at(i: Column) -> Column:
        head = F.array_join(F.slice(parts, 1, i - 1), "/")
        return F.struct(F.when(i > 1, F.concat(F.lit("/"), head)).otherwise("").alias("path"), F.element_at(parts, i).alias("name"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), at)).otherwise(F.array().cast("array<struct<path:string,name:string>>"))


def prefixes(full: Column | str) -> Column:
    """A full path and all its ancestors, '' (the root) first."""
    parts = F.filter(F.split(_col(full), "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.when(i > 0, F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))).otherwise(""))


def depth(path: Column | str) -> Column:
    return F.size(F.filter(F.split(_col(path), "/"), lambda x: x != ""))


def split_digits(extension_: Column | str) -> Column:
    """(alphabet, width, number) of an extension of split files; null if it is none."""
    e = _col(extension_)
    alpha = F.aggregate(
        F.split(e, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * 26 + (F.ascii(c) - 97))
    )
    return (
        F.when(e.rlike(r"\A[0-9]+\z"), F.struct(F.lit("decimal").alias("alphabet"), F.length(e).alias("width"), F.conv(e, 10, 10).cast("long").alias("number")))
        .when(e.rlike(r"\A[a-z]+\z"), F.struct(F.lit("alpha").alias("alphabet"), F.length(e).alias("width"), alpha.alias("number")))
        .when(e.rlike(r"\A[0-9a-f]+\z"), F.struct(F.lit("hex").alias("alphabet"), F.length(e).alias("width"), F.conv(e, 16, 10).cast("long").alias("number")))
    )


def format_number(number: Column | str, alphabet: str, width: int) -> Column:
    """A number in the base of an alphabet, padded with its first character."""
    n, base = _col(number).cast("long"), len(alphabet)
    digits = [F.substring(F.lit(alphabet), (F.floor(n / (base**k)) % base + 1).cast("int"), F.lit(1)) for k in reversed(range(width))]
    return F.concat(*digits)
