"""Upserts, versioned lookups and listings.

Versions of a member are its rows by offsetheader, nulls first: version 1 is the oldest, 0 the
newest, -1 the one before.  A null offsetheader equals no other in a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEMBER = ("path", "name")


def upsert(files: DataFrame, *, key: tuple[str, ...] = ("path", "name", "offsetheader"), order: str = "ingest_seq", keep_null: str | None = "offsetheader") -> DataFrame:
    """The last row in ingest order of each key; rows whose keep_null column is null all stay.

    An aggregate, so that rows of a hot key meet map-side.
    """
    others = [c for c in files.columns if c not in key]
    whole = files if keep_null is None else files.where(F.col(keep_null).isNotNull())
    last = whole.groupBy(*key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_r")).select(*[F.col(c) if c in key else F.col("_r")[c].alias(c) for c in files.columns])
    return last if keep_null is None else last.unionByName(files.where(F.col(keep_null).isNull()))


def ranked(files: DataFrame, *by: str, order: tuple[str, ...] = ("offsetheader",)) -> DataFrame:
    """version (1 is the oldest) and behind (0 is the newest) of every row."""
    by = by or MEMBER
    w = Window.partitionBy(*by)
    up = w.orderBy(*(F.col(c).asc_nulls_first() for c in order))
    down = w.orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return files.withColumn("version", F.row_number().over(up).cast("long")).withColumn("behind", (F.row_number().over(down) - 1).cast("long"))


def versions(files: DataFrame) -> DataFrame:
    return ranked(files).drop("behind")


def lookup(files: DataFrame, version: int = 0, *, order: tuple[str, ...] = ("offsetheader",), by: tuple[str, ...] = MEMBER) -> DataFrame:
    """One version of every member: positive counts from the oldest, 0 and below from the newest."""
    if version == 0 and len(order) == 1:
        return newest(files, by, order[0])
    df = ranked(files, *by, order=order)
    wanted = F.col("version") == version if version > 0 else F.col("behind") == -version
    return df.where(wanted).drop("version", "behind")


def newest(files: DataFrame, by: tuple[str, ...] = MEMBER, order: str = "offsetheader", **more: Column) -> DataFrame:
    """lookup 0 as an aggregate: no sort, and hot members meet map-side.  A null order is the oldest.  more: aggregates beside it."""
    rest = [c for c in files.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), F.col(order)))
    found = files.groupBy(*by).agg(best.alias("_r"), *(c.alias(k) for k, c in more.items()))
    return found.select(*[F.col(c) if c in by else F.col("_r")[c].alias(c) for c in files.columns], *more)


def lookup_path(files: DataFrame, path: str, name: str, version: int = 0) -> DataFrame:
    """One member's row; filters reach the scan."""
    rows = files.where((F.col("path") == path) & (F.col("name") == name))
    if version > 0:
        return rows.orderBy(F.col("offsetheader").asc_nulls_first()).offset(version - 1).limit(1)
    return rows.orderBy(F.col("offsetheader").desc_nulls_last()).offset(-version).limit(1)


def listing(files: DataFrame, path: str | None = None) -> DataFrame:
    """Newest version of each name of a folder (or of all folders), with `position`, the place of its first version."""
    rows = files if path is None else files.where(F.col("path") == path)
    return newest(rows.where(F.col("name") != ""), position=F.min("offsetheader"))


def list_mode(files: DataFrame, path: str | None = None) -> DataFrame:
    rows = (files if path is None else files.where(F.col("path") == path)).select("path", "name", "mode", "offsetheader")
    return newest(rows.where(F.col("name") != "")).select("path", "name", "mode")


def file_count(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"))


def version_folders(files: DataFrame, suffix: str = ".versions") -> DataFrame:
    """Listing of every virtual folder <file>.versions: names 1 to N; a real member of that name hides it."""
    n = files.where(F.col("name") != "").groupBy(*MEMBER).agg(F.count("*").alias("n"))
    real = files.select("path", F.col("name").alias("folder")).distinct()
    named = n.withColumn("folder", F.concat("name", F.lit(suffix))).join(real, ["path", "folder"], "left_anti")
    rows = named.select(F.concat("path", F.lit("/"), "folder").alias("path"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("v"))
    return rows.select("path", F.col("v").cast("string").alias("name"))


def decode_version_path(full: Column, suffix: str = ".versions") -> Column:
    """Struct of the file's path and version that a path <file>.versions/<n> names; version 0 for all others."""
    pattern = rf"(?s)\A(.+){suffix.replace('.', chr(92) + '.')}/([0-9]+)((?:/.*)?)\z"
    hit = full.rlike(pattern)
    return F.struct(
        F.when(hit, F.concat(F.regexp_extract(full, pattern, 1), F.regexp_extract(full, pattern, 3))).otherwise(full).alias("path"),
        F.when(hit, F.regexp_extract(full, pattern, 2).cast("int")).otherwise(0).alias("version"),
    )
