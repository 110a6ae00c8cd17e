"""Reports over catalogs of several disks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..operators import attributes


def unbacked(main: DataFrame, others: DataFrame, *, digest: str = "sha256", source: str = "src", threshold: int = 1) -> DataFrame:
    """Files of main whose content is on fewer than threshold other disks: full_path, copies.

    Both sides are brought down to distinct digests before they meet, so a digest that a third of
    all files share is one row; files without a digest are left out.
    """
    known = main.where(F.col(digest).isNotNull())
    there = others.where(F.col(digest).isNotNull()).select(digest, source).distinct()
    copies = known.select(digest).distinct().join(there, digest, "left").groupBy(digest).agg(F.count(source).alias("copies"))
    few = copies.where(F.col("copies") < threshold)
    return known.join(few, digest).select(F.concat("path", F.lit("/"), "name").alias("full_path"), "copies")


def duplicates(files: DataFrame, *, digest: str = "sha256") -> DataFrame:
    """Digests of more than one file: how many, and the bytes that one copy each would free."""
    df = files.groupBy(digest).agg(F.count("*").alias("files"), F.max("size").alias("size"))
    return df.where("files > 1").select(digest, "files", ((F.col("files") - 1) * F.col("size")).alias("wasted"))


#: Names of these kinds often have brackets that hold no check sum.
NO_CHECKSUM = (".srt", ".ass", ".trashinfo", ".png")


def crc_mismatches(files: DataFrame, xattrs: DataFrame) -> DataFrame:
    """Files whose name holds another CRC-32 than their attribute: full_path, crc_from_name, crc_from_xattr."""
    named = files.withColumn("crc_from_name", values.crc_from_name(F.col("name"))).where("crc_from_name is not null")
    for suffix in NO_CHECKSUM:
        named = named.where(~F.lower("name").endswith(suffix))
    both = attributes.with_attribute(named, xattrs, "user.hash.crc32", "v").withColumn("crc_from_xattr", F.lower(F.trim("v")))
    return both.where("crc_from_name <> crc_from_xattr").select(F.concat("path", F.lit("/"), "name").alias("full_path"), "crc_from_name", "crc_from_xattr")


def unbacked_files(main_files: DataFrame, main_xattrs: DataFrame, disks: list[tuple[DataFrame, DataFrame]], *, threshold: int = 1, any_kind: bool = False) -> DataFrame:
    """unbacked() over catalogs with attributes, without files whose name contradicts their CRC.

    any_kind keeps folders that share a member's offsetheader, as a plain join on it does.
    """
    files = main_files if any_kind else main_files.where(values.is_regular(F.col("mode")))
    main = attributes.with_attribute(files, main_xattrs, "user.hash.sha256", "sha256").select("path", "name", "sha256")
    others = None
    for i, (f, x) in enumerate(disks):
        part = attributes.with_attribute(f, x, "user.hash.sha256", "sha256").select("sha256").withColumn("src", F.lit(f"disk{i}"))
        others = part if others is None else others.unionByName(part)
    report = unbacked(main, others, threshold=threshold)
    return report.join(crc_mismatches(main_files, main_xattrs).select("full_path").distinct(), "full_path", "left_anti")
