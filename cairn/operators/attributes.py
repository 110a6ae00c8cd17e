"""Extended attributes and content digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values
from . import versions as v

HASH_PREFIX = "user.hash."


def with_attribute(files: DataFrame, xattrs: DataFrame, key: str, alias: str, how: str = "inner") -> DataFrame:
    """files beside one attribute; the key filter is in the join's right side."""
    values_ = xattrs.where(F.col("key") == key).select("offsetheader", F.col("value").cast("string").alias(alias))
    return files.join(values_, "offsetheader", how)


def set_attributes(xattrs: DataFrame, new: DataFrame) -> DataFrame:
    rows = xattrs.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    return v.upsert(rows, key=("offsetheader", "key"), order="_seq", keep_null=None).drop("_seq")


def attributes_of(files: DataFrame, xattrs: DataFrame) -> DataFrame:
    """path, name, key, value; generated rows have none."""
    return files.where(~F.coalesce("isgenerated", F.lit(False))).join(xattrs, "offsetheader").select("path", "name", "key", "value")


def missing_hashes(files: DataFrame, xattrs: DataFrame, keys: list[str]) -> DataFrame:
    """Regular files that lack any of the keys: the work list of resumable hashing."""
    have = xattrs.where(F.col("key").isin(keys)).select("offsetheader", "key").distinct()
    full = have.groupBy("offsetheader").agg(F.count("*").alias("n")).where(F.col("n") == len(set(keys)))
    regular = files.where(values.is_regular(F.col("mode")) & F.col("offsetheader").isNotNull())
    return regular.join(full, "offsetheader", "left_anti").select(*files.columns)


def hashed(contents: DataFrame, names: list[str]) -> DataFrame:
    """contents: offsetheader, content.  One attribute row for each digest."""
    rows = F.explode(F.array(*(F.struct(F.lit(HASH_PREFIX + n).alias("key"), values.digest(n, F.col("content")).alias("hex")) for n in names)))
    return contents.select("offsetheader", rows.alias("h")).select("offsetheader", "h.key", F.col("h.hex").cast("binary").alias("value"))


def dictionary(xattrs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keyid, key) and (offsetheader, keyid, value); keyid numbers the keys in order."""
    from pyspark.sql import Window

    keys = xattrs.select("key").distinct().withColumn("keyid", F.row_number().over(Window.orderBy("key")).cast("long"))
    return keys, xattrs.join(keys, "key").select("offsetheader", "keyid", "value")
