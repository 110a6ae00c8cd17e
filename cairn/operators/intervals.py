"""Byte ranges: stencils, blocks, holes and the end of an archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stencils(segments: DataFrame, archive: str, order: list[str], size: str = "size") -> DataFrame:
    """Start of each segment in the file that its archive's segments make; empty ones are left out."""
    w = Window.partitionBy(archive).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.where(F.col(size) > 0)
    return rows.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def interval_lookup(points: DataFrame, starts: DataFrame, key: str, *, at: str = "at", start: str = "start", carry: tuple[str, ...] = ()) -> DataFrame:
    """points with the row of starts that has the greatest start at or below `at`, within the key.

    As-of join by one sort: both sides in one window, the last start carried forward.
    """
    fields = F.struct(F.col(start).alias(start), *(F.col(c).alias(c) for c in carry))
    right = starts.select(key, F.col(start).alias("_x"), F.lit(0).alias("_o"), fields.alias("_s"))
    left = points.select(key, F.col(at).alias("_x"), F.lit(1).alias("_o"), F.struct(*points.columns).alias("_p"))
    w = Window.partitionBy(key).orderBy("_x", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return _both(right, left).withColumn("_f", F.last("_s", ignorenulls=True).over(w)).where("_o = 1").select("_p.*", *(F.col("_f")[c].alias(c) for c in (start, *carry)))


def _both(right: DataFrame, left: DataFrame) -> DataFrame:
    a = right.withColumn("_p", F.lit(None).cast(left.schema["_p"].dataType))
    b = left.withColumn("_s", F.lit(None).cast(right.schema["_s"].dataType))
    return a.unionByName(b)


def holes(segments: DataFrame, archive: str, offset: str = "offset", size: str = "size") -> DataFrame:
    """Gaps between a sparse file's data segments."""
    w = Window.partitionBy(archive).orderBy(offset)
    end = F.coalesce(F.lag(F.col(offset) + F.col(size)).over(w), F.lit(0))
    return segments.withColumn("hole_start", end).withColumn("hole_size", F.col(offset) - end).where("hole_size > 0").select(archive, "hole_start", "hole_size")


def past_end(files: DataFrame, by: str | None = None, block: int = 512) -> DataFrame:
    """Where an archive's last member ends, in whole blocks; null if that member is sparse."""
    last = F.max_by(F.struct((F.col("offset") + F.col("size")).alias("end"), "issparse"), F.col("offset")).alias("r")
    df = files.groupBy(by).agg(last) if by else files.agg(last)
    keys = [by] if by else []
    return df.select(*keys, F.when(~F.col("r.issparse"), F.floor((F.col("r.end") + block - 1) / block) * block).cast("long").alias("past_end"))


def samples(files: DataFrame, k: int, *, seed: int | None = None) -> DataFrame:
    """The k first and k last rows by offsetheader, and k random ones if there is a seed; each row once."""
    first = files.orderBy(F.col("offsetheader").asc_nulls_first()).limit(k)
    last = files.orderBy(F.col("offsetheader").desc_nulls_last()).limit(k)
    out = first.union(last)
    if seed is not None:
        out = out.union(files.orderBy(F.rand(seed)).limit(k))
    return out.distinct()


def joined_parts(parts: DataFrame, by: list[str], order: str, content: str = "content") -> DataFrame:
    """Whole files from their parts in order; a file's parts fit one cell by the format's limit."""
    rows = F.sort_array(F.collect_list(F.struct(order, content)))
    return parts.groupBy(*by).agg(rows.alias("r")).select(*by, F.aggregate("r", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x[content])).alias(content))


def chunks(content: Column, n: int) -> Column:
    """A blob in pieces of n bytes, as an array of (chunk_no, data)."""
    count = F.greatest(F.ceil(F.octet_length(content) / n).cast("int"), F.lit(0))
    rows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("chunk_no"), F.substring(content, i * n + 1, F.lit(n)).alias("data")))
    return F.when(count > 0, rows)
