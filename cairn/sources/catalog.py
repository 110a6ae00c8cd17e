"""Catalogs as sorted Parquet, read with a fixed schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DEFAULTS, FILES


def write(files: DataFrame, path: str, *, partitions: int | None = None, mode: str = "errorifexists") -> None:
    """Sorted by (path, name), so that a lookup or a folder's listing reads few row groups."""
    by = ("path", "name")
    ranged = files.repartitionByRange(partitions, *by) if partitions else files.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by, F.col("offsetheader").asc_nulls_first()).write.mode(mode).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A catalog of any age: columns that it lacks have their defaults."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name) for f in FILES))


class WrongBackend(ValueError):
    """A catalog that another backend wrote is not opened, and not written anew either."""


def check_backend(metadata: DataFrame, backend: str) -> None:
    """metadata: key, value.  Raises WrongBackend if they name another backend; catalogs of old may name none."""
    other = metadata.where((F.col("key") == "backendName") & (F.col("value") != backend)).select("value").first()
    if other:
        raise WrongBackend(f"the catalog is of {other[0]}, not of {backend}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a catalog can be read from a path: a folder of Parquet with the columns of a key."""
    try:
        return {"path", "name"} <= set(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def drop(spark: SparkSession, path: str) -> bool:
    """Delete a catalog; whether there was one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def attach(catalogs: dict[str, DataFrame]) -> DataFrame:
    """All rows of several catalogs, with their name in src."""
    out = None
    for name, df in catalogs.items():
        df = df.withColumn("src", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def sqlar_listing(table: DataFrame, folder: str) -> DataFrame:
    """Direct children of a folder in a (name, mode, mtime, sz, data) table; link targets for sz -1."""
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    rows = table.where(F.col("name").startswith(prefix)) if prefix else table
    rest = F.substring(F.col("name"), F.lit(len(prefix) + 1), F.length("name"))
    rows = rows.withColumn("_r", rest).where((F.instr("_r", "/") == 0) & (F.col("_r") != ""))
    link = F.when(F.col("sz") == -1, F.col("data").cast("string")).otherwise("")
    return rows.select(F.col("_r").alias("name"), "mode", "mtime", F.when(F.col("sz") == -1, 0).otherwise(F.col("sz")).alias("size"), link.alias("linkname"))
