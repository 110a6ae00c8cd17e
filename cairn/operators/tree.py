"""Folders: missing parents, subtrees, mount points by longest prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, values

FOLDER_MODE = 0o555 | values.S_IFDIR


def parents(files: DataFrame, *, order: str = "ingest_seq") -> DataFrame:
    """Every ancestor (path, name) of the rows, with the offsets of the first row that implies it."""
    # a folder's first row implies all its ancestors, so one row for each folder is exploded
    rows = files.groupBy("path").agg(F.min_by(F.struct(order, "offsetheader", "offset"), F.col(order)).alias("r"))
    rows = rows.select(F.explode(paths.ancestors("path")).alias("a"), "r.*")
    first = rows.groupBy("a.path", "a.name").agg(F.min_by(F.struct("offsetheader", "offset"), F.col(order)).alias("r"))
    return first.select("path", "name", F.col("r.offsetheader").alias("offsetheader"), F.col("r.offset").alias("offset"))


def missing_parents(files: DataFrame, *, order: str = "ingest_seq") -> DataFrame:
    """Parents that no folder row of the catalog stands for."""
    folders = files.where(values.has_dir_bit(F.col("mode"))).select("path", "name").distinct()
    return parents(files, order=order).join(folders, ["path", "name"], "left_anti")


def with_parents(files: DataFrame, *, order: str = "ingest_seq") -> DataFrame:
    """files and a generated row for each missing parent."""
    made = missing_parents(files, order=order)
    fixed = {
        "size": F.lit(0), "mtime": F.lit(0.0), "mode": F.lit(FOLDER_MODE), "type": F.lit("5"), "linkname": F.lit(""), "uid": F.lit(0), "gid": F.lit(0),
        "istar": F.lit(False), "issparse": F.lit(False), "isgenerated": F.lit(True), "recursiondepth": F.lit(0),
    }
    for f in files.schema:
        if f.name not in made.columns:
            made = made.withColumn(f.name, fixed.get(f.name, F.lit(None)).cast(f.dataType))
    return files.unionByName(made.select(*files.columns))


def subtree(files: DataFrame, root: str) -> DataFrame:
    """Rows below a folder, at any depth.  Both filters are on path alone, so a scan of a catalog sorted by it skips the rest."""
    top = root.rstrip("/")
    return files.where((F.col("path") == top) | F.col("path").startswith(top + "/"))


def folder_sizes(files: DataFrame) -> DataFrame:
    """Count and total size of the regular files below every folder, at any depth; '' is the root."""
    rows = files.where(values.is_regular(F.col("mode"))).groupBy("path").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s"))
    rows = rows.select(F.explode(paths.prefixes("path")).alias("folder"), "n", "s")
    return rows.groupBy("folder").agg(F.sum("n").alias("files"), F.sum("s").alias("bytes"))


def longest_prefix(requests: DataFrame, mounts: DataFrame, *, path: str = "full_path", mount: str = "mount") -> DataFrame:
    """requests with the deepest mount point that is their path or an ancestor of it, and the rest of the path.

    An equi-join on each ancestor: no range join, and mounts are deduplicated first.
    """
    points = mounts.select(F.col(mount).alias("_p")).distinct()
    wanted = requests.select(F.col(path)).distinct()
    found = wanted.withColumn("_p", F.explode(paths.prefixes(path))).join(points, "_p")
    best = found.groupBy(path).agg(F.max_by("_p", F.length("_p")).alias("mount"))
    out = requests.join(best, path, "left")
    return out.withColumn("rest", F.when(F.col("mount").isNotNull(), F.substring(F.col(path), F.length("mount") + 1, F.length(path))))
