"""Archives as DataFrames of members."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import MapType, StringType, BinaryType, StructField, StructType

from ..functions import formats, paths
from ..functions.batches import small_batches
from ..operators import compose
from ..schema import FILES, XATTRS
from . import parsers
from .rows import clean

MEMBERS = StructType(
    [StructField("archive", StringType()), *[StructField(f.name, f.dataType) for f in FILES], StructField("content", BinaryType()), StructField("xattrs", MapType(StringType(), BinaryType())), StructField("error", StringType())]
)
#: Rows of one Arrow batch of members, and bytes of their contents after which a batch is full.
BATCH, BATCH_CONTENT = 256, 4 << 20


def _parse(options: dict, with_content: bool):
    schema = to_arrow_schema(MEMBERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for name, data in zip(batch.column("archive"), batch.column("data"), strict=True):
                archive = name.as_py()
                try:
                    for r in parsers.parse(data.as_py() or b"", archive, options | {"content": with_content}):
                        held.append(r | {"archive": archive, "error": None, "content": r["content"] if with_content else None, "xattrs": list(r["xattrs"].items())})
                        size += len(held[-1]["content"] or b"")
                        if len(held) >= BATCH or size >= BATCH_CONTENT:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                except Exception as e:  # noqa: BLE001  one bad archive is one row, after the members before the damage
                    held.append({"archive": archive, "path": "", "name": "", "error": clean(f"{type(e).__name__}: {e}"[:500]), "xattrs": []})
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


def members_of(archives: DataFrame, *, content: bool = False, **options) -> DataFrame:
    """archives: archive (a name), data (bytes).  One row per member; what can't be read of an archive is one row with `error`."""
    small_batches(archives.sparkSession)
    return archives.select("archive", "data").mapInArrow(_parse(options, content), MEMBERS)


def read(spark: SparkSession, path: str, *, content: bool = False, glob: str | None = None, transform: tuple[str, str] | None = None, **options) -> DataFrame:
    """Members of all archives below a path.

    transform: (pattern, replacement) on each member's full path before it is made normal.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = members_of(reader.load(path).select(F.col("path").alias("archive"), F.col("content").alias("data")), content=content, **options)
    return transformed(rows, *transform) if transform else rows


def transformed(rows: DataFrame, pattern: str, replacement: str) -> DataFrame:
    from ..functions import values

    full = paths.normpath(values.apply_transform(paths.join("path", "name"), pattern, replacement))
    return rows.withColumn("_f", full).withColumn("path", paths.dirname("_f")).withColumn("name", paths.basename("_f")).drop("_f")


def files_of(members: DataFrame) -> DataFrame:
    """Catalog rows, unreadable archives left out."""
    return members.where("error is null").select("archive", *[f.name for f in FILES])


def xattrs_of(members: DataFrame) -> DataFrame:
    return members.select("archive", "offsetheader", F.explode("xattrs")).select("archive", *[f.name for f in XATTRS])


def folder(spark: SparkSession, path: str) -> DataFrame:
    """A live folder's files with size and time; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.lit(path if "://" in path or path.startswith("file:") else "file:" + path)
    rest = F.replace(F.col("path"), root, F.lit(""))
    return rows.select(paths.dirname(rest).alias("path"), paths.basename(rest).alias("name"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))


def indexed_folder(spark: SparkSession, path: str) -> DataFrame:
    """folder() with an ordinal in order of folder and name as offsetheader."""
    from pyspark.sql import Window

    rows = folder(spark, path)
    w = Window.partitionBy("path").orderBy("name")
    before = rows.groupBy("path").agg(F.count("*").alias("n"))  # one row a folder is ranked, not one a file
    before = before.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(before.select("path", "base"), "path").withColumn("offsetheader", F.col("base") + F.row_number().over(w) - 1).drop("base")


def is_archive(name: Column) -> Column:
    return F.size(F.array_union(formats.by_extension(name, "archive"), formats.by_extension(name, "compressed"))) > 0


def recursive(archives: DataFrame, *, max_depth: int | None = None, strip: bool = False, mount_transform: tuple[str, str] | None = None, content: bool = False, **options) -> DataFrame:
    """Members of archives and of the archives in them, down to max_depth if it is given; nested ones are folders.

    A nested archive that can't be read keeps its row, and has one more with `error` at its place.

    strip: mount a nested archive without its suffix.  mount_transform: (pattern, replacement) on its mount point.
    """
    rules = formats.suffix_rules(["/archive/", "/compressed/"])
    nested = is_archive(F.col("name"))

    def slim(rows: DataFrame) -> DataFrame:
        """Contents that no further round needs don't travel."""
        return rows if content else rows.withColumn("content", F.when(nested, F.col("content")))

    top = slim(members_of(archives, content=True, **options))

    def expand(found: DataFrame) -> DataFrame:
        keyed = found.select(F.concat("archive", F.lit("\0"), "mount").alias("archive"), F.col("content").alias("data"))
        inner = slim(members_of(keyed, content=True, **options))
        return inner.withColumn("mount", F.substring_index("archive", "\0", -1)).withColumn("archive", F.substring_index("archive", "\0", 1))

    def mount(full: Column) -> Column:
        return compose.mount_points(full, rules=rules if strip else None, transform=mount_transform)

    out = compose.automount(top, expand, is_archive=nested & F.col("content").isNotNull(), mount_point=mount, max_depth=max_depth)
    return out if content else out.drop("content")


def checked(archives: DataFrame) -> DataFrame:
    """archives: archive, data.  archive, formats (by content, else by name), readable, and why not: what an input check tells."""
    by_content = formats.detect(F.col("data"))
    found = F.when(F.size(by_content) > 0, by_content).otherwise(formats.by_extension(F.col("archive")))
    able = F.size(F.array_intersect("formats", F.array(*map(F.lit, READABLE)))) > 0
    why = F.when(F.octet_length("data") == 0, "empty").when(F.size("formats") == 0, "unknown format").when(~able, F.concat(F.lit("no parser of "), F.array_join("formats", ", ")))
    rows = archives.select("archive", found.alias("formats"), F.col("data"))
    return rows.withColumn("readable", able & (F.octet_length("data") > 0)).withColumn("problem", why).drop("data")


#: Names of functions.formats that parsers read.
READABLE = tuple(parsers.PARSERS) + ("gzip", "bzip2", "xz", "zstandard", "zlib", "deflate", "lz4", "lzip", "lzma", "compress", "uu", "rpm")
