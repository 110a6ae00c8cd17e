"""Appending to a catalog.

New archive files come as a stream (binaryFile, all that is there now); each batch is parsed and
written as a version of its own, and readers take the last row of each key.  A TAR that has grown is
read from its old end on (`refresh`), if its first and last known member are still where they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.batches import small_batches
from ..operators import versions
from ..sources import archives, parsers

#: An archive is appended to rather than read anew from this size and number of members on, and up to this growth.
MIN_BYTES, MIN_FILES, MAX_GROWTH = 64 << 20, 100, 3


def ingest(spark: SparkSession, source: str, catalog: str, checkpoint: str, **options) -> int:
    """Parse all archives below source that no earlier call has seen; number of batches written.

    A batch that is repeated after a failure overwrites its own folder.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(source)
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        rows = archives.members_of(batch.select(F.col("path").alias("archive"), F.col("content").alias("data")), **options)
        archives.files_of(rows).withColumn("ingest_seq", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{catalog}/batch={number}")
        done.append(number)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(done)


def current(spark: SparkSession, catalog: str) -> DataFrame:
    """The catalog with the last row of each key."""
    rows = spark.read.parquet(catalog).drop("batch")
    return versions.upsert(rows, key=("archive", "path", "name", "offsetheader"))


_KNOWN = ("path", "name", "size", "offsetheader", "offset")


def _still_there(data: bytes, member: dict, options: dict) -> bool:
    """Whether the member that a catalog has is found at its place."""
    try:
        found = next(parsers.tar(data[member["offsetheader"] : member["offset"] + member["size"]], options | {"content": False}), None)
    except Exception:  # noqa: BLE001  whatever is there now, it is not that member
        return False
    return found is not None and all(found[k] == member[k] for k in ("path", "name", "size")) and found["offset"] == member["offset"] - member["offsetheader"]


def _tails(options: dict):
    schema = to_arrow_schema(StructType([*archives.MEMBERS, StructField("read_from", LongType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data, start = r["data"] or b"", 0
                if r["may"] and _still_there(data, r["first"], options) and _still_there(data, r["last"], options):
                    start = r["past_end"]
                rows = [{"archive": r["archive"], "path": "", "name": "", "read_from": start, "xattrs": []}]  # what was done, in a row without an error
                try:
                    if data[start : start + 1024].strip(b"\0"):
                        for x in parsers.parse(data[start:], r["archive"], options | {"content": False}):
                            moved = {k: x[k] + start for k in ("offsetheader", "offset") if x[k] is not None}
                            rows.append(x | moved | {"archive": r["archive"], "xattrs": list(x["xattrs"].items())})
                except Exception as e:  # noqa: BLE001  one bad archive is one row
                    rows.append({"archive": r["archive"], "path": "", "name": "", "error": f"{type(e).__name__}: {e}"[:500], "xattrs": []})
                for at in range(0, len(rows), archives.BATCH):
                    yield pa.RecordBatch.from_pylist(rows[at : at + archives.BATCH], schema)

    return run


def refresh(old: DataFrame, now: DataFrame, *, min_bytes: int | None = None, min_files: int | None = None, max_growth: int | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """old: files_of() rows; now: archive, data.  (rows of all archives as they are now; archive, read_from: from which byte each was read).

    The state of a catalog is an aggregate of its rows; rows of an archive whose tail alone was read are
    those it had and the tail's.  Archives that are gone from `now` have no rows.
    """
    from ..plans.tables import cut

    known = F.struct(*_KNOWN)
    plain = F.col("offsetheader").isNotNull() & F.col("offset").isNotNull()
    state = old.where(plain).groupBy("archive").agg(
        F.min_by(known, "offsetheader").alias("first"), F.max_by(known, "offsetheader").alias("last"), F.count("*").alias("files"),
        F.max((F.ceil((F.col("offset") + F.when(F.col("type").isin("0", "7"), F.col("size")).otherwise(0)) / 512) * 512).cast("long")).alias("past_end"),
    )
    size = F.octet_length("data").cast("long")
    least, files, most = (b if a is None else a for a, b in ((min_bytes, MIN_BYTES), (min_files, MIN_FILES), (max_growth, MAX_GROWTH)))
    may = (F.col("past_end") >= least) & (F.col("files") >= files) & (size >= F.col("past_end")) & (size <= most * F.col("past_end") + 10_240)
    found = now.select("archive", "data").join(state, "archive", "left").withColumn("may", F.coalesce(may, F.lit(False)))
    schema = StructType([*archives.MEMBERS, StructField("read_from", LongType())])
    small_batches(now.sparkSession)
    read = cut(found.select("archive", "data", "first", "last", "past_end", "may").mapInArrow(_tails(options), schema))
    said = read.where("read_from is not null").select("archive", "read_from")
    kept = old.join(said.where("read_from > 0").select("archive"), "archive", "left_semi")
    return kept.unionByName(archives.files_of(read.where("read_from is null"))), said


def may_append(old: Column, new: Column) -> Column:
    """old, new: structs of size, files, mtime, version, compressed.  Whether the tail alone may be read."""
    grown = (new["size"] > old["size"]) & (new["size"] <= MAX_GROWTH * old["size"])
    return ~old["compressed"] & (old["size"] >= MIN_BYTES) & (old["files"] >= MIN_FILES) & grown & (old["version"] == new["version"]) & (new["mtime"] >= old["mtime"])


def drifted(old: Column, new: Column) -> Column:
    """Names of the arguments (maps of strings) that differ."""
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    return F.sort_array(F.filter(keys, lambda k: ~F.element_at(old, k).eqNullSafe(F.element_at(new, k))))


def has_end_mark(tail: Column) -> Column:
    """Whether the bytes past the last member begin with two blocks of zeros."""
    return F.substring(tail, 1, 1024) == F.lit(bytearray(1024))
