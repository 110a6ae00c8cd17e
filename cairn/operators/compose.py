"""Composition of catalogs: unions, subvolumes, prefixes, nested mounts and overlays."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats, paths, values
from . import versions as v

ORDER = ("source_idx", "offsetheader")


def union(sources: list[DataFrame]) -> DataFrame:
    """All rows with source_idx, the place of their source; later sources come later in version order."""
    return reduce(DataFrame.unionByName, [s.withColumn("source_idx", F.lit(i)) for i, s in enumerate(sources)])


def union_lookup(rows: DataFrame, version: int = 0) -> DataFrame:
    """Version 0 is the newest of the rightmost source that has the member."""
    return v.lookup(rows, version, order=ORDER)


def union_versions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path", "name").agg(F.count("*").alias("versions"))


def union_listing(rows: DataFrame, precedence: str = "right") -> DataFrame:
    """One row per member: its newest version in the rightmost source, or in the leftmost."""
    side = F.col("source_idx") if precedence == "right" else -F.col("source_idx")
    rest = [c for c in rows.columns if c not in ("path", "name")]
    best = F.max_by(F.struct(*rest), F.struct(side, F.col("offsetheader").isNotNull(), F.col("offsetheader")))
    return rows.groupBy("path", "name").agg(best.alias("_r")).select("path", "name", "_r.*")


def under_prefix(files: DataFrame, prefix: str) -> DataFrame:
    """The catalog moved below a folder."""
    return files.withColumn("path", F.concat(F.lit(prefix.rstrip("/")), "path"))


def subvolumes(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Each source below its own folder; a name that comes again gets .1, .2, ..."""
    seen: dict[str, int] = {}
    out = []
    for name, df in sources:
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(under_prefix(df, f"/{name}.{n}" if n else f"/{name}"))
    return reduce(DataFrame.unionByName, out)


def strip_prefix(files: DataFrame, prefix: str) -> DataFrame:
    """Rows below a folder, with it as their root."""
    p = prefix.rstrip("/")
    rows = files.where((F.col("path") == p) | F.col("path").startswith(p + "/"))
    return rows.withColumn("path", F.substring(F.col("path"), F.lit(len(p) + 1), F.length("path")))


def mounted(files: DataFrame, mounts: DataFrame) -> DataFrame:
    """A listing where a file that is a mount point is shown as its root folder: mounts has path, name."""
    points = mounts.select("path", "name").distinct().withColumn("_m", F.lit(True))
    df = files.join(points, ["path", "name"], "left")
    hit = F.coalesce("_m", F.lit(False))
    return df.withColumn("mode", F.when(hit, values.folder_mode(F.col("mode"))).otherwise(F.col("mode"))).withColumn("is_mount", hit).drop("_m")


def mounted_versions(files: DataFrame, mounts: DataFrame) -> DataFrame:
    """Versions of a member; a mount point's root is one more on top of the archive's own."""
    n = files.groupBy("path", "name").agg(F.count("*").alias("n"))
    points = mounts.select("path", "name").distinct().withColumn("_m", F.lit(1))
    return n.join(points, ["path", "name"], "left").select("path", "name", (F.col("n") + F.coalesce("_m", F.lit(0))).alias("versions"))


def automount(files: DataFrame, expand: Callable[[DataFrame], DataFrame], *, is_archive, mount_point, max_depth: int | None = None) -> DataFrame:
    """files and the members of nested archives, breadth first, down to max_depth or until no archive is left.

    expand: rows of archives to rows of members, whose path is relative to the archive.  The
    mount point of a row is mount_point(full path).  One round for each level; a level without
    archives ends it.
    """
    from ..plans.tables import cut

    level, out = files, [files]
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        found = level.where(is_archive)
        if found.isEmpty():
            break
        full = paths.join("path", "name")
        level = expand(found.withColumn("mount", mount_point(full)))
        level = cut(level.withColumn("path", F.concat("mount", "path")).withColumn("recursiondepth", F.lit(depth)).select(*files.columns))
        out.append(level)
    return reduce(DataFrame.unionByName, out)


def mount_points(full: Column, *, rules: list | None = None, transform: tuple[str, str] | None = None) -> Column:
    """Where a nested archive is mounted: its path, without its suffix if rules are given, then a regular expression replaced."""
    at = full if rules is None else formats.strip_suffix(full, rules)
    return at if transform is None else F.concat(F.lit("/"), F.ltrim(values.apply_transform(at, *transform), F.lit("/")))


def nested_folders(files: DataFrame, mounts: DataFrame) -> DataFrame:
    """files with the archives of mounts (offsetheader, mount) marked istar, and a generated folder row for each at its mount point.

    A folder that takes the place of its archive has offsets one greater, and so is its newer version.
    """
    points = mounts.select("offsetheader", F.col("mount").alias("_m")).dropDuplicates(["offsetheader"])
    rows = files.join(points, "offsetheader", "left")
    full = paths.join("path", "name")
    same = (F.col("_m") == full).cast("long")
    made = {
        "path": paths.dirname("_m"), "name": paths.basename("_m"), "offsetheader": F.col("offsetheader") + same, "offset": F.col("offset") + same, "mode": values.folder_mode(F.col("mode")),
        "istar": F.lit(True), "isgenerated": F.lit(True), "recursiondepth": F.col("recursiondepth") + 1,
    }
    both = F.array(
        F.struct(*(F.when(F.col("_m").isNotNull(), True).otherwise(F.col(c)).alias(c) if c == "istar" else F.col(c) for c in files.columns)),
        F.when(F.col("_m").isNotNull(), F.struct(*(made.get(c, F.col(c)).cast(files.schema[c].dataType).alias(c) for c in files.columns))),
    )
    return rows.select(F.explode(F.array_compact(both)).alias("_r")).select("_r.*")


def outside(files: DataFrame, prefixes: list[str]) -> DataFrame:
    """Rows whose full path begins with none of the prefixes."""
    full, keep = paths.join("path", "name"), F.lit(True)
    for p in prefixes:
        keep &= ~full.startswith(p)
    return files.where(keep)


def resolve_links(files: DataFrame, max_hops: int = 128) -> DataFrame:
    """Hard links to the row they end at: path, name, offsetheader, target_path, target_name, target_offset.

    A link to itself goes to its member's version before; a chain that does not end in max_hops
    rounds, or ends nowhere, has a null target.
    """
    from ..plans.tables import cut

    full = F.concat("path", F.lit("/"), "name")
    ranked = v.ranked(files.select("path", "name", "offsetheader", "linkname")).drop("behind")
    link = F.when(F.col("linkname") != "", paths.normpath("linkname"))
    nodes = ranked.select(full.alias("full"), F.col("version"), link.alias("link"), "offsetheader")
    newest = nodes.groupBy("full").agg(F.max("version").alias("top"))
    step = nodes.join(newest.select(F.col("full").alias("link"), "top"), "link", "left")
    step = step.select("full", "version", F.col("link").alias("to"), F.when(F.col("link") == F.col("full"), F.col("version") - 1).otherwise(F.col("top")).alias("at"))
    step = nodes.select("full", "version", "offsetheader").join(step, ["full", "version"], "left")
    now = cut(step.select("full", "version", "offsetheader", F.coalesce("to", "full").alias("to"), F.when(F.col("to").isNull(), F.col("version")).otherwise(F.col("at")).alias("at"), F.col("to").isNull().alias("done")))
    jump = now.select(F.col("full").alias("to"), F.col("version").alias("at"), F.col("to").alias("to2"), F.col("at").alias("at2"), F.col("done").alias("done2"), F.col("offsetheader").alias("end"))
    hops = 1
    while hops < max_hops and not now.where(~F.col("done") & F.col("at").isNotNull()).isEmpty():  # pointer doubling
        joined = now.join(jump.drop("end"), ["to", "at"], "left")
        now = cut(
            joined.select(
                "full", "version", "offsetheader",
                F.when(F.col("done"), F.col("to")).otherwise(F.coalesce("to2", "to")).alias("to"),
                F.when(F.col("done"), F.col("at")).otherwise(F.col("at2")).alias("at"),
                (F.col("done") | F.coalesce("done2", F.lit(False))).alias("done"),
            )
        )
        jump = now.select(F.col("full").alias("to"), F.col("version").alias("at"), F.col("to").alias("to2"), F.col("at").alias("at2"), F.col("done").alias("done2"))
        hops *= 2
    ends = nodes.select(F.col("full").alias("to"), F.col("version").alias("at"), F.col("offsetheader").alias("target_offset"))
    out = now.join(ends, ["to", "at"], "left")
    ok = F.col("done")
    return out.select(paths.dirname("full").alias("path"), paths.basename("full").alias("name"), "offsetheader", F.when(ok, F.col("to")).alias("target"), F.when(ok, F.col("target_offset")).alias("target_offset"))


# --- overlay --------------------------------------------------------------------------------

_SET = ("mtime", "mode", "uid", "gid")


def overlay_merge(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """base rows with the overlay's metadata where it has some, deleted members left out, new ones added: one full join."""
    changes = overlay.select("path", "name", *(F.col(c).alias(f"_{c}") for c in _SET), F.coalesce("deleted", F.lit(False)).alias("_deleted"))
    both = base.join(changes, ["path", "name"], "full").where(~F.coalesce("_deleted", F.lit(False)))
    return both.select(*(F.coalesce(F.col(f"_{c}").cast(base.schema[c].dataType), F.col(c)).alias(c) if c in _SET else F.col(c) for c in base.columns))


def overlay_delete(base: DataFrame, overlay: DataFrame, members: DataFrame) -> DataFrame:
    """The overlay after members are deleted: a tombstone where base has one, else the row goes."""
    gone = members.select("path", "name").distinct()
    kept = overlay.join(gone, ["path", "name"], "left_anti")
    stones = gone.join(base.select("path", "name").distinct(), ["path", "name"], "left_semi")
    stones = stones.select(*(F.col(c) if c in ("path", "name") else F.lit(True).alias(c) if c == "deleted" else F.lit(None).cast(overlay.schema[c].dataType).alias(c) for c in overlay.columns))
    return kept.unionByName(stones)


def list_deleted(overlay: DataFrame) -> DataFrame:
    return overlay.where("deleted").select("path", "name")


def overlay_update(overlay: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert of metadata; a null change keeps what the overlay has, and the tombstone is cleared."""
    both = overlay.join(changes.select("path", "name", *(F.col(c).alias(f"_{c}") for c in _SET), F.lit(True).alias("_c")), ["path", "name"], "full")
    cols = [F.coalesce(f"_{c}", c).cast(overlay.schema[c].dataType).alias(c) for c in _SET]
    return both.select("path", "name", *cols, F.when(F.col("_c"), F.lit(False)).otherwise(F.coalesce("deleted", F.lit(False))).alias("deleted"))


def overlay_rename(base: DataFrame, overlay: DataFrame, renames: DataFrame) -> DataFrame:
    """renames: path, name, new_path, new_name.  The target's row is replaced by the source's; the source is deleted."""
    source = renames.join(overlay_merge(base, overlay).select("path", "name", *_SET), ["path", "name"])
    moved = source.select(F.col("new_path").alias("path"), F.col("new_name").alias("name"), *_SET, F.lit(False).alias("deleted"))
    rest = overlay_delete(base, overlay, renames.select("path", "name")).join(moved.select("path", "name"), ["path", "name"], "left_anti")
    return rest.unionByName(moved.select(*overlay.columns))


def removable_folders(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Folders of the merged view that hold nothing."""
    view = overlay_merge(base, overlay)
    folders = view.where(values.has_dir_bit(F.col("mode"))).select("path", "name")
    used = view.select(paths.dirname("path").alias("path"), paths.basename("path").alias("name")).distinct()
    return folders.join(used, ["path", "name"], "left_anti")


def commit_lists(overlay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a commit takes out of the catalog and what it adds."""
    return list_deleted(overlay), overlay.where(~F.coalesce("deleted", F.lit(False))).drop("deleted")


def commit(base: DataFrame, overlay: DataFrame, path: str) -> None:
    """Write the merged view as the next version of the catalog; the old one is left as it is."""
    overlay_merge(base, overlay).repartitionByRange("path", "name").sortWithinPartitions("path", "name").write.mode("errorifexists").parquet(path)


def merged_statfs(stats: DataFrame) -> DataFrame:
    """statfs of several sources: largest block sizes, shortest name limit, all else from the first source."""
    first = [F.min_by(c, "source_idx").alias(c) for c in stats.columns if c not in ("source_idx", "f_bsize", "f_frsize", "f_namemax")]
    return stats.agg(F.max("f_bsize").alias("f_bsize"), F.max("f_frsize").alias("f_frsize"), F.min("f_namemax").alias("f_namemax"), *first)
