"""The registered queries of the catalog operators, each beside SQL for the same rows."""

from __future__ import annotations

import itertools
import posixpath
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, paths, values
from ..functions.batches import small_batches
from ..operators import attributes, compose, intervals, sequences, tree, versions
from ..sources import archives, catalog, writers
from ..streaming import append
from . import analytics
from .tables import LINE_ORDER, docs_catalog, events_catalog, geo_catalog, line_segments, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The catalogs of tables.py in SQL.
_CTES = {
    "docs": "SELECT '/' || lang || '/' || source AS path, doc_id || '.txt' AS name, doc_id AS offsetheader, strlen(text)::BIGINT AS size, 33188 AS mode, source AS src, text AS content FROM documents",
    "ev": "SELECT '/u' || user_id AS path, event_type AS name, event_id AS offsetheader, value, (event_id % 5 + 33184)::INT AS mode FROM events",
    "geo": "SELECT '/' || r_name || '/' || n_name || '/' || c_custkey AS path, o_orderkey::VARCHAR AS name, o_orderkey AS offsetheader, o_orderkey AS ingest_seq, o_orderkey * 512 AS offset_, trunc(o_totalprice)::BIGINT AS size FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "parts_": "SELECT *, string_split(trim(path, '/'), '/') AS p FROM geo",
    "seg": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, trunc(l_quantity)::BIGINT AS size FROM lineitem",
}


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({_CTES[n]})" for n in names)


def query(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (_with(*ctes) + ("," if sql.lstrip().startswith(",") else " ") + sql.lstrip().lstrip(",")) if ctes else sql
        return f

    return register


def _values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- analytics ------------------------------------------------------------------------------


@query(
    """, m AS (SELECT path || '/' || name AS full_path, sha256(content) AS h FROM docs WHERE src = 'src1'),
    o AS (SELECT DISTINCT sha256(content) AS h, src FROM docs WHERE src <> 'src1')
    SELECT full_path, (SELECT count(*) FROM o WHERE o.h = m.h)::BIGINT AS copies FROM m WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.h = m.h)""",
    "docs",
)
def unbacked_content(spark, d):
    rows = docs_catalog(spark, d).withColumn("sha256", F.sha2("content", 256))
    return analytics.unbacked(rows.where("src = 'src1'"), rows.where("src <> 'src1'"))


@query("SELECT sha256(content) AS sha256, count(*)::BIGINT AS files, ((count(*) - 1) * max(size))::BIGINT AS wasted FROM docs GROUP BY 1 HAVING count(*) > 1", "docs")
def duplicate_content(spark, d):
    return analytics.duplicates(docs_catalog(spark, d).withColumn("sha256", F.sha2("content", 256)))


@query("SELECT d.path, d.name, d.offsetheader FROM docs d ANTI JOIN labels l ON l.doc_id = d.offsetheader AND l.quality IS NOT NULL AND l.toxic IS NOT NULL", "docs")
def missing_hashes(spark, d):
    labels = table(spark, d, "labels")
    x = labels.select(F.col("doc_id").alias("offsetheader"), F.explode(F.array(F.lit("quality"), F.lit("toxic"))).alias("key"))
    return attributes.missing_hashes(docs_catalog(spark, d).select("path", "name", "offsetheader", "mode"), x, ["quality", "toxic"]).select("path", "name", "offsetheader")


@query("SELECT coalesce(sum(d.size), 0)::BIGINT AS bytes, count(*)::BIGINT AS files FROM docs d ANTI JOIN labels l ON l.doc_id = d.offsetheader", "docs")
def missing_hash_bytes(spark, d):
    x = table(spark, d, "labels").select(F.col("doc_id").alias("offsetheader"), F.lit("quality").alias("key"))
    rows = attributes.missing_hashes(docs_catalog(spark, d).select("path", "name", "offsetheader", "mode", "size"), x, ["quality"])
    return rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def _crc_names(spark, d):
    name = F.concat(F.lit("f "), "doc_id", F.lit(" ["), F.upper(F.substring(F.md5("text"), 1, 8)), F.when(F.col("doc_id") % 3 == 0, "] (x).mkv").when(F.col("doc_id") % 3 == 1, "].srt").otherwise("].mkv"))
    return table(spark, d, "documents").select(F.lit("/v").alias("path"), name.alias("name"), F.col("doc_id").alias("offsetheader"))


@query(
    """SELECT name, CASE WHEN k = 0 THEN NULL ELSE substr(md5(text), 1, 8) END AS crc FROM (
    SELECT doc_id % 3 AS k, text, 'f ' || doc_id || ' [' || upper(substr(md5(text), 1, 8)) || CASE doc_id % 3 WHEN 0 THEN '] (x).mkv' WHEN 1 THEN '].srt' ELSE '].mkv' END AS name FROM documents)"""
)
def crc_from_name(spark, d):
    return _crc_names(spark, d).select("name", values.crc_from_name(F.col("name")).alias("crc"))


@query(
    """SELECT '/v/f ' || doc_id || ' [' || upper(substr(md5(text), 1, 8)) || '].mkv' AS full_path, substr(md5(text), 1, 8) AS crc_from_name, substr(sha1(text), 1, 8) AS crc_from_xattr
    FROM documents WHERE doc_id % 3 = 2 AND substr(md5(text), 1, 8) <> substr(sha1(text), 1, 8)"""
)
def crc_mismatch(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("offsetheader"), F.lit("user.hash.crc32").alias("key"), F.concat(F.lit(" "), F.upper(F.substring(F.sha1("text"), 1, 8))).cast("binary").alias("value"))
    return analytics.crc_mismatches(_crc_names(spark, d), x)


# --- versions -------------------------------------------------------------------------------

_RANK = "row_number() OVER (PARTITION BY path, name ORDER BY offsetheader {} NULLS {})::BIGINT"
_UP, _DOWN = _RANK.format("ASC", "FIRST"), _RANK.format("DESC", "LAST")


@query(f"SELECT path, name, offsetheader, value, mode FROM (SELECT *, {_DOWN} AS r FROM ev) WHERE r = 1", "ev")
def latest_version(spark, d):
    return versions.lookup(events_catalog(spark, d))


@query(f"SELECT path, name, offsetheader, value, mode FROM (SELECT *, {_UP} AS r FROM ev) WHERE r = 2", "ev")
def nth_version_oldest(spark, d):
    return versions.lookup(events_catalog(spark, d), 2)


@query(f"SELECT path, name, offsetheader, value, mode FROM (SELECT *, {_DOWN} AS r FROM ev) WHERE r = 3", "ev")
def nth_version_newest(spark, d):
    return versions.lookup(events_catalog(spark, d), -2)


@query(f"SELECT path, name, offsetheader, {_UP} AS version FROM ev", "ev")
def all_versions(spark, d):
    return versions.versions(events_catalog(spark, d)).select("path", "name", "offsetheader", "version")


@query(
    f""", n AS (SELECT path, name, CASE WHEN offsetheader % 7 = 0 THEN NULL ELSE offsetheader END AS offsetheader, value FROM ev)
    SELECT path, name, offsetheader, CASE WHEN offsetheader IS NULL THEN NULL ELSE value END AS value FROM (SELECT *, {_DOWN} AS r FROM n) WHERE r = 1""",
    "ev",
)
def latest_version_null_offsets(spark, d):
    rows = events_catalog(spark, d).select("path", "name", F.when(F.col("offsetheader") % 7 != 0, F.col("offsetheader")).alias("offsetheader"), "value")
    out = versions.lookup(rows)
    return out.withColumn("value", F.when(F.col("offsetheader").isNotNull(), F.col("value")))


@query("SELECT path, name, offsetheader, value, mode FROM ev WHERE path = '/u1' AND name = 'click' ORDER BY offsetheader DESC NULLS LAST LIMIT 1 OFFSET 1", "ev")
def lookup_one_path(spark, d):
    return versions.lookup_path(events_catalog(spark, d), "/u1", "click", -1)


@query(f"SELECT path, name, offsetheader, position FROM (SELECT *, {_DOWN} AS r, min(offsetheader) OVER (PARTITION BY path, name) AS position FROM ev) WHERE r = 1", "ev")
def list_all_folders(spark, d):
    return versions.listing(events_catalog(spark, d)).select("path", "name", "offsetheader", "position")


@query(f"SELECT name, mode, offsetheader FROM (SELECT *, {_DOWN} AS r FROM ev WHERE path = '/u3') WHERE r = 1", "ev")
def list_dir(spark, d):
    return versions.listing(events_catalog(spark, d), "/u3").select("name", "mode", "offsetheader")


@query(f"SELECT path, name, mode FROM (SELECT *, {_DOWN} AS r FROM ev) WHERE r = 1", "ev")
def list_mode(spark, d):
    return versions.list_mode(events_catalog(spark, d))


@query("SELECT count(*)::BIGINT AS files FROM docs", "docs")
def file_count(spark, d):
    return versions.file_count(docs_catalog(spark, d))


@query(
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey * 100000 + l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1"""
)
def upsert_last_wins(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.struct((F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("a"), "l_extendedprice").alias("seq"))
    return versions.upsert(rows, key=("l_orderkey", "l_linenumber"), order="seq", keep_null=None).drop("seq")


@query(
    """, n AS (SELECT path, name, CASE WHEN offsetheader % 4 = 0 THEN NULL ELSE offsetheader % 3 END AS offsetheader, offsetheader AS seq FROM ev)
    SELECT path, name, offsetheader, max(seq) AS seq FROM n WHERE offsetheader IS NOT NULL GROUP BY ALL UNION ALL SELECT path, name, offsetheader, seq FROM n WHERE offsetheader IS NULL""",
    "ev",
)
def upsert_null_keys(spark, d):
    rows = events_catalog(spark, d).select("path", "name", F.when(F.col("offsetheader") % 4 != 0, F.col("offsetheader") % 3).alias("offsetheader"), F.col("offsetheader").alias("seq"))
    return versions.upsert(rows.withColumn("s", F.col("seq")), order="s").drop("s")


@query(", n AS (SELECT path, name, count(*) AS n FROM ev GROUP BY ALL) SELECT path || '/' || name || '.versions' AS path, unnest(range(1, n + 1))::VARCHAR AS name FROM n", "ev")
def version_folders(spark, d):
    return versions.version_folders(events_catalog(spark, d))


@query("SELECT path || '/' || name AS path, (offsetheader % 9)::INT AS version FROM ev", "ev")
def version_paths(spark, d):
    rows = events_catalog(spark, d).select(F.concat("path", F.lit("/"), "name", F.when(F.col("offsetheader") % 9 == 0, "").otherwise(F.concat(F.lit(".versions/"), (F.col("offsetheader") % 9).cast("string")))).alias("p"))
    return rows.select(versions.decode_version_path(F.col("p")).alias("v")).select("v.*")


# --- tree -----------------------------------------------------------------------------------

_PARENTS = """, a AS (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM parts_),
    x AS (SELECT CASE WHEN i > 1 THEN '/' || array_to_string(p[1 : i - 1], '/') ELSE '' END AS path, p[i] AS name, offsetheader, offset_, ingest_seq FROM a)"""


@query(_PARENTS + " SELECT path, name, arg_min(offsetheader, ingest_seq) AS offsetheader, arg_min(offset_, ingest_seq) AS \"offset\" FROM x GROUP BY path, name", "geo", "parts_")
def parents_synth(spark, d):
    return tree.parents(geo_catalog(spark, d))


@query(
    _PARENTS + " SELECT path, name, arg_min(offsetheader, ingest_seq) AS offsetheader FROM x WHERE NOT (path = '' AND name IN (SELECT r_name FROM region WHERE r_regionkey < 2)) GROUP BY path, name",
    "geo", "parts_",
)
def parents_missing(spark, d):
    geo = geo_catalog(spark, d)
    have = table(spark, d, "region").where("r_regionkey < 2").select(
        F.lit("").alias("path"), F.col("r_name").alias("name"), F.lit(-1).cast("long").alias("offsetheader"), F.lit(-1).cast("long").alias("ingest_seq"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("size"), F.lit(0o40755).alias("mode")
    )
    return tree.missing_parents(geo.unionByName(have)).select("path", "name", "offsetheader")


@query(_PARENTS + " SELECT path, name, TRUE AS isgenerated FROM x GROUP BY path, name UNION ALL SELECT path, name, FALSE FROM geo", "geo", "parts_")
def with_parents(spark, d):
    return tree.with_parents(geo_catalog(spark, d).withColumn("isgenerated", F.lit(False))).select("path", "name", "isgenerated")


@query("SELECT path, name, size FROM geo WHERE starts_with(path || '/' || name, '/ASIA/')", "geo")
def subtree(spark, d):
    return tree.subtree(geo_catalog(spark, d), "/ASIA").select("path", "name", "size")


@query(
    """, a AS (SELECT p, size, unnest(range(0, len(p) + 1)) AS i FROM parts_)
    SELECT CASE WHEN i = 0 THEN '' ELSE '/' || array_to_string(p[1 : i], '/') END AS folder, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM a GROUP BY 1""",
    "geo", "parts_",
)
def subtree_size(spark, d):
    return tree.folder_sizes(geo_catalog(spark, d))


@query("SELECT len(p)::INT AS depth, count(*)::BIGINT AS files FROM parts_ WHERE len(p) <= 3 GROUP BY 1", "geo", "parts_")
def depth_filter(spark, d):
    return geo_catalog(spark, d).withColumn("depth", paths.depth("path")).where("depth <= 3").groupBy("depth").agg(F.count("*").alias("files"))


@query(
    """, m AS (SELECT '/' || r_name AS mount FROM region UNION SELECT '/' || r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0),
    r AS (SELECT path || '/' || name AS full_path FROM geo), b AS (SELECT full_path, arg_max(mount, length(mount)) AS mount FROM r JOIN m ON starts_with(full_path, mount || '/') OR full_path = mount GROUP BY full_path)
    SELECT full_path, mount, substr(full_path, length(mount) + 1) AS rest FROM b""",
    "geo",
)
def mount_longest_prefix(spark, d):
    region, nation = table(spark, d, "region"), table(spark, d, "nation").where("n_nationkey % 2 = 0")
    m = region.select(F.concat(F.lit("/"), "r_name").alias("mount")).union(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name")))
    return tree.longest_prefix(geo_catalog(spark, d).select(paths.join("path", "name").alias("full_path")), m)


# --- composition ----------------------------------------------------------------------------

_UNION = ", u AS (SELECT *, 0 AS source_idx FROM ev WHERE offsetheader % 3 < 2 UNION ALL SELECT *, 1 FROM ev WHERE offsetheader % 3 > 0)"


def _union(spark, d):
    ev = events_catalog(spark, d)
    return compose.union([ev.where("offsetheader % 3 < 2"), ev.where("offsetheader % 3 > 0")])


_U = "path, name, offsetheader, source_idx::INT AS source_idx"
_BY = "PARTITION BY path, name ORDER BY source_idx {0}, offsetheader {0} NULLS {1}"


@query(_UNION + f" SELECT {_U} FROM (SELECT *, row_number() OVER ({_BY.format('DESC', 'LAST')}) AS r FROM u) WHERE r = 1", "ev")
def union_lookup(spark, d):
    return compose.union_lookup(_union(spark, d)).select("path", "name", "offsetheader", "source_idx")


@query(_UNION + f" SELECT {_U} FROM (SELECT *, row_number() OVER ({_BY.format('ASC', 'FIRST')}) AS r FROM u) WHERE r = 3", "ev")
def union_lookup_version(spark, d):
    return compose.union_lookup(_union(spark, d), 3).select("path", "name", "offsetheader", "source_idx")


@query(_UNION + " SELECT path, name, count(*)::BIGINT AS versions FROM u GROUP BY ALL", "ev")
def union_versions(spark, d):
    return compose.union_versions(_union(spark, d))


@query(_UNION + f" SELECT {_U} FROM (SELECT *, row_number() OVER ({_BY.format('DESC', 'LAST')}) AS r FROM u) WHERE r = 1", "ev")
def union_list_right(spark, d):
    return compose.union_listing(_union(spark, d)).select("path", "name", "offsetheader", "source_idx")


@query(_UNION + f" SELECT {_U} FROM (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY source_idx, offsetheader DESC NULLS LAST) AS r FROM u) WHERE r = 1", "ev")
def union_list_left(spark, d):
    return compose.union_listing(_union(spark, d), "left").select("path", "name", "offsetheader", "source_idx")


@query("SELECT '/a' || path AS path, name FROM docs WHERE offsetheader % 2 = 0 UNION ALL SELECT '/a.1' || path, name FROM docs WHERE offsetheader % 2 = 1", "docs")
def subvolumes(spark, d):
    docs = docs_catalog(spark, d)
    return compose.subvolumes([("a", docs.where("offsetheader % 2 = 0")), ("a", docs.where("offsetheader % 2 = 1"))]).select("path", "name")


@query("SELECT '/moved/here' || path AS path, name FROM docs", "docs")
def prefix_added(spark, d):
    return compose.under_prefix(docs_catalog(spark, d), "/moved/here").select("path", "name")


@query("SELECT substr(path, 4) AS path, name FROM docs WHERE path = '/en' OR starts_with(path, '/en/')", "docs")
def remove_prefix(spark, d):
    return compose.strip_prefix(docs_catalog(spark, d), "/en").select("path", "name")


@query("SELECT path, name, CASE WHEN offsetheader % 10 = 0 THEN 16877 ELSE mode END::INT AS mode, offsetheader % 10 = 0 AS is_mount FROM docs", "docs")
def mount_points_listed(spark, d):
    docs = docs_catalog(spark, d)
    return compose.mounted(docs, docs.where("offsetheader % 10 = 0")).select("path", "name", "mode", "is_mount")


@query("SELECT path, name, (count(*) + CASE WHEN path = '/u1' THEN 1 ELSE 0 END)::BIGINT AS versions FROM ev GROUP BY path, name", "ev")
def mount_versions(spark, d):
    ev = events_catalog(spark, d)
    return compose.mounted_versions(ev, ev.where("path = '/u1'"))


def _overlay(spark, d):
    return table(spark, d, "orders").where("o_orderkey % 4 = 0").select(
        F.lit("/o").alias("path"), F.col("o_orderkey").cast("string").alias("name"), F.when(F.col("o_orderkey") % 8 == 0, F.col("o_totalprice")).alias("mtime"), F.when(F.col("o_orderkey") % 12 == 0, 33152).cast("int").alias("mode"),
        F.lit(None).cast("int").alias("uid"), F.lit(None).cast("int").alias("gid"), (F.col("o_orderkey") % 20 == 0).alias("deleted"),
    )


def _base(spark, d):
    return table(spark, d, "orders").where("o_orderkey % 16 <> 4").select(F.lit("/o").alias("path"), F.col("o_orderkey").cast("string").alias("name"), F.lit(1.5).alias("mtime"), F.lit(33188).alias("mode"), F.lit(1000).alias("uid"), F.lit(1000).alias("gid"))


_OVERLAY = """WITH base AS (SELECT '/o' AS path, o_orderkey::VARCHAR AS name, 1.5::DOUBLE AS mtime, 33188 AS mode, 1000 AS uid, 1000 AS gid FROM orders WHERE o_orderkey % 16 <> 4),
    ov AS (SELECT '/o' AS path, o_orderkey::VARCHAR AS name, CASE WHEN o_orderkey % 8 = 0 THEN o_totalprice END AS mtime, CASE WHEN o_orderkey % 12 = 0 THEN 33152 END AS mode, NULL::INT AS uid, NULL::INT AS gid, o_orderkey % 20 = 0 AS deleted FROM orders WHERE o_orderkey % 4 = 0)"""


@query(
    _OVERLAY
    + """ SELECT path, name, coalesce(ov.mtime, base.mtime) AS mtime, coalesce(ov.mode, base.mode)::INT AS mode, coalesce(ov.uid, base.uid)::INT AS uid, coalesce(ov.gid, base.gid)::INT AS gid
    FROM base FULL JOIN ov USING (path, name) WHERE NOT coalesce(ov.deleted, FALSE)"""
)
def overlay_merge(spark, d):
    return compose.overlay_merge(_base(spark, d), _overlay(spark, d))


@query(
    _OVERLAY
    + """, gone AS (SELECT path, name FROM ov WHERE name::BIGINT % 24 = 0 UNION SELECT path, name FROM base WHERE name::BIGINT % 7 = 0)
    SELECT path, name, deleted FROM ov WHERE (path, name) NOT IN (SELECT (path, name) FROM gone) UNION ALL SELECT path, name, TRUE FROM gone WHERE (path, name) IN (SELECT (path, name) FROM base)"""
)
def overlay_delete(spark, d):
    base, ov = _base(spark, d), _overlay(spark, d)
    gone = ov.where("try_cast(name as bigint) % 24 = 0").select("path", "name").union(base.where("try_cast(name as bigint) % 7 = 0").select("path", "name"))
    return compose.overlay_delete(base, ov, gone).select("path", "name", "deleted")


@query(_OVERLAY + " SELECT path, name FROM ov WHERE deleted")
def overlay_list_deleted(spark, d):
    return compose.list_deleted(_overlay(spark, d))


@query(
    _OVERLAY
    + """, ch AS (SELECT path, name, 9.5::DOUBLE AS mtime FROM base WHERE name::BIGINT % 5 = 0)
    SELECT path, name, coalesce(ch.mtime, ov.mtime) AS mtime, CASE WHEN ch.mtime IS NOT NULL THEN FALSE ELSE coalesce(ov.deleted, FALSE) END AS deleted FROM ov FULL JOIN ch USING (path, name)"""
)
def overlay_update(spark, d):
    changes = _base(spark, d).where("try_cast(name as bigint) % 5 = 0").select("path", "name", F.lit(9.5).alias("mtime"), *(F.lit(None).cast("int").alias(c) for c in ("mode", "uid", "gid")))
    return compose.overlay_update(_overlay(spark, d), changes).select("path", "name", "mtime", "deleted")


@query(
    _OVERLAY
    + """, v AS (SELECT path, name, coalesce(ov.mtime, base.mtime) AS mtime FROM base FULL JOIN ov USING (path, name) WHERE NOT coalesce(ov.deleted, FALSE)),
    r AS (SELECT path, name, 'x' || name AS new_name FROM base WHERE name::BIGINT % 9 = 0)
    SELECT path, name, mtime, deleted FROM ov WHERE name::BIGINT % 9 <> 0 OR name NOT IN (SELECT name FROM base)
    UNION ALL SELECT path, name, NULL, TRUE FROM r UNION ALL SELECT r.path, r.new_name, v.mtime, FALSE FROM r JOIN v USING (path, name)"""
)
def overlay_rename(spark, d):
    base = _base(spark, d)
    r = base.where("try_cast(name as bigint) % 9 = 0").select("path", "name", F.col("path").alias("new_path"), F.concat(F.lit("x"), "name").alias("new_name"))
    return compose.overlay_rename(base, _overlay(spark, d), r).select("path", "name", "mtime", "deleted")


@query("SELECT max(bs)::BIGINT AS f_bsize, max(fs)::BIGINT AS f_frsize, min(nm)::BIGINT AS f_namemax, arg_min(bl, n_nationkey)::BIGINT AS f_blocks FROM (SELECT n_nationkey, 512 * (n_nationkey % 7 + 1) AS bs, 256 * (n_nationkey % 5 + 1) AS fs, 255 - n_nationkey AS nm, 1000 + n_nationkey AS bl FROM nation)")
def statfs_merged(spark, d):
    k = F.col("n_nationkey").cast("long")
    return compose.merged_statfs(table(spark, d, "nation").select(k.alias("source_idx"), (512 * (k % 7 + 1)).alias("f_bsize"), (256 * (k % 5 + 1)).alias("f_frsize"), (255 - k).alias("f_namemax"), (1000 + k).alias("f_blocks")))


@query(
    """WITH RECURSIVE n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey - 1 END AS nxt FROM orders),
    w AS (SELECT id, id AS at, nxt, 0 AS hops FROM n UNION ALL SELECT w.id, n.id, n.nxt, hops + 1 FROM w JOIN n ON n.id = w.nxt WHERE hops < 20)
    SELECT '/l' AS path, id::VARCHAR AS name, id AS offsetheader, (SELECT max('/l/' || x.at) FROM w x WHERE x.id = o.o_orderkey AND x.nxt IS NULL) AS target FROM (SELECT o_orderkey AS id, o_orderkey FROM orders) o"""
)
def hard_links(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.lit("/l").alias("path"), k.cast("string").alias("name"), k.alias("offsetheader"), F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("l/"), (k - 1).cast("string"))).alias("linkname"))
    return compose.resolve_links(rows).select("path", "name", "offsetheader", "target")


# --- attributes -----------------------------------------------------------------------------


@query("SELECT d.path, d.name, l.quality::VARCHAR AS quality FROM docs d JOIN labels l ON l.doc_id = d.offsetheader", "docs")
def attribute_join(spark, d):
    x = table(spark, d, "labels").select(F.col("doc_id").alias("offsetheader"), F.lit("user.quality").alias("key"), F.col("quality").cast("string").cast("binary").alias("value"))
    return attributes.with_attribute(docs_catalog(spark, d), x, "user.quality", "quality").select("path", "name", "quality")


@query(
    """, x AS (SELECT doc_id, 'user.quality' AS key, quality::VARCHAR AS v FROM labels UNION ALL SELECT doc_id, 'user.toxic', toxic::VARCHAR FROM labels)
    SELECT d.path, d.name, x.key, x.v AS value FROM docs d JOIN x ON x.doc_id = d.offsetheader WHERE d.offsetheader % 5 <> 0""",
    "docs",
)
def list_attributes(spark, d):
    x = table(spark, d, "labels").select(F.col("doc_id").alias("offsetheader"), F.explode(F.create_map(F.lit("user.quality"), F.col("quality").cast("string"), F.lit("user.toxic"), F.col("toxic").cast("string"))))
    rows = docs_catalog(spark, d).withColumn("isgenerated", F.col("offsetheader") % 5 == 0)
    return attributes.attributes_of(rows, x)


@query(
    """SELECT doc_id AS offsetheader, 'user.q' AS key, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE quality::VARCHAR END AS value FROM labels
    UNION ALL SELECT doc_id, 'user.r', 'new' FROM labels WHERE doc_id % 3 = 0"""
)
def set_attributes(spark, d):
    labels = table(spark, d, "labels")
    old = labels.select(F.col("doc_id").alias("offsetheader"), F.lit("user.q").alias("key"), F.col("quality").cast("string").alias("value"))
    new = labels.where("doc_id % 3 = 0").select(F.col("doc_id").alias("offsetheader"), F.explode(F.array(F.lit("user.q"), F.lit("user.r"))).alias("key"), F.lit("new").alias("value"))
    return attributes.set_attributes(old, new)


@query("SELECT doc_id AS offsetheader, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def content_hashes(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select(F.col("doc_id").alias("offsetheader"), *(values.digest(n, c).alias(n) for n in ("md5", "sha1", "sha256")))


@query()
def other_hashes(spark, d):
    small_batches(spark)
    c = F.col("text")
    return table(spark, d, "documents").select(F.col("doc_id").alias("offsetheader"), *(values.digest(n, c).alias(n) for n in ("crc32", "sha224", "sha384", "sha512", "sha3-256", "blake2b", "smplayer")))


@query("SELECT doc_id AS offsetheader, 'user.hash.' || n AS key, CASE n WHEN 'md5' THEN md5(text) ELSE sha256(text) END AS value FROM documents, (VALUES ('md5'), ('sha256')) t(n)")
def hash_attributes(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("offsetheader"), F.col("text").cast("binary").alias("content"))
    return attributes.hashed(rows, ["md5", "sha256"]).withColumn("value", F.col("value").cast("string"))


@query(
    """WITH c AS (SELECT doc_id, unnest(string_split(hex(encode(text)), '')) AS h, unnest(range(0, 2 * strlen(text))) AS i FROM documents),
    b AS (SELECT doc_id, i // 2 AS k, string_agg(h, '' ORDER BY i) AS x FROM c GROUP BY ALL), n AS (SELECT doc_id, x, count(*) AS n FROM b GROUP BY ALL),
    p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM n) SELECT doc_id AS offsetheader, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1"""
)
def entropy(spark, d):
    small_batches(spark)
    return table(spark, d, "documents").select(F.col("doc_id").alias("offsetheader"), F.round(values.entropy(F.col("text").cast("binary")), 6).alias("entropy"))


@query(
    """WITH h AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN array_to_string(list_transform(range(32), lambda i: sha256(doc_id || '/' || i)), '') ELSE hex(encode(coalesce(text, ''))) END AS h FROM documents),
    v AS (SELECT doc_id, k, ('0x' || substr(h, (2 * k + 1)::INT, 2))::INT AS v FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS k FROM h)),
    w AS (SELECT doc_id, 0 AS kind, v FROM v UNION ALL SELECT * FROM (SELECT doc_id, 1, (v - lag(v) OVER (PARTITION BY doc_id ORDER BY k) + 256) % 256 AS v FROM v) WHERE v IS NOT NULL),
    n AS (SELECT doc_id, kind, v, count(*) AS c FROM w GROUP BY ALL), p AS (SELECT doc_id, kind, c / sum(c) OVER (PARTITION BY doc_id, kind) AS p, sum(c) OVER (PARTITION BY doc_id, kind) AS n FROM n),
    e AS (SELECT doc_id, kind, 8 + sum(p * log2(p)) < 8 * 41 / (any_value(n) + 40) AS ok FROM p GROUP BY ALL)
    SELECT doc_id AS offsetheader, coalesce(bool_and(ok) AND count(*) = 2, FALSE) AS is_random FROM h LEFT JOIN e USING (doc_id) GROUP BY doc_id"""
)
def random_content(spark, d):
    """Every other content is a run of digests, the rest are texts."""
    small_batches(spark)
    digests = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.sha2(F.concat_ws("/", "doc_id", i), 256)), ""))
    content = F.when(F.col("doc_id") % 2 == 0, digests).otherwise(F.coalesce("text", F.lit("")).cast("binary"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("offsetheader"), values.is_random(content).alias("is_random"))


@query(
    """, x AS (SELECT doc_id, 'user.quality' AS key, quality::VARCHAR AS v FROM labels UNION ALL SELECT doc_id, 'user.toxic', toxic::VARCHAR FROM labels)
    SELECT doc_id AS offsetheader, dense_rank() OVER (ORDER BY key)::BIGINT AS keyid, v AS value FROM x""",
    "docs",
)
def attribute_dictionary(spark, d):
    x = table(spark, d, "labels").select(F.col("doc_id").alias("offsetheader"), F.explode(F.create_map(F.lit("user.quality"), F.col("quality").cast("string"), F.lit("user.toxic"), F.col("toxic").cast("string"))))
    return attributes.dictionary(x)[1]


@query(
    """, f AS (SELECT path, name || CASE WHEN offsetheader % 10 = 0 THEN ' [00000000]' ELSE '' END AS name, offsetheader, sha256(content) AS h, src FROM docs), m AS (SELECT * FROM f WHERE src = 'src1'), o AS (SELECT DISTINCT h FROM f WHERE src <> 'src1')
    SELECT path || '/' || name AS full_path, 0::BIGINT AS copies FROM m WHERE h NOT IN (SELECT h FROM o) AND offsetheader % 10 <> 0""",
    "docs",
)
def unbacked_without_contradictions(spark, d):
    """Files that only src1 has, but for those whose name holds another CRC than their attribute (here every tenth)."""
    name = F.concat("name", F.when(F.col("offsetheader") % 10 == 0, " [00000000]").otherwise(""))
    docs = docs_catalog(spark, d).withColumn("name", name)

    def side(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        kinds = F.create_map(F.lit("user.hash.sha256"), F.sha2("content", 256), F.lit("user.hash.crc32"), values.crc32_hex(F.col("content").cast("binary")))
        return rows.select("path", "name", "offsetheader", "mode"), rows.select("offsetheader", F.explode(kinds)).withColumn("value", F.col("value").cast("binary"))

    return analytics.unbacked_files(*side(docs.where("src = 'src1'")), [side(docs.where("src <> 'src1'"))])


# --- byte ranges ----------------------------------------------------------------------------

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, size"
_STENCIL = f", s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM seg WHERE size > 0)"


@query(_STENCIL + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, size, start FROM s", "seg")
def stencil_prefix_sum(spark, d):
    return intervals.stencils(line_segments(spark, d), "l_orderkey", LINE_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "size", "start")


@query(_STENCIL + " SELECT o_orderkey AS l_orderkey, o_orderkey % 97 AS \"at\", (SELECT max(start) FROM s WHERE s.l_orderkey = o_orderkey AND s.start <= o_orderkey % 97) AS start FROM orders", "seg")
def stencil_lookup(spark, d):
    starts = intervals.stencils(line_segments(spark, d), "l_orderkey", LINE_ORDER)
    points = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 97).alias("at"))
    return intervals.interval_lookup(points, starts, "l_orderkey")


@query("SELECT arg_max((ceil((offset_ + size) / 512.0) * 512)::BIGINT, offset_) AS past_end FROM geo", "geo")
def past_end_offset(spark, d):
    return intervals.past_end(geo_catalog(spark, d).withColumn("issparse", F.lit(False)))


@query("SELECT offsetheader FROM (SELECT offsetheader FROM docs ORDER BY offsetheader NULLS FIRST LIMIT 33) UNION SELECT offsetheader FROM (SELECT offsetheader FROM docs ORDER BY offsetheader DESC NULLS LAST LIMIT 33)", "docs")
def sample_validation(spark, d):
    return intervals.samples(docs_catalog(spark, d).select("offsetheader"), 33)


@query(
    """, r AS (SELECT l_orderkey, l_linenumber * 1000 AS o, max(size) AS size FROM seg GROUP BY ALL),
    h AS (SELECT l_orderkey, coalesce(lag(o + size) OVER (PARTITION BY l_orderkey ORDER BY o), 0) AS hole_start, o FROM r) SELECT l_orderkey, hole_start::BIGINT AS hole_start, (o - hole_start)::BIGINT AS hole_size FROM h WHERE o > hole_start""",
    "seg",
)
def sparse_holes(spark, d):
    rows = line_segments(spark, d).groupBy("l_orderkey", (F.col("l_linenumber").cast("long") * 1000).alias("offset")).agg(F.max("size").alias("size"))
    return intervals.holes(rows, "l_orderkey")


@query("SELECT doc_id, k::INT AS chunk_no, sha256(substr(text, k * 1000 + 1, 1000)) AS data FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 999) // 1000)) AS k FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS text FROM documents))")
def blob_chunks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").cast("binary").alias("c"))
    return rows.select("doc_id", F.inline(intervals.chunks(F.col("c"), 1000))).withColumn("data", F.sha2("data", 256))


@query(
    """WITH p AS (SELECT 'part' || (p_partkey // 7) AS base, p_partkey % 7 AS n FROM part WHERE p_partkey % 11 <> 3), i AS (SELECT base, n, n - row_number() OVER (PARTITION BY base ORDER BY n) AS g FROM p),
    r AS (SELECT base, min(n) AS first, count(*) AS parts FROM i GROUP BY base, g HAVING min(n) <= 1)
    SELECT base, first::BIGINT AS first, parts::BIGINT AS parts FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY parts DESC, first) AS k FROM r) WHERE k = 1"""
)
def split_sequences(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").where("p_partkey % 11 <> 3").select(F.lit("").alias("path"), F.concat(F.lit("part"), F.floor(k / 7).cast("string"), F.lit("."), F.lpad((k % 7).cast("string"), 3, "0")).alias("name"))
    return sequences.split_sequences(rows).select("base", "first", "parts")


# --- archives -------------------------------------------------------------------------------

_HELD = "SELECT (doc_id // 50) || '.{suffix}' AS archive, '' AS path, {name} AS name, {size}::BIGINT AS size, {sha} AS sha256 FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def _reading(suffix: str, name: Callable[[], Column], sql_name: str, size: str = "strlen(text)", sha: str = "sha256(text)") -> None:
    """Registers a query that packs documents, fifty to an archive, and reads their members."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = table(spark, d, "documents").select("doc_id", name().alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
        packed = writers.pack(docs, F.floor(F.col("doc_id") / 50), suffix)
        rows = archives.members_of(packed, content=sha != "NULL")
        digest = F.sha2("content", 256) if sha != "NULL" else F.lit(None).cast("string")
        return rows.where("error is null").select("archive", "path", "name", "size", digest.alias("sha256"))

    run.__name__ = "read_" + suffix.replace(".", "_")
    query(_HELD.format(suffix=suffix, name=sql_name, size=size, sha=sha))(run)


def _plain_name() -> Column:
    return F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))


for _suffix in ("tar", "tar.gz", "tar.xz", "tar.zst", "zip", "ar", "asar", "sqlar", "cpio", "warc", "html", "xar", "cab", "7z", "rar", "iso", "fat", "squashfs", "ext4", "pdf"):
    _reading(_suffix, _plain_name, "doc_id || '.txt'")
_reading("catalog", _plain_name, "doc_id || '.txt'", sha="NULL")
# pages of 255 segments of 255 bytes, with a head of 27 bytes and a length for each segment
_OGG_SIZE = "(strlen(text) + (strlen(text) // 65025) * 282 + CASE WHEN strlen(text) % 65025 > 0 OR strlen(text) = 0 THEN 28 + (strlen(text) % 65025) // 255 ELSE 0 END)"
_reading("ogg", lambda: F.lpad(F.lower(F.hex("doc_id")), 8, "0"), "'unknown_' || lpad(printf('%x', doc_id), 8, '0') || '.ogg'", size=_OGG_SIZE, sha="NULL")


@query(
    """SELECT doc_id // 50 || '.tar' AS archive, '/' || (doc_id // 10) || '.zip' AS path, doc_id || '.txt' AS name, strlen(coalesce(text, ''))::BIGINT AS size, sha256(coalesce(text, '')) AS sha256, 1 AS recursiondepth FROM documents
    UNION ALL SELECT DISTINCT doc_id // 50 || '.tar', '', (doc_id // 10) || '.zip', NULL::BIGINT, NULL, 0 FROM documents"""
)
def read_nested(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat("doc_id", F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    inner = writers.pack(docs, F.floor(F.col("doc_id") / 10), "zip").select(F.col("archive").alias("name"), F.col("data").alias("content"))
    outer = writers.pack(inner, F.floor(F.substring_index("name", ".", 1).cast("long") / 5), "tar")
    rows = archives.recursive(outer, content=True).where("error is null")
    leaf = F.col("recursiondepth") == 1
    return rows.select("archive", "path", "name", F.when(leaf, F.col("size")).alias("size"), F.when(leaf, F.sha2("content", 256)).alias("sha256"), F.col("recursiondepth").cast("int").alias("recursiondepth"))


@query("SELECT (doc_id // 50) || '.tar' AS archive, doc_id || '.txt' AS name, strlen(coalesce(text, ''))::BIGINT AS size, bool_or(doc_id % 50 < 30) OVER (PARTITION BY doc_id // 50) AS tail_only FROM documents")
def append_tail(spark, d):
    """Archives of thirty documents, grown to fifty: the rows after reading tails alone."""
    name = F.concat(F.lpad((F.col("doc_id") % 50).cast("string"), 2, "0"), F.lit("/"), "doc_id", F.lit(".txt"))
    docs = table(spark, d, "documents").select("doc_id", name.alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    by = F.floor(F.col("doc_id") / 50)
    old = archives.files_of(archives.members_of(writers.pack(docs.where("doc_id % 50 < 30"), by, "tar")))
    rows, said = append.refresh(old, writers.pack(docs, by, "tar"), min_bytes=1, min_files=1)
    return rows.join(said, "archive").select("archive", "name", "size", (F.col("read_from") > 0).alias("tail_only"))


@query(
    """SELECT (doc_id // 50) || '.tar' AS archive, doc_id || '.txt' AS name, (before + 0)::BIGINT AS offsetheader, (before + 512)::BIGINT AS "offset" FROM (SELECT doc_id, coalesce(sum(512 + (strlen(coalesce(text, '')) + 511) // 512 * 512)
    OVER (PARTITION BY doc_id // 50 ORDER BY doc_id || '.txt' ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)"""
)
def tar_layout(spark, d):
    """Where headers and contents lie in archives of fifty documents, in order of their names."""
    docs = table(spark, d, "documents").select("doc_id", _plain_name().alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    rows = archives.members_of(writers.pack(docs, F.floor(F.col("doc_id") / 50), "tar"))
    return rows.where("error is null").select("archive", "name", "offsetheader", "offset")


#: What the content of an archive of each kind is recognised as.
_DETECTED = {"tar": "tar", "tar.gz": "gzip", "tar.xz": "xz", "tar.zst": "zstandard", "zip": "zip", "ar": "ar", "cpio": "cpio", "warc": "warc", "html": "html", "xar": "xar", "cab": "cab", "7z": "7z", "rar": "rar", "iso": "iso9660", "squashfs": "squashfs", "bz2": "bzip2"}


@query("SELECT (doc_id // 500) || '.' || k AS archive, f AS formats FROM (SELECT DISTINCT doc_id // 500 * 500 AS doc_id FROM documents), (VALUES " + ", ".join(f"('{k}', '{f}')" for k, f in _DETECTED.items()) + ") t(k, f)")
def detect_archives(spark, d):
    docs = table(spark, d, "documents").select("doc_id", _plain_name().alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    out = None
    for kind in _DETECTED:
        one = writers.pack(docs, F.floor(F.col("doc_id") / 500), kind).select("archive", F.array_join(formats.detect(F.col("data")), ",").alias("formats"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_id || '.' || k AS archive, doc_id::VARCHAR AS name, strlen(coalesce(text, ''))::BIGINT AS size, sha256(coalesce(text, '')) AS sha256, CASE WHEN k = 'gz' THEN 1577836800 ELSE 0 END::DOUBLE AS mtime FROM documents, (VALUES ('gz'), ('bz2'), ('xz'), ('zst'), ('zz'), ('lz4'), ('lz'), ('Z'), ('uu')) t(k)")
def read_compressed(spark, d):
    """Compressed single files, one for each document and codec; a gzip header also has the time."""
    docs = table(spark, d, "documents").select("doc_id", _plain_name().alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    packed = None
    for kind in ("gz", "bz2", "xz", "zst", "zz", "lz4", "lz", "Z", "uu"):
        one = writers.pack(docs, F.col("doc_id"), kind)
        packed = one if packed is None else packed.unionByName(one)
    rows = archives.members_of(packed, content=True)
    return rows.where("error is null").select("archive", "name", "size", F.sha2("content", 256).alias("sha256"), "mtime")


@query("SELECT doc_id || '.txt' AS name, strlen(coalesce(text, ''))::BIGINT AS size FROM documents WHERE lang = 'en' AND source = 'src0'")
def children_of_folder(spark, d):
    """Direct children of one folder in a table of archive rows."""
    rows = docs_catalog(spark, d).select(F.concat(F.substring("path", 2, 1000), F.lit("/"), "name").alias("name"), "mode", F.lit(0).cast("long").alias("mtime"), F.coalesce("size", F.lit(0)).alias("sz"), F.col("content").cast("binary").alias("data"))
    return catalog.sqlar_listing(rows, "/en/src0/").select("name", "size")


@query("SELECT path, name, 'a' AS src FROM docs WHERE offsetheader % 2 = 0 UNION ALL SELECT path, name, 'b' FROM docs WHERE offsetheader % 3 = 0", "docs")
def attached_catalogs(spark, d):
    docs = docs_catalog(spark, d).drop("src")
    return catalog.attach({"a": docs.where("offsetheader % 2 = 0"), "b": docs.where("offsetheader % 3 = 0")}).select("path", "name", "src")


@query(
    "SELECT o_orderkey, (o_totalprice > 50000 AND o_custkey % 3 = 0) AS may, list_sort(list_concat(CASE WHEN o_orderkey % 2 = 0 THEN ['encoding'] ELSE [] END, CASE WHEN o_orderkey % 3 = 0 THEN ['gone'] ELSE [] END))::VARCHAR AS drifted FROM orders"
)
def append_checks(spark, d):
    """Whether an archive's tail alone may be read, and which arguments differ from the catalog's."""
    size = (F.col("o_totalprice") * 1000).cast("long")
    old = F.struct(F.when(F.col("o_totalprice") > 50000, append.MIN_BYTES).otherwise(append.MIN_BYTES - 1).cast("long").alias("size"), F.lit(200).alias("files"), F.lit(1.0).alias("mtime"), F.lit("1").alias("version"), F.lit(False).alias("compressed"))
    new = F.struct(F.when(F.col("o_custkey") % 3 == 0, append.MIN_BYTES * 2).otherwise(append.MIN_BYTES * 4).cast("long").alias("size"), F.lit(2.0).alias("mtime"), F.lit("1").alias("version"))
    args = F.map_filter(F.create_map(F.lit("encoding"), F.lit("utf-8"), F.lit("gone"), F.when(F.col("o_orderkey") % 3 == 0, "x")), lambda k, v: v.isNotNull())
    now = F.create_map(F.lit("encoding"), F.when(F.col("o_orderkey") % 2 == 0, "latin-1").otherwise("utf-8"))
    said = F.concat(F.lit("["), F.array_join(append.drifted(args, now), ", "), F.lit("]"))
    return table(spark, d, "orders").where(size.isNotNull()).select("o_orderkey", append.may_append(old, new).alias("may"), said.alias("drifted"))


@query(
    """WITH f AS (SELECT '/' || lang || '/' || source AS path, doc_id || '.tar' AS name, doc_id * 1024 AS offsetheader, doc_id * 1024 + 512 AS o, doc_id % 4 = 0 AS nested, doc_id % 8 = 0 AS moved FROM documents)
    SELECT path, name, offsetheader::BIGINT AS offsetheader, o::BIGINT AS "offset", 33188 AS mode, nested AS istar, FALSE AS isgenerated, 0 AS recursiondepth FROM f
    UNION ALL SELECT CASE WHEN moved THEN '/mnt' || path ELSE path END, CASE WHEN moved THEN replace(name, '.tar', '') ELSE name END, (offsetheader + (NOT moved)::INT)::BIGINT, (o + (NOT moved)::INT)::BIGINT, 16877, TRUE, TRUE, 1 FROM f WHERE nested"""
)
def nested_rows(spark, d):
    """Nested archives: marked in their own row, and a folder at their mount point (every second without its suffix, under /mnt)."""
    k = F.col("doc_id")
    files = table(spark, d, "documents").select(
        F.concat(F.lit("/"), "lang", F.lit("/"), "source").alias("path"), F.concat(k.cast("string"), F.lit(".tar")).alias("name"), (k * 1024).alias("offsetheader"), (k * 1024 + 512).alias("offset"),
        F.lit(0o100644).alias("mode"), F.lit(False).alias("istar"), F.lit(False).alias("isgenerated"), F.lit(0).alias("recursiondepth"),
    )
    full = paths.join("path", "name")
    moved = compose.mount_points(full, rules=formats.suffix_rules(["/archive/", "/compressed/"]), transform=(r"^/", "/mnt/"))
    mounts = files.where("offsetheader % 4096 = 0").select("offsetheader", F.when(F.col("offsetheader") % 8192 == 0, moved).otherwise(full).alias("mount"))
    return compose.nested_folders(files, mounts)


@query("SELECT path, name FROM docs WHERE NOT starts_with(path || '/' || name, '/en/src1') AND NOT starts_with(path || '/' || name, '/fr/')", "docs")
def outside_prefixes(spark, d):
    return compose.outside(docs_catalog(spark, d), ["/en/src1", "/fr/"]).select("path", "name")


@query(
    """SELECT (doc_id // 500) || k AS archive, f AS formats, f <> '' AS readable, CASE WHEN k = '.none' THEN 'unknown format' END AS problem FROM (SELECT DISTINCT doc_id // 500 * 500 AS doc_id FROM documents),
    (VALUES ('.tar', 'tar'), ('.none', ''), ('.zip', 'zip')) t(k, f)"""
)
def checked_inputs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", _plain_name().alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    by = F.floor(F.col("doc_id") / 500)
    packed = writers.pack(docs, by, "tar").unionByName(writers.pack(docs, by, "zip"))
    plain = docs.select(by.cast("string").alias("g")).distinct().select(F.concat("g", F.lit(".none")).alias("archive"), F.lit("nothing known").cast("binary").alias("data"))
    return archives.checked(packed.unionByName(plain)).withColumn("formats", F.array_join("formats", ","))


# --- scalars --------------------------------------------------------------------------------


def _path_cases() -> list[str]:
    """Paths of up to four parts out of a few kinds, with and without a slash at their ends."""
    parts = ("lib", "", ".", "..", "v1.2")
    bodies = ["/".join(p) for n in range(1, 5) for p in itertools.product(parts, repeat=n) if n < 4 or "lib" in p[:2]]
    return sorted({begin + b + end for b in bodies for begin in ("", "/") for end in ("", "/")} - {""})


def _normal(path: str) -> str:
    return posixpath.normpath("/./" + path)  # one slash before it, whatever path begins with


def _normal_query(path: str) -> str:
    """What leads out of the root stays if the path begins so."""
    return posixpath.join("/", posixpath.normpath(path)) if path.startswith("../") else _normal(path)


_PATHS = [(p, _normal(p)) for p in _path_cases()]


def _sql_values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows) + ")"


@query(f"SELECT a AS input, b AS path FROM {_sql_values(_PATHS)} t(a, b)")
def normpath_cases(spark, d):
    return _values(spark, "input string", [(a,) for a, _ in _PATHS]).select("input", paths.normpath("input").alias("path"))


_QUERY_PATHS = [(p, _normal_query(p)) for p in _path_cases()]


@query(f"SELECT a AS input, b AS path FROM {_sql_values(_QUERY_PATHS)} t(a, b)")
def query_normpath_cases(spark, d):
    return _values(spark, "input string", [(a,) for a, _ in _QUERY_PATHS]).select("input", paths.query_normpath("input").alias("path"))


@query("SELECT '/' || path[2:] || '/' || name AS full_path, path, name, 'txt' AS extension, offsetheader + size AS past FROM docs", "docs")
def path_functions(spark, d):
    full = docs_catalog(spark, d).select(paths.join("path", "name").alias("full_path"), (F.col("offsetheader") + F.col("size")).alias("past"))
    return full.select("full_path", paths.dirname("full_path").alias("path"), paths.basename("full_path").alias("name"), paths.extension("full_path").alias("extension"), "past")


_STEMS = [(f"{folder}{base}{suffix}", f"{folder}{base}") for folder in ("", "backup/2024/") for base in ("photos", "site.v2") for suffix in (".tar", ".tar.xz", ".TGZ", ".tbz2", ".tar.zst", ".7z", ".cpio", ".lz4")]
_STEMS += [(f"{base}.gz", base) for base in ("song.flac", "notes.md")] + [(name, name) for name in ("song.flac", "README", "archive.d/readme")]


@query(f"SELECT a AS name, b AS stem FROM {_sql_values(_STEMS)} t(a, b)")
def suffix_strip(spark, d):
    rules = formats.suffix_rules(["/archive/", "/compressed/"])
    return _values(spark, "name string", [(a,) for a, _ in _STEMS]).select("name", formats.strip_suffix(F.col("name"), rules).alias("stem"))


_EXTENSIONS = [("a.tar.gz", "gzip,tar"), ("a.ZIP", "zip"), ("b.html", "html"), ("c.txt", ""), ("d.img", "fat,ext4"), ("e.sqlar", "sqlar")]


@query(f"SELECT a AS name, b AS formats FROM {_sql_values(_EXTENSIONS)} t(a, b)")
def format_by_extension(spark, d):
    return _values(spark, "name string", [(a,) for a, _ in _EXTENSIONS]).select("name", F.array_join(formats.by_extension(F.col("name")), ",").alias("formats"))


@query("SELECT page_id, 'html' AS formats FROM pages")
def format_by_content(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(formats.detect(F.col("html").cast("binary")), ",").alias("formats"))


@query(
    """SELECT offsetheader, (mode & 61440) = 32768 AS is_regular, (mode & 16384) <> 0 AS has_dir_bit, ((mode & 511) | 16384 | ((mode & 292) >> 2))::INT AS folder_mode, ((offsetheader + 511) // 512)::BIGINT AS blocks
    FROM (SELECT event_id AS offsetheader, ([33188, 16877, 41471, 49645, 24992])[(event_id % 5 + 1)::INT] AS mode FROM events)"""
)
def mode_bits(spark, d):
    m = F.element_at(F.array(*map(F.lit, (33188, 16877, 41471, 49645, 24992))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("offsetheader"), m.alias("mode"))
    return rows.select("offsetheader", values.is_regular(F.col("mode")).alias("is_regular"), values.has_dir_bit(F.col("mode")).alias("has_dir_bit"), values.folder_mode(F.col("mode")).cast("int").alias("folder_mode"), values.stat_blocks(F.col("offsetheader")).alias("blocks"))


@query("SELECT path, regexp_replace(path, '^/([a-z]+)/src([0-9]+)', '/disk\\2/\\1') AS moved FROM docs", "docs")
def path_transform(spark, d):
    return docs_catalog(spark, d).select("path", values.apply_transform(F.col("path"), r"^/([a-z]+)/src([0-9]+)", r"/disk\2/\1").alias("moved"))


@query("SELECT page_id, 'text/plain' AS mime, TRUE AS is_base64, md5(url) AS md5 FROM pages")
def data_urls(spark, d):
    u = F.concat(F.lit("data:;base64,"), F.regexp_replace(F.base64(F.col("url").cast("binary")), "[=\\s]", ""))
    return table(spark, d, "pages").select("page_id", values.data_url(u).alias("u")).select("page_id", "u.mime", "u.is_base64", F.md5("u.content").alias("md5"))


@query("SELECT event_id, event_id AS octal, (CASE WHEN event_id % 2 = 0 THEN '1.2.3' ELSE 'v0.10.1rc' END) AS version, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 10 END::INT AS minor, ((event_id + 6) // 7)::BIGINT AS pieces FROM events")
def number_functions(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit(" "), F.conv(F.col("event_id").cast("string"), 10, 8), F.lit("\x00")).alias("o"), F.when(F.col("event_id") % 2 == 0, "1.2.3").otherwise("v0.10.1rc").alias("version"))
    return rows.select("event_id", values.octal(F.col("o")).alias("octal"), "version", F.element_at(values.version_numbers(F.col("version")), 2).alias("minor"), values.ceil_div(F.col("event_id"), F.lit(7)).alias("pieces"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
