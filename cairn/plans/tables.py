"""Catalogs made of plain tables, and tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df as a written table under spark.checkpoint.dir: ends its lineage and outlives executors.

    Where that is unset, a folder of our own serves, but only if one machine runs all, as in tests.
    """
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file:///tmp/checkpoints/cairn"
    path = f"{at.rstrip('/')}/cairn-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: /lang/source/doc_id.txt."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/"), "lang", F.lit("/"), "source").alias("path"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.col("doc_id").alias("offsetheader"),
        F.octet_length("text").cast("long").alias("size"),
        F.lit(0o100644).alias("mode"),
        F.col("source").alias("src"),
        F.col("text").alias("content"),
    )


def events_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as versions of /u<user>/<event type>."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("/u"), F.col("user_id").cast("string")).alias("path"),
        F.col("event_type").alias("name"),
        F.col("event_id").alias("offsetheader"),
        F.col("value").alias("value"),
        (F.col("event_id") % 5 + 0o100640).cast("int").alias("mode"),
    )


def geo_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as files /region/nation/customer/order, without their folders."""
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/"), F.col("c_custkey").cast("string")).alias("path"),
        F.col("o_orderkey").cast("string").alias("name"),
        F.col("o_orderkey").alias("offsetheader"),
        F.col("o_orderkey").alias("ingest_seq"),
        (F.col("o_orderkey") * 512).alias("offset"),
        F.col("o_totalprice").cast("long").alias("size"),
        F.lit(0o100644).alias("mode"),
    )


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as segments of one archive for each order, in a total order."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("size"))


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "size"]
