"""Files that a splitting tool cut into numbered parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths


def split_sequences(files: DataFrame) -> DataFrame:
    """Parts that belong together: path, base, alphabet, width, first, parts.

    Gaps and islands: numbers in a row from 0 or 1, of one alphabet and width; the longest
    sequence of a base wins, then the first alphabet by name.
    """
    ext = F.regexp_extract("name", r"\.([0-9a-z]+)\z", 1)
    base = F.regexp_extract("name", r"(?s)\A(.*)\.[0-9a-z]+\z", 1)
    rows = files.select("path", base.alias("base"), paths.split_digits(ext).alias("d")).where("d is not null and base <> ''")
    rows = rows.select("path", "base", "d.*").distinct()
    w = Window.partitionBy("path", "base", "alphabet", "width").orderBy("number")
    islands = rows.withColumn("island", F.col("number") - F.row_number().over(w))
    groups = islands.groupBy("path", "base", "alphabet", "width", "island").agg(F.min("number").alias("first"), F.count("*").alias("parts")).where("first <= 1")
    best = F.max_by(F.struct("alphabet", "width", "first", "parts"), F.struct("parts", -F.col("first"), -F.ascii("alphabet")))
    return groups.groupBy("path", "base").agg(best.alias("r")).select("path", "base", "r.*")
