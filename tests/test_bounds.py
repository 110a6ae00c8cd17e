"""Memory of functions on contents, which a batch or a content must not multiply."""

import math
import random
import tracemalloc
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from cairn.functions import values
from cairn.sources import archives, writers
from cairn.streaming import append


def plain_is_random(x):
    def near(y):
        return 8 + sum(c / len(y) * math.log2(c / len(y)) for c in Counter(y).values()) < 8 * 41 / (len(y) + 40)

    return len(x) > 1 and near(x) and near(bytes((b - a) % 256 for a, b in zip(x, x[1:])))


def test_is_random_is_counted_in_pieces():
    r = random.Random(3)
    data = [r.randbytes(n) for n in (0, 1, 2, 1023, 1 << 20, (1 << 20) + 1, 3_000_000)] + [b"text " * 500_000, bytes(range(256)) * 4000, None]
    want = [plain_is_random(x or b"") for x in data]
    tracemalloc.start()
    got = values.is_random.func(pd.Series(data))
    peak = tracemalloc.get_traced_memory()[1]
    values.entropy.func(pd.Series(data))
    both = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(got) == want and True in want[:-1]
    assert peak < 40e6 and both < 40e6  # of 8 MB of contents; all at once took some 40 times as much


def test_is_random_over_many_rows():
    data = [random.Random(k).randbytes(1024) if k % 3 else b"ab" * k for k in range(1500)]
    assert list(values.is_random.func(pd.Series(data))) == [plain_is_random(x) for x in data]


def largest_batch(df):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    return max(r.n for r in df.coalesce(1).mapInArrow(sizes, "n long").collect())


def test_archives_reach_python_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    some = spark.range(24).select(F.col("id").cast("string").alias("archive"), F.repeat(F.lit("x"), 1 << 20).cast("binary").alias("data"))
    archives.members_of(some)
    assert largest_batch(some) < 8e6  # of 24 MB


def test_members_leave_python_in_small_batches():
    data = writers.ar([(f"{k}.txt", b"x" * (1 << 20)) for k in range(24)])
    batch = pa.RecordBatch.from_pydict({"archive": ["a.ar"], "data": [data]})
    out = list(archives._parse({}, True)(iter([batch])))
    assert sum(b.num_rows for b in out) == 24 and max(b.nbytes for b in out) < 8e6


def test_nested_and_grown_archives_come_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    data = writers.tar([("1.zip", writers.zip_([("f", b"x" * 1000)])), ("g", b"y")])
    df = spark.createDataFrame([("a.tar", data)], "archive string, data binary")
    old = archives.files_of(archives.members_of(df))
    for run in (lambda: archives.recursive(df, content=True), lambda: append.refresh(old, df)):
        spark.conf.set(name, "64m")
        run()
        assert int(spark.conf.get(name).removesuffix("b")) <= 4 << 20
