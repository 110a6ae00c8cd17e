"""What the operators of this package share: shared-folder tables and vectorised text.

Texts reach Python as Arrow batches.  A batch is cut into slices of a few megabytes, and each
slice is handled as one flat byte array with numpy, so that no code runs per character.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step handles; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: The id that stands for a null doc_id inside the operators: it comes before all others.
NULL_ID = -(1 << 63)

try:
    # the C library gives blocks of 4 MB and more back as soon as they are freed, also after many were, and keeps little for each thread
    for _parameter, _value in ((-3, 4 << 20), (-1, 8 << 20), (-8, 2)):
        ctypes.CDLL("libc.so.6").mallopt(_parameter, _value)
    pa.set_memory_pool(pa.system_memory_pool())  # Arrow's own pool holds what it once had
except (OSError, AttributeError):  # another C library
    pass

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_BYTE_BASE = _U(0xD6E8FEB86659FD93)
_WORD_BASE = _U(0xA0761D6478BD642F)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; our own where it is unset and one machine runs all (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file:///tmp/checkpoints/cairn"
    return f"{at.rstrip('/')}/cairn-{uuid.uuid4().hex}"


def cut(df: DataFrame, *, parts: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This ends the lineage without tying data to an executor, and lets Spark drop the shuffle
    files of everything that came before.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    if _made:
        _made[-1].append(out)
    return out


#: Tables written inside the scratch() blocks that are open.
_made: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables that cut() writes inside the block at its end, but for those given to keep()."""
    _made.append([])
    try:
        yield
    finally:
        for df in _made.pop():
            if not getattr(df, "_kept", False):
                discard(df)


def keep(df: DataFrame) -> DataFrame:
    df._kept = True
    return df


def discard(df: DataFrame) -> None:
    """Delete a cut() table that nothing to come reads."""
    df._kept = True  # a scratch() block has nothing more to do
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._cut_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Ask the driver's JVM to drop shuffles that no plan refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of an Arrow batch: texts are long, and JVM and Python hold a batch of each task.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> SparkSession:
    """Lower the session's Arrow batches to BATCH_ROWS where they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def key_of(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))


def null_key(k: str = "_k") -> Column:
    return F.when(F.col(k) != NULL_ID, F.col(k))


# --- flat texts -----------------------------------------------------------------------------


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    _, off, data = texts.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(off, np.int64 if large else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, in pieces of about `limit` bytes of `column`."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, o = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(o, o[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def word_spans(b: np.ndarray, o: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in b, and for each text the index of its first word (n + 1 values)."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(o), np.int64)
    inside = is_word[b]
    first = np.zeros(len(b) + 1, bool)
    first[o] = True
    before = np.empty(len(b), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(b), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, o)


def _table(chars: bytes, value: bool) -> np.ndarray:
    t = np.full(256, not value)
    t[list(chars)] = value
    return t


#: For `[^\x20\x09-\x0D]+`.
PLAIN_WORD = _table(b" \t\n\x0b\x0c\r", False)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    h = h ^ (h >> _U(32))
    h = h * _MULT
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[int, np.ndarray] = {}
#: So many powers of a base are kept; those for a longer text are made for it alone.
_KEPT = SLICE_BYTES + 4096


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= _KEPT:
            _powers[int(base)] = have
    return have[:n]


def _inverse(base: np.uint64) -> np.uint64:
    return _U(pow(int(base), -1, 1 << 64))


def _sums(codes: np.ndarray, base: np.uint64) -> np.ndarray:
    out = np.empty(len(codes) + 1, np.uint64)
    out[0] = 0
    np.cumsum(codes * _power(base, len(codes)), out=out[1:])
    return out


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of b[start:end]."""
    sums = _sums(_BYTE_CODE[b], _BYTE_BASE)
    return mix((sums[ends] - sums[starts]) * _power(_inverse(_BYTE_BASE), len(b) + 1)[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(codes: np.ndarray, n: int, base: np.uint64 = _WORD_BASE) -> np.ndarray:
    """64-bit hashes of all runs of n codes, at every position (some run over the end of a text)."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    sums = _sums(codes, base)
    return mix((sums[n:] - sums[:-n]) * _power(_inverse(base), len(codes) - n + 1))


def byte_gram_hashes(b: np.ndarray, n: int) -> np.ndarray:
    return gram_hashes(_BYTE_CODE[b], n, _BYTE_BASE)


def starts_inside(bounds: np.ndarray, n: int) -> np.ndarray:
    """All positions at which n items in a row lie in one text; bounds: index of each text's first item."""
    total = int(bounds[-1])
    ok = np.ones(max(0, total - n + 1), bool)
    for k in range(1, n):  # a run that starts less than n before an end goes over it
        at = bounds - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return np.flatnonzero(ok)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """For each i, min(h[i : i + w]); linear time for any w."""
    n = len(h)
    if n < w:
        return np.zeros(0, h.dtype)
    pad = -n % w
    top = np.iinfo(h.dtype).max
    blocks = np.concatenate([h, np.full(pad, top, h.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
