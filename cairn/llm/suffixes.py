"""Suffix-array deduplication of bytes, with two-stage suffix sorting.

Stretches of text that can hold a repeated string of `length` bytes are found by their anchors.
Each stretch of starts around one anchor goes, with the bytes its strings need, to the shard of
the anchor, so that equal strings meet.  A shard sorts directly only the suffixes that are smaller
than their successors and induces the order of the rest by scanning buckets; where adjacent
suffixes have a common prefix of `length` bytes or more, all but the earliest start are repeats.

Skew: stretches with the same bytes are made one by a map-side minimum before they travel, so
copies never gather; stretches of an anchor with more than HOT different ones are cut into single
strings, which spread over all shards by their own hash.

Strings are of UTF-8 bytes and never cross texts; earlier means a smaller doc_id, then (for rows
that share an id) the hash of the text, then an earlier start; rows with both equal are one text
and lose the same bytes.  Defined results: a null or empty text keeps nothing and has the hash of
the empty string; a null doc_id comes before all others; columns beyond doc_id and text are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Kind, candidates, copies, live_runs, merge_runs, prepared, with_spans
from .common import byte_gram_hashes, cut, flat, keep, null_key, release, scratch, slices, span_hashes

LENGTH, GRAM = 100, 32
#: Text bytes for one shard of suffixes.
SHARD_BYTES = 2 << 20
HOT = 4096


# --- suffix sorting -------------------------------------------------------------------------


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t (values below 256 apart from 0 ends) in order of their first depth bytes at least.

    Stage one: suffixes smaller than their successors are sorted directly.  Stage two: bucket by
    bucket, each sorted suffix puts the suffix before it, if that is larger than it, at the next
    place of its own bucket.  t must end with a 0; suffixes are told apart up to depth bytes only.
    """
    n = len(t)
    # smaller[i]: suffix i < suffix i + 1; equal bytes take after the next place
    change = np.flatnonzero(t[1:] != t[:-1])
    up = np.zeros(n, bool)
    if len(change):
        up[: change[-1] + 1] = np.repeat(t[change] < t[change + 1], np.diff(change, prepend=-1))
    up[t == 0] = True
    small = _sort_directly(t, np.flatnonzero(up), depth)
    counts = np.bincount(t, minlength=256)
    tails = np.cumsum(counts)
    heads = tails - counts
    sa = np.full(n, -1, small.dtype)
    by = np.bincount(t[small], minlength=256)
    at = np.cumsum(by)
    for c in np.flatnonzero(by):  # within a bucket, the smaller-than-successor suffixes come last
        sa[tails[c] - by[c] : tails[c]] = small[at[c] - by[c] : at[c]]
    place = heads.copy()
    for c in range(256):
        if not counts[c]:
            continue
        lo = heads[c]
        while True:  # suffixes of this bucket induced by others of it come in waves, one byte of a run each
            hi = place[c] if place[c] > lo else lo
            if hi == lo:
                break
            place = _induce(t, up, sa, sa[lo:hi], place)
            lo = hi
        _induce(t, up, sa, sa[tails[c] - by[c] : tails[c]], place)
    return sa


def _induce(t: np.ndarray, up: np.ndarray, sa: np.ndarray, done: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Put the larger predecessors of these suffixes, in their order, at the next places of their buckets."""
    before = done[done > 0] - 1
    before = before[~up[before]]
    if len(before):
        c = t[before]
        order = np.argsort(c, kind="stable")
        before, c = before[order], c[order]
        count = np.bincount(c, minlength=256)
        sa[(place - np.cumsum(count) + count)[c] + np.arange(len(c))] = before
        place += count
    return place


def _words_at(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number, zeros beyond the end; a view, so nothing is held for it."""
    return np.ndarray(len(t), ">u8", np.concatenate([t, np.zeros(8, np.uint8)]), strides=(1,))


def _sort_directly(t: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of the depth bytes from each, eight bytes a step, ties only."""
    w = _words_at(t)
    at = at.astype(np.int32 if len(t) < 1 << 31 else np.int64)
    key = w[at].astype(np.uint64)
    by = np.argsort(key, kind="stable")
    order, key = at[by], key[by]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]).astype(order.dtype) if len(order) else np.zeros(0, order.dtype)
    for step in range(8, depth, 8):
        new = np.concatenate([[True], group[1:] != group[:-1], [True]]) if len(group) else np.ones(1, bool)
        tied = np.flatnonzero(~(new[:-1] & new[1:])) if len(group) else np.zeros(0, np.int64)
        if not len(tied):
            break
        part = order[tied]
        far = part.astype(np.int64) + step
        key = np.where(far < len(t), w[np.minimum(far, len(t) - 1)].astype(np.uint64), np.uint64(0))
        by = np.lexsort((key, group[tied]))
        part, key, own = part[by], key[by], group[tied][by]
        order[tied] = part
        start = new[:-1].copy()
        start[tied[1:]] |= (own[1:] == own[:-1]) & (key[1:] != key[:-1])
        group = (np.cumsum(start) - 1).astype(order.dtype)
    return order


def common_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Whether the suffixes a and b share limit bytes (both have as many)."""
    w = _words_at(t)
    on = np.arange(len(a))
    for step in [*range(0, limit - 7, 8), limit - 8]:
        on = on[w[a[on] + step] == w[b[on] + step]]
    same = np.zeros(len(a), bool)
    same[on] = True
    return same


# --- stretches ------------------------------------------------------------------------------

_STRETCH = "anchor long, same long, _k long, _h long, at long, n int, bytes binary"
_STRETCH_NAMES = ["anchor", "same", "_k", "_h", "at", "n", "bytes"]


def _stretches(kind: Kind):
    """For each run of windows with a repeated anchor: their starts (at, n) and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            b, bounds = flat(batch.column("text"))
            doc, lo, n, anchor = live_runs(kind, batch, bounds)
            if not len(lo):
                continue
            hi = lo + n - 1 + kind.window
            same = span_hashes(b, lo, hi) ^ anchor
            take = pa.array(doc)
            data = b.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor.view(np.int64)),
                    pa.array(same.view(np.int64)),
                    batch.column("_k").take(take),
                    batch.column("_h").take(take),
                    pa.array(lo - bounds[doc]),
                    pa.array(n.astype(np.int32)),
                    pa.array([data[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()),
                ],
                _STRETCH_NAMES,
            )

    return run


def _single(length: int):
    """Every string of hot stretches on its own, with its own hash as anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes"):
            b, o = flat(batch.column("bytes"))
            n = batch.column("n").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = o[:-1][row] + step
            h = byte_gram_hashes(b, length)[at].view(np.int64)
            data = b.tobytes()
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(h), batch.column("_k").take(take), batch.column("_h").take(take), pa.array(batch.column("at").to_numpy()[row] + step), pa.array(np.ones(len(row), np.int32)), pa.array([data[i : i + length] for i in at.tolist()], pa.binary())],
                _STRETCH_NAMES,
            )

    return run


def _shard(length: int):
    """One shard's stretches, all different: the starts whose string also starts earlier, as [lo, hi) of bytes."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        # the only stretch of its anchor has no equal string: copies of it are gone already
        _, place, count = np.unique(table["anchor"].to_numpy(), return_inverse=True, return_counts=True)
        table = table.take(pa.array(np.flatnonzero(count[place] > 1))).combine_chunks()
        k, h, at, n = (table[c].to_numpy().astype(np.int64) for c in ("_k", "_h", "at", "n"))
        b, o = flat(table["bytes"])
        size = np.diff(o)
        # a 0 after each stretch: no string of text has one there, and none runs into the next
        ends = o[1:] + np.arange(len(n))
        t = np.zeros(len(b) + len(n), np.uint8)
        where = np.arange(len(b)) + np.repeat(np.arange(len(n)), size)
        t[where] = b + 1  # UTF-8 has no byte 255
        sa = suffix_array(t, length)
        begin = ends - size
        row = np.full(len(t), -1, np.int32)
        row[where] = np.repeat(np.arange(len(n), dtype=np.int32), size)
        ok = row[sa] >= 0
        sa = sa[ok]
        sa = sa[sa - begin[row[sa]] < n[row[sa]]]  # starts of strings only
        out_k, out_h, lo = (np.zeros(0, np.int64) for _ in range(3))
        if len(sa) > 1:
            r = row[sa]
            start = at[r] + sa - begin[r]
            group = np.concatenate([[0], np.cumsum(~common_prefix(t, sa[:-1], sa[1:], length))])
            order = np.lexsort((start, h[r], k[r], group))
            first = np.concatenate([[True], group[order][1:] != group[order][:-1]])
            later = order[~first]
            out_k, out_h, lo = k[r[later]], h[r[later]], start[later]
            order = np.lexsort((lo, out_h, out_k))
            out_k, out_h, lo = out_k[order], out_h[order], lo[order]
        return _intervals(out_k, out_h, lo, length)

    return run


_SPANS = "_k long, _h long, lo long, hi long"


def _intervals(k: np.ndarray, h: np.ndarray, lo: np.ndarray, length: int) -> pa.Table:
    """Starts in order as intervals of bytes; starts next to each other make one."""
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1]) | (lo[1:] != lo[:-1] + 1)])) if len(k) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(k)) - 1 if len(k) else new
    return pa.table([pa.array(k[new]), pa.array(h[new]), pa.array(lo[new]), pa.array(lo[last] + length)], names=["_k", "_h", "lo", "hi"])


def _collapse(stretches: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(the earliest of each set of equal stretches, spans that the others lose).  Bytes are compared by two 64-bit hashes."""
    where = F.struct("_k", "_h", "at")
    firsts = stretches.groupBy("same", "other").agg(F.min(where).alias("first"), F.first("anchor").alias("anchor"), F.first("n").alias("n"), F.first("bytes").alias("bytes"), F.count("*").alias("copies"))
    firsts = cut(firsts)
    many = firsts.where("copies > 1").select("same", "other", "first")
    rest = stretches.select("same", "other", "_k", "_h", "at", "n").join(many, ["same", "other"]).where(where != F.col("first"))
    lost = rest.select("_k", "_h", F.col("at").alias("lo"), (F.col("at") + F.col("n") - 1 + length).alias("hi"))
    return firsts.select("anchor", "same", "first.*", "n", "bytes"), lost


def spans(docs: DataFrame, *, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """prepared() rows to _k, _h, lo, hi: bytes to remove, as intervals that may overlap."""
    kind = Kind(length, GRAM, False)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = int(size // shard_bytes) + 1
    whole, only = copies(docs)
    whole = whole.where(F.col("size") >= length).select("_k", "_h", F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"))
    live = candidates(docs, kind, within=True, only=only)
    stretches = cut(live.mapInArrow(_stretches(kind), _STRETCH).withColumn("other", F.xxhash64("bytes")))
    del live
    release(docs.sparkSession)
    firsts, lost = _collapse(stretches, length)
    release(docs.sparkSession)
    crowds = firsts.groupBy("anchor").count().where(F.col("count") > hot).select("anchor")
    singles = cut(firsts.join(crowds, "anchor", "left_semi").select(*_STRETCH_NAMES).mapInArrow(_single(length), _STRETCH).withColumn("other", F.xxhash64("bytes")))
    _, lost_singles = _collapse(singles, length)
    shard = F.pmod(F.xxhash64("anchor"), F.lit(n_shards)).cast("int").alias("shard")
    dealt = firsts.join(crowds, "anchor", "left_anti").select(shard, "anchor", "_k", "_h", "at", "n", "bytes")
    sorted_ = dealt.groupBy("shard").applyInArrow(_shard(length), _SPANS)
    return whole.union(lost).union(lost_singles).union(sorted_)


def _finish(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, cuts in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = text or b""
                kept, at, runs, removed = [], 0, 0, 0
                if cuts:
                    lo, hi = merge_runs(np.array([x["lo"] for x in cuts], np.int64), np.array([x["hi"] for x in cuts], np.int64))
                    runs, removed = len(lo), int((hi - lo).sum())
                    for i, j in zip(lo.tolist(), hi.tolist(), strict=True):
                        kept.append(text[at:i])
                        at = j
                kept.append(text[at:])
                left = b"".join(kept)
                rows.append((len(text), removed, runs, hashlib.sha256(left).hexdigest(), left if texts else None))
            n, removed, runs, sha, left = zip(*rows, strict=True)
            columns = [batch.column("_k"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha)]
            names = ["_k", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(left, pa.binary())] if texts else columns, [*names, "kept"] if texts else names)

    return run


def dedup(docs: DataFrame, *, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the bytes left."""
    docs = prepared(docs)
    with scratch():
        removed = keep(cut(spans(docs, length=length)))
    release(docs.sparkSession)
    schema = "_k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    out = with_spans(docs, removed, _finish(texts), schema)
    return out.select(null_key("_k").alias("doc_id"), *out.columns[1:])
