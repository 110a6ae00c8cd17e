"""Anchors: which stretches of which documents can hold a repeated window, found without shipping text.

A window of `window` items has among its grams of `gram` items one with the least hash, its
anchor; equal windows have equal anchors.  Only anchors are counted over the corpus, and where their
windows lie goes with them, so that texts are read once for anchors and once for what is repeated.  A window can
be repeated only if its anchor is, so all else is skipped, and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN_WORD, _BYTE_CODE, cut, discard, flat, gram_hashes, key_of, slices, sliding_min, span_hashes, starts_inside, word_spans

#: Places in a slice are held in so many low bits beside the order of hashes.
_PLACE = 28


@dataclass(frozen=True)
class Kind:
    """What windows are made of: words of a text or its bytes."""

    window: int
    gram: int
    words: bool

    def items(self, b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
        """(hash of each item, index of each text's first item, (starts, ends) of words)."""
        if not self.words:
            return _BYTE_CODE[b], o, None
        starts, ends, first = word_spans(b, o, PLAIN_WORD)
        return span_hashes(b, starts, ends), first, (starts, ends)

    def anchors(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of all windows, place of each one's anchor, hashes of all grams)."""
        starts = starts_inside(bounds, self.window)
        if not len(starts):
            return starts, starts, np.zeros(0, np.uint64)
        h = gram_hashes(codes, self.gram)
        if len(h) >> _PLACE:
            raise ValueError("a text is too long")
        low = np.uint64((1 << _PLACE) - 1)
        order = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        least = sliding_min(order, self.window - self.gram + 1)[starts]
        return starts, (least & low).astype(np.int64), h


def prepared(docs: DataFrame) -> DataFrame:
    """_k (id), _h (hash of the text: tells rows apart that share an id), ref (both in one), text."""
    return docs.select(key_of().alias("_k"), F.xxhash64("text").alias("_h"), "text").select("_k", "_h", F.xxhash64("_k", "_h").alias("ref"), "text")


def copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_k, _h, size of rows whose whole text a row with a smaller id has, ref of all others).

    Copies lose everything that can be repeated, so the search is over the others alone; texts are
    compared by two 64-bit hashes, which are all that is shuffled.
    """
    rows = docs.where("text is not null").select("_k", "_h", F.xxhash64(F.lit(7), "text").alias("_g"), F.octet_length("text").cast("long").alias("size"))
    first = rows.groupBy("_h", "_g").agg(F.min("_k").alias("lead"))
    found = rows.join(first, ["_h", "_g"]).where("_k <> lead").select("_k", "_h", "size")
    return found, first.select(F.xxhash64("lead", "_h").alias("ref")).distinct()


#: Bits of a run's number of windows.
_N_BITS = 16


def _occurrences(kind: Kind):
    """A row for each run of windows that share an anchor: where the run starts in its text, and how many windows it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, bounds, _ = kind.items(*flat(batch.column("text")))
            starts, place, h = kind.anchors(codes, bounds)
            if not len(place):
                continue
            new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            n = np.diff(np.append(new, len(starts)))
            anchor, first = h[place[new]], starts[new]
            doc = np.searchsorted(bounds, first, "right") - 1
            order = np.lexsort((anchor, doc))
            again = (anchor[order][1:] == anchor[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            many = np.zeros(len(doc), bool)
            many[order[1:][again]] = True
            take = pa.array(doc)
            where = ((first - bounds[doc]) << _N_BITS) | n
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), batch.column("ref").take(take), batch.column("_h").take(take), pa.array(where), pa.array(many)], ["anchor", "ref", "_h", "run", "many"])

    return run


def candidates(docs: DataFrame, kind: Kind, *, within: bool, only: DataFrame) -> DataFrame:
    """prepared() rows that can hold repeated windows, with runs: where their repeated anchors have windows.

    An anchor is repeated if two different texts have it, or, with `within`, if one has it twice.
    only: ref of the rows to look at; what they leave out are copies of them.  Anchors are computed
    once and written; copies have the same text, so they make no anchor repeated.
    """
    found = cut(docs.select("ref", "_h", "text").mapInArrow(_occurrences(kind), "anchor long, ref long, _h long, run long, many boolean"))
    texts = found.groupBy("anchor").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi"), *([F.max("many").alias("many")] if within else []))
    shared = cut(texts.where(((F.col("lo") < F.col("hi")) | F.col("many")) if within else F.col("lo") < F.col("hi")).select("anchor"))
    hits = found.select("anchor", "ref", "run").join(shared, "anchor", "left_semi").groupBy("ref").agg(F.collect_set(F.struct("anchor", "run")).alias("runs"))
    hits = cut(hits.join(only, "ref", "left_semi"))
    discard(found), discard(shared)  # the largest tables of all, and no longer read
    return docs.join(hits, "ref")


def live_runs(kind: Kind, batch: pa.RecordBatch, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, anchor) of the runs of a candidates() batch, in page order; bounds: index of each text's first item."""
    lists = batch.column("runs")
    values = lists.flatten()
    owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
    run = values.field("run").to_numpy()
    at, n = bounds[owner] + (run >> _N_BITS), run & ((1 << _N_BITS) - 1)
    inside = at + n - 1 + kind.window <= bounds[owner + 1]  # not so only if two rows share a ref
    order = np.lexsort((at, owner))
    order = order[inside[order]]
    return owner[order], at[order], n[order], values.field("anchor").to_numpy().view(np.uint64)[order]


def merge_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted intervals [start, end), those that overlap or touch made one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def with_spans(docs: DataFrame, removed: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """docs beside their removed spans: removed has _k, _h, lo, hi; finish is a mapInArrow function."""
    spans = removed.groupBy("_k", "_h").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # rows that are equal have equal spans
    return docs.join(spans, ["_k", "_h"], "left").select("_k", "text", "spans").mapInArrow(finish, schema)
