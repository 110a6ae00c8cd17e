"""Substring deduplication with repeated-phrase automata.

Recurring passages are confirmed by counting: windows of `window` words whose anchor recurs are
hashed, and a window is confirmed if two ids have it.  Its phrase is then taken from the first
document that has it, sent to the shards whose documents have it too, and compiled into
Aho-Corasick automata there, over an alphabet in which each word is three characters.  All candidate
stretches of a shard's documents are streamed through its automata, which finds every occurrence
by the words themselves; what an earlier document has is removed.

Shards are by document, sized by text, and an automaton has AUTOMATON windows at most, so memory is
bounded; a phrase that very many documents share is made once and then costs one row in each shard
that needs it, where it is joined with the set of these shards.

Words are runs of `[^\\x20\\x09-\\x0D]+`, unchanged.  Defined results: a null, empty or blank text has no
words and keeps none (the hash is that of the empty string); copies count by doc_id, and rows that
share an id never remove each other's words; a null doc_id comes before all others; columns
beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Kind, candidates, copies, live_runs, merge_runs, prepared, with_spans
from .common import PLAIN_WORD, cut, flat, gram_hashes, keep, null_key, release, scratch, slices, span_hashes, starts_inside, word_spans

WINDOW, GRAM = 13, 5
#: Text bytes of the documents of one shard, and windows in one automaton.
SHARD_BYTES = 4 << 20
AUTOMATON = 20_000
#: End of the span of a copy: all of a text that has a window.
WHOLE = 1 << 40


def _stretches(kind: Kind):
    """Runs of live windows: document, first word, and the words, by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            b, o = flat(batch.column("text"))
            ws, we, bounds = word_spans(b, o, PLAIN_WORD)
            doc, lo, n, _ = live_runs(kind, batch, bounds)
            lo, hi = merge_runs(lo + doc, lo + doc + n - 1 + kind.window)  # a place of its own after each text, so that runs of two never touch
            doc = np.searchsorted(bounds + np.arange(len(bounds)), lo, "right") - 1
            lo, hi = lo - doc, hi - doc
            texts = [b[ws[i] : we[j - 1]].tobytes() for i, j in zip(lo, hi, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(doc)), batch.column("_h").take(pa.array(doc)), pa.array(lo - bounds[doc]), pa.array(texts, pa.binary())], ["_k", "_h", "at", "words"])

    return run


def _windows(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(window hashes, stretch of each, words) of stretches; every stretch has n words at least."""
    b, o = flat(words)
    starts, ends, first = word_spans(b, o, PLAIN_WORD)
    codes = span_hashes(b, starts, ends)
    h = gram_hashes(codes, n)
    count = np.maximum(np.diff(first) - n + 1, 0)
    at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    return h[at], np.repeat(np.arange(len(o) - 1), count), (b, starts, ends, first, codes, at)


def _hashed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words"):
            h, run_, _ = _windows(batch.column("words"), n)
            k = batch.column("_k").to_numpy()[run_]
            order = np.lexsort((h, k))
            h, k = h[order], k[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])]) if len(h) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(k[new])], ["w", "_k"])

    return run


def _phrases(n: int):
    """Cogroup of a shard's stretches and the confirmed windows first found in it: their phrases, once each.

    A phrase is a run of confirmed windows that the same shards need.
    """

    def run(stretches: pa.Table, confirmed: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if confirmed.num_rows and stretches.num_rows:
            stretches = stretches.combine_chunks()
            h, run_, (b, starts, ends, _, _, at) = _windows(stretches["words"], n)
            own = stretches["_k"].to_numpy()[run_]
            order = np.argsort(confirmed["w"].to_numpy().view(np.uint64))
            w, first, same = confirmed["w"].to_numpy().view(np.uint64)[order], confirmed["lo"].to_numpy()[order], confirmed["same"].to_numpy()[order]
            place = np.minimum(np.searchsorted(w, h), len(w) - 1)
            ok = np.flatnonzero((w[place] == h) & (first[place] == own))
            place = place[ok]
            _, once = np.unique(place, return_index=True)  # a window that the document has twice is sent once
            once.sort()
            ok, place = ok[once], place[once]
            cut_ = np.flatnonzero((np.diff(ok) != 1) | (np.diff(run_[ok]) != 0) | (np.diff(same[place]) != 0)) + 1
            for i, j in zip(np.concatenate([[0], cut_]).tolist(), [*cut_.tolist(), len(ok)], strict=True):
                if i < j:
                    text = b[starts[at[ok[i]]] : ends[at[ok[j - 1]] + n - 1]].tobytes()
                    out.append((int(same[place[i]]), int(own[ok[i]]), text))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["same", "first", "phrase"])

    return run


def _numbers(vocabulary: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Each word's number in the vocabulary from 1; 0 for any other word."""
    at = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == codes, at + 1, 0)


def _text_of(numbers: np.ndarray) -> str:
    """Three characters for a word, each from an alphabet of its own, so that matches begin and end with words.

    An automaton looks for a child among its siblings one by one; 64 of them are few.
    """
    letters = np.stack([0x100 + (numbers >> 12), 0x200 + ((numbers >> 6) & 63), 0x300 + (numbers & 63)], axis=1)
    return letters.astype("<u4").tobytes().decode("utf-32-le")


def automata(phrases: pa.Array, firsts: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, object]]:
    """(vocabulary, automaton) over the windows of the phrases, AUTOMATON windows each; a window's value is its first document.

    A phrase of more windows goes on in the next automaton, so none is larger, nor has more words than three characters tell apart.
    """
    import ahocorasick

    b, o = flat(phrases)
    starts, ends, bounds = word_spans(b, o, PLAIN_WORD)
    codes = span_hashes(b, starts, ends)
    count = np.maximum(np.diff(bounds) - n + 1, 0)
    value = np.repeat(firsts, count)
    window = np.repeat(bounds[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())  # first word of each
    for at in range(0, len(window), AUTOMATON):
        part = window[at : at + AUTOMATON]
        lo, hi = int(part[0]), int(part[-1]) + n
        vocabulary = np.unique(codes[lo:hi])
        text = _text_of(_numbers(vocabulary, codes[lo:hi]))
        machine = ahocorasick.Automaton()
        for k, first in zip((3 * (part - lo)).tolist(), value[at : at + AUTOMATON].tolist(), strict=True):
            machine.add_word(text[k : k + 3 * n], first)
        machine.make_automaton()
        yield vocabulary, machine


def _locate(n: int):
    """Cogroup of a shard's stretches and its phrases: words to remove, [lo, hi) of each document."""

    def run(stretches: pa.Table, phrases: pa.Table) -> pa.Table:
        k, h, lo, hi = [], [], [], []
        if phrases.num_rows and stretches.num_rows:
            stretches, phrases = stretches.combine_chunks(), phrases.combine_chunks()
            b, o = flat(stretches["words"])
            starts, ends, bounds = word_spans(b, o, PLAIN_WORD)
            codes = span_hashes(b, starts, ends)
            key, own, at = (stretches[c].to_numpy() for c in ("_k", "_h", "at"))
            inside = starts_inside(bounds, n)
            order = np.argsort(phrases["first"].to_numpy(), kind="stable")  # phrases of a document share words
            ordered = phrases.take(pa.array(order)).combine_chunks()
            for vocabulary, machine in automata(ordered["phrase"], ordered["first"].to_numpy(), n):
                numbers = _numbers(vocabulary, codes)
                unknown = np.concatenate([[0], np.cumsum(numbers == 0)])
                live = inside[unknown[inside + n] == unknown[inside]]  # n words in a row that the automaton knows
                for i in np.unique(np.searchsorted(bounds, live, "right") - 1).tolist():
                    mine = int(key[i])
                    found = [e for e, first in machine.iter(_text_of(numbers[bounds[i] : bounds[i + 1]])) if first < mine]
                    if found:
                        last = np.array(found) // 3
                        a, z = merge_runs(last - n + 1, last + 1)
                        k += [mine] * len(a)
                        h += [own[i]] * len(a)
                        lo += (a + at[i]).tolist()
                        hi += (z + at[i]).tolist()
        return pa.table([pa.array(k, pa.int64()), pa.array(h, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["_k", "_h", "lo", "hi"])

    return run


def spans(docs: DataFrame, *, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """prepared() rows to _k, _h, lo, hi: words to remove, as intervals that may overlap.

    A span to WHOLE means nothing in a text of fewer words than a window.
    """
    kind = Kind(window, min(GRAM, window), True)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = int(size // shard_bytes) + 1
    shard = F.pmod(F.xxhash64("_k"), F.lit(n_shards)).cast("int").alias("shard")
    whole, only = copies(docs)
    whole = whole.select("_k", "_h", F.lit(0).cast("long").alias("lo"), F.lit(WHOLE).alias("hi"))
    live = candidates(docs, kind, within=False, only=only)
    live = cut(live.mapInArrow(_stretches(kind), "_k long, _h long, at long, words binary"))
    release(docs.sparkSession)
    hashed = live.select("_k", "words").mapInArrow(_hashed(window), "w long, _k long")
    confirmed = hashed.groupBy("w").agg(F.min("_k").alias("lo"), F.max("_k").alias("hi")).where("lo < hi").select("w", "lo")
    confirmed = cut(confirmed)
    release(docs.sparkSession)
    # (window, first document, shard of a later one that has it): a hot window is one row in each shard, made one where it is joined
    routes = hashed.select("w", "_k", shard).join(confirmed, "w").where("_k <> lo").select("w", "lo", F.col("shard").alias("to")).distinct()
    routes = cut(routes)
    # what is told of a window to the shard of its first document is one row, however many shards need it: a hash of their set
    told = routes.groupBy("w").agg(F.first("lo").alias("lo"), F.bit_xor(F.xxhash64("to")).alias("same"))
    sets = routes.join(told.select("w", "same"), "w").select("same", "to").distinct()
    told = told.select(F.pmod(F.xxhash64("lo"), F.lit(n_shards)).cast("int").alias("shard"), "w", "lo", "same")
    stretches = live.select(shard, "_k", "_h", "at", "words")
    phrases = cut(stretches.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_phrases(window), "same long, first long, phrase binary"))
    phrases = phrases.join(sets, "same").select(F.col("to").alias("shard"), "first", "phrase")
    release(docs.sparkSession)
    found = stretches.groupBy("shard").cogroup(phrases.groupBy("shard")).applyInArrow(_locate(window), "_k long, _h long, lo long, hi long")
    return found.union(whole)


def _finish(window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (text or "").encode().split()
                keep = np.ones(len(words), bool)
                for x in (cuts or []) if len(words) >= window else []:
                    keep[x["lo"] : x["hi"]] = False
                kept = b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep)])
                rows.append((len(words), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            n, removed, sha, kept = zip(*rows, strict=True)
            columns = [batch.column("_k"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)]
            names = ["_k", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string())] if texts else columns, [*names, "kept"] if texts else names)

    return run


def dedup(docs: DataFrame, *, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept: the words left, by one space."""
    docs = prepared(docs)
    with scratch():
        removed = keep(cut(spans(docs, window=window)))
    release(docs.sparkSession)
    schema = "_k long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else "")
    out = with_spans(docs, removed, _finish(window, texts), schema)
    return out.select(null_key("_k").alias("doc_id"), *out.columns[1:])
