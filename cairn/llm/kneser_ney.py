"""Interpolated modified Kneser-Ney n-gram language model.

Counting is a shuffle of packed, locally summed n-grams.  An n-gram goes to the bucket of the last word
of its context, where all n-grams of every shorter context meet too, so that one shuffle serves all
orders.  Each bucket writes its n-grams and contexts as sorted hash arrays beside small counts into the
shared folder; scorers memory-map these arrays and look n-grams up by binary search, so that a
model may be larger than a worker's memory.  N-grams are counted in PASSES passes over the texts,
each for a part of the buckets, so that only a part of them is on the way at a time.

Hot words (at least 1/HOT_SHARE of all tokens; there are at most HOT_SHARE of them) are no buckets' names: an
n-gram goes by as many words of its context, from the last, as lead to one that is not hot, and by its
own word if all are hot.  What such parts know of shorter n-grams and contexts is added up in a second,
smaller shuffle.  Nothing is pruned or capped: counts are held in 64 bits where fewer don't do.
A missing file of the model is an error, never a count of 0.

Words are held as 48 bits of a hash, n-grams as 51 bits or more (32 beside an index) within their bucket.

Tokens: A-Z is lower-cased, words are `[^\\x20\\x09-\\x0D]+`, and one end token follows each text.  Unknown words
share one place of the uniform distribution under the unigrams, 1 / (V + 1).  Defined results: a
null or empty text is the end token alone; a null doc_id counts as training; repeated rows count
as often as they come; an empty training set gives the uniform model; other columns aren't read.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from .common import PLAIN_WORD, cut, flat, mix, release, scratch, shared_dir, slices, span_hashes, word_spans
from .files import mapped, write_bytes

ORDER = 3
#: Text bytes for one bucket of counts, and passes over the texts.
BUCKET_BYTES = 16 << 20
PASSES = 5
HOT_SHARE = 2000
#: Tokens that a task sums up before it sends them on.
FLUSH_TOKENS = 3 << 19
#: Text bytes that are scored together: what they share is looked up once.
SCORED_BYTES = 8 << 20
#: Text bytes that are cut into tokens at once: what belongs to them stays in a core's cache.
TOKEN_BYTES = 1 << 17
#: Words of more bytes are hashed with all bytes around them.
SHORT_WORD = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64
END = _U(0x51ED270B9F1E)
START = _U(0xC2B2AE3D27D4)
_ODD = _U(0x9E3779B97F4A7C15)
#: Of eight bytes, the first 0 to 8.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def tokens(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of 48 bits, index of each text's first token): the words of each text and its end."""
    starts, ends, first = _spans(b, o)
    b = _LOWER[b]
    bounds = first + np.arange(len(o))
    codes = np.empty(bounds[-1], np.uint64)
    is_end = np.zeros(len(codes), bool)
    is_end[bounds[1:] - 1] = True
    codes[is_end] = END
    codes[~is_end] = word_hashes(b, starts, ends) >> _U(16)
    return codes, bounds


def _spans(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_spans of plain words, by the places where words and spaces meet and where words of two texts do."""
    if not len(b):
        return word_spans(b, o, PLAIN_WORD)
    inside = PLAIN_WORD[b]
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    at = np.unique(o[(o > 0) & (o < len(b))])
    both = np.repeat(at[inside[at] & inside[at - 1]], 2)  # an end and a start
    more = np.concatenate([np.zeros(int(inside[0]), np.int64), both, np.full(int(inside[-1]), len(b))])
    turns = np.insert(turns, np.searchsorted(turns, more), more)
    return turns[::2], turns[1::2], np.searchsorted(turns[::2], o)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of b[start:end], eight bytes at a time; those of long words are span_hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(b) + 1, "<u8", padded, 0, (1,))  # of the bytes from each place
    length = ends - starts
    out = _first_hashes(eights[starts], length)
    rest = np.flatnonzero((length > 8) & (length <= SHORT_WORD))
    done = 8
    while len(rest):
        out[rest] = mix(out[rest] * _ODD + (eights[starts[rest] + done] & _MASKS[np.minimum(length[rest] - done, 8)]))
        done += 8
        rest = rest[length[rest] > done]
    long = np.flatnonzero(length > SHORT_WORD)
    if len(long):
        out[long] = span_hashes(b, starts[long], ends[long])
    return out


def _first_hashes(eight: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix((eight & _MASKS[np.minimum(length, 8)]) + length.astype(np.uint64) * _ODD)


def token_slices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """tokens() of a batch's texts, made in small slices."""
    parts = [tokens(*flat(part.column("text"))) for part in slices([batch], limit=TOKEN_BYTES)]
    lengths = np.concatenate([np.diff(bounds) for _, bounds in parts])
    return np.concatenate([codes for codes, _ in parts]), np.concatenate([[0], np.cumsum(lengths)])


def previous(codes: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """The words before each token, nearest first: order - 1 of them."""
    out, now = [], codes
    for _ in range(order - 1):
        now = np.concatenate([[START], now[:-1]]) if len(now) else now
        now[bounds[:-1]] = START
        out.append(now)
    return out


def contexts(before: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of contexts of one word, two words and so on; before: nearest first."""
    out: list[np.ndarray] = []
    for p in before:
        out.append(mix(p + _ODD) if not out else mix(out[-1] * _ODD + p))
    return out


def gram_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix((context ^ (word >> _U(17))) * _ODD + word)


def is_among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each value is among a few, which have a place each by their lower bits; those that find it taken are compared one by one."""
    place = (some & _U(0xFFFF)).astype(np.int64)
    _, first = np.unique(place, return_index=True)
    table = np.full(1 << 16, ~_U(0))
    table[place[first]] = some[first]
    out = table[(values & _U(0xFFFF)).astype(np.int64)] == values
    for x in np.delete(some, first):
        out |= values == x
    return out


def hot_run(before: list[np.ndarray], hot: np.ndarray) -> np.ndarray:
    """How many words in a row, from the nearest, are hot."""
    run = np.zeros(len(before[0]), np.int8)
    on = np.ones(len(run), bool)
    for p in before:
        on &= is_among(p, hot)
        run += on
        if not on.any():
            break
    return run


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """By the lower half of a hash: the upper half puts a bucket's keys in order."""
    return (((h & _U(0xFFFFFFFF)) * _U(n)) >> _U(32)).astype(np.int64)


def home(run: np.ndarray, before_hashes: list[np.ndarray], key: np.ndarray) -> np.ndarray:
    """The hash whose bucket an n-gram goes to: of its context up to the first word that is not hot, or its own key."""
    out = before_hashes[0]
    for r in range(1, len(before_hashes) + 1):
        rest = np.flatnonzero(run >= r)
        if not len(rest):
            break
        out = out.copy() if r == 1 else out
        out[rest] = (before_hashes[r] if r < len(before_hashes) else key)[rest]
    return out


def _merged(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of each distinct key's first place, in order of the keys; their summed counts; the keys)."""
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return order[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0], key[at]


# --- packed rows ----------------------------------------------------------------------------

_PACK = "bucket int, n long, data binary"


def _packed(columns: list[np.ndarray], counts: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, rows, six bytes of each column's words, then counts of one, four or eight bytes)."""
    if not len(bucket):
        return
    if (bucket[1:] < bucket[:-1]).any():
        order = np.argsort(bucket, kind="stable")
        columns, counts, bucket = [c[order] for c in columns], counts[order], bucket[order]
    at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
    small = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]) for c in columns]
    for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True):
        top = int(counts[lo:hi].max())
        kind = "<u1" if top < 256 else "<u4" if top < 1 << 32 else "<u8"
        yield int(bucket[lo]), hi - lo, b"".join([*(c[lo:hi].tobytes() for c in small), counts[lo:hi].astype(kind).tobytes()])


def _pack_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "n", "data"])


def _unpacked(table: pa.Table, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    ns = table["n"].to_pylist()
    columns = [np.zeros((sum(ns), 8), np.uint8) for _ in range(width)]
    counts = np.zeros(sum(ns), np.int64)
    at = row = 0
    for chunk in table["data"].chunks:
        data, o = flat(chunk)
        for i in range(len(chunk)):
            n, d = ns[row], data[o[i] : o[i + 1]]
            row += 1
            for k in range(width if n else 0):
                columns[k][at : at + n, :6] = d[6 * n * k : 6 * n * (k + 1)].reshape(n, 6)
            if n:
                counts[at : at + n] = np.frombuffer(d[6 * n * width :].tobytes(), f"<u{(len(d) - 6 * n * width) // n}", n)
            at += n
    return [c.view("<u8").ravel() for c in columns], counts


def _count_words(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            words = np.concatenate(held)
            held.clear()
            words.sort()
            at = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            counts, words = np.diff(np.append(at, len(words))), words[at]
            return _pack_batch(list(_packed([words], counts, bucket_of(mix(words), n_buckets))))

        for batch in slices(batches, limit=TOKEN_BYTES):
            held.append(tokens(*flat(batch.column("text")))[0])
            size += len(held[-1])
            if size >= FLUSH_TOKENS:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _count(order: int, hot: np.ndarray, n_buckets: int, lo: int, hi: int):
    """Packed n-grams of the buckets from lo to hi: the words of the context, nearest first, then the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            *columns, key, bucket = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            bits = _U(int(n_buckets).bit_length())
            # in order of bucket and key's upper bits; a key that this parts is summed up later
            order_ = np.argsort((bucket.astype(np.uint64) << (_U(64) - bits)) | (key >> bits))
            key, bucket = key[order_], bucket[order_]
            at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])]))
            first = order_[at]
            return _pack_batch(list(_packed([c[first] for c in columns], np.diff(np.append(at, len(key))), bucket[at])))

        for batch in slices(batches, limit=TOKEN_BYTES):
            codes, bounds = tokens(*flat(batch.column("text")))
            before = previous(codes, bounds, order)
            run_ = hot_run(before, hot)
            first = bucket_of(mix(before[0] + _ODD), n_buckets)
            # most go by their nearest word, so that the others' hashes are made for few
            mine = np.flatnonzero((run_ > 0) | ((first >= lo) & (first < hi)))
            before, codes = [p[mine] for p in before], codes[mine]
            hashes = contexts(before)
            key = gram_key(hashes[-1], codes)
            bucket = bucket_of(home(run_[mine], hashes, key), n_buckets)
            mine = np.flatnonzero((bucket >= lo) & (bucket < hi))
            held.append([*(p[mine] for p in before), codes[mine], key[mine], bucket[mine]])
            size += len(mine)
            if size >= FLUSH_TOKENS:
                yield flush()
                size = 0
        if size:
            yield flush()

    return run


# --- sorted hash arrays ---------------------------------------------------------------------


def write_sorted(path: str, key: np.ndarray, values: np.ndarray) -> None:
    """Sorted 64-bit keys and their values: an index by the upper bits, 32 bits of each key after these, and
    a byte of each value; values that a byte doesn't hold are listed apart.

    values: counts, or rows of (total, N1, N2, N3+) of which most are N1 alone.
    """
    n = len(key)
    top = max(0, (n // 4).bit_length() - 1)
    edges = np.concatenate([np.searchsorted(key, np.arange(1 << top, dtype=np.uint64) << _U(64 - top)) if top else [0], [n]])
    rest = ((key << _U(top)) >> _U(32)).astype("<u4")
    if values.ndim == 1:
        plain = values < 255
        short = np.where(plain, values, 255).astype(np.uint8)
    else:
        plain = (values[:, 1] == values[:, 0]) & (values[:, 0] < 255)
        short = np.where(plain, values[:, 0], 255).astype(np.uint8)
    apart = np.flatnonzero(~plain)
    long = values[apart]
    size = 8 if long.size and int(long.max()) >> 32 else 4
    head = np.array([n, top, len(apart), size, values.shape[1] if values.ndim > 1 else 1, int(np.diff(edges).max()), 0, 0], "<i8")
    parts = [head, edges.astype("<u4" if n < 1 << 32 else "<u8"), rest, apart.astype("<u8"), long.astype(f"<u{size}").ravel(), short]
    write_bytes(path, *(y for x in parts for y in (np.ascontiguousarray(x), bytes(-x.nbytes % 8))))


@lru_cache(maxsize=4096)
def _opened(path: str, width: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Number of keys, bits of the index, and the parts of a file: index, keys, places and values listed apart, bytes; the most keys of one place in the index."""
    data = mapped(path, "u1").view(np.ndarray)
    n, top, n_apart, size, _, most = data[:48].view("<i8").tolist()
    at = 64

    def part(count: int, kind: str) -> np.ndarray:
        nonlocal at
        begin, size_ = at, count * int(kind[2])
        at += size_ + -size_ % 8
        return data[begin : begin + size_].view(kind)

    edges = part((1 << top) + 1, "<u4" if n < 1 << 32 else "<u8")
    rest, apart = part(n, "<u4"), part(n_apart, "<i8")  # signed as places are: or every search would make floats of all
    return n, top, edges, rest, apart, part(n_apart * width, f"<u{size}").reshape(-1, width), part(n, "<u1"), most


def look_up(path: str, wanted: np.ndarray, width: int) -> np.ndarray:
    """Values of the wanted keys; 0 where there is none."""
    n, top, edges, rest, apart, long, short, most = _opened(path, width)
    out = np.zeros((len(wanted), width) if width > 1 else len(wanted), np.int64)
    if not n:
        return out
    slot = (wanted >> _U(64 - top)).astype(np.int64) if top else np.zeros(len(wanted), np.int64)
    at, end = edges[slot].astype(np.int64), edges[slot + 1].astype(np.int64)
    goal = ((wanted << _U(top)) >> _U(32)).astype(np.uint32)
    for step in reversed([1 << i for i in range(most.bit_length())]):  # at: behind keys that are less
        if step > 8:  # few places of the index have so many
            far = np.flatnonzero(end - at >= step)
            at[far] += step * (rest[at[far] + (step - 1)] < goal[far])
        else:
            ahead = np.minimum(at + step, end)
            at = np.where(rest.take(ahead - 1, mode="clip") < goal, ahead, at)
    hit = np.flatnonzero((rest.take(at, mode="clip") == goal) & (at < end))
    place = at[hit]
    value = short[place].astype(np.int64)
    large = np.flatnonzero(value == 255)
    if width == 1:
        if len(large):
            value[large] = long[np.searchsorted(apart, place[large]), 0]
        out[hit] = value
    else:
        out[hit, 0] = out[hit, 1] = value
        if len(large):
            out[hit[large]] = long[np.searchsorted(apart, place[large])]
    return out


# --- counting -------------------------------------------------------------------------------


def _stats_of(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


@dataclass
class Model:
    path: str
    order: int
    n_buckets: int
    n_tokens: int
    n_types: int
    hot: np.ndarray
    #: unigram level: total, N1, N2, N3+ of the continuation counts
    unigram: tuple[float, float, float, float]
    #: of each order: discounts for counts 1, 2 and 3 or more
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of counts 1 to 4, held within [0, k]."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        out.append(min(max(k - (k + 1) * y * b / a if a else k * y, 0.0), k - 1e-3))
    return tuple(out)


def _group_stats(context: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts in order, and their total, N1, N2 and N3+."""
    order = np.argsort(context)
    context, counts = context[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
    if not len(at):
        return context, np.zeros((0, 4), np.int64)
    stats = np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts >= 3)], axis=1)
    return context[at], stats


#: stat: numbers of counts 1 to 4 of order k; context: s1 to s4 of context n, to be added up; gram, word: packed rows, to be added up.
_REDUCED = "kind string, k int, bucket int, n long, data binary, s1 long, s2 long, s3 long, s4 long"
_ARROW = pa.schema([("kind", pa.string()), ("k", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("data", pa.binary()), *((f"s{i}", pa.int64()) for i in (1, 2, 3, 4))])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _contexts_apart(k: int, context: np.ndarray, stats: np.ndarray, n_buckets: int) -> Iterator[tuple]:
    for c, b, s in zip(context.view(np.int64).tolist(), bucket_of(context, n_buckets).tolist(), stats.tolist(), strict=True):
        yield ("context", k, b, c, None, *s)


def _words_of(columns: list[np.ndarray], n_buckets: int) -> Iterator[tuple]:
    """The words of bigrams, counted by the words before them."""
    words = columns[-1]
    first, counts, _ = _merged(words, np.ones(len(words), np.int64))
    words = words[first]
    for b, n, d in _packed([words], counts, bucket_of(mix(words), n_buckets)):
        yield ("word", 1, b, n, d, 0, 0, 0, 0)


def _reduce(order: int, path: str, hot: np.ndarray, n_buckets: int):
    """One bucket: writes the arrays of all orders, passes on what hot contexts have elsewhere too."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        columns, counts = _unpacked(table, order)
        del table
        hashes = contexts(columns[:-1])
        rows: list[tuple] = []
        for k in range(order, 1, -1):
            before, word, context = columns[: k - 1], columns[-1], hashes[k - 2]
            first, counts, key = _merged(gram_key(context, word), counts if k == order else np.ones(len(word), np.int64))
            columns, hashes, context = [*(p[first] for p in before), word[first]], [h[first] for h in hashes[: k - 1]], context[first]
            apart = hot_run(columns[:-1], hot) == k - 1
            if k < order and apart.any():  # counted in other buckets too
                there = [c[apart] for c in columns]
                for b, n, d in _packed(there, counts[apart], bucket_of(key[apart], n_buckets)):
                    rows.append(("gram", k, b, n, d, 0, 0, 0, 0))
                own = ~apart
                columns, hashes, context, counts, key, apart = [c[own] for c in columns], [h[own] for h in hashes], context[own], counts[own], key[own], apart[own]
            rows.append(("stat", k, bucket, 0, None, *_stats_of(counts)))
            write_sorted(f"{path}/grams-{k}-{bucket}", key, counts)
            write_sorted(f"{path}/contexts-{k}-{bucket}", *_group_stats(context[~apart], counts[~apart]))
            rows += _contexts_apart(k, *_group_stats(context[apart], counts[apart]), n_buckets)
        rows += _words_of(columns, n_buckets)
        return _table(rows)

    return run


def _add_grams(k: int, path: str, n_buckets: int):
    """One bucket of n-grams of hot contexts: their counts added up, and what follows for shorter ones."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        columns, counts = _unpacked(table, k)
        hashes = contexts(columns[:-1])
        first, counts, key = _merged(gram_key(hashes[-1], columns[-1]), counts)
        columns = [c[first] for c in columns]
        write_sorted(f"{path}/grams-{k}-{n_buckets + bucket}", key, counts)
        rows: list[tuple] = [("stat", k, bucket, 0, None, *_stats_of(counts))]
        rows += _contexts_apart(k, *_group_stats(hashes[-1][first], counts), n_buckets)
        if k == 2:
            rows += _words_of(columns, n_buckets)
        else:
            shorter = columns[: k - 2] + columns[-1:]
            first, counts, key = _merged(gram_key(contexts(shorter[:-1])[-1], shorter[-1]), np.ones(len(shorter[-1]), np.int64))
            for b, n, d in _packed([c[first] for c in shorter], counts, bucket_of(key, n_buckets)):
                rows.append(("gram", k - 1, b, n, d, 0, 0, 0, 0))
        return _table(rows)

    return run


def _add_contexts(order: int, path: str, n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        ks, context = table["k"].to_numpy(), table["n"].to_numpy().view(np.uint64)
        for k in range(2, order + 1):
            own = np.flatnonzero(ks == k)
            key, at = np.unique(context[own], return_inverse=True)
            stats = np.zeros((len(key), 4), np.int64)
            for i in range(4):
                np.add.at(stats[:, i], at, table[f"s{i + 1}"].to_numpy()[own])
            write_sorted(f"{path}/contexts-{k}-{n_buckets + bucket}", key, stats)
        return pa.table({"bucket": pa.array([bucket], pa.int32())})

    return run


def _add_words(path: str, name: str):
    """Counts of the words of one bucket; passes on words that may be hot."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        (words,), counts = _unpacked(table, 1)
        first, counts, key = _merged(mix(words), counts)
        words = words[first]
        write_sorted(f"{path}/{name}-{bucket}", key, counts)
        total = int(counts.sum())
        top = np.flatnonzero(counts * HOT_SHARE >= total) if name == "words" else np.zeros(0, np.int64)
        s = [*_stats_of(counts), int((counts >= 3).sum())]
        rows = [("stat", 0, total, len(words), *s), *(("hot", int(words[i].view(np.int64)), int(counts[i]), 0, 0, 0, 0, 0, 0) for i in top)]
        return pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["kind", "word", "count", "types", "s1", "s2", "s3", "s4", "s3p"])

    return run


_ADDED = "kind string, word long, count long, types long, s1 long, s2 long, s3 long, s4 long, s3p long"


def fit(docs: DataFrame, *, order: int = ORDER, bucket_bytes: int = BUCKET_BYTES, passes: int = PASSES) -> Model:
    """Count docs.text and leave the model's arrays in the shared folder."""
    with scratch():
        return _fit(docs, order, bucket_bytes, passes)


def _fit(docs: DataFrame, order: int, bucket_bytes: int, passes: int) -> Model:
    spark = docs.sparkSession
    docs = docs.select("text")
    path = shared_dir(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, int(-(-size // bucket_bytes)))

    def dealt(packed: DataFrame, lo: int = 0, hi: int = n_buckets) -> GroupedData:
        """A task for each bucket; with a row without n-grams for each, so that each has its files."""
        every = spark.range(lo, hi).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("data"))
        return one_each(packed.select("bucket", "n", "data").union(every), lo, hi)

    def one_each(df: DataFrame, lo: int, hi: int) -> GroupedData:
        return df.withColumn("part", F.col("bucket") - lo).repartitionById(hi - lo, F.col("part")).groupBy("part")

    def sums(df: DataFrame, *names: str) -> list[int]:
        return list(df.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in names)).first())

    words = cut(dealt(docs.mapInArrow(_count_words(n_buckets), _PACK)).applyInArrow(_add_words(path, "words"), _ADDED))
    n_tokens, n_types = sums(words.where("kind = 'stat'"), "count", "types")
    # at most HOT_SHARE words can each be 1/HOT_SHARE of all tokens; START opens every text
    found = words.where((F.col("kind") == "hot") & (F.col("count") * HOT_SHARE >= n_tokens)).select("word").collect()
    hot = np.unique(np.concatenate([np.array([r.word for r in found], np.int64).view(np.uint64), [START]]))

    parts = []
    for p in range(passes):
        lo, hi = p * n_buckets // passes, (p + 1) * n_buckets // passes
        if lo < hi:
            packed = docs.mapInArrow(_count(order, hot, n_buckets, lo, hi), _PACK)
            parts.append(cut(dealt(packed, lo, hi).applyInArrow(_reduce(order, path, hot, n_buckets), _REDUCED)))
    for k in range(order - 1, 1, -1):
        rows = _all(parts).where((F.col("kind") == "gram") & (F.col("k") == k))
        parts.append(cut(dealt(rows).applyInArrow(_add_grams(k, path, n_buckets), _REDUCED)))
    reduced = _all(parts)
    stats = {r[0]: list(r)[1:] for r in reduced.where("kind = 'stat'").groupBy("k").agg(*(F.sum(f"s{i}") for i in (1, 2, 3, 4))).collect()}
    last = cut(dealt(reduced.where("kind = 'word'")).applyInArrow(_add_words(path, "left"), _ADDED)).where("kind = 'stat'")
    s = sums(last, "s1", "s2", "s3", "s4", "s3p", "count")
    every = spark.range(n_buckets).selectExpr("'context' AS kind", "0 AS k", "cast(id AS int) AS bucket", "0L AS n", "cast(null AS binary) AS data", "0L AS s1", "0L AS s2", "0L AS s3", "0L AS s4")
    apart = reduced.where("kind = 'context'").groupBy("kind", "k", "bucket", "n").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in (1, 2, 3, 4))).withColumn("data", F.lit(None).cast("binary"))
    one_each(apart.unionByName(every), 0, n_buckets).applyInArrow(_add_contexts(order, path, n_buckets), "bucket int").write.format("noop").mode("overwrite").save()
    found = {k: discounts(stats.get(k, [0, 0, 0, 0])) for k in range(2, order + 1)} | {1: discounts(s[:4])}
    release(spark)
    return Model(path, order, n_buckets, int(n_tokens), int(n_types), hot, (float(s[5]), float(s[0]), float(s[1]), float(s[4])), found)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- scoring --------------------------------------------------------------------------------


def _values(model: Model, names: list[str], key: np.ndarray, bucket: np.ndarray, width: int = 1, then: Callable = lambda found: [found]) -> list[np.ndarray]:
    """What `then` makes of the keys' values in the files of their buckets, by name: each distinct key is looked up once, in order."""
    bits = _U(int(2 * model.n_buckets).bit_length())
    place = bucket.astype(np.uint64)
    place <<= _U(64) - bits
    place |= key >> bits
    order = np.argsort(place)
    k, b = key[order], bucket[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (b[1:] != b[:-1])]) if len(k) else np.zeros(0, bool)
    alike = not new.all()
    if alike:
        k, b = k[new], b[new]
        number = np.cumsum(new) - 1
    edges = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    out = []
    for name in names:
        found = [look_up(f"{model.path}/{name}-{b[lo]}", k[lo:hi], width) for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(b)], strict=True)]
        for ranked in then(np.concatenate(found) if found else np.zeros((0, width) if width > 1 else 0, np.int64)):
            out.append(np.empty(len(key), ranked.dtype))
            out[-1][order] = ranked[number] if alike else ranked
    return out


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def _blocks(n: int) -> Iterator[slice]:
    """Parts of n values that stay in a core's cache."""
    return (slice(at, at + (1 << 15)) for at in range(0, n, 1 << 15))


def _left_over(d: tuple[float, float, float], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, what the discounts leave of it for shorter contexts); 1 and 1 of a context that isn't there, whose n-grams have counts of 0."""
    seen = stats[:, 0]
    free = stats[:, 1] * d[0] + stats[:, 2] * d[1] + stats[:, 3] * d[2]
    return np.maximum(seen, 1), np.where(seen > 0, free, 1.0)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct value, the number of each value among these)."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(values) else np.zeros(0, bool)
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def log_probabilities(model: Model, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability, training count) of each token in its context.

    What a word or a shorter n-gram decides alone is found once for each distinct one; `number` is the one that ends at a token.
    """
    n = model.n_buckets
    rep, word = _distinct(codes)
    words = codes[rep]
    word_key = mix(words)
    known, left = _values(model, ["words", "left"], word_key, bucket_of(word_key, n))
    total, n1, n2, n3 = model.unigram
    d = model.discounts[1]
    if total:
        free = (d[0] * n1 + d[1] * n2 + d[2] * n3) / total
        p = (left - _discount(left, d)) / total + free / (model.n_types + 1)
    else:
        p = np.full(len(words), 1.0)
    before = previous(codes, bounds, model.order)
    number = word
    # of each distinct n-gram as a context, the last one being that of START alone: hashes by length, and hot words from the nearest
    last = np.append(words, START)
    hashes, run = [mix(last + _ODD)], is_among(last, model.hot).astype(np.int8)
    for k in range(2, model.order + 1):
        all_hot = run == k - 1
        own = bucket_of(home(run, hashes, hashes[-1]), n)
        d = model.discounts[k]
        seen, free = _values(model, [f"contexts-{k}"], hashes[-1], np.where(all_hot, n + bucket_of(hashes[-1], n), own), 4, partial(_left_over, d))
        context = np.empty(len(codes), np.int64)
        context[1:] = number[:-1]
        context[bounds[:-1]] = len(seen) - 1
        shorter = number
        if k < model.order:
            rep, number = _distinct(context * len(words) + word)
            context, ends, shorter = context[rep], word[rep], shorter[rep]
        else:
            ends = word  # most of the longest n-grams are distinct
        key, where, lower = np.empty(len(context), np.uint64), np.empty(len(context), np.int64), p
        for some in _blocks(len(context)):
            before_, key_ = context[some], key[some]
            key_[:] = gram_key(hashes[-1][before_], words[ends[some]])
            where[some] = np.where(all_hot[before_], bucket_of(key_, n) + (n if k < model.order else 0), own[before_])
        (c,) = _values(model, [f"grams-{k}"], key, where)
        p = np.empty(len(context))
        for some in _blocks(len(context)):
            before_, c_ = context[some], c[some]
            p[some] = (c_ - _discount(c_, d) + free[before_] * lower[shorter[some]]) / seen[before_]
        if k < model.order:
            first = np.append(before[k - 2][rep], START)
            shorter = np.append(shorter, len(run) - 1)
            hashes = [h[shorter] for h in hashes]
            hashes.append(mix(hashes[-1] * _ODD + first))
            run = run[shorter]
            run += (run == k - 1) & is_among(first, model.hot)
    return np.log10(p), known[word]


_SCORED = "n_tokens long, n_known long, base_score double, score double"


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of about limit bytes of text, over the ends of batches."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for part in slices(batches, limit=limit):
        n = len(flat(part.column("text"))[0])
        if held and size + n > limit:
            yield joined()
            held, size = [], 0
        held.append(part)
        size += n
    if held:
        yield joined()


@contextmanager
def _memory_kept() -> Iterator[None]:
    """Blocks of up to 32 MB, which scoring makes again and again, stay with the worker meanwhile; then common.py's limits hold again."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 32 << 20), libc.mallopt(-1, 512 << 20)
    except (OSError, AttributeError):  # another C library
        yield
        return
    try:
        yield
    finally:
        libc.mallopt(-3, 4 << 20), libc.mallopt(-1, 8 << 20)
        libc.malloc_trim(0)


def _score(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _memory_kept():
            yield from scored(batches)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        denominator = np.log10(float(model.n_tokens + model.n_types + 1))
        for batch in _gathered(batches, SCORED_BYTES):
            codes, bounds = token_slices(batch)
            logs, counts = log_probabilities(model, codes, bounds)
            at = bounds[:-1]
            sums = [np.add.reduceat(x, at) for x in (counts > 0, np.log10(counts + 1) - denominator, logs)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(np.diff(bounds)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.float64)), pa.array(sums[2])],
                [*keep, "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """keep columns and n_tokens, n_known, base_score, score (log10 probability) of every text."""
    df = docs.select(*keep, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep), _SCORED])
    return df.mapInArrow(_score(model, list(keep)), schema)


def held_out(doc_id: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


def perplexity(docs: DataFrame, *, order: int = ORDER) -> DataFrame:
    """The model of the training rows, and the score of all rows under it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs.where(~held_out()), order=order)
    out = score(docs.withColumn("held_out", held_out()), model, "doc_id", "held_out")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
