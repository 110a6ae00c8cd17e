"""Benchmark decontamination by suffix arrays over the training documents.

The documents of one slice (a few megabytes) are one shard.  A shard's suffixes are sorted by
their first words; every suffix of every benchmark item is then found in the shard by binary
search, which gives all places of its longest verbatim match.  Suffixes that begin with a word
run which no item has can't match and are left out of the array.  Shards never meet, so
documents are not shuffled; the benchmark is the stated query set.  It is dealt by item into blocks
of bounded size, which tasks write to the shared folder; a worker maps one block after another, so
neither the driver nor a worker ever holds the benchmark.

Words are the runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, held as 64-bit
hashes.  A window is `window` consecutive words of an item; an item of fewer words, but not none,
is one window.  Defined results: null or empty texts have no words and are never contaminated;
repeated rows are judged each on its own; an empty benchmark hits nothing; items with a null id
are ignored, equal items count once; a null doc_id stays null.  Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, shared_dir, slices, span_hashes, word_spans
from .files import mapped, write_bytes

WINDOW = 8
#: A document with windows of so many items is affected.
MIN_ITEMS = 2
#: Bytes of benchmark text in one block; a longer item is a block of its own size.
BLOCK_BYTES = 256 << 10
#: With so many blocks at most, a worker keeps them all open.
HELD_BLOCKS = 64

_IS_WORD = np.zeros(256, bool)
_IS_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_IS_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class TestBlock:
    """Benchmark items as word numbers, with all their suffixes that are long enough for a window."""

    vocabulary: np.ndarray  # sorted word hashes; word number = index + 1, 0 is any other word
    items: list[str]  # ids as text
    words: np.ndarray  # word numbers of all items, 0 after each
    suffixes: dict[int, tuple[np.ndarray, np.ndarray]]  # window length -> starts in words, item of each


def block_of(ids: list, texts: list, window: int) -> TestBlock:
    b, o = flat(pa.array(texts, pa.large_string()))
    b = _LOWER[b]
    starts, ends, first = word_spans(b, o, _IS_WORD)
    hashes = span_hashes(b, starts, ends)
    vocabulary = np.unique(hashes)
    numbers = np.searchsorted(vocabulary, hashes).astype(np.int64) + 1
    words = np.zeros(len(numbers) + len(ids), np.int64)
    words[np.arange(len(numbers)) + np.repeat(np.arange(len(ids)), np.diff(first))] = numbers
    by: dict[int, tuple[list, list]] = {}
    for i in range(len(ids)):
        n, at = int(first[i + 1] - first[i]), int(first[i]) + i
        if n:
            m = min(n, window)
            pos, of = by.setdefault(m, ([], []))
            pos.append(np.arange(at, at + n - m + 1))
            of.append(np.full(n - m + 1, i))
    return TestBlock(vocabulary, [str(x) for x in ids], words, {m: (np.concatenate(p), np.concatenate(i)) for m, (p, i) in by.items()})


def _keys(words: np.ndarray, at: np.ndarray, m: int, wide: bool) -> list[np.ndarray]:
    """The m word numbers from each place, four to a 64-bit key, or two if they are wide; most significant first."""
    per, bits = (2, np.uint64(32)) if wide else (4, np.uint64(16))
    keys = []
    for k in range(0, m, per):
        key = np.zeros(len(at), np.uint64)
        for j in range(k, min(k + per, m)):
            key = (key << bits) | words[at + j].astype(np.uint64)
        keys.append(key)
    return keys


def search(words: np.ndarray, bounds: np.ndarray, block: TestBlock) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each window length: (m, places in the shard, items, lengths of the longest verbatim matches).

    words: the shard's word numbers; bounds: index of each document's first word, and their count.
    """
    if not len(words):
        return
    unknown = np.concatenate([[0], np.cumsum(words == 0)])
    stop = np.repeat(bounds[1:], np.diff(bounds))
    for m, (suffixes, item) in block.suffixes.items():
        if len(words) < m:
            continue
        heads = np.zeros(len(block.vocabulary) + 1, bool)
        heads[block.words[suffixes]] = True
        n = len(words) - m + 1
        sa = np.flatnonzero(heads[words[:n]] & (unknown[m : m + n] == unknown[:n]))
        sa = sa[sa + m <= stop[sa]]
        if not len(sa):
            continue
        wide = len(block.vocabulary) >= (1 << 16) - 1
        keys = _keys(words, sa, m, wide)
        order = np.lexsort(keys[::-1])
        sa, keys = sa[order], [k[order] for k in keys]
        wanted = _keys(block.words, suffixes, m, wide)
        lo, hi = np.searchsorted(keys[0], wanted[0], "left"), np.searchsorted(keys[0], wanted[0], "right")
        group = keys[0]
        for key, goal_key in zip(keys[1:], wanted[1:], strict=True):  # inside the range of the keys so far, the next is sorted
            _, group = np.unique(group, return_inverse=True)
            distinct, rank = np.unique(key, return_inverse=True)
            both = (group.astype(np.int64) << 32) | rank
            at = np.minimum(np.searchsorted(distinct, goal_key), len(distinct) - 1)
            found = (hi > lo) & (distinct[at] == goal_key)
            goal = (group[np.minimum(lo, len(group) - 1)].astype(np.int64) << 32) | at
            lo, hi = np.searchsorted(both, goal, "left"), np.searchsorted(both, goal, "right")
            hi, group = np.where(found, hi, lo), both
        count = hi - lo
        if not count.sum():
            continue
        which = np.repeat(np.arange(len(suffixes)), count)
        place = sa[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
        length = np.full(len(place), m)
        alive = np.flatnonzero(place + m < stop[place])
        while len(alive):  # go on word by word where the match does
            there = block.words[suffixes[which[alive]] + length[alive]]
            alive = alive[(there > 0) & (words[place[alive] + length[alive]] == there)]
            length[alive] += 1
            alive = alive[place[alive] + length[alive] < stop[place[alive]]]
        yield m, place, item[which], length


@dataclass(frozen=True)
class Blocks:
    """The benchmark's blocks in the shared folder, n of them; going through them loads one at a time."""

    path: str
    n: int

    def __iter__(self) -> Iterator[TestBlock]:
        for k in range(self.n):
            if self.n > HELD_BLOCKS:
                yield _load(self.path, k)
            else:
                yield _held(self.path, k)


def _save(path: str, k: int, block: TestBlock) -> None:
    head = json.dumps({"items": block.items, "sizes": [[m, len(p)] for m, (p, _) in block.suffixes.items()], "n": [len(block.vocabulary), len(block.words)]}).encode()
    arrays = [block.vocabulary, block.words, *(x for pair in block.suffixes.values() for x in pair)]
    write_bytes(f"{path}/{k}.block", len(head).to_bytes(8, "little"), head, b" " * (-len(head) % 8), *arrays)


def _load(path: str, k: int) -> TestBlock:
    data = mapped(f"{path}/{k}.block", "u1")
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    rest, at = data[8 + size + -size % 8 :].view(np.int64), 0
    arrays = []
    for n in (*head["n"], *(n for _, n in head["sizes"] for _ in (0, 1))):
        arrays.append(rest[at : at + n])
        at += n
    return TestBlock(arrays[0].view(np.uint64), head["items"], arrays[1], {m: (arrays[2 + 2 * i], arrays[3 + 2 * i]) for i, (m, _) in enumerate(head["sizes"])})


@lru_cache(maxsize=64)
def _held(path: str, k: int) -> TestBlock:
    return _load(path, k)


def blocks_of(benchmark: DataFrame, window: int, block_bytes: int) -> Blocks:
    """The benchmark's distinct items with a text, dealt into blocks that tasks write; only their number reaches the driver."""
    tests = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = int(total // block_bytes) + 1
    path = shared_dir(benchmark.sparkSession)

    def write(table: pa.Table) -> pa.Table:
        k = table["block"][0].as_py()
        table = table.sort_by([("item_id", "ascending")])
        _save(path, k, block_of(table["item_id"].to_pylist(), table["text"].to_pylist(), window))
        return pa.table({"block": pa.array([k], pa.int32())})

    dealt = tests.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).cast("int").alias("block"), "item_id", "text")
    have = {r[0] for r in dealt.groupBy("block").applyInArrow(write, "block int").collect()}  # a number for each block
    for k in set(range(n_blocks)) - have:
        _save(path, k, block_of([], [], window))
    return Blocks(path, n_blocks)


_OUT = "doc_id long, n_words long, hits array<int>, items array<string>, longest long, longest_item string, longest_at long"


def _found(texts: pa.Array, blocks: Blocks, window: int) -> tuple[np.ndarray, list, list, list, np.ndarray]:
    """Per document of one shard: (bounds of its words, word places inside windows, item ids, longest match, whether a window has all `window` words)."""
    b, o = flat(texts)
    b = _LOWER[b]
    starts, ends, bounds = word_spans(b, o, _IS_WORD)
    hashes = span_hashes(b, starts, ends)
    n = len(o) - 1
    hits: list = [[] for _ in range(n)]
    items: list = [[] for _ in range(n)]
    best: list = [(0, None, None)] * n
    full = np.zeros(n, bool)
    for block in blocks:
        if not len(block.vocabulary):
            continue
        at = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
        words = np.where(block.vocabulary[at] == hashes, at + 1, 0)
        for m, place, item, length in search(words, bounds, block):
            doc = np.searchsorted(bounds, place, "right") - 1
            full[doc] |= m == window
            order = np.argsort(doc, kind="stable")
            doc, place, item, length = doc[order], place[order], item[order], length[order]
            cuts = np.flatnonzero(np.diff(doc)) + 1
            for p, i, s, d in zip(np.split(place, cuts), np.split(item, cuts), np.split(length, cuts), doc[np.concatenate([[0], cuts])]):
                hits[d].append(np.unique((p[:, None] + np.arange(m)).ravel()) - bounds[d])
                items[d] += [block.items[x] for x in np.unique(i)]
                top = int(np.lexsort((p, -s))[0])
                best[d] = max(best[d], (int(s[top]), block.items[int(i[top])], int(p[top] - bounds[d])), key=lambda x: x[0])
    return bounds, hits, [sorted(set(x)) for x in items], best, full


def _scan(blocks: Blocks, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bounds, hits, items, best, _ = _found(batch.column("text"), blocks, window)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(bounds)),
                    pa.array([np.unique(np.concatenate(h)).astype(np.int32) if h else [] for h in hits], pa.list_(pa.int32())),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array([x[0] for x in best], pa.int64()),
                    pa.array([x[1] for x in best], pa.string()),
                    pa.array([x[2] for x in best], pa.int64()),
                ],
                ["doc_id", "n_words", "hits", "items", "longest", "longest_item", "longest_at"],
            )

    return run


def matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: n_words, hits (numbers of the words inside a window), items (ids, sorted),
    and the longest verbatim match with its item and place.

    Each task goes through the benchmark's blocks one after another; a block is bounded by
    block_bytes (one item may be longer), so work is the documents times the number of blocks.
    """
    blocks = blocks_of(benchmark, window, block_bytes)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(blocks, window), _OUT)


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    found = matches(docs, benchmark, window=window)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
    )


def sha_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, min_items: int = MIN_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the affected rows, all columns as they were; one pass, no shuffle.

    A document goes if it holds a verbatim window of `window` words, of one item already, or
    min_items items of any length: a short item alone, such as a common phrase, says too little.
    """
    blocks = blocks_of(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, _, items, _, full = _found(batch.column(batch.schema.get_field_index("text")), blocks, window)
            yield batch.filter(pa.array([not f and len(x) < min_items for x, f in zip(items, full, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
