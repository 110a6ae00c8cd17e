"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Texts with equal words are one class.  Each class has a MinHash signature of DEPTH values for every
tree of the forest.  A tree is the trie of its signatures, kept as a table sorted by them: the
longest common prefix of a signature and its neighbours in that order is the deepest node at which
it meets another.  Matched prefixes start at DEPTH values and are shortened by one at a time until a pair
at the threshold shares one with the target's probability, and the recall, measured on all neighbours near
the threshold by the trees that did not find them, reaches the target too (`matched_prefix`).  Classes that share such a prefix are compared by their signatures, all pairs of
them; alike ones are connected to candidate clusters.  Within a cluster every pair is verified on
its whole shingle sets, in blocks, and only link counts and spanning edges leave a task, never pairs.

Skew: copies collapse before anything is shuffled by prefix.  A prefix with more than BUCKET_ROWS
classes is dealt over tasks that all see the same PIVOTS classes.  Differences of signatures obey
the triangle inequality, so of two alike classes, one of which is near a pivot, the other touches that
pivot (SETTLED, TOUCHING), and all touch edges are kept; only classes near no pivot meet each other, in
pairs of blocks.  So every pair of a prefix whose estimated likeness is ALIKE is in one cluster,
whatever the prefix's size.  Clusters of more than BLOCK classes, or of long texts, are verified as pairs of blocks.

Shingles are sets of `shingle` consecutive words `[^\\x20\\x09-\\x0D]+`, unchanged; a text of fewer words is
one shingle.  Defined results: null, empty and blank texts are one class without links; repeated
rows are copies; a null doc_id counts as the least id and stays null; ties have the least id as
representative; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN_WORD, cut, flat, gram_hashes, keep, key_of, mix, null_key, scratch, slices, span_hashes, word_spans
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
#: Trees of the forest, the length of the signature in each, and the shortest prefix that may match.
TREES, DEPTH, SHORTEST = 32, 8, 4
#: A pair at the threshold is found with this probability at least.
RECALL = 0.9999
#: Recall is measured on all neighbours in the sorted tables whose estimated likeness is at most this far over the threshold.
NEAR = 0.1
#: Estimated likeness, of COMPARED values, from which classes of one prefix are candidates: five deviations under the threshold.
ALIKE, COMPARED = 0.62, 128
#: A class this like a pivot needs no other comparison in its prefix, as all that are ALIKE to it are TOUCHING the pivot.
SETTLED, TOUCHING = 0.76, 0.38
BUCKET_ROWS, PIVOTS = 2000, 32
#: Classes of a block, and the bytes of their texts.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Shingles whose meetings are counted at a time.
MEETING = 1 << 20


def found_at(threshold: float, prefix: int, trees: int = TREES) -> float:
    """Probability that a pair of this likeness shares a prefix of so many values in one of the trees."""
    return 1 - (1 - threshold**prefix) ** trees


def shingle_sets(b: np.ndarray, o: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, bounds, class): the distinct shingle hashes of each text in order, and the hash of its words (0: none)."""
    starts, ends, first = word_spans(b, o, PLAIN_WORD)
    words = span_hashes(b, starts, ends)
    count = np.diff(first)
    texts = len(o) - 1
    data = b.tobytes()
    whole = np.zeros(texts, np.uint64)
    for i in np.flatnonzero(count):  # a cryptographic hash: texts made to collide don't
        whole[i] = int.from_bytes(hashlib.blake2b(b" ".join(data[o[i] : o[i + 1]].split()), digest_size=8).digest(), "little") or 1
    room = np.where(count >= n, count - n + 1, 0)
    at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum()) if texts else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(texts), room)
    grams = gram_hashes(words, n)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < n))
    doc, grams = np.concatenate([doc, short]), np.concatenate([grams, whole[short]])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, bool)
    return grams[new], np.searchsorted(doc[new], np.arange(texts + 1)), whole


_SEEDS = (mix(np.arange(1, 1025, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (mix(np.arange(5001, 6025, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def signatures(grams: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """(texts, k) MinHash values, a byte of each; texts without shingles must not be asked for."""
    out = np.empty((len(bounds) - 1, k), np.uint8)
    lengths = np.diff(bounds)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    at = 0
    while at < len(lengths):  # blocks of about 2,048 shingles stay in cache; a long text is one block
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 2048, "right")) - 1)
        low = np.full((to - at, k), np.uint32(0xFFFFFFFF))
        for lo in range(int(bounds[at]), int(bounds[to]), 2048):
            hi = min(lo + 2048, int(bounds[to]))
            values = short[lo:hi, None] * _SEEDS[None, :k]
            values += _SHIFT[None, :k]
            first = int(np.searchsorted(bounds, lo, "right")) - 1
            inside = np.arange(first, to)
            inside = inside[(bounds[inside] < hi) & (bounds[inside + 1] > lo)]
            low[inside - at] = np.minimum(low[inside - at], np.minimum.reduceat(values, np.maximum(bounds[inside], lo) - lo, axis=0))
        out[at:to] = (low * np.uint32(0x9E3779B1)) >> np.uint32(24)
        at = to
    return out


def _sign(shingle: int):
    """The class of each text and its signature: the first value of every tree, then the second, and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            b, o = flat(batch.column("text"))
            grams, bounds, whole = shingle_sets(b, o, shingle)
            some = np.flatnonzero(np.diff(bounds) > 0)
            full = signatures(grams, np.concatenate([bounds[some], bounds[-1:]]), TREES * DEPTH)
            sigs: list = [None] * batch.num_rows
            for i, d in enumerate(some):
                sigs[d] = full[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("_h"), pa.array(whole.view(np.int64)), pa.array(np.diff(o)), pa.array(sigs, pa.binary())], ["_k", "_h", "node", "size", "sig"])

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


# --- sorted tables --------------------------------------------------------------------------


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and tree: its label there, all values of the signature in one number, the first on top."""
    for batch in batches:
        sigs = _matrix(batch.column("sig"), TREES * DEPTH).reshape(-1, DEPTH, TREES).transpose(0, 2, 1)
        labels = np.ascontiguousarray(sigs).view(">u8").astype(np.uint64).reshape(-1)
        trees = np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(trees), pa.array(labels.view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), TREES))], ["tree", "label", "node"])


def common_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values, from the first, two labels share."""
    x = a ^ b
    out = np.zeros(len(x), np.int32)
    for k in range(DEPTH):
        out += x >> np.uint64(8 * k) == 0
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (tree, label): meets is the longest prefix that a row shares with a neighbour, before the row it shares SHORTEST values with.

    The first and last row of a task may have their neighbour in another one, and count as met.
    """
    held: pa.RecordBatch | None = None  # the row before, whose next neighbour isn't known yet, and its prefix with its own neighbour before
    with_before = DEPTH
    for batch in batches:
        if not batch.num_rows:
            continue
        both = pa.Table.from_batches([held, batch]).combine_chunks() if held is not None else pa.Table.from_batches([batch])
        tree, label, node = both["tree"].to_numpy(), both["label"].to_numpy().view(np.uint64), both["node"].to_numpy()
        step = np.where(tree[1:] == tree[:-1], common_values(label[1:], label[:-1]), 0)
        back = np.concatenate([[with_before], step])
        meets = np.maximum(back[:-1], step)  # the last row waits for the next batch
        near = np.concatenate([[False], step >= SHORTEST])[:-1]
        before = pa.array(np.concatenate([node[:1], node[:-1]])[:-1], mask=~near)
        keep = pa.array(np.flatnonzero(meets >= SHORTEST))
        rows = [pa.array(tree[:-1]), pa.array(label[:-1].view(np.int64)), pa.array(node[:-1]), pa.array(meets.astype(np.int32)), before]
        yield pa.RecordBatch.from_arrays([x.take(keep) for x in rows], ["tree", "label", "node", "meets", "before"])
        held, with_before = batch.slice(batch.num_rows - 1), int(back[-1])
    if held is not None:
        yield pa.RecordBatch.from_arrays([*(held.column(c) for c in ("tree", "label", "node")), pa.array([DEPTH], pa.int32()), pa.nulls(1, pa.int64())], ["tree", "label", "node", "meets", "before"])


def forest(signed: DataFrame) -> DataFrame:
    """signed: node, sig.  The trees' rows that share SHORTEST values with a neighbour at least: tree, label, node, meets, before."""
    rows = signed.mapInArrow(_spread, "tree int, label long, node long")
    ranged = rows.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")  # node: equal labels can be parted
    return cut(ranged.mapInArrow(_neighbours, "tree int, label long, node long, meets int, before long"))


def _probe(threshold: float):
    """Weights of neighbours that the other trees find, by the length of the prefix; all neighbours' last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(c), TREES * DEPTH).reshape(-1, DEPTH, TREES) for c in ("sig", "other"))
            same = a == b
            like = same.mean(axis=(1, 2))
            near = np.flatnonzero((like >= threshold) & (like < threshold + NEAR))
            deep = np.minimum.accumulate(same[near], axis=1).sum(axis=1)  # (pairs, trees)
            pair, tree = np.nonzero(batch.column("trees").to_numpy()[near, None] >> np.arange(TREES) & 1)  # a pair counts for each tree in which it is one of neighbours
            deep = deep[pair]
            deep[np.arange(len(deep)), tree] = 0
            weight = 1 / np.maximum(like[near][pair], 0.1) ** SHORTEST  # finding a pair has that much chance
            found = [float(weight[deep.max(axis=1) >= d].sum()) for d in range(1, DEPTH + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*found, float(weight.sum()))], [*(f"d{d}" for d in range(1, DEPTH + 1)), "all"])

    return run


def matched_prefix(rows: DataFrame, signed: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix, shortened value by value from DEPTH, that reaches the recall in theory and as measured.

    In theory it is the chance of a pair at the threshold, whatever the rows are.  As measured it is the
    share of all neighbours near the threshold that share the prefix in another tree than the one in
    whose order they are neighbours (but for the two rows at a border of tasks); a smaller share shortens the prefix further.
    """
    # a class has two neighbours in a tree at most, so no key of these joins is hot
    ends = (F.least("node", "before").alias("node"), F.greatest("node", "before").alias("to"))
    met = rows.where("before is not null").groupBy(*ends).agg(F.bit_or(F.expr("shiftleft(1L, tree)")).alias("trees"))
    one = met.join(signed.select("node", F.col("sig").alias("other")), "node").select(F.col("to").alias("node"), "trees", "other")
    pairs = one.join(signed.select("node", "sig"), "node")
    names = [*(f"d{d}" for d in range(1, DEPTH + 1)), "all"]
    found = pairs.mapInArrow(_probe(threshold), ", ".join(f"`{n}` double" for n in names)).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).first()
    for d in range(DEPTH, SHORTEST, -1):
        measured = found[f"d{d}"] / found["all"] if found["all"] else 1.0
        if min(found_at(threshold, d), measured) >= recall:
            return d
    return SHORTEST


# --- candidates -----------------------------------------------------------------------------


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard, of each row of a and each of b, as the share of equal values; a little high, as bytes may be equal by chance."""
    out = np.empty((len(a), len(b)), np.float32)
    for at in range(0, len(a), 32):
        out[at : at + 32] = (a[at : at + 32, None, :] == b[None, :, :]).mean(axis=2, dtype=np.float32)
    return out


def connected(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n places the least one that edges x, y connect it to."""
    root = np.arange(n)
    while len(x):
        low = np.minimum(root[x], root[y])
        old = root.copy()
        np.minimum.at(root, old[x], low)
        np.minimum.at(root, old[y], low)
        root = root[root]
        if (root == old).all():
            break
    return root


def _by_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (bucket, sub, pivots first): edges to touched pivots; kind 1: classes near no pivot."""
    at, pivots, names = None, np.zeros((0, COMPARED), np.uint8), np.zeros(0, np.int64)
    for batch in batches:
        bucket, sub, node = (batch.column(c).to_numpy() for c in ("bucket", "sub", "node"))
        is_pivot = batch.column("pivot").to_numpy(zero_copy_only=False)
        sigs = _matrix(batch.column("sig"), COMPARED)
        a, b, kind, where = [], [], [], []
        edge = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (sub[1:] != sub[:-1])])) if len(bucket) else np.zeros(0, np.int64)
        for lo, hi in zip(edge, [*edge[1:], len(bucket)], strict=True):
            if at != (bucket[lo], sub[lo]):
                at, pivots, names = (bucket[lo], sub[lo]), np.zeros((0, COMPARED), np.uint8), np.zeros(0, np.int64)
            mine = np.arange(lo, hi)
            new = mine[is_pivot[lo:hi]]
            pivots, names = np.concatenate([pivots, sigs[new]]), np.concatenate([names, node[new]])
            if not len(names):
                a.append(node[mine]), b.append(node[mine]), kind.append(np.ones(len(mine), np.int32)), where.append(bucket[mine])
                continue
            like = likeness(sigs[mine], pivots)
            touched = like >= TOUCHING
            some = np.flatnonzero(touched.any(axis=1))
            first = touched.argmax(axis=1)
            x, y = np.nonzero(touched[some])
            pairs = np.unique(first[some][x] * len(names) + y)  # pivots that one class touches are connected once
            a += [node[mine[some]], names[pairs // len(names)]]
            b += [names[first[some]], names[pairs % len(names)]]
            rest = mine[(like.max(axis=1) < SETTLED) & ~is_pivot[lo:hi]]
            a.append(node[rest]), b.append(node[rest])
            kind += [np.zeros(len(some) + len(pairs), np.int32), np.ones(len(rest), np.int32)]
            where += [np.zeros(len(some) + len(pairs), np.int64), bucket[rest]]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (a, b, kind, where)], ["a", "b", "kind", "bucket"])


def _meet_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (bucket, i, j): edges that connect the alike classes of a bucket, or of its blocks i and j.  One group is held."""

    def edges(table: pa.Table) -> pa.RecordBatch:
        bucket, i, j, own, node = (table[c].to_numpy() for c in ("bucket", "i", "j", "own", "node"))
        sigs = _matrix(table["sig"].combine_chunks() if isinstance(table["sig"], pa.ChunkedArray) else table["sig"], COMPARED)
        n = len(node)
        group = np.concatenate([[0], np.cumsum((bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))])
        size = np.bincount(group)
        few = size[group] <= 16
        xs, ys = [], []
        for k in range(1, 16):  # small groups: every row with the row k before it
            x = np.flatnonzero(few[k:] & (group[k:] == group[:-k])) + k
            if not len(x):
                break
            x = x[(i[x] == j[x]) | (own[x] != own[x - k])]
            hit = (sigs[x] == sigs[x - k]).mean(axis=1) >= ALIKE
            xs.append(x[hit]), ys.append(x[hit] - k)
        first = np.concatenate([[0], np.cumsum(size)])
        for g in np.flatnonzero(size > 16):
            rows = np.arange(first[g], first[g + 1])
            left = rows[own[rows] == i[rows[0]]]
            right = rows[own[rows] == j[rows[0]]]
            for at in range(0, len(left), 256):
                p, q = np.nonzero(likeness(sigs[left[at : at + 256]], sigs[right]) >= ALIKE)
                xs.append(left[at + p]), ys.append(right[q])
                if len(p) > 4 * len(rows):  # only what connects is kept
                    root = connected(n, np.concatenate(xs), np.concatenate(ys))
                    xs, ys = [np.arange(n)[root != np.arange(n)]], [root[root != np.arange(n)]]
        root = connected(n, np.concatenate(xs), np.concatenate(ys)) if xs else np.arange(n)
        other = np.flatnonzero(root != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[root[other]])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in ("bucket", "i", "j")]
        last = np.logical_and.reduce([k == k[-1] for k in keys])
        start = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if start or (held and any(held[-1].column(c)[-1].as_py() != k[0] for c, k in zip(("bucket", "i", "j"), keys, strict=True))):
            whole = [*held, batch.slice(0, start)]
            yield edges(pa.Table.from_batches([x for x in whole if x.num_rows]))
            held = []
        held.append(batch.slice(start))
    if held:
        yield edges(pa.Table.from_batches(held))


def candidate_edges(rows: DataFrame, signed: DataFrame, prefix: int) -> DataFrame:
    """rows: forest().  a, b: edges whose components hold every pair that shares a prefix and is ALIKE."""
    bucket = F.xxhash64("tree", F.shiftrightunsigned("label", 8 * (DEPTH - prefix)))
    members = rows.where(F.col("meets") >= prefix).select(bucket.alias("bucket"), "node")
    big = cut(members.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS))
    members = members.join(signed.select("node", F.expr(f"substring(sig, 1, {COMPARED})").alias("sig")), "node")
    zero = F.lit(0)
    if big.isEmpty():
        small, edges = members, None
    else:
        members = members.join(big, "bucket", "left")
        small = members.where("n is null")
        parts = F.ceil(F.col("n") / BUCKET_ROWS).cast("int")
        lot = F.pmod(F.xxhash64("node", "bucket"), F.lit(1_000_000_007)) / 1_000_000_007
        dealt = members.where("n is not null").withColumn("pivot", lot * F.col("n") < PIVOTS)
        own = F.array(F.pmod(F.xxhash64("node", "bucket", F.lit(1)), parts).cast("int"))
        dealt = dealt.withColumn("sub", F.explode(F.when(F.col("pivot"), F.sequence(zero, parts - 1)).otherwise(own)))
        dealt = dealt.select("bucket", "sub", "node", "pivot", "sig").repartition("bucket", "sub").sortWithinPartitions("bucket", "sub", F.desc("pivot"), "node")
        first = cut(dealt.mapInArrow(_by_pivots, "a long, b long, kind int, bucket long"))
        edges = first.where("kind = 0 and a <> b").select("a", "b")
        rest = first.where("kind = 1").select(F.col("a").alias("node"), "bucket")
        sizes = rest.groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("parts"))
        rest = rest.join(sizes, "bucket").join(signed.select("node", F.expr(f"substring(sig, 1, {COMPARED})").alias("sig")), "node")
        rest = rest.withColumn("own", F.pmod(F.xxhash64("node", "bucket", F.lit(2)), "parts").cast("int")).withColumn("o", F.explode(F.sequence(zero, F.col("parts") - 1)))
        rest = rest.select("bucket", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "node", "sig")
    met = small.select("bucket", zero.alias("i"), zero.alias("j"), zero.alias("own"), "node", "sig")
    met = met if edges is None else met.union(rest)
    met = met.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node").mapInArrow(_meet_all, "a long, b long")
    return (met if edges is None else met.union(edges)).distinct()


def _shingles(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            grams, bounds, whole = shingle_sets(*flat(batch.column("text")), shingle)
            right = whole.view(np.int64) == batch.column("node").to_numpy()
            keep = pa.array(np.flatnonzero(right))
            data = [grams[bounds[i] : bounds[i + 1]].tobytes() for i in np.flatnonzero(right)]
            yield pa.RecordBatch.from_arrays([batch.column("root").take(keep), batch.column("node").take(keep), batch.column("m").take(keep), pa.array(data, pa.binary())], ["root", "node", "m", "grams"])

    return run


def _meet(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right) sizes of intersections of sorted sets, as products of incidence matrices in column blocks.

    The sets are gone through by ranges of values, so that about MEETING shingles are handled at a time.
    """
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], np.float64).reshape(len(left), len(right))
    sets = [*left, *right]
    parts = sum(map(len, sets)) // MEETING + 1
    edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
    cuts = np.array([np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in sets])
    out = np.zeros((len(left), len(right)))
    for k in range(parts):
        values = np.concatenate([x[c[k] : c[k + 1]] for x, c in zip(sets, cuts, strict=True)])
        row = np.repeat(np.arange(len(sets)), cuts[:, k + 1] - cuts[:, k])
        _, column, count = np.unique(values, return_inverse=True, return_counts=True)
        shared = count[column] > 1  # a shingle of one set is in no intersection
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = 4096
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, lo), np.searchsorted(column, lo + width)
            part = np.zeros((len(sets), width), np.float32)
            part[row[a:b], column[a:b] - lo] = 1
            out += part[: len(left)] @ part[len(left) :].T
    return out


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        seen: dict[int, tuple[int, bytes]] = {}
        for node, own, grams in zip(table["node"].to_pylist(), table["own"].to_pylist(), table["grams"].to_pylist(), strict=True):
            seen.setdefault(node, (own, grams))
        nodes = np.array(sorted(seen), np.int64)
        sets = [np.frombuffer(seen[int(x)][1], np.uint64) for x in nodes]
        own = np.array([seen[int(x)][0] for x in nodes], np.int64)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        both = _meet([sets[x] for x in left], [sets[x] for x in right])
        size = np.array([len(x) for x in sets], np.float64)
        linked = both >= threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-9
        if i == j:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(nodes), np.int64)
        links[left] += linked.sum(axis=1)
        if i != j:
            links[right] += linked.sum(axis=0)
        x, y = np.nonzero(linked)
        root = connected(len(nodes), left[x], right[y])  # spanning edges
        return pa.table([pa.array(nodes), pa.array(nodes[root]), pa.array(links)], names=["node", "to", "links"])

    return run


def classes_of(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(every row's _k, _h and node, every class: node, _k and _h of its first row, n_copies, size of its shortest text, sig)."""
    rows = docs.select(key_of().alias("_k"), F.xxhash64("text").alias("_h"), "text")
    signed = keep(cut(rows.mapInArrow(_sign(shingle), "_k long, _h long, node long, size long, sig binary")))
    classes = signed.groupBy("node").agg(F.min(F.struct("_k", "_h")).alias("least"), F.count("*").alias("n_copies"), F.min("size").alias("size"), F.first("sig").alias("sig"))
    return signed.select("_k", "_h", "node"), cut(classes.select("node", "least.*", "n_copies", "size", "sig"))


def _linked(docs: DataFrame, shingle: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(every row's _k, _h and node; every class: node, _k, _h, n_copies, n_links, and the first row of its group, _gk and _gh)."""
    with scratch():
        return _search(docs, shingle, threshold, recall)


def _search(docs: DataFrame, shingle: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    rows, classes = classes_of(docs, shingle)
    signed = classes.where("sig is not null").select("node", "sig")
    trees = forest(signed)
    edges = candidate_edges(trees, signed, matched_prefix(trees, signed, threshold=threshold, recall=recall))
    clusters = components(edges)
    named = clusters.join(classes.select("node", "_k", "_h", "size"), "node")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("long")
    members = named.drop("size").join(named.groupBy("root").agg(blocks.alias("m")), "root")
    texts = docs.select(key_of().alias("_k"), F.xxhash64("text").alias("_h"), "text").join(members, ["_k", "_h"])
    texts = texts.groupBy("node").agg(F.first("root").alias("root"), F.first("m").alias("m"), F.first("text").alias("text"))  # equal rows with one id
    sets = texts.select("root", "node", "m", "text").mapInArrow(_shingles(shingle), "root long, node long, m long, grams binary")
    sets = sets.withColumn("own", F.pmod(F.xxhash64("node"), "m").cast("int"))
    other = F.explode(F.sequence(F.lit(0), (F.col("m") - 1).cast("int"))).alias("other")
    dealt = sets.select("*", other).select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "grams")
    found = cut(dealt.groupBy("root", "i", "j").applyInArrow(_verify(threshold), "node long, to long, links long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    groups = components(found.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    firsts = groups.join(classes.select("node", "_k", "_h"), "node").groupBy("root").agg(F.min(F.struct("_k", "_h")).alias("g"))
    groups = groups.join(firsts, "root").select("node", "g")
    classes = classes.drop("sig", "size").join(counts, "node", "left").join(groups, "node", "left")
    group = F.coalesce("g", F.struct("_k", "_h"))
    # written, so that the join with the rows of a class of very many copies is one that Spark can split
    return rows, keep(cut(classes.select("node", "_k", "_h", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), group["_k"].alias("_gk"), group["_h"].alias("_gh"))))


def links(docs: DataFrame, *, shingle: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (least id with the same words), n_copies (rows of the
    class), n_links (other classes with a Jaccard of threshold or more), group_id (least id that is
    reached over links)."""
    rows, classes = _linked(docs, shingle, threshold, recall)
    out = rows.select("_k", "node").join(classes.select("node", F.col("_k").alias("_c"), "n_copies", "n_links", "_gk"), "node")
    return out.select(
        null_key("_k").alias("doc_id"),
        null_key("_c").alias("class_id"),
        F.col("n_copies").cast("long").alias("n_copies"),
        F.col("n_links").cast("long").alias("n_links"),
        null_key("_gk").alias("group_id"),
    )


def keep_one(docs: DataFrame, *, shingle: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with one document of each group, the one with the least id (of rows that share it, the text with the least hash); all columns kept."""
    _, classes = _linked(docs, shingle, threshold, recall)
    kept = classes.where("_k = _gk and _h <=> _gh").select("_k", F.coalesce("_h", F.lit(0)).alias("_h"))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), key_of().alias("_k"), F.xxhash64("text").alias("_h"))
    # the join deals rows by id and text, which serves the duplicates as well
    return packed.join(kept, ["_k", "_h"], "left_semi").dropDuplicates(["_k", "_h"]).select("_row.*")
