"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased words and the 4- and 5-byte grams inside them.  The vocabulary is the terms that a
chi-squared test ties to the label on a bounded sample of labelled rows, MAX_TERMS at most; cosines
are exact over it.  How many documents have a term is counted over all documents.  The sample's vectors
form an inverted index in blocks of rows; for each term and block the largest weight is kept.  A
text's blocks are visited in order of their upper bound, and the visit ends when no block can
hold a nearer neighbour than the k found, so the k nearest are exact.  Votes are weighted by
cosine, shrunk towards none, and calibrated by isotonic regression on leave-one-out votes; the
neighbours are given as evidence.

Defined results: a text without terms of the vocabulary (also null or empty) has no neighbours and
gets the calibrated score of no votes; repeated rows are scored each on its own; ties of cosine go
to the lower doc_id; without labelled rows every score is 0; rows whose label or id is null aren't
learned from; of several labels of one id the greatest counts; only doc_id and text of documents, and doc_id and the label of labels, are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_gram_hashes, flat, slices, span_hashes, word_spans

#: The classifier is fitted on so many labelled rows at most, those with the least hash of doc_id.
SAMPLE_ROWS = 12_000
GRAMS = (4, 5)
MAX_TERMS = 1024
MIN_CHI2 = 30.0
#: A term occurs in so many labelled toxic rows at least, and in this share of them.
MIN_ROWS, MIN_SHARE = 4, 0.004
NEIGHBOURS = 16
BLOCK_ROWS = 64
#: Texts that are looked up together.
BATCH = 1024
#: Votes are divided by their sum plus this, so that faint likeness counts little.
SHRINK = 0.5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[list(b"abcdefghijklmnopqrstuvwxyz")] = True
_IS_WORD[128:] = True
_GRAM_MARK = np.uint64(0x1B873593CC9E2D51)


def terms(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term hash) of every term in every text."""
    b = _LOWER[b]
    starts, ends, first = word_spans(b, o, _IS_WORD)
    n = len(o) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    words = span_hashes(b, starts, ends)
    docs, found = [doc], [words]
    for k in GRAMS:
        room = np.maximum(ends - starts - k + 1, 0)  # grams of each word
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum()) if len(room) else np.zeros(0, np.int64)
        docs.append(np.repeat(doc, room))
        found.append(byte_gram_hashes(b, k)[at] ^ (_GRAM_MARK * np.uint64(k)) if len(at) else np.zeros(0, np.uint64))
    return np.concatenate(docs), np.concatenate(found)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, rows, toxic rows) of each slice."""
    for batch in slices(batches):
        doc, term = terms(*flat(batch.column("text")))
        order = np.lexsort((doc, term))
        doc, term = doc[order], term[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]) if len(doc) else np.zeros(0, bool)
        doc, term = doc[new], term[new]
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        at = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(term[at].view(np.int64)), pa.array(np.add.reduceat(np.ones(len(term), np.int64), at)), pa.array(np.add.reduceat(label, at))], ["term", "n", "toxic"])


def vectors(b: np.ndarray, o: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF vectors of the texts over the vocabulary: (text, term number, weight), in order."""
    doc, term = terms(b, o)
    few = np.zeros(1 << 16, bool)
    few[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    may = few[(term & np.uint64(0xFFFF)).astype(np.int64)]
    doc, term = doc[may], term[may]
    if not len(vocabulary) or not len(term):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
    found = vocabulary[at] == term
    pair, count = np.unique(doc[found] * len(vocabulary) + at[found], return_counts=True)
    doc, number = pair // len(vocabulary), pair % len(vocabulary)
    weight = (1 + np.log(count)) * idf[number]
    norm = np.sqrt(np.bincount(doc, weight * weight, len(o) - 1))
    return doc, number, weight / norm[doc]


def _frequencies(vocabulary: np.ndarray):
    """(term number, texts of the task that have it), and -1 with the number of all texts."""
    few = np.zeros(1 << 16, bool)
    few[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in slices(batches):
            doc, term = terms(*flat(batch.column("text")))
            may = few[(term & np.uint64(0xFFFF)).astype(np.int64)]
            doc, term = doc[may], term[may]
            at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
            found = vocabulary[at] == term
            pair = np.unique(doc[found] * len(vocabulary) + at[found])
            total += np.bincount(pair % len(vocabulary), minlength=len(vocabulary))
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(vocabulary), dtype=np.int32)), pa.array(np.concatenate([[n], total]))], ["term", "n"])

    return run


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """In how many of all rows each term of the vocabulary occurs, after the number of rows: a sum for each term leaves a task."""
    counts = docs.select("text").mapInArrow(_frequencies(vocabulary), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in counts:
        out[r.term + 1] = r.n
    return out


@dataclass
class Index:
    """Block-max inverted index of unit vectors: BLOCK_ROWS rows a block, postings by (block, term)."""

    ids: np.ndarray
    labels: np.ndarray
    maxima: np.ndarray  # (terms, blocks): the largest weight of a term in a block
    terms: list[np.ndarray]  # of each block: the terms that occur in it
    weights: list[np.ndarray]  # of each block: (those terms, rows)

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """queries: (texts, terms).  (rows, cosines) of each text's k nearest rows, nearest first; cosine 0: none.

        A candidate is one integer, its cosine in units of 1e-9 above its rank among ties.
        """
        n, blocks = len(queries), len(self.terms)
        best = np.zeros((n, k), np.int64)
        bound = queries @ self.maxima
        done = np.zeros((n, blocks), bool)

        def visit(block: int, which: np.ndarray) -> None:
            cosines = queries[np.ix_(which, self.terms[block])] @ self.weights[block]
            rows = block * BLOCK_ROWS + np.arange(cosines.shape[1])
            found = np.where(cosines > 1e-9, (np.rint(cosines * 1e9).astype(np.int64) << 24) | ((1 << 24) - 1 - rows), 0)
            both = np.concatenate([best[which], found], axis=1)
            best[which] = -np.sort(np.partition(-both, k - 1, axis=1)[:, :k], axis=1)
            done[which, block] = True

        first = np.argsort(-bound, axis=1, kind="stable")[:, :2]
        for block in range(blocks):  # each text's two most promising blocks, then all that may still matter
            which = np.flatnonzero((first == block).any(axis=1) & (bound[:, block] > 0))
            if len(which):
                visit(block, which)
        for block in range(blocks):
            which = np.flatnonzero(~done[:, block] & (bound[:, block] > 0) & (bound[:, block] * 1e9 + 2 >= best[:, k - 1] >> 24))
            if len(which):
                visit(block, which)
        return np.where(best > 0, (1 << 24) - 1 - (best & ((1 << 24) - 1)), -1), (best >> 24) / 1e9


def build_index(ids: np.ndarray, labels: np.ndarray, vecs: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> tuple[Index, np.ndarray]:
    """The index and the vectors in its order of rows.

    Rows that share their heaviest term are put in the same blocks, which keeps bounds tight.
    """
    heaviest = np.array([v[0][np.argmax(v[1])] if len(v[0]) else -1 for v in vecs], np.int64)
    order = np.lexsort((ids, heaviest))
    dense = np.zeros((len(vecs), n_terms))
    for row, i in enumerate(order):
        dense[row, vecs[i][0]] = vecs[i][1]
    parts = [dense[at : at + BLOCK_ROWS] for at in range(0, len(vecs), BLOCK_ROWS)]
    used = [np.flatnonzero(p.any(axis=0)) for p in parts]
    maxima = np.stack([p.max(axis=0) for p in parts], axis=1) if parts else np.zeros((n_terms, 0))
    return Index(ids[order], labels[order], maxima, used, [np.ascontiguousarray(p[:, u].T) for p, u in zip(parts, used, strict=True)]), dense


def votes_of(index: Index, rows: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    toxic = np.where(rows >= 0, index.labels[np.maximum(rows, 0)], 0.0) if len(index.labels) else np.zeros(rows.shape)
    return (cosines * toxic).sum(axis=1) / (cosines.sum(axis=1) + SHRINK)


def dense_queries(doc: np.ndarray, number: np.ndarray, weight: np.ndarray, n_terms: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, their vectors) of the texts that have terms, BATCH at a time."""
    texts = np.unique(doc)
    for at in range(0, len(texts), BATCH):
        part = texts[at : at + BATCH]
        lo, hi = np.searchsorted(doc, part[0]), np.searchsorted(doc, part[-1], "right")
        out = np.zeros((len(part), n_terms))
        out[np.searchsorted(part, doc[lo:hi]), number[lo:hi]] = weight[lo:hi]
        yield part, out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, value) of the least-squares rising fit, by pooling adjacent violators."""
    values, inverse = np.unique(x, return_inverse=True)
    total, n = np.bincount(inverse, y), np.bincount(inverse).astype(float)
    pools: list[list[float]] = []  # sum, count, first x, last x
    for v, t, c in zip(values, total, n, strict=True):
        pools.append([t, c, v, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t2, c2, _, last = pools.pop()
            pools[-1][0] += t2
            pools[-1][1] += c2
            pools[-1][3] = last
    xs = np.array([p for q in pools for p in (q[2], q[3])])
    return xs, np.array([q[0] / q[1] for q in pools for _ in (0, 1)])


@dataclass
class Classifier:
    vocabulary: np.ndarray
    idf: np.ndarray
    index: Index | None
    knots: tuple[np.ndarray, np.ndarray]

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return np.interp(votes, *self.knots) if len(self.knots[0]) else np.zeros(len(votes))


def _vectorise(vocabulary: np.ndarray, idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, number, weight = vectors(*flat(batch.column("text")), vocabulary, idf)
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for v in (number.astype(np.int64), weight)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], ["doc_id", "label", "terms", "weights"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """docs: doc_id, text; labels: doc_id and the label, rows to learn from only."""
    known = labels.where(f"doc_id is not null and `{label}` is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # bounded, so it may be broadcast
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    none = np.zeros(0, np.uint64)
    if not n or not toxic or toxic == n:
        return Classifier(none, np.zeros(0), None, (np.zeros(1), np.array([1.0 if n and toxic == n else 0.0])))
    a, rows = F.col("toxic").cast("double"), F.col("n").cast("double")
    c = rows - a
    chi2 = n * F.pow(a * (n - toxic - c) - c * (toxic - a), F.lit(2)) / (rows * (n - rows) * toxic * (n - toxic))
    counts = sample.select("text", "label").mapInArrow(_document_counts, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    chosen = (
        counts.where((a >= max(MIN_ROWS, MIN_SHARE * toxic)) & (a * (n - toxic) > c * toxic) & (rows < n))
        .withColumn("chi2", chi2)
        .where(F.col("chi2") >= MIN_CHI2)
        .orderBy(F.desc("chi2"), "term")
        .limit(MAX_TERMS)
        .toPandas()
    )
    keys = chosen["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    vocabulary = keys[order]
    if not len(vocabulary):
        return Classifier(none, np.zeros(0), None, (np.zeros(1), np.array([toxic / n])))
    frequencies = document_frequencies(docs, vocabulary)
    idf = np.log((1 + frequencies[0]) / (1 + frequencies[1:])) + 1
    made = sample.mapInArrow(_vectorise(vocabulary, idf), "doc_id long, label int, terms array<long>, weights array<double>")
    made = made.where(F.size("terms") > 0).toArrow()  # at most sample_rows sparse rows over MAX_TERMS terms
    ids, labels_ = made["doc_id"].to_numpy(), made["label"].to_numpy().astype(float)
    vecs = [(np.array(t, np.int64), np.array(w)) for t, w in zip(made["terms"].to_pylist(), made["weights"].to_pylist(), strict=True)]
    index, dense = build_index(ids, labels_, vecs, len(vocabulary))
    votes = np.zeros(len(vecs))
    for at in range(0, len(vecs), BATCH):  # leave-one-out: a row's nearest but itself
        rows, cosines = index.nearest(dense[at : at + BATCH], NEIGHBOURS + 1)
        own = rows == np.arange(at, at + len(rows))[:, None]
        own[:, -1] |= ~own.any(axis=1)
        keep = ~own
        votes[at : at + len(rows)] = votes_of(index, rows[keep].reshape(len(rows), -1), cosines[keep].reshape(len(rows), -1))
    empty = int(n) - len(vecs)
    without_terms = int(toxic - index.labels.sum())
    x = np.concatenate([votes, np.zeros(empty)])
    y = np.concatenate([index.labels, np.repeat([1.0, 0.0], [without_terms, empty - without_terms])])
    return Classifier(vocabulary, idf, index, isotonic(x, y))


def _score(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = batch.num_rows
            votes = np.zeros(n)
            evidence: list = [[] for _ in range(n)]
            if model.index is not None:
                found = vectors(*flat(batch.column("text")), model.vocabulary, model.idf)
                for texts, queries in dense_queries(*found, len(model.vocabulary)):
                    rows, cosines = model.index.nearest(queries, NEIGHBOURS)
                    votes[texts] = votes_of(model.index, rows, cosines)
                    for d, r, c in zip(texts, rows, cosines, strict=True):
                        evidence[d] = [(int(model.index.ids[x]), float(y)) for x, y in zip(r, c, strict=True) if x >= 0]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))
            pairs = pa.array([[{"doc_id": i, "cosine": c} for i, c in e] for e in evidence], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.calibrated(votes)), pairs], ["doc_id", "held_out", "score", "evidence"])

    return run


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs: doc_id, held_out, text.  score, predicted and the neighbours of every row."""
    df = docs.select("doc_id", "held_out", "text").mapInArrow(_score(model), "doc_id long, held_out boolean, score double, evidence array<struct<doc_id: long, cosine: double>>")
    return df.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, labels.where(~held_out()))
    return score(docs.withColumn("held_out", held_out()), model)
