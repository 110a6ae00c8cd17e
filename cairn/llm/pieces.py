"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A text gets a leading space, spaces become U+2581, and the pieces of a BPE model are merged by
agenda: the best-scoring adjacent pair first, the leftmost of equals.  With dropout each candidate
taken from the agenda is skipped if a hash keyed by seed, doc_id and the word's number in its text
falls under the rate, so equal words are cut each on its own, a text has one segmentation per seed
and id, on any machine, and other seeds give others; rate 0 gives the model's own segmentation.  Characters that the model lacks become its byte pieces, and so does a U+2581 of
the text itself, so that decoding always gives the text back.

No piece has U+2581 after another character or a line end beside one, so texts are cut there into
words; words of equal length are segmented together, one agenda step of all of them at a time.
The distinct words of a slice go through it once without dropout.  An occurrence none of whose
merges on that way is skipped has the same ids; the others go through the agenda on their own.

Defined results: a null or empty text has no ids and decodes to an empty text; repeated rows get equal
ids; without a doc_id the text stands for it; columns beyond those named are not read.  The model is
read from a path; it is never trained or copied.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, mix, slices, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 20_240_229
#: Share of candidate merges that are skipped.
DROPOUT = 0.1
SLICE = 2 << 20
#: Longer words, in characters, have an agenda of their own.
SHORT = 28

_MASK = (1 << 64) - 1
_A, _B, _C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_SPACE = "▁"
_NONE = np.int32(1 << 30)


def _mix(h: int) -> int:
    """mix() of one number."""
    h ^= h >> 32
    h = h * 0x9E3779B97F4A7C15 & _MASK
    h ^= h >> 29
    h = h * 0xBF58476D1CE4E5B9 & _MASK
    return h ^ (h >> 32)


class Pieces:
    """A SentencePiece BPE model's pieces and the pairs that merge."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = model.get_piece_size()
        self.bytes = [0] * 256
        self.raw: list[bytes] = [b""] * n  # what a piece stands for
        self.ids: dict[str, int] = {}
        scores = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                self.raw[i] = bytes([int(piece[3:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.raw[i] = piece.replace(_SPACE, " ").encode()
                scores[piece] = -model.get_score(i)
        wrong = next((p for p in self.ids if _SPACE in p.lstrip(_SPACE) or ("\n" in p and p != "\n")), None)
        if wrong is not None:
            raise ValueError(f"pieces such as {wrong!r} go over the places where texts are cut into words")
        places = {s: k for k, s in enumerate(sorted(set(scores.values())))}
        self.rank = {p: places[s] for p, s in scores.items()}

        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in self.raw])])
        # symbols of single characters: pieces, byte pieces of ASCII without one, -1 for the rest
        self.single = np.full(1 << 16, -1, np.int32)
        self.single[:128] = self.bytes[:128]
        for p, i in self.ids.items():
            if len(p) == 1 and ord(p) < 1 << 16:
                self.single[ord(p)] = i
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = (i, self.rank[p])
        self._table(np.array(sorted(pairs), np.int64), pairs)

    def _table(self, keys: np.ndarray, pairs: dict[int, tuple[int, int]]) -> None:
        """The pairs by displaced rows: those of left symbol a lie at shift[a] + right symbol, and slot_left says whose a place is."""
        left, right = (keys >> 20).astype(np.int32), (keys & ((1 << 20) - 1)).astype(np.int32)
        size = 1 << max(18, int(4 * len(keys)).bit_length())
        self.shift = np.zeros(self.size, np.int32)
        self.slot_left = np.full(size + self.size, -1, np.int32)
        rng = np.random.default_rng(0)
        names, first, count = np.unique(left, return_index=True, return_counts=True)
        large = np.argsort(-count, kind="stable")
        todo = np.zeros(len(keys), bool)
        for r in large[count[large] > 16]:  # first those that fit hardly anywhere
            own = right[first[r] : first[r] + count[r]]
            while True:
                at = int(rng.integers(size))
                if (self.slot_left[at + own] < 0).all():
                    break
            self.shift[names[r]], self.slot_left[at + own] = at, names[r]
        todo[np.repeat(count <= 16, count)] = True
        while todo.any():  # the rest all at once: a row stays if all its places are free and no other row's
            mine = np.flatnonzero(todo)
            rows = np.unique(left[mine])
            self.shift[rows] = rng.integers(size, size=len(rows))
            at = self.shift[left[mine]] + right[mine]
            _, place, hits = np.unique(at, return_inverse=True, return_counts=True)
            bad = np.unique(left[mine[(self.slot_left[at] >= 0) | (hits[place] > 1)]])
            good = ~np.isin(left[mine], bad)
            self.slot_left[at[good]] = left[mine[good]]
            todo[mine[good]] = False
        at = self.shift[left] + right
        self.slot_id, self.slot_rank = np.zeros(len(self.slot_left), np.int32), np.zeros(len(self.slot_left), np.int32)
        self.slot_id[at], self.slot_rank[at] = ([pairs[int(k)][j] for k in keys] for j in (0, 1))

    # --- one word ---------------------------------------------------------------------------

    def segment(self, word: str, threshold: int = 0, h: int = 0, trace: list[int] | None = None) -> list[int]:
        """Ids of a word (spaces as U+2581) under dropout threshold / 2**64 and the word's keyed hash h; trace gets its merges."""
        n = len(word)
        get = self.rank.get
        end = list(range(1, n + 1))  # of the symbol that starts here; 0 if none does
        left = list(range(-1, n - 1))  # start of the symbol before
        agenda = [(r, k, k + 1, k + 2) for k in range(n - 1) if (r := get(word[k : k + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, c = heapq.heappop(agenda)
            if end[a] != b or b >= n or end[b] != c:
                continue
            merge = a * _A + b * _B + c * _C & _MASK
            if threshold and _mix(h ^ merge) < threshold:
                continue
            if trace is not None:
                trace.append(merge)
            end[a], end[b] = c, 0
            if c < n:
                left[c] = a
                if (r := get(word[a : end[c]])) is not None:
                    heapq.heappush(agenda, (r, a, c, end[c]))
            if a:
                p = left[a]
                if (r := get(word[p:c])) is not None:
                    heapq.heappush(agenda, (r, p, a, c))
        out = []
        for a in range(n):
            if end[a]:
                i = self.ids.get(word[a : end[a]])
                out += [i] if i is not None else [self.bytes[x] for x in word[a : end[a]].encode()]
        return out

    # --- many words -------------------------------------------------------------------------

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, rank) of each pair of symbols; rank _NONE if it doesn't merge."""
        at = self.shift[a] + b
        found = self.slot_left[at] == a
        return self.slot_id[at], np.where(found, self.slot_rank[at], _NONE)

    def _equal_length(self, symbols: np.ndarray, h: np.ndarray, threshold: int, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (words, n) of words of n characters, n > 1.  (all symbols after all merges, word by word; number of them in each); trace gets (words, merges).

        A symbol lies at the place of its first character, and places are linked, so a merge touches a few
        numbers of a word; the pair that starts at a place has its rank there.
        """
        words, n = symbols.shape
        out, left_out = symbols.copy(), np.ones((words, n), bool)
        who = np.arange(words)
        sym = symbols.astype(np.int32)
        piece, rank = np.zeros((words, n), np.int32), np.full((words, n), _NONE)
        piece[:, :-1], rank[:, :-1] = (x.reshape(words, n - 1) for x in self._pairs(sym[:, :-1].ravel(), sym[:, 1:].ravel()))
        after = np.broadcast_to(np.arange(1, n + 1), (words, n)).copy()
        before = np.broadcast_to(np.arange(-1, n - 1), (words, n)).copy()
        there = np.ones((words, n), bool)
        while True:
            k = rank.argmin(axis=1)
            base = np.arange(0, len(who) * n, n)
            at = base + k
            live = np.flatnonzero(rank.ravel()[at] != _NONE)
            if 4 * len(live) < 3 * len(who):  # words that are done leave when they are many
                done = np.ones(len(who), bool)
                done[live] = False
                out[who[done]], left_out[who[done]] = sym[done], there[done]
                if not len(live):
                    break
                who, sym, piece, rank, after, before, there = (x[live] for x in (who, sym, piece, rank, after, before, there))
                k, base, live = k[live], np.arange(0, len(live) * n, n), np.arange(len(live))
                at = base + k
            else:
                k, base, at = k[live], base[live], at[live]
            b = after.ravel()[at]
            c = after.ravel()[base + b]
            if threshold or trace is not None:
                merge = k.astype(np.uint64) * np.uint64(_A) + b.astype(np.uint64) * np.uint64(_B) + c.astype(np.uint64) * np.uint64(_C)
            if trace is not None:
                trace.append((who[live], merge))
            if threshold:
                skip = mix(h[who[live]] ^ merge) < np.uint64(threshold)
                rank.ravel()[at[skip]] = _NONE
                on = ~skip
                k, base, at, b, c = k[on], base[on], at[on], b[on], c[on]
            sym.ravel()[at] = piece.ravel()[at]
            there.ravel()[base + b] = False
            rank.ravel()[base + b] = _NONE
            rank.ravel()[at] = _NONE
            after.ravel()[at] = c
            right = np.flatnonzero(c < n)
            before.ravel()[(base + c)[right]] = k[right]
            left = np.flatnonzero(k > 0)
            ahead = (base + before.ravel()[at])[left]
            where = np.concatenate([at[right], ahead])
            piece.ravel()[where], rank.ravel()[where] = self._pairs(sym.ravel()[where], sym.ravel()[np.concatenate([(base + c)[right], at[left]])])
        return out[left_out], left_out.sum(axis=1)

    def segment_all(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, threshold: int, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the words b[start:end], which are UTF-8; trace (without dropout only) gets (words, merges)."""
        size = ends - starts
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        own = b[at]
        code = np.frombuffer(own.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])  # characters before each byte
        edges = first[np.concatenate([[0], np.cumsum(size)])]
        # a U+2581 of the text has no symbol of its own; then spaces become U+2581
        symbol = np.where(code == 0x2581, np.int32(-1), self.single[np.where(code < 1 << 16, code, 0xFFFF)])
        symbol[code == 32] = self.ids[_SPACE]
        length = np.diff(edges)
        unknown = np.concatenate([[0], np.cumsum(symbol < 0)])
        slow = (length > SHORT) | (unknown[edges[1:]] > unknown[edges[:-1]])
        values: list[np.ndarray] = []
        counts = np.zeros(len(starts), np.int64)
        owner: list[np.ndarray] = []
        for n in np.unique(length[~slow]):
            which = np.flatnonzero(~slow & (length == n))
            got = symbol[edges[which][:, None] + np.arange(n)]
            sizes = np.ones(len(which), np.int64)
            if n > 1:
                own_trace = None if trace is None else []
                got, sizes = self._equal_length(got, h[which], threshold, own_trace)
                if trace is not None:
                    trace += [(which[w], merge) for w, merge in own_trace]
            values.append(got.ravel())
            owner.append(which)
            counts[which] = sizes
        for w in np.flatnonzero(slow):
            text = own_text(code[edges[w] : edges[w + 1]])
            ids: list[int] = []
            merges: list[int] | None = None if trace is None else []
            for k, part in enumerate(text.split(_SPACE)):
                if k:
                    ids += [self.bytes[x] for x in _SPACE.encode()]
                ids += self.segment(part.replace(" ", _SPACE), threshold, int(h[w]), merges)
            if merges:
                trace.append((np.full(len(merges), w), np.array(merges, np.uint64)))
            values.append(np.array(ids, np.int32))
            owner.append(np.array([w]))
            counts[w] = len(ids)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(bounds[-1], np.int32)
        if owner:
            order = np.concatenate(owner)
            c = counts[order]
            out[np.repeat(bounds[order] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())] = np.concatenate(values)
        return out, bounds

    def encode_all(self, b: np.ndarray, o: np.ndarray, keys: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of texts; keys: of seed and id of each text."""
        full = np.diff(o) > 0
        shift = np.concatenate([[0], np.cumsum(full)])
        texts = np.full(len(b) + shift[-1], 32, np.uint8)  # a space before each text
        texts[np.arange(len(b)) + np.repeat(shift[1:], np.diff(o))] = b
        bounds = o + shift
        line, space = texts == 10, texts == 32
        cut = line.copy()
        cut[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        cut[bounds[:-1][full]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(texts)) if len(starts) else starts
        first = np.searchsorted(starts, bounds)
        _, at, place = np.unique(span_hashes(texts, starts, ends), return_index=True, return_inverse=True)
        trace: list | None = [] if threshold else None
        ids, edges = self.segment_all(texts, starts[at], ends[at], np.zeros(len(at), np.uint64), 0, trace)
        from_, count = edges[:-1][place], np.diff(edges)[place]
        if trace:
            number = (np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
            h = mix(mix(np.repeat(keys, np.diff(first))) + number * np.uint64(_A))
            again = np.flatnonzero(_any_skipped(trace, len(at), place, h, threshold))
            more, bounds = self.segment_all(texts, starts[again], ends[again], h[again], threshold)
            from_[again], count[again] = len(ids) + bounds[:-1], np.diff(bounds)
            ids = np.concatenate([ids, more])
        total = np.concatenate([[0], np.cumsum(count)])
        out = ids[np.repeat(from_ - total[:-1], count) + np.arange(total[-1])]
        return out, total[first]

    def encode(self, text: str, threshold: int = 0, key: int = 0) -> list[int]:
        b, o = flat(pa.array([text], pa.string()))
        return self.encode_all(b, o, np.array([key], np.uint64), threshold)[0].tolist()

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of ids[bounds[i]:bounds[i + 1]]; control pieces stand for nothing."""
        size = (self.raw_at[1:] - self.raw_at[:-1])[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.raw_bytes[np.repeat(self.raw_at[ids] - total[:-1], size) + np.arange(total[-1])]
        o = total[bounds]
        led = np.zeros(len(o) - 1, bool)
        some = np.flatnonzero(np.diff(o) > 0)
        led[some] = out[o[some]] == 32
        keep = np.ones(len(out), bool)
        keep[o[:-1][led]] = False  # the leading space
        return out[keep], o - np.concatenate([[0], np.cumsum(led)])

    def decode(self, ids: list[int]) -> str:
        out, _ = self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))
        return out.tobytes().decode("utf-8", "replace")


def _any_skipped(trace: list[tuple[np.ndarray, np.ndarray]], n: int, place: np.ndarray, h: np.ndarray, threshold: int) -> np.ndarray:
    """Whether dropout skips one of the merges of each occurrence; trace: (words, merges) of n distinct words, place: an occurrence's word."""
    word, merge = (np.concatenate(x) for x in zip(*trace, strict=True))
    merge = merge[np.argsort(word, kind="stable")]
    size = np.bincount(word, minlength=n)
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    count = size[place]
    total = np.concatenate([[0], np.cumsum(count)])
    skip = mix(np.repeat(h, count) ^ merge[np.repeat(at[place] - total[:-1], count) + np.arange(total[-1])]) < np.uint64(threshold)
    skips = np.concatenate([[0], np.cumsum(skip)])
    return skips[total[1:]] > skips[total[:-1]]


def own_text(code: np.ndarray) -> str:
    return code.tobytes().decode("utf-32-le", "surrogatepass")


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def threshold_of(dropout: float) -> int:
    return min(int(dropout * 2.0**64), _MASK)


def _encode(model: str, dropout: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, threshold = _pieces(model), threshold_of(dropout)
        for part in slices(batches, limit=SLICE):
            b, o = flat(part.column("text"))
            ids, bounds = pieces.encode_all(b, o, part.column("_key").to_numpy().view(np.uint64), threshold)
            back, at = pieces.decode_all(ids, bounds)
            whole = np.diff(at) == np.diff(o)
            if len(back) == len(b):
                wrong = np.concatenate([[0], np.cumsum(back != b)])
                whole &= wrong[o[1:]] == wrong[o[:-1]]
            else:
                whole &= np.array([np.array_equal(back[at[i] : at[i + 1]], b[o[i] : o[i + 1]]) for i in range(part.num_rows)])
            names = part.schema.names
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists, pa.array(whole)], [*names, "ids", "lossless"])

    return run


def encode(docs: DataFrame, *keep: str, model: str = MODEL, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """keep columns, text, ids and lossless (whether the ids decode to the text) of every row; doc_id keys the dropout."""
    doc_id = F.col("doc_id").cast("long")
    key = F.when(doc_id.isNull(), F.xxhash64(F.lit(seed), F.coalesce(F.col("text"), F.lit("")))).otherwise(F.xxhash64(F.lit(seed), doc_id))
    df = docs.select(*keep, "text", key.alias("_key"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "ids array<int>", "lossless boolean"])
    return df.mapInArrow(_encode(model, dropout), schema).drop("_key")


def decode(rows: DataFrame, *keep: str, model: str = MODEL) -> DataFrame:
    """keep columns and the text of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column("ids").fill_null([]) if part.column("ids").null_count else part.column("ids")
                values, bounds = lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                out, o = pieces.decode_all(values, bounds)
                texts = [out[o[i] : o[i + 1]].tobytes().decode("utf-8", "replace") for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(texts, pa.string())], [*keep, "text"])

    df = rows.select(*keep, "ids")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep), "text string"])
    return df.mapInArrow(run, schema)


def digest(docs: DataFrame, *, model: str = MODEL, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    out = encode(docs, "doc_id", model=model, seed=seed, dropout=dropout)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "ids", "lossless")
