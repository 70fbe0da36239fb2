"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The agenda of a chunk holds its adjacent pairs that merge to a piece; the best piece (leftmost on a tie) is popped.
A popped candidate is skipped for good when a keyed hash of (seed, the document's id, the chunk's place, the span) falls
under the dropout rate, so that every segmentation is a function of the seed and recomputing a lost partition gives the
same ids. Merges never cross the start of a word or a line feed, for no piece does, so chunks are encoded on their own,
many at a time in NumPy. Equal chunks of a batch are encoded once without dropout; an occurrence that skips none of the
candidates popped there has these pieces, and only the others are encoded one by one.
"""

from __future__ import annotations

import heapq
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

DROPOUT, SEED, TOKENIZER = 0.1, 17, "piece_bpe_32k.model"
SPACE, NONE = "▁", np.int32(2**31 - 1)
CHUNKS = re.compile(r" *[^ \n]+|\n| +")
#: Chunks up to this many characters are encoded side by side, the others one at a time on a heap.
WIDEST = 48
#: Spans that are held against the dropout rate at a time; symbols that are merged side by side; bytes of texts encoded at a time.
SPANS, SYMBOLS, SLICE = 1 << 17, 1 << 17, 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Pieces:
    """Vocabulary, merge table and byte pieces of a SentencePiece BPE model."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte0 = next(i for i in range(n) if sp.is_byte(i))
        normal = {p: i for i, p in enumerate(self.pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        order = np.argsort(np.argsort([-sp.get_score(i) for i in range(n)], kind="stable"), kind="stable")
        self.rank = order.astype(np.int32)
        self.by_rank = np.argsort(self.rank).astype(np.int32)
        merges = {}
        for p, i in normal.items():
            for cut in range(1, len(p)):
                if (a := normal.get(p[:cut])) is not None and (b := normal.get(p[cut:])) is not None:
                    merges[a * n + b] = i
        self.n, self.merges = n, merges
        # an open-addressed table of the merges: pair -> rank of what it makes
        self.bits = max(4, (4 * len(merges)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        self.probes = 1
        for k, i in merges.items():
            at = self._home(np.array([k]))[0]
            step = 0
            while self.keys[at] != -1:
                at, step = (at + 1) & ((1 << self.bits) - 1), step + 1
            self.keys[at], self.vals[at] = k, self.rank[i]
            self.probes = max(self.probes, step + 1)
        self.symbol = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]
        self.symbol[ord(SPACE)] = -1  # in a text the mark itself goes by its bytes, else it would come back as a space
        self.as_bytes = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for i in range(n):
            if sp.is_byte(i):
                self.as_bytes[i] = bytes([i - self.byte0])
            elif sp.is_control(i) or sp.is_unknown(i):
                self.as_bytes[i] = b""

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece each pair makes, NONE where it makes none. Symbols below 0 merge with nothing."""
        out = np.full(len(left), NONE, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.astype(np.int64) * self.n + right
        at = self._home(keys)
        for _ in range(self.probes):
            here = self.keys[at[open_]]
            hit = here == keys[open_]
            out[open_[hit]] = self.vals[at[open_[hit]]]
            open_ = open_[~hit & (here != -1)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def decode(self, ids) -> str:
        """The text that encode was given: the leading space that it added goes again."""
        return b"".join(map(self.as_bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


def shipped(spark: SparkSession, model: str) -> str:
    """The name under which executors find the driver's model file."""
    spark.sparkContext.addFile(model)
    return os.path.basename(model)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _skipped(key, start, end, rate: float):
    """Keyed hash of a candidate's span against the dropout rate; for arrays and for single numbers."""
    with np.errstate(over="ignore"):
        h = _mix(np.asarray(key, np.uint64) + np.asarray(start, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(end, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (h >> np.uint64(11)).astype(np.float64) < rate * 2.0**53


def encode_one(p: Pieces, symbols: list[int], key: int, rate: float) -> list[tuple[int, int, int]]:
    """(piece or -1, start, end) of one chunk, by agenda on a heap: for chunks of any length."""
    n = len(symbols)
    left, right, sym, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(symbols), list(range(1, n + 1))
    heap: list = []

    def push(i: int) -> None:
        j = right[i]
        if j < n and sym[i] >= 0 and sym[j] >= 0 and (made := p.merges.get(sym[i] * p.n + sym[j])) is not None:
            heapq.heappush(heap, (int(p.rank[made]), i, j, end[j], made, sym[i], sym[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, j, e, made, a, b = heapq.heappop(heap)
        if sym[i] != a or right[i] != j or sym[j] != b or end[j] != e:
            continue
        if rate and _skipped(key, i, e, rate):
            continue
        sym[i], sym[j], end[i], right[i] = made, -2, e, right[j]
        if right[j] < n:
            left[right[j]] = i
        if left[i] >= 0:
            push(left[i])
        push(i)
    out, i = [], 0
    while i < n:
        out.append((sym[i], i, end[i]))
        i = right[i]
    return out


def encode_many(p: Pieces, symbols: np.ndarray, keys: np.ndarray, rate: float, popped: list | None = None) -> np.ndarray:
    """Agenda processing of chunks side by side; symbols[place, chunk], padded with -3. What merged away becomes -2.
    The merges' (chunks, starts, ends) are added to popped.

    An agenda's entry is rank * 64 + place, so one minimum over the places pops the best candidate, leftmost on a tie.
    """
    w, m = symbols.shape
    out = symbols.copy()
    if w == 1:
        return out
    sym, who, width = symbols, np.arange(m), (symbols != -3).sum(axis=0)
    places = np.arange(w)[:, None]
    nxt = np.repeat(places + 1, m, axis=1)  # the next symbol that is left; w: none
    prv = nxt - 2
    agenda = np.full((w, m), NONE, np.int32)
    made = p.ranks(sym[:-1].ravel(), sym[1:].ravel()).reshape(w - 1, m)
    agenda[:-1] = np.where(made == NONE, NONE, made * 64 + places[:-1])
    while len(who):
        top = agenda.min(axis=0)
        go = top != NONE
        n = np.count_nonzero(go)
        if n < 0.8 * len(who):  # chunks that are done leave
            done = ~go
            out[:, who[done]] = sym[:, done]
            sym, agenda, nxt, prv, who, keys, width, top = sym[:, go], agenda[:, go], nxt[:, go], prv[:, go], who[go], keys[go], width[go], top[go]
            r = np.arange(len(who))
        else:
            r = np.flatnonzero(go)
            top = top[r]
        if not len(r):
            continue
        at = top & 63
        mid = nxt[at, r]
        if popped is not None:
            popped.append((who[r], at, np.minimum(nxt[mid, r], width[r])))
        if rate:
            end = np.minimum(nxt[mid, r], width[r])
            skip = _skipped(keys[r], at, end, rate)
            agenda[at[skip], r[skip]] = NONE
            keep = ~skip
            r, at, mid, top = r[keep], at[keep], mid[keep], top[keep]
        piece = p.by_rank[top >> 6]
        sym[at, r], sym[mid, r] = piece, -2
        after, before = nxt[mid, r], prv[at, r]
        nxt[at, r] = after
        agenda[mid, r] = NONE
        inside, has = after < w, before >= 0
        prv[after[inside], r[inside]] = at[inside]
        follow = np.where(inside, sym[np.minimum(after, w - 1), r], -3)
        rb, bb = r[has], before[has]
        made = p.ranks(np.concatenate([piece, sym[bb, rb]]), np.concatenate([follow, piece[has]]))
        spot = np.concatenate([at, bb])
        agenda[spot, np.concatenate([r, rb])] = np.where(made == NONE, NONE, made * 64 + spot)
    return out


def _flat(p: Pieces, sym: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of rows of symbols in row order, and how many each row has; unknown characters become their bytes."""
    keep = sym > -2
    ids, chars = sym[keep], points[keep]
    count = np.ones(len(ids), np.int64)
    odd = np.flatnonzero(ids == -1)
    if len(odd):
        raw = [chr(c).encode() for c in chars[odd].tolist()]
        count[odd] = [len(x) for x in raw]
        out = np.repeat(ids, count)
        starts = np.cumsum(count) - count
        for at, x in zip(starts[odd].tolist(), raw):
            out[at : at + len(x)] = np.frombuffer(x, np.uint8).astype(np.int32) + p.byte0
        ids = out
    per = np.zeros(keep.shape, np.int64)
    per[keep] = count
    return ids, per.sum(axis=1)


def encode_chunks(p: Pieces, chunks: list[str], keys: np.ndarray, rate: float, popped: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all chunks (none empty) in order, and each chunk's number of ids. The merges' (chunks, starts, ends)
    of chunks up to WIDEST are added to popped."""
    lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
    points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.int64)
    starts = np.cumsum(lens) - lens
    counts, found = np.zeros(len(chunks), np.int64), []
    lower = 0
    for width in (1, 4, 7, 9, 11, 14, 20, 32, WIDEST):
        who = np.flatnonzero((lens > lower) & (lens <= width))
        lower = width
        for part in range(0, len(who), SYMBOLS // width):
            rows = who[part : part + SYMBOLS // width]
            cols = np.arange(width)
            inside = cols < lens[rows][:, None]
            pts = points[np.minimum(starts[rows][:, None] + cols, len(points) - 1)]
            sym = np.where(inside, p.symbol[pts], -3).astype(np.int32)
            merged: list | None = None if popped is None else []
            ids, per = _flat(p, encode_many(p, np.ascontiguousarray(sym.T), keys[rows], rate, merged).T, pts)
            if merged:
                popped += [(rows[w], s, e) for w, s, e in merged]
            counts[rows] = per
            found.append((rows, ids, per))
    for i in np.flatnonzero(lens > WIDEST).tolist():
        pts = points[starts[i] : starts[i] + lens[i]]
        ids: list[int] = []
        for s, a, _ in encode_one(p, p.symbol[pts].tolist(), int(keys[i]), rate):
            ids += [s] if s >= 0 else [p.byte0 + x for x in chr(pts[a]).encode()]
        counts[i] = len(ids)
        found.append((np.array([i]), np.array(ids, np.int32), np.array([len(ids)])))
    out, at = np.empty(counts.sum(), np.int32), np.cumsum(counts) - counts
    for rows, ids, per in found:
        out[np.repeat(at[rows] - (np.cumsum(per) - per), per) + np.arange(len(ids))] = ids
    return out, counts


def chunk_keys(ids: list, per_text: np.ndarray, seed: int) -> np.ndarray:
    """A keyed 64-bit hash of each chunk's document id and place."""
    doc = np.fromiter((xxhash.xxh64_intdigest(repr(i), seed) for i in ids), np.uint64, len(ids))
    place = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    with np.errstate(over="ignore"):
        return _mix(np.repeat(doc, per_text) + _mix(place.astype(np.uint64) + np.uint64(1)))


def encode_batch(p: Pieces, texts: list[str], ids: list, rate: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Flat piece ids of the texts, and how many each has. A text's dropout is keyed by its id in ids."""
    chunks, per_text = [], []
    for t in texts:
        found = CHUNKS.findall(" " + t) if t else []
        chunks += found
        per_text.append(len(found))
    if not chunks:
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    per_text = np.array(per_text)
    coded = pa.array(chunks, pa.string()).dictionary_encode()
    words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    popped: list = []
    flat, counts = encode_chunks(p, words, np.zeros(len(words), np.uint64), 0.0, popped if rate else None)
    begin = np.cumsum(counts) - counts
    first, n = begin[index], counts[index]
    if rate:
        keys = chunk_keys(ids, per_text, seed)
        word, start, end = (np.concatenate([x[i] for x in popped] or [np.empty(0, np.int64)]) for i in range(3))
        order = np.argsort(word, kind="stable")
        start, end = start[order], end[order]
        spans = np.bincount(word, minlength=len(words))
        at = np.cumsum(spans) - spans
        long = np.fromiter((len(w) > WIDEST for w in words), bool, len(words))
        varied, size = [flat], len(flat)
        many = np.cumsum(spans[index])
        edges = [0, *(np.searchsorted(many, np.arange(SPANS, many[-1], SPANS)) + 1).tolist(), len(index)]
        for lo, hi in zip(edges, edges[1:]):
            w, key = index[lo:hi], keys[lo:hi]
            k = spans[w]
            who = np.repeat(np.arange(len(w)), k)
            span = at[w][who] + np.arange(len(who)) - np.repeat(np.cumsum(k) - k, k)
            drops = long[w]
            drops[who[_skipped(key[who], start[span], end[span], rate)]] = True
            drops = np.flatnonzero(drops)
            if len(drops):
                got, n_got = encode_chunks(p, [words[i] for i in w[drops].tolist()], key[drops], rate)
                first[lo + drops], n[lo + drops] = size + np.cumsum(n_got) - n_got, n_got
                varied.append(got)
                size += len(got)
        flat = np.concatenate(varied)
    out = flat[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    return out, np.add.reduceat(np.append(n, 0), np.cumsum(per_text) - per_text) * (per_text > 0)


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: str | None = None, rate: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, pieces (array of int), n_pieces, lossless (whether decoding the pieces gives the text again).

    Null and empty texts have no pieces; decoding gives the empty text. Repeated rows give equal rows. model is the
    path, on the driver, of a SentencePiece BPE model with byte pieces.
    """
    model = shipped(docs.sparkSession, model or default_model())

    def run(batches):
        p = pieces(SparkFiles.get(model))
        for batch in batches:
            for part in common.slices(batch, 1, SLICE):
                texts = part.column(1).fill_null("").to_pylist()
                flat, n = encode_batch(p, texts, part.column(0).to_pylist(), rate, seed)
                ids, ends = flat.tolist(), np.cumsum(n).tolist()
                same = [p.decode(ids[e - k : e]) == t for t, e, k in zip(texts, ends, n.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), common.ragged(flat, n, pa.int32()), pa.array(n), pa.array(same)], names=["doc_id", "pieces", "n_pieces", "lossless"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return common.arrow_map(docs.select(F.col(doc_id), F.col(text)), run, f"doc_id {kind}, pieces array<int>, n_pieces long, lossless boolean")


def decode(encoded: DataFrame, pieces_column: str = "pieces", doc_id: str = "doc_id", model: str | None = None) -> DataFrame:
    """doc_id and text of encode's rows; null pieces give an empty text."""
    model = shipped(encoded.sparkSession, model or default_model())

    def run(batches):
        p = pieces(SparkFiles.get(model))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    kind = encoded.schema[doc_id].dataType.simpleString()
    return common.arrow_map(encoded.select(F.col(doc_id), F.col(pieces_column)), run, f"doc_id {kind}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"))
