"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic texts, both on whole texts cut into windows.
Toxic texts are ordinary prose for the most part: their windows that the ordinary dictionary already compresses well
teach nothing, so the toxic dictionary is trained on the others, each distinct window once (a passage copied many times
counts once), and holds the ordinary dictionary too. To score a text every word of it, a window of its own (LONGEST
bytes at most), is compressed with either dictionary; the bytes that the toxic one saves are counted in a few shares of
the text's windows, which a logistic curve turns into a score. The curve and the toxic dictionary's size are calibrated
on labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

#: Labelled texts used, at most: rows of either class in the order of their ids' hashes, as long as their bytes fit.
SAMPLE_TOXIC, SAMPLE_ORDINARY, TOXIC_BYTES, ORDINARY_BYTES = 3000, 6000, 16 << 20, 32 << 20
#: Bytes of the ordinary dictionary, and of the toxic one beside it: calibration chooses among these.
ORDINARY_SIZE, TOXIC_SIZES, THRESHOLD = 1 << 18, (1 << 10, 1 << 11, 1 << 12, 1 << 13, 1 << 14, 1 << 15), 0.7
#: Windows for training have LEARN bytes of whole words or just over, 64 for the ordinary dictionary; the toxic one takes
#: those that cost HARD bytes or more with the ordinary one. In scoring a word under SHORT bytes can't save any.
LEARN, ORDINARY_LEARN, HARD, SHORT, LONGEST = 10, 64, 8, 5, 64
#: A window is compressed between these bytes, which both dictionaries end in: so it never falls under the least size of
#: a block, and its last bytes are searched like the others.
TAIL = np.random.default_rng(3).integers(1, 256, 24, np.uint8).tobytes()
CLOSE = bytes(9) + TAIL  # no match goes on from a content into it, and none has an offset like its own
HEAD = np.random.default_rng(2).integers(1, 256, 64, np.uint8).tobytes()
#: One labelled text in so many calibrates.
CALIBRATES = 3
#: Savings under LEAST bytes count as none, and so do those of a window that costs under COVERED bytes beyond its
#: surroundings with the ordinary dictionary: that one knows it, and it isn't compressed with the other.
LEAST, COVERED = 2, 5
#: Words whose saving a task remembers; when full it starts anew.
MEMO = 1 << 18


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def windows(text: bytes, size: int) -> list[bytes]:
    """The whole text, lower-cased, in windows of whole words, each of at least size bytes but the last."""
    out, part, n = [], [], 0
    for w in text.lower().split():
        part.append(w)
        n += len(w) + 1
        if n >= size:
            out.append(b" " + b" ".join(part) + b" ")
            part, n = [], 0
    if part:
        out.append(b" " + b" ".join(part) + b" ")
    return out


def words(text: bytes) -> list[bytes]:
    """The windows of scoring: lower-cased words, cut after every LONGEST bytes."""
    found = text.lower().split()
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary trained on samples, the best bytes last; the samples' own where they are too few."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        found = zstandard.train_dictionary(size, samples, k=segment, d=8, level=3)
        return found.as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Lengths:
    """Compressed lengths under a dictionary. Matches from four bytes on, by binary trees: short words must find their
    way into the lengths."""

    def __init__(self, content: bytes):
        log = max(12, min(20, len(content).bit_length()))
        how = zstandard.ZstdCompressionParameters(
            window_log=max(14, log + 1), chain_log=log, hash_log=log, search_log=4, min_match=4, strategy=zstandard.STRATEGY_BTLAZY2,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        known = zstandard.ZstdCompressionDict(content + CLOSE + HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=how)
        self.compress = zstandard.ZstdCompressor(compression_params=how, dict_data=known).compress
        self.empty = self.of(b"")

    def of(self, window: bytes) -> int:
        """Bytes of the window, its surroundings included."""
        return len(self.compress(HEAD + window + TAIL))


def saving(plain: int, both: Lengths, empty: int, window: bytes) -> int:
    """Bytes that the toxic dictionary saves of a window that has plain with the ordinary one; 0 for under LEAST, or COVERED."""
    if plain - empty < COVERED:
        return 0
    saved = plain - both.of(window)
    return saved if saved >= LEAST else 0


@lru_cache(maxsize=2)
def _lengths(ordinary: bytes, toxic: bytes) -> tuple[Lengths, Lengths]:
    return Lengths(ordinary), Lengths(ordinary + toxic)


#: A toxic text counts this many times an ordinary one: at score THRESHOLD the odds, as they are in the labels, are even.
FIGURES, TOXIC_WEIGHT = 9, THRESHOLD / (1 - THRESHOLD)


def figures(saved: np.ndarray) -> tuple[float, ...]:
    """Shares of the windows by how many bytes the toxic dictionary saves."""
    if not len(saved):
        return (0.0,) * FIGURES
    share = {k: float((saved >= k).mean()) for k in (2, 3, 4, 5, 6)}
    return (*share.values(), share[3] ** 0.5, share[4] ** 0.5, share[5] ** 0.5, min(float(saved.max()), 9.0))


class Model:
    """The ordinary dictionary's content, what the toxic one has beside it, and the curve."""

    def __init__(self, ordinary: bytes, toxic: bytes, curve: tuple[float, ...]):
        self.ordinary, self.toxic, self.curve, self.memo = ordinary, toxic, curve, {}
        self.plain, self.both = _lengths(ordinary, toxic)

    def __reduce__(self):
        return Model, (self.ordinary, self.toxic, self.curve)

    def saving(self, word: bytes) -> int:
        window = b" " + word + b" "
        return saving(self.plain.of(window), self.both, self.plain.empty, window)

    def savings(self, text: bytes) -> np.ndarray:
        out, memo = [], self.memo
        for w in words(text):
            if len(w) < SHORT:
                out.append(0)
                continue
            if (found := memo.get(w)) is None:
                if len(memo) >= MEMO:
                    memo.clear()
                found = memo[w] = self.saving(w)
            out.append(found)
        return np.array(out, np.int64)

    def score(self, text: bytes) -> float:
        z = self.curve[-1] + sum(a * b for a, b in zip(self.curve, figures(self.savings(text))))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fit_curve(rows: np.ndarray, toxic: np.ndarray, rounds: int = 60, decay: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton's steps on standardised figures; weights for the figures as they are, constant last."""
    n = FIGURES
    if not len(rows) or toxic.min() == toxic.max():
        share = (toxic.sum() + 0.5) / (len(toxic) + 1) if len(toxic) else 0.05
        return (*[0.0] * n, math.log(share / (1 - share)))
    mean, std = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    x = np.column_stack([(rows - mean) / std, np.ones(len(rows))])
    w = np.zeros(n + 1)
    ridge = decay * np.eye(n + 1) * len(rows) / 100
    ridge[-1, -1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - toxic) + ridge @ w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    a = w[:-1] / std
    return (*a.tolist(), float(w[-1] - (a * mean).sum()))


def dictionaries(rows: list[tuple[bytes, int]]) -> tuple[bytes, bytes]:
    """The ordinary dictionary's content, and what the toxic one has beside it, from (text, toxic 0/1)."""
    pieces = lambda y, size: list(dict.fromkeys(w for t, of in rows if of == y for w in windows(t, size)))
    ordinary = trained(pieces(0, ORDINARY_LEARN), ORDINARY_SIZE, 256)
    alone = Lengths(ordinary)
    hard = alone.empty + HARD
    return ordinary, trained([w for w in pieces(1, LEARN) if alone.of(w) >= hard], max(TOXIC_SIZES), 16)


def measured(ordinary: bytes, toxic: bytes, texts: list[bytes]) -> dict[int, list[tuple[float, ...]]]:
    """Size of the toxic dictionary -> the figures of each text."""
    cut = [words(t) for t in texts]
    plain, out = Lengths(ordinary), {}
    lengths = {w: plain.of(b" " + w + b" ") for w in sorted({w for ws in cut for w in ws if len(w) >= SHORT})}
    for size in TOXIC_SIZES:
        both = Lengths(ordinary + toxic[-size:])
        saved = {w: saving(n, both, plain.empty, b" " + w + b" ") for w, n in lengths.items()}
        out[size] = [figures(np.array([saved.get(w, 0) for w in ws])) for ws in cut]
    return out


def fit(texts: list[tuple[bytes, int]], rates: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model from (text, toxic 0/1). Equal texts count once, as toxic if any is. By the texts' hashes one in CALIBRATES
    is kept from the dictionaries; on these the toxic one's size is chosen and the curve is fitted. rates: the shares of
    ordinary and of toxic rows that texts are a sample of."""
    label: dict[bytes, int] = {}
    for t, y in texts:
        label[t] = max(y, label.get(t, 0))
    rows = sorted(label.items())
    kept = [xxhash.xxh64_intdigest(t, 10) % CALIBRATES == 0 for t, _ in rows]
    ordinary, toxic = dictionaries([r for r, k in zip(rows, kept) if not k])
    tested = [r for r, k in zip(rows, kept) if k]
    y = np.array([of for _, of in tested], float)
    best = (math.inf, 0, (0.0,) * (FIGURES + 1))
    for size, found in measured(ordinary, toxic, [t for t, _ in tested]).items():
        x = np.array(found).reshape(-1, FIGURES)
        curve = fit_curve(x, y)
        z = x @ np.array(curve[:-1]) + curve[-1]
        best = min(best, (float(np.logaddexp(0, np.where(y == 1, -z, z)).sum()), size, curve))
    _, size, (*weights, constant) = best
    return Model(ordinary, toxic[-size:], (*weights, constant + math.log(TOXIC_WEIGHT * rates[0] / rates[1])))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model:
    """A model from labels (doc_id, toxic 0/1) of rows that are not held out; null labels and ids don't count, and of an
    id's labels the greatest does. The sample is the same in every run."""
    place = F.xxhash64("__id", F.lit(9))
    marks = labels.where(~held_out(F.col(doc_id)) & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("__toxic"))
    marks = common.saved(marks.withColumn("__place", place))
    some = [marks.where(F.col("__toxic") == y).orderBy("__place", "__id").limit(most) for y, most in ((0, SAMPLE_ORDINARY), (1, SAMPLE_TOXIC))]
    some = common.saved(some[0].unionByName(some[1]))
    rows = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(some), "__id")
    texts = common.saved(rows.select("__toxic", "__place", "__text", F.octet_length("__text").cast("long").alias("__size"), F.xxhash64("__text").alias("__hash")))
    order = ["__place", "__size", "__hash"]
    sizes = sorted(tuple(r) for r in texts.groupBy("__toxic", *order).count().select("__toxic", *order).collect())
    fits, left = [], {0: ORDINARY_BYTES, 1: TOXIC_BYTES}
    for y, *key in sizes:  # a text that doesn't fit is left out whole
        if key[1] <= left[y]:
            left[y] -= key[1]
            fits.append((y, *key))
    chosen = docs.sparkSession.createDataFrame(fits, "__toxic int, __place long, __size long, __hash long")
    found = texts.join(F.broadcast(chosen), ["__toxic", *order], "left_semi").select("__text", "__toxic").distinct().collect()
    of = Counter({r[0]: r[1] for r in marks.groupBy("__toxic").count().collect()})
    used = Counter({r[0]: r[1] for r in some.groupBy("__toxic").count().collect()})
    return fit([(r[0].encode(), r[1]) for r in found], tuple(used[y] / of[y] if of[y] else 1.0 for y in (0, 1)))


def judge(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on).

    Null and empty texts get the score of a text without windows; repeated rows get equal scores; a null id is never
    held out; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                got = [model.score(t) for t in common.byte_texts(b.column(2))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64()), pa.array([int(g >= THRESHOLD) for g in got], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id), F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out"), F.col(text))
    return common.arrow_map(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return judge(docs, train(docs, common.table(spark, sf_dir, "labels")))
