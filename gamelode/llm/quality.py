"""Quality classifier from weak labels.

Overlapping heuristic labellers vote junk, clean or abstain on each document. Their vote patterns are counted over
all documents; expectation-maximisation on those counts (at most 3**len(LABELLERS) of them) estimates how each
labeller votes on junk and on clean texts. The posteriors label a bounded training sample, on which a linear scorer
over hashed word shapes is fitted; the scorer judges every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

JUNK, CLEAN, ABSTAIN = 0, 1, 2
#: Expected rows of the training sample, hashed features, least words for a vote, score from which a text stays.
TRAIN_ROWS, BUCKETS, LEAST_WORDS, THRESHOLD, SEED = 6000, 1024, 16, 0.5, 5
FUNCTION_WORDS = frozenset(
    b"the of and to in is that for it on was with as are be this by from or at an not have has a "
    b"der die und den von das mit ein eine ist im zu des auf sich nicht es "
    b"le la les des un une et que qui dans par sur pour en du de au il elle "
    b"el los las una por con para se del lo como su al y".split()
)
SYMBOLS = b"#$%&*@=+^~<>{}\\_"
_OTHER = bytes(i for i in range(256) if i not in SYMBOLS)
_NOT_UPPER = bytes(i for i in range(256) if not 65 <= i <= 90)
_LETTERS = bytes(i for i in range(256) if not (65 <= i <= 90 or 97 <= i <= 122))
_SHAPE = bytes(ord("A") if 65 <= i <= 90 else ord("a") if 97 <= i <= 122 or i >= 128 else ord("9") if 48 <= i <= 57 else i for i in range(256))


def measures(text: bytes) -> dict[str, float]:
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = max(1, len(words))
    letters = len(text.translate(None, _LETTERS))
    return {
        "words": len(words),
        "symbols": len(text.translate(None, _OTHER)) / max(1, len(text)),
        "capitals": len(text.translate(None, _NOT_UPPER)) / max(1, letters),
        "bars": text.count(b"|") / n,
        "shouts": text.count(b"!!") / n,
        "repeats": sum(map(eq, words, words[1:])) / n,
        "runs": sum(a == b == c for a, b, c in zip(words, words[1:], words[2:])) / n,
        "distinct": 1 - len(set(words)) / n,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "length": sum(map(len, words)) / n,
        "function": sum(map(FUNCTION_WORDS.__contains__, text.lower().split())) / n,
    }


#: name: (measure, clean up to, junk from); between them the labeller abstains. "function" is the other way round.
LABELLERS = {
    "symbols": ("symbols", 0.005, 0.02),
    "capitals": ("capitals", 0.06, 0.2),
    "bars": ("bars", 0.01, 0.05),
    "shouts": ("shouts", 0.01, 0.05),
    "repeats": ("repeats", 0.04, 0.12),
    "runs": ("runs", 0.02, 0.08),
    "distinct": ("distinct", 0.55, 0.7),
    "lines": ("lines", 0.2, 0.5),
    "length": ("length", 6.0, 7.5),
    "function": ("function", -0.12, -0.04),
}


def votes(text: bytes) -> list[int]:
    m = measures(text)
    if m["words"] < LEAST_WORDS:
        return [ABSTAIN] * len(LABELLERS)
    out = []
    for measure, clean, junk in LABELLERS.values():
        v = -m[measure] if measure == "function" else m[measure]
        out.append(CLEAN if v <= clean else JUNK if v >= junk else ABSTAIN)
    return out


def pattern(text: bytes) -> int:
    return sum(v * 3**i for i, v in enumerate(votes(text)))


def unpacked(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**i % 3 for i in range(len(LABELLERS))], axis=1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of clean for each pattern, table[labeller, class, vote]) by EM. A pattern with a junk vote starts as
    probable junk. Smoothed by one count in all, so an empty input gives even tables."""
    v, c = unpacked(patterns), counts.astype(float)
    clean = np.where((v == JUNK).any(axis=1), 0.2, 0.98)
    table = np.full((len(LABELLERS), 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([(1 - clean) * c, clean * c])
        prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        for j in range(len(LABELLERS)):
            for k in range(3):
                table[j, :, k] = (weight[:, v[:, j] == k].sum(axis=1) + 1 / 3) / (weight.sum(axis=1) + 1)
        logs = np.log(prior)[:, None] + sum(np.log(table[j][:, v[:, j]]) * (v[:, j] != ABSTAIN) for j in range(len(LABELLERS)))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        if len(new) == 0 or np.abs(new - clean).max() < 1e-9:
            break
        clean = new
    return clean, table


@lru_cache(maxsize=1 << 16)
def _bucket(shape: bytes) -> int:
    short = re.sub(rb"(.)\1+", rb"\1\1", shape)  # a run of one class counts as two
    return xxhash.xxh64_intdigest(short, SEED) % BUCKETS


REPEATED, LINE = xxhash.xxh64_intdigest(b"repeated word", SEED) % BUCKETS, xxhash.xxh64_intdigest(b"repeated line", SEED) % BUCKETS


def features(text: bytes) -> dict[int, float]:
    """Bucket -> root of its share of the words: shapes of words, words equal to the last one, repeated lines."""
    words = text.split()
    found: Counter = Counter()
    for shape, n in Counter(text.translate(_SHAPE).split()).items():
        found[_bucket(shape)] += n
    found[REPEATED] += sum(map(eq, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    found[LINE] += len(lines) - len(set(lines))
    n = len(words) + 8  # short texts say little
    return {b: (k / n) ** 0.5 for b, k in found.items() if k}


def fit(rows: list[dict[int, float]], target: np.ndarray, rounds: int = 400, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft targets, both classes of equal total weight; the last number is the constant."""
    x = np.zeros((len(rows), BUCKETS + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, list(r)] = list(r.values())
    x[:, -1] = 1
    w = np.zeros(BUCKETS + 1, np.float32)
    if not len(rows):
        w[-1] = 1  # nothing was learned: every text stays
        return w
    mass = np.array([max((1 - target).sum(), 1e-9), max(target.sum(), 1e-9)])
    if mass.min() < 0.5:
        w[-1] = 1 if mass[1] > mass[0] else -1
        return w
    each = ((1 - target) / mass[0] + target / mass[1]).astype(np.float32) / 2
    speed = np.zeros_like(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        speed = 0.9 * speed + x.T @ ((p - target.astype(np.float32)) * each) + decay * w
        w -= rate * speed * np.float32(0.5)
    return w


def score(text: bytes, w: np.ndarray) -> float:
    """1 for texts without a word; short texts, on which no labeller votes, are scored like others."""
    if not text.split(None, 1):
        return 1.0
    z = float(w[-1]) + sum(float(w[b]) * v for b, v in features(text).items())
    return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of the scorer. Vote patterns are counted over all documents, the scorer is fitted on those whose id's
    hash falls under a bound that lets train_rows of them through on average (twice as many at most)."""

    def vote(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pattern(t) for t in common.byte_texts(b.column(0))], pa.int64())], names=["pattern"])

    counted = common.arrow_map(docs.select(F.col(text)), vote, "pattern long").groupBy("pattern").count().collect()
    patterns, counts = np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], np.int64)
    order = np.argsort(patterns)
    patterns, counts = patterns[order], counts[order]
    clean, _ = estimate(patterns, counts)
    share = min(1.0, train_rows / max(1, counts.sum()))
    some = docs.where(F.xxhash64(F.col(doc_id), F.lit(SEED)).cast("double") <= F.lit((2 * share - 1) * 2.0**63))

    def describe(batches):
        for b in batches:
            texts = common.byte_texts(b.column(0))
            rows = [features(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([pattern(t) for t in texts], pa.int64()), pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.float64()))],
                names=["pattern", "at", "value"],
            )

    sample = common.arrow_map(some.select(F.col(text)), describe, "pattern long, at array<int>, value array<double>").limit(2 * train_rows).collect()
    sample = sorted((r[0], tuple(sorted(zip(r[1], r[2])))) for r in sample)
    target = clean[np.searchsorted(patterns, [r[0] for r in sample])] if sample else np.empty(0)
    return fit([dict(r[1]) for r in sample], target)


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", weights: np.ndarray | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, quality (0 to 1, high for clean text), kept (quality >= THRESHOLD).

    Null, empty and blank texts count as clean (1). Repeated rows get equal scores; an empty
    table gives no rows; where all documents look alike, all stay.
    """
    w = train(docs, text, doc_id, train_rows) if weights is None else weights

    def run(batches):
        for b in batches:
            got = [score(t, w) for t in common.byte_texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64()), pa.array([g >= THRESHOLD for g in got], pa.bool_())], names=["doc_id", "quality", "kept"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return common.arrow_map(docs.select(F.col(doc_id), F.col(text)), run, f"doc_id {kind}, quality double, kept boolean")


def keep_clean(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that the classifier keeps, all columns, without a shuffle."""
    w = train(docs, text, doc_id)
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            keep = [score(t, w) >= THRESHOLD for t in common.byte_texts(b.column(at))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return common.arrow_map(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))
