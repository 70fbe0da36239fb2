"""op5: short texts."""

import math
import re
from collections import Counter

import numpy as np
import xxhash

from gamelode.llm import quality


def test_short_junk_is_scored(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    w = quality.train(d)
    assert quality.score(b"heitieau | enenst. | Schkeittz | ### |", w) < quality.THRESHOLD
    assert quality.score(b"", w) == quality.score(b" \n", w) == 1


def test_estimate_against_em_over_single_documents(spark):
    """Labellers' accuracies and posteriors by EM over rows, not over counted patterns; and the counts over all rows."""
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    votes = np.array([quality.votes((t or "").encode()) for t in rows])
    kinds = Counter(quality.pattern((t or "").encode()) for t in rows)
    patterns = np.array(sorted(kinds))
    clean, table = quality.estimate(patterns, np.array([kinds[p] for p in patterns.tolist()]))
    p = [0.2 if (v == quality.JUNK).any() else 0.98 for v in votes]
    n = len(quality.LABELLERS)
    for _ in range(100):
        sides = [[1 - x for x in p], p]
        prior = [(sum(s) + 1) / (len(p) + 2) for s in sides]
        say = [[[(sum(w for w, v in zip(s, votes) if v[j] == k) + 1 / 3) / (sum(s) + 1) for k in range(3)] for s in sides] for j in range(n)]
        new = []
        for v in votes:
            like = [prior[c] * math.prod(say[j][c][v[j]] for j in range(n) if v[j] != quality.ABSTAIN) for c in (0, 1)]
            new.append(like[1] / (like[0] + like[1]))
        done = max(abs(a - b) for a, b in zip(new, p)) < 1e-9
        if done:
            break
        p = new
    of = dict(zip(patterns.tolist(), clean))
    assert max(abs(of[quality.pattern((t or "").encode())] - x) for t, x in zip(rows, p)) < 1e-6
    assert np.abs(table - np.array(say)).max() < 1e-6


def test_scores_of_whole_texts_against_plain_counting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    w = quality.train(docs)
    for r in quality.judge(docs, weights=w).join(docs, "doc_id").limit(40).collect():
        words = r.text.encode().split()
        shapes = Counter(re.sub(rb"(.)\1+", rb"\1\1", x.translate(quality._SHAPE)) for x in words)
        value = np.zeros(quality.BUCKETS)
        for shape, n in shapes.items():
            value[xxhash.xxh64_intdigest(shape, quality.SEED) % quality.BUCKETS] += n
        value[quality.REPEATED] += sum(a == b for a, b in zip(words, words[1:]))
        lines = [x for x in r.text.encode().split(b"\n") if x.strip()]
        value[quality.LINE] += len(lines) - len(set(lines))
        z = float(w[-1] + (w[:-1] * np.sqrt(value / (len(words) + 8))).sum())
        assert abs(r.quality - 1 / (1 + math.exp(-z))) < 1e-5 and r.kept == (r.quality >= quality.THRESHOLD)
