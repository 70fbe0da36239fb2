"""Exact top-k search by inner product over a vector-approximation file.

Every component is an integer, floor(256 * x). The file holds for each vector, one byte a component, which of 2**BITS
cells of equal width over that component's range in the whole table it lies in; it is written once. The inner product
with a query is then known up to a margin, that of the query with half a cell in every component. A scan reads the
cells alone and keeps, for each query, candidates whose best possible score reaches the k-th greatest certain one. Only
their exact vectors are read, in order of best possible score until no unread one can enter the k best.

Queries go out in blocks of bounded size; each block scans all cells.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import common

SCALE, BITS, K = 256, 6, 5
#: Queries of a block at most, and the bytes of their vectors; candidates looked at together.
QUERY_BLOCK, BLOCK_BYTES, STEP = 4096, 1 << 25, 4096
#: Exact vectors that one task reads for a query: one near very many like vectors has several tasks.
SHARE = 256
#: Blocks whose scans go into one written table.
BLOCKS_AT_ONCE = 8


def usable(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, v (floor(256 * x) of each component as double), dim; without vectors null or with a component null or not finite."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE).cast("double"))
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(F.col(vector).isNotNull() & F.col(vec_id).isNotNull()).where(fine)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("v"), F.size(F.col(vector)).alias("dim"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def ranges(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dim -> least and greatest of each component, over all rows: a few numbers a component."""
    each = rows.select("dim", F.posexplode_outer("v").alias("i", "x")).groupBy("dim", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    out: dict = {}
    for dim, i, lo, hi in each.collect():
        a, b = out.setdefault(dim, (np.zeros(dim), np.zeros(dim)))
        if i is not None:
            a[i], b[i] = lo, hi
    return out


def written(rows: DataFrame, span: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The approximation file: vec_id, dim, cells (a byte a component)."""

    def run(batches):
        for b in batches:
            dims, cells = b.column(2).to_numpy(), [None] * b.num_rows
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                lo, hi = span[dim]
                width = (hi - lo) / (1 << BITS)
                v = _matrix(b.column(1).take(pa.array(at)), dim)
                of = np.minimum(((v - lo) / np.where(width > 0, width, 1)).astype(np.int64), (1 << BITS) - 1).astype(np.uint8)
                for i, row in zip(at.tolist(), of):
                    cells[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cells, pa.binary())], names=["vec_id", "dim", "cells"])

    return common.saved(common.arrow_map(rows.select("vec_id", "v", "dim"), run, "vec_id long, dim int, cells binary"))


def bounds(q: np.ndarray, cells: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(guess, margin): the inner products of queries and vectors lie within margin, one a query, of guess."""
    width = (hi - lo) / (1 << BITS)
    steps = (q * width).astype(np.float32)
    guess = cells.astype(np.float32) @ steps.T
    # the sums' rounding, far below half a cell: each term is under 2**BITS steps
    rounding = (len(lo) + 2) * 2.0**-23 * (1 << BITS) * np.abs(steps).sum(axis=1, dtype=np.float64)
    base = q @ (lo + width / 2)
    return guess.T.astype(np.float64) + base[:, None], np.abs(q) @ (width / 2) + rounding + 1e-9 * (1 + np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)))


def scan(cells: DataFrame, sent, k: int) -> DataFrame:
    """query_id, vec_id, least, most: candidates whose score may be among the k best of their task, with its bounds."""

    def run(batches):
        q_ids, q, lo, hi = sent.value
        sure = np.full((len(q), k), -np.inf)  # the k greatest certain scores so far
        found: list = []
        for b in batches:
            for s in range(0, b.num_rows, STEP):
                part = b.slice(s, STEP)
                ids = part.column(0).to_numpy()
                at = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(ids), len(lo))
                guess, margin = bounds(q, at, lo, hi)
                guess[q_ids[:, None] == ids] = -np.inf
                least = guess - margin[:, None]
                sure = np.partition(np.concatenate([sure, least], axis=1), -k, axis=1)[:, -k:]
                i, j = np.nonzero((guess + margin[:, None] >= sure.min(axis=1)[:, None]) & (guess > -np.inf))
                found.append((i, ids[j], least[i, j], guess[i, j] + margin[i]))
        if found:
            i, ids, least, most = (np.concatenate(x) for x in zip(*found))
            keep = most >= sure.min(axis=1)[i]
            for s in range(0, np.count_nonzero(keep), 1 << 16):
                at = np.flatnonzero(keep)[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i[at]]), pa.array(ids[at]), pa.array(least[at]), pa.array(most[at])], names=["query_id", "vec_id", "least", "most"])

    return common.arrow_map(cells.select("vec_id", "cells"), run, "query_id long, vec_id long, least double, most double")


def _read(k: int):
    """Over (query_id, dim, share, q, vec_id, most, v) sorted by query, length, share and descending bound: the k best of each
    share."""

    def run(batches):
        of, best = None, []
        out: list = []
        for b in batches:
            for query, dim, share, q, vec, most, v in zip(*[c.to_pylist() for c in b.columns]):
                if (query, dim, share) != of:
                    out += [(of[0], n + 1, i, -s) for n, (s, i) in enumerate(best)]
                    of, best, vector = (query, dim, share), [], np.array(q)
                if len(best) == k and most < -best[-1][0]:
                    continue  # nor can any later one enter
                best = sorted([*best, (-int(vector @ np.array(v)), vec)])[:k]
        out += [(of[0], n + 1, i, -s) for n, (s, i) in enumerate(best)]
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["query_id", "rank", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k greatest scores (all, if fewer), ties to the lesser id.

    queries are rows like those of vectors; a candidate with the query's own id is left out. Vectors null, with a null id,
    or with a component null or not finite take no part; vectors of another length never meet, so empty ones (score 0)
    meet each other alone. Repeated rows are candidates of their own; of several vectors with one id the least is the
    query. No query or no candidate: no rows. Scores are sums of integers, exact below 2**53.
    """
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = usable(vectors, vector, vec_id)
    asked = common.saved(usable(queries, vector, vec_id).groupBy("vec_id", "dim").agg(F.min("v").alias("v")))
    span = ranges(rows)
    cells = written(rows, span)
    parts, tables = [], []
    for dim in sorted(span):
        of = cells.where(F.col("dim") == dim)
        stream = asked.where(F.col("dim") == dim).select("vec_id", "v").toLocalIterator(prefetchPartitions=False)
        while block := list(islice(stream, max(1, min(QUERY_BLOCK, BLOCK_BYTES // (8 * max(1, dim)))))):
            sent = spark.sparkContext.broadcast((np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], float).reshape(len(block), dim), *span[dim]))
            parts.append((scan(of, sent, k).withColumn("dim", F.lit(dim)), sent))
            if len(parts) == BLOCKS_AT_ONCE:
                tables.append(_kept(parts, k))
                parts = []
    if parts:
        tables.append(_kept(parts, k))
    if not tables:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pairs = tables[0]
    for t in tables[1:]:
        pairs = pairs.unionByName(t)
    # exact vectors of the candidates that are left, and of the queries
    ids = pairs.select(F.col("vec_id").alias("id")).distinct()
    exact = common.among(rows.select("vec_id", "dim", "v"), "vec_id", ids)
    both = pairs.join(exact, ["vec_id", "dim"]).join(asked.select(F.col("vec_id").alias("query_id"), "dim", F.col("v").alias("q")), ["query_id", "dim"])
    dealt = both.select("query_id", "dim", "share", "q", "vec_id", "most", "v").repartition(n, "query_id", "dim", "share").sortWithinPartitions("query_id", "dim", "share", F.desc("most"), "vec_id")
    found = common.arrow_map(dealt, _read(k), "query_id long, rank int, vec_id long, score long")
    # over a query's shares; and an id may stand for queries of several lengths
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _kept(parts: list, k: int) -> DataFrame:
    """query_id, dim, vec_id, most, share of the scans' candidates that may be among a query's k best of all tasks; written.
    What is broadcast has a row a query, QUERY_BLOCK * BLOCKS_AT_ONCE at most."""
    found = parts[0][0]
    for p, _ in parts[1:]:
        found = found.unionByName(p)
    found = common.saved(found)
    for _, sent in parts:
        sent.unpersist()
    nth = F.row_number().over(W.partitionBy("query_id", "dim").orderBy(F.desc("least")))
    sure = found.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("query_id", "dim").agg(F.min("least").alias("sure"), F.count(F.lit(1)).alias("n"))
    left = found.join(F.broadcast(sure), ["query_id", "dim"]).where((F.col("n") < k) | (F.col("most") >= F.col("sure")))
    left = common.saved(left.groupBy("query_id", "dim", "vec_id").agg(F.max("most").alias("most")))
    shares = left.groupBy("query_id", "dim").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("shares"))
    return left.join(F.broadcast(shares), ["query_id", "dim"]).withColumn("share", F.pmod(F.xxhash64("vec_id"), F.col("shares"))).drop("shares")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(CASE WHEN len(q.v) = 0 THEN 0 ELSE list_dot_product(q.v, c.v) END AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
