"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 32 segments of two bits. The Manhattan distance of two
embeddings is at most the fingerprints' Hamming distance, so pairs near enough in the embedding are a superset of the
pairs wanted. The embedding is cut into BLOCKS blocks: within Manhattan distance r, at most r blocks differ, so the two
agree on a grid cell made of some BLOCKS - r blocks. The range join is an equi-join on those cells, and every pair is
verified on the exact bits inside its cell.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

WIDTH, RADIUS, BLOCKS, SEED = 4, 4, 8, 42
#: A cell with more fingerprints than this isn't held in memory; its links are found through midpoints instead.
CELL_IN_MEMORY = 65_536


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Bit set iff it is set in over half of the shingles' XXH64. No word: zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    hashes = np.array([digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[width - 1 :])], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in common.byte_texts(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return common.arrow_map(docs.select(F.col(doc_id), F.col(text)), run, f"doc_id {kind}, fp long")


def cell_masks(radius: int, blocks: int) -> list[int]:
    """Bits of the embedding that make each kind of cell, as signed longs."""
    width = 64 // blocks
    out = [sum(((1 << width) - 1) << (width * b) for b in kept) for kept in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def spanning_links(values: np.ndarray, radius: int):
    """Pairs that join each component of the distinct values under Hamming distance radius, not all pairs."""
    left = values
    while len(left) > 1:
        root, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= radius
            if near.any():
                hits = left[near]
                frontier.extend(hits)
                left = left[~near]
                yield np.full(len(hits), root), hits


def _cell_links(radius: int, most: int):
    """Over rows (cell, part, fp) sorted by cell: links (a, b), and (fp, null) for each fingerprint of an over-full cell."""

    def run(batches):
        held, last, full = [], None, False

        def out(pairs, singles):
            a = np.concatenate([*[p[0] for p in pairs], *singles]).view(np.int64) if pairs or singles else np.empty(0, np.int64)
            b = np.concatenate([p[1] for p in pairs]).view(np.int64) if pairs else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.concat_arrays([pa.array(b), pa.nulls(len(a) - len(b), pa.int64())])], names=["a", "b"])

        def closed(parts):
            return [] if full else list(spanning_links(np.unique(np.concatenate(parts)), radius))

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.view(np.uint64)
            cut = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(cell)]))
            pairs, singles = [], []
            sizes = ends - starts
            inner = np.ones(len(starts), bool)
            inner[[0, -1]] = False
            two = starts[inner & (sizes == 2)]  # most cells hold one or two: these at once
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            pairs.append((fp[near], fp[near + 1]))
            for i in np.flatnonzero(inner & (sizes > 2) | ~inner):
                s, e, key = starts[i], ends[i], (cell[starts[i]], part[starts[i]])
                if key != last:
                    if held:
                        pairs += closed(held)
                    held, last, full = [], key, False
                held.append(fp[s:e])
                if full or sum(map(len, held)) > most:
                    full = True
                    singles += held
                    held = []
            yield out(pairs, singles)
        if held:
            yield out(closed(held), [])

    return run


def _ball(fps: DataFrame, flips: int) -> DataFrame:
    """(fp, z): each fp with all values that differ from it in at most `flips` bits."""
    out = fps.select("fp", F.col("fp").alias("z"), F.lit(-1).alias("last"))
    for _ in range(flips):  # one more bit to the right of the last one, or none any more (64)
        bit = F.explode(F.when(F.col("last") < 63, F.sequence(F.col("last") + 1, F.lit(64))).otherwise(F.array(F.lit(64))))
        out = out.select("fp", "z", bit.alias("last")).select("fp", F.expr("z ^ CASE WHEN last < 64 THEN shiftleft(1L, last) ELSE 0L END").alias("z"), "last")
    return out.select("fp", "z")


def midpoint_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that join the components of fps (column fp) under radius, in rows linear in fps.

    Two values lie within radius iff some value lies within radius // 2 of one and the rest of radius of the other. Of
    those that are near such a midpoint the least within radius // 2 is linked with all others: they lie within radius of
    it. For radius 4 each value has 1 + 64 + 2016 midpoints.
    """
    near, far = _ball(fps, radius // 2), _ball(fps, radius - radius // 2)
    least = near.groupBy("z").agg(F.min("fp").alias("a"))
    return far.join(least, "z").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, most: int = CELL_IN_MEMORY) -> DataFrame:
    """Links (a, b) between the distinct values of fp that join what lies within radius; not every pair of a group."""
    odd = "6148914691236517205L"  # the count of each two bits, in those bits: the carry above, the odd bit below
    embedding = f"(shiftleft(fp & shiftrightunsigned(fp, 1) & {odd}, 1) | ((fp ^ shiftrightunsigned(fp, 1)) & {odd}))"
    cells = F.explode(F.array(*[F.struct(F.lit(i).cast("short").alias("part"), F.expr(f"{embedding} & {m}L").alias("cell")) for i, m in enumerate(cell_masks(radius, blocks))]))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = fps.repartition(n)  # each becomes some 70 rows: all tasks share them
    dealt = fps.select("fp", cells.alias("c")).select("c.cell", "c.part", "fp").repartition(n, "cell", "part").sortWithinPartitions("cell", "part", "fp")
    found = common.saved(common.arrow_map(dealt, _cell_links(radius, most), "a long, b long").distinct())
    full = found.where("b IS NULL").select(F.col("a").alias("fp"))
    found = found.where("b IS NOT NULL")
    return found if full.isEmpty() else found.unionByName(midpoint_links(full, radius)).distinct()


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, radius: int = RADIUS, most: int = CELL_IN_MEMORY) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least id that links reach, the own one included).

    Null and empty texts have fingerprint zero and link like others; equal fingerprints always link; repeated rows
    give repeated rows; a null id is never a component's least id unless it has no other. Empty table: no rows.
    """
    fps = common.saved(fingerprints(docs, text, doc_id, width))
    nodes = common.saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    root = common.components(links(nodes.select("fp"), radius, most=most))
    at = nodes.join(root, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    at = common.saved(at)
    least = at.groupBy("root").agg(F.min("first").alias("component_id")).withColumn("head", F.expr("root & 255"))
    named = at.withColumn("head", F.expr("root & 255")).join(least, ["root", "head"]).select("fp", "component_id")
    head = F.expr("fp & 255").alias("head")
    return fps.select("doc_id", "fp", head).join(named.select("fp", "component_id", head), ["fp", "head"]).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, radius: int = RADIUS) -> DataFrame:
    """The rows of docs with the least id of their component, all columns; of several texts with that id one (the least
    hash). Rows that repeat id and text of the one that stays all stay. A null id gives way to any other."""
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("content"))
    groups = near_groups(docs.select(key.alias("doc_id"), F.col(text).alias("text")), "text", "doc_id", width, radius)
    keep = groups.where("doc_id = component_id").select(F.col("doc_id.id").alias("__near_id"), F.col("doc_id.content").alias("__near_content")).distinct()
    return docs.join(keep, F.col(doc_id).eqNullSafe(F.col("__near_id")) & (F.xxhash64(text) == F.col("__near_content")), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
