"""What the corpus operators share: checkpoints, Arrow columns, ranks, repeated-key filters, components."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..sources.store import materialised


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Materialise df in the cluster's shared checkpoint folder and cut its lineage."""
    return materialised(df)


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow, after this package was sent to the executors: they need not have it on their path."""
    sc = df.sparkSession.sparkContext
    if not getattr(sc, "_gamelode_sent", False):
        root = Path(__file__).parents[1]
        name = Path(tempfile.mkdtemp(prefix="gamelode-")) / "gamelode.zip"  # the driver serves it from here
        with zipfile.ZipFile(name, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(name))
        sc._gamelode_sent = True
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, most: int):
    """Parts of a batch whose texts have `most` bytes together or are a single one."""
    at, size = 0, 0
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    for i, n in enumerate(sizes):
        if i > at and size + n > most:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null counts as empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the length of each list."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """df with its 0-based rank under a total order, without sending all rows to one task.

    Rows are range-partitioned and numbered per partition; only one count per partition reaches the driver.
    """
    part, at = f"__{name}_part", f"__{name}_at"
    dealt = saved(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))  # as many partitions as the rows need
    counts = {r[0]: r[1] for r in dealt.groupBy(part).count().collect()}
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    if not offsets:
        return dealt.drop(part).withColumn(name, F.lit(0).cast("long"))
    starts = F.create_map(*[F.lit(x).cast("long") for pair in offsets for x in pair])
    numbered = dealt.withColumn(at, F.row_number().over(W.partitionBy(part).orderBy(*order)))
    return numbered.withColumn(name, starts[F.col(part).cast("long")] + F.col(at) - 1).drop(part, at)


#: Bits of a repeated-key filter for each key, and its largest size: 2**29 bits are 64 MiB.
BITS_PER_KEY, MAX_BITS, MIN_BITS = 8, 1 << 29, 1 << 15


def filter_bits(n_keys: int, per_key: int = BITS_PER_KEY, most: int = MAX_BITS) -> int:
    """A power of two: per_key bits a key, most at the utmost. A full filter lets more keys pass, it never loses one."""
    return min(most, max(MIN_BITS, 1 << max(0, n_keys * per_key - 1).bit_length()))


def bit_array(slots: DataFrame, n_bits: int) -> np.ndarray:
    """A bit for each slot (column slot, below n_bits) on the driver: n_bits / 8 bytes, MAX_BITS / 8 at most."""
    at = F.col("slot") + 1  # bitmap functions count from 1
    bitmaps = slots.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(max(n_bits // 8, 4096), np.uint8)
    for bucket, bits in bitmaps.toLocalIterator():
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return out


#: Packed hashes come together in groups of about so many.
GROUP = 1 << 22
PACKED = "group long, packed binary"


def pack(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as the byte planes of their differences, which compress well."""
    return np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)


def group_bits(partitions: int, total: int) -> int:
    """First bits of a hash that name its group, for some total of hashes."""
    return min(30, max(4 * partitions, -(-total // GROUP)).bit_length())


def packed(hashes: np.ndarray, bits: int, cut: bool = False, most: int = 2) -> pa.RecordBatch:
    """(group, packed): the first `bits` bits of 62-bit hashes and the 32 bits after them (cut: these alone are given),
    each hash that occurs more often `most` times."""
    if not cut:
        hashes = (hashes >> hashes.dtype.type(30 - bits)).astype(np.int64)
    found, n = np.unique(hashes, return_counts=True)
    found = np.repeat(found, np.minimum(n, most))
    group = found >> 32
    edges = np.flatnonzero(np.diff(group)) + 1
    first = np.concatenate([[0], edges]) if len(found) else edges
    parts = [pack(x) for x in np.split((found & 0xFFFFFFFF).astype(np.uint32), edges)] if len(found) else []
    return pa.RecordBatch.from_arrays([pa.array(group[first]), pa.array(parts, pa.binary())], names=["group", "packed"])


def repeated(rows: DataFrame, name: str, few: int | None = None) -> DataFrame:
    """The hashes (their first bits, as packed has them) that occur twice at least in rows of packed; with `few`, also whether
    they occur more than so many times (often)."""

    def run(batches):
        held, of = [], None

        def out():
            x = np.sort(np.concatenate(held))
            found = np.unique(x[1:][x[1:] == x[:-1]])
            cols = [pa.array(found.astype(np.int64) | of << 32)]
            if few is not None:
                cols.append(pa.array(np.isin(found, x[few:][x[few:] == x[: max(0, len(x) - few)]])))
            return pa.RecordBatch.from_arrays(cols, names=[name, "often"][: len(cols)])

        for b in batches:
            for group, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if group != of:
                    if held:
                        yield out()
                    held, of = [], group
                held.append(unpack(part))
        if held:
            yield out()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_map(rows.repartition(n, "group").sortWithinPartitions("group"), run, f"{name} long" + (", often boolean" if few is not None else ""))


def in_filter(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    slots = slots.astype(np.int64, copy=False)
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


class Ids:
    """A set of ids (column id) as bit arrays of bounded size, sent to the scans; a few other ids pass as well.

    With `others`, ids that are not in the set, none of these passes: those that pass the first array fill a second one, ids
    of the set that pass this a third one, and so on until none passes wrongly. Each is a small part of the one before."""

    def __init__(self, ids: DataFrame, others: DataFrame | None = None):
        self.bits: list[int] = []
        self.sent: list = []
        while True:
            bits = filter_bits(ids.count(), 16)
            slot = F.xxhash64("id", F.lit(len(self.bits))).bitwiseAND(bits - 1)
            self.bits.append(bits)
            self.sent.append(ids.sparkSession.sparkContext.broadcast(bit_array(ids.select(slot.alias("slot")), bits)))
            if others is None or len(self.bits) == 21:  # an odd number: what passes all is in
                break
            last = self.sent[-1]

            def wrong(batches, last=last):
                for b in batches:
                    yield b.filter(pa.array(in_filter(last.value, b.column(1).to_numpy()))).select([0])

            passed = saved(arrow_map(others.select(F.col("id").cast("long").alias("id"), slot), wrong, "id long"))
            if passed.isEmpty():
                break
            ids, others = passed, ids

    def slot(self, key: str) -> Column:
        return F.array(*[F.xxhash64(key, F.lit(i)).bitwiseAND(n - 1) for i, n in enumerate(self.bits)])

    def keeper(self):
        """A function of a batch and its column of slots, to be used in a scan: the rows whose id is in."""
        sent = self.sent

        def keep(b, column):
            slots = b.column(column).flatten().to_numpy().reshape(b.num_rows, len(sent))
            there = np.stack([in_filter(x.value, slots[:, i]) for i, x in enumerate(sent)] + [np.zeros(b.num_rows, bool)], axis=1)
            return b.filter(pa.array(there.argmin(axis=1) % 2 == 1))  # how many arrays in a row it passes

        return keep


def among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is among ids (column id), and a few others."""
    known, n = Ids(ids), len(rows.columns)
    keep = known.keeper()

    def run(batches):
        for b in batches:
            yield keep(b, n).select(list(range(n)))

    return arrow_map(rows.withColumn("__among", known.slot(key)), run, rows.schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b), both long: rows (node, root), root the smallest node.

    Alternating large-star and small-star rounds; each is a few shuffles keyed by node with map-side minima, and
    each round's edges are checkpointed. No component is ever gathered in one task.
    """

    def star(both: DataFrame, large: bool) -> DataFrame:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumn("h", F.col("a").bitwiseAND(255))
        joined = both.withColumn("h", F.col("a").bitwiseAND(255)).join(least, ["a", "h"])  # by two keys: the skewed side gets an exchange of its own
        out = joined.where("b > a" if large else "b <= a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    now = state(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = saved(star(star(both, True), False))
        last, now = now, state(edges)
        if last == now:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
