"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one hashes every text to a few slots of a bit array and keeps the slots that were set twice. Pass two tests
every row against that array: a row with a slot set once only is unique and passes straight through, and only the
others (repeated ones and a few false alarms) shuffle. An array of MOST_BITS, which is broadcast, serves MOST_BITS /
BITS_PER_ROW texts; where there are more, their hashes are cut into ranges with an array each, one after the other, so that the
share of false alarms stays the same. Pass one shuffles slots, map-side combined: a few bytes a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SLOTS, BITS_PER_ROW, MOST_BITS = 2, 16, 1 << 30


def normalised(text: Column) -> Column:
    """Lower-case A-Z alone; null is empty. Texts of ASCII alone take the fast function."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _slot(key: Column, i: int, n_bits: int) -> Column:
    return F.xxhash64(key, F.lit(i)).bitwiseAND(n_bits - 1)


def _tested(rows: DataFrame, slots: list[Column], bitmaps: DataFrame) -> DataFrame:
    """rows with __maybe: whether all slots are set in bitmaps (bucket, bits), which are broadcast."""
    maybe = F.lit(True)
    for i, slot in enumerate(slots):
        bucket, bits = f"__bucket{i}", f"__bits{i}"
        rows = rows.withColumn(bucket, F.bitmap_bucket_number(slot)).join(
            F.broadcast(bitmaps.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))), bucket, "left"
        )
        position = F.bitmap_bit_position(slot)
        byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        maybe = maybe & F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), position % 8)), F.lit(2)) == 1, F.lit(False))
    return rows.withColumn("__maybe", maybe).drop(*[f"__{x}{i}" for x in ("bucket", "bits") for i in range(len(slots))])


def possibly_repeated(rows: DataFrame, key: str) -> DataFrame:
    """rows with __maybe: false where the key certainly occurs once."""
    n = rows.count()
    ranges = max(1, -(-n * BITS_PER_ROW // MOST_BITS))
    n_bits = common.filter_bits(-(-n // ranges), BITS_PER_ROW, MOST_BITS)
    slots = [_slot(F.col(key), i, n_bits) for i in range(SLOTS)]
    part = F.pmod(F.xxhash64(F.col(key), F.lit(SLOTS)), F.lit(ranges)).cast("int")
    twice = rows.select(part.alias("part"), F.explode(F.array(*slots)).alias("slot")).groupBy("part", "slot").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    bitmaps = twice.groupBy("part", F.bitmap_bucket_number(F.col("slot")).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot"))).alias("bits"))
    bitmaps = common.saved(bitmaps)  # of one part at most MOST_BITS / 8 bytes
    if ranges == 1:
        return _tested(rows, slots, bitmaps)
    out = None
    for i in range(ranges):
        some = _tested(rows.where(part == i), slots, bitmaps.where(F.col("part") == i))
        out = some if out is None else out.unionByName(some)
    return out


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts are those identical after lower-casing A-Z; null counts as empty. The largest id of a group stays. A
    null id is below all others; rows that repeat the staying id all stay. An empty table gives no rows. Columns
    beside the two named are not looked at.
    """
    rows = common.saved(docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("text_sha256")))
    tested = possibly_repeated(rows, "text_sha256")
    return _grouped(tested)


def _grouped(tested: DataFrame) -> DataFrame:
    maybe = tested.where("__maybe").drop("__maybe").withColumn("head", F.substring("text_sha256", 1, 2))
    groups = maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # joined by digest and head: groups are dealt by digest alone, so both sides get exchanges that Spark can split
    repeated = maybe.join(groups.withColumn("head", F.substring("text_sha256", 1, 2)), ["text_sha256", "head"])
    single = tested.where("NOT __maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    both = single.unionByName(repeated.select("doc_id", "keep_id", "group_size", "text_sha256"))
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, all columns. Rows that are surely none of those that go pass straight through, the
    rest are matched with them. Nulls, ties and empty tables as in exact_groups; names that begin with __ are taken."""
    sha = "__exact_sha256"
    groups = exact_groups(docs, text, doc_id)
    gone = groups.where("NOT kept").select(F.col("doc_id").alias("__exact_id"), F.col("text_sha256").alias("__exact_of")).distinct()
    gone = common.saved(gone)
    n_bits = common.filter_bits(gone.count(), BITS_PER_ROW, MOST_BITS)
    of = lambda id_, sha_: F.xxhash64(sha_, id_).bitwiseAND(n_bits - 1)
    slot = of(F.col("__exact_id"), F.col("__exact_of"))
    bitmaps = gone.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    tested = _tested(docs.withColumn(sha, digest(F.col(text))), [of(F.col(doc_id), F.col(sha))], common.saved(bitmaps))
    match = (F.col(sha) == F.col("__exact_of")) & F.col(doc_id).eqNullSafe(F.col("__exact_id"))
    stays = tested.where("__maybe").join(gone, match, "left_anti")
    return tested.where("NOT __maybe").unionByName(stays).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
