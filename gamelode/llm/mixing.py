"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: sources in code-point order weigh 1, 2, 3, 1, ... and share the corpus's words; a source takes at most
REPEATS times its own words, the rest is shared again by weight. Words are handed out in blocks of equal size, BLOCK
words or a PARTS-th of the smallest target: first to sources, then within a source to its shards, each time to the
highest quotient votes / (2 * seats + 1). Two bounds of the least quotient that still wins follow from the sums of votes
and seats; what lies above both is won, and the quotients between them, some two a row, are ranked. A shard lays its
documents end to end in keyed-hash order; its quota of blocks is a run of words, from a seeded place, round and round
that sequence. No source, shard list or document list is ever gathered in one place.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import common

WEIGHTS, REPEATS, BLOCK, PARTS, SHARD_WORDS, SEED = (1, 2, 3), 3, 64, 16, 1 << 18, 11
#: Rates that one pass over the sources tries for the targets.
MARKS = 32


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source, size (words [^\\x20\\x09-\\x0D]+ of the whole text, null: 0), content (the text's hash)."""

    def run(batches):
        for b in batches:
            size = pa.array([len(t.split()) for t in common.byte_texts(b.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), size, b.column(3)], names=["doc_id", "source", "size", "content"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return common.arrow_map(docs.select(F.col(doc_id), F.col(source).cast("string"), F.col(text), F.xxhash64(text).alias("content")), run, f"doc_id {kind}, source string, size long, content long")


def targets(sources: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sources (source, source_size) with weight and target.

    A source is full where the words for one unit of weight reach its limit, repeats * source_size / weight. The words
    taken grow with that rate; each pass over the sources closes in on the rate by MARKS marks, until no source's limit
    lies between the last two: then it is known exactly."""
    at = common.ranked(sources, "rank", F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    at = at.withColumn("weight", weight)
    most = F.lit(float(repeats)) * F.col("source_size")
    full = most / F.col("weight")
    total, lo, hi = at.agg(F.sum("source_size"), F.lit(0.0), F.max(full)).first()
    if not total or total >= repeats * total:
        return at.withColumn("target", most if total else F.lit(0.0))
    while True:
        marks = [lo + (hi - lo) * i / MARKS for i in range(1, MARKS)]
        inside = [m for m in marks if lo < m < hi]
        taken = at.agg(F.count(F.when((full > lo) & (full < hi), 1)), *[F.sum(F.least(most, F.col("weight") * F.lit(m))) for m in inside]).first()
        if not taken[0] or not inside:
            break
        under = [m for m, t in zip(inside, taken[1:]) if t <= total]
        over = [m for m, t in zip(inside, taken[1:]) if t > total]
        lo, hi = max([lo, *under]), min([hi, *over])
    over = full <= F.lit(lo)
    taken, free = at.agg(F.coalesce(F.sum(F.when(over, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
    rate = (total - taken) / free if free else lo
    return at.withColumn("target", F.least(most, F.col("weight") * F.lit(rate)))


def _seats(votes: Column, quotient: Column) -> Column:
    """How many of the quotients votes / 1, votes / 3, votes / 5, ... are `quotient` or more."""
    return F.floor((votes / quotient + 1) / 2).cast("long")


def apportion(rows: DataFrame, votes: str, seats: str, group: str | None, order: str, out: str) -> DataFrame:
    """Sainte-Laguë seats within each group: rows' votes share the group's number of seats (the same in all its rows),
    ties to the lesser order, which tells the rows of a group apart. Without votes in a group nobody wins. group None: all
    rows are one. Rows are few numbers each (one a shard or a source).

    With n rows, V votes and s seats, quotients from V / (2s + n) on are s at least, for each row's count of them is
    less than half a seat from votes / 2q; above V / (2s - n) they are under s.
    """
    v, by = F.col(votes).cast("double"), [group] if group else []
    of = rows.groupBy(*by).agg(F.max(seats).cast("double").alias("__s"), F.sum(v).alias("__v"), F.count(F.when(v > 0, 1)).alias("__n"), F.max(v).alias("__most"))
    high = F.when(2 * F.col("__s") > F.col("__n"), F.least("__most", F.col("__v") / (2 * F.col("__s") - F.col("__n")))).otherwise(F.col("__most"))
    span = of.where("__s > 0 AND __v > 0").select(*by, "__s", (F.col("__v") / (2 * F.col("__s") + F.col("__n"))).alias("__lo"), (high * (1 + 1e-9)).alias("__hi"))

    def beside(rows: DataFrame, few: DataFrame) -> DataFrame:
        if group:
            return rows.join(few, group)
        one = few.first()  # a single row
        return rows.select("*", *[F.lit(one[c] if one else None).cast(few.schema[c].dataType).alias(c) for c in few.columns])

    won = beside(rows.where(v > 0), span).withColumn("__sure", _seats(v, F.col("__hi"))).withColumn("__may", _seats(v, F.col("__lo")))
    won = common.saved(won.where("__s IS NOT NULL"))
    bids = won.where("__may > __sure").select(*by, order, v.alias("__v"), F.explode(F.sequence(F.col("__sure"), F.col("__may") - 1)).alias("__k"))
    bids = bids.withColumn("__q", F.col("__v") / (2 * F.col("__k") + 1))
    place = common.ranked(bids, "__place", *by, F.desc("__q"), order, "__k")
    left = won.groupBy(*by).agg((F.max("__s") - F.sum("__sure")).cast("long").alias("__open"))
    first = place.groupBy(*by).agg(F.min("__place").alias("__first"))
    more = beside(beside(place, left), first).where(F.col("__place") - F.col("__first") < F.col("__open")).groupBy(*by, order).agg(F.count(F.lit(1)).alias("__more"))
    won = won.select(*by, order, "__sure").join(more, [*by, order], "left").select(*by, order, (F.col("__sure") + F.coalesce("__more", F.lit(0))).cast("long").alias(out))
    return rows.join(won, [*by, order], "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def mix_plan(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, parts: int = PARTS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, content, source_size, target, taken and the first word taken besides whole copies (`start`, `rest`).

    A document contributes taken // size whole copies and `rest` = taken % size words from word `start` on, going
    round its end. Repeated rows are documents of their own; a null source is a source, the last one; a null id is
    laid out like others; empty texts take nothing; an empty table gives no rows.
    """
    sizes = common.saved(sizes)
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    whole, least = sources.agg(F.sum("target"), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    block = max(1, min(block, int((least or 0) / parts)))
    named = sources.withColumn("blocks", F.lit(int((whole or 0.0) / block + 0.5)))
    quotas = apportion(named, "target", "blocks", None, "rank", "quota").drop("blocks", "weight")
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    # the sources are joined by source and by the hash's low bits: the large side may then be split at a hot source
    salt = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(16))
    side = quotas.select(F.col("source").alias("__source"), "source_size", "target", "rank", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("__salt"))
    place = F.xxhash64("doc_id", F.lit(seed + 1))
    docs = sizes.withColumn("salt", salt).join(side, F.col("source").eqNullSafe(F.col("__source")) & (F.col("salt") == F.col("__salt"))).drop("__source", "__salt", "salt")
    docs = docs.withColumn("shard", F.pmod(place, n_shards)).withColumn("place", place)
    shards = docs.groupBy("rank", "shard", "quota", "source_size").agg(F.sum("size").alias("shard_size"))
    shards = apportion(common.saved(shards), "shard_size", "quota", "rank", "shard", "shard_quota")
    run = F.least(F.col("shard_quota") * block, F.col("shard_size") * repeats)
    shards = shards.select("rank", "shard", "shard_size", run.alias("run"), F.pmod(F.xxhash64("rank", "shard", F.lit(seed + 2)), F.greatest(F.lit(1), "shard_size")).alias("from"))
    at = docs.join(shards, ["rank", "shard"]).withColumn("after", F.sum("size").over(W.partitionBy("rank", "shard").orderBy("place", "doc_id", "content", "size").rowsBetween(W.unboundedPreceding, 0)))
    # words from `from` on: this document's first word lies `lead` words past `from`, going round
    s, size = F.greatest(F.lit(1), "shard_size"), F.col("size")
    lead = F.pmod(F.col("after") - size - F.col("from"), s)
    left = F.pmod(F.col("run"), s)
    head = F.greatest(F.lit(0), F.least(size, left - lead))  # the part after the first word, if the run reaches it
    tail = F.greatest(F.lit(0), F.least(left, lead + size - s))  # the part beyond `from`, if `from` lies inside
    whole = F.floor(F.col("run") / s).cast("long")
    at = at.withColumn("head", head).withColumn("rest", F.least(size, head + tail)).withColumn("start", F.when(tail > 0, s - lead).otherwise(0))
    taken = (whole * size + F.col("rest")).cast("long")
    return at.select("doc_id", "source", size.cast("long").alias("size"), "content", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), taken.alias("taken"), F.col("start").cast("long").alias("start"), F.col("rest").cast("long").alias("rest"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", n_chars: str = "n_chars", **how) -> DataFrame:
    """The mixture itself, in docs' columns: each document's whole copies, and a last row with the words of its partial
    copy, if any, joined by spaces (n_chars, where docs has it, is counted anew). Rows that repeat an id are documents of
    their own; which of several rows with equal id, source and text gets which of their shares is not said."""
    plan = mix_plan(word_counts(docs, text, doc_id, source), **how)
    key = ["__mix_id", "__mix_source", "__mix_content"]
    plan = plan.select(F.col("doc_id").alias(key[0]), F.col("source").alias(key[1]), F.col("content").alias(key[2]), "taken", "rest", "size", "start")
    plan = common.saved(plan)
    same = F.col(doc_id).eqNullSafe(F.col(key[0])) & F.col(source).cast("string").eqNullSafe(F.col(key[1])) & (F.xxhash64(text) == F.col(key[2]))
    repeated = plan.groupBy(*key).agg(F.count(F.lit(1)).alias("__mix_n")).where("__mix_n > 1")
    rows = docs
    if not repeated.isEmpty():  # then rows of a key are numbered on either side
        number = lambda by: F.row_number().over(W.partitionBy(*by).orderBy(F.lit(0)))
        rows = docs.withColumn("__mix_nth", number([F.col(doc_id), F.col(source).cast("string"), F.xxhash64(text)]))
        plan = plan.withColumn("__mix_nth_of", number(key))
        same = same & (F.col("__mix_nth") == F.col("__mix_nth_of"))
    whole = F.floor((F.col("taken") - F.col("rest")) / F.col("size")).cast("int").alias("__mix_whole")
    extra = ["__mix_nth_of"] if "__mix_nth_of" in plan.columns else []
    plan = plan.where("taken > 0").select(*key, *extra, whole, F.col("start").cast("int").alias("__mix_start"), F.col("rest").cast("int").alias("__mix_rest"))
    rows = rows.join(plan, same)
    copies = F.flatten(F.array(F.array_repeat(F.lit(False), F.col("__mix_whole")), F.when(F.col("__mix_rest") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))))
    rows = rows.withColumn("__mix_part", F.explode(copies))
    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    first = F.slice(words, F.col("__mix_start") + 1, F.col("__mix_rest"))
    more = F.slice(words, F.lit(1), F.greatest(F.lit(0), F.col("__mix_rest") + F.col("__mix_start") - F.size(words)))
    out = rows.withColumn(text, F.when(F.col("__mix_part"), F.concat_ws(" ", first, more)).otherwise(F.col(text)))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col("__mix_part"), F.char_length(text).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(word_counts(common.table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "source")
