"""Removal of byte strings of WIDTH bytes that start at two places or more.

This is not the depth-limited radix sort of suffixes: its most-significant-digit passes would deal out a row for each
byte of the corpus in every pass. Windows are told apart by hashes instead, in four passes that each let only what is
still open into the next; equal groups after the last are the repeated windows, as they would be after the sort.

1. A window's anchor is, of its substrings of ANCHOR bytes, the one with the least hash (the leftmost on a tie). Equal
   windows have equal anchors at equal places, so windows with different anchors never meet. Adjacent windows that
   share an anchor form a run, one for some 50 bytes. Anchors are counted packed; runs whose anchor occurs once are
   settled: unique.
2. Runs left are counted by their whole content.
3. Equal runs are repeated in all their windows: settled.
4. What is left (runs at the edge of repeated passages, and one of each group of equal runs beside them) is cut into
   its windows; equal ones are repeated. Windows of an anchor with over HOT such runs are dealt one by one, and those
   that occur twice in a slice are settled there.

Groups of runs are told apart by 128 bits of hashes, single windows and documents by 64. Which runs take part in a pass
reaches the scans as a bit array of bounded size; a scan lets a few others through, which later passes settle. Only texts
that lose bytes are dealt out, once, at the end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

WIDTH, ANCHOR = 200, 100
#: Texts are scanned in buffers of this many bytes; longer ones in overlapping parts.
BUFFER = 1 << 18
#: Anchors of a slice that are packed together.
PACKED = 1 << 20
#: An anchor with more runs than this in pass 4 is dealt out by windows.
HOT = 128
_PLACE = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_C1, _C2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_POWERS: list = []


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _POWERS:
        n = 2 * BUFFER + WIDTH + 1
        with np.errstate(over="ignore"):
            up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        _POWERS.extend((np.random.default_rng(200).integers(0, 1 << 63, 256, np.uint64), up, down))
    return tuple(_POWERS)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Runs:
    """The runs of one buffer, arrays of one entry a run: uid, start and end (first and last window, places in the
    text), anchor, content, name (a hash of uid and start)."""

    def __init__(self, parts: list[tuple[int, int, bytes]], width: int, anchor: int):
        """parts: (uid, place in the text of the first byte, bytes); a part shorter than width has no window."""
        table, up, down = _powers()
        sizes = np.array([len(p[2]) for p in parts])
        at = np.cumsum(sizes) - sizes
        buf = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        n = len(buf)
        self.width, self.down = width, down
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[buf] * up[:n], dtype=np.uint64)])
            grams = mix((self.sums[anchor:] - self.sums[:-anchor]) * down[: n - anchor + 1])
        key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        least, span, reach = key, 1, width - anchor + 1
        while 2 * span <= reach:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if span < reach:
            least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
        place = (least & _PLACE).astype(np.int64)  # of each window's anchor, the leftmost on a tie
        count = np.maximum(0, sizes - width + 1)
        part = np.repeat(np.arange(len(parts)), count)
        windows = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count) + at[part]
        found = place[windows]
        new = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (part[1:] != part[:-1])])) if len(part) else np.empty(0, np.int64)
        last = np.append(new[1:], len(part)) - 1
        self.first, self.last, self.place = windows[new], windows[last], found[new]
        shift = np.array([p[1] for p in parts], np.int64)[part[new]] - at[part[new]]
        self.uid = np.array([p[0] for p in parts], np.int64)[part[new]]
        self.start, self.end = self.first + shift, self.last + shift
        self.anchor = grams[self.place]
        with np.errstate(over="ignore"):
            text = (self.sums[self.last + width] - self.sums[self.first]) * down[self.first]
            self.content = mix(text + (self.last - self.first).astype(np.uint64) * _C1 + (self.place - self.first).astype(np.uint64) * _C2)
            self.name = mix(self.uid.view(np.uint64) + self.start.astype(np.uint64) * _C1)

    def keys(self, i: int) -> np.ndarray:
        """Hashes of the windows of run i, with the anchor's place in each."""
        w = np.arange(self.first[i], self.last[i] + 1)
        with np.errstate(over="ignore"):
            return mix((self.sums[w + self.width] - self.sums[w]) * self.down[w] + (self.place[i] - w).astype(np.uint64) * _C2)


def scan(uids, texts, width: int = WIDTH, anchor: int = ANCHOR):
    """Runs of the whole texts, buffer by buffer."""
    parts, size = [], 0
    for uid, t in zip(uids, texts):
        for s in range(0, max(1, len(t) - width + 1), BUFFER):
            piece = t[s : s + BUFFER + width - 1] if len(t) > BUFFER else t
            if len(piece) < width:
                continue
            parts.append((uid, s, piece))
            size += len(piece)
            if size >= BUFFER:
                yield Runs(parts, width, anchor)
                parts, size = [], 0
            if len(t) <= BUFFER:
                break
    if parts:
        yield Runs(parts, width, anchor)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _uid(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id), F.col(text))


def _out(uid, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(start), pa.array(end)], names=["uid", "start", "end"])


def _window_groups(batches):
    """Over rows (anchor, uid, start, end, keys) sorted by anchor: (uid, start, end) of windows that are repeated. Rows
    without keys are settled and pass."""

    def settled(rows):
        n = np.array([len(r[3]) // 8 for r in rows])
        keys = np.frombuffer(b"".join(r[3] for r in rows), np.uint64)
        with np.errstate(over="ignore"):
            keys = mix(keys + np.repeat(np.array([r[0] for r in rows], np.int64).view(np.uint64), n))
        uid = np.repeat(np.array([r[1] for r in rows], np.int64), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.array([r[2] for r in rows], np.int64), n)
        row = np.repeat(np.arange(len(rows)), n)
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(count[back] > 1)
        if not len(hit):
            return _out(*[np.empty(0, np.int64)] * 3)
        first = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])]))
        last = np.append(first[1:], len(hit)) - 1
        return _out(uid[hit[first]], place[hit[first]], place[hit[last]])

    held: list = []
    for b in batches:
        done = b.column(4).is_null()
        if pc.any(done).as_py():
            yield b.filter(done).select(["uid", "start", "end"])
            b = b.filter(pc.invert(done))
        held += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist())
        if not held:
            continue
        last = held[-1][0]  # its rows may go on: HOT long ones and two short ones for each slice at most
        cut = next((i for i in range(len(held) - 1, -1, -1) if held[i][0] != last), -1) + 1
        if cut:
            yield settled(held[:cut])
            held = held[cut:]
    if held:
        yield settled(held)


def _loose_rows(r: Runs, i: np.ndarray, hot: np.ndarray):
    """Rows for _window_groups of the runs i of r; hot says which of them are dealt out by windows."""
    cold = i[~hot]
    keys = pa.array([r.keys(j).tobytes() for j in cold.tolist()], pa.binary())
    names = ["anchor", "uid", "start", "end", "keys"]
    yield pa.RecordBatch.from_arrays([_signed(r.anchor[cold]), pa.array(r.uid[cold]), pa.array(r.start[cold]), pa.array(r.end[cold]), keys], names=names)
    if not hot.any():
        return
    parts = [r.keys(j) for j in i[hot].tolist()]
    n = np.array([len(p) for p in parts])
    run = np.repeat(i[hot], n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + r.start[run]
    with np.errstate(over="ignore"):
        key = mix(np.concatenate(parts) + r.anchor[run] * _C1)
    order = np.argsort(key, kind="stable")
    key, uid, place = key[order], r.uid[run][order], place[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    nth = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))
    sent, known = nth < 2, nth >= 2  # two stand for all of a slice; the others are repeated
    yield pa.RecordBatch.from_arrays([_signed(key[sent]), pa.array(uid[sent]), pa.array(place[sent]), pa.array(place[sent]), pa.array([key[j : j + 1].tobytes() for j in np.flatnonzero(sent)], pa.binary())], names=names)
    if known.any():
        yield pa.RecordBatch.from_arrays([_signed(key[known]), pa.array(uid[known]), pa.array(place[known]), pa.array(place[known]), pa.nulls(int(known.sum()), pa.binary())], names=names)


def repeated_windows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """uid, start, end: stretches of window starts (first and last) whose windows occur elsewhere too. uid names a row."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(_uid(doc_id, text).alias("uid"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0

    def runs(batches):
        for b in batches:
            yield from scan(b.column(0).to_pylist(), common.byte_texts(b.column(1)), width, anchor)

    def flagged(slots: DataFrame, n_bits: int):
        return spark.sparkContext.broadcast(common.bit_array(slots, n_bits))

    def slot(x: str, n_bits: int) -> F.Column:
        return F.expr(f"{x} & {n_bits - 1}L").alias("slot")

    bits = common.group_bits(n, total // 50)

    def first(batches):
        held, size = [], 0
        for r in runs(batches):
            held.append(r.anchor >> np.uint64(2))
            size += len(r.anchor)
            if size >= PACKED:
                yield common.packed(np.concatenate(held), bits)
                held, size = [], 0
        if held:
            yield common.packed(np.concatenate(held), bits)

    counted = common.saved(common.repeated(common.arrow_map(rows, first, common.PACKED), "anchor"))
    n_bits = common.filter_bits(counted.count(), 16)
    known = flagged(counted.select(slot("anchor", n_bits)), n_bits)

    def second(batches):
        for r in runs(batches):
            i = np.flatnonzero(common.in_filter(known.value, (r.anchor >> np.uint64(2) >> np.uint64(30 - bits)) & np.uint64(n_bits - 1)))
            yield pa.RecordBatch.from_arrays([_signed(r.anchor[i]), _signed(r.content[i]), _signed(r.name[i])], names=["anchor", "content", "name"])

    found = common.arrow_map(rows, second, "anchor long, content long, name long")
    kinds = common.saved(found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")))
    anchors = kinds.groupBy("anchor").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("singles"), F.count(F.lit(1)).alias("kinds")).where("all > 1")
    head = F.expr("content & 255").alias("head")
    left = kinds.join(anchors, "anchor").select("anchor", "content", "n", "name", "singles", (F.col("kinds") + F.col("all") / 16).alias("rows"))
    left = common.saved(left)  # rows: the runs of an anchor in the last pass, with those that the filter lets through
    equal, loose = left.where("n > 1"), left.where("singles > 0")
    many = loose.where(F.col("rows") > hot).select("anchor").distinct()
    n_equal, n_loose, n_many = (x.count() for x in (equal, loose, many))
    b_equal, b_loose, b_many = (common.filter_bits(x, 16) for x in (n_equal, n_loose, n_many))
    in_equal, in_loose, in_many = flagged(equal.select(slot("content", b_equal)), b_equal), flagged(loose.select(slot("name", b_loose)), b_loose), flagged(many.select(slot("anchor", b_many)), b_many)

    def third(batches):
        for r in runs(batches):
            i = np.flatnonzero(common.in_filter(in_equal.value, r.content & np.uint64(b_equal - 1)))
            yield pa.RecordBatch.from_arrays([_signed(r.anchor[i]), _signed(r.content[i]), pa.array(r.uid[i]), pa.array(r.start[i]), pa.array(r.end[i])], names=["anchor", "content", "uid", "start", "end"])

    twins = equal.select("anchor", "content", head)  # by three keys: the runs get an exchange that can be split
    whole = common.arrow_map(rows, third, "anchor long, content long, uid long, start long, end long").withColumn("head", head).join(twins, ["anchor", "content", "head"]).select("uid", "start", "end")

    def fourth(batches):
        for r in runs(batches):
            i = np.flatnonzero(common.in_filter(in_loose.value, r.name & np.uint64(b_loose - 1)))
            if len(i):
                yield from _loose_rows(r, i, common.in_filter(in_many.value, r.anchor[i] & np.uint64(b_many - 1)))

    cut = common.arrow_map(rows, fourth, "anchor long, uid long, start long, end long, keys binary")
    spread = F.when(F.col("keys").isNull(), F.col("uid")).otherwise(F.col("anchor"))  # settled ones just pass
    dealt = cut.withColumn("spread", spread).repartition(n, "spread").drop("spread").sortWithinPartitions("anchor")
    return whole.unionByName(common.arrow_map(dealt, _window_groups, "uid long, start long, end long"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes), kept_sha256.

    Texts are UTF-8 bytes, null is empty; matches never cross texts. Every byte in a string of width bytes that starts
    elsewhere too goes, judged on the input. Texts under width bytes stay whole; repeated rows lose all that is long
    enough; null ids are ids like others; an empty table gives no rows.
    """
    found = common.saved(repeated_windows(docs, text, doc_id, width, anchor, hot))
    stretches = found.groupBy("uid").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    ids = found.select(F.col("uid").alias("id")).distinct()
    bits = common.filter_bits(ids.count(), 16)
    touched = docs.sparkSession.sparkContext.broadcast(common.bit_array(ids.select(F.expr(f"id & {bits - 1}L").alias("slot")), bits))
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"

    def batch(ids, texts, starts, ends):
        size, gone, spans, kept = [], [], [], []
        for t, s, e in zip(texts, starts, ends):
            size.append(len(t))
            if s is None or not s.is_valid:
                gone.append(0), spans.append(0), kept.append(t)
                continue
            edge = np.zeros(len(t) + 1, np.int64)
            np.add.at(edge, s.values.to_numpy(zero_copy_only=False), 1)
            np.add.at(edge, e.values.to_numpy(zero_copy_only=False) + width, -1)
            cover = np.cumsum(edge[:-1]) > 0
            gone.append(int(cover.sum()))
            spans.append(int(cover[0]) + int(np.count_nonzero(cover[1:] & ~cover[:-1])))
            kept.append(np.frombuffer(t, np.uint8)[~cover].tobytes())
        sha = [hashlib.sha256(k).hexdigest() for k in kept]
        return pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    def clean(batches):
        for b in batches:
            b = b.filter(pa.array(~common.in_filter(touched.value, b.column(2).to_numpy() & (bits - 1))))
            yield batch(b.column(0), common.byte_texts(b.column(1)), [None] * b.num_rows, [None] * b.num_rows)

    def some(batches):
        for b in batches:
            yield b.filter(pa.array(common.in_filter(touched.value, b.column(2).to_numpy() & (bits - 1))))

    def run(batches):
        for b in batches:
            yield batch(b.column(0), common.byte_texts(b.column(1)), b.column(2), b.column(3))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _uid(doc_id, text).alias("uid"))
    cut = common.arrow_map(rows, some, f"doc_id {kind}, text string, uid long").join(stretches, "uid", "left").select("doc_id", "text", "starts", "ends")
    return common.arrow_map(rows, clean, schema).unionByName(common.arrow_map(cut, run, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents")).drop("kept")


#: Every window of 200 bytes, as hexadecimal digits, counted by its hash; runs of repeated ones cut out.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
w AS (SELECT doc_id, i, md5_number(array_slice(h, 2 * i + 1, 2 * i + 400)) AS k FROM (SELECT doc_id, h, unnest(range(n - 199)) AS i FROM b WHERE n >= 200)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT p.doc_id, sum(z - a) AS gone, count(*) AS spans, string_agg(h[2 * before + 1 : 2 * a], '' ORDER BY a) || any_value(h)[2 * max(z) + 1 : ] AS rest FROM p JOIN b USING (doc_id) GROUP BY 1)
SELECT b.doc_id, b.n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM b LEFT JOIN k USING (doc_id)
"""
