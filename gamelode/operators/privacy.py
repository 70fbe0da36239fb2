"""Subject pseudonyms, erasure, and the funnel over counted rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import DEFAULT, Config
from ..functions import timex


def subject_ref(game_id: str, user_id: str, master: str) -> Column:
    """HMAC-SHA256 of the user under sha256(master:subject:game), spelled out with built-in functions."""
    key = F.unhex(F.rpad(F.sha2(F.concat(F.lit(f"{master}:subject:"), F.col(game_id)).cast("binary"), 256), 128, "0"))
    pad = lambda byte: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.lpad(F.hex(F.conv(F.substring(F.hex(key), i * 8 + 1, F.lit(8)), 16, 10).cast("long").bitwiseXOR(int.from_bytes(bytes([byte]) * 4, "big"))), 8, "0")), ""))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.col(user_id).cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def subject_ref_of(game_id: str, user_id: str, master: str) -> str:
    import hmac

    return hmac.new(hashlib.sha256(f"{master}:subject:{game_id}".encode()).digest(), user_id.encode(), hashlib.sha256).hexdigest()


def erased(rows: DataFrame, ledger: DataFrame, master: str) -> DataFrame:
    """rows without those of subjects in ledger (game_id, subject_ref). The pseudonym is worked out once a user."""
    users = rows.where("user_id IS NOT NULL").select("game_id", "user_id").distinct().withColumn("subject_ref", subject_ref("game_id", "user_id", master))
    gone = users.join(ledger, ["game_id", "subject_ref"], "left_semi").select("game_id", "user_id")
    return rows.join(gone, ["game_id", "user_id"], "left_anti")


#: Stands for the user of a purchase whose subject was erased.
ERASED = "__erased__"


def erase(tables: dict[str, DataFrame], subjects: DataFrame, purchases: str = "detach") -> dict[str, DataFrame]:
    """tables (name -> rows with game_id and user_id) without subjects (game_id, user_id), twice the same as once.

    Rows of a subject go. Those of the table named `purchases` keep their money and lose their user (detach), or go as
    well (delete). Counts by cell carry no user and stay as they are.
    """
    gone = subjects.select("game_id", "user_id").distinct()
    out = {name: rows.join(gone, ["game_id", "user_id"], "left_anti") for name, rows in tables.items() if name != "purchases" or purchases == "delete"}
    if "purchases" in tables and purchases != "delete":
        rows = tables["purchases"]
        marked = rows.join(gone.withColumn("__gone", F.lit(True)), ["game_id", "user_id"], "left")
        out["purchases"] = marked.withColumn("user_id", F.when(F.col("__gone"), F.lit(ERASED)).otherwise(F.col("user_id"))).select(*rows.columns)
    return out


def erasure_states(requests: DataFrame, days: DataFrame, as_of_ms: int, cfg: Config = DEFAULT) -> DataFrame:
    """requests (game_id, request_id, user_id, executed) with status, all_sealed and the number of days that hold the
    subject: executed ones stay executed; one with an unsealed day waits for its seal; the others are executed now.
    days: (game_id, user_id, day)."""
    sealed = timex.seal_state("day", F.lit(as_of_ms), cfg) == "sealed"
    held = days.select("game_id", "user_id", "day").distinct().groupBy("game_id", "user_id").agg(F.count(F.lit(1)).alias("n_days"), F.every(sealed).alias("all_sealed"))
    both = requests.join(held, ["game_id", "user_id"], "left").na.fill(0, ["n_days"]).withColumn("all_sealed", F.coalesce("all_sealed", F.lit(True)))
    return both.withColumn("status", F.when(F.col("executed") | F.col("all_sealed"), "executed").otherwise("awaiting_seal"))


def funnel(rows: DataFrame, steps: tuple[str, ...], window_ms: int) -> DataFrame:
    """Users by game who reach each step in order within window_ms of their first one, and the whole conversion.

    Each step's time is the first after the one before: one pass of small aggregates a step.
    """
    keys = ["game_id", "user_id"]
    at = rows.select(*keys, "name", F.col("corrected_time").alias("t"))
    reached = at.where(F.col("name") == steps[0]).groupBy(*keys).agg(F.min("t").alias("t1")).withColumn("last", F.col("t1"))
    out = reached.select("*", F.lit(1).alias("n"))
    for i, step in enumerate(steps[1:], 2):
        nxt = at.where(F.col("name") == step).join(out.where(F.col("n") == i - 1).select(*keys, "t1", "last"), keys).where((F.col("t") > F.col("last")) & (F.col("t") <= F.col("t1") + window_ms)).groupBy(*keys).agg(F.min("t").alias("next"))
        out = out.join(nxt, keys, "left").withColumn("n", F.when(F.col("next").isNotNull(), F.lit(i)).otherwise(F.col("n"))).withColumn("last", F.coalesce("next", "last")).drop("next")
    counts = [F.sum((F.col("n") >= i).cast("int")).alias(f"r{i}") for i in range(1, len(steps) + 1)]
    return out.groupBy("game_id").agg(*counts).withColumn("overall", F.col(f"r{len(steps)}") / F.col("r1"))


def funnel_steps(rows: DataFrame, steps: tuple[str, ...], window_ms: int) -> DataFrame:
    """funnel() step by step: game_id, step (from 1), name, reached, rate (of the step before), drop_off, median_ms (nearest
    rank of the time since the step before; read off running counts of distinct times)."""
    keys = ["game_id", "user_id"]
    at = rows.select(*keys, "name", F.col("corrected_time").alias("t"))
    here = at.where(F.col("name") == steps[0]).groupBy(*keys).agg(F.min("t").alias("t1")).withColumn("last", F.col("t1")).withColumn("took", F.lit(0).cast("long"))
    each = [here.select("game_id", F.lit(1).alias("step"), "took")]
    for i, step in enumerate(steps[1:], 2):
        later = at.where(F.col("name") == step).join(here.select(*keys, "t1", "last"), keys).where((F.col("t") > F.col("last")) & (F.col("t") <= F.col("t1") + window_ms))
        here = later.groupBy(*keys, "t1", "last").agg(F.min("t").alias("next")).select(*keys, "t1", F.col("next").alias("last"), (F.col("next") - F.col("last")).alias("took"))
        each.append(here.select("game_id", F.lit(i).alias("step"), "took"))
    times = each[0]
    for e in each[1:]:
        times = times.unionByName(e)
    by = ["game_id", "step"]
    took = times.groupBy(*by, "took").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(W.partitionBy(*by).orderBy("took").rowsBetween(W.unboundedPreceding, 0)))
    n = took.groupBy(*by).agg(F.sum("k").alias("reached"))
    median = took.join(n, by).where(2 * F.col("upto") >= F.col("reached")).groupBy(*by, "reached").agg(F.min("took").alias("median_ms"))
    grid = n.select("game_id").distinct().withColumn("step", F.explode(F.array(*[F.lit(i + 1) for i in range(len(steps))]))).withColumn("name", F.element_at(F.array(*map(F.lit, steps)), F.col("step")))
    out = grid.join(median, by, "left").na.fill(0, ["reached"])
    before = F.lag("reached").over(W.partitionBy("game_id").orderBy("step"))  # a row a step
    rate = F.when(F.col("step") == 1, 1.0).otherwise(F.try_divide(F.col("reached").cast("double"), before))
    return out.withColumn("rate", rate).withColumn("drop_off", 1 - F.col("rate")).select("game_id", "step", "name", "reached", "rate", "drop_off", F.when(F.col("step") > 1, F.col("median_ms")).alias("median_ms"))


def export(tables: dict[str, DataFrame], game_id: str, user_id: str) -> DataFrame:
    """All rows of tables (name -> rows with game_id and user_id) that belong to a subject: section and item (JSON text);
    an unknown subject has none."""
    out = None
    for name, rows in sorted(tables.items()):
        own = rows.where((F.col("game_id") == game_id) & (F.col("user_id") == user_id))
        part = own.select(F.lit(name).alias("section"), F.to_json(F.struct(*[c for c in rows.columns if c not in ("game_id", "user_id")])).alias("item"))
        out = part if out is None else out.unionByName(part)
    return out
