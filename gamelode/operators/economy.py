"""Virtual economy over routed rows: flows, segments, balances, money supply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import DEFAULT, Config
from .kernel import capped, computed, is_number, prop

def order() -> Column:
    return F.struct("corrected_time", "server_received_time", "event_id")


def level_bucket(level: Column, bounds=DEFAULT.level_buckets) -> Column:
    out = F.when(level < bounds[0], F.lit(f"<{bounds[0]}"))
    for lo, hi in zip(bounds, bounds[1:]):
        out = out.when((level >= lo) & (level < hi), F.lit(f"{lo}-{hi - 1}"))
    return out.when(level >= bounds[-1], F.lit(f"{bounds[-1]}+"))


def flows(r: DataFrame, cfg: Config = DEFAULT, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Counted economy rows: currency (capped a game), flow_type, amount (truncated), reason, level, region, balance."""
    e = r.where("counted AND resolved_kind = 'economy'")
    cols = {"raw_currency": prop("currency_type"), "flow_type": prop("flow_type"), "amount": prop("amount").cast("double").cast("long"), "flow_reason": prop("reason"),
            "level": F.when(is_number("player_level"), F.floor(prop("player_level").cast("double"))), "region": prop("region"),
            "balance": F.when(is_number("balance_after") & (prop("balance_after").cast("double") >= 0), prop("balance_after").cast("double").cast("long"))}
    e = computed(e, **cols)
    if allowed:
        e = e.where(F.col("raw_currency").isin(*allowed))
    return capped(e, cfg.currency_cap, "raw_currency", "currency", ["game_id"], F.lit(True))


def flow_cells(f: DataFrame) -> DataFrame:
    return f.groupBy("game_id", "currency", "day", "provenance", "flow_reason", "flow_type").agg(F.sum("amount").alias("amount_sum"), F.count(F.lit(1)).alias("event_count"))


def segment_cells(f: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Each axis on its own, never crossed; a row without a value on an axis has no cell there."""
    axes = F.array(F.struct(F.lit("level_bucket").alias("dim"), level_bucket(F.col("level"), cfg.level_buckets).alias("value")), F.struct(F.lit("region").alias("dim"), F.col("region").alias("value")))
    s = f.withColumn("s", F.explode(axes)).where("s.value IS NOT NULL").withColumn("segment_dim", F.col("s.dim")).withColumn("segment_value", F.col("s.value"))
    return s.groupBy("game_id", "currency", "day", "flow_type", "segment_dim", "segment_value").agg(F.sum("amount").alias("amount_sum"), F.count(F.lit(1)).alias("event_count"))


def day_view(cells: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    side = lambda t, c: F.coalesce(F.sum(F.when(F.col("flow_type") == t, F.col(c))), F.lit(0))
    d = cells.groupBy(*keys).agg(side("source", "amount_sum").alias("source"), side("sink", "amount_sum").alias("sink"), side("source", "event_count").alias("source_n"), side("sink", "event_count").alias("sink_n"))
    return d.select(*keys, "source", "sink", (F.col("source") - F.col("sink")).alias("net"), F.try_divide("sink", "source").alias("ratio"), F.try_divide("sink", F.col("source") + F.col("sink")).alias("bounded_ratio"),
                    ((F.col("source_n") < cfg.economy_low_count) | (F.col("sink_n") < cfg.economy_low_count)).alias("low_volume"))


def top_reasons(cells: DataFrame, n: int = 3) -> DataFrame:
    s = cells.groupBy("game_id", "currency", "day", "flow_type", "flow_reason").agg(F.sum("amount_sum").alias("amount"))
    rank = F.row_number().over(W.partitionBy("game_id", "currency", "day", "flow_type").orderBy(F.desc("amount"), "flow_reason"))
    return s.withColumn("rank", rank).where(F.col("rank") <= n)


def balances(f: DataFrame) -> DataFrame:
    """Last known balance by (game, user, currency): latest corrected time, ties to receipt, then event id."""
    return f.where("user_id <> '' AND balance IS NOT NULL").groupBy("game_id", "user_id", "currency").agg(F.max_by(F.struct("balance", "provenance", "corrected_time"), order()).alias("v")).select("game_id", "user_id", "currency", F.col("v.balance").alias("balance"), F.col("v.provenance").alias("provenance"), F.col("v.corrected_time").alias("as_of_ms"))


def money_supply(b: DataFrame) -> DataFrame:
    """Supply, holders, nearest-rank p50 and p90 and what servers vouch for, by game and currency.

    Holders are counted by balance first, so that percentiles are read off running counts of distinct balances."""
    keys = ["game_id", "currency"]
    at = b.groupBy(*keys, "balance").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("provenance") == "server", 1)).alias("trusted"))
    w = W.partitionBy(*keys).orderBy("balance")
    at = at.withColumn("upto", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    total = at.groupBy(*keys).agg(F.sum(F.col("n") * F.col("balance")).alias("money_supply"), F.sum("n").alias("n_users"), F.sum(F.col("trusted") * F.col("balance")).alias("trusted_supply"))
    p = lambda x: F.min(F.when(F.col("upto") >= F.ceil(F.col("n_users") * x / 100), F.col("balance")))
    ranks = at.join(total, keys).groupBy(*keys).agg(p(50).alias("p50"), p(90).alias("p90"))
    return total.join(ranks, keys).select(*keys, "money_supply", "n_users", "p50", "p90", "trusted_supply")


def supply_trend(f: DataFrame) -> DataFrame:
    """By day: supply measured from balances known by then, net flow so far, and how far apart they are."""
    net = f.groupBy("game_id", "currency", "day").agg(F.sum(F.when(F.col("flow_type") == "source", F.col("amount")).otherwise(-F.col("amount"))).alias("net"))
    last = f.where("user_id <> '' AND balance IS NOT NULL").groupBy("game_id", "currency", "user_id", "day").agg(F.max_by("balance", order()).alias("balance"))
    before = F.lag("balance", 1, 0).over(W.partitionBy("game_id", "currency", "user_id").orderBy("day"))
    step = last.withColumn("change", F.col("balance") - before).groupBy("game_id", "currency", "day").agg(F.sum("change").alias("change"))
    w = W.partitionBy("game_id", "currency").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    both = net.join(step, ["game_id", "currency", "day"], "full").na.fill(0, ["net", "change"])
    out = both.withColumn("net_flow", F.sum("net").over(w)).withColumn("supply", F.sum("change").over(w))
    return out.select("game_id", "currency", "day", "supply", "net_flow", (F.col("supply") - F.col("net_flow")).alias("divergence"))
