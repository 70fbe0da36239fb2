"""Verified purchases: conversion by the last known rate, payer state, context, cells, KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import DEFAULT, Config
from ..functions import timex
from .economy import level_bucket
from .kernel import ARRIVAL, NUMBER, capped, is_number, prop

CLIENT_DIMS = ("in_game_state", "level_bucket", "region")


def purchases(r: DataFrame) -> DataFrame:
    """Money rows: one for each transaction, with price and currency."""
    return r.where("counted AND money").select(
        "game_id", F.coalesce(prop("user_id"), F.col("user_id")).alias("user_id"), "event_id", *ARRIVAL[:2], "corrected_time", "day", "provenance", prop("transaction_id").alias("transaction_id"), prop("product_id").alias("product_id"),
        prop("product_category").alias("product_category"), prop("price_local").cast("decimal(12,2)").alias("price_local"), prop("currency").alias("currency"), prop("purchase_attempt_id").alias("attempt_id"),
    )


def rate_spans(fx: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """fx (currency, rate_date, rate) with until: the last day each rate is valid for, by age and by the next rate."""
    nxt = F.lead("rate_date").over(W.partitionBy("currency").orderBy("rate_date"))
    until = F.least(F.date_add("rate_date", cfg.fx_max_age_days), F.coalesce(F.date_sub(nxt, 1), F.lit("9999-12-31").cast("date")))
    return fx.withColumn("until", until)


def converted(p: DataFrame, fx: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """p with rate, rate_date, fx_state (fresh, carried, parked) and normalized (parked: 0).

    An as-of join as an equi-join: each rate is laid out on the days it holds for, at most fx_max_age_days + 1 of them.
    """
    days = rate_spans(fx, cfg).select(F.col("currency").alias("__c"), "rate", "rate_date", F.explode(F.sequence("rate_date", "until")).alias("__d"))
    out = p.join(days, (F.col("currency") == F.col("__c")) & (F.col("day") == F.col("__d")), "left").drop("__c", "__d")
    state = F.when(F.col("rate").isNull(), "parked").when(F.col("rate_date") == F.col("day"), "fresh").otherwise("carried")
    return out.withColumn("fx_state", state).withColumn("normalized", F.coalesce(F.round(F.col("price_local") * F.col("rate"), 6).cast("decimal(24,6)"), F.lit(0).cast("decimal(24,6)")))


def payer_tier(c: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    w = W.partitionBy("game_id", "user_id").orderBy(*ARRIVAL).rowsBetween(W.unboundedPreceding, -1)
    spent, parked, n = F.sum("normalized").over(w), F.max((F.col("fx_state") == "parked").cast("int")).over(w), F.count(F.lit(1)).over(w)
    tier = F.when(n == 0, "first").when(parked == 1, "indeterminate").when(spent >= cfg.whale_spend, "whale").when(spent >= cfg.dolphin_spend, "dolphin").otherwise("minnow")
    return c.withColumn("payer_tier", tier)


def fx_table(table: Column) -> Column:
    """array<struct<currency, rate_date, rate>> of an operator's table {currency: {date: rate}} as JSON text; what is no
    number, and dates not written yyyy-mm-dd or that don't exist, are left out. Anything but an object gives none."""
    each = F.map_entries(F.from_json(table, "map<string,variant>"))
    dates = lambda v: F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    rows = F.flatten(F.transform(each, lambda c: F.coalesce(F.transform(dates(c["value"]), lambda d: F.struct(
        c["key"].alias("currency"), F.when(d["key"].rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(d["key"], F.lit("yyyy-MM-dd")))).alias("rate_date"),
        F.when(F.schema_of_variant(d["value"]).rlike(NUMBER), F.try_variant_get(d["value"], "$", "decimal(16,10)")).alias("rate"))), F.array())))
    return F.coalesce(F.filter(rows, lambda r: r["rate_date"].isNotNull() & r["rate"].isNotNull()), F.array())


def server_dims(c: DataFrame, spine: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """c with install_cohort (day first seen) and days_since_install, as text: `unknown` for users never seen in a session.

    spine: user_spine's (game_id, user_id, first_seen_ms)."""
    seen = spine.select("game_id", "user_id", timex.logical_day("first_seen_ms", cfg).alias("__first"))
    out = c.join(seen, ["game_id", "user_id"], "left")
    known = lambda x: F.coalesce(x.cast("string"), F.lit("unknown"))
    return out.withColumn("install_cohort", known(F.col("__first"))).withColumn("days_since_install", known(F.date_diff("day", "__first"))).drop("__first")


def companions(r: DataFrame) -> DataFrame:
    return r.where("counted AND resolved_kind = 'purchase'").where(prop("source") == "client").select(
        "game_id", prop("purchase_attempt_id").alias("attempt_id"), F.col("server_received_time").alias("c_recv"), F.col("processed_at").alias("c_at"), F.col("event_id").alias("c_event"), prop("region").alias("region"), prop("in_game_state").alias("in_game_state"),
        level_bucket(F.when(is_number("player_level"), F.floor(prop("player_level").cast("double")))).alias("level_bucket"),
    )


def enriched(c: DataFrame, r: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """c with the client's context of the same attempt, whichever came first, within the staging time and before the
    purchase's day was sealed; unknown where none came. The last non-null value of each dimension counts."""
    comp = companions(r)
    near = comp.join(c.select("game_id", "attempt_id", F.col("server_received_time").alias("s_recv"), F.col("day").alias("s_day"), "transaction_id"), ["game_id", "attempt_id"])
    seal = (F.unix_date("s_day").cast("long") + 1) * 86_400_000 - cfg.reporting_offset_min * 60_000 + cfg.seal_grace_ms
    near = near.where((F.abs(F.col("c_recv") - F.col("s_recv")) <= cfg.staging_ms) & (F.col("c_at") < seal))
    order = F.struct("c_at", "c_recv", "c_event")
    dims = near.groupBy("transaction_id").agg(*[F.max_by(d, F.when(F.col(d).isNotNull(), order)).alias(d) for d in CLIENT_DIMS])
    out = c.join(dims, "transaction_id", "left")
    out = out.withColumns({d: F.coalesce(d, F.lit("unknown")) for d in CLIENT_DIMS})
    return out


def capped_dims(e: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    for d in ("in_game_state", "region"):
        e = capped(e.withColumnRenamed(d, f"raw_{d}"), cfg.dimension_cap, f"raw_{d}", d, ["game_id"], ~F.col(f"raw_{d}").isin("", "unknown", "other"))
    return e


def dim_combo(dims: dict[str, Column]) -> Column:
    """`name=value` of the dimensions in order of name, joined by bars; backslash, bar and equals sign are escaped."""
    esc = lambda c: F.regexp_replace(F.coalesce(c, F.lit("unknown")), r"([\\|=])", r"\\$1")
    return F.concat_ws("|", *[F.concat(F.lit(f"{k}="), esc(dims[k])) for k in sorted(dims)])


def parse_combo(combo: Column) -> Column:
    """map of a dim_combo."""
    parts = F.regexp_extract_all(combo, F.lit(r"((?:[^\\|]|\\.)+)"), 1)
    plain = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    pair = lambda p: F.struct(plain(F.regexp_extract(p, r"^((?:[^\\=]|\\.)*)=", 1)).alias("key"), plain(F.regexp_extract(p, r"^(?:[^\\=]|\\.)*=(.*)$", 1)).alias("value"))
    return F.map_from_entries(F.transform(parts, pair))


def cells(e: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    combo = dim_combo({d: F.col(d) for d in cfg.active_dims})
    return e.withColumn("dim_combo", combo).groupBy("game_id", "product_id", "dim_combo", "day").agg(F.count(F.lit(1)).alias("purchase_count"), F.sum("normalized").alias("revenue"), F.min("product_category").alias("product_category"))


def payer_spine(c: DataFrame) -> DataFrame:
    return c.where("user_id <> ''").groupBy("game_id", "user_id").agg(F.min_by("day", F.struct(*ARRIVAL)).alias("first_purchase_day"), F.sum("normalized").alias("lifetime_spend"), F.max(F.col("fx_state") == "parked").alias("has_unconverted"))


def payer_period(c: DataFrame) -> DataFrame:
    return c.where("user_id <> ''").groupBy("game_id", F.date_format("day", "yyyy-MM").alias("period"), "user_id").agg(F.sum("normalized").alias("spend"))


def payer_day(c: DataFrame) -> DataFrame:
    return c.groupBy("game_id", "day").agg(F.count_distinct(F.when(F.col("user_id") != "", F.col("user_id"))).alias("payers"), F.sum("normalized").alias("revenue"))


def top_package(e: DataFrame, dim: str, measure: str = "revenue") -> DataFrame:
    """By value of a dimension the product with the greatest revenue or count (`n`), ties to the lesser name."""
    s = e.groupBy("game_id", dim, "product_id").agg(F.sum("normalized").alias("revenue"), F.count(F.lit(1)).alias("n"))
    return s.withColumn("r", F.row_number().over(W.partitionBy("game_id", dim).orderBy(F.desc(measure), "product_id"))).where("r = 1").drop("r")


def local_sums(e: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """What cells took in each currency, before conversion: a later rate is applied to these."""
    combo = dim_combo({d: F.col(d) for d in cfg.active_dims})
    return e.withColumn("dim_combo", combo).groupBy("game_id", "product_id", "dim_combo", "day", "currency").agg(F.sum("price_local").alias("local"))


def context_coverage(e: DataFrame) -> DataFrame:
    """Share of revenue with a known value, by client dimension; null without revenue."""
    long = e.select("game_id", "normalized", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in CLIENT_DIMS])).alias("d"))
    unknown = F.coalesce(F.sum(F.when(F.col("d.value") == "unknown", F.col("normalized"))), F.lit(0)).cast("double")
    return long.groupBy("game_id", F.col("d.dim").alias("dim")).agg((1 - F.try_divide(unknown, F.sum("normalized").cast("double"))).alias("coverage"))


def active_users(act: DataFrame) -> DataFrame:
    """DAU, WAU, MAU and stickiness by day; trailing windows not yet full are null. act: distinct (game, day, user).

    An activity makes its user count from its day on until the window ends or the next activity takes over: one more on
    the first of these days, one less on the day after the last. Running sums of the changes by day are the counts.
    """
    after = F.lead("day").over(W.partitionBy("game_id", "user_id").orderBy("day"))
    own = act.withColumn("next", after)
    moves = []
    for n, c in ((1, "dau"), (7, "wau"), (30, "mau")):
        moves += [F.struct(F.col("day").alias("on"), F.lit(c).alias("c"), F.lit(1).alias("k")), F.struct(F.least(F.date_add("day", n), "next").alias("on"), F.lit(c).alias("c"), F.lit(-1).alias("k"))]
    change = own.select("game_id", F.explode(F.array(*moves)).alias("m")).groupBy("game_id", F.col("m.on").alias("on"))
    change = change.agg(*[F.sum(F.when(F.col("m.c") == c, F.col("m.k")).otherwise(0)).alias(c) for c in ("dau", "wau", "mau")])
    span = act.groupBy("game_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = span.select("game_id", "lo", F.explode(F.sequence("lo", "hi")).alias("on"))
    w = W.partitionBy("game_id").orderBy("on").rowsBetween(W.unboundedPreceding, 0)  # a row a day
    d = days.join(change, ["game_id", "on"], "left").na.fill(0, ["dau", "wau", "mau"])
    d = d.select("game_id", "lo", "on", *[F.sum(c).over(w).alias(c) for c in ("dau", "wau", "mau")]).where("mau > 0")
    full = lambda n, c: F.when(F.date_diff("on", "lo") >= n - 1, F.col(c))
    return d.select("game_id", F.col("on").alias("day"), "dau", full(7, "wau").alias("wau"), full(30, "mau").alias("mau"), F.try_divide(F.col("dau").cast("double"), full(30, "mau")).alias("stickiness"))


def revenue_kpis(c: DataFrame, act: DataFrame) -> DataFrame:
    dau = act.groupBy("game_id", "day").agg(F.count(F.lit(1)).alias("dau"))
    d = payer_day(c).join(dau, ["game_id", "day"], "full").na.fill(0, ["payers", "dau"]).withColumn("rev", F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)))
    return d.select("game_id", "day", "dau", "payers", "rev", F.try_divide("rev", "dau").alias("arpu"), F.try_divide("rev", "payers").alias("arppu"), F.try_divide(F.col("payers").cast("double"), F.col("dau")).alias("conversion"))


def whale(c: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Share of the period's spend by its top 1, 5 and 10 % of payers, ceil(p n / 100) of them.

    Payers are counted by what they spent first; of the amount at which the top ends as many count as are wanted.
    Payers with a purchase that no rate converts yet may stand too low: indeterminate says how many there are."""
    keys = ["game_id", "period"]
    parked = F.col("fx_state") == "parked" if "fx_state" in c.columns else F.lit(False)
    open_ = c.where((F.col("user_id") != "") & parked).groupBy("game_id", F.date_format("day", "yyyy-MM").alias("period")).agg(F.count_distinct("user_id").alias("indeterminate"))
    at = payer_period(c).groupBy(*keys, "spend").agg(F.count(F.lit(1)).alias("k"))
    w = W.partitionBy(*keys).orderBy(F.desc("spend")).rowsBetween(W.unboundedPreceding, -1)
    at = at.withColumn("above", F.coalesce(F.sum("k").over(w), F.lit(0)))
    total = at.groupBy(*keys).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("spend")).alias("total"))
    wanted = total.withColumn("pct", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10)))).withColumn("want", F.ceil(F.col("pct") * F.col("n") / 100))
    some = at.join(wanted, keys).where("above < want")
    out = some.groupBy(*keys, "pct", "n", "total").agg(F.sum(F.least(F.col("k"), F.col("want") - F.col("above")) * F.col("spend")).alias("top")).join(open_, keys, "left")
    return out.select(*keys, "pct", "n", F.try_divide(F.col("top").cast("double"), F.col("total").cast("double")).alias("share"), (F.col("n") < cfg.whale_low_size).alias("low_confidence"), F.coalesce("indeterminate", F.lit(0)).alias("indeterminate"))


def reconcile(cell_rows: DataFrame, c: DataFrame) -> DataFrame:
    """Cells' revenue against that derived from transactions, by game and day, and whether the gap must be booked."""
    a = cell_rows.groupBy("game_id", "day").agg(F.sum("revenue").alias("booked"))
    b = c.groupBy("game_id", "day").agg(F.sum("normalized").alias("derived"))
    both = a.join(b, ["game_id", "day"], "full").select("game_id", "day", F.coalesce(F.col("booked").cast("double"), F.lit(0.0)).alias("booked"), F.coalesce(F.col("derived").cast("double"), F.lit(0.0)).alias("derived"))
    return both.withColumn("correction", F.when(F.abs(F.col("derived") - F.col("booked")) > F.greatest(F.lit(1e-6), F.abs(F.col("derived")) * 1e-9), F.col("derived") - F.col("booked")).otherwise(0.0))


def booked(cell_rows: DataFrame, c: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """cells with each game-day's correction booked into the cell whose product and dimensions are unknown: then the
    cells' revenue is what the transactions give. Booking again changes nothing."""
    combo = dim_combo({d: F.lit(None).cast("string") for d in cfg.active_dims})
    gaps = reconcile(cell_rows, c).where("correction <> 0")
    fix = gaps.select("game_id", F.lit("unknown").alias("product_id"), combo.alias("dim_combo"), "day", F.lit(0).cast("long").alias("purchase_count"), F.round("correction", 6).cast("decimal(24,6)").alias("revenue"), F.lit("reconciliation").alias("product_category"))
    both = cell_rows.select(*fix.columns).unionByName(fix)
    return both.groupBy("game_id", "product_id", "dim_combo", "day").agg(F.sum("purchase_count").alias("purchase_count"), F.sum("revenue").alias("revenue"), F.min("product_category").alias("product_category"))
