"""Sessions, user spine and retention over routed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import DEFAULT, Config
from ..functions import timex
from .kernel import computed, prop


def _ms(key: str):
    return F.coalesce(prop(key).cast("double").cast("long"), F.unix_millis(F.try_to_timestamp(prop(key))))


def sessions(r: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Counted session rows with their interval on the server's clock and trusted duration."""
    raw = computed(r.where("counted AND resolved_kind = 'session'"), raw_start=_ms("session_start_time"), raw_end=_ms("session_end_time"))
    start, end = timex.session_interval("raw_start", "raw_end", "client_sent_time", "server_received_time", cfg)
    out = computed(raw, start_ms=start, end0=end)
    out = computed(out, duration_ms=timex.session_duration("start_ms", "end0", cfg)).drop("end0")
    out = computed(out, end_ms=F.col("start_ms") + F.col("duration_ms"))
    return computed(out, start_day=timex.logical_day("start_ms", cfg), end_day=timex.logical_day("end_ms", cfg))


def session_days(s: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A row for each session and day it touches: the part on that day; an end day without overlap is left out."""
    d = s.withColumn("on_day", F.explode(F.array_distinct(F.array("start_day", "end_day"))))
    lo = timex.day_start_ms("on_day", cfg)
    part = F.greatest(F.lit(0).cast("long"), F.least("end_ms", lo + timex.DAY_MS) - F.greatest("start_ms", lo))
    return d.withColumn("part_ms", part).where("on_day = start_day OR part_ms > 0")


def session_day_result(s: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return session_days(s, cfg).groupBy("game_id", "on_day").agg(
        F.sum(F.when(F.col("on_day") == F.col("start_day"), 1).otherwise(0)).alias("session_count"), F.sum("part_ms").alias("duration_sum_ms"), F.count(F.lit(1)).alias("sessions_touching")
    )


def active_user_day(s: DataFrame) -> DataFrame:
    return s.where("provenance = 'client' AND user_id <> ''").select("game_id", F.col("start_day").alias("day"), "user_id").distinct()


def user_spine(s: DataFrame) -> DataFrame:
    """first_seen is the start of the client session that was processed first, not the earliest."""
    return s.where("provenance = 'client' AND user_id <> ''").groupBy("game_id", "user_id").agg(F.min_by("start_ms", F.struct("processed_at", "server_received_time", "event_id")).alias("first_seen_ms"))


def activity(s: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(game, user, cohort day, offset): set-once activity bits; negative offsets and those past the span are left out."""
    spine = user_spine(s).withColumn("cohort_date", timex.logical_day("first_seen_ms", cfg))
    days = active_user_day(s)
    out = days.join(spine, ["game_id", "user_id"]).withColumn("day_offset", F.date_diff("day", "cohort_date"))
    return out.where((F.col("day_offset") >= 0) & (F.col("day_offset") < cfg.span_days)).select("game_id", "user_id", "cohort_date", "day_offset").distinct()


def negative_offsets(s: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Sessions, by game and day of arrival, that start before the day their user was first seen: they set no bit."""
    spine = user_spine(s).withColumn("cohort_date", timex.logical_day("first_seen_ms", cfg))
    own = s.where("provenance = 'client' AND user_id <> ''").join(spine, ["game_id", "user_id"])
    return own.where(F.col("start_day") < F.col("cohort_date")).groupBy("game_id", "arrival_day").agg(F.count(F.lit(1)).alias("n"))


def cohorts(s: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return user_spine(s).groupBy("game_id", timex.logical_day("first_seen_ms", cfg).alias("cohort_date")).agg(F.count(F.lit(1)).alias("cohort_size"))


def retention_cells(s: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return activity(s, cfg).groupBy("game_id", "cohort_date", "day_offset").agg(F.count(F.lit(1)).alias("retained_users"))


def headline(s: DataFrame, as_of: str, cfg: Config = DEFAULT) -> DataFrame:
    """Retention by target day over cohorts old enough; null where there is none."""
    size = cohorts(s, cfg).withColumn("target", F.explode(F.array(*[F.lit(t) for t in cfg.retention_targets]))).where(F.date_diff(F.lit(as_of).cast("date"), "cohort_date") >= F.col("target"))
    cell = retention_cells(s, cfg).withColumnRenamed("day_offset", "target")
    both = size.join(cell, ["game_id", "cohort_date", "target"], "left").groupBy("game_id", "target")
    return both.agg(F.sum("cohort_size").alias("users"), F.coalesce(F.sum("retained_users"), F.lit(0)).alias("retained")).withColumn("rate", F.try_divide(F.col("retained"), F.col("users")))


def heatmap(s: DataFrame, as_of: str, cfg: Config = DEFAULT) -> DataFrame:
    """The cohort triangle with offset 0 and the targets; rate is null where immature. provisional: the cell's day is not
    sealed when the day as_of begins."""
    grid = cohorts(s, cfg).withColumn("day_offset", F.explode(F.array(F.lit(0), *[F.lit(t) for t in cfg.retention_targets])))
    out = grid.join(retention_cells(s, cfg), ["game_id", "cohort_date", "day_offset"], "left")
    mature = F.date_diff(F.lit(as_of).cast("date"), "cohort_date") >= F.col("day_offset")
    kept = F.when(mature, F.coalesce("retained_users", F.lit(0))).otherwise(0)
    return out.select("game_id", "cohort_date", "day_offset", "cohort_size", kept.cast("long").alias("retained"), F.when(mature, F.try_divide(kept.cast("double"), F.col("cohort_size"))).alias("rate"), (F.col("cohort_size") < cfg.retention_low_size).alias("low_confidence"),
                      (timex.seal_state(F.expr("date_add(cohort_date, day_offset)"), timex.day_start_ms(F.lit(as_of).cast("date"), cfg), cfg) != "sealed").alias("provisional"))


def average_by_day(s: DataFrame, first: str, last: str, cfg: Config = DEFAULT) -> DataFrame:
    """Average session length by game for every day from first to last: 0 where no session touches it."""
    got = session_day_result(s, cfg).select("game_id", F.col("on_day").alias("day"), "duration_sum_ms", "sessions_touching")
    days = s.select("game_id").distinct().withColumn("day", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))))
    return days.join(got, ["game_id", "day"], "left").select("game_id", "day", F.coalesce(F.try_divide(F.col("duration_sum_ms").cast("double"), F.col("sessions_touching")), F.lit(0.0)).alias("average_ms"))


def ztest(s: DataFrame, target: int, cfg: Config = DEFAULT) -> DataFrame:
    """Two-proportion z-test of each cohort against the game's next one at one offset; pooled error."""
    size = cohorts(s, cfg).join(retention_cells(s, cfg).where(F.col("day_offset") == target), ["game_id", "cohort_date"], "left").withColumn("x", F.coalesce("retained_users", F.lit(0)))
    w = W.partitionBy("game_id").orderBy("cohort_date")
    pair = size.withColumn("n2", F.lead("cohort_size").over(w)).withColumn("x2", F.lead("x").over(w)).where("n2 IS NOT NULL")
    p = (F.col("x") + F.col("x2")) / (F.col("cohort_size") + F.col("n2"))
    se = F.sqrt(p * (1 - p) * (1 / F.col("cohort_size") + 1 / F.col("n2")))
    z = F.when(se == 0, 0.0).otherwise((F.col("x") / F.col("cohort_size") - F.col("x2") / F.col("n2")) / F.when(se == 0, 1.0).otherwise(se))
    return pair.select("game_id", "cohort_date", z.alias("z"), (F.abs(z) > 1.96).alias("significant"))


def sessionize(events: DataFrame, gap_ms: int) -> DataFrame:
    """Client sessions from bare activity (user_id, t): a gap of gap_ms or more starts a new one; it ends with its last activity."""
    w = W.partitionBy("user_id").orderBy("t")
    new = F.when(F.col("t") - F.lag("t").over(w) >= gap_ms, 1).otherwise(0)
    return events.withColumn("n", new).withColumn("session_no", F.sum("n").over(w.rangeBetween(W.unboundedPreceding, 0))).groupBy("user_id", "session_no").agg(F.min("t").alias("start_ms"), F.max("t").alias("end_ms"), F.count(F.lit(1)).alias("n_events"))
