"""Rollups kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..config import DEFAULT, Config
from ..functions import timex
from ..operators import kernel
from ..sources.envelopes import EVENT

WIRE = "game_id string, provenance string, server_received_time bigint, processed_at bigint, " + EVENT.removeprefix("struct<").removesuffix(">").replace(":", " ")


def read_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Envelopes, one JSON object a line, from files as they come; files_at_once bounds a batch."""
    return spark.readStream.schema(WIRE).option("maxFilesPerTrigger", files_at_once).json(path)


def verdicts(stream: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The stateless verdicts: properties scrubbed, times, route, seal, reason. Late rows are marked, not dropped."""
    df = kernel.computed(kernel.with_route(kernel.with_times(stream, cfg)), seal=timex.seal_state("day", "processed_at", cfg))
    return kernel.computed(df, reason=F.coalesce("early_reason", F.when(F.col("seal") == "sealed", "sealed_late"))).drop("fields")


def first_claims(routed: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Repeats of an event id within the dedup window go; the state of an id leaves with the watermark."""
    at = routed.where("reason IS NULL").withColumn("arrived", F.timestamp_millis("processed_at"))
    return at.withWatermark("arrived", f"{cfg.dedup_window_ms} milliseconds").dropDuplicatesWithinWatermark(["game_id", "event_id"])


def live_sessions(events: DataFrame, cfg: Config = DEFAULT, late: str = "1 hour") -> DataFrame:
    """Sessions of (user_id, t in ms) as they close: a gap of session_gap_ms or more starts a new one, as in batch.

    Spark's windows still join events that lie exactly their gap apart, so the gap is a millisecond less."""
    at = events.select("user_id", "t", F.timestamp_millis("t").alias("at")).withWatermark("at", late)
    window = F.session_window("at", f"{cfg.session_gap_ms - 1} milliseconds")
    return at.groupBy("user_id", window).agg(F.min("t").alias("start_ms"), F.max("t").alias("end_ms"), F.count(F.lit(1)).alias("n_events")).drop("session_window")


def provisional(rollup: DataFrame, as_of_ms: int, cfg: Config = DEFAULT, day: str = "day") -> DataFrame:
    """rollup with provisional: whether its day may still change, for it isn't sealed."""
    return rollup.withColumn("provisional", timex.seal_state(day, F.lit(as_of_ms), cfg) != "sealed")


def _before(spark: SparkSession, path: str, schema: str, number: int) -> DataFrame:
    """What batches before this one have written."""
    try:
        return spark.read.schema(f"{schema}, batch bigint").parquet(path).where(F.col("batch") < number).drop("batch")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _bucketed(batch: DataFrame, names: str, number: int, cfg: Config) -> DataFrame:
    """batch with bucket_name: the first name_cap generic names of a game in order of arrival over all batches, else other."""
    schema = "game_id string, name string"
    known = _before(batch.sparkSession, names, schema, number)
    generic = batch.where("resolved_kind = 'generic'")
    fresh = generic.groupBy("game_id", "name").agg(F.min(F.struct(*kernel.ARRIVAL)).alias("first")).join(known, ["game_id", "name"], "left_anti")
    had = known.groupBy("game_id").agg(F.count(F.lit(1)).alias("had"))
    nth = F.row_number().over(W.partitionBy("game_id").orderBy("first", "name"))
    new = fresh.withColumn("nth", nth).join(had, "game_id", "left").where(F.col("nth") + F.coalesce("had", F.lit(0)) <= cfg.name_cap)
    new.select("game_id", "name").write.mode("overwrite").parquet(f"{names}/batch={number}")
    kept = known.unionByName(batch.sparkSession.read.schema(schema).parquet(f"{names}/batch={number}")).withColumn("kept", F.lit(True))
    bucket = F.when((F.col("resolved_kind") != "generic") | F.col("kept"), F.col("name")).otherwise("other")
    return batch.join(kept, ["game_id", "name"], "left").withColumn("bucket_name", bucket).drop("kept")


def _counted_money(batch: DataFrame, paid: str, number: int) -> DataFrame:
    """batch without purchases whose transaction was counted before, in this batch or an earlier one."""
    tx = F.when(kernel.eligible(), kernel.prop("transaction_id"))
    rows = batch.withColumn("__tx", tx)
    money = rows.where("__tx IS NOT NULL").withColumn("__n", F.row_number().over(W.partitionBy("__tx").orderBy(*kernel.ARRIVAL))).where("__n = 1").drop("__n")
    money = money.join(_before(batch.sparkSession, paid, "__tx string", number), "__tx", "left_anti").select(*rows.columns)
    money.select("__tx").write.mode("overwrite").parquet(f"{paid}/batch={number}")
    return rows.where("__tx IS NULL").unionByName(money).drop("__tx")


def totals(spark: SparkSession, target: str) -> DataFrame:
    """Counts by (game, bucket, day) over all batches written so far."""
    return spark.read.parquet(target).groupBy("game_id", "bucket_name", "day").agg(F.sum("n").alias("n"))


def day_counts(spark: SparkSession, path: str, target: str, quarantine: str, checkpoint: str, cfg: Config = DEFAULT, every: str | None = None):
    """Two queries that keep counts of events by (game, capped name, day) in target and rows put aside in quarantine.

    Each batch is written under its own number, replaced if it comes again, and looks only at what earlier numbers left;
    totals() sums them. The names and the transactions counted lie beside the checkpoint. every: how often a batch is
    started (`300 seconds`); None takes what is there and ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            rows = _counted_money(_bucketed(batch, f"{checkpoint}/names", number, cfg), f"{checkpoint}/paid", number)
            rows.groupBy("game_id", "bucket_name", "day").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{target}/batch={number}")
        finally:
            batch.unpersist()

    def aside(batch: DataFrame, number: int) -> None:
        batch.where("reason IS NOT NULL").select("game_id", "event_id", "reason", "arrival_day").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")

    seen = verdicts(read_stream(spark, path), cfg)
    when = {"processingTime": every} if every else {"availableNow": True}
    return (
        first_claims(seen, cfg).writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/counts").trigger(**when).start(),
        seen.writeStream.foreachBatch(aside).option("checkpointLocation", f"{checkpoint}/aside").trigger(**when).start(),
    )
