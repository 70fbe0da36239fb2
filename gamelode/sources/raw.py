"""Raw day files: append of what the front door let through, their object keys, checksums and shipment records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What a raw line keeps of an event: its envelope, properties already scrubbed.
LINE = ("game_id", "user_id", "anon_id", "event_id", "name", "kind", "client_event_time", "client_sent_time", "server_received_time", "processed_at", "provenance", "props")


def append_raw(routed: DataFrame, path: str) -> None:
    """Append routed rows to path/game_id=…/corrected_day=…/class=…: body for what is routed, quarantine for what was put
    aside; drops are not kept. Lines are gzipped JSON. Files are dealt by Spark's size advice, so a large game-day has
    several and small ones don't scatter."""
    rows = routed.where("disposition <> 'drop'")
    cls = F.when(F.col("disposition") == "route", "body").otherwise("quarantine")
    out = rows.select(F.to_json(F.struct(*[c for c in LINE if c in routed.columns])).alias("value"), "game_id", F.col("day").cast("string").alias("corrected_day"), cls.alias("class"))
    out.hint("rebalance", "game_id", "corrected_day", "class").write.mode("append").partitionBy("game_id", "corrected_day", "class").option("compression", "gzip").text(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """value (a JSON line), game_id, corrected_day, class; only the partitions that a filter names are listed."""
    return spark.read.schema("value string, game_id string, corrected_day string, class string").text(path)


def object_key(game: Column, day: Column) -> Column:
    """raw/{game}/{day}.rawlog; an error where either holds a path separator or two dots in a row."""
    bad = game.contains("/") | game.contains("..") | day.contains("/") | day.contains("..")
    return F.when(bad, F.raise_error(F.concat(F.lit("illegal object key for "), game, F.lit(" "), day))).otherwise(F.concat(F.lit("raw/"), game, F.lit("/"), day, F.lit(".rawlog")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a raw file: path, game_id, corrected_day, class, object_key, size and sha256 of its bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt.gz").load(path)
    part = lambda name: F.regexp_extract("path", rf"/{name}=([^/]*)/", 1)
    rows = files.select("path", part("game_id").alias("game_id"), part("corrected_day").alias("corrected_day"), part("class").alias("class"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return rows.withColumn("object_key", object_key(F.col("game_id"), F.col("corrected_day")))


def shipment(local: DataFrame, stored: DataFrame, sealed_before: Column) -> DataFrame:
    """What a shipment run does with each local file, given what the object store already holds (path, size, sha256):
    wait (day not sealed), ship (not stored yet), verified (stored alike: may be deleted locally), mismatch (stored
    otherwise: neither is touched)."""
    there = stored.select("path", F.col("size").alias("__size"), F.col("sha256").alias("__sha"))
    same = (F.col("size") == F.col("__size")) & (F.col("sha256") == F.col("__sha"))
    state = F.when(~(F.col("corrected_day") < sealed_before), "wait").when(F.col("__sha").isNull(), "ship").when(same, "verified").otherwise("mismatch")
    return local.join(there, "path", "left").select("path", "game_id", "corrected_day", "object_key", "size", "sha256", state.alias("state"))
