"""Event envelopes: reading batches of JSON, and a deterministic adapter over the driver's events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fields of one event on the wire; props is any JSON object and is kept as its text.
EVENT = "struct<user_id:string,anon_id:string,session_id:string,event_id:string,name:string,kind:string,client_event_time:bigint,client_sent_time:bigint,props:string,v:int>"


def read_batches(spark: SparkSession, path: str, credentials: DataFrame) -> DataFrame:
    """Events of files of JSON batches, one a line: {credential, server_received_time, processed_at, events: [...]}.

    credentials (credential, game_id, provenance) decides tenant and provenance; what a body says of them is dropped.
    Unknown credentials give no rows.
    """
    batches = spark.read.schema(f"credential string, server_received_time bigint, processed_at bigint, events array<{EVENT}>").json(path)
    rows = batches.join(credentials, "credential").select("game_id", "provenance", "server_received_time", "processed_at", F.explode("events").alias("e"))
    return rows.select("game_id", "provenance", "server_received_time", "processed_at", "e.*").withColumn("v", F.coalesce("v", F.lit(1)))


def decode_frames(spark: SparkSession, path: str) -> DataFrame:
    """payload (JSON text), truncated_tail of raw day files: frames of a magic `RAW1`, a big-endian length and a gzip
    member. A last frame that is cut off is left out and flagged; damage before the end is an error."""
    import gzip
    import struct

    import pyarrow as pa

    def frames(name: str, content: bytes) -> tuple[list[tuple[int, int]], bool]:
        """(first byte, end) of each whole frame's body, and whether the last frame is cut off."""
        at, found = 0, []
        while at < len(content):
            if len(content) - at < 8:
                return found, True
            magic, size = struct.unpack_from(">4sI", content, at)
            if magic != b"RAW1":
                raise ValueError(f"no frame at byte {at} of {name}")
            if at + 8 + size > len(content):
                return found, True
            found.append((at + 8, at + 8 + size))
            at += 8 + size
        return found, False

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, cut = frames(name, content)
                for i in range(0, len(found), 1024):
                    some = [gzip.decompress(content[s:e]).decode() for s, e in found[i : i + 1024]]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.string()), pa.array([cut] * len(some), pa.bool_())], names=["path", "payload", "truncated_tail"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, payload string, truncated_tail boolean")


def encode_frame(payload: str) -> bytes:
    import gzip
    import struct

    body = gzip.compress(payload.encode(), mtime=0)
    return struct.pack(">4sI", b"RAW1", len(body)) + body


#: The driver's events have one clock and no tenants; this text, run by either engine, adds what envelopes need.
ADAPTER = """
WITH base AS (
  SELECT event_id AS eid, user_id AS uid, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, {ms} AS t FROM events),
enr AS (
  SELECT *, CASE uid % 7 WHEN 1 THEN 300000 WHEN 2 THEN 30000 ELSE 0 END AS clock_err,
    CASE WHEN eid % 97 = 0 THEN 100800000 ELSE 5000 END AS send_lag,
    CASE WHEN eid % 89 = 0 THEN 259200000 ELSE 1000 END AS queue_lag,
    CASE event_type WHEN 'click' THEN 'economy' WHEN 'purchase' THEN 'purchase' WHEN 'signup' THEN 'session' ELSE event_type END AS typed_name,
    CAST(floor(value * 60000) AS BIGINT) AS len, CAST(ceil(value) AS BIGINT) AS whole, CAST(round(value * 100) AS BIGINT) AS cents
  FROM base),
attempts AS (
  SELECT *, CAST(0 AS BIGINT) AS resend_lag FROM enr
  UNION ALL
  SELECT *, CAST(CASE WHEN eid % 100 = 0 THEN 3600000 ELSE 90000000 END AS BIGINT) AS resend_lag FROM enr WHERE eid % 50 = 0
  UNION ALL
  SELECT *, CAST(0 AS BIGINT) AS resend_lag FROM enr WHERE eid % 125 = 0),
clocks AS (
  SELECT *, t + clock_err AS client_event_time, t + clock_err + send_lag + resend_lag AS client_sent_time,
    t + send_lag + resend_lag AS server_received_time, t + send_lag + resend_lag + queue_lag AS processed_at,
    CASE WHEN event_type = 'purchase' AND eid % 10 <> 9 THEN 'server' WHEN event_type = 'click' AND eid % 4 = 0 THEN 'server' ELSE 'client' END AS provenance
  FROM attempts),
main AS (
  SELECT 'g' || CAST(uid % 3 AS STRING) AS game_id,
    CASE WHEN eid % 101 = 0 THEN NULL ELSE 'u' || CAST(uid AS STRING) END AS user_id, 'a' || CAST(uid AS STRING) AS anon_id,
    'e' || CAST(eid AS STRING) AS event_id,
    CASE WHEN eid % 199 = 0 THEN '  ' ELSE typed_name END AS name,
    CASE WHEN eid % 211 = 0 AND event_type IN ('view', 'error') THEN 'telemetry' WHEN event_type IN ('view', 'error') THEN 'generic' ELSE typed_name END AS kind,
    client_event_time, client_sent_time, server_received_time, processed_at, provenance,
    CASE typed_name
      WHEN 'session' THEN '{{"session_id":"s' || CAST(eid AS STRING) || '","session_start_time":' || CAST(client_event_time - CASE WHEN eid % 37 = 0 THEN 54000000 ELSE len END AS STRING)
        || ',"session_end_time":' || CAST(CASE WHEN eid % 41 = 0 THEN client_sent_time + 60000 ELSE client_event_time END AS STRING)
        || ',"duration_ms":' || CAST(CASE WHEN eid % 47 = 0 THEN -1 ELSE len END AS STRING) || '}}'
      WHEN 'economy' THEN '{{"flow_type":"' || CASE WHEN eid % 2 = 0 THEN 'source' ELSE 'sink' END || '","currency_type":"'
        || CASE uid % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'gems' WHEN 2 THEN 'energy' ELSE 'tokens' END || '","amount":' || CAST(CASE WHEN eid % 53 = 0 THEN -whole ELSE whole END AS STRING)
        || ',"reason":"r' || CAST(k % 12 AS STRING) || '","player_level":' || CAST(k AS STRING)
        || CASE WHEN uid % 5 = 4 THEN '' ELSE ',"region":"z' || CAST(uid % 5 AS STRING) || '"' END
        || CASE WHEN eid % 3 = 0 THEN ',"balance_after":' || CAST(whole * 10 AS STRING) ELSE '' END || '}}'
      WHEN 'purchase' THEN CASE WHEN provenance = 'server' THEN '{{"source":"server","transaction_id":"t' || CAST(eid AS STRING) || '","original_transaction_id":"t' || CAST(eid AS STRING)
        || '","product_id":"p' || CAST(k % 8 AS STRING) || '","product_category":"c' || CAST(k % 3 AS STRING)
        || '","price_local":' || CAST(CAST(floor(cents / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST(cents % 100 AS STRING), 2, '0')
        || ',"currency":"' || CASE eid % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'IRR' ELSE 'JPY' END
        || '","verified":' || CASE WHEN eid % 31 <> 0 THEN 'true' ELSE 'false' END || ',"environment":"' || CASE WHEN eid % 29 = 0 THEN 'sandbox' ELSE 'prod' END
        || '","purchase_attempt_id":"pa' || CAST(eid AS STRING) || '"}}'
        ELSE '{{"source":"client","purchase_attempt_id":"po' || CAST(eid AS STRING) || '"}}' END
      ELSE '{{"k":' || CASE WHEN eid % 7 = 0 THEN '"' || CAST(k AS STRING) || '"' ELSE CAST(k AS STRING) END
        || CASE WHEN eid % 13 = 0 THEN ',"Email":"x","note":"to u' || CAST(uid AS STRING) || '@example.com"' ELSE '' END
        || CASE WHEN eid % 17 = 0 THEN ',"from":"10.0.0.' || CAST(k AS STRING) || '","ref":"1234567890"' ELSE '' END || '}}' END AS props
  FROM clocks),
late AS (
  SELECT *, CASE WHEN eid % 83 = 0 THEN 360000000 WHEN eid % 2 = 0 THEN -600000 ELSE 1200000 END AS d
  FROM clocks WHERE event_type = 'purchase' AND provenance = 'server' AND resend_lag = 0 AND eid % 3 <> 0)
SELECT * FROM main
UNION ALL
SELECT 'g' || CAST(uid % 3 AS STRING), CASE WHEN eid % 101 = 0 THEN NULL ELSE 'u' || CAST(uid AS STRING) END, 'a' || CAST(uid AS STRING), 'c' || CAST(eid AS STRING), 'purchase', 'purchase',
  client_event_time + d, client_sent_time + d, server_received_time + d, processed_at + d, 'client',
  '{{"source":"client","purchase_attempt_id":"pa' || CAST(eid AS STRING) || '","in_game_state":"st' || CAST(k % 4 AS STRING) || '","player_level":' || CAST(k AS STRING)
    || CASE WHEN uid % 5 = 4 THEN '' ELSE ',"region":"z' || CAST(uid % 5 AS STRING) || '"' END || '}}'
FROM late
"""
SPARK_MS = "unix_millis(CAST(ts AS TIMESTAMP))"
DUCK_MS = "(epoch_us(ts) // 1000)"


def adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes made of the driver's events."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    made = spark.sql(ADAPTER.format(ms=SPARK_MS))
    # each row's columns are made once, not anew wherever a query names them
    return made.select(F.inline(F.array(F.struct(*made.columns))))
