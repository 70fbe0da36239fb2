"""One query for each operator over the driver's tables, and its oracle. Days come as text, amounts as doubles."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..config import Config
from ..functions import periods, timex
from ..operators import economy as ECO, kernel as K, monetization as M, privacy, sessions as S
from ..operators.merge import upsert
from ..sources import envelopes, raw
from ..sources.store import fresh_folder, materialised
from . import oracle as O
from .kinds import dispatch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Small caps, so that the driver's few names, currencies and values overflow.
CFG = Config(name_cap=1, currency_cap=3, dimension_cap=3)
AS_OF, AS_OF_MS = "2024-01-31", 1706659200000


def shaped(df: DataFrame) -> DataFrame:
    """Dates as text, whole numbers as long, the others as doubles of six places."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "date":
            c = c.cast("string")
        elif kind in ("int", "smallint", "tinyint") or kind.startswith("decimal") and kind.endswith(",0)"):
            c = c.cast("long")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.floor(c.cast("double") * 1e6 + 0.5) / 1e6
        out.append(c.alias(name))
    return df.select(*out)


class Tables:
    """What the queries share: the routed rows and what the stories start from, each materialised when first asked for.

    One set is kept for each session, folder and state of its events, as the engine would keep these tables; a rollup is a query over them.
    """

    kept: dict[tuple, "Tables"] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        sc = spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
        state = path.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(path)
        key = (sc.applicationId, sf_dir, state.getModificationTime(), state.getLen())  # other files, other tables
        if key not in cls.kept:
            cls.kept = {k: v for k, v in list(cls.kept.items())[-3:] if k[0] == key[0]}
            cls.kept[key] = cls(spark, sf_dir)
        return cls.kept[key]

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def env(self):
        return materialised(envelopes.adapted(self.spark, self.sf_dir))

    @cached_property
    def routed(self):
        return materialised(K.routed(self.env, CFG))

    @property
    def counted(self):
        return self.routed.where("counted")

    @cached_property
    def sessions(self):
        return materialised(S.sessions(self.routed, CFG))

    @cached_property
    def flows(self):
        return materialised(ECO.flows(self.routed, CFG))

    @property
    def fx(self):
        return self.spark.sql(f"SELECT * FROM VALUES {O.FX_VALUES} AS t(currency, rate_date, rate)")

    @cached_property
    def converted(self):
        return materialised(M.converted(M.purchases(self.routed), self.fx, CFG))

    @cached_property
    def enriched(self):
        return materialised(M.enriched(M.payer_tier(self.converted, CFG), self.routed, CFG))

    @cached_property
    def dims(self):
        return materialised(M.capped_dims(self.enriched, CFG))


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: shaped(f(Tables.of(spark, sf_dir)))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def d(x: str) -> str:
    return f"CAST({x} AS VARCHAR) AS {x.split('.')[-1]}"


def n(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"


def r6(x: str, name: str) -> str:
    return f"floor(CAST({x} AS DOUBLE) * 1e6 + 0.5) / 1e6 AS {name}"


# --- front door ---------------------------------------------------------------------------------------------------


@query("q_drops", f"WITH {O.ROUTED} SELECT game_id, disposition, {n('count(*)', 'n')} FROM (SELECT game_id, CASE WHEN reason IS NULL THEN 'route' WHEN reason = 'nameless' THEN 'drop' ELSE 'quarantine' END AS disposition FROM sealed) GROUP BY 1, 2")
def _(t):
    return t.routed.groupBy("game_id", "disposition").agg(F.count(F.lit(1)).alias("n"))


@query("q_pii_scrub", f"""WITH {O.ENV}, g AS (SELECT event_id, processed_at, props FROM env WHERE kind = 'generic'),
kv AS (SELECT event_id, processed_at, unnest(json_keys(props)) AS key, props FROM g)
SELECT event_id, processed_at, key, CASE WHEN json_type(props, '$.' || key) <> 'VARCHAR' THEN json_extract_string(props, '$.' || key)
  WHEN contains(json_extract_string(props, '$.' || key), '@example.com') THEN '[redacted:email]'
  WHEN starts_with(json_extract_string(props, '$.' || key), '10.0.0.') THEN '[redacted:ip]'
  WHEN length(json_extract_string(props, '$.' || key)) >= 9 THEN '[redacted:digits]' ELSE json_extract_string(props, '$.' || key) END AS value
FROM kv WHERE lower(key) <> 'email'""")
def _(t):
    return t.env.where("kind = 'generic'").select("event_id", "processed_at", F.explode(K.scrub(F.col("props"))).alias("key", "value"))


@query("q_stored_properties", f"""WITH {O.ROUTED}, kv AS (SELECT bucket_name, unnest(json_keys(props)) AS key, props FROM counted)
SELECT bucket_name, key, CASE WHEN starts_with(json_extract_string(props, '$.' || key), '[redacted') THEN json_extract_string(props, '$.' || key) END AS redacted, {n('count(*)', 'n')} FROM kv GROUP BY 1, 2, 3""")
def _(t):
    each = t.counted.select("bucket_name", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return each.groupBy("bucket_name", "key", F.when(F.col("value").startswith("[redacted"), F.col("value")).alias("redacted")).agg(F.count(F.lit(1)).alias("n"))


@query("q_skew", f"WITH {O.TIMES} SELECT event_id, processed_at, corrected_time, time_fallback FROM timed")
def _(t):
    return K.with_times(t.env).select("event_id", "processed_at", "corrected_time", "time_fallback")


@query("q_logical_day", f"WITH {O.TIMES} SELECT CAST({O.day('corrected_time', 210)} AS VARCHAR) AS day, CAST({O.day('server_received_time', 210)} AS VARCHAR) AS arrival_day, {n('count(*)', 'n')} FROM timed GROUP BY 1, 2")
def _(t):
    return K.with_times(t.env, Config(reporting_offset_min=210)).groupBy("day", "arrival_day").agg(F.count(F.lit(1)).alias("n"))


@query("q_route", f"WITH {O.ROUTED} SELECT game_id, rk AS resolved_kind, coalesce(reason, '') AS reason, {n('count(*)', 'n')} FROM sealed GROUP BY 1, 2, 3")
def _(t):
    return t.routed.groupBy("game_id", "resolved_kind", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


for _kind in K.TYPED:

    @query(f"q_validate_{_kind}", f"WITH {O.ROUTED} SELECT event_id, processed_at, early IS NULL AS valid FROM judged WHERE rk = '{_kind}' AND trim(name) <> ''")
    def _(t, kind=_kind):
        return K.with_route(K.with_times(t.env)).where((F.col("resolved_kind") == kind) & (F.trim("name") != "")).select("event_id", "processed_at", F.col("early_reason").isNull().alias("valid"))


@query("q_name_cap", f"WITH {O.ROUTED} SELECT game_id, name, bucket_name, {n('count(*)', 'n')} FROM sealed WHERE early IS NULL AND rk = 'generic' GROUP BY 1, 2, 3")
def _(t):
    return t.routed.where("resolved_kind = 'generic' AND coalesce(reason, '') IN ('', 'sealed_late')").groupBy("game_id", "name", "bucket_name").agg(F.count(F.lit(1)).alias("n"))


@query("q_seal", f"""WITH {O.ROUTED} SELECT seal, {n('count(*)', 'n')} FROM (SELECT CASE WHEN processed_at >= (day - DATE '1970-01-01' + 3) * CAST(86400000 AS BIGINT) THEN 'sealed'
 WHEN processed_at >= (day - DATE '1970-01-01' + 1) * CAST(86400000 AS BIGINT) THEN 'grace' ELSE 'open' END AS seal FROM kinds) GROUP BY 1""")
def _(t):
    return t.routed.groupBy("seal").agg(F.count(F.lit(1)).alias("n"))


@query("q_dedup_24h", f"WITH {O.ROUTED} SELECT game_id, event_id, {n('count(*)', 'sent')}, {n('count(*) FILTER (WHERE opens)', 'counted')} FROM ok LEFT JOIN fold USING (game_id, event_id, nth) WHERE NOT is_server GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    r = t.routed.where("reason IS NULL").where(~F.coalesce((F.col("resolved_kind") == "purchase") & (K.prop("source") == "server"), F.lit(False)))
    return r.groupBy("game_id", "event_id").agg(F.count(F.lit(1)).alias("sent"), F.sum(F.col("counted").cast("int")).alias("counted")).where("sent > 1")


@query("q_purchase_dedup", f"WITH {O.ROUTED} SELECT tx AS transaction_id, {n('count(*)', 'sent')}, {n('count(*) FILTER (WHERE tx_nth = 1)', 'counted')} FROM (SELECT *, json_extract_string(props, '$.transaction_id') AS tx FROM money) GROUP BY 1")
def _(t):
    return t.routed.where("money").groupBy(K.prop("transaction_id").alias("transaction_id")).agg(F.count(F.lit(1)).alias("sent"), F.sum(F.col("counted").cast("int")).alias("counted"))


@query("q_exception_tally", f"WITH {O.ROUTED} SELECT game_id, {d('arrival_day')}, reason, {n('count(*)', 'n')} FROM sealed WHERE reason IS NOT NULL GROUP BY 1, 2, 3")
def _(t):
    return K.exception_tally(t.routed)


@query("q_exception_window", f"""WITH {O.ROUTED}, days AS (SELECT CAST(unnest(range(DATE '2024-01-24', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day), reasons(reason) AS (VALUES ('nameless'), ('unknown_kind'), ('quarantined_typed'), ('sealed_late'))
SELECT CAST(days.day AS VARCHAR) AS day, reasons.reason, {n('count(s.reason)', 'n')} FROM days CROSS JOIN reasons LEFT JOIN sealed s ON s.arrival_day = days.day AND s.reason = reasons.reason GROUP BY 1, 2""")
def _(t):
    grid = t.spark.sql("SELECT explode(sequence(date'2024-01-24', date'2024-01-30')) AS arrival_day, reasons FROM VALUES (array('nameless', 'unknown_kind', 'quarantined_typed', 'sealed_late')) AS t(reasons)").select("arrival_day", F.explode("reasons").alias("reason"))
    tally = K.exception_tally(t.routed).groupBy("arrival_day", "reason").agg(F.sum("n").alias("n"))
    return grid.join(tally, ["arrival_day", "reason"], "left").select(F.col("arrival_day").alias("day"), "reason", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("q_clock_regression", f"WITH {O.ENV}, h AS (SELECT *, max(server_received_time) OVER (PARTITION BY game_id ORDER BY processed_at, server_received_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM env) SELECT game_id, event_id, server_received_time, high FROM h WHERE server_received_time < high")
def _(t):
    return K.clock_regression(t.env).select("game_id", "event_id", "server_received_time", "high")


@query("q_event_day_count", f"WITH {O.ROUTED} SELECT game_id, bucket_name, {d('day')}, {n('count(*)', 'n')} FROM counted GROUP BY 1, 2, 3")
def _(t):
    return t.counted.groupBy("game_id", "bucket_name", "day").agg(F.count(F.lit(1)).alias("n"))


@query("q_event_catalog", f"WITH {O.ROUTED} SELECT game_id, bucket_name, {n('count(*)', 'lifetime_count')}, min(corrected_time) AS first_seen, max(corrected_time) AS last_seen, arg_min(rk, (processed_at, server_received_time, event_id)) AS kind FROM counted GROUP BY 1, 2")
def _(t):
    return t.counted.groupBy("game_id", "bucket_name").agg(F.count(F.lit(1)).alias("lifetime_count"), F.min("corrected_time").alias("first_seen"), F.max("corrected_time").alias("last_seen"), F.min_by("resolved_kind", F.struct(*K.ARRIVAL)).alias("kind"))


@query("q_property_types", f"""WITH {O.ROUTED}, kv AS (SELECT bucket_name, unnest(json_keys(props)) AS key, props FROM counted),
ty AS (SELECT DISTINCT bucket_name, key, CASE json_type(props, '$.' || key) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN CASE WHEN CAST(json_extract_string(props, '$.' || key) AS DOUBLE) % 1 = 0 THEN 'int' ELSE 'float' END ELSE 'int' END AS tag FROM kv)
SELECT bucket_name, key, string_agg(tag, ',' ORDER BY tag) AS tags, count(*) > 1 AS drifts FROM ty GROUP BY 1, 2""")
def _(t):
    m = F.from_json("props", "map<string,variant>")
    rows = t.counted.select("bucket_name", m.alias("m")).withColumn("key", F.explode(F.slice(F.array_sort(F.map_keys("m")), 1, CFG.property_key_cap)))
    v = F.col("m")[F.col("key")]
    kind, number = F.schema_of_variant(v), F.try_variant_get(v, "$", "double")
    tag = F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(number == F.floor(number), "int").otherwise("float")
    sets = rows.select("bucket_name", "key", tag.alias("tag")).groupBy("bucket_name", "key").agg(F.array_sort(F.collect_set("tag")).alias("s"))
    return sets.select("bucket_name", "key", F.array_join("s", ",").alias("tags"), (F.size("s") > 1).alias("drifts"))


# --- sessions and retention ---------------------------------------------------------------------------------------


@query("q_session_interval", f"WITH {O.SESSIONS} SELECT event_id, processed_at, start_ms, end_ms FROM sess")
def _(t):
    return t.sessions.select("event_id", "processed_at", "start_ms", "end_ms")


@query("q_session_duration", f"WITH {O.SESSIONS} SELECT event_id, processed_at, duration_ms FROM sess")
def _(t):
    return t.sessions.select("event_id", "processed_at", "duration_ms")


@query("q_session_day", f"WITH {O.SESSIONS} SELECT game_id, {d('on_day')}, {n('count(*) FILTER (WHERE on_day = start_day)', 'session_count')}, {n('sum(part)', 'duration_sum_ms')}, {n('count(*)', 'sessions_touching')} FROM day_parts GROUP BY 1, 2")
def _(t):
    return S.session_day_result(t.sessions, CFG)


@query("q_session_window", f"""WITH {O.SESSIONS}, c AS (SELECT game_id, count(*) AS n FROM sess WHERE start_day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY 1),
u AS (SELECT game_id, count(DISTINCT user_id) AS users, count(*) AS user_days FROM act WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY 1)
SELECT game_id, {n('n', 'sessions')}, {n('users', 'users')}, {n('user_days', 'user_days')}, {r6('n / users', 'sessions_per_user')}, {r6('user_days / users', 'frequency')} FROM c JOIN u USING (game_id)""")
def _(t):
    s, inside = t.sessions, lambda c: f"{c} BETWEEN date'2024-01-08' AND date'2024-01-14'"
    c = s.where(inside("start_day")).groupBy("game_id").agg(F.count(F.lit(1)).alias("sessions"))
    u = S.active_user_day(s).where(inside("day")).groupBy("game_id").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("user_days"))
    return c.join(u, "game_id").withColumn("sessions_per_user", F.try_divide("sessions", "users")).withColumn("frequency", F.try_divide("user_days", "users"))


@query("q_session_average", f"WITH {O.SESSIONS} SELECT game_id, {r6('sum(part) / count(*)', 'average_ms')} FROM day_parts GROUP BY 1")
def _(t):
    return S.session_day_result(t.sessions, CFG).groupBy("game_id").agg(F.try_divide(F.sum("duration_sum_ms"), F.sum("sessions_touching")).alias("average_ms"))


@query("q_sessionize", """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 1800000 THEN 1 ELSE 0 END AS b FROM e),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT user_id, CAST(k AS BIGINT) AS session_no, min(t) AS start_ms, max(t) AS end_ms, count(*) AS n_events FROM s GROUP BY 1, 2""")
def _(t):
    return S.sessionize(t.spark.read.parquet(f"{t.sf_dir}/events.parquet").select("user_id", F.expr(envelopes.SPARK_MS).alias("t")), CFG.session_gap_ms)


@query("q_active_user_day", f"WITH {O.SESSIONS} SELECT game_id, {d('day')}, user_id FROM act")
def _(t):
    return S.active_user_day(t.sessions)


@query("q_dau_rolling7", f"""WITH {O.SESSIONS}, x AS (SELECT game_id, day, count(*) AS dau FROM act GROUP BY 1, 2)
SELECT game_id, {d('day')}, {n('dau', 'dau')}, CASE WHEN row_number() OVER w >= 7 THEN CAST(floor(avg(dau) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) + 0.5) AS BIGINT) END AS rolling FROM x WINDOW w AS (PARTITION BY game_id ORDER BY day)""")
def _(t):
    w = W.partitionBy("game_id").orderBy("day")
    x = S.active_user_day(t.sessions).groupBy("game_id", "day").agg(F.count(F.lit(1)).alias("dau"))
    return x.withColumn("rolling", F.when(F.row_number().over(w) >= 7, F.floor(F.avg("dau").over(w.rowsBetween(-6, 0)) + 0.5)))


@query("q_user_spine", f"WITH {O.SESSIONS} SELECT * FROM spine")
def _(t):
    return S.user_spine(t.sessions)


@query("q_cohort", f"WITH {O.SESSIONS} SELECT game_id, {d('cohort_date')}, cohort_size FROM cohort")
def _(t):
    return S.cohorts(t.sessions, CFG)


@query("q_retention_cell", f"WITH {O.SESSIONS} SELECT game_id, {d('cohort_date')}, {n('day_offset', 'day_offset')}, retained AS retained_users FROM cell")
def _(t):
    return S.retention_cells(t.sessions, CFG)


_TARGETS = "g(t) AS (VALUES (1), (7), (30))"


@query("q_retention_headline", f"""WITH {O.SESSIONS}, {_TARGETS} SELECT c.game_id, {n('g.t', 'target')}, {n('sum(cohort_size)', 'users')}, {n('coalesce(sum(retained), 0)', 'retained')}, {r6('coalesce(sum(retained), 0) / sum(cohort_size)', 'rate')}
FROM cohort c CROSS JOIN g LEFT JOIN cell ON cell.game_id = c.game_id AND cell.cohort_date = c.cohort_date AND cell.day_offset = g.t WHERE DATE '{AS_OF}' - c.cohort_date >= g.t GROUP BY 1, 2""")
def _(t):
    return S.headline(t.sessions, AS_OF, CFG)


@query("q_retention_heatmap", f"""WITH {O.SESSIONS}, g(t) AS (VALUES (0), (1), (7), (30)) SELECT c.game_id, CAST(c.cohort_date AS VARCHAR) AS cohort_date, {n('g.t', 'day_offset')}, cohort_size,
{n(f"CASE WHEN DATE '{AS_OF}' - c.cohort_date >= g.t THEN coalesce(retained, 0) ELSE 0 END", 'retained')}, {r6(f"CASE WHEN DATE '{AS_OF}' - c.cohort_date >= g.t THEN coalesce(retained, 0) / cohort_size END", 'rate')}, cohort_size < 30 AS low_confidence, {AS_OF_MS} < (c.cohort_date + g.t - DATE '1970-01-01' + 3) * CAST(86400000 AS BIGINT) AS provisional
FROM cohort c CROSS JOIN g LEFT JOIN cell ON cell.game_id = c.game_id AND cell.cohort_date = c.cohort_date AND cell.day_offset = g.t""")
def _(t):
    return S.heatmap(t.sessions, AS_OF, CFG)


@query("q_cohort_ztest", f"""WITH {O.SESSIONS}, a AS (SELECT c.game_id, c.cohort_date, cohort_size AS n1, coalesce(retained, 0) AS x1 FROM cohort c LEFT JOIN cell ON cell.game_id = c.game_id AND cell.cohort_date = c.cohort_date AND day_offset = 7),
b AS (SELECT *, lead(n1) OVER w AS n2, lead(x1) OVER w AS x2 FROM a WINDOW w AS (PARTITION BY game_id ORDER BY cohort_date)),
e AS (SELECT *, (x1 + x2) / (n1 + n2) AS p FROM b WHERE n2 IS NOT NULL), z AS (SELECT *, CASE WHEN p * (1 - p) = 0 THEN 0 ELSE (x1 / n1 - x2 / n2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) END AS z FROM e)
SELECT game_id, {d('cohort_date')}, {r6('z', 'z')}, abs(z) > 1.96 AS significant FROM z""")
def _(t):
    return S.ztest(t.sessions, 7, CFG)


@query("q_spine_rescan", f"WITH {O.SESSIONS} SELECT game_id, {d('cohort_date')}, string_agg(CAST(day_offset AS VARCHAR) || ':' || CAST(retained AS VARCHAR), ',' ORDER BY day_offset) AS row FROM cell GROUP BY 1, 2")
def _(t):
    bits = S.activity(t.sessions, CFG).groupBy("game_id", "user_id", "cohort_date").agg(F.array_sort(F.collect_set("day_offset")).alias("bits"))
    cells = bits.select("game_id", "cohort_date", F.explode("bits").alias("day_offset")).groupBy("game_id", "cohort_date", "day_offset").agg(F.count(F.lit(1)).alias("k"))
    line = F.array_sort(F.collect_list(F.struct("day_offset", "k")))
    return cells.groupBy("game_id", "cohort_date").agg(F.array_join(F.transform(line, lambda x: F.concat_ws(":", x["day_offset"], x["k"])), ",").alias("row"))


@query("q_d0_invariant", f"WITH {O.SESSIONS} SELECT c.game_id, CAST(c.cohort_date AS VARCHAR) AS cohort_date, cohort_size, coalesce(retained, 0) AS d0, cohort_size = coalesce(retained, 0) AS holds FROM cohort c LEFT JOIN cell ON cell.game_id = c.game_id AND cell.cohort_date = c.cohort_date AND day_offset = 0")
def _(t):
    s = t.sessions
    both = S.cohorts(s, CFG).join(S.retention_cells(s, CFG).where("day_offset = 0"), ["game_id", "cohort_date"], "left").withColumn("d0", F.coalesce("retained_users", F.lit(0)))
    return both.select("game_id", "cohort_date", "cohort_size", "d0", (F.col("cohort_size") == F.col("d0")).alias("holds"))


# --- economy ------------------------------------------------------------------------------------------------------


@query("q_economy_flow", f"WITH {O.ECONOMY} SELECT game_id, currency, {d('day')}, provenance, why AS flow_reason, flow AS flow_type, {n('sum(amount)', 'amount_sum')}, {n('count(*)', 'event_count')} FROM flow GROUP BY ALL")
def _(t):
    return ECO.flow_cells(t.flows)


_SEG = f"seg AS (SELECT game_id, currency, day, flow, amount, 'level_bucket' AS segment_dim, {O.LEVEL.format('lvl')} AS segment_value FROM flow UNION ALL SELECT game_id, currency, day, flow, amount, 'region', region FROM flow WHERE region IS NOT NULL)"


@query("q_economy_segment", f"WITH {O.ECONOMY}, {_SEG} SELECT game_id, currency, {d('day')}, flow AS flow_type, segment_dim, segment_value, {n('sum(amount)', 'amount_sum')}, {n('count(*)', 'event_count')} FROM seg GROUP BY ALL")
def _(t):
    return ECO.segment_cells(t.flows, CFG)




def _day_sql(keys: str, table: str) -> str:
    s, k = "coalesce(sum(amount) FILTER (WHERE flow = 'source'), 0)", "coalesce(sum(amount) FILTER (WHERE flow = 'sink'), 0)"
    return f"""SELECT {keys}, {n(s, 'source')}, {n(k, 'sink')}, {n(f'{s} - {k}', 'net')}, {r6(f'{k} / nullif({s}, 0)', 'ratio')}, {r6(f'{k} / nullif({s} + {k}, 0)', 'bounded_ratio')},
count(*) FILTER (WHERE flow = 'source') < 100 OR count(*) FILTER (WHERE flow = 'sink') < 100 AS low_volume FROM {table} GROUP BY ALL"""


@query("q_economy_day", f"WITH {O.ECONOMY} {_day_sql('game_id, currency, CAST(day AS VARCHAR) AS day', 'flow')}")
def _(t):
    return ECO.day_view(ECO.flow_cells(t.flows), ["game_id", "currency", "day"], CFG)


@query("q_economy_segment_day", f"WITH {O.ECONOMY}, {_SEG} {_day_sql('game_id, currency, CAST(day AS VARCHAR) AS day, segment_dim, segment_value', 'seg')}")
def _(t):
    return ECO.day_view(ECO.segment_cells(t.flows, CFG), ["game_id", "currency", "day", "segment_dim", "segment_value"], CFG)


@query("q_level_bucket", f"WITH {O.ECONOMY} SELECT {n('lvl', 'level')}, {O.LEVEL.format('lvl')} AS bucket, {n('count(*)', 'n')} FROM f0 GROUP BY 1, 2")
def _(t):
    return t.flows.groupBy("level", ECO.level_bucket(F.col("level")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("q_currency_cap", f"WITH {O.ECONOMY} SELECT game_id, cur AS raw_currency, currency, {n('count(*)', 'n')} FROM flow GROUP BY ALL")
def _(t):
    return t.flows.groupBy("game_id", "raw_currency", "currency").agg(F.count(F.lit(1)).alias("n"))


@query("q_currencies", f"WITH {O.ECONOMY} SELECT DISTINCT game_id, currency FROM flow")
def _(t):
    return t.flows.select("game_id", "currency").distinct()


@query("q_balance_lww", f"WITH {O.ECONOMY} SELECT game_id, user_id, currency, balance, prov AS provenance, as_of_ms FROM bal")
def _(t):
    return ECO.balances(t.flows)


@query("q_top_reasons", f"WITH {O.ECONOMY}, s AS (SELECT game_id, currency, day, flow, why, sum(amount) AS amount FROM flow GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY game_id, currency, day, flow ORDER BY amount DESC, why) AS rank FROM s) SELECT game_id, currency, {d('day')}, flow AS flow_type, why AS flow_reason, {n('amount', 'amount')}, rank FROM r WHERE rank <= 3")
def _(t):
    return ECO.top_reasons(ECO.flow_cells(t.flows))


for _name in ("q_money_supply", "q_supply_snapshot"):

    @query(_name, f"""WITH {O.ECONOMY}, r AS (SELECT *, row_number() OVER (PARTITION BY game_id, currency ORDER BY balance) AS i, count(*) OVER (PARTITION BY game_id, currency) AS c FROM bal{" WHERE as_of_ms < 1705363200000" if _name == "q_supply_snapshot" else ""})
SELECT game_id, currency, {n('sum(balance)', 'money_supply')}, {n('count(*)', 'n_users')}, {n('min(balance) FILTER (WHERE i = (c + 1) // 2)', 'p50')}, {n('min(balance) FILTER (WHERE i = (9 * c + 9) // 10)', 'p90')}, {n("coalesce(sum(balance) FILTER (WHERE prov = 'server'), 0)", 'trusted_supply')} FROM r GROUP BY 1, 2""")
    def _(t, name=_name):
        b = ECO.balances(t.flows)
        return ECO.money_supply(b.where("as_of_ms < 1705363200000") if name == "q_supply_snapshot" else b)


@query("q_supply_trend", f"""WITH {O.ECONOMY}, days AS (SELECT DISTINCT game_id, currency, day FROM flow),
nf AS (SELECT d.game_id, d.currency, d.day, sum(CASE WHEN f.flow = 'source' THEN f.amount ELSE -f.amount END) AS net_flow FROM days d JOIN flow f ON f.game_id = d.game_id AND f.currency = d.currency AND f.day <= d.day GROUP BY ALL),
lb AS (SELECT d.game_id, d.currency, d.day, f.user_id, arg_max(f.balance, (f.day, f.corrected_time, f.server_received_time, f.event_id)) AS b FROM days d JOIN flow f ON f.game_id = d.game_id AND f.currency = d.currency AND f.day <= d.day WHERE f.user_id IS NOT NULL AND f.balance IS NOT NULL GROUP BY ALL),
su AS (SELECT game_id, currency, day, sum(b) AS supply FROM lb GROUP BY ALL)
SELECT game_id, currency, {d('day')}, {n('coalesce(supply, 0)', 'supply')}, {n('net_flow', 'net_flow')}, {n('coalesce(supply, 0) - net_flow', 'divergence')} FROM nf LEFT JOIN su USING (game_id, currency, day)""")
def _(t):
    return ECO.supply_trend(t.flows)


# --- monetization -------------------------------------------------------------------------------------------------


@query("q_fx_asof", f"WITH {O.MONEY} SELECT tx AS transaction_id, currency, {d('day')}, CAST(CASE WHEN fx_state <> 'parked' THEN rate_date END AS VARCHAR) AS rate_date FROM conv")
def _(t):
    return t.converted.select("transaction_id", "currency", "day", "rate_date")


@query("q_fx_normalize", f"WITH {O.MONEY} SELECT tx AS transaction_id, fx_state, {r6('norm', 'normalized')} FROM conv")
def _(t):
    return t.converted.select("transaction_id", "fx_state", "normalized")


@query("q_payer_tier", f"WITH {O.MONEY} SELECT tx AS transaction_id, payer_tier FROM tier")
def _(t):
    return M.payer_tier(t.converted, CFG).select("transaction_id", "payer_tier")


@query("q_payer_spine", f"WITH {O.MONEY} SELECT game_id, user_id, CAST(arg_min(day, (processed_at, server_received_time, event_id)) AS VARCHAR) AS first_purchase_day, {r6('sum(norm)', 'lifetime_spend')}, bool_or(fx_state = 'parked') AS has_unconverted FROM conv GROUP BY 1, 2")
def _(t):
    return M.payer_spine(t.converted)


@query("q_payer_period_spend", f"WITH {O.MONEY} SELECT game_id, strftime(day, '%Y-%m') AS period, user_id, {r6('sum(norm)', 'spend')} FROM conv GROUP BY ALL")
def _(t):
    return M.payer_period(t.converted)


@query("q_purchase_enriched", f"WITH {O.MONEY} SELECT tx AS transaction_id, payer_tier, region, in_game_state, level_bucket FROM rich")
def _(t):
    return t.enriched.select("transaction_id", "payer_tier", "region", "in_game_state", "level_bucket")


@query("q_dim_cap", f"WITH {O.MONEY} SELECT game_id, region, in_game_state, {n('count(*)', 'n')} FROM dims GROUP BY ALL")
def _(t):
    return t.dims.groupBy("game_id", "region", "in_game_state").agg(F.count(F.lit(1)).alias("n"))


_COMBO = "'in_game_state=' || in_game_state || '|payer_tier=' || payer_tier || '|region=' || region"


@query("q_dim_combo", f"WITH {O.MONEY} SELECT tx AS transaction_id, {_COMBO} AS dim_combo, region AS parsed_region FROM dims")
def _(t):
    combo = M.dim_combo({x: F.col(x) for x in CFG.active_dims})
    return t.dims.select("transaction_id", combo.alias("dim_combo")).withColumn("parsed_region", M.parse_combo(F.col("dim_combo"))["region"])


_CELLS = f"SELECT game_id, product_id, {_COMBO} AS dim_combo, day, count(*) AS k, sum(norm) AS revenue, min(cat) AS cat FROM dims GROUP BY ALL"


@query("q_monetization_cell", f"WITH {O.MONEY} SELECT game_id, product_id, dim_combo, {d('day')}, {n('k', 'purchase_count')}, {r6('revenue', 'revenue')}, cat AS product_category FROM ({_CELLS})")
def _(t):
    return M.cells(t.dims, CFG)


@query("q_local_breakdown", f"WITH {O.MONEY} SELECT game_id, product_id, {d('day')}, currency, {r6('sum(price)', 'local')} FROM conv GROUP BY ALL")
def _(t):
    return t.converted.groupBy("game_id", "product_id", "day", "currency").agg(F.sum("price_local").alias("local"))


@query("q_payer_day", f"WITH {O.MONEY} SELECT game_id, {d('day')}, {n('count(DISTINCT user_id)', 'payers')}, {r6('sum(norm)', 'revenue')} FROM conv GROUP BY ALL")
def _(t):
    return M.payer_day(t.converted)


@query("q_top_package", f"WITH {O.MONEY}, s AS (SELECT game_id, region, product_id, sum(norm) AS v, count(*) AS n FROM dims GROUP BY ALL) SELECT game_id, region, product_id, {r6('v', 'revenue')}, {n('n', 'n')} FROM s QUALIFY row_number() OVER (PARTITION BY game_id, region ORDER BY v DESC, product_id) = 1")
def _(t):
    return M.top_package(t.dims, "region")


@query("q_context_coverage", f"""WITH {O.MONEY}, x AS (SELECT game_id, norm, unnest(['in_game_state', 'level_bucket', 'region']) AS dim, unnest([in_game_state, level_bucket, region]) AS v FROM rich)
SELECT game_id, dim, {r6("1 - CAST(coalesce(sum(norm) FILTER (WHERE v = 'unknown'), 0) AS DOUBLE) / nullif(CAST(sum(norm) AS DOUBLE), 0)", 'coverage')} FROM x GROUP BY 1, 2""")
def _(t):
    return M.context_coverage(t.enriched)


@query("q_active_users", f"""WITH {O.SESSIONS}, e AS (SELECT game_id, min(day) AS lo, max(day) AS hi FROM act GROUP BY 1), g AS (SELECT game_id, lo, CAST(unnest(range(lo, hi + 1, INTERVAL 1 DAY)) AS DATE) AS day FROM e),
x AS (SELECT g.game_id, g.day, g.lo, count(DISTINCT CASE WHEN a.day = g.day THEN user_id END) AS dau, count(DISTINCT CASE WHEN g.day - a.day < 7 THEN user_id END) AS wau, count(DISTINCT user_id) AS mau FROM g JOIN act a ON a.game_id = g.game_id AND a.day <= g.day AND g.day - a.day < 30 GROUP BY ALL)
SELECT game_id, {d('day')}, {n('dau', 'dau')}, {n('CASE WHEN day - lo >= 6 THEN wau END', 'wau')}, {n('CASE WHEN day - lo >= 29 THEN mau END', 'mau')}, {r6('CASE WHEN day - lo >= 29 THEN dau / mau END', 'stickiness')} FROM x""")
def _(t):
    return M.active_users(S.active_user_day(t.sessions))


#: Sessions and money in one statement: the second one's CTEs follow the shared ones of the first.
_BOTH = O.SESSIONS + O.MONEY.removeprefix(O.ROUTED)


@query("q_revenue_kpis", f"""WITH {_BOTH}, a AS (SELECT game_id, day, count(*) AS dau FROM act GROUP BY ALL), m AS (SELECT game_id, day, count(DISTINCT user_id) AS payers, CAST(sum(norm) AS DOUBLE) AS rev FROM conv GROUP BY ALL)
SELECT game_id, CAST(day AS VARCHAR) AS day, {n('coalesce(dau, 0)', 'dau')}, {n('coalesce(payers, 0)', 'payers')}, {r6('coalesce(rev, 0)', 'rev')}, {r6('coalesce(rev, 0) / nullif(coalesce(dau, 0), 0)', 'arpu')}, {r6('coalesce(rev, 0) / nullif(coalesce(payers, 0), 0)', 'arppu')}, {r6('coalesce(payers, 0) / nullif(coalesce(dau, 0), 0)', 'conversion')} FROM a FULL JOIN m USING (game_id, day)""")
def _(t):
    return M.revenue_kpis(t.converted, S.active_user_day(t.sessions))


@query("q_first_conversion", f"""WITH {_BOTH}, f AS (SELECT game_id, user_id, arg_min(day, (processed_at, server_received_time, event_id)) AS fd FROM conv GROUP BY 1, 2), g AS (SELECT DISTINCT game_id FROM act)
SELECT game_id, {n('(SELECT count(*) FROM f WHERE f.game_id = g.game_id AND fd BETWEEN DATE %s2024-01-08%s AND DATE %s2024-01-14%s)' % (("'",) * 4), 'first_payers')},
{n('(SELECT count(DISTINCT user_id) FROM act WHERE act.game_id = g.game_id AND day BETWEEN DATE %s2024-01-08%s AND DATE %s2024-01-14%s)' % (("'",) * 4), 'active')} FROM g""")
def _(t):
    inside = "BETWEEN date'2024-01-08' AND date'2024-01-14'"
    act = S.active_user_day(t.sessions)
    first = M.payer_spine(t.converted).where(f"first_purchase_day {inside}").groupBy("game_id").agg(F.count(F.lit(1)).alias("first_payers"))
    active = act.groupBy("game_id").agg(F.count_distinct(F.when(F.expr(f"day {inside}"), F.col("user_id"))).alias("active"))
    return active.join(first, "game_id", "left").select("game_id", F.coalesce("first_payers", F.lit(0)).cast("long").alias("first_payers"), "active")


@query("q_new_returning", f"WITH {O.SESSIONS} SELECT a.game_id, CAST(a.day AS VARCHAR) AS day, {n(f'count(*) FILTER (WHERE {O.day(chr(102) + chr(46) + chr(102))} = a.day)', 'new_users')}, {n(f'count(*) FILTER (WHERE {O.day(chr(102) + chr(46) + chr(102))} <> a.day)', 'returning_users')} FROM act a JOIN (SELECT game_id, user_id, first_seen_ms AS f FROM spine) f USING (game_id, user_id) GROUP BY 1, 2")
def _(t):
    s = t.sessions
    both = S.active_user_day(s).join(S.user_spine(s), ["game_id", "user_id"]).withColumn("is_new", timex.logical_day("first_seen_ms", CFG) == F.col("day"))
    return both.groupBy("game_id", "day").agg(F.sum(F.col("is_new").cast("int")).alias("new_users"), F.sum((~F.col("is_new")).cast("int")).alias("returning_users"))


@query("q_whale", f"""WITH {O.MONEY}, s AS (SELECT game_id, strftime(day, '%Y-%m') AS period, user_id, sum(norm) AS v FROM conv GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY game_id, period ORDER BY v DESC, user_id) AS i, count(*) OVER (PARTITION BY game_id, period) AS c FROM s), g(pct) AS (VALUES (1), (5), (10))
SELECT game_id, period, {n('pct', 'pct')}, {n('c', 'n')}, {n('coalesce((SELECT count(DISTINCT user_id) FROM conv p WHERE p.game_id = r.game_id AND strftime(p.day, \'%Y-%m\') = r.period AND fx_state = \'parked\' AND user_id IS NOT NULL), 0)', 'indeterminate')}, {r6('CAST(sum(v) FILTER (WHERE i <= (pct * c + 99) // 100) AS DOUBLE) / nullif(CAST(sum(v) AS DOUBLE), 0)', 'share')}, c < 20 AS low_confidence FROM r CROSS JOIN g GROUP BY game_id, period, pct, c""")
def _(t):
    return M.whale(t.converted, CFG)


@query("q_period_revenue", f"WITH {O.MONEY} SELECT game_id, strftime(day, '%Y-%m') AS period, {r6('sum(norm)', 'revenue')} FROM conv GROUP BY ALL")
def _(t):
    return M.payer_day(t.converted).groupBy("game_id", F.date_format("day", "yyyy-MM").alias("period")).agg(F.sum("revenue").alias("revenue"))


@query("q_fx_recompute", f"""WITH {O.MONEY}, b AS (SELECT game_id, day, currency, sum(price) AS local FROM conv GROUP BY ALL)
SELECT b.game_id, CAST(b.day AS VARCHAR) AS day, {r6('sum(CASE WHEN f.rate_date IS NULL OR b.day - f.rate_date > 7 THEN 0 ELSE CAST(round(b.local * f.rate, 6) AS DECIMAL(24,6)) END)', 'revenue')} FROM b ASOF LEFT JOIN (SELECT currency, rate_date, CAST(rate * 2 AS DECIMAL(16,10)) AS rate FROM fx) f ON b.currency = f.currency AND b.day >= f.rate_date GROUP BY 1, 2""")
def _(t):
    local = t.converted.groupBy("game_id", "day", "currency").agg(F.sum("price_local").cast("decimal(14,2)").alias("price_local"))
    again = M.converted(local, t.fx.withColumn("rate", (F.col("rate") * 2).cast("decimal(16,10)")), CFG)
    return again.groupBy("game_id", "day").agg(F.sum("normalized").alias("revenue"))


@query("q_reconcile", f"WITH {O.MONEY}, v AS (SELECT game_id, day, floor(CAST(sum(norm) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS d FROM conv GROUP BY ALL) SELECT game_id, CAST(day AS VARCHAR) AS day, d AS booked, d AS derived, CAST(0 AS DOUBLE) AS correction FROM v")
def _(t):
    return M.reconcile(M.cells(t.dims, CFG), t.converted)


# --- dashboard, privacy, funnel -----------------------------------------------------------------------------------


@query("q_day_counts", f"WITH {O.ROUTED} SELECT {d('day')}, bucket_name, {n('count(*)', 'n')}, {n('sum(count(*)) OVER (PARTITION BY day)', 'total')} FROM counted GROUP BY day, bucket_name")
def _(t):
    c = t.counted.groupBy("day", "bucket_name").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("total", F.sum("n").over(W.partitionBy("day")))


@query("q_top_events", f"WITH {O.ROUTED}, c AS (SELECT game_id, bucket_name, count(*) AS n FROM counted GROUP BY ALL) SELECT game_id, bucket_name, {n('n', 'n')}, {r6('n / sum(n) OVER (PARTITION BY game_id)', 'share')} FROM c QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY n DESC, bucket_name) <= 3")
def _(t):
    w = W.partitionBy("game_id")
    c = t.counted.groupBy("game_id", "bucket_name").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(w))
    return c.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "bucket_name"))).where("r <= 3").drop("r")


@query("q_trend", f"""WITH {O.ROUTED}, c AS (SELECT game_id, count(*) FILTER (WHERE day BETWEEN DATE '2024-01-15' AND DATE '2024-01-21') AS now, count(*) FILTER (WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14') AS prev FROM counted GROUP BY 1)
SELECT game_id, {n('now', 'now')}, {n('prev', 'prev')}, CASE WHEN prev = 0 OR abs(now - prev) * 100 < prev THEN 'flat' WHEN now > prev THEN 'up' ELSE 'down' END AS direction, CASE WHEN prev = 0 OR abs(now - prev) * 100 < prev THEN NULL ELSE round(abs(now - prev) * 100 / prev, 1) END AS percent FROM c""")
def _(t):
    span = lambda a, b: F.sum(F.when(F.col("day").between(F.lit(a).cast("date"), F.lit(b).cast("date")), 1).otherwise(0))
    c = t.counted.groupBy("game_id").agg(span("2024-01-15", "2024-01-21").alias("now"), span("2024-01-08", "2024-01-14").alias("prev"))
    flat = (F.col("prev") == 0) | (F.abs(F.col("now") - F.col("prev")) * 100 < F.col("prev"))
    return c.select("game_id", "now", "prev", F.when(flat, "flat").when(F.col("now") > F.col("prev"), "up").otherwise("down").alias("direction"), F.when(~flat, F.round(F.abs(F.col("now") - F.col("prev")) * 100 / F.col("prev"), 1)).alias("percent"))


@query("q_upload_status", f"""WITH {O.ROUTED}, x AS (SELECT game_id, day, count(*) AS n FROM sealed WHERE coalesce(reason, '') <> 'nameless' GROUP BY ALL)
SELECT game_id, {d('day')}, CASE WHEN {AS_OF_MS} < (day - DATE '1970-01-01' + 3) * CAST(86400000 AS BIGINT) THEN 'open' WHEN day < DATE '2024-01-10' THEN 'local-deleted' WHEN day < DATE '2024-01-20' THEN 'uploaded' ELSE 'pending' END AS status FROM x""")
def _(t):
    days = t.routed.where("disposition <> 'drop'").select("game_id", "day").distinct()
    books = days.where("day < date'2024-01-20'").select("game_id", "day", F.lit(True).alias("uploaded"), (F.col("day") < F.lit("2024-01-10").cast("date")).alias("deleted"))
    both = days.join(books, ["game_id", "day"], "left")
    return both.select("game_id", "day", F.when(timex.seal_state("day", F.lit(AS_OF_MS), CFG) != "sealed", "open").when(F.col("deleted"), "local-deleted").when(F.col("uploaded"), "uploaded").otherwise("pending").alias("status"))


@query("q_subject_days", f"WITH {_BOTH} SELECT DISTINCT game_id, user_id, CAST(day AS VARCHAR) AS day FROM (SELECT game_id, user_id, day FROM act UNION ALL SELECT game_id, user_id, day FROM conv) WHERE user_id = 'u7'")
def _(t):
    a = S.active_user_day(t.sessions).where("user_id = 'u7'").select("game_id", "user_id", "day")
    return a.union(t.converted.where("user_id = 'u7'").select("game_id", "user_id", "day")).distinct()


@query("q_dsar", f"""WITH {_BOTH}, b0 AS (SELECT count(*) AS purchases, floor(CAST(coalesce(sum(norm), 0) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS spend FROM conv WHERE user_id = 'u7')
SELECT 'u7' AS user_id, {n("(SELECT count(*) FROM sess WHERE user_id = 'u7')", 'sessions')}, {n("(SELECT count(*) FROM act WHERE user_id = 'u7')", 'active_days')}, purchases, spend FROM b0""")
def _(t):
    who = "user_id = 'u7'"
    s = t.sessions
    parts = [s.where(who).agg(F.count(F.lit(1)).alias("v")), S.active_user_day(s).where(who).agg(F.count(F.lit(1)).alias("v"))]
    p = t.converted.where(who).agg(F.count(F.lit(1)).alias("purchases"), F.coalesce(F.sum("normalized").cast("double"), F.lit(0.0)).alias("spend")).withColumn("user_id", F.lit("u7"))
    for name, part in zip(("sessions", "active_days"), parts):
        p = p.join(part.select(F.lit("u7").alias("user_id"), F.col("v").alias(name)), "user_id")
    return p.select("user_id", "sessions", "active_days", "purchases", "spend")


@query("q_erasure_antijoin", f"WITH {O.ROUTED} SELECT game_id, {n('count(*)', 'n')} FROM counted WHERE user_id IS NULL OR CAST(substr(user_id, 2) AS BIGINT) % 10 <> 0 GROUP BY 1")
def _(t):
    from ..operators.privacy import erased, subject_ref

    users = t.env.where("user_id IS NOT NULL").select("game_id", "user_id").distinct()
    ledger = users.where("cast(substr(user_id, 2) as bigint) % 10 = 0").select("game_id", subject_ref("game_id", "user_id", "master").alias("subject_ref"))
    return erased(t.counted, ledger, "master").groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))


@query("q_funnel", f"""WITH {O.ROUTED}, a AS (SELECT game_id, user_id, name, corrected_time AS t FROM counted WHERE user_id IS NOT NULL), s1 AS (SELECT game_id, user_id, min(t) AS t1 FROM a WHERE name = 'session' GROUP BY 1, 2),
s2 AS (SELECT s1.*, min(t) AS t2 FROM s1 JOIN a USING (game_id, user_id) WHERE name = 'economy' AND t > t1 AND t <= t1 + 604800000 GROUP BY ALL), s3 AS (SELECT s2.*, min(t) AS t3 FROM s2 JOIN a USING (game_id, user_id) WHERE name = 'purchase' AND t > t2 AND t <= t1 + 604800000 GROUP BY ALL)
SELECT game_id, {n('count(*)', 'r1')}, {n('count(t2)', 'r2')}, {n('count(t3)', 'r3')}, {r6('count(t3) / count(*)', 'overall')} FROM s1 LEFT JOIN s2 USING (game_id, user_id, t1) LEFT JOIN s3 USING (game_id, user_id, t1, t2) GROUP BY 1""")
def _(t):
    from ..operators.privacy import funnel

    return funnel(t.counted.where("user_id IS NOT NULL"), ("session", "economy", "purchase"), 7 * 86_400_000)


@query("q_rate_limit", f"""WITH RECURSIVE {O.ENV}, b AS MATERIALIZED (SELECT game_id, server_received_time AS ms, count(*) AS n, row_number() OVER (PARTITION BY game_id ORDER BY server_received_time) AS i FROM env GROUP BY 1, 2),
f AS (SELECT game_id, ms, n, i, CAST(0 AS DOUBLE) AS tokens, true AS admitted FROM b WHERE i = 1
  UNION ALL SELECT game_id, ms, n, i, have - CASE WHEN have >= 1 THEN 1 ELSE 0 END, have >= 1
  FROM (SELECT b.*, least(CAST(1 AS DOUBLE), f.tokens + (b.ms - f.ms) * CAST(0.001 AS DOUBLE)) AS have FROM f JOIN b ON b.game_id = f.game_id AND b.i = f.i + 1))
SELECT game_id, ms AS "at", {n('n', 'n')}, admitted FROM f""")
def _(t):
    batches = t.env.groupBy("game_id", F.col("server_received_time").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    return K.rate_limited(batches, Config(rate_per_s=1, rate_burst=1))


@query("q_retention_curve", f"""WITH {O.SESSIONS}, {_TARGETS}, h AS (SELECT c.game_id, g.t, coalesce(sum(retained), 0) / sum(cohort_size) AS rate FROM cohort c CROSS JOIN g LEFT JOIN cell ON cell.game_id = c.game_id AND cell.cohort_date = c.cohort_date AND cell.day_offset = g.t
WHERE DATE '{AS_OF}' - c.cohort_date >= g.t GROUP BY 1, 2)
SELECT game_id, {n('t', 'target')}, floor(rate * 1000 + 0.5) / 10 AS percent FROM h UNION ALL SELECT DISTINCT game_id, CAST(0 AS BIGINT), CAST(100 AS DOUBLE) FROM h""")
def _(t):
    h = S.headline(t.sessions, AS_OF, CFG).select("game_id", F.col("target").cast("long").alias("target"), (F.floor(F.col("rate") * 1000 + 0.5) / 10).alias("percent"))
    return h.unionByName(h.select("game_id").distinct().select("game_id", F.lit(0).cast("long").alias("target"), F.lit(100.0).alias("percent")))


@query("q_economy_period", f"WITH {O.ECONOMY} {_day_sql('game_id, currency', '(SELECT * FROM flow WHERE day BETWEEN DATE %s2024-01-08%s AND DATE %s2024-01-14%s)' % (chr(39), chr(39), chr(39), chr(39)))}")
def _(t):
    cells = ECO.flow_cells(t.flows).where("day BETWEEN date'2024-01-08' AND date'2024-01-14'")
    return ECO.day_view(cells, ["game_id", "currency"], CFG)


@query("q_identity_edge", f"WITH {O.ROUTED} SELECT game_id, anon_id, user_id, min(corrected_time) AS first_linked_ms FROM counted WHERE anon_id IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL")
def _(t):
    return t.counted.where("anon_id IS NOT NULL AND user_id IS NOT NULL").groupBy("game_id", "anon_id", "user_id").agg(F.min("corrected_time").alias("first_linked_ms"))


# --- sinks, server dimensions, erasure, periods -------------------------------------------------------------------


@query("q_raw_append", f"""WITH {O.ROUTED} SELECT game_id, {d('day')}, CASE WHEN reason IS NULL THEN 'body' ELSE 'quarantine' END AS class, 'raw/' || game_id || '/' || CAST(day AS VARCHAR) || '.rawlog' AS object_key, {n('count(*)', 'n')},
{n('count(*) FILTER (WHERE contains(props, %s[redacted%s))' % ("'", "'"), 'redacted')} FROM sealed WHERE coalesce(reason, '') <> 'nameless' GROUP BY 1, 2, 3, 4""")
def _(t):
    path = fresh_folder(t.spark, "raw")
    raw.append_raw(t.routed, path)
    line = raw.read_raw(t.spark, path).select("game_id", F.col("corrected_day").alias("day"), "class", raw.object_key(F.col("game_id"), F.col("corrected_day")).alias("object_key"), F.get_json_object("value", "$.props").alias("props"))
    return line.groupBy("game_id", "day", "class", "object_key").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("props").contains("[redacted"), 1)).alias("redacted"))


@query("q_raw_shipment", f"""WITH {O.ROUTED} SELECT game_id, {d('day')}, CASE WHEN day >= DATE '2024-01-20' THEN 'wait' WHEN day < DATE '2024-01-10' THEN 'verified' ELSE 'ship' END AS state FROM sealed WHERE coalesce(reason, '') <> 'nameless' GROUP BY game_id, day""")
def _(t):
    path = fresh_folder(t.spark, "raw")
    raw.append_raw(t.routed, path)
    local = raw.manifest(t.spark, path)
    stored = local.where("corrected_day < '2024-01-10'").select("path", "size", "sha256")
    return raw.shipment(local, stored, F.lit("2024-01-20")).select("game_id", F.col("corrected_day").alias("day"), "state").distinct()


@query("q_merge_upsert", f"WITH {O.ROUTED} SELECT game_id, bucket_name, {d('day')}, {n('count(*)', 'n')}, min(corrected_time) AS first_seen, arg_max(event_id, (processed_at, server_received_time, event_id)) AS last_event, max(processed_at) AS as_of FROM counted GROUP BY 1, 2, 3")
def _(t):
    path, keys = fresh_folder(t.spark, "rollup"), ["game_id", "bucket_name", "day"]
    own = F.struct(*K.ARRIVAL)
    cells = lambda rows: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("corrected_time").alias("first_seen"), F.max_by("event_id", own).alias("last_event"), F.max("processed_at").alias("as_of"))
    early = t.counted.where("processed_at < 1705363200000")
    for delta in (cells(early), cells(t.counted), cells(early), cells(t.counted)):  # deltas that come again change nothing
        upsert(t.spark, path, delta, keys, {"n": "greatest", "first_seen": "least", "last_event": "last"}, ["day"], ["as_of"])
    return t.spark.read.parquet(path)


@query("q_server_dims", f"""WITH {_BOTH} SELECT tx AS transaction_id, CASE WHEN first_seen_ms IS NULL THEN 'unknown' ELSE CAST({O.day('first_seen_ms')} AS VARCHAR) END AS install_cohort,
CASE WHEN first_seen_ms IS NULL THEN 'unknown' ELSE CAST(conv.day - {O.day('first_seen_ms')} AS VARCHAR) END AS days_since_install FROM conv LEFT JOIN spine USING (game_id, user_id)""")
def _(t):
    return M.server_dims(t.converted, S.user_spine(t.sessions), CFG).select("transaction_id", "install_cohort", "days_since_install")


@query("q_conversion_rate", f"""WITH {_BOTH}, f AS (SELECT game_id, user_id, arg_min(day, (processed_at, server_received_time, event_id)) AS fd FROM conv WHERE user_id IS NOT NULL GROUP BY 1, 2), w AS (SELECT game_id, count(*) AS new_users FROM spine WHERE {O.day('first_seen_ms')} BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY 1)
SELECT game_id, {n('count(f.user_id)', 'first_payers')}, {n('coalesce(any_value(new_users), 0)', 'new_users')}, {r6('count(f.user_id) / nullif(any_value(new_users), 0)', 'rate')} FROM (SELECT DISTINCT game_id FROM spine) g LEFT JOIN w USING (game_id) LEFT JOIN (SELECT * FROM f WHERE fd BETWEEN DATE '2024-01-08' AND DATE '2024-01-14') f USING (game_id) GROUP BY 1""")
def _(t):
    inside = "BETWEEN date'2024-01-08' AND date'2024-01-14'"
    spine = S.user_spine(t.sessions).withColumn("day", timex.logical_day("first_seen_ms", CFG))
    new = spine.groupBy("game_id").agg(F.count(F.when(F.expr(f"day {inside}"), 1)).alias("new_users"))
    first = M.payer_spine(t.converted).where(f"first_purchase_day {inside}").groupBy("game_id").agg(F.count(F.lit(1)).alias("first_payers"))
    both = new.join(first, "game_id", "left").na.fill(0, ["first_payers"])
    return both.withColumn("rate", F.try_divide(F.col("first_payers"), F.col("new_users")))


@query("q_negative_offset", f"WITH {O.SESSIONS} SELECT s.game_id, {d('s.arrival_day')}, {n('count(*)', 'n')} FROM sess s JOIN spine USING (game_id, user_id) WHERE provenance = 'client' AND s.start_day < {O.day('first_seen_ms')} GROUP BY 1, 2")
def _(t):
    return S.negative_offsets(t.sessions, CFG)


_GONE = "user_id IN ('u7', 'u11', 'u30')"


@query("q_erase", f"""WITH {_BOTH} SELECT game_id, {n(f'(SELECT count(*) FROM spine s WHERE s.game_id = g.game_id AND NOT {_GONE})', 'spine')}, {n(f'(SELECT count(*) FROM act a WHERE a.game_id = g.game_id AND NOT {_GONE})', 'active_days')},
{n('(SELECT count(*) FROM conv c WHERE c.game_id = g.game_id)', 'purchases')}, {n(f'(SELECT count(*) FROM conv c WHERE c.game_id = g.game_id AND {_GONE})', 'detached')}, {r6('(SELECT sum(norm) FROM conv c WHERE c.game_id = g.game_id)', 'revenue')} FROM (SELECT DISTINCT game_id FROM conv) g""")
def _(t):
    gone = t.converted.where(_GONE).select("game_id", "user_id").unionByName(S.user_spine(t.sessions).where(_GONE).select("game_id", "user_id"))
    left = privacy.erase({"spine": S.user_spine(t.sessions), "act": S.active_user_day(t.sessions), "purchases": t.converted}, gone)
    left = privacy.erase(left, gone)  # again: no change
    count = lambda rows, name: rows.groupBy("game_id").agg(F.count(F.lit(1)).alias(name))
    p = left["purchases"].groupBy("game_id").agg(F.count(F.lit(1)).alias("purchases"), F.count(F.when(F.col("user_id") == privacy.ERASED, 1)).alias("detached"), F.sum("normalized").alias("revenue"))
    return p.join(count(left["spine"], "spine"), "game_id", "left").join(count(left["act"], "active_days"), "game_id", "left").na.fill(0, ["spine", "active_days"])


@query("q_erasure_states", f"""WITH {_BOTH}, days AS (SELECT game_id, user_id, day FROM act UNION SELECT game_id, user_id, day FROM conv WHERE user_id IS NOT NULL)
SELECT game_id, user_id, {n('count(*)', 'n_days')}, bool_and(1705363200000 >= (day - DATE '1970-01-01' + 3) * CAST(86400000 AS BIGINT)) AS all_sealed, CASE WHEN bool_and(1705363200000 >= (day - DATE '1970-01-01' + 3) * CAST(86400000 AS BIGINT)) OR user_id = 'u7' THEN 'executed' ELSE 'awaiting_seal' END AS status FROM days GROUP BY 1, 2""")
def _(t):
    days = S.active_user_day(t.sessions).select("game_id", "user_id", "day").union(t.converted.where("user_id <> ''").select("game_id", "user_id", "day")).distinct()
    asked = days.select("game_id", "user_id").distinct().withColumn("request_id", F.concat("game_id", F.lit("/"), "user_id")).withColumn("executed", F.col("user_id") == "u7")
    return privacy.erasure_states(asked, days, 1705363200000, CFG).select("game_id", "user_id", "n_days", "all_sealed", "status")


@query("q_fx_decode", f"SELECT * FROM (VALUES ('EUR', '2024-01-01', CAST(1.1 AS DOUBLE)), ('EUR', '2024-01-08', CAST(1.11 AS DOUBLE)), ('JPY', '2024-01-08', CAST(0.0068 AS DOUBLE))) AS v(currency, rate_date, rate)")
def _(t):
    table = '{"EUR":{"2024-01-01":1.1,"2024-01-08":1.11,"2024-1-9":1.2,"2024-02-31":1.2,"2024-01-15":"1.3","2024-01-16":null},"JPY":{"2024-01-08":0.0068},"GBP":5,"CHF":{}}'
    return t.spark.range(1).select(F.inline(M.fx_table(F.lit(table))))


@query("q_reconcile_booked", f"""WITH {O.MONEY} SELECT game_id, {d('day')}, {r6('sum(norm)', 'revenue')}, {r6("coalesce(sum(norm) FILTER (WHERE product_id = 'p3'), 0)", 'unknown_revenue')} FROM conv GROUP BY 1, 2 HAVING count(*) FILTER (WHERE product_id <> 'p3') > 0 OR sum(norm) > 0.000001""")
def _(t):
    lost = M.cells(t.dims, CFG).where("product_id <> 'p3'")  # cells that a fault has lost
    again = M.booked(M.booked(lost, t.converted, CFG), t.converted, CFG)
    return again.groupBy("game_id", "day").agg(F.sum("revenue").alias("revenue"), F.coalesce(F.sum(F.when(F.col("product_id") == "unknown", F.col("revenue"))), F.lit(0)).alias("unknown_revenue"))


@query("q_period_compare", f"""WITH {O.ROUTED}, p(period, first, last, pfirst, plast) AS (VALUES ('24h', DATE '2024-01-31', DATE '2024-01-31', DATE '2024-01-30', DATE '2024-01-30'), ('7d', DATE '2024-01-25', DATE '2024-01-31', DATE '2024-01-18', DATE '2024-01-24'),
('30d', DATE '2024-01-02', DATE '2024-01-31', DATE '2023-12-03', DATE '2024-01-01'), ('90d', DATE '2023-11-03', DATE '2024-01-31', DATE '2023-08-05', DATE '2023-11-02'), ('custom', DATE '2024-01-10', DATE '2024-01-12', DATE '2024-01-07', DATE '2024-01-09'))
SELECT period, {n('count(*) FILTER (WHERE day BETWEEN first AND last)', 'events')}, {n('count(*) FILTER (WHERE day BETWEEN pfirst AND plast)', 'before')}, period <> 'custom' AS provisional FROM p CROSS JOIN counted GROUP BY period""")
def _(t):
    today = datetime.date.fromisoformat(AS_OF)
    chosen = [periods.resolve(name, today, "2024-01-10", "2024-01-12") for name in (*periods.PRESETS, "custom")]
    days = t.counted.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    inside = lambda a, b: F.coalesce(F.sum(F.when(F.col("day").between(F.lit(a), F.lit(b)), F.col("n"))), F.lit(0))
    sums = days.agg(*[F.struct(F.lit(p.name).alias("period"), inside(p.first, p.last).alias("events"), inside(p.previous_first, p.previous_last).alias("before"), F.lit(p.provisional).alias("provisional")).alias(p.name) for p in chosen])
    return sums.select(F.inline(F.array(*[F.col(f"`{p.name}`") for p in chosen])))


@query("q_formats", """SELECT event_id, replace(printf('%,d', CAST(floor(value * 100 + 0.5) AS BIGINT)), '.', ',') AS a_count, CASE WHEN value * 100 >= 1000 THEN printf('%.1f', floor(value * 100 / 1000 * 10 + 0.5) / 10) || 'K' ELSE CAST(CAST(floor(value * 100 + 0.5) AS BIGINT) AS VARCHAR) END AS a_compact,
CAST(CAST(floor(s / 60) AS BIGINT) AS VARCHAR) || 'm ' || CAST(s % 60 AS VARCHAR) || 's' AS a_duration FROM (SELECT event_id, value, CAST(floor(value + 0.5) AS BIGINT) AS s FROM events WHERE event_id % 20 = 0)""")
def _(t):
    e = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").where("event_id % 20 = 0")
    return e.select("event_id", periods.count(F.col("value") * 100).alias("a_count"), periods.compact(F.col("value") * 100).alias("a_compact"), periods.duration(F.col("value") * 1000).alias("a_duration"))


@query("q_session_average_day", f"""WITH {O.SESSIONS}, g AS (SELECT DISTINCT game_id FROM sess), x AS (SELECT CAST(unnest(range(DATE '2023-12-25', DATE '2024-02-06', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT g.game_id, CAST(x.day AS VARCHAR) AS day, {r6('coalesce(sum(part) / count(p.game_id), 0)', 'average_ms')} FROM g CROSS JOIN x LEFT JOIN day_parts p ON p.game_id = g.game_id AND p.on_day = x.day GROUP BY 1, 2""")
def _(t):
    return S.average_by_day(t.sessions, "2023-12-25", "2024-02-05", CFG)


@query("q_top_package_count", f"""WITH {O.MONEY}, s AS (SELECT game_id, in_game_state, product_id, sum(norm) AS revenue, count(*) AS n FROM dims GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY game_id, in_game_state ORDER BY n DESC, product_id) AS i FROM s)
SELECT game_id, in_game_state, product_id, {r6('revenue', 'revenue')}, {n('n', 'n')} FROM r WHERE i = 1""")
def _(t):
    return M.top_package(t.dims, "in_game_state", "n")


@query("q_cell_local", f"""WITH {O.MONEY} SELECT game_id, product_id, {d('day')}, currency, {r6('sum(price)', 'local')} FROM dims GROUP BY 1, 2, 3, 4""")
def _(t):
    return M.local_sums(t.dims, CFG).groupBy("game_id", "product_id", "day", "currency").agg(F.sum("local").alias("local"))


@query("q_funnel_steps", f"""WITH {O.ROUTED}, a AS (SELECT game_id, user_id, name, corrected_time AS t FROM counted WHERE user_id IS NOT NULL), s1 AS (SELECT game_id, user_id, min(t) AS t1 FROM a WHERE name = 'session' GROUP BY 1, 2),
s2 AS (SELECT s1.*, min(t) AS t2 FROM s1 JOIN a USING (game_id, user_id) WHERE name = 'economy' AND t > t1 AND t <= t1 + 604800000 GROUP BY ALL), s3 AS (SELECT s2.*, min(t) AS t3 FROM s2 JOIN a USING (game_id, user_id) WHERE name = 'purchase' AND t > t2 AND t <= t1 + 604800000 GROUP BY ALL),
x AS (SELECT game_id, 1 AS step, NULL AS took FROM s1 UNION ALL SELECT game_id, 2, t2 - t1 FROM s2 UNION ALL SELECT game_id, 3, t3 - t2 FROM s3), r AS (SELECT game_id, step, count(*) AS reached, quantile_disc(took, 0.5) AS median_ms FROM x GROUP BY 1, 2),
l AS (SELECT *, CASE WHEN step = 1 THEN 1.0 ELSE reached / lag(reached) OVER (PARTITION BY game_id ORDER BY step) END AS rate FROM r)
SELECT game_id, {n('step', 'step')}, ['session', 'economy', 'purchase'][step] AS name, {n('reached', 'reached')}, {r6('rate', 'rate')}, {r6('1 - rate', 'drop_off')}, {n('median_ms', 'median_ms')} FROM l""")
def _(t):
    return privacy.funnel_steps(t.counted.where("user_id IS NOT NULL"), ("session", "economy", "purchase"), 7 * 86_400_000)


@query("q_dsar_bundle", f"""WITH {_BOTH}, {O.ECONOMY.removeprefix(O.ROUTED).removeprefix(',').strip()}
SELECT 'active_days' AS section, '{{"day":"' || CAST(day AS VARCHAR) || '"}}' AS item FROM act WHERE game_id = 'g1' AND user_id = 'u7' UNION ALL
SELECT 'balances', '{{"currency":"' || currency || '","balance":' || CAST(balance AS VARCHAR) || '}}' FROM bal WHERE game_id = 'g1' AND user_id = 'u7' UNION ALL
SELECT 'first_seen', '{{"first_seen_ms":' || CAST(first_seen_ms AS VARCHAR) || '}}' FROM spine WHERE game_id = 'g1' AND user_id = 'u7' UNION ALL
SELECT 'purchases', '{{"transaction_id":"' || tx || '","product_id":"' || product_id || '","currency":"' || conv.currency || '"}}' FROM conv WHERE game_id = 'g1' AND user_id = 'u7' UNION ALL
SELECT 'sessions', '{{"start_ms":' || CAST(start_ms AS VARCHAR) || ',"end_ms":' || CAST(end_ms AS VARCHAR) || '}}' FROM sess WHERE game_id = 'g1' AND user_id = 'u7'""")
def _(t):
    own = ["game_id", "user_id"]
    return privacy.export({
        "active_days": S.active_user_day(t.sessions).select(*own, "day"), "balances": ECO.balances(t.flows).select(*own, "currency", "balance"), "first_seen": S.user_spine(t.sessions),
        "purchases": t.converted.select(*own, "transaction_id", "product_id", "currency"), "sessions": t.sessions.select(*own, "start_ms", "end_ms"),
    }, "g1", "u7")


def _card(name: str, sql: str) -> str:
    return f"SELECT '{name}' AS card, p.period, {r6(sql, 'value')} FROM p"


@query("q_overview_cards", f"""WITH {_BOTH}, p(period, first, last) AS (VALUES ('current', DATE '2024-01-18', DATE '2024-01-24'), ('previous', DATE '2024-01-11', DATE '2024-01-17')), f AS (SELECT {O.day('first_seen_ms')} AS day FROM spine)
{_card('events', '(SELECT count(*) FROM counted WHERE day BETWEEN first AND last)')} UNION ALL {_card('sessions', '(SELECT count(*) FROM sess WHERE start_day BETWEEN first AND last)')} UNION ALL
{_card('users', '(SELECT count(*) FROM (SELECT DISTINCT game_id, user_id FROM act WHERE day BETWEEN first AND last))')} UNION ALL {_card('new_users', '(SELECT count(*) FROM f WHERE day BETWEEN first AND last)')} UNION ALL
{_card('revenue', '(SELECT coalesce(sum(norm), 0) FROM conv WHERE day BETWEEN first AND last)')} UNION ALL {_card('payers', '(SELECT count(*) FROM (SELECT DISTINCT game_id, user_id FROM conv WHERE user_id IS NOT NULL AND day BETWEEN first AND last))')} UNION ALL
{_card('average_session_ms', '(SELECT coalesce(sum(part) / nullif(count(*), 0), 0) FROM day_parts WHERE on_day BETWEEN first AND last)')} UNION ALL {_card('put_aside', "(SELECT count(*) FROM sealed WHERE reason IS NOT NULL AND reason <> 'nameless' AND arrival_day BETWEEN first AND last)")}""")
def _(t):
    chosen = periods.resolve("7d", datetime.date(2024, 1, 24))
    spans = (("current", chosen.first, chosen.last), ("previous", chosen.previous_first, chosen.previous_last))
    users = lambda rows, day: F.count_distinct(F.when(day, F.struct("game_id", "user_id")))
    act, spine = S.active_user_day(t.sessions), S.user_spine(t.sessions).withColumn("day", timex.logical_day("first_seen_ms", CFG))
    result = S.session_day_result(t.sessions, CFG)
    cards = {
        "events": (t.counted, "day", lambda x: F.count(F.when(x, 1))), "sessions": (t.sessions, "start_day", lambda x: F.count(F.when(x, 1))), "users": (act, "day", lambda x: users(act, x)), "new_users": (spine, "day", lambda x: F.count(F.when(x, 1))),
        "revenue": (t.converted, "day", lambda x: F.coalesce(F.sum(F.when(x, F.col("normalized"))), F.lit(0))), "payers": (t.converted.where("user_id <> ''"), "day", lambda x: users(act, x)),
        "average_session_ms": (result, "on_day", lambda x: F.coalesce(F.try_divide(F.sum(F.when(x, F.col("duration_sum_ms"))).cast("double"), F.sum(F.when(x, F.col("sessions_touching")))), F.lit(0.0))),
        "put_aside": (t.routed.where("disposition = 'quarantine'"), "arrival_day", lambda x: F.count(F.when(x, 1))),
    }
    out = None
    for name, (rows, day, value) in cards.items():  # a scan a card, both periods at once
        both = rows.agg(*[value(F.col(day).between(F.lit(a), F.lit(b))).cast("double").alias(period) for period, a, b in spans])
        part = both.select(F.lit(name).alias("card"), F.expr("stack(2, 'current', current, 'previous', previous) AS (period, value)"))
        out = part if out is None else out.unionByName(part)
    return out


@query("q_kind_dispatch", f"""WITH {O.ROUTED} SELECT rk AS kind, {n('count(*)', 'n')} FROM counted WHERE rk <> 'purchase' GROUP BY 1 UNION ALL SELECT 'purchase', {n('count(*)', 'n')} FROM counted WHERE money""")
def _(t):
    out = None
    for kind, rows in dispatch(t.routed, CFG).items():
        part = rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("q_currency_allowlist", f"WITH {O.ROUTED} SELECT game_id, json_extract_string(props, '$.currency_type') AS raw_currency, {n('count(*)', 'n')} FROM counted WHERE rk = 'economy' AND json_extract_string(props, '$.currency_type') IN ('gold', 'gems') GROUP BY 1, 2")
def _(t):
    return ECO.flows(t.routed, CFG, ("gold", "gems")).groupBy("game_id", "raw_currency").agg(F.count(F.lit(1)).alias("n"))
