"""The front door: every envelope gets its verdicts as columns, in the fixed order parse, scrub, skew, day, route,
validate, cap, seal, dedup. Rollups are queries over what routed() returns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import DEFAULT, Config
from ..functions import timex

#: Reserved names, dropped property keys, what looks personal in a text, disposition of each reason.
TYPED = ("economy", "purchase", "session")
PII_KEYS = ("email", "e_mail", "ip", "ip_address", "phone", "phone_number", "name", "full_name", "first_name", "last_name", "address", "street", "ssn", "password", "credit_card")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IP = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
DIGITS = r"(?:\d[ -]?){9,}"
DISPOSITION = {"nameless": "drop", "unparseable": "drop", "rate_limited": "drop", "quarantined_typed": "quarantine", "sealed_late": "quarantine", "unknown_kind": "quarantine", "time_fallback": "quarantine"}
#: Fields that a typed event is judged and told apart by: their texts are not searched for personal data.
OWN_FIELDS = {
    "session": ("session_id", "session_start_time", "session_end_time"),
    "economy": ("currency_type", "reason"),
    "purchase": ("transaction_id", "original_transaction_id", "product_id", "product_category", "purchase_attempt_id"),
}

#: Kinds of a variant that are numbers.
NUMBER = "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"
ARRIVAL = ("processed_at", "server_received_time", "event_id")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns worked out once a row: later expressions refer to them instead of repeating what they stand for."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def prop(key: str) -> Column:
    return F.get_json_object("props", f"$.{key}")


def _field(key: str) -> Column:
    """A property as a variant, from the fields that were parsed once a row."""
    return F.try_element_at(F.col("fields"), F.lit(key))


def _kind(key: str) -> Column:
    return F.schema_of_variant(_field(key))


def _text(key: str) -> Column:
    return F.try_variant_get(_field(key), "$", "string")


def _number(key: str) -> Column:
    return F.try_variant_get(_field(key), "$", "double")


def _is_text(key: str) -> Column:
    return F.coalesce((_kind(key) == "STRING") & (F.length(_text(key)) > 0), F.lit(False))


def _is_number(key: str) -> Column:
    return F.coalesce(_kind(key).rlike(NUMBER), F.lit(False))


def _is_time(key: str) -> Column:
    return _is_number(key) | (_is_text(key) & F.try_to_timestamp(_text(key)).isNotNull())


def is_number(key: str) -> Column:
    """Whether a property of the stored text is a number."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json("props"), f"$.{key}", "variant")).rlike(NUMBER), F.lit(False))


def valid_session() -> Column:
    duration = _number("duration_ms")
    whole = _is_number("duration_ms") & (duration == F.floor(duration)) & (duration >= 0)
    return _is_text("session_id") & _is_time("session_start_time") & _is_time("session_end_time") & F.coalesce(whole, F.lit(False))


def valid_economy() -> Column:
    return F.coalesce(_text("flow_type").isin("source", "sink"), F.lit(False)) & _is_text("currency_type") & _is_number("amount") & F.coalesce(_number("amount") > 0, F.lit(False)) & _is_text("reason")


def valid_purchase() -> Column:
    texts = ("transaction_id", "original_transaction_id", "product_id", "product_category", "currency")
    server = _is_number("price_local") & F.coalesce(_kind("verified") == "BOOLEAN", F.lit(False)) & F.coalesce(_text("environment").isin("prod", "sandbox"), F.lit(False)) & F.coalesce(_is_text("user_id") | (F.length("user_id") > 0), F.lit(False))
    for t in texts:
        server = server & _is_text(t)
    return F.coalesce(F.when(_text("source") == "server", server).when(_text("source") == "client", _is_text("purchase_attempt_id")), F.lit(False))


def scrubbed(props: Column, kind: Column | None = None, keys=()) -> Column:
    """map<string, variant> of a JSON object's top level without denied keys; texts that look personal are redacted, but
    for the fields that events of this (typed) kind are judged by. Null where props is no JSON object."""
    denied = [k.lower() for k in (*PII_KEYS, *keys)]
    kept = F.map_filter(F.from_json(props, "map<string,variant>"), lambda k, v: ~F.lower(k).isin(denied))
    own = F.lit(False)

    def clean(k, v):
        t = F.try_variant_get(v, "$", "string")
        spared = own if kind is None else F.coalesce(F.array_contains(F.create_map(*[x for n, f in OWN_FIELDS.items() for x in (F.lit(n), F.array(*map(F.lit, f)))])[kind], k), own)
        mark = F.when(t.rlike(EMAIL), F.lit("email")).when(t.rlike(IP), F.lit("ip")).when(t.rlike(DIGITS), F.lit("digits"))
        return F.when((F.schema_of_variant(v) == "STRING") & ~spared & mark.isNotNull(), F.parse_json(F.concat(F.lit('"[redacted:'), mark, F.lit(']"')))).otherwise(v)

    return F.transform_values(kept, clean)


def scrub(props: Column, keys=()) -> Column:
    """The same as map<string, string>, of events without fields of their own."""
    return F.transform_values(scrubbed(props, None, keys), lambda _, v: F.try_variant_get(v, "$", "string"))


def _resolved() -> Column:
    """A reserved name decides, whatever kind is declared."""
    return F.when(F.col("name").isin(*TYPED), F.col("name")).otherwise(F.col("kind"))


def with_fields(env: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """env with fields: the scrubbed top level of its properties, parsed once."""
    return computed(env, fields=scrubbed(F.col("props"), _resolved(), cfg.pii_keys))


def with_times(env: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Properties scrubbed before anything else sees them, corrected time, day and day of arrival."""
    clocks = ("client_event_time", "client_sent_time", "server_received_time")
    out = with_fields(env, cfg).withColumn("props", F.to_json("fields"))
    out = computed(out, time_fallback=timex.fallback(*clocks, cfg), corrected_time=timex.corrected(*clocks, cfg))
    return computed(out, day=timex.logical_day("corrected_time", cfg), arrival_day=timex.logical_day("server_received_time", cfg))


def with_route(env: DataFrame) -> DataFrame:
    """resolved_kind, and reason of what is dropped or put aside so far."""
    blank = F.coalesce(F.trim("name"), F.lit("")) == ""
    out = computed(env if "fields" in env.columns else with_fields(env), resolved_kind=_resolved())
    valid = F.when(F.col("resolved_kind") == "session", valid_session()).when(F.col("resolved_kind") == "economy", valid_economy()).when(F.col("resolved_kind") == "purchase", valid_purchase()).otherwise(F.lit(True))
    reason = F.when(blank, "nameless").when(F.coalesce(F.trim("event_id"), F.lit("")) == "", "unparseable").when(~F.col("resolved_kind").isin("generic", *TYPED), "unknown_kind").when(~valid, "quarantined_typed")
    return computed(out, early_reason=reason)


def capped(df: DataFrame, cap: int, value: str, out: str, group: list[str], counts: Column, other: str = "other") -> DataFrame:
    """out: value, or other where value isn't among the first cap values of its group in order of arrival.

    counts says which rows take part. The ranking is over distinct values, one row each; at most cap of them a group stay,
    which bounds what is joined back.
    """
    arrival = F.struct(*ARRIVAL)
    first = df.where(counts & F.col(value).isNotNull()).groupBy(*group, value).agg(F.min(arrival).alias("__first"))
    rank = F.row_number().over(W.partitionBy(*group).orderBy("__first", value))
    known = first.withColumn("__rank", rank).where(F.col("__rank") <= cap).select(*[F.col(g).alias(f"__{g}") for g in group], F.col(value).alias("__value"), F.lit(True).alias("__known"))
    on = [F.col(g) == F.col(f"__{g}") for g in group] + [F.col(value) == F.col("__value")]
    joined = df.join(known, on, "left")
    return joined.withColumn(out, F.when(~counts | F.col(value).isNull() | F.col("__known"), F.col(value)).otherwise(F.lit(other))).drop(*[f"__{g}" for g in group], "__value", "__known")


#: Rows of one id that arrived at the same time: the first of them opens the window.
_TIES = ("game_id", "event_id", "processed_at", "server_received_time")


def _windows(df: DataFrame, claims: Column, cfg: Config) -> DataFrame:
    """df with __opens: whether a window of the row's (game, event id) opens at its time; null where the id claims once.

    Only the distinct times of ids that claim more often are looked at: they stream in order past the time at which the
    last window opened, so nothing of an id is gathered, and rows are joined by id and time, which spreads a hot id."""
    times = df.where(claims).groupBy(*_TIES).agg(F.count(F.lit(1)).alias("n"))
    often = times.groupBy("game_id", "event_id").agg(F.sum("n").alias("all")).where("all > 1").select("game_id", "event_id")
    dealt = times.join(often, ["game_id", "event_id"], "left_semi").select(*_TIES).repartition("game_id", "event_id").sortWithinPartitions(*_TIES)
    window = cfg.dedup_window_ms

    def run(batches):
        of, opened = None, 0
        for b in batches:
            opens = []
            for game, event, t in zip(*[b.column(i).to_pylist() for i in range(3)]):
                new = (game, event) != of or t - opened >= window
                if new:
                    of, opened = (game, event), t
                opens.append(new)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(opens, pa.bool_())], names=["__g", "__e", "__t", "__r", "__opens"])

    at = dealt.mapInArrow(run, "__g string, __e string, __t long, __r long, __opens boolean")
    same = (F.col("game_id") == F.col("__g")) & (F.col("event_id") == F.col("__e")) & (F.col("processed_at") == F.col("__t")) & (F.col("server_received_time") == F.col("__r"))
    return df.join(at, claims & same, "left").drop("__g", "__e", "__t", "__r")


def _numbered(df: DataFrame, needs: Column, key: list[Column]) -> DataFrame:
    """df with __nth, in order of arrival within key; only rows that need it are dealt by it, the others have 1."""
    some = df.where(needs).withColumn("__nth", F.row_number().over(W.partitionBy(*key).orderBy(*ARRIVAL)))
    return df.where(~needs).withColumn("__nth", F.lit(1)).unionByName(some)


def with_window_dedup(df: DataFrame, claims: Column, cfg: Config = DEFAULT) -> DataFrame:
    """first_in_window: whether a claiming row opens a window of its (game, event id); windows don't slide."""
    df = _numbered(_windows(df, claims, cfg), F.col("__opens").isNotNull(), [F.col(c) for c in _TIES])
    return df.withColumn("first_in_window", F.coalesce(F.col("__opens") & (F.col("__nth") == 1), F.lit(True))).drop("__opens", "__nth")


def eligible() -> Column:
    """A purchase that counts as money: the store verified it, in production, and the game's server says so."""
    return F.coalesce((F.col("resolved_kind") == "purchase") & (prop("source") == "server") & (prop("verified") == "true") & (prop("environment") == "prod") & (F.col("provenance") == "server"), F.lit(False))


def routed(env: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """env with its properties scrubbed, and corrected_time, day, arrival_day, time_fallback, resolved_kind, bucket_name,
    seal, money, reason, disposition and counted (routed, and not a repeat)."""
    df = with_route(with_times(env, cfg))
    df = capped(df, cfg.name_cap, "name", "bucket_name", ["game_id"], F.col("early_reason").isNull() & (F.col("resolved_kind") == "generic"))
    df = computed(df, seal=timex.seal_state("day", "processed_at", cfg))
    df = computed(df, reason=F.coalesce("early_reason", F.when(F.col("seal") == "sealed", "sealed_late")))
    disposition = F.when(F.col("reason").isNull(), "route").when(F.col("reason").isin("nameless", "unparseable"), "drop").otherwise("quarantine")
    open_ = F.col("reason").isNull()
    server = F.coalesce((F.col("resolved_kind") == "purchase") & (prop("source") == "server"), F.lit(False))
    df = computed(df, disposition=disposition, money=eligible() & open_, __claims=open_ & ~server)
    df = _windows(df, F.col("__claims"), cfg)
    # money is told apart by its transaction, repeats by their times: one pass over these rows alone
    ties = [F.when(~F.col("money"), F.col(c)) for c in _TIES]
    df = _numbered(df, F.col("money") | F.col("__opens").isNotNull(), [F.when(F.col("money"), prop("transaction_id")), *ties])
    counted = open_ & (F.col("__nth") == 1) & F.coalesce("__opens", F.lit(True))
    return df.withColumn("counted", counted).drop("__nth", "__opens", "__claims", "early_reason", "fields")


def exception_tally(r: DataFrame) -> DataFrame:
    return r.where("reason IS NOT NULL").groupBy("game_id", "arrival_day", "reason").agg(F.count(F.lit(1)).alias("n"))


def clock_regression(env: DataFrame) -> DataFrame:
    """Events received before the high-water mark (`high`) of those of their game that were processed earlier.

    The mark is worked out by hour of processing first, over one row an hour, and within an hour from there on."""
    hour = F.floor(F.col("processed_at") / 3_600_000)
    df = env.withColumn("__hour", hour)
    top = df.groupBy("game_id", "__hour").agg(F.max("server_received_time").alias("__top"))
    earlier = top.select("game_id", "__hour", F.max("__top").over(W.partitionBy("game_id").orderBy("__hour").rowsBetween(W.unboundedPreceding, -1)).alias("__high"))
    w = W.partitionBy("game_id", "__hour").orderBy(*ARRIVAL).rowsBetween(W.unboundedPreceding, -1)
    own = df.withColumn("__own", F.max("server_received_time").over(w)).join(earlier, ["game_id", "__hour"])
    return own.withColumn("high", F.greatest("__own", "__high")).where("server_received_time < high").drop("__hour", "__own", "__high")


def rate_limited(batches: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """batches (game_id, at ms, n) with admitted: a token bucket a game, all of a batch or nothing; cost min(n, burst).

    A batch's verdict hangs on all earlier ones of its game, so each game's are folded in order; the state is two
    numbers, and rows stream past it: nothing of a game is gathered.
    """
    burst, per_ms = float(cfg.rate_burst), cfg.rate_per_s / 1000

    def run(rows):
        game, tokens, last = None, burst, 0
        for b in rows:
            admitted = []
            for g, at, n in zip(*[b.column(i).to_pylist() for i in range(3)]):
                if g != game:
                    game, tokens, last = g, burst, at
                tokens, last = min(burst, tokens + (at - last) * per_ms), at
                cost = min(float(n), burst)
                admitted.append(tokens >= cost)
                tokens -= cost if admitted[-1] else 0.0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(admitted, pa.bool_())], names=["game_id", "at", "n", "admitted"])

    dealt = batches.select("game_id", F.col("at").cast("long"), F.col("n").cast("long")).repartition("game_id").sortWithinPartitions("game_id", "at", "n")
    return dealt.mapInArrow(run, "game_id string, at long, n long, admitted boolean")
