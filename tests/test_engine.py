import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gamelode.config import Config
from gamelode.functions import timex
from gamelode.operators import economy, kernel, merge, monetization, privacy, sessions
from gamelode.sources import envelopes

H = 3_600_000


def times(spark, event, sent, recv):
    df = spark.createDataFrame([(event, sent, recv)], "e long, s long, r long")
    return tuple(df.select(timex.corrected("e", "s", "r"), timex.fallback("e", "s", "r")).first())


@pytest.mark.parametrize(
    "event,sent,recv,want",
    [
        (1000 * H, 1000 * H, 1000 * H + 60_000, (1000 * H, False)),  # the dead band holds its edge
        (1000 * H, 1000 * H, 1000 * H + 60_001, (1000 * H + 60_001, False)),
        (1000 * H + 500, 1000 * H, 1000 * H + 100, (1000 * H + 100, False)),  # never after receipt
        (1000 * H, 1026 * H, 1026 * H, (1000 * H, False)),
        (1000 * H, 1026 * H + 1, 1026 * H + 1, (1026 * H + 1, True)),
    ],
)
def test_skew(spark, event, sent, recv, want):
    assert times(spark, event, sent, recv) == want


def test_days_and_seals(spark):
    df = spark.createDataFrame([(-1,), (0,), (86_399_999,), (22 * H,)], "t long")
    assert [str(r[0]) for r in df.select(timex.logical_day("t")).collect()] == ["1969-12-31", "1970-01-01", "1970-01-01", "1970-01-01"]
    assert [str(r[0]) for r in df.select(timex.logical_day("t", Config(reporting_offset_min=210))).collect()][3] == "1970-01-02"
    s = spark.createDataFrame([(24 * H - 1,), (24 * H,), (72 * H - 1,), (72 * H,)], "now long").select(timex.seal_state(F.lit("1970-01-01").cast("date"), "now"))
    assert [r[0] for r in s.collect()] == ["open", "grace", "grace", "sealed"]


def test_session_split(spark):
    day = 1_000 * 24 * H
    df = spark.createDataFrame([("g", "a", day + 23 * H + 40 * 60_000, day + 24 * H + 35 * 60_000), ("g", "b", day + 33 * H, day + 33 * H + 600_000)], "game_id string, event_id string, start_ms long, end_ms long")
    df = df.withColumn("start_day", timex.logical_day("start_ms")).withColumn("end_day", timex.logical_day("end_ms"))
    got = {str(r.on_day): (r.session_count, r.duration_sum_ms // 60_000, r.sessions_touching) for r in sessions.session_day_result(df).collect()}
    assert list(got.values()) == [(1, 20, 1), (1, 45, 2)] or sorted(got.values()) == [(1, 20, 1), (1, 45, 2)]


def test_dedup_window_does_not_slide(spark):
    rows = [("g", "e", h * H, h * H) for h in (0, 23, 25, 40, 50)]
    df = spark.createDataFrame(rows, "game_id string, event_id string, processed_at long, server_received_time long")
    got = kernel.with_window_dedup(df, F.lit(True)).where("first_in_window").select("processed_at").collect()
    assert sorted(r[0] // H for r in got) == [0, 25, 50]


def test_equal_repeats_count_once(spark):
    """Rows of one id with equal times, as in a batch that was sent twice."""
    rows = [("g", "e", 5 * H, 5 * H)] * 3 + [("g", "e", 29 * H, 29 * H)] * 2 + [("g", "f", 5 * H, 5 * H)]
    df = spark.createDataFrame(rows, "game_id string, event_id string, processed_at long, server_received_time long")
    got = kernel.with_window_dedup(df, F.lit(True)).where("first_in_window").select("event_id", "processed_at").collect()
    assert sorted((r[0], r[1] // H) for r in got) == [("e", 5), ("e", 29), ("f", 5)]


def test_nothing_personal_is_routed(spark):
    t = 1_704_100_000_000
    events = [
        ("generic", '{"Email":"x","note":"me@x.org","n":5}'),
        ("purchase", '{"source":"server","transaction_id":"1234567890123456","original_transaction_id":"1-2-3-4-5-6-7-8-9","product_id":"p","product_category":"c","price_local":1.5,"currency":"USD","verified":true,"environment":"prod","phone":"1","memo":"call 1.2.3.4"}'),
        ("generic", "no json"),
    ]
    rows = [("g", "server", t, t, "u", f"e{i}", k, k, t, t, p) for i, (k, p) in enumerate(events)]
    env = spark.createDataFrame(rows, "game_id string, provenance string, server_received_time long, processed_at long, user_id string, event_id string, name string, kind string, client_event_time long, client_sent_time long, props string")
    got = {r.event_id: r for r in kernel.routed(env).collect()}
    assert json.loads(got["e0"].props) == {"note": "[redacted:email]", "n": 5}
    props = json.loads(got["e1"].props)
    assert props["transaction_id"] == "1234567890123456" and props["memo"] == "[redacted:ip]" and "phone" not in props and got["e1"].counted and got["e1"].money
    assert got["e2"].props is None and "fields" not in env.columns


def test_scrub(spark):
    df = spark.createDataFrame([('{"EMAIL":"x","a":"me@x.org","b":"1.2.3.4","c":"12 345 678 90","d":"ok","e":123456789012}',)], "props string")
    got = df.select(kernel.scrub(F.col("props")).alias("m")).first().m
    assert got == {"a": "[redacted:email]", "b": "[redacted:ip]", "c": "[redacted:digits]", "d": "ok", "e": "123456789012"}


def test_validators(spark):
    rows = [
        ("economy", '{"flow_type":"source","currency_type":"gold","amount":5,"reason":"r"}', True),
        ("economy", '{"flow_type":"source","currency_type":"gold","amount":0,"reason":"r"}', False),
        ("economy", '{"flow_type":"source","currency_type":"gold","amount":"5","reason":"r"}', False),
        ("session", '{"session_id":"s","session_start_time":1,"session_end_time":"2024-01-01T00:00:00Z","duration_ms":0}', True),
        ("session", '{"session_id":"s","session_start_time":1,"session_end_time":2,"duration_ms":1.5}', False),
        ("session", '{"session_id":"s"}', False),
        ("purchase", '{"source":"client","purchase_attempt_id":"p"}', True),
        ("purchase", '{"purchase_attempt_id":"p"}', False),
        ("purchase", "not json", False),
        ("purchase", '{"source":"server","transaction_id":"t","original_transaction_id":"t","product_id":"p","product_category":"c","price_local":1.5,"currency":"USD","verified":true,"environment":"prod"}', True),
    ]
    df = spark.createDataFrame([(k, p, "u", "e", k) for k, p, _ in rows], "name string, props string, user_id string, event_id string, kind string")
    got = {r.props: r.early_reason is None for r in kernel.with_route(df).collect()}
    assert got == {p: w for _, p, w in rows}


def test_level_bucket_and_combo(spark):
    df = spark.createDataFrame([(9,), (10,), (19,), (50,), (None,)], "l long")
    assert [r[0] for r in df.select(economy.level_bucket(F.col("l"))).collect()] == ["<10", "10-19", "10-19", "50+", None]
    df = spark.createDataFrame([("a|b=c\\", None)], "region string, tier string")
    combo = monetization.dim_combo({"region": F.col("region"), "tier": F.col("tier")})
    row = df.select(combo.alias("c")).select("c", monetization.parse_combo(F.col("c")).alias("m")).first()
    assert row.c == "region=a\\|b\\=c\\\\|tier=unknown" and row.m == {"region": "a|b=c\\", "tier": "unknown"}


def test_whale(spark):
    rows = [("g", f"u{i}", v) for i, v in enumerate((500, 200, 120, 80, 40, 30, 15, 10, 3, 2))]
    df = spark.createDataFrame(rows, "game_id string, user_id string, v int").withColumn("day", F.lit("2024-01-01").cast("date")).withColumn("normalized", F.col("v").cast("decimal(24,6)"))
    got = {r.pct: (r.share, r.low_confidence) for r in monetization.whale(df).collect()}
    assert got == {1: (0.5, True), 5: (0.5, True), 10: (0.5, True)}


def test_subject_ref(spark):
    df = spark.createDataFrame([("g1", "u7"), ("g2", "é" * 70)], "game_id string, user_id string")
    for r in df.withColumn("s", privacy.subject_ref("game_id", "user_id", "m")).collect():
        assert r.s == privacy.subject_ref_of(r.game_id, r.user_id, "m")
    assert hashlib.sha256(b"").hexdigest()


def test_rate_limit(spark):
    df = spark.createDataFrame([("g", 0, 3), ("g", 0, 3), ("g", 1000, 2), ("g", 9000, 50)], "game_id string, at long, n long")
    got = kernel.rate_limited(df, Config(rate_per_s=1, rate_burst=5)).orderBy("at", "n").collect()
    assert [r.admitted for r in got] == [True, False, True, True]


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([("a", 5, 1, ["x"], 10), ("b", 1, 4, [], 20)], "k string, n int, first int, s array<string>, as_of int")
    new = spark.createDataFrame([("a", 3, 0, ["y"], 11), ("c", 9, 9, ["z"], 1)], "k string, n int, first int, s array<string>, as_of int")
    kinds = {"n": "greatest", "first": "least", "s": "union", "as_of": "last"}
    once = merge.merged(old, new, ["k"], kinds, ["as_of"])
    twice = merge.merged(once, new, ["k"], kinds, ["as_of"])
    want = {("a", 5, 0, ("x", "y"), 11), ("b", 1, 4, (), 20), ("c", 9, 9, ("z",), 1)}
    for df in (once, twice):
        assert {(r.k, r.n, r.first, tuple(r.s), r.as_of) for r in df.select("k", "n", "first", "s", "as_of").collect()} == want


def test_frames(spark, tmp_path):
    whole = envelopes.encode_frame('{"a":1}') + envelopes.encode_frame('{"b":2}')
    (tmp_path / "x.rawlog").write_bytes(whole + envelopes.encode_frame('{"c":3}')[:-4])
    got = envelopes.decode_frames(spark, str(tmp_path)).collect()
    assert [(r.payload, r.truncated_tail) for r in got] == [('{"a":1}', True), ('{"b":2}', True)]


def test_batches(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"credential":"k","server_received_time":5,"processed_at":6,"events":[{"event_id":"e","name":"n","game_id":"other","props":{"k":1}}]}\n')
    creds = spark.createDataFrame([("k", "g1", "client")], "credential string, game_id string, provenance string")
    row = envelopes.read_batches(spark, str(tmp_path), creds).first()
    assert (row.game_id, row.provenance, row.v, row.props) == ("g1", "client", 1, '{"k":1}')


def test_stream(spark, tmp_path):
    import json

    from gamelode.streaming import rollups

    t = 1_704_100_000_000
    event = dict(game_id="g", provenance="client", server_received_time=t, processed_at=t, user_id="u", name="n", kind="generic", client_event_time=t, client_sent_time=t, props="{}")
    rows = [event | {"event_id": "a"}, event | {"event_id": "a"}, event | {"event_id": "b"}, event | {"event_id": "c", "name": " "}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text("\n".join(map(json.dumps, rows)))
    for q in rollups.day_counts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "aside"), str(tmp_path / "cp")):
        q.awaitTermination(120)
    assert [r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "aside")).collect()] == ["nameless"]


def test_periods():
    import datetime

    from gamelode.functions import periods

    today = datetime.date(2024, 3, 1)
    day = datetime.date.fromisoformat
    p = periods.resolve("7d", today)
    assert (p.first, p.last, p.previous_first, p.previous_last, p.provisional, p.days) == (day("2024-02-24"), today, day("2024-02-17"), day("2024-02-23"), True, 7)
    assert periods.resolve("24h", today).first == today and periods.resolve("nonsense", today).name == "7d"
    p = periods.resolve("custom", today, "2024-02-28", "2024-02-29")
    assert (p.days, p.previous_first, p.previous_last, p.provisional) == (2, day("2024-02-26"), day("2024-02-27"), False)
    assert periods.resolve("custom", today, "2024-03-02", "2024-02-01").name == periods.resolve("custom", today, "2024-02-30", "2024-03-01").name == "7d"


def test_formats(spark):
    from gamelode.functions import periods

    df = spark.createDataFrame([(1234.5,), (45231.0,), (8420000.0,), (-3.2,), (None,), (float("nan"),)], "v double")
    assert [r[0] for r in df.select(periods.compact(F.col("v"))).collect()] == ["1.2K", "45.2K", "8.4M", "-3", "N/A", "N/A"]
    assert [r[0] for r in df.select(periods.money(F.col("v"))).collect()][:2] == ["$1,234.50", "$45,231.00"]
    ms = spark.createDataFrame([(744_000,), (8_100_000,), (-1,), (None,)], "v long")
    assert [r[0] for r in ms.select(periods.duration(F.col("v"))).collect()] == ["12m 24s", "2h 15m", "N/A", "N/A"]
    assert df.select(periods.percent(F.lit(0.1478))).first()[0] == "14.8%"


def test_raw_files_and_their_keys(spark, tmp_path):
    from pyspark.errors import PySparkException

    from gamelode.sources import raw

    day = F.lit("2024-01-01").cast("date")
    rows = spark.createDataFrame([("g", "e1", "route", "{}"), ("g", "e2", "quarantine", "{}"), ("h", "e3", "drop", "{}")], "game_id string, event_id string, disposition string, props string").withColumn("day", day)
    for _ in range(2):  # appends
        raw.append_raw(rows, str(tmp_path / "raw"))
    got = raw.read_raw(spark, str(tmp_path / "raw")).groupBy("game_id", "corrected_day", "class").count().collect()
    assert sorted(map(tuple, got)) == [("g", "2024-01-01", "body", 2), ("g", "2024-01-01", "quarantine", 2)]
    local = raw.manifest(spark, str(tmp_path / "raw"))
    first = local.limit(1)
    assert all(len(r.sha256) == 64 and r.object_key == "raw/g/2024-01-01.rawlog" for r in local.collect())
    states = {r.state for r in raw.shipment(local, first.withColumn("sha256", F.lit("0")).select("path", "size", "sha256"), F.lit("2024-02-01")).collect()}
    assert states == {"mismatch", "ship"}
    assert {r.state for r in raw.shipment(local, first.select("path", "size", "sha256"), F.lit("2024-01-01")).collect()} == {"wait"}
    with pytest.raises(PySparkException):
        rows.select(raw.object_key(F.lit("../x"), F.lit("2024-01-01"))).collect()


def test_upsert_replaces_touched_partitions_alone(spark, tmp_path):
    path, kinds = str(tmp_path / "t"), {"n": "greatest"}
    one = spark.createDataFrame([("a", "d1", 5), ("b", "d2", 7)], "k string, day string, n long")
    merge.upsert(spark, path, one, ["k", "day"], kinds, ["day"])
    kept = sorted(p.name for p in (tmp_path / "t/day=d2").iterdir())
    for _ in range(2):
        merge.upsert(spark, path, spark.createDataFrame([("a", "d1", 4), ("c", "d1", 1), ("a", "d3", 2)], "k string, day string, n long"), ["k", "day"], kinds, ["day"])
    got = {(r.k, r.day, r.n) for r in spark.read.schema("k string, n long, day string").parquet(path).collect()}
    assert got == {("a", "d1", 5), ("c", "d1", 1), ("b", "d2", 7), ("a", "d3", 2)}
    assert sorted(p.name for p in (tmp_path / "t/day=d2").iterdir()) == kept


def test_purchases_are_detached_or_deleted(spark):
    p = spark.createDataFrame([("g", "u", 5), ("g", "v", 6), ("h", "u", 7), ("g", None, 8)], "game_id string, user_id string, amount int")
    who = spark.createDataFrame([("g", "u")], "game_id string, user_id string")
    detached = privacy.erase({"purchases": p, "spine": p}, who)
    assert sorted((r.user_id or "", r.amount) for r in detached["purchases"].collect()) == [("", 8), ("__erased__", 5), ("u", 7), ("v", 6)]
    assert sorted(r.amount for r in detached["spine"].collect()) == [6, 7, 8]
    assert sorted(r.amount for r in privacy.erase({"purchases": p}, who, "delete")["purchases"].collect()) == [6, 7, 8]


def test_stream_caps_names_and_counts_money_once(spark, tmp_path):
    from gamelode.streaming import rollups

    t = 1_704_100_000_000
    base = dict(game_id="g", provenance="server", user_id="u", kind="generic", props="{}")
    paid = '{"source":"server","transaction_id":"t1","original_transaction_id":"t1","product_id":"p","product_category":"c","price_local":1.5,"currency":"USD","verified":true,"environment":"prod"}'

    def event(i, name, at, **more):
        return base | dict(event_id=f"e{i}", name=name, server_received_time=at, processed_at=at, client_event_time=at, client_sent_time=at) | more

    batches = [
        [event(1, "b", t), event(2, "a", t + 1), event(3, "purchase", t, kind="purchase", props=paid), event(4, "purchase", t + 5, kind="purchase", props=paid)],
        [event(5, "c", t + 10), event(6, "a", t + 11), event(7, "purchase", t + 12, kind="purchase", props=paid), event(1, "b", t + 13)],
    ]
    where = [str(tmp_path / x) for x in ("in", "out", "aside", "cp")]
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        (tmp_path / f"in/{i}.json").write_text("\n".join(map(json.dumps, rows)))
        for q in rollups.day_counts(spark, *where, cfg=Config(name_cap=2)):
            q.awaitTermination(120)
    got = rollups.totals(spark, where[1]).collect()
    assert {r.bucket_name: r.n for r in got} == {"a": 2, "b": 1, "other": 1, "purchase": 1}
    open_ = rollups.provisional(rollups.totals(spark, where[1]), t).select("provisional").distinct().collect()
    assert [r[0] for r in open_] == [True]


def test_live_sessions_split_where_batch_does(spark, tmp_path):
    from gamelode.streaming import rollups

    gap, t = 30 * 60_000, 1_704_100_000_000
    times = [t, t + gap - 1, t + 2 * gap - 1, t + 5 * gap, t + 5 * gap]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/0.json").write_text("\n".join(json.dumps({"user_id": "u", "t": x}) for x in times))
    stream = spark.readStream.schema("user_id string, t long").json(str(tmp_path / "in"))
    for last in (False, True):
        q = rollups.live_sessions(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        (tmp_path / "in/1.json").write_text(json.dumps({"user_id": "v", "t": t + 90 * gap}))
    got = sorted((r.start_ms, r.end_ms, r.n_events) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = spark.createDataFrame([("u", x) for x in times], "user_id string, t long")
    assert got == sorted((r.start_ms, r.end_ms, r.n_events) for r in sessions.sessionize(batch, gap).collect())


def test_a_games_own_knobs():
    from gamelode.config import for_game

    assert for_game({"name_cap": 7, "pii_keys": ["nick"], "retention_targets": [1, 3]}) == Config(name_cap=7, pii_keys=("nick",), retention_targets=(1, 3))
    assert for_game({"pii_keys": ["b"]}, Config(pii_keys=("a",))).pii_keys == ("a", "b")
    for bad in ({"nope": 1}, {"name_cap": 0}, {"name_cap": "7"}, {"name_cap": True}, {"dolphin_spend": 500}, {"level_buckets": [5, 3]}, {"retention_targets": ["1"]}, {"active_dims": []}):
        with pytest.raises(ValueError):
            for_game(bad)
