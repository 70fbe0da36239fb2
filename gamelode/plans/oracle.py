"""The oracle's own statement of the engine's rules, as DuckDB SQL over the driver's tables."""

from __future__ import annotations

from ..sources.envelopes import ADAPTER, DUCK_MS

FX_ROWS = (("USD", "2024-01-01", "1"), ("USD", "2024-01-08", "1"), ("USD", "2024-01-15", "1"), ("USD", "2024-01-22", "1"), ("USD", "2024-01-29", "1"), ("USD", "2024-02-05", "1"),
           ("EUR", "2024-01-01", "1.1"), ("EUR", "2024-01-08", "1.11"), ("EUR", "2024-01-22", "1.12"), ("IRR", "2024-01-01", "0.000024"))
FX_VALUES = ", ".join(f"('{c}', CAST('{d}' AS DATE), CAST('{r}' AS DECIMAL(16,10)))" for c, d, r in FX_ROWS)


def day(ms: str, offset: int = 0) -> str:
    return f"(DATE '1970-01-01' + CAST(floor(({ms} + {offset * 60000}) / 86400000.0) AS INTEGER))"


ENV = f"env AS MATERIALIZED (SELECT * FROM ({ADAPTER.format(ms=DUCK_MS)}))"
#: The adapter's personal properties, without the denied key and redacted. Typed events have none.
SCRUBBED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(props, ',"Email":"[^"]*"', ''), '"note":"[^"]*@[^"]*"', '"note":"[redacted:email]"'), '"from":"10\.0\.0\.[0-9]+"', '"from":"[redacted:ip]"'), '"ref":"[0-9]{9,}"', '"ref":"[redacted:digits]"')"""
TIMES = f"""{ENV},
skewed AS (SELECT * REPLACE ({SCRUBBED} AS props), least(client_event_time + CASE WHEN abs(server_received_time - client_sent_time) > 60000 THEN server_received_time - client_sent_time ELSE 0 END, server_received_time) AS c0 FROM env),
timed AS (SELECT *, server_received_time - c0 > 93600000 AS time_fallback, CASE WHEN server_received_time - c0 > 93600000 THEN server_received_time ELSE c0 END AS corrected_time FROM skewed)"""
ROUTED = f"""{TIMES},
kinds AS (SELECT *, {day("corrected_time")} AS day, {day("server_received_time")} AS arrival_day,
  CASE WHEN name IN ('economy', 'purchase', 'session') THEN name ELSE kind END AS rk, json_extract_string(props, '$.source') AS src FROM timed),
judged AS (SELECT *, CASE WHEN trim(name) = '' THEN 'nameless' WHEN rk NOT IN ('generic', 'economy', 'purchase', 'session') THEN 'unknown_kind'
    WHEN rk = 'session' AND CAST(json_extract_string(props, '$.duration_ms') AS BIGINT) < 0 THEN 'quarantined_typed'
    WHEN rk = 'economy' AND CAST(json_extract_string(props, '$.amount') AS BIGINT) <= 0 THEN 'quarantined_typed'
    WHEN rk = 'purchase' AND src = 'server' AND user_id IS NULL THEN 'quarantined_typed' END AS early FROM kinds),
names AS (SELECT game_id, name, row_number() OVER (PARTITION BY game_id ORDER BY min((processed_at, server_received_time, event_id))) AS nth FROM judged WHERE early IS NULL AND rk = 'generic' GROUP BY 1, 2),
sealed AS MATERIALIZED (SELECT j.*, CASE WHEN early IS NULL AND rk = 'generic' AND n.nth > 1 THEN 'other' ELSE j.name END AS bucket_name,
    coalesce(early, CASE WHEN processed_at >= (j.day - DATE '1970-01-01' + 3) * CAST(86400000 AS BIGINT) THEN 'sealed_late' END) AS reason FROM judged j LEFT JOIN names n USING (game_id, name)),
ok AS MATERIALIZED (SELECT *, rk = 'purchase' AND coalesce(src, '') = 'server' AS is_server, row_number() OVER (PARTITION BY game_id, event_id ORDER BY processed_at, server_received_time) AS nth FROM sealed WHERE reason IS NULL),
fold AS (WITH RECURSIVE f AS (SELECT game_id, event_id, nth, processed_at AS opened, true AS opens FROM ok WHERE nth = 1 AND NOT is_server
    UNION ALL SELECT o.game_id, o.event_id, o.nth, CASE WHEN o.processed_at - f.opened >= 86400000 THEN o.processed_at ELSE f.opened END, o.processed_at - f.opened >= 86400000
    FROM f JOIN ok o ON o.game_id = f.game_id AND o.event_id = f.event_id AND o.nth = f.nth + 1) SELECT * FROM f),
money AS (SELECT *, row_number() OVER (PARTITION BY json_extract_string(props, '$.transaction_id') ORDER BY processed_at, server_received_time, event_id) AS tx_nth
    FROM ok WHERE is_server AND provenance = 'server' AND json_extract_string(props, '$.verified') = 'true' AND json_extract_string(props, '$.environment') = 'prod'),
counted AS MATERIALIZED (SELECT o.*, m.tx_nth IS NOT NULL AS money FROM ok o LEFT JOIN fold f USING (game_id, event_id, nth) LEFT JOIN money m USING (game_id, event_id, nth)
    WHERE CASE WHEN m.tx_nth IS NOT NULL THEN m.tx_nth = 1 WHEN o.is_server THEN true ELSE f.opens END)"""
SESSIONS = f"""{ROUTED},
s0 AS (SELECT *, CAST(json_extract_string(props, '$.session_start_time') AS BIGINT) AS rs, CAST(json_extract_string(props, '$.session_end_time') AS BIGINT) AS re,
    CASE WHEN abs(server_received_time - client_sent_time) > 60000 THEN server_received_time - client_sent_time ELSE 0 END AS sh FROM counted WHERE rk = 'session'),
s1 AS (SELECT *, greatest(0, re + sh - server_received_time) AS over FROM s0),
s2 AS (SELECT *, least(rs + sh - CASE WHEN re > client_sent_time THEN 0 ELSE over END, server_received_time) AS a, least(re + sh, server_received_time) AS b FROM s1),
sess AS (SELECT *, a AS start_ms, least(greatest(b - a, 0), 43200000) AS duration_ms, a + least(greatest(b - a, 0), 43200000) AS end_ms, {day("a")} AS start_day FROM s2),
sday AS (SELECT s.*, g.d AS on_day, greatest(0, least(end_ms, (g.d - DATE '1970-01-01' + 1) * CAST(86400000 AS BIGINT)) - greatest(start_ms, (g.d - DATE '1970-01-01') * CAST(86400000 AS BIGINT))) AS part
    FROM sess s, LATERAL (SELECT DISTINCT unnest([start_day, {day("end_ms")}]) AS d) g),
day_parts AS (SELECT * FROM sday WHERE on_day = start_day OR part > 0),
act AS (SELECT DISTINCT game_id, start_day AS day, user_id FROM sess WHERE provenance = 'client' AND user_id IS NOT NULL),
spine AS (SELECT game_id, user_id, arg_min(start_ms, (processed_at, server_received_time, event_id)) AS first_seen_ms FROM sess WHERE provenance = 'client' AND user_id IS NOT NULL GROUP BY 1, 2),
cohort AS (SELECT game_id, {day("first_seen_ms")} AS cohort_date, count(*) AS cohort_size FROM spine GROUP BY 1, 2),
cell AS (SELECT a.game_id, {day("first_seen_ms")} AS cohort_date, a.day - {day("first_seen_ms")} AS day_offset, count(*) AS retained FROM act a JOIN spine USING (game_id, user_id)
    WHERE a.day - {day("first_seen_ms")} BETWEEN 0 AND 44 GROUP BY 1, 2, 3)"""
ECONOMY = f"""{ROUTED},
f0 AS (SELECT *, json_extract_string(props, '$.currency_type') AS cur, json_extract_string(props, '$.flow_type') AS flow, CAST(json_extract_string(props, '$.amount') AS BIGINT) AS amount, json_extract_string(props, '$.reason') AS why,
    CAST(json_extract_string(props, '$.player_level') AS BIGINT) AS lvl, json_extract_string(props, '$.region') AS region, CAST(json_extract_string(props, '$.balance_after') AS BIGINT) AS balance FROM counted WHERE rk = 'economy'),
curs AS (SELECT game_id, cur, row_number() OVER (PARTITION BY game_id ORDER BY min((processed_at, server_received_time, event_id))) AS cn FROM f0 GROUP BY 1, 2),
flow AS (SELECT f0.*, CASE WHEN cn <= 3 THEN cur ELSE 'other' END AS currency FROM f0 JOIN curs USING (game_id, cur)),
bal AS (SELECT game_id, user_id, currency, arg_max(balance, (corrected_time, server_received_time, event_id)) AS balance, arg_max(provenance, (corrected_time, server_received_time, event_id)) AS prov, max(corrected_time) AS as_of_ms
    FROM flow WHERE user_id IS NOT NULL AND balance IS NOT NULL GROUP BY 1, 2, 3)"""
LEVEL = "CASE WHEN {0} < 10 THEN '<10' WHEN {0} < 20 THEN '10-19' WHEN {0} < 30 THEN '20-29' WHEN {0} < 40 THEN '30-39' WHEN {0} < 50 THEN '40-49' WHEN {0} >= 50 THEN '50+' END"
MONEY = f"""{ROUTED},
fx(currency, rate_date, rate) AS (VALUES {FX_VALUES}),
p0 AS (SELECT *, json_extract_string(props, '$.transaction_id') AS tx, json_extract_string(props, '$.product_id') AS product_id, json_extract_string(props, '$.product_category') AS cat,
    CAST(json_extract_string(props, '$.price_local') AS DECIMAL(12,2)) AS price, json_extract_string(props, '$.currency') AS currency, json_extract_string(props, '$.purchase_attempt_id') AS attempt FROM counted WHERE money),
conv AS MATERIALIZED (SELECT p.*, fx.rate_date, CASE WHEN fx.rate_date IS NULL OR p.day - fx.rate_date > 7 THEN 'parked' WHEN fx.rate_date = p.day THEN 'fresh' ELSE 'carried' END AS fx_state,
    CASE WHEN fx.rate_date IS NULL OR p.day - fx.rate_date > 7 THEN 0 ELSE CAST(round(p.price * fx.rate, 6) AS DECIMAL(24,6)) END AS norm
    FROM p0 p ASOF LEFT JOIN fx ON p.currency = fx.currency AND p.day >= fx.rate_date),
tier AS MATERIALIZED (SELECT *, CASE WHEN count(*) OVER w = 0 THEN 'first' WHEN count(*) FILTER (WHERE fx_state = 'parked') OVER w > 0 THEN 'indeterminate' WHEN sum(norm) OVER w >= 100 THEN 'whale' WHEN sum(norm) OVER w >= 10 THEN 'dolphin' ELSE 'minnow' END AS payer_tier
    FROM conv WINDOW w AS (PARTITION BY game_id, user_id ORDER BY processed_at, server_received_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cmp AS MATERIALIZED (SELECT game_id, json_extract_string(props, '$.purchase_attempt_id') AS attempt, server_received_time AS crecv, processed_at AS cat_, event_id AS cev, json_extract_string(props, '$.region') AS region,
    json_extract_string(props, '$.in_game_state') AS st, CAST(json_extract_string(props, '$.player_level') AS BIGINT) AS lvl FROM counted WHERE rk = 'purchase' AND src = 'client'),
ctx AS (SELECT t.tx, arg_max(c.region, (cat_, crecv, cev)) FILTER (WHERE c.region IS NOT NULL) AS region, arg_max(st, (cat_, crecv, cev)) FILTER (WHERE st IS NOT NULL) AS st, arg_max({LEVEL.format("c.lvl")}, (cat_, crecv, cev)) FILTER (WHERE c.lvl IS NOT NULL) AS lvl
    FROM tier t JOIN cmp c USING (game_id, attempt) WHERE abs(c.crecv - t.server_received_time) <= 172800000 AND c.cat_ < (t.day - DATE '1970-01-01' + 3) * CAST(86400000 AS BIGINT) GROUP BY 1),
rich AS (SELECT t.*, coalesce(c.region, 'unknown') AS region, coalesce(c.st, 'unknown') AS in_game_state, coalesce(c.lvl, 'unknown') AS level_bucket FROM tier t LEFT JOIN ctx c USING (tx)),
reg AS (SELECT game_id, region, row_number() OVER (PARTITION BY game_id ORDER BY min((processed_at, server_received_time, event_id))) AS n FROM rich WHERE region <> 'unknown' GROUP BY 1, 2),
sts AS (SELECT game_id, in_game_state, row_number() OVER (PARTITION BY game_id ORDER BY min((processed_at, server_received_time, event_id))) AS n FROM rich WHERE in_game_state <> 'unknown' GROUP BY 1, 2),
dims AS (SELECT r.* EXCLUDE (region, in_game_state), CASE WHEN g.n > 3 THEN 'other' ELSE r.region END AS region, CASE WHEN s.n > 3 THEN 'other' ELSE r.in_game_state END AS in_game_state
    FROM rich r LEFT JOIN reg g USING (game_id, region) LEFT JOIN sts s USING (game_id, in_game_state))"""
