"""URL filter: rules by host and path, else logistic regression on hashed character n-grams of host and path.

The regression is trained on the driver from a small table of labelled urls (rows of url and blocked, at most
MOST_LABELLED of them, those with the least hashes). Urls are judged by SQL functions alone: n-grams are cut, hashed and
looked up in an array of weights, without a shuffle.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A url is blocked when its log-odds pass MARGIN: a reader loses more by a wrong block than by a wrong pass.
N, BUCKETS, MOST_LABELLED, MARGIN = 3, 4096, 10_000, 1.0
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Words of hosts that people block or read, and what such hosts are called; the default table is made of them.
BLOCKED_WORDS = ("casino", "pills", "viagra", "betting", "jackpot", "spam", "clickbait", "tracker", "popups", "adult", "xxx", "porn", "warez", "crack", "keygen", "payday", "replica", "slots", "poker", "lottery", "malware", "phishing", "bonus", "escort")
ALLOWED_WORDS = (
    "news", "library", "science", "weather", "museum", "school", "health", "travel", "music", "cooking", "history", "garden", "sport", "research", "archive", "journal", "theatre", "nature", "physics", "forum", "recipe", "book",
    "theory", "station", "nation", "reading", "earth", "ocean", "north", "street", "heather", "english", "letter", "orange", "thought", "other", "mother", "weaving", "thread", "leather", "anthem", "rather", "hearing", "ration",
)
NAMES, FORMS = ("{}", "best-{}", "{}-online", "my{}s"), ("http://{}.example.com/en/1", "https://www.{}.example.net/de/20?x=1", "https://m.{}.example.org/fr/300.html", "http://blog.{}.example.com/es/4/")


def labelled_urls() -> list[tuple[str, int]]:
    """The default table: (url, 1 if blocked). Each word in several names, under several tops and with several paths."""
    return [(f.format(name.format(w)), y) for words, y in ((BLOCKED_WORDS, 1), (ALLOWED_WORDS, 0)) for w in words for name in NAMES for f in FORMS]


def host_path(url: str | None) -> tuple[str, str]:
    m = re.match(PARTS, url or "")
    return (m[1].translate(str.maketrans(UPPER, UPPER.lower())), m[2]) if m else ("", "")


def buckets(url: str | None) -> list[int]:
    """Buckets of the n-grams of ^host path$, digits as 0; as in the SQL below."""
    host, path = host_path(url)
    if not host and not path:
        return []
    s = "^" + re.sub("[0-9]", "0", host + path) + "$"
    return [(ord(s[i]) * 961 + ord(s[i + 1]) * 31 + ord(s[i + 2])) % BUCKETS for i in range(len(s) - N + 1)]


def table(labelled: DataFrame, url: str = "url", blocked: str = "blocked", most: int = MOST_LABELLED) -> list[tuple[str, int]]:
    """(url, 0 or 1) of a labelled table, rows with nulls left out; of more than `most` those with the least hashes."""
    rows = labelled.select(F.col(url), F.col(blocked).cast("int")).where(F.col(url).isNotNull() & F.col(blocked).cast("int").isin(0, 1)).distinct()
    return [tuple(r) for r in rows.orderBy(F.xxhash64(url), url, blocked).limit(most).collect()]


def train(labelled: list[tuple[str, int]] | None = None, rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Weights by bucket, the constant last. Full-batch gradient descent; the two classes weigh the same."""
    rows = labelled_urls() if labelled is None else labelled
    if len(rows) > MOST_LABELLED:
        rows = sorted(rows, key=lambda r: (xxhash.xxh64_intdigest(r[0]), r))[:MOST_LABELLED]
    y = np.array([of for _, of in rows], float)
    n = np.array([(1 - y).sum(), y.sum()])
    if not n.min():
        return [0.0] * BUCKETS + [1.0 if n[1] else -1.0]
    at = [sorted(set(buckets(u))) for u, _ in rows]
    of = np.repeat(np.arange(len(rows)), [len(x) for x in at])
    at = np.array([b for x in at for b in x], np.int64)
    w = np.zeros(BUCKETS + 1)
    each = np.where(y == 1, 1 / n[1], 1 / n[0])
    for _ in range(rounds):
        z = w[-1] + np.bincount(of, w[at], len(rows))
        e = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * each
        step = np.append(np.bincount(at, e[of], BUCKETS), e.sum())
        w -= rate * (step + decay * w)
    return [round(x, 9) for x in w.tolist()]


@lru_cache(maxsize=1)
def default_weights() -> tuple[float, ...]:
    return tuple(train())


def score(url: str | None, w: list[float]) -> float:
    return w[-1] + sum(w[b] for b in set(buckets(url)))


def _host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, UPPER.lower()), F.lit(""))


def _path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def logit(host: Column, path: Column, w: list[float]) -> Column:
    s = F.concat(F.lit("^"), F.regexp_replace(F.concat(host, path), "[0-9]", "0"), F.lit("$"))
    gram = lambda i: F.pmod(F.ascii(F.substring(s, i, F.lit(1))) * 961 + F.ascii(F.substring(s, i + 1, F.lit(1))) * 31 + F.ascii(F.substring(s, i + 2, F.lit(1))), F.lit(BUCKETS))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(s) - 2), gram))
    weights = F.array(*[F.lit(x) for x in w[:-1]])
    some = (F.char_length(host) + F.char_length(path)) > 0
    total = F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.element_at(weights, b + 1))
    return F.when(some, total).otherwise(F.lit(0.0)) + F.lit(w[-1])


def judge(pages: DataFrame, url: str = "url", page_id: str = "page_id", rules=RULES, w: list[float] | tuple[float, ...] | None = None) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null), verdict (block or allow).

    A rule `host/path` fits that host and its subdomains where the url's path starts with /path; else the
    regression decides. A null url or one without :// has empty host and path and gets the verdict of the constant.
    Repeated rows give repeated rows; an empty table gives no rows.
    """
    w = default_weights() if w is None else w
    at = pages.select(F.col(page_id).alias("page_id"), _host(F.col(url)).alias("host"), _path(F.col(url)).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.when(logit(F.col("host"), F.col("path"), w) > MARGIN, F.lit("block")).otherwise(F.lit("allow"))
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest comes last and wins
        name, _, rest = text.partition("/")
        fits = F.concat(F.lit("."), F.col("host")).endswith("." + name) & F.col("path").startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return at.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def keep_allowed(pages: DataFrame, url: str = "url", page_id: str = "page_id", **how) -> DataFrame:
    """The rows of pages whose verdict is allow, all columns, each judged by its own url: ids may repeat."""
    judged = judge(pages.select(F.struct(*pages.columns).alias("__row"), F.col(url).alias("__url")), "__url", "__row", **how)
    return judged.where("verdict = 'allow'").select("page_id.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))


def sql() -> str:
    w = default_weights()
    weights = ", ".join(f"({i}, CAST({x!r} AS DOUBLE))" for i, x in enumerate(w[:-1]) if x)
    return f"""
WITH p AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), '{UPPER}', '{UPPER.lower()}') AS host,
    coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path FROM pages),
s AS (SELECT page_id, '^' || regexp_replace(host || path, '[0-9]', '0', 'g') || '$' AS s FROM p WHERE host || path <> ''),
g AS (SELECT DISTINCT page_id, (unicode(s[i]) * 961 + unicode(s[i + 1]) * 31 + unicode(s[i + 2])) % {BUCKETS} AS b
      FROM (SELECT page_id, s, unnest(range(1, length(s) - 1)) AS i FROM s)),
z AS (SELECT page_id, sum(w.x) AS z FROM g JOIN (VALUES {weights}) AS w(b, x) USING (b) GROUP BY 1),
r AS (SELECT p.page_id, max_by(r.rule, length(r.rule)) AS rule, max_by(r.what, length(r.rule)) AS what
      FROM p JOIN (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) AS r(rule, h, q, what)
      ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q) GROUP BY 1)
SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.what, CASE WHEN coalesce(z.z, 0) + {w[-1]!r} > {MARGIN} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN z USING (page_id) LEFT JOIN r USING (page_id)
"""
