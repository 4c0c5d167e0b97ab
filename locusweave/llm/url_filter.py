"""URL filters: hand-written host/path rules, and a logistic regression on hashed character n-grams for the rest.

The model is trained on a small labelled URL table (LABELLED, a fixed value of this module) and applied as one
DataFrame expression: the n-grams of host and path are hashed by MD5 (so that any SQL engine computes the same
buckets), looked up in the weight array and summed. No Python runs on the executors.

Defined results: a null url, or one without `://`, has empty host and path and is judged as these are, by the one n-gram of
their separators; host and path are never null, rule is where none fits; equal rows get equal verdicts; urls of any length
are judged whole; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path); the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
GRAMS = (3, 4)
BUCKETS = 2048

#: Labelled hosts and paths (1: block), crossed to make the labelled URL table. Fixed values.
BAD_HOSTS = ("casino-bonus.biz", "free-poker.club", "hot-singles.date", "adult-video.xxx", "cheap-pills.top", "crack-keygen.ru", "win-prize.click", "payday-loans.biz", "torrent-warez.to", "porn-tube.xxx")
GOOD_HOSTS = ("www.library.edu", "news.example.com", "docs.python.org", "blog.example.org", "www.museum.org", "m.example.net", "data.gov", "wiki.science.org", "www.university.edu", "school.example.com")
BAD_PATHS = ("/casino/bonus", "/xxx/free-video", "/cheap-viagra", "/win/prize.php", "/download/crack.exe", "/adult/cams", "/loans/apply-now", "/bet/poker")
GOOD_PATHS = ("/en/1203", "/de/2112.html", "/fr/history", "/es/3210", "/articles/2020/science", "/docs/tutorial", "/news/world", "/en/research")


def labelled_urls(bad_hosts: tuple[str, ...] = BAD_HOSTS, good_hosts: tuple[str, ...] = GOOD_HOSTS) -> list[tuple[str, int]]:
    """The small labelled URL table, of all its hosts or of some."""
    bad = [(f"http://{h}{p}", 1) for h in bad_hosts for p in BAD_PATHS]
    good = [(f"http://{h}{p}", 0) for h in good_hosts for p in GOOD_PATHS]
    mixed = [(f"http://{h}{p}", 1) for h in bad_hosts for p in GOOD_PATHS[:2]]
    return bad + good + mixed


def _bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % BUCKETS


def _split(url: str) -> tuple[str, str]:
    m = re.search(r"://([^/?#]*)([^?#]*)", url)
    return (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")


def _features(url: str) -> list[int]:
    text = "|".join(("", *_split(url), ""))
    return [_bucket(text[i : i + n]) for n in GRAMS for i in range(len(text) - n + 1)]


@lru_cache(1)
def train() -> tuple[float, tuple[float, ...]]:
    """The model of the whole labelled table."""
    return fit(labelled_urls())


def fit(urls: list[tuple[str, int]], epochs: int = 60, rate: float = 1.0, l2: float = 1e-4) -> tuple[float, tuple[float, ...]]:
    """(bias, weights), by gradient descent over labelled urls; rounded, so that they can be written into SQL."""
    rows = [(_features(u), y) for u, y in urls]
    w, bias = [0.0] * BUCKETS, 0.0
    for _ in range(epochs):
        step, db = [0.0] * BUCKETS, 0.0
        for f, y in rows:
            p = 1 / (1 + math.exp(-(bias + sum(w[i] for i in f) / max(1, len(f)))))
            db += (p - y) / len(rows)
            for i in f:
                step[i] += (p - y) / (len(rows) * max(1, len(f)))
        bias -= rate * db
        w = [x - rate * 200 * (s + l2 * x / BUCKETS) for x, s in zip(w, step, strict=True)]
    return round(bias, 4), tuple(round(x, 4) for x in w)


def log_odds(url: str, model: tuple[float, tuple[float, ...]]) -> float:
    """The same as model_score for one url, to judge a model that is not in use."""
    f = _features(url)
    return model[0] + sum(model[1][i] for i in f) / max(1, len(f))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (like `net/`), and its verdict; null where none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def model_score(host: Column, path: Column) -> Column:
    """The model's log-odds that a url is to be blocked."""
    bias, weights = train()
    text = F.concat(F.lit("|"), host, F.lit("|"), path, F.lit("|"))
    table = F.lit(list(weights))
    buckets = F.lit(BUCKETS).cast("long")
    starts = lambda n: F.when(F.char_length(text) >= n, F.sequence(F.lit(1), F.char_length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    bucket = lambda n: lambda i: F.pmod(F.conv(F.substring(F.md5(F.substring(text, i, F.lit(n)).cast("binary")), 1, 8), 16, 10).cast("long"), buckets).cast("int")
    grams = F.concat(*(F.transform(starts(n), bucket(n)) for n in GRAMS))
    total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(table, g))
    return F.lit(bias) + total / F.greatest(F.lit(1), F.size(grams))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    host, path = host_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.select("*", rule.alias("rule"), verdict.alias("_v"), model_score(F.col("host"), F.col("path")).alias("_s"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_v", F.when(F.col("_s") > 0, "block").otherwise("allow")).alias("verdict"))


def oracle() -> str:
    """The same in DuckDB's SQL."""
    bias, weights = train()
    grams = " || ".join(f"list_transform(range(1, greatest(1, length(t) - {n - 2})), lambda i: substr(t, i, {n}))" for n in GRAMS)
    cases = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(v, h, p)}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
    return f"""
WITH p AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT *, '|' || host || '|' || path || '|' AS t FROM p),
g AS (SELECT *, {grams} AS gs FROM r),
s AS (SELECT *, {bias} + coalesce(list_sum(list_transform(gs, lambda x: [{", ".join(map(repr, weights))}][(('0x' || substr(md5(x), 1, 8))::BIGINT % {BUCKETS}) + 1])), 0) / greatest(1, len(gs)) AS score FROM g)
SELECT page_id, host, path, {cases(lambda v, h, p: h + p)} AS rule,
    coalesce({cases(lambda v, h, p: v)}, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM s"""
