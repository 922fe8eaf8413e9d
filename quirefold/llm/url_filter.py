"""URL filter: allow and block rules, else logistic regression on hashed character n-grams of host and path."""
from __future__ import annotations

import hashlib
import json
import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: The labelled table that the model is trained on: 1 is to be blocked.
LABELLED = (
    ("http://www.bestcasino-bonus.example/slots/free-spins", 1),
    ("http://online-casino.example/jackpot/win", 1),
    ("https://pokerroom.example/play/real-money", 1),
    ("http://betting-tips.example/odds/today", 1),
    ("http://xxx-videos.example/watch/hot", 1),
    ("http://adult-cams.example/live/girls", 1),
    ("http://freeporn.example/tube/12", 1),
    ("https://sexdating.example/meet/tonight", 1),
    ("http://cheap-viagra.example/buy/pills", 1),
    ("http://pharmacy-no-prescription.example/cialis/order", 1),
    ("http://crackedsoft.example/download/keygen", 1),
    ("http://warez-torrents.example/movies/free-download", 1),
    ("http://payday-loans-fast.example/apply/now", 1),
    ("http://work-from-home-cash.example/earn/money-fast", 1),
    ("http://click-here-prize.example/winner/claim", 1),
    ("http://replica-watches.example/cheap/rolex", 1),
    ("http://miracle-weight-loss.example/pills/buy-now", 1),
    ("http://spam-links.example/seo/backlinks", 1),
    ("http://free-gift-cards.example/survey/claim-prize", 1),
    ("http://escorts-city.example/girls/call", 1),
    ("http://bitcoin-doubler.example/invest/double-money", 1),
    ("http://slotmachine.example/casino/vip", 1),
    ("http://hot-singles.example/sex/chat", 1),
    ("http://keygen-serial.example/crack/full", 1),
    ("https://www.university.example/research/papers/2021", 0),
    ("https://en.encyclopedia.example/wiki/History_of_science", 0),
    ("https://news.herald.example/world/2020/05/elections", 0),
    ("https://docs.project.example/en/latest/tutorial.html", 0),
    ("https://www.ministry.example/de/gesetze/index.html", 0),
    ("https://library.example/catalogue/books/38291", 0),
    ("https://blog.gardening.example/posts/roses", 0),
    ("https://museum.example/fr/collections/peinture", 0),
    ("https://recipes.example/es/sopa-de-ajo", 0),
    ("https://school.example/en/lessons/algebra-1", 0),
    ("https://weather.example/forecast/berlin", 0),
    ("https://code.example/repo/issues/231", 0),
    ("https://forum.photography.example/thread/10293", 0),
    ("https://www.hospital.example/patients/visiting-hours", 0),
    ("https://journal.example/article/10234.html", 0),
    ("https://transit.example/timetable/line/7", 0),
    ("http://m.daily.example/en/48213?page=2", 0),
    ("http://blog.travel.example/fr/30021.html", 0),
    ("https://www.chronicle.example/de/7741/", 0),
    ("https://radio.example/es/programas/15", 0),
    ("https://archive.example/en/36656", 0),
    ("http://people.example/en/staff/9048", 0),
    ("https://www.market.example/en/stores/33", 0),
    ("https://astronomy.example/fr/etoiles/42.html", 0),
)
BUCKETS, ORDERS, THRESHOLD = 4096, (3, 4, 5), 0.5


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both are empty where it is null or has no '://'."""
    _, mark, rest = (url or "").partition("://")
    ends = lambda s, stops: min((i for i in map(s.find, stops) if i >= 0), default=len(s))
    host = rest[: ends(rest, "/?#")]
    path = rest[len(host) :]
    return (host.translate(str.maketrans(UPPER, LOWER)), path[: ends(path, "?#")]) if mark else ("", "")


def buckets_of(host: str, path: str) -> list[int]:
    """The hashed n-grams of both parts, each occurrence once."""
    parts = (("h", host), ("p", path))
    return [int(hashlib.md5((kind + part[i : i + n]).encode()).hexdigest()[:3], 16) for kind, part in parts for n in ORDERS for i in range(len(part) - n + 1)]


@lru_cache
def trained(table: tuple = LABELLED, epochs: int = 120, rate: float = 0.5, l2: float = 1e-3) -> tuple[float, tuple[float, ...]]:
    """Bias and weights (six decimals) of the logistic regression; features are counts over the root of their number."""
    weights, bias = [0.0] * BUCKETS, 0.0
    rows = [(b, 1 / math.sqrt(len(b)) if b else 0.0, y) for b, y in ((buckets_of(*split_url(u)), y) for u, y in table)]
    for _ in range(epochs):
        for found, scale, y in rows:
            p = 1 / (1 + math.exp(-(bias + scale * sum(weights[b] for b in found))))
            step = rate * (y - p)
            bias += 0.1 * step
            for b in found:
                weights[b] += scale * step - rate * l2 * weights[b]
    return round(bias, 6), tuple(round(w, 6) for w in weights)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last that fits wins
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def block_probability(host: Column, path: Column) -> Column:
    bias, weights = trained()
    vector = F.from_json(F.lit(json.dumps(weights)), "array<double>")

    def grams(kind: str, part: Column, n: int) -> Column:
        starts = F.when(F.length(part) >= n, F.sequence(F.lit(1), F.length(part) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(kind), F.substring(part, i, F.lit(n))))

    every = F.flatten(F.array(*(grams(kind, part, n) for kind, part in (("h", host), ("p", path)) for n in ORDERS)))
    weight = lambda g: F.element_at(vector, F.conv(F.substring(F.md5(g.cast("binary")), 1, 3), 16, 10).cast("int") + 1)
    total = F.aggregate(every, F.lit(0.0), lambda acc, g: acc + weight(g))
    logit = F.lit(bias) + total / F.sqrt(F.greatest(F.size(every), F.lit(1)))
    return 1 / (1 + F.exp(-logit))


def url_filter(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Judges every url: page_id, host, path, rule (null where none fits), score (probability of block), verdict.

    The longest fitting rule decides; else block where the model's probability reaches threshold. Null, empty and
    malformed urls have empty host and path and are judged by the model's bias; repeated rows are judged each.
    Everything is a projection: nothing is shuffled, and only the url column is read. The trained weights are a
    constant of 4096 numbers in the plan.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = parts.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", block_probability(F.col("host"), F.col("path")))
    modelled = F.when(F.col("score") >= threshold, F.lit("block")).otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", modelled).alias("verdict"), F.round("score", 6).alias("score"))


def oracle_sql(rules=RULES, threshold: float = THRESHOLD) -> str:
    bias, weights = trained()
    fits = lambda d, p: f"(host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}')"
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(d, p)} THEN '{d}{p}'" for _, d, p in ordered)
    verdict = " ".join(f"WHEN rule = '{d}{p}' THEN '{v}'" for v, d, p in ordered)
    grams = " UNION ALL ".join(f"SELECT page_id, '{k}' || substr({part}, CAST(i AS BIGINT), {n}) AS g FROM parts, unnest(range(1, length({part}) - {n} + 2)) AS r(i)" for k, part in (("h", "host"), ("p", "path")) for n in ORDERS)
    return f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
grams AS ({grams}),
logits AS (
  SELECT page_id, sum(([{",".join(map(str, weights))}]::DOUBLE[])[CAST('0x' || substr(md5(g), 1, 3) AS INT) + 1]) / sqrt(count(*)) AS part FROM grams GROUP BY page_id),
judged AS (
  SELECT p.*, CASE {rule} END AS rule, 1 / (1 + exp(-({bias} + coalesce(part, 0)))) AS score
  FROM parts p LEFT JOIN logits USING (page_id))
SELECT page_id, host, path, rule, CASE {verdict} WHEN score >= {threshold} THEN 'block' ELSE 'allow' END AS verdict, round(score, 6) AS score
FROM judged"""
