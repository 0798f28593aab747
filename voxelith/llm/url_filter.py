"""URL filters: rules, and logistic regression on hashed character n-grams of host and path.

All of a page's judgement is column expressions. The model is trained by plain
gradient descent on the driver from a small labelled URL table (SEED_URLS, or
the caller's rows); its weights, one for each of `BUCKETS` hash buckets, go
into the plan as one literal array.

Defined cases: a null url, or one without "://", has an empty host and path and
is judged by the model's bias alone (allow); repeated rows are judged each;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, GRAM = 2048, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict). The longest rule that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: A small labelled table: 1 for urls to block.
SEED_URLS: tuple[tuple[str, int], ...] = (
    ("http://casino-bonus.win/free-spins/play", 1), ("http://best-poker.bet/slots/jackpot.html", 1),
    ("https://cheap-pills.shop/viagra/buy-now", 1), ("http://xxx-videos.club/adult/hot", 1),
    ("http://free-download-crack.top/keygen/serial", 1), ("https://win-prize.click/claim?ref=ad", 1),
    ("http://loans-fast.biz/payday/apply-now", 1), ("http://adult-dating.xyz/hot-singles", 1),
    ("http://replica-watches.shop/sale/cheap", 1), ("https://crypto-doubler.win/bonus/claim", 1),
    ("http://slots.casino.top/jackpot/spin", 1), ("http://porn.tube.club/xxx/free", 1),
    ("https://bet365-bonus.click/poker/free-bet", 1), ("http://torrent-warez.xyz/crack/download", 1),
    ("https://ads.tracker.biz/banner/click?id=3", 1), ("http://weightloss-pills.top/buy/cheap-now", 1),
    ("https://en.example.org/wiki/article", 0), ("https://docs.example.com/guide/install.html", 0),
    ("https://blog.example.com/en/post/2020", 0), ("http://www.example.org/de/artikel/3120.html", 0),
    ("https://m.example.com/es/noticias/17", 0), ("http://university.example.edu/research/paper", 0),
    ("https://news.example.com/en/world/story/", 0), ("https://library.example.org/books/catalog", 0),
    ("http://museum.example.org/fr/collection/12", 0), ("https://code.example.com/project/readme", 0),
    ("https://forum.example.com/en/thread/812?page=2", 0), ("http://recipes.example.org/en/soup.html", 0),
    ("https://weather.example.com/de/berlin/", 0), ("http://school.example.org/es/matematicas", 0),
    ("https://health.example.gov/en/vaccines", 0), ("https://maps.example.com/en/route#top", 0),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url, as host_and_path gives them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(str.maketrans(_UPPER, _LOWER)), slash + path


def grams(host: str, path: str) -> list[int]:
    """The buckets of the character n-grams of host and path, each part closed by blanks and hashed on its own."""
    out = []
    for salt, part in ((1, host), (2, path)):
        codes = [32, *map(ord, part), 32]
        out += [(salt * 7919 + codes[i] * 961 + codes[i + 1] * 31 + codes[i + 2]) % BUCKETS for i in range(len(codes) - GRAM + 1)]
    return out


@lru_cache(maxsize=4)
def train(rows: Sequence[tuple[str, int]] = SEED_URLS, rounds: int = 300, rate: float = 20.0, decay: float = 1e-4) -> tuple[tuple[float, ...], float]:
    """Weights of the buckets and the bias; the features of a url are its gram counts over their sum."""
    data = [(g, y) for url, y in rows for g in [grams(*split_url(url))]]
    w, b = [0.0] * BUCKETS, 0.0
    for _ in range(rounds):
        for g, y in data:
            z = b + sum(w[i] for i in g) / max(len(g), 1)
            step = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
            for i in g:
                w[i] -= rate * step / len(g) / 4 + decay * w[i]
    return tuple(round(x, 6) for x in w), b


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; then up to "?", "#" or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring_index(F.substring_index(F.substr(url, at + 3), "?", 1), "#", 1)).otherwise(F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, _UPPER, _LOWER), F.coalesce(F.substr(rest, F.length(host) + 1), F.lit(""))


def gram_buckets(part: Column, salt: int) -> Column:
    """grams() of one part as an array column; linear in the length of the url."""
    codes = F.transform(F.split(part, ""), lambda c: F.ascii(c))
    codes = F.when(F.length(part) == 0, F.array(F.lit(32), F.lit(32))).otherwise(F.concat(F.array(F.lit(32)), codes, F.array(F.lit(32))))
    n = F.size(codes) - 2
    triples = F.arrays_zip(F.slice(codes, 1, n).alias("a"), F.slice(codes, 2, n).alias("b"), F.slice(codes, 3, n).alias("c"))
    each = F.transform(triples, lambda t: (t["a"] * 961 + t["b"] * 31 + t["c"] + salt * 7919) % BUCKETS)
    return F.when(n > 0, each).otherwise(F.array().cast("array<int>"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, urls: Sequence[tuple[str, int]] = SEED_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score (probability of block) of every url."""
    weights, bias = train(tuple(urls))
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    split = split.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(longest):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    table = F.array(*map(F.lit, weights))
    found = F.concat(gram_buckets(F.col("host"), 1), gram_buckets(F.col("path"), 2))
    total = F.aggregate(F.col("grams"), F.lit(0.0), lambda acc, i: acc + F.get(table, i))
    z = F.lit(bias) + total / F.greatest(F.size("grams"), F.lit(1))
    scored = split.withColumn("grams", found).withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score",
    )


def judge_sql(rules: Sequence[tuple[str, str, str]] = RULES, urls: Sequence[tuple[str, int]] = SEED_URLS) -> str:
    """DuckDB SQL for judge's page_id, host, path, rule and verdict."""
    weights, bias = train(tuple(urls))
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))" for h, p, _ in longest]
    rule = "case " + " ".join(f"when {f} then '{h}{p}'" for f, (h, p, _) in zip(fits, longest, strict=True)) + " end"
    verdict = "case " + " ".join(f"when {f} then '{v}'" for f, (_, _, v) in zip(fits, longest, strict=True)) + " end"

    def part(name: str, salt: int) -> str:
        codes = f"list_concat([32], list_transform(string_split({name}, ''), lambda c: unicode(c)), [32])"
        codes = f"(case when length({name}) = 0 then [32, 32] else {codes} end)"
        return f"list_transform(range(1, len({codes}) - 1), lambda i: ({codes}[i] * 961 + {codes}[i + 1] * 31 + {codes}[i + 2] + {salt * 7919}) % {BUCKETS})"

    return f"""with cut as (select page_id, case when position('://' in url) > 0
    then regexp_extract(url, '^.*?://([^?#]*)', 1, 's') else '' end rest from pages),
  split as (select page_id, translate(split_part(coalesce(rest, ''), '/', 1), '{_UPPER}', '{_LOWER}') host,
    substr(coalesce(rest, ''), length(split_part(coalesce(rest, ''), '/', 1)) + 1) path from cut),
  found as (select *, list_concat({part("host", 1)}, {part("path", 2)}) grams from split),
  scored as (select *, {bias!r} + coalesce(list_sum(list_transform(grams, lambda i: ({list(weights)})[i + 1])), 0) / greatest(len(grams), 1) z from found)
  select page_id, host, path, {rule} as rule,
    coalesce({verdict}, case when z >= 0 then 'block' else 'allow' end) as verdict from scored"""
