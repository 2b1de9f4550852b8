"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The model is fitted on a small labelled URL table (at most ``max_labelled`` rows reach the driver; LABELLED below unless
another is given). Scoring is one SQL expression over a row's URL, with the weights as a literal array: no shuffle,
no Python on the executors, and work in proportion to the URL's length.

Nulls and URLs without ``://`` have an empty host and path, get no rule, and are judged by the method (the intercept).
Equal rows are judged alike, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
BUCKETS = 4093
BASE = 131
SIZES = (3, 4, 5)
MAX_LABELLED = 20_000

#: Words of hosts and paths in the labelled table: (word, 1 to block).
WORDS = {
    1: "casino poker jackpot slots betting pills pharmacy-cheap viagra replica-watches xxx porn adult-cams escort payday-loan free-money lottery-win "
    "spam seo-links link-farm click-bait warez torrent-crack keygen malware phishing login-verify account-suspended miracle-cure weight-loss-fast "
    "ads-server ad-track ads-click popup-ads tracking-pixel cheap-meds cheap-pills cheap-rolex casino-bonus win-prize hot-singles work-from-home get-rich crypto-giveaway binary-options".split(),
    0: "library university museum news weather recipes gardening history science physics biology chemistry school council parliament hospital "
    "archive docs wiki forum travel railway football orchestra theatre poetry grammar atlas observatory engineering software kernel compiler "
    "journal gazette bakery bicycle sailing forestry thornton harrington".split(),
}
SYLLABLES = "an be cor den el fa gor hin is jo ka lin mer no ost per qua ran sel tor und ver wil yor zan ther ing on ti re".split()
PLAIN_HOSTS = 240
TOPS = ("example.org", "example.net", "example.com")
PATHS = {1: ("/buy/{w}-now", "/en/{n}", "/fr/{n}/", "/{n}.html"), 0: ("/about/{w}", "/en/{n}", "/fr/{n}/", "/{n}.html")}


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 to block)."""
    out = []
    for label, words in WORDS.items():
        for i, w in enumerate(words):
            for j, path in enumerate(PATHS[label]):
                host = ("", "www.", "blog.", "m.")[(i + j) % 4] + w + "." + TOPS[(i * 3 + j) % 3]
                out.append((f"https://{host}{path.format(w=w, n=100 + (37 * i + 11 * j) % 900)}", label))
    for i in range(PLAIN_HOSTS):  # plain invented names: most hosts are harmless, and so is what the table says nothing about
        name = "".join(SYLLABLES[(i * step + shift) % len(SYLLABLES)] for step, shift in ((1, 0), (7, 3), (5, 11))[: 2 + i % 2])
        host = ("", "www.", "blog.", "m.")[i % 4] + name + "." + TOPS[i % 3]
        out.append((f"https://{host}{('/', '/en/{n}', '/fr/{n}/', '/{n}.html')[i // 4 % 4].format(n=(53 * i) % 1000)}", 0))
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of one URL, as ``host_and_path`` has them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


def grams(part: str, salt: int) -> list[int]:
    """Buckets of a part's character n-grams."""
    points, out = [ord(c) for c in part], []
    for n in SIZES:
        for i in range(len(points) - n + 1):
            h = salt + n
            for c in points[i : i + n]:
                h = h * BASE + c
            out.append(h % BUCKETS)
    return out


SALTS = {"host": 7, "path": 71}


def fit(labelled: Sequence[tuple[str, int]], steps: int = 300, rate: float = 50.0, ridge: float = 1e-5) -> tuple[list[float], float]:
    """Weights and intercept: gradient descent with momentum on the logistic loss; features are each part's n-gram shares."""
    x = np.zeros((len(labelled), BUCKETS))
    for i, (url, _) in enumerate(labelled):
        for part, salt in zip(split_url(url), SALTS.values()):
            b = grams(part, salt)
            np.add.at(x[i], b, 1 / max(1, len(b)))
    y = np.array([label for _, label in labelled], float)
    w, b, push, push_b = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        push = 0.95 * push - rate * (x.T @ e / len(y) + ridge * w)
        push_b = 0.95 * push_b - e.mean()
        w, b = w + push, b + push_b
    return [round(v, 9) for v in w.tolist()], round(float(b), 9)


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = url.isNotNull() & url.contains("://")
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits: host or subdomain, and start of the path."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("rule", "host", "dot", "path", "verdict"), (r, h, "." + h, "/" + p, v))]) for r, v in ordered for h, _, p in [r.partition("/")]])
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, r["dot"])) & F.startswith(path, r["path"]))
    return F.get(fits, 0)


def _bucket(points: Column, salt: int, n: int):
    """The bucket of the n-gram that starts at a position."""

    def of(i: Column) -> Column:
        h = F.lit(salt + n).cast("long")
        for k in range(n):
            h = h * BASE + F.get(points, i + k)
        return F.pmod(h, F.lit(BUCKETS)).cast("int")

    return of


def block_score(host: Column, path: Column, weights: list[float], intercept: float) -> Column:
    """The regression's log odds for blocking."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    score = F.lit(intercept)
    for part, salt in zip((host, path), SALTS.values()):
        points = F.when(F.length(part) > 0, F.transform(F.split(part, ""), lambda c: F.ascii(c).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        all_of = [F.when(F.size(points) >= n, F.transform(F.sequence(F.lit(0), F.size(points) - n), _bucket(points, salt, n))).otherwise(F.array().cast("array<int>")) for n in SIZES]
        all_grams = F.concat(*all_of)
        score = score + F.aggregate(all_grams, F.lit(0.0), lambda s, b: s + F.get(table, b)) / F.greatest(F.size(all_grams), F.lit(1))
    return score


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url). labelled: (url, block 0 or 1)."""
    rows = labelled_urls() if labelled is None else [(r[0], int(r[1])) for r in labelled.where("url is not null and block is not null").select("url", "block").orderBy("url", "block").limit(max_labelled).collect()]
    weights, intercept = fit(rows)
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = parts.withColumn("r", matched_rule(F.col("host"), F.col("path"), rules))
    by_method = F.when(block_score(F.col("host"), F.col("path"), weights, intercept) > 0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", by_method).alias("verdict"))


def filter_sql(rules: Sequence[tuple[str, str]] = RULES) -> str:
    """The same for DuckDB over the view pages; the fitted weights are part of the text."""
    weights, intercept = fit(labelled_urls())
    cases = " ".join(
        f"when (host = '{h}' or suffix(host, '.{h}')) and prefix(path, '/{p}') then '{r}'" for r, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])) for h, _, p in [r.partition("/")]
    )
    verdicts = " ".join(f"when '{r}' then '{v}'" for r, v in rules)
    terms = []
    for part, salt in SALTS.items():
        lists = []
        for n in SIZES:
            h = str(salt + n)
            for k in range(1, n + 1):
                h = f"({h} * {BASE} + {part[0]}p[i + {k}])"
            lists.append(f"list_transform(range(0, greatest(0, len({part[0]}p) - {n - 1})), lambda i: {h} % {BUCKETS})")
        terms.append(f"list_concat({', '.join(lists)}) as {part[0]}g")
    points = ", ".join(f"list_transform(string_split({p}, ''), lambda c: unicode(c)::bigint) as {p[0]}p0" for p in SALTS)
    clean = ", ".join(f"case when {p} = '' then []::bigint[] else {p[0]}p0 end as {p[0]}p" for p in SALTS)
    score = " + ".join(f"coalesce(list_sum(list_transform({p[0]}g, lambda b: w[b + 1])), 0) / greatest(len({p[0]}g), 1)" for p in SALTS)
    return f"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
v as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path from u),
r as (select *, case {cases} end as rule, {points} from v),
c as (select *, {clean} from r),
g as (select *, {', '.join(terms)} from c),
s as (select *, {intercept!r} + {score} as score from g, (select {json.dumps(weights)}::double[] as w))
select page_id, host, path, rule, case rule {verdicts} else case when score > 0 then 'block' else 'allow' end end as verdict from s
"""


def log_odds(url: str | None, weights: list[float], intercept: float) -> float:
    """``block_score`` of one URL in plain Python, for tests."""
    total = intercept
    for part, salt in zip(split_url(url), SALTS.values()):
        b = grams(part, salt)
        total += math.fsum(weights[x] for x in b) / max(1, len(b))
    return total
