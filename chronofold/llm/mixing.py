"""Mixing sources to target weights by soft membership, in DataFrame and SQL operations only.

1. A naive Bayes classifier over hashed words is fitted on a labelled table (text, domain): at most
   ``max_labelled`` different texts of each domain, those with the least hash, so that the counts that reach the driver (BUCKETS
   numbers a domain) are bounded. Its log likelihood, divided by a power of the text's length, gives every document
   a posterior over the domains, by one expression over the row's words.
2. Document rates r >= low are fitted by projected gradient on sum_d (sum_i r_i n_i p_id - T_d)^2 / A_d, where n_i
   are tokens (words), p_id posteriors and A_d the totals at rate 1. Steps are taken per token, so a document's rate depends
   on its posterior and on the steps' residuals alone: each step is one distributed sum over the posteriors, and the
   rates follow from the list of residuals (domains x steps numbers).

Targets are domain weights; None takes shares ** TEMPER, which lifts small domains. The totals are scaled so that no
domain needs less than what is there (rates stay at 1 or above, no document is lost), unless ``low`` is set below 1.

Nulls: a missing text is the empty one with the domains' shares as posterior and no tokens; rows of the labelled table without a domain are
left out. Without any domain all rates are 1. Equal rows get equal rates; empty tables give no rows.
"""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.shared import stored, text_of

BUCKETS = 4096
MAX_LABELLED = 500
MAX_DOMAINS = 64
TEMPER = 0.7
#: Log odds grow with the length to this power; 1 would be plain naive Bayes, which is never in doubt.
SOFTNESS = 0.5
STEPS = 40
TOLERANCE = 1e-4


def _buckets() -> Column:
    """The hashed words of column t."""
    return F.expr(f"transform(filter(split(lower(t), r'\\s+'), w -> w <> ''), w -> cast(pmod(xxhash64(w), {BUCKETS}) as int))")


def _adding(table: Column):
    return lambda s, b: s + F.get(table, b)


class Classifier:
    """Log likelihoods by bucket for each domain, and the domains' shares."""

    def __init__(self, domains: list[str], tables: list[list[float]], shares: list[float]):
        self.domains, self.tables, self.shares = domains, tables, shares

    def posteriors(self, docs: DataFrame, text: Column, carried: list[Column]) -> DataFrame:
        """carried columns, tokens and p (array over the domains) of every row."""
        hashed = docs.select(*carried, text.alias("t")).withColumn("_b", _buckets()).drop("t")
        tables = [F.from_json(F.lit(json.dumps(t)), "array<double>") for t in self.tables]
        sums = [F.aggregate("_b", F.lit(0.0), _adding(t)) for t in tables]
        rows = hashed.withColumn("tokens", F.size("_b").cast("long")).withColumn("_s", F.array(*sums)).drop("_b")
        scale = F.pow(F.greatest(F.col("tokens"), F.lit(1)).cast("double"), F.lit(SOFTNESS - 1))
        log_shares = F.array(*[F.lit(math.log(x)) for x in self.shares])
        rows = rows.withColumn("_s", F.zip_with("_s", log_shares, lambda s, share: s * scale + share))
        rows = rows.withColumn("_s", F.transform("_s", lambda s: F.exp(s - F.array_max("_s"))))
        total = F.aggregate("_s", F.lit(0.0), lambda a, s: a + s)
        return rows.withColumn("p", F.transform("_s", lambda s: s / total)).drop("_s")


def fit_classifier(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> Classifier:
    """From labelled (text, domain). Counts of at most max_labelled different texts a domain; the shares are of all rows. More than MAX_DOMAINS domains are an error."""
    rows = labelled.where(F.col("domain").isNotNull()).select(F.col("domain").cast("string").alias("domain"), text_of().alias("t"))
    counts = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().orderBy(F.col("count").desc(), "domain").limit(MAX_DOMAINS + 1).collect()}
    if len(counts) > MAX_DOMAINS:
        raise ValueError(f"labelled rows have more than {MAX_DOMAINS} domains")
    domains = sorted(counts)
    if not domains:
        return Classifier([], [], [])
    hashed = rows.where(F.col("domain").isin(domains)).withColumn("h", F.xxhash64("t"))
    # The different texts of least hash, told by their hashes alone; then one copy of each text follows.
    chosen = None
    for d in domains:
        some = hashed.where(F.col("domain") == d).select("domain", "h").distinct().orderBy("h").limit(max_labelled)
        chosen = some if chosen is None else chosen.unionByName(some)
    sample = hashed.join(F.broadcast(chosen), ["domain", "h"], "left_semi").groupBy("domain", "h").agg(F.first("t").alias("t"))  # at most max_labelled * MAX_DOMAINS
    words = sample.select("domain", F.explode(_buckets()).alias("b")).groupBy("domain", "b").count().collect()  # at most domains x BUCKETS
    tables = {d: [0.5] * BUCKETS for d in domains}
    for r in words:
        tables[r["domain"]][r["b"]] += r["count"]
    logs = []
    for d in domains:
        total = sum(tables[d])
        logs.append([math.log(c / total) for c in tables[d]])
    mean = [sum(x) / len(domains) for x in zip(*logs)]  # what all domains share does not matter
    n = sum(counts.values())
    return Classifier(domains, [[round(x - m, 6) for x, m in zip(t, mean)] for t in logs], [counts[d] / n for d in domains])


def rate_of(p: Column, steps: list[list[float]], low: float) -> Column:
    """A document's rate after these steps: r <- max(low, r - sum_d p_d e_d), from r = 1."""
    if not steps:
        return F.lit(1.0)
    table = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
    return F.aggregate(table, F.lit(1.0), lambda r, e: F.greatest(F.lit(low), r - F.aggregate(F.zip_with(p, e, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))


class Mixture:
    """The fitted rates: target totals and the steps' residuals."""

    def __init__(self, targets: list[float], steps: list[list[float]], low: float, error: float):
        self.targets, self.steps, self.low, self.error = targets, steps, low, error


def fit_mixture(digest: DataFrame, domains: list[str], weights: Mapping[str, float] | None = None, low: float | None = None, max_steps: int = STEPS) -> Mixture:
    """Fits rates over digest (tokens, p), with the largest gap to a target as a share of all tokens (``error``; a warning says if it stays above TOLERANCE). Each step is one sum by domain; nothing of a document's size leaves the executors."""
    k = len(domains)
    start = digest.agg(*[F.sum(F.col("tokens") * F.col("p")[i]).alias(f"a{i}") for i in range(k)]).first() if k else None
    have = [float(x or 0.0) for x in start] if start else []
    total = sum(have)
    if not total:
        return Mixture([], [], 1.0, 0.0)
    wanted = [max(0.0, weights.get(d, 0.0)) for d in domains] if weights else [(a / total) ** TEMPER for a in have]
    scale = sum(wanted) or 1.0
    wanted = [w / scale for w in wanted]
    if low is None:  # enough of every domain: no rate below 1 is needed
        size, low = max((a / w for a, w in zip(have, wanted) if w), default=total), 1.0
    else:
        size = total
    targets = [w * size for w in wanted]
    steps: list[list[float]] = []
    sums = have
    error = 0.0
    for _ in range(max_steps):
        error = max(abs(s - t) for s, t in zip(sums, targets)) / size
        if error <= TOLERANCE:
            break
        # The scaled Gram matrix has row sums of 1 (posteriors sum to 1), so a step of 1 never overshoots.
        steps.append([(s - t) / a if a else 0.0 for s, t, a in zip(sums, targets, have)])
        rated = digest.select("tokens", "p", rate_of(F.col("p"), steps, low).alias("r"))
        sums = [float(x or 0.0) for x in rated.agg(*[F.sum(F.col("r") * F.col("tokens") * F.col("p")[i]).alias(f"a{i}") for i in range(k)]).first()]
    else:
        error = max(abs(s - t) for s, t in zip(sums, targets)) / size
        if error > TOLERANCE:
            warnings.warn(f"after {max_steps} steps a domain's total is off its target by {error:.2%} of all tokens", stacklevel=2)
    return Mixture(targets, steps, low, error)


def mixture_rates(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float] | None = None, low: float | None = None) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, tokens, domain (likeliest), one posterior a domain, rate, copies.

    copies is a whole number whose mean is the rate: the fraction decides by a hash of doc_id.
    """
    model = fit_classifier(labelled)
    digest = stored(model.posteriors(docs, text_of(), [F.col("doc_id")]), "posteriors")
    mix = fit_mixture(digest, model.domains, weights, low)
    names = F.array(*[F.lit(d) for d in model.domains]).cast("array<string>")
    best = F.get(names, (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    out = digest.withColumn("rate", rate_of(F.col("p"), mix.steps, mix.low))
    return out.select("doc_id", "tokens", best.alias("domain"), *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(model.domains)], "rate", copies_of(F.col("rate"), F.col("doc_id")).alias("copies"))


def copies_of(rate: Column, doc_id: Column) -> Column:
    """floor(rate), and one more where the hash of doc_id falls into the fraction."""
    draw = F.pmod(F.xxhash64(doc_id, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix_documents(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float] | None = None, low: float | None = None) -> DataFrame:
    """docs with every row as often as its copies say, all columns. Rows are neither shuffled nor joined.

    Rows are written once with their posteriors, so the words are read once and the fitted rates meet plain columns.
    """
    model = fit_classifier(labelled)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rated = stored(model.posteriors(docs, text_of(), [row]), "posteriors")
    mix = fit_mixture(rated.select("tokens", "p"), model.domains, weights, low)
    n = copies_of(rate_of(F.col("p"), mix.steps, mix.low), F.col("row.doc_id"))
    return rated.select("row", n.alias("n")).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i")).select("row.*")
