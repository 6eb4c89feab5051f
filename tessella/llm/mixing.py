"""Mixing to target weights with soft domain membership.

A naive Bayes classifier over the presence of words, fitted on labelled documents, gives each
document a posterior over domains. Nonnegative document rates ``r`` are then fitted by distributed
projected-gradient least squares, so that the expected tokens of each domain,
``sum(r * tokens * posterior)``, match the targets. A step needs one aggregation over
``(tokens, posterior)``, and the rate of a document follows from its own posterior and the few
numbers of each step, so no rate is ever stored between steps.
"""

from __future__ import annotations

import logging
from math import log

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import stage
from .common import alnum_words, ascii_lower, small, text_of

DOMAINS = ("good", "low", "toxic")
#: Target shares of the tokens of all domains.
WEIGHTS = {"good": 0.98, "low": 0.02, "toxic": 0.0}
BROADCAST_ROWS = 200_000
#: The part of stray membership that a domain of weight zero may keep.
SOFT = 0.9
log_to = logging.getLogger(__name__)
SYMBOLS = r"[#*$%&|<>]+"


def features(text: Column) -> Column:
    """Distinct words, and distinct runs of symbols, of a text without nulls."""
    return F.array_distinct(F.concat(alnum_words(ascii_lower(text)), F.regexp_extract_all(text, F.lit(SYMBOLS), F.lit(0))))


def domain_of(quality: Column, toxic: Column) -> Column:
    """Domain number of a label row; null when the label says nothing."""
    return F.when(toxic == 1, 2).when(quality == 1, 0).when(quality == 0, 1)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 20_000, vocabulary: int = 20_000, ratio: float = 3.0, evidence: float = 20.0,
        text: str = "text", key: str = "doc_id") -> tuple[DataFrame, list[float]]:
    """Bernoulli naive Bayes: weights ``(word, w0, w1, ..)`` of present words, and what a document without them has.

    ``rows`` bounds the labelled documents used (the least hashes of their keys; equal texts count
    once). Words speak for a domain when they are ``ratio`` times as frequent there as in all and their
    log-likelihood ratio is at least ``evidence``; the ``vocabulary`` best are kept, so a task holds no more.
    Labels with a null key or no domain are left out; a domain without labels counts as one document.
    """
    k = len(DOMAINS)
    marked = labels.select(F.col(key).alias("_key"), domain_of(F.col("quality"), F.col("toxic")).alias("_d")).dropna()
    marked = marked.groupBy("_key").agg(F.max("_d").alias("_d")).orderBy(F.xxhash64("_key"), "_key").limit(rows)
    marked = small(stage(marked, "labels"), rows)
    sample = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text")).join(marked, "_key")
    sample = stage(sample.groupBy(features(F.col("_text")).alias("_words")).agg(F.max("_d").alias("_d")), "sample")
    count = lambda d: F.count_if(F.col("_d") == d)
    found = sample.agg(*(count(d).alias(f"n{d}") for d in range(k))).first()
    sizes = [found[f"n{d}"] + 1 for d in range(k)]
    total = sum(sizes)
    words = sample.select("_d", F.explode("_words").alias("word")).groupBy("word").agg(*(count(d).alias(f"n{d}") for d in range(k)))
    n = [F.col(f"n{d}") for d in range(k)]
    seen = sum(n[1:], n[0])
    # smoothing adds documents in which the word is as frequent as in all
    q = [(n[d] + seen * 2 / total) / (sizes[d] + 2) for d in range(k)]
    share = seen / total
    gain = sum((n[d] * F.log(q[d] / share) for d in range(1, k)), n[0] * F.log(q[0] / share)) * 2
    raised = F.greatest(*q) / share
    chosen = words.where((gain >= evidence) & (raised >= ratio)).orderBy(gain.desc(), "word").limit(vocabulary)
    clip = lambda x: F.least(F.lit(0.999), x)
    weights = stage(chosen.select("word", *(F.log(clip(q[d]) / (1 - clip(q[d]))).alias(f"w{d}") for d in range(k)),
                                  *(F.log(1 - clip(q[d])).alias(f"z{d}") for d in range(k))), "weights")
    none = weights.agg(*(F.coalesce(F.sum(f"z{d}"), F.lit(0.0)).alias(f"z{d}") for d in range(k))).first()
    return weights.select("word", *(f"w{d}" for d in range(k))), [log(sizes[d] / total) + none[f"z{d}"] for d in range(k)]


def posteriors(docs: DataFrame, model: tuple[DataFrame, list[float]], text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_tokens, p)`` for each key: its words (not distinct) and domain posteriors, rounded to six places.

    Rows that share a key are one document. Null and empty texts have no words.
    """
    weights, without = model
    k = len(without)
    rows = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text"))
    rows = rows.select("_key", F.size(alnum_words(ascii_lower(F.col("_text")))).alias("_n"), features(F.col("_text")).alias("_words"))
    # one row for each word, and one before them that carries the number of tokens
    each = rows.select("_key", "_n", F.posexplode(F.concat(F.array(F.lit("")), "_words")).alias("_at", "word"))
    known = each.join(small(weights, BROADCAST_ROWS), "word", "left")
    sums = known.groupBy("_key").agg(
        F.sum(F.when(F.col("_at") == 0, F.col("_n"))).cast("long").alias("n_tokens"),
        *((F.coalesce(F.sum(f"w{d}"), F.lit(0.0)) + without[d]).alias(f"s{d}") for d in range(k)),
    )
    top = F.greatest(*(F.col(f"s{d}") for d in range(k)))
    sums = sums.select("_key", "n_tokens", *(F.exp(F.col(f"s{d}") - top).alias(f"e{d}") for d in range(k)))
    norm = sum((F.col(f"e{d}") for d in range(1, k)), F.col("e0"))
    return sums.select(
        F.col("_key").alias(key), "n_tokens", F.array(*(F.round(F.col(f"e{d}") / norm, 6) for d in range(k))).alias("p")
    )


def momentum(step: int) -> float:
    """Weight of the last move in the point from which step ``step`` (from 0) starts."""
    return step / (step + 3.0)


def rate_of(p: Column, steps: list[list[float]]) -> Column:
    """The rate after the given steps: each goes on from the last move, subtracts ``p . step`` and projects on 0."""
    if not steps:
        return F.lit(1.0)
    k = len(steps[0])
    dot = lambda s: sum((F.get(p, d) * F.get(s, d) for d in range(1, k)), F.get(p, 0) * F.get(s, 0))
    table = F.array(*(F.array(F.lit(momentum(i)), *(F.lit(float(x)) for x in s)) for i, s in enumerate(steps)))
    ahead = lambda a, s: a["r"] + F.get(s, 0) * (a["r"] - a["before"])
    shift = lambda s: F.slice(s, 2, k)
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("before"))
    step = lambda a, s: F.struct(F.greatest(F.lit(0.0), ahead(a, s) - dot(shift(s))).alias("r"), a["r"].alias("before"))
    return F.aggregate(table, start, step, lambda a: a["r"])


def unwanted(p: Column, weights: dict[str, float]) -> Column:
    """Whether the most probable domain has weight zero."""
    return F.array_position(p, F.array_max(p)).isin([d + 1 for d, n in enumerate(DOMAINS) if not weights.get(n)])


def rates(members: DataFrame, weights: dict[str, float], rounds: int = 40, tolerance: float = 1e-3):
    """Steps of the fit for ``members (n_tokens, p)``, and the token totals per domain that it reaches and aims at.

    Members whose most probable domain has weight zero have rate zero and take no part. The targets share
    out the tokens T for which the first domain with a weight keeps its own tokens. Of what the others
    hold of a domain of weight zero in expectation, the share ``SOFT`` is its target, and less is no miss. The
    gradient of the squared miss is taken in the metric in which a rate weighs as much as its document's tokens and a miss
    as 1 / (tokens of the domain): the matrix of the problem then has a norm of at most 1, so a step of 1
    is safe. Accelerated steps need the totals at a point on the line through the last two, which follow
    from theirs. Stops when each miss is below ``tolerance`` of the tokens of its own domain.
    """
    members = members.where(~unwanted(F.col("p"), weights))
    k = len(DOMAINS)
    totals = lambda rate: [F.coalesce(F.sum(F.col("n_tokens") * rate * F.get("p", d)), F.lit(0.0)).alias(f"t{d}") for d in range(k)]
    have = [float(x) for x in members.agg(*totals(F.lit(1.0))).first()]
    share = [weights.get(d, 0.0) for d in DOMAINS]
    lead = next((d for d in range(k) if share[d] > 0 and have[d] > 0), None)
    if lead is None:
        return [], have, [0.0] * k
    whole = have[lead] / share[lead]
    # a domain without tokens cannot be reached by any rate
    goal = [0.0 if have[d] <= 0 else whole * share[d] if share[d] > 0 else SOFT * have[d] for d in range(k)]
    miss = lambda d, t: t - goal[d] if share[d] > 0 else max(0.0, t - goal[d])
    steps: list[list[float]] = []
    reached = before = have
    while len(steps) < rounds and any(abs(miss(d, reached[d])) > tolerance * have[d] for d in range(k)):
        go = momentum(len(steps))
        point = [reached[d] + go * (reached[d] - before[d]) for d in range(k)]
        steps.append([miss(d, point[d]) / have[d] if have[d] > 0 else 0.0 for d in range(k)])
        now = members.withColumn("_rate", rate_of(F.col("p"), steps)).agg(*totals(F.col("_rate"))).first()
        before, reached = reached, [float(x) for x in now]
    return steps, reached, goal


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, text: str = "text", key: str = "doc_id", **fitting) -> DataFrame:
    """``(key, n_tokens, p_<domain>.., rate)`` for each key of ``docs``; rates are rounded to six places.

    Without labels every document has the prior's posterior; an empty table gives no rows.
    """
    members = stage(posteriors(docs, fit(docs, labels, text=text, key=key, **fitting), text, key), "members")
    # Documents of equal posteriors have equal rates: steps run on one row for each posterior.
    groups = stage(members.groupBy("p").agg(F.sum("n_tokens").cast("double").alias("n_tokens")), "posteriors")
    steps, reached, goal = rates(groups, weights)
    log_to.info("%d steps; tokens of %s reached %s, target %s", len(steps), DOMAINS, reached, goal)
    rate = F.round(rate_of(F.col("p"), steps), 6)
    return members.select(
        key, "n_tokens", *(F.get("p", d).alias(f"p_{n}") for d, n in enumerate(DOMAINS)),
        F.when(unwanted(F.col("p"), weights), 0.0).otherwise(rate).alias("rate"),
    )
