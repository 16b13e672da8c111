"""Quality of documents with the help of their sites: hierarchical empirical Bayes.

A classifier of hashed n-grams gives every document a probability of being good. Hosts, and
paths inside them, get posteriors from their documents' probabilities: each level's prior is
centred on the level above, and its strength follows from the spread between and inside the
groups, so a site with few documents stays near its host and a host with few near the global
rate. A document's odds are those of its text times those of its path against the global rate,
the path without the document itself.

* A null text counts as empty and says nothing: its text's probability is the global rate. A
  null host or path is one more group.
* Repeated rows count as often as they occur. An empty table gives an empty result.
* Without labels of both kinds every text has probability 0.5.
* A level whose groups differ no more than chance would make them, or that has one group only, has a
  strength of ``STRONGEST`` documents, which leaves its groups at the level above.
* Only the id, text, host and path are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quality import hashed_ngrams, ngram_counts, ngram_score
from tidemark.operators.sizing import broadcast_if_small, store

_EDGE = 1e-4
# The most documents a prior counts for.
STRONGEST = 1e6


@dataclass(frozen=True)
class SiteParams:
    """``labelled_rows`` bounds the documents of each kind the classifier is fitted on.

    Those with the smallest seeded hashes are used: half for the n-grams, half to turn scores into
    probabilities.
    """

    buckets: int = 16_384
    labelled_rows: int = 20_000
    bins: int = 20
    keep: float = 0.2
    seed: int = 5


def _sample(labels: DataFrame, params: SiteParams) -> DataFrame:
    """``doc_id, good, part``: a bounded number of labelled documents of each kind."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("good"))
    order = F.xxhash64("doc_id", F.lit(params.seed))
    kinds = [known.where(F.col("good") == k).orderBy(order, "doc_id").limit(params.labelled_rows) for k in (0, 1)]
    return kinds[0].unionByName(kinds[1]).withColumn("part", F.pmod(order, F.lit(2)))


def fit_classifier(
    docs: DataFrame, labels: DataFrame, params: SiteParams
) -> tuple[list[float], list[tuple[float, float]]]:
    """Log ratio per bucket, and ``(least score, probability)`` steps that never fall."""
    sample = F.broadcast(_sample(labels, params))
    rows = store(docs.select("doc_id", "text").join(sample, "doc_id"))
    grams = hashed_ngrams(rows, "text", params.buckets, "good", "part")
    counts = [ngram_counts(grams.where(f"part = 0 AND good = {k}")) for k in (0, 1)]
    totals = [sum(c.values()) for c in counts]
    if not all(totals):
        return [0.0] * params.buckets, []
    size = params.buckets
    ratio = [
        round(
            math.log((counts[1].get(b, 0) + 1) / (totals[1] + size))
            - math.log((counts[0].get(b, 0) + 1) / (totals[0] + size)),
            6,
        )
        for b in range(size)
    ]
    score = F.round(ngram_score(F.col("_grams"), ratio), 3)
    # One row per thousandth of a score and kind.
    seen = grams.select("part", "good", score.alias("s")).groupBy("part", "good", "s").agg(F.count(F.lit(1)).alias("n"))
    held = sorted((r["s"], r["good"], r["n"]) for r in seen.collect() if r["part"] == 1 and r["s"] is not None)
    return ratio, _steps(held, params.bins)


def _steps(held: list[tuple[float, int, int]], bins: int) -> list[tuple[float, float]]:
    """Equal shares of the held-out documents, pooled until their rates never fall."""
    total = sum(n for _, _, n in held)
    groups: list[list[float]] = []
    for s, good, n in held:
        if not groups or (groups[-1][2] >= total / bins and s > groups[-1][3]):
            groups.append([s, 0.0, 0.0, s])
        groups[-1][1] += n * good
        groups[-1][2] += n
        groups[-1][3] = s
    out: list[list[float]] = []
    for low, good, n, _ in groups:
        out.append([low, good, n])
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            _, g, m = out.pop()
            out[-1][1] += g
            out[-1][2] += m
    return [(low, (good + 1) / (n + 2)) for low, good, n in out]


def score_documents(docs: DataFrame, labels: DataFrame, host: Column, path: Column, params: SiteParams) -> DataFrame:
    """``doc_id, host, path, p``, as a table. Null ``p`` for a text without words."""
    ratio, steps = fit_classifier(docs, labels, params)
    grams = hashed_ngrams(docs, "text", params.buckets, "doc_id", host.alias("host"), path.alias("path"))
    scored = grams.select("doc_id", "host", "path", F.round(ngram_score(F.col("_grams"), ratio), 3).alias("s"))
    p = F.lit(steps[0][1]) if steps else F.lit(0.5)
    for low, probability in steps[1:]:
        p = F.when(F.col("s") >= low, probability).otherwise(p)
    return store(scored.select("doc_id", "host", "path", F.when(F.col("s").isNotNull(), p).alias("p")))


def _strength(groups: DataFrame, above: str) -> float:
    """How many documents a level's prior counts for: spread inside groups over that between them.

    ``groups`` has ``n, total, squares`` of each group and the mean ``above`` it.
    """
    row = groups.agg(
        F.count(F.lit(1)).alias("g"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("squares") - F.col("total") * F.col("total") / F.col("n")).alias("inside"),
        F.sum(F.col("n") * F.pow(F.col("total") / F.col("n") - F.col(above), 2)).alias("between"),
    ).first()
    g, n = row["g"], row["n"] or 0
    if g < 2 or n <= g:
        return STRONGEST
    inside = max(row["inside"], 0.0) / (n - g)
    spread = (row["between"] / (g - 1) - inside) / ((n - row["nn"] / n) / (g - 1))
    return min(STRONGEST, max(1.0, inside / spread)) if spread > 0 else STRONGEST


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys that may be null, by broadcast where the measured size allows it."""
    renamed = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    sent = broadcast_if_small(renamed)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(renamed if sent is None else sent, on).drop(*[f"_{k}" for k in keys])


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Path table ``host, path, n, total, host_posterior, path_strength, path_posterior``, host table and global rate.

    All sums are grouped aggregates, summed up in the tasks first: a host with a third of all
    documents leaves each task as one row per path.
    """
    known = scored.where("p IS NOT NULL")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares")]
    paths = store(known.groupBy("host", "path").agg(*sums))
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    hosts = store(hosts)
    all_ = hosts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    rate = all_["total"] / all_["n"] if all_["n"] else 0.5
    k = _strength(hosts.withColumn("above", F.lit(rate)), "above")
    posterior = (F.lit(k * rate) + F.col("total")) / (F.col("n") + k)
    mean = F.col("total") / F.col("n")
    hosts = store(hosts.select("host", "n", posterior.alias("host_posterior"), mean.alias("host_mean")))
    below = _joined(paths, hosts.select("host", "host_posterior", "host_mean"), ["host"])
    q = _strength(below, "host_mean")
    paths = below.select(
        "host",
        "path",
        "n",
        "total",
        "host_posterior",
        F.lit(q).alias("path_strength"),
        ((q * F.col("host_posterior") + F.col("total")) / (F.col("n") + q)).alias("path_posterior"),
    )
    return store(paths), hosts, rate


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(_EDGE)), F.lit(1 - _EDGE))
    return F.log(p / (1 - p))


def site_quality(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, params: SiteParams | None = None
) -> DataFrame:
    """``doc_id, text_probability, host_posterior, path_posterior, probability, kept`` of every document."""
    params = params or SiteParams()
    return combine(score_documents(docs, labels, host, path, params), params)


def combine(scored: DataFrame, params: SiteParams) -> DataFrame:
    """As ``site_quality``, from documents with the probabilities of their texts."""
    paths, _, rate = site_posteriors(scored)
    # Groups in which no document has words have the global rate.
    seen = scored.select("host", "path").distinct()
    missing = seen.join(
        paths.select(F.col("host").alias("_h"), F.col("path").alias("_p")),
        F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")),
        "left_anti",
    )
    empty = missing.select(
        "host",
        "path",
        F.lit(0).cast("bigint").alias("n"),
        F.lit(0.0).alias("total"),
        F.lit(rate).alias("host_posterior"),
        F.lit(STRONGEST).alias("path_strength"),
        F.lit(rate).alias("path_posterior"),
    )
    joined = _joined(scored, store(paths.unionByName(empty)), ["host", "path"])
    p = F.coalesce("p", F.lit(rate))
    others = F.when(
        F.col("p").isNotNull(),
        (F.col("path_strength") * F.col("host_posterior") + F.col("total") - F.col("p"))
        / (F.col("n") - 1 + F.col("path_strength")),
    ).otherwise(F.col("path_posterior"))
    odds = _logit(p) + _logit(others) - _logit(F.lit(rate))
    probability = F.round(1 / (1 + F.exp(-odds)), 6)
    return joined.select(
        "doc_id",
        F.round(p, 6).alias("text_probability"),
        F.round("host_posterior", 6).alias("host_posterior"),
        F.round("path_posterior", 6).alias("path_posterior"),
        probability.alias("probability"),
        (probability >= params.keep).alias("kept"),
    )
