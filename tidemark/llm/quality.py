"""Quality rules: base counts of a text, then a likelihood ratio of hashed n-grams.

Two multinomials over hashed word unigrams and bigrams are compared, that of trusted documents
and that of the whole corpus. A document's score is the mean log ratio of its n-grams; a
document is kept when no base rule fails and the score reaches the threshold.

* Null text counts as empty: no words, so the base rule on length rejects it.
* Repeated rows are counted and decided like any other row; equal texts get equal verdicts.
* An empty table gives an empty result. Without a trusted document every ratio is 0 and only
  the base rules decide.
* Columns of the input may have any name: results are in one struct with a free name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import SPACE, const_array, fresh, let, text_of, words
from tidemark.operators.sizing import broadcast_if_small, store

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class QualityParams:
    """``trusted_rows`` bounds the labelled documents the target is fitted on.

    Of those with the smallest seeded hashes half are used to fit the target. All other trusted
    documents, whatever their number, set the threshold: the score that the share ``tail`` of
    them stays below, less ``margin``. Where they are too few to have such a share, the least score
    is carried on to it. Those shorter than ``min_words`` are left out, because their scores vary
    most and the base rule rejects them anyway.
    """

    buckets: int = 16_384
    smoothing: float = 1.0
    trusted_rows: int = 20_000
    tail: float = 0.001
    margin: float = 0.02
    min_words: int = 50
    repeat_percent: int = 50
    seed: int = 7


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def _repeat_words(w: str) -> Column:
    """Words inside 3-word windows that occur at least twice; ``w`` names the word array.

    Each window is one number, its hash above its place, so equal windows are neighbours after
    a sort of plain numbers; the words themselves settle a collision of hashes. Each repeated
    window then covers three words or those up to the next one.
    """
    place = "cast({x} & (d.unit - 1) as int)"
    equal = " AND ".join(
        ["((a ^ b) & -d.unit) = 0", *(f"d.w[{place.format(x='a')} + {k}] = d.w[{place.format(x='b')} + {k}]" for k in range(3))]
    )
    return F.expr(f"""
        element_at(transform(array(struct({w} AS w, shiftleft(1L, length(bin(size({w})))) AS unit)), d ->
          element_at(transform(array(
            sort_array(transform(sequence(0, size(d.w) - 3), i ->
              (xxhash64(d.w[i], d.w[i + 1], d.w[i + 2]) & -d.unit) | i))), s ->
            element_at(transform(array(
              filter(zip_with(s, slice(s, 2, size(s) - 1), (a, b) ->
                CASE WHEN {equal} THEN struct(a, b) END), x -> x IS NOT NULL)), pairs ->
              CASE WHEN size(pairs) = 0 THEN 0L ELSE
                element_at(transform(array(
                  sort_array(array_distinct(
                    transform(flatten(transform(pairs, x -> array(x.a, x.b))), x -> x & (d.unit - 1))))), p ->
                  aggregate(zip_with(p, slice(p, 2, size(p) - 1), (a, b) -> least(3L, coalesce(b - a, 3L))),
                    0L, (n, x) -> n + x)), 1) END), 1)), 1)), 1)
    """)


def base_counts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """The rows with a struct of counts, and the struct's name."""
    out, t, w = (fresh(docs, x) for x in ("_quality", "_quality_text", "_quality_words"))
    split = docs.withColumn(t, text_of(text)).withColumn(w, words(F.col(t)))
    counted = split.withColumn(
        out,
        F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(F.col(t), F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            _dup_lines(F.col(t)).alias("n_dup_lines"),
            F.when(F.size(w) < 4, F.lit(0).cast("bigint")).otherwise(_repeat_words(w)).alias("n_repeat_words"),
        ),
    )
    return counted.drop(t, w), out


def _ngrams(w: Column, buckets: int) -> Column:
    """Hash buckets of all words and of all pairs of neighbours."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))

    def pair(i: Column) -> Column:
        return F.pmod(F.xxhash64(w[i], w[i + 1]), F.lit(buckets)).cast("int")

    two = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), pair))
    return F.concat(one, F.coalesce(two, F.array().cast("array<int>")))


def hashed_ngrams(docs: DataFrame, text: str, buckets: int, *keep: Column | str) -> DataFrame:
    tokens = words(text_of(text))
    return docs.select(*keep, let(tokens, lambda w: _ngrams(w, buckets)).alias("_grams"))


def trusted_ids(labels: DataFrame, params: QualityParams) -> tuple[DataFrame, DataFrame]:
    """Ids of good, harmless documents: half of a number bounded by seeded hash to fit on, and all others."""
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull())
    good = store(good.select("doc_id").distinct())
    order = F.xxhash64("doc_id", F.lit(params.seed))
    fitted = good.orderBy(order, "doc_id").limit(params.trusted_rows).where(F.pmod(order, F.lit(2)) == 0)
    fitted = store(fitted)
    return fitted, store(good.join(F.broadcast(fitted), "doc_id", "left_anti"))


def fit_ratio(docs: DataFrame, labels: DataFrame, params: QualityParams) -> tuple[list[float], float]:
    """Log ratio of each bucket, and the threshold.

    Counts are summed in the tasks first, so at most ``buckets`` rows leave each of them; the
    driver gets one row per bucket.
    """
    size = params.buckets
    # The threshold comes from trusted documents that the target was not fitted on.
    fitted, others = trusted_ids(labels, params)
    raw = ngram_counts(hashed_ngrams(docs, "text", size))
    good = ngram_counts(hashed_ngrams(docs.join(F.broadcast(fitted), "doc_id"), "text", size))
    a, total, good_total = params.smoothing, sum(raw.values()), sum(good.values())
    if not good_total:
        return [0.0] * size, -math.inf
    ratio = [
        round(
            math.log((good.get(b, 0) + a) / (good_total + a * size))
            - math.log((raw.get(b, 0) + a) / (total + a * size)),
            6,
        )
        for b in range(size)
    ]
    # Whole thousandths: a bounded histogram that is the same in every run.
    # Nulls go here and not in the plan: Spark would test for them below the join, on all documents.
    sent = broadcast_if_small(others)
    marked = docs.select("doc_id", "text")
    grams = hashed_ngrams(marked if sent is None else marked.join(sent, "doc_id"), "text", size, "doc_id")
    # As many n-grams as a text of the least words has.
    long = F.size("_grams") >= max(0, 2 * params.min_words - 1)
    scored = grams.select("doc_id", F.when(long, F.floor(1000 * ngram_score(F.col("_grams"), ratio))).alias("bin"))
    # Too many ids for a broadcast are joined with the scores, not with the texts.
    scored = scored.join(others, "doc_id") if sent is None else scored
    counted = scored.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()
    bins = sorted((r["bin"], r["n"]) for r in counted if r["bin"] is not None)
    if not bins:
        return ratio, -math.inf
    low, middle = _quantile(bins, params.tail), _quantile(bins, 0.5)
    return ratio, (middle - (middle - low) * _beyond(sum(n for _, n in bins), params.tail)) / 1000 - params.margin


def _beyond(rows: int, tail: float) -> float:
    """How much farther from the median than the least of ``rows`` scores the quantile ``tail`` lies.

    1 as soon as there are enough rows to see that quantile; before, as in an exponential tail.
    """
    if rows * tail >= 1 or rows < 2:
        return 1.0
    return max(1.0, math.log(0.5 / tail) / math.log((rows + 1) / 2))


def _quantile(bins: list[tuple[int, int]], share: float) -> int:
    """The first value that more than ``share`` of all are at or below."""
    below, wanted = 0, share * sum(n for _, n in bins)
    for value, n in bins:
        below += n
        if below > wanted:
            break
    return value


def ngram_counts(hashed: DataFrame) -> dict[int, int]:
    rows = (
        # The outer form: the plain one makes Spark compute the array a second time, to drop empty ones.
        hashed.select(F.explode_outer("_grams").alias("b")).groupBy("b").agg(F.count("b").alias("n")).collect()
    )
    return {r["b"]: r["n"] for r in rows if r["b"] is not None}


def ngram_score(grams: Column, ratio: list[float]) -> Column:
    """Mean log ratio; null for a text without words."""
    table = const_array(ratio, "double")
    total = let(
        F.struct(grams.alias("g"), table.alias("t")),
        lambda d: F.aggregate(d["g"], F.lit(0.0), lambda acc, b: acc + d["t"][b]) / F.size(d["g"]),
    )
    return F.when(F.size(grams) > 0, total)


def quality_rules(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None) -> tuple[DataFrame, str]:
    """The rows with a struct ``n_words .. n_repeat_words, score, base_failed, kept``, and its name."""
    params = params or QualityParams()
    ratio, threshold = fit_ratio(docs, labels, params)
    counted, name = base_counts(docs)
    grams = fresh(counted, "_quality_grams")
    tokens = words(text_of("text"))
    scored = counted.withColumn(grams, let(tokens, lambda w: _ngrams(w, params.buckets)))
    q = F.col(name)
    failed = (q["n_words"] < params.min_words) | (100 * q["n_repeat_words"] > params.repeat_percent * q["n_words"])
    score = fresh(scored, "_quality_score")
    scored = scored.withColumn(score, ngram_score(F.col(grams), ratio))
    good = F.coalesce(F.col(score) >= threshold, F.lit(False)) if threshold > -math.inf else F.lit(True)
    fields = [q[f].alias(f) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    verdict = F.struct(
        *fields, F.col(score).alias("score"), failed.alias("base_failed"), (~failed & good).alias("kept")
    )
    return scored.withColumn(name, verdict).drop(grams, score), name
