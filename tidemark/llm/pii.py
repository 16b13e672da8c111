"""Personal data: weak labelers vote on candidate spans, EM weighs them, a classifier decides.

Every valid base span (email, ip, card, phone) is kept. Looser candidates (numbers, handles,
names) are added when the classifier gives them a probability of at least ``threshold``.

Labelers are patterns, gazetteers and words near a candidate; each votes for, against or not at
all. Expectation-maximisation finds how often each casts which vote on personal data and on other
text, and how much of a kind's candidates is personal data; base spans are known to be. The
classifier is trained towards what that says of each candidate, on votes, kind, length and the
two words before it, hashed, so it can tell apart what the labelers vote alike on.

* Null text counts as empty and has no spans; a null id stays null.
* Very long texts are searched whole; no pattern has to try a run of characters from each place in it.
* Equal texts have equal spans; repeated rows count as often as they occur.
* An empty table gives an empty result, and a corpus without candidates trains nothing.
* Of the input only the text and the columns named in ``keep`` are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import const_array, find_all, let, text_of, uncovered
from tidemark.operators.sizing import store

# Base patterns. A look behind or the end of the last match ties each to the start of a run, and
# possessive loops never go back: the matches are those of the plain patterns, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Candidates beyond them.
NUMBER = r"(?<![A-Za-z0-9+.(-])\(?[0-9](?:[\x20().-]?[0-9]){6,}+(?![A-Za-z0-9])"
HANDLE = r"(?<![A-Za-z0-9._%+@-])@[A-Za-z0-9_]{3,30}+(?![A-Za-z0-9_@.-])"
NAME = r"(?<![A-Za-z])[A-Z][a-z]++\x20[A-Z][a-z]++(?![A-Za-z])"

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "number", "handle", "name")

FIRST_NAMES = (
    "James Mary John Linda Robert Susan Michael Karen David Sarah Thomas Anna Peter Laura Paul Emma Daniel Julia "
    "Martin Sophie Hans Ursula Klaus Petra Jean Marie Pierre Claire Luis Carmen Jose Maria Juan Ana Carlos Elena"
).split()
CALLING_CODES = r"^\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[^0-9]"
DOMAINS = r"\.(?:com|org|net|edu|gov|io|co|de|fr|es|it|nl|uk|eu|info)$"
CONTEXT = (
    r"(?:phone|tel|mobile|cell|call|fax|mail|contact|reach|card|visa|account|iban|ssn|passport|address|name is"
    r"|mr|mrs|ms|dr)[\x20.:#=]*$"
)
AGAINST = r"(?:order|page|version|isbn|issue|invoice|total|year|figure|table|chapter|line|id|no|nr|section)[\x20.:#=]*$"

LABELERS = 6
_LENGTHS = 4
# Numbers for the words before a candidate, besides that of no word.
_WORDS = 32
_FEATURES = len(KINDS) + 3 * LABELERS + _LENGTHS + 2 * (_WORDS + 1)
_CANDIDATES = "array<struct<kind:int,start:bigint,stop:bigint,base:boolean,features:array<int>>>"


@dataclass(frozen=True)
class PiiParams:
    """``trained``: most candidates the classifier is trained on, those of the smallest hashes.

    Votes are counted over all candidates. ``prior``: weight, in candidates, of the votes that
    are expected of a labeler, for one that votes as its class says, not at all, or the other way.
    """

    threshold: float = 0.9
    em_rounds: int = 40
    train_rounds: int = 400
    context: int = 24
    trained: int = 20_000
    prior: tuple[float, float, float] = (3.0, 3.0, 1.0)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether every second digit from the right, doubled, gives a check sum that ends in 0."""

    def total(parts: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            d = parts[F.size(parts) - 1 - i].cast("int")
            twice = 2 * d
            return acc + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

        return F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), F.lit(0), add) % 10 == 0

    return let(F.split(digits, ""), total)


def _small_parts(ip: Column) -> Column:
    return ip.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?(?:\.|$)){4}$")


def _base_spans(text: Column, digits: Column, context: int) -> dict[str, Column]:
    ip = find_all(text, IP, digits, context)
    card = find_all(text, CARD, digits, context)
    phone = find_all(text, PHONE, F.contains(text, F.lit("+")), context)
    return {
        "email": find_all(text, EMAIL, F.contains(text, F.lit("@")), context),
        "ip": F.filter(ip, lambda s: _small_parts(s["match"])),
        "card": F.filter(card, lambda s: luhn(_digits(s["match"]))),
        "phone": F.filter(phone, lambda s: F.length(_digits(s["match"])).between(8, 15)),
    }


def _loose_spans(text: Column, digits: Column, context: int) -> dict[str, Column]:
    return {
        "number": find_all(text, NUMBER, digits, context),
        "handle": find_all(text, HANDLE, F.contains(text, F.lit("@")), context),
        "name": find_all(text, NAME, None, context),
    }


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, 2)
    return vote.otherwise(1) if no is None else vote.when(no, 0).otherwise(1)


def _votes(kind: str, match: Column, left: Column) -> list[Column]:
    """One of 0 (against), 1 (no opinion), 2 (for) from each labeler."""
    digits, never = _digits(match), F.lit(False)
    left = F.lower(left)
    shape = {
        "phone": match.rlike(r"^\+[0-9]{1,3}[\x20-]\(?[0-9]{2,4}\)?[\x20-]"),
        "card": match.rlike(r"^(?:[0-9]{16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$"),
        "number": match.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
        "name": never,
        "handle": match.rlike("[0-9_]"),
    }.get(kind, F.lit(True))
    check = {
        "card": (F.lit(True), None),
        "number": (never, F.length(digits) > 12),
        "ip": (never, match.rlike(r"^(?:10|127|192\.168|0)\.")),
    }.get(kind, (never, None))
    known = {
        "email": (match.rlike(DOMAINS), None),
        "phone": (match.rlike(CALLING_CODES), None),
        "name": (F.split(match, " ")[0].isin(FIRST_NAMES), ~F.split(match, " ")[0].isin(FIRST_NAMES)),
    }.get(kind, (never, None))
    plain = match.rlike(r"^[0-9]+$") if kind == "number" else match.rlike(r"([0-9])\1{6}")
    return [
        _vote(shape, ~shape if kind in ("number", "handle") else None),
        _vote(*check),
        _vote(*known),
        _vote(left.rlike(CONTEXT)),
        _vote(never, left.rlike(AGAINST)),
        _vote(never, plain),
    ]


def _features(kind: str, span: Column) -> Column:
    """Indices of what holds: the kind, a vote of each labeler, the length, the two words before."""
    first = len(KINDS)
    votes = [v + (first + 3 * i) for i, v in enumerate(_votes(kind, span["match"], span["left"]))]
    length = F.least(F.length(span["match"]) / F.lit(8), F.lit(_LENGTHS - 1)).cast("int") + first + 3 * LABELERS
    words, left = first + 3 * LABELERS + _LENGTHS, F.lower(span["left"])
    near = [
        F.regexp_extract(left, r"([a-z]+)[^a-z]*$", 1),
        F.regexp_extract(left, r"([a-z]+)[^a-z]+[a-z]+[^a-z]*$", 1),
    ]
    hashed = [
        F.when(w == "", 0).otherwise(1 + F.pmod(F.xxhash64(w), F.lit(_WORDS))) + (words + i * (_WORDS + 1))
        for i, w in enumerate(near)
    ]
    return F.array(F.lit(KINDS.index(kind)), *votes, length, *hashed).cast("array<int>")


def _candidates(spans: dict[str, Column]) -> Column:
    def of(kind: str) -> Column:
        return F.transform(
            spans[kind],
            lambda s: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                s["start"].alias("start"),
                s["stop"].alias("stop"),
                F.lit(kind in BASE).alias("base"),
                _features(kind, s).alias("features"),
            ),
        ).cast(_CANDIDATES)

    return F.concat(*[of(kind) for kind in KINDS])


Pattern = tuple[int, bool, tuple[int, ...], int]


@dataclass(frozen=True)
class Reliabilities:
    """What EM found: per kind the share of personal data, per class, labeler and vote its share.

    Votes are 0 (against), 1 (no opinion) and 2 (for); class 1 is personal data. A labeler's
    sensitivity is its share of votes for in class 1, its specificity that of the others in class 0.
    """

    rates: dict[int, float]
    shares: list[list[list[float]]]

    def posterior(self, kind: int, base: bool, votes: Sequence[int]) -> float:
        if base:
            return 1.0
        rate = self.rates[kind]
        odds = math.log(rate / (1 - rate))
        for j, v in enumerate(votes):
            odds += math.log(self.shares[1][j][v] / self.shares[0][j][v])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def reliabilities(patterns: Sequence[Pattern], params: PiiParams) -> Reliabilities:
    """EM over ``kind, base, votes, count``; their number does not depend on the corpus.

    It starts from the balance of the votes. Given the class, labelers are taken as independent.
    """
    agree, silent, other = params.prior
    prior = [[agree, silent, other], [other, silent, agree]]
    post = [1.0 if base else 1 / (1 + math.exp(-2.0 * (sum(v) - len(v)))) for _, base, v, _ in patterns]
    found = Reliabilities({}, [])
    for _ in range(params.em_rounds):
        shares = [[list(prior[c]) for _ in range(LABELERS)] for c in (0, 1)]
        ours: dict[int, float] = {}
        all_: dict[int, float] = {}
        for (kind, base, votes, n), p in zip(patterns, post, strict=True):
            for j, v in enumerate(votes):
                shares[1][j][v] += n * p
                shares[0][j][v] += n * (1 - p)
            if not base:
                ours[kind] = ours.get(kind, 1.0) + n * p
                all_[kind] = all_.get(kind, 2.0) + n
        shares = [[[x / sum(row) for x in row] for row in side] for side in shares]
        found = Reliabilities({k: ours[k] / all_[k] for k in all_}, shares)
        post = [found.posterior(kind, base, votes) for kind, base, votes, _ in patterns]
    return found


def _votes_of(features: Sequence[int]) -> tuple[int, ...]:
    first = len(KINDS)
    return tuple(f - first - 3 * j for j, f in enumerate(features[1 : 1 + LABELERS]))


def _train(rows: Sequence[tuple[Sequence[int], float, int]], rounds: int) -> list[float]:
    """Logistic regression on ``features, posterior, count``, by steps down the mean loss."""
    weights = np.zeros(_FEATURES)
    if not rows:
        return weights.tolist()
    at = np.array([r[0] for r in rows])
    target, count = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    count /= count.sum()
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(weights[at].sum(axis=1), -30, 30)))
        error = np.repeat((chance - target) * count, at.shape[1])
        weights -= 0.5 * (np.bincount(at.ravel(), error, _FEATURES) + 1e-4 * weights)
    return [round(float(w), 9) for w in weights]


def fit(voted: DataFrame, column: str, params: PiiParams) -> list[float]:
    """Weights of the span classifier: EM over all candidates, training on a bounded number of them.

    ``voted`` has the candidates in ``column`` and a hash of their text in ``_hash``.
    """
    one = voted.select("_hash", F.explode(column).alias("c"))
    votes = F.slice("c.features", 2, LABELERS)
    counted = one.groupBy("c.kind", "c.base", votes.alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = sorted((r["kind"], r["base"], _votes_of([0, *r["v"]]), r["n"]) for r in counted)
    found = reliabilities(patterns, params)
    order = F.xxhash64("_hash", "c.kind", "c.start")
    some = one.select("c.features", "c.kind", "c.base", order.alias("h")).orderBy("h", "features").limit(params.trained)
    shown = some.groupBy("kind", "base", "features").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted((r["features"], found.posterior(r["kind"], r["base"], _votes_of(r["features"])), r["n"]) for r in shown)
    return _train(rows, params.train_rounds)


def detect_pii(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), params: PiiParams | None = None) -> DataFrame:
    """Per row: the columns of ``keep`` and ``spans``, by kind, then start.

    A span has ``kind, start, stop, base, probability``; places are in code points, the end
    exclusive. Texts are read once: what the labelers say goes to a table, and later steps read that.
    """
    params = params or PiiParams()
    passed = [F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    searched = docs.select(*passed, text_of().alias("_t")).withColumn("_d", F.col("_t").rlike("[0-9][0-9.\x20()-]"))
    text, digits = F.col("_t"), F.col("_d")
    spans = {**_base_spans(text, digits, params.context), **_loose_spans(text, digits, params.context)}
    found = searched.select("*", *[spans[k].alias(f"_{k}") for k in KINDS])
    kept = [f"_keep_{i}" for i in range(len(keep))]
    all_ = _candidates({k: F.col(f"_{k}") for k in KINDS}).alias("_all")
    voted = store(found.select(*kept, F.xxhash64("_t").alias("_hash"), all_))
    weights = const_array(fit(voted, "_all", params), "double")

    def score(c: Column, w: Column) -> Column:
        return F.aggregate(c["features"], F.lit(0.0), lambda acc, f: acc + w[f])

    def decide(d: Column) -> Column:
        base = F.filter(d["all"], lambda c: c["base"])

        def judge(c: Column) -> Column:
            p = 1 / (1 + F.exp(-score(c, d["w"])))
            return F.struct(
                F.element_at(F.array(*[F.lit(k) for k in KINDS]), c["kind"] + 1).alias("kind"),
                c["start"].alias("start"),
                c["stop"].alias("stop"),
                c["base"].alias("base"),
                F.round(p, 6).alias("probability"),
            )

        loose = F.filter(d["all"], lambda c: ~c["base"])
        judged = F.transform(F.concat(base, uncovered(loose, base)), judge)
        return F.filter(judged, lambda c: c["base"] | (c["probability"] >= params.threshold))

    out = let(F.struct(F.col("_all").alias("all"), weights.alias("w")), decide)
    return voted.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], out.alias("spans"))


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, a hash of the base spans, all spans as text; what was added, with probabilities."""

    def named(spans: Column, *more: str) -> Column:
        def name(s: Column) -> Column:
            return F.concat_ws(":", s["kind"], *[s[f].cast("string") for f in ("start", "stop", *more)])

        return F.array_join(F.transform(spans, name), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base, added = F.filter("spans", lambda s: s["base"]), F.filter("spans", lambda s: ~s["base"])
    return found.select(
        "doc_id",
        *[count(kind) for kind in BASE],
        F.sha2(named(base), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
        F.size(added).cast("bigint").alias("n_added"),
        named(added, "probability").alias("added"),
    )
