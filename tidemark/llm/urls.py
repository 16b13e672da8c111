"""URL filter: rules by host and path decide first, boosted trees over lexical features the rest.

A rule names a host and the start of a path; it fits that host and all its subdomains, and the
longest rule that fits wins. URLs with a rule are the labelled ones. Trees are trained on them
over lengths, depth, shares of digits, entropy, numbers of parameters, and statistics of parts:
how often labelled URLs with the same host ending, file ending or first folder are blocked.

The statistics come from all labelled URLs of one half (by a hash of the URL), the trees from a
sample of the other, so that no URL is trained on a statistic that it is part of.

* A null URL, and one without ``://``, has an empty host and path and no rule; the trees judge it.
* Equal URLs get equal verdicts; repeated rows count as often as they occur. Very long ones are
  taken whole.
* With labels of one verdict only, all other URLs get that verdict; without any, all are allowed.
* An empty table gives an empty result. Columns of the input may have any name.

``sampled`` bounds the labelled URLs of each verdict that the trees are fitted on, those with the
smallest seeded hashes; statistics, rules and verdicts cover every row. A list of rules is
configuration and goes to every task as a constant.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import fresh, let, lower_ascii
from tidemark.operators.encode import lookup
from tidemark.operators.sizing import store
from tidemark.session import enable_checkpoints

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class UrlParams:
    """``prior``: weight, in URLs, of the overall share of blocked ones in a part's statistic."""

    rounds: int = 20
    depth: int = 4
    rate: float = 0.3
    sampled: int = 20_000
    prior: float = 10.0
    seed: int = 23


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    """What follows the first ``://``, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The name of the longest rule that fits, or null; of rules of one length the first by name."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = (host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))
        found = F.when(fits & F.startswith(path, F.lit(rule.path)), rule.name).otherwise(found)
    return found


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _entropy(text: Column) -> Column:
    """Bits per character, from the runs of the sorted characters."""

    def runs(chars: Column) -> Column:
        start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

        def closed(acc: Column) -> Column:
            return acc["sum"] + F.when(acc["run"] > 0, acc["run"] * F.log2(acc["run"].cast("double"))).otherwise(0.0)

        def step(acc: Column, c: Column) -> Column:
            same = c == acc["last"]
            return F.struct(
                c.alias("last"),
                F.when(same, acc["run"] + 1).otherwise(1).alias("run"),
                F.when(same, acc["sum"]).otherwise(closed(acc)).alias("sum"),
            )

        n = F.size(chars).cast("double")
        return F.log2(n) - F.aggregate(chars, start, step, closed) / n

    return F.when(F.length(text) > 0, let(F.array_sort(F.split(text, "")), runs)).otherwise(0.0)


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers that follow from the text of a URL alone."""
    digits = "0123456789"
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    features = {
        "length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "host_labels": _count(host, "."),
        "host_hyphens": _count(host, "-"),
        "host_digits": _count(host, digits) / F.greatest(F.length(host), F.lit(1)),
        "depth": _count(path, "/"),
        "digits": _count(url, digits) / F.greatest(F.length(url), F.lit(1)),
        "entropy": _entropy(url),
        "host_entropy": _entropy(host),
        "parameters": F.when(F.length(query) > 0, 1 + _count(query, "&")).otherwise(0),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
        "secure": F.startswith(url, F.lit("https")).cast("int"),
    }
    return {name: F.coalesce(f.cast("double"), F.lit(0.0)) for name, f in features.items()}


def parts(host: Column, path: Column) -> dict[str, Column]:
    """The parts whose statistics are features: endings of the host and the file, the first folder."""
    return {
        "suffix": F.substring_index(host, ".", -1),
        "domain": F.substring_index(host, ".", -2),
        "extension": F.regexp_extract(path, r"\.([A-Za-z0-9]*)$", 1),
        "folder": F.regexp_extract(path, "^/([^/]*)/", 1),
        "domain_folder": F.concat(F.substring_index(host, ".", -2), F.lit("/"), F.regexp_extract(path, "^/([^/]*)/", 1)),
        "www_folder": F.concat(F.startswith(host, F.lit("www.")).cast("string"), F.regexp_extract(path, "^/([^/]*)/", 1)),
    }


def _statistics(labelled: DataFrame, names: Sequence[str], prior: float) -> tuple[dict[str, DataFrame], float, int]:
    """Per part a table ``label, code, rows`` of its values' shares of blocked URLs, drawn to the overall one."""
    whole = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("b")).first()
    share = (whole["b"] or 0) / whole["n"] if whole["n"] else 0.0
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("part"), F.col(n).alias("label")) for n in names]))
    counts = labelled.select("blocked", each.alias("p")).groupBy("p.part", "p.label")
    counts = counts.agg(F.count(F.lit(1)).alias("rows"), F.sum("blocked").alias("b"))
    drawn = (F.col("b") + F.lit(prior * share)) / (F.col("rows") + F.lit(prior))
    table = store(counts.select("part", "label", drawn.alias("code"), "rows"))
    return {n: table.where(F.col("part") == n).drop("part") for n in names}, share, whole["n"]


def _with_statistics(rows: DataFrame, tables: dict[str, DataFrame], share: float, total: int) -> DataFrame:
    """The share of blocked URLs of each part; that of all for a value that was not seen."""
    for name, table in tables.items():
        rows = lookup(rows, name, table, f"{name}_share", total)
    return rows.withColumns({f"{n}_share": F.coalesce(f"{n}_share", F.lit(share)) for n in tables})


def _fit(train: DataFrame, features: Sequence[str], params: UrlParams) -> GBTClassificationModel:
    """Trees over the bounded sample, which lies in one partition, in order: equal rows give equal trees."""
    sample = None
    for verdict in (0.0, 1.0):
        some = train.where(F.col("blocked") == verdict).orderBy("hash", *features).limit(params.sampled)
        sample = some if sample is None else sample.unionByName(some)
    sample = store(sample.select("hash", "blocked", *features).coalesce(1).sortWithinPartitions("hash", *features))
    enable_checkpoints(train.sparkSession)
    trees = GBTClassifier(
        featuresCol="features",
        labelCol="blocked",
        maxIter=params.rounds,
        maxDepth=params.depth,
        stepSize=params.rate,
        seed=params.seed,
        checkpointInterval=10,
    )
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return trees.fit(assembler.transform(sample.coalesce(1)).select("blocked", "features"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    params: UrlParams | None = None,
    column: str = "url",
    learn: Column | None = None,
) -> tuple[DataFrame, str]:
    """The input with a struct ``host, path, rule, verdict, score``, and the struct's name.

    ``score`` is the trees' probability of ``block``; it is given for URLs with a rule as well.
    ``learn`` tells which of those to learn from, all of them by default.
    """
    params = params or UrlParams()
    name = fresh(pages, "_url")
    url = F.col(column).cast("string")
    learned = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    read = pages.select(F.struct(*pages.columns).alias("given"), url.alias("url"), learned.alias("learn"))
    read = read.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    by_verdict = {r.name: r.verdict for r in rules}
    ruled = read.withColumn("rule", rule_of(host, path, rules))
    told = F.lit(None).cast("string")
    for rule, verdict in by_verdict.items():
        told = F.when(F.col("rule") == rule, verdict).otherwise(told)
    lexical = lexical_features(F.col("url"), host, path)
    split = parts(host, path)
    rows = ruled.select("given", "url", "learn", "host", "path", "rule", told.alias("told"))
    made = [*[f.alias(n) for n, f in lexical.items()], *[p.alias(n) for n, p in split.items()]]

    hashed = F.xxhash64("url", F.lit(params.seed)).alias("hash")
    labelled = rows.where("learn AND told IS NOT NULL").select(
        (F.col("told") == BLOCK).cast("double").alias("blocked"), hashed, *made
    )
    labelled = store(labelled)
    tables, share, total = _statistics(labelled.where("hash % 2 = 0"), list(split), params.prior)
    counts = {r["blocked"]: r["count"] for r in labelled.where("hash % 2 <> 0").groupBy("blocked").count().collect()}
    features = [*lexical, *[f"{n}_share" for n in split]]
    if len(counts) == 2:
        train = _with_statistics(labelled.where("hash % 2 <> 0"), tables, share, total)
        model = _fit(train, features, params)
        full = _with_statistics(rows.select("*", *made), tables, share, total)
        assembled = VectorAssembler(inputCols=features, outputCol="features").transform(full)
        scored = model.transform(assembled).withColumn("score", vector_to_array("probability")[1])
    else:
        # One verdict or none among the labels: nothing to learn.
        known = labelled.agg(F.max("blocked").alias("b")).first()["b"]
        scored = rows.withColumn("score", F.lit(float(known or 0.0)))
    judged = F.when(F.col("score") > 0.5, BLOCK).otherwise(ALLOW)
    out = F.struct("host", "path", "rule", F.coalesce("told", judged).alias("verdict"), "score").alias(name)
    return scored.select("given.*", out), name
