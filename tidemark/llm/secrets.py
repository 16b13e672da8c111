"""Secrets: spans by pattern, and a verdict from who owns copies of the same value.

A value is hashed and counted over the whole corpus by distinct owners and repositories. One
that several owners hold is a copied ``example``; one held by a single owner that also looks
random is ``live``; the rest is ``shared``. Base spans (assign, access, hex) always stay; looser
candidates (bearer, vendor, jwt, mixed) are added when they look random and are no example.

A repository belongs to its owner, and copies in several of one owner's repositories are still
that owner's secret: their number is reported with each span but has no part in the verdict.

* Null text counts as empty and has no spans. A null owner or repository is one more name.
* Very long texts are searched whole. Equal spans of different patterns are all reported.
* Repeated rows are counted as rows and add no owner. An empty table gives an empty result.
* Only the text, owner, repository and kept columns are read; others may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import find_all, let, scan, slices, text_of, uncovered
from tidemark.operators.sizing import store

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
# A run that is long enough from its start on; a shorter run fails as a whole in the plain pattern too.
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"

BEARER = r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}+=*"
VENDOR = r"(?<![A-Za-z0-9])(?:ghp|gho|ghs|glpat|xox[abp]|sk|pk|rk|hf|npm)[_-][A-Za-z0-9_-]{16,}+"
JWT = r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"
MIXED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+"

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "bearer", "vendor", "jwt", "mixed")

# Words of placeholders; a value that holds one is no credential.
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|0000000|1234567|abcdefg"


@dataclass(frozen=True)
class SecretParams:
    """``example_owners``: from how many owners on a value is a copied example.

    ``hot_share``: values with more than this share of all candidates, of which there are at
    most its inverse, get their counts by broadcast, so that none is one key of a join.
    """

    example_owners: int = 3
    min_distinct: int = 10
    hot_share: float = 0.001


def _spans(text: Column) -> dict[str, Column]:
    def long_value(s: Column) -> Column:
        return F.length(F.regexp_extract(s["match"], ASSIGN_VALUE, 1)) >= 12

    def mixed(s: Column) -> Column:
        m = s["match"]
        return m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")

    return {
        "assign": F.filter(find_all(text, ASSIGN, text.rlike("[:=]")), long_value),
        "access": find_all(text, ACCESS, F.contains(text, F.lit("AKIA"))),
        "hex": find_all(text, HEX),
        "bearer": find_all(text, BEARER, text.rlike("[Bb][Ee][Aa][Rr][Ee][Rr]\x20")),
        "vendor": find_all(text, VENDOR),
        "jwt": find_all(text, JWT, F.contains(text, F.lit("eyJ"))),
        "mixed": F.filter(find_all(text, MIXED), mixed),
    }


def _candidates(spans: dict[str, Column], params: SecretParams) -> Column:
    def of(kind: str) -> Column:
        def one(s: Column) -> Column:
            value = F.regexp_extract(s["match"], ASSIGN_VALUE, 1) if kind == "assign" else s["match"]
            if kind == "bearer":
                value = F.regexp_replace(value, r"^[A-Za-z]+\x20+", "")
            varied = F.size(F.array_distinct(F.split(value, ""))) >= params.min_distinct
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                s["start"].alias("start"),
                s["stop"].alias("stop"),
                F.xxhash64(value).alias("value"),
                (varied & ~value.rlike(PLACEHOLDER)).alias("random"),
            )

        return F.transform(spans[kind], one)

    return F.concat(*[of(kind) for kind in KINDS])


def ownership(candidates: DataFrame) -> DataFrame:
    """``value, n_rows, n_owners, n_repositories`` from rows of ``value, owner, repository``.

    A repository belongs to its owner. Each step adds up in the tasks first, so a value in a
    third of all rows leaves a task as one row per owner and repository.
    """
    repositories = candidates.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = repositories.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("r"))
    return owners.groupBy("value").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_owners"), F.sum("r").alias("n_repositories")
    )


def _with_counts(rows: DataFrame, params: SecretParams) -> DataFrame:
    """``rows`` with the counts of their ``value``."""
    counted = store(ownership(rows))
    total = counted.agg(F.sum("n_rows").alias("n")).first()["n"] or 0
    hot = counted.where(F.col("n_rows") > params.hot_share * total)
    cold = counted.where(F.col("n_rows") <= params.hot_share * total)
    frequent = rows.join(F.broadcast(hot), "value")
    # Broadcast as well: at most 1 / hot_share values.
    rest = rows.join(F.broadcast(hot.select("value")), "value", "left_anti").join(cold, "value")
    return frequent.unionByName(rest)


def _search(
    docs: DataFrame, keep: Sequence[str], owner: Column | None, repository: Column | None, params: SecretParams
) -> DataFrame:
    """``_keep_0.., owner, repository, _all``: the kept columns and all candidates."""
    owner = F.col("source") if owner is None else owner
    repository = F.col("lang") if repository is None else repository
    searched = docs.select(
        *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)],
        owner.cast("string").alias("owner"),
        repository.cast("string").alias("repository"),
        text_of().alias("_t"),
    )
    spans = _spans(F.col("_t"))
    found = searched.select("*", *[spans[k].alias(f"_{k}") for k in KINDS])
    found = found.withColumn("_all", _candidates({k: F.col(f"_{k}") for k in KINDS}, params))
    return found.drop("_t", *[f"_{k}" for k in KINDS])


def _numbered(found: DataFrame) -> DataFrame:
    return store(found.withColumn("_row", F.monotonically_increasing_id()))


def _judge(found: DataFrame, params: SecretParams) -> DataFrame:
    """``_row, spans`` of the rows that have candidates."""
    hits = found.where(F.size("_all") > 0)
    one = hits.select("_row", "owner", "repository", F.explode_outer("_all").alias("_c"))
    one = one.select("_row", "owner", "repository", "_c.*")
    verdict = (
        F.when(F.col("n_owners") >= params.example_owners, "example")
        .when((F.col("n_owners") == 1) & F.col("random"), "live")
        .otherwise("shared")
    )
    span = F.struct(
        "start",
        "kind",
        "stop",
        (F.col("kind") < len(BASE)).alias("base"),
        verdict.alias("verdict"),
        "n_owners",
        "n_repositories",
        "random",
    )

    def decide(spans: Column) -> Column:
        base = F.filter(spans, lambda s: s["base"])
        added = F.filter(spans, lambda s: ~s["base"] & s["random"] & (s["verdict"] != "example"))
        kept = F.array_sort(F.concat(base, uncovered(added, base)))
        return F.transform(kept, lambda s: s.dropFields("random"))

    judged = _with_counts(one, params).select("_row", span.alias("_s"))
    # One row per document that has candidates; its list is as long as they are many.
    listed = judged.groupBy("_row").agg(F.array_sort(F.collect_list("_s")).alias("_spans"))
    return listed.select("_row", let(F.col("_spans"), decide).alias("spans"))


def scan_secrets(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    owner: Column | None = None,
    repository: Column | None = None,
    params: SecretParams | None = None,
) -> DataFrame:
    """Per row: the columns of ``keep`` and ``spans``, by start, then kind.

    A span has ``start, kind, stop, base, verdict, n_owners, n_repositories``; places are in
    code points, the end exclusive. Texts are read once; what is found goes to a table. Rows
    without candidates are not shuffled.
    """
    params = params or SecretParams()
    found = _numbered(_search(docs, keep, owner, repository, params))
    spans = _judge(found, params)
    out = [F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)]
    hits = found.where(F.size("_all") > 0).join(spans, "_row").select(*out, "spans")
    empty = F.array().cast(spans.schema["spans"].dataType)
    return found.where(F.size("_all") == 0).select(*out, empty.alias("spans")).unionByName(hits)


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, a hash of the base spans, all spans as text, counts per verdict."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def named(spans: Column) -> Column:
        return F.array_join(
            F.transform(
                spans,
                lambda s: F.concat_ws(
                    ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")
                ),
            ),
            ",",
        )

    def count(field: str, value: object) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("bigint")

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[count("kind", i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(named(base), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
        *[count("verdict", v).alias(f"n_{v}") for v in ("live", "shared", "example")],
    )


def redact_secrets(
    docs: DataFrame,
    mark: str = "[SECRET]",
    owner: Column | None = None,
    repository: Column | None = None,
    params: SecretParams | None = None,
) -> DataFrame:
    """The same rows and columns; in texts every span is replaced by ``mark``, overlaps by one.

    ``n_chars``, where there is such a column, follows the text. Only rows with candidates are
    stored and shuffled; the others pass as they are, in a second search of the texts.
    """
    params = params or SecretParams()
    columns = docs.columns
    searched = _search(docs, columns, owner, repository, params)
    found = _numbered(searched.where(F.size("_all") > 0))
    names = {c: f"_keep_{i}" for i, c in enumerate(columns)}
    plain = [F.col(k).alias(c) for c, k in names.items()]

    def cut(d: Column) -> Column:
        """The pieces outside of all spans, each followed by a mark."""

        def between(ends: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                before = F.when(i > 0, ends[i - 1]).otherwise(0)
                return F.struct(before.alias("start"), s["start"].alias("stop"))

            gaps = F.filter(F.transform(d["spans"], piece), lambda g: g["stop"] >= g["start"])
            last = F.struct(ends[F.size(ends) - 1].alias("start"), F.length(d["text"]).cast("bigint").alias("stop"))
            return F.array_join(slices(d["text"], F.concat(gaps, F.array(last))), mark)

        return let(scan(F.transform(d["spans"], lambda s: s["stop"]), F.greatest), between)

    hits = found.join(_judge(found, params), "_row")
    changed = F.size("spans") > 0
    hits = hits.withColumn("_cut", F.when(changed, let(F.struct(F.col(names["text"]).alias("text"), "spans"), cut)))
    new = {"text": F.when(changed, F.col("_cut")).otherwise(F.col(names["text"]))}
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length("_cut").cast(kind)).otherwise(F.col(names["n_chars"]))
    cleaned = hits.select(*[new.get(c, F.col(k)).alias(c) for c, k in names.items()])
    return searched.where(F.size("_all") == 0).select(*plain).unionByName(cleaned)
