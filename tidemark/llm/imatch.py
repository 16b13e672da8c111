"""Document fingerprints in the manner of I-Match: hashes of a document's telling terms.

Terms that very many or very few documents have say little about a text, so only those whose
document frequency lies in a band count. The sorted distinct terms are hashed once as a whole
and once for each of several random parts of the lexicon; the parts are of different sizes, so
that short and long texts both have some that an edit leaves alone.

Terms are lower-cased words, each by a hash of 64 bits. Document frequencies are counted for every
term; the terms of the band go to each task, as a sorted table that is cut by the hashes' top bits.
Documents without a term in the band use all their terms.

* Null text counts as empty: its fingerprint is that of no terms. Equal texts have equal fingerprints.
* Likeness is the share of equal hashes among those that stand for terms in either of two
  fingerprints; 1 if they are the same and 0 if they differ and have no such part.
* Repeated rows and ids are kept as they are; among equal ids the order is by a hash of the
  text. Null ids come first. A single document is its own next one; an empty table gives an empty result.
* Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import const_array, let, text_of, words

_EMPTY = "-"


@dataclass(frozen=True)
class IMatchParams:
    """The band is a share of documents: idf from ``-ln(max_share)`` to ``-ln(min_share)``.

    A document has few distinct terms on average, so at most that average divided by
    ``min_share`` terms can be in the band, however large the corpus. ``bits``: length of the
    table that tells most other terms at once; results do not depend on it.
    """

    min_share: float = 0.002
    max_share: float = 0.1
    bits: int = 20
    parts_per_size: int = 4
    # A part of size s has one in 2 ** s of the lexicon's terms.
    sizes: tuple[int, ...] = (4, 5, 6, 7, 8, 9, 10)


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    return F.array_distinct(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, params: IMatchParams) -> list[int]:
    """The terms in the band, from document frequencies of all terms over all documents."""
    terms = docs.select(F.explode(term_hashes(text_of())).alias("term"))
    total = docs.count()
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    band = counts.where(F.col("n").between(params.min_share * total, params.max_share * total))
    return sorted(r["term"] for r in band.select("term").collect())


def _place(term: Column, bits: int) -> Column:
    """The top bits of a hash, in the order of signed numbers."""
    return F.shiftright(term, 64 - bits) + (1 << (bits - 1))


def band_table(band: list[int], params: IMatchParams) -> Column:
    """The band as a struct of constants: a bit per place, the first of each place's terms, all terms."""
    bits = params.bits
    places = [(t >> (64 - bits)) + (1 << (bits - 1)) for t in band]
    packed = [0] * (1 << max(0, bits - 6))
    for p in places:
        packed[p >> 6] |= 1 << (p & 63)
    # Places of the second table: about as many as there are terms.
    wide = min(bits, max(1, len(band).bit_length()))
    starts, at = [], 0
    for p in range(1 << wide):
        starts.append(at)
        while at < len(band) and places[at] >> (bits - wide) == p:
            at += 1
    return F.struct(
        const_array([w - (1 << 64) if w >> 63 else w for w in packed], "bigint").alias("bits"),
        const_array([*starts, len(band)], "int").alias("starts"),
        (const_array(band, "bigint") if band else F.array().cast("array<bigint>")).alias("terms"),
        F.lit(wide).alias("wide"),
    )


def _in_band(term: Column, table: Column, params: IMatchParams) -> Column:
    place = _place(term, params.bits)
    low = F.call_function("shiftright", place, params.bits - table["wide"]).cast("int")
    first = table["starts"][low]

    def found(at: Column) -> Column:
        return F.exists(F.slice(table["terms"], at["first"] + 1, at["n"]), lambda t: t == term)

    near = F.struct(first.alias("first"), (table["starts"][low + 1] - first).alias("n"))
    seen = F.getbit(table["bits"][F.shiftright(place, 6).cast("int")], place.bitwiseAND(F.lit(63)).cast("int")) == 1
    return F.when(seen, let(near, found)).otherwise(F.lit(False))


def _parts(params: IMatchParams) -> list[tuple[int, int]]:
    """Mask and value: a term is in the part if its hash under the mask has the value."""
    return [((1 << s) - 1, i % (1 << s)) for s in params.sizes for i in range(params.parts_per_size)]


def fingerprint(text: Column, table: Column, params: IMatchParams) -> Column:
    """An array of hashes in hexadecimal: all terms, then one per part; ``-`` for none."""

    def chosen(d: Column) -> Column:
        known = F.filter(d["terms"], lambda t: _in_band(t, d["table"], params))
        return let(known, lambda k: F.when(F.size(k) > 0, k).otherwise(d["terms"]))

    terms = let(F.struct(term_hashes(text).alias("terms"), table.alias("table")), chosen)

    def hashes(t: Column) -> Column:
        def of(part: Column) -> Column:
            return F.when(F.size(part) > 0, F.lower(F.hex(F.xxhash64(part)))).otherwise(_EMPTY)

        def inside(mask: int, value: int) -> Column:
            return let(F.filter(t, lambda h: h.bitwiseAND(F.lit(mask)) == value), of)

        return F.array(of(t), *[inside(m, v) for m, v in _parts(params)])

    return let(F.array_sort(F.transform(terms, lambda t: F.xxhash64(t))), hashes)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among those that are there on either side."""

    def of(pairs: Column) -> Column:
        used = F.filter(pairs, lambda p: (p["a"] != _EMPTY) | (p["b"] != _EMPTY))
        same = F.filter(used, lambda p: p["a"] == p["b"])
        return F.when(F.size(used) > 0, F.size(same) / F.size(used)).otherwise((a == b).cast("double"))

    return let(F.arrays_zip(a.alias("a"), b.alias("b")), of)


def _split_ids(ids: DataFrame, rows_per_bucket: int) -> list[int]:
    """Ids that cut the table into ranges of about the same number of rows; each is in it."""
    low, rows = ids.agg(F.min("_id"), F.count("_id")).first()
    n = min(32_768, max(256, rows // rows_per_bucket))
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = ids.agg(F.percentile_approx("_id", shares, F.lit(max(10_000, 10 * n))).alias("ids")).first()["ids"]
    return sorted({i for i in cuts or [] if i > low})


def _range_of(value: Column, splits: list[int]) -> Column:
    """The number of splits up to ``value``: first that of whole blocks of splits, then inside one."""
    if not splits:
        return F.lit(0)
    block = max(1, math.isqrt(len(splits)))
    last = const_array(splits[block - 1 :: block], "bigint") if len(splits) >= block else F.array()

    def count(d: Column) -> Column:
        whole = F.size(F.filter(d["last"], lambda x: x <= value))

        def more(w: Column) -> Column:
            return w * block + F.size(F.filter(F.slice(d["all"], w * block + 1, block), lambda x: x <= value))

        return let(whole, more)

    inside = let(F.struct(last.alias("last"), const_array(splits, "bigint").alias("all")), count)
    return F.coalesce(F.when(value.isNotNull(), inside), F.lit(0))


def with_next(docs: DataFrame, rows_per_bucket: int = 4_000) -> DataFrame:
    """Rows ``_bucket, _turn, _id, _tie, _text``: ranges of ids, each followed by the next one's first row.

    Rows with ``_turn`` over 0 are such guests; a window over a bucket in the order of
    ``_turn, _id, _tie`` then sees every document's successor, and texts are shuffled once. The
    table's first row is the last bucket's guest.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("_id"), text_of().alias("_text"))
    splits = _split_ids(slim.select("_id"), rows_per_bucket)
    slim = slim.withColumn("_tie", F.xxhash64("_text"))
    here = slim.withColumn("_range", _range_of(F.col("_id"), splits))
    own = F.struct(F.col("_range").alias("_bucket"), F.lit(0).alias("_turn"))
    guest = F.struct((F.col("_range") - 1).alias("_bucket"), F.lit(1).alias("_turn"))
    if splits:
        opens = F.col("_id") == F.get(const_array(splits, "bigint"), F.col("_range") - 1)
        places = F.when(opens, F.array(own, guest)).otherwise(F.array(own))
    else:
        places = F.array(own)
    out = here.select("_id", "_tie", "_text", F.explode_outer(places).alias("_p")).select(
        "_id", "_tie", "_text", "_p._bucket", "_p._turn"
    )
    lowest = slim.select("_id").orderBy(F.col("_id").asc_nulls_first()).limit(1).collect()
    if not lowest:
        return out
    first = slim.where(F.col("_id").eqNullSafe(F.lit(lowest[0]["_id"]).cast("bigint"))).orderBy("_tie").limit(1)
    last = first.select("_id", "_tie", "_text", F.lit(len(splits)).alias("_bucket"), F.lit(2).alias("_turn"))
    return out.unionByName(last)


def fingerprint_edits(docs: DataFrame, params: IMatchParams | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how much they are alike.

    The edited text ends with the first quarter of the next document's, by ascending id, in
    place of its own last quarter.
    """
    params = params or IMatchParams()
    table = band_table(lexicon(docs, params), params)
    order = Window.partitionBy("_bucket").orderBy("_turn", F.col("_id").asc_nulls_first(), "_tie")
    rows = with_next(docs).withColumn("_next", F.lead("_text").over(order))
    n = F.length("_text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(
        F.substr("_text", F.lit(1), n - cut), F.substr(F.coalesce("_next", F.lit("")), F.lit(1), cut)
    )
    place = ("_bucket", "_turn", "_id", "_tie")
    rows = rows.select(*place, "_text", n.cast("bigint").alias("n_chars"), edited.alias("_edited"))
    rows = rows.select(
        *place,
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint(F.col("_text"), table, params).alias("_print"),
        F.when(F.col("_turn") == 0, fingerprint(F.col("_edited"), table, params)).alias("_edited_print"),
    )
    rows = rows.withColumn("_next_print", F.lead("_print").over(order)).where("_turn = 0")
    return rows.select(
        F.col("_id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.array_join("_print", " ").alias("fingerprint"),
        F.array_join("_edited_print", " ").alias("edited_fingerprint"),
        likeness(F.col("_print"), F.col("_edited_print")).alias("near_edited"),
        likeness(F.col("_print"), F.col("_next_print")).alias("near_next"),
    )
