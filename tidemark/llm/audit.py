"""Audit of filters that overlap: what each removes in every order, and its fair share.

Every document has the set of filters it fails, as the bits of one number. A coalition of
filters removes the documents that fail any of them, so a table of documents per set gives the
worth of all coalitions, per part of the corpus. The Hart-Mas-Colell potential of a coalition is

    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|,    P of the empty one is 0,

and the Shapley value of a filter is the potential of all filters less that of all but this one.
Potentials are kept times the factorial of the number of filters, which makes them whole numbers.
A filter's step in an order removes the difference of two coalitions.

* Null text counts as empty, a null part as the empty name. Very long texts are counted whole.
* A repeat is a text that occurs with a smaller id anywhere in the table. Rows of one id and one
  text do not repeat each other; a null id is smaller than none and no other is smaller than it.
* A document with several label rows has a mark if any of them has it; a null mark is none.
* An empty table has no part and gives an empty result. Of the input only the id, the text and the
  part are read, so other columns may have any name.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import let, text_of, words
from tidemark.operators.sizing import store

MARKS = ("good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails: too short, too uniform, too many capitals, symbols."""
    few = let(words(text), lambda w: 100 * F.size(F.array_distinct(w)) < 50 * F.size(w))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return {
        "A": F.size(words(text)) < 200,
        "B": few,
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failed_sets(
    docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], part: Column, repeats: bool = True
) -> DataFrame:
    """``part, good, toxic, mask, n``: documents by the set of filters they fail.

    Bit ``i`` is set for the ``i``-th of ``filters``, and with ``repeats`` the next one for a text that
    a smaller id has. Equal texts fail the same filters, so copies collapse in the tasks, before
    any shuffle, to a row per part and label, and no text leaves its task.
    """
    text = text_of()
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    # Two hashes of different seeds and the length stand for the text.
    hashes = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.length(text).alias("h3")]
    mask = sum(bits, F.lit(0)).alias("mask")
    slim = docs.select("doc_id", F.coalesce(part.cast("string"), F.lit("")).alias("part"), *hashes, mask)
    slim = slim.groupBy("doc_id", "part", "h1", "h2", "h3", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = labels.where("doc_id IS NOT NULL").groupBy("doc_id")
    marked = marked.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    slim = slim.join(marked, "doc_id", "left").withColumns({m: F.coalesce(m, F.lit(False)) for m in MARKS})
    if not repeats:
        return slim.groupBy("part", *MARKS, "mask").agg(F.sum("n").alias("n"))

    # Per text, part and marks: all rows, the least id and the rows that have it, the rows without an id.
    known = F.col("doc_id").isNotNull()
    copies = slim.groupBy("h1", "h2", "h3", "mask", "part", *MARKS).agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("least"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nameless"),
    )
    # A text has at most a row per part and marks here.
    whole = F.min("least").over(Window.partitionBy("h1", "h2", "h3"))
    at_least = F.when(F.col("least") == whole, F.col("first.n")).otherwise(0)
    kept = copies.select("*", (F.col("nameless") + at_least).alias("first_rows"))
    bit = 1 << len(filters)
    both = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("first_rows").alias("n")),
        F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("first_rows")).alias("n")),
    )
    each = kept.select("part", *MARKS, F.explode(both).alias("s")).select("part", *MARKS, "s.*")
    return each.where("n > 0").groupBy("part", *MARKS, "mask").agg(F.sum("n").alias("n"))


def _worth(sets: Column, field: str, k: int) -> Column:
    """Documents that each of the coalitions removes, by the number of the coalition."""

    def removed(s: Column) -> Column:
        def add(acc: Column, one: Column) -> Column:
            return acc + F.when(one["mask"].bitwiseAND(s) != 0, one[field]).otherwise(0)

        return F.aggregate(sets, F.lit(0).cast("bigint"), add)

    return F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), removed)


def _potential(worth: Column, k: int) -> Column:
    """The potential of every coalition, times ``k!``; coalitions come after all they contain."""
    scale = math.factorial(k)
    bits = F.array(*[F.lit(1 << i) for i in range(k)])

    def next_one(found: Column, s: Column) -> Column:
        def smaller(acc: Column, bit: Column) -> Column:
            return acc + F.when(s.bitwiseAND(bit) != 0, found[s - bit]).otherwise(0)

        below = F.aggregate(bits, F.lit(0).cast("bigint"), smaller)
        return F.concat(found, F.array(F.call_function("div", scale * worth[s] + below, F.bit_count(s))))

    none = F.array(F.lit(0).cast("bigint"))
    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << k) - 1)), none, next_one)


def coalitions(sets: DataFrame, names: Sequence[str]) -> DataFrame:
    """``part, total, worth, worth_good, worth_toxic, potential`` from ``failed_sets``.

    The arrays have a place per coalition, the bits of whose number are its filters.
    """
    k = len(names)
    marked = [F.sum(F.when(F.col(m), F.col("n")).otherwise(0)).alias(m) for m in MARKS]
    by_set = sets.groupBy("part", "mask").agg(F.sum("n").alias("n"), *marked)
    # At most a row per set of filters and part.
    per_part = by_set.groupBy("part").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("mask", "n", *MARKS)).alias("sets")
    )
    worth = per_part.select(
        "part",
        "total",
        _worth(F.col("sets"), "n", k).alias("worth"),
        *[_worth(F.col("sets"), m, k).alias(f"worth_{m}") for m in MARKS],
    )
    return store(worth.withColumn("potential", _potential(F.col("worth"), k)))


def filter_steps(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every step of every order of the filters, per part, from ``coalitions``.

    ``shapley`` is the sum of what the step's filter removes over all orders.
    """
    k = len(names)
    orders = [" ".join(map(str, o)) for o in itertools.permutations(1 << i for i in range(k))]
    listed = F.transform(F.split(F.lit(",".join(orders)), ","), lambda o: F.split(o, " ").cast("array<int>"))
    name_of = F.create_map(*itertools.chain(*[(F.lit(1 << i), F.lit(name)) for i, name in enumerate(names)]))
    rows = table.select("*", F.explode(listed).alias("order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))

    def coalition(length: Column) -> Column:
        return F.aggregate(F.slice("order", F.lit(1), length), F.lit(0), lambda acc, bit: acc + bit)

    rows = rows.withColumns({"before": coalition(F.col("step") - 1), "after": coalition(F.col("step"))})
    rows = rows.withColumn("bit", F.col("after") - F.col("before"))
    full = (1 << k) - 1

    def step(column: str) -> Column:
        return F.col(column)[F.col("after")] - F.col(column)[F.col("before")]

    worth, removed = F.col("worth"), step("worth")
    return rows.select(
        "part",
        F.array_join(F.transform("order", lambda bit: name_of[bit]), "").alias("filter_order"),
        "step",
        (F.col("total") - worth[F.col("after")]).alias("kept"),
        removed.alias("removed"),
        (worth[F.col("bit")] - removed).alias("redundant"),
        (worth[full] - worth[full - F.col("bit")]).alias("unique_fails"),
        step("worth_good").alias("good_lost"),
        step("worth_toxic").alias("toxic_lost"),
        (F.col("potential")[full] - F.col("potential")[full - F.col("bit")]).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters, repeats of a text last, per source."""
    filters = text_filters(text_of())
    names = [*filters, "E"]
    return filter_steps(coalitions(failed_sets(docs, labels, filters, F.col("source")), names), names)


def audit_sql() -> str:
    """The same rows counted one order at a time."""
    bits = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate("abcde"))
    return f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 200 AS a,
         100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e
  FROM texts LEFT JOIN marks USING (doc_id)),
sets AS (SELECT part, {bits} AS mask, count(*) AS n, count(*) FILTER (WHERE good) AS good,
                count(*) FILTER (WHERE toxic) AS toxic FROM fails GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(letter, bit)),
orders AS (SELECT '' AS filter_order, 0 AS mask
           UNION ALL
           SELECT filter_order || letter, mask + bit FROM orders, letters WHERE (mask & bit) = 0),
steps AS (SELECT o.filter_order, length(p.filter_order) AS step, p.mask AS before, bit
          FROM orders AS o JOIN orders AS p ON starts_with(o.filter_order, p.filter_order) AND length(p.filter_order) < 5
               JOIN letters ON letter = substr(o.filter_order, length(p.filter_order) + 1, 1)
          WHERE length(o.filter_order) = 5),
counted AS (
  SELECT part, filter_order, CAST(step + 1 AS INTEGER) AS step, bit,
         sum(CASE WHEN (mask & (before + bit)) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN (mask & before) <> 0 AND (mask & bit) <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM sets, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""
