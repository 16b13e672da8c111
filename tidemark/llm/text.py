"""Column helpers the text operators share: words, matches with positions, bounded lookups."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space of all contracts: the ASCII characters 9 to 13 and 32.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SPANS = "array<struct<start:bigint,stop:bigint,match:string,left:string>>"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    """The text column, a null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z; all other characters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The runs of other characters between white space, in order; none for an empty text."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACE, "")).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def const_array(values: Iterable[object], element: str) -> Column:
    """A constant array that Spark folds into one literal; for lists of a bounded length."""
    return F.split(F.lit(",".join(str(v) for v in values)), ",").cast(f"array<{element}>")


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Of an array, ``op`` over each element and all before it; ``op`` must be associative.

    Reaches twice as far back in every step, so n elements take n log n operations.
    """

    def step(acc: Column, bit: Column) -> Column:
        reach = F.call_function("shiftleft", F.lit(1), bit)
        return F.transform(acc, lambda x, i: F.when(i >= reach, op(acc[i - reach], x)).otherwise(x))

    bits = F.length(F.bin(F.size(values).cast("bigint")))
    return F.aggregate(F.sequence(F.lit(0), bits - 1), values, step)


def find_all(text: Column, pattern: str, when: Column | None = None, left: int = 0) -> Column:
    """Leftmost non-overlapping matches with their places in code points.

    Places come from the lengths of the matches and of the pieces between them, which the
    same pattern cuts, so a text with n matches takes n log n steps. ``when`` is a cheap test
    that a text can match at all. ``left`` keeps so many characters before a match, as far as
    the match before it.
    """

    def place(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            lengths = F.transform(found, lambda m, i: (F.length(gaps[i]) + F.length(m)).cast("bigint"))

            def spans(stops: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    return F.struct(
                        (stops[i] - F.length(m)).alias("start"),
                        stops[i].alias("stop"),
                        m.alias("match"),
                        F.right(gaps[i], F.lit(left)).alias("left"),
                    )

                return F.transform(found, one)

            return let(let(lengths, lambda n: scan(n, lambda a, b: a + b)), spans)

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), with_gaps)).otherwise(F.array().cast(SPANS))

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)
    return spans if when is None else F.when(when, spans).otherwise(F.array().cast(SPANS))


def uncovered(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``, in their order; none of either is empty.

    Both lists are merged by their starts: the furthest end of the others before a span and the
    nearest start after it tell.
    """

    def merge(d: Column) -> Column:
        theirs = F.transform(
            d["others"], lambda s: F.struct(s["start"].alias("start"), F.lit(-1).alias("at"), s["stop"].alias("stop"))
        )
        own = F.transform(
            d["spans"], lambda s, i: F.struct(s["start"].alias("start"), i.alias("at"), s["stop"].alias("stop"))
        )

        def free(merged: Column) -> Column:
            ends = F.transform(merged, lambda e: F.when(e["at"] < 0, e["stop"]).otherwise(0))
            starts = F.transform(F.reverse(merged), lambda e: F.when(e["at"] < 0, e["start"]).otherwise(2**62))

            def among(near: Column) -> Column:
                def place(e: Column, i: Column) -> Column:
                    clear = (near["before"][i] <= e["start"]) & (near["after"][F.size(merged) - 1 - i] >= e["stop"])
                    return F.when((e["at"] >= 0) & clear, e["at"])

                places = F.array_sort(F.filter(F.transform(merged, place), lambda at: at.isNotNull()))
                return F.transform(places, lambda at: d["spans"][at])

            return let(F.struct(scan(ends, F.greatest).alias("before"), scan(starts, F.least).alias("after")), among)

        none = (F.size(d["spans"]) == 0) | (F.size(d["others"]) == 0)
        return F.when(none, d["spans"]).otherwise(let(F.array_sort(F.concat(theirs, own)), free))

    # Bound once: what is asked for each element must not be worked out for each.
    return let(F.struct(spans.alias("spans"), others.alias("others")), merge)


# Code points of a block: how far a slice of a long text has to be counted.
_BLOCK = 8192


def slices(text: Column, spans: Column) -> Column:
    """The pieces of a text at ``start`` to ``stop`` (code points, the end exclusive), an empty one as ''.

    A text is counted through from its front for each place that is asked of it, so long ones
    are cut into blocks once.
    """

    def cut(d: Column) -> Column:
        def block(b: Column) -> Column:
            return d["text"].substr(b * _BLOCK + 1, F.lit(_BLOCK))

        def within(blocks: Column) -> Column:
            def piece(s: Column) -> Column:
                def part(b: Column) -> Column:
                    low = F.greatest(s["start"].cast("int") - b * _BLOCK, F.lit(0))
                    high = F.least(s["stop"].cast("int") - b * _BLOCK, F.lit(_BLOCK))
                    return blocks[b].substr(low + 1, high - low)

                first, last = (F.floor(at / _BLOCK).cast("int") for at in (s["start"], s["stop"] - 1))
                joined = F.array_join(F.transform(F.sequence(first, last), part), "")
                return F.when(s["stop"] > s["start"], joined).otherwise("")

            return F.transform(d["spans"], piece)

        count = F.floor(F.length(d["text"]) / _BLOCK).cast("int")
        return let(F.transform(F.sequence(F.lit(0), count), block), within)

    return let(F.struct(text.alias("text"), spans.alias("spans")), cut)
