"""Mix sources to target weights by min-cost flow over membership patterns.

A document may belong to several sources. Documents with the same set of sources form a
pattern, and only the patterns' word counts enter the flow: each pattern gives its words once
for nothing, a second time at a cost and a third time at a higher one, to any of its sources, up
to each source's target. Documents are then chosen by a seeded hash: every document of a pattern
is taken as often as all of them fit. The words that remain go to documents once more each, in the
order of their hashes. A few documents of every length are held back from that order, and the
subset of them whose words come nearest to what is missing, below or above, is added.

* Words are runs of other characters between ASCII white space; a null text has none.
* A null source is a source of its own, the last; a document without any source belongs to it.
* Rows equal in id and text have the same hash and are taken together. A document without words
  is taken with its pattern's whole rounds but adds nothing. Reruns agree.
* An empty table gives an empty result. Columns of the input may have any name.

Patterns and sources are what a mixture is declared over, so their number does not follow that
of the documents; their word counts are all that the driver gets.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import fresh, text_of, words
from tidemark.operators.sizing import BROADCAST_BYTES, broadcast_if_small, store

# Word counts of a pattern that one task sorts.
LEVEL_COUNTS = 1 << 16
# Documents of a pattern that are held back, of each length class; four classes to a power of two.
HELD, CLASSES = 4, 4
# Words of subset sums are counted in units, of which held documents have at most so many.
UNITS = 1 << 20


@dataclass(frozen=True)
class MixParams:
    """``weights`` repeat over the sources in code-point order; ``costs`` are those of each round."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    costs: tuple[int, ...] = (0, 1, 3)
    seed: int = 17


def targets(sizes: list[int], weights: list[float], rounds: int, total: int | None = None) -> list[float]:
    """``total`` (all sizes) shared out by weight, none more than ``rounds`` times a size; the rest goes to the others."""
    out, whole = [0.0] * len(sizes), float(sum(sizes) if total is None else total)
    open_ = set(range(len(sizes)))
    while open_:
        share = (whole - sum(out[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_)
        full = {i for i in open_ if share * weights[i] > rounds * sizes[i]}
        for i in full or open_:
            out[i] = float(rounds * sizes[i]) if full else share * weights[i]
        open_ -= full or open_
    return out


class _Flow:
    """Min-cost flow by shortest augmenting paths over a small graph, costs never negative at first."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = []  # to, room, cost; an edge's reverse is its neighbour
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: int, cost: int) -> int:
        self.out[a].append(len(self.edges))
        self.out[b].append(len(self.edges) + 1)
        self.edges += [[b, room, cost], [a, 0, -cost]]
        return len(self.edges) - 2

    def run(self, source: int, sink: int) -> None:
        height = [0] * len(self.out)
        while True:
            far: list[float] = [math.inf] * len(self.out)
            came = [-1] * len(self.out)
            far[source], queue = 0, [(0, source)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    b, room, cost = self.edges[e]
                    step = d + cost + height[a] - height[b]
                    if room and step < far[b]:
                        far[b], came[b] = step, e
                        heapq.heappush(queue, (step, b))
            if far[sink] == math.inf:
                return
            height = [h + (f if f < math.inf else far[sink]) for h, f in zip(height, far, strict=True)]
            path, b = [], sink
            while b != source:
                path.append(came[b])
                b = self.edges[came[b] ^ 1][0]
            room = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= room
                self.edges[e ^ 1][1] += room


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], costs: tuple[int, ...]) -> list[int]:
    """Words each pattern gives in all, for patterns of ``(sources, words)`` and a quota per source.

    Patterns that share no source, directly or through others, are solved apart.
    """
    parent = list(range(len(quotas)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for members, _ in patterns:
        for m in members:
            parent[root(m)] = root(members[0])
    parts: dict[int, list[int]] = {}
    for p, (members, _) in enumerate(patterns):
        parts.setdefault(root(members[0]), []).append(p)
    given = [0] * len(patterns)
    for part in parts.values():
        used = sorted({m for p in part for m in patterns[p][0]})
        place = {m: 2 + len(part) + i for i, m in enumerate(used)}
        flow = _Flow(2 + len(part) + len(used))
        rounds = {}
        for i, p in enumerate(part):
            members, size = patterns[p]
            rounds[p] = [flow.add(0, 2 + i, size, cost) for cost in costs]
            for m in members:
                flow.add(2 + i, place[m], len(costs) * size, 0)
        for m in used:
            flow.add(place[m], 1, quotas[m], 0)
        flow.run(0, 1)
        for p in part:
            given[p] = sum(flow.edges[e + 1][1] for e in rounds[p])
    return given


def _joined(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Join with a table that is broadcast if its measured size allows it."""
    sent = broadcast_if_small(small)
    return rows.join(small if sent is None else sent, key)


def nearest_subset(sizes: Sequence[int], low: int, high: int) -> list[int]:
    """Indexes of a subset whose total is between ``low`` and ``high``, or as near to that as any.

    Nothing where that is good; else the least total inside. Reachable totals are the bits of one
    number. Above ``UNITS`` words in all, totals are rounded to that many units.
    """
    if low <= 0:
        return []
    unit = max(1, -(-sum(sizes) // UNITS))
    counts = [round(n / unit) for n in sizes]
    reach = [1]
    for n in counts:
        reach.append(reach[-1] | reach[-1] << n)
    low, high = -(-low // unit), max(high // unit, -(-low // unit))
    above = reach[-1] >> low
    up = low + (above & -above).bit_length() - 1 if above else None
    down = (reach[-1] & ((1 << low) - 1)).bit_length() - 1
    total = up if up is not None and (up <= high or up - high < low - down) else down
    chosen = []
    for i in range(len(counts), 0, -1):
        if not reach[i - 1] >> total & 1:
            chosen.append(i - 1)
            total -= counts[i - 1]
    return chosen[::-1]


def _held_back(sized: DataFrame, wanted: dict[str, int]) -> tuple[dict[str, dict[int, int]], dict[str, int]]:
    """Per pattern: words of the documents held back, by hash, and of all others that can be taken.

    Held back are, of each length class, those of the smallest hashes, as far as they are no
    longer than twice the wanted words. Rows of equal hashes count as one document.
    """
    spark = sized.sparkSession
    rest = F.broadcast(spark.createDataFrame(list(wanted.items()), "pattern string, rest long").coalesce(1))
    open_ = sized.select("pattern", "hash", "size").join(rest, "pattern").where("size > 0 AND size <= 2 * rest")
    kind = F.floor(F.log2(F.col("size").cast("double")) * CLASSES)
    order = Window.partitionBy("pattern", "kind").orderBy("hash")
    # Only the first of each class leave a task.
    first = open_.withColumn("kind", kind).withColumn("place", F.row_number().over(order)).where(F.col("place") <= HELD)
    held: dict[str, set[int]] = {p: set() for p in wanted}
    for r in first.select("pattern", "hash").distinct().collect():
        held[r["pattern"]].add(r["hash"])
    table = [(p, sorted(hashes)) for p, hashes in held.items()]
    kept = F.broadcast(spark.createDataFrame(table, "pattern string, held array<long>").coalesce(1))
    mine = F.when(F.array_contains("held", F.col("hash")), F.col("hash"))
    sums = open_.join(kept, "pattern").where(mine.isNotNull() | (F.col("size") <= F.col("rest")))
    words_: dict[str, dict[int, int]] = {p: {} for p in wanted}
    others = dict.fromkeys(wanted, 0)
    for r in sums.groupBy("pattern", mine.alias("mine")).agg(F.sum("size").alias("n")).collect():
        if r["mine"] is None:
            others[r["pattern"]] = r["n"]
        else:
            words_[r["pattern"]][r["mine"]] = r["n"]
    return words_, others


def _cuts(
    sized: DataFrame, wanted: dict[str, tuple[int, list[int]]], most: int
) -> tuple[dict[str, int], dict[str, int]]:
    """Per pattern the hash of the first document that does not fit, and the words of those before it.

    ``wanted`` has the words and the hashes that are left out; documents of more words are passed
    over. The place is found by word counts per range of hashes. No pattern has more than ``most``
    documents; where these are more than a level's counts, places are found 16 bits at a time, and
    what remains to be sorted of a pattern is one document in four billion. A pattern whose
    documents all fit has no such hash.
    """
    levels = (0,) if most <= LEVEL_COUNTS else (48, 32, 0)
    cuts: dict[str, int] = {}
    before = dict.fromkeys(wanted, 0)
    # ``low`` is the words before the range that is looked at.
    places = [(p, rest, held, 0, None) for p, (rest, held) in wanted.items()]
    for bits in levels:
        schema = "pattern string, rest long, held array<long>, low long, inside long"
        table = sized.sparkSession.createDataFrame(places, schema).coalesce(1)
        if sum(len(p[0].encode()) + 96 + 8 * len(p[2]) for p in places) <= BROADCAST_BYTES:
            table = F.broadcast(table)
        rows = sized.select("pattern", "hash", "size").join(table, "pattern")
        rows = rows.where("size > 0 AND size <= rest").where(~F.array_contains("held", F.col("hash")))
        if bits != levels[0]:
            rows = rows.where(F.shiftright("hash", above) == F.col("inside"))
        counts = rows.groupBy("pattern", F.shiftright("hash", bits).alias("part")).agg(
            F.sum("size").alias("n"), *[F.first(c).alias(c) for c in ("rest", "low")]
        )
        upto = Window.partitionBy("pattern").orderBy("part")
        counts = counts.withColumn("end", F.col("low") + F.sum("n").over(upto))
        # The first range that goes beyond the wanted words.
        over = F.when(F.col("end") > F.col("rest"), F.struct("part", (F.col("end") - F.col("n")).alias("low")))
        found = counts.groupBy("pattern").agg(F.min(over).alias("m"), F.max("end").alias("all")).collect()
        places = []
        for r in found:
            rest, held = wanted[r["pattern"]]
            before[r["pattern"]] = r["all"] if r["m"] is None else r["m"]["low"]
            if r["m"] is not None:
                cuts[r["pattern"]] = r["m"]["part"]
                places.append((r["pattern"], rest, held, r["m"]["low"], r["m"]["part"]))
        above = bits
        if not places:
            break
    return cuts, before


@dataclass(frozen=True)
class _Choice:
    """What to take once more: hashes before ``before`` of at most ``most`` words but for ``held``, and ``added``."""

    before: int | None
    most: int
    held: list[int]
    added: list[int]


def _choose(sized: DataFrame, wanted: dict[str, int], most: int) -> dict[str, _Choice]:
    """Per pattern, documents whose words come near to the wanted ones; five passes at most."""
    if not wanted:
        return {}
    words_, others = _held_back(sized, wanted)
    taken: dict[str, list[int]] = {}
    left: dict[str, tuple[int, list[int]]] = {}
    for p, rest in wanted.items():
        hashes = sorted(words_[p])
        # Those without which all others are too few, such as one document longer than all of them.
        chosen = nearest_subset([words_[p][h] for h in hashes], rest - others[p], rest)
        taken[p] = [hashes[i] for i in chosen]
        left[p] = (max(0, rest - sum(words_[p][h] for h in taken[p])), hashes)
    cuts, before = _cuts(sized, left, most)
    out = {}
    for p, (rest, hashes) in left.items():
        free = sorted(set(hashes) - set(taken[p]))
        short = rest - before[p]
        more = nearest_subset([words_[p][h] for h in free], short, short)
        out[p] = _Choice(cuts.get(p), rest, hashes, taken[p] + [free[i] for i in more])
    return out


def plan_mix(docs: DataFrame, sources: Column | None = None, params: MixParams | None = None):
    """Three tables: ``pattern, base, choice``; ``source, source_size, target``; the sized documents.

    A document of a pattern is taken ``base`` times, once more if it is in the ``choice``.
    The sized documents have ``doc_id, pattern, members, size, hash``.
    """
    params = params or MixParams()
    spark = docs.sparkSession
    sized = store(docs.select("doc_id", *_keys(sources, params)))
    totals = sized.groupBy("pattern", "members").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    totals.sort(key=lambda r: r["pattern"])
    names = sorted({m for r in totals for m in r["members"] if m is not None}, key=lambda s: s.encode())
    names += [None] if any(None in r["members"] for r in totals) else []
    number = {m: i for i, m in enumerate(names)}
    patterns = [(tuple(sorted(number[m] for m in r["members"])), r["n"]) for r in totals]
    sizes = [sum(n for members, n in patterns if i in members) for i in range(len(names))]
    weights = [params.weights[i % len(params.weights)] for i in range(len(names))]
    rounds = len(params.costs)
    # All words are shared out once, whatever belongs to several sources.
    total = sum(n for _, n in patterns)
    wanted = targets(sizes, weights, rounds, total) if total else [0.0] * len(sizes)
    given = route(patterns, [round(t) for t in wanted], params.costs)
    bases, rest = {}, {}
    for row, (_, n), words_ in zip(totals, patterns, given, strict=True):
        base = words_ // n if n else 0
        bases[row["pattern"]] = base
        if n and words_ % n:
            rest[row["pattern"]] = words_ - base * n
    chosen = _choose(sized, rest, max((r["rows"] for r in totals), default=0))
    plan = [(p, base, astuple(chosen[p]) if p in chosen else None) for p, base in bases.items()]
    choice = "struct<before: long, most: long, held: array<long>, added: array<long>>"
    mixed = store(spark.createDataFrame(plan, f"pattern string, base long, choice {choice}"))
    shown = spark.createDataFrame(
        list(zip(names, sizes, wanted, strict=True)), "source string, source_size long, target double"
    )
    return mixed, shown, sized


def _keys(sources: Column | None, params: MixParams) -> list[Column]:
    """``members, pattern, size, hash`` of a document."""
    members = F.array(F.col("source").cast("string")) if sources is None else sources
    members = F.array_sort(F.array_distinct(members))
    members = F.when(F.size(members) > 0, members).otherwise(F.array(F.lit(None).cast("string")))
    return [
        members.alias("members"),
        F.to_json(F.struct(members.alias("m")), {"ignoreNullFields": "false"}).alias("pattern"),
        F.size(words(text_of())).cast("bigint").alias("size"),
        F.xxhash64("doc_id", text_of(), F.lit(params.seed)).alias("hash"),
    ]


def _copies() -> Column:
    hash_, choice = F.col("hash"), F.col("choice")
    early = F.coalesce(hash_ < choice["before"], F.lit(True)) & (F.col("size") <= choice["most"])
    within = F.array_contains(choice["added"], hash_) | (early & ~F.array_contains(choice["held"], hash_))
    # A document without words has no copy beyond its pattern's.
    once_more = choice.isNotNull() & (F.col("size") > 0) & within
    return F.col("base") + F.coalesce(once_more, F.lit(False)).cast("bigint")


def mix_digest(docs: DataFrame, params: MixParams | None = None) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes."""
    plan, shown, sized = plan_mix(docs, None, params)
    # A document's pattern is its one source here.
    one = F.to_json(F.struct(F.array("source").alias("m")), {"ignoreNullFields": "false"})
    named = shown.withColumn("pattern", one)
    return _joined(sized, store(plan.join(named, "pattern")), "pattern").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken")
    )


def mix(docs: DataFrame, sources: Column | None = None, params: MixParams | None = None) -> DataFrame:
    """The input's columns, each row as often as the mix takes it."""
    params = params or MixParams()
    plan, _, _ = plan_mix(docs, sources, params)
    columns = docs.columns
    whole = fresh(docs, "_mix_row")
    rows = docs.select(F.struct(*columns).alias(whole), *_keys(sources, params))
    counted = _joined(rows, plan, "pattern").withColumn("copies", _copies())
    times = F.array_repeat(F.lit(1), F.col("copies").cast("int"))
    each = counted.where("copies > 0").select(whole, F.explode_outer(times))
    return each.select(*[F.col(whole)[c].alias(c) for c in columns])
