"""Similarity join on word n-grams: documents whose sets of shingles have a high Jaccard index.

The index is a tree over count vectors. A document's distinct shingles are hashed into groups,
and its vector has the number of shingles per group. The overlap of two documents is at most the
sum of the smaller counts, and for a box of vectors at most the sum of the smaller of a query's
counts and the box's upper corner: boxes and vectors below the needed overlap are left out, the
rest is compared exactly.

A tree over all vectors would have to be searched as a whole by every document, so its top level
is a directory that two similar documents always share an entry of: documents of about one size
have their shingles dealt into more blocks than a similar document can differ in, so at least
one block is the same in both. An entry is the content of one block; entries with one document
go, and under each of the others stands a tree.

1. Sets, vectors and blocks of every document (whole texts); equal sets become one class.
2. Directory entries with at least two classes. An entry's leader is the class that most entries
   hold; copies of one text share more with it than with each other. Each class is first compared
   with the leader it shares most entries with, and links found that way are closed to components.
3. Of entries whose classes are not all in one component: classes outside of a large component are
   each searched for in the tree of its members, once per component and not once per entry, until
   one link is found; a class's text goes to as many tasks as the component has cuts.
4. Pairs of classes that are both outside of large components, and in different ones, are searched
   by the trees of the entries they share. Pairs that pass are compared; components are closed again.

* Null and empty texts have no shingle and no link. A text of fewer words than a shingle is one
  shingle, its whole sequence. Very long texts are processed whole.
* Equal sets, so also repeated rows, are one class and are in one group.
* A null id is kept; it takes part and names a group only if the group has no other id.
* An empty table gives an empty result. Columns of the input may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.components import components
from tidemark.llm.text import fresh
from tidemark.operators.sizing import broadcast_if_small, store

_M = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class JaccardParams:
    """``percent``: least similarity. ``groups``: least length of a count vector.

    ``growth``: sizes of one directory level span this factor. ``chunk``: most classes one task
    takes of an entry at a time; larger ones are cut and all pairs of cuts done. ``shingles``: most
    shingles of the classes of one cut, which bounds a task's memory. ``compared``: about how many
    texts are compared with one in a group. ``large``: from how many classes on a component is
    searched as one. ``spare``: one block more for so many that may differ; with more of them a
    similar class shares more entries, and fewer others share as many.
    """

    words: int = 5
    percent: int = 80
    groups: int = 64
    growth: float = 1.4
    chunk: int = 2048
    shingles: int = 1 << 21
    compared: int = 64
    large: int = 16
    spare: int = 8


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``k`` words, A-Z in lower case."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = min(k, len(tokens))
    out = np.full(len(tokens) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out + hashes[i : len(tokens) - n + 1 + i])
    return np.unique(out)


def _levels(size: int, params: JaccardParams) -> list[tuple[int, int]]:
    """The directory levels of a set: number and upper bound of sizes.

    A set also enters each higher level in which a similar larger one can be.
    """
    low, number = 1, 0
    while True:
        high = max(low + 1, int(low * params.growth))
        if size < high:
            break
        low, number = high, number + 1
    out = [(number, high)]
    while size * 100 >= params.percent * high:
        high, number = max(high + 1, int(high * params.growth)), number + 1
        out.append((number, high))
    return out


def block_keys(shingles: np.ndarray, params: JaccardParams) -> tuple[np.ndarray, int]:
    """Directory entries of a set, one per block of each of its levels, and how many a similar set shares.

    Sets of a level differ in at most ``most`` shingles if they are similar, and there are more
    blocks than that, some to spare: as many are the same in both, but for those that are empty
    in both. Empty blocks are no entry, unless a set has more of them than the spare ones: two sets
    could then agree in empty blocks only.
    """
    keys, least = [], []
    for level, high in _levels(len(shingles), params):
        most = 2 * (high - 1) * (100 - params.percent) // (100 + params.percent)
        spare = 1 + most // params.spare
        blocks = most + 1 + spare if most else 1
        block = (shingles % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        place, first = np.unique(block[order], return_index=True)
        content = np.add.reduceat(_mix(shingles[order] + np.uint64(1)), first)
        name = _mix(place.astype(np.uint64) + np.uint64(level) * np.uint64(1 << 32))
        keys.append(_mix(content ^ name))
        if blocks - len(place) > spare:
            empty = np.setdiff1d(np.arange(blocks), place).astype(np.uint64)
            keys.append(_mix(_mix(empty + np.uint64(level) * np.uint64(1 << 32))))
        least.append(max(1, len(place) - most))
    return (np.concatenate(keys), min(least)) if keys else (np.empty(0, np.uint64), 1)


# A count this large is not kept; it stands for any number, so that a bound stays one.
_FULL, _ANY = 255, 1 << 24


def groups_for(size: int, params: JaccardParams) -> int:
    """Length of a set's vector: a power of two with about four shingles to a group.

    With fewer groups the vectors of unrelated long texts are too much alike to tell apart.
    """
    groups = params.groups
    while groups * 4 < size and groups < 1 << 16:
        groups *= 2
    return groups


def count_vector(shingles: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount(((shingles >> np.uint64(40)) % np.uint64(groups)).astype(np.int64), minlength=groups)


def _pack(counts: np.ndarray) -> bytes:
    return np.minimum(counts, _FULL).astype(np.uint8).tobytes()


def _unpack(vectors: list[bytes]) -> np.ndarray:
    """Vectors as rows of one length: groups of longer ones are added up to those of the shortest."""
    length = min(map(len, vectors))
    out = np.empty((len(vectors), length), np.int64)
    for i, vector in enumerate(vectors):
        counts = np.frombuffer(vector, np.uint8).astype(np.int64)
        counts[counts == _FULL] = _ANY
        out[i] = counts.reshape(-1, length).sum(axis=0)
    return out


class CountTree:
    """A packed R-tree over count vectors: leaves of near points, boxes by their upper corners."""

    FAN = 16

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        self.order = self._tiles(counts, np.arange(len(sizes)))
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        # Levels from the points up: upper corner and least size of each box.
        self.levels = [(self.counts, self.sizes)]
        while len(self.levels[-1][1]) > self.FAN:
            corner, least = self.levels[-1]
            cuts = np.arange(0, len(least), self.FAN)
            self.levels.append((np.maximum.reduceat(corner, cuts), np.minimum.reduceat(least, cuts)))

    def _tiles(self, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Points in the order of leaves: halves along the widest coordinate, again and again."""
        if len(rows) <= self.FAN:
            return rows
        spread = counts[rows].max(axis=0) - counts[rows].min(axis=0)
        by = rows[np.argsort(counts[rows, spread.argmax()], kind="stable")]
        half = (len(by) // 2 + self.FAN - 1) // self.FAN * self.FAN
        return np.concatenate([self._tiles(counts, by[:half]), self._tiles(counts, by[half:])])

    def search(self, counts: np.ndarray, size: int) -> np.ndarray:
        """Numbers of all points that can be similar to the query."""
        boxes = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[depth]
            bound = np.minimum(corner[boxes], counts).sum(axis=1)
            boxes = boxes[(100 + self.percent) * bound >= self.percent * (size + least[boxes])]
            if depth:
                below = (boxes[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                boxes = below[below < len(self.levels[depth - 1][1])]
        return self.order[boxes]


# Rounds in which classes without enough shared entries are left out.
PRUNED = 2

_SKETCH = "n long, h1 long, h2 long, vector binary"


def sketch(docs: DataFrame, params: JaccardParams) -> tuple[DataFrame, dict[str, str]]:
    """The input with a row number, set size, set hash and vector, as a table; the added names."""
    names = {c: fresh(docs, f"_{c}") for c in ("row", "n", "h1", "h2", "vector")}
    numbered = docs.withColumn(names["row"], F.monotonically_increasing_id())
    added = [T.StructField(names[f.name], f.dataType) for f in T._parse_datatype_string(_SKETCH).fields]
    schema = T.StructType([*numbered.schema.fields, *added])
    at = numbered.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, vectors = [], [], [], []
            for text in batch.column(at):
                value = text.as_py()
                s = shingle_set(value.encode() if value else None, params.words)
                sizes.append(len(s))
                first.append(int(_mix(s + np.uint64(11)).sum() & _M))
                second.append(int(_mix(s + np.uint64(29)).sum() & _M))
                vectors.append(_pack(count_vector(s, groups_for(len(s), params))))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(first, np.uint64).view(np.int64)),
                    pa.array(np.array(second, np.uint64).view(np.int64)),
                    pa.array(vectors, pa.binary()),
                ],
                names=schema.names,
            )

    return store(numbered.mapInArrow(run, schema)), names


def _among(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join on a row number; the numbers are broadcast if their measured size allows it.

    The rows hold texts, which then need no shuffle to be picked.
    """
    sent = broadcast_if_small(keys)
    return rows.join(keys if sent is None else sent, key, how)


def _entries(texts: DataFrame, params: JaccardParams) -> DataFrame:
    """``key, id, need`` of the directory entries that at least two classes share.

    ``texts`` has one document of each class; ``need`` is how many entries a similar class shares.
    Entries are sorted inside the partitions and passed through one by one: what is held is one
    batch, however many classes share an entry.
    """

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            found = [block_keys(shingle_set(t.as_py().encode(), params.words), params) for t in batch.column(1)]
            counts = [len(k) for k, _ in found]
            keys = np.concatenate([k for k, _ in found]).view(np.int64) if found else np.empty(0, np.int64)
            needs = np.repeat(np.array([n for _, n in found], np.int32), counts)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(ids, counts)), pa.array(needs)], _ENTRY)

    keyed = texts.select("id", "text").mapInArrow(keys_of, "key long, id long, need int")
    dealt = keyed.repartition("key").sortWithinPartitions("key", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row waits for the next one, which tells whether its entry has company.
        held, before = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if table.num_rows < 2:
                held = table if table.num_rows else held
                continue
            key = table.column("key").to_numpy()
            same = key[1:] == key[:-1]
            shared = same | np.concatenate([[key[0] == before], same[:-1]])
            yield from table.slice(0, len(key) - 1).filter(pa.array(shared)).to_batches()
            held, before = table.slice(len(key) - 1), key[-2]
        if held is not None and held.column("key")[0].as_py() == before:
            yield from held.to_batches()

    return _pruned(store(dealt.mapInArrow(run, "key long, id long, need int")))


_ENTRY = ["key", "id", "need"]


def _pruned(entries: DataFrame) -> DataFrame:
    """Without classes that share fewer entries than a similar class would, and entries left with one class.

    Classes that have a passage in common and little else go here, however many they are. Each
    round leaves fewer companions to the classes that stay.
    """
    for _ in range(PRUNED):
        shared = entries.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.min("need").alias("least"))
        kept = store(shared.where("c >= least").select("id"))
        rest = _among(entries, kept, "id", "left_semi")
        company = rest.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
        entries = store(rest.join(company, "key", "left_semi").select(*_ENTRY))
    return entries


def _compare(pairs: DataFrame, texts: DataFrame, params: JaccardParams) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar, found from the texts.

    Pairs are grouped by ``a``, about ``compared`` of them in one group; its text comes
    first, and those to compare with it pass by one at a time.
    """
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    salted = store(
        pairs.join(store(many), "a").select(
            "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / params.compared)).cast("int").alias("salt")
        )
    )
    used = store(salted.select(F.col("a").alias("id")).unionByName(salted.select(F.col("b").alias("id"))).distinct())
    texts = _among(texts, used, "id", "left_semi")
    none = F.lit(None).cast("bigint")
    left = salted.select("a", "salt").distinct().join(texts, F.col("a") == F.col("id")).select(
        "a", "salt", none.alias("b"), "text"
    )
    right = salted.join(texts, F.col("b") == F.col("id")).select("a", "salt", "b", "text")
    dealt = left.unionByName(right).repartition("a", "salt")
    dealt = dealt.sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for a, b, text in zip(
                batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True
            ):
                shingles = shingle_set(text.as_py().encode(), params.words)
                if b is None:
                    base = shingles
                    continue
                if _similar(base, shingles, params.percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"]
            )

    return store(dealt.mapInArrow(run, "a long, b long"))


def _possible(a: DataFrame, params: JaccardParams) -> DataFrame:
    """Of rows ``a, b, va, na, vb, nb``, those whose vectors allow enough overlap."""
    percent = params.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            total = batch.column(3).to_numpy() + batch.column(5).to_numpy()
            bound = [
                _unpack([a, b]).min(axis=0).sum()
                for a, b in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)
            ]
            good = (100 + percent) * np.array(bound) >= percent * total
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(good)) for c in (batch.column(0), batch.column(1))], names=["a", "b"]
            )

    return a.mapInArrow(run, "a long, b long")


def _first_pairs(entries: DataFrame, points: DataFrame, params: JaccardParams) -> DataFrame:
    """Each class with the leader it shares most entries with, if their vectors allow a link."""
    held = entries.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    rated = entries.join(held, "id").groupBy("key").agg(F.max(F.struct("n", (-F.col("id")).alias("l"))).alias("m"))
    leaders = store(rated.select("key", (-F.col("m.l")).alias("leader")))
    shared = entries.join(leaders, "key").where("id <> leader").groupBy("id", "leader").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("id").agg(F.max(F.struct("n", (-F.col("leader")).alias("l"))).alias("m"))
    pairs = store(best.select((-F.col("m.l")).alias("a"), F.col("id").alias("b")))
    left = points.select(F.col("id").alias("a"), F.col("vector").alias("va"), F.col("n").alias("na"))
    right = points.select(F.col("id").alias("b"), F.col("vector").alias("vb"), F.col("n").alias("nb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "va", "na", "vb", "nb")
    return store(_possible(both, params))


def _cuts(classes: Column, shingles: Column, params: JaccardParams) -> Column:
    by_size = F.greatest(F.ceil(classes / params.chunk), F.ceil(shingles / params.shingles))
    return by_size.cast("int").alias("cuts")


def _open_rows(entries: DataFrame, labels: DataFrame, points: DataFrame, params: JaccardParams) -> DataFrame:
    """``key, id, n, component, cuts`` of entries with more than one component.

    ``cuts`` are those of the row's component if it is large, else null.
    """
    named = points.select("id", "n").join(labels.select("id", "component"), "id", "left")
    named = store(named.select("id", "n", F.coalesce("component", "id").alias("component")))
    per = named.groupBy("component").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("all"))
    large = per.where(F.col("classes") >= params.large).select(
        "component", _cuts(F.col("classes"), F.col("all"), params)
    )
    rows = entries.join(named.join(large, "component", "left"), "id")
    rows = store(rows.select("key", "id", "need", "n", "component", "cuts"))
    spread = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    # Tables, so that an entry that very many share is a key Spark can split.
    return store(rows.join(store(spread.where("low < high").select("key")), "key"))


def _outside_links(rows: DataFrame, labels: DataFrame, texts: DataFrame, params: JaccardParams) -> DataFrame:
    """Links ``a, b`` of classes to large components they are outside of, one per component and cut.

    A class is held against a component if they share an entry; of two large components the one
    of the higher number is held against the other.
    """
    present = rows.where("cuts IS NOT NULL").select("key", F.col("component").alias("c"), F.col("cuts").alias("k"))
    met = rows.join(store(present.distinct()), "key").where("component <> c AND (cuts IS NULL OR component > c)")
    # A member that is similar shares that many entries with the class, so the component does.
    shared = met.groupBy("id", "c", "k").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("least"))
    outside = store(shared.where("n >= least").select("id", "c", "k"))
    cut = F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("cut")
    homes = store(outside.select("c", "k").distinct())
    members = labels.join(homes, labels["component"] == homes["c"]).select("c", cut, F.lit(0).alias("asks"), "id")
    cuts = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("cut")
    asking = outside.select("c", cuts, F.lit(1).alias("asks"), "id")
    placed = store(members.unionByName(asking))
    some = _among(texts, store(placed.select("id").distinct()), "id", "left_semi")
    dealt = placed.join(some, "id").select("c", "cut", "asks", "id", "text").repartition("c", "cut")
    dealt = dealt.sortWithinPartitions("c", "cut", "asks", "id")
    percent = params.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets, tree, counts = None, [], [], None, None
        for batch in batches:
            found = []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for c, cut, asks, id_, text in zip(*columns, batch.column(4), strict=True):
                if at != (c, cut):
                    at, ids, sets, tree, counts = (c, cut), [], [], None, None
                shingles = shingle_set(text.as_py().encode(), params.words)
                if not asks:
                    ids.append(id_), sets.append(shingles)
                    continue
                if not sets:
                    continue
                if tree is None:
                    groups = _fine_groups(max(map(len, sets)))
                    counts = np.stack([count_vector(s, groups) for s in sets]).astype(np.int32)
                    tree = CountTree(counts, np.array([len(s) for s in sets]), percent)
                mine = count_vector(shingles, counts.shape[1]).astype(np.int32)
                near = tree.search(mine, len(shingles))
                bound = np.minimum(counts[near], mine).sum(axis=1)
                for i in near[np.argsort(-bound, kind="stable")]:
                    if _similar(sets[i], shingles, percent):
                        found.append((ids[i], id_))
                        break
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"]
            )

    return store(dealt.mapInArrow(run, "a long, b long"))


def _fine_groups(size: int) -> int:
    """Length of vectors that are made where the sets are: few shingles meet in a group."""
    groups = 64
    while groups < 2 * size and groups < 1 << 16:
        groups *= 2
    return groups


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _tree_pairs(rows: DataFrame, labels: DataFrame, points: DataFrame, params: JaccardParams) -> DataFrame:
    """Pairs of classes of different components that a tree search under some entry lets pass.

    ``rows`` are those of classes outside of large components. An entry with more classes or
    shingles than a cut is cut, and every two cuts meet in a task of their own.
    """
    labelled = rows.select("key", "id", "need", "n").join(labels.select("id", "component"), "id", "left")
    labelled = store(labelled.select("key", "id", "need", "n", F.coalesce("component", "id").alias("component")))
    spread = labelled.groupBy("key").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.count(F.lit(1)).alias("classes"),
        F.sum("n").alias("all"),
    )
    open_ = spread.where("low < high").select("key", _cuts(F.col("classes"), F.col("all"), params))
    open_ = store(open_)
    if open_.isEmpty():
        return labelled.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    joined = labelled.drop("n").join(open_, "key")
    cut = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    others = F.sequence(F.lit(0), F.col("cuts") - 1)
    placed = joined.select("key", "id", "need", "component", cut.alias("cut"), F.explode(others).alias("other"))
    placed = placed.select(
        "key", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), "cut", "id", "need", "component"
    )
    groups = placed.join(points.select("id", "n", "vector"), "id").select(
        "key", "i", "j", "cut", "id", "need", "component", "n", "vector"
    )

    names = ["key", "i", "j"]
    dealt = groups.repartition(*names).sortWithinPartitions(*names)
    percent = params.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of one group follow each other; the last group of a batch waits for the next one.
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            marks = [held.column(name).to_numpy() for name in names]
            new = np.ones(held.num_rows, bool)
            new[1:] = np.any([m[1:] != m[:-1] for m in marks], axis=0)
            starts = np.flatnonzero(new)
            if len(starts) > 1:
                yield _pairs_of_groups(held.slice(0, starts[-1]), starts, percent)
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield _pairs_of_groups(held, np.array([0, held.num_rows]), percent)

    # A pair comes once from each entry it shares, unless some tree can tell that it is none.
    found = dealt.mapInArrow(run, "a long, b long, need int").groupBy("a", "b")
    counted = found.agg(F.count(F.lit(1)).alias("c"), F.min("need").alias("least"))
    return store(counted.where("c >= least").select("a", "b"))


def _pairs_of_groups(table: pa.Table, starts: np.ndarray, percent: int) -> pa.RecordBatch:
    """Pairs ``a, b`` that the tree of each group lets pass, and the entries they need to share.

    The groups begin at ``starts``, whose last place ends them.
    """
    ids, labels, sizes, cuts, i, j, needs = (
        table.column(name).to_numpy() for name in ("id", "component", "n", "cut", "i", "j", "need")
    )
    vectors = table.column("vector").to_pylist()
    out_a, out_b, out_need = [], [], []
    for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if high - low < 2:
            continue
        counts = _unpack(vectors[low:high])
        points = np.flatnonzero(cuts[low:high] == i[low])
        queries = np.flatnonzero(cuts[low:high] == j[low])
        if not len(points) or not len(queries):
            continue
        mine, of, size = ids[low:high], labels[low:high], sizes[low:high]
        tree = CountTree(counts[points], size[points], percent)
        for q in queries:
            near = points[tree.search(counts[q], size[q])]
            near = near[(of[near] != of[q]) & ((mine[near] < mine[q]) | (i[low] != j[low]))]
            if len(near):
                out_a.append(mine[near]), out_b.append(np.full(len(near), mine[q]))
                # The larger of two bounds, each of which holds.
                out_need.append(np.maximum(needs[low:high][near], needs[low + q]))
    a, b, need = (
        np.concatenate(out) if out else np.empty(0, np.int64) for out in (out_a, out_b, out_need)
    )
    columns = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "need"])


def jaccard_groups(docs: DataFrame, params: JaccardParams | None = None) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """The input as a table with row number and set size, and ``row, group, group_id, first``.

    ``group`` numbers the component of a row's class, ``group_id`` is the least ``doc_id`` in it
    and ``first`` marks one row of the group. Rows without a shingle are their own group.
    """
    params = params or JaccardParams()
    table, c = sketch(docs, params)
    slim = table.select(*[F.col(c[name]).alias(name) for name in ("row", "n", "h1", "h2")], "doc_id")
    lonely = slim.where("n = 0").select(
        "row", F.col("row").alias("group"), F.col("doc_id").alias("group_id"), F.lit(True).alias("first")
    )
    # One row per set; copies of one text are summed up in the tasks first.
    classes = slim.where("n > 0").groupBy("h1", "h2", "n")
    classes = store(classes.agg(F.min("row").alias("id"), F.min("doc_id").alias("least")))
    copies = slim.where("n > 0").join(classes, ["h1", "h2", "n"]).where("row <> id").select(F.col("row").alias("id"))
    copies = store(copies)
    filled = table.where(F.col(c["n"]) > 0)
    texts = filled.select(F.col(c["row"]).alias("id"), "text")
    vectors = filled.select(F.col(c["row"]).alias("id"), *[F.col(c[name]).alias(name) for name in ("n", "vector")])
    vectors = store(_among(vectors, copies, "id", "left_anti"))
    entries = _entries(_among(texts, copies, "id", "left_anti"), params)
    links = _compare(_first_pairs(entries, vectors, params), texts, params)
    labels = store(components(links))
    rows = _open_rows(entries, labels, vectors, params)
    near = _outside_links(rows, labels, texts, params)
    if not near.isEmpty():
        links = links.unionByName(near)
        labels = store(components(links))
    more = _tree_pairs(rows.where("cuts IS NULL"), labels, vectors, params)
    if not more.isEmpty():
        links = links.unionByName(_compare(more, texts, params))
        labels = store(components(links))
    grouped = classes.join(labels, "id", "left").select(
        "h1", "h2", "n", "id", "least", F.coalesce("component", "id").alias("group")
    )
    grouped = store(grouped)
    least = store(grouped.groupBy("group").agg(F.min("least").alias("group_id")))
    named = store(grouped.join(least, "group").select("h1", "h2", "n", "group", "group_id"))
    linked = slim.where("n > 0").join(named, ["h1", "h2", "n"]).select(
        "row", "group", "group_id", (F.col("row") == F.col("group")).alias("first")
    )
    return table, lonely.unionByName(linked), c


def jaccard_digest(docs: DataFrame, params: JaccardParams) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    table, groups, c = jaccard_groups(docs.select("doc_id", "text"), params)
    mine = table.select("doc_id", F.col(c["row"]).alias("row"), F.col(c["n"]).alias("n_shingles"))
    return mine.join(groups, "row").select("doc_id", "n_shingles", F.col("group_id").alias("component_id"))


def keep_one(docs: DataFrame, params: JaccardParams | None = None) -> DataFrame:
    """The input's rows and columns, of each group of similar documents one row."""
    table, groups, c = jaccard_groups(docs, params)
    dropped = store(groups.where(~F.col("first")).select(F.col("row").alias(c["row"])))
    return _among(table, dropped, c["row"], "left_anti").select(*docs.columns)
