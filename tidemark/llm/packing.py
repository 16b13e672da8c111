"""Packing by minimum bin slack: documents as token pieces, pieces into full sequences.

Only documents longer than a sequence are cut; all their pieces but the first are whole
sequences. What is left to pack are lengths, and only their histogram matters: for each
sequence the longest remaining piece goes in, and subset sums over the available lengths, kept
as the bits of one number, tell the fullest way to complete it. The same combination is
used as long as its lengths last, so there are at most as many combinations as lengths. Pieces
of one length are alike; they are numbered across the table and take their places by number.

* A null text counts as empty: its document is the end token alone. Null ids are kept.
* Very long texts are tokenized whole. Repeated rows are packed as often as they occur.
* An empty table gives an empty result. Columns of the input may have any name.
* Tokenizing runs in tasks on batches; a task's pieces are numbered by its partition, and the
  numbers are in a table before anything uses them, so a repeated task changes nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import fresh
from tidemark.llm.tokens import encoder
from tidemark.operators.sizing import broadcast_if_small, store


@dataclass(frozen=True)
class PackParams:
    """``tokenizer``: a vocabulary of byte-level BPE as ranks, by path. ``end``: the id after each document."""

    tokenizer: str
    capacity: int = 1024
    end: int = 2


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: the first takes what whole sequences leave."""
    first = total % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, total, capacity)]


def pieces(docs: DataFrame, params: PackParams, keep: Sequence[str] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep.., piece, start, length, ids_crc32, part, number`` and, if asked for, ``ids``, as a table.

    ``number`` counts the pieces of the same length in the same partition.
    """
    names = list(keep)
    added = "piece int, start long, length long, ids_crc32 long, part int, number long"
    fields = T._parse_datatype_string(added + (", ids binary" if with_ids else "")).fields
    source = docs.select(*names, F.col("text").cast("string").alias(fresh(docs, "_pack_text")))
    schema = T.StructType([*source.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(params.tokenizer)
        end = int(params.end).to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        seen = np.zeros(params.capacity + 1, np.int64)
        for batch in batches:
            rows, out, ids = [], [], []
            for i, text in enumerate(batch.column(len(names))):
                whole = encode(text.as_py()) + end
                for piece, (start, length) in enumerate(cut(len(whole) // 4, params.capacity)):
                    body = whole[4 * start : 4 * (start + length)]
                    rows.append(i)
                    out.append((piece, start, length, zlib.crc32(body), part, seen[length]))
                    seen[length] += 1
                    if with_ids:
                        ids.append(body)
            table = np.array(out, np.int64).reshape(-1, 6)
            columns = [pa.array(table[:, c]).cast(t) for c, t in enumerate(_arrow_types())]
            passed = [batch.column(c).take(pa.array(rows, pa.int64())) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*passed, *columns, *([pa.array(ids, pa.binary())] if with_ids else [])], names=schema.names
            )

    return store(source.mapInArrow(run, schema))


def _arrow_types() -> list[pa.DataType]:
    return [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def _fullest(room: int, counts: dict[int, int]) -> list[int]:
    """Lengths that together come nearest to ``room`` without passing it.

    Bit s of ``reach`` says that some of the pieces seen so far add up to s. Copies of a length
    go in as powers of two; walking back over the steps gives the pieces of the best sum.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Combinations as ``(sequences, pieces per length)``, each with the longest piece that was left."""
    counts = {length: n for length, n in counts.items() if n > 0}
    out = []
    while counts:
        first = max(counts)
        counts[first] -= 1
        inside = [first, *_fullest(capacity - first, {k: n for k, n in counts.items() if n and k <= capacity - first})]
        counts[first] += 1
        combination = {length: inside.count(length) for length in inside}
        times = min(counts[length] // n for length, n in combination.items())
        out.append((times, combination))
        for length, n in combination.items():
            counts[length] -= times * n
            if not counts[length]:
                del counts[length]
    return out


def _runs(combinations: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per length, rows of ``first number, first sequence, pieces per sequence, offset``."""
    used: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for times, combination in combinations:
        offset = 0
        for length in sorted(combination, reverse=True):
            n = combination[length]
            runs.setdefault(length, []).append((used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + times * n
            offset += n * length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in runs.items()}


def pack(cut_pieces: DataFrame, params: PackParams) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    The driver gets the histogram of lengths, at most one row per token of a sequence. Pieces
    get their numbers from counts per partition and length, and look up their place in a list
    of the combinations each length is in; that list is bounded by the square of the capacity.
    """
    counts = store(cut_pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = _runs(pack_lengths(histogram, params.capacity))
    # One row per partition and length: a window over counts, not over pieces.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    first = store(first)
    # Small next to the pieces, which then need no shuffle; measured, because it grows with the partitions.
    sent = broadcast_if_small(first)
    numbered = cut_pieces.join(first if sent is None else sent, ["length", "part"])
    numbered = numbered.withColumn("first", F.col("first") + F.col("number"))
    numbered = numbered.select(*[c for c in cut_pieces.columns if c not in ("part", "number")], "first")
    kept = numbered.drop("first")
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    at = numbered.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = batch.column(at).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                table = runs[int(length)]
                mine = table[np.searchsorted(table[:, 0], numbers[rows], side="right") - 1]
                place = numbers[rows] - mine[:, 0]
                sequence[rows] = mine[:, 1] + place // mine[:, 2]
                offset[rows] = mine[:, 3] + place % mine[:, 2] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names
            )

    return numbered.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed token ids, from pieces cut ``with_ids``; a sequence is at most one capacity."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_rows"))
    empty = F.lit(b"").cast("binary")
    return rows.select("sequence_id", F.aggregate("_rows.ids", empty, lambda acc, x: F.concat(acc, x)).alias("ids"))
