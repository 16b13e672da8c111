"""Alignment of two tokenizers: which tokens of one cover the same bytes as which of the other.

A space and the text are cut by a byte-level vocabulary (A, from ``tokenizers``) and by a piece
vocabulary with byte fallback (B, from ``sentencepiece``, which adds the space itself). The places
the libraries report, characters for A and the spans of the encoded message for B, are coarse
cuts: a token that ends inside a character, or a piece that stands for one byte of it, has no
place of its own there. Their ends are refined by the lengths of the tokens' decoded bytes. Segments
of ASCII characters need no more than those lengths, which are the spans there.

Where both vocabularies let no token run from a character on into a space, a text is the sequence
of its segments, each a space and what follows it, and these are encoded one by one; the segments
that a task has met before are not encoded again.

Bytes at which tokens of both end cut the text into groups. Every token of A in a group is linked
with every one of B in it; over the corpus, a pair of ids counts the documents that hold it linked.

* Null and empty texts have no tokens, and neither do those whose tokens do not join to the space
  and the text again (such as texts with the mark that pieces use for a space).
* The names of special tokens inside a text are plain text.
* Very long texts are cut whole. A row is a document, also if it repeats another one's id.
* An empty table gives an empty result. Of the input only the text and the columns named in
  ``keep`` are read, so others may have any name.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.text import text_of
from tidemark.operators.encode import lookup
from tidemark.operators.sizing import store

# Characters of text that are encoded in one call.
BATCH_CHARS = 1 << 20
# Links of a group, above which equal ids of it are counted before they are paired.
WIDE = 1 << 12
# Segments of at most so many characters are remembered, about as many of them as said.
SHORT, KNOWN = 48, 250_000
_SEGMENT = re.compile(r"(?<=[!-~])(?= [\s\S])")
# Pairs with more than this share of all are joined by broadcast; there are at most a million.
HOT_SHARE = 1e-6


@dataclass(frozen=True)
class AlignParams:
    """``first``: a tokenizer file of byte-level BPE. ``second``: a sentencepiece model."""

    first: str
    second: str


@dataclass(frozen=True)
class Alignment:
    """Ids of both vocabularies, the byte at which each token ends, and the common cuts."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    cuts: np.ndarray

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of the group of each token."""
        return np.searchsorted(self.cuts, self.a_ends), np.searchsorted(self.cuts, self.b_ends)


def byte_alphabet() -> dict[str, int]:
    """The characters a byte-level vocabulary writes bytes as: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def refine(begins: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The byte at which each token ends, from coarse spans in bytes and the sizes of decoded tokens.

    A token whose span is empty or overlaps the next one's shares a character with it; its end is
    counted on from the last one whose end is sure.
    """
    open_ = begins >= ends
    open_[:-1] |= begins[1:] < ends[:-1]
    if not open_.any():
        return ends
    total = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(open_, -1, np.arange(len(ends))))
    base = np.where(last < 0, 0, ends[last] - total[last])
    return np.where(open_, base + total, ends)


class Part(NamedTuple):
    """What a segment adds to its text: counts, the text of its groups, and one code per link.

    ``counts`` holds ``n_a, n_b, n_groups, n_links`` in one number, so that a text's are one sum.
    Links of wide groups come apart, as distinct codes and how often each occurs.
    """

    counts: int
    groups: bytes
    codes: bytes
    wide: tuple[np.ndarray, np.ndarray] | None


_FIELD = 48


def packed(n_a: int, n_b: int, n_groups: int, n_links: int) -> int:
    return n_a | n_b << _FIELD | n_groups << 2 * _FIELD | n_links << 3 * _FIELD


def unpacked(counts: int) -> tuple[int, int, int, int]:
    low = (1 << _FIELD) - 1
    return counts & low, counts >> _FIELD & low, counts >> 2 * _FIELD & low, counts >> 3 * _FIELD


class Aligner:
    """Both tokenizers, with the decoded bytes of every id."""

    def __init__(self, params: AlignParams):
        # Tasks take the cores already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(params.first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=params.second)
        alphabet, described = byte_alphabet(), json.loads(self.first.to_str())
        names = [self.first.id_to_token(i) or "" for i in range(self.first.get_vocab_size())]
        plain = {t["id"] for t in described["added_tokens"]}
        self.a_bytes = [t.encode() if i in plain else bytes(alphabet[c] for c in t) for i, t in enumerate(names)]
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.b_bytes = [self._decoded(i, piece) for i, piece in enumerate(pieces)]
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        self.width = len(pieces)
        # The byte-level pattern takes spaces only before what follows them, and no merge can make a
        # piece that is not in the vocabulary.
        by_word = described["pre_tokenizer"] or {}
        self.splits = (
            by_word.get("type") == "ByteLevel"
            and by_word.get("use_regex", False)
            and not by_word.get("add_prefix_space", False)
            and described["normalizer"] is None
            and not any(re.search("[^▁]▁", piece) for piece in pieces)
        )
        self._known: dict[str, Part | None] = {}
        self._older: dict[str, Part | None] = {}

    def _decoded(self, i: int, piece: str) -> bytes:
        if self.second.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    def align(self, texts: list[str]) -> Iterator[Alignment | None]:
        """One alignment per text, None for one without tokens."""
        for some in _bounded(texts):
            for text in some:
                kept, found = self._encoded([f" {text}"]) if text else ([], None)
                yield found if kept else None

    def _encoded(self, fulls: list[str]) -> tuple[list[int], Alignment | None]:
        """Which of the texts (each a space and more) have tokens, and the alignment of those, one after the other.

        They are encoded as one text, so each but the last must end as a segment does.
        """
        found = self._whole("".join(fulls))
        if found is not None:
            stops = np.cumsum(_byte_lengths(fulls))
            at = np.minimum(np.searchsorted(found.cuts, stops), len(found.cuts) - 1)
            if (found.cuts[at] == stops).all():
                return list(range(len(fulls))), found
        if len(fulls) == 1:
            return [], None
        # Some text does not come back from its tokens: look for it in either half.
        half = len(fulls) // 2
        (left, first), (right, second) = self._encoded(fulls[:half]), self._encoded(fulls[half:])
        kept = [*left, *(half + i for i in right)]
        if first is None or second is None:
            return kept, first or second
        by = sum(len(fulls[i].encode()) for i in left)
        places = [
            np.concatenate([getattr(first, n), getattr(second, n) + by]) for n in ("a_ends", "b_ends", "cuts")
        ]
        ids = [np.concatenate([getattr(first, n), getattr(second, n)]) for n in ("a", "b")]
        return kept, Alignment(*ids, *places)

    def _whole(self, full: str) -> Alignment | None:
        """The alignment of a space and a text, None if its tokens do not join to it."""
        raw = full.encode()
        first = self.first.encode(full, add_special_tokens=False)
        a, pieces = first.ids, []
        if full.isascii():
            b = self.second.encode(full[1:])
        else:
            message = self.second.encode(full[1:], return_type="proto")
            pieces = [(p.id, p.begin, p.end) for p in message.pieces]
            b = [p[0] for p in pieces]
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        if not pieces:
            # Every byte is a character: the lengths of decoded tokens are those of the spans.
            a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
            return Alignment(a, b, a_ends, b_ends, np.intersect1d(a_ends, b_ends, assume_unique=True))
        spans = np.fromiter(chain.from_iterable(first.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        # Characters to bytes.
        points = np.frombuffer(full.encode("utf-32-le"), np.uint32)
        widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        spans = np.concatenate([[0], np.cumsum(widths)])[spans]
        a_ends = refine(spans[:, 0], spans[:, 1], self.a_sizes[a])
        # The message counts bytes of the text, without the space.
        flat = np.array(pieces, np.int64) + 1
        flat[0, 1] = 0
        b_ends = refine(flat[:, 1], flat[:, 2], self.b_sizes[b])
        return Alignment(a, b, a_ends, b_ends, np.intersect1d(a_ends, b_ends, assume_unique=True))

    def segments(self, text: str) -> list[str]:
        """A space and the text, cut before each space between a visible ASCII character and another one."""
        return _SEGMENT.split(f" {text}") if self.splits else [f" {text}"]

    def parts(self, texts: list[str]) -> Iterator[list[Part] | None]:
        """The parts of each text, None for one without tokens."""
        for some in _bounded(texts):
            cut = [self.segments(t) if t else [] for t in some]
            # What was met since the last change of the two lists stays, the rest goes.
            if len(self._known) > KNOWN:
                self._known, self._older = {}, self._known
            known, older = self._known, self._older
            new = {}
            for s in set().union(*cut).difference(known):
                if s in older:
                    known[s] = older[s]
                else:
                    new[s] = None
            # The last segment of a text may end in any way; such are encoded alone.
            alone, plain, others = [], [], []
            for s in new:
                if not "!" <= s[-1] <= "~":
                    alone.append([s])
                elif s.isascii():
                    plain.append(s)
                else:
                    others.append(s)
            alone.extend([*_bounded(plain), *_bounded(others)])
            for batch in alone:
                new.update(self._made(batch))
            long = {s: new[s] for s in new if len(s) > SHORT}
            known.update((s, part) for s, part in new.items() if s not in long)
            for segments in cut:
                if long and not long.keys().isdisjoint(segments):
                    found = [known[s] if s in known else long[s] for s in segments]
                else:
                    found = [known[s] for s in segments]
                yield found if found and None not in found else None

    def _made(self, segments: list[str]) -> Iterator[tuple[str, Part]]:
        """The parts of those segments that have tokens, all worked out together."""
        kept, found = self._encoded(segments)
        if not kept:
            return
        n, m = len(kept), len(found.cuts)
        stops = np.cumsum(_byte_lengths([segments[i] for i in kept]))
        a_group, b_group = found.groups()
        of_group = np.searchsorted(stops, found.cuts)
        a_count, b_count = np.bincount(a_group, minlength=m), np.bincount(b_group, minlength=m)
        links = a_count * b_count
        sums = [np.bincount(of_group, c, n).astype(np.int64).tolist() for c in (a_count, b_count, np.ones(m), links)]

        # Every token of A with all of B in its group, unless the group is wide.
        wide = links > WIDE
        narrow = ~wide[a_group]
        first = (np.cumsum(b_count) - b_count)[a_group[narrow]]
        each = b_count[a_group[narrow]]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - first, each)
        codes = np.repeat(found.a[narrow], each) * self.width + found.b[at]
        code_stops = np.cumsum(np.bincount(of_group, np.where(wide, 0, links), n).astype(np.int64)) * 8
        raw = codes.tobytes()

        # Ids in the order of their groups, those of A before those of B, and the mark after each.
        kind = np.concatenate([np.zeros(len(a_group), np.int64), np.ones(len(b_group), np.int64)])
        group = np.concatenate([a_group, b_group])
        order = np.argsort(group * 2 + kind, kind="stable")
        kind, group = kind[order], group[order]
        ids = np.concatenate([found.a, found.b])[order].tolist()
        mark = np.where(group[1:] != group[:-1], 2, np.where(kind[1:] != kind[:-1], 1, 0))
        texts = [f"{i}{c}" for i, c in zip(ids, [",|;"[k] for k in mark.tolist()] + [";"], strict=True)]
        text_stops = np.cumsum(np.bincount(of_group[group], minlength=n)).tolist()

        apart = self._wide(found, a_group, b_group, np.flatnonzero(wide), of_group)
        start = low = 0
        for j, (i, stop, high) in enumerate(zip(kept, text_stops, code_stops.tolist(), strict=True)):
            counts = packed(*[c[j] for c in sums])
            yield segments[i], Part(counts, "".join(texts[start:stop])[:-1].encode(), raw[low:high], apart.get(j))
            start, low = stop, high

    def _wide(self, found: Alignment, a_group, b_group, groups, of_group) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per segment the distinct pairs of its wide groups, and how often each is linked.

        Groups without a common cut for long, such as runs of one character, repeat few ids.
        """
        out: dict[int, list] = {}
        for g in groups:
            ids, n_a = np.unique(found.a[slice(*np.searchsorted(a_group, [g, g + 1]))], return_counts=True)
            others, n_b = np.unique(found.b[slice(*np.searchsorted(b_group, [g, g + 1]))], return_counts=True)
            pairs = (ids[:, None] * self.width + others).ravel(), (n_a[:, None] * n_b).ravel()
            out.setdefault(int(of_group[g]), []).append(pairs)
        return {j: tuple(np.concatenate(c) for c in zip(*pairs, strict=True)) for j, pairs in out.items()}


def _byte_lengths(texts: list[str]) -> list[int]:
    return [len(t) if t.isascii() else len(t.encode()) for t in texts]


def _bounded(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about ``BATCH_CHARS`` characters together, at least one at a time."""
    start = 0
    while start < len(texts):
        stop, chars = start + 1, len(texts[start])
        while stop < len(texts) and chars + len(texts[stop]) <= BATCH_CHARS:
            chars += len(texts[stop])
            stop += 1
        yield texts[start:stop]
        start = stop


@functools.lru_cache(maxsize=2)
def _aligner(params: AlignParams) -> Aligner:
    return Aligner(params)


def linked_pairs(codes: Iterable[bytes], wide: Iterable[tuple | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs of a text's parts, and how often each is linked."""
    pairs, times = np.unique(np.frombuffer(b"".join(codes), np.int64), return_counts=True)
    apart = [w for w in wide if w is not None]
    if apart:
        pairs, place = np.unique(np.concatenate([pairs, *[w[0] for w in apart]]), return_inverse=True)
        times = np.bincount(place, np.concatenate([times, *[w[1] for w in apart]])).astype(np.int64)
    return pairs, times


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


_NONE = np.empty(0, np.int64)


def alignments(docs: DataFrame, params: AlignParams, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row the columns of ``keep``, ``a, b`` (ids), ``a_ends, b_ends`` (bytes of space and text) and ``cuts``."""
    names = ["a", "b", "a_ends", "b_ends", "cuts"]

    def columns(aligner: Aligner, texts: list[str]) -> list[pa.Array]:
        found = list(aligner.align(texts))
        return [_lists([_NONE if f is None else getattr(f, n) for f in found], pa.int64()) for n in names]

    schema = ", ".join(f"{n} array<bigint>" for n in names)
    return _mapped(docs, params, keep, schema, names, columns)


def _mapped(
    docs: DataFrame,
    params: AlignParams,
    keep: tuple[str, ...],
    schema: str,
    names: list[str],
    columns: Callable[[Aligner, list[str]], list[pa.Array]],
) -> DataFrame:
    """``keep`` and the columns made of the texts, a bounded part of a batch at a time."""
    rows = docs.select(*keep, text_of().alias("_text"))
    kept = rows.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(params)
        # The segments kept are many objects without cycles, which the collector would visit again and again.
        gc.disable()
        try:
            for batch in batches:
                start = 0
                for some in _bounded(batch.column(len(keep)).to_pylist()):
                    cut = [batch.column(i).slice(start, len(some)) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*cut, *columns(aligner, some)], names=[*keep, *names])
                    start += len(some)
        finally:
            gc.enable()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)
    return rows.mapInArrow(run, f"{fields}, {schema}")


@dataclass(frozen=True)
class Linked:
    """A row per document (counts and its linked pairs), and how to read a pair's code."""

    rows: DataFrame
    width: int


def linked_documents(docs: DataFrame, params: AlignParams) -> Linked:
    """The stored rows ``row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, codes, times``.

    ``codes`` are the distinct pairs of ids linked in the document, ``a * width + b``, ``times`` how
    often each is linked.
    """
    width, size = _vocabulary_sizes(docs.sparkSession, params)
    narrow = width * size <= 2**31
    kind = "int" if narrow else "bigint"
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"]

    def columns(aligner: Aligner, texts: list[str]) -> list[pa.Array]:
        counts, hashes, codes, times = [], [], [], []
        for parts in aligner.parts(texts):
            if parts is None:
                counts.append((0, 0, 0, 0)), hashes.append(""), codes.append(_NONE), times.append(_NONE)
                continue
            sums, groups, raw, wide = zip(*parts, strict=True)
            counts.append(unpacked(sum(sums)))
            hashes.append(hashlib.sha256(b";".join(groups)).hexdigest())
            pairs, each = linked_pairs(raw, wide)
            codes.append(pairs), times.append(each)
        numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
        element = pa.int32() if narrow else pa.int64()
        return [*numbers, pa.array(hashes, pa.string()), _lists(codes, element), _lists(times, pa.int64())]

    schema = ", ".join(f"{n} bigint" for n in names[:4])
    schema += f", groups_sha256 string, codes array<{kind}>, times array<bigint>"
    mapped = _mapped(docs, params, ("doc_id",), schema, names, columns)
    return Linked(store(mapped.withColumn("row", F.monotonically_increasing_id())), width)


def _vocabulary_sizes(spark: SparkSession, params: AlignParams) -> tuple[int, int]:
    """Ids of the second and of the first vocabulary."""
    import sentencepiece
    from tokenizers import Tokenizer

    second = sentencepiece.SentencePieceProcessor(model_file=params.second)
    return second.get_piece_size(), Tokenizer.from_file(params.first).get_vocab_size()


def link_counts(linked: Linked) -> DataFrame:
    """``code, a, b, n, best``: documents that hold a pair linked; ``best``: none of its ``a`` has more."""
    counted = linked.rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    counted = store(counted)
    a = F.call_function("div", F.col("code").cast("bigint"), F.lit(linked.width))
    named = counted.select("code", a.alias("a"), F.pmod(F.col("code"), F.lit(linked.width)).alias("b"), "n")
    # A row per id of the first vocabulary.
    most = F.broadcast(named.groupBy("a").agg(F.max("n").alias("most")))
    return named.join(most, "a").select("code", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align_digest(docs: DataFrame, params: AlignParams) -> DataFrame:
    """Per document the numbers of tokens, groups and links, and what its links count in the corpus."""
    linked = linked_documents(docs, params)
    packed = (2 * F.col("n") + F.col("best").cast("bigint")).alias("code")
    table = store(link_counts(linked).select(F.col("code").alias("label"), packed, F.col("n").alias("rows")))
    total = table.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    pairs = linked.rows.select("row", F.explode(F.arrays_zip("codes", "times")).alias("p"))
    pairs = pairs.select("row", F.col("p.codes").alias("pair"), F.col("p.times").alias("times"))
    counted = lookup(pairs, "pair", table, "found", total, hot_share=HOT_SHARE)
    best = F.when(F.col("found") % 2 == 1, F.col("times")).otherwise(0)
    sums = counted.groupBy("row").agg(
        F.sum(best).alias("n_best"), F.sum(F.col("times") * F.shiftright("found", 1)).alias("count_sum")
    )
    both = linked.rows.drop("codes", "times").join(sums, "row", "left")
    zero = F.lit(0).cast("bigint")
    return both.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )
