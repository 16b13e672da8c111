import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.packing import PackParams, _fullest, cut, pack, pack_lengths, pieces, sequences
from tidemark.llm.tokens import PATTERN, encoder

PARAMS = PackParams(tokenizer=public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_are_those_of_the_tokenizer_file(reference):
    assert PATTERN == public_tokenizers.PATTERN
    encode, r = encoder(PARAMS.tokenizer), random.Random(1)
    signs = list(" \n\tab1'é. 　\x1c\x85sß漢\U0001f600")
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 16))) for _ in range(3_000)]
    for text in [*texts, None, "a" * 50_000, " " * 50_000, "<|endoftext|>"]:
        assert encode(text) == reference(text)


def test_pieces():
    assert cut(1, 4) == [(0, 1)]
    assert cut(4, 4) == [(0, 4)]
    assert cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.mark.parametrize("seed", range(20))
def test_fullest_is_the_best_subset_sum(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 30): r.randint(1, 4) for _ in range(5)}
    room = r.randint(0, 80)
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    chosen = _fullest(room, counts)
    assert sum(chosen) == max(s for s in sums if s <= room)
    assert all(chosen.count(length) <= counts.get(length, 0) for length in chosen)


def least_bins(counts, capacity):
    """A lower bound: long pieces need a bin each, and short ones only have the room those leave."""

    def within(low, high):
        chosen = [(length, n) for length, n in counts.items() if low < length <= high]
        return sum(n for _, n in chosen), sum(length * n for length, n in chosen)

    best = 0
    for k in range(1, capacity // 2 + 1):
        alone, _ = within(capacity - k, capacity)
        long_, filled = within(capacity // 2, capacity - k)
        _, short = within(k - 1, capacity // 2)
        best = max(best, alone + long_ + max(0, -(-(short - (long_ * capacity - filled)) // capacity)))
    return best


@pytest.mark.parametrize("seed", range(5))
def test_histogram_is_used_up(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 1024): r.randint(1, 3_000) for _ in range(300)} | {17: 100_000}
    combinations = pack_lengths(counts, 1024)
    used = {}
    for times, combination in combinations:
        assert sum(length * n for length, n in combination.items()) <= 1024
        for length, n in combination.items():
            used[length] = used.get(length, 0) + times * n
    assert used == counts
    assert sum(times for times, _ in combinations) <= 1.02 * least_bins(counts, 1024) + 1


def test_round_trip(odd, spark, reference):
    words = F.transform(F.sequence(F.lit(0), (F.col("id") * 37) % 900), lambda i: (i * 7919 % 1000).cast("string"))
    many = spark.range(300).select((F.col("id") + 1_000).alias("doc_id"), F.array_join(words, " ").alias("text"))
    docs = odd.unionByName(many.unionByName(many.limit(20)), allowMissingColumns=True).repartition(5)
    made = pieces(docs, PARAMS, with_ids=True)
    packed = pack(made, PARAMS)
    rows = packed.collect()
    assert made.count() == len(rows)
    whole = {}
    for r in sorted(rows, key=lambda r: r.piece):
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        whole.setdefault(r.doc_id, []).append((r.piece, r.start, bytes(r.ids)))
    for r in docs.dropDuplicates(["doc_id", "text"]).collect():
        parts = dict((piece, ids) for piece, _, ids in whole[r.doc_id])
        assert b"".join(parts[i] for i in sorted(parts)) == reference(r.text) + (2).to_bytes(4, "little")
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024 and len(ends) <= -(-sum(ends.values()) // 1024) + 2
    full = {r.sequence_id: bytes(r.ids) for r in sequences(packed).collect()}
    assert {k: len(v) // 4 for k, v in full.items()} == ends


def test_empty_table(odd):
    assert pack(pieces(odd.limit(0), PARAMS), PARAMS).count() == 0
