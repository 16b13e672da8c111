"""Alignment of tokenizers against a plain version, byte by byte."""

import bisect
import hashlib
import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import align as m
from tidemark.llm import queries

PARAMS = m.AlignParams(*map(public_tokenizers.path, queries.ALIGNED))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

TEXTS = [
    None,
    "",
    " ",
    "  two  spaces ",
    "plain words, and some more.",
    "héllo wörld 漢字かな \U0001f600\U0001f468‍\U0001f469 x",
    "a ▁ piece mark",
    "<s> </s> <unk> <0xE6> <|endoftext|> [INST]",
    "\t\n\r\n\x0b\x0c \x00 \x7f",
    "𒀀𒀁 ꙮ ￼  ﷽ é",
    "a" * 3000,
    "漢" * 500,
    "\n" * 2000,
    "plain words, and some more.",
    "ğüşiöç " * 50,
]


@pytest.fixture(scope="module")
def aligner():
    return m.Aligner(PARAMS)


def plain(aligner, text):
    """Ids and ends of both by decoding every token on its own; None without tokens."""
    if not text:
        return None
    raw = f" {text}".encode()
    a = aligner.first.encode(f" {text}", add_special_tokens=False).ids
    b = aligner.second.encode(text)
    sides = []
    for ids, sizes in ((a, aligner.a_bytes), (b, aligner.b_bytes)):
        if b"".join(sizes[i] for i in ids) != raw:
            return None
        ends, at = [], 0
        for i in ids:
            at += len(sizes[i])
            ends.append(at)
        sides.append(ends)
    return a, b, *sides


def brute(aligner, texts):
    """The digest's rows, pair by pair."""
    rows, held = [], Counter()
    for text in texts:
        found = plain(aligner, text)
        if found is None:
            rows.append(None)
            continue
        a, b, a_ends, b_ends = found
        cuts = sorted(set(a_ends) & set(b_ends))
        groups = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate([(a, a_ends), (b, b_ends)]):
            for i, e in zip(ids, ends):
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(links))
        rows.append((len(a), len(b), groups, links))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = row
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((
            n_a, n_b, len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest(),
        ))
    return out


def digest(spark, texts, extra=()):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for name in extra:
        docs = docs.withColumn(name, docs.doc_id)
    rows = m.align_digest(docs, PARAMS).collect()
    return [tuple(r)[1:] for r in sorted(rows)]


def test_equals_brute_force(spark, aligner):
    assert digest(spark, TEXTS) == brute(aligner, TEXTS)


def test_given_documents(spark, aligner):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text for r in sorted(docs)]
    assert digest(spark, texts) == brute(aligner, texts)


def test_pairs_too_many_to_broadcast(spark, aligner, monkeypatch):
    from tidemark.operators import encode

    calls = []

    def small(df, limit=None):
        calls.append(limit)
        # Only the frequent pairs may be sent.
        return None if len(calls) == 1 else real(df)

    real = encode.broadcast_if_small
    monkeypatch.setattr(encode, "broadcast_if_small", small)
    monkeypatch.setattr(m, "HOT_SHARE", 0.01)
    assert digest(spark, TEXTS) == brute(aligner, TEXTS)
    assert len(calls) == 2


@pytest.mark.parametrize("wide", [1, 50, 1 << 12])
def test_wide_groups_count_equal_ids_first(aligner, monkeypatch, wide):
    monkeypatch.setattr(m, "WIDE", wide)
    for text in TEXTS:
        found = next(aligner.align([text or ""]))
        aligner._known.clear(), aligner._older.clear()
        parts = next(aligner.parts([text or ""]))
        assert (found is None) == (parts is None)
        if found is None:
            continue
        a_group, b_group = found.groups()
        links = Counter(
            (x, y)
            for g in range(len(found.cuts))
            for x in found.a[a_group == g].tolist()
            for y in found.b[b_group == g].tolist()
        )
        codes, times = m.linked_pairs([p.codes for p in parts], [p.wide for p in parts])
        assert dict(zip(codes.tolist(), times.tolist())) == {x * aligner.width + y: c for (x, y), c in links.items()}
        counts = m.unpacked(sum(p.counts for p in parts))
        assert counts == (len(found.a), len(found.b), len(found.cuts), sum(links.values()))
    aligner._known.clear(), aligner._older.clear()


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs"]), min_size=1, max_size=60))
def test_refined_ends_are_those_of_the_bytes(aligner, text):
    expected, found = plain(aligner, text), next(aligner.align([text]))
    assert (found is None) == (expected is None)
    if found is not None:
        assert found.a.tolist() == expected[0] and found.b.tolist() == expected[1]
        assert found.a_ends.tolist() == expected[2] and found.b_ends.tolist() == expected[3]


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("ab'sZ9.,-é漢\x1c\xa0\u2003\u3000 \n\t▁\U0001f600"), min_size=1, max_size=30))
def test_segments_are_encoded_as_in_the_whole_text(aligner, text):
    whole = next(aligner.align([text]))
    parts = next(aligner.parts([text]))
    assert (whole is None) == (parts is None)
    if whole is not None:
        groups = plain_groups(whole)
        assert b";".join(p.groups for p in parts).decode() == groups


def plain_groups(found):
    a_group, b_group = found.groups()
    return ";".join(
        ",".join(map(str, found.a[a_group == g])) + "|" + ",".join(map(str, found.b[b_group == g]))
        for g in range(len(found.cuts))
    )


def test_other_vocabularies_are_not_cut(aligner):
    assert aligner.splits and aligner.segments("a b  c\n d") == [" a", " b", "  c\n d"]
    whole = m.Aligner(PARAMS)
    whole.splits = False
    for text in TEXTS:
        one, many = next(whole.parts([text or ""])), next(aligner.parts([text or ""]))
        assert (one is None) == (many is None)
        if one is not None:
            assert one[0].groups == b";".join(p.groups for p in many)


def test_a_space_mark_has_no_tokens(spark):
    assert digest(spark, ["a ▁ b", None, ""]) == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_alignments_cover_the_bytes(spark, aligner):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in m.alignments(docs, PARAMS).collect()}
    assert rows[1].a_ends[-1] == rows[1].b_ends[-1] == rows[1].cuts[-1] == 8
    assert rows[2].a == rows[2].cuts == []
    first = b"".join(aligner.a_bytes[i] for i in rows[1].a)
    assert first == b" one two"


def test_long_text_in_one_batch_with_others(spark, aligner):
    texts = ["short", "word " * 100_000, "été " * 100_000, "short"]
    found = digest(spark, texts)
    assert found[0] == found[3] and found[1][0] > 100_000 and found[2][6]
    assert found == brute(aligner, texts)


def test_odd_rows_and_clashing_names(spark, odd):
    names = ["row", "codes", "times", "a", "_text", "pair", "found"]
    docs = odd.select("*", *[odd.doc_id.alias(n) for n in names if n not in odd.columns])
    rows = m.align_digest(docs, PARAMS).collect()
    assert len(rows) == odd.count()
    assert sorted({tuple(r)[1:] for r in rows if r.doc_id == 6}) == [tuple(r)[1:] for r in rows if r.doc_id == 6][:1]
    assert m.align_digest(odd.limit(0), PARAMS).count() == 0


def test_refine_without_a_sure_end_before():
    ends = m.refine(np.array([0, 0, 0, 3]), np.array([3, 3, 3, 5]), np.array([1, 1, 1, 2]))
    assert ends.tolist() == [1, 2, 3, 5]
