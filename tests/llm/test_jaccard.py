import random

import numpy as np
import pytest

from tidemark.llm.components import components
from tidemark.llm.jaccard import (
    CountTree,
    JaccardParams,
    _pack,
    _unpack,
    block_keys,
    count_vector,
    groups_for,
    jaccard_digest,
    keep_one,
    shingle_set,
)


def shingles(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def groups(docs, k, percent):
    """Least id reachable by links, over all pairs."""
    sets = [(i, shingles(t, k)) for i, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    members = {}
    for n, (i, _) in enumerate(sets):
        members.setdefault(root(n), []).append(i)
    names = {r: min((i for i in ids if i is not None), default=None) for r, ids in members.items()}
    return sorted(((i, len(s), names[root(n)]) for n, (i, s) in enumerate(sets)), key=str)


def corpus(seed, families=12, copies=12):
    r = random.Random(seed)
    words = [f"W{i}" for i in range(300)]
    shared = r.choices(words, k=60)
    docs = []
    for _ in range(families):
        base = r.choices(words, k=r.choice([1, 2, 3, 6, 12, 30, 80, 300])) + (shared if r.random() < 0.4 else [])
        for _ in range(copies):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5, 12])):
                text[r.randrange(len(text))] = r.choice(words)
            docs.append((len(docs), r.choice([" ", "\n", " \t "]).join(text)))
    return docs


@pytest.mark.parametrize(
    ("k", "percent", "chunk", "large"), [(3, 90, 512, 16), (5, 80, 4, 2), (5, 80, 2048, 4), (1, 60, 3, 3)]
)
def test_groups_equal_brute_force(spark, odd, odd_rows, k, percent, chunk, large):
    docs = [(1_000 + i, t) for i, t in corpus(k)]
    frame = odd.unionByName(spark.createDataFrame(docs, "doc_id long, text string"), allowMissingColumns=True)
    got = jaccard_digest(frame, JaccardParams(words=k, percent=percent, chunk=chunk, large=large)).collect()
    assert sorted(map(tuple, got), key=str) == groups([r[:2] for r in odd_rows] + docs, k, percent)


def components_by_matrix(texts, k, percent):
    """The least place reachable by links, from the overlaps of all pairs as one matrix product."""
    sets = [shingles(t, k) for t in texts]
    number = {s: i for i, s in enumerate({s for one in sets for s in one})}
    held = np.zeros((len(sets), len(number)), np.float32)
    for row, one in zip(held, sets):
        row[[number[s] for s in one]] = 1
    sizes = held.sum(axis=1).astype(np.int64)
    both = (held @ held.T).astype(np.int64)
    linked = 100 * both >= percent * (sizes[:, None] + sizes - both)
    label = np.arange(len(sets))
    while True:
        least = np.array([label[near].min() for near in linked])
        if (least == label).all():
            return label
        label = least


@pytest.mark.parametrize(("edits", "large"), [(14, 16), (40, 16), (14, 100_000)])
def test_a_group_of_near_copies(spark, edits, large):
    """Copies that link to one text, to each other or to none, and unrelated texts with the same passage."""
    r, words = random.Random(edits), [f"w{i}" for i in range(2_000)]
    base, passage = r.choices(words, k=220), r.choices(words, k=60)
    texts = []
    for i in range(3_000 if large == 16 else 600):
        text = list(base)
        for _ in range(r.randint(0, edits)):
            text[r.randrange(len(text))] = r.choice(words)
        texts.append(" ".join(text))
    texts += [" ".join(passage + r.choices(words, k=r.randint(100, 200))) for _ in range(300)]
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    params = JaccardParams(words=5, percent=80, large=large, shingles=1 << 17)
    got = {r.doc_id: r.component_id for r in jaccard_digest(docs, params).collect()}
    expected = components_by_matrix(texts, 5, 80)
    assert [got[i] for i in range(len(texts))] == expected.tolist()
    assert len(set(got.values())) > 300


def test_one_of_each_group_stays(spark, odd, odd_rows):
    docs = [(1_000 + i, t) for i, t in corpus(9, families=6)]
    frame = odd.unionByName(spark.createDataFrame(docs, "doc_id long, text string"), allowMissingColumns=True)
    kept = keep_one(frame)
    assert kept.columns == frame.columns
    expected = groups([r[:2] for r in odd_rows] + docs, 5, 80)
    lonely = sum(1 for _, n, _ in expected if not n)
    assert kept.count() == lonely + len({name for _, n, name in expected if n})


def test_empty_table(odd):
    assert jaccard_digest(odd.limit(0), JaccardParams()).count() == 0
    assert keep_one(odd.limit(0)).columns == odd.columns


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_similar_sets_share_an_entry(percent):
    params, r = JaccardParams(percent=percent), np.random.default_rng(percent)
    for _ in range(400):
        size = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        same = int(np.ceil(len(a) * r.uniform(percent / 100, 1)))
        new = r.integers(0, 2**63, int(r.integers(0, len(a) // 4 + 1))).astype(np.uint64)
        b = np.unique(np.concatenate([r.permutation(a)[:same], new]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both):
            (first, least), (second, other) = block_keys(a, params), block_keys(b, params)
            assert len(np.intersect1d(first, second)) >= max(least, other) >= 1


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 300])
def test_tree_search_misses_nothing_the_bound_allows(n):
    r, percent = np.random.default_rng(n), 80
    sizes = r.integers(5, 60, n)
    counts = np.array([np.bincount(r.integers(0, 8, s), minlength=8) for s in sizes]).reshape(n, 8)
    tree = CountTree(counts, sizes, percent) if n else None
    for q in range(min(n, 50)):
        bound = np.minimum(counts, counts[q]).sum(axis=1)
        allowed = np.flatnonzero((100 + percent) * bound >= percent * (sizes + sizes[q]))
        assert sorted(tree.search(counts[q], sizes[q])) == list(allowed)


def test_vectors_of_any_length_bound_the_overlap():
    params, r = JaccardParams(), np.random.default_rng(3)
    for size in (3, 200, 900, 5_000):
        a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(size * 0.9)], r.integers(0, 2**63, size // 3).astype(np.uint64)]))
        # Many shingles in one group: the count is not kept, and the bound still holds.
        crowd = np.arange(1, 400, dtype=np.uint64)
        for x, y in ((a, b), (a, a), (np.union1d(a, crowd), np.union1d(b, crowd)), (crowd, crowd)):
            both = _unpack([_pack(count_vector(s, groups_for(len(s), params))) for s in (x, y)])
            assert both.min(axis=0).sum() >= len(np.intersect1d(x, y))


def test_shingles_and_vectors():
    assert len(shingle_set(b"a b", 3)) == 1 and len(shingle_set(b"A b", 3)) == 1
    assert shingle_set(b"A b c", 3) == shingle_set(b"a\tB  C", 3)
    assert len(shingle_set(None, 3)) == len(shingle_set(b" \n", 3)) == 0
    s = shingle_set(b"a b c d e f a b c", 3)
    assert len(s) == 6 and count_vector(s, 64).sum() == 6


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    hub = [(1_000, 1_000 + i) for i in range(1, 100)]
    edges = chain[::-1] + hub + hub + [(5_000, 5_000), (3_000, 2_000)]
    got = components(spark.createDataFrame(edges, "x long, y long")).collect()
    assert sorted(map(tuple, got)) == sorted(
        [(i, 0) for i in range(201)] + [(1_000 + i, 1_000) for i in range(100)] + [(2_000, 2_000), (3_000, 2_000)]
    )
