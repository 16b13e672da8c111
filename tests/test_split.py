import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidemark.operators.encode import lookup
from tidemark.operators.split import stratified_split, train_quotas


def quotas_of(sizes, test_size):
    """Training rows per class, largest remainders one by one."""
    total = sum(sizes.values())
    train = total - math.ceil(test_size * total)
    quotas = {c: train * n // total for c, n in sizes.items()}
    for c in sorted(sizes, key=lambda c: (-(train * sizes[c] % total), c))[: train - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def found_quotas(spark, sizes, test_size):
    table = spark.createDataFrame(list(sizes.items()), "_class long, n long")
    rows = train_quotas(table, sum(sizes.values()), len(sizes), test_size).collect()
    return {r["_class"]: r["_want"] for r in rows}


def brute_force(rows, test_size, seed):
    """The training ids: per class, the quota's smallest keys."""
    sizes = {}
    for _, label in rows:
        sizes[label] = sizes.get(label, 0) + 1
    quotas = quotas_of(sizes, test_size)
    chosen = set()
    for label, quota in quotas.items():
        ids = [i for i, other in rows if other == label]
        ids.sort(key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
        chosen.update(ids[:quota])
    return chosen


def split_ids(df, **options):
    rows = stratified_split(df, "id", "label", **options).collect()
    return {r.id for r in rows if r.split == "train"}, {r.id for r in rows if r.split == "test"}


@pytest.mark.parametrize("rank_rows", [1_000_000, 0])
@pytest.mark.parametrize("test_size, seed", [(0.2, 42), (0.37, 1)])
def test_matches_brute_force(spark, rank_rows, test_size, seed):
    rows = [(i, 1 if i % 11 == 0 else 0) for i in range(3000)]
    train, test = split_ids(
        spark.createDataFrame(rows, "id int, label int"), test_size=test_size, seed=seed, rank_rows=rank_rows
    )
    assert train == brute_force(rows, test_size, seed)
    assert train.isdisjoint(test) and len(train) + len(test) == len(rows)
    assert len(test) == math.ceil(test_size * len(rows))


def test_boundary_bucket_cut_finer(spark, monkeypatch):
    """With one hex digit per level the boundary bucket holds many rows and needs several levels."""
    from tidemark.operators import split

    monkeypatch.setattr(split, "_STEP", 1)
    rows = [(i, i % 2) for i in range(4000)]
    train, _ = split_ids(spark.createDataFrame(rows, "id int, label int"), rank_rows=3)
    assert train == brute_force(rows, 0.2, 42)


def test_same_rows_on_any_partitioning(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 = 0 AS label")
    assert split_ids(df.repartition(7)) == split_ids(df.coalesce(1))


def test_text_ids_and_labels(spark):
    rows = [(f"c{i}", "yes" if i % 4 == 0 else "no") for i in range(400)]
    train, _ = split_ids(spark.createDataFrame(rows, "id string, label string"))
    assert train == brute_force(rows, 0.2, 42)


def test_a_repeated_id_stays_together(spark):
    """A third of all rows under one id: no error, and all of them in one part."""
    rows = [(7 if i % 3 == 0 else i, i % 2) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, label int")
    train, test = split_ids(df, rank_rows=1)
    by_class = stratified_split(df, "id", "label", rank_rows=1).where("id = 7")
    assert by_class.select("label", "split").distinct().count() == 2
    assert train | test == {i for i, _ in rows}


def test_columns_are_kept(spark):
    df = spark.createDataFrame([(i, i % 2, "x") for i in range(20)], "id int, label int, more string")
    assert stratified_split(df, "id", "label").columns == ["id", "label", "more", "split"]


def test_no_shuffle_of_the_rows(spark):
    df = spark.range(1000).selectExpr("id", "id % 2 AS label")
    plan = stratified_split(df, "id", "label")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_null_ids_are_refused(spark):
    rows = [(None if i % 10 == 0 else i, i % 2) for i in range(1000)]
    with pytest.raises(ValueError, match="100 rows with null in id"):
        stratified_split(spark.createDataFrame(rows, "id int, label int"), "id", "label")


def test_null_label_and_too_few_rows(spark):
    with pytest.raises(ValueError, match="null in label"):
        split_ids(spark.createDataFrame([(1, None), (2, 1), (3, 1)], "id int, label int"))
    with pytest.raises(ValueError, match="too few"):
        split_ids(spark.createDataFrame([(1, 0), (2, 1)], "id int, label int"))


@settings(max_examples=8, deadline=None)
@given(sizes=st.lists(st.integers(2, 500), min_size=1, max_size=6), test_size=st.floats(0.1, 0.9))
def test_quotas_keep_the_ratios(spark, sizes, test_size):
    classes = dict(enumerate(sizes))
    total = sum(sizes)
    test_rows = math.ceil(test_size * total)
    if total - test_rows < len(sizes) or test_rows < len(sizes):
        with pytest.raises(ValueError):
            found_quotas(spark, classes, test_size)
        return
    quotas = found_quotas(spark, classes, test_size)
    assert quotas == quotas_of(classes, test_size)
    assert sum(quotas.values()) == total - test_rows
    assert all(abs(quotas[c] - (total - test_rows) * n / total) < 1 for c, n in classes.items())


def test_known_quotas(spark):
    # 7,043 rows at 0.2 leave 5,634 to train on; 26.5 % of them are in class 1.
    assert found_quotas(spark, {0: 5174, 1: 1869}, 0.2) == {0: 4139, 1: 1495}


def test_quotas_of_counts_whose_product_is_large(spark):
    sizes = {0: 3 * 10**14 + 1, 1: 7 * 10**14 + 2}
    assert found_quotas(spark, sizes, 0.2) == quotas_of(sizes, 0.2)


@pytest.mark.parametrize("broadcast", [True, False])
def test_twenty_thousand_classes_with_a_hot_one(spark, monkeypatch, broadcast):
    """Every class gets its quota of the smallest keys, also where no table may be broadcast."""
    from tidemark.operators import split

    n = 180_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20_000 + 1).alias("label"))
    if not broadcast:
        monkeypatch.setattr(split, "broadcast_if_small", lambda df: None)
        monkeypatch.setattr(split, "lookup", lambda *args: lookup(*args, broadcast_bytes=0, hot_share=0.01))
    train, test = split_ids(df)
    rows = [(i, 0 if i % 3 == 0 else i % 20_000 + 1) for i in range(n)]
    assert len(train) + len(test) == n and len(test) == math.ceil(0.2 * n)
    by_class = {}
    for i, label in rows:
        by_class.setdefault(label, []).append(i)
    quotas = quotas_of({c: len(ids) for c, ids in by_class.items()}, 0.2)
    assert len(by_class) == 20_001
    for c, ids in by_class.items():
        ids.sort(key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        assert train.issuperset(ids[: quotas[c]]) and test.issuperset(ids[quotas[c] :])
