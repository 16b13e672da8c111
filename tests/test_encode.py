import random

import pytest

from tidemark.operators import encode
from tidemark.operators.encode import label_codes, label_encode
from tidemark.operators.sizing import part_offsets, sorted_positions


def labelled(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "id int, label string")


def expected(labels):
    order = {label: i for i, label in enumerate(sorted({x for x in labels if x is not None}))}
    return {i: order.get(x, len(order)) for i, x in enumerate(labels)}


def skewed(n=3000):
    rng = random.Random(3)
    return ["hot" if i % 3 == 0 else f"k{rng.randint(0, 400)}" for i in range(n)]


def test_sorted_codes(spark):
    labels = ["Two year", "Month-to-month", "One year", "One year"]
    rows = label_encode(labelled(spark, labels), "label", "code").collect()
    assert {r.id: r.code for r in rows} == {0: 2, 1: 0, 2: 1, 3: 1}


@pytest.mark.parametrize(
    "settings", [{}, {"broadcast_bytes": 0, "hot_share": 0.01}, {"broadcast_bytes": 0, "hot_share": 2.0}]
)
def test_matches_brute_force_with_a_hot_label(spark, settings):
    labels = [None if i % 50 == 7 else x for i, x in enumerate(skewed())]
    rows = label_encode(labelled(spark, labels), "label", "code", **settings).collect()
    assert {r.id: r.code for r in rows} == expected(labels)
    assert len(rows) == len(labels)


def test_shuffled_join_of_the_rare_labels(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labels = skewed()
        df = label_encode(labelled(spark, labels), "label", "code", broadcast_bytes=0, hot_share=0.01)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        assert {r.id: r.code for r in df.collect()} == expected(labels)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_labels_too_long_for_a_broadcast_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(encode, "broadcast_if_small", lambda df, limit=50: real(df, 50))
    labels = ["x" * 100] * 5 + ["y" * 100] * 5 + ["z"]
    rows = label_encode(labelled(spark, labels), "label", "code", broadcast_bytes=50).collect()
    assert {r.id: r.code for r in rows} == expected(labels)


real = encode.broadcast_if_small


def test_nulls(spark):
    df = labelled(spark, ["b", None, "a"])
    assert {r.id: r.code for r in label_encode(df, "label", "code").collect()} == {0: 1, 1: 2, 2: 0}
    assert {r.id: r.code for r in label_encode(df, "label", "code", nulls="skip").collect()} == {0: 1, 2: 0}
    with pytest.raises(Exception, match="null in label"):
        label_encode(df, "label", "code", nulls="error").collect()
    with pytest.raises(ValueError):
        label_encode(df, "label", "code", nulls="other")


def test_codes_over_many_sort_ranges(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        labels = [f"{(i * 7919) % 1000:04d}" for i in range(4000)]
        codes = label_codes(labelled(spark, labels).repartition(6), "label")
        assert [(r.label, r.code, r.rows) for r in codes.orderBy("code").collect()] == [
            (f"{i:04d}", i, 4) for i in range(1000)
        ]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_prefix_totals(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = sorted_positions(spark.range(0, 1000, 1, 5).selectExpr("id", "id AS v"), "id")
        rows = placed.join(part_offsets(placed, "v", "before"), "_part").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    first = {}
    for r in rows:
        first[r["_part"]] = min(first.get(r["_part"], (10**9, 0)), (r.id, r.before))
    assert len(first) > 1
    assert all(before == start * (start - 1) // 2 for start, before in first.values())
    assert all(r["_row"] == r.id - first[r["_part"]][0] for r in rows)
