import os

import pytest
from oracle import connect, differences

from tidemark.llm.chat import CONTROLS, ChatParams, best_paths, chat_digest, format_trees, read_loss, read_turns
from tidemark.llm.queries import SQL, op1_chat

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "id long, parent long, role string, text string, score double"


def paths(rows, top_k):
    """All root-to-leaf paths, the best of each root first."""
    ids = {r[0] for r in rows}
    parent = {r[0]: r[1] if r[1] in ids else None for r in rows}
    inner = {p for p in parent.values() if p is not None}
    score = {r[0]: r[4] or 0.0 for r in rows}
    found = {}
    for leaf in ids - inner:
        path, at = [], leaf
        while at is not None:
            path.append(at)
            at = parent[at]
        found.setdefault(path[-1], []).append(
            (-sum(score[i] for i in path) / len(path), -len(path), leaf, path[::-1])
        )
    return sorted(p[3] for ranked in found.values() for p in sorted(ranked)[:top_k])


TREE = [
    (1, None, "user", "q", 0.0),
    (2, 1, "assistant", "a", 1.0),
    (3, 1, "assistant", "b", 3.0),
    (4, 3, "user", "c", None),
    (5, 99, None, None, None),
    (8, 1, "assistant", "tie", 3.0),
    (9, 8, "user", "tie", 0.0),
    *[(100 + i, 99 + i if i else None, "user", str(i), 1.0) for i in range(37)],
    *[(200 + i, 120, "user", "many", float(i % 5)) for i in range(50)],
]
CYCLE = [(6, 7, "x", "y", 1.0), (7, 6, "x", "y", 1.0)]


@pytest.mark.parametrize("top_k", [1, 3])
def test_paths_equal_brute_force(spark, top_k):
    got = {}
    for r in best_paths(spark.createDataFrame(TREE + CYCLE, SCHEMA), ChatParams(paths_per_tree=top_k)).collect():
        got.setdefault(r.leaf, []).append((-r.distance, r.node))
    assert sorted([n for _, n in sorted(p)] for p in got.values()) == paths(TREE, top_k)


def test_turns_and_loss_are_read_back_exactly(spark):
    texts = ["", "\\", "\\\\<s>", *CONTROLS, "".join(CONTROLS), "<<s>>", "a\n</s>\n<\\s>", "é\U0001f600", "[[/INST]]"]
    roles = ["user", "assistant", "sys\ntem\\", "", "</s>"]
    rows = [(i, i - 1 if i else None, roles[i % 5], t, 0.0) for i, t in enumerate(texts)]
    out = format_trees(spark.createDataFrame(rows, SCHEMA))
    row = out.select("formatted", read_turns(out["formatted"]).alias("t"), read_loss(out["mask"]).alias("l")).first()
    assert [(t.role, t.text) for t in row.t] == [(r[2], r[3]) for r in rows]
    assert row.l == "".join(r[3] for r in rows if r[2] == "assistant")
    assert row.formatted.count("</s>") == len(rows)


def test_conversations_with_nulls_ties_and_repeats(spark):
    rows = [
        (1, 0, "user", None, "x"),
        (1, 0, "user", None, "x"),
        (1, None, None, "first", "x"),
        (1, 5, "assistant", "last", "x"),
        (None, 0, "assistant", "", "x"),
        (2, 0, "assistant", "long " * 30_000, "x"),
    ]
    schema = "conv_id long, turn long, role string, text string, formatted string"
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_digest(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (4, 4), None: (1, 0), 2: (1, 150_000)}
    assert chat_digest(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_query_equals_sql(spark):
    assert differences(op1_chat(spark, SF_DIR), connect(SF_DIR), SQL["op1_chat"]) == []
