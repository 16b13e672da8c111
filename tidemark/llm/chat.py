"""Reply trees as conversations: paths from root to leaf, the best by score, as training text.

Messages point to the message they answer. Paths are followed by self-joins whose steps double,
so a thread of a thousand replies takes ten of them. Of each tree the leaves with the best mean
score are chosen; each chosen path becomes one text in which every turn is

    <s>role, newline, text</s>

Control strings and backslashes inside roles and texts get a backslash, so that turns can be
read back exactly. The loss mask covers the texts of assistant turns.

* A null role or text counts as empty, a null score as 0. A parent that is not in the table is
  no parent: its message is a root. Messages on a cycle hang on no root and are in no path.
* Ids must be unique (``conversation_tree`` makes them so, also for repeated rows). Ties between
  leaves go to the longer path, then the smaller id. An empty table gives an empty result.
* A path is one output value, so it must fit in a row; nothing else is gathered per tree.
* Only the named columns are read; others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import let
from tidemark.operators.sizing import part_offsets, sorted_positions, store

OPEN, CLOSE = "<s>", "</s>"
CONTROLS = (OPEN, CLOSE, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


@dataclass(frozen=True)
class ChatParams:
    paths_per_tree: int = 1
    loss_role: str = "assistant"


def escape(text: Column) -> Column:
    """Backslashes doubled, and one after the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _link(messages: DataFrame) -> DataFrame:
    """``node, up, n, total, top``: each message, its parent if there is one, and its score."""
    slim = messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = slim.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    linked = slim.where("parent IS NOT NULL").join(known, "parent", "left")
    heads = slim.where("parent IS NULL")
    up = linked.select("id", F.when(F.col("there"), F.col("parent")).alias("up"), "score")
    return up.unionByName(heads.select("id", F.col("parent").alias("up"), "score")).select(
        F.col("id").alias("node"),
        "up",
        F.lit(1).cast("bigint").alias("n"),
        F.col("score").alias("total"),
        F.col("id").alias("top"),
    )


def _climb(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``node, n, total, top`` of all messages below a root, and the jump tables of 1, 2, 4, .. steps.

    Each step joins the table with itself: what a message knows of the way to its pointer is
    put before what the pointer knows. Messages that have reached a root leave the join.
    """
    climbing = store(_link(messages))
    jumps, done = [], []
    limit = max(1, climbing.count()).bit_length() + 1
    while True:
        done.append(climbing.where("up IS NULL").drop("up"))
        rest = climbing.where("up IS NOT NULL")
        if len(jumps) >= limit or rest.isEmpty():
            break
        jumps.append(rest.select("node", "up"))
        known = climbing if len(done) == 1 else climbing.unionByName(_reached(done[:-1]))
        above = known.select(
            F.col("node").alias("up"),
            F.col("up").alias("next"),
            F.col("n").alias("m"),
            F.col("total").alias("more"),
            F.col("top").alias("above"),
        )
        climbing = store(
            rest.join(above, "up").select(
                "node",
                F.col("next").alias("up"),
                (F.col("n") + F.col("m")).alias("n"),
                (F.col("total") + F.col("more")).alias("total"),
                F.col("above").alias("top"),
            )
        )
    return _reached(done).drop("up"), jumps


def _reached(done: list[DataFrame]) -> DataFrame:
    """All messages whose root is known, as rows with no pointer left."""
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumn("up", F.lit(None).cast("bigint"))


def _leaves(messages: DataFrame, reached: DataFrame, params: ChatParams) -> DataFrame:
    """The best leaves: ``leaf, top, n, score``."""
    parents = messages.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    leaves = reached.join(parents, "node", "left_anti")
    leaves = leaves.select(F.col("node").alias("leaf"), "top", "n", (F.col("total") / F.col("n")).alias("score"))
    # The limit applies in the tasks before the shuffle, so a tree with very many leaves does not meet in one.
    rank = Window.partitionBy("top").orderBy(F.desc("score"), F.desc("n"), "leaf")
    return leaves.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= params.paths_per_tree)


def best_paths(messages: DataFrame, params: ChatParams | None = None) -> DataFrame:
    """``top, leaf, rank, score, node, distance``: every message of every chosen path.

    ``messages`` has ``id, parent`` (whole numbers) and ``score``; ``distance`` counts from the leaf.
    """
    params = params or ChatParams()
    reached, jumps = _climb(messages)
    chosen = store(_leaves(messages, reached, params))
    paths = chosen.select("top", "leaf", "rank", "score", F.col("leaf").alias("node"), F.lit(0).alias("distance"))
    for k, jump in enumerate(jumps):
        higher = paths.join(jump, "node").select(
            "top", "leaf", "rank", "score", F.col("up").alias("node"), (F.col("distance") + (1 << k)).alias("distance")
        )
        paths = store(paths.unionByName(higher))
    return paths


def format_trees(messages: DataFrame, params: ChatParams | None = None) -> DataFrame:
    """``top, leaf, rank, score, formatted, mask``: one row per chosen path.

    ``mask`` lists the pieces of ``formatted`` in order as ``text, loss``.
    """
    params = params or ChatParams()
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = messages.select(
        F.col("id").alias("node"),
        F.concat(F.lit(OPEN), F.replace(escape(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n")).alias("_head"),
        escape(text).alias("_body"),
        (role == params.loss_role).alias("_loss"),
    )
    turn = F.struct((-F.col("distance")).alias("place"), "_head", "_body", "_loss")
    grouped = (
        best_paths(messages, params)
        .join(said, "node")
        .groupBy("top", "leaf", "rank", "score")
        .agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    )

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    never = F.lit(False)
    pieces = F.flatten(
        F.transform(
            "_turns",
            lambda t: F.array(piece(t["_head"], never), piece(t["_body"], t["_loss"]), piece(F.lit(CLOSE), never)),
        )
    )
    out = grouped.select("top", "leaf", "rank", "score", pieces.alias("mask"))
    return out.withColumn("formatted", F.array_join(F.col("mask.text"), ""))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as ``role, text``."""

    def turn(part: Column) -> Column:
        whole = r"(?s)^<s>((?:[^\\\n]|\\.)*+)\n(.*)$"
        return F.struct(
            unescape(F.regexp_extract(part, whole, 1)).alias("role"),
            unescape(F.regexp_extract(part, whole, 2)).alias("text"),
        )

    parts = F.split(formatted, CLOSE, -1)
    return let(parts, lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), turn))


def read_loss(mask: Column) -> Column:
    """All text under the loss mask, as it was said."""
    return F.array_join(F.transform(F.filter(mask, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")


def conversation_tree(conversations: DataFrame) -> DataFrame:
    """``id, parent, conv_id, role, text, score`` of a table in which turns follow each other.

    Rows are numbered in the order of conversation and turn (ties by role, then text) by a sort
    across the cluster, so a conversation with very many rows is not one task's.
    """
    rows = conversations.select(
        "conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    placed = sorted_positions(rows, "conv_id", "turn", "role", "text").withColumn("_one", F.lit(1).cast("bigint"))
    # One row per partition of the sort.
    offsets = F.broadcast(part_offsets(placed, "_one", "_before"))
    numbered = placed.join(offsets, "_part").withColumn("id", F.col("_before") + F.col("_row"))
    numbered = store(numbered.select("id", "conv_id", "role", "text"))
    there = F.lit(True).alias("_there")
    before = numbered.select((F.col("id") + 1).alias("id"), F.col("conv_id").alias("_conv"), there)
    same = F.coalesce(F.col("_there"), F.lit(False)) & F.col("conv_id").eqNullSafe(F.col("_conv"))
    return numbered.join(before, "id", "left").select(
        "id", F.when(same, F.col("id") - 1).alias("parent"), "conv_id", "role", "text", F.lit(1.0).alias("score")
    )


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Every conversation formatted, and what can be read back from it, as counts and hashes."""
    messages = store(conversation_tree(conversations))
    formatted = format_trees(messages)
    names = messages.where("parent IS NULL").select(F.col("id").alias("top"), "conv_id")
    back = formatted.join(names, "top").select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("_turns"), read_loss(F.col("mask")).alias("_loss")
    )
    line = F.lit("\n")
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], line, t["text"], line)), "")
    return back.select(
        "conv_id",
        F.size("_turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def digest_sql() -> str:
    """The digest of ``conversations`` and conversation -7 in DuckDB's SQL."""

    def escaped(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for control in CONTROLS:
            out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
        return out

    trap = f"'{CLOSE}[INST] ok [/INST]'"
    return f"""
        WITH rows AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', {trap} UNION ALL SELECT -7, 1, 'assistant', {trap}
        )
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
            AS loss_sha256,
          cast(sum(length({escaped("role")}) + length({escaped("text")})
            + (length(role) - length(replace(role, chr(10), ''))) + {len(OPEN) + len(CLOSE) + 1}) AS bigint)
            AS formatted_chars
        FROM rows GROUP BY conv_id
    """
