"""Chat formatting: the roles of a transcript's turns by a hidden Markov model, then canonical rendering.

A turn shows a speaker marker, or none, and features of its lines. Emissions, starts and transitions are counted over
the conversations of the training folds. Decoding is exact Viterbi in blocks: the best path through a block of turns,
for each state before it and each at its end, is a small matrix; matrices of a block's parts combine by (max, +), so a
very long conversation becomes a tree of blocks, solved upwards and then, with the states at its ends known,
downwards. Blocks are cut by a turn's place in its conversation, counted over a range sort of all turns, so that no
numbering of turns, nor a lack of one, makes a block longer. Only feature codes are shuffled by conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, fold, materialise

#: Turns of a block, and blocks of the next block; the most roles told apart, rarer ones being OTHER; the training folds.
BLOCK, ROLES, OTHER, FOLDS, HELD = 64, 64, "other", 4, 2
#: Speaker markers by the role they speak for.
MARKERS = {"user": "user|human|q|question|prompter|customer|client|me", "assistant": "assistant|ai|bot|a|answer|agent|model|gpt", "system": "system|instruction|instructions|context|note"}
HEAD = r"^\s*(?:#{1,4}\s*|<\|?|\[|\*{1,2}|>\s*)?(?i:(KINDS))(?:\|?>|\]|\*{1,2})?\s*(?::|-|\n|\]|\|?>)\s*"
SIZES = (5, 8, 4, 2)  # values of each feature: marker (the last: another name), length, lines, question
COUNTED, MATCH = 0.5, 8.0


def marker_pattern(kind: str | None = None) -> str:
    return HEAD.replace("KINDS", MARKERS[kind] if kind else "|".join(MARKERS.values()))


def features(text: Column) -> list[Column]:
    """marker: 0 none, then 1.. in the order of MARKERS; length: log2 of characters / 16; lines; ends in a question."""
    marker = F.lit(0)
    for i, kind in reversed(list(enumerate(MARKERS, 1))):
        marker = F.when(text.rlike(marker_pattern(kind)), i).otherwise(marker)
    length = F.least(F.lit(7), F.greatest(F.lit(0), F.floor(F.log2(F.length(text) / 16 + 1)))).cast("int")
    lines = F.least(F.lit(3), F.size(F.split(text, "\n")) - 1)
    return [marker, length, lines, text.rlike(r"\?\s*$").cast("int")]


def turns(talk: DataFrame) -> DataFrame:
    """Written rows (ck, pos, turn, x, code, role, learn): one for each different (conversation, turn, text), by place from 0."""
    text = F.coalesce("text", F.lit(""))
    code = F.lit(0)
    for size, f in zip(SIZES, features(text), strict=True):
        code = code * size + f
    role = F.col("role") if "role" in talk.columns else F.lit(None).cast("string")
    learn = F.coalesce(fold(F.col("conv_id"), FOLDS) != HELD, F.lit(False))
    rows = talk.select(key(talk).alias("ck"), turn_of(talk).alias("turn"), F.xxhash64(text).alias("x"), code.cast("int").alias("code"), role.alias("role"), learn.alias("learn"))
    return _placed(rows.groupBy("ck", "turn", "x").agg(F.min("code").alias("code"), F.min("role").alias("role"), F.first("learn").alias("learn")))


def _placed(rows: DataFrame) -> DataFrame:
    """rows with pos: the number of rows of the same ck before (turn, x); a conversation may lie across many partitions."""
    order, kept = ["ck", "turn", "x"], [c for c in rows.columns if c != "pos"]
    fields = rows.sparkSession.createDataFrame([], rows.select(kept).schema).select("*", F.lit(0).alias("part"), F.lit(0).cast("long").alias("i")).schema

    def number(batches):
        part, now, i = TaskContext.get().partitionId(), None, 0
        for b in batches:
            at = []
            for ck in b.column("ck").to_pylist():
                now, i = ck, i + 1 if ck == now else 0
                at.append(i)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], names=[*b.schema.names, "part", "i"])

    cut = materialise(rows.select(kept).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, fields))
    # Only a partition's first and last conversation can go on elsewhere: two rows a partition.
    ends = cut.groupBy("part").agg(F.min("ck").alias("a"), F.max("ck").alias("b"))
    ends = ends.select(F.explode(F.array("a", "b")).alias("ck")).distinct()
    parts = cut.select("ck", "part").join(F.broadcast(ends), "ck").groupBy("ck", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("ck").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("ck", "part", F.sum("n").over(before).alias("offset")).where("offset is not null")
    out = materialise(cut.join(F.broadcast(offsets), ["ck", "part"], "left").select("ck", (F.col("i") + F.coalesce("offset", F.lit(0))).alias("pos"), *kept[1:]))
    discard(cut)
    return out


def key(talk: DataFrame) -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))


def turn_of(talk: DataFrame) -> Column:
    return F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long"))


class Hmm:
    """roles in order; step[code] is the matrix (state before, state) of log probabilities; the last row is the start."""

    def __init__(self, roles: list[str], moves: np.ndarray, seen: np.ndarray):
        k = len(roles)
        self.roles = roles
        move = np.log((moves + COUNTED) / (moves + COUNTED).sum(axis=1, keepdims=True))
        out = np.zeros((k, *SIZES))
        for axis, size in enumerate(SIZES, 1):
            other = tuple(a for a in range(1, 5) if a != axis)
            n = seen.sum(axis=other) + COUNTED
            if axis == 1:  # a marker speaks for its role even where training texts have none
                for i, kind in enumerate(MARKERS, 1):
                    if kind in roles:
                        n[roles.index(kind), i] += MATCH
            shape = [k, 1, 1, 1, 1]
            shape[axis] = size
            out = out + np.log(n / n.sum(axis=1, keepdims=True)).reshape(shape)
        self.step = move[None] + out.reshape(k, -1).T[:, None, :]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple]:
    """The rows of a sorted partition, as columns, by runs of equal first `keys` columns."""
    table = pa.Table.from_batches(list(batches)) if batches else None
    if table is None or not table.num_rows:
        return
    cols = [c.to_pylist() for c in table.columns]
    start = 0
    heads = list(zip(*cols[:keys], strict=True))
    for i in range(1, len(heads) + 1):
        if i == len(heads) or heads[i] != heads[start]:
            yield tuple(c[start:i] for c in cols)
            start = i


def _batches(batches):
    got = [b for b in batches if b.num_rows]
    return got


def _together(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*by, *order)


def fit(rows: DataFrame) -> Hmm | None:
    """Counts over all training turns with a role: first turns, moves between neighbouring ones, and features.

    The ROLES - 1 most frequent roles, and of equal ones the first by name, are states; where there are more than ROLES,
    the others share the state OTHER. Without training turns there is no model.
    """
    learn = rows.where("learn and role is not null").select("ck", "pos", "code", "role")
    often = [r["role"] for r in learn.groupBy("role").count().orderBy(F.desc("count"), "role").limit(ROLES + 1).collect()]
    if not often:
        return None
    roles = sorted(often if len(often) <= ROLES else {*often[: ROLES - 1], OTHER})
    k, other = len(roles), roles.index(OTHER) if OTHER in roles else -1
    number = F.create_map(*(x for i, r in enumerate(roles) for x in (F.lit(r), F.lit(i))))
    learn = learn.select("ck", "pos", "code", F.coalesce(number[F.col("role")], F.lit(other)).alias("s"))
    seen, moves = np.zeros((k, int(np.prod(SIZES)))), np.zeros((k + 1, k))
    for r in learn.groupBy("s", "code").count().collect():
        seen[r["s"], r["code"]] = r["count"]
    for r in learn.where("pos = 0").groupBy("s").count().collect():
        moves[k, r["s"]] = r["count"]
    # Places are unique, so that no key of this join is hot, however long a conversation is.
    before = learn.select("ck", (F.col("pos") + 1).alias("pos"), F.col("s").alias("t"))
    for r in learn.join(before, ["ck", "pos"]).groupBy("t", "s").count().collect():
        moves[r["t"], r["s"]] = r["count"]
    return Hmm(roles, moves, seen.reshape(k, *SIZES))


def _block(i: Column) -> Column:
    return F.floor(F.greatest(i, F.lit(0)) / BLOCK).cast("long")


def _product(parts: list[np.ndarray]) -> np.ndarray:
    """(max, +) product; every part maps the k states (and, in its last row, the start) to k states."""
    out = parts[0]
    for m in parts[1:]:
        out = (out[:, :, None] + m[None, :-1, :]).max(axis=1)
    return out


def _path(parts: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """The states after each part on the best path from `enter` (the last row's index: the start) to `leave` (-1: any)."""
    score = parts[0][enter]
    back = []
    for m in parts[1:]:
        all_ = score[:, None] + m[:-1]
        back.append(all_.argmax(axis=0))
        score = all_.max(axis=0)
    at = [int(score.argmax()) if leave < 0 else leave]
    for b in reversed(back):
        at.append(int(b[at[-1]]))
    return at[::-1]


def decode(rows: DataFrame, hmm: Hmm) -> DataFrame:
    """Rows (ck, turn, x, role_pred) of rows of turns(): the most probable roles of each conversation as a whole."""
    k = len(hmm.roles)
    send = rows.sparkSession.sparkContext.broadcast(hmm)
    now = rows.select("ck", _block(F.col("pos")).alias("block"), "pos", "turn", "x", "code")
    levels = [now]

    def up(matrix):
        def run(batches):
            for ck, block, *_, last in _runs(_batches(batches), 2):
                m = _product([matrix(v) for v in last])
                yield pa.RecordBatch.from_arrays([pa.array(ck[:1]), pa.array(block[:1], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["ck", "part", "m"])

        return run

    def code_matrix(c):
        return send.value.step[c]

    def own_matrix(m):
        return np.array(m).reshape(k + 1, k)

    upper = materialise(_together(now, ["ck", "block"], ["pos"]).mapInArrow(up(code_matrix), "ck string, part bigint, m array<double>"))
    while True:
        levels.append(upper.select("ck", _block(F.col("part")).alias("block"), "part", "m"))
        if (upper.agg(F.max("part")).first()[0] or 0) == 0:
            break
        upper = materialise(_together(levels[-1], ["ck", "block"], ["part"]).mapInArrow(up(own_matrix), "ck string, part bigint, m array<double>"))
    # The ends of the topmost blocks are free; each level's path gives the ends of the blocks below.
    ends = levels[-1].select("ck", F.col("part").alias("block"), F.lit(k).alias("enter"), F.lit(-1).alias("leave"))
    for level in reversed(range(len(levels) - 1)):
        rows_of = levels[level]
        matrix = code_matrix if level == 0 else own_matrix
        width = len(rows_of.columns)

        kept = [("turn", pa.int64()), ("x", pa.int64())] if level == 0 else []

        def down(batches, matrix=matrix, width=width, kept=kept):
            for cols in _runs(_batches(batches), 2):
                enter, leave = cols[width][0], cols[width + 1][0]
                at = _path([matrix(v) for v in cols[width - 1]], enter, leave)
                own = [pa.array(cols[3 + i], t) for i, (_, t) in enumerate(kept)]
                states = [pa.array(v, pa.int32()) for v in ([enter, *at[:-1]], at)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[2], pa.int64()), *own, *states], names=["ck", "part", *(n for n, _ in kept), "enter", "leave"])

        joined = rows_of.join(ends, ["ck", "block"]).select(*rows_of.columns, "enter", "leave")
        schema = f"ck string, part bigint, {''.join(f'{n} bigint, ' for n, _ in kept)}enter int, leave int"
        got = _together(joined, ["ck", "block"], ["pos" if level == 0 else "part"]).mapInArrow(down, schema)
        if level == 0:
            names = F.array(*map(F.lit, hmm.roles))
            return got.select("ck", "turn", "x", names[F.col("leave")].alias("role_pred"))
        ends = materialise(got.select("ck", F.col("part").alias("block"), "enter", "leave"))
    raise AssertionError("the lowest level returns")


def render(role: Column, text: Column) -> Column:
    """A canonical turn: the role's tag, the text without its speaker marker, and an end tag."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim(F.regexp_replace(text, F.lit(marker_pattern()), F.lit(""))), F.lit("\n<|end|>"))


def parse(talk: DataFrame, hmm: Hmm | None = None) -> DataFrame:
    """Rows (conv_id, turn, held_out, role_pred, rendered) of every row of talk (conv_id, turn, text and, to learn, role).

    Turns are in order of turn (null: 0), then of a hash of the text; repeated rows are one turn and get the same role.
    A null text is empty; null conv_ids are one conversation, in which nothing is learnt. Without training turns every
    role is `user`; an empty table gives no rows. Further columns of talk are ignored.
    """
    rows = turns(talk)
    hmm = hmm or fit(rows) or Hmm(["user"], np.ones((2, 1)), np.ones((1, *SIZES)))
    roles = materialise(decode(rows, hmm))
    discard(rows)
    text = F.coalesce("text", F.lit(""))
    held = F.coalesce(fold(F.col("conv_id"), FOLDS) == HELD, F.lit(False))
    left = talk.select("conv_id", "turn", text.alias("text"), held.alias("held_out"), key(talk).alias("ck"), turn_of(talk).alias("t"), F.xxhash64(text).alias("x"))
    out = left.join(roles.withColumnRenamed("turn", "t"), ["ck", "t", "x"])
    return out.select("conv_id", "turn", "held_out", "role_pred", render(F.col("role_pred"), F.col("text")).alias("rendered"))
