"""Chat formatting with minimum-cost role repair.

A legal conversation is: at most one system turn, then user and assistant in turn, ending with the assistant.  Whatever is
recorded is brought into that form at least cost by dynamic programming over the automaton of legal turns: a turn may keep
its role, be given another (relabel), be appended to the turn before it (merge), and empty turns may be put in between
(insert).  The repaired sequence is then rendered.

A turn's effect on the automaton is a small cost matrix, and matrices combine (minimum of sums) in any grouping.  So a
conversation is split wherever range partitioning by (conversation, turn) splits it: each part gives its matrix, the parts
of one conversation (at most the number of partitions) agree on the states between them, and every part is repaired and
rendered on its own.  No task holds more than a part, however long a conversation is.  Most conversations have one part.

Defined cases: unknown or null roles may become any role at a small cost; null texts are empty; turns are ordered by turn
(null first), then role and text, and repeated rows are separate turns; a null conv_id is a conversation of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.llm.common import written

# Role names and their usual synonyms, and the costs of repairs.
ROLES = ["system", "user", "assistant"]
SYNONYMS = {"human": "user", "customer": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant",
            "developer": "system"}
MERGE, INSERT, RELABEL, NAME = 1, 3, 2, 1
TEMPLATE = "<|{role}|>\n{text}<|end|>\n"
MERGED_BY = "\n"

NEVER = 1 << 40
WHOLE_TURNS = 20_000
START, SYSTEM, USER, ASSISTANT = range(4)
#: Empty turns to insert between a state and the next turn's role, where that is possible.
BETWEEN: dict[tuple[int, int], list[int]] = {
    (START, SYSTEM): [], (START, USER): [], (START, ASSISTANT): [USER], (SYSTEM, USER): [], (SYSTEM, ASSISTANT): [USER],
    (USER, ASSISTANT): [], (USER, USER): [ASSISTANT], (ASSISTANT, USER): [], (ASSISTANT, ASSISTANT): [USER]}
#: Empty turns that end a conversation legally.
FINISH = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}


def state_of(role: str | None) -> int:
    """The state that a recorded role names; START if none."""
    name = (role or "").strip().lower()
    name = SYNONYMS.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else START


def step_cost(before: int, recorded: int, after: int) -> tuple[int, bool]:
    """Cost of a turn recorded as ``recorded`` that stands as ``after``, and whether it is merged."""
    change = 0 if recorded == after else NAME if recorded == START else RELABEL
    put = INSERT * len(BETWEEN[before, after]) if (before, after) in BETWEEN else NEVER
    return (change + MERGE, True) if before == after and put >= MERGE else (change + put, False)


_COST = {(a, r, b): step_cost(a, r, b) for a in range(4) for r in range(4) for b in (SYSTEM, USER, ASSISTANT)}


def matrix(recorded: list[int]) -> list[list[int]]:
    """Least cost of some turns from every state to every state."""
    out = []
    for start in range(4):
        cost = [0 if s == start else NEVER for s in range(4)]
        for r in recorded:
            cost = [NEVER] + [min(cost[a] + _COST[a, r, b][0] for a in range(4)) for b in (SYSTEM, USER, ASSISTANT)]
        out.append([min(c, NEVER) for c in cost])
    return out


def repair(recorded: list[int], entry: int = START, leave: int | None = None) -> tuple[int, list[tuple[int, bool, list[int]]], int]:
    """Least-cost repair from state ``entry`` to ``leave`` (None: to a legal end): cost, and per turn its role, whether it is
    merged and what is inserted before it, and the last state.  Ties go to the smaller state."""
    cost = [0 if s == entry else NEVER for s in range(4)]
    back: list[list[int]] = []
    for r in recorded:
        come, new = [0] * 4, [NEVER] * 4
        for b in (SYSTEM, USER, ASSISTANT):
            come[b] = min(range(4), key=lambda a: (cost[a] + _COST[a, r, b][0], a))
            new[b] = min(NEVER, cost[come[b]] + _COST[come[b], r, b][0])
        back.append(come)
        cost = new
    last = leave if leave is not None else min(range(4), key=lambda s: (cost[s] + INSERT * len(FINISH[s]), s))
    total = cost[last] + (INSERT * len(FINISH[last]) if leave is None else 0)
    states, s = [last], last
    for come in reversed(back):
        s = come[s]
        states.append(s)
    states.reverse()
    turns = []
    for a, r, b in zip(states, recorded, states[1:]):
        merged = _COST[a, r, b][1]
        turns.append((b, merged, [] if merged else BETWEEN[a, b]))
    return total, turns, last


def render(texts: list[str], turns: list[tuple[int, bool, list[int]]], finish: list[int], open_before: bool, open_after: bool) -> str:
    """The repaired turns as text.  ``open_before``: the first turn goes on a turn of the part before if it is merged;
    ``open_after``: the next part may go on the last turn, so its end mark is left to it."""
    head, tail = TEMPLATE.split("{text}")
    out, is_open = [], open_before
    for text, (role, merged, put) in zip(texts, turns):
        if merged:
            out += [MERGED_BY, text]
            continue
        if is_open:
            out.append(tail)
        out += [TEMPLATE.format(role=ROLES[p - 1], text="") for p in put]
        out += [head.format(role=ROLES[role - 1]), text]
        is_open = True
    if not open_after:
        if is_open:
            out.append(tail)
        out += [TEMPLATE.format(role=ROLES[p - 1], text="") for p in finish]
    return "".join(out)


def _runs(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that agree on the first columns and stand together."""
    now, rows = None, []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if r[:n_keys] != now:
                if rows:
                    yield now, rows
                now, rows = r[:n_keys], []
            rows.append(r[n_keys:])
    if rows:
        yield now, rows


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         parts: int | None = None, whole_turns: int = WHOLE_TURNS) -> DataFrame:
    """(conv_id, part, n_turns, n_out, n_merged, n_relabelled, n_inserted, cost, rendered): one row per conversation, or
    one per part of a conversation of more than ``whole_turns`` turns that spans partitions; ``rendered`` in the order of
    ``part`` is then the whole."""
    spark = turns.sparkSession
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["conv_id"]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([part] * b.num_rows, pa.int32()), pa.array(range(at, at + b.num_rows), pa.int64()),
                                              b.column(2), b.column(3)], ["conv_id", "part", "pos", "role", "text"])
            at += b.num_rows

    ranged = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        number, f"conv_id {kind}, part int, pos long, role string, text string"), "chat-turns")
    # conversations that a splitter cut, a few per partition: the short ones are put together again, the long ones stay in parts
    cut = ranged.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count("*").alias("k")).where("a < b")
    cut = written(cut.select(F.col("conv_id").alias("c"), "a", (F.col("k") > whole_turns).alias("long")), "chat-cut")
    ranged = ranged.join(cut, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", F.when(~F.col("long"), F.col("a")).otherwise(F.col("part")).alias("part"), F.struct("part", "pos").alias("pos"), "role", "text", "long")
    split = ranged.where("long")

    def matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(*key, [c for row in matrix([state_of(r[0]) for r in rows_]) for c in row]) for key, rows_ in _runs(batches, 2)]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa_kind(kind)), pa.array([f[1] for f in found], pa.int32()),
                                          pa.array([f[2] for f in found], pa.list_(pa.int64()))], ["conv_id", "part", "m"])

    def agree(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv,), rows_ in _runs(batches, 1):
            cost, back = [0, NEVER, NEVER, NEVER], []
            for _, m in rows_:
                come = [min(range(4), key=lambda a: (cost[a] + m[4 * a + b], a)) for b in range(4)]
                back.append(come)
                cost = [min(NEVER, cost[come[b]] + m[4 * come[b] + b]) for b in range(4)]
            state = min(range(4), key=lambda s: (cost[s] + INSERT * len(FINISH[s]), s))
            for k in range(len(rows_) - 1, -1, -1):
                entry = back[k][state]
                out.append((conv, rows_[k][0], entry, state, k == 0, k == len(rows_) - 1))
                state = entry
        columns = list(zip(*out)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa_kind(kind), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()))],
                                         ["conv_id", "part", "entry", "leave", "first", "last"])

    maps = split.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos").select("conv_id", "part", "role").mapInArrow(
        matrices, f"conv_id {kind}, part int, m array<long>")
    states = maps.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        agree, f"conv_id {kind}, part int, entry int, leave int, first boolean, last boolean")
    states = written(states, "chat-states").withColumnRenamed("conv_id", "c").withColumnRenamed("part", "p")
    joined = ranged.join(states, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", "part", "role", "text", "entry", "leave", "first", "last", "pos")

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, rows_ in _runs(batches, 2):
            entry, leave, first, last = rows_[0][2:]
            whole = entry is None
            recorded = [state_of(r[0]) for r in rows_]
            end = whole or last
            cost, turns_, state = repair(recorded, START if whole else entry, None if whole else leave)
            tail = FINISH[state] if end else []
            cost += INSERT * len(tail) if not whole else 0
            merged = sum(m for _, m, _ in turns_)
            put = sum(len(p) for _, _, p in turns_) + len(tail)
            relabelled = sum(r != b for r, (b, _, _) in zip(recorded, turns_))
            out.append((*key, len(rows_), len(rows_) - merged + put, merged, relabelled, put, cost,
                        render([r[1] or "" for r in rows_], turns_, tail, not whole and not first, not end)))
            if len(out) >= 2000:
                yield record(out)
                out = []
        if out:
            yield record(out)

    def record(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa_kind(kind)), pa.array(columns[1], pa.int32())] + [pa.array(c, pa.int64()) for c in columns[2:8]]
                                          + [pa.array(columns[8], pa.string())],
                                          ["conv_id", "part", "n_turns", "n_out", "n_merged", "n_relabelled", "n_inserted", "cost", "rendered"])

    return joined.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos").drop("pos").mapInArrow(
        finish, f"conv_id {kind}, part int, n_turns long, n_out long, n_merged long, n_relabelled long, n_inserted long, cost long, rendered string")


def pa_kind(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
