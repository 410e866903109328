"""Conversation structure repair: cheapest edits by Hirschberg's divide and conquer.

After the stated damage, every row of a conversation has at most one fault (blank, duplicate, truncated).  The edits Keep,
Rerole, Delete and Insert bring the roles into the form (system? (user assistant)+)?.  The state after a row is one of four
(nothing yet, system, user, assistant), so the cost of some rows is a 4 x 4 matrix, and the cheapest edits are found without a
table over all rows: costs from the front of the first half meet costs from the back of the second, the crossing state of
least sum is chosen, and both halves are solved on their own.  Beside its cost every state of the front has the rank
of its least edit string among the four; of equal crossings the one of least rank is on the least string of all, since the
string up to a row ends with that row's edit and so none is the beginning of another.

On Spark the first halvings are between segments of ``SEGMENT`` rows: matrices of segments are combined by ``FAN`` to
matrices of larger stretches until a conversation is one, then the crossings are handed down.  No task holds more than
one segment's codes, one stretch's matrices, or one piece of text, however long a conversation is.  What has one value per
conversation by its contract (the edit string, and the hash of the repaired text, which is sequential) is
made in one task from pieces that stream through it in order.

Defined cases: a null role or text is one space, as is a null id or turn in the text that decides the damage; a null conv_id is
one conversation; rows are ordered by turn (null first), then damaged role, then MD5 of the damaged text, so equal rows are
neighbours and all but the first are duplicates; roles other than by their first letter s, u, a cannot be kept; an empty table has
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.llm.common import pieces, written
from labelwise.llm.runs import running

#: Rows of a segment, and matrices that one task combines.
SEGMENT, FAN = 4096, 1024
PIECE_BYTES = 4 << 20
#: Costs of the edits, the share of damaged rows, what ends a sentence, white space.
RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
DAMAGE = 20
STOPS = ".!?"
WHITE = " \t\n\x0b\x0c\r"

NEVER = 1 << 50
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the next user or assistant turn, and the edits that end a conversation legally.
NEXT = [USER, USER, ASSISTANT, USER]
FINISH = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]
#: A row's code: first letter of its role (0 other, else its state), 4 if truncated, 8 if it has to go.
LETTERS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def _row_table(code: int) -> list[list[tuple[int, str]]]:
    """For one row, from every state to every state: the least cost and its least edits, inserts before the row included."""
    letter, truncated, forced = code & 3, code & 4, code & 8
    table = [[(NEVER, "")] * 4 for _ in range(4)]
    for start in range(4):
        state, cost, edits = start, 0, ""
        for _ in range(3):
            options = [(state, DELETE, "D")]
            if not forced:
                stay = TRUNCATED if truncated else 0
                if letter == SYSTEM and state == NOTHING or letter in (USER, ASSISTANT) and NEXT[state] == letter:
                    options.append((letter, stay, "K"))
                options.append((NEXT[state], RE_ROLE + stay, "R"))
            for end, price, edit in options:
                table[start][end] = min(table[start][end], (cost + price, edits + edit))
            state, cost, edits = NEXT[state], cost + INSERT, edits + "I"
    return table


ROWS = [_row_table(c) for c in range(16)]
#: The same as matrices of (cost, rank of the edits among those from the same state).
_RANKS = [[[(c, sorted(e for _, e in row).index(s)) for c, s in row] for row in table] for table in ROWS]
Matrix = list[list[tuple[int, int]]]


def forward(entry: int, matrices: Iterable[Matrix]) -> list[tuple[int, int]]:
    """From state ``entry`` over all ``matrices``: per state its cost and the rank of its least edits."""
    front = [(0 if s == entry else NEVER, s) for s in range(4)]
    for m in matrices:
        best = [min((front[s][0] + m[s][t][0], front[s][1], m[s][t][1]) for s in range(4)) for t in range(4)]
        order = sorted(b[1:] for b in best)
        front = [(min(b[0], NEVER), order.index(b[1:])) for b in best]
    return front


def backward(leave: int, matrices: list[Matrix]) -> list[int]:
    """Per state the cost of getting over all ``matrices`` to state ``leave``."""
    cost = [0 if s == leave else NEVER for s in range(4)]
    for m in reversed(matrices):
        cost = [min(NEVER, min(m[s][t][0] + cost[t] for t in range(4))) for s in range(4)]
    return cost


def crossings(entry: int, leave: int, matrices: list[Matrix]) -> list[int]:
    """The states between ``matrices`` on the least of the cheapest ways from ``entry`` to ``leave``, by Hirschberg's method."""
    out: list[int] = []
    stack = [(0, len(matrices), entry, leave)]
    while stack:
        lo, hi, start, end = stack.pop()
        if hi - lo < 2:
            out.append(end)
            continue
        mid = (lo + hi) // 2
        front, back = forward(start, matrices[lo:mid]), backward(end, matrices[mid:hi])
        cross = min(range(4), key=lambda s: (front[s][0] + back[s], front[s][1]))
        stack += [(mid, hi, cross, end), (lo, mid, start, cross)]
    return out[:-1]


def last_state(front: list[tuple[int, int]]) -> int:
    """The state after the last row from which a conversation ends at least cost, of equal ones that of the least edits."""
    return min(range(4), key=lambda s: (front[s][0] + FINISH[s][0], front[s][1]))


def edits(codes: bytes, entry: int = NOTHING, leave: int | None = None) -> tuple[int, str]:
    """Cost and edit string of rows with these codes; without ``leave`` up to a legal end."""
    matrices = [_RANKS[c] for c in codes]
    end = last_state(forward(entry, matrices)) if leave is None else leave
    states = [entry, *crossings(entry, end, matrices), end] if codes else [entry]
    steps = [ROWS[c][a][b] for c, a, b in zip(codes, states, states[1:])]
    if leave is None:
        steps.append(FINISH[end])
    return sum(c for c, _ in steps), "".join(e for _, e in steps)


def combined(matrices: list[Matrix]) -> Matrix:
    return [forward(s, matrices) for s in range(4)]


def lines(audit: str, entry: int, rows: Iterable[tuple[str, str]]) -> Iterator[str]:
    """The repaired ``role:text`` lines of rows under their edits."""
    names = {USER: "user", ASSISTANT: "assistant"}
    state, rows = entry, iter(rows)
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield names[state] + ":"
            continue
        role, text = next(rows)
        if edit == "K":
            state = LETTERS[role[0]]
            yield f"{role}:{text}"
        elif edit == "R":
            state = NEXT[state]
            yield f"{names[state]}:{text}"


def damaged(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after the stated damage."""
    space = F.lit(" ")
    shown = [F.coalesce(F.col(f"`{c}`").cast("string"), space) for c in (conv_id, turn)]
    k = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % DAMAGE
    rows = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), k.alias("k"),
                        F.coalesce(F.col(f"`{role}`"), space).alias("role"), F.coalesce(F.col(f"`{text}`"), space).alias("text"))
    broken = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("k <> 0").select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), broken.alias("text"),
                                       F.explode(copies).alias("copy")).drop("copy")


def faults(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """``rows`` numbered in order (row_no, a written table) with blank, cut (truncated but for blank ones) and digest."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    told = rows.select("conv_id", "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("digest"), (bare == "").alias("blank"),
                       ((bare != "") & ~F.right(bare, F.lit(1)).isin(*STOPS)).alias("cut"))
    return running(told, "conv_id", ["turn", "role", "digest"], [], parts, "turns")


_SIZES = ", ".join(f"c{i} bigint, r{i} int" for i in range(16))


def _matrix_columns(ms: list[Matrix]) -> list[pa.Array]:
    cells = [[x for row in m for x in row] for m in ms]
    return list(itertools.chain.from_iterable((pa.array([c[i][0] for c in cells], pa.int64()), pa.array([c[i][1] for c in cells], pa.int32())) for i in range(16)))


def _matrices(flat: list[dict]) -> list[Matrix]:
    return [[[(x[f"c{4 * s + t}"], x[f"r{4 * s + t}"]) for t in range(4)] for s in range(4)] for x in flat]


def _names() -> list[str]:
    return [f"{p}{i}" for i in range(16) for p in ("c", "r")]


def _stretches(matrices: DataFrame, fan: int) -> DataFrame:
    """Matrices of ``fan`` consecutive members each, in one list a stretch: (conv_id, at, members)."""
    member = F.struct(F.col("at").alias("member"), *_names())
    return matrices.groupBy("conv_id", F.floor(F.col("at") / fan).cast("bigint").alias("stretch")).agg(F.sort_array(F.collect_list(member)).alias("members")) \
        .withColumnRenamed("stretch", "at")


def _up(stretches: DataFrame, id_type: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ms = [combined(_matrices(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_matrix_columns(ms)], names=["conv_id", "at", *_names()])

    return stretches.select("conv_id", "at", "members").mapInArrow(run, f"conv_id {id_type}, at bigint, {_SIZES}")


def _down(stretches: DataFrame, ends: DataFrame | None, id_type: str) -> DataFrame:
    """(conv_id, at, entry, leave, is_last) of every member; ``ends`` gives them for the stretches, None: whole conversations."""
    if ends is None:
        given = stretches.select("conv_id", "members", F.lit(NOTHING).alias("entry"), F.lit(-1).alias("leave"), F.lit(True).alias("is_last"))
    else:
        e = ends.select(F.col("conv_id").alias("of"), F.col("at").alias("at_of"), "entry", "leave", "is_last")
        given = stretches.join(e, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("at") == F.col("at_of"))).select("conv_id", "members", "entry", "leave", "is_last")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, members, entry, leave, is_last in zip(*(x.to_pylist() for x in batch.columns)):
                ms = _matrices(members)
                end = last_state(forward(entry, ms)) if leave < 0 else leave
                states = [entry, *crossings(entry, end, ms), end]
                out += [(c, m["member"], a, b, is_last and k == len(ms) - 1) for k, (m, a, b) in enumerate(zip(members, states, states[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(
                [batch.schema.field(0), pa.field("at", pa.int64()), *(pa.field(n, pa.int32()) for n in ("entry", "leave")), pa.field("is_last", pa.bool_())])],
                names=["conv_id", "at", "entry", "leave", "is_last"])

    return given.mapInArrow(run, f"conv_id {id_type}, at bigint, entry int, leave int, is_last boolean")


def _solutions(segments: DataFrame, id_type: str, segment: int, fan: int) -> DataFrame:
    """(conv_id, seg, whole, entry, audit, cost, illegal, first, last) of every segment; whole: it is all of a conversation."""
    schema = f"conv_id {id_type}, seg bigint, whole boolean, entry int, audit string, cost bigint, illegal bigint, first int, last int"

    def shape(codes: bytes) -> tuple[int, int, int]:
        letters = [c & 3 for c in codes]
        legal = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
        return sum(p not in legal for p in zip(letters, letters[1:])), letters[0], letters[-1]

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            out = []
            for c, seg, rows, entry, leave in zip(*(x.to_pylist() for x in batch.columns)):
                codes = bytes(r["code"] for r in rows)
                key = (codes, entry, leave)
                if key not in known:
                    if len(known) > 20_000:
                        known.clear()
                    known[key] = (*reversed(edits(codes, entry, None if leave < 0 else leave)), *shape(codes))
                out.append((c, seg, seg == 0 and len(codes) < segment, entry, *known[key]))
            fields = [batch.schema.field(0).type, pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(fields)],
                                             names=["conv_id", "seg", "whole", "entry", "audit", "cost", "illegal", "first", "last"])

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ms = [combined([_RANKS[r["code"]] for r in rows]) for rows in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_matrix_columns(ms)], names=["conv_id", "at", *_names()])

    parted = (F.col("seg") > 0) | (F.size("rows") >= segment)
    short = segments.where(~parted).select("conv_id", "seg", "rows", F.lit(NOTHING).alias("entry"), F.lit(-1).alias("leave"))
    long = segments.where(parted).select("conv_id", "seg", "rows")
    whole = short.mapInArrow(solve, schema)
    level = written(long.mapInArrow(measure, f"conv_id {id_type}, at bigint, {_SIZES}"), "matrices")
    widest = level.agg(F.max("at")).first()[0]
    if widest is None:  # no long conversation
        return whole
    stretches = []
    while True:
        stretches.append(written(_stretches(level, fan), "stretches"))
        widest = widest // fan
        if widest == 0:
            break
        level = written(_up(stretches[-1], id_type), "matrices")
    ends = None
    for s in reversed(stretches):
        ends = written(_down(s, ends, id_type), "crossings")
    e = ends.select(F.col("conv_id").alias("of"), "at", "entry", F.when(F.col("is_last"), -1).otherwise(F.col("leave")).cast("int").alias("leave"))
    # the last segment's own end is the crossing that was chosen; solving it up to a legal end finds the same one
    given = long.join(e, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("seg") == F.col("at"))).select("conv_id", "seg", "rows", "entry", "leave")
    return whole.unionByName(given.mapInArrow(solve, schema))


def _rendered(rows: DataFrame, solutions: DataFrame, id_type: str, segment: int) -> DataFrame:
    """Rows of all segments under their edits: (conv_id, seg, piece, whole, audit, cost, illegal, first, last, data, digest):
    the digest of a whole conversation's lines, or the lines of a segment in pieces, the other columns with the first."""
    names = ["conv_id", "seg", "row_no", "role", "text", "whole", "entry", "audit", "cost", "illegal", "first", "last"]
    own = rows.select("conv_id", F.floor(F.col("row_no") / segment).cast("bigint").alias("seg"), "row_no", "role", "text")
    both = own.unionByName(solutions.withColumn("row_no", F.lit(-1).cast("bigint")), allowMissingColumns=True).select(*names)
    ordered = both.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "row_no")
    schema = f"conv_id {id_type}, seg bigint, piece bigint, whole boolean, audit string, cost bigint, illegal bigint, first int, last int, data binary, digest string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def flush(id_field):
            types = [id_field, pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)],
                                               names=["conv_id", "seg", "piece", "whole", "audit", "cost", "illegal", "first", "last", "data", "digest"])
            out.clear()
            return batch

        def stream():
            for batch in pieces(batches, "text"):
                yield from zip(*(x.to_pylist() for x in batch.columns), itertools.repeat(batch.schema.field(0).type))

        for _, group in itertools.groupby(stream(), key=lambda r: (r[0], r[1])):
            conv, seg, _, _, _, whole, entry, audit, *told, id_field = next(group)
            made = lines(audit, entry, ((r[3], r[4]) for r in group))
            if whole:
                digest = hashlib.sha256()
                for k, line in enumerate(made):
                    digest.update(("\n" if k else "").encode() + line.encode())
                out.append((conv, seg, 0, True, audit, *told, None, digest.hexdigest()))
                held += len(audit) + 100
            else:
                part, size, piece = [], 0, 0
                for k, line in enumerate(made):
                    part.append(("\n" if k else "").encode() + line.encode())
                    size += len(part[-1])
                    if size > PIECE_BYTES:
                        out.append((conv, seg, piece, False, *([audit, *told] if piece == 0 else [None] * 5), b"".join(part), None))
                        yield flush(id_field)
                        part, size, piece = [], 0, piece + 1
                if part or piece == 0:
                    out.append((conv, seg, piece, False, *([audit, *told] if piece == 0 else [None] * 5), b"".join(part), None))
                    held += size + 100
            if held > PIECE_BYTES:
                yield flush(id_field)
                held = 0
        if out:
            yield flush(id_field)

    return ordered.mapInArrow(run, schema)


def _joined(parts: DataFrame, id_type: str) -> DataFrame:
    """Segments of long conversations, pieces in order, as one row a conversation."""
    ordered = parts.select("conv_id", "seg", "piece", "audit", "cost", "illegal", "first", "last", "data").repartition("conv_id") \
        .sortWithinPartitions("conv_id", "seg", "piece")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        legal = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}

        def stream():
            for batch in pieces(batches, "data"):
                yield from zip(*(x.to_pylist() for x in batch.columns), itertools.repeat(batch.schema.field(0).type))

        for conv, group in itertools.groupby(stream(), key=lambda r: r[0]):
            digest, any_line, audit, cost, illegal, before = hashlib.sha256(), False, [], 0, 0, None
            for _, _, piece, part, price, wrong, first, last, data, id_field in group:
                if piece == 0:
                    audit.append(part)
                    cost, illegal = cost + price, illegal + wrong + (before is not None and (before, first) not in legal)
                    before = last
                if data:
                    digest.update((b"\n" if any_line and piece == 0 else b"") + data)
                    any_line = True
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], id_field), pa.array(["".join(audit)]), pa.array([cost], pa.int64()), pa.array([illegal], pa.int64()), pa.array([digest.hexdigest()])],
                names=["conv_id", "audit", "cost", "illegal", "digest"])

    return ordered.mapInArrow(run, f"conv_id {id_type}, audit string, cost bigint, illegal bigint, digest string")


def _with_faults(rows: DataFrame) -> DataFrame:
    """The numbered rows without their texts, with dup: role and text were seen earlier in the conversation."""
    first = rows.where("NOT blank").groupBy(F.col("conv_id").alias("of"), F.col("role").alias("role_of"), F.col("digest").alias("digest_of")).agg(
        F.min("row_no").alias("first_no"), F.count("*").alias("n")).where("n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("role_of")) & (F.col("digest") == F.col("digest_of"))
    letter = F.substring("role", 1, 1)
    code = F.when(letter == "s", SYSTEM).when(letter == "u", USER).when(letter == "a", ASSISTANT).otherwise(0)
    slim = rows.select("conv_id", "turn", "row_no", "role", "digest", "blank", "cut")
    marked = slim.join(first, same & ~F.col("blank"), "left").withColumn("dup", F.coalesce(F.col("row_no") > F.col("first_no"), F.lit(False)))
    return marked.select("conv_id", "turn", "row_no", "blank", "dup", (F.col("cut") & ~F.col("dup")).alias("cut"),
                         (code + F.when(F.col("cut") & ~F.col("dup"), 4).otherwise(0) + F.when(F.col("blank") | F.col("dup"), 8).otherwise(0)).alias("code"))


def repair(rows: DataFrame, segment: int = SEGMENT, fan: int = FAN, parts: int | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.  Reads ``rows`` once, in order; every shuffle after that but the one of the repaired texts is of codes."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    numbered = faults(rows, parts)
    marked = written(_with_faults(numbered), "faults")
    counts = marked.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        F.count_if("blank").alias("blank"), F.count_if("dup").alias("duplicate"), F.count_if("cut").alias("truncated"))
    segments = marked.groupBy("conv_id", F.floor(F.col("row_no") / segment).cast("bigint").alias("seg")).agg(
        F.sort_array(F.collect_list(F.struct("row_no", "code"))).alias("rows"))
    solutions = written(_solutions(written(segments, "segments"), id_type, segment, fan), "edits")
    made = written(_rendered(numbered, solutions, id_type, segment), "repaired")
    done = made.where("whole").select("conv_id", "audit", "cost", "illegal", "digest").unionByName(_joined(made.where("NOT whole"), id_type))
    done = done.withColumnRenamed("conv_id", "of")
    return counts.join(done, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("digest").alias("repaired_sha256"))


def repair_damaged(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **options) -> DataFrame:
    """:func:`repair` of the damaged ``turns``, with a row for every conversation of ``turns``, also if no row is left of it."""
    found = repair(damaged(turns, conv_id, turn, role, text), **options).withColumnRenamed("conv_id", "of")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    every = turns.select(F.col(f"`{conv_id}`").alias("conv_id")).distinct()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
