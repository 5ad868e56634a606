"""Conversations repaired to legal turns at the least cost, then rendered.

Legal: at most one system turn, first; then user and assistant in turn, the assistant last. A turn may be merged into the one before
it (cost MERGE), get another role (RELABEL; RENAME for a role that is none of the three), and an empty turn may be inserted (INSERT).
The cheapest repair is a shortest path through the automaton whose state is the role of the last turn, found by dynamic programming.

Costs of a run of turns, from each state before it to each state after it, form a small matrix, and runs join by the (min, +)
product. So all turns are sorted over the cluster and cut into blocks of at most BLOCK rows of one conversation: one pass makes the blocks'
matrices, the matrices (16 numbers a block) decide each block's states at both ends, a second pass traces each block's own path. The
order ends with a number of the row, so equal turns and rows without conversation id spread over tasks and blocks like others. No task
holds more of a long conversation than a block and the matrices. The result has one row per segment, and the segments of a
conversation in the order of (block, place) are its rendered text; block numbers ascend but have gaps.

Defined cases: null text is empty; null or unknown roles are renamed; roles are compared without case and surrounding blanks; rows without conversation id form
one conversation; rows without turn number come last, in the order of their texts' hashes; equal turn numbers are ordered by role,
then the first PREFIX characters of the text, then its hash; repeated rows are turns of their own. Among repairs of equal cost: keep before merge before insertion, and system,
user, assistant in this order. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleevenotes.sources.work import shared_folder, written

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
MERGE, RELABEL, RENAME, INSERT = 2, 4, 1, 3
#: Rows of a block at most.
BLOCK = 256
#: Characters of a text that order equal turns.
PREFIX = 128
NEVER = 1 << 40
#: States that may directly come before a turn of each role.
BEFORE = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}


def _steps() -> list[tuple[int, int, int | None, bool, int]]:
    """All moves by one turn: state before, state after, inserted role, merged, cost without relabelling; preferred ones first."""
    out = []
    for after in (SYSTEM, USER, ASSISTANT):
        out += [(before, after, None, False, 0) for before in BEFORE[after]]
        out.append((after, after, None, True, MERGE))
        for extra in (USER, ASSISTANT):
            if extra in BEFORE[after]:
                out += [(before, after, extra, False, INSERT) for before in BEFORE[extra] if before not in BEFORE[after]]
    return out


STEPS = sorted(_steps(), key=lambda s: (s[4], s[1], s[0], s[2] or 0))
#: What must be inserted when the conversation ends in a state.
ENDINGS: dict[int, tuple[int, ...]] = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else START


def relabel_cost(given: int, wanted: int) -> int:
    return 0 if given == wanted else RENAME if given == START else RELABEL


def _forward(roles: list[int], entry: int) -> list[list[tuple[int, tuple | None]]]:
    """For each turn and state after it the least cost from entry and the step that reaches it."""
    costs = [(NEVER, None)] * 4
    costs[entry] = (0, None)
    out = []
    for role in roles:
        now: list[tuple[int, tuple | None]] = [(NEVER, None)] * 4
        for step in STEPS:
            before, after, _, _, cost = step
            c = costs[before][0] + cost + relabel_cost(role, after)
            if c < now[after][0]:
                now[after] = (c, step)
        out.append(now)
        costs = now
    return out


def transfer(roles: list[int]) -> list[int]:
    """The least costs from each state to each state, row by row."""
    return [c for entry in range(4) for c, _ in _forward(roles, entry)[-1]]


def trace(roles: list[int], entry: int, leave: int) -> list[tuple]:
    """The steps of the cheapest path from entry to leave."""
    table, state, out = _forward(roles, entry), leave, []
    for now in reversed(table):
        step = now[state][1]
        out.append(step)
        state = step[0]
    return out[::-1]


def best_states(matrices: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
    """The least cost of the whole conversation, and each block's states at both ends."""
    costs, back = [0, NEVER, NEVER, NEVER], []
    for m in matrices:
        came = [min(range(4), key=lambda b, a=a: costs[b] + m[4 * b + a]) for a in range(4)]
        costs = [costs[came[a]] + m[4 * came[a] + a] for a in range(4)]
        back.append(came)
    state = min((SYSTEM, USER, ASSISTANT), key=lambda s: costs[s] + INSERT * len(ENDINGS[s]))
    total, ends = costs[state] + INSERT * len(ENDINGS[state]), []
    for came in reversed(back):
        ends.append((came[state], state))
        state = came[state]
    return total, ends[::-1]


def numbered(size: int):
    """Adds block and at (the place in its block) to the sorted rows of a partition."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, before = (TaskContext.get().partitionId() << 40) - 1, size, None
        for batch in batches:
            blocks, places = [], []
            for conv in batch.column("conv_id").to_pylist():
                if at == size or conv != before:
                    block, at, before = block + 1, 0, conv
                blocks.append(block)
                places.append(at)
                at += 1
            columns = [batch.column(c) for c in ("conv_id", "turn", "role", "text")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(blocks, pa.int64()), pa.array(places, pa.int32())], ["conv_id", "turn", "role", "text", "block", "at"])

    return number


def _matrix(key: tuple, table: pa.Table) -> pa.Table:
    roles = [role_number(r) for r in table.sort_by("at").column("role").to_pylist()]
    return pa.table({"conv_id": [key[0].as_py()], "block": [key[1].as_py()], "matrix": [transfer(roles)]}, schema=MATRIX)


MATRIX = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("matrix", pa.list_(pa.int64()))])
STATES = pa.schema(
    [("conv_id", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_()), ("cost", pa.int64())]
)
SEGMENTS = pa.schema(
    [("conv_id", pa.int64()), ("block", pa.int64()), ("place", pa.int32()), ("turn", pa.int64()), ("role", pa.string()),
     ("action", pa.string()), ("segment", pa.string()), ("cost", pa.int64())]
)


def _ends(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("block")
    blocks = table.column("block").to_pylist()
    total, ends = best_states(table.column("matrix").to_pylist())
    n = len(blocks)
    columns = [[key[0].as_py()] * n, blocks, [e for e, _ in ends], [x for _, x in ends], [k == n - 1 for k in range(n)], [total] * n]
    return pa.table(columns, schema=STATES)


def header(role: int, first: bool) -> str:
    return f"{'' if first else '<|end|>'}<|{ROLES[role - 1]}|>"


def _rendered(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("at")
    turns, texts = table.column("turn").to_pylist(), [t or "" for t in table.column("text").to_pylist()]
    roles = [role_number(r) for r in table.column("role").to_pylist()]
    entry, leave, last, cost = (table.column(c)[0].as_py() for c in ("entry", "leave", "last", "cost"))
    out, fresh = [], entry == START

    def add(turn: int | None, role: int, action: str, text: str, new: bool) -> None:
        nonlocal fresh
        segment = header(role, fresh) + text if new else "\n" + text
        out.append((key[0].as_py(), key[1].as_py(), len(out), turn, ROLES[role - 1], action, segment, cost))
        fresh = False

    for turn, given, text, (_, after, extra, merged, _) in zip(turns, roles, texts, trace(roles, entry, leave), strict=True):
        if extra is not None:
            add(None, extra, "insert", "", True)
        action = ("merge" if merged else "keep") if given == after else "relabel+merge" if merged else "relabel"
        add(turn, after, action, text, not merged)
    if last:
        for extra in ENDINGS[leave]:
            add(None, extra, "insert", "", True)
        final = out[-1]
        out[-1] = (*final[:6], final[6] + "<|end|>", final[7])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SEGMENTS, strict=True)], schema=SEGMENTS)


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per segment: conv_id, block, place, turn (null: inserted), role, action, segment, cost (of the whole conversation)."""
    folder = shared_folder(conversations.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text",
        F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"),
    )
    order = (
        F.col("conv_id"), F.col("turn").isNull(), F.coalesce("turn", "hash"), F.coalesce("role", F.lit("")), F.substring(text, 1, PREFIX),
        F.col("hash"), F.col("row"),
    )
    kinds = "conv_id long, turn long, role string, text string, block long, at int"
    turns = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(numbered(BLOCK), kinds), folder)
    matrices = turns.select("conv_id", "block", "at", "role").groupBy("conv_id", "block").applyInArrow(
        _matrix, "conv_id long, block long, matrix array<long>"
    )
    states = written(
        written(matrices, folder).groupBy("conv_id").applyInArrow(
            _ends, "conv_id long, block long, entry int, leave int, last boolean, cost long"
        ),
        folder,
    ).withColumnRenamed("conv_id", "c").withColumnRenamed("block", "b")
    same = turns["conv_id"].eqNullSafe(states["c"]) & (turns["block"] == states["b"])
    return turns.join(states, same).drop("c", "b").groupBy("conv_id", "block").applyInArrow(
        _rendered, "conv_id long, block long, place int, turn long, role string, action string, segment string, cost long"
    )
