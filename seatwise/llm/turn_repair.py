"""Cheapest repair of conversations whose turns are blank, repeated, cut off or out of order.

A repaired conversation has roles with the initials ``(s?(ua)+)?``. Edits: a turn is kept (0), gets the role user
or assistant (3), or is deleted (4, required for blank and repeated ones); an empty user or assistant turn
is inserted anywhere (3); a cut-off turn that stays costs 3 more. Of the cheapest edits those with the
ASCII-least string of initials (D, I, K, R) are taken.

That is a walk through four states: at the start, after a system turn, after a user's, after an assistant's.
Costs to the end are computed backwards and edits chosen forwards. Of the backward vectors
only every sqrt(n)-th is stored; the walk computes those between two checkpoints again. A long conversation is
cut into blocks of at most ``BLOCK`` turns. A block is a (min, +) matrix over the states; the vectors at block ends,
from the last to the first, are checkpoints as well. With its end vector each block maps any start
state to an end state; so the start states follow from the first to the last, and blocks are walked in
parallel. Tasks stream sorted rows and hold one block; texts are shuffled once, for the result.

Turns are ordered by turn number (null first), then role, then the text's hash; equal rows of that order are equal.
A null role or text is an empty one, a null conversation id a conversation of its own. A turn counts as often as
``copies`` says; a conversation whose turns all have 0 copies is empty, costs nothing and stays in the result.
Texts of any length are hashed in Spark, never held together. Other columns are not read. No turns, no rows.

The hash of a whole repaired conversation is a chain over its texts in order, so one task reads them as a
stream, however long the conversation; its memory doesn't grow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import stored

BLOCK = 1024  # a power of two
WHITE = " \t\n\x0b\x0c\r"
FREE, CUT_OFF, MUST_GO = range(3)
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWING = (USER, USER, ASSISTANT, USER)  # the state after an insert or a change of role
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
NEVER = 1 << 60
END = (0, 6, 3, 0)  # inserts that lead from each state to an accepted end
LAST_INSERTS = (0, 2, 1, 0)
EDITS = "conv_id long, at long, turn long, role string, hash binary, initial string, fault int, edits string, roles array<string>"

Vector = tuple[int, int, int, int]


def _options(kind: tuple[str, int], after: Vector, state: int) -> tuple[int, int, int]:
    """Costs to the end if the turn is deleted, kept, or gets another role."""
    initial, fault = kind
    more = 3 if fault == CUT_OFF else 0
    keep = KEPT.get(initial, (None,) * 4)[state]
    stays = fault != MUST_GO
    return (
        4 + after[state],
        more + after[keep] if stays and keep is not None else NEVER,
        3 + more + after[FOLLOWING[state]] if stays else NEVER,
    )


@lru_cache(1 << 16)
def _before(kind: tuple[str, int], after: Vector) -> Vector:
    """Costs to the end before a turn, inserts in front of it included."""
    own = [min(_options(kind, after, s)) for s in range(4)]
    one = [3 + own[FOLLOWING[s]] for s in range(4)]
    two = [6 + own[FOLLOWING[FOLLOWING[s]]] for s in range(4)]
    return tuple(min(NEVER, *costs) for costs in zip(own, one, two))


@lru_cache(1 << 16)
def _choice(kind: tuple[str, int], after: Vector, state: int) -> tuple[str, int, tuple[str | None, ...]]:
    """The ASCII-least of the cheapest edits at a turn, the state after them, and the roles they leave."""
    before, edits, roles = _before(kind, after), "", []
    while True:
        delete, keep, change = _options(kind, after, state)
        following = FOLLOWING[state]
        if delete == before[state]:
            return edits + "D", state, tuple(roles)
        if 3 + before[following] == before[state]:
            edits, state = edits + "I", following
            roles.append(NAMES[state])
        elif keep == before[state]:
            return edits + "K", KEPT[kind[0]][state], (*roles, None)
        else:
            assert change == before[state]
            return edits + "R", following, (*roles, NAMES[following])


def _level(vector: Vector) -> Vector:
    """Only differences matter for the choice; small numbers make the caches hit."""
    least = min(vector)
    return tuple(NEVER if v >= NEVER else v - least for v in vector)


def block_matrix(kinds: list[tuple[str, int]]) -> list[Vector]:
    """Cost from each state before the block to each state after it."""
    columns = []
    for end in range(4):
        vector = tuple(0 if s == end else NEVER for s in range(4))
        for kind in reversed(kinds):
            vector = _before(kind, vector)
        columns.append(vector)
    return list(zip(*columns))


def times(matrix: list[Vector], vector: Vector) -> Vector:
    return tuple(min(NEVER, *(c + v for c, v in zip(row, vector))) for row in matrix)


def walk(kinds: list[tuple[str, int]], end: Vector, state: int) -> Iterator[tuple[str, int, tuple[str | None, ...]]]:
    """The edits at each turn of a block, where ``end`` has the costs after it."""
    step = isqrt(len(kinds)) + 1
    checkpoints, vector = {len(kinds): _level(end)}, _level(end)
    for at in range(len(kinds) - 1, -1, -1):
        vector = _level(_before(kinds[at], vector))
        if at % step == 0:
            checkpoints[at] = vector
    for start in range(0, len(kinds), step):
        stop = min(start + step, len(kinds))
        after = [checkpoints[stop]]
        for at in range(stop - 1, start, -1):
            after.append(_level(_before(kinds[at], after[-1])))
        for at in range(start, stop):
            edits, state, roles = _choice(kinds[at], after[stop - 1 - at], state)
            yield edits, state, roles


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of sorted batches by their first ``keys`` columns."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(rows, key=lambda row: row[:keys])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 4096:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _sorted(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """``df`` dealt by ``by`` and sorted in its partitions, for a task that streams it."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *by).sortWithinPartitions(*order)


def _same_conversation(one: DataFrame, other: DataFrame, *more: str):
    condition = one["conv_id"].eqNullSafe(other["conv_id"])
    for name in more:
        condition &= one[name].eqNullSafe(other[name])
    return condition


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Stored turns without their texts, numbered by ``at`` in order, each with its fault.

    ``at`` grows with the order over all conversations; ``block`` is a stretch of it in one partition.
    """
    text = F.rtrim(F.col("text"), F.lit(WHITE))
    narrow = turns.where("copies > 0").select(
        "conv_id", "turn", "role", "hash", F.substring("role", 1, 1).alias("initial"), (text == "").alias("blank"),
        (~F.substring(text, -1, 1).isin(".", "!", "?")).alias("cut_off"),
        F.monotonically_increasing_id().alias("input"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
    )
    # the input's own order parts equal rows, so that a turn which repeats very often is spread over tasks
    order = ["conv_id", "turn", "role", "hash", "input", "copy"]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.drop("input", "copy").withColumn("at", F.monotonically_increasing_id()), "turns")
    told = placed.where("NOT blank").groupBy("conv_id", "role", "hash").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    again = told.where("n > 1").drop("n")
    marked = placed.join(again, _same_conversation(placed, again, "role", "hash"), "left").select(
        placed["*"], (~F.col("blank") & (F.col("at") > F.coalesce("first", "at"))).alias("duplicate")
    )
    return marked.withColumn("block", F.floor(F.col("at") / BLOCK))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("costs", pa.list_(pa.int64()))])
    rows = (
        (*key, [c for row in block_matrix([(r[3], r[4]) for r in own]) for c in row]) for key, own in _groups(batches, 2)
    )
    yield from _in_batches(rows, schema)


def _end_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs to the end after each block; blocks come from the last to the first."""
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def rows() -> Iterator[tuple]:
        for _, blocks in _groups(batches, 1):
            vector = END
            for conv, block, costs in blocks:
                yield conv, block, list(vector)
                vector = times([tuple(costs[i : i + 4]) for i in range(0, 16, 4)], vector)

    yield from _in_batches(rows(), schema)


def _state_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after a block for each state before it."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("block", pa.int64()), ("ends", pa.list_(pa.int64())), ("states", pa.list_(pa.int32()))]
    )

    def rows() -> Iterator[tuple]:
        for key, own in _groups(batches, 2):
            own = list(own)
            ends = tuple(own[0][5])
            kinds = [(r[3], r[4]) for r in own]
            states = []
            for start in range(4):
                for _, state, _ in walk(kinds, ends, start):
                    pass
                states.append(state)
            yield *key, list(ends), states

    yield from _in_batches(rows(), schema)


def _start_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each block; blocks come from the first to the last."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("block", pa.int64()), ("ends", pa.list_(pa.int64())), ("start", pa.int32()), ("final", pa.bool_())]
    )

    def rows() -> Iterator[tuple]:
        for _, blocks in _groups(batches, 1):
            state, waiting = START, None
            for conv, block, ends, states in blocks:
                if waiting:
                    yield *waiting, False
                waiting = (conv, block, ends, state)
                state = states[state]
            yield *waiting, True

    yield from _in_batches(rows(), schema)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("conv_id", pa.int64()), ("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("hash", pa.binary()),
         ("initial", pa.string()), ("fault", pa.int32()), ("edits", pa.string()), ("roles", pa.list_(pa.string()))]
    )

    def rows() -> Iterator[tuple]:
        for _, own in _groups(batches, 2):
            own = list(own)
            ends, start, final = own[0][9:12]
            found = list(walk([(r[3], r[4]) for r in own], tuple(ends), start))
            for n, (row, (edits, state, roles)) in enumerate(zip(own, found)):
                conv, _, at, initial, _, turn, role, hashed, fault = row[:9]
                roles = [role if r is None else r for r in roles]
                if final and n == len(own) - 1:
                    edits += "I" * LAST_INSERTS[state]
                    roles += ["user", "assistant"][2 - LAST_INSERTS[state] :]
                yield conv, at, turn, role, hashed, initial, fault, edits, roles

    yield from _in_batches(rows(), schema)


def repair_edits(turns: DataFrame) -> DataFrame:
    """For each turn in order (``at``): its fault, its edits' initials, and the roles of the turns that they leave.

    ``fault`` is 1 for a blank turn, 2 for a repeated one, 3 for one cut off, else 0. Edits that end in K
    or R leave the turn itself last of ``roles`` (before inserts at the conversation's end).
    """
    marked = ordered_turns(turns)
    fault = F.when(F.col("blank"), 1).when(F.col("duplicate"), 2).when(F.col("cut_off"), 3).otherwise(0)
    kind = F.when(fault.isin(1, 2), MUST_GO).when(fault == 3, CUT_OFF).otherwise(FREE)
    marked = stored(marked.withColumn("fault", fault.cast("int")).withColumn("kind", kind.cast("int")), "faults")
    narrow = ["conv_id", "block", "at", "initial", "kind"]
    spans = marked.groupBy("conv_id").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a <> b")
    long = marked.join(spans, _same_conversation(marked, spans), "left_semi").select(*narrow)
    by_block, order = ["conv_id", "block"], ["conv_id", "block", "at"]
    matrices = _sorted(long, by_block, order).mapInArrow(_matrices, "conv_id long, block long, costs array<long>")
    down = _sorted(matrices, ["conv_id"], [F.col("conv_id"), F.desc("block")])
    ends = stored(down.mapInArrow(_end_vectors, "conv_id long, block long, ends array<long>"), "end-vectors")
    known = long.join(ends, _same_conversation(long, ends, "block")).select(*[long[c] for c in narrow], "ends")
    maps = _sorted(known, by_block, order).mapInArrow(_state_maps, "conv_id long, block long, ends array<long>, states array<int>")
    starts = _sorted(maps, ["conv_id"], by_block).mapInArrow(
        _start_states, "conv_id long, block long, ends array<long>, start int, final boolean"
    )
    whole = marked.join(starts, _same_conversation(marked, starts, "block"), "left").select(
        *[marked[c] for c in (*narrow, "turn", "role", "hash", "fault")],
        F.coalesce("ends", F.array(*[F.lit(c).cast("long") for c in END])).alias("ends"),
        F.coalesce("start", F.lit(START)).alias("start"), F.coalesce("final", F.lit(True)).alias("final"),
    )
    return _sorted(whole, by_block, order).mapInArrow(_edits, EDITS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation, from its texts and edits in order; a text comes right before the edits of its turns."""
    schema = pa.schema(
        [("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
         ("audit", pa.string()), ("repaired_sha256", pa.string())]
    )

    def rows() -> Iterator[tuple]:
        for (conv,), own in _groups(batches, 1):
            faults, audit, hashed, lines, text = [0, 0, 0, 0], [], hashlib.sha256(), 0, ""
            illegal, cost, before = 0, 0, None
            first = last = None
            numbers = 0
            for _, turn, _, _, is_edit, _, said, initial, fault, edits, roles in own:
                if not is_edit:
                    text = said
                    continue
                if turn is not None and turn != last:
                    first, last, numbers = turn if first is None else first, turn, numbers + 1
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                faults[fault] += 1
                audit.append(edits)
                cost += 3 * (edits.count("I") + edits.count("R")) + 4 * edits.count("D")
                cost += 3 * (fault == 3 and "D" not in edits)
                left = iter(roles)
                for edit in edits:
                    if edit != "D":
                        line = f"{next(left)}:{'' if edit == 'I' else text}"
                        hashed.update((f"\n{line}" if lines else line).encode())
                        lines += 1
            gaps = 0 if first is None else last - first + 1 - numbers
            yield conv, gaps, *faults[1:], illegal, cost, "".join(audit), hashed.hexdigest()

    yield from _in_batches(rows(), schema)


def with_hashes(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", copies_col=None) -> DataFrame:
    """The columns that this module works on; nulls as the module says."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    copies = F.lit(1) if copies_col is None else F.col(copies_col)
    return turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), text.alias("text"),
        F.unhex(F.sha2(text, 256)).alias("hash"), copies.cast("int").alias("copies"),
    )


def repair_conversations(turns: DataFrame, **columns: str) -> DataFrame:
    """Per conversation: its gaps and faults, the edits' cost and initials, and the hash of what they leave."""
    rows = with_hashes(turns, **columns)
    texts = rows.selectExpr(
        "conv_id", "turn", "role", "hash", "0 AS is_edit", "0L AS at", "CASE WHEN copies > 0 THEN text END AS text",
        "'' AS initial", "0 AS fault", "'' AS edits", "CAST(array() AS array<string>) AS roles",
    )
    edits = repair_edits(rows).selectExpr(
        "conv_id", "turn", "role", "hash", "1 AS is_edit", "at", "CAST(NULL AS string) AS text", "initial", "fault", "edits", "roles"
    )
    both = _sorted(texts.unionByName(edits), ["conv_id"], ["conv_id", "turn", "role", "hash", "is_edit", "at"])
    counts = ", ".join(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return both.mapInArrow(_digests, f"conv_id long, {counts}, audit string, repaired_sha256 string")


def repaired_turns(turns: DataFrame, **columns: str) -> DataFrame:
    """The turns that the edits leave: conv_id, at and place (their order), role, text."""
    rows = with_hashes(turns, **columns)
    edits = repair_edits(rows)
    texts = rows.where("copies > 0").select("conv_id", "turn", "role", "hash", "text").dropDuplicates(["conv_id", "turn", "role", "hash"])
    told = edits.join(texts, _same_conversation(edits, texts, "turn", "role", "hash")).select(edits["*"], "text")
    marks = F.split(F.translate("edits", "D", ""), "")
    lines = told.select("conv_id", "at", "text", marks.alias("marks"), F.posexplode("roles").alias("place", "role"))
    said = F.when(F.get("marks", F.col("place")) == "I", "").otherwise(F.col("text"))
    return lines.select("conv_id", "at", "place", "role", said.alias("text"))


def with_damage(turns: DataFrame) -> DataFrame:
    """``turns`` with faults by the hash of conversation and turn; ``copies`` is 0 for dropped, 2 for repeated turns.

    A null id, turn number, role or text counts as one space.
    """
    own = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fault = F.crc32(F.concat(own["conv_id"], F.lit(":"), own["turn"])) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(own["text"], ".!?", "")).otherwise(own["text"])
    return turns.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(own["role"]).alias("role"), text.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )
