"""Conversations repaired at least cost to a legal sequence of roles, and rendered.

Legal is: at most one system turn, first; then user and assistant in alternation, user first; an
assistant turn last. For every turn, a legal-turn automaton (state: the role rendered last) may keep the role (0),
merge the turn into the one before (1), give it another role (2), or put an empty turn of the missing
role before it (3); an empty assistant turn may close (3). The cheapest sequence of choices is found by
dynamic programming. A turn's choices depend on its role alone, so a stretch of turns is a small
matrix of least costs between states, and stretches combine by min-plus products: a conversation
that spans many partitions is solved from one matrix for each, and no task holds it whole.

Turns are ordered by turn, then text; null turns come first. Null conv_ids are one conversation.
Unknown and null roles fit no state, so they are merged or relabelled. A null text is empty. A
conversation of no turns has no rows, an empty table an empty result. Columns other than conv_id, turn,
role and text are left out, whatever their names; turns of any length are taken whole. Among cheapest choices the first in the order above wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm import shared

ROLES = ("system", "user", "assistant")
#: Bytes of turns for each part.
PART = 64 << 20
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, MERGE, RELABEL, INSERT = "keep", "merge", "relabel", "insert"
COST = {KEEP: 0.0, MERGE: 1.0, RELABEL: 2.0, INSERT: 3.0}
NEXT = {NOTHING: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _choices(role: int) -> dict[tuple[int, int], tuple[float, tuple[str, ...]]]:
    """The cheapest way to take a turn of this role (0: unknown) from one state to another."""
    out: dict[tuple[int, int], tuple[float, tuple[str, ...]]] = {}

    def offer(a: int, b: int, *steps: str) -> None:
        cost = sum(COST[s] for s in steps)
        if (a, b) not in out or cost < out[a, b][0]:
            out[a, b] = (cost, steps)

    for a in range(4):
        for b in NEXT[a]:
            offer(a, b, KEEP if b == role else RELABEL)
            for c in NEXT[b]:
                if b != SYSTEM:
                    offer(a, c, INSERT, KEEP if c == role else RELABEL)
        if a != NOTHING:
            offer(a, a, MERGE) if role in (a, 0) else offer(a, a, RELABEL, MERGE)
    return out


CHOICES = [_choices(r) for r in range(4)]
MATRIX = np.full((4, 4, 4), np.inf)
for _r in range(4):
    for (_a, _b), (_c, _) in CHOICES[_r].items():
        MATRIX[_r, _a, _b] = _c
#: What it costs to stop in each state.
CLOSE = np.array([0.0, 2 * COST[INSERT], COST[INSERT], 0.0])


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Min-plus: least costs over two stretches in a row."""
    return (x[:, :, None] + y[None, :, :]).min(1)


def whole(roles: np.ndarray) -> np.ndarray:
    """The matrix of a stretch, by products of neighbours in a balanced tree."""
    m = MATRIX[roles]
    while len(m) > 1:
        even = (m[: len(m) // 2 * 2 : 2, :, :, None] + m[1::2, None, :, :]).min(2)
        m = np.concatenate([even, m[-1:]]) if len(m) % 2 else even
    return m[0]


def path(roles: np.ndarray, start: int, end: int | None) -> list[tuple[int, int]]:
    """The states around each turn on the cheapest way from ``start`` to ``end``, or to the cheapest close."""
    cost = np.full(4, np.inf)
    cost[start] = 0
    back = np.empty((len(roles), 4), np.int8)
    for k, r in enumerate(roles):
        ways = cost[:, None] + MATRIX[r]
        back[k] = ways.argmin(0)
        cost = ways.min(0)
    at = int((cost + CLOSE).argmin()) if end is None else end
    out = []
    for k in range(len(roles) - 1, -1, -1):
        out.append((int(back[k, at]), at))
        at = int(back[k, at])
    return out[::-1]


def _codes(roles) -> np.ndarray:
    known = {r: k + 1 for k, r in enumerate(ROLES)}
    return np.array([known.get((r or "").strip().lower(), 0) for r in roles], np.int64)


def repaired(turns: DataFrame) -> DataFrame:
    """For every turn: conv_id, turn, role, position (in the conversation, from 0, within its stretch's order),
    new_role, actions, cost, and ``piece``; the pieces of a conversation in order of position are its rendering."""
    spark = turns.sparkSession
    shared.shared_dir(spark)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "text", "role")]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = shared.parts_for(spark, shared.bytes_of(rows), PART)
    dealt = shared.stored(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "turns")

    def in_order(columns):
        keys = [F.col(c).asc_nulls_first() for c in ("part", "conv_id", "turn", "text", "role")]
        return dealt.repartition(parts, "part").sortWithinPartitions(*keys).select(*columns)

    def stretch(batches):
        """The first and last conversation of each part with their matrices: all that can go on elsewhere."""
        for part, found in _by_part(batches):
            convs = list(found)
            for k in sorted({0, len(convs) - 1}):
                conv, own = convs[k]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "conv_id": pa.array([conv], pa.int64()), "last": pa.array([k == len(convs) - 1]), "n": pa.array([len(own)], pa.int64()), "m": pa.array([whole(_codes(r[0] for r in own)).ravel().tolist()], pa.list_(pa.float64()))})

    def _by_part(batches):
        import itertools

        def lines():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for part, rows in itertools.groupby(lines(), key=lambda r: r[0]):
            yield part, ((conv, [r[2:] for r in own]) for conv, own in itertools.groupby(rows, key=lambda r: r[1]))

    ends = in_order(["part", "conv_id", "role"]).mapInArrow(stretch, "part int, conv_id long, last boolean, n long, m array<double>").collect()  # two rows for each part at most
    plan: dict[tuple[int, int | None], tuple[int, int | None, int, bool, bool]] = {}
    by_conv: dict[int | None, list] = {}
    for r in sorted(ends, key=lambda r: (r.part, r.last)):
        by_conv.setdefault(r.conv_id, []).append(r)
    for conv, found in by_conv.items():
        if len(found) < 2:
            continue
        mats = [np.array(r.m).reshape(4, 4) for r in found]
        after = [CLOSE]
        for m in reversed(mats[1:]):
            after.append((m + after[-1][None, :]).min(1))
        state, seen = NOTHING, 0
        for k, (r, m) in enumerate(zip(found, mats, strict=True)):
            to = int((m[state] + after[len(mats) - 1 - k]).argmin())
            plan[r.part, conv] = (state, to, seen, k == 0, k == len(mats) - 1)
            state, seen = to, seen + r.n

    def render(batches):
        for part, found in _by_part(batches):
            out = []
            for conv, own in found:
                start, end, seen, _, last = plan.get((part, conv), (NOTHING, None, 0, True, True))
                roles = _codes(r[0] for r in own)
                for k, ((a, b), (role, turn, text)) in enumerate(zip(path(roles, start, end), own, strict=True)):
                    cost, steps = CHOICES[roles[k]][a, b]
                    piece = "\n" if MERGE in steps else ("<|end|>\n" if a else "")
                    if INSERT in steps:
                        piece += f"<|{ROLES[NEXT[a][-1] - 1]}|>\n<|end|>\n"
                    if MERGE not in steps:
                        piece += f"<|{ROLES[b - 1]}|>\n"
                    piece += text
                    if last and k == len(own) - 1:
                        missing = {ASSISTANT: (), USER: (ASSISTANT,), SYSTEM: (USER, ASSISTANT)}[b]
                        piece += "<|end|>\n" + "".join(f"<|{ROLES[m - 1]}|>\n<|end|>\n" for m in missing)
                        cost += float(CLOSE[b])
                        steps = (*steps, *(INSERT for _ in missing))
                    out.append((conv, turn, role, seen + k, ROLES[b - 1], ",".join(steps), cost, piece))
                if len(out) > 2000:
                    yield _result(out)
                    out = []
            if out:
                yield _result(out)

    return in_order(["part", "conv_id", "role", "turn", "text"]).mapInArrow(render, "conv_id long, turn long, role string, position long, new_role string, actions string, cost double, piece string")


def _result(rows) -> pa.RecordBatch:
    names = ["conv_id", "turn", "role", "position", "new_role", "actions", "cost", "piece"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
