"""Chat formatting with role repair at the least cost.

Legal conversations are an automaton: an optional system turn, then user and
assistant in turns, with an assistant's turn at the end. Dynamic programming
over its states finds, for each conversation, the cheapest way to make its
turns legal: keep a turn, give it another role, merge it into the turn before,
or insert an empty turn. The repaired turns are then rendered.

Scale: turns are sorted by range over the whole table and numbered within their
range; the (at most one) conversation that began before a range gets the number of its
turns there from counts. Parts are ``PART_TURNS`` turns by that number, so neither a
conversation that holds a third of all turns nor turns of one number or of none
make a large group. A part's costs from each state to each state are a small matrix;
matrices combine by (min, +), first within blocks of ``BLOCK_PARTS`` parts, then over a
conversation's blocks. Each part is then repaired on its own, between the
states that the cheapest path has at its ends, and rendered as a row of its own.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterspark.llm.common import cut, read, rows_of

PART_TURNS = 256
BLOCK_PARTS = 4096
ROLES = ("system", "user", "assistant")
START = 3                                   # a state is the role of the last turn, or START
LEGAL = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
END = 2
MERGE, MERGE_BLANK, RELABEL, RELABEL_UNKNOWN, INSERT = 2, 1, 3, 2, 4
NEVER = 10**12

#: Cheapest empty turns that lead from a state to another (roles inserted).
INSERTS = {(START, START): (), (0, 0): (), (1, 1): (), (2, 2): (), (START, 1): (1,), (START, 2): (1, 2), (0, 1): (1,), (0, 2): (1, 2), (1, 2): (2,), (2, 1): (1,)}

OUT = "conv_id bigint, orphan bigint, part bigint, cost bigint, n_turns int, n_merged int, n_relabelled int, n_inserted int, rendered string"


def moves(role: int | None, blank: bool) -> list[tuple[int, int, int, tuple, bool, bool]]:
    """How a turn can be taken: (from, to, cost, roles inserted before, merged, relabelled)."""
    out = []
    for (a, b), inserted in INSERTS.items():
        for q in range(3):
            change = 0 if q == role else RELABEL_UNKNOWN if role is None else RELABEL
            if q in LEGAL[b]:
                out.append((a, q, len(inserted) * INSERT + change, inserted, False, q != role))
            if q == b and not inserted:
                out.append((a, q, (MERGE_BLANK if blank else MERGE) + change, inserted, True, q != role))
    return out


MOVES = {(r, blank): moves(r, blank) for r in (0, 1, 2, None) for blank in (False, True)}
CODES = list(MOVES)


def _kind(turn: dict) -> tuple[int | None, bool]:
    role = (turn["role"] or "").strip().lower()
    return ROLES.index(role) if role in ROLES else None, not (turn["text"] or "").strip()


def forward(kinds: list, start: int) -> list[list]:
    """The least cost of each state after each turn, with the move that led there.
    Of equally cheap moves the first in MOVES is taken."""
    costs = [NEVER] * 4
    costs[start] = 0
    steps = []
    for kind in kinds:
        best = [(NEVER, None)] * 4
        for move in MOVES[kind]:
            c = costs[move[0]] + move[2]
            if c < best[move[1]][0]:
                best[move[1]] = (c, move)
        steps.append(best)
        costs = [c for c, _ in best]
    return steps


def repair(kinds: list, start: int, end: int) -> list:
    """The cheapest moves for the turns that lead from ``start`` to ``end``."""
    steps, out, state = forward(kinds, start), [], end
    for best in reversed(steps):
        out.append(best[state][1])
        state = out[-1][0]
    return out[::-1]


def _number_batches(batches):
    """Sorted turns with the number of their range, their own number in it within
    their conversation, and the code of their role and blankness."""
    task, current, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        for part in rows_of(batch):
            numbers, codes = [], []
            for conv, orphan, role, text in zip(*(part.column(name).to_pylist() for name in ("conv_id", "orphan", "role", "text"))):
                n = n + 1 if (conv, orphan) == current else 0
                current = (conv, orphan)
                numbers.append(n)
                codes.append(CODES.index(_kind({"role": role, "text": text})))
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("orphan"), pa.array([task] * len(codes), pa.int32()), pa.array(numbers, pa.int64()), pa.array(codes, pa.int8()), part.column("text")],
                                             ["conv_id", "orphan", "task", "number", "code", "text"])


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, orphan, rank (from 0, within the conversation), code, text for distinct turns."""
    order = ["conv_id", "orphan", F.col("turn").isNull(), "turn", "role", "text"]
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                 .mapInArrow(_number_batches, "conv_id bigint, orphan bigint, task int, number bigint, code tinyint, text string"))
    earlier = Window.partitionBy("conv_id", "orphan").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("conv_id", "orphan", "task").agg(F.count("*").alias("n"))
    begun = counts.withColumn("begun", F.sum("n").over(earlier)).filter("begun > 0").drop("n")       # one row a range at most
    return placed.join(F.broadcast(begun), ["conv_id", "orphan", "task"], "left").select("conv_id", "orphan", (F.col("number") + F.coalesce("begun", F.lit(0))).alias("rank"), "code", "text")


def _matrix_batches(batches):
    for batch in batches:
        for part in rows_of(batch):
            found = []
            for codes in part.column(3).to_pylist():
                kinds = [CODES[c["code"]] for c in codes]
                found.append([c for s in range(4) for c, _ in forward(kinds, s)[-1]])
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(3)] + [pa.array(found, pa.list_(pa.int64()))], ["conv_id", "orphan", "part", "m"])


def _times(a: list[int], b: list[int]) -> list[int]:
    """The (min, +) product of two matrices."""
    return [min(NEVER, *(a[4 * s + u] + b[4 * u + t] for u in range(4))) for s in range(4) for t in range(4)]


def _block_batches(batches):
    for batch in batches:
        for part in rows_of(batch, 64):
            found = []
            for inner in part.column(3).to_pylist():
                total = None
                for p in sorted(inner, key=lambda p: p["part"]):
                    total = p["m"] if total is None else _times(total, p["m"])
                found.append(total)
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(3)] + [pa.array(found, pa.list_(pa.int64()))], ["conv_id", "orphan", "block", "m"])


def cheapest_path(matrices: list[list[int]], start: int, end: int | None) -> tuple[int, list[tuple[int, int]]]:
    """The cost, and the states before and after each matrix. Without ``end`` the best legal end is taken."""
    costs, came = [NEVER] * 4, []
    costs[start] = 0
    for m in matrices:
        best = [min((costs[s] + m[4 * s + t], s) for s in range(4)) for t in range(4)]
        came.append([s for _, s in best])
        costs = [min(c, NEVER) for c, _ in best]
    cost, state = min((costs[s] + INSERT * len(INSERTS[s, END]), s) for s in range(3)) if end is None else (costs[end], end)
    out = []
    for back in reversed(came):
        out.append((back[state], state))
        state = back[state]
    return cost, out[::-1]


def _top_batches(batches):
    """The states between the blocks of each conversation on its cheapest path."""
    for batch in batches:
        for part in rows_of(batch):
            out = {k: [] for k in ("conv_id", "orphan", "block", "enter", "leave", "cost", "last")}
            for conv, orphan, blocks in zip(*(part.column(i).to_pylist() for i in range(3))):
                blocks.sort(key=lambda b: b["block"])
                cost, states = cheapest_path([b["m"] for b in blocks], START, None)
                for b, (enter, leave) in zip(blocks, states):
                    for k, v in zip(out, (conv, orphan, b["block"], enter, leave, cost, b is blocks[-1])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, PATH_TYPES.get(k, pa.int64())) for k, v in out.items()], list(out))


def _path_batches(batches):
    """The states between the parts of each block."""
    for batch in batches:
        for part in rows_of(batch, 64):
            out = {k: [] for k in ("conv_id", "orphan", "part", "enter", "leave", "cost", "last")}
            for conv, orphan, parts, start, end, cost, last in zip(*(part.column(i).to_pylist() for i in range(7))):
                parts.sort(key=lambda p: p["part"])
                _, states = cheapest_path([p["m"] for p in parts], start, end)
                for p, (enter, leave) in zip(parts, states):
                    for k, v in zip(out, (conv, orphan, p["part"], enter, leave, cost, last and p is parts[-1])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, PATH_TYPES.get(k, pa.int64())) for k, v in out.items()], list(out))


PATH_TYPES = {"enter": pa.int32(), "leave": pa.int32(), "last": pa.bool_()}


def _render_batches(header: str, close: str, joint: str, batches):
    for batch in batches:
        for part in rows_of(batch, 16):
            yield _render(header, close, joint, part)


def _render(header: str, close: str, joint: str, batch):
    out = {k: [] for k in ("n_turns", "n_merged", "n_relabelled", "n_inserted", "rendered")}
    for turns, enter, leave, last in zip(*(batch.column(i).to_pylist() for i in range(4, 8))):
        taken = repair([CODES[t["code"]] for t in turns], enter, leave)
        after = INSERTS[leave, END] if last else ()
        text, open_turn = [], enter != START
        for turn, (_, role, _, inserted, merged, _) in zip(turns, taken):
            for r in inserted:
                text += [close * open_turn, header.format(role=ROLES[r])]
                open_turn = True
            text += [joint] if merged else [close * open_turn, header.format(role=ROLES[role])]
            text.append(turn["text"] or "")
            open_turn = True
        text += [close + header.format(role=ROLES[r]) for r in after] + [close] * last
        for k, v in (("n_turns", len(turns)), ("n_merged", sum(m[4] for m in taken)), ("n_relabelled", sum(m[5] for m in taken)),
                     ("n_inserted", sum(len(m[3]) for m in taken) + len(after)), ("rendered", "".join(text))):
            out[k].append(v)
    return pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [pa.array(v, pa.string() if k == "rendered" else pa.int32()) for k, v in out.items()],
                                      ["conv_id", "orphan", "part", "cost", *out])


def format_chats(turns: DataFrame, header: str = "<|{role}|>\n", close: str = "<|end|>\n", joint: str = "\n") -> DataFrame:
    """One row for each conversation and part: conv_id, orphan, part, cost (of
    the whole conversation), n_turns, n_merged, n_relabelled, n_inserted,
    rendered. A part is ``PART_TURNS`` turns (the last one fewer), numbered from 0. The rendered parts of a conversation in order are its text.

    Turns go by number; turns of one number go by role and text, and turns
    without a number come last. Rows repeated in full count once. Roles are
    taken without their case and outer white space; null and unknown ones are
    given one. A null text is empty. A turn without a conv_id is a conversation
    of its own (orphan tells them apart). Other columns are ignored; an empty
    table gives no rows."""
    rows = turns.select(turns["conv_id"].cast("bigint").alias("conv_id"), turns["turn"].cast("bigint").alias("turn"), turns["role"].cast("string").alias("role"), turns["text"].cast("string").alias("text"))
    orphan = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.lit(0))
    key = ["conv_id", "orphan"]
    placed = (numbered(rows.withColumn("orphan", orphan).withColumn("conv_id", F.coalesce("conv_id", F.lit(-(2**63)))).distinct())
              .withColumn("part", F.floor(F.col("rank") / PART_TURNS).cast("bigint")))
    codes = placed.groupBy(*key, "part").agg(F.sort_array(F.collect_list(F.struct("rank", "code"))).alias("codes"))
    matrices = codes.mapInArrow(_matrix_batches, "conv_id bigint, orphan bigint, part bigint, m array<bigint>")
    block = F.floor(F.col("part") / BLOCK_PARTS).cast("bigint").alias("block")
    blocks = cut(matrices.groupBy(*key, block).agg(F.collect_list(F.struct("part", "m")).alias("parts")))
    tops = (blocks.mapInArrow(_block_batches, "conv_id bigint, orphan bigint, block bigint, m array<bigint>")
            .groupBy(*key).agg(F.collect_list(F.struct("block", "m")).alias("blocks"))
            .mapInArrow(_top_batches, "conv_id bigint, orphan bigint, block bigint, enter int, leave int, cost bigint, last boolean"))
    paths = (blocks.join(tops, [*key, "block"]).select(*key, "parts", "enter", "leave", "cost", "last")
             .mapInArrow(_path_batches, "conv_id bigint, orphan bigint, part bigint, enter int, leave int, cost bigint, last boolean"))
    parts = placed.groupBy(*key, "part").agg(F.sort_array(F.collect_list(F.struct("rank", "code", "text"))).alias("turns"))
    ready = parts.join(paths, [*key, "part"]).select(*key, "part", "cost", "turns", "enter", "leave", "last")
    out = ready.mapInArrow(partial(_render_batches, header, close, joint), OUT)
    return out.withColumn("conv_id", F.nullif("conv_id", F.lit(-(2**63))))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = format_chats(read(spark, sf_dir, "conversations"))
    return found.select("conv_id", "part", "cost", "n_turns", "n_merged", "n_relabelled", "n_inserted", F.sha2("rendered", 256).alias("rendered_sha256"))
