"""Chat formatting with minimum-cost role repair.

Legal conversations are: a system turn or none, then user and assistant turns in alternation,
user first. Dynamic programming over the states of that automaton chooses for every turn whether
it is kept, merged with the one before, relabelled or preceded by an empty turn.

The cost of a run of turns from each state to each state is a small matrix, and matrices of
consecutive runs combine by (min, +). So conversations are cut into blocks of turns, by their
rank in an order over all tasks: blocks give their matrices, runs of blocks combine them, the short
chain of those fixes the states at their borders and then at every block's, and the blocks are repaired
and rendered apart. A conversation of any length, or many turns without a number, is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if, materialize, table
from .shingles import few_rows

ROLES = ("system", "user", "assistant")
#: State 0: nothing yet; state k: the last turn is of ROLES[k - 1].
N_STATES = 4
MERGE_COST, RELABEL_COST, INSERT_COST = 1, 3, 2
#: Turns of a block, and blocks of a run.
BLOCK_TURNS = 512
#: Parts of conversations that several tasks have are broadcast up to so many rows (24 MB); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
HEADER, FOOTER = "<|{role}|>\n", "<|end|>\n"


def _moves() -> dict[int, list[tuple[int, int, str, tuple[int, ...]]]]:
    """From each state: (role number, cost, how, roles of empty turns put in before)."""
    direct = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}
    found: dict[int, list] = {}
    for state in range(N_STATES):
        own = [(role, 0, "keep", ()) for role in direct[state]]
        if state:
            own.append((state - 1, MERGE_COST, "merge", ()))
        own += [(role, INSERT_COST, "insert", (first,)) for first in direct[state] if first for role in direct[first + 1] if role not in direct[state]]
        found[state] = own
    return found


MOVES = _moves()


def turn_costs(role: str | None) -> np.ndarray:
    """Least cost of one turn from state (row) to state (column)."""
    m = np.full((N_STATES, N_STATES), np.inf)
    for state, moves in MOVES.items():
        for out, cost, _, _ in moves:
            m[state, out + 1] = min(m[state, out + 1], cost + (RELABEL_COST if ROLES[out] != role else 0))
    return m


_COSTS = {role: turn_costs(role) for role in (*ROLES, None)}


def costs_of(role: str | None) -> np.ndarray:
    return _COSTS[role if role in ROLES else None]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def block_matrix(roles: list) -> np.ndarray:
    m = np.where(np.eye(N_STATES, dtype=bool), 0.0, np.inf)
    for role in roles:
        m = combine(m, costs_of(role))
    return m


def border_states(matrices: list[np.ndarray], enter: int = 0, leave: int | None = None) -> tuple[list[int], float]:
    """States before the first, between and after the last of the blocks on a path of least cost; of equal paths the one with the smallest states from the end."""
    ahead = [np.where(np.arange(N_STATES) == enter, 0.0, np.inf)]
    for m in matrices:
        ahead.append((ahead[-1][:, None] + m).min(axis=0))
    states = [int(np.argmin(ahead[-1])) if leave is None else leave]
    for k in range(len(matrices) - 1, -1, -1):
        states.append(int(np.argmin(ahead[k] + matrices[k][:, states[-1]])))
    return states[::-1], float(ahead[-1].min())


def repair(roles: list, enter: int, leave: int) -> list[tuple[int, str, tuple[int, ...], bool]]:
    """(role number, how, empty turns before, relabelled) of each turn, from state enter to state leave."""
    states, at = [], np.full(N_STATES, np.inf)
    at[enter] = 0
    ahead = [at]
    for role in roles:
        ahead.append((ahead[-1][:, None] + costs_of(role)).min(axis=0))
    states = [leave]
    for k in range(len(roles) - 1, -1, -1):
        states.append(int(np.argmin(ahead[k] + costs_of(roles[k])[:, states[-1]])))
    states.reverse()
    found = []
    for k, role in enumerate(roles):
        options = [(cost + (RELABEL_COST if ROLES[out] != role else 0), i, out, how, before) for i, (out, cost, how, before) in enumerate(MOVES[states[k]]) if out + 1 == states[k + 1]]
        _, _, out, how, before = min(options)
        found.append((out, how, before, ROLES[out] != role))
    return found


def render(texts: list, plan: list, opening: bool, closing: bool) -> list[str]:
    """What each turn adds to the conversation's string; joined in order the pieces are the whole."""
    pieces, begun = [], not opening
    for text, (out, how, before, _) in zip(texts, plan, strict=True):
        if how == "merge":
            pieces.append("\n" + text)
        else:
            empty = "".join(HEADER.format(role=ROLES[r]) + "\n" + FOOTER for r in before)
            pieces.append(("\n" + FOOTER if begun else "") + empty + HEADER.format(role=ROLES[out]) + text)
        begun = True
    if closing and pieces:
        pieces[-1] += "\n" + FOOTER
    return pieces


def ranked(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with rank, each turn's place in its conversation from 0, on shared files.

    All rows are sorted over all tasks, so that no conversation is one task's; tasks number their
    own, and what earlier tasks had of a conversation is added. Rows that are the same may change places.
    """
    order = ["conv_id", "turn", "role", "text"]
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("part", pa.int32()), ("i", pa.int64())])

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, n = TaskContext.get().partitionId(), object(), 0
        for part in parts:
            found = []
            for c in part.column("conv_id").to_pylist():
                n, last = (n + 1 if c == last else 0), c
                found.append(n)
            yield pa.RecordBatch.from_arrays([*(part.column(c).cast(schema.field(c).type) for c in order), pa.array([own] * part.num_rows, pa.int32()), pa.array(found, pa.int64())], schema=schema)

    dealt = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = dealt.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
    table = materialize(dealt.mapInArrow(number, "conv_id long, turn long, role string, text string, part int, i long"), "chat-order")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = table.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(before))
    counts = materialize(counts.filter("before is not null").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "before"), "chat-offsets")
    both = table.join(broadcast_if(counts, BROADCAST_ROWS), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    return both.select(*order, (F.col("i") + F.coalesce("before", F.lit(0))).alias("rank"))


_MATRIX = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("costs", pa.list_(pa.float64()))])
_BORDER = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("is_first", pa.bool_()), ("is_last", pa.bool_()), ("conv_cost", pa.float64())])
_BORDERS = "conv_id long, block long, enter int, leave int, is_first boolean, is_last boolean, conv_cost double"


def _square(costs: list[float]) -> np.ndarray:
    return np.array(costs).reshape(N_STATES, N_STATES)


def _chains(matrices: DataFrame, *keys) -> DataFrame:
    return matrices.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "costs"))).alias("chain"))


def _mapped(rows: DataFrame, one, schema: pa.Schema, types: str) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(parts):
            yield pa.RecordBatch.from_pylist([x for r in part.to_pylist() for x in one(r)], schema)

    return rows.mapInArrow(run, types)


def _borders(r: dict) -> Iterator[dict]:
    """States at the borders of a chain's members, within the chain's own borders where it has them."""
    states, cost = border_states([_square(b["costs"]) for b in r["chain"]], r.get("enter") or 0, r.get("leave"))
    last = len(r["chain"]) - 1
    for i, b in enumerate(r["chain"]):
        yield {"conv_id": r["conv_id"], "block": b["block"], "enter": states[i], "leave": states[i + 1], "is_first": i == 0 and r.get("is_first", True), "is_last": i == last and r.get("is_last", True), "conv_cost": r.get("conv_cost", cost)}


def _combined(r: dict) -> Iterator[dict]:
    m = _square(r["chain"][0]["costs"])
    for b in r["chain"][1:]:
        m = combine(m, _square(b["costs"]))
    yield {"conv_id": r["conv_id"], "block": r["run"], "costs": m.ravel().tolist()}


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """A row per turn: conv_id, turn, role, new_role, action, n_inserted, piece, conv_cost, rank.

    Turns stand in order of number, role and text; null numbers come first, null texts are
    empty, roles that are null or unknown are relabelled. action is keep, merge or insert, with
    +relabel where the role changed. Of repairs of equal cost that with the smallest states at the ends
    of blocks (of ``block_turns`` turns, and of as many blocks) is taken, whatever the partitioning. Rows
    without conversation are one conversation of their own (null). Repeated rows are turns like others.
    An empty table gives an empty result. Only the named columns are looked at.
    """
    rows = ranked(turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.lower(F.trim(F.col(role_col).cast("string"))).alias("role"), F.col(text_col).cast("string").alias("text")
    )).withColumn("block", F.floor(F.col("rank") / block_turns))
    run, same = F.floor(F.col("block") / block_turns).alias("run"), lambda a, b, *keys: [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{y}")) for x, y in (("conv_id", "conv_id"), *keys)]

    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("rank", "role"))).alias("turns"))
    matrices = _mapped(blocks, lambda r: [{"conv_id": r["conv_id"], "block": r["block"], "costs": block_matrix([t["role"] for t in r["turns"]]).ravel().tolist()}], _MATRIX, "conv_id long, block long, costs array<double>")
    runs = materialize(_chains(materialize(matrices, "chat-matrices"), "conv_id", run), "chat-runs")
    combined = _mapped(runs, _combined, _MATRIX, "conv_id long, block long, costs array<double>")
    outer = _mapped(_chains(combined, "conv_id"), _borders, _BORDER, _BORDERS)
    inner = runs.alias("r").join(outer.alias("o"), same("r", "o", ("run", "block"))).select("r.conv_id", "r.chain", "o.enter", "o.leave", "o.is_first", "o.is_last", "o.conv_cost")
    fixed = materialize(_mapped(inner, _borders, _BORDER, _BORDERS), "chat-borders")

    whole = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("rank", "turn", "role", "text"))).alias("turns"))
    planned = whole.alias("w").join(fixed.alias("b"), same("w", "b", ("block", "block"))).select("w.conv_id", "w.turns", "b.enter", "b.leave", "b.is_first", "b.is_last", "b.conv_cost")
    out = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("n_inserted", pa.int64()), ("piece", pa.string()), ("conv_cost", pa.float64()), ("rank", pa.int64())])

    def finish(r: dict) -> Iterator[dict]:
        plan = repair([t["role"] for t in r["turns"]], r["enter"], r["leave"])
        pieces = render([t["text"] or "" for t in r["turns"]], plan, r["is_first"], r["is_last"])
        for t, p, piece in zip(r["turns"], plan, pieces, strict=True):
            yield {"conv_id": r["conv_id"], "turn": t["turn"], "role": t["role"], "new_role": ROLES[p[0]], "action": p[1] + "+relabel" * p[3], "n_inserted": len(p[2]), "piece": piece, "conv_cost": r["conv_cost"], "rank": t["rank"]}

    return _mapped(planned, finish, out, "conv_id long, turn long, role string, new_role string, action string, n_inserted long, piece string, conv_cost double, rank long")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


QUERIES = {"op10_chat_format": op10_chat_format}
ORACLES: dict[str, str] = {}
