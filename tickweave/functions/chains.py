"""Chains through ordered rows, of which each step depends on the last: bars that start anew, positions of which one is held at a time.

Rows of a symbol are in order and have a level that never falls. A chain is in a state, a number: it takes the first row whose level reaches
the state, which gives it the next state, and so on. One task that reads a symbol's rows in order would do. Instead rows are cut into
blocks. A block's jumps (from every row to the one taken next) are composed by doubling, which tells for every state that a chain may
come with the one that it leaves with: a step function of a few pieces, as chains that come in different states soon take the same
rows. Only those pieces, one row for each block, pass a task in order; then every block knows its state and takes its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, counted by the number that orders them.
BLOCK = 65_536


class Steps(NamedTuple):
    """Of a block's rows in order: level, the state after taking each, how much lower states are for the next block, the highest state
    that a chain may come with, and the row taken after each, where levels don't say it exactly (their number: none in this block)."""

    level: np.ndarray
    after: np.ndarray
    shift: float
    highest: float = np.inf
    jump: np.ndarray | None = None

    @property
    def jumps(self) -> np.ndarray:
        return np.searchsorted(self.level, self.after) if self.jump is None else self.jump


class Pieces(NamedTuple):
    """A state up to upper[i] (above upper[i - 1]) becomes after[i], with taken[i] rows taken; a higher one is only shifted."""

    upper: np.ndarray
    after: np.ndarray
    taken: np.ndarray


def pieces(steps: Steps) -> Pieces:
    """What a block does to every state up to the highest."""
    n, level = len(steps.level), steps.level
    jump = np.append(steps.jumps, n)
    last, count = np.where(jump < n, jump, np.arange(n + 1)), (jump < n).astype(np.int64)
    while True:  # where the chain from each row ends within the block, by doubling
        further = last[last]
        if (further == last).all():
            break
        count += count[last]
        last = further
    rows = np.arange(min(n, int(np.searchsorted(level, steps.highest)) + 1))
    rows = rows[np.append(True, level[1 : len(rows)] > level[: len(rows) - 1])]  # of equal levels the first is taken
    after, taken = steps.after[last[rows]] - steps.shift, 1 + count[rows]
    kept = np.append((after[1:] != after[:-1]) | (taken[1:] != taken[:-1]), True)
    return Pieces(level[rows][kept], after[kept], taken[kept])


def taken_rows(steps: Steps, state: float) -> np.ndarray:
    """The rows that a chain takes which enters the block in this state."""
    out, at, n = [], int(np.searchsorted(steps.level, state)), len(steps.level)
    jump = steps.jumps.tolist()
    while at < n:
        out.append(at)
        at = jump[at]
    return np.array(out, np.int64)


def _in_order(start: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of symbols in order, with their pieces -> the state and the number of rows taken with which each begins."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, before = None, start, 0
        for batch in batches:
            states, counts = np.empty(batch.num_rows), np.empty(batch.num_rows, np.int64)
            shift, top = (batch.column(c).to_numpy() for c in ("_shift", "_top"))
            for i, name in enumerate(batch.column("_key").to_pylist()):
                if name != own:
                    own, state, before = name, start, 0
                if state > top[i]:
                    raise ValueError(f"a chain is in state {state}, above the highest that was foreseen: are there amounts below 0?")
                states[i], counts[i] = state, before
                at = int(np.searchsorted(batch.column("_upper")[i].values.to_numpy(), state))
                if at == len(batch.column("_upper")[i]):
                    state -= shift[i]
                else:
                    state, before = batch.column("_after")[i].values[at].as_py(), before + batch.column("_taken")[i].values[at].as_py()
            yield pa.record_batch([batch.column("_key"), batch.column("_block"), pa.array(states), pa.array(counts)], names=["_key", "_block", "_state", "_before"])

    return work


def along_chain(rows: DataFrame, order: str, steps: Callable[[pa.Table], Steps], uses: tuple[str, ...], start: float, size: int | None = None) -> DataFrame:
    """rows with `taken`, whether their symbol's chain takes them, and `rank`, how many rows it took before.

    order numbers a symbol's rows, each once (gaps are fine); steps makes the levels and states of one block from its rows in order, of
    which it reads the columns in `uses`. A chain begins in state start. A null symbol is one of its own. Empty input gives an empty result.
    """
    keyed = rows.withColumns({"_key": F.coalesce(F.concat(F.lit("="), "symbol"), F.lit("!")), "_block": F.floor(F.col(order) / (size or BLOCK))})

    def table(block: pa.Table) -> pa.Table:
        made = steps(block.sort_by(order))
        found = pieces(made)
        lists = {n: pa.array([x], pa.list_(k)) for n, x, k in (("_upper", found.upper, pa.float64()), ("_after", found.after, pa.float64()), ("_taken", found.taken, pa.int64()))}
        return pa.table({"_key": block["_key"][:1], "_block": block["_block"][:1], "_shift": [float(made.shift)], "_top": [float(made.highest)]} | lists)

    tables = keyed.select("_key", "_block", order, *uses).groupBy("_key", "_block").applyInArrow(table, "_key string, _block long, _shift double, _top double, _upper array<double>, _after array<double>, _taken array<long>")
    # a row for each block
    states = tables.repartition("_key").sortWithinPartitions("_key", "_block").mapInArrow(_in_order(start), "_key string, _block long, _state double, _before long")

    def walk(block: pa.Table) -> pa.Table:
        block = block.sort_by(order)
        taken = np.zeros(len(block), bool)
        taken[taken_rows(steps(block), block["_state"][0].as_py())] = True
        rank = block["_before"][0].as_py() + np.cumsum(taken) - taken
        return block.drop_columns(["_key", "_block", "_state", "_before"]).append_column("taken", pa.array(taken)).append_column("rank", pa.array(rank, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", taken boolean, rank long"
    return keyed.join(states, ["_key", "_block"]).groupBy("_key", "_block").applyInArrow(walk, schema)
