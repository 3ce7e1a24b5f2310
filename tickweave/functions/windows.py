"""Row frames over ordered bars, and their execution in blocks.

A rolling value needs the frame's rows only. `in_blocks` cuts a symbol's bars into blocks by bar_index, copies to each
block the rows before and after it that frames reach into, lets the windows run per (symbol, block), and keeps each block's
own rows: one long symbol becomes many tasks with the same results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Bars in a block.
BLOCK = 65_536


@dataclass(frozen=True)
class Frame:
    """Partition and order of bars; makes frames of rows."""

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("bar_index",)

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def rows(self, first: int, last: int) -> WindowSpec:
        return self.ordered.rowsBetween(first, last)

    def roll(self, n: int) -> WindowSpec:
        return self.rows(1 - n, 0)

    def lag(self, column: Column | str, n: int = 1) -> Column:
        return F.lag(column, n).over(self.ordered)

    def gate(self, aggregate: Callable[[Column | str], Column], column: Column | str, n: int) -> Column:
        """The aggregate of the last n rows; null unless all n have a value."""
        return F.when(F.count(column).over(self.roll(n)) == n, aggregate(column).over(self.roll(n)))


def spread_blocks(bars: DataFrame, before: int, after: int, size: int | None = None) -> DataFrame:
    """bars with _block, and _own: whether the row belongs to that block or is copied to it as a margin."""
    size = max(size or BLOCK, before, after, 1)
    own, at = F.floor(F.col("bar_index") / size), F.col("bar_index") % size
    blocks = F.array_compact(F.array(own, F.when(at >= size - before, own + 1), F.when(at < after, own - 1)))
    return bars.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == own)


def in_blocks(bars: DataFrame, make: Callable[[DataFrame, Frame], DataFrame], before: int, after: int = 0, size: int | None = None) -> DataFrame:
    """make(bars, frame) run per block; `before` and `after` say how many rows frames reach back and ahead in all."""
    return make(spread_blocks(bars, before, after, size), Frame(("symbol", "_block"))).where("_own").drop("_own", "_block")
