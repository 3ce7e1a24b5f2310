"""Session-aware long-only backtest.

Where a trade entered at a bar would leave is a bounded look ahead and is found for all bars at once. Which entries are taken
depends on the one position being free: a chain through the candidate entries, walked in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chains import Steps, along_chain
from ..functions.prefix import with_prefix
from ..functions.search import HALT, NONE, UP, first_reach
from ..functions.stored import stored
from .session import SessionCalendar
from .signals import Strategy


@dataclass(frozen=True)
class BacktestSpec:
    """barrier_ref: the entry bar's price that tp and sl are measured from, bid or ask. close_seconds: no position is held so near a session's end.

    distances: (symbol, tp, sl) of the symbols that have their own; a row for each.
    """

    tp: float
    sl: float
    max_bars: int = 500
    initial_cash: float = 10_000.0
    size: float = 1.0
    commission: float = 0.0
    slippage: float = 0.0
    close_seconds: float = 600.0
    use_meta: bool = True
    barrier_ref: str = "bid"
    calendar: SessionCalendar = field(default_factory=SessionCalendar)
    distances: DataFrame | None = None

    def __post_init__(self):
        if self.tp <= 0 or self.sl <= 0:
            raise ValueError("tp and sl must be positive")
        if self.barrier_ref not in ("bid", "ask"):
            raise ValueError(f"unknown barrier_ref: {self.barrier_ref}")


def feed(bars: DataFrame) -> DataFrame:
    """Bars as a strategy sees them: bid prices, the ask's close, volume (0 where there is none)."""
    volume = F.coalesce(F.col("bidVolume_sum"), F.lit(0.0)) if "bidVolume_sum" in bars.columns else F.lit(0.0)
    return bars.select("symbol", "bar_index", "timestamp", *[F.col(f"bid_{x}").alias(x) for x in ("open", "high", "low", "close")], "ask_close", volume.alias("volume"))


def candidate_trades(bars: DataFrame, signals: DataFrame, spec: BacktestSpec) -> DataFrame:
    """Every entry that a signal allows, with the exit it would have: tp, sl, session_close or time (after max_bars or the data's end)."""
    cal = spec.calendar
    closed = (F.lit(False) if cal.weekend_trading else cal.is_weekend("timestamp")) | (cal.time_to_end("timestamp") <= spec.close_seconds)
    wanted = F.col("prediction") == 1
    if spec.use_meta:
        wanted &= F.coalesce("meta_decision", F.lit(1)) != 0
    entries = signals.where(wanted).select("symbol", "bar_index", F.lit(True).alias("_entry")).distinct()
    rows = bars.withColumn("_closed", closed).join(entries, ["symbol", "bar_index"], "left")
    base, tp, sl = F.col(f"{spec.barrier_ref}_close"), F.lit(spec.tp), F.lit(spec.sl)
    if spec.distances is not None:
        own = spec.distances.select(F.col("symbol").alias("_s"), F.col("tp").alias("_own_tp"), F.col("sl").alias("_own_sl"))
        rows = rows.join(own, F.col("symbol").eqNullSafe(F.col("_s")), "left").drop("_s")
        tp, sl = F.coalesce("_own_tp", tp), F.coalesce("_own_sl", sl)
    found = first_reach(rows, base + tp, base - sl, F.when(F.col("_entry") & ~F.col("_closed"), spec.max_bars), spec.max_bars, F.col("_closed"), keep=("ask_close",))
    outcome = F.col("outcome")
    reason = F.when(outcome == NONE, "time").when(outcome == HALT, "session_close").when(outcome == UP, "tp").otherwise("sl")
    return found.select("symbol", F.col("bar_index").alias("entry_bar"), F.col("timestamp").alias("entry_timestamp"), (F.col("ask_close") + spec.slippage).alias("entry_price"), "exit_bar", "exit_timestamp", (F.col("exit_close") - spec.slippage).alias("exit_price"), reason.alias("reason"))


def _free_steps(max_bars: int):
    """An entry that is taken holds the position up to its exit; the next one taken lies behind that bar."""

    def steps(block: pa.Table) -> Steps:
        entry, out = (block[c].to_numpy().astype(float) for c in ("entry_bar", "exit_bar"))
        return Steps(entry, out + 1, 0.0, entry[0] + max_bars + 1)

    return steps


def run_backtest(bars: DataFrame, signals: DataFrame, spec: BacktestSpec) -> DataFrame:
    """The trade log: a position at a time for each symbol; the bar that closes one opens none."""
    candidates = stored(candidate_trades(bars, signals, spec), "candidates")  # read by both passes of the chain
    taken = along_chain(candidates, "entry_bar", _free_steps(spec.max_bars), ("exit_bar",), 0.0).where("taken").drop("taken", "rank")
    cost = spec.commission * spec.size * (F.col("entry_price") + F.col("exit_price"))
    pnl = (F.col("exit_price") - F.col("entry_price")) * spec.size - cost
    seconds = (F.unix_micros("exit_timestamp") - F.unix_micros("entry_timestamp")) / 1e6
    return taken.withColumns({"size": F.lit(spec.size), "pnl": pnl, "pnl_pct": pnl / spec.initial_cash, "duration": seconds})


def equity_curve(trades: DataFrame, initial_cash: float = 10_000.0, index: str | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """trades with equity: cash and all profit up to and with the trade, by exit_timestamp, then entry_bar; index names a column for its number."""
    summed = with_prefix(trades, sums={"equity": "pnl"}, index=index, keys=keys, order=("exit_timestamp", "entry_bar"))
    return summed.withColumn("equity", F.col("equity") + initial_cash)


def run_benchmark(bars: DataFrame, strategies: dict[str, Strategy], spec: BacktestSpec) -> DataFrame:
    """The trade logs of several strategies under their names."""
    logs = [run_backtest(bars, s(bars), spec).withColumn("strategy", F.lit(name)) for name, s in strategies.items()]
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out


