"""Labels from what follows a bar: triple barriers, excursions, meta-labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.search import DOWN, NONE, UP, first_reach
from ..functions.stored import stored
from ..functions.windows import Frame, in_blocks
from .bars import average_duration
from .session import SessionCalendar

#: Barrier distances never fall below so many ticks.
LEAST_TICKS = 10


def events(bars: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """symbol, timestamp, bar_index of the bars that have features."""
    kept = bars if features is None else bars.join(features.select("symbol", "bar_index").distinct(), ["symbol", "bar_index"], "left_semi")
    return kept.select("symbol", "timestamp", "bar_index")


def with_bars_left(bars: DataFrame, calendar: SessionCalendar) -> DataFrame:
    """bars with bars_left: how many later bars of the symbol bear a time up to the end of the bar's session.

    Counted by ranks within (symbol, session), so weekends and gaps need no care. A bar after its session's end, or on a closed
    weekend day, has none left.
    """
    at, end = F.unix_micros("timestamp"), F.unix_micros(calendar.session_end("timestamp"))
    inside = (at <= end) if calendar.weekend_trading else (at <= end) & ~calendar.is_weekend("timestamp")
    day = Window.partitionBy("symbol", "_end", "_inside")
    rows = bars.withColumns({"_end": end, "_inside": inside})
    left = F.count("*").over(day) - F.row_number().over(day.orderBy("bar_index"))
    return rows.withColumn("bars_left", F.when(F.col("_inside"), left).otherwise(0)).drop("_end", "_inside")


def triple_barrier(bars: DataFrame, tp: float | Column, sl: float | Column, max_horizon: int, min_horizon: int, calendar: SessionCalendar | None = None, at: DataFrame | None = None, session: str = "mean") -> DataFrame:
    """A label for each event with room before the session's end.

    Entry at the ask's close; barriers lie tp above and sl below the bid's close. The first bar of the next h that reaches
    a barrier decides, the upper one winning a tie; else the last of them (label 0). Exit at that bar's bid close. h is the
    least of max_horizon and the session's remaining bars; events with less than min_horizon or without a next bar are left out.
    How many bars remain is estimated from the mean time between bars, or (session "exact") counted: bars up to the session's real end.
    """
    calendar = calendar or SessionCalendar()
    if session == "exact":
        rows = with_bars_left(bars, calendar)
        left = F.col("bars_left")
    elif session == "mean":
        rows = bars.join(average_duration(bars), "symbol")  # one row for each symbol
        left = calendar.bars_to_end("timestamp", F.col("seconds"))
    else:
        raise ValueError(f"unknown way to cut at the session's end: {session}")
    rows = rows.withColumn("effective_horizon", F.least(F.lit(max_horizon), left).cast("int"))
    asked = F.when(F.col("effective_horizon") >= max(min_horizon, 1), F.col("effective_horizon"))
    if at is not None:
        rows = rows.join(at.select("symbol", "bar_index", F.lit(True).alias("_event")).distinct(), ["symbol", "bar_index"], "left")
        asked = F.when(F.col("_event"), asked)
    found = first_reach(rows, F.col("bid_close") + tp, F.col("bid_close") - sl, asked, max_horizon, keep=("ask_close", "effective_horizon"))
    outcome = F.col("outcome")
    return found.select(
        "symbol",
        F.col("timestamp").alias("event_start"),
        F.col("exit_timestamp").alias("event_end"),
        F.when(outcome == NONE, 0).when(outcome == UP, 1).otherwise(-1).alias("label"),
        F.col("bar_index").alias("bar_index_start"),
        F.col("exit_bar").alias("bar_index_end"),
        F.col("ask_close").alias("entry_price"),
        F.col("exit_close").alias("exit_price"),
        (F.col("exit_close") - F.col("ask_close")).alias("pnl"),
        F.when(outcome == UP, "tp").when(outcome == DOWN, "sl").otherwise("time").alias("barrier_hit"),
        "effective_horizon",
        F.col("timestamp").alias("bar_timestamp"),
    )


def excursions(bars: DataFrame, horizon: int) -> DataFrame:
    """symbol, bar_index, mfe, mae over the next `horizon` bars; null where there are fewer."""
    high, low, entry = ("bid_high", "bid_low", "ask_close") if "bid_high" in bars.columns else ("high", "low", "close")

    def ahead(df: DataFrame, f: Frame) -> DataFrame:
        over = f.rows(1, horizon)
        full = F.count("*").over(over) == horizon
        return df.withColumns({"mfe": F.when(full, F.max(high).over(over) - F.col(entry)), "mae": F.when(full, F.col(entry) - F.min(low).over(over))})

    return in_blocks(bars, ahead, 0, horizon).select("symbol", "bar_index", "mfe", "mae")


def suggest_distances(bars: DataFrame, horizon: int, tick_size: float, tp_quantile: float = 0.5, sl_quantile: float | None = None, default_ticks: int = 50, pip_size: float | None = None, legacy: bool = False) -> DataFrame:
    """symbol, tp_ticks, sl_ticks, tp_price, sl_price from quantiles of the excursions (linear interpolation).

    A tick is tick_size, or a tenth of pip_size where that is given. legacy takes a tick_size of 1e-4 or more for a pip:
    ticks are counted in tenths of it, but priced at tick_size each.
    """
    reach = stored(excursions(bars, horizon).select("symbol", "mfe", "mae"), "excursions")  # read by several passes
    q = exact_quantiles(reach, {"mfe_q": ("mfe", tp_quantile), "mae_q": ("mae", tp_quantile if sl_quantile is None else sl_quantile)}, ("symbol",))
    price = tick_size if pip_size is None else pip_size / 10
    unit = price / 10 if legacy and pip_size is None and tick_size >= 1e-4 else price
    ticks = lambda c: F.coalesce(F.greatest(F.lit(LEAST_TICKS), (c / unit).cast("int")), F.lit(default_ticks))
    out = q.select("symbol", ticks(F.col("mfe_q")).alias("tp_ticks"), ticks(F.abs("mae_q")).alias("sl_ticks"), "mfe_q", "mae_q")
    return out.withColumns({"tp_price": F.col("tp_ticks") * price, "sl_price": F.col("sl_ticks") * price})


def triple_barrier_by_excursion(bars: DataFrame, horizon: int, tick_size: float, tp_quantile: float, sl_quantile: float, max_horizon: int, min_horizon: int, calendar: SessionCalendar | None = None) -> DataFrame:
    """Triple barriers at distances that the excursions suggest for each symbol."""
    d = suggest_distances(bars, horizon, tick_size, tp_quantile, sl_quantile).select("symbol", "tp_price", "sl_price")
    return triple_barrier(bars.join(d, "symbol"), F.col("tp_price"), F.col("sl_price"), max_horizon, min_horizon, calendar)


def meta_labels(labels: DataFrame) -> DataFrame:
    return labels.withColumn("meta_label", (F.col("pnl") > 0).cast("int"))


def meta_features(labels: DataFrame, regimes: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Labels' rows with regime and other columns of the bar at which they start, where there are any."""
    out = labels.withColumn("bar_index", F.col("bar_index_start"))
    for side in (regimes, extra):
        if side is not None:
            out = out.join(side, ["symbol", "bar_index"], "left")
    return out


def label_distribution(labels: DataFrame) -> DataFrame:
    """label, n, share of all; share among labels other than 0 where the label is one."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("label") != 0, F.col("n"))).alias("decided"))
    joined = counts.join(F.broadcast(total))  # one row beside a few
    return joined.select("label", "n", (F.col("n") / F.col("total")).alias("share"), F.when(F.col("label") != 0, F.col("n") / F.col("decided")).alias("share_decided"))


def decided(labels: DataFrame) -> DataFrame:
    return labels.where("label != 0")


def with_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features joined with the label of the same bar."""
    return features.join(labels.withColumn("bar_index", F.col("bar_index_start")), ["symbol", "bar_index"])
