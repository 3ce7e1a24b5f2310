"""Performance of trade logs and equity curves, as aggregates by any grouping columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def drawdown_curve(equity: DataFrame, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("exit_timestamp", "entry_bar"), bucket: str = "day") -> DataFrame:
    """equity with peak, dd and dd_pct. The peak so far comes from the bucket and from the buckets before it."""
    b = equity.withColumn("_b", F.date_trunc(bucket, order[0]))
    tops = b.groupBy(*keys, "_b").agg(F.max("equity").alias("_top"))
    tops = tops.select(*keys, "_b", F.max("_top").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tops = tops.withColumnsRenamed({k: f"_k_{k}" for k in (*keys, "_b")})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, "_b")]
    out = b.withColumn("_own", F.max("equity").over(w)).join(tops, same).drop(*[f"_k_{k}" for k in (*keys, "_b")]).withColumn("peak", F.greatest("_own", "_before"))
    out = out.withColumn("dd", F.col("equity") - F.col("peak"))
    return out.withColumn("dd_pct", F.try_divide("dd", "peak")).drop("_b", "_own", "_before")


def daily_stats(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return trades.groupBy(*keys, F.to_date("exit_timestamp").alias("day")).agg(F.sum("pnl").alias("pnl"), F.avg((F.col("pnl_pct") > 0).cast("int")).alias("win_rate"), F.count("*").alias("n_trades"))


def win_rate(pnl: str = "pnl") -> Column:
    return F.coalesce(F.avg((F.col(pnl) > 0).cast("int")), F.lit(0.0))


def sharpe(returns: str = "pnl_pct", periods: int = 252) -> Column:
    """Mean over population deviation, by the root of periods; 0 where nothing varies."""
    return F.coalesce(F.try_divide(F.avg(returns), F.nullif(F.stddev_pop(returns), F.lit(0.0))) * periods**0.5, F.lit(0.0))


def sortino(returns: str = "ret", risk_free: float = 0.0, periods: int = 252) -> Column:
    excess = F.col(returns) - risk_free / periods
    mean, down = F.avg(excess), F.stddev_samp(F.when(excess < 0, excess))
    flat = F.when(F.coalesce(mean, F.lit(0.0)) > 0, F.lit(INF)).otherwise(0.0)
    return F.when(F.coalesce(down, F.lit(0.0)) == 0, flat).otherwise(mean * periods / (down * periods**0.5))


def profit_factor(pnl: str = "pnl") -> Column:
    won, lost = (F.coalesce(F.sum(F.when(c, F.col(pnl))), F.lit(0.0)) for c in (F.col(pnl) > 0, F.col(pnl) < 0))
    return F.when(lost == 0, F.when(won > 0, F.lit(INF)).otherwise(0.0)).otherwise(won / F.abs(lost))


def expectancy(pnl: str = "pnl") -> Column:
    return F.coalesce(F.avg(pnl), F.lit(0.0))


def ulcer(dd_pct: str = "dd_pct") -> Column:
    return F.coalesce(F.sqrt(F.avg((F.col(dd_pct) * 100) ** 2)), F.lit(0.0))


def calmar(total_return: Column, max_drawdown: Column, periods: Column) -> Column:
    annual = F.when(periods > 0, F.pow(1 + total_return, F.lit(252.0) / periods) - 1).otherwise(total_return)
    return F.when(max_drawdown == 0, F.when(total_return > 0, F.lit(INF)).otherwise(0.0)).otherwise(annual / F.abs(max_drawdown))


def recovery(net: Column, max_drawdown: Column) -> Column:
    return F.when(max_drawdown == 0, F.when(net > 0, F.lit(INF)).otherwise(0.0)).otherwise(net / F.abs(max_drawdown))


def basic(trades: DataFrame, initial_cash: float = 10_000.0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """n_trades, net_profit, total_return, win_rate, sharpe, max_drawdown of each group."""
    from .backtest import equity_curve

    curve = drawdown_curve(equity_curve(trades, initial_cash, keys=keys), keys)
    return curve.groupBy(*keys).agg(F.count("*").alias("n_trades"), F.sum("pnl").alias("net_profit"), (F.sum("pnl") / initial_cash).alias("total_return"), win_rate().alias("win_rate"), sharpe().alias("sharpe"), F.min("dd_pct").alias("max_drawdown"))


def extended(trades: DataFrame, initial_cash: float = 10_000.0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Sortino, Calmar, profit factor, expectancy, recovery factor and ulcer index from the equity after each trade."""
    from .backtest import equity_curve

    curve = drawdown_curve(equity_curve(trades, initial_cash, index="_place", keys=keys), keys)
    before = F.col("equity") - F.col("pnl")  # the equity after the trade before, for all but the first
    rows = curve.withColumn("ret", F.when(F.col("_place") > 0, F.col("pnl") / before))
    last, start = F.max_by("equity", F.struct("exit_timestamp", "entry_bar")), F.min_by("equity", F.struct("exit_timestamp", "entry_bar"))
    sums = rows.groupBy(*keys).agg(sortino().alias("sortino"), profit_factor().alias("profit_factor"), expectancy().alias("expectancy"), ulcer().alias("ulcer"), F.sum("pnl").alias("_net"), F.min("dd_pct").alias("_dd"), F.count("ret").alias("_n"), (last / start - 1).alias("_return"))
    periods = F.when(F.col("_n") > 0, F.col("_n")).otherwise(252)
    return sums.select(*keys, "sortino", calmar(F.col("_return"), F.col("_dd"), periods).alias("calmar"), "profit_factor", "expectancy", recovery(F.col("_net"), F.col("_dd")).alias("recovery"), "ulcer")


def classification(scored: DataFrame, label: str = "label", prediction: str = "prediction", positive: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """n, accuracy, precision, recall, f1; 0 where a ratio has no cases."""
    y, p = F.col(label) == positive, F.col(prediction) == positive
    tp, np_, ny = F.count_if(y & p), F.count_if(p), F.count_if(y)
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"), safe(tp, np_).alias("precision"), safe(tp, ny).alias("recall"), safe(2 * tp, np_ + ny).alias("f1"))
