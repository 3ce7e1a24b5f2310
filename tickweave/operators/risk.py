"""Monte Carlo risk of a trade log. Each simulation draws by a hash of seed, simulation and step, so results don't depend on tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..functions.prefix import with_prefix


def drawn(trades: DataFrame, n_simulations: int, n_trades: int, seed: int = 42) -> DataFrame:
    """(sim, step, pnl): trades by their number in time, drawn with replacement; draws meet trades in a join, whatever the log's size."""
    numbered = with_prefix(trades.withColumn("_all", F.lit(0)), index="_i", keys=("_all",), order=("exit_timestamp", "entry_bar")).select("_i", "pnl")
    total = trades.agg(F.count("*").alias("_n"))
    steps = trades.sparkSession.range(n_simulations).select(F.col("id").alias("sim"), F.explode(F.sequence(F.lit(0), F.lit(n_trades - 1))).alias("step"))
    steps = steps.join(F.broadcast(total)).where("_n > 0")  # one row
    return steps.withColumn("_i", draw("sim", "step", seed) % F.col("_n")).join(numbered, "_i").select("sim", "step", "pnl")


def simulate(trades: DataFrame, n_simulations: int, n_trades: int, initial_capital: float, max_drawdown: float, target: float, seed: int = 42) -> DataFrame:
    """sim, final_capital, max_dd, ruined, reached: trades drawn with replacement until ruin (looked at first), target or n_trades."""
    spark, floor, goal = trades.sparkSession, initial_capital * (1 - max_drawdown), initial_capital * (1 + target)
    walks = drawn(trades, n_simulations, n_trades, seed).groupBy("sim").agg(F.array_sort(F.collect_list(F.struct("step", "pnl"))).alias("walk"))  # n_trades each
    walks = spark.range(n_simulations).select(F.col("id").alias("sim")).join(walks, "sim", "left").select("sim", F.coalesce(F.col("walk.pnl"), F.array().cast("array<double>")).alias("walk"))
    zero = F.struct(F.lit(initial_capital).alias("c"), F.lit(initial_capital).alias("peak"), F.lit(0.0).alias("dd"), F.lit(False).alias("done"))

    def step(s, x):
        c = s["c"] + x
        peak = F.greatest(s["peak"], c)
        dd = F.greatest(s["dd"], (peak - c) / peak)
        return F.when(s["done"], s).otherwise(F.struct(c.alias("c"), peak.alias("peak"), dd.alias("dd"), ((c <= floor) | (c >= goal)).alias("done")))

    end = walks.withColumn("end", F.aggregate("walk", zero, step))
    return end.select("sim", F.col("end.c").alias("final_capital"), F.col("end.dd").alias("max_dd"), (F.col("end.done") & (F.col("end.c") <= floor)).alias("ruined"), (F.col("end.done") & (F.col("end.c") > floor)).alias("reached"))


def monte_carlo(trades: DataFrame, n_simulations: int = 1000, n_trades: int = 100, initial_capital: float = 10_000.0, max_drawdown: float = 0.1, target: float = 0.05, seed: int = 42) -> DataFrame:
    sims = simulate(trades, n_simulations, n_trades, initial_capital, max_drawdown, target, seed)
    share = lambda c: F.avg(F.col(c).cast("int"))
    return sims.agg(share("ruined").alias("prob_ruin"), share("reached").alias("prob_target"), F.avg("final_capital").alias("mean_final_capital"), F.avg("max_dd").alias("mean_max_dd"))


def prop_firm(risk: DataFrame) -> DataFrame:
    """monte_carlo() with the ratio of the two chances and whether an account is viable: ruin under 5 %, target over 30 %."""
    ratio = F.coalesce(F.try_divide("prob_target", "prob_ruin"), F.lit(float("inf")))
    return risk.withColumns({"ratio": ratio, "viable": (F.col("prob_ruin") < 0.05) & (F.col("prob_target") > 0.3)})
