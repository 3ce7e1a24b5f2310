"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run three times in a warm session, its median counts; rows are those that it returns. `bars_1m` builds bars of 100
ticks from a million ticks or so: those of the events table under ten symbols, written as Parquet before the clock starts; `volume_bars_1m_one_symbol` has them
all under one.
"""

import json
import os
import sys
import tempfile
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["tick_bars", "volume_bars", "clean_full", "feature_matrix", "triple_barrier", "features_labels_join", "cpcv_folds", "asof_signal", "backtest_trades", "perf_extended", "frac_diff_ffd"]
REPEATS, SYMBOLS = 3, 10


def timed(make) -> tuple[float, int]:
    """(median seconds, rows) of a query."""
    runs, rows = [], 0
    for _ in range(REPEATS):
        start, seen = time.time(), Observation()
        make().observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        runs.append(time.time() - start)
        rows = seen.get["rows"]
    return round(median(runs), 3), rows


def main() -> None:
    from tickweave import registry
    from tickweave.operators import bars
    from tickweave.schema import ticks_from_events

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tickweave-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds, rows = registry.queries(), {}, {}
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    n_ticks = events.count()
    for name in HEADLINE:
        seconds[name], rows[name] = timed(lambda: queries[name](spark, SF_DIR))
    path = f"{tempfile.mkdtemp(prefix='spark-')}/ticks"
    many = events.withColumn("_symbol", F.explode(F.sequence(F.lit(1), F.lit(SYMBOLS)))).withColumn("_symbol", F.format_string("S%02d", "_symbol"))
    ticks_from_events(many, F.col("_symbol")).write.parquet(path)
    ticks = spark.read.parquet(path)
    seconds["bars_1m"], rows["bars_1m"] = timed(lambda: bars.build_bars(ticks, bars.BarSpec("tick", 100)))
    seconds["volume_bars_1m"], rows["volume_bars_1m"] = timed(lambda: bars.build_bars(ticks, bars.BarSpec("volume", 7_500)))
    one = ticks.withColumns({"seq": F.col("seq") * SYMBOLS + F.substring("symbol", 2, 2).cast("long"), "symbol": F.lit("ONE")})
    one.write.parquet(f"{path}-one")
    single = spark.read.parquet(f"{path}-one")
    seconds["volume_bars_1m_one_symbol"], rows["volume_bars_1m_one_symbol"] = timed(lambda: bars.build_bars(single, bars.BarSpec("volume", 7_500)))
    total = SYMBOLS * n_ticks
    print(json.dumps({"metric": f"total of the medians of {REPEATS} runs", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")), "ticks": n_ticks, "rows_out": rows, "ticks_per_sec_bars": round(total / seconds["bars_1m"]), "labels_per_sec": round(rows["triple_barrier"] / seconds["triple_barrier"])}))
    spark.stop()


if __name__ == "__main__":
    main()
