import datetime as dt
import random

import pytest
from tickweave.operators import bars, clean, validate
from tickweave.schema import TICK, nan_to_null
from tickweave.streaming import ticks as streaming

START = dt.datetime(2024, 1, 2)


def ticks(spark, n=200, seed=1, symbol="A"):
    rng, bid, out = random.Random(seed), 100.0, []
    for i in range(n):
        bid += rng.randrange(-8, 9) / 64
        out.append((symbol, i, START + dt.timedelta(seconds=i * 37), bid, bid + 1 / 64, float(rng.randrange(1, 9)), float(rng.randrange(1, 9))))
    return spark.createDataFrame(out, TICK), out


def test_tick_bars_drop_or_keep_the_last(spark):
    df, rows = ticks(spark, 95)
    got = bars.build_bars(df.repartition(7), bars.BarSpec("tick", 10)).orderBy("bar_index").collect()
    assert [r.bar_index for r in got] == list(range(9))
    for r in got:
        part = [x[3] for x in rows[r.bar_index * 10 : r.bar_index * 10 + 10]]
        assert (r.bid_open, r.bid_high, r.bid_low, r.bid_close, r.tick_count) == (part[0], max(part), min(part), part[-1], 10)
    assert bars.build_bars(df, bars.BarSpec("tick", 10, keep_partial=True)).count() == 10
    assert bars.build_bars(df.limit(0), bars.BarSpec("tick", 10)).count() == 0


@pytest.mark.parametrize("kind,amount", [("volume", lambda r: r[5] + r[6]), ("dollar", lambda r: r[3] * r[5] + r[4] * r[6])])
def test_reset_bars_match_a_loop(spark, kind, amount):
    a, rows_a = ticks(spark, 300, 2, "A")
    b, rows_b = ticks(spark, 150, 3, "B")
    threshold = 40 if kind == "volume" else 4000
    got = {(r.symbol, r.bar_index): r.tick_count for r in bars.build_bars(a.unionByName(b).repartition(5), bars.BarSpec(kind, threshold)).collect()}
    want = {}
    for rows in (rows_a, rows_b):
        bar, held = 0, 0.0
        for r in rows:
            want[r[0], bar] = want.get((r[0], bar), 0) + 1
            held += amount(r)
            if held >= threshold:
                bar, held = bar + 1, 0.0
    assert got == want


def test_specs_are_checked():
    assert bars.BarSpec.parse("tick100").threshold == 100 and bars.BarSpec.parse("volume_bar", 5).kind == "volume_cum"
    for make in (lambda: bars.BarSpec("range", 1), lambda: bars.BarSpec("tick", 0), lambda: bars.BarSpec.from_config({"type": "tick"}), lambda: bars.BarSpec.parse("hour")):
        with pytest.raises(ValueError):
            make()


def test_cleaning_keeps_first_rows_and_drops_bad_ones(spark):
    rows = [("A", i, START + dt.timedelta(seconds=i // 2 * 2 if i < 4 else i), 1.1, 1.2, 1.0, 1.0) for i in range(10)]
    assert [r.seq for r in clean.dedupe(spark.createDataFrame(rows, TICK)).orderBy("seq").collect()] == [0, 2, 4, 5, 6, 7, 8, 9]
    bad = spark.createDataFrame([("A", 0, START, float("nan"), 1.0, 1.0, 1.0), ("A", 1, START, 2.0, 1.0, 1.0, 1.0), ("A", 2, START, -1.0, 1.0, 1.0, 1.0), ("A", 3, START, 1.0, 1.0, 1.0, 1.0)], TICK)
    assert [r.seq for r in clean.validate_and_clean(bad).collect()] == [3]
    assert nan_to_null(bad).where("bidPrice is null").count() == 1
    df, rows = ticks(spark, 400, 5)
    spiked = df.withColumn("bidPrice", clean.F.when(clean.F.col("seq").isin(200, 300), 900.0).otherwise(clean.F.col("bidPrice")))
    assert {r.seq for r in df.select("seq").subtract(clean.drop_outliers(spiked).select("seq")).collect()} >= {200, 300}


def test_schema_reports(spark):
    df, _ = ticks(spark, 3)
    assert validate.schema_report(df).is_valid and validate.schema_report(df).has_volume
    report = validate.schema_report(df.drop("askPrice").withColumn("bidPrice", clean.F.lit("x")))
    assert report.missing == ["askPrice"] and report.wrong_type == ["bidPrice"] and not report.is_valid
    with pytest.raises(ValueError):
        clean.validate_and_clean(df.drop("bidPrice"))


def test_time_bars_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    df, _ = ticks(spark, 120)
    df.unionByName(df.limit(1).withColumn("timestamp", clean.F.lit(START + dt.timedelta(days=2))).withColumn("seq", clean.F.lit(10_000).cast("long"))).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streaming.time_bars(streaming.dedupe_stream(spark.readStream.schema(TICK).parquet(f"{tmp_path}/in")), late=None)
    q = stream.writeStream.outputMode("append").format("memory").queryName("bars").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    key = lambda r: (r.timestamp, r.bid_open, r.bid_close, r.tick_count)
    want = sorted(key(r) for r in streaming.time_bars(df).collect())
    assert sorted(key(r) for r in spark.table("bars").collect()) == want
