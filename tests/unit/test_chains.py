import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tickweave.functions import chains
from tickweave.operators import backtest, bars


def stepwise_bars(amounts, threshold):
    """The bar of each tick, one tick after the other."""
    out, held, bar = [], 0.0, 0
    for x in amounts:
        out.append(bar)
        held += x or 0.0
        if held >= threshold:
            held, bar = 0.0, bar + 1
    return out


def stepwise_trades(entries):
    taken, free = [], -1
    for entry, out in entries:
        if entry > free:
            taken.append(entry)
            free = out
    return taken


def ticks_of(amounts):
    """(symbol, seq, timestamp, prices, volumes): bid volumes are the amounts."""
    return [("S", i, i, 1.0, 1.5, float(a), 0.0) for i, a in enumerate(amounts)]


def ticks(spark, rows):
    return spark.createDataFrame(rows, "symbol string, seq long, t long, bidPrice double, askPrice double, bidVolume double, askVolume double").withColumn("timestamp", F.timestamp_seconds("t"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 25), st.integers(1, 20))
def test_pieces_give_the_state_that_steps_lead_to(amounts, threshold, size):
    state, before, expected = float(threshold), 0, stepwise_bars(amounts, threshold)
    for at in range(0, len(amounts), size):
        part = np.array(amounts[at : at + size], float)
        sums = np.cumsum(part)
        steps = chains.Steps(sums, sums + threshold, float(sums[-1]), threshold)
        found, rows = chains.pieces(steps), chains.taken_rows(steps, state)
        rank = before + np.cumsum(np.isin(np.arange(len(part)), rows)) - np.isin(np.arange(len(part)), rows)
        assert rank.tolist() == expected[at : at + size]
        i = int(np.searchsorted(found.upper, state))
        if i == len(found.upper):
            assert not len(rows)
            state -= steps.shift
        else:
            assert found.taken[i] == len(rows)
            state, before = found.after[i], before + len(rows)


def test_pieces_stay_few_where_bars_are_short():
    amounts = np.random.default_rng(1).integers(1, 100, 65_536).astype(float)
    sums = np.cumsum(amounts)
    assert len(chains.pieces(chains.Steps(sums, sums + 2000, float(sums[-1]), 2000)).upper) < 60


@pytest.mark.parametrize("size", [7, 64, 100_000])
def test_volume_bars_do_not_depend_on_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(chains, "BLOCK", size)
    rng = random.Random(4)
    made = {s: [rng.choice((0, 1, 3, 40)) for _ in range(n)] for s, n in (("A", 500), ("B", 1), ("C", 63), (None, 70), ("!", 5))}
    rows = [(s, i, i, 1.0, 1.5, float(a) if a else None, None if i % 3 else 0.0) for s, xs in made.items() for i, a in enumerate(xs)]
    # one side may be missing: then the sum is, and counts as 0
    known = {s: [x if x and not i % 3 else 0 for i, x in enumerate(xs)] for s, xs in made.items()}
    got = bars.build_bars(ticks(spark, rows).repartition(6), bars.BarSpec("volume", 50.0)).select("symbol", "bar_index", "tick_count").collect()
    expected = {}
    for s, xs in known.items():
        for b in stepwise_bars(xs, 50.0):
            expected[s, b] = expected.get((s, b), 0) + 1
    assert {(r.symbol, r.bar_index): r.tick_count for r in got} == expected and len(got) == len(expected)


def test_bars_longer_than_blocks(spark, monkeypatch):
    monkeypatch.setattr(chains, "BLOCK", 5)
    amounts = [1, 0, 2] * 40
    got = bars.build_bars(ticks(spark, ticks_of(amounts)), bars.BarSpec("volume", 33.0)).select("bar_index", "tick_count").collect()
    expected = stepwise_bars(amounts, 33.0)
    assert {r.bar_index: r.tick_count for r in got} == {b: expected.count(b) for b in expected}


def test_amounts_below_zero_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(chains, "BLOCK", 3)
    with pytest.raises(Exception, match="amounts below 0"):
        bars.build_bars(ticks(spark, ticks_of([1, 1, -9, 1, 1, 1])), bars.BarSpec("volume", 5.0)).count()
    assert bars.build_bars(ticks(spark, []), bars.BarSpec("volume", 5.0)).count() == 0


@pytest.mark.parametrize("blocks", [1, 10, 50])
def test_one_symbols_positions_in_many_blocks(spark, monkeypatch, blocks):
    n, rng = 400, random.Random(blocks)
    monkeypatch.setattr(chains, "BLOCK", n // blocks)
    entries = [(i, i + rng.randrange(1, 30)) for i in range(n) if rng.random() < 0.6]
    rows = spark.createDataFrame([("S", e, x) for e, x in entries] + [("T", 3, 9)], "symbol string, entry_bar long, exit_bar long").repartition(5)
    taken = chains.along_chain(rows, "entry_bar", backtest._free_steps(30), ("exit_bar",), 0.0).where("taken")
    got = sorted((r.symbol, r.entry_bar, r.rank) for r in taken.collect())
    assert got == [("S", e, i) for i, e in enumerate(stepwise_trades(entries))] + [("T", 3, 0)]
