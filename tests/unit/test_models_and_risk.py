import collections
import dataclasses
import hashlib
import itertools
import math
import random
import sys
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tickweave.functions import draws, prefix
from tickweave.operators import folds, forest, regimes, risk, stats
from tickweave.plans import experiment
from tickweave.sources import runs
from tickweave.sources import ticks as sources

PNLS = [10.0, -5.0, 20.0, -10.0, 15.0, -3.0, 8.0, -2.0]


def log(spark, pnls=PNLS):
    rows = [("A", i, p) for i, p in enumerate(pnls)]
    return spark.createDataFrame(rows, "symbol string, entry_bar long, pnl double").withColumn("exit_timestamp", F.timestamp_seconds(F.col("entry_bar") * 3600))


def test_monte_carlo_is_seeded_and_plausible(spark):
    a = risk.monte_carlo(log(spark), 400, 100, 10_000.0).first()
    assert a == risk.monte_carlo(log(spark).repartition(3), 400, 100, 10_000.0).first()
    assert abs(a.mean_final_capital - (10_000 + 100 * np.mean(PNLS))) < 60 and a.prob_ruin == 0 and 0 <= a.mean_max_dd < 0.1
    sure = risk.prop_firm(risk.monte_carlo(log(spark, [-600.0]), 20, 100, 10_000.0)).first()
    assert sure.prob_ruin == 1 and not sure.viable and sure.mean_final_capital == 10_000 - 1200


def md5_draw(*keys):
    return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:12], 16)


def test_simulations_equal_a_loop(spark):
    got = {r.sim: (r.final_capital, r.max_dd, r.ruined, r.reached) for r in risk.simulate(log(spark).repartition(3), 50, 40, 100.0, 0.2, 0.3).collect()}
    for sim in range(50):
        c = peak = 100.0
        dd, ruined, reached = 0.0, False, False
        for step in range(40):
            c += PNLS[md5_draw(sim, step, 42) % len(PNLS)]
            peak = max(peak, c)
            dd = max(dd, (peak - c) / peak)
            ruined, reached = c <= 80, c >= 130
            if ruined or reached:
                break
        assert got[sim] == pytest.approx((c, dd, ruined, reached))
    empty = risk.simulate(log(spark).limit(0), 3, 5, 100.0, 0.2, 0.3).collect()
    assert [tuple(r) for r in empty] == [(i, 100.0, 0.0, False, False) for i in range(3)]


def coefficients(spark, n, seed=7):
    return np.array([tuple(r)[1:] for r in draws.resamples(spark, n, seed).orderBy("k").collect()], np.int64)


@pytest.mark.parametrize("n", [1, 3, 40, 1000, 10**7])
def test_weights_of_many_rows_are_poisson(spark, n):
    w = draws.poisson_weights(coefficients(spark, 200), np.arange(400, dtype=np.int64) * n, n)
    assert abs(w.mean() / n - 1) < 5 / math.sqrt(n * w.size) and abs(w.var() / n - 1) < 0.03
    assert abs(np.std(w.sum(axis=0)) / math.sqrt(400 * n) - 1) < 0.2


def test_larger_means_are_drawn_in_parts(spark, monkeypatch):
    monkeypatch.setattr(draws, "LARGEST_MEAN", 8)
    w = draws.poisson_weights(coefficients(spark, 300), np.arange(300, dtype=np.int64) * 21, 21)
    assert abs(w.mean() - 21) < 0.1 and abs(w.var() - 21) < 0.5
    monkeypatch.undo()
    low, shares = draws.poisson_table(5)
    assert low == 0 and np.allclose(shares[:9], np.cumsum([math.exp(-5) * 5**k / math.factorial(k) for k in range(9)]), atol=1e-14)


def weighted_statistics(spark, values, n, seed, name):
    """The statistic of each resample, from a list of each value with its weights."""
    known = np.unique(values)
    before = np.array([sum(v < x for v in values) for x in known], np.int64)
    many = [values.count(x) for x in known]
    w = np.concatenate([draws.poisson_weights(coefficients(spark, n, seed), before[i : i + 1], m) for i, m in enumerate(many)])
    out = []
    for k in range(n):
        sample = np.repeat(known, w[:, k])
        out.append({"mean": np.mean, "median": np.median, "sharpe": lambda x: np.mean(x) / np.std(x) * math.sqrt(252)}[name](sample))
    return out


@pytest.mark.parametrize("name", ["mean", "median", "sharpe"])
def test_statistics_of_resamples(spark, name):
    rng = random.Random(4)
    values = [float(rng.randrange(-3, 9)) for _ in range(150)] + [round(rng.gauss(0, 2), 3) for _ in range(60)]
    got = stats.bootstrap_ci(log(spark, values), n_bootstrap=150, seed=7, statistic=name).first()
    each = weighted_statistics(spark, values, 150, 7, name)
    assert np.isclose(got.lower, np.quantile(each, 0.025)) and np.isclose(got.upper, np.quantile(each, 0.975))
    assert np.isclose(got[name], {"mean": np.mean, "median": np.median, "sharpe": lambda x: np.mean(x) / np.std(x) * math.sqrt(252)}[name](values))
    none = stats.bootstrap_ci(log(spark, values).limit(0), statistic=name).first()
    assert none.lower is None and none[name] == (0.0 if name == "mean" else None)


def test_two_values_in_many_rows(spark):
    df = spark.range(10_000_000).select(F.when(F.col("id") % 4 == 0, 1.0).otherwise(-1.0).alias("pnl"))
    start = time.time()
    got = stats.bootstrap_ci(df, n_bootstrap=1000).first()
    assert time.time() - start < 60
    assert got.mean == -0.5 and abs((got.upper - got.lower) / (2 * 1.96 * math.sqrt(0.75 / 1e7)) - 1) < 0.1
    with pytest.raises(ValueError):
        stats.bootstrap_ci(df, statistic="mode")


def test_exact_u_shares_against_enumeration():
    for n1, n2 in ((1, 1), (2, 3), (4, 4), (3, 8), (8, 3), (5, 6)):
        counts = collections.Counter(sum(1 for i in chosen for j in range(n1 + n2) if j not in chosen and j < i) for chosen in itertools.combinations(range(n1 + n2), n1))
        want = [sum(c for u, c in counts.items() if u <= k) / math.comb(n1 + n2, n1) for k in range(n1 * n2 + 1)]
        assert np.allclose(stats.u_shares(n1, n2), want, atol=1e-12)


def test_small_samples_have_exact_p_values(spark):
    a, b = [1.1, 2.5, 3.7, 4.2, 0.3], [0.5, 1.9, 2.2, 0.1, 0.2, 0.7, 0.25]
    u = sum(x > y for x in a for y in b)
    counts = collections.Counter(sum(1 for i in chosen for j in range(12) if j not in chosen and j < i) for chosen in itertools.combinations(range(12), 5))
    upper, lower = (sum(c for k, c in counts.items() if f(k)) / math.comb(12, 5) for f in (lambda k: k >= u, lambda k: k <= u))
    got = {alt: stats.mann_whitney(log(spark, a), log(spark, b), alternative=alt) for alt in stats.ALTERNATIVES}
    assert got["greater"]["u"] == u and np.isclose(got["greater"]["p_value"], upper) and np.isclose(got["less"]["p_value"], lower)
    assert np.isclose(got["two-sided"]["p_value"], min(1, 2 * min(upper, lower)))
    tied = stats.mann_whitney(log(spark, a), log(spark, [1.1, *b]))
    assert tied["method"] == "normal" and got["less"]["method"] == "exact"


def test_value_places(spark, monkeypatch):
    rng = random.Random(9)
    values = [round(rng.gauss(0, 3), 1) for _ in range(500)] + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "x double").groupBy("x").agg(F.count("*").alias("n"))
    for ranges in (2, 7, 256):
        monkeypatch.setattr(prefix, "RANGES", ranges)
        got = {r.x: r.before for r in prefix.value_places(df, "x", "n").collect()}
        assert got == {v: sum(u < v for u in values) for v in values}


def test_t_and_u_tests(spark):
    rng = random.Random(2)
    a, b = [rng.gauss(0.3, 1) for _ in range(60)], [rng.gauss(0, 1.2) for _ in range(50)]
    got = stats.t_test(log(spark, a), log(spark, b))
    pooled = ((59 * np.var(a, ddof=1)) + 49 * np.var(b, ddof=1)) / 108
    assert np.isclose(got["t"], (np.mean(a) - np.mean(b)) / math.sqrt(pooled * (1 / 60 + 1 / 50)))
    assert np.isclose(stats.t_tail(2.0, 10), 0.03669402, atol=1e-7) and np.isclose(stats.t_tail(-1.0, 5), 0.8183913, atol=1e-6)
    u = stats.mann_whitney(log(spark, a), log(spark, b))
    assert u["u"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b) and np.isclose(u["median1"], np.median(a))
    assert stats.t_test(log(spark, a).limit(0), log(spark, b))["p_value"] == 1.0 and stats.mann_whitney(log(spark, a), log(spark, b).limit(0))["p_value"] == 1.0
    with pytest.raises(ValueError):
        stats.t_test(log(spark), log(spark), alternative="more")
    ci = stats.bootstrap_ci(log(spark, a), n_bootstrap=400).first()
    assert ci.lower < np.mean(a) < ci.upper and abs((ci.upper - ci.lower) - 2 * 1.96 * np.std(a) / math.sqrt(60)) < 0.12
    assert stats.compare(log(spark, [x + 5 for x in a]), log(spark, b))["model_better"] and stats.bootstrap_ci(log(spark, a).limit(0)).first().mean == 0.0


def test_hmm_recovers_states(spark, monkeypatch):
    rng = np.random.default_rng(3)
    state, states = 0, []
    for _ in range(1500):
        state = state if rng.random() < 0.97 else 1 - state
        states.append(state)
    x = rng.normal(0, 1, (1500, 2)) * np.where(np.array(states) == 0, 0.5, 2.0)[:, None] + np.where(np.array(states) == 0, 0.0, 3.0)[:, None]
    rows = [("A", i, float(a), float(b) if i != 7 else None) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, bar_index long, a double, b double")
    model = regimes.fit_hmm(df, ["a", "b"], 2, 15)
    assert all(b >= a - 1e-6 for a, b in zip(model.log_likelihood, model.log_likelihood[1:]))
    got = {r.bar_index: r for r in regimes.regimes(df, model).collect()}
    assert got[7].macro_state == -1 and got[7].macro_state_0_proba == 0.0
    hits = np.mean([got[i].macro_state == s for i, s in enumerate(states) if i != 7])
    assert max(hits, 1 - hits) > 0.97
    for size in (400, 37):  # results don't depend on how rows are dealt to tasks
        monkeypatch.setattr(regimes, "SEGMENT", size)
        cut = {r.bar_index: r for r in regimes.regimes(df, model).collect()}
        assert len(cut) == 1500 and all(cut[i].macro_state == got[i].macro_state and abs(cut[i].macro_state_0_proba - got[i].macro_state_0_proba) < 1e-9 for i in cut)
    again = regimes.fit_hmm(df, ["a", "b"], 2, 3)
    monkeypatch.setattr(regimes, "SEGMENT", 50_000)
    whole = regimes.fit_hmm(df, ["a", "b"], 2, 3)
    assert np.allclose(again.move, whole.move) and np.allclose(again.means, whole.means) and np.allclose(again.log_likelihood, whole.log_likelihood)


def labelled(spark, n=400):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        x, y = rng.random(), rng.random()
        rows.append((i, x, y, 1 if x + 0.2 * rng.random() > 0.75 else -1, x - 0.6))
    return spark.createDataFrame(rows, "row_idx long, x double, y double, label int, pnl double")


def test_forest_cross_validation_calibration_and_storage(spark, tmp_path):
    rows = labelled(spark).cache()
    metrics, scored = forest.cross_validate(rows, folds.time_series_folds(rows.select("row_idx"), 2), ["x", "y"], forest.ForestSpec(10, 4))
    assert all(r.accuracy > 0.85 for r in metrics.collect())
    assert scored.where("probability between 0 and 1").count() == scored.count()
    model = forest.fit_forest(rows, ["x", "y"], forest.ForestSpec(10, 4))
    top = forest.importances(model, ["x", "y"]).first()
    assert top.feature == "x"
    for method in ("isotonic", "sigmoid"):
        out = forest.calibrated(forest.calibrate(scored, method), scored)
        assert out.where("calibrated < 0 or calibrated > 1").count() == 0
    meta = forest.meta_training_rows(scored)
    assert {"primary_proba", "meta_label"} <= set(meta.columns)
    model.write().overwrite().save(f"{tmp_path}/model")
    again = runs.load_model(f"{tmp_path}/model")
    batch = runs.rows_from(spark, [{"x": 0.9, "y": 0.1}, {"x": 0.05, "y": 0.5}])
    assert [r.prediction for r in experiment.score_batch(again, batch).collect()] == [1, -1] and runs.loaded_models()
    for bad in (lambda: runs.load_model("ftp://x"), lambda: forest.calibrate(scored, "other"), lambda: runs.rows_from(spark, []), lambda: forest.ForestSpec.from_config({"backend": "tpu"})):
        with pytest.raises(ValueError):
            bad()


def test_sources_and_runs(spark, tmp_path):
    syn = sources.synthetic_ticks(spark, 500)
    assert syn.count() == 500 and syn.where("askPrice <= bidPrice").count() == 0
    assert sorted(map(tuple, syn.collect())) == sorted(map(tuple, sources.synthetic_ticks(spark, 500).repartition(5).collect()))
    raw = syn.select(F.unix_millis("timestamp").alias("timestamp"), "askPrice", "bidPrice", "askVolume", "bidVolume")
    raw.coalesce(1).write.option("header", True).csv(f"{tmp_path}/t.csv")
    sources.csv_to_parquet(spark, f"{tmp_path}/t.csv", f"{tmp_path}/t.parquet")
    for name in ("t.csv", "t.parquet"):
        assert sources.read_ticks(spark, f"{tmp_path}/{name}", symbol="S").agg(F.round(F.sum("bidPrice"), 6)).first()[0] == syn.agg(F.round(F.sum("bidPrice"), 6)).first()[0]
    raw.coalesce(1).write.parquet(f"{tmp_path}/noname")
    assert sources.detect_format(spark, f"{tmp_path}/noname") == "parquet" and sources.detect_format(spark, "x.csv") == "csv"
    assert sources.validate_file(spark, f"{tmp_path}/t.csv")[0].is_valid
    spark.range(3).selectExpr("cast(id as string) as value").coalesce(1).write.text(f"{tmp_path}/junk")
    with pytest.raises(ValueError):
        sources.detect_format(spark, f"{tmp_path}/junk")
    assert sources.convert_all(spark, {f"{tmp_path}/t.csv": f"{tmp_path}/o", f"{tmp_path}/no.csv": f"{tmp_path}/p"})[f"{tmp_path}/t.csv"] == "converted"
    runs.record(spark, f"{tmp_path}/runs", "r1", {"a": 1}, {"m": 0.5}, {"model": "/m1"})
    runs.record(spark, f"{tmp_path}/runs", "r2", {"a": 2}, {"m": 0.6}, {"model": "/m2"})
    assert [r.run_id for r in runs.list_runs(spark, f"{tmp_path}/runs", 5).collect()] == ["r2", "r1"]


def test_experiment_end_to_end(spark):
    ticks = sources.synthetic_ticks(spark, 12_000, seed=3)
    e = experiment.Experiment.from_config({"bars": {"type": "tick", "threshold": 20}, "labeling": {"tp_ticks": 60, "sl_ticks": 60, "max_horizon_bars": 12, "min_horizon_bars": 2}, "assets": {"tick_size": 1e-5}})
    e = dataclasses.replace(e, n_splits=2, forest=forest.ForestSpec(5, 3), n_simulations=50)
    later = sources.synthetic_ticks(spark, 6_000, seed=4, start="2024-02-05 00:00:00")
    out = experiment.run(spark, ticks, e, later)
    assert out["bars"].count() == 600 and out["fold_metrics"].count() == 2
    # trades lie in the later source; its bars were neither trained on nor labelled
    assert out["traded_bars"].count() == 300 and out["trades"].where("entry_timestamp < '2024-02-05'").count() == 0
    assert out["signals"].count() > 0 and out["signals"].where("timestamp < '2024-02-05'").count() == 0
    # no row's primary or meta probability comes from a model that was trained on it: only tested rows have one
    tested = out["folds"].where("role = 'test'").select("row_idx").distinct()
    assert 0 < out["predictions"].count() <= tested.count() and out["predictions"].join(tested, "row_idx", "left_anti").count() == 0
    assert out["meta_metrics"].count() >= 1 and set(out["models"]) == {"primary", "meta"}
    assert out["trades"].select("strategy").distinct().count() >= 3 and out["metrics"].count() >= 3
    page = experiment.report(out)
    assert "<h2>risk</h2>" in page and "prob_ruin" in page
    _, columns = experiment.training_table(out["bars"], e)
    assert not {"exit_price", "entry_price", "pnl", "label", "effective_horizon"} & set(columns)
    assert experiment.merge_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


CONFIG = {
    "experiment": {"name": "n", "seed": 7},
    "assets": {"symbol": "X", "tick_size": 0.01, "pip_value": 0.1},
    "session": {"timezone": "UTC", "session_start": "01:00", "session_end": "20:00", "friday_end": "19:00", "weekend_trading": True, "labeling": {"max_horizon_bars": 40, "min_horizon_bars": 4}},
    "data": {"bars": {"type": "tick", "threshold": 50}, "cleaning": {"enabled": True}, "session_filter": True},
    "labeling": {"triple_barrier": {"distance_mode": "mfe_mae", "mfe_mae": {"horizon_bars": 16, "tp_quantile": 0.6, "sl_quantile": 0.4}, "max_horizon_bars": 24}},
    "models": {"random_forest": {"params": {"n_estimators": 20, "max_depth": 3, "min_samples_leaf": 5, "class_weight": "balanced", "n_jobs": -1}}, "meta_model": {"enabled": True, "threshold": 0.6}},
    "validation": {"cv_type": "cpcv", "n_groups": 5, "n_test_groups": 2, "embargo_duration": 3, "max_combinations": 4},
    "backtest": {"capital": {"initial": 500.0}, "sizing": {"mode": "fixed", "size": 2.0}, "commission": {"type": "percentage", "value": 0.001}, "slippage": {"enabled": True, "fixed_slippage_ticks": 2}, "meta_model": {"enabled": False}},
    "risk": {"monte_carlo": {"n_sims": 30, "prop_firm": {"max_total_loss": 0.2, "target_profit": 0.3}}},
    "mlflow": {"enabled": True},
}


def test_configuration_is_read_whole(tmp_path):
    e = experiment.Experiment.from_config(CONFIG)
    assert (e.bars.threshold, e.tick_size, e.distance, e.max_horizon, e.min_horizon, e.quantiles, e.excursion) == (50, 0.01, None, 24, 4, (0.6, 0.4), 16)
    assert (e.calendar.start, e.calendar.end, e.calendar.friday_end, e.calendar.weekend_trading) == ("01:00", "20:00", "19:00", True)
    assert (e.cv, e.cpcv, e.max_combinations, e.forest.n_trees, e.forest.min_leaf) == ("cpcv", (5, 2, 3), 4, 20, 5)
    assert (e.clean_ticks, e.session_filter, e.meta, e.initial_cash, e.size, e.commission, e.slippage) == (True, True, False, 500.0, 2.0, 0.001, 0.02)
    assert (e.n_simulations, e.max_drawdown, e.target, e.seed) == (30, 0.2, 0.3, 7)
    for name in ("c.json", "c.yaml"):
        if name.endswith("yaml"):
            pytest.importorskip("yaml")
        experiment.save_config(CONFIG, f"{tmp_path}/{name}")
        assert experiment.load_config(f"{tmp_path}/{name}") == CONFIG


@pytest.mark.parametrize("change", [{"labelling": {}}, {"labeling": {"triple_barrier": {"distance_mode": "ticks", "tp_ticks": 0, "sl_ticks": 5}}}, {"validation": {"cv_type": "loo"}}, {"validation": {"folds": 3}}, {"backtest": {"sizing": {"mode": "kelly"}}}, {"models": {"random_forest": {"params": {"depth": 3}}}}, {"assets": {"ticks": 1}}])
def test_bad_configurations_are_refused(change):
    with pytest.raises(ValueError):
        experiment.Experiment.from_config({**CONFIG, **change})
    for bad in ({}, {"bars": {"type": "tick"}, "labeling": {}}):
        with pytest.raises((ValueError, KeyError)):
            experiment.Experiment.from_config(bad)


def hmm_rows(spark, n=300, seed=1):
    rng, rows, state = np.random.default_rng(seed), [], 0
    for i in range(n):
        state = state if rng.random() < 0.95 else 1 - state
        rows.append(("S", i, *(rng.normal(4 * state, 1, 2).tolist() if i != 7 else (None, None))))
    return spark.createDataFrame(rows, "symbol string, bar_index long, a double, b double")


def test_filtered_regimes_do_not_look_ahead(spark, monkeypatch):
    df = hmm_rows(spark)
    model = regimes.fit_hmm(df, ["a", "b"], 2, n_init=3)
    assert model.log_likelihood[-1] >= regimes.fit_hmm(df, ["a", "b"], 2).log_likelihood[-1]
    whole = regimes.filtered(df, model, "macro").orderBy("bar_index").toPandas()
    assert whole["macro_regime"][7] == -1 and abs(whole.drop(index=7)[["macro_regime_0_proba", "macro_regime_1_proba"]].sum(axis=1) - 1).max() < 1e-9
    later = df.withColumn("a", F.when(F.col("bar_index") >= 200, 99.0).otherwise(F.col("a")))
    pd.testing.assert_frame_equal(whole[:200], regimes.filtered(later, model, "macro").orderBy("bar_index").toPandas()[:200])
    for size in (16, 64):
        monkeypatch.setattr(regimes, "SEGMENT", size)
        pd.testing.assert_frame_equal(whole, regimes.filtered(df, model, "macro").orderBy("bar_index").toPandas(), atol=1e-9)


def test_experiment_with_regimes_and_distances_of_each_symbol(spark):
    ticks = sources.synthetic_ticks(spark, 8_000, seed=3, symbol="A").unionByName(sources.synthetic_ticks(spark, 8_000, seed=5, symbol="B|x").withColumns({c: F.col(c) * 3 - 2 for c in ("bidPrice", "askPrice")}))
    hmm = {"macro": {"enabled": True, "n_states": 2, "max_iter": 3, "n_init": 2, "covariance_type": "diag", "features": ["ret_long", "vol_long"]}, "micro": {"enabled": False}}
    config = {"bars": {"type": "tick", "threshold": 20}, "labeling": {"distance_mode": "mfe_mae", "max_horizon_bars": 12, "min_horizon_bars": 2}, "assets": {"tick_size": 1e-5}, "models": {"hmm": hmm}}
    e = dataclasses.replace(experiment.Experiment.from_config(config), n_splits=2, forest=forest.ForestSpec(3, 3), n_simulations=20, meta=False)
    assert e.hmm == (experiment.Regimes("macro", 2, ("ret_long", "vol_long"), "diag", 3, 2),)
    later = sources.synthetic_ticks(spark, 4_000, seed=4, start="2024-02-05 00:00:00", symbol="A")
    out = experiment.run(spark, ticks, e, later)
    assert {"macro_regime", "macro_regime_0_proba"} <= {r.feature for r in out["importances"].collect()} and "macro_hmm" in out["models"]
    assert out["signals"].count() > 0 and out["traded_bars"].count() == 200
    d = {r.symbol: r for r in experiment.labeling.suggest_distances(out["bars"], 12, 1e-5).collect()}
    assert len(d) == 2 and d["A"].tp_price != d["B|x"].tp_price
    both = experiment.run(spark, ticks, e)
    hits = both["trades"].where("reason = 'tp'").join(both["bars"].select("symbol", F.col("bar_index").alias("entry_bar"), "bid_close"), ["symbol", "entry_bar"]).select("symbol", (F.col("exit_price") - F.col("bid_close")).alias("gain"), "exit_bar").collect()
    bars_at = {(r.symbol, r.bar_index): r for r in both["bars"].collect()}
    start = {(r.symbol, r.entry_bar, r.exit_bar) for r in both["trades"].where("reason = 'tp'").collect()}
    assert hits and all(bars_at[s, x].bid_high >= bars_at[s, b].bid_close + d[s].tp_price - 1e-12 for s, b, x in start)
    assert {r.symbol for r in both["metrics"].select("symbol").distinct().collect()} == {"A", "B|x"}
    with pytest.raises(ValueError):
        experiment.Experiment.from_config({**config, "models": {"hmm": {"macro": {"enabled": True, "states": 3}}}})


def test_hmm_against_all_paths_and_in_few_steps():
    rng = np.random.default_rng(4)

    def model(k):
        return regimes.GaussianHMM(["a"], np.zeros(1), np.ones(1), rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.normal(size=(k, 1)), 0.5 + rng.random((k, 1, 1)), [])

    for n in (1, 2, 3, 5, 8):
        m, x = model(3), rng.normal(size=(n, 1))
        before, after = rng.dirichlet(np.ones(3)), rng.random(3)
        dense = m.log_density(x)
        for b, a in ((None, None), (before, after)):
            paths = list(itertools.product(range(3), repeat=n))
            weights = np.array([np.log(m.start if b is None else b @ m.move)[p[0]] + sum(dense[t, s] for t, s in enumerate(p)) + sum(np.log(m.move[i, j]) for i, j in zip(p, p[1:])) + (0 if a is None else np.log(a[p[-1]])) for p in paths])
            share = np.exp(weights - weights.max())
            share /= share.sum()
            want = np.array([[sum(w for p, w in zip(paths, share) if p[t] == s) for s in range(3)] for t in range(n)])
            got, pair, likelihood = m.forward_backward(x, b, a)
            assert np.allclose(got, want) and abs(pair.sum() - (n - (b is None))) < 1e-9
            if a is None:
                assert abs(likelihood - (weights.max() + np.log(np.exp(weights - weights.max()).sum()))) < 1e-9
            scores = [weights[i] + (0 if b is None else np.log(b[:, None] * m.move).max(0)[p[0]] - np.log(b @ m.move)[p[0]]) for i, p in enumerate(paths)]
            assert tuple(m.viterbi(x, None if b is None else np.log(b), None if a is None else np.log(a))) == paths[int(np.argmax(scores))]
    m, x = model(3), rng.normal(size=(20_000, 1))
    for work in (m.forward_backward, m.viterbi, m.forward, lambda x: m.transfer(x, False)):
        calls = [0]
        sys.setprofile(lambda *_: calls.__setitem__(0, calls[0] + 1))
        try:
            work(x)
        finally:
            sys.setprofile(None)
        assert calls[0] < 20_000  # not a call for each row
