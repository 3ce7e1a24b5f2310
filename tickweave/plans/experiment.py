"""The whole experiment: ticks to bars, features, labels, folds, models, backtest, comparison, risk and report.

Up to the training table all is one lazy plan. Bars are written once, as features, labels and the backtest all start there.
"""

from __future__ import annotations

import html
import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions.stored import stored
from ..functions.windows import in_blocks
from ..operators import backtest, bars, clean, folds, forest, labeling, performance, regimes, risk, signals, stats
from ..operators.session import SessionCalendar


@dataclass(frozen=True)
class Regimes:
    """A hidden Markov model of bars. kind: macro (returns, volatility and trend over 50 bars) or micro (order flow and spread)."""

    kind: str = "macro"
    n_states: int = 3
    columns: tuple[str, ...] = ()
    covariance: str = "full"
    n_iter: int = 20
    n_init: int = 1

    def __post_init__(self):
        if self.kind not in _REGIME_COLUMNS:
            raise ValueError(f"unknown kind of regimes: {self.kind}")
        if unknown := sorted(set(self.columns) - set(_REGIME_COLUMNS[self.kind])):
            raise ValueError(f"{self.kind} regimes have no columns {', '.join(unknown)}")

    @property
    def observed(self) -> list[str]:
        return list(self.columns or _REGIME_COLUMNS[self.kind])

    def rows(self, made: DataFrame) -> DataFrame:
        """The bars with what the model observes."""
        make, before = (ft.macro_features, 100) if self.kind == "macro" else (ft.micro_features, 1)
        return in_blocks(made, make, before).select("symbol", "bar_index", *self.observed)

    def fit(self, rows: DataFrame, seed: int) -> regimes.GaussianHMM:
        return regimes.fit_hmm(rows, self.observed, self.n_states, self.n_iter, self.covariance, seed, n_init=self.n_init)

    @property
    def features(self) -> list[str]:
        return [f"{self.kind}_regime", *[f"{self.kind}_regime_{i}_proba" for i in range(self.n_states)]]


_REGIME_COLUMNS = {"macro": ("ret_long", "vol_long", "trend_slope", "trend_strength"), "micro": ("of_imbalance", "spread", "spread_change", "tick_direction")}


@dataclass(frozen=True)
class Experiment:
    """What an experiment needs. distance: tp and sl in price units, or None for distances from excursions over `excursion` bars."""

    bars: bars.BarSpec = bars.BarSpec("tick", 100)
    calendar: SessionCalendar = field(default_factory=SessionCalendar)
    tick_size: float = 1e-5
    distance: tuple[float, float] | None = None
    max_horizon: int = 32
    min_horizon: int = 5
    quantiles: tuple[float, float] = (0.5, 0.5)
    cv: str = "tscv"
    n_splits: int = 3
    cpcv: tuple[int, int, int] = (6, 2, 10)
    forest: forest.ForestSpec = forest.ForestSpec()
    clean_ticks: bool = False
    session_filter: bool = False
    initial_cash: float = 10_000.0
    excursion: int | None = None
    test_size: int | None = None
    gap: int = 0
    max_combinations: int | None = None
    meta: bool = True
    meta_threshold: float = 0.5
    meta_forest: forest.ForestSpec | None = None
    size: float = 1.0
    commission: float = 0.0
    slippage: float = 0.0
    n_simulations: int = 1000
    max_drawdown: float = 0.1
    target: float = 0.05
    seed: int = 42
    hmm: tuple[Regimes, ...] = ()

    def __post_init__(self):
        if self.distance and min(self.distance) <= 0:
            raise ValueError("barrier distances must be positive")
        if self.cv not in ("tscv", "cpcv"):
            raise ValueError(f"unknown cross-validation: {self.cv}")

    @staticmethod
    def from_config(config: dict) -> Experiment:
        """An experiment from sections; a key that none of them knows is an error, but sections about where results go are left alone."""
        return read_config(config)

    @property
    def backtest(self) -> dict:
        return {"max_bars": self.max_horizon, "initial_cash": self.initial_cash, "size": self.size, "commission": self.commission, "slippage": self.slippage, "use_meta": self.meta, "calendar": self.calendar}


#: Sections that say where data and results lie or who asks; an experiment doesn't depend on them.
ELSEWHERE = ("experiment", "runtime", "reporting", "mlflow", "deployment", "defaults")


class _Section:
    """A part of a configuration that remembers which of its keys were read."""

    def __init__(self, values: dict, name: str):
        self.values, self.name, self.read = dict(values or {}), name, set()

    def get(self, key: str, default=None):
        self.read.add(key)
        return self.values.get(key, default)

    def part(self, key: str) -> _Section:
        return _Section(self.get(key) or {}, f"{self.name}.{key}")

    def done(self, *ignored: str) -> None:
        unknown = sorted(self.values.keys() - self.read - set(ignored))
        if unknown:
            raise ValueError(f"{self.name} has unknown keys: {', '.join(unknown)}")


def read_config(config: dict) -> Experiment:
    top = _Section(config, "configuration")
    data, flat_bars = top.part("data"), top.get("bars")
    made = flat_bars or data.get("bars")
    if made is None or "labeling" not in config:
        raise ValueError("the configuration lacks " + ("labeling" if made is not None else "bars"))
    assets = top.part("assets")
    tick = assets.get("tick_size", 1e-5)
    lab = top.part("labeling")
    lab = lab.part("triple_barrier") if lab.get("triple_barrier") else lab
    kind, mfe = lab.get("distance_mode", "ticks"), lab.part("mfe_mae")
    if kind not in ("ticks", "mfe_mae"):
        raise ValueError(f"unknown distance_mode: {kind}")
    tp, sl = lab.get("tp_ticks"), lab.get("sl_ticks")
    if kind == "ticks" and (tp is None or sl is None or tp <= 0 or sl <= 0):
        raise ValueError("tp_ticks and sl_ticks must be positive")
    session = top.part("session")
    room = session.part("labeling")
    names = {"timezone": "timezone", "session_start": "start", "start": "start", "session_end": "end", "end": "end", "friday_end": "friday_end", "weekend_trading": "weekend_trading"}
    hours = {own: session.get(k) for k, own in names.items() if session.get(k) is not None}
    cv, models = top.part("validation"), top.part("models")
    kinds = {"time_series": "tscv", "tscv": "tscv", "cpcv": "cpcv"}
    cv_type = cv.get("cv_type", "time_series")
    if cv_type not in kinds:
        raise ValueError(f"unknown cross-validation: {cv_type}")
    test, cleaning, risks = top.part("backtest"), data.part("cleaning"), top.part("risk")
    meta, capital, carlo = test.part("meta_model"), test.part("capital"), risks.part("monte_carlo")
    firm, commission, slippage = carlo.part("prop_firm"), test.part("commission"), test.part("slippage")
    sizing = test.part("sizing")
    if commission.get("type", "percentage") != "percentage" and commission.get("value", 0.0):
        raise ValueError("a commission is a share of price (percentage)")
    if sizing.get("mode", "fixed") != "fixed":
        raise ValueError("positions have a fixed size")
    markov = models.part("hmm")
    hidden = tuple(_regimes(markov.part(kind), kind) for kind in _REGIME_COLUMNS if (markov.get(kind) or {}).get("enabled", False))
    markov.done()
    primary = models.get("model") or models.get("random_forest") or top.get("model") or {}
    second = models.part("meta_model")
    out = Experiment(
        bars=bars.BarSpec.from_config(made),
        calendar=SessionCalendar(**hours),
        tick_size=tick,
        distance=(tp * tick, sl * tick) if kind == "ticks" else None,
        max_horizon=lab.get("max_horizon_bars", room.get("max_horizon_bars", 32)),
        min_horizon=lab.get("min_horizon_bars", room.get("min_horizon_bars", 5)),
        quantiles=(mfe.get("tp_quantile", 0.5), mfe.get("sl_quantile", 0.5)),
        excursion=mfe.get("horizon_bars"),
        cv=kinds[cv_type],
        n_splits=cv.get("n_splits", 3),
        test_size=cv.get("test_size"),
        gap=cv.get("gap", 0),
        cpcv=(cv.get("n_groups", 6), cv.get("n_test_groups", 2), cv.get("embargo_duration", 10)),
        max_combinations=cv.get("max_combinations"),
        forest=_forest(primary, "model"),
        meta=meta.get("enabled", second.get("enabled", True)),
        meta_threshold=meta.get("threshold", second.get("threshold", 0.5)),
        meta_forest=_forest(second.values, "meta_model") if second.get("params") else None,
        clean_ticks=cleaning.get("enabled", False),
        session_filter=data.get("session_filter", False),
        initial_cash=capital.get("initial", risks.get("starting_capital", 10_000.0)),
        size=sizing.get("size", 1.0),
        commission=commission.get("value", 0.0),
        slippage=(slippage.get("fixed_slippage_ticks", 0.0) * tick) if slippage.get("enabled", False) else 0.0,
        n_simulations=carlo.get("n_sims", risks.get("mc_simulations", 1000)),
        max_drawdown=firm.get("max_total_loss", risks.get("max_total_drawdown", 0.1)),
        target=firm.get("target_profit", 0.05),
        seed=config.get("experiment", {}).get("seed", 42),
        hmm=hidden,
    )
    top.done(*ELSEWHERE, "features")
    for part, ignored in ((assets, ("symbol", "pip_value", "min_lot", "max_lot", "pip_size")), (session, ()), (room, ()), (lab, ("type", "long_only", "meta_label")), (mfe, ()), (cv, ()), (cleaning, ()), (meta, ()), (capital, ()), (commission, ()), (sizing, ()), (slippage, ("model",))):
        part.done(*ignored)
    return out


def _regimes(section: _Section, kind: str) -> Regimes:
    section.get("enabled")
    out = Regimes(kind, section.get("n_states", 3), tuple(section.get("features", ())), section.get("covariance_type", "full"), section.get("max_iter", 20), section.get("n_init", 1))
    section.done()
    return out


def _forest(section: dict, name: str) -> forest.ForestSpec:
    params = section.get("params", section)
    known = {"n_estimators", "max_depth", "min_samples_leaf", "class_weight", "random_state", "n_jobs", "backend"}
    if unknown := sorted(set(section.get("params", {})) - known):
        raise ValueError(f"{name} has unknown keys: {', '.join(unknown)}")
    spec = {"n_estimators": 100, "max_depth": 8} | {k: params[k] for k in known if k in params}
    return forest.ForestSpec.from_config(spec | ({"backend": section["backend"]} if "backend" in section else {}))


def load_config(path: str) -> dict:
    """A configuration from a YAML or JSON file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml  # only where YAML is asked for

    return yaml.safe_load(text) or {}


def save_config(config: dict, path: str) -> None:
    if path.endswith(".json"):
        text = json.dumps(config, indent=1)
    else:
        import yaml

        text = yaml.safe_dump(config, sort_keys=False)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def merge_config(base: dict, over: dict) -> dict:
    """base with over laid upon it, section by section."""
    return base | {k: merge_config(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def build(ticks: DataFrame, e: Experiment) -> DataFrame:
    ticks = clean.chain(ticks, clean.positive_prices, clean.ordered_quotes)
    ticks = clean.clean_ticks(ticks) if e.clean_ticks else ticks
    ticks = e.calendar.session_rows(ticks) if e.session_filter else ticks
    return bars.build_bars(ticks, e.bars)


def label(made: DataFrame, e: Experiment) -> DataFrame:
    if e.distance:
        return labeling.triple_barrier(made, *e.distance, e.max_horizon, e.min_horizon, e.calendar)
    return labeling.triple_barrier_by_excursion(made, e.excursion or e.max_horizon, e.tick_size, *e.quantiles, e.max_horizon, e.min_horizon, e.calendar)


def training_table(made: DataFrame, e: Experiment) -> tuple[DataFrame, list[str]]:
    """Features joined with decided labels, and the names of the features: no label column is among them."""
    table = ft.feature_matrix(made)
    columns = clean.feature_columns(table)
    return labeling.with_labels(table, labeling.decided(label(made, e))), columns


def cv_folds(rows: DataFrame, e: Experiment) -> DataFrame:
    """Folds of labelled rows of all symbols. Labels' spans are compared by time, which symbols share."""
    if e.cv == "tscv":
        return folds.time_series_folds(rows, e.n_splits, e.test_size, e.gap)
    spans = rows.select("row_idx", F.unix_micros("event_start").alias("start_idx"), F.unix_micros("event_end").alias("end_idx"))
    return folds.cpcv_folds(spans, *e.cpcv, limit=e.max_combinations)


def regime_features(made: DataFrame, models: dict[str, regimes.GaussianHMM], e: Experiment) -> DataFrame:
    """symbol, bar_index and the regime features of all bars by one model of each kind; none looks at later bars."""
    out = made.select("symbol", "bar_index")
    for spec in e.hmm:
        out = out.join(regimes.filtered(spec.rows(made), models[spec.kind], spec.kind), ["symbol", "bar_index"])
    return out


def fit_regimes(made: DataFrame, rows: DataFrame, e: Experiment) -> dict[str, regimes.GaussianHMM]:
    """A model of each kind from the bars that are among rows."""
    own = rows.select("symbol", "bar_index").distinct()
    return {spec.kind: spec.fit(spec.rows(made).join(own, ["symbol", "bar_index"], "left_semi"), e.seed) for spec in e.hmm}


def fold_regimes(made: DataFrame, rows: DataFrame, cv: DataFrame, e: Experiment) -> DataFrame:
    """fold_id, row_idx and regime features: each fold's models are fitted on its train rows alone."""
    parts = []
    for fold in [r["fold_id"] for r in cv.select("fold_id").distinct().orderBy("fold_id").collect()]:
        own = cv.where(F.col("fold_id") == fold)
        models = fit_regimes(made, rows.join(own.where("role = 'train'"), "row_idx", "left_semi"), e)
        used = rows.join(own, "row_idx", "left_semi").select("row_idx", "symbol", "bar_index")
        parts.append(used.join(regime_features(made, models, e), ["symbol", "bar_index"]).drop("symbol", "bar_index").withColumn("fold_id", F.lit(fold)))
    return reduce(DataFrame.unionByName, parts)


def out_of_fold(scored: DataFrame) -> DataFrame:
    """row_idx, probability: of each row that is tested in a fold, the mean over models that were not trained on it."""
    return scored.groupBy("row_idx").agg(F.avg("probability").alias("probability"))


def trade_signals(rows: DataFrame, threshold: float) -> DataFrame:
    """Signals of rows with primary_proba and, where there is a second model, meta_proba."""
    meta = F.coalesce((F.col("meta_proba") >= threshold).cast("int"), F.lit(1)) if "meta_proba" in rows.columns else F.lit(1)
    return rows.select("symbol", "bar_index", "timestamp", F.when(F.col("primary_proba") >= 0.5, 1).otherwise(-1).alias("prediction"), F.col("primary_proba").alias("probability"), meta.alias("meta_decision"))


def run(spark: SparkSession, ticks: DataFrame, e: Experiment, test_ticks: DataFrame | None = None) -> dict:
    """bars, labels, folds, metrics of folds, predictions, trades, metrics of each strategy, risk, and the fitted models.

    A primary model says which barrier is met first and learns from decided labels; a second one says whether a trade pays
    and learns from all labels and the primary probability. Both are scored on rows of folds that they were not trained on.
    With test_ticks, a later source of ticks, the models of all training rows trade its bars; otherwise the training
    bars are traded by what the folds' models said of rows outside their training.
    """
    made = stored(build(ticks, e), "bars")
    labels = stored(label(made, e), "labels")
    table = ft.feature_matrix(made)
    columns = clean.feature_columns(table)
    rows = stored(folds.numbered(clean.training_rows(labeling.meta_labels(labeling.with_labels(table, labels)), columns)), "training")
    cv = stored(cv_folds(rows, e), "folds")
    plain, hidden, states = rows, {}, None
    if e.hmm:
        states = stored(fold_regimes(made, rows, cv, e), "fold_regimes")
        hidden = fit_regimes(made, rows, e)
        columns = [*columns, *[c for spec in e.hmm for c in spec.features]]
        rows = stored(rows.join(regime_features(made, hidden, e), ["symbol", "bar_index"]), "training_regimes")
    fold_models = forest.fit_folds(labeling.decided(plain), cv, columns, e.forest, extra=states)
    scored = stored(forest.score_folds(fold_models, plain, cv, extra=states), "scored")
    decided = labeling.decided(rows)
    metrics = performance.classification(labeling.decided(scored), keys=("fold_id",))
    predictions = stored(rows.join(out_of_fold(scored), "row_idx").withColumnRenamed("probability", "primary_proba"), "predictions")
    models = {"primary": forest.fit_forest(decided, columns, e.forest)}
    names, meta_metrics, seen = [*columns, "primary_proba"], None, predictions
    if e.meta:
        spec = e.meta_forest or e.forest
        bare = predictions.drop(*[c for h in e.hmm for c in h.features])
        meta_scored = stored(forest.score_folds(forest.fit_folds(bare, cv, names, spec, "meta_label", 1, states), bare, cv, 1, 0, states), "meta")
        meta_metrics = performance.classification(meta_scored, "meta_label", keys=("fold_id",))
        seen = predictions.join(out_of_fold(meta_scored).withColumnRenamed("probability", "meta_proba"), "row_idx", "left")
        models["meta"] = forest.fit_forest(predictions, names, spec, "meta_label")
    traded = made
    if test_ticks is not None:
        traded = stored(build(test_ticks, e), "test_bars")
        features = ft.feature_matrix(traded)
        seen = _scored_bars(features.join(regime_features(traded, hidden, e), ["symbol", "bar_index"]) if e.hmm else features, models)
    model_signals = stored(trade_signals(seen, e.meta_threshold), "signals")
    distances = None if e.distance else stored(labeling.suggest_distances(made, e.excursion or e.max_horizon, e.tick_size, *e.quantiles).select("symbol", F.col("tp_price").alias("tp"), F.col("sl_price").alias("sl")), "distances")
    spec = backtest.BacktestSpec(*(e.distance or (1.0, 1.0)), distances=distances, **e.backtest)
    baselines = {"buy_and_hold": signals.buy_and_hold, "random": lambda b: signals.random_signals(b, e.seed), "ma_crossover": signals.ma_crossover, "rsi": signals.rsi_signals}
    trades = stored(backtest.run_benchmark(traded, {"model": lambda _: model_signals, **baselines}, spec), "trades")
    out = {
        "bars": made,
        "traded_bars": traded,
        "labels": labels,
        "distribution": labeling.label_distribution(labels),
        "folds": cv,
        "fold_metrics": metrics,
        "predictions": predictions.withColumn("prediction", F.when(F.col("primary_proba") >= 0.5, 1).otherwise(-1)),
        "importances": forest.importances(models["primary"], columns),
        "signals": model_signals,
        "trades": trades,
        "metrics": strategy_metrics(trades, e.initial_cash),
        "risk": risk.prop_firm(risk.monte_carlo(trades.where("strategy = 'model'"), e.n_simulations, 100, e.initial_cash, e.max_drawdown, e.target, e.seed)),
        "models": models | {f"{kind}_hmm": m for kind, m in hidden.items()},
    }
    return out | ({"meta_metrics": meta_metrics, "meta": seen} if meta_metrics is not None else {})


def _scored_bars(table: DataFrame, models: dict) -> DataFrame:
    """Feature rows with primary_proba and, where there is a second model, meta_proba; rows with undefined features are left out."""
    keys = ["symbol", "bar_index"]
    one = forest.predict(models["primary"], table).withColumnRenamed("probability", "primary_proba").drop("prediction")
    if "meta" not in models:
        return one
    two = forest.predict(models["meta"], one, 1, 0)
    return two.withColumnRenamed("probability", "meta_proba").select(*keys, "timestamp", "primary_proba", "meta_proba")


def strategy_metrics(trades: DataFrame, initial_cash: float) -> DataFrame:
    """Basic and extended metrics of each strategy and symbol."""
    keys = ("strategy", "symbol")
    one, two = performance.basic(trades, initial_cash, keys), performance.extended(trades, initial_cash, keys).withColumnsRenamed({k: f"_{k}" for k in keys})
    return one.join(two, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])


def against_baselines(trades: DataFrame, significance: float = 0.05) -> dict[str, dict]:
    """The model's trades tested against each baseline's."""
    model = trades.where("strategy = 'model'")
    names = [r["strategy"] for r in trades.select("strategy").distinct().collect()]
    return {n: stats.compare(model, trades.where(F.col("strategy") == n), significance=significance) for n in sorted(names) if n != "model"}


def report(results: dict, title: str = "Experiment", sections: tuple[str, ...] = ("distribution", "fold_metrics", "meta_metrics", "importances", "metrics", "risk", "trades"), rows: int = 50) -> str:
    """The summaries as one HTML page; each section that there is shows `rows` rows of its table, and how many it has."""
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name in sections:
        if results.get(name) is None:
            continue
        table = results[name].limit(rows + 1).collect()
        cell = lambda v: f"{v:.6g}" if isinstance(v, float) else html.escape(str(v))
        head = "".join(f"<th>{html.escape(c)}" for c in results[name].columns)
        body = "".join("<tr>" + "".join(f"<td>{cell(v)}" for v in r) for r in table[:rows])
        more = f"<p>the first {rows} of {results[name].count()}" if len(table) > rows else ""
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}{body}</table>{more}")
    return "\n".join(out)


def score_batch(model, rows: DataFrame) -> DataFrame:
    """prediction, probability, class probabilities and confidence for a batch of feature rows."""
    out = forest.predict(model, rows)
    return out.withColumns({"probabilities": F.create_map(F.lit("1"), F.col("probability"), F.lit("-1"), 1 - F.col("probability")), "confidence": forest.confidence()})
