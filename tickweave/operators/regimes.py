"""Hidden Markov regimes with Gaussian states.

Fitting maximises the likelihood by Baum-Welch, decoding finds the likeliest path. Both work on segments of SEGMENT rows,
so that one long symbol is many tasks, and give what one pass over the whole sequence would: each segment first tells how it
carries any state before it to each state at its end (a matrix), a scan over one matrix for each segment gives what comes
before and after every segment, and with that the segments are independent. Within a segment the same is done once more: its rows are cut into runs, about as many
as each has rows, and the t-th rows of all runs are taken in one step. Rows are packed once, one row for each segment. Only sums of
expected counts, a few numbers for each pair of states, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stored import stored

#: Rows that one task takes at once. Results don't depend on it.
SEGMENT = 50_000


def _cut(rows: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """[t, c]: the t-th row of the c-th run; how many runs have a t-th row (the last run may be shorter)."""
    n, k = rows.shape
    size = math.isqrt(n)
    runs = -(-n // size)
    out = np.zeros((runs * size, k))
    out[:n] = rows
    short = n - (runs - 1) * size
    return np.ascontiguousarray(out.reshape(runs, size, k).swapaxes(0, 1)), [runs if t < short else runs - 1 for t in range(size)]


def _uncut(runs: np.ndarray, n: int) -> np.ndarray:
    return runs.swapaxes(0, 1).reshape(-1, *runs.shape[2:])[:n]


def _through(left: np.ndarray, right: np.ndarray, best: bool) -> np.ndarray:
    """Logarithms of the product of matrices (best: of the best path instead of the sum over paths), up to a factor."""
    step = left[..., :, None] + right
    top = step.max(-2)
    out = top if best else top + np.log(np.exp(step - top[..., None, :]).sum(-2))
    return out - out.max((-2, -1), keepdims=True) if out.ndim > 1 else out - out.max()


def _shares(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class GaussianHMM:
    columns: list[str]
    center: np.ndarray
    scale: np.ndarray
    start: np.ndarray
    move: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: list[float]

    def log_density(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.means)))
        for k, (m, c) in enumerate(zip(self.means, self.covariances, strict=True)):
            root = np.linalg.cholesky(c)
            z = np.linalg.solve(root, (x - m).T)
            out[:, k] = -0.5 * ((z**2).sum(0) + len(m) * np.log(2 * np.pi)) - np.log(np.diag(root)).sum()
        return out

    @property
    def log_move(self) -> np.ndarray:
        return np.log(self.move + 1e-300)

    def _runs(self, dense: np.ndarray, live: list[int], best: bool) -> np.ndarray:
        """For each run what transfer() gives for its rows."""
        move = self.log_move
        carry = np.vstack([move, np.log(self.start + 1e-300)]) + dense[0][:, None, :]
        for t in range(1, len(dense)):
            m = live[t]
            carry[:m] = _through(carry[:m], move, best) + dense[t, :m, None, :]
        return carry

    def _entries(self, runs: np.ndarray, before: np.ndarray | None, best: bool) -> list[np.ndarray | None]:
        """Logarithms of what comes before each run, up to a factor; before: before the first."""
        out = [before]
        for run in runs[:-1]:
            out.append(run[-1] if out[-1] is None else _through(out[-1], run[:-1], best))
        return out

    def _filter(self, dense: np.ndarray, live: list[int], runs: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """[t, run]: e, density of each state, the likeliest 1; alpha, each row's state given the rows up to it; scale, its likelihood."""
        e = np.exp(dense - dense.max(2, keepdims=True))
        alpha, scale = np.zeros_like(e), np.ones(e.shape[:2])
        first, *others = self._entries(runs, None if before is None else np.log(before + 1e-300), False)
        own = self.start if first is None else before @ self.move
        state = np.vstack([own, *[_shares(x) @ self.move for x in others]])
        for t, m in enumerate(live):
            a = (alpha[t - 1, :m] @ self.move if t else state) * e[t, :m]
            scale[t, :m] = np.maximum(a.sum(1), 1e-300)
            alpha[t, :m] = a / scale[t, :m, None]
        return e, alpha, scale

    def forward_backward(self, x: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
        """Posterior of each row's state, expected transitions, log likelihood; probabilities are scaled row by row.

        before: the states' distribution at the row before the first (none: the sequence begins); after: how likely what
        follows is from each state of the last row (none: the sequence ends).
        """
        whole = self.log_density(x)
        n, k = whole.shape
        dense, live = _cut(whole)
        runs = self._runs(dense, live, False)
        e, alpha, scale = self._filter(dense, live, runs, before)
        follows = [np.zeros(k) if after is None else np.log(after + 1e-300)]
        for run in runs[:0:-1]:
            follows.append(_through(follows[-1], run[:-1].T, False))
        ends = np.exp([f - f.max() for f in follows[::-1]])
        rows = np.where(np.arange(live[0]) < live[-1], len(live), live.count(live[0])) - 1
        last = alpha[rows, np.arange(live[0])]
        ends /= np.maximum((last * ends).sum(1, keepdims=True), 1e-300)
        beta, later = np.ones_like(alpha), 0
        for t in range(len(live) - 1, -1, -1):
            m = live[t]
            if later:
                beta[t, :later] = (e[t + 1, :later] * beta[t + 1, :later] / scale[t + 1, :later, None]) @ self.move.T
            beta[t, later:m] = ends[later:m]
            later = m
        e, alpha, beta, scale = (_uncut(a, n) for a in (e, alpha, beta, scale))
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        pair = self.move * (alpha[:-1].T @ (e[1:] * beta[1:] / scale[1:, None])) if n > 1 else np.zeros((k, k))
        if before is not None:
            pair += self.move * np.outer(before, e[0] * beta[0] / scale[0])
        return gamma, pair, float((np.log(scale) + whole.max(1)).sum())

    def forward(self, x: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Each row's state given the rows up to it, later ones unknown; before as in forward_backward()."""
        dense, live = _cut(self.log_density(x))
        return _uncut(self._filter(dense, live, self._runs(dense, live, False), before)[1], len(x))

    def viterbi(self, x: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
        """The likeliest states; before and after are log scores of what comes before the first row and after the last."""
        move = self.log_move
        dense, live = _cut(self.log_density(x))
        size, count, k = dense.shape
        first, *others = self._entries(self._runs(dense, live, True), before, True)
        # the state before each state; a run's first rows point into the run before
        back = np.zeros((size, count, k), int)
        score = np.empty((count, k))
        score[0] = np.log(self.start + 1e-300) if first is None else (first[:, None] + move).max(0)
        if others:
            step = np.array(others)[:, :, None] + move
            back[0, 1:], score[1:] = step.argmax(1), step.max(1)
        score += dense[0]
        for t in range(1, size):
            m = live[t]
            step = score[:m, :, None] + move
            back[t, :m] = step.argmax(1)
            score[:m] = step.max(1) + dense[t, :m]
        # from each state that a run may end in, the way back; then which it is, from the last run to the first
        ways, at = np.empty((size, count, k), int), np.tile(np.arange(k), (count, 1))
        for t in range(size - 1, -1, -1):
            m = live[t]
            ways[t, :m] = at[:m]
            at[:m] = np.take_along_axis(back[t, :m], at[:m], 1)
        ends = [int((score[-1] if after is None else score[-1] + after).argmax())]
        for c in range(count - 1, 0, -1):
            ends.append(int(at[c, ends[-1]]))
        return _uncut(np.take_along_axis(ways, np.array(ends[::-1])[None, :, None], 2)[:, :, 0], len(x))

    def transfer(self, x: np.ndarray, best: bool) -> np.ndarray:
        """[i, j]: of all paths (best: of the best one) from state i before these rows to state j at their end, the weight up to a factor, as
        logarithm; the last row is for a sequence that begins with them."""
        first, *others = self._runs(*_cut(self.log_density(x)), best)
        for run in others:
            first = _through(first, run[:-1], best)
        return first


def _packed(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """One row for each segment of a symbol's rows in order, stored: bars, their numbers; values, row by row, NaN where there is none."""
    kind = rows.schema["symbol"].dataType.simpleString()

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by("bar_index")
        values = np.column_stack([part[c].to_numpy() for c in columns]).ravel()
        lists = {"bars": pa.array([part["bar_index"].to_numpy()], pa.list_(pa.int64())), "values": pa.array([values], pa.list_(pa.float64()))}
        return pa.table({"symbol": part["symbol"][:1], "_segment": part["_segment"][:1]} | lists)

    keyed = rows.select("symbol", F.col("bar_index").cast("long"), *[F.col(c).cast("double").alias(c) for c in columns], F.floor(F.col("bar_index") / SEGMENT).alias("_segment"))
    return stored(keyed.groupBy("symbol", "_segment").applyInArrow(pack, f"symbol {kind}, _segment long, bars array<long>, values array<double>"), name)


def _scaled(model: GaussianHMM, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A segment's rows as the model takes them, and which have all values."""
    x = (np.reshape(values, (-1, len(model.columns))) - model.center) / model.scale
    return x, np.isfinite(x).all(1)


def _with_edges(model: GaussianHMM, packed: DataFrame, kinds: dict[str, bool]) -> DataFrame:
    """packed with {kind}before, {kind}after: logarithms, up to a factor, of what the rows outside a segment say of its ends; null at the ends of a symbol.

    kinds say whether the best path or all paths are meant.
    """
    k = len(model.means)
    kind = packed.schema["symbol"].dataType.simpleString()

    def carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for symbol, segment, values in zip(pdf["symbol"], pdf["_segment"], pdf["values"], strict=True):
                x, ok = _scaled(model, values)
                if ok.any():
                    yield pd.DataFrame({"_s": [symbol], "_g": [segment]} | {n: [model.transfer(x[ok], best).ravel()] for n, best in kinds.items()})

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_g")
        out = {"_s": pdf["_s"].to_numpy(), "_g": pdf["_g"].to_numpy()}
        for name, best in kinds.items():
            runs = np.stack([np.reshape(m, (k + 1, k)) for m in pdf[name]])
            out[f"{name}before"], state, after = model._entries(runs, None, best), np.zeros(k), [None]
            for m in runs[:0:-1]:
                state = _through(state, m[:-1].T, best)
                after.append(state)
            out[f"{name}after"] = after[::-1]
        return pd.DataFrame(out)

    matrices = packed.select("symbol", "_segment", "values").mapInPandas(carried, f"_s {kind}, _g long, " + ", ".join(f"{n} array<double>" for n in kinds))
    sides = ", ".join(f"{n}before array<double>, {n}after array<double>" for n in kinds)
    edges = matrices.groupBy("_s").applyInPandas(scan, f"_s {kind}, _g long, {sides}")  # one row for each segment
    return packed.join(edges, packed["symbol"].eqNullSafe(edges["_s"]) & (packed["_segment"] == edges["_g"]), "left").drop("_s", "_g")


def _side(value: np.ndarray | None) -> np.ndarray | None:
    return None if value is None else np.array(value, float)


def _counts(model: GaussianHMM, packed: DataFrame) -> tuple[np.ndarray, ...]:
    """Sums over all segments of what Baum-Welch needs."""
    k, d = len(model.means), len(model.columns)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for values, before, after in zip(pdf["values"], pdf["p_before"], pdf["p_after"], strict=True):
                x = _scaled(model, values)[0]
                before, after = _side(before), _side(after)
                g, pair, ll = model.forward_backward(x, None if before is None else _shares(before), None if after is None else np.exp(after))
                flat = np.concatenate([[ll, 1.0], g[0] * (before is None), pair.ravel(), g.sum(0), (g.T @ x).ravel(), np.einsum("tk,ti,tj->kij", g, x, x).ravel()])
                yield pd.DataFrame({"at": np.arange(len(flat)), "value": flat})

    both = _with_edges(model, packed, {"p_": False}).select("values", "p_before", "p_after")
    rows = both.mapInPandas(work, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    v = np.array([r["value"] for r in sorted(rows, key=lambda r: r["at"])])
    cut = np.cumsum([2, k, k * k, k, k * d])
    head, first, pair, weight, sums, squares = np.split(v, cut)
    return head, first, pair.reshape(k, k), weight, sums.reshape(k, d), squares.reshape(k, d, d)


def fit_hmm(rows: DataFrame, columns: list[str], n_states: int = 3, n_iter: int = 20, covariance: str = "full", seed: int = 42, tolerance: float = 1e-4, n_init: int = 1) -> GaussianHMM:
    """A model of rows in which all columns are defined, standardised by mean and population deviation; the likeliest of n_init fits."""
    if covariance not in ("full", "diag"):
        raise ValueError(f"unknown covariance: {covariance}")
    ready = stored(rows.select("symbol", "bar_index", *columns).na.drop("any"), "hmm")
    s = ready.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns], F.count("*").alias("n")).first()
    if s["n"] < 2 * n_states:
        raise ValueError("too few rows for the states")
    center, scale = np.array([s[f"m_{c}"] for c in columns]), np.array([s[f"s_{c}"] or 1.0 for c in columns])
    packed = _packed(ready, columns, "segments").drop("bars")
    fits = [_fitted(packed, columns, center, scale, n_states, n_iter, covariance, seed + i, tolerance) for i in range(n_init)]
    return max(fits, key=lambda m: m.log_likelihood[-1])


def _fitted(packed: DataFrame, columns: list[str], center: np.ndarray, scale: np.ndarray, n_states: int, n_iter: int, covariance: str, seed: int, tolerance: float) -> GaussianHMM:
    """Baum-Welch from means drawn with the seed."""
    d = len(columns)
    rng = np.random.default_rng(seed)
    model = GaussianHMM(columns, center, scale, np.full(n_states, 1 / n_states), np.full((n_states, n_states), 0.1 / max(n_states - 1, 1)), rng.normal(0, 1, (n_states, d)), np.stack([np.eye(d)] * n_states), [])
    np.fill_diagonal(model.move, 0.9 if n_states > 1 else 1.0)
    for _ in range(n_iter):
        head, first, pair, weight, sums, squares = _counts(model, packed)
        model.log_likelihood.append(float(head[0]))
        weight = np.maximum(weight, 1e-10)
        model.start = first / first.sum()
        model.move = (pair + 1e-10) / (pair + 1e-10).sum(1, keepdims=True)
        model.means = sums / weight[:, None]
        cov = squares / weight[:, None, None] - np.einsum("ki,kj->kij", model.means, model.means)
        cov = np.stack([np.diag(np.diag(c)) for c in cov]) if covariance == "diag" else cov
        model.covariances = cov + 1e-6 * np.eye(d)
        ll = model.log_likelihood
        if len(ll) > 1 and abs(ll[-1] - ll[-2]) < tolerance * abs(ll[-2]):
            break
    return model


def regimes(rows: DataFrame, model: GaussianHMM, prefix: str = "macro") -> DataFrame:
    """symbol, bar_index, {prefix}_state (-1 where a column is null), {prefix}_state_k_proba (0 there)."""
    k = len(model.means)
    names = [f"{prefix}_state_{i}_proba" for i in range(k)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for symbol, numbers, values, *edges in zip(*[pdf[c] for c in ("symbol", "bars", "values", "p_before", "p_after", "best_before", "best_after")], strict=True):
                x, ok = _scaled(model, values)
                state, proba = np.full(len(x), -1), np.zeros((len(x), k))
                if ok.any():
                    before, after, first, last = map(_side, edges)
                    state[ok] = model.viterbi(x[ok], first, last)
                    proba[ok] = model.forward_backward(x[ok], None if before is None else _shares(before), None if after is None else np.exp(after))[0]
                yield pd.DataFrame({"symbol": symbol, "bar_index": numbers, f"{prefix}_state": state.astype("int32"), **{n: proba[:, i] for i, n in enumerate(names)}})

    kind = rows.schema["symbol"].dataType.simpleString()
    schema = f"symbol {kind}, bar_index long, {prefix}_state int, " + ", ".join(f"{n} double" for n in names)
    return _with_edges(model, _packed(rows, model.columns, "regimes"), {"p_": False, "best_": True}).mapInPandas(work, schema)


def filtered(rows: DataFrame, model: GaussianHMM, prefix: str = "macro") -> DataFrame:
    """symbol, bar_index, {prefix}_regime (-1 where a column is null), {prefix}_regime_k_proba (0 there): each bar's state by what its symbol's bars up to it say.

    Unlike regimes(), which knows the whole sequence, no later bar changes an earlier one's values: they may be features.
    """
    k = len(model.means)
    names = [f"{prefix}_regime_{i}_proba" for i in range(k)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for symbol, numbers, values, before in zip(pdf["symbol"], pdf["bars"], pdf["values"], pdf["p_before"], strict=True):
                x, ok = _scaled(model, values)
                state, proba = np.full(len(x), -1), np.zeros((len(x), k))
                if ok.any():
                    proba[ok] = model.forward(x[ok], None if before is None else _shares(_side(before)))
                    state[ok] = proba[ok].argmax(1)
                yield pd.DataFrame({"symbol": symbol, "bar_index": numbers, f"{prefix}_regime": state.astype("int32"), **{n: proba[:, i] for i, n in enumerate(names)}})

    kind = rows.schema["symbol"].dataType.simpleString()
    schema = f"symbol {kind}, bar_index long, {prefix}_regime int, " + ", ".join(f"{n} double" for n in names)
    return _with_edges(model, _packed(rows, model.columns, "regimes"), {"p_": False}).mapInPandas(work, schema)
