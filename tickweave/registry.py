"""Queries of the engine's operators over ticks made from events, and the DuckDB SQL that checks them.

Prices are exact in binary, so bars need no rounding; what comes from logarithms and roots is rounded to six places.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import features as ft
from .functions.draws import PRIME
from .functions.stored import scratch_path, stored
from .functions.windows import in_blocks
from .operators import backtest, bars, clean, folds, forest, joins, labeling, performance, regimes, risk, signals, stats, validate
from .operators.session import SessionCalendar
from .schema import dirty_ticks, ticks_from_events
from .sources import ticks as sources
from .streaming.bars import replayed_bars

Query = Callable[[SparkSession, str], DataFrame]
CAL = SessionCalendar()
TEN = bars.BarSpec("tick", 10)
TP = SL = 0.25
CASH = 10_000.0

#: Values that lie halfway between two roundings are moved off it, the same way in both engines.
UP = 1.000000000001


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def _ticks(spark, d):
    return ticks_from_events(_events(spark, d))


def _by_type(spark, d):
    return ticks_from_events(_events(spark, d), F.col("event_type"))


def _bars(spark, d, spec=TEN):
    return bars.build_bars(ticks_from_events(_events(spark, d), index="idx"), spec)


def _features(make, before, after=0):
    return lambda spark, d: in_blocks(_bars(spark, d), make, before, after)


def _labels(spark, d):
    return labeling.triple_barrier(_bars(spark, d), TP, SL, 10, 3, CAL)


def _trades(spark, d):
    made = _bars(spark, d)
    return backtest.run_backtest(made, signals.buy_and_hold(made), backtest.BacktestSpec(TP, SL, max_bars=20, calendar=CAL))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Ticks to bars of two, all features, triple-barrier labels joined to them."""
    made = bars.build_bars(_ticks(spark, d), bars.BarSpec("tick", 2))
    labels = labeling.triple_barrier(made, 0.125, 0.125, 8, 2, CAL)
    return labeling.with_labels(ft.feature_matrix(made), labels.drop("bar_timestamp"))


def _out(df: DataFrame, keep: list[str], rounded: list[str] = (), times: list[str] = ()) -> DataFrame:
    """Columns as they are, rounded doubles, and timestamps as microseconds, so that both engines show one type."""
    six = [(F.round(F.col(c).cast("double") * UP, 6) + 0.0).alias(c) for c in rounded]
    return df.select(*[F.col(c) for c in keep], *six, *[F.unix_micros(F.col(c)).alias(c) for c in times])


def _cols(names: list[str], rounded: list[str] = (), times: list[str] = ()) -> str:
    return ", ".join([*names, *[f"(round({c}::double * 1.000000000001::double, 6) + 0::double) as {c}" for c in rounded], *[f"epoch_us({c}) as {c}" for c in times]])


# SQL building blocks -----------------------------------------------------------------------------------------------

_K = "k as (select event_id as seq, ts, event_type, cast(json_extract_string(props, '$.k') as bigint) as k from events)"


def _sql_ticks(symbol: str = "'EV'") -> str:
    part = "" if symbol == "'EV'" else f"partition by {symbol} "
    return f"""{_K}, t0 as (select {symbol} as symbol, seq, ts, 100 + sum((2 * k - 99) / 2048.0) over ({part}order by ts, seq rows unbounded preceding) as bid, k::double as bv, (1 + (seq * 7) % 50)::double as av from k),
ticks as (select symbol, seq, ts, bid, bid + (1 + seq % 5) / 64.0 as ask, bv, av, row_number() over (partition by symbol order by ts, seq) - 1 as idx from t0)"""


_AGG = """arg_min(bid, idx) as bid_open, max(bid) as bid_high, min(bid) as bid_low, arg_max(bid, idx) as bid_close,
arg_min(ask, idx) as ask_open, max(ask) as ask_high, min(ask) as ask_low, arg_max(ask, idx) as ask_close,
count(*) as tick_count, avg(ask - bid) as spread_mean, stddev_samp(ask - bid) as spread_std, sum(bv) as bidVolume_sum, sum(av) as askVolume_sum"""


def _sql_bars(n: int = 10, partial: bool = False, symbol: str = "'EV'") -> str:
    having = "" if partial else f" having count(*) = {n}"
    return f"{_sql_ticks(symbol)}, bars as (select symbol, idx // {n} as bar_index, min(ts) as timestamp, max(ts) as last_ts, {_AGG} from ticks group by 1, 2{having})"


OHLC = [f"{s}_{x}" for s in ("bid", "ask") for x in ("open", "high", "low", "close")]
BAR = ["symbol", "bar_index", *OHLC, "tick_count"]
BAR_SIX = ["spread_mean", "spread_std", "bidVolume_sum", "askVolume_sum"]


def _over(n: int) -> str:
    return f"over (partition by symbol order by bar_index rows between {n - 1} preceding and current row)"


def _gate(f: str, c: str, n: int) -> str:
    return f"case when count({c}) {_over(n)} = {n} then {f}({c}) {_over(n)} end"


def _lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) over (partition by symbol order by bar_index)"


_END = "date_trunc('day', {t}) + to_seconds(case when isodow({t}) = 5 then 72000 else 78900 end)"
_LEFT = "greatest(0, (epoch_us(" + _END + ") - epoch_us({t})) / 1e6)"


def _end(t: str) -> str:
    return _END.replace("{t}", t)


def _left(t: str) -> str:
    return _LEFT.replace("{t}", t)


_LABELS = f"""dur as (select case when count(*) > 1 then ((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6) / count(*) else 60.0 end as seconds from bars),
ev as (select b.*, least(10, floor({_left("b.timestamp")} / seconds))::int as h from bars b, dur),
ahead as (select e.bar_index, e.h, n.bar_index as j, n.bid_high >= e.bid_close + {TP} as up, n.bid_low <= e.bid_close - {SL} as down from ev e join bars n on n.bar_index > e.bar_index and n.bar_index <= e.bar_index + e.h where e.h >= 3),
ends as (select bar_index, min(case when up or down then j end) as hit, max(j) as last from ahead group by 1),
labels as (select e.symbol, e.timestamp as event_start, x.timestamp as event_end, case when s.hit is null then 0 when x.bid_high >= e.bid_close + {TP} then 1 else -1 end::int as label,
  e.bar_index as bar_index_start, x.bar_index as bar_index_end, e.ask_close as entry_price, x.bid_close as exit_price, x.bid_close - e.ask_close as pnl,
  case when s.hit is null then 'time' when x.bid_high >= e.bid_close + {TP} then 'tp' else 'sl' end as barrier_hit, e.h as effective_horizon
  from ev e join ends s using (bar_index) join bars x on x.bar_index = coalesce(s.hit, s.last))"""
LABEL = ["symbol", "label", "bar_index_start", "bar_index_end", "entry_price", "exit_price", "pnl", "barrier_hit", "effective_horizon"]

_CLOSED = f"(isodow(timestamp) >= 6 or {_left('timestamp')} <= 600)"
_TRADES = f"""marked as (select *, {_CLOSED} as closed from bars),
reach as (select e.bar_index, min(case when n.closed or n.bid_high >= e.bid_close + {TP} or n.bid_low <= e.bid_close - {SL} then n.bar_index end) as hit, max(n.bar_index) as last
  from marked e join marked n on n.bar_index > e.bar_index and n.bar_index <= e.bar_index + 20 where not e.closed group by 1),
cand as (select r.bar_index as entry_bar, coalesce(hit, last) as exit_bar, hit from reach r),
walk as (select min(entry_bar) as entry_bar from cand union all select (select min(c.entry_bar) from cand c where c.entry_bar > p.exit_bar) from walk w join cand p on p.entry_bar = w.entry_bar where (select min(c.entry_bar) from cand c where c.entry_bar > p.exit_bar) is not null),
trades as (select 'EV' as symbol, c.entry_bar, e.timestamp as entry_timestamp, e.ask_close as entry_price, c.exit_bar, x.timestamp as exit_timestamp, x.bid_close as exit_price,
  case when hit is null then 'time' when x.closed then 'session_close' when x.bid_high >= e.bid_close + {TP} then 'tp' else 'sl' end as reason, x.bid_close - e.ask_close as pnl, (x.bid_close - e.ask_close) / {CASH} as pnl_pct
  from walk w join cand c using (entry_bar) join marked e on e.bar_index = c.entry_bar join marked x on x.bar_index = c.exit_bar)"""
_CURVE = f"""eq as (select *, {CASH} + sum(pnl) over (order by exit_timestamp, entry_bar rows unbounded preceding) as equity from trades),
curve as (select *, max(equity) over (order by exit_timestamp, entry_bar rows unbounded preceding) as peak from eq),
dd as (select *, equity - peak as dd, (equity - peak) / peak as dd_pct, case when row_number() over (order by exit_timestamp, entry_bar) > 1 then pnl / (equity - pnl) end as ret from curve)"""

_DIRTY = """spiked as (select symbol, seq, ts, bid * case when seq % 211 = 0 then 8 else 1 end as bid, case when seq % 53 = 0 then bid else ask end * case when seq % 211 = 0 then 8 else 1 end as ask, bv, av from ticks),
dirty as (select * from spiked union all select symbol, seq + 1000000000, ts, bid, ask, bv, av from spiked where seq % 97 = 0)"""


def _reset_sql(amount: str, threshold: int) -> str:
    # the running state is one row for each tick: the bar it belongs to, and what the bar holds after it
    return f"""with recursive {_sql_ticks()}, a as materialized (select idx, {amount} as v from ticks),
run as (select 0::bigint as idx, 0::bigint as bar, v as held from a where idx = 0 union all
  select a.idx, case when run.held >= {threshold} then run.bar + 1 else run.bar end, case when run.held >= {threshold} then a.v else run.held + a.v end from run join a on a.idx = run.idx + 1),
bars as (select symbol, bar as bar_index, min(ts) as timestamp, {_AGG} from ticks join run using (idx) group by 1, 2)
select {_cols(BAR, BAR_SIX, ["timestamp"])} from bars"""


#: name -> (query, SQL or None)
_ALL: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    _ALL[name] = (query, sql)


# Bars ---------------------------------------------------------------------------------------------------------------

_bar_out = lambda df: _out(df, BAR, BAR_SIX, ["timestamp"])
_add("tick_bars", lambda s, d: _bar_out(_bars(s, d)), f"with {_sql_bars()} select {_cols(BAR, BAR_SIX, ['timestamp'])} from bars")
_add("tick_bars_multi", lambda s, d: _bar_out(bars.build_bars(_by_type(s, d), TEN)), f"with {_sql_bars(symbol='event_type')} select {_cols(BAR, BAR_SIX, ['timestamp'])} from bars")
_add("tick_bars_partial", lambda s, d: _bar_out(_bars(s, d, bars.BarSpec("tick", 7, keep_partial=True))), f"with {_sql_bars(7, True)} select {_cols(BAR, BAR_SIX, ['timestamp'])} from bars")
_add(
    "tick_bars_population_std",
    lambda s, d: _out(_bars(s, d, bars.BarSpec("tick", 10, ddof=0)), ["symbol", "bar_index"], ["spread_std"]),
    f"with {_sql_ticks()} select symbol, idx // 10 as bar_index, (round(stddev_pop(ask - bid) * 1.000000000001::double, 6) + 0::double) as spread_std from ticks group by 1, 2 having count(*) = 10",
)
_add(
    "legacy_tick_bars",
    lambda s, d: _out(_bars(s, d, bars.BarSpec.parse("tick7")), BAR, [*BAR_SIX, "bar_duration_sec"], ["timestamp"]),
    f"with {_sql_bars(7, True)}, x as (select * exclude (timestamp), last_ts as timestamp, (epoch_us(last_ts) - epoch_us(timestamp)) / 1e6 as bar_duration_sec from bars) select {_cols(BAR, [*BAR_SIX, 'bar_duration_sec'], ['timestamp'])} from x",
)
_add(
    "mid_bars",
    lambda s, d: _out(_bars(s, d, bars.BarSpec("tick", 10, mid=True)), ["symbol", "bar_index", "open", "high", "low", "close", "tick_count"], BAR_SIX, ["timestamp"]),
    f"with {_sql_ticks()}, m as (select *, (ask + bid) / 2 as mid from ticks), x as (select symbol, idx // 10 as bar_index, min(ts) as timestamp, arg_min(mid, idx) as open, max(mid) as high, min(mid) as low, arg_max(mid, idx) as close, count(*) as tick_count, avg(ask - bid) as spread_mean, stddev_samp(ask - bid) as spread_std, sum(bv) as bidVolume_sum, sum(av) as askVolume_sum from m group by 1, 2 having count(*) = 10) select {_cols(['symbol', 'bar_index', 'open', 'high', 'low', 'close', 'tick_count'], BAR_SIX, ['timestamp'])} from x",
)
_add("volume_bars", lambda s, d: _bar_out(_bars(s, d, bars.BarSpec("volume", 900))), _reset_sql("bv + av", 900))
_add("dollar_bars", lambda s, d: _bar_out(_bars(s, d, bars.BarSpec("dollar", 90_000))), _reset_sql("bid * bv + ask * av", 90_000))
_add(
    "volume_bars_cum",
    lambda s, d: _bar_out(_bars(s, d, bars.BarSpec("volume_cum", 900))),
    f"with {_sql_ticks()}, c as (select *, sum(bv + av) over (order by ts, seq rows unbounded preceding) as total from ticks), bars as (select symbol, floor(total / 900)::bigint as bar_index, min(ts) as timestamp, {_AGG} from c group by 1, 2) select {_cols(BAR, BAR_SIX, ['timestamp'])} from bars",
)
_add("stream_tick_bars", lambda s, d: _bar_out(replayed_bars(_by_type(s, d), TEN)), _ALL["tick_bars_multi"][1])
_add("stream_volume_bars", lambda s, d: _bar_out(replayed_bars(_ticks(s, d), bars.BarSpec("volume", 900))), _ALL["volume_bars"][1])
_add("bar_duration", lambda s, d: _out(bars.average_duration(_bars(s, d)), ["symbol"], ["seconds"]), f"with {_sql_bars()} select symbol, (round(((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6) / count(*), 6) + 0::double) as seconds from bars group by 1")

_HA = ["ha_open", "ha_high", "ha_low", "ha_close"]
_add(
    "heikin_ashi_bars",
    lambda s, d: _out(bars.heikin_ashi(_bars(s, d)), ["symbol", "bar_index"], _HA),
    f"with recursive {_sql_bars()}, c as materialized (select symbol, bar_index, bid_open as o, bid_high as h, bid_low as l, (bid_open + bid_high + bid_low + bid_close) / 4 as ha_close, (bid_open + bid_close) / 2 as first from bars), "
    "walk as (select bar_index, first as ha_open, ha_close from c where bar_index = 0 union all select c.bar_index, (w.ha_open + w.ha_close) / 2, c.ha_close from walk w join c on c.bar_index = w.bar_index + 1), "
    f"x as (select symbol, bar_index, w.ha_open, w.ha_close, greatest(h, w.ha_open, w.ha_close) as ha_high, least(l, w.ha_open, w.ha_close) as ha_low from walk w join c using (bar_index)) select {_cols(['symbol', 'bar_index'], _HA)} from x",
)

_DETAIL = ["midPrice_first", "midPrice_last", "midPrice_mean", "spread_min", "spread_max"]
_add(
    "legacy_bid_ask_bars",
    lambda s, d: _out(_bars(s, d, bars.BarSpec.parse("volume_bar", 900)), ["symbol", "bar_index"], [*_DETAIL, "spread_mean", "spread_std"]),
    f"with {_sql_ticks()}, c as (select *, floor(sum(bv + av) over (order by ts, seq rows unbounded preceding) / 900)::bigint as bar_index, (ask + bid) / 2 as mid from ticks), x as (select symbol, bar_index, arg_min(mid, idx) as midPrice_first, arg_max(mid, idx) as midPrice_last, avg(mid) as midPrice_mean, min(ask - bid) as spread_min, max(ask - bid) as spread_max, avg(ask - bid) as spread_mean, stddev_samp(ask - bid) as spread_std from c group by 1, 2) select {_cols(['symbol', 'bar_index'], [*_DETAIL, 'spread_mean', 'spread_std'])} from x",
)

# Files --------------------------------------------------------------------------------------------------------------


def _csv(spark, d) -> str:
    """Ticks as a CSV folder, the way files of ticks look."""
    path = scratch_path(spark, "ticks") + ".csv"
    _ticks(spark, d).select(F.unix_millis("timestamp").alias("timestamp"), "askPrice", "bidPrice", "askVolume", "bidVolume").write.option("header", True).csv(path)
    return path


def _converted(spark, d):
    path = _csv(spark, d)
    done = sources.convert_all(spark, {path: path.replace(".csv", ".parquet")})
    return sources.read_ticks(spark, path.replace(".csv", ".parquet"), symbol=done[path])


_FILE = "bid, ask, bv, av, epoch_us(ts) // 1000 as ms from ticks"
_file_out = lambda df, *more: df.select(*more, F.col("bidPrice").alias("bid"), F.col("askPrice").alias("ask"), F.col("bidVolume").alias("bv"), F.col("askVolume").alias("av"), F.unix_millis("timestamp").alias("ms"))
_add("ticks_from_csv", lambda s, d: _file_out(sources.read_ticks(s, _csv(s, d), symbol="EV"), "symbol"), f"with {_sql_ticks()} select symbol, {_FILE}")
_add("ticks_converted", lambda s, d: _file_out(_converted(s, d), "symbol"), f"with {_sql_ticks()} select 'converted' as symbol, {_FILE}")
_add("first_ticks", lambda s, d: _tick_out(sources.first_rows(_ticks(s, d), 100)), f"with {_sql_ticks()} select symbol, seq, bid, ask, epoch_us(ts) as ts from ticks order by epoch_us(ticks.ts), seq limit 100")

# Cleaning and validation --------------------------------------------------------------------------------------------

TICK = ["symbol", "seq", "bid", "ask"]
_tick_out = lambda df: df.select("symbol", "seq", F.col("bidPrice").alias("bid"), F.col("askPrice").alias("ask"), F.unix_micros("timestamp").alias("ts"))
_tick_sql = "select symbol, seq, bid, ask, epoch_us(ts) as ts from"
_dirty = lambda s, d: dirty_ticks(_ticks(s, d))
_FIRST = "first_ticks as (select * exclude (n) from (select *, row_number() over (partition by symbol, ts order by seq) as n from dirty) where n = 1)"
_Z = "z as (select *, abs(bid - avg(bid) over w) / (stddev_samp(bid) over w + 1e-10) as z from {src} window w as (partition by symbol order by ts, seq rows between 49 preceding and current row))"
_add("clean_dedupe", lambda s, d: _tick_out(clean.dedupe(_dirty(s, d))), f"with {_sql_ticks()}, {_DIRTY}, {_FIRST} {_tick_sql} first_ticks")
_add("clean_zero_spread", lambda s, d: _tick_out(clean.drop_zero_spread(_dirty(s, d))), f"with {_sql_ticks()}, {_DIRTY} {_tick_sql} dirty where ask - bid > 0")
_add("clean_outliers", lambda s, d: _tick_out(clean.drop_outliers(_dirty(s, d))), f"with {_sql_ticks()}, {_DIRTY}, {_Z.format(src='dirty')} {_tick_sql} z where not coalesce(z > 3, false)")
_add("clean_full", lambda s, d: _tick_out(clean.clean_ticks(_dirty(s, d))), f"with {_sql_ticks()}, {_DIRTY}, {_FIRST}, spread as (select * from first_ticks where ask - bid > 0), {_Z.format(src='spread')} {_tick_sql} z where not coalesce(z > 3, false)")
_add("validate_and_clean", lambda s, d: _tick_out(clean.validate_and_clean(_dirty(s, d))), f"with {_sql_ticks()}, {_DIRTY} {_tick_sql} dirty where ask > 0 and bid > 0 and ask >= bid")
_usable = lambda c: f"(count({c}) > 0 and max(abs({c})) > 0 and stddev_samp({c}) > 0)"
_add("schema_volume_usable", lambda s, d: validate.volume_usable(_ticks(s, d)), f"with {_sql_ticks()} select {_usable('bv')} as bid_usable, {_usable('av')} as ask_usable, {_usable('bv')} and {_usable('av')} as usable from ticks")
_add(
    "temporal_safety",
    lambda s, d: validate.temporal_safety(_dirty(s, d)),
    f"with {_sql_ticks()}, {_DIRTY}, m as (select *, coalesce(lag(ts) over (partition by symbol order by seq) > ts, false) as back from dirty), t as (select symbol, ts, count(*) as n, count_if(back) as b from m group by 1, 2), s as (select symbol, sum(n)::bigint as n_rows, sum(n - 1)::bigint as n_repeated, sum(b)::bigint as n_backward from t group by 1) select *, n_repeated = 0 and n_backward = 0 as is_safe from s",
)
_add(
    "spread_profile",
    lambda s, d: _out(sources.spread_profile(_dirty(s, d)), ["n", "n_zero"], ["low", "high", "mean", "median"]),
    f"with {_sql_ticks()}, {_DIRTY}, x as (select count(*) as n, count_if(ask - bid = 0) as n_zero, min(ask - bid) as low, max(ask - bid) as high, avg(ask - bid) as mean, median(ask - bid) as median from dirty) select {_cols(['n', 'n_zero'], ['low', 'high', 'mean', 'median'])} from x",
)
_add(
    "tick_profile",
    lambda s, d: _out(sources.profile(_ticks(s, d).select("bidPrice", "askPrice", "bidVolume")), ["column", "n_values", "n_null"], ["low", "high", "mean", "std"]),
    f"with {_sql_ticks()}, x as (" + " union all ".join(f"select '{n}' as \"column\", count({c}) as n_values, count(*) - count({c}) as n_null, min({c}) as low, max({c}) as high, avg({c}) as mean, stddev_samp({c}) as std from ticks" for n, c in (("bidPrice", "bid"), ("askPrice", "ask"), ("bidVolume", "bv"))) + f") select {_cols([chr(34) + 'column' + chr(34), 'n_values', 'n_null'], ['low', 'high', 'mean', 'std'])} from x",
)

# Sessions -----------------------------------------------------------------------------------------------------------

_add("weekend_filter", lambda s, d: _tick_out(CAL.drop_weekends(_ticks(s, d))), f"with {_sql_ticks()} {_tick_sql} ticks where isodow(ts) < 6")
_add("session_filter", lambda s, d: _tick_out(CAL.session_rows(_ticks(s, d))), f"with {_sql_ticks()} {_tick_sql} ticks where isodow(ts) < 6 and ts <= {_end('ts')}")
_add("session_end", lambda s, d: _bars(s, d).select("symbol", "bar_index", F.unix_micros(CAL.session_end("timestamp")).alias("session_end")), f"with {_sql_bars()} select symbol, bar_index, epoch_us({_end('timestamp')}) as session_end from bars")
_add("time_to_session_end", lambda s, d: _out(_bars(s, d).withColumn("minutes", CAL.time_to_end("timestamp", "minutes")), ["symbol", "bar_index"], ["minutes"]), f"with {_sql_bars()} select symbol, bar_index, (round(({_left('timestamp')} / 60) * 1.000000000001::double, 6) + 0::double) as minutes from bars")
_add(
    "bars_to_session_end",
    lambda s, d: (lambda b: b.join(bars.average_duration(b), "symbol").select("symbol", "bar_index", CAL.bars_to_end("timestamp", F.col("seconds")).alias("n"), CAL.in_no_trade_zone("timestamp", F.col("seconds"), 3).alias("no_trade")))(_bars(s, d)),
    f"with {_sql_bars()}, dur as (select ((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6) / count(*) as seconds from bars) select symbol, bar_index, floor({_left('timestamp')} / seconds)::bigint as n, floor({_left('timestamp')} / seconds) < 3 as no_trade from bars, dur",
)
_add("near_session_end", lambda s, d: _bars(s, d).select("symbol", "bar_index", CAL.near_end("timestamp").alias("near"), CAL.is_weekend("timestamp").alias("weekend")), f"with {_sql_bars()} select symbol, bar_index, {_left('timestamp')} / 60 <= 30 as near, isodow(timestamp) >= 6 as weekend from bars")

# Features -----------------------------------------------------------------------------------------------------------

_KEY = ["symbol", "bar_index"]


def _feature(name: str, make, before: int, whole: list[str], rounded: list[str], ctes: str, source: str) -> None:
    _add(name, lambda s, d: _out(in_blocks(_bars(s, d), make, before), [*_KEY, *whole], rounded), f"with {_sql_bars()}{', ' + ctes if ctes else ''} select {_cols([*_KEY, *whole], rounded)} from {source}")


_RET = "r as (select *, " + ", ".join(f"ln(bid_close / {_lag('bid_close', n)}) as ret_{n}" for n in (1, 5, 10)) + " from bars)"
_VOL = _RET + ", v as (select *, " + ", ".join(f"{_gate('stddev_samp', 'ret_1', n)} as vol_{n}" for n in (10, 20)) + " from r)"
_feature("log_returns", lambda d, f: ft.log_returns(d, f, (1, 5, 10)), 10, [], ["ret_1", "ret_5", "ret_10"], _RET, "r")
_feature("volatility", lambda d, f: ft.volatility(d, f, (10, 20)), 21, [], ["vol_10", "vol_20"], _VOL, "v")
_feature("bar_ranges", lambda d, f: ft.bar_ranges(d, f, (10,)), 10, ["range"], ["avg_range_10"], f"g as (select *, bid_high - bid_low as range from bars), x as (select *, {_gate('avg', 'range', 10)} as avg_range_10 from g)", "x")
_SPREAD = f"s as (select *, spread_mean as spread, spread_mean - {_lag('spread_mean')} as spread_change, " + ", ".join(f"{_gate(a, 'spread_mean', n)} as spread_{k}_{n}" for n in (5, 10) for k, a in (("mean", "avg"), ("std", "stddev_samp"))) + " from bars)"
SPREADS = ["spread", "spread_change", "spread_mean_5", "spread_std_5", "spread_mean_10", "spread_std_10"]
_feature("spread_features", lambda d, f: ft.spread_features(d, f, (5, 10)), 10, [], SPREADS, _SPREAD, "s")
_DIR = f"d as (select *, coalesce(sign(bid_close - {_lag('bid_close')}), 0)::double as tick_direction from bars)"
_feature("tick_direction", ft.tick_direction, 1, ["tick_direction"], [], _DIR, "d")
_feature("order_flow", lambda d, f: ft.order_flow(d, f, (5, 10)), 11, [], ["of_imbalance_5", "of_imbalance_10"], _DIR + ", x as (select *, " + ", ".join(f"{_gate('avg', 'tick_direction', n)} as of_imbalance_{n}" for n in (5, 10)) + " from d)", "x")
_VI = "i as (select *, case when bidVolume_sum + askVolume_sum > 0 then (bidVolume_sum - askVolume_sum) / (bidVolume_sum + askVolume_sum) else 0 end as volume_imbalance from bars)"
_feature("volume_imbalance", lambda d, f: ft.volume_imbalance(d, f, (5,)), 5, [], ["volume_imbalance", "vol_imbalance_5"], _VI + f", x as (select *, {_gate('avg', 'volume_imbalance', 5)} as vol_imbalance_5 from i)", "x")
_feature("bar_stats", ft.bar_stats, 20, ["tick_count"], ["tick_count_norm", "volume"], f"x as (select *, tick_count / ({_gate('avg', 'tick_count', 20)}) as tick_count_norm, bidVolume_sum + askVolume_sum as volume from bars)", "x")
PERIODS = (5, 10, 20, 50)
_MA = (
    "p as (select *, (bid_close + ask_close) / 2 as p from bars), c as (select *, p / " + _lag("p") + " - 1 as change from p), m as (select *, " + ", ".join(f"{_gate('avg', 'p', n)} as ma_{n}, {_gate('stddev_samp', 'change', n)} as v_{n}" for n in PERIODS) + " from c), sl as (select *, "
    + ", ".join(f"(ma_{n} - {_lag(f'ma_{n}', n)}) / {n} as ma_{n}_slope, (p - ma_{n}) / ma_{n} as dist_to_ma_{n}" for n in PERIODS) + " from m), x as (select *, " + ", ".join(f"ma_{n}_slope / (p * nullif(v_{n}, 0)) as ma_{n}_slope_norm" for n in PERIODS) + " from sl)"
)
SLOPES = [f"{a}{n}{b}" for n in PERIODS for a, b in (("ma_", ""), ("ma_", "_slope"), ("ma_", "_slope_norm"), ("dist_to_ma_", ""))]
_feature("ma_slopes", ft.ma_slopes, 100, [], SLOPES, _MA, "x")
_CROSS = ", ".join(f"case when ma_{a} > ma_{b} then 1 else -1 end::int as ma_cross_{a}_{b}, (ma_{a} - ma_{b}) / ma_{b} as ma_cross_{a}_{b}_strength" for a, b in ft.CROSSES)
_feature("ma_cross", ft.ma_cross, 50, [f"ma_cross_{a}_{b}" for a, b in ft.CROSSES], [f"ma_cross_{a}_{b}_strength" for a, b in ft.CROSSES], _MA.split(", sl as")[0] + f", y as (select *, {_CROSS} from m)", "y")
_REG = f"g as (select *, case when bar_index >= 50 then regr_slope(bid_close, bar_index) {_over(50)} end as trend_slope, case when bar_index >= 50 then regr_r2(bid_close, bar_index) {_over(50)} end as trend_strength from bars)"
_feature("trend_regression", ft.trend_regression, 50, [], ["trend_slope", "trend_strength"], _REG, "g")
_feature("macro_features", ft.macro_features, 100, [], ["ret_long", "vol_long", "trend_slope", "trend_strength"], _REG + f", l as (select *, ln(bid_close / {_lag('bid_close', 50)}) as ret_long from g), x as (select *, {_gate('stddev_samp', 'ret_long', 50)} as vol_long from l)", "x")
_feature("micro_features", ft.micro_features, 1, ["tick_direction"], ["spread", "spread_change", "of_imbalance"], f"x as (select *, spread_mean as spread, spread_mean - {_lag('spread_mean')} as spread_change, coalesce(sign(bid_close - {_lag('bid_close')}), 0)::double as tick_direction, case when bidVolume_sum + askVolume_sum > 0 then (bidVolume_sum - askVolume_sum) / (bidVolume_sum + askVolume_sum) else 0 end as of_imbalance from bars)", "x")


def _fd(weights: list[float]) -> str:
    # every lag is there once the farthest one is, as closes are never null
    return "x as (select *, " + " + ".join(f"({w!r})::double * {_lag('bid_close', k + 1)}" for k, w in enumerate(weights)) + " as bid_close_fracdiff from bars)"


_feature("frac_diff", lambda d, f: ft.frac_diff(d, f, "bid_close", 0.4, 1e-2), 60, [], ["bid_close_fracdiff"], _fd(ft.frac_diff_weights(0.4, 1000, 1e-2)), "x")
_feature("frac_diff_ffd", lambda d, f: ft.frac_diff(d, f, "bid_close", 0.4, 1e-2, fixed_width=True), 60, [], ["bid_close_fracdiff"], _fd(ft.frac_diff_weights(0.4, 1000, 1e-2, True)), "x")
_RSI = f"g as (select *, coalesce(bid_close - {_lag('bid_close')}, 0) as ch from bars), gl as (select *, greatest(ch, 0) as gain, greatest(-ch, 0) as loss from g), rs as (select *, 100 - 100 / (1 + ({_gate('avg', 'gain', 14)}) / (({_gate('avg', 'loss', 14)}) + 1e-10)) as rsi from gl)"
_feature("rsi", ft.rsi, 15, [], ["rsi"], _RSI, "rs")
MATRIX = ["ret_1", "ret_5", "ret_10", "vol_10", "vol_20", *SPREADS, "of_imbalance_5", "of_imbalance_10", "volume_imbalance", "vol_imbalance_5", "vol_imbalance_10", "tick_count_norm", "volume", *SLOPES, *[f"ma_cross_{a}_{b}_strength" for a, b in ft.CROSSES]]
_MATRIX_SQL = (
    _VOL
    + f", s1 as (select *, spread_mean as spread, spread_mean - {_lag('spread_mean')} as spread_change, " + ", ".join(f"{_gate(a, 'spread_mean', n)} as spread_{k}_{n}" for n in (5, 10) for k, a in (("mean", "avg"), ("std", "stddev_samp")))
    + f", coalesce(sign(bid_close - {_lag('bid_close')}), 0)::double as tick_direction, case when bidVolume_sum + askVolume_sum > 0 then (bidVolume_sum - askVolume_sum) / (bidVolume_sum + askVolume_sum) else 0 end as volume_imbalance, tick_count / ({_gate('avg', 'tick_count', 20)}) as tick_count_norm, bidVolume_sum + askVolume_sum as volume from v)"
    + ", s2 as (select *, " + ", ".join(f"{_gate('avg', 'tick_direction', n)} as of_imbalance_{n}, {_gate('avg', 'volume_imbalance', n)} as vol_imbalance_{n}" for n in (5, 10)) + " from s1)"
    + ", " + _MA.replace("from bars)", "from s2)", 1) + f", y as (select *, {_CROSS} from x)"
)
_add("feature_matrix", lambda s, d: _out(ft.feature_matrix(_bars(s, d)), [*_KEY, "tick_direction", *[f"ma_cross_{a}_{b}" for a, b in ft.CROSSES]], MATRIX), f"with {_sql_bars()}, {_MATRIX_SQL} select {_cols([*_KEY, 'tick_direction', *[f'ma_cross_{a}_{b}' for a, b in ft.CROSSES]], MATRIX)} from y")
_CHECKED = ["ret_1", "vol_10", "ma_50", "tick_count_norm", "volume"]
_add(
    "feature_validation",
    lambda s, d: validate.feature_report(ft.feature_matrix(_bars(s, d)), _CHECKED),
    f"with {_sql_bars()}, {_MATRIX_SQL}, z as (" + " union all ".join(f"select '{c}' as \"column\", count(*) as n_rows, count(*) - count({c}) as n_null, count_if(isinf({c}::double)) as n_inf, coalesce(max({c}) = min({c}), true) or coalesce(stddev_samp({c}), 0) < 1e-10 as is_constant from y" for c in _CHECKED) + ") select *, n_null / n_rows <= 0.05 and n_inf = 0 as is_valid from z",
)

# Labels -------------------------------------------------------------------------------------------------------------

_add("mfe_mae", lambda s, d: labeling.excursions(_bars(s, d), 10), f"with {_sql_bars()} select symbol, bar_index, case when count(*) over w = 10 then max(bid_high) over w - ask_close end as mfe, case when count(*) over w = 10 then ask_close - min(bid_low) over w end as mae from bars window w as (partition by symbol order by bar_index rows between 1 following and 10 following)")
_MFE = "e as (select *, case when count(*) over w = 10 then max(bid_high) over w - ask_close end as mfe, case when count(*) over w = 10 then ask_close - min(bid_low) over w end as mae from bars window w as (partition by symbol order by bar_index rows between 1 following and 10 following))"
_SUGGEST = _MFE + ", q as (select symbol, quantile_cont(mfe, 0.5) as mfe_q, quantile_cont(mae, 0.5) as mae_q from e group by 1), sug as (select symbol, coalesce(greatest(10, trunc(mfe_q / 0.015625)::int), 50) as tp_ticks, coalesce(greatest(10, trunc(abs(mae_q) / 0.015625)::int), 50) as sl_ticks, mfe_q, mae_q from q)"
_add("suggest_tp_sl", lambda s, d: _out(labeling.suggest_distances(_bars(s, d), 10, 1 / 64), ["symbol", "tp_ticks", "sl_ticks", "tp_price", "sl_price"], ["mfe_q", "mae_q"]), f"with {_sql_bars()}, {_SUGGEST} select symbol, tp_ticks::int as tp_ticks, sl_ticks::int as sl_ticks, (tp_ticks * 0.015625)::double as tp_price, (sl_ticks * 0.015625)::double as sl_price, {_cols([], ['mfe_q', 'mae_q'])} from sug")
_label_out = lambda df: _out(df, LABEL, [], ["event_start", "event_end"])
_label_sql = f"select {_cols(LABEL, [], ['event_start', 'event_end'])} from labels"
_add("triple_barrier", lambda s, d: _label_out(_labels(s, d)), f"with {_sql_bars()}, {_LABELS} {_label_sql}")
_EXACT = _LABELS.replace(
    f"ev as (select b.*, least(10, floor({_left('b.timestamp')} / seconds))::int as h from bars b, dur)",
    f"ev as (select b.*, least(10, case when isodow(timestamp) < 6 then (select count(*) from bars n where n.bar_index > b.bar_index and n.timestamp <= {_end('b.timestamp')}) else 0 end)::int as h from bars b)",
)
_add("triple_barrier_exact_session", lambda s, d: _label_out(labeling.triple_barrier(_bars(s, d), TP, SL, 10, 3, CAL, session="exact")), f"with {_sql_bars()}, {_EXACT} {_label_sql}")
_add("triple_barrier_mfe", lambda s, d: _label_out(labeling.triple_barrier_by_excursion(_bars(s, d), 10, 1 / 64, 0.5, 0.5, 10, 3, CAL)), f"with {_sql_bars()}, {_SUGGEST}, {_LABELS.replace(f'+ {TP}', '+ (select tp_ticks * 0.015625 from sug)').replace(f'- {SL}', '- (select sl_ticks * 0.015625 from sug)')} {_label_sql}")
_add("label_distribution", lambda s, d: _out(labeling.label_distribution(_labels(s, d)), ["label", "n"], ["share", "share_decided"]), f"with {_sql_bars()}, {_LABELS}, x as (select label, count(*) as n, count(*) / (select count(*) from labels) as share, case when label <> 0 then count(*) / (select count(*) from labels where label <> 0) end as share_decided from labels group by 1) select {_cols(['label', 'n'], ['share', 'share_decided'])} from x")
_add("meta_labels", lambda s, d: labeling.meta_labels(_labels(s, d)).select("symbol", "bar_index_start", "pnl", "meta_label"), f"with {_sql_bars()}, {_LABELS} select symbol, bar_index_start, pnl, (pnl > 0)::int as meta_label from labels")
_add(
    "meta_features",
    lambda s, d: _out(labeling.meta_features(_labels(s, d), extra=in_blocks(_bars(s, d), lambda x, f: ft.volatility(ft.tick_direction(x, f), f, (10,)), 11).select("symbol", "bar_index", "tick_direction", "vol_10")), ["symbol", "bar_index", "label", "tick_direction"], ["vol_10"]),
    f"with {_sql_bars()}, {_VOL}, d as (select *, coalesce(sign(bid_close - {_lag('bid_close')}), 0)::double as tick_direction from v), {_LABELS} select l.symbol, bar_index_start as bar_index, label, tick_direction, (round((vol_10) * 1.000000000001::double, 6) + 0::double) as vol_10 from labels l left join d on d.bar_index = l.bar_index_start",
)
_add("features_labels_join", lambda s, d: _out(labeling.with_labels(ft.feature_matrix(_bars(s, d)), _labels(s, d)), [*_KEY, "label", "pnl"], ["ret_1", "vol_10", "ma_20_slope"]), f"with {_sql_bars()}, {_MATRIX_SQL}, {_LABELS} select y.symbol, y.bar_index, label, pnl, {_cols([], ['ret_1', 'vol_10', 'ma_20_slope'])} from y join labels l on y.bar_index = l.bar_index_start")

_NAMED = [*MATRIX, *[f"ma_cross_{a}_{b}" for a, b in ft.CROSSES]]
_add(
    "training_rows",
    lambda s, d: (lambda m: clean.training_rows(m, _NAMED).select(*_KEY, F.lit(len(set(_NAMED) - set(clean.feature_columns(m)))).alias("n_missing")))(ft.feature_matrix(_bars(s, d))),
    f"with {_sql_bars()}, {_MATRIX_SQL} select symbol, bar_index, 0::int as n_missing from y where " + " and ".join(f"{c} is not null" for c in _NAMED),
)
_add("empty_columns", lambda s, d: (lambda b: s.createDataFrame([(c,) for c in clean.drop_null_columns(b.withColumns({"none": F.lit(None).cast("double"), "some": F.when(F.col("bar_index") == 3, 1.0)})).columns], "kept string"))(_bars(s, d).select("symbol", "bar_index", "bid_close")), "select unnest(['symbol', 'bar_index', 'bid_close', 'some']) as kept")

# Joins by time, folds ----------------------------------------------------------------------------------------------


def _asof(spark, d, direction):
    points = _ticks(spark, d).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 11 SECONDS")).select("symbol", "seq", "timestamp")
    right = _bars(spark, d).select("symbol", "timestamp", "bar_index", "bid_close")
    return joins.asof(points, right, ["bar_index", "bid_close"], direction).select("symbol", "seq", "bar_index", "bid_close")


_POINTS = "pts as (select symbol, seq, ts + interval 11 seconds as at from ticks), p as (select pts.*, b.bar_index as bi, b.bid_close as bc, b.timestamp as bt from pts asof left join bars b on b.timestamp <= pts.at), n as (select pts.seq, b.bar_index as bi, b.bid_close as bc, b.timestamp as bt from pts asof left join bars b on b.timestamp >= pts.at)"
_NEAR = "(p.bt is null or (n.bt is not null and epoch_us(n.bt) - epoch_us(p.at) <= epoch_us(p.at) - epoch_us(p.bt)))"
_add("asof_signal", lambda s, d: _asof(s, d, "nearest"), f"with {_sql_bars()}, {_POINTS} select symbol, p.seq, case when {_NEAR} then n.bi else p.bi end as bar_index, case when {_NEAR} then n.bc else p.bc end as bid_close from p join n using (seq)")
_add("asof_backward", lambda s, d: _asof(s, d, "backward"), f"with {_sql_bars()}, {_POINTS} select symbol, seq, bi as bar_index, bc as bid_close from p")
_add("tscv_folds", lambda s, d: folds.time_series_folds(folds.numbered(_labels(s, d).withColumnRenamed("event_start", "timestamp")), 4, gap=5), f"with {_sql_bars()}, {_LABELS}, r as (select row_number() over (order by event_start) - 1 as row_idx from labels), t as (select count(*) as n, count(*) // 5 as size from labels), f as (select range::int as fold_id, n - (4 - range) * size as start, size from range(4), t), x as (select fold_id, row_idx, case when row_idx >= start and row_idx < start + size then 'test' when row_idx < start - 5 then 'train' end as role from r, f) select * from x where role is not null")


def _intervals(spark, d):
    return folds.numbered(_labels(spark, d).withColumnRenamed("event_start", "timestamp")).select("row_idx", F.col("bar_index_start").alias("start_idx"), F.col("bar_index_end").alias("end_idx"))


_GROUPS = "r as (select row_number() over (order by event_start) - 1 as row_idx, bar_index_start as start_idx, bar_index_end as end_idx from labels), g as (select *, (ntile(6) over (order by row_idx) - 1)::int as group_id from r)"
_add("cpcv_groups", lambda s, d: folds.cpcv_groups(_intervals(s, d), 6), f"with {_sql_bars()}, {_LABELS}, {_GROUPS} select row_idx, start_idx, end_idx, group_id from g")
_COMBOS = "combos as (select (row_number() over (order by a.range, b.range) - 1)::int as fold_id, a.range as x, b.range as y from range(6) a, range(6) b where a.range < b.range), test as (select fold_id, x, y, g.* from combos, g where group_id in (x, y))"
_FOLD = """, held as (select distinct c.fold_id, t.row_idx + k.range as row_idx from combos c join test t on t.fold_id = c.fold_id and not exists (select 1 from test u where u.fold_id = t.fold_id and u.row_idx = t.row_idx + 1), range(1, 11) k),
{spans}, roles as (select c.fold_id, g.row_idx, case when g.group_id in (x, y) then 'test' when not exists (select 1 from held h where h.fold_id = c.fold_id and h.row_idx = g.row_idx) and not exists (select 1 from span s where s.fold_id = c.fold_id and g.end_idx >= s.low and g.start_idx <= s.high) then 'train' end as role from combos c, g)
select fold_id, row_idx, role from roles r where role is not null and (select count(distinct role) from roles q where q.fold_id = r.fold_id) = 2"""
_add("cpcv_folds", lambda s, d: folds.cpcv_folds(_intervals(s, d), 6, 2, 10), f"with {_sql_bars()}, {_LABELS}, {_GROUPS}, {_COMBOS}" + _FOLD.replace("{spans}", "span as (select fold_id, min(start_idx) as low, max(end_idx) as high from test group by 1)"))
_add("cpcv_folds_per_run", lambda s, d: folds.cpcv_folds(_intervals(s, d), 6, 2, 10, purge="per_run"), f"with {_sql_bars()}, {_LABELS}, {_GROUPS}, {_COMBOS}" + _FOLD.replace("{spans}", "span as (select fold_id, min(start_idx) as low, max(end_idx) as high from test group by fold_id, case when y = x + 1 then -1 else group_id end)"))



def _timed(spark, d):
    """Bars of several symbols with intervals of an hour from their own time."""
    rows = folds.numbered(bars.build_bars(_by_type(spark, d), TEN))
    return rows.select("row_idx", F.unix_micros("timestamp").alias("start_idx"), (F.unix_micros("timestamp") + 3_600_000_000).alias("end_idx"))


_ROWS = "r as (select row_number() over (order by timestamp, symbol, bar_index) - 1 as row_idx, epoch_us(timestamp) as start_idx, epoch_us(timestamp) + 3600000000 as end_idx from bars)"
_add("tscv_folds_multi", lambda s, d: folds.time_series_folds(_timed(s, d), 4, gap=5), f"with {_sql_bars(symbol='event_type')}, {_ROWS}, t as (select count(*) as n, count(*) // 5 as size from r), f as (select range::int as fold_id, n - (4 - range) * size as start, size from range(4), t), x as (select fold_id, row_idx, case when row_idx >= start and row_idx < start + size then 'test' when row_idx < start - 5 then 'train' end as role from r, f) select * from x where role is not null")
_add("cpcv_folds_multi", lambda s, d: folds.cpcv_folds(_timed(s, d), 6, 2, 10), f"with {_sql_bars(symbol='event_type')}, {_ROWS}, g as (select *, (ntile(6) over (order by row_idx) - 1)::int as group_id from r), {_COMBOS}" + _FOLD.replace("{spans}", "span as (select fold_id, min(start_idx) as low, max(end_idx) as high from test group by 1)"))

_RANGES = "f as ({roles}), i as (select *, row_idx - row_number() over (partition by fold_id, role order by row_idx) as stretch from f) select fold_id, role, min(row_idx) as first, max(row_idx) as last from i group by fold_id, role, stretch"
for _name, _make, _of in (("cpcv_ranges", _intervals, "cpcv_folds"), ("cpcv_ranges_multi", _timed, "cpcv_folds_multi")):
    _head, _, _roles = _ALL[_of][1].rpartition("select fold_id, row_idx, role from")
    _add(_name, lambda s, d, make=_make: folds.cpcv_ranges(make(s, d), 6, 2, 10), f"{_head.rstrip()}, " + _RANGES.format(roles=f"select fold_id, row_idx, role from{_roles}"))

# Signals, backtest, performance -------------------------------------------------------------------------------------

_sig = lambda df: df.select("symbol", "bar_index", "prediction", "probability", "meta_decision")
_add("signals_buy_hold", lambda s, d: _sig(signals.buy_and_hold(_bars(s, d))), f"with {_sql_bars()} select symbol, bar_index, 1::int as prediction, 1.0::double as probability, 1::int as meta_decision from bars")
_add("signals_ma", lambda s, d: _sig(signals.ma_crossover(_bars(s, d))), f"with {_sql_bars()} select symbol, bar_index, coalesce(({_gate('avg', 'bid_close', 10)}) > ({_gate('avg', 'bid_close', 50)}), false)::int as prediction, 1.0::double as probability, 1::int as meta_decision from bars")
_add("signals_rsi", lambda s, d: _sig(signals.rsi_signals(_bars(s, d))), f"with {_sql_bars()}, {_RSI} select symbol, bar_index, coalesce(rsi < 30, false)::int as prediction, 1.0::double as probability, 1::int as meta_decision from rs")
_draw = lambda *keys: f"('0x' || substr(md5(concat_ws('|', {', '.join(map(str, keys))})), 1, 12))::bigint"
_add("signals_random", lambda s, d: _sig(signals.random_signals(_bars(s, d))), f"with {_sql_bars()} select symbol, bar_index, ({_draw('symbol', 'bar_index', 42)} % 2)::int as prediction, 0.5::double as probability, 1::int as meta_decision from bars")
TRADE = ["symbol", "entry_bar", "entry_price", "exit_bar", "exit_price", "reason", "pnl"]
_BT = f"with recursive {_sql_bars().replace('bars as (', 'bars as materialized (')}, {_TRADES.replace('marked as (', 'marked as materialized (').replace('cand as (', 'cand as materialized (')}"
_add("backtest_feed", lambda s, d: backtest.feed(_bars(s, d)).drop("timestamp"), f"with {_sql_bars()} select symbol, bar_index, bid_open as open, bid_high as high, bid_low as low, bid_close as close, ask_close, bidVolume_sum as volume from bars")
_add("backtest_trades", lambda s, d: _out(_trades(s, d), TRADE, ["pnl_pct"], ["entry_timestamp", "exit_timestamp"]), f"{_BT} select {_cols(TRADE, ['pnl_pct'], ['entry_timestamp', 'exit_timestamp'])} from trades")
_add("equity_curve", lambda s, d: backtest.equity_curve(_trades(s, d)).select("symbol", "entry_bar", "equity"), f"{_BT}, {_CURVE} select symbol, entry_bar, equity from eq")
_add("drawdown_curve", lambda s, d: _out(performance.drawdown_curve(backtest.equity_curve(_trades(s, d))), ["symbol", "entry_bar", "equity", "peak", "dd"], ["dd_pct"]), f"{_BT}, {_CURVE} select {_cols(['symbol', 'entry_bar', 'equity', 'peak', 'dd'], ['dd_pct'])} from dd")
_add("daily_stats", lambda s, d: _out(performance.daily_stats(_trades(s, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd")), ["symbol", "day", "pnl", "n_trades"], ["win_rate"]), f"{_BT}, x as (select symbol, strftime(exit_timestamp, '%Y-%m-%d') as day, sum(pnl) as pnl, count(*) as n_trades, avg((pnl_pct > 0)::int) as win_rate from trades group by 1, 2) select {_cols(['symbol', 'day', 'pnl', 'n_trades'], ['win_rate'])} from x")
BASIC = ["total_return", "win_rate", "sharpe", "max_drawdown"]
_add("perf_basic", lambda s, d: _out(performance.basic(_trades(s, d)), ["symbol", "n_trades", "net_profit"], BASIC), f"{_BT}, {_CURVE}, x as (select symbol, count(*) as n_trades, sum(pnl) as net_profit, sum(pnl) / {CASH} as total_return, avg((pnl > 0)::int) as win_rate, coalesce(avg(pnl_pct) / nullif(stddev_pop(pnl_pct), 0) * sqrt(252), 0) as sharpe, min(dd_pct) as max_drawdown from dd group by 1) select {_cols(['symbol', 'n_trades', 'net_profit'], BASIC)} from x")
EXT = ["sortino", "calmar", "profit_factor", "expectancy", "recovery", "ulcer"]
_add("perf_extended", lambda s, d: _out(performance.extended(_trades(s, d)), ["symbol"], EXT), f"{_BT}, {_CURVE}, x as (select symbol, avg(ret) * 252 / (stddev_samp(case when ret < 0 then ret end) * sqrt(252)) as sortino, (pow(1 + arg_max(equity, (exit_timestamp, entry_bar)) / arg_min(equity, (exit_timestamp, entry_bar)) - 1, 252.0 / count(ret)) - 1) / abs(min(dd_pct)) as calmar, sum(case when pnl > 0 then pnl end) / abs(sum(case when pnl < 0 then pnl end)) as profit_factor, avg(pnl) as expectancy, sum(pnl) / abs(min(dd_pct)) as recovery, sqrt(avg(pow(dd_pct * 100, 2))) as ulcer from dd group by 1) select {_cols(['symbol'], EXT)} from x")



def _compared(spark, d):
    made = _bars(spark, d)
    spec = backtest.BacktestSpec(TP, SL, max_bars=20, calendar=CAL)
    log = backtest.run_benchmark(made, {"buy_and_hold": signals.buy_and_hold, "ma_crossover": signals.ma_crossover}, spec)
    return _out(log.groupBy("strategy").agg(F.count("*").alias("n_trades"), F.sum("pnl").alias("net_profit"), performance.win_rate().alias("win_rate"), performance.profit_factor().alias("profit_factor")), ["strategy", "n_trades", "net_profit"], ["win_rate", "profit_factor"])


_MA_TRADES = re.sub(r"\b(marked|reach|cand|walk|trades)\b", r"\1_ma", _TRADES).replace("where not e.closed", f"where not e.closed and e.bar_index in (select bar_index from (select bar_index, ({_gate('avg', 'bid_close', 10)}) > ({_gate('avg', 'bid_close', 50)}) as up from bars) where up)")
_STRATEGY = "select '{name}' as strategy, count(*) as n_trades, sum(pnl) as net_profit, avg((pnl > 0)::int) as win_rate, sum(case when pnl > 0 then pnl end) / abs(sum(case when pnl < 0 then pnl end)) as profit_factor from {table}"
_add("strategy_comparison", _compared, f"{_BT}, {_MA_TRADES.replace('marked_ma as (', 'marked_ma as materialized (').replace('cand_ma as (', 'cand_ma as materialized (')}, x as ({_STRATEGY.format(name='buy_and_hold', table='trades')} union all {_STRATEGY.format(name='ma_crossover', table='trades_ma')}) select {_cols(['strategy', 'n_trades', 'net_profit'], ['win_rate', 'profit_factor'])} from x")

# Tests, models, risk ------------------------------------------------------------------------------------------------


def _two(spark, d):
    labels = _labels(spark, d)
    return labels.where("bar_index_start % 2 = 0"), labels.where("bar_index_start % 2 = 1")


_add("t_test_stat", lambda s, d: _out(stats.t_statistic(*_two(s, d)), ["n1", "n2", "df"], ["mean1", "mean2", "t"]), f"with {_sql_bars()}, {_LABELS}, x as (select count(*) filter (m) as n1, count(*) filter (not m) as n2, avg(pnl) filter (m) as mean1, avg(pnl) filter (not m) as mean2, var_samp(pnl) filter (m) as v1, var_samp(pnl) filter (not m) as v2 from (select pnl, bar_index_start % 2 = 0 as m from labels)), y as (select *, n1 + n2 - 2 as df, (mean1 - mean2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) as t from x) select {_cols(['n1', 'n2', 'df'], ['mean1', 'mean2', 't'])} from y")
_add("mann_whitney_u", lambda s, d: _out(stats.mann_whitney_statistic(*_two(s, d)), ["n1", "n2"], ["u", "median1", "median2"]), f"with {_sql_bars()}, {_LABELS}, v as (select pnl, bar_index_start % 2 = 0 as m from labels), r as (select m, pnl, rank() over (order by pnl) + (count(*) over (partition by pnl) - 1) / 2.0 as rk from v), x as (select count(*) filter (m) as n1, count(*) filter (not m) as n2, sum(rk) filter (m) - count(*) filter (m) * (count(*) filter (m) + 1) / 2.0 as u, median(pnl) filter (m) as median1, median(pnl) filter (not m) as median2 from r) select {_cols(['n1', 'n2'], ['u', 'median1', 'median2'])} from x")


def _exact_u(spark, d):
    """Mean pnl by the weekday of a label's start against mean pnl by its hour: few values from all labels."""
    labels = stored(_labels(spark, d), "labels")
    one, other = (labels.groupBy(F.date_format("event_start", k)).agg(F.avg("pnl").alias("pnl")) for k in ("E", "H"))
    got = {k: stats.mann_whitney(one, other, alternative=k) for k in stats.ALTERNATIVES}
    rows = [(k, v["u"], v["p_value"], v["method"]) for k, v in got.items()]
    return _out(spark.createDataFrame(rows, "alternative string, u double, p_value double, method string"), ["alternative", "method"], ["u", "p_value"])


_add(
    "mann_whitney_exact",
    _exact_u,
    f"with recursive {_sql_bars()}, {_LABELS}, v as materialized (select true as m, avg(pnl) as x from labels group by isodow(event_start) union all select false, avg(pnl) from labels group by hour(event_start)), "
    "n as (select count(*) filter (m) as n1, count(*) filter (not m) as n2, count(*) > count(distinct x) as tied from v), o as (select sum((a.x > b.x)::int + 0.5 * (a.x = b.x)::int) as u from v a, v b where a.m and not b.m), "
    # ways(i, k, u): how many orders of k of the first sample among i values have U = u
    "ways as (select 0 as i, 0 as k, 0 as u, 1::double as c union all select i, k, u, sum(c) from (select i + 1 as i, k, u, c from ways, n where i < n1 + n2 union all select i + 1, k + 1, u + i - k, c from ways, n where i < n1 + n2 and k < n1) group by i, k, u), "
    "s as (select w.u, c / sum(c) over () as p from ways w, n where i = n1 + n2 and k = n1), t as (select sum(p) filter (s.u >= o.u) as upper, sum(p) filter (s.u <= o.u) as lower, any_value(o.u) as u from s, o), "
    f"x as (select unnest(['two-sided', 'greater', 'less']) as alternative, case when tied then 'normal' else 'exact' end as method, u, unnest([least(1, 2 * least(upper, lower)), upper, lower]) as p_value from t, n) select {_cols(['alternative', 'method'], ['u', 'p_value'])} from x",
)
_add("classification_metrics", lambda s, d: _out(performance.classification(labeling.decided(_labels(s, d)).withColumn("prediction", F.when(F.col("bar_index_start") % 3 == 0, 1).otherwise(-1))), ["n"], ["accuracy", "precision", "recall", "f1"]), f"with {_sql_bars()}, {_LABELS}, v as (select label, case when bar_index_start % 3 = 0 then 1 else -1 end as p from labels where label <> 0), x as (select count(*) as n, avg((label = p)::int) as accuracy, count_if(label = 1 and p = 1) / count_if(p = 1) as precision, count_if(label = 1 and p = 1) / count_if(label = 1) as recall, 2 * count_if(label = 1 and p = 1) / (count_if(p = 1) + count_if(label = 1)) as f1 from v) select {_cols(['n'], ['accuracy', 'precision', 'recall', 'f1'])} from x")


def _fold_metrics(spark, d):
    rows = folds.numbered(_labels(spark, d).withColumnRenamed("event_start", "timestamp"))
    tests = rows.join(folds.time_series_folds(rows, 4, gap=5).where("role = 'test'"), "row_idx")
    guessed = tests.withColumn("prediction", F.when(F.col("bar_index_start") % 3 == 0, 1).otherwise(-1))
    return _out(performance.classification(labeling.decided(guessed), keys=("fold_id",)), ["fold_id", "n"], ["accuracy", "precision", "recall", "f1"])


_add(
    "fold_metrics",
    _fold_metrics,
    f"with {_sql_bars()}, {_LABELS}, r as (select *, row_number() over (order by event_start) - 1 as row_idx from labels), t as (select count(*) as n, count(*) // 5 as size from labels), f as (select range::int as fold_id, n - (4 - range) * size as start, size from range(4), t), "
    "p as (select fold_id, label, case when bar_index_start % 3 = 0 then 1 else -1 end as guess from r, f where row_idx >= start and row_idx < start + size and label <> 0), c as (select fold_id, count(*) as n, avg((label = guess)::int) as accuracy, count(*) filter (label = 1 and guess = 1) as tp, count(*) filter (guess = 1) as np, count(*) filter (label = 1) as ny from p group by 1), "
    f"x as (select fold_id, n, accuracy, coalesce(tp / nullif(np, 0), 0) as precision, coalesce(tp / nullif(ny, 0), 0) as recall, coalesce(2 * tp / nullif(np + ny, 0), 0) as f1 from c) select {_cols(['fold_id', 'n'], ['accuracy', 'precision', 'recall', 'f1'])} from x",
)


def _hmm(spark, d):
    columns = ["ret_long", "vol_long", "trend_slope", "trend_strength"]
    rows = stored(in_blocks(_bars(spark, d), ft.macro_features, 100).select("symbol", "bar_index", *columns), "macro")
    return regimes.regimes(rows, regimes.fit_hmm(rows, columns, 3), "macro")


def _forest(spark, d):
    made = _bars(spark, d)
    table = stored(labeling.with_labels(ft.feature_matrix(made), labeling.decided(_labels(spark, d))), "training")
    names = clean.feature_columns(ft.feature_matrix(made))
    model = forest.fit_forest(table.where("bar_index % 4 <> 0"), names, forest.ForestSpec())
    scored = forest.predict(model, table.where("bar_index % 4 = 0").na.drop("any", subset=names))
    return scored.select("symbol", "bar_index", "label", "prediction", "probability", forest.confidence().alias("confidence"))


_add("hmm_regimes", _hmm, None)
_add("forest_predictions", _forest, None)
RISK = ["prob_ruin", "prob_target", "mean_final_capital", "mean_max_dd"]
_add(
    "monte_carlo",
    lambda s, d: _out(risk.monte_carlo(_trades(s, d), 1000, 100, 100.0), [], RISK),
    f"{_BT}, numbered as (select pnl, row_number() over (order by exit_timestamp, entry_bar) - 1 as i from trades), steps as (select sim.range as sim, step.range as step, {_draw('sim.range', 'step.range', 42)} % (select count(*) from trades) as i from range(1000) sim, range(100) step), "
    "c as (select sim, step, 100 + sum(pnl) over (partition by sim order by step) as c from steps join numbered using (i)), p as (select *, greatest(100, max(c) over (partition by sim order by step)) as peak, min(case when c <= 90 or c >= 105 then step end) over (partition by sim) as stop from c), "
    "e as (select sim, arg_max(c, step) as c, max((peak - c) / peak) as dd from p where step <= coalesce(stop, 99) group by 1), "
    f"x as (select avg((c <= 90)::int) as prob_ruin, avg((c >= 105)::int) as prob_target, avg(c) as mean_final_capital, avg(dd) as mean_max_dd from e) select {_cols([], RISK)} from x",
)
_add("prop_firm", lambda s, d: risk.prop_firm(risk.monte_carlo(_trades(s, d), 1000, 100, 100.0)).select("viable"), _ALL["monte_carlo"][1].rsplit(" select ", 1)[0] + " select prob_ruin < 0.05 and prob_target > 0.3 as viable from x")
# a value's weight is the number of Poisson(n) shares below its draw
_WEIGHED = (
    f"v as (select pnl as x, count(*) as n, sum(count(*)) over (order by pnl) - count(*) as i from labels group by pnl), rs as (select range as k, " + ", ".join(f"{_draw('range', j, 42)} % {PRIME} as c{j}" for j in range(4)) + f" from range(1000)), "
    "cdf as (select n, list(c order by j) as cs from (select n, j, sum(p) over (partition by n order by j) as c from (select n, j.range as j, exp(j.range * ln(n) - n - lgamma(j.range + 1)) as p from (select distinct n from v), range(0, 2000) j where j.range <= n + 10 * sqrt(n) + 30)) group by n), "
    f"h as (select k, x, n, ((((c3 * i + c2) % {PRIME}) * i + c1) % {PRIME} * i + c0) % {PRIME} as h from v, rs), w as materialized (select k, x, len(list_filter(cs, lambda c: c < (h + 0.5) / {PRIME})) as w from h join cdf using (n))"
)
_BOUNDS = "x as (select quantile_cont(m, 0.025) as lower, quantile_cont(m, 0.975) as upper, (select {whole} from labels) as {name} from m)"
_SHARPE = "case when stddev_pop(pnl) > 0 then avg(pnl) / stddev_pop(pnl) * sqrt(252) end"
for _name, _m, _whole in (
    ("mean", "select sum(w * x) / sum(w) as m from w group by k", "avg(pnl)"),
    ("sharpe", "select sum(w * x) / sum(w) / sqrt(sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2)) * sqrt(252) as m from w group by k", _SHARPE),
    ("median", "select (max(case when upto - w <= floor((t - 1) / 2) and floor((t - 1) / 2) < upto then x end) + max(case when upto - w <= ceil((t - 1) / 2) and ceil((t - 1) / 2) < upto then x end)) / 2 as m from (select *, sum(w) over (partition by k order by x) as upto, sum(w) over (partition by k) as t from w) group by k", "median(pnl)"),
):
    _add(
        "bootstrap_ci" if _name == "mean" else f"bootstrap_{_name}",
        lambda s, d, name=_name: _out(stats.bootstrap_ci(_labels(s, d), statistic=name), [], ["lower", "upper", name]),
        f"with {_sql_bars()}, {_LABELS}, {_WEIGHED}, m as ({_m}), {_BOUNDS.format(whole=_whole, name=_name)} select {_cols([], ['lower', 'upper', _name])} from x",
    )


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
