"""Trading sessions as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0}


def _seconds(clock: str) -> int:
    h, m = clock.split(":")
    return int(h) * 3600 + int(m) * 60


@dataclass(frozen=True)
class SessionCalendar:
    """Sessions from start to end of a day in a time zone; Friday's ends earlier. Saturday and Sunday are closed unless weekend_trading."""

    timezone: str = "UTC"
    start: str = "00:00"
    end: str = "21:55"
    friday_end: str = "20:00"
    weekend_trading: bool = False

    def _local(self, ts: Column | str) -> Column:
        ts = F.col(ts) if isinstance(ts, str) else ts
        return ts if self.timezone == "UTC" else F.from_utc_timestamp(ts, self.timezone)

    def is_weekend(self, ts: Column | str) -> Column:
        return F.weekday(self._local(ts)) >= 5

    def session_end(self, ts: Column | str) -> Column:
        """The end of the session of the day of ts, as an instant."""
        local = self._local(ts)
        seconds = F.when(F.weekday(local) == 4, _seconds(self.friday_end)).otherwise(_seconds(self.end))
        end = F.date_trunc("day", local) + F.make_dt_interval(secs=seconds)
        return end if self.timezone == "UTC" else F.to_utc_timestamp(end, self.timezone)

    def time_to_end(self, ts: Column | str, unit: str = "seconds") -> Column:
        if unit not in UNITS:
            raise ValueError(f"unknown unit: {unit}")
        at = F.col(ts) if isinstance(ts, str) else ts
        return F.greatest(F.lit(0.0), (F.unix_micros(self.session_end(ts)) - F.unix_micros(at)) / 1e6) / UNITS[unit]

    def bars_to_end(self, ts: Column | str, bar_seconds: Column) -> Column:
        """Whole bars of that duration until the session's end. A duration of 0 or less is an error."""
        checked = F.when(bar_seconds > 0, bar_seconds).otherwise(F.raise_error(F.lit("a bar's duration must be positive")).cast("double"))
        return F.floor(self.time_to_end(ts) / checked)

    def near_end(self, ts: Column | str, minutes: float = 30) -> Column:
        return self.time_to_end(ts, "minutes") <= minutes

    def in_no_trade_zone(self, ts: Column | str, bar_seconds: Column, min_bars: int) -> Column:
        return self.bars_to_end(ts, bar_seconds) < min_bars

    def trading_allowed(self, ts: Column | str) -> Column:
        """Within the session, both ends included."""
        local = self._local(ts)
        clock = F.hour(local) * 3600 + F.minute(local) * 60 + F.date_format(local, "s.SSSSSS").cast("double")
        end = F.when(F.weekday(local) == 4, _seconds(self.friday_end)).otherwise(_seconds(self.end))
        open_day = F.lit(True) if self.weekend_trading else ~self.is_weekend(ts)
        return open_day & (clock >= _seconds(self.start)) & (clock <= end)

    def drop_weekends(self, df: DataFrame, ts: str = "timestamp") -> DataFrame:
        return df if self.weekend_trading else df.where(~self.is_weekend(ts))

    def session_rows(self, df: DataFrame, ts: str = "timestamp") -> DataFrame:
        return df.where(self.trading_allowed(ts))
