"""Date parsing, half-open windows and calendar buckets."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upswell.config import EmergenceConfig

# Date texts (pattern, places of year, month and day among its groups); the first that fits counts.
DATE_FORMS = (
    (r"(\d{4})-(\d{1,2})-(\d{1,2})", (1, 2, 3)),
    (r"(\d{1,2})/(\d{1,2})/(\d{4})", (3, 1, 2)),
    (r"(\d{1,2})/(\d{1,2})/(\d{2})", (3, 1, 2)),
    (r"(\d{4})/(\d{1,2})/(\d{1,2})", (1, 2, 3)),
    (r"(\d{4})(\d{2})(\d{2})", (1, 2, 3)),
    (r"(0?[1-9]|1[0-2])\.(\d{1,2})\.(\d{4})", (3, 1, 2)),
    (r"(\d{1,2})\.(0?[1-9]|1[0-2])\.(\d{4})", (3, 2, 1)),
    (r"([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})", (3, 1, 2)),
    (r"(\d{1,2})[ -]([A-Za-z]{3,9})\.?[ -](\d{4})", (3, 2, 1)),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAY = r"(?:(?i:mon|tue|wed|thu|fri|sat|sun)[A-Za-z]{0,6}\.?,? +)?"
HALF_DAY = r"[AaPp]\.?[Mm]\.?"
FIRST_YEAR = 69
"""Two-digit years from this one on are of the 20th century."""


def _any_form() -> tuple[str, str]:
    """All forms as one pattern, and the replacement that puts whichever matched in ISO order."""
    patterns, parts, n = [], ["", "", ""], 0
    for pattern, places in DATE_FORMS:
        patterns.append(pattern)
        parts = [p + f"${n + place}" for p, place in zip(parts, places)]  # groups of other forms are empty
        n += len(places)
    return f"^{WEEKDAY}(?:{'|'.join(patterns)})(?=$|[ T])", "-".join(parts)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated a single time, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _iso(text: Column) -> Column:
    """A timestamp from year-month-day and what follows; the month may be a name, the year short, the time of 12 hours."""
    named = F.lower(F.regexp_extract(text, r"^\d+-([A-Za-z]{3})", 1))
    number = F.array_position(F.array(*map(F.lit, MONTHS)), named)
    text = F.when(named == "", text).when(number > 0, F.regexp_replace(
        text, F.lit("-[A-Za-z]+-"), F.concat(F.lit("-"), number.cast("string"), F.lit("-"))))
    year = F.regexp_extract(text, r"^(\d\d)-", 1)
    text = F.when(year == "", text).otherwise(F.concat(F.when(year >= str(FIRST_YEAR), F.lit("19")).otherwise(F.lit("20")), text))
    return _once(text, lambda t: F.when(t.rlike(f"{HALF_DAY}$"), _once(
        F.regexp_extract(t, rf"^(?:[^ T]+[ T]+)(0?[1-9]|1[0-2])(?::\d\d(?::\d\d(?:\.\d+)?)?)? ?{HALF_DAY}$", 1),
        lambda hour: F.when(hour != "", _half_day(t, hour))).try_cast("timestamp")).otherwise(t.try_cast("timestamp")))


def _half_day(text: Column, hour: Column) -> Column:
    """The text with its hour of 1 to 12 as one of 0 to 23 (12 AM is 0)."""
    later = F.when(text.rlike(r"[Pp]\.?[Mm]\.?$"), 12).otherwise(0)
    of_day = F.lpad((hour.cast("int") % 12 + later).cast("string"), 2, "0")
    minutes = F.regexp_extract(text, r"[ T]+\d{1,2}((?::\d\d){1,2}(?:\.\d+)?)", 1)
    return F.concat(F.regexp_extract(text, "^([^ T]+)", 1), F.lit(" "), of_day, F.when(minutes == "", F.lit(":00")).otherwise(minutes))


def lenient_timestamp(col: Column) -> Column:
    """Parse to timestamp; junk becomes NULL instead of failing (ANSI-safe).

    ISO dates with or without a time (to minutes, seconds or fractions, also of
    12 hours with AM or PM) and an offset or ``Z`` (turned to UTC), compact
    ``yyyyMMdd``, ``yyyy/m/d``, ``m/d/yyyy``, ``m/d/yy``, ``m.d.yyyy`` and dates
    with the month's name, all also after a weekday's name, which isn't checked;
    single digits need no leading zero. Dots are read month first like slashes,
    and day first only where the first number is above 12. ISO texts are cast as they are; any
    other text is brought to ISO order by one search over all forms.
    """
    pattern, order = _any_form()
    plain = rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}(?:$|[ T](?![^A-Za-z]*{HALF_DAY}$))"

    def parse(s: Column) -> Column:
        # A text that no form fits stays as it is.
        moved = F.regexp_replace(s, pattern, order)
        other = _once(moved, lambda t: F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), t.try_cast("timestamp")).when(
            (t != s) | t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[ T]"), _iso(t)))
        return F.when(s.rlike(plain), s.try_cast("timestamp")).otherwise(other)

    return _once(F.btrim(col.cast("string")), parse)


def parse_date_column(df: DataFrame, name: str = "date_received") -> DataFrame:
    """Make ``name`` a timestamp column; strings parsed leniently, zones to UTC."""
    if name not in df.columns:
        return df
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return df
    if isinstance(dtype, T.DateType):
        return df.withColumn(name, F.col(name).cast("timestamp"))
    return df.withColumn(name, lenient_timestamp(F.col(name)))


def ts_literal(value: _dt.datetime | _dt.date, like: T.DataType | None = None) -> Column:
    """A timestamp literal typed like the column it is compared with."""
    if isinstance(value, _dt.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    else:
        text = value.strftime("%Y-%m-%d 00:00:00.000000")
    target = "timestamp_ntz" if isinstance(like, T.TimestampNTZType) else "timestamp"
    return F.lit(text).cast(target)


def max_timestamp(df: DataFrame, name: str = "date_received", partition: str | None = None) -> _dt.datetime | None:
    """Newest timestamp in the data, as a naive UTC ``datetime`` (small jobs).

    Fetched eagerly so that the window bounds become literals, which Parquet
    row-group / partition pruning can use. ``partition`` names the column of a
    table written by month (as ``ingest`` writes it): the newest month is found
    from the directories first, and only that one is scanned.
    """
    if partition:
        newest = df.agg(F.max(F.col(partition)).alias("p")).first()["p"]
        if newest is None:
            return None
        df = df.filter(F.col(partition) == F.lit(newest))
    row = df.agg(F.date_format(F.max(F.col(name)), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("m")).first()
    if row is None or row["m"] is None:
        return None
    return _dt.datetime.strptime(row["m"], "%Y-%m-%d %H:%M:%S.%f")


def months_between(df: DataFrame, start: _dt.date, end: _dt.date, partition: str | None) -> DataFrame:
    """Only the months that touch [start, end], by the month column of a table written by month."""
    if not partition:
        return df
    return df.filter(F.col(partition).cast("string").between(f"{start:%Y-%m}", f"{end:%Y-%m}"))


def min_max_dates(df: DataFrame, name: str = "date_received") -> tuple[_dt.date | None, _dt.date | None]:
    row = df.agg(
        F.date_format(F.min(F.col(name)), "yyyy-MM-dd").alias("lo"),
        F.date_format(F.max(F.col(name)), "yyyy-MM-dd").alias("hi"),
    ).first()
    conv = lambda s: None if s is None else _dt.date.fromisoformat(s)
    return conv(row["lo"]), conv(row["hi"])


@dataclass(frozen=True)
class Windows:
    """current = [current_start, end), prior and baseline directly before it."""

    end: _dt.datetime
    current_start: _dt.datetime
    prior_start: _dt.datetime
    baseline_start: _dt.datetime

    @staticmethod
    def ending_at(end: _dt.datetime, current_days: int, prior_days: int,
                  baseline_days: int = 0) -> "Windows":
        cs = end - _dt.timedelta(days=current_days)
        ps = cs - _dt.timedelta(days=prior_days)
        bs = ps - _dt.timedelta(days=baseline_days)
        return Windows(end, cs, ps, bs)

    @staticmethod
    def from_config(end: _dt.datetime, cfg: EmergenceConfig) -> "Windows":
        return Windows.ending_at(end, cfg.time_window_days, cfg.prior_window_days,
                                 cfg.seasonality_window_days)

    def flags(self, col: Column, like: T.DataType | None = None) -> tuple[Column, Column, Column]:
        e, c, p, b = (ts_literal(x, like) for x in (self.end, self.current_start,
                                                    self.prior_start, self.baseline_start))
        return ((col >= c) & (col < e), (col >= p) & (col < c), (col >= b) & (col < p))

    def rows(self, df: DataFrame, date: str, partition: str | None = None) -> DataFrame:
        """Rows in any window; directories of other months are pruned if ``partition`` names the month column."""
        return months_between(df, self.baseline_start, self.end, partition).filter(self.span(F.col(date), df.schema[date].dataType))

    def span(self, col: Column, like: T.DataType | None = None) -> Column:
        """Rows in any window: one range predicate, pushed to the scan."""
        return (col >= ts_literal(self.baseline_start, like)) & (col < ts_literal(self.end, like))


def week_start(col: Column) -> Column:
    """Monday of the ISO week (pandas ``to_period('W')`` start)."""
    return F.to_date(F.date_trunc("week", col))


def week_label(col: Column) -> Column:
    ws = week_start(col)
    return F.concat_ws("/", F.date_format(ws, "yyyy-MM-dd"), F.date_format(F.date_add(ws, 6), "yyyy-MM-dd"))
