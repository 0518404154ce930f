"""Logical days, ISO weeks and window keys.

Expressions assume the session time zone is UTC (see `memlake.session`) and
convert to the configured zone themselves.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from memlake.settings import DEFAULTS, Settings


def local_time(ts: Column, settings: Settings = DEFAULTS) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp"), settings.timezone)


def logical_day(ts: Column, settings: Settings = DEFAULTS) -> Column:
    """The day a moment belongs to when days turn over at the local boundary time."""
    shift = F.make_dt_interval(F.lit(0), F.lit(settings.boundary_hour), F.lit(settings.boundary_minute))
    return F.to_date(local_time(ts, settings) - shift)


def previous_logical_day(now: Column, settings: Settings = DEFAULTS) -> Column:
    """The last logical day that was already complete at `now`."""
    return F.date_sub(logical_day(now, settings), 1)


def local_hhmm(ts: Column, settings: Settings = DEFAULTS) -> Column:
    return F.date_format(local_time(ts, settings), "HH:mm")


def day_windows(days: DataFrame, *, start_offset: int = 0, start_hour: int = 3, start_minute: int = 0,
                end_offset: int = 1, end_hour: int = 3, end_minute: int = 0,
                settings: Settings = DEFAULTS) -> DataFrame:
    """Add the UTC bounds `[window_start, window_end)` to each `memory_date`."""
    def bound(offset: int, hour: int, minute: int) -> Column:
        wall = (F.date_add("memory_date", offset).cast("timestamp")
                + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute)))
        return F.to_utc_timestamp(wall, settings.timezone)

    return (days.withColumn("window_start", bound(start_offset, start_hour, start_minute))
                .withColumn("window_end", bound(end_offset, end_hour, end_minute)))


#: Shortest slice of time that windows are laid out over, in seconds; longer windows take slices of four, sixteen, ... times.
SLICE = 6 * 3600


def assign_windows(messages: DataFrame, windows: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ()) -> DataFrame:
    """Messages with every window of theirs, `[window_start, window_end)`; windows may overlap, last for months or leave gaps.

    With `keys` (such as the agent) a message meets the windows of its key only.
    Windows are laid out over slices of time about as long as themselves, a few
    each; a message looks once per slice length in use, and the join is an equi
    join on key, slice length and slice. A key with most of the messages is so cut
    by time. Empty windows and null times match nothing.
    """
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    lasts = seconds(F.col("window_end")) - seconds(F.col("window_start"))
    length = F.lit(SLICE).cast("bigint") * F.pow(F.lit(4.0), F.greatest(F.lit(0), F.ceil(F.log(4.0, lasts / SLICE)))).cast("bigint")
    sized = windows.where("window_start < window_end").withColumn("_length", length)
    # One number for each fourfold length of windows goes to the driver.
    lengths = sorted(r[0] for r in sized.select("_length").distinct().collect())
    slice_of = lambda second: F.floor(second / F.col("_length"))
    covered = sized.withColumn("_slice", F.explode(F.sequence(slice_of(seconds(F.col("window_start"))), slice_of(seconds(F.col("window_end"))))))
    probes = messages.withColumn("_length", F.explode(F.array(*[F.lit(n).cast("bigint") for n in lengths]))) if lengths else (
        messages.withColumn("_length", F.lit(0).cast("bigint")).limit(0))
    probes = probes.withColumn("_slice", slice_of(seconds(F.col(ts))))
    return (probes.join(covered, [*keys, "_length", "_slice"])
            .filter((F.col(ts) >= F.col("window_start")) & (F.col(ts) < F.col("window_end")))
            .drop("_length", "_slice"))


# --- ISO weeks -----------------------------------------------------------------

def week_id(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def monday(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def week_monday(week: Column) -> Column:
    """Monday of `YYYY-Www`; null when the text names no ISO week."""
    shape = r"^\s*(\d{4})-W(\d{1,2})\s*$"
    year = F.regexp_extract(week, shape, 1).try_cast("int")
    number = F.regexp_extract(week, shape, 2).try_cast("int")
    first = F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date")
    candidate = F.date_add(first, (number - 1) * 7)
    return F.when(
        (F.extract(F.lit("YEAROFWEEK"), candidate) == year) & (F.weekofyear(candidate) == number), candidate)


def week_sunday(week: Column) -> Column:
    return F.date_add(week_monday(week), 6)


def shift_week(week: Column, weeks: int) -> Column:
    return week_id(F.date_add(week_monday(week), 7 * weeks))


def previous_week(day: Column) -> Column:
    return week_id(F.date_sub(monday(day), 7))


def week_dates(week: Column) -> Column:
    start = week_monday(week)
    return F.when(start.isNotNull(), F.sequence(start, F.date_add(start, 6)))


def complete_weeks(first_day: Column, last_day: Column) -> Column:
    """Week ids from the week of `first_day` to the last week that ended by `last_day`."""
    start = monday(first_day)
    end = monday(F.date_add(last_day, -6))
    return F.when(end >= start, F.transform(
        F.sequence(start, end, F.make_dt_interval(F.lit(7))), week_id)).otherwise(
        F.array().cast("array<string>"))


def trim_boundary(week: Column, settings: Settings = DEFAULTS) -> Column:
    """Last day whose transcript may be trimmed in the decay run of `week`."""
    return F.date_sub(week_monday(week), 7 * settings.trim_weeks + 1)


def session_decay_boundary(week: Column, settings: Settings = DEFAULTS) -> Column:
    return F.date_add(week_monday(week), 6 - 7 * settings.session_decay_weeks)


# --- time keys -------------------------------------------------------------------

def _iso_date(text: Column) -> Column:
    return F.when(F.btrim(text).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"),
                  F.try_to_date(F.btrim(text), "yyyy-M-d"))


def characterized_date(depth: Column, time_key: Column) -> Column:
    """One date that stands for a day, a week or a multi-week window."""
    span_text = F.regexp_extract(time_key, r"^[^+]*\+?(.*)$", 1)
    span_number = F.regexp_replace(span_text, "d+$", "")
    span = F.when(span_number == "", F.lit(1)).otherwise(F.btrim(span_number).try_cast("int"))
    start = _iso_date(F.substring_index(time_key, "+", 1))
    return (F.when(depth == "surface", _iso_date(time_key))
             .when(depth == "shallow", F.date_add(week_monday(time_key), 3))
             .when((depth == "deep") & span.isNotNull(),
                   F.date_add(start, F.greatest(F.lit(0), F.floor(span / 2).cast("int")))))


def date_window(text: str | None) -> tuple[date, date] | None:
    """Parse `D` or `D1,D2` (either order) of a query parameter."""
    parts = [date.fromisoformat(part.strip()) for part in (text or "").split(",") if part.strip()]
    if not parts:
        return None
    if len(parts) > 2:
        raise ValueError("a date window is one date or two dates separated by a comma")
    return min(parts), max(parts)


def date_in_range(day: Column, *, on: date | None = None, start: date | None = None,
                  end: date | None = None) -> Column:
    """Day filter: a single day, a closed range, or a range open on one side."""
    if on is not None and (start or end):
        raise ValueError("give one day or a range, not both")
    if on is not None:
        return day == F.lit(on)
    keep = F.lit(True)
    if start is not None:
        keep = keep & (day >= F.lit(start))
    if end is not None:
        keep = keep & (day <= F.lit(end))
    return keep
