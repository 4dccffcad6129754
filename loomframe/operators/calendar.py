"""Dates, times, calendars and gaps in time series."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..plans.core import column_names, is_numeric, is_string, named, require_columns, require_frame

#: The formats that are tried in turn.
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yyyy", "yyyyMMdd", "MM-dd-yyyy"]
#: Intervals with the step, the type and the name of the spine's column.
INTERVALS = {
    "day": ("interval 1 day", "date", "date"),
    "week": ("interval 7 days", "date", "week_start"),
    "month": ("interval 1 month", "date", "month_start"),
    "hour": ("interval 1 hour", "timestamp", "ts"),
}


def _parts(df: DataFrame, column: str, parts: Sequence[str] | None, known: dict, what: str) -> DataFrame:
    require_frame(df)
    require_columns(df, column)
    wanted = list(known) if parts is None else list(parts)
    if bad := [p for p in wanted if p not in known]:
        raise ValueError(f"Unsupported {what}: {bad}; known are {list(known)}")
    return df.withColumns({f"{column}_{p}": known[p](named(column)) for p in wanted}) if wanted else df


def _unit(units: str) -> str:
    if units.lower() not in dates.UNITS:
        raise ValueError(f"Unsupported units: {units!r}; known are {list(dates.UNITS)}")
    return units.lower()


def parse_dates(df: DataFrame, column: str, formats: Sequence[str] | None = None, output_col: str | None = None) -> DataFrame:
    """The text as a date by the first format that fits, else null."""
    require_frame(df)
    require_columns(df, column)
    return df.withColumn(output_col or column, dates.first_parsed(named(column), list(formats or DATE_FORMATS)))


def add_date_parts(df: DataFrame, date_col: str, parts: Sequence[str] | None = None) -> DataFrame:
    """``{date_col}_{part}`` for each part."""
    return _parts(df, date_col, parts, dates.DATE_PARTS, "date part")


def add_time_parts(df: DataFrame, timestamp_col: str, parts: Sequence[str] | None = None) -> DataFrame:
    """``{timestamp_col}_{part}`` for hour, minute and second."""
    return _parts(df, timestamp_col, parts, dates.TIME_PARTS, "time part")


def date_diff_columns(df: DataFrame, start_col: str, end_col: str, units: str = "days") -> DataFrame:
    """``{start}_to_{end}_diff_{units}``; months, years and shorter units go to 0."""
    require_frame(df)
    require_columns(df, [start_col, end_col])
    return df.withColumn(f"{start_col}_to_{end_col}_diff_{units}", dates.elapsed(named(start_col), named(end_col), _unit(units)))


def add_business_days(df: DataFrame, date_col: str, n_days: int, output_col: str | None = None, weekend_start: str = "roll") -> DataFrame:
    """The date ``n_days`` Mondays to Fridays later; see ``functions.dates.plus_business_days`` for weekends."""
    require_frame(df)
    require_columns(df, date_col)
    return df.withColumn(output_col or f"{date_col}_plus_{n_days}bd", dates.plus_business_days(named(date_col).cast("date"), n_days, weekend_start))


def is_business_day(df: DataFrame, date_col: str, output_col: str | None = None) -> DataFrame:
    """Whether the date is a Monday to Friday; ``{date_col}_is_business_day`` by default."""
    require_frame(df)
    require_columns(df, date_col)
    return df.withColumn(output_col or f"{date_col}_is_business_day", F.dayofweek(named(date_col)).between(2, 6))


def _step(interval: str) -> tuple[Column, str, str]:
    if interval not in INTERVALS:
        raise ValueError(f"Unsupported interval: {interval!r}; known are {list(INTERVALS)}")
    step, kind, name = INTERVALS[interval]
    return F.expr(step), kind, name


def _moment(value: str | date | datetime, kind: str) -> Column:
    return F.lit(value).cast("timestamp" if kind == "timestamp" else "date")


def generate_date_spine(spark: SparkSession, start_date: str | date, end_date: str | date, interval: str = "day") -> DataFrame:
    """All days, weeks, months or hours from the start to the end, both included; weeks step from the start."""
    step, kind, name = _step(interval)
    return spark.range(1).select(F.explode(F.sequence(_moment(start_date, kind), _moment(end_date, kind), step)).alias(name))


def fill_date_gaps(
    df: DataFrame,
    date_col: str,
    partition_cols: str | Sequence[str] | None = None,
    interval: str = "day",
    fill_value: float | str = 0,
    value_cols: str | Sequence[str] | None = None,
    keep_name: bool = False,
) -> DataFrame:
    """A row for every step between the first and the last date, for each combination of ``partition_cols``.

    Dates are cut to the interval before they are matched. Missing and null values of ``value_cols``
    (all other columns by default) become ``fill_value`` where their type can hold it. The date
    column takes the spine's name unless ``keep_name``. Lazy: the range is an aggregate of the plan.
    """
    require_frame(df)
    keys = require_columns(df, column_names(partition_cols))
    require_columns(df, date_col)
    step, kind, spine_name = _step(interval)
    name = date_col if keep_name else spine_name
    values = require_columns(df, value_cols) if value_cols is not None else [c for c in df.columns if c not in (date_col, *keys)]
    moment = named(date_col).cast(kind)
    moment = F.date_trunc("hour", moment) if interval == "hour" else moment
    ends = df.agg(F.min(moment).alias("__lo"), F.max(moment).alias("__hi")).where("__lo is not null")
    spine = ends.select(F.explode(F.sequence("__lo", "__hi", step)).alias("__t"))
    if keys:
        spine = spine.crossJoin(df.select(*(named(k).alias(f"__k{i}") for i, k in enumerate(keys))).distinct())
    data = df.withColumn("__m", moment)
    on = F.col("__t") == F.col("__m")
    for i, k in enumerate(keys):
        on = on & F.col(f"__k{i}").eqNullSafe(named(k))
    rows = spine.join(data, on, "left")
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def filled(c: str) -> Column:
        if c == date_col:
            return F.col("__t").alias(name)
        if c in keys:
            return F.col(f"__k{keys.index(c)}").alias(c)
        fits = is_numeric(kinds[c]) if isinstance(fill_value, (int, float)) and not isinstance(fill_value, bool) else is_string(kinds[c])
        return F.coalesce(named(c), F.lit(fill_value).cast(kinds[c])).alias(c) if c in values and fits else named(c)

    return rows.select(*map(filled, df.columns))


def add_fiscal_year(df: DataFrame, date_col: str, fiscal_start_month: int = 7, output_col: str = "fiscal_year") -> DataFrame:
    """The calendar year in which the date's fiscal year ends."""
    require_frame(df)
    require_columns(df, date_col)
    if fiscal_start_month not in range(1, 13):
        raise ValueError("fiscal_start_month must be 1 to 12")
    return df.withColumn(output_col, dates.fiscal_year(named(date_col), fiscal_start_month))


def _reference(as_of_date: str | None, kind: str) -> Column:
    if as_of_date is not None:
        return F.lit(as_of_date).cast(kind)
    return F.current_date() if kind == "date" else F.current_timestamp()


def add_age(df: DataFrame, date_col: str, as_of_date: str | None = None, output_col: str = "age_years") -> DataFrame:
    """Whole years since the date, as of today by default."""
    require_frame(df)
    require_columns(df, date_col)
    return df.withColumn(output_col, dates.elapsed(named(date_col), _reference(as_of_date, "date"), "years", "floor"))


def add_time_since(df: DataFrame, date_col: str, as_of_date: str | None = None, units: str = "days", output_col: str | None = None) -> DataFrame:
    """Units since the date or time; months and years go down, shorter units to 0."""
    require_frame(df)
    require_columns(df, date_col)
    unit = _unit(units)
    until = _reference(as_of_date, "date" if unit in ("days", "months", "years") else "timestamp")
    return df.withColumn(output_col or f"{date_col}_since_{units}", dates.elapsed(named(date_col), until, unit, "floor"))


def bucket_time_of_day(df: DataFrame, timestamp_col: str, output_col: str = "time_of_day") -> DataFrame:
    """morning, afternoon, evening or night; null for null."""
    require_frame(df)
    require_columns(df, timestamp_col)
    return df.withColumn(output_col, dates.day_period(named(timestamp_col)))
