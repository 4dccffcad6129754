"""Cleaning and validating rows, columns and schemas.

Everything is lazy but ``drop_null_columns`` and ``drop_constant_columns``, whose result schema depends
on the data: one aggregate of one row each.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import compiled
from ..plans.core import column_names, is_date_like, is_fractional, is_numeric, is_orderable, is_string, named, require_choice, require_columns, require_frame, without_nan

#: Other names of types in expected schemas.
TYPE_ALIASES = {"integer": "int", "long": "bigint", "bool": "boolean", "str": "string", "short": "smallint", "byte": "tinyint"}
QUANTILE_ACCURACY = 200_000


def clean_column_names(df: DataFrame) -> DataFrame:
    """Names in lower case with single underscores; repeats get the first free suffix _1, _2 ..."""
    require_frame(df)
    names: list[str] = []
    for raw in df.columns:
        base = re.sub(r"[^a-z0-9]+", "_", raw.lower()).strip("_") or "col"
        name, n = base, 0
        while name in names:
            n += 1
            name = f"{base}_{n}"
        names.append(name)
    return df.toDF(*names)


def drop_null_columns(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Without the columns of which a share of ``threshold`` or more is null or NaN; an empty table is unchanged."""
    require_frame(df)
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    missing = [F.count_if(named(f.name).isNull() | (F.isnan(named(f.name)) if is_fractional(f.dataType) else F.lit(False))).alias(f"_{i}") for i, f in enumerate(df.schema.fields)]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *missing).first()
    if not row["_n"]:
        return df
    return df.select(*(named(c) for i, c in enumerate(df.columns) if row[f"_{i}"] / row["_n"] < threshold))


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Without the columns that have at most one distinct value besides null."""
    require_frame(df)

    def varies(i: int, kind, c: Column) -> Column:
        # least and greatest decide in one pass; types without an order are counted
        return (F.min(c) != F.max(c) if is_orderable(kind) else F.count_distinct(F.to_json(F.struct(c))) > 1).alias(f"_{i}")

    row = df.agg(F.lit(1).alias("_"), *(varies(i, f.dataType, named(f.name)) for i, f in enumerate(df.schema.fields))).first()
    return df.select(*(named(c) for i, c in enumerate(df.columns) if row[f"_{i}"]))


def fill_nulls_by_type(df: DataFrame, numeric_fill: float = 0, string_fill: str = "unknown", date_fill: str | None = None) -> DataFrame:
    """Nulls replaced by a value for the column's kind, cast to the column's own type."""
    require_frame(df)

    def filled(f) -> Column:
        c = named(f.name)
        fill = numeric_fill if is_numeric(f.dataType) else string_fill if is_string(f.dataType) else date_fill if is_date_like(f.dataType) else None
        return c if fill is None else F.coalesce(c, F.lit(fill).cast(f.dataType)).alias(f.name)

    return df.select(*map(filled, df.schema.fields))


def _directed(order_by: str | Sequence[str], last: bool) -> list[Column]:
    out = []
    for name in column_names(order_by):
        falling = name.startswith("-")
        c = named(name.removeprefix("-"))
        # the mirror image of ascending with nulls first is descending with nulls last
        out.append(c.desc_nulls_last() if falling != last else c.asc_nulls_first())
    return out


def deduplicate(df: DataFrame, subset: str | Sequence[str] | None = None, order_by: str | Sequence[str] | None = None, keep: str = "first") -> DataFrame:
    """One row for each value of ``subset`` (all columns by default): the first or last by ``order_by``.

    ``-name`` orders descending. Without an order any row stays, at the cost of one aggregation.
    """
    require_frame(df)
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    keys = require_columns(df, subset) if subset is not None else df.columns
    if not order_by:
        return df.dropDuplicates(keys)
    require_columns(df, [c.removeprefix("-") for c in column_names(order_by)])
    ranked = Window.partitionBy(*map(named, keys)).orderBy(*_directed(order_by, keep == "last"))
    return df.withColumn("__rank", F.row_number().over(ranked)).where("__rank = 1").drop("__rank")


def standardize_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Trimmed of spaces, with single spaces, in lower case; all text columns by default."""
    require_frame(df)
    wanted = require_columns(df, columns) if columns is not None else [f.name for f in df.schema.fields if is_string(f.dataType)]
    return df.withColumns({c: F.lower(F.regexp_replace(F.trim(named(c)), r"\s+", " ")) for c in wanted}) if wanted else df


def _with_statistics(df: DataFrame, **statistics: Column) -> DataFrame:
    """Every row beside the one row of the aggregates, which is all that is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*(c.alias(f"__{k}") for k, c in statistics.items()))))


def _quartiles(c: Column, accuracy: int) -> dict[str, Column]:
    q = F.percentile_approx(c, [0.25, 0.75], accuracy)
    return {"q1": q[0].cast("double"), "q3": q[1].cast("double")}


def remove_outliers(df: DataFrame, column: str, method: str = "iqr", factor: float = 1.5, z_threshold: float = 3.0, accuracy: int = QUANTILE_ACCURACY) -> DataFrame:
    """Rows within the quartiles' fences, or within ``z_threshold`` standard deviations of the mean.

    Null values stay, NaN goes. Where there is no spread to judge by nothing is removed.
    """
    require_frame(df)
    require_columns(df, column)
    require_choice(method, ("iqr", "zscore"), "method")
    x = without_nan(df, column)
    if method == "iqr":
        rows = _with_statistics(df, **_quartiles(x, accuracy))
        reach = F.lit(factor) * (F.col("__q3") - F.col("__q1"))
        inside = named(column).between(F.col("__q1") - reach, F.col("__q3") + reach) | F.col("__q1").isNull()
    else:
        rows = _with_statistics(df, mean=F.mean(x), sd=F.stddev(x))
        flat = F.col("__sd").isNull() | (F.col("__sd") == 0)
        inside = flat | (F.abs(F.try_divide(named(column) - F.col("__mean"), F.col("__sd"))) <= z_threshold)
    return rows.where(named(column).isNull() | inside).select(*map(named, df.columns))


def cap_outliers(df: DataFrame, column: str, method: str = "iqr", factor: float = 1.5, lower_pct: float = 0.01, upper_pct: float = 0.99, accuracy: int = QUANTILE_ACCURACY) -> DataFrame:
    """Values drawn in to the fences or to two percentiles; null and NaN stay as they are."""
    require_frame(df)
    require_columns(df, column)
    require_choice(method, ("iqr", "percentile"), "method")
    x = without_nan(df, column)
    if method == "iqr":
        rows = _with_statistics(df, **_quartiles(x, accuracy))
        reach = F.lit(factor) * (F.col("__q3") - F.col("__q1"))
        low, high = F.col("__q1") - reach, F.col("__q3") + reach
    else:
        q = F.percentile_approx(x, [lower_pct, upper_pct], accuracy)
        rows = _with_statistics(df, low=q[0].cast("double"), high=q[1].cast("double"))
        low, high = F.col("__low"), F.col("__high")
    capped = F.when(x.isNotNull() & low.isNotNull(), F.least(F.greatest(x.cast("double"), low), high)).otherwise(named(column).cast("double"))
    return rows.select(*(capped.alias(c) if c == column else named(c) for c in df.columns))


def _type_name(name: str) -> str:
    name = name.strip().lower()
    return TYPE_ALIASES.get(name, name)


def validate_schema(df: DataFrame, expected_schema: Mapping[str, str]) -> dict:
    """What ``df`` lacks, has besides, and has of another type than expected; reads no data."""
    require_frame(df)
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = {c: {"expected": t, "actual": actual[c]} for c, t in expected_schema.items() if c in actual and _type_name(t) != _type_name(actual[c])}
    return {"missing_cols": sorted(set(expected_schema) - set(actual)), "extra_cols": sorted(set(actual) - set(expected_schema)), "type_mismatches": wrong}


def enforce_types(df: DataFrame, type_map: Mapping[str, str]) -> DataFrame:
    """Columns cast to the given types; values that can't be cast become null, unknown columns are passed over."""
    require_frame(df)
    return df.select(*(named(c).try_cast(type_map[c]).alias(c) if c in type_map else named(c) for c in df.columns))


def flag_invalid_rows(df: DataFrame, rules: Mapping[str, str | Column]) -> DataFrame:
    """``df`` with ``is_valid``: whether every rule holds; a rule that is null doesn't hold."""
    require_frame(df)
    if not rules:
        raise ValueError("rules must not be empty")
    valid = F.lit(True)
    for name, rule in rules.items():
        valid = valid & F.coalesce(compiled(name, rule), F.lit(False))
    return df.withColumn("is_valid", valid)


def split_valid_invalid(df: DataFrame, rules: Mapping[str, str | Column]) -> tuple[DataFrame, DataFrame]:
    """(rows for which every rule holds, all others)."""
    flagged = flag_invalid_rows(df, rules)
    return flagged.where("is_valid").drop("is_valid"), flagged.where("not is_valid").drop("is_valid")


def normalize_values(df: DataFrame, column: str, mapping: Mapping) -> DataFrame:
    """Values replaced by their image in ``mapping``; others and null stay."""
    require_frame(df)
    if not mapping:
        raise ValueError("mapping must not be empty")
    require_columns(df, column)
    kind = df.schema[column].dataType
    pairs = [F.lit(x).cast(kind) for kv in mapping.items() for x in kv]
    return df.withColumn(column, F.coalesce(F.create_map(*pairs)[named(column)], named(column)))
