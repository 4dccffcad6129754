"""Names, types, checks and the one-aggregate report plan that the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, MapType, NumericType, StringType, StructType, TimestampNTZType, TimestampType, VariantType


def named(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(kind: DataType) -> bool:
    return isinstance(kind, NumericType)


def is_string(kind: DataType) -> bool:
    return isinstance(kind, StringType)


def is_date_like(kind: DataType) -> bool:
    return isinstance(kind, (DateType, TimestampType, TimestampNTZType))


def is_fractional(kind: DataType) -> bool:
    return kind.typeName() in ("float", "double")


def is_orderable(kind: DataType) -> bool:
    """Whether reports compare and count values of this type; nested types are left out."""
    return not isinstance(kind, (ArrayType, MapType, StructType, VariantType)) and kind.typeName() not in ("vector", "udt")


def require_frame(df: DataFrame, name: str = "df") -> None:
    if df is None:
        raise ValueError(f"{name} must not be None")


def column_names(columns: str | Iterable[str] | None) -> list[str]:
    return [] if columns is None else [columns] if isinstance(columns, str) else list(columns)


def require_columns(df: DataFrame, columns: str | Iterable[str]) -> list[str]:
    wanted = column_names(columns)
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"{missing} not found in DataFrame; it has {df.columns}")
    return wanted


def require_choice(value: str, choices: Sequence[str], what: str) -> str:
    if value not in choices:
        raise ValueError(f"{what} must be one of {list(choices)}, not {value!r}")
    return value


def numeric_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    """The numeric columns of ``df``, or those of ``columns`` that are numeric."""
    if columns is not None:
        require_columns(df, columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in (df.columns if columns is None else columns) if is_numeric(kinds[c])]


def without_nan(df: DataFrame, name: str) -> Column:
    """The column with NaN as null, for statistics that one NaN would spoil."""
    c = named(name)
    return F.when(~F.isnan(c), c) if is_fractional(df.schema[name].dataType) else c


def unpivoted(df: DataFrame, per_column: dict[str, dict[str, Column]], common: dict[str, Column]) -> DataFrame:
    """A report with a row for each column of ``df``, from ONE aggregate and no collect.

    ``per_column`` maps a column name to named aggregates, of the same names and types for all;
    ``common`` are aggregates that every row repeats. The result adds ``_at``, the column's place.
    """
    aggregates = [c.alias(f"_c_{k}") for k, c in common.items()]
    for i, metrics in enumerate(per_column.values()):
        aggregates += [c.alias(f"_{i}_{k}") for k, c in metrics.items()]
    one = df.agg(*aggregates)
    rows = [F.struct(F.lit(name).alias("column_name"), F.lit(i).alias("_at"), *(F.col(f"_{i}_{k}").alias(k) for k in metrics)) for i, (name, metrics) in enumerate(per_column.items())]
    return one.select(*(F.col(f"_c_{k}").alias(k) for k in common), F.inline(F.array(*rows)))
