"""Features for models: encodings, scales, bins, series, imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, MaxAbsScaler, MinMaxScaler, OneHotEncoder, QuantileDiscretizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..plans.core import column_names, is_numeric, named, numeric_columns, require_choice, require_columns, require_frame, without_nan

ACCURACY = 200_000
#: The features of a date and of a moment, and those made by default.
DATE_FEATURES = {
    **{k: dates.DATE_PARTS[k] for k in ("year", "month", "day", "day_of_week", "quarter")},
    "is_weekend": lambda c: F.dayofweek(c).isin(1, 7).cast("int"),
    "hour": F.hour,
    "minute": F.minute,
    "week_of_year": F.weekofyear,
}
DEFAULT_DATE_FEATURES = ["year", "month", "day", "day_of_week", "quarter", "is_weekend"]
ROLLING = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "stddev": F.stddev}


def encode_categoricals(df: DataFrame, columns: Sequence[str], method: str = "index", handle_invalid: str = "keep") -> tuple[DataFrame, list]:
    """``{c}_indexed`` by falling frequency (ties by value), and ``{c}_onehot`` if asked; with the fitted stages.

    All columns are fitted in one pass. "keep" gives null and unseen values the next free index.
    """
    require_frame(df)
    wanted = require_columns(df, columns)
    require_choice(method, ("index", "onehot"), "method")
    require_choice(handle_invalid, ("keep", "skip", "error"), "handle_invalid")
    if not wanted:
        return df, []
    indexed = [f"{c}_indexed" for c in wanted]
    index = StringIndexer(inputCols=wanted, outputCols=indexed, handleInvalid=handle_invalid, stringOrderType="frequencyDesc").fit(df)
    df = index.transform(df)
    if method == "index":
        return df, [index]
    hot = OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_onehot" for c in wanted], handleInvalid="keep" if handle_invalid == "keep" else "error").fit(df)
    return hot.transform(df), [index, hot]


def scale_features(df: DataFrame, input_col: str, output_col: str = "scaled_features", method: str = "standard") -> tuple[DataFrame, object]:
    """A vector column scaled to zero mean and unit deviation, to [0, 1] or by its largest magnitude; with the model."""
    require_frame(df)
    require_columns(df, input_col)
    require_choice(method, ("standard", "minmax", "maxabs"), "method")
    names = {"inputCol": input_col, "outputCol": output_col}
    scaler = StandardScaler(withMean=True, withStd=True, **names) if method == "standard" else MinMaxScaler(**names) if method == "minmax" else MaxAbsScaler(**names)
    model = scaler.fit(df)
    return model.transform(df), model


def assemble_features(df: DataFrame, input_cols: Sequence[str], output_col: str = "features", handle_invalid: str = "skip") -> DataFrame:
    """The columns as one vector; rows with null or NaN are dropped ("skip"), kept as NaN ("keep") or fail ("error")."""
    require_frame(df)
    return VectorAssembler(inputCols=require_columns(df, input_cols), outputCol=output_col, handleInvalid=handle_invalid).transform(df)


def create_bins(df: DataFrame, column: str, method: str = "quantile", n_bins: int = 4, custom_splits: Sequence[float] | None = None, output_col: str | None = None) -> DataFrame:
    """The bin of each value as a double; null and NaN are a bin of their own after the last."""
    require_frame(df)
    require_columns(df, column)
    require_choice(method, ("quantile", "custom"), "method")
    name = output_col or f"{column}_binned"
    if method == "custom":
        if not custom_splits:
            raise ValueError("custom_splits must be provided for method 'custom'")
        return Bucketizer(splits=list(custom_splits), inputCol=column, outputCol=name, handleInvalid="keep").transform(df)
    return QuantileDiscretizer(numBuckets=n_bins, inputCol=column, outputCol=name, relativeError=1e-4, handleInvalid="keep").fit(df).transform(df)


def add_date_features(df: DataFrame, date_col: str, features: Sequence[str] | None = None) -> DataFrame:
    """``{date_col}_{feature}`` for each feature; ``is_weekend`` is 0 or 1."""
    require_frame(df)
    require_columns(df, date_col)
    wanted = list(features or DEFAULT_DATE_FEATURES)
    if bad := [f for f in wanted if f not in DATE_FEATURES]:
        raise ValueError(f"Unknown feature: {bad}; known are {list(DATE_FEATURES)}")
    return df.withColumns({f"{date_col}_{f}": DATE_FEATURES[f](named(date_col)) for f in wanted})


def _series(partition_by: str | Sequence[str], order_by: str | Sequence[str]):
    return Window.partitionBy(*map(named, column_names(partition_by))).orderBy(*map(named, column_names(order_by)))


def add_lag_features(df: DataFrame, column: str, partition_by: str | Sequence[str], order_by: str | Sequence[str], lags: Sequence[int] = (1, 7, 30)) -> DataFrame:
    """``{column}_lag_{n}``: the value n rows before; one sort for all lags."""
    require_frame(df)
    require_columns(df, [column, *column_names(partition_by), *column_names(order_by)])
    series = _series(partition_by, order_by)
    return df.withColumns({f"{column}_lag_{n}": F.lag(named(column), n).over(series) for n in lags})


def add_rolling_features(
    df: DataFrame,
    column: str,
    partition_by: str | Sequence[str],
    order_by: str | Sequence[str],
    windows: Sequence[int] = (7, 30),
    funcs: Sequence[str] = ("avg", "min", "max"),
) -> DataFrame:
    """``{column}_rolling_{f}_{n}`` over the last n rows, this one included."""
    require_frame(df)
    require_columns(df, [column, *column_names(partition_by), *column_names(order_by)])
    if bad := [f for f in funcs if f not in ROLLING]:
        raise ValueError(f"Unknown function: {bad}; known are {list(ROLLING)}")
    series = _series(partition_by, order_by)
    return df.withColumns({f"{column}_rolling_{f}_{n}": ROLLING[f](named(column)).over(series.rowsBetween(-(n - 1), 0)) for n in windows for f in funcs})


def add_interaction_features(df: DataFrame, column_pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``{a}_x_{b}``: the product."""
    require_frame(df)
    require_columns(df, [c for pair in column_pairs for c in pair])
    return df.withColumns({f"{a}_x_{b}": named(a) * named(b) for a, b in column_pairs}) if column_pairs else df


def add_ratio_features(df: DataFrame, ratios: Sequence[tuple[str, str]] | Sequence[tuple[str, str, str]]) -> DataFrame:
    """The quotient as ``{numerator}_per_{denominator}``, or under a third name; null where the denominator is 0 or null."""
    require_frame(df)
    require_columns(df, [c for r in ratios for c in r[:2]])
    names = [r[2] if len(r) > 2 else f"{r[0]}_per_{r[1]}" for r in ratios]
    return df.withColumns({k: F.try_divide(named(r[0]).cast("double"), named(r[1]).cast("double")) for k, r in zip(names, ratios, strict=True)}) if ratios else df


def add_missing_indicators(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``{c}_missing``, 0 or 1; by default for the columns that have a null, which one aggregate finds."""
    require_frame(df)
    if columns is None:
        found = df.agg(F.lit(1).alias("_"), *(F.count_if(named(c).isNull()).alias(f"_{i}") for i, c in enumerate(df.columns))).first()
        wanted = [c for i, c in enumerate(df.columns) if found[f"_{i}"]]
    else:
        wanted = require_columns(df, columns)
    return df.withColumns({f"{c}_missing": named(c).isNull().cast("int") for c in wanted}) if wanted else df


def _typical(strategy: str, x: Column) -> Column:
    if strategy == "mean":
        return F.mean(x.cast("double"))
    return F.percentile_approx(x, 0.5, ACCURACY) if strategy == "median" else F.mode(x, True)


def impute_columns(
    df: DataFrame,
    strategy: str = "median",
    columns: Sequence[str] | None = None,
    group_by: str | Sequence[str] | None = None,
) -> tuple[DataFrame, dict]:
    """Nulls replaced by the column's median, mean or most frequent value, of the whole table or of the row's group.

    Returns the values used as well (a description, for groups). One aggregate fits all columns.
    A column becomes double where its fill is a fraction; NaN is not null and takes no part in the
    statistics. Groups are joined with their aggregate: nothing is gathered by group.
    """
    require_frame(df)
    require_choice(strategy, ("mean", "median", "mode"), "strategy")
    wanted = require_columns(df, columns) if columns is not None else [c for c in numeric_columns(df) if c not in column_names(group_by)]
    if columns is not None and strategy != "mode":
        wanted = numeric_columns(df, wanted)
    if not wanted:
        return df, {}
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def filled(c: str, fill: Column, fraction: bool) -> Column:
        return F.coalesce(named(c).cast("double") if fraction else named(c), fill if fraction else fill.cast(kinds[c])).alias(c)

    fits = [_typical(strategy, without_nan(df, c)).alias(f"__fill_{i}") for i, c in enumerate(wanted)]
    fraction = strategy == "mean"
    if group_by is not None:
        keys = require_columns(df, group_by)
        groups = df.groupBy(*(named(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(*fits)
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & named(k).eqNullSafe(F.col(f"__k{i}"))
        rows = df.join(groups, same, "left")
        out = rows.select(*(filled(c, F.col(f"__fill_{wanted.index(c)}"), fraction) if c in wanted else named(c) for c in df.columns))
        return out, {c: f"group-wise {strategy} by {keys}" for c in wanted}
    values = df.agg(*fits).first()
    fills = {c: values[f"__fill_{i}"] for i, c in enumerate(wanted)}
    known = {c: v for c, v in fills.items() if v is not None}
    out = df.select(*(filled(c, F.lit(known[c]), fraction and not float(known[c]).is_integer() or fraction and not is_numeric(kinds[c])) if c in known else named(c) for c in df.columns))
    return out, fills


def prepare_features(
    df: DataFrame,
    numeric_cols: Sequence[str],
    categorical_cols: Sequence[str],
    label_col: str | None = None,
    impute_strategy: str = "median",
    scale_method: str = "standard",
) -> tuple[DataFrame, dict]:
    """Missing indicators, imputation, indexing, assembly and scaling in one go.

    Returns the table with ``features`` and ``scaled_features``, and the fitted parts under
    impute_values, indexer_stages, feature_cols, fitted_scaler and pipeline (a PipelineModel of the
    ML stages, for tables that are imputed already). Rows without a label go if ``label_col`` is given.
    """
    require_frame(df)
    require_columns(df, [*numeric_cols, *categorical_cols, *([label_col] if label_col else [])])
    if label_col:
        df = df.where(named(label_col).isNotNull())
    df = add_missing_indicators(df, [*numeric_cols, *categorical_cols])
    df, values = impute_columns(df, impute_strategy, list(numeric_cols)) if numeric_cols else (df, {})
    inputs = [*numeric_cols, *(f"{c}_indexed" for c in categorical_cols), *(f"{c}_missing" for c in [*numeric_cols, *categorical_cols])]
    names = {"inputCol": "features", "outputCol": "scaled_features"}
    require_choice(scale_method, ("standard", "minmax", "maxabs"), "method")
    scaler = {"standard": lambda: StandardScaler(withMean=True, withStd=True, **names), "minmax": lambda: MinMaxScaler(**names), "maxabs": lambda: MaxAbsScaler(**names)}[scale_method]()
    index = [StringIndexer(inputCols=list(categorical_cols), outputCols=[f"{c}_indexed" for c in categorical_cols], handleInvalid="keep")] if categorical_cols else []
    model: PipelineModel = Pipeline(stages=[*index, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="skip"), scaler]).fit(df)
    return model.transform(df), {"impute_values": values, "indexer_stages": model.stages[: len(index)], "feature_cols": inputs, "fitted_scaler": model.stages[-1], "pipeline": model}
