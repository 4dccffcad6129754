"""Files on paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..plans.core import named, require_choice, require_frame

FORMATS = ("csv", "json", "parquet", "delta", "text")


def read_csv_with_schema(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    header: bool = True,
    delimiter: str = ",",
    infer_schema: bool = True,
    multiline: bool = False,
    null_values: str | Sequence[str] | None = None,
) -> DataFrame:
    """CSV with a given or inferred schema; any number of ``null_values`` read as null.

    One token is Spark's own option. Several are applied to the text before it is cast, with the
    types that the remaining values allow when the schema is inferred.
    """
    tokens = [null_values] if isinstance(null_values, str) else list(null_values or [])
    reader = spark.read.option("header", header).option("sep", delimiter).option("multiLine", multiline)
    if len(tokens) <= 1:
        if tokens:
            reader = reader.option("nullValue", tokens[0])
        return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", infer_schema).csv(path)
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    text = reader.schema(StructType([StructField(f.name, StringType()) for f in schema.fields])).csv(path) if schema is not None else reader.csv(path)
    text = text.select(*(F.when(~named(c).isin(tokens), named(c)).alias(c) for c in text.columns))
    if schema is None and infer_schema and text.columns:
        schema = _inferred(text)
    return text if schema is None else text.select(*(named(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields))


def _inferred(text: DataFrame) -> StructType:
    """For each column the first type that all its values can be cast to; one aggregate."""
    kinds = ("int", "bigint", "double", "boolean", "date", "timestamp")
    fails = [F.count_if(named(c).isNotNull() & named(c).try_cast(k).isNull()).alias(f"_{i}_{k}") for i, c in enumerate(text.columns) for k in kinds]
    some = [F.count(named(c)).alias(f"_{i}") for i, c in enumerate(text.columns)]
    row = text.agg(*fails, *some).first()
    return StructType.fromDDL(", ".join(f"`{c}` {next((k for k in kinds if row[f'_{i}'] and not row[f'_{i}_{k}']), 'string')}" for i, c in enumerate(text.columns)))


def read_files_from_volume(spark: SparkSession, volume_path: str, file_format: str = "csv", options: Mapping[str, str] | None = None) -> DataFrame:
    """Files of a format; without options CSV has a header and an inferred schema, and JSON is one record a line, as ``write_to_volume`` writes it."""
    require_choice(file_format.lower(), FORMATS, "file_format")
    defaults = {"csv": {"header": "true", "inferSchema": "true"}}
    return spark.read.format(file_format.lower()).options(**(options or defaults.get(file_format.lower(), {}))).load(volume_path)


def write_to_volume(df: DataFrame, volume_path: str, file_format: str = "parquet", mode: str = "overwrite", options: Mapping[str, str] | None = None) -> None:
    """Files of a format; without options CSV has a header."""
    require_frame(df)
    require_choice(file_format.lower(), FORMATS, "file_format")
    require_choice(mode, ("overwrite", "append"), "mode")
    defaults = {"csv": {"header": "true"}}
    df.write.format(file_format.lower()).mode(mode).options(**(options or defaults.get(file_format.lower(), {}))).save(volume_path)
