"""Which operators hold on unbounded input, and running them there.

These are projections and filters without state: on a streaming DataFrame they give, batch by batch,
what they give on the whole. ``streamed`` runs any of them from a folder of files to a sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import calendar, cleansing, display, features

STATELESS: dict[str, Callable] = {
    f.__name__: f
    for f in (
        cleansing.clean_column_names, cleansing.fill_nulls_by_type, cleansing.standardize_strings, cleansing.enforce_types,
        cleansing.flag_invalid_rows, cleansing.split_valid_invalid, cleansing.normalize_values, calendar.parse_dates,
        calendar.add_date_parts, calendar.add_time_parts, calendar.date_diff_columns, calendar.add_business_days,
        calendar.is_business_day, calendar.add_fiscal_year, calendar.add_age, calendar.add_time_since, calendar.bucket_time_of_day,
        display.format_number_columns, display.format_pct_columns, features.add_date_features, features.add_interaction_features,
        features.add_ratio_features, features.add_missing_indicators,
    )
}


def streamed(spark: SparkSession, folder: str, schema: StructType, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, file_format: str = "parquet") -> StreamingQuery:
    """Runs ``work`` over the files of a folder as they come, into Parquet, each file once; ends when all are read."""
    rows = work(spark.readStream.schema(schema).format(file_format).load(folder))
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
