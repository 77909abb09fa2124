"""Request, event and mapping tables from CSV, Parquet and ORC files."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from appconv.functions import day_list, in_window, known_ids
from appconv.names import APP, APP_MAP_SCHEMA, DATE, REQUEST_COLUMNS, REQUEST_LOG_SCHEMA, STORE_ID, UID
from appconv.sources.logs import read_quoted_log

# Where the three needed columns stand in the wide ORC event table.
ORC_ORDINALS = (6, 10, 14)
ORC_NAMES = ("request_uid", "request_date", "app_id")


def read_app_map(spark: SparkSession, path: str) -> DataFrame:
    """Headerless store-id mapping; rows with a missing id on either side are dropped."""
    rows = spark.read.csv(path, schema=APP_MAP_SCHEMA)
    return known_ids(rows, STORE_ID, APP).distinct()


def read_request_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_quoted_log(spark, path, REQUEST_LOG_SCHEMA).select(*REQUEST_COLUMNS)


def read_request_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headerless request files; ``path`` may be a glob over part files."""
    return spark.read.csv(path, schema=REQUEST_LOG_SCHEMA).select(*REQUEST_COLUMNS)


def read_requests(spark: SparkSession, base: str, end: str, days: int) -> DataFrame:
    """The request tuples of ``days`` day folders ending on ``end``, as one scan over all folders."""
    paths = [f"{base.rstrip('/')}/{day}" for day in day_list(end, days)]
    return spark.read.parquet(*paths).select(*REQUEST_COLUMNS).distinct()


def read_orc_events(
    spark: SparkSession,
    base: str,
    end: str,
    days: int,
    ordinals: Sequence[int] = ORC_ORDINALS,
    names: Sequence[str] = ORC_NAMES,
) -> DataFrame:
    """Columns taken by position from the ORC folders ``load_time=yyyy/MM/dd*`` of ``days`` days. Only the chosen
    columns are read from the files."""
    globs = [f"{base.rstrip('/')}/load_time={day}*" for day in day_list(end, days, "%Y/%m/%d")]
    rows = spark.read.orc(globs)
    return rows.select(*[F.col(f"`{rows.columns[i]}`").alias(n) for i, n in zip(ordinals, names)]).distinct()


def event_days(events: DataFrame, start: str, end: str) -> DataFrame:
    """Timestamps become ISO day text, restricted to a closed window; events of one day fall together."""
    days = events.select(UID, APP, F.to_date(DATE).cast("string").alias(DATE))
    return in_window(days, DATE, start, end)
