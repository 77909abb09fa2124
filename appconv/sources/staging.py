"""Hand-over points between jobs."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appconv.names import DATE
from appconv.session import checkpoint_dir


def stage(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write Parquet and continue from the files: the lineage ends there and file sizes become known to the planner."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_folder(spark: SparkSession) -> str:
    """A fresh name in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Stage under a fresh name in the shared checkpoint folder, so a lost executor costs no earlier step."""
    folder = checkpoint_dir(df.sparkSession).rstrip("/")
    return stage(df, f"{folder}/staged-{uuid.uuid4().hex}")


def stage_counted(df: DataFrame, path: str, counts: dict[str, Column], mode: str = "errorifexists") -> tuple[DataFrame, dict]:
    """Stage and take ``counts`` (aggregates over all rows), which read only their columns of the staged files. An observation
    would count while writing, but a session that has used one cannot run the transformers of Spark ML any more: they
    serialise the session, and its manager of observations cannot be."""
    written = stage(df, path, mode)
    return written, written.agg(*[c.alias(name) for name, c in counts.items()]).first().asDict()


def stage_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Stage in ``buckets`` files by ``key``, sorted by it. Tables with one number of buckets meet on the key, and are grouped by
    it, without a shuffle. A key is kept in one bucket, so this is for tables whose rows a key are bounded, such as
    distinct (user, app); adaptive execution cannot split a bucket."""
    name = f"staged_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def _by_day(df: DataFrame, path: str) -> None:
    # Ranges of (day, row), so that a day with most of the rows is written by several tasks and others by one.
    dealt = df.repartitionByRange(DATE, F.xxhash64(*[c for c in df.columns if c != DATE]))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE).parquet(path)


def read_days(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The days under ``path``, days being text; a filter on the day is answered by the names of the folders."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def stage_days(df: DataFrame, path: str) -> DataFrame:
    """Stage with a folder for each day."""
    _by_day(df, path)
    return read_days(df.sparkSession, path, df)


def redo_days(df: DataFrame, path: str, days: list[str]) -> DataFrame:
    """Replace ``days`` by their rows in ``df``; folders of other days are not touched. A day without rows becomes empty."""
    rows = df.filter(F.col(DATE).isin(days))
    found = {r[0] for r in rows.select(DATE).distinct().collect()}
    if found:
        _by_day(rows, path)
    for day in set(days) - found:
        rows.limit(0).drop(DATE).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{DATE}={day}")
    return read_days(df.sparkSession, path, df)


def preview(df: DataFrame, rows: int = 20, order: list[Column] | None = None) -> DataFrame:
    """A few rows; with ``order`` the first ones in it, of which each task sends no more than it shows."""
    return df.orderBy(*order).limit(rows) if order else df.limit(rows)
