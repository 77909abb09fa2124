"""App bags: the sorted set of items a user holds. A bag has at most one entry per item of the catalogue, however often
the user shows up in the logs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appconv.names import APP, BAG, REQUEST_COLUMNS, UID
from appconv.operators.skew import HOT_ROWS, lookup
from appconv.sources.staging import cut_lineage


def app_bags(df: DataFrame, item: str = APP, uid: str = UID) -> DataFrame:
    """One sorted bag per user; ``item`` may be another column, such as ``market_id``."""
    return df.select(uid, item).distinct().groupBy(uid).agg(F.sort_array(F.collect_list(item)).alias(BAG))


def requests_with_bags(
    requests: DataFrame, bags: DataFrame, how: str = "left", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Request tuples with the user's bag: ``left`` keeps users without a bag, ``inner`` drops them.

    A bag is unique per user, so distinct requests give a distinct result."""
    rows = cut_lineage(requests.select(*REQUEST_COLUMNS).distinct())
    return lookup(rows, bags, [UID], how, hot_rows).select(*REQUEST_COLUMNS, BAG)


def downloads_with_bags(downloads: DataFrame, bags: DataFrame, how: str = "left") -> DataFrame:
    """(Attributed) downloads with the user's bag."""
    return lookup(cut_lineage(downloads.distinct()), bags, [UID], how)


def bag_stats(bags: DataFrame) -> DataFrame:
    """Number of bags and their average size."""
    return bags.agg(F.count("*").alias("bags"), F.avg(F.size(BAG)).alias("avg_apps"))
