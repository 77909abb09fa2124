"""The logical tables (requests, events, store-id mapping) read off an order schema: orders are ad requests, order lines
are app events, parts are store ids. Months play the part of days."""

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appconv.functions import known_ids
from appconv.names import COHORT, REQUEST_COLUMNS, UID

DOWNLOAD, CUSTOM, PURCHASE = "N", "A", "R"
ALL_KINDS = (DOWNLOAD, CUSTOM, PURCHASE)


def _month(column: str) -> Column:
    return F.trunc(F.col(column).cast("date"), "MM").cast("string")


def _next_month(day: str) -> str:
    d = date.fromisoformat(day)
    return date(d.year + d.month // 12, d.month % 12 + 1, 1).isoformat()


class OrderTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def _table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def _orders(self, start: str | None, end: str | None) -> DataFrame:
        """Orders of the months ``start`` .. ``end``. The window is put on the stored column, where the Parquet reader
        can skip row groups by it."""
        orders = self._table("orders")
        kind = orders.schema["o_orderdate"].dataType.simpleString()
        if start:
            orders = orders.filter(F.col("o_orderdate") >= F.lit(start).cast(kind))
        if end:
            orders = orders.filter(F.col("o_orderdate") < F.lit(_next_month(end)).cast(kind))
        return orders

    def requests(self, start: str | None = None, end: str | None = None) -> DataFrame:
        # The other columns depend on the customer alone, so duplicates go before the joins.
        orders = (
            self._orders(start, end)
            .select(
                _month("o_orderdate").alias("request_date"),
                "o_custkey",
                F.col("o_orderpriority").alias("os_version_id"),
                F.col("o_orderstatus").alias("device_os_id"),
            )
            .distinct()
        )
        return self._of_customers(orders).select(*REQUEST_COLUMNS)

    def cohort_rows(self) -> DataFrame:
        """The cohort and user of all requests, without the columns that only make more of them; duplicates included."""
        orders = self._orders(None, None).select("o_custkey", F.col("o_orderstatus").alias("device_os_id")).distinct()
        return self._of_customers(orders).select(*COHORT, UID)

    def _of_customers(self, orders: DataFrame) -> DataFrame:
        customers = (
            self._table("customer")
            .join(self._table("nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                "c_custkey",
                F.when(F.col("c_custkey") % 20 == 0, "").otherwise(F.col("c_mktsegment")).alias("display_marketing_name"),
                F.col("c_nationkey").cast("string").alias("market_id"),
                F.col("n_regionkey").cast("string").alias("country_id"),
                F.when(F.col("c_acctbal") < 0, "3").otherwise("1").alias("device_type_id"),
            )
        )
        rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        return rows.withColumn("request_uid", F.col("o_custkey").cast("string"))

    def event_lines(
        self, kinds: Iterable[str] = ALL_KINDS, start: str | None = None, end: str | None = None
    ) -> DataFrame:
        """One row per event, duplicates included."""
        lines = (
            self._table("lineitem")
            .filter(F.col("l_returnflag").isin(list(kinds)))
            .select("l_orderkey", F.col("l_partkey").cast("string").alias("app_gpm_id"))
        )
        orders = self._orders(start, end).select(
            "o_orderkey",
            F.col("o_custkey").cast("string").alias("request_uid"),
            _month("o_orderdate").alias("request_date"),
        )
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            "request_uid", "app_gpm_id", "request_date"
        )

    def raw_app_map(self) -> DataFrame:
        return self._table("part").select(
            F.col("p_partkey").cast("string").alias("app_gpm_id"),
            F.when(F.col("p_size") == 50, "NULL").otherwise(F.concat_ws("/", "p_brand", "p_type")).alias("app_id"),
        )

    def app_map(self) -> DataFrame:
        return known_ids(self.raw_app_map(), "app_gpm_id", "app_id").distinct()
