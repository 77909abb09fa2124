"""Places of rows in a total order, without one task that holds them all."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from appconv.sources.staging import cut_lineage


def ranked(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place from 0 on. Rows are dealt by ranges of ``order`` and numbered within each range; what
    precedes a range is a sum over the ranges, of which there are as many as shuffle partitions. The ranges are staged, as
    another run would sample other bounds."""
    dealt = cut_lineage(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("range", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return dealt.withColumn("within", within).join(starts, "range").withColumn(name, F.col("before") + F.col("within")).drop(
        "range", "within", "before"
    )
