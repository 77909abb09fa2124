"""Indexes of large categories as a table.

The indexer of Spark ML takes the labels of a category through the driver. App ids and vectors can be many, so here a category's
labels stay rows: they are counted, put in order by frequency, and joined back. The one-hot positions follow from the indexes
and the categories' widths, of which there is one number each."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from appconv.learning.features import index_names
from appconv.names import FEATURES
from appconv.operators.ranking import ranked
from appconv.sources.staging import cut_lineage


def label_dictionary(rows: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """feature, label, n, index: labels of each category by descending frequency, ties alphabetical; staged. A missing label
    is none. All categories are ranked as one, so a category with very many labels is spread over all tasks."""
    cells = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(c).alias("feature"), F.col(c).alias("label")) for k, c in enumerate(columns)])
    counts = rows.select(F.inline(cells)).filter("label is not null").groupBy("pos", "feature", "label").agg(F.count("*").alias("n"))
    placed = cut_lineage(ranked(counts, [F.col("pos"), F.col("n").desc(), F.col("label")]))
    starts = placed.groupBy("pos").agg(F.min("place").alias("start"))
    index = (F.col("place") - F.col("start")).cast("int").alias("index")
    return cut_lineage(placed.join(starts, "pos").select("pos", "feature", "label", "n", index))


def category_widths(dictionary: DataFrame) -> DataFrame:
    """pos, labels, start: of each category its labels and where its part of the assembled vector begins. The last label has no
    place of its own."""
    widths = dictionary.groupBy("pos").agg(F.count("*").alias("labels"))
    before = F.sum(F.col("labels") - 1).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return widths.select("pos", F.col("labels").cast("int").alias("labels"), F.coalesce(before, F.lit(0)).cast("int").alias("start"))


def with_indexes(rows: DataFrame, dictionary: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Add the index of each category; unknown and missing labels get NULL. The dictionary is staged and the rows come from
    a shuffle of their own, so that adaptive execution splits labels which most rows have."""
    for pos, (column, index) in enumerate(zip(columns, index_names(columns), strict=True)):
        own = dictionary.filter(F.col("pos") == pos).select(F.col("label").alias(column), F.col("index").alias(index))
        rows = rows.join(own, column, "left")
    return rows


def with_slots(rows: DataFrame, dictionary: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Add the width of the assembled vector and the places of its ones."""
    widths = category_widths(dictionary)
    number = lambda pos, name: widths.filter(F.col("pos") == pos).agg(F.max(name)).scalar()
    indexed = with_indexes(rows, dictionary, columns)
    ones = [
        F.when(F.col(index) < number(pos, "labels") - 1, F.col(index) + number(pos, "start"))
        for pos, index in enumerate(index_names(columns))
    ]
    width = widths.agg(F.sum(F.col("labels") - 1)).scalar().cast("int")
    return indexed.withColumns({"width": width, "ones": F.array_compact(F.array(*ones))})
