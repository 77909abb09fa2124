"""Rows in a total order: sorted over ranges, with their numbers over all rows or within groups, and never in one task."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from appconv.llm.common import staged

# A task numbers its rows from its own number times 2 to this power.
_RANGE_BITS = 33


def sorted_rows(rows: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """``rows``, staged, with ``at``: larger for later rows, with gaps between ranges, whose number is ``range``. Rows that are
    equal in ``order`` are dealt by where they come from, so that they need not fit one task; the caller sees that only
    equal rows are."""
    names = [f"_order_{k}" for k in range(len(order))]
    keyed = rows.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)], F.monotonically_increasing_id().alias("_tie"))
    keys = [F.col(n).asc_nulls_first() for n in names] + [F.col("_tie")]
    dealt = keyed.repartitionByRange(*([ranges] if ranges else []), *keys).sortWithinPartitions(*keys).drop(*names, "_tie")
    at = F.monotonically_increasing_id()
    return staged(dealt.withColumn("at", at).withColumn("range", F.shiftright("at", _RANGE_BITS)))


def numbered(rows: DataFrame, name: str = "number") -> DataFrame:
    """Sorted rows with their number over all of them, from 0 on; ``at`` and ``range`` go."""
    sizes = rows.groupBy("range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("range", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(starts, "range").withColumn(name, F.col("at") - F.col("first") + F.col("before")).drop("at", "range", "first", "before")


def numbered_in_groups(rows: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Rows sorted by ``group`` first, with ``number`` within their group from 0 on, and ``tree`` and ``total``, the place of the
    group among all groups and its rows; and the groups themselves. A group may fill any share of the ranges: it is joined
    by range and group."""
    parts = staged(rows.groupBy("range", group).agg(F.count("*").alias("n"), F.min("at").alias("first")))
    sums = parts.groupBy(group).agg(F.sum("n").alias("total"), F.min("first").alias("start"))
    groups = staged(numbered(sorted_rows(sums, [F.col("start")]), "tree").drop("start"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    same = parts[group].eqNullSafe(groups[group])
    starts = parts.join(groups, same).select(
        "range", parts[group].alias("_group"), "first", "tree", "total", F.coalesce(before, F.lit(0)).alias("before")
    )
    found = rows.alias("r").join(starts.alias("s"), F.expr(f"r.range = s.range and r.`{group}` <=> s._group"))
    number = F.expr("r.at - s.first + s.before").alias("number")
    return found.select(*[f"r.`{c}`" for c in rows.columns if c not in ("at", "range")], "tree", "total", number), groups
