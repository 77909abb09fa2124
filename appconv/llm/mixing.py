"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w with u from a hash of its id and w its quality weight; the documents of a source with
the smallest keys are a weighted sample without replacement. A source's words are taken in whole epochs as long as its target
allows, what is left is filled in key order, and the document in which the target is reached gives only the words still
missing. Rows are dealt by ranges of their keys, of about as many rows each whatever the weights are. Prefix sums are taken
over the ranges first and over documents only within the range where a target is reached, so a source with any share of the
rows is spread over all tasks.

Defined cases: a null or empty text has no words and takes none; a null source is one source, ranked last; a null id has a
key like any other id; rows that repeat an id have the same key and are ordered by size, and equal rows give equal rows.
A source without words has target 0. Other columns are ignored. An empty table gives no rows."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from appconv.llm.common import WORD, slices, staged, table
from appconv.llm.order import sorted_rows
from appconv.operators.ranking import ranked

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SYMBOLS = "#*$%&|<>"
LEAST_WEIGHT = 0.05
RANGE_ROWS = 50_000


def quality_weight() -> Column:
    """Share of characters that are not symbols."""
    symbols = F.length("text") - F.length(F.translate("text", SYMBOLS, ""))
    return F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(1.0 - symbols / F.greatest(F.length("text"), F.lit(1)), F.lit(1.0)))


def sampling_key(weight: Column) -> Column:
    """-ln(u) / weight, u from 52 bits of the id's MD5."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, size -> source, source_size, target: shares of the weights, none above its most epochs."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = ranked(totals, [F.col("source").isNull(), F.col("source")])
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS)).cast("int"))
    sources = staged(placed.select("source", "source_size", weight.alias("weight")))
    words, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    rate, capped = (SHARE * words / weights if weights else 0.0), 0
    while True:
        # The excess of sources at their cap is shared again, until no further source reaches its cap.
        above = MOST_EPOCHS * F.col("source_size") < rate * F.col("weight")
        now, held, open_weight = sources.agg(
            F.count_if(above),
            F.coalesce(F.sum(F.when(above, MOST_EPOCHS * F.col("source_size"))), F.lit(0)),
            F.sum(F.when(~above, F.col("weight"))),
        ).first()
        if now == capped or not open_weight:
            break
        rate, capped = (SHARE * words - held) / open_weight, now
    cap = (MOST_EPOCHS * F.col("source_size")).cast("double")
    return sources.select("source", "source_size", F.least(cap, rate * F.col("weight")).alias("target"))


def mix(documents: DataFrame, weight: Column | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """documents (doc_id, source, text) -> doc_id, source, size, source_size, target, taken."""
    weight = quality_weight() if weight is None else weight
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    docs = staged(documents.select("doc_id", "source", size.alias("size"), sampling_key(weight).alias("key")))
    docs = sorted_rows(docs, [F.col("key"), F.col("doc_id"), F.col("size")], slices(docs.count(), range_rows))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    targets = source_targets(docs).withColumn("epochs", epochs)
    targets = targets.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    sums = docs.groupBy("source", "range").agg(F.sum("size").alias("words"))
    end = F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    bounds = (
        sums.withColumn("end", end)
        .withColumn("start", F.col("end") - F.col("words"))
        .alias("b")
        .join(targets.alias("t"), F.expr("b.source <=> t.source"))
        .selectExpr("b.source", "range", "start", "end", "source_size", "target", "epochs", "rest")
    )
    rows = (
        docs.alias("d")
        .join(bounds.alias("b"), F.expr("d.range = b.range and d.source <=> b.source"))
        .selectExpr("doc_id", "d.source", "size", "at", "d.range", "start", "end", "source_size", "target", "epochs", "rest")
    )
    reached = (F.col("start") < F.col("rest")) & (F.col("rest") < F.col("end"))
    clear = rows.filter(~reached).withColumn("more", F.when(F.col("end") <= F.col("rest"), F.col("size")).otherwise(0))
    order = Window.partitionBy("source", "range").orderBy("at")
    upto = F.col("start") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    missing = F.col("rest") - (F.col("upto") - F.col("size"))
    split = (
        rows.filter(reached)
        .withColumn("upto", upto)
        .withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), missing)))
        .drop("upto")
    )
    taken = (F.col("epochs") * F.col("size") + F.col("more")).cast("long")
    return clear.unionByName(split).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


ORACLE = {
    "op7_mix_sources": r"""
        with recursive docs as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint + 0.5::double) / 4503599627370496::double)
                    / greatest(0.05::double, coalesce(1::double - (length(text) - length(translate(text, '#*$%&|<>', '')))::double
                        / greatest(length(text), 1), 1::double)) as key
            from documents
        ), sources as (
            select source, sum(size)::double as source_size,
                [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as weight
            from docs group by source
        ), rates as (
            select 0 as i, 0::bigint as capped, 1.5::double * sum(source_size) / sum(weight) as rate from sources
            union all
            select i + 1, count(*) filter (2 * source_size < rate * weight),
                (1.5::double * sum(source_size) - coalesce(sum(2 * source_size) filter (2 * source_size < rate * weight), 0))
                    / sum(weight) filter (2 * source_size >= rate * weight)
            from sources, rates group by i, capped, rate having count(*) filter (2 * source_size < rate * weight) > capped
        ), targets as (
            select source, source_size::bigint as source_size,
                least(2 * source_size, weight * (select arg_max(rate, i) from rates)) as target
            from sources
        ), placed as (
            select d.doc_id, d.size, t.source_size, t.target,
                case when t.source_size > 0 then round(t.target)::bigint // t.source_size else 0 end as epochs,
                sum(d.size) over (partition by d.source order by key, doc_id, d.size rows unbounded preceding) as upto
            from docs d join targets t on d.source is not distinct from t.source
        )
        select doc_id, size, source_size, target,
            (epochs * size + greatest(0, least(size, round(target)::bigint - epochs * source_size - (upto - size))))::bigint
                as taken
        from placed
    """
}
