"""Cleaning a corpus: each stage works on what its predecessor kept, written as Parquet and reread."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from appconv.llm import contamination, language, lines, mixing, near_copies
from appconv.llm.common import staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the recurrent network has learned from them."""
    return language.accepted(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a later one holds; a document may be left without text, but stays."""
    return lines.drop_repeated(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words."""
    return near_copies.deduplicate(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which less than a twentieth of the words are passages of the benchmark."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
]

# The learned language model of the first stage has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    for _, stage in STAGES[-1:]:
        docs = stage(spark, docs, sf_dir)
    return docs
