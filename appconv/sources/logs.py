"""Comma-separated log lines whose cells may be quoted. Every comma separates cells, also inside quotes, so the CSV
reader would split such lines differently."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: trimming removes every character up to and including the blank.
_BLANKS = "".join(map(chr, range(33)))


def _cell(cells: Column, position: int) -> Column:
    trimmed = F.trim(F.get(cells, F.lit(position)), F.lit(_BLANKS))
    return F.replace(trimmed, F.lit('"'), F.lit(""))


def parse_quoted_lines(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Split, trim, then remove all quotes. Short lines give NULL cells, extra cells are dropped."""
    cells = F.split(F.col(column), ",")
    return lines.select(*[_cell(cells, i).alias(name) for i, name in enumerate(schema.names)])


def read_quoted_log(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    return parse_quoted_lines(spark.read.text(path), schema)
