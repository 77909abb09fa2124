"""What several operators share: the tables, the word and letter rules of the queries, staging."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appconv.sources import cut_lineage

# White space that separates words, as a regular expression class and as bytes.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Lower-cases A-Z and leaves every other byte of UTF-8 as it is.
LOWER_BYTES = bytes.maketrans(_UPPER.encode(), _UPPER.lower().encode())


# What goes to a Python task at once ends at this size as well as at a number of rows, so that long texts do not add up.
BATCH_BYTES = 4 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def batches_by_bytes(spark: SparkSession) -> None:
    """Sets the session's bound on the bytes of a batch, unless it was set to something else than Spark's own."""
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    batches_by_bytes(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other letters kept."""
    return F.translate(text, _UPPER, _UPPER.lower())


def staged(df: DataFrame) -> DataFrame:
    """Written to and reread from the shared folder: computed once, and a lost executor costs no earlier step."""
    return cut_lineage(df)


def slices(rows: int, each: int) -> int:
    """Number of groups so that one holds about ``each`` rows."""
    return max(1, -(-rows // each))
