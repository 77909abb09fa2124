"""Column expressions. All are built-in Spark functions, so they stay inside generated code."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appconv.names import COHORT

# Bins are clipped to [-3, 5], which leaves nine slots 0..8.
SLOT_LOW = -3
SLOT_HIGH = 5
VECTOR_WIDTH = SLOT_HIGH - SLOT_LOW + 1


def in_window(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Closed window on ISO date text; a plain comparison, so it reaches the scan."""
    return df.filter(F.col(column).between(start, end))


def cohort_filter(
    df: DataFrame,
    countries: Iterable[str] | None = None,
    oses: Iterable[str] | None = None,
    types: Iterable[str] | None = None,
) -> DataFrame:
    """Keep the listed countries, operating systems and device types; ``None`` means no restriction."""
    for column, allowed in zip(COHORT, (countries, oses, types)):
        if allowed is not None:
            df = df.filter(F.col(column).isin(list(allowed)))
    return df


def known_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows where an id is missing, spelled either as SQL NULL or as the text ``NULL``."""
    for column in columns:
        df = df.filter(F.col(column) != "NULL")
    return df


def empty_to_na(column: str) -> Column:
    """``''`` becomes ``'NA'``; NULL stays NULL."""
    return F.when(F.col(column) == "", F.lit("NA")).otherwise(F.col(column))


def log_bin(x: Column) -> Column:
    """``floor(log2(x))`` as a long, NULL unless x is a positive number.

    The logarithm is a quotient of two rounded logarithms and can land on the wrong side of an exact power of two, so
    the bin is corrected by comparing x with the powers on both sides, which doubles hold exactly."""
    guess = F.floor(F.log2(x))
    power = F.pow(F.lit(2.0), guess)
    exact = F.when(x < power, guess - 1).when(x >= power * 2, guess + 1).otherwise(guess)
    return F.when((x > 0) & ~F.isnan(x), exact)


def clip_slot(bin_: Column, low: int = SLOT_LOW, high: int = SLOT_HIGH) -> Column:
    """Clip a bin to [low, high] and count slots from 0; NULL stays NULL."""
    value = bin_.cast("int")
    return F.when(value >= high, high).when(value <= low, low).otherwise(value) - F.lit(low)


def slot_bit(slot: Column) -> Column:
    """A slot as a one-bit integer; the nine slots of a vector are or-ed together in one int."""
    return F.call_function("shiftleft", F.lit(1), slot)


def _bits(mask: Column, width: int) -> list[Column]:
    return [F.getbit(mask, F.lit(i)).cast("int") for i in range(width)]


def mask_to_array(mask: Column, width: int = VECTOR_WIDTH) -> Column:
    return F.array(*_bits(mask, width))


def mask_to_text(mask: Column, width: int = VECTOR_WIDTH) -> Column:
    """The vector as text, e.g. ``Array(0, 0, 1, 0, 0, 0, 0, 0, 0)``."""
    cells = F.concat_ws(", ", *[bit.cast("string") for bit in _bits(mask, width)])
    return F.concat(F.lit("Array("), cells, F.lit(")"))
