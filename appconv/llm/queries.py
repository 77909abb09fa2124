"""The registered queries of this package and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from appconv.llm import (
    contamination,
    conversations,
    html_text,
    language,
    lines,
    merkle,
    mixing,
    near_copies,
    passages,
    quality,
    sharding,
    url_rules,
    warc,
)

_MODULES = [
    warc,
    url_rules,
    contamination,
    quality,
    lines,
    language,
    mixing,
    passages,
    html_text,
    near_copies,
    sharding,
    merkle,
    conversations,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
