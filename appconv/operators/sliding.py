"""Owned apps over a window that moves on by days.

Recomputing a window of 56 days reads 56 days of events for each new day. Here (user, app) pairs carry the first and the last
day they were seen. Such states merge by minimum and maximum in any order, a new day is merged into the state of the day
before, and a window that ends with the state's last day holds the pairs last seen on or after its start. Pairs that were last
seen before the window are of no use to later windows and are left out, so the state stays as large as the window's result."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appconv.names import APP, DATE, STORE_ID, UID
from appconv.operators.events import map_store_ids

FIRST, LAST = "first_day", "last_day"


def day_state(events: DataFrame, app_map: DataFrame) -> DataFrame:
    """events (user, store id, day) -> user, app, first and last day."""
    # Store ids that repeat go before the join, two ids of one app after it.
    seen = events.groupBy(UID, STORE_ID).agg(F.min(DATE).alias(FIRST), F.max(DATE).alias(LAST))
    return merge(map_store_ids(seen, app_map).select(UID, APP, FIRST, LAST))


def merge(*states: DataFrame) -> DataFrame:
    rows = reduce(DataFrame.unionByName, states)
    return rows.groupBy(UID, APP).agg(F.min(FIRST).alias(FIRST), F.max(LAST).alias(LAST))


def advance(state: DataFrame, day: DataFrame, start: str) -> DataFrame:
    """The state with a later day's state merged in, without pairs that are older than the window's start."""
    return merge(state, day).filter(F.col(LAST) >= start)


def owned_since(state: DataFrame, start: str) -> DataFrame:
    """Distinct (user, app) of the window from ``start`` to the state's last day."""
    return state.filter(F.col(LAST) >= start).select(UID, APP)
