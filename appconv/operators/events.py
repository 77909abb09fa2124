"""From event logs and requests to who owns, and who lately downloaded, which app.

Inputs are made distinct before each join rather than after it: a user or store id that fills a third of a log has few
distinct rows left when it reaches the shuffle, and a join of distinct inputs on these keys has a distinct result."""

from functools import reduce

from pyspark.sql import DataFrame

from appconv.functions import in_window
from appconv.names import APP, COHORT, DATE, REQUEST_COLUMNS, STORE_ID, UID


def union_events(*kinds: DataFrame, window: tuple[str, str] | None = None, repeats: bool = False) -> DataFrame:
    """Set union of event tables (download, custom, purchase), optionally within a closed window. With ``repeats`` they stay,
    for a next step that drops them anyway, such as ``owned_apps``."""
    events = reduce(DataFrame.unionByName, [k.select(UID, STORE_ID, DATE) for k in kinds])
    if window:
        events = in_window(events, DATE, *window)
    return events if repeats else events.distinct()


def map_store_ids(events: DataFrame, app_map: DataFrame) -> DataFrame:
    """Replace the store id by the app id; events without a mapping are dropped.

    No broadcast hint: the mapping grows with the app catalogue, and the planner broadcasts it by itself while its
    size allows that."""
    rest = [c for c in events.columns if c != STORE_ID]
    return events.join(app_map, STORE_ID).select(*rest, APP)


def owned_apps(events: DataFrame, app_map: DataFrame) -> DataFrame:
    """Distinct (user, app). Dates go first, so repeated use of an app never reaches the join."""
    return map_store_ids(events.select(UID, STORE_ID).distinct(), app_map).distinct()


def mapped_downloads(downloads: DataFrame, app_map: DataFrame, window: tuple[str, str] | None = None) -> DataFrame:
    """Distinct (user, app, date) downloads."""
    events = downloads.select(UID, STORE_ID, DATE)
    if window:
        events = in_window(events, DATE, *window)
    return map_store_ids(events.distinct(), app_map).select(UID, APP, DATE).distinct()


def attach_requests(apps: DataFrame, requests: DataFrame) -> DataFrame:
    """Every (user, app) with every request tuple of the user."""
    rest = [c for c in REQUEST_COLUMNS if c != UID]
    return apps.distinct().join(requests.select(*REQUEST_COLUMNS).distinct(), UID).select(UID, APP, *rest)


def ownership(owned: DataFrame, requests: DataFrame) -> DataFrame:
    return attach_requests(owned, requests)


def targets(
    downloads: DataFrame, app_map: DataFrame, requests: DataFrame, window: tuple[str, str] | None = None
) -> DataFrame:
    """Recent conversions: the apps downloaded within the window, with the users' request tuples."""
    events = in_window(downloads, DATE, *window) if window else downloads
    return attach_requests(owned_apps(events, app_map), requests)


def cohort_members(requests: DataFrame) -> DataFrame:
    """Distinct (cohort, user)."""
    return requests.select(*COHORT, UID).distinct()


def cohort_apps(owned: DataFrame, requests: DataFrame, distinct: bool = False) -> DataFrame:
    """Distinct (cohort, user, app): what the lift feed needs of ``ownership``, without building one row per request.
    ``distinct`` says that both inputs, of which the second then has the cohort members, are distinct already."""
    members, apps = (requests, owned) if distinct else (cohort_members(requests), owned.distinct())
    return members.join(apps, UID).select(*COHORT, UID, APP)


def attribute_downloads(downloads: DataFrame, requests: DataFrame, distinct: bool = False) -> DataFrame:
    """Downloads with the request tuples of the same user on the same day. ``distinct`` says that both inputs are already."""
    rest = [c for c in REQUEST_COLUMNS if c not in (UID, DATE)]
    left, right = downloads.select(DATE, UID, APP), requests.select(*REQUEST_COLUMNS)
    if not distinct:
        left, right = left.distinct(), right.distinct()
    return left.join(right, [DATE, UID]).select(DATE, UID, APP, *rest)
