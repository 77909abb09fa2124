"""End-to-end jobs. Each stages the tables that several later steps read, under a folder of the caller's choice."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from appconv.functions import in_window
from appconv.learning.evaluate import binning_cells, compare_models, weighted_rmse
from appconv.learning.features import fill_missing, fit_features, temporal_split
from appconv.learning.training import MAX_ITER, fit_logistic, score
from appconv.names import DATE, FEATURES
from appconv.operators.compact import CompactFeed, compact_feed
from appconv.operators.encode import MIN_ROWS, Slots, popular_targets
from appconv.operators.events import cohort_apps, cohort_members, mapped_downloads, owned_apps, union_events
from appconv.operators.lift import MIN_USERS, feed_counts, feed_slots, lift_feed
from appconv.operators.rates import cvu_encoded, cvu_encoded_appfree
from appconv.operators.sliding import advance, day_state, owned_since
from appconv.sources.staging import stage, stage_counted


@dataclass
class Members:
    """Distinct (user, app) and (cohort, user, app) of owned apps, (cohort, user, app) of recent conversions."""

    owned: DataFrame
    own: DataFrame
    tgt: DataFrame


@dataclass
class Window:
    requests: DataFrame
    downloads: DataFrame
    popular: DataFrame


@dataclass
class Feed:
    """``feed`` is the table of all pairs, or the compact form of it."""

    owned: DataFrame
    feed: DataFrame | CompactFeed
    counts: dict | None = None

    def slots(self) -> Slots:
        return feed_slots(self.feed) if isinstance(self.feed, DataFrame) else self.feed


def stage_members(
    download: DataFrame,
    custom: DataFrame,
    purchase: DataFrame,
    app_map: DataFrame,
    requests: DataFrame,
    event_window: tuple[str, str],
    target_window: tuple[str, str],
    folder: str,
    mode: str = "errorifexists",
) -> Members:
    events = union_events(download, custom, purchase, window=event_window, repeats=True)
    owned = stage(owned_apps(events, app_map), f"{folder}/owned", mode)
    lately = owned_apps(in_window(download, DATE, *target_window), app_map)
    # Both sides meet the same cohort members, which are the requests without their repeats.
    members = stage(cohort_members(requests), f"{folder}/members", mode)
    own = stage(cohort_apps(owned, members, distinct=True), f"{folder}/ownership", mode)
    return Members(owned, own, stage(cohort_apps(lately, members, distinct=True), f"{folder}/target", mode))


def stage_window(
    requests: DataFrame,
    download: DataFrame,
    app_map: DataFrame,
    window: tuple[str, str],
    folder: str,
    min_rows: int = MIN_ROWS,
    mode: str = "errorifexists",
) -> Window:
    requests = stage(in_window(requests, DATE, *window).distinct(), f"{folder}/requests", mode)
    downloads = stage(mapped_downloads(download, app_map, window), f"{folder}/downloads", mode)
    return Window(requests, downloads, stage(popular_targets(downloads, min_rows), f"{folder}/popular", mode))


def build_feed(
    download: DataFrame,
    custom: DataFrame,
    purchase: DataFrame,
    app_map: DataFrame,
    requests: DataFrame,
    event_window: tuple[str, str],
    target_window: tuple[str, str],
    folder: str,
    min_users: int = MIN_USERS,
    mode: str = "errorifexists",
    compact: bool = False,
) -> Feed:
    """Event logs, store-id mapping and requests to the staged owned apps and lift feed, whose pairs are counted. With ``compact`` only co-owned pairs are kept, for catalogues whose pairs are too many to store."""
    apps = stage_members(download, custom, purchase, app_map, requests, event_window, target_window, folder, mode)
    if compact:
        return Feed(apps.owned, compact_feed(apps.own, apps.tgt, min_users, distinct=True).staged(f"{folder}/feed", mode))
    feed, counts = stage_counted(lift_feed(apps.own, apps.tgt, min_users, distinct=True), f"{folder}/feed", feed_counts(), mode)
    return Feed(apps.owned, feed, counts)


def slide_owned(
    state: DataFrame | None, events: DataFrame, app_map: DataFrame, window: tuple[str, str], folder: str, mode: str = "errorifexists"
) -> tuple[DataFrame, DataFrame]:
    """The window's owned apps and the state to go on from. ``events`` are those of the days that came since ``state``, or of the
    whole window where there is none; the days must come in order."""
    day = day_state(in_window(events, DATE, *window), app_map)
    state = stage(advance(state, day, window[0]) if state is not None else day, f"{folder}/state-{window[1]}", mode)
    return owned_since(state, window[0]), state


def build_cvu(
    requests: DataFrame,
    download: DataFrame,
    app_map: DataFrame,
    feed: Feed,
    window: tuple[str, str],
    folder: str,
    min_rows: int = MIN_ROWS,
    app_free: bool = False,
    mode: str = "errorifexists",
) -> DataFrame:
    """CVU by segment, target app and lift vector over a window of requests and downloads."""
    read = stage_window(requests, download, app_map, window, folder, min_rows, mode)
    table = cvu_encoded_appfree if app_free else cvu_encoded
    cvu = table(read.requests, feed.owned, read.downloads, read.popular, feed.slots(), distinct=True)
    return stage(cvu, f"{folder}/cvu", mode)


@dataclass
class Trained:
    features: object
    model: object
    train_scores: DataFrame
    test_scores: DataFrame
    train_rmse: DataFrame
    comparison: DataFrame


def train_and_compare(
    rows: DataFrame,
    train_window: tuple[str, str],
    test_day: str,
    fit_on: str = "train",
    max_iter: int = MAX_ITER,
    columns: list[str] = FEATURES,
    known_only: bool = False,
) -> Trained:
    """Weighted logistic regression against the binning baseline. ``rows`` should be a staged CVU table: the index fit,
    every pass of the optimiser's input and the evaluation read it. With ``known_only`` rows with a category that training has
    not seen get no score."""
    rows = fill_missing(rows)
    train, test = temporal_split(rows, train_window, test_day)
    features = fit_features(train, rows, fit_on, columns)
    model = fit_logistic(train, features, max_iter, columns)
    train_scores, test_scores = (score(part, features, model, known_only) for part in (train, test))
    return Trained(
        features,
        model,
        train_scores,
        test_scores,
        weighted_rmse(train_scores, "CVU", "logistic_prediction", "user_count"),
        compare_models(binning_cells(train, test, columns), test_scores, columns),
    )
