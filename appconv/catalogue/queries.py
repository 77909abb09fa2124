"""One query per operator, over the whole tables of an order schema."""

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from appconv.catalogue import windows as W
from appconv.functions import cohort_filter, in_window, known_ids, mask_to_array
from appconv.learning import dictionary, evaluate, features, training
from appconv.names import (
    APP,
    BAG,
    BIN,
    BINNING,
    COHORT,
    DATE,
    EVENT_LOG_SCHEMA,
    FEATURES,
    REQUEST_LOG_SCHEMA,
    SEGMENT,
    STORE_ID,
    UID,
    VECTOR,
)
from appconv.operators import bags, compact, encode, events, lift, rates
from appconv.plans.jobs import Members, Window, slide_owned, stage_members, stage_window, train_and_compare
from appconv.functions import day_list
from appconv.sources.logs import read_quoted_log
from appconv.sources.tables import ORC_ORDINALS, event_days, read_app_map, read_orc_events, read_request_csv, read_request_log, read_requests
from appconv.sources.order_tables import ALL_KINDS, CUSTOM, DOWNLOAD, PURCHASE, OrderTables
from appconv.sources.staging import cut_lineage, preview, redo_days, run_folder, stage_bucketed, stage_counted, stage_days

Query = Callable[[SparkSession, str], DataFrame]


class Inputs:
    """The logical tables. Those that several steps of one query read are staged on first use, as the jobs in
    ``plans`` do; the others are lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.tables = OrderTables(spark, folder)

    def requests(self) -> DataFrame:
        return self.tables.requests()

    def members(self) -> DataFrame:
        return events.cohort_members(self.tables.cohort_rows())

    def window_requests(self) -> DataFrame:
        return self.tables.requests(W.TRAIN_START, W.TEST_DAY)

    def app_map(self) -> DataFrame:
        return self.tables.app_map()

    def owned(self) -> DataFrame:
        return events.owned_apps(self.tables.event_lines(ALL_KINDS, end=W.OWNED_END), self.app_map())

    def lately(self) -> DataFrame:
        lines = self.tables.event_lines((DOWNLOAD,), W.TARGET_START, W.TARGET_END)
        return events.owned_apps(lines, self.app_map())

    def downloads(self) -> DataFrame:
        lines = self.tables.event_lines((DOWNLOAD,), W.TRAIN_START, W.TEST_DAY)
        return events.mapped_downloads(lines, self.app_map())

    def own(self) -> DataFrame:
        return events.cohort_apps(self.owned(), self.members(), distinct=True)

    def tgt(self) -> DataFrame:
        return events.cohort_apps(self.lately(), self.members(), distinct=True)

    def bags(self) -> DataFrame:
        return bags.app_bags(self.owned())

    @cached_property
    def _folder(self) -> str:
        return run_folder(self.tables.spark)

    @cached_property
    def _members(self) -> Members:
        lines = [self.tables.event_lines((kind,), end=W.TARGET_END) for kind in (DOWNLOAD, CUSTOM, PURCHASE)]
        windows = ((W.FIRST_DAY, W.OWNED_END), (W.TARGET_START, W.TARGET_END))
        return stage_members(*lines, self.app_map(), self.tables.cohort_rows(), *windows, self._folder)

    @cached_property
    def _window(self) -> Window:
        days = (W.TRAIN_START, W.TEST_DAY)
        lines = self.tables.event_lines((DOWNLOAD,), *days)
        return stage_window(self.window_requests(), lines, self.app_map(), days, self._folder, W.MIN_ROWS)

    @property
    def staged_owned(self) -> DataFrame:
        return self._members.owned

    @property
    def staged_own(self) -> DataFrame:
        return self._members.own

    @property
    def staged_tgt(self) -> DataFrame:
        return self._members.tgt

    @property
    def staged_requests(self) -> DataFrame:
        return self._window.requests

    @property
    def staged_downloads(self) -> DataFrame:
        return self._window.downloads

    @property
    def staged_popular(self) -> DataFrame:
        return self._window.popular

    @cached_property
    def staged_feed(self) -> DataFrame:
        return cut_lineage(self.feed())

    @cached_property
    def model_rows(self) -> DataFrame:
        return features.fill_missing(cut_lineage(self.cvu(rates.cvu_encoded_appfree)))

    @cached_property
    def compact_feed(self) -> compact.CompactFeed:
        return compact.compact_feed(self.staged_own, self.staged_tgt, W.MIN_USERS, distinct=True)

    def feed(self, min_users: int = W.MIN_USERS) -> DataFrame:
        return lift.lift_feed(self.staged_own, self.staged_tgt, min_users, distinct=True)

    def slots(self) -> DataFrame:
        return lift.feed_slots(self.staged_feed)

    def cvu(self, table: Callable[..., DataFrame], slots: encode.Slots | None = None, **options) -> DataFrame:
        return table(
            self.staged_requests,
            self.staged_owned,
            self.staged_downloads,
            self.staged_popular,
            self.slots() if slots is None else slots,
            distinct=True,
            **options,
        )

    def split(self) -> tuple[DataFrame, DataFrame]:
        return features.temporal_split(self.model_rows, (W.TRAIN_START, W.TRAIN_END), W.TEST_DAY)


def _bag_text(df: DataFrame) -> DataFrame:
    return df.withColumn(BAG, F.array_join(BAG, ","))


# --- sources and events -------------------------------------------------------------------------------------------


def parse_event_log(i: Inputs) -> DataFrame:
    """Event lines of all kinds as they stand in a text log, with quotes and blanks, read back into cells."""
    lines = i.tables.event_lines(ALL_KINDS).select(
        F.format_string('"%s" , "%s",\t"%s" ', UID, STORE_ID, "request_date").alias("value")
    )
    lines.write.text(path := run_folder(i.tables.spark))
    return read_quoted_log(i.tables.spark, path, EVENT_LOG_SCHEMA)


def _request_cells(i: Inputs) -> DataFrame:
    """All requests with the nine columns of a request file."""
    rows = i.requests().withColumn("constant", F.lit("1"))
    return rows.select(*REQUEST_LOG_SCHEMA.names)


def request_log(i: Inputs) -> DataFrame:
    cells = [F.concat(F.lit('"'), c, F.lit('" ')) for c in REQUEST_LOG_SCHEMA.names]
    _request_cells(i).select(F.concat_ws(", ", *cells).alias("value")).write.text(path := run_folder(i.tables.spark))
    return read_request_log(i.tables.spark, path)


def request_csv(i: Inputs) -> DataFrame:
    _request_cells(i).write.csv(path := run_folder(i.tables.spark))
    return read_request_csv(i.tables.spark, f"{path}/part-*")


def app_map_csv(i: Inputs) -> DataFrame:
    i.tables.raw_app_map().select(STORE_ID, APP).write.csv(path := run_folder(i.tables.spark))
    return read_app_map(i.tables.spark, path)


def _days(months: DataFrame) -> DataFrame:
    """The months of the window as the first days of one month, as folders are kept by day."""
    return months.withColumn(DATE, F.concat(F.lit("2000-01-"), F.substring(DATE, 6, 2)))


_WINDOW_DAYS = 8


def requests_by_day(i: Inputs) -> DataFrame:
    """A Parquet folder for each day of the window, read as one table."""
    rows, path = cut_lineage(_days(i.window_requests())), run_folder(i.tables.spark)
    for day in day_list("2000-01-08", _WINDOW_DAYS):
        rows.filter(F.col(DATE) == day).write.parquet(f"{path}/{day}")
    return read_requests(i.tables.spark, path, "2000-01-08", _WINDOW_DAYS)


def requests_redone_day(i: Inputs) -> DataFrame:
    """All days staged while one was still coming in, with half of its rows and some of the day before; then that day alone is
    written again."""
    rows, path = cut_lineage(i.window_requests()), run_folder(i.tables.spark)
    late = F.col(DATE) == W.LATE_DAY
    early = rows.filter(~late).unionByName(rows.filter(late & (F.xxhash64(UID) % 2 == 0)))
    wrong = rows.filter(F.col(DATE) == W.TRAIN_START).withColumn(DATE, F.lit(W.LATE_DAY))
    stage_days(early.unionByName(wrong), path)
    return redo_days(rows, path, [W.LATE_DAY])


def orc_events(i: Inputs) -> DataFrame:
    """A wide ORC table in a folder for each day, columns taken by position, timestamps cut to days."""
    lines = _days(i.tables.event_lines((DOWNLOAD,), W.TRAIN_START, W.TEST_DAY))
    known = {ORC_ORDINALS[0]: F.col(UID), ORC_ORDINALS[1]: F.to_timestamp(DATE), ORC_ORDINALS[2]: F.col(STORE_ID)}
    wide = [known.get(n, F.lit(n)).alias(f"c{n}") for n in range(max(ORC_ORDINALS) + 1)]
    rows, path = cut_lineage(lines.select(*wide, DATE)), run_folder(i.tables.spark)
    for day in day_list("2000-01-08", _WINDOW_DAYS):
        rows.filter(F.col(DATE) == day).drop(DATE).write.orc(f"{path}/load_time={day.replace('-', '/')}")
    return event_days(read_orc_events(i.tables.spark, path, "2000-01-08", _WINDOW_DAYS), "2000-01-01", "2000-01-08")


def app_map(i: Inputs) -> DataFrame:
    return known_ids(i.tables.raw_app_map(), STORE_ID, APP).distinct()


def requests(i: Inputs) -> DataFrame:
    return i.requests()


def event_window(i: Inputs) -> DataFrame:
    return in_window(i.tables.event_lines((DOWNLOAD,)), "request_date", W.TARGET_START, W.TARGET_END)


def cohort_filtered(i: Inputs) -> DataFrame:
    return cohort_filter(i.requests(), countries=("1",), oses=("O", "F"), types=("1", "3"))


def union_events(i: Inputs) -> DataFrame:
    kinds = [i.tables.event_lines((kind,), end=W.OWNED_END) for kind in (DOWNLOAD, CUSTOM, PURCHASE)]
    return events.union_events(*kinds)


def map_store_ids(i: Inputs) -> DataFrame:
    return events.map_store_ids(i.tables.event_lines(ALL_KINDS, end=W.OWNED_END), i.app_map())


def owned_apps(i: Inputs) -> DataFrame:
    return i.owned()


def owned_apps_sliding(i: Inputs) -> DataFrame:
    """The owned apps of windows that move on by a month, each from the state before and one month of events."""
    found, state, path = [], None, run_folder(i.tables.spark)
    for start, end in W.SLIDING:
        new = i.tables.event_lines(ALL_KINDS, end if state else start, end)
        owned, state = slide_owned(state, new, i.app_map(), (start, end), path)
        found.append(owned.withColumn("window_end", F.lit(end)))
    return found[0].unionByName(found[1]).unionByName(found[2])


def ownership(i: Inputs) -> DataFrame:
    return events.ownership(i.owned(), i.requests())


def targets(i: Inputs) -> DataFrame:
    lines = i.tables.event_lines((DOWNLOAD,))
    return events.targets(lines, i.app_map(), i.requests(), (W.TARGET_START, W.TARGET_END))


def cohort_apps(i: Inputs) -> DataFrame:
    return i.own()


_BUCKETS = 8


def _bucketed(i: Inputs, rows: DataFrame) -> DataFrame:
    return stage_bucketed(rows, run_folder(i.tables.spark), UID, _BUCKETS)


def cohort_apps_bucketed(i: Inputs) -> DataFrame:
    """Owned apps and cohort members in buckets by user: they meet without a shuffle."""
    members = events.cohort_members(i.requests())
    return events.cohort_apps(_bucketed(i, i.owned()), _bucketed(i, members), distinct=True)


def attribute_downloads(i: Inputs) -> DataFrame:
    return events.attribute_downloads(i.downloads(), i.window_requests())


# --- bags ---------------------------------------------------------------------------------------------------------


def app_bags(i: Inputs) -> DataFrame:
    return _bag_text(i.bags())


def market_bags(i: Inputs) -> DataFrame:
    markets = i.requests().select(UID, "market_id").distinct()
    return _bag_text(bags.app_bags(markets.join(i.owned().select(UID).distinct(), UID, "left_semi"), item="market_id"))


def requests_with_bags(i: Inputs) -> DataFrame:
    return _bag_text(bags.requests_with_bags(i.window_requests(), i.bags()))


def requests_with_bags_bucketed(i: Inputs) -> DataFrame:
    """Bags grouped, and requests joined with them, without a shuffle of either."""
    own, requests = _bucketed(i, i.owned()), _bucketed(i, i.window_requests().distinct())
    own_bags = own.groupBy(UID).agg(F.sort_array(F.collect_list(APP)).alias(BAG))
    return _bag_text(requests.join(own_bags, UID, "left").select(*requests.columns, BAG))


def requests_of_owners(i: Inputs) -> DataFrame:
    return _bag_text(bags.requests_with_bags(i.window_requests(), i.bags(), how="inner"))


def downloads_with_bags(i: Inputs) -> DataFrame:
    return _bag_text(bags.downloads_with_bags(events.attribute_downloads(i.downloads(), i.window_requests()), i.bags()))


def bag_stats(i: Inputs) -> DataFrame:
    return bags.bag_stats(i.bags()).withColumn("avg_apps", F.round("avg_apps", 6))


# --- lift ---------------------------------------------------------------------------------------------------------


def cohort_counts(i: Inputs) -> DataFrame:
    return lift.cohort_rows(i.owned(), i.requests())


def cohort_reach(i: Inputs) -> DataFrame:
    return lift.cohort_reach(i.own())


def app_users(i: Inputs) -> DataFrame:
    return lift.app_users(i.own(), distinct=True)


def target_users(i: Inputs) -> DataFrame:
    return lift.target_users(i.tgt(), distinct=True)


def eligible_pairs(i: Inputs) -> DataFrame:
    return lift.eligible_pairs(i.own(), i.tgt(), W.MIN_USERS, distinct=True)


def co_users(i: Inputs) -> DataFrame:
    return lift.co_users(i.staged_own, i.staged_tgt, W.MIN_USERS, distinct=True)


def pair_counts(i: Inputs) -> DataFrame:
    return lift.pair_counts(i.staged_own, i.staged_tgt, W.MIN_USERS, distinct=True)


def pair_lift(i: Inputs) -> DataFrame:
    """Before the fill: NULL where there is no lift or no bin."""
    feed = lift.lift_feed(i.staged_own, i.staged_tgt, W.MIN_USERS, missing=None, distinct=True)
    return feed.select(*COHORT, "app_a0", "app_a1", "nCVU", BIN)


def lift_feed(i: Inputs) -> DataFrame:
    return i.feed()


def lift_feed_legacy(i: Inputs) -> DataFrame:
    """Targets that no partner shares users with are put into bin 0."""
    return lift.lift_feed(i.staged_own, i.staged_tgt, W.MIN_USERS, legacy_nan=True, distinct=True)


def feed_slots(i: Inputs) -> DataFrame:
    return lift.feed_slots(i.feed()).select(*COHORT, "app_a0", "app_a1", BIN)


def lift_stats(i: Inputs) -> DataFrame:
    return lift.lift_stats(i.own(), i.tgt(), W.MIN_USERS, distinct=True)


def feed_preview(i: Inputs) -> DataFrame:
    """The pairs with the strongest lift."""
    order = [F.col("nCVU").desc(), F.col("A1A0users").desc(), *[F.col(c) for c in (*COHORT, "app_a0", "app_a1")]]
    return preview(i.staged_feed, 20, order)


def feed_counts(i: Inputs) -> DataFrame:
    """Counts of the feed, taken from its staged files."""
    counts = lift.feed_counts()
    _, seen = stage_counted(i.feed(), run_folder(i.tables.spark), counts)
    return i.tables.spark.range(1).select(*[F.lit(seen[c]).cast("long").alias(c) for c in counts])


def lift_feed_compact(i: Inputs) -> DataFrame:
    """Co-owned pairs and one default slot for each target of a cohort, which has no owned app."""
    return i.compact_feed.rows()


def lift_feed_unfolded(i: Inputs) -> DataFrame:
    """The whole feed out of the compact one."""
    return i.compact_feed.full()


# --- encode -------------------------------------------------------------------------------------------------------


def popular_targets(i: Inputs) -> DataFrame:
    return encode.popular_targets(i.downloads(), W.MIN_ROWS)


def target_hits_shuffled(i: Inputs) -> DataFrame:
    """As for a packed feed that is too large to broadcast."""
    return target_hits(i, broadcast_bytes=0)


def _window_members(i: Inputs) -> DataFrame:
    return encode.members_by_user(i.staged_owned, events.cohort_members(i.staged_requests))


def target_hits(i: Inputs, slots: encode.Slots | None = None, **options) -> DataFrame:
    members = _window_members(i)
    hits = encode.target_hits(members, i.staged_popular, i.slots() if slots is None else slots, laid_out=True, **options)
    digits = F.array_join(mask_to_array(F.col("mask")).cast("array<string>"), "")
    return hits.select(*COHORT, UID, "app_a0", digits.alias("slots"))


def target_hits_compact(i: Inputs) -> DataFrame:
    """The encoder on the compact feed."""
    return target_hits(i, i.compact_feed)


def encode_own_target(i: Inputs) -> DataFrame:
    attributed = cut_lineage(events.attribute_downloads(i.downloads(), i.window_requests()))
    return encode.encode_own_target(attributed, i.slots(), i.staged_owned, distinct=True)


def encode_all_targets(i: Inputs) -> DataFrame:
    members = _window_members(i)
    return encode.encode_all_targets(i.staged_requests, i.staged_popular, i.slots(), members)


# --- rates --------------------------------------------------------------------------------------------------------


def count_users(i: Inputs) -> DataFrame:
    return rates.count_users(i.window_requests(), SEGMENT)


def count_downloads(i: Inputs) -> DataFrame:
    attributed = events.attribute_downloads(i.downloads(), i.window_requests())
    return rates.count_downloads(attributed, [*SEGMENT, APP])


def cvu_plain(i: Inputs) -> DataFrame:
    return rates.cvu_plain(i.window_requests(), i.downloads())


def _unnamed_devices(i: Inputs) -> DataFrame:
    name = "display_marketing_name"
    return i.window_requests().withColumn(name, F.nullif(F.col(name), F.lit("")))


def cvu_plain_unknown_device(i: Inputs) -> DataFrame:
    """A NULL dimension matches no download."""
    return rates.cvu_plain(_unnamed_devices(i), i.downloads())


def cvu_plain_null_safe(i: Inputs) -> DataFrame:
    return rates.cvu_plain(_unnamed_devices(i), i.downloads(), null_safe=True)


def cvu_by_bag(i: Inputs) -> DataFrame:
    return _bag_text(rates.cvu_by_bag(i.window_requests(), i.downloads(), i.bags()))


def cvu_encoded(i: Inputs) -> DataFrame:
    return i.cvu(rates.cvu_encoded)


def cvu_encoded_sparse(i: Inputs) -> DataFrame:
    return i.cvu(rates.cvu_encoded, sparse=True)


def cvu_encoded_compact(i: Inputs) -> DataFrame:
    """The same table, encoded from the compact feed."""
    return i.cvu(rates.cvu_encoded, slots=i.compact_feed)


def cvu_encoded_appfree_compact(i: Inputs) -> DataFrame:
    return i.cvu(rates.cvu_encoded_appfree, slots=i.compact_feed)


def encode_own_target_compact(i: Inputs) -> DataFrame:
    attributed = cut_lineage(events.attribute_downloads(i.downloads(), i.window_requests()))
    return encode.encode_own_target(attributed, i.compact_feed, i.staged_owned, distinct=True)


def cvu_encoded_appfree(i: Inputs) -> DataFrame:
    return i.cvu(rates.cvu_encoded_appfree)


def cvu_encoded_appfree_min_users(i: Inputs) -> DataFrame:
    return i.cvu(rates.cvu_encoded_appfree, min_users=W.LEAST_USERS)


def table_sizes(i: Inputs) -> DataFrame:
    return rates.table_sizes(
        plain=rates.cvu_plain(i.staged_requests, i.staged_downloads),
        by_bag=rates.cvu_by_bag(i.staged_requests, i.staged_downloads, bags.app_bags(i.staged_owned)),
        encoded=i.cvu(rates.cvu_encoded),
    )


# --- model --------------------------------------------------------------------------------------------------------


def fill_missing(i: Inputs) -> DataFrame:
    return features.fill_missing(i.window_requests())


def temporal_split(i: Inputs) -> DataFrame:
    train, test = i.split()
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def expand_instances(i: Inputs) -> DataFrame:
    return features.expand_instances(i.model_rows)


def training_cells(i: Inputs) -> DataFrame:
    return training.training_cells(i.split()[0])


def string_index(i: Inputs) -> DataFrame:
    """Label and index of every category, read off the indexed rows."""
    rows = i.model_rows
    indexed = features.string_indexer(unseen="error").fit(rows).transform(rows)
    pairs = [
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("label"), F.col(f"{c}_index").cast("int").alias("index"))
        for c in FEATURES
    ]
    return indexed.select(F.inline(F.array(*pairs))).distinct()


def feature_slots(i: Inputs) -> DataFrame:
    """Width of the assembled feature vector and the positions of its ones, read off the vectors of every distinct row."""
    rows = i.model_rows
    vectors = features.fit_features(rows, rows, fit_on="all").transform(rows.select(*FEATURES).distinct())
    ones = F.array_join(features.vector_ones(F.col("features")).cast("array<string>"), ",")
    return vectors.select(*FEATURES, features.vector_width(F.col("features")).alias("width"), ones.alias("ones"))


def string_index_table(i: Inputs) -> DataFrame:
    """The same indexes from a dictionary that stays a table."""
    return dictionary.label_dictionary(i.model_rows).select("feature", "label", "index")


def feature_slots_table(i: Inputs) -> DataFrame:
    """The positions of the ones by joins with the dictionary."""
    rows = i.model_rows
    slots = dictionary.with_slots(rows.select(*FEATURES).distinct(), dictionary.label_dictionary(rows))
    return slots.select(*FEATURES, "width", F.array_join(F.col("ones").cast("array<string>"), ",").alias("ones"))


def binning_rates(i: Inputs) -> DataFrame:
    return evaluate.binning_rates(i.split()[0])


def binning_cells(i: Inputs) -> DataFrame:
    return evaluate.binning_cells(*i.split())


def binning_cells_coarse(i: Inputs) -> DataFrame:
    """Cells of three categories, of which most are common to training and test."""
    return evaluate.binning_cells(*i.split(), columns=W.COARSE)


def binning_rmse(i: Inputs) -> DataFrame:
    cells = evaluate.binning_cells(*i.split())
    error = evaluate.weighted_rmse(cells, "CVU", BINNING, "user_count")
    return error.select(F.round("weighted_error", 6).alias("weighted_error"), "weight", F.round("rmse", 6).alias("rmse"))


def _trained(i: Inputs, **options):
    return train_and_compare(i.model_rows, (W.TRAIN_START, W.TRAIN_END), W.TEST_DAY, **options)


# Over one category the model's maximum likelihood is the ratio of each of its values, which SQL can state.
_ONE = ["market_id"]

# Places after the point to which the optimiser meets the ratio.
_PLACES_OF_ONE = 6


def lr_scores(i: Inputs) -> DataFrame:
    return _trained(i, columns=_ONE).test_scores.withColumn("logistic_prediction", F.round("logistic_prediction", _PLACES_OF_ONE))


def lr_scores_fit_on_all(i: Inputs) -> DataFrame:
    """Category indexes fitted on all rows: the same predictions."""
    scores = _trained(i, columns=_ONE, fit_on="all").test_scores
    return scores.withColumn("logistic_prediction", F.round("logistic_prediction", _PLACES_OF_ONE))


def lr_calibration(i: Inputs) -> DataFrame:
    """With an intercept and no regularisation the expected downloads of every category equal the observed ones."""
    scores = _trained(i).train_scores
    expected = F.sum(F.col("logistic_prediction") * F.greatest("user_count", "downloads"))
    return scores.groupBy("market_id").agg(F.round(expected, 0).cast("long").alias("downloads"))


def lr_calibration_all(i: Inputs) -> DataFrame:
    """The model over all five categories: for each value of each, how far expected downloads are from observed ones, as a
    share of them."""
    scores = _trained(i).train_scores
    expected = F.col("logistic_prediction") * F.greatest("user_count", "downloads")
    values = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("label")) for c in FEATURES])
    rows = scores.select(F.inline(values), expected.alias("expected"), "downloads")
    error = F.abs(F.sum("expected") - F.sum("downloads")) / F.sum("downloads")
    return rows.groupBy("feature", "label").agg(F.sum("downloads").alias("downloads"), F.abs(F.round(error, 2)).alias("error"))


def _errors(df: DataFrame) -> DataFrame:
    return df.withColumn("weighted_error", F.round("weighted_error", 4)).withColumn("rmse", F.round("rmse", 6))


# Places after the point to which the optimiser and an exact solver agree.
_PLACES = 4


def _trained_on_all(i: Inputs):
    return _trained(i, known_only=True)


def lr_scores_all(i: Inputs) -> DataFrame:
    """The model over all five categories; rows with a category that training has not seen have no score."""
    scores = _trained_on_all(i).test_scores
    return scores.withColumn("logistic_prediction", F.round("logistic_prediction", _PLACES))


def lr_train_rmse_all(i: Inputs) -> DataFrame:
    return _rounded_errors(_trained_on_all(i).train_rmse)


def compare_models_all(i: Inputs) -> DataFrame:
    """Both models over all five categories, on the test cells that training has seen."""
    return _rounded_errors(_trained_on_all(i).comparison)


def _rounded_errors(df: DataFrame) -> DataFrame:
    return df.withColumn("weighted_error", F.round("weighted_error", 3)).withColumn("rmse", F.round("rmse", 5))


def lr_train_rmse(i: Inputs) -> DataFrame:
    return _errors(_trained(i, columns=_ONE).train_rmse)


def compare_models(i: Inputs) -> DataFrame:
    return _errors(_trained(i, columns=_ONE).comparison)


CATALOGUE: dict[str, Callable[[Inputs], DataFrame]] = {
    f.__name__: f
    for f in (
        parse_event_log,
        request_log,
        request_csv,
        app_map_csv,
        requests_by_day,
        requests_redone_day,
        orc_events,
        app_map,
        requests,
        event_window,
        cohort_filtered,
        union_events,
        map_store_ids,
        owned_apps,
        owned_apps_sliding,
        ownership,
        targets,
        cohort_apps,
        cohort_apps_bucketed,
        attribute_downloads,
        app_bags,
        market_bags,
        requests_with_bags,
        requests_with_bags_bucketed,
        requests_of_owners,
        downloads_with_bags,
        bag_stats,
        cohort_counts,
        cohort_reach,
        app_users,
        target_users,
        eligible_pairs,
        co_users,
        pair_counts,
        pair_lift,
        lift_feed,
        lift_feed_legacy,
        feed_slots,
        lift_feed_compact,
        lift_feed_unfolded,
        lift_stats,
        feed_preview,
        feed_counts,
        popular_targets,
        target_hits,
        target_hits_shuffled,
        target_hits_compact,
        encode_own_target,
        encode_all_targets,
        count_users,
        count_downloads,
        cvu_plain,
        cvu_plain_unknown_device,
        cvu_plain_null_safe,
        cvu_by_bag,
        cvu_encoded,
        cvu_encoded_sparse,
        cvu_encoded_compact,
        cvu_encoded_appfree_compact,
        encode_own_target_compact,
        cvu_encoded_appfree,
        cvu_encoded_appfree_min_users,
        table_sizes,
        fill_missing,
        temporal_split,
        expand_instances,
        training_cells,
        string_index,
        feature_slots,
        string_index_table,
        feature_slots_table,
        binning_rates,
        binning_cells,
        binning_cells_coarse,
        binning_rmse,
        lr_scores,
        lr_scores_fit_on_all,
        lr_calibration,
        lr_calibration_all,
        lr_train_rmse,
        compare_models,
        lr_scores_all,
        lr_train_rmse_all,
        compare_models_all,
    )
}


def _query(build: Callable[[Inputs], DataFrame]) -> Query:
    return lambda spark, folder: build(Inputs(spark, folder))


def queries() -> dict[str, Query]:
    return {name: _query(build) for name, build in CATALOGUE.items()}
