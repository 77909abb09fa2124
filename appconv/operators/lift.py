"""App-pair lift: how much more often owners of one app (a1) convert on another (a0) than owners of the other eligible
apps do, per cohort of country, operating system and device type.

All cohorts are worked on at once, with the cohort as part of every key."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appconv.functions import clip_slot, log_bin
from appconv.names import APP, BIN, COHORT, FEED_COLUMNS, OWNED, TARGET, UID
from appconv.operators.skew import USER_PAIRS, split_bags
from appconv.sources.staging import cut_lineage

# An app is eligible from this many users in a cohort; missing numbers are stored as this sentinel.
MIN_USERS = 10000
MISSING = -999

# Pairs that one slice of a cohort's pair universe holds, and slices that a task builds on average.
SLICE_PAIRS = 250_000
TASK_SLICES = 4

# The user goes first: sorts compare the start of the first key, and cohorts are few.
_USER = [UID, *COHORT]


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cohorts(df: DataFrame) -> DataFrame:
    """Cohorts with their row counts."""
    return df.groupBy(*COHORT).agg(F.count("*").alias("count"))


def cohort_rows(owned: DataFrame, requests: DataFrame) -> DataFrame:
    """Cohorts with the number of rows that owned apps and distinct requests have together, without building these: each
    user counts apps times requests."""
    apps = owned.select(UID, APP).distinct().groupBy(UID).agg(F.count("*").alias("apps"))
    seen = requests.distinct().groupBy(*COHORT, UID).agg(F.count("*").alias("seen"))
    return seen.join(apps, UID).groupBy(*COHORT).agg(F.sum(F.col("apps") * F.col("seen")).alias("count"))


def cohort_reach(own: DataFrame) -> DataFrame:
    """Distinct owners per cohort."""
    return own.select(*COHORT, UID).distinct().groupBy(*COHORT).agg(F.count(UID).alias("RONusers"))


def _members(df: DataFrame, app: str, distinct: bool) -> DataFrame:
    """Distinct (cohort, app, user). Rows without a cohort or an app can be in no pair; all branches of the plan state
    the same filters, so that their shuffles are recognised as one."""
    rows = df.select(*COHORT, F.col(APP).alias(app), UID)
    for column in (*COHORT, app):
        rows = rows.filter(F.col(column).isNotNull())
    return rows if distinct else rows.distinct()


def _users(members: DataFrame, app: str, name: str) -> DataFrame:
    return members.groupBy(*COHORT, app).agg(F.count(UID).alias(name))


def app_users(own: DataFrame, distinct: bool = False) -> DataFrame:
    """Users per owned app and cohort.

    Here and below, ``distinct`` says that the inputs are distinct on (cohort, user, app) already, as ``cohort_apps``
    makes them; the largest table is then not shuffled just to find that out."""
    return _users(_members(own, OWNED, distinct), OWNED, "A1users")


def target_users(tgt: DataFrame, distinct: bool = False) -> DataFrame:
    """Users per target app and cohort."""
    return _users(_members(tgt, TARGET, distinct), TARGET, "A0users")


def _eligible(counts: DataFrame, name: str, min_users: int) -> DataFrame:
    return counts.filter(F.col(name) >= min_users)


def _pair_universe(owned: DataFrame, wanted: DataFrame, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """All ordered pairs of eligible apps of a cohort. The result is the feed's own grain, so its size is given.

    A handful of cohorts would mean a handful of tasks. The owned apps of a cohort are therefore dealt into slices that
    are part of the join key, as many as the cohort's pairs fill, and its target apps are copied to each slice. Where
    there are few pairs, slices are smaller, so that every task gets some. ``owned`` and ``wanted`` should be staged, as
    they are counted first."""
    o = owned.groupBy(*COHORT).agg(F.count("*").alias("o"))
    sizes = cut_lineage(o.join(wanted.groupBy(*COHORT).agg(F.count("*").alias("w")), COHORT))
    total = sizes.agg(F.sum(F.col("o") * F.col("w"))).first()[0] or 0
    each = max(1, min(slice_pairs, total // (TASK_SLICES * _partitions(owned))))
    tasks = max(_partitions(owned), -(-total // (TASK_SLICES * each)))
    # No more slices than owned apps: a finer deal would leave slices empty.
    slices = F.least(F.ceil(F.col("o") * F.col("w") / each), F.col("o")).cast("int")
    sizes = sizes.select(*COHORT, slices.alias("slices"))
    dealt = owned.join(sizes, COHORT).withColumn("slice", F.pmod(F.xxhash64(OWNED), F.col("slices")).cast("int")).drop("slices")
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    copied = wanted.join(sizes, COHORT).withColumn("slice", every).drop("slices")
    layout = [tasks, *COHORT, "slice"]
    pairs = dealt.repartition(*layout).join(copied.repartition(*layout), [*COHORT, "slice"])
    return pairs.filter(F.col(OWNED) != F.col(TARGET)).drop("slice")


def _lists(own: DataFrame, tgt: DataFrame, min_users: int, distinct: bool) -> tuple[DataFrame, DataFrame]:
    """The eligible owned and target apps with their users, staged: several steps read them, and a join with a staged
    table has both its sides from a shuffle, so that adaptive execution can split an app that everybody owns."""
    owned = _eligible(app_users(own, distinct), "A1users", min_users)
    return cut_lineage(owned), cut_lineage(_eligible(target_users(tgt, distinct), "A0users", min_users))


def eligible_pairs(
    own: DataFrame, tgt: DataFrame, min_users: int = MIN_USERS, distinct: bool = False
) -> DataFrame:
    """Pairs of an owned and a different target app, both with at least ``min_users`` users in the cohort."""
    owned, wanted = _lists(own, tgt, min_users, distinct)
    return _pair_universe(owned.select(*COHORT, OWNED), wanted.select(*COHORT, TARGET))


def _numbered(apps: DataFrame, app: str, number: str) -> DataFrame:
    """Eligible apps with a number for each (cohort, app); staged, as another run could give other numbers."""
    return cut_lineage(apps.select(*COHORT, app).withColumn(number, F.monotonically_increasing_id()))


def _bags(df: DataFrame, apps: DataFrame, app: str, number: str, bag: str, distinct: bool) -> DataFrame:
    """One row per (cohort, user): the numbers of the user's eligible apps, none for a user without any."""
    rows = df.select(*COHORT, F.col(APP).alias(app), UID)
    for column in (*COHORT, UID):
        rows = rows.filter(F.col(column).isNotNull())
    rows = rows if distinct else rows.distinct()
    return rows.join(apps, [*COHORT, app], "left").groupBy(*_USER).agg(F.collect_list(number).alias(bag))


def _co_users(
    own: DataFrame, tgt: DataFrame, owned_apps: DataFrame, target_apps: DataFrame, distinct: bool, user_pairs: int = USER_PAIRS
) -> tuple[DataFrame, DataFrame]:
    """The co-owned pairs, and the owners per cohort, which come from the same bags."""
    owned_apps, target_apps = _numbered(owned_apps, OWNED, "o"), _numbered(target_apps, TARGET, "t")
    owners = cut_lineage(_bags(own, owned_apps, OWNED, "o", "owned", distinct))
    wanted = _bags(tgt, target_apps, TARGET, "t", "wanted", distinct).filter(F.size("wanted") > 0)
    both = cut_lineage(split_bags(owners.filter(F.size("owned") > 0).join(wanted, _USER), "owned", "wanted", user_pairs))
    # Tasks of one cohort, or few, know few pairs, so that counting them in place leaves little to shuffle.
    dealt = both.repartitionByRange(_partitions(own), *COHORT, F.xxhash64(UID, "part"))
    pairs = dealt.select("owned", F.explode("wanted").alias("t")).select("t", F.explode("owned").alias("o"))
    together = (
        pairs.groupBy("t", "o")
        .agg(F.count("*").alias("A1A0users"))
        .join(owned_apps, "o")
        .join(target_apps.select("t", TARGET), "t")
        .filter(F.col(OWNED) != F.col(TARGET))
        .select(*COHORT, TARGET, OWNED, "A1A0users")
    )
    return together, owners.groupBy(*COHORT).agg(F.count(UID).alias("RONusers"))


def co_users(
    own: DataFrame, tgt: DataFrame, min_users: int = MIN_USERS, distinct: bool = False, user_pairs: int = USER_PAIRS
) -> DataFrame:
    """Users per cohort who own a1 and converted on a0, for eligible pairs with at least one such user.

    Both sides become one bag of numbers of eligible apps per (cohort, user) before they meet: a user with n owned and m
    target apps makes n*m pairs of numbers, which are counted in the same task before anything is shuffled again. A user with
    more than ``user_pairs`` of them is split exactly: the owned apps are dealt over parts and the targets copied to each part.
    Bags are laid out by ranges of cohort and user with the full number of partitions, whatever the size of their input,
    because the work grows with the pairs and not with the bytes read."""
    return _co_users(own, tgt, *_lists(own, tgt, min_users, distinct), distinct, user_pairs)[0]


def pair_parts(own: DataFrame, tgt: DataFrame, min_users: int, distinct: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the pair table is made of: eligible owned apps, eligible targets with their totals, and the co-owned pairs,
    which are staged.

    The totals need no window over the pairs. The co-users of a target are summed over the pairs that have any; the
    users of its partners are the cohort's sum over eligible owned apps, less the target's own users when it is one of
    them."""
    owned, wanted = _lists(own, tgt, min_users, distinct)
    together, reach = _co_users(own, tgt, owned, wanted, distinct)
    together = cut_lineage(together)

    co_totals = together.groupBy(*COHORT, TARGET).agg(F.sum("A1A0users").alias("A1A0usersAggTarget"))
    cohort_totals = owned.groupBy(*COHORT).agg(F.sum("A1users").alias("all_users"))
    same_app = owned.select(*COHORT, F.col(OWNED).alias(TARGET), F.col("A1users").alias("own_users"))
    totals = (
        wanted.join(cohort_totals, COHORT)
        .join(reach, COHORT, "left")
        .join(same_app, [*COHORT, TARGET], "left")
        .join(co_totals, [*COHORT, TARGET], "left")
        .select(
            *COHORT,
            TARGET,
            "A0users",
            F.coalesce("RONusers", F.lit(0)).alias("RONusers"),
            F.coalesce("A1A0usersAggTarget", F.lit(0)).alias("A1A0usersAggTarget"),
            (F.col("all_users") - F.coalesce("own_users", F.lit(0))).alias("A1usersAggTarget"),
        )
    )
    return owned, totals, together


def expand_pairs(owned: DataFrame, totals: DataFrame, together: DataFrame) -> DataFrame:
    """All pairs of the two sides with their counts; a pair that is not in ``together`` has no co-users."""
    return (
        _pair_universe(owned, totals)
        .join(together, [*COHORT, TARGET, OWNED], "left")
        .fillna(0, subset=["A1A0users"])
        .select(*[c for c in FEED_COLUMNS if c not in ("nCVU", BIN)])
    )


def pair_counts(own: DataFrame, tgt: DataFrame, min_users: int = MIN_USERS, distinct: bool = False) -> DataFrame:
    """Every eligible pair with its counts and the totals of its target app."""
    return expand_pairs(*pair_parts(own, tgt, min_users, distinct))


def pair_lift(pairs: DataFrame, legacy_nan: bool = False) -> DataFrame:
    """Lift and its bin. A target that no partner shares users with has no lift: NULL, or bin 0 with ``legacy_nan``."""
    together, partner_total = F.col("A1A0users").cast("double"), F.col("A1usersAggTarget").cast("double")
    target_total, users = F.col("A1A0usersAggTarget").cast("double"), F.col("A1users").cast("double")
    lift = F.try_divide(together * partner_total, target_total * users)
    bins = log_bin(F.col("nCVU"))
    if legacy_nan:
        bins = F.when(F.col("A1A0usersAggTarget") == 0, F.lit(0).cast("long")).otherwise(bins)
    return pairs.withColumn("nCVU", lift).withColumn(BIN, bins)


def lift_feed(
    own: DataFrame,
    tgt: DataFrame,
    min_users: int = MIN_USERS,
    missing: int | None = MISSING,
    legacy_nan: bool = False,
    distinct: bool = False,
) -> DataFrame:
    """The lift feed of all cohorts; missing numbers become ``missing`` (``None`` leaves them NULL)."""
    feed = pair_lift(pair_counts(own, tgt, min_users, distinct), legacy_nan).select(*FEED_COLUMNS)
    return feed if missing is None else feed.fillna(missing)


def feed_counts(missing: int = MISSING) -> dict[str, Column]:
    """Counts of a feed: pairs, those of them that were co-owned and that have a bin, and their users."""
    return {
        "pairs": F.count("*"),
        "co_owned": F.count_if(F.col("A1A0users") > 0),
        "with_bin": F.count_if(F.col(BIN) != missing),
        "co_users": F.coalesce(F.sum("A1A0users"), F.lit(0)),
    }


def feed_slots(feed: DataFrame) -> DataFrame:
    """The feed with its bins clipped and counted from 0, as the encoders expect it."""
    return feed.withColumn(BIN, clip_slot(F.col(BIN)))


def lift_stats(own: DataFrame, tgt: DataFrame, min_users: int = MIN_USERS, distinct: bool = False) -> DataFrame:
    """Eligible owned apps, eligible target apps and eligible pairs per cohort, counted without building the pairs."""
    owned = _eligible(app_users(own, distinct), "A1users", min_users)
    wanted = _eligible(target_users(tgt, distinct), "A0users", min_users)
    sides = owned.select(*COHORT, F.col(OWNED).alias(APP), F.lit(1).alias("o"), F.lit(0).alias("t")).unionByName(
        wanted.select(*COHORT, F.col(TARGET).alias(APP), F.lit(0).alias("o"), F.lit(1).alias("t"))
    )
    apps = sides.groupBy(*COHORT, APP).agg(F.max("o").alias("o"), F.max("t").alias("t"))
    return (
        apps.groupBy(*COHORT)
        .agg(
            F.sum("o").alias("eligible_owned"),
            F.sum("t").alias("eligible_targets"),
            F.sum(F.col("o") * F.col("t")).alias("both"),
        )
        .select(
            *COHORT,
            "eligible_owned",
            "eligible_targets",
            (F.col("eligible_owned") * F.col("eligible_targets") - F.col("both")).alias("pairs"),
        )
    )
