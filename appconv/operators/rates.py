"""Conversion per user (CVU = downloads / users) by audience segment."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appconv.functions import mask_to_text
from appconv.names import APP, BAG, COHORT, DATE, MODEL_SEGMENT, SEGMENT, UID, VECTOR
from appconv.operators import encode
from appconv.operators.encode import MASK
from appconv.operators.events import attribute_downloads, cohort_members
from appconv.operators.skew import lookup
from appconv.sources.staging import cut_lineage


def count_users(df: DataFrame, dims: list[str]) -> DataFrame:
    """Rows per segment. A user seen with two devices on a day has two request tuples and counts twice."""
    return df.groupBy(*dims).agg(F.count("*").alias("user_count"))


def count_downloads(df: DataFrame, dims: list[str]) -> DataFrame:
    return df.groupBy(*dims).agg(F.count("*").alias("downloads"))


def conversion_rate(
    users: DataFrame,
    downloads: DataFrame,
    dims: list[str],
    how: str = "left",
    null_safe: bool = False,
    fill: bool = True,
) -> DataFrame:
    """Bring both counts together on ``dims``. A NULL dimension matches nothing unless ``null_safe``."""
    if null_safe:
        renamed = downloads.select(*[F.col(c).alias(f"d_{c}") if c in dims else F.col(c) for c in downloads.columns])
        same = None
        for c in dims:
            equal = F.col(c).eqNullSafe(F.col(f"d_{c}"))
            same = equal if same is None else same & equal
        joined = users.join(renamed, same, how).drop(*[f"d_{c}" for c in dims])
    else:
        joined = users.join(downloads, dims, how)
    rates = joined.withColumn("CVU", F.try_divide(F.col("downloads").cast("double"), F.col("user_count").cast("double")))
    return rates.fillna(0) if fill else rates


def cvu_plain(requests: DataFrame, downloads: DataFrame, null_safe: bool = False) -> DataFrame:
    """CVU without an ownership feature. Segments without downloads stay, with app_id NULL and CVU 0."""
    attributed = attribute_downloads(downloads, requests)
    users = count_users(requests.distinct(), SEGMENT)
    return conversion_rate(users, count_downloads(attributed, [*SEGMENT, APP]), SEGMENT, null_safe=null_safe)


def cvu_by_bag(requests: DataFrame, downloads: DataFrame, bags: DataFrame) -> DataFrame:
    """CVU grouped on the whole bag; segments without downloads, and users without a bag, drop out.

    The bag belongs to the user, so downloads meet requests on (date, user)."""
    # The smallest user of a bag stands for it, so arrays are grouped once per user and not once per request.
    distinct = cut_lineage(bags.groupBy(BAG).agg(F.min(UID).alias("bag_id")))
    users = cut_lineage(bags.join(distinct, BAG).select(UID, "bag_id"))
    with_bag = requests.distinct().join(users, UID)
    downloaded = downloads.select(DATE, UID, APP).distinct().join(with_bag, [DATE, UID])
    dims = [*SEGMENT, "bag_id"]
    rates = conversion_rate(
        count_users(with_bag, dims), count_downloads(downloaded, [*dims, APP]), dims, how="inner", fill=False
    )
    return rates.join(distinct, "bag_id").drop("bag_id")


def _hit_counts(requests: DataFrame, hits: DataFrame, dims: list[str], *keys: str) -> DataFrame:
    """Requests per segment, vector and ``keys``, for vectors that are not all zero."""
    rows = encode.unfold_hits(lookup(requests, hits, [*COHORT, UID], "inner").select(*dims, encode.HITS))
    return rows.groupBy(*dims, *keys, MASK).agg(F.count("*").alias("n"))


def _all_counts(requests: DataFrame, hits: DataFrame, targets: DataFrame, dims: list[str]) -> DataFrame:
    """Requests per segment, target and vector. Requests are counted by word before the words are unfolded, so requests
    of a segment with equal vectors, such as all those without any, are unfolded once."""
    words = encode.with_target_words(requests, targets, hits).groupBy(*dims, "word", "bits").agg(F.count("*").alias("n"))
    vectors = encode.listed_only(encode.unfold(words), targets)
    return vectors.groupBy(*dims, encode.POS, MASK).agg(F.sum("n").alias("user_count"))


def _with_zero_vectors(counted: DataFrame, everyone: DataFrame, dims: list[str]) -> DataFrame:
    """Counts for all vectors from the counts of non-zero ones: who is not among those has the zero vector.

    ``counted`` has (dims, mask, n), ``everyone`` (dims, n). Each non-zero count is also booked against the zero
    vector of its segment."""
    booked = counted.select(
        *dims, F.inline(F.array(F.struct(F.col(MASK), F.col("n")), F.struct(F.lit(0).alias(MASK), (-F.col("n")).alias("n"))))
    )
    return (
        booked.unionByName(everyone.select(*dims, F.lit(0).alias(MASK), "n"))
        .groupBy(*dims, MASK)
        .agg(F.sum("n").alias("user_count"))
        .filter(F.col("user_count") > 0)
    )


def _as_vector(df: DataFrame, order: list[str]) -> DataFrame:
    return df.withColumn(VECTOR, mask_to_text(F.col(MASK))).select(*order, VECTOR, "user_count", "downloads", "CVU")


def cvu_encoded(
    requests: DataFrame,
    owned: DataFrame,
    downloads: DataFrame,
    targets: DataFrame,
    slots: encode.Slots,
    sparse: bool = False,
    null_safe: bool = False,
    distinct: bool = False,
) -> DataFrame:
    """CVU by segment, popular target and lift vector; every request counts once per popular target.

    A feed has a slot for every eligible pair, so nearly every owner has a vector for nearly every target, and requests
    are unfolded over the targets in the same task that counts them. ``sparse`` is for feeds that cover few targets: it
    unfolds the vectors that are not zero and gets the zero ones by subtraction. Both give the same table. ``distinct`` says that
    requests, owned apps and downloads have no repeats."""
    if not distinct:
        requests, owned, downloads = requests.distinct(), owned.distinct(), downloads.distinct()
    targets = encode.target_positions(targets)
    members = encode.members_by_user(owned, cohort_members(requests))
    hits = cut_lineage(encode.packed_hits(members, targets, slots, laid_out=True))
    dims = [*SEGMENT, encode.POS]
    if sparse:
        everyone = requests.groupBy(*SEGMENT).agg(F.count("*").alias("n"))
        last = encode.target_count(targets).cast("long") - 1
        positions = F.explode(F.sequence(F.lit(0).cast("long"), last)).alias(encode.POS)
        everyone = everyone.filter(encode.target_count(targets) > 0).select(*SEGMENT, positions, "n")
        users = _with_zero_vectors(_hit_counts(requests, hits, SEGMENT, encode.POS), everyone, dims)
    else:
        users = _all_counts(requests, hits, targets, SEGMENT)
    wanted = cut_lineage(attribute_downloads(downloads.join(targets, APP, "left_semi"), requests, distinct=True))
    downloaded = encode.with_own_mask_from_hits(wanted, targets, hits)
    rates = conversion_rate(users, count_downloads(downloaded, [*dims, MASK]), [*dims, MASK], null_safe=null_safe)
    return _as_vector(encode.with_app(rates, targets), [*SEGMENT, APP])


def cvu_encoded_appfree(
    requests: DataFrame,
    owned: DataFrame,
    downloads: DataFrame,
    targets: DataFrame,
    slots: encode.Slots,
    min_users: int = 0,
    null_safe: bool = False,
    distinct: bool = False,
) -> DataFrame:
    """CVU by coarse segment, app and lift vector over users counted without the app: a user with the same vector for
    several popular targets counts once for each. Users without any owned app do not count; downloads of every app do.
    ``distinct`` says that requests, owned apps and downloads have no repeats."""
    if not distinct:
        requests, owned, downloads = requests.distinct(), owned.distinct(), downloads.distinct()
    members = encode.members_by_user(owned, cohort_members(requests))
    # Read three times below.
    owners = cut_lineage(requests.join(owned, UID, "left_semi"))
    hits = encode.packed_hits(members, targets, slots, laid_out=True)
    counted = _hit_counts(owners, hits, MODEL_SEGMENT)
    how_many = targets.agg(F.count("*").alias("targets")).scalar()
    everyone = owners.groupBy(*MODEL_SEGMENT).agg(F.count("*").alias("rows"))
    everyone = everyone.select(*MODEL_SEGMENT, (F.col("rows") * how_many).alias("n"))
    users = _with_zero_vectors(counted, everyone, MODEL_SEGMENT).filter(F.col("user_count") >= min_users)

    # Read three times below.
    attributed = cut_lineage(attribute_downloads(downloads, requests, distinct=True))
    own_hits = encode.own_target_hits(attributed, owned, slots, distinct=True)
    downloaded = count_downloads(encode.with_own_mask(attributed, own_hits), [*MODEL_SEGMENT, APP, MASK])
    rates = conversion_rate(users, downloaded, [*MODEL_SEGMENT, MASK], how="inner", null_safe=null_safe, fill=False)
    return _as_vector(rates, [*MODEL_SEGMENT, APP])


def table_sizes(**tables: DataFrame) -> DataFrame:
    """Row counts of tables by name, to compare what each encoding costs."""
    counts = [t.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows")) for name, t in tables.items()]
    report = counts[0]
    for c in counts[1:]:
        report = report.unionByName(c)
    return report
