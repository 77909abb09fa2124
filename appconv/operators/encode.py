"""Encode a user's app bag against the lift feed: for a target app, slot s of the vector is 1 when some owned app has
lift slot s for that target in the user's cohort. Vectors travel as the bits of one int and are rendered last.

A user's bag is the same on all of the user's requests, so the encoding is worked out once per (cohort, user) and
joined back, not once per request. Popular targets travel as their position in the sorted list of popular targets, and
the vectors of seven neighbouring positions share one 64-bit word, so that or-ing a bag's rows together handles seven
targets at a time. Eight neighbouring words make a block, whose words are or-ed side by side in one row."""

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appconv.functions import VECTOR_WIDTH, mask_to_text, slot_bit
from appconv.names import APP, BAG, BIN, COHORT, DATE, OWNED, TARGET, UID, VECTOR
from appconv.operators.events import cohort_apps
from appconv.operators.ranking import ranked
from appconv.operators.skew import HOT_ROWS, USER_PAIRS, lookup, split_bags
from appconv.sources.staging import cut_lineage

# Fixed value: user-day downloads from which an app counts as a popular target.
MIN_ROWS = 10000

MASK = "mask"
POS = "pos"
HITS = "hits"

# A packed feed up to this many bytes is broadcast; a larger one is joined by shuffling.
BROADCAST_BYTES = 256 * 1024 * 1024

# Vectors per 64-bit word: seven of nine bits each.
PER_WORD = 63 // VECTOR_WIDTH

# Words per block, and the columns that hold them.
BLOCK_WORDS = 8
BLOCKS = "blocks"
_WORDS = [f"w{i}" for i in range(BLOCK_WORDS)]

# The user goes first: sorts compare the start of the first key, and cohorts are few.
_USER = [UID, *COHORT]


class PairSlots(Protocol):
    """A feed that knows the slots of its pairs without a row for each (``compact.CompactFeed``)."""

    def packed_hits(self, members: DataFrame, targets: DataFrame, laid_out: bool = False) -> DataFrame: ...

    def pair_bits(self, pairs: DataFrame) -> DataFrame: ...


# What the functions here take as ``slots``: a table of slots by pair, or a feed as above.
Slots = DataFrame | PairSlots


def popular_targets(downloads: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Apps with at least ``min_rows`` distinct (user, day) downloads."""
    return (
        downloads.select(UID, APP, DATE)
        .distinct()
        .groupBy(APP)
        .agg(F.count(UID).alias("rows"))
        .filter(F.col("rows") >= min_rows)
        .select(APP)
    )


def target_positions(targets: DataFrame) -> DataFrame:
    """(app, position in the sorted list), from 0. A table that has positions already is returned as it is."""
    return targets if POS in targets.columns else cut_lineage(ranked(targets.select(APP), [F.col(APP)], POS))


def target_count(targets: DataFrame) -> Column:
    return targets.agg(F.count("*").cast("int")).scalar()


def with_app(df: DataFrame, targets: DataFrame, name: str = APP) -> DataFrame:
    """Positions back to the apps they stand for."""
    return df.join(target_positions(targets).select(POS, F.col(APP).alias(name)), POS)


def _feed_bits(slots: DataFrame) -> DataFrame:
    return slots.filter(F.col(BIN).isNotNull()).select(*COHORT, TARGET, OWNED, slot_bit(F.col(BIN)).alias("bit"))


def pack_feed(slots: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per (cohort, owned app): the blocks with the words of the popular targets it has a slot for. The array is no
    longer than the list of popular targets takes."""
    known = slots.filter(F.col(BIN).isNotNull()).select(*COHORT, F.col(TARGET).alias(APP), OWNED, BIN)
    shift = (F.col(POS) % PER_WORD) * VECTOR_WIDTH + F.col(BIN)
    words = (
        known.join(target_positions(targets), APP)
        .groupBy(*COHORT, OWNED, F.floor(F.col(POS) / PER_WORD).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), shift)).alias("bits"))
    )
    return in_blocks(words)


def in_blocks(words: DataFrame) -> DataFrame:
    """(cohort, owned app, word, bits) to one row per (cohort, owned app) with its words in blocks; a word that is not there is
    NULL."""
    place = F.pmod(F.col("word"), F.lit(BLOCK_WORDS))
    cells = [F.bit_or(F.when(place == i, F.col("bits"))).alias(w) for i, w in enumerate(_WORDS)]
    blocks = words.groupBy(*COHORT, OWNED, F.floor(F.col("word") / BLOCK_WORDS).cast("int").alias("block")).agg(*cells)
    return blocks.groupBy(*COHORT, OWNED).agg(F.collect_list(F.struct("block", *_WORDS)).alias(BLOCKS))


def packed_bytes(packed: DataFrame) -> int:
    """Memory a packed feed takes, from its true row and block counts and a generous share for each."""
    size = packed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(BLOCKS)), F.lit(0)).alias("blocks")).first()
    return size["n"] * 256 + size["blocks"] * 32 * (BLOCK_WORDS // 2)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def members_by_user(owned: DataFrame, members: DataFrame) -> DataFrame:
    """``cohort_apps`` of distinct (user, app) and (cohort, user), laid out by user with the full number of partitions, so that
    the encoder can go on in place."""
    return cohort_apps(owned.repartition(_partitions(owned), UID), members, distinct=True)


def by_user(members: DataFrame, packed: DataFrame, broadcast_bytes: int, laid_out: bool = False) -> DataFrame:
    """``members`` with the blocks of their apps, laid out by user. ``packed`` is staged."""
    n = _partitions(members)
    owned = members.select(*COHORT, UID, F.col(APP).alias(OWNED))
    if packed_bytes(packed) <= broadcast_bytes:
        return (owned if laid_out else owned.repartition(n, *_USER)).join(F.broadcast(packed), [*COHORT, OWNED])
    return owned.join(packed.hint("merge"), [*COHORT, OWNED]).repartition(n, *_USER)


def or_blocks(rows: DataFrame, counted: bool = False) -> DataFrame:
    """Blocks of all apps of a user or-ed: (user, cohort, words), an array of (word, bits). With ``counted`` it has
    (word, (bits, n)), n being the apps that have the word."""
    counts = [F.count(w).alias(f"n_{w}") for w in _WORDS] if counted else []
    blocks = rows.select(*_USER, F.inline(BLOCKS)).groupBy(*_USER, "block").agg(*[F.bit_or(w).alias(w) for w in _WORDS], *counts)
    words = [
        F.struct(
            (F.col("block") * BLOCK_WORDS + i).alias("word"),
            (F.struct(F.col(w).alias("bits"), F.col(f"n_{w}").alias("n")) if counted else F.col(w)).alias("bits"),
        )
        for i, w in enumerate(_WORDS)
    ]
    there = F.filter(F.array(*words), lambda h: (h["bits"]["bits"] if counted else h["bits"]).isNotNull())
    some = blocks.select(*_USER, there.alias("some"))
    return some.groupBy(*_USER).agg(F.flatten(F.collect_list("some")).alias("words"))


def packed_hits(
    members: DataFrame, targets: DataFrame, slots: Slots, broadcast_bytes: int = BROADCAST_BYTES, laid_out: bool = False
) -> DataFrame:
    """Per (cohort, user) the vectors that are not all zero, as an array of words.

    ``members`` holds distinct (cohort, user, owned app); ``laid_out`` says that they come from ``members_by_user``. The packed
    feed is staged once and measured. Where it is small enough, users are laid out first, the feed is broadcast, and all the rest happens in place. Beyond that the feed is
    joined by shuffling: as a staged table it comes from a shuffle like the members do, so adaptive execution splits the
    partitions of apps that everybody owns, and the users are laid out afterwards: what moves is one block per owned app
    and 56 targets."""
    if not isinstance(slots, DataFrame):
        return slots.packed_hits(members, targets, laid_out)
    packed = cut_lineage(pack_feed(slots, targets))
    words = or_blocks(by_user(members, packed, broadcast_bytes, laid_out))
    return words.select(*COHORT, UID, F.col("words").alias(HITS))


def unfold(df: DataFrame) -> DataFrame:
    """Rows with a ``word`` and its ``bits`` to one row per position: ``pos`` and ``mask``, zero vectors included."""
    rest = [c for c in df.columns if c not in ("word", "bits")]
    cells = [
        F.struct(
            (F.col("word") * PER_WORD + i).alias(POS),
            F.shiftrightunsigned("bits", i * VECTOR_WIDTH).bitwiseAND(F.lit((1 << VECTOR_WIDTH) - 1)).cast("int").alias(MASK),
        )
        for i in range(PER_WORD)
    ]
    return df.select(*rest, F.inline(F.array(*cells)))


def unfold_hits(df: DataFrame) -> DataFrame:
    """Rows with packed hits to one row per vector that is not all zero."""
    rest = [c for c in df.columns if c != HITS]
    return unfold(df.select(*rest, F.inline(HITS))).filter(F.col(MASK) != 0)


def target_hits(
    members: DataFrame, targets: DataFrame, slots: Slots, broadcast_bytes: int = BROADCAST_BYTES, laid_out: bool = False
) -> DataFrame:
    """Vectors that are not all zero, for every popular target: (cohort, user, a0, mask)."""
    targets = target_positions(targets)
    hits = unfold_hits(packed_hits(members, targets, slots, broadcast_bytes, laid_out))
    return with_app(hits, targets, TARGET).select(*COHORT, UID, TARGET, MASK)


def own_target_hits(
    wanted: DataFrame, owned: DataFrame, slots: Slots, user_pairs: int = USER_PAIRS, distinct: bool = False
) -> DataFrame:
    """Vectors that are not all zero, for the (cohort, user, app) rows of ``wanted`` only.

    A user with n such rows and m owned apps makes n*m pairs. With more than ``user_pairs`` of them the user is split exactly:
    the owned apps are dealt over parts and the wanted rows copied to each part; the parts' vectors are or-ed. Both sides meet
    as one bag per user. ``distinct`` says that ``owned`` has no repeats."""
    asked = wanted.select(UID, *COHORT, F.col(APP).alias(TARGET)).filter(F.col(UID).isNotNull()).distinct()
    asked = asked.groupBy(UID).agg(F.collect_list(F.struct(*COHORT, TARGET)).alias("asked"))
    apps = owned.select(UID, APP).filter(F.col(UID).isNotNull())
    apps = (apps if distinct else apps.distinct()).groupBy(UID).agg(F.collect_list(APP).alias("apps"))
    both = split_bags(asked.join(apps, UID), "apps", "asked", user_pairs).repartition(_partitions(wanted), UID, "part")
    both = both.select(UID, F.explode("apps").alias(OWNED), "asked")
    pairs = both.select(UID, OWNED, F.inline("asked"))
    bits = pairs.join(_feed_bits(slots), [*COHORT, TARGET, OWNED]) if isinstance(slots, DataFrame) else slots.pair_bits(pairs)
    return bits.groupBy(*_USER, F.col(TARGET).alias(APP)).agg(F.bit_or("bit").alias(MASK)).select(*COHORT, UID, APP, MASK)


def with_own_mask_from_hits(df: DataFrame, targets: DataFrame, hits: DataFrame) -> DataFrame:
    """``df`` (cohort, user, app, ...), of popular targets only, with position and mask of its app, taken out of the packed
    hits of its user. ``df`` is read twice and should be staged."""
    place = F.floor(F.col(POS) / PER_WORD).cast("int")
    rows = lookup(df.join(targets, APP).withColumn("word", place), hits, [*COHORT, UID], "left")
    bits = F.get(F.filter(HITS, lambda h: h["word"] == F.col("word")), F.lit(0))["bits"]
    shift = ((F.col(POS) % PER_WORD) * VECTOR_WIDTH).cast("int")
    mask = F.call_function("shiftrightunsigned", bits, shift).bitwiseAND(F.lit((1 << VECTOR_WIDTH) - 1)).cast("int")
    return rows.withColumn(MASK, F.coalesce(mask, F.lit(0))).drop("word", HITS)


def with_own_mask(df: DataFrame, hits: DataFrame) -> DataFrame:
    """``df`` (cohort, user, app, ...) with the mask of its own app; no hit gives the zero vector."""
    return lookup(df, hits, [*COHORT, UID, APP], "left").fillna(0, subset=[MASK])


def _unpack(df: DataFrame, *keys: str) -> DataFrame:
    """Bags to rows, after the repeats of a user's bag over requests are gone."""
    return df.select(*keys, BAG).distinct().select(*keys, F.explode(BAG).alias(APP)).distinct()


def encode_own_target(df: DataFrame, slots: Slots, owned: DataFrame | None = None, distinct: bool = False) -> DataFrame:
    """Add the vector of the row's own ``app_id``. The users' apps are ``owned``, or the bag that each row carries, where
    a NULL bag gives all zeros. ``distinct`` says that ``owned`` has no repeats."""
    hits = own_target_hits(df, _unpack(df, UID) if owned is None else owned, slots, distinct=distinct or owned is None)
    rows = with_own_mask(df, hits)
    return rows.select(*df.columns, mask_to_text(F.col(MASK)).alias(VECTOR))


def with_target_words(
    df: DataFrame, targets: DataFrame, hits: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per row of ``df`` and word of the target list: ``word`` and ``bits`` next to the columns of ``df``.

    A row first meets the user's packed hits, of which there is one record per (cohort, user), and is only then
    unfolded, so the large result is not shuffled. Words that are not among the hits are zero."""
    words = F.ceil(target_count(targets) / PER_WORD).cast("int")
    every = F.when(words > 0, F.sequence(F.lit(0), words - 1)).otherwise(F.array().cast("array<int>"))
    rows = lookup(df, hits, [*COHORT, UID], "left", hot_rows).withColumn("every", every)
    found = F.coalesce(HITS, F.array().cast(hits.schema[HITS].dataType))
    missed = F.transform(
        F.array_except("every", F.transform(found, lambda h: h["word"])),
        lambda word: F.struct(word.alias("word"), F.lit(0).cast("long").alias("bits")),
    )
    return rows.select(*df.columns, F.inline(F.concat(found, missed)))


def listed_only(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Drop the unused positions of the last word."""
    return df.filter(F.col(POS) < target_count(targets))


def encode_all_targets(
    df: DataFrame, targets: DataFrame, slots: Slots, members: DataFrame | None = None
) -> DataFrame:
    """Rows once per popular target, with that target's vector. The users' apps are ``members`` (distinct cohort, user,
    app), or the bag that each row carries."""
    targets = target_positions(targets)
    hits = packed_hits(_unpack(df, *COHORT, UID) if members is None else members, targets, slots)
    rows = listed_only(unfold(with_target_words(df.drop(BAG), targets, hits)), targets)
    rest = [c for c in df.columns if c != BAG]
    return with_app(rows, targets).select(*rest, APP, mask_to_text(F.col(MASK)).alias(VECTOR))
