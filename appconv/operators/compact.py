"""The lift feed in the size of what was co-owned.

The feed has a row for every eligible pair of a cohort, but almost all pairs of a large catalogue were never co-owned and have the
same slot: that of no lift. So only co-owned pairs are kept, next to the eligible apps of both sides, and one default slot
for each (cohort, target). The full feed can be unfolded from that, and the encoder reads the small form itself: for an owned
app a target's vector is that of its pair where the pair is listed, and the default slot where it is not."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appconv.functions import VECTOR_WIDTH, clip_slot, slot_bit
from appconv.names import APP, BIN, COHORT, FEED_COLUMNS, OWNED, TARGET, UID
from appconv.operators import encode, lift
from appconv.operators.skew import lookup
from appconv.sources.staging import cut_lineage, stage

# Stands for the word in which a user's eligible apps are counted: the first of the block before all others.
_ALL = -encode.BLOCK_WORDS


@dataclass
class CompactFeed:
    """``owned`` (cohort, a1, A1users) and ``targets`` (cohort, a0, totals) are the eligible apps, ``together`` (cohort, a0, a1,
    A1A0users) the pairs that some user has. All are staged."""

    owned: DataFrame
    targets: DataFrame
    together: DataFrame
    legacy_nan: bool = False

    def staged(self, folder: str, mode: str = "errorifexists") -> "CompactFeed":
        parts = {name: stage(getattr(self, name), f"{folder}/{name}", mode) for name in ("owned", "targets", "together")}
        return CompactFeed(**parts, legacy_nan=self.legacy_nan)

    def full(self, missing: int | None = lift.MISSING) -> DataFrame:
        """Every eligible pair, as ``lift.lift_feed`` gives them."""
        pairs = lift.expand_pairs(self.owned, self.targets, self.together)
        feed = lift.pair_lift(pairs, self.legacy_nan).select(*FEED_COLUMNS)
        return feed if missing is None else feed.fillna(missing)

    def listed(self) -> DataFrame:
        """Slots of the co-owned pairs: (cohort, a0, a1, slot)."""
        pairs = self.together.join(self.owned, [*COHORT, OWNED]).join(self.targets, [*COHORT, TARGET])
        return _slot(lift.pair_lift(pairs, self.legacy_nan)).select(*COHORT, TARGET, OWNED, BIN)

    def defaults(self) -> DataFrame:
        """The slot of a target's other pairs: (cohort, a0, slot)."""
        nobody = self.targets.withColumns({"A1A0users": F.lit(0).cast("long"), "A1users": F.lit(1).cast("long")})
        return _slot(lift.pair_lift(nobody, self.legacy_nan)).select(*COHORT, TARGET, BIN)

    def packed_hits(self, members: DataFrame, targets: DataFrame, laid_out: bool = False) -> DataFrame:
        """Per (cohort, user) the words of all targets, as ``encode.packed_hits`` gives them.

        Of a user's eligible apps those without an exception in a word share its default, so the default is or-ed in where
        fewer exceptions than apps were seen; words without any exception are the default itself."""
        targets = encode.target_positions(targets)
        defaults = cut_lineage(default_words(self, targets))
        packed = cut_lineage(pack_exceptions(self, targets, defaults))
        rows = encode.by_user(members, packed, encode.BROADCAST_BYTES, laid_out)
        found = encode.or_blocks(rows, counted=True).withColumnRenamed("words", "found")
        lists = defaults.groupBy(*COHORT).agg(F.collect_list(F.struct("word", "bits")).alias("defaults"))
        both = lookup(cut_lineage(found), lists, COHORT, "inner").withColumn("found", F.map_from_entries("found"))
        hits = F.filter(F.transform("defaults", _with_default), lambda h: h["bits"] != 0)
        return both.select(*COHORT, UID, hits.alias(encode.HITS)).filter(F.size(encode.HITS) > 0)

    def pair_bits(self, pairs: DataFrame) -> DataFrame:
        """(cohort, user, a0, a1) -> with the bit of each eligible pair."""
        known = pairs.filter(F.col(TARGET) != F.col(OWNED)).join(self.owned.select(*COHORT, OWNED), [*COHORT, OWNED])
        known = known.join(self.defaults().withColumnRenamed(BIN, "default"), [*COHORT, TARGET])
        slots = known.join(self.listed(), [*COHORT, TARGET, OWNED], "left")
        return slots.withColumn("bit", slot_bit(F.coalesce(BIN, "default")))

    def rows(self) -> DataFrame:
        """Both in one table; a default has no owned app."""
        none = F.lit(None).cast("string").alias(OWNED)
        return self.listed().unionByName(self.defaults().select(*COHORT, TARGET, none, BIN))


def _slot(pairs: DataFrame) -> DataFrame:
    return pairs.fillna(lift.MISSING, subset=[BIN]).withColumn(BIN, clip_slot(F.col(BIN)))


def compact_feed(
    own: DataFrame, tgt: DataFrame, min_users: int = lift.MIN_USERS, distinct: bool = False, legacy_nan: bool = False
) -> CompactFeed:
    owned, targets, together = lift.pair_parts(own, tgt, min_users, distinct)
    return CompactFeed(owned, cut_lineage(targets), together, legacy_nan)


def _bit(slot: Column) -> Column:
    shift = (F.col(encode.POS) % encode.PER_WORD) * VECTOR_WIDTH
    return F.call_function("shiftleft", F.lit(1).cast("long"), (shift + slot).cast("int"))


def _field() -> Column:
    """All bits of a target's vector."""
    shift = ((F.col(encode.POS) % encode.PER_WORD) * VECTOR_WIDTH).cast("int")
    return F.call_function("shiftleft", F.lit((1 << VECTOR_WIDTH) - 1).cast("long"), shift)


def _word() -> Column:
    return F.floor(F.col(encode.POS) / encode.PER_WORD).cast("int").alias("word")


def default_words(feed: CompactFeed, targets: DataFrame) -> DataFrame:
    """(cohort, word, bits): the default slots of the popular targets that are eligible in a cohort."""
    known = feed.defaults().withColumnRenamed(TARGET, APP).join(targets, APP)
    return known.groupBy(*COHORT, _word()).agg(F.bit_or(_bit(F.col(BIN))).alias("bits"))


def pack_exceptions(feed: CompactFeed, targets: DataFrame, defaults: DataFrame) -> DataFrame:
    """One row per (cohort, eligible owned app): its words that differ from the default ones, because they hold a listed pair
    or the app itself as a target, for which it has no slot; and the word in which apps are counted, which all of them have."""
    listed = feed.listed().withColumnRenamed(TARGET, APP).join(targets, APP)
    listed = listed.select(*COHORT, OWNED, _word(), _field().alias("field"), _bit(F.col(BIN)).alias("bit"))
    itself = feed.targets.select(*COHORT, F.col(TARGET).alias(APP)).join(targets, APP).withColumn(OWNED, F.col(APP))
    itself = itself.select(*COHORT, OWNED, _word(), _field().alias("field"), F.lit(0).cast("long").alias("bit"))
    words = listed.unionByName(itself).groupBy(*COHORT, OWNED, "word").agg(F.bit_or("field").alias("fields"), F.bit_or("bit").alias("own"))
    bits = F.col("own").bitwiseOR(F.col("bits").bitwiseAND(F.bitwise_not("fields")))
    words = words.join(defaults, [*COHORT, "word"]).select(*COHORT, OWNED, "word", bits.alias("bits"))
    everyone = feed.owned.select(*COHORT, OWNED, F.lit(_ALL).alias("word"), F.lit(0).cast("long").alias("bits"))
    # Listed pairs and targets of apps that nobody eligible owns are of no use.
    words = words.join(feed.owned.select(*COHORT, OWNED), [*COHORT, OWNED], "left_semi")
    return encode.in_blocks(everyone.unionByName(words))


def _with_default(word: Column) -> Column:
    own = F.col("found")[word["word"]]
    rest = F.when(own["n"] < F.col("found")[F.lit(_ALL)]["n"], word["bits"]).otherwise(F.lit(0))
    bits = F.when(own.isNull(), word["bits"]).otherwise(own["bits"].bitwiseOR(rest))
    return F.struct(word["word"].alias("word"), bits.alias("bits"))
