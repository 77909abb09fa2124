"""Near-duplicates by an inverted join on MinHash coordinates.

Equal shingle sets are one class, represented by its smallest doc_id. A class has ``COORDINATES`` MinHash values; a
coordinate with its value is a token. Two sets of similarity 0.8 or more agree in at least ``MATCHES`` coordinates but for
a chance of 3e-6. Tokens of one class only match nothing and are skipped, and with them every class that has too few
others. Of the n tokens that are left, two classes with ``MATCHES`` in common share one of the n - MATCHES + 1 rarest of
each (prefix), so only these are posted. Candidates are counted on all their tokens, and those with enough matches are
confirmed on full sets of words.

Nothing lists all pairs of a group. Every member of a posting meets its leader, the smallest member. Members that are
confirmed to be similar to the leader leave the posting together with it: what is far from the leader (a similarity below
0.6, by fewer than ``FAR`` matches but for a chance of 3e-6) cannot be similar to them, as the distance 1 - similarity
keeps the triangle inequality. The rest gets a new leader. After ``ROUNDS`` components are formed; then members that were
neither similar to a leader nor far from it, those that were, and those left in a posting are compared exactly where their
posting still spans components: by the rarest shingles of their full sets (of two sets with similarity 0.8 each has a common
one among the rarest fifth), at a place from where enough of both sets is left, and only across components. Each set has
``PARITIES`` bits, a bit being the parity of the shingles hashed to it. Two sets differ in at least as many shingles as bits, so
pairs with too many different bits are no candidates; this loses none, and is sharp for sets of up to about ``PARITIES``.

Defined cases: a text without words has an empty set and is linked with nothing; so is a row without doc_id, which is kept.
Rows that repeat id and text get equal results; texts that share their smallest id count as linked. Other columns are kept
by ``deduplicate``. An empty table gives no rows."""

from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appconv.llm.common import LOWER_BYTES, batches_by_bytes, staged, table
from appconv.llm.links import components

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
COORDINATES = 96
MATCHES = 58
FAR = 36
ROUNDS = 3
PARITIES = 512
_TAG_BITS = 7
_HELD_SETS = 64
_HELD_WORDS = 1 << 20
_PIECE = 4096

SETS = "doc_id long, n_shingles long, high long, low long, tokens array<long>"
LINKS = "a long, b long"
FULL = "rep long, n int, parities array<long>, shingles array<long>"

_FACTORS = np.random.default_rng(20).integers(1, 1 << 63, (2, COORDINATES), dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) >= _HELD_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of the shingles, sorted; fewer words than a shingle are one as a whole."""
    size = min(size, hashes.size)
    mixed = np.full(hashes.size - size + 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[k : hashes.size - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function, with the number of the function in its lowest bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, shingles.size, _PIECE):
        values = shingles[k : k + _PIECE, None] * _FACTORS[0] + _FACTORS[1]
        least = np.minimum(least, values.min(axis=0))
    tags = np.arange(COORDINATES, dtype=np.uint64)
    return ((least >> np.uint64(_TAG_BITS) << np.uint64(_TAG_BITS)) | tags).view(np.int64)


def signatures(documents: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = _WordHashes()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = words_of(text)
                if not words:
                    rows.append((0, None, None, None))
                    continue
                hashes = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
                shingles = shingle_hashes(hashes, shingle_words)
                high, low = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "<i8").tolist()
                rows.append((shingles.size, high, low, signature(shingles)))
            frame = pd.DataFrame(rows, columns=["n_shingles", "high", "low", "tokens"])
            frame["high"], frame["low"] = frame["high"].astype("Int64"), frame["low"].astype("Int64")
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield frame

    return documents.select("doc_id", "text").mapInPandas(run, SETS)


def _postings(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """classes (rep, tokens) -> postings (token, rep) of the prefixes, and known (rep, tokens shared with others)."""
    tokens = classes.select("rep", F.explode("tokens").alias("token"))
    # Written, so that the join below has both sides from a shuffle and a frequent token can be split.
    frequent = staged(tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"))
    known = tokens.join(frequent, "token").groupBy("rep").agg(F.collect_set(F.struct("n", "token")).alias("tokens"))
    known = staged(known.filter(F.size("tokens") >= MATCHES).select("rep", F.array_sort("tokens").alias("tokens")))
    prefix = F.slice("tokens", F.lit(1), F.size("tokens") - (MATCHES - 1))
    postings = known.select("rep", F.explode(prefix).alias("t")).select(F.col("t.token").alias("token"), "rep")
    # For counting matches 32 bits of each token are enough; candidates are confirmed.
    marks = F.transform("tokens.token", lambda t: t.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    return staged(postings), staged(known.select("rep", marks.alias("marks")))


def _counted(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs with the number of their equal coordinates."""
    a = known.select(F.col("rep").alias("a"), F.col("marks").alias("marks_a"))
    b = known.select(F.col("rep").alias("b"), F.col("marks").alias("marks_b"))
    both = pairs.join(a, "a").join(b, "b")
    return staged(both.select("a", "b", F.size(F.array_intersect("marks_a", "marks_b")).alias("matches")))


def _confirmer(shingle_words: int):
    def shingles(text: str) -> set:
        words = words_of(text)
        size = min(shingle_words, len(words))
        return set(zip(*(words[k : len(words) - size + 1 + k] for k in range(size)), strict=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: OrderedDict[str, set] = OrderedDict()

        def of(text: str) -> set:
            if text not in held:
                held[text] = shingles(text)
                if len(held) > _HELD_SETS:
                    held.popitem(last=False)
            return held[text]

        for batch in batches:
            similar = []
            for x, y in zip(batch["text_a"], batch["text_b"], strict=True):
                left, right = of(x), of(y)
                common = len(left & right)
                similar.append(100 * common >= SIMILAR_PERCENT * (len(left) + len(right) - common))
            yield batch.loc[similar, ["a", "b"]]

    return run


def _confirmed(pairs: DataFrame, documents: DataFrame, shingle_words: int) -> DataFrame:
    """Pairs that are similar on full sets."""
    pairs = staged(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = documents.select("doc_id", "text").filter("text is not null").join(staged(ids), "doc_id", "left_semi")
    both = pairs.join(texts.selectExpr("doc_id as a", "text as text_a"), "a").join(
        texts.selectExpr("doc_id as b", "text as text_b"), "b"
    )
    return staged(both.mapInPandas(_confirmer(shingle_words), LINKS).distinct())


def parities(shingles: np.ndarray) -> np.ndarray:
    """``PARITIES`` bits as longs: whether an odd number of shingles is hashed to each."""
    places = (shingles >> np.uint64(32)) % np.uint64(PARITIES)
    odd = np.bincount(places.astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _full_sets(shingle_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = _WordHashes()
        for batch in batches:
            sets, odd = [], []
            for words in map(words_of, batch["text"]):
                hashes = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
                shingles = shingle_hashes(hashes, shingle_words)
                odd.append(parities(shingles))
                sets.append(shingles.view(np.int64))
            sizes = np.array([x.size for x in sets], "int32")
            yield pd.DataFrame({"rep": batch["doc_id"], "n": sizes, "parities": odd, "shingles": sets})

    return run


def _across(members: DataFrame, parts: DataFrame, documents: DataFrame, shingle_words: int) -> DataFrame:
    """Pairs of members (rep) in different components that a common rare shingle of their full sets allows to be similar."""
    ids = staged(members.select(F.col("rep").alias("doc_id")).distinct())
    texts = documents.select("doc_id", "text").filter("text is not null").join(ids, "doc_id", "left_semi")
    sets = staged(texts.mapInPandas(_full_sets(shingle_words), FULL))
    each = sets.select("rep", "n", F.explode("shingles").alias("shingle"))
    common = staged(each.groupBy("shingle").agg(F.count("*").alias("held")).filter("held > 1"))
    ordered = each.join(common, "shingle").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("s"))
    # Shingles of one member only come first and meet nothing.
    own = F.col("n") - F.size("s")
    rarest = F.col("n") - F.ceil(F.col("n") * SIMILAR_PERCENT / 100).cast("int") + 1
    ordered = ordered.join(sets.select("rep", "n", "parities").distinct(), ["rep", "n"])
    rows = ordered.withColumn("own", own).withColumn("s", F.slice("s", F.lit(1), F.greatest(F.lit(0), rarest - F.col("own"))))
    rows = rows.select("rep", "n", "parities", "own", F.posexplode("s").alias("k", "s"))
    part = F.coalesce("component", "rep").alias("part")
    rows = rows.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    left = (F.col("n") - F.col("own") - F.col("k")).alias("left")
    rows = staged(rows.select("rep", part, "n", "parities", left, F.col("s.shingle").alias("shingle")))
    x, y = (rows.select([F.col(c).alias(f"{name}_{c}") for c in rows.columns]) for name in "xy")
    # What both have in common from this place on can reach the overlap that the similarity takes.
    enough = (100 + SIMILAR_PERCENT) * F.least("x_left", "y_left") >= SIMILAR_PERCENT * (F.col("x_n") + F.col("y_n"))
    # Similar sets differ in few shingles, and so in few parities.
    bits = [F.bit_count(F.col("x_parities")[k].bitwiseXOR(F.col("y_parities")[k])) for k in range(PARITIES // 64)]
    few = (100 + SIMILAR_PERCENT) * reduce(Column.__add__, bits) <= (100 - SIMILAR_PERCENT) * (F.col("x_n") + F.col("y_n"))
    apart = (F.col("x_rep") < F.col("y_rep")) & (F.col("x_part") != F.col("y_part"))
    pairs = x.join(y, (F.col("x_shingle") == F.col("y_shingle")) & apart & enough & few)
    return pairs.select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b")).distinct()


def group(documents: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_shingles, component_id, kept: one row for each row."""
    sets = staged(signatures(documents, shingle_words))
    full = sets.filter("doc_id is not null and n_shingles > 0")
    reps = staged(full.groupBy("high", "low").agg(F.min("doc_id").alias("rep")))
    first = full.join(reps.withColumnRenamed("rep", "doc_id"), ["high", "low", "doc_id"])
    postings, known = _postings(first.select(F.col("doc_id").alias("rep"), "tokens"))

    confirm = lambda counted: _confirmed(counted.filter(F.col("matches") >= MATCHES).select("a", "b"), documents, shingle_words)
    links, met = [], []
    for _ in range(ROUNDS):
        leaders = postings.groupBy("token").agg(F.min("rep").alias("a"), F.count("*").alias("n")).filter("n > 1")
        members = staged(postings.join(staged(leaders.drop("n")), "token").filter("rep <> a"))
        counted = _counted(members.select("a", F.col("rep").alias("b")).distinct(), known)
        links.append(confirm(counted))
        similar = links[-1].withColumn("linked", F.lit(True))
        state = counted.join(similar, ["a", "b"], "left").select(
            "a", F.col("b").alias("rep"), F.coalesce("linked", F.lit(False)).alias("linked"), (F.col("matches") >= FAR).alias("close")
        )
        met.append(staged(members.join(staged(state), ["a", "rep"]).select("token", "rep", "linked", "close")))
        postings = met[-1].filter("not linked").select("token", "rep")
        if postings.isEmpty():
            break
    all_ = lambda parts: reduce(DataFrame.unionByName, parts)
    parts = staged(components(all_(links)))

    # Only postings whose members lie in different components are still open.
    part = F.coalesce("component", "rep").alias("part")
    rest = [*(m.filter("close or linked").select("token", "rep") for m in met), postings]
    open_ = []
    for rows in rest:
        placed = staged(rows.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", part))
        mixed = placed.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("token")
        open_.append(placed.join(staged(mixed), "token", "left_semi").select("rep"))
    more = _confirmed(_across(all_(open_), parts, documents, shingle_words), documents, shingle_words)
    if not more.isEmpty():
        parts = components(all_([*links, more]))

    of_class = reps.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        "high", "low", F.coalesce("component", "rep").alias("component")
    )
    rows = sets.select("doc_id", "n_shingles", "high", "low").join(staged(of_class), ["high", "low"], "left")
    single = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(single, F.col("doc_id")).otherwise(F.col("component"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def deduplicate(documents: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``documents`` without those that another one of their group stands for."""
    batches_by_bytes(documents.sparkSession)
    gone = group(documents, shingle_words).filter("not kept").select(F.col("doc_id").alias("gone"))
    return documents.join(gone.distinct(), F.col("doc_id") == F.col("gone"), "left_anti")


def op10_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"), shingle_words=2)
