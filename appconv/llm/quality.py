"""Quality by weak supervision: rules vote good or bad or abstain, expectation-maximisation finds how far each rule is to be
trusted, and a document is kept if its posterior probability of being good is high enough.

The rules are native expressions over counts of the whole text. Documents are counted by their pattern of votes, of which
there are at most 3 to the number of rules, however large the corpus; the estimate runs on these counts. Votes are taken
as independent given the class: a rule that votes is right with an accuracy of its own for good and for bad documents, as a
rule sees only its own kind of bad ones, and whether it votes says nothing. Shares and accuracies start at set values, which
from then on weigh as much as one document or one vote; all else comes from the corpus.

Defined cases: a null text has no words and fails the base rules, like every text of fewer than ``MIN_WORDS`` words. Rows
are judged one by one, so repeated rows get equal results; other columns are ignored. An empty table gives no rows."""

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appconv.llm.common import SPACE_CLASS, staged, table

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
THRESHOLD = 0.5
# The estimate ends when no share or accuracy moves by more than this, or after so many rounds.
STEADY, ITERATIONS = 1e-9, 500
# Rules seldom speak against good documents, and each finds only its own kind of bad ones.
START_SHARE = 0.8
START_ON_GOOD, START_ON_BAD = 0.98, 0.3
# Window hashes that a text holds twice or more, up to which a text's windows are looked up in them one after the other.
FEW = 64


class Model(NamedTuple):
    """Share of good documents; of each rule, how often it is right on good and on bad documents if it votes."""

    share: float
    right_on_good: dict[str, float]
    right_on_bad: dict[str, float]


def _repeat_words() -> Column:
    """Words in 3-word windows that the text holds at least twice: windows are hashed, the hashes sorted, equal neighbours
    are repeats. Texts with many repeated windows sort (hash, place) pairs instead of looking hashes up."""
    windows = F.when(
        F.col("n_words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.col("n_words").cast("int") - 3),
            lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    return windows


def _covered(starts: Column) -> Column:
    """Words in windows of three that begin at the ascending places ``starts``."""
    reach = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
    return F.aggregate(reach, F.lit(0), lambda a, b: a + b).cast("long")


def counts(documents: DataFrame) -> DataFrame:
    """doc_id, n_words and the counts the rules read; one row for each row of ``documents``."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = documents.select("doc_id", text.alias("text"), words.alias("words"), lines.alias("lines"))
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("hashes", _repeat_words())
    rows = rows.withColumn("ordered", F.array_sort("hashes"))
    rows = rows.withColumn(
        "twice", F.array_distinct(F.filter("ordered", lambda h, i: (i > 0) & (h == F.get("ordered", i - 1))))
    )
    few = F.filter(
        F.transform("hashes", lambda h, i: F.when(F.array_contains("twice", h), i)), lambda i: i.isNotNull()
    )
    pairs = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("pairs", F.when(F.size("twice") > FEW, pairs))
    equal = lambda p, i: F.coalesce(F.get("pairs", i)["h"] == p["h"], F.lit(False))
    many = F.array_sort(
        F.transform(
            F.filter("pairs", lambda p, i: F.when(i > 0, equal(p, i - 1)).otherwise(False) | equal(p, i + 1)),
            lambda p: p["i"],
        )
    )
    starts = F.when(F.size("twice") == 0, F.array().cast("array<int>")).when(F.size("twice") <= FEW, few).otherwise(many)
    return rows.withColumn("starts", starts).select(
        "doc_id",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("starts")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?…:;\"»”)]\s*$"))).cast("long").alias("n_ended_lines"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]+")).cast("long").alias("n_symbol_runs"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )


def rules() -> dict[str, Column]:
    """Name -> vote: 1 good, 0 bad, null abstains."""

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 1)

    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    length = ratio("word_chars", "n_words")
    return {
        "enough_words": vote(F.col("n_words") < MIN_WORDS, F.col("n_words") >= 2 * MIN_WORDS),
        "word_length": vote((length < 2.5) | (length > 12), length.between(3.5, 10)),
        "symbols": vote(ratio("n_symbols", "n_words") > 0.1, ratio("n_symbols", "n_words") < 0.02),
        "symbol_words": vote(ratio("n_symbol_runs", "n_words") > 0.2, ratio("n_symbol_runs", "n_words") < 0.02),
        "repeated_lines": vote(ratio("n_dup_lines", "n_lines") > 0.3, F.col("n_dup_lines") == 0),
        "repeated_words": vote(ratio("n_repeat_words", "n_words") > 0.3, ratio("n_repeat_words", "n_words") < 0.1),
        "ended_lines": vote(ratio("n_ended_lines", "n_lines") < 0.2, ratio("n_ended_lines", "n_lines") > 0.6),
        "capitals": vote(ratio("n_capitals", "word_chars") > 0.4, ratio("n_capitals", "word_chars") < 0.15),
    }


def _weights(right_on_good: list[float], right_on_bad: list[float]) -> list[tuple[float, float]]:
    """What a bad and what a good vote of each rule add to the log odds of being good."""
    return [
        (math.log((1 - g) / b), math.log(g / (1 - b))) for g, b in zip(right_on_good, right_on_bad, strict=True)
    ]


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], names: list[str]) -> Model:
    """Expectation-maximisation over (votes, documents)."""
    start = [[START_ON_GOOD] * len(names), [START_ON_BAD] * len(names)]
    share, right = START_SHARE, start
    total = sum(n for _, n in patterns)
    for _ in range(ITERATIONS):
        prior, weight = math.log(share / (1 - share)), _weights(*right)
        good = 0.0
        hits = [[0.0] * len(names), [0.0] * len(names)]
        cast = [[0.0] * len(names), [0.0] * len(names)]
        for votes, n in patterns:
            odds = prior + sum(w[v] for v, w in zip(votes, weight, strict=True) if v is not None)
            p = 1 / (1 + math.exp(-odds))
            good += n * p
            for j, v in enumerate(votes):
                if v is not None:
                    cast[0][j] += n * p
                    cast[1][j] += n * (1 - p)
                    hits[1 - v][j] += n * (p if v else 1 - p)
        before = [share, *right[0], *right[1]]
        share = (good + START_SHARE) / (total + 1)
        right = [
            [(h + s) / (c + 1) for h, c, s in zip(*of_class, strict=True)] for of_class in zip(hits, cast, start, strict=True)
        ]
        if max(abs(x - y) for x, y in zip(before, [share, *right[0], *right[1]], strict=True)) < STEADY:
            break
    return Model(share, dict(zip(names, right[0], strict=True)), dict(zip(names, right[1], strict=True)))


def fit(voted: DataFrame, names: list[str]) -> Model:
    patterns = voted.groupBy(*names).count().collect()
    return estimate([(tuple(r[n] for n in names), r["count"]) for r in sorted(patterns, key=str)], names)


def posterior(model: Model) -> Column:
    """Probability of being good, from the columns of votes."""
    odds = F.lit(math.log(model.share / (1 - model.share)))
    weights = _weights(list(model.right_on_good.values()), list(model.right_on_bad.values()))
    for name, (bad, good) in zip(model.right_on_good, weights, strict=True):
        odds = odds + F.when(F.col(name) == 1, good).when(F.col(name) == 0, bad).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def supervise(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents (doc_id, text) -> counts, base_failed, kept, quality."""
    votes = rules()
    counted = staged(counts(documents))
    voted = counted.select("*", *[v.alias(name) for name, v in votes.items()])
    model = fit(voted, list(votes))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return voted.select(*counted.columns, failed.alias("base_failed"), posterior(model).alias("quality")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= threshold)
    )


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supervise(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "quality",
    )
