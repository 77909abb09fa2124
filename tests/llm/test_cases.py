"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from appconv.llm import contamination, html_text, language, lines, mixing, near_copies, passages, quality, url_rules, warc
from appconv.llm.lines import PerfectHash
from appconv.llm.links import components
from appconv.llm.order import sorted_rows
from appconv.llm.suffix import suffix_array
from tests.llm import brute

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, found string, kept string, text_hash int, rest int"


def prose(seed, words):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6))) for _ in range(words))


LONG = "\n".join(prose(1000 + k, 40) for k in range(700))


@pytest.fixture(scope="module")
def texts():
    shared = prose(1, 30)
    base = prose(2, 60)
    return [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, "one"),
        (5, base),
        (6, base),
        (6, base),
        (7, base + " tail"),
        (8, shared + "\n" + prose(3, 20)),
        (9, shared.upper() + " \n" + prose(4, 20)),
        (10, shared + "\n" + shared + "\né" + prose(5, 15)),
        (11, LONG),
        (12, "x " + LONG),
        (None, base),
        (None, None),
        (13, "one"),
        (14, "naïve café " * 15),
    ]


@pytest.fixture(scope="module")
def documents(spark, texts):
    rows = [(i, t, "en" if t and i != 5 else None, "s" if i else None, len(t or ""), "f", "k", 3, 4) for i, t in texts]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


def key(row):
    return tuple((x is not None, x) for x in row)


def test_lines(documents, nothing, texts):
    got = [tuple(r) for r in lines.judge(documents).collect()]
    assert sorted(got, key=key) == sorted(brute.lines(texts), key=key)
    assert lines.judge(nothing).count() == 0
    kept = lines.drop_repeated(documents)
    assert kept.columns == documents.columns
    assert sorted([(r.doc_id, r.text, r.n_chars) for r in kept.collect()], key=key) == sorted(
        [(i, t, len(t)) for i, _, _, t in brute.lines(texts)], key=key
    )


def test_lines_with_many_shards_and_copies(documents, texts):
    got = lines.judge(documents, shard_keys=7, questions=3, min_documents=2, min_chars=3)
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted(brute.lines(texts, 3, 2), key=key)


def test_perfect_hash_is_minimal():
    import numpy as np

    hashes = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    found = PerfectHash.build(hashes).find(hashes)
    assert sorted(found.tolist()) == list(range(5000))
    assert PerfectHash.build(hashes[:0]).find(hashes[:3]).tolist() == [-1] * 3


def test_passages(documents, nothing, texts):
    got = [tuple(r) for r in passages.remove_repeats(documents).collect()]
    assert sorted(got, key=key) == sorted(brute.repeats(texts, 13), key=key)
    assert passages.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize(("window", "hot", "block"), [(3, 5000, 40), (3, 2, 40), (7, 1, 5), (5, 0, 1000), (13, 3, 10)])
def test_passages_of_a_small_vocabulary(spark, window, hot, block):
    """Few words, so that matches begin and end everywhere."""
    draw = random.Random(window)
    rows = [(k // 2, " ".join(draw.choice("abcde") for _ in range(draw.randint(0, 60)))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = passages.remove_repeats(docs, window, hot_segments=hot, block_segments=block)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute.repeats(rows, window))


@pytest.mark.parametrize("coarse", [3, 1024])
def test_passages_over_many_buckets(spark, monkeypatch, coarse):
    """Buckets of a few bytes, reached directly or by way of coarse ones; hot anchors split down to single windows."""
    monkeypatch.setattr(passages, "BUCKET_BYTES", 150)
    monkeypatch.setattr(passages, "COARSE_BUCKETS", coarse)
    draw = random.Random(coarse)
    common = prose(5, 20)
    rows = [(k // 2, " ".join([prose(k % 9, 12), common if k % 3 else "", prose(100 + k, draw.randint(0, 20))])) for k in range(60)]
    rows += [(70 + k, "a b " * 30) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = passages.remove_repeats(docs, hot_segments=2, block_segments=50)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute.repeats(rows, 13))


def test_packs_follow_the_anchors():
    """However many buckets there are, a pack has no more rows than anchors, and nothing is lost."""
    import numpy as np

    draw = np.random.default_rng(1)
    key = draw.integers(0, 1 << 63, 3000, dtype=np.uint64)
    key[:1500] = key[1500:]
    doc, code = draw.integers(0, 400, 3000), draw.integers(0, 1 << 40, 3000)
    for buckets in (1, 16, 900, 90_000, 3_000_000):
        packs = passages._pack(key, doc, code, buckets, 1)
        assert len(packs) <= 3000 + 3000
        (k, d, c), passed = passages._unpacked(packs)
        whole = {(a, b, e) for a, b, e in zip(key.tolist(), doc.tolist(), code.tolist(), strict=True)}
        assert {*zip(k.tolist(), d.tolist(), c.tolist(), strict=True), *zip(*(x.tolist() for x in passed), strict=True)} == whole
    fine = next(passages._repacker(64, 8)(iter([passages._pack(key, doc, code, 8, 1)])))
    assert sorted(fine["bucket"]) == sorted(set(fine["bucket"])) and (fine["coarse"] == fine["bucket"] // 8).all()
    assert sorted(passages._unpacked(fine)[0][2].tolist()) == sorted(passages._unpacked(passages._pack(key, doc, code, 8, 1))[0][2].tolist())


def test_anchors_do_not_depend_on_the_neighbours():
    texts = [passages.words_of(prose(k, 10 + 7 * k)) for k in range(8)] + [[], [b"x"] * 40]
    number = passages._WordHashes()
    owner, key, code = passages.anchors(texts, number, 13)
    for k, text in enumerate(texts):
        _, own, codes = passages.anchors([text], number, 13)
        assert own.tolist() == key[owner == k].tolist() and codes.tolist() == code[owner == k].tolist()
        first, last = passages.decoded(codes)
        assert [w for a, b in zip(first, last, strict=True) for w in range(a, b + 1)] == list(range(max(0, len(text) - 12)))


def test_suffix_array_order():
    import numpy as np

    ids = np.random.default_rng(3).integers(0, 3, 400)
    starts = np.flatnonzero(ids)
    order = suffix_array(ids, starts, 50)
    ranked = [ids[p : p + 50].tolist() for p in order]
    assert ranked == sorted(ranked) and sorted(order.tolist()) == starts.tolist()


def test_near_copies(documents, nothing, texts):
    got = near_copies.group(documents, 2).collect()
    known = {i: t for i, t in texts if i is not None}
    want = brute.near(list(known.items()), 2)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert sorted((r.doc_id is None, r.n_shingles) for r in got) == sorted(
        (i is None, len(brute.shingles(t, 2))) for i, t in texts
    )
    assert all(r.kept for r in got if r.doc_id is None)
    assert near_copies.group(nothing).count() == 0
    kept = near_copies.deduplicate(documents, 2)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, p in want.items() if i == p} | {None}


def test_near_copies_in_chains(spark):
    """Neighbours of a chain are similar, its ends are not; and a group with each text a little different."""
    words = prose(7, 300).split()
    rows = [(k, " ".join(words[3 * k : 3 * k + 100])) for k in range(40)]
    rows += [(100 + k, " ".join(words[:k] + ["other"] + words[k + 1 : 150])) for k in range(60)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.group(docs, 2).collect()}
    assert got == brute.near(rows, 2)


def test_parities_differ_in_no_more_places_than_sets():
    import numpy as np

    draw = np.random.default_rng(4)
    for size in (0, 1, 30, 400, 3000):
        common = draw.integers(0, 1 << 63, size, dtype=np.uint64)
        for own in (0, 1, 40):
            x, y = (np.unique(np.concatenate([common, draw.integers(0, 1 << 63, own, dtype=np.uint64)])) for _ in "xy")
            bits = np.bitwise_count((near_copies.parities(x) ^ near_copies.parities(y)).view(np.uint64)).sum()
            assert bits <= np.setxor1d(x, y).size
            assert len(near_copies.parities(x)) == near_copies.PARITIES // 64


def test_near_copies_around_the_threshold(spark):
    """Copies with several words changed, most pairs a little below or above the similarity; short and long texts, ids repeated."""
    draw = random.Random(6)
    rows = []
    for base, words, copies, most in ((0, 120, 90, 6), (1000, 2500, 25, 60), (2000, 9, 12, 1)):
        own = prose(base + 1, words).split()
        for k in range(copies):
            text = list(own)
            for _ in range(draw.randint(0, most)):
                text[draw.randrange(len(text))] = draw.choice(("some", "other", f"new{draw.randrange(9)}"))
            rows.append((base + k, " ".join(text)))
    docs = spark.createDataFrame([*rows[::-1], *rows[:20]], "doc_id long, text string").repartition(4)
    got = near_copies.group(docs, 5).collect()
    assert {r.doc_id: r.component_id for r in got} == brute.near(rows, 5)
    assert len(got) == len(rows) + 20


def test_components(spark):
    draw = random.Random(5)
    path = list(range(200))
    draw.shuffle(path)
    links = list(zip(path, path[1:], strict=False)) + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(200)} | {1000 + k: 1000 for k in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


BENCHMARK = "item_id long, text string, kept int"


def test_contamination(spark, documents, nothing, texts):
    items = [(1, prose(1, 30)), (1, prose(1, 30)), (20, "One"), (3, None), (4, "... !"), (5, prose(2, 20)), (None, prose(1, 14))]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], BENCHMARK)
    known = [(i, t) for i, t in items if i is not None]
    for block_bytes in (1 << 20, 100):
        found = contamination.find(documents, benchmark, "hits", block_bytes=block_bytes)
        got = [(r.doc_id, r.hits.n_words, sum(s.end - s.start for s in r.hits.hits), list(r.hits["items"])) for r in found.collect()]
        want = [(i, *contamination_of(t, known)) for i, t in texts]
        assert sorted(got, key=key) == sorted(want, key=key)
    clean = contamination.decontaminate(documents, benchmark)
    assert clean.columns == documents.columns
    assert clean.count() == sum(not (h > 0 and 20 * h >= n) for n, h, _ in (contamination_of(t, known) for _, t in texts))
    assert contamination.decontaminate(nothing, benchmark).count() == 0
    empty = spark.createDataFrame([], BENCHMARK)
    assert contamination.decontaminate(documents, empty).count() == len(texts)
    assert contamination.longest_matches(documents, empty).count() == 0


def contamination_of(text, items):
    return brute.contamination(text if not text or len(text) < 5000 else None, items) if text and len(text) < 5000 else (
        len((text or "").split()),
        0,
        [],
    )


def test_longest_match_of_each_document(spark):
    draw = random.Random(4)
    one, two = (prose(k, 40).split() for k in (31, 32))
    items = [(7, " ".join(one)), (10, " ".join(two)), (9, " ".join(two)), (None, " ".join(one[:20])), (3, "Lone Word"), (5, "a " * 30), (6, None)]
    texts = [None, "", "lone word", " ".join(one), " ".join(two[:13]), " ".join(two[:12]), "a " * 50, "a, A; " * 8]
    for _ in range(40):
        parts = []
        for _ in range(4):
            source, i = draw.choice((one, two)), draw.randrange(30)
            parts += source[i : i + draw.randrange(5, 30)] + ["other"] * draw.randrange(2)
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute.longest_match(t, items) for i, t in enumerate(texts)}
    for block_bytes in (1 << 20, 100):
        found = contamination.find(docs, benchmark, "found", block_bytes=block_bytes).collect()
        assert len(found) == len(texts) + 1
        for r in found:
            assert (tuple(r.found.longest) if r.found.longest else None) == want[r.doc_id], texts[r.doc_id]


def test_longest_matches(spark):
    item = prose(8, 40).split()
    docs = [(5, " ".join(["x", *item[10:30], "y"])), (2, " ".join(["z", "z", *item[10:30]])), (9, " ".join(item[12:26]))]
    got = contamination.longest_matches(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item), 0)], BENCHMARK)
    )
    assert {r.item_at: (r.length, r.doc_id, r.doc_at) for r in got.collect()} == {
        k: (30 - k, 2, 2 + k - 10) for k in range(10, 18)
    }


def test_weak_supervision(documents, nothing, texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = [(r.doc_id, *(r[n] for n in names)) for r in quality.supervise(documents).collect()]
    assert sorted(got, key=key) == sorted([(i, *brute.counts(t)) for i, t in texts], key=key)
    assert quality.supervise(nothing).count() == 0


def test_many_repeated_windows(spark):
    draw = random.Random(9)
    rows = [(k, " ".join(draw.choice("abcdefghij") for _ in range(900 * k))) for k in range(4)]
    got = quality.counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {i: brute.counts(t)[-1] for i, t in rows}


def test_estimate_finds_the_accuracies():
    draw = random.Random(3)
    patterns = {}
    for _ in range(20000):
        good = draw.random() < 0.8
        votes = tuple(
            None if draw.random() < 0.2 else int(draw.random() < 0.98) if good else int(draw.random() >= bad)
            for bad in (0.8, 0.6, 0.7, 0.5)
        )
        patterns[votes] = patterns.get(votes, 0) + 1
    model = quality.estimate(list(patterns.items()), list("abcd"))
    assert math.isclose(model.share, 0.8, abs_tol=0.03)
    assert all(math.isclose(model.right_on_bad[n], b, abs_tol=0.06) for n, b in zip("abcd", (0.8, 0.6, 0.7, 0.5), strict=True))


def plain_estimate(patterns, rounds=2000):
    """Expectation-maximisation without priors, in numpy: share, how often each rule says good and bad in each class."""
    votes = np.array([[-1 if v is None else v for v in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    share, says_good = 0.8, np.array([np.full(votes.shape[1], 0.98), np.full(votes.shape[1], 0.7)])
    for _ in range(rounds):
        logs = np.stack(
            [np.where(votes == 1, np.log(g + 1e-300), np.where(votes == 0, np.log(1 - g + 1e-300), 0)).sum(1) for g in says_good]
        )
        p = 1 / (1 + np.exp(np.clip(np.log(1 - share) + logs[1] - np.log(share) - logs[0], -700, 700)))
        share = (n * p).sum() / n.sum()
        for k, w in enumerate((n * p, n * (1 - p))):
            says_good[k] = (w[:, None] * (votes == 1)).sum(0) / (w[:, None] * (votes >= 0)).sum(0)
    return share, says_good, dict(zip([v for v, _ in patterns], p, strict=True))


def test_estimate_is_that_of_plain_expectation_maximisation(spark):
    names = list(quality.rules())
    counted = quality.counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    grouped = counted.select(*[v.alias(n) for n, v in quality.rules().items()]).groupBy(*names).count().collect()
    patterns = [(tuple(r[n] for n in names), r["count"]) for r in sorted(grouped, key=str)]
    model = quality.estimate(patterns, names)
    share, says_good, kept = plain_estimate(patterns)
    assert math.isclose(model.share, share, abs_tol=0.005)
    for j, name in enumerate(names):
        assert math.isclose(model.right_on_good[name], says_good[0][j], abs_tol=0.005)
        assert math.isclose(model.right_on_bad[name], 1 - says_good[1][j], abs_tol=0.02)
    judged = spark.createDataFrame([p for p, _ in patterns], ", ".join(f"{n} int" for n in names))
    got = {tuple(r[n] for n in names): r.p for r in judged.withColumn("p", quality.posterior(model)).collect()}
    assert {v: p >= 0.5 for v, p in got.items()} == {v: p >= 0.5 for v, p in kept.items()}


def test_estimate_where_all_votes_agree_or_none_is_cast():
    for patterns in ([], [((1, 1, 1), 10**12)], [((0, 0, 0), 10**12)], [((None, None, None), 7)]):
        model = quality.estimate(patterns, list("abc"))
        values = [model.share, *model.right_on_good.values(), *model.right_on_bad.values()]
        assert all(0 < v < 1 for v in values)


def test_language(spark, documents, nothing, texts):
    found = language.identify(documents).collect()
    assert sorted(key((r.doc_id,)) for r in found) == sorted(key((i,)) for i, _ in texts)
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred == "en" for r in found if r.doc_id in (4, 5, 11))
    assert language.identify(nothing).count() == 0
    kept = language.accepted(documents)
    assert kept.columns == documents.columns and kept.filter("doc_id in (1, 2, 3)").count() == 0
    unlabelled = documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def test_gradients_of_the_network():
    import numpy as np

    draw = np.random.default_rng(1)
    weights = {k: v.astype(np.float64) for k, v in language.start_weights(3, 4).items()}
    x, labels = draw.integers(1, 9, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    mask = np.ones((7, 5))
    mask[5:, 2] = 0
    _, found = language.gradients(weights, x, labels, mask)
    for name, values in weights.items():
        for at in (np.unravel_index(k, values.shape) for k in draw.choice(values.size, min(12, values.size), replace=False)):
            kept, losses = values[at], []
            for step in (1e-3, -1e-3):
                values[at] = kept + step
                losses.append(language.gradients(weights, x, labels, mask)[0])
            values[at] = kept
            assert abs((losses[0] - losses[1]) / 2e-3 - found[name][at]) < 1e-5


def test_mixing(spark, nothing):
    rows = [(k, prose(k, k % 40), "big" if k % 3 else None, k) for k in range(300)]
    rows += [(5, prose(5, 5), "small", 0)] * 3 + [(None, None, "none", 0), (400, "", "none", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    one, many = (sorted([tuple(r) for r in mixing.mix(docs, range_rows=n).collect()], key=key) for n in (50_000, 10))
    assert one == many and len(one) == len(rows)
    size, taken = {}, {}
    for _, source, n, source_size, target, got in one:
        assert 0 <= got <= 2 * n
        size[source] = size.get(source, 0) + n
        taken[source] = taken.get(source, 0) + got
    for _, source, _, source_size, target, _ in one:
        assert source_size == size[source] and abs(taken[source] - target) <= 1 and target <= 2 * source_size
    assert math.isclose(sum(taken.values()), 1.5 * sum(size.values()), abs_tol=len(size))
    assert mixing.mix(nothing).count() == 0


def test_mixing_with_weights_far_from_one(spark):
    """Low and uneven weights, one id on a third of the rows, a very long text: ranges stay even and targets are met."""
    rows = [(7 if k % 3 == 0 else k, f"s{k % 2}", "a b " * (1 + k % 4)) for k in range(6000)] + [(9999, "s0", "w " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    weight = F.when(F.col("source") == "s0", 0.05).otherwise(0.4)
    got = mixing.mix(docs, weight, range_rows=300).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    for source in ("s0", "s1"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    keyed = docs.select("doc_id", F.lit(1).alias("size"), mixing.sampling_key(weight).alias("key"))
    ranges = [r["count"] for r in sorted_rows(keyed, [F.col("key"), F.col("doc_id")], 20).groupBy("range").count().collect()]
    assert max(ranges) < 3 * len(rows) / 20


PAGES = "page_id long, url string, html string, digest int, text string, host string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "w " * 600 + "</p>"
    rows = [
        (1, "http://a.net/x", big),
        (2, None, big),
        (None, "http://a.net/ x\n", big),
        (3, "b", "é" * 400),
        (4, "c", "é" * 400),
        (5, "", None),
        (6, "HTTP://Sub.Example.NET/en/1?x#y", "short"),
        (7, "https://example.com/de/", "short"),
        (7, "https://example.com/de/", "short"),
        (8, "https://notexample.com/de/", "é" * 500),
        (9, "x://org/fr/a", "é" * 500),
        (10, "x://net", "<html>\r\n\r\n" * 200_000),
    ]
    return spark.createDataFrame([(*r, 0, "t", "h") for r in rows], PAGES).repartition(3)


def test_warc(spark, pages, tmp_path):
    warc.write_archives(pages, f"file://{tmp_path}/streams")
    index = warc.normalise(spark, f"file://{tmp_path}/streams", f"file://{tmp_path}/members")
    got = sorted([tuple(r)[:2] + tuple(r)[3:] for r in warc.read_archives(index).collect()], key=key)
    big, two, tall = 7 + 1200, 1000, 2_000_000
    want = [(1, big, "revisit", 2), (2, big, "response", None), (None, big, "revisit", 2), (3, 800, "response", None)]
    want += [(4, 800, "response", None), (5, 0, "response", None), (6, 5, "response", None), (7, 5, "response", None)]
    want += [(7, 5, "response", None), (8, two, "revisit", 9), (9, two, "response", None), (10, tall, "response", None)]
    assert sorted(want, key=key) == got
    import gzip

    assert sorted(p.name.removesuffix(".idx") for p in (tmp_path / "members").glob("*.idx")) == sorted(
        p.name for p in (tmp_path / "members").glob("*.gz")
    )
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "streams").glob("*.gz")))
    members = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "members").glob("*.gz")))
    assert whole == members


def test_a_payload_of_most_pages_is_split(spark):
    """Pages with one payload do not all go to one task."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        # Equal payloads are small when compressed.
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    body = F.when(F.col("id") % 2 == 0, F.repeat(F.lit("a"), 1500)).otherwise(F.concat(F.repeat(F.lit("b"), 1500), (F.col("id") % 500).cast("string")))
    pages = spark.range(0, 6000, 1, 8).select(F.col("id").alias("page_id"), F.lit("http://x").alias("url"), body.alias("html"))
    found = warc.records(pages)
    assert found.count() == 6000
    tasks = found.select(F.spark_partition_id().alias("p"), F.crc32(F.col("value").cast("binary")).alias("c"))
    most = max(r["n"] for r in tasks.groupBy("p").agg(F.count("*").alias("n"), F.max("c")).collect())
    found.collect()
    assert "SortMergeJoin(skew=true)" in found._jdf.queryExecution().executedPlan().toString()
    assert most < 2500
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_empty_archives(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], PAGES), f"file://{tmp_path}/streams")
    index = warc.normalise(spark, f"file://{tmp_path}/streams", f"file://{tmp_path}/members")
    assert warc.read_archives(index).count() == 0


def test_url_rules(spark, pages):
    rules = spark.createDataFrame([*url_rules.RULES, (None, "/", "block"), ("", "", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()}
    assert got[6] == ("sub.example.net", "/en/1", "example.net/en/", "allow")
    assert got[7] == ("example.com", "/de/", "example.com/de/", "block")
    assert got[8] == ("notexample.com", "/de/", None, "allow")
    assert got[9] == ("org", "/fr/a", "org/fr/", "allow")
    assert got[1] == ("a.net", "/x", "net/", "block")
    assert got[10] == ("net", "", None, "allow")
    assert got[2] == got[5] == got[3] == ("", "", None, "allow")
    assert url_rules.judge(spark.createDataFrame([], PAGES), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    """Many listed keys and more others, so that several levels are needed."""
    keys = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    levels = url_rules.build_cascade(keys)
    assert len(levels) > 2
    assert keys.filter(url_rules.member(F.col("key"), levels) != F.col("listed")).count() == 0


def test_large_rule_lists_are_sharded(spark):
    """Filters beyond the bound: the same verdicts from several cascades. Repeated rows and very long urls."""
    draw = random.Random(9)
    hosts = [f"h{k}.example" for k in range(60)]
    rules = spark.createDataFrame(
        [(h, draw.choice(["", "/", "/a/"]), draw.choice(["block", "allow"])) for h in hosts if draw.random() < 0.6], "host string, path string, verdict string"
    )
    urls = [f"http://{draw.choice(['', 'www.'])}{draw.choice(hosts)}{draw.choice(['', '/', '/a/x', '/b?c'])}" for _ in range(300)]
    urls += [f"http://{hosts[0]}/a/" + "x" * 200_000, "http://" + "y" * 100_000, urls[0], None]
    rows = [(None if k == 5 else k % 250, u, None, 0, "t", "h") for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, PAGES)
    universe = spark.range(1000).select(F.col("id").cast("string").alias("key"), (F.col("id") < 300).alias("block"), (F.col("id") > 800).alias("allow"))
    assert url_rules.shard_count(universe, 16) > 3 and url_rules.shard_count(universe, 1 << 20) == 1
    one = sorted(map(tuple, url_rules.judge(pages, rules).collect()), key=key)
    several = sorted(map(tuple, url_rules.judge(pages, rules, max_bytes=8).collect()), key=key)
    assert one == several and len(one) == len(urls)
    listed = {r.host: (r.path, r.verdict) for r in rules.collect()}
    for _, host, path, rule, verdict in one:
        mine = listed.get(host.removeprefix("www."))
        assert (rule, verdict) == ((host.removeprefix("www.") + mine[0], mine[1]) if mine and path.startswith(mine[0]) else (None, "allow"))


def test_html_cases(spark, pages):
    tree = html_text.grow(*html_text.labelled_table())
    read = lambda page: html_text.main_text(tree, page)
    body = "word " * 30
    assert read(None) == read("") == ""
    assert read(f"<article><p>a &amp; b &lt;c&gt;\n  {body}<br>x</p>") == f"a & b <c> {body}x"
    assert read(f"<article><p>{body}<script>if (a < b) {{'</p>'}}</script></p><style>x") == body.strip()
    assert read(f"<article><p>{body}</article><footer>c</footer><!-- {body}") == body.strip()
    assert read(f"<article><p>{body}</p></article><div id='comments'><p>{body}</p></div><aside>{body}</aside>") == body.strip()
    assert read(f"<article><p>{body}</p><p class='cut") == body.strip()
    assert read("<p>" + "w " * 200_000 + "</p>") == ("w " * 200_000).strip()
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text"] and got.count() == 12
    # Extra columns clash with the result's; repeated rows get equal texts.
    assert [r.text for r in got.filter("page_id = 7").collect()] == [read("short")] * 2


def made_page(draw, kind):
    """A page and its main blocks. ``kind``: main text in an article, in a named division, or in neither."""
    text = lambda n: " ".join(draw.choice("alpha beta gamma delta".split()) for _ in range(n))
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>{text(draw.randint(1, 3))}</a></li>" for k in range(draw.randint(3, 9))) + "</ul>"
    main = [text(draw.randint(4, 9)), *(text(draw.choice([draw.randint(25, 120), draw.randint(8, 20)])) for _ in range(draw.randint(3, 9))), text(60)]
    inner = f"<h1>{main[0]}</h1>" + "".join(f"<p>{x}</p>" for x in main[1:])
    name = lambda n: "" if kind == "bare" else f" class='{n}'"
    body = {"article": f"<article class='post notice'>{inner}</article>", "named": f"<div id='content'>{inner}</div>"}.get(kind, f"<div>{inner}</div>")
    before = f"<div{name('main-menu')}>{menu}</div><div{name('ad')}>{text(draw.randint(2, 7))}</div>"
    behind = f"<div{name('share-buttons')}>{menu}</div><div{name('site-footer')}>{text(draw.randint(2, 8))}</div>"
    return f"<html><head><title>t</title></head><body>{before}{body}{behind}</body></html>", main


@pytest.mark.parametrize("kind, least", [("article", 1.0), ("named", 0.97), ("bare", 0.93)])
def test_html_of_made_pages(kind, least):
    """Blocks are told apart by what is around them where neither tags nor names do."""
    tree = html_text.grow(*html_text.labelled_table())
    draw, right, total = random.Random(kind), 0, 0
    for _ in range(150):
        page, main = made_page(draw, kind)
        found, wanted = html_text.blocks(page), list(main)
        kept = html_text.classify(tree, html_text.features(found)).tolist()
        for block, keep in zip(found, kept, strict=True):
            is_main = bool(wanted) and block.text == wanted[0] and block.link_density < 1
            if is_main:
                wanted.pop(0)
            right, total = right + (keep == is_main), total + 1
        assert not wanted
    assert right >= least * total


def test_html_tree_asks_the_neighbours():
    def asked(node):
        return set() if node.low is None else {html_text.FEATURES[node.feature]} | asked(node.low) | asked(node.high)

    used = asked(html_text.grow(*html_text.labelled_table()))
    assert {"words", "words_before", "words_behind"} <= used
    # Without the names little is lost.
    rows, labels = html_text.labelled_table()
    rows[:, html_text.FEATURES.index("in_furniture_name")] = 0
    tree = html_text.grow(rows, labels)
    assert (html_text.classify(tree, rows) == labels).mean() > 0.9


def test_html_names_count_as_whole_words():
    tree = html_text.grow(*html_text.labelled_table())
    body, tail = "word " * 40, "and so on it goes"
    for page in (
        "<article class='post notice'><p>{}</p><p>{}</p></article>",
        "<div class='story related-topics'><h1>A title of it</h1><p>{}</p><p>{}</p></div>",
        "<div class='commentary'><p>{}</p><p>{}</p><p>" + body + "</p></div>",
        "<div class='subscription-history'><p>{}</p><p>{}</p><p>" + body + "</p></div>",
        "<main><div class='header-image-caption'><p>{}</p></div><p>{}</p></main>",
    ):
        found = html_text.main_text(tree, page.format(body, tail))
        assert body.strip() in found and tail in found


def test_html_of_broken_markup_is_read_in_one_pass():
    start = time.perf_counter()
    for page in ("<b>x</i>" * 130_000, "<b>x" * 250_000, "<p><i>x</b></p>" * 70_000, "<a title='x>" * 80_000):
        html_text.blocks(page)
    assert time.perf_counter() - start < 12


def test_letters_are_those_of_the_letter_categories():
    assert [language.has_letter(t) for t in ("²½①Ⅻ", "12 _.,!", "", "É", "1a", "ж", "漢", "ʰ")] == [False, False, False, True, True, True, True, True]


def test_hit_at_the_end_of_a_very_long_text(spark):
    item = prose(70, 30)
    docs = spark.createDataFrame([(1, LONG.replace("\n", " ") + " " + item), (2, LONG), (3, item)], "doc_id long, text string")
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    found = contamination.find(docs, items, "found").withColumn("n_hit", contamination.n_hit("found"))
    got = {r.doc_id: (r.found.n_words, r.n_hit, [tuple(h) for h in r.found.hits]) for r in found.collect()}
    assert got == {1: (28030, 30, [(28000, 28030)]), 2: (28000, 0, []), 3: (30, 30, [(0, 30)])}


@pytest.mark.parametrize("empty", ["documents", "benchmark"])
def test_pipeline_on_empty_tables(spark, tmp_path, empty):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, prose(1, 40), "en", "s", 200), (2, None, "en", "s", None), (None, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([(1, prose(2, 20))], "item_id long, text string")
    for name, table in (("documents", docs), ("benchmark", items)):
        (table.limit(0) if name == empty else table).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in got] == ([] if empty == "documents" else [1])
