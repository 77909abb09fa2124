"""Registered queries against DuckDB where SQL expresses them, and against plain versions."""

import html
import re
import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from appconv.llm import queries
from tests.comparing import compare, connect
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()
RUN = queries.queries()


def rows(columns, name="documents", folder=FOLDER):
    return duckdb.sql(f"select {columns} from '{folder}/{name}.parquet'").fetchall()


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in RUN) == list(range(1, 14))
    assert set(SQL) == {n for n in RUN if int(n[2:].split("_")[0]) in (1, 2, 3, 5, 7, 8, 11, 12, 13)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    problems = [p for p in compare(spark, RUN[name], SQL[name], FOLDER, connect(FOLDER)) if "boolean" not in p]
    assert problems == []


def test_weak_supervision(spark):
    got = {r.doc_id: r for r in RUN["op4_weak_supervision"](spark, FOLDER).collect()}
    quality = dict(rows("doc_id, quality", "labels"))
    right = Counter()
    for i, text in rows("doc_id, text"):
        r = got[i]
        n, chars, symbols, lines, repeated = brute.counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (r.kept and r.base_failed)
        if i in quality and not r.base_failed:
            right[r.kept == bool(quality[i])] += 1
    assert right[True] >= 0.95 * sum(right.values())


def test_language_on_held_out_documents(spark):
    got = {r.doc_id: r for r in RUN["op6_language_id"](spark, FOLDER).collect()}
    right = Counter()
    for i, lang in rows("doc_id, lang"):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i].score <= 1
        if got[i].held_out:
            right[got[i].lang_pred == lang] += 1
    assert right[True] >= 0.9 * sum(right.values())


def test_html_text(spark):
    """The article of every page, cut out with plain patterns."""
    plain = lambda x: " ".join(html.unescape(re.sub(r"<[^>]*(>|$)", "", re.sub(r"<br\s*/?>", " ", x))).split())
    pages = dict(rows("page_id, html", "pages"))
    got = RUN["op9_html_text"](spark, FOLDER).collect()
    for r in got:
        assert r.n_chars == len(r.text)
        inner = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", pages[r.page_id], flags=re.S)
        article = re.search(r"<article\b[^>]*>(.*?)(</article>|\Z)", inner, re.S)
        parts = re.split(r"</?(?:p|h\d|li|ul|ol|div)\b[^>]*>", article[1] if article else "")
        assert r.text == "\n".join(x for x in map(plain, parts) if x)
    assert {r.page_id for r in got} == set(pages)


def test_near_copies(spark):
    want = brute.near(rows("doc_id, text"), 2)
    sizes = {i: len(brute.shingles(t, 2)) for i, t in rows("doc_id, text")}
    got = {r.doc_id: r for r in RUN["op10_minhash_join"](spark, FOLDER).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_pipeline_stages(spark):
    """Each stage against a plain version on what its predecessor kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    start = dict(rows("doc_id, text"))
    assert all(kept["language_id"][i].text == start[i] for i in kept["language_id"])
    assert len(kept["language_id"]) >= 0.97 * len(start)
    before = [(i, r.text) for i, r in kept["language_id"].items()]
    assert {i: r.text for i, r in kept["line_dedup"].items()} == {i: t for i, _, _, t in brute.lines(before)}
    assert all(len(r.text) == r.n_chars for r in kept["line_dedup"].values())
    part = brute.near([(i, r.text) for i, r in kept["line_dedup"].items()], 5)
    assert set(kept["near_dedup"]) == {i for i, p in part.items() if i == p}
    items = rows("item_id, text", "benchmark")
    clean = set()
    for i, r in kept["near_dedup"].items():
        n, hit, _ = brute.contamination(r.text, items)
        if not (hit > 0 and 20 * hit >= n):
            clean.add(i)
    assert set(kept["decontamination"]) == clean
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in last} == clean
    by_source = Counter()
    for r in last:
        by_source[r.source] += r.taken
    assert all(abs(by_source[r.source] - r.target) <= 1 for r in last)
