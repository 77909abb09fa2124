"""Benchmark decontamination with suffix arrays of the training texts.

The words of a batch of documents become one array of word numbers, cut into shards. Each shard gets a suffix array, in
which every suffix of every benchmark item is searched by halving: a range of suffixes that share the first words is
narrowed word by word, for all benchmark suffixes in step. The range at a window's length holds every occurrence of the
window. Occurrences that do not go on to the left are followed to the right as far as the words agree: these are the verbatim
matches that nothing makes longer. They give the hit words, the items and the longest match of each document with its place,
and by them documents are removed. Words outside the benchmark's vocabulary break the array, and suffixes too short before the
next break to hold a window are not indexed.

The benchmark is a stated query set. It is read in blocks of bounded size, each against all documents; documents are never
joined or shuffled.

Defined cases: a null or empty text has no words, no hits and is never contaminated. Items without words have no windows; an
item without item_id hits words but is not counted among the items; item_ids count once. Of equally long matches the first in
the document counts, then the smallest item_id (null last), then the first in the item; without any it is null. Documents are judged row by row, so
repeated rows get equal results, and other columns are kept as they are. An empty table gives no rows, an empty benchmark no
hits."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appconv.llm.common import batches_by_bytes, staged, table
from appconv.llm.suffix import narrow, spread, suffix_array

WINDOW = 13
# A document is contaminated if at least one word of this many is hit.
WORDS_PER_HIT = 20
SHARD_WORDS = 500_000
BLOCK_BYTES = 8 << 20
_PAIRS = 2_000_000

# Digits, lower-cased letters and everything beyond ASCII stay, all else separates words.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

PLACE = "length: int, doc_at: int, item_id: string, item_at: int"
FOUND = f"n_words long, hits array<struct<start: int, end: int>>, items array<string>, longest struct<{PLACE}>"
LONGEST = "item_id string, item_at int, length int, doc_id long, doc_at int"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class _Vocabulary(dict):
    def __missing__(self, word):
        return 0


class Block(NamedTuple):
    """Benchmark items as one array of word numbers; ``starts``, ``widths`` and ``owners`` are those of the windows."""

    vocabulary: dict[bytes, int]
    names: list[str | None]
    ids: np.ndarray
    item: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    widths: np.ndarray
    rank: np.ndarray  # of each item's name

    @classmethod
    def of(cls, items: list[tuple[str | None, str]], window: int) -> "Block":
        vocabulary: dict[bytes, int] = {}
        ids, item, at, starts, widths = [], [], [], [], []
        for number, (_, text) in enumerate(items):
            words = words_of(text)
            width = min(window, len(words))
            for k in range(len(words) - width + 1 if words else 0):
                starts.append(len(ids) + k)
                widths.append(width)
            ids += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words] + [0]
            item += [number] * (len(words) + 1)
            at += range(len(words) + 1)
        names = [n for n, _ in items]
        places = {n: k for k, n in enumerate(sorted(set(names), key=lambda n: (n is None, n or "")))}
        rank = [places[n] for n in names]
        whole = lambda x: np.array(x, np.int64)
        return cls(_Vocabulary(vocabulary), names, *map(whole, (ids, item, at, starts, widths, rank)))


class Shard(NamedTuple):
    ids: np.ndarray
    order: np.ndarray
    first: np.ndarray  # where each document begins
    lengths: np.ndarray

    @classmethod
    def of(cls, texts: list[list[bytes]], block: Block) -> "Shard":
        lengths = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(lengths + 1) - lengths - 1
        ids = np.zeros(int(lengths.sum()) + lengths.size, np.int64)
        number = block.vocabulary.__getitem__
        for start, words in zip(first, texts, strict=True):
            ids[start : start + len(words)] = np.fromiter(map(number, words), np.int64, len(words))
        breaks = np.flatnonzero(ids == 0)
        places = np.flatnonzero(ids)
        left = breaks[np.searchsorted(breaks, places)] - places
        places = places[left >= block.widths.min(initial=WINDOW)]
        longest = int(np.diff(np.flatnonzero(np.concatenate([[0], block.ids]) == 0)).max(initial=1))
        return cls(ids, suffix_array(ids, places, longest), first, lengths)


def _shards(texts: list[str | None], block: Block) -> Iterator[tuple[int, Shard]]:
    """Documents of a batch in shards, with the place of the first one; a document is never cut."""
    begun, held, size = 0, [], 0
    for row, text in enumerate(texts):
        held.append(words_of(text))
        size += len(held[-1])
        if size >= SHARD_WORDS:
            yield begun, Shard.of(held, block)
            begun, held, size = row + 1, [], 0
    if held:
        yield begun, Shard.of(held, block)


def _search(shard: Shard, block: Block, starts: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges and matched lengths of the benchmark suffixes at ``starts``, of at most ``limits`` words."""
    low, high = np.zeros(starts.size, np.int64), np.full(starts.size, shard.order.size, np.int64)
    length = np.zeros(starts.size, np.int64)
    active = np.arange(starts.size) if shard.order.size else np.zeros(0, np.int64)
    depth = 0
    while active.size:
        words = block.ids[np.minimum(starts[active] + depth, block.ids.size - 1)]
        active, words = active[words > 0], words[words > 0]
        a, b = narrow(shard.ids, shard.order, words, low[active], high[active], depth)
        found = a < b
        active, a, b = active[found], a[found], b[found]
        low[active], high[active] = a, b
        depth += 1
        length[active] = depth
        active = active[limits[active] > depth]
    return low, high, length


def _occurrences(shard: Shard, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the shard and numbers of the windows that occur there, in bounded pieces."""
    low, high, length = _search(shard, block, block.starts, block.widths)
    full = np.flatnonzero(length == block.widths)
    sizes = np.cumsum(high[full] - low[full])
    begun = 0
    while begun < full.size:
        before = sizes[begun - 1] if begun else 0
        end = max(begun + 1, int(np.searchsorted(sizes, before + _PAIRS)))
        part = full[begun:end]
        slots, owner = spread(low[part], high[part])
        yield shard.order[slots], part[owner]
        begun = end


class Match(NamedTuple):
    length: int
    doc_at: int
    item_id: str | None
    item_at: int

    def worth(self) -> tuple:
        return -self.length, self.doc_at, self.item_id is None, self.item_id or "", self.item_at


def _matches(shard: Shard, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in the shard, places in the block and lengths of the matches that nothing makes longer."""
    for places, windows in _occurrences(shard, block):
        starts = block.starts[windows]
        # Both arrays end with a break, which is also what comes before their first word.
        before = shard.ids[places - 1]
        begins = (before == 0) | (before != block.ids[starts - 1])
        places, starts, length = places[begins], starts[begins], block.widths[windows][begins]
        active = np.arange(places.size)
        while active.size:
            at = length[active]
            word = block.ids[starts[active] + at]
            active = active[(word > 0) & (word == shard.ids[places[active] + at])]
            length[active] += 1
        yield places, starts, length


def _longest_of_each(held: np.ndarray) -> np.ndarray:
    """Of rows (doc, -length, place in the document, rank of the item, place in the item, item) the first of each document."""
    held = held[np.lexsort(held.T[::-1])]
    return held[np.flatnonzero(np.diff(held[:, 0], prepend=-1))]


def _found(texts: list[str | None], block: Block) -> list[tuple[int, list, list, Match | None]]:
    out = []
    for _, shard in _shards(texts, block):
        cover = np.zeros(shard.ids.size + 1, np.int64)
        pairs = [np.zeros(0, np.int64)]
        best = np.zeros((0, 6), np.int64)
        for places, starts, length in _matches(shard, block):
            np.add.at(cover, places, 1)
            np.add.at(cover, places + length, -1)
            docs, item = np.searchsorted(shard.first, places, side="right") - 1, block.item[starts]
            pairs.append(np.unique(docs * len(block.names) + item))
            rows = np.stack([docs, -length, places - shard.first[docs], block.rank[item], block.at[starts], item], axis=1)
            best = _longest_of_each(np.concatenate([best, rows]))
        hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
        begins, ends = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
        span_doc = np.searchsorted(shard.first, begins, side="right") - 1
        spans: list[list] = [[] for _ in shard.lengths]
        items: list[list] = [[] for _ in shard.lengths]
        longest: list[Match | None] = [None] * shard.lengths.size
        for doc, a, b in zip(span_doc.tolist(), begins.tolist(), ends.tolist(), strict=True):
            spans[doc].append((a - int(shard.first[doc]), b - int(shard.first[doc])))
        for pair in np.unique(np.concatenate(pairs)).tolist():
            doc, item = divmod(pair, len(block.names))
            if block.names[item] is not None:
                items[doc].append(block.names[item])
        for doc, less, doc_at, _, item_at, item in best.tolist():
            longest[doc] = Match(-less, doc_at, block.names[item], item_at)
        out += [
            (int(n), s, sorted(set(i)), m) for n, s, i, m in zip(shard.lengths, spans, items, longest, strict=True)
        ]
    return out


def _longer(one: Match | None, other: Match | None) -> Match | None:
    return min((m for m in (one, other) if m), key=Match.worth, default=None)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in parts of bounded size, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // block_bytes)
    for k in range(count):
        # Twice the mean is beyond any chance of hashing, unless one item is that large.
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield Block.of([(r.item_id, r.text) for r in rows.collect()], window)


def _finder(block: Block, first: bool) -> Column:
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for text, *earlier in batches:
            rows = _found(text.tolist() if len(text) else [], block)
            if earlier:
                old = earlier[0]
                rows = [
                    (
                        n,
                        _merged(spans + [(int(s["start"]), int(s["end"])) for s in old_spans]),
                        sorted({*items, *old_items}),
                        _longer(match, old_match and Match(*(old_match[f] for f in Match._fields))),
                    )
                    for (n, spans, items, match), old_spans, old_items, old_match in zip(
                        rows, old["hits"], old["items"], old["longest"], strict=True
                    )
                ]
            yield pd.DataFrame(
                {
                    "n_words": np.array([r[0] for r in rows], "int64"),
                    "hits": [[{"start": a, "end": b} for a, b in r[1]] for r in rows],
                    "items": [r[2] for r in rows],
                    "longest": pd.Series([r[3] and r[3]._asdict() for r in rows], dtype="object"),
                }
            )

    if first:

        def run_text(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            return run((t,) for t in texts)

        return F.pandas_udf(run_text, FOUND)

    def run_both(pairs: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        return run(pairs)

    return F.pandas_udf(run_both, FOUND)


def find(documents: DataFrame, benchmark: DataFrame, column: str, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` with a struct ``column``: n_words, hits (spans of hit words), items (ids, sorted as strings),
    longest (length and places, in words, of the longest verbatim match)."""
    rows, first = documents, True
    for block in blocks(benchmark, window, block_bytes):
        if first:
            rows = rows.withColumn(column, _finder(block, True)(F.col("text")))
        else:
            rows = staged(rows).withColumn(column, _finder(block, False)(F.col("text"), F.col(column)))
        first = False
    return rows if not first else rows.withColumn(column, _finder(Block.of([], window), True)(F.col("text")))


def n_hit(found: str) -> Column:
    return F.aggregate(f"{found}.hits", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))


def is_contaminated(found: str) -> Column:
    return (n_hit(found) > 0) & (WORDS_PER_HIT * n_hit(found) >= F.col(f"{found}.n_words"))


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    batches_by_bytes(documents.sparkSession)
    name = "found"
    while name in documents.columns:
        name += "_"
    return find(documents, benchmark, name).filter(~is_contaminated(name)).drop(name)


def longest_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each benchmark suffix that shares at least a window with a document: the longest verbatim match in the corpus and
    one of its locations (the smallest doc_id and place): item_id, item_at, length, doc_id, doc_at."""
    parts = [documents.select("doc_id", "text").mapInPandas(_longest(b), LONGEST) for b in blocks(benchmark, window)]
    if not parts:
        return documents.sparkSession.createDataFrame([], LONGEST)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    best = F.max(F.struct("length", (-F.col("doc_id")).alias("id"), (-F.col("doc_at")).alias("at"))).alias("best")
    return rows.groupBy("item_id", "item_at").agg(best).selectExpr(
        "item_id", "item_at", "best.length as length", "-best.id as doc_id", "cast(-best.at as int) as doc_at"
    )


def _longest(block: Block):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].tolist()
            for begun, shard in _shards(batch["text"].tolist(), block):
                low, high, length = _search(shard, block, block.starts, np.full(block.starts.size, 1 << 40))
                full = np.flatnonzero(length >= block.widths)
                slots, owner = spread(low[full], high[full])
                places = shard.order[slots]
                docs = np.searchsorted(shard.first, places, side="right") - 1
                starts = block.starts[full][owner]
                frame = pd.DataFrame(
                    {
                        "item_id": [block.names[i] for i in block.item[starts]],
                        "item_at": block.at[starts].astype("int32"),
                        "length": length[full][owner].astype("int32"),
                        "doc_id": pd.array([ids[begun + d] for d in docs.tolist()], "Int64"),
                        "doc_at": (places - shard.first[docs]).astype("int32"),
                    }
                )
                yield frame.sort_values(["doc_id", "doc_at"]).drop_duplicates(["item_id", "item_at"])

    return run


def op3_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "found")
    return found.select(
        "doc_id",
        "found.n_words",
        n_hit("found").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated("found").alias("contaminated"),
        F.col("found.longest.length").cast("long").alias("longest_match"),
        F.col("found.longest.doc_at").cast("long").alias("longest_doc_at"),
        F.col("found.longest.item_id").alias("longest_item_id"),
        F.col("found.longest.item_at").cast("long").alias("longest_item_at"),
    )


ORACLE = {
    "op3_suffix_decontamination": r"""
        with doc_words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
            from documents
        ), item_words as (
            select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
            from benchmark
        ), windows as (
            select distinct item_id, width, j, array_to_string(words[j:j + width - 1], ' ') as seq
            from (
                select item_id, words, least(13, len(words)) as width,
                    unnest(generate_series(1, len(words) - least(13, len(words)) + 1)) as j
                from item_words where len(words) > 0
            )
        ), widths as (
            select distinct width from windows
        ), places as (
            select doc_id, width, k, array_to_string(words[k:k + width - 1], ' ') as seq
            from (
                select doc_id, words, width, unnest(generate_series(1, len(words) - width + 1)) as k
                from doc_words, widths where len(words) >= width
            )
        ), occurring as (
            select doc_id, item_id, width, k, j from places join windows using (width, seq)
        ), hit as (
            select doc_id, count(distinct w) as n_hit
            from (select doc_id, unnest(generate_series(k, k + width - 1)) as w from occurring) group by doc_id
        ), found as (
            select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
            from (select distinct doc_id, item_id::varchar as item from occurring) group by doc_id
        ), matches as (
            select doc_id, item_id::varchar as item, max(k) - min(k) + width as length, min(k) - 1 as doc_at, min(j) - 1 as item_at
            from (
                select *, k - row_number() over (partition by doc_id, item_id, width, k - j order by k) as run from occurring
            ) group by doc_id, item_id, width, k - j, run
        ), longest as (
            select * from matches
            qualify row_number() over (partition by doc_id order by length desc, doc_at, item nulls last, item_at) = 1
        )
        select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
            sha256(coalesce(items, '')) as items_sha256,
            coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated, length as longest_match,
            doc_at as longest_doc_at, item as longest_item_id, item_at as longest_item_at
        from doc_words left join hit using (doc_id) left join found using (doc_id) left join longest using (doc_id)
    """
}
