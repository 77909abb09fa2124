"""Substring dedup by relative Lempel-Ziv parsing.

Reference blocks are made so that every block a passage could match is known beforehand. Each window of ``window`` words
has an anchor, the run of ``ANCHOR_WORDS`` words in it with the smallest hash, which depends on nothing but the window's own
words. Consecutive windows with one anchor form a segment. Equal windows have equal anchors, so segments whose anchor occurs
in one document only are left out, and the others go to the block of their anchor. In a block, every segment is parsed
greedily into factors: the longest match from a place on in a segment of a document with a smaller doc_id, found in the
block's suffix array with the smallest doc_id of a range of suffixes. A factor of at least a window is a repeated span. A
repeated window that lies in no factor crosses exactly one factor boundary, as the factor behind the boundary is at least as
long as the window's rest; so windows across boundaries whose two factors are long enough together are searched too. The
result is exact.

Words are hashed and anchors found once: what later steps need of a segment (its anchor, place and windows) goes through the
search for shared anchors. Equal segments are pre-aggregated before they meet: of those in a batch, and later in a block, only
the one with the smallest doc_id is parsed, the others are repeats as a whole. An anchor that still has very many segments
(``HOT_SEGMENTS``) is split by the same rule: its windows are dealt by their two smallest hashed runs, then three, and so on, and
parsed like the others; equal windows agree in all their runs.

Defined cases: a null or empty text has no words. Rows without doc_id are kept as they are and remove nothing elsewhere. Rows
that repeat a doc_id are one document: they remove nothing from each other, and each is judged by its own text; equal rows get
equal results. Other columns are ignored. An empty table gives no rows."""

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from appconv.llm.common import slices, staged, table
from appconv.llm.suffix import narrow, suffix_array

WINDOW = 13
ANCHOR_WORDS = 5
BUCKET_BYTES = 16 << 20
BLOCK_SEGMENTS = 20_000
HOT_SEGMENTS = 5_000
_HELD_WORDS = 1 << 17

PACKS = "coarse int, bucket int, anchors binary, docs binary, codes binary, passed_anchors binary, passed_docs binary, passed_codes binary"
SHARED = "doc_id long, anchor long, code long"
SEGMENTS = "anchor long, doc_id long, text_hash long, at int, words binary"
SPANS = "doc_id long, text_hash long, start int, end int"
KEPT = "doc_id long, n_words long, n_removed long, kept string"

# Bytes of text whose words are in memory at once, and anchors that are packed together.
SLICE_BYTES = 1 << 20
PACK_ANCHORS = 1 << 18
# Buckets that one pack is dealt over; more are reached in two steps.
COARSE_BUCKETS = 1024


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) >= _HELD_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def text_hash(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on."""
    runs = np.zeros(hashes.size - size + 1, np.uint64)
    for k in range(size):
        runs = (runs ^ hashes[k : hashes.size - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    return runs


def anchors(texts: list[list[bytes]], number: _WordHashes, window: int) -> tuple[np.ndarray, ...]:
    """Of each segment of several texts: text, anchor and code, which holds the anchor's place and by how much the first and
    the last window come before it."""
    lengths = np.array([len(t) for t in texts], np.int64)
    flat = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.uint64, int(lengths.sum()))
    size = min(ANCHOR_WORDS, window)
    if flat.size < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    runs = _runs(flat, size)
    windows = flat.size - window + 1
    best, back = runs[:windows].copy(), np.zeros(windows, np.int64)
    for k in range(1, window - size + 1):
        smaller = runs[k : windows + k] < best
        best[smaller], back[smaller] = runs[k : windows + k][smaller], k
    owner = np.repeat(np.arange(lengths.size), lengths)
    start = np.flatnonzero(owner[:windows] == owner[window - 1 :])
    owner, place = owner[start], start + back[start]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.concatenate([first[1:], [place.size]]) - 1 if place.size else first[:0]
    if not place.size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin = (np.cumsum(lengths) - lengths)[owner[first]]
    code = ((place[first] - begin) << 16) | ((place[first] - start[first]) << 8) | (place[first] - start[last])
    return owner[first], runs[place[first]], code


def decoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last windows."""
    place = codes >> 16
    return place - ((codes >> 8) & 255), place - (codes & 255)


def _planes(values: np.ndarray) -> bytes:
    """Byte by byte, as bytes of equal weight compress together."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unplaned(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _groups(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if keys.size else np.zeros(0, np.int64)


def _shared(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether the key at each place, keys being sorted, occurs with more than one document."""
    begins = _groups(keys)
    if not begins.size:
        return np.zeros(0, bool)
    several = np.minimum.reduceat(docs, begins) != np.maximum.reduceat(docs, begins)
    return np.repeat(several, np.diff(np.append(begins, keys.size)))


def _slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of a batch with no more than ``SLICE_BYTES`` of text, or one."""
    begins = np.flatnonzero(np.diff(batch["text"].str.len().cumsum().to_numpy() // SLICE_BYTES, prepend=-1))
    for a, b in zip(begins, [*begins[1:], len(batch)], strict=True):
        yield batch.iloc[a:b]


def _dealt(coarse: np.ndarray, bucket: np.ndarray, columns: list[np.ndarray], passed: np.ndarray, passed_columns: list[np.ndarray]) -> pd.DataFrame:
    """A row for each bucket that has something; the columns are in the order of the buckets."""
    reached = np.union1d(bucket, passed)
    low, high = (np.searchsorted(bucket, reached, side) for side in ("left", "right"))
    passed_low, passed_high = (np.searchsorted(passed, reached, side) for side in ("left", "right"))
    rows = []
    for b, i, j, k, m in zip(reached.tolist(), low, high, passed_low, passed_high, strict=True):
        steps = np.diff(columns[0][i:j], prepend=np.uint64(0))
        rows.append((b, *map(_planes, (steps, columns[1][i:j], columns[2][i:j])), *(_planes(c[k:m]) for c in passed_columns)))
    names = [c.split()[0] for c in PACKS.split(", ")]
    out = pd.DataFrame(rows, columns=names[1:])
    out.insert(0, "coarse", (out["bucket"].to_numpy(np.int64) // coarse).astype("int32") if len(out) else [])
    return out.astype({"coarse": "int32", "bucket": "int32"})


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _pack(key: np.ndarray, doc: np.ndarray, code: np.ndarray, buckets: int, fine: int) -> pd.DataFrame:
    """Anchors by bucket. Of one that is there in several documents only the first and the last of these go to the bucket; all
    its places are passed on as shared, dealt by document."""
    by = np.lexsort((doc, key))
    key, doc, code = key[by], doc[by], code[by]
    shared, begins = _shared(key, doc), _groups(key)
    go = ~shared
    go[begins], go[np.append(begins[1:], key.size) - 1] = True, True
    dealt = np.mod(doc[shared], buckets)
    order = np.argsort(dealt, kind="stable")
    passed = [c[shared][order] for c in (key, doc, code)]
    return _dealt(fine, _bucket_of(key[go], buckets), [key[go], doc[go], code[go]], dealt[order], passed)


def _packer(buckets: int, fine: int, window: int):
    """Anchors of many documents in a pack for each bucket that they reach; ``fine`` buckets make a coarse one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, size = _WordHashes(), [], 0
        for batch in batches:
            for part in _slices(batch):
                owner, key, code = anchors([words_of(t) for t in part["text"]], number, window)
                held.append((key, part["doc_id"].to_numpy(np.int64)[owner], code))
                size += key.size
                if size >= PACK_ANCHORS:
                    yield _pack(*map(np.concatenate, zip(*held, strict=True)), buckets, fine)
                    held, size = [], 0
        if size:
            yield _pack(*map(np.concatenate, zip(*held, strict=True)), buckets, fine)

    return run


def _unpacked(packs: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    def whole(name: str, kind: str) -> np.ndarray:
        return np.concatenate([_unplaned(x, kind) for x in packs[name]])

    key = np.concatenate([np.cumsum(_unplaned(x, "uint64"), dtype=np.uint64) for x in packs["anchors"]])
    passed = [whole("passed_anchors", "uint64"), whole("passed_docs", "int64"), whole("passed_codes", "int64")]
    return [key, whole("docs", "int64"), whole("codes", "int64")], passed


def _repacker(buckets: int, fine: int):
    """Packs that only go by coarse buckets, gathered until they fill packs for the fine ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def filled() -> pd.DataFrame:
            (key, doc, code), passed = _unpacked(pd.concat(held))
            by = np.argsort(key, kind="stable")
            dealt = np.mod(passed[1], buckets)
            order = np.argsort(dealt, kind="stable")
            key = key[by]
            return _dealt(fine, _bucket_of(key, buckets), [key, doc[by], code[by]], dealt[order], [c[order] for c in passed])

        for batch in batches:
            held.append(batch)
            size += int(batch["docs"].str.len().sum() + batch["passed_docs"].str.len().sum()) // 8
            if size >= PACK_ANCHORS:
                yield filled()
                held, size = [], 0
        if held:
            yield filled()

    return run


def _unpack(packs: pd.DataFrame) -> pd.DataFrame:
    (key, doc, code), passed = _unpacked(packs)
    by = np.lexsort((doc, key))
    key, doc, code = key[by], doc[by], code[by]
    shared = _shared(key, doc)
    key, doc, code = (np.concatenate([c[shared], p]) for c, p in zip((key, doc, code), passed, strict=True))
    return pd.DataFrame({"doc_id": doc, "anchor": key.view(np.int64), "code": code})


def _least(rows: list[tuple], window: int) -> pd.DataFrame:
    """(anchor, doc, text hash, at, words) -> of equal segments those of the smallest document; of the others only how far the
    span reaches."""
    least: dict[bytes, int] = {}
    for _, doc, _, _, content in rows:
        if least.get(content, doc) >= doc:
            least[content] = doc
    repeated = [least[r[4]] < r[1] for r in rows]
    out = pd.DataFrame(rows, columns=["anchor", "doc_id", "text_hash", "at", "words"])
    out["end"] = [at + content.count(b" ") + 1 if r else 0 for (_, _, _, at, content), r in zip(rows, repeated, strict=True)]
    out.loc[repeated, "words"] = None
    return out.astype({"anchor": "int64", "doc_id": "int64", "text_hash": "int64", "at": "int32", "end": "int32"})


def _segmenter(window: int):
    """Segments of a batch at shared anchors. A doc_id may have several texts: what was found in another one of them ends where
    this one does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _slices(batch):
                rows = []
                for doc, text, keys, codes in zip(part["doc_id"].tolist(), part["text"], part["anchors"], part["codes"], strict=True):
                    words, own = words_of(text), text_hash(text)
                    first, last = decoded(np.asarray(codes, np.int64))
                    last = np.minimum(last, len(words) - window)
                    for k, a, b in zip(np.asarray(keys).tolist(), first.tolist(), last.tolist(), strict=True):
                        if a <= b:
                            rows.append((k, doc, own, a, b" ".join(words[a : b + window])))
                yield _least(rows, window)

    return run


def _finer(level: int, window: int):
    """Segments -> their windows dealt by the ``level`` smallest runs, neighbours that agree in these together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = _WordHashes()
        size = min(ANCHOR_WORDS, window)
        for batch in batches:
            rows = []
            for doc, own, at, content in zip(batch["doc_id"], batch["text_hash"], batch["at"], batch["words"], strict=True):
                words = bytes(content).split(b" ")
                hashes = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
                runs = np.lib.stride_tricks.sliding_window_view(_runs(hashes, size), window - size + 1)
                key = np.zeros(runs.shape[0], np.uint64)
                for column in np.sort(runs, axis=1)[:, :level].T:
                    key = (key ^ column) * np.uint64(0xD6E8FEB86659FD93)
                    key ^= key >> np.uint64(32)
                first = _groups(key)
                for a, b in zip(first.tolist(), [*first[1:].tolist(), key.size], strict=True):
                    rows.append((int(key[a : a + 1].view(np.int64)[0]), int(doc), int(own), int(at) + a, b" ".join(words[a : b - 1 + window])))
            yield _least(rows, window)

    return run


class _Reference:
    """Segments of a block as one array, its suffix array, and the smallest document of any range of it."""

    def __init__(self, texts: list[bytes], docs: np.ndarray, depth: int):
        number: dict[bytes, int] = {}
        parts = [[number.setdefault(w, len(number) + 1) for w in t.split(b" ")] + [0] for t in texts]
        self.lengths = np.array([len(p) - 1 for p in parts], np.int64)
        self.first = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.ids = np.array([x for p in parts for x in p], np.int64)
        self.doc = np.repeat(docs, self.lengths + 1)
        self.order = suffix_array(self.ids, np.flatnonzero(self.ids), depth)
        # Where the suffixes of each first word begin.
        self.begin = np.searchsorted(self.ids[self.order], np.arange(len(number) + 2))
        self.least = [self.doc[self.order]]
        step = 1
        while 2 * step <= self.order.size:
            row = self.least[-1]
            self.least.append(np.minimum(row[: row.size - step], row[step:]))
            step *= 2

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(low.size, np.int64)
        for k in np.unique(level):
            here = level == k
            out[here] = np.minimum(self.least[k][low[here]], self.least[k][high[here] - (1 << int(k))])
        return out

    def longest(self, places: np.ndarray, limit: int) -> np.ndarray:
        """Words from each place on that a smaller document holds together, up to ``limit``."""
        length = np.zeros(places.size, np.int64)
        word = self.ids[places]
        low, high = self.begin[word], self.begin[word + 1]
        active = np.flatnonzero(self.smallest(low, high) < self.doc[places])
        depth = 1
        length[active] = depth
        while active.size and depth < limit:
            words = self.ids[places[active] + depth]
            active, words = active[words > 0], words[words > 0]
            if not active.size:
                break
            a, b = narrow(self.ids, self.order, words, low[active], high[active], depth)
            found = self.smallest(a, b) < self.doc[places[active]]
            active, a, b = active[found], a[found], b[found]
            low[active], high[active] = a, b
            depth += 1
            length[active] = depth
        return length


def repeated_windows(texts: list[bytes], docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments and places in them where windows begin that a segment of a smaller document holds."""
    depth = max(t.count(b" ") + 1 for t in texts)
    reference = _Reference(texts, docs, depth)
    segment, place = np.arange(len(texts)), reference.first.copy()
    before = np.zeros(len(texts), np.int64)  # length of the factor that ends here; 0 behind a word without match
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while segment.size:
        length = reference.longest(place, depth)
        long = np.flatnonzero(length >= window)
        for k in range(int(length.max(initial=0)) - window + 1):
            part = long[length[long] >= window + k]
            found.append((segment[part], place[part] + k))
        for back in range(1, window):
            crossing = np.flatnonzero((before >= back) & (length + back >= window))
            if crossing.size:
                starts = place[crossing] - back
                full = reference.longest(starts, window) == window
                found.append((segment[crossing][full], starts[full]))
        place = place + np.maximum(length, 1)
        going = reference.ids[place] > 0
        segment, place, before = segment[going], place[going], length[going]
    which = np.concatenate([s for s, _ in found] or [np.zeros(0, np.int64)])
    at = np.concatenate([p for _, p in found] or [np.zeros(0, np.int64)])
    return which, at - reference.first[which]


def _parser(window: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        # A segment that a smaller document of the block has as a whole needs no parsing, and the block only one of them.
        later = (block["doc_id"] > block.groupby("words")["doc_id"].transform("min")).to_numpy()
        whole, block = block[later], block[~later]
        lengths = np.array([w.count(b" ") + 1 for w in whole["words"]], np.int64)
        which, at = repeated_windows(block["words"].tolist(), block["doc_id"].to_numpy(np.int64), window)
        rows = pd.concat([whole, block.iloc[which]])
        start = rows["at"].to_numpy(np.int64) + np.concatenate([np.zeros(len(whole), np.int64), at])
        end = start + np.concatenate([lengths, np.full(which.size, window)])
        return pd.DataFrame(
            {"doc_id": rows["doc_id"].array, "text_hash": rows["text_hash"].array, "start": start.astype("int32"), "end": end.astype("int32")}
        )

    return run


def _shared_places(docs: DataFrame, window: int) -> DataFrame:
    """doc_id -> anchors and codes of its segments whose anchor another document has."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = slices(size, BUCKET_BYTES)
    fine = slices(buckets, COARSE_BUCKETS)
    packs = docs.mapInPandas(_packer(buckets if fine == 1 else slices(buckets, fine), 1, window), PACKS)
    if fine > 1:
        packs = packs.repartition("bucket").mapInPandas(_repacker(buckets, fine), PACKS)
    # A place may be found in its pack and in its bucket. Staged, so that the groups' rows and the texts' shuffle are not in
    # memory together.
    shared = staged(packs.groupBy("bucket").applyInPandas(_unpack, SHARED)).distinct()
    return shared.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("code").alias("codes"))


def _parsed(segments: DataFrame, window: int, block_segments: int) -> DataFrame:
    block = F.pmod("anchor", F.lit(slices(segments.count(), block_segments)))
    return segments.withColumn("block", block).groupBy("block").applyInPandas(_parser(window), SPANS)


def spans(documents: DataFrame, window: int = WINDOW, block_segments: int = BLOCK_SEGMENTS, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """documents (doc_id, text) -> doc_id, text_hash, start, end: words that windows of smaller documents cover."""
    docs = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    found = staged(docs.join(_shared_places(docs, window), "doc_id").mapInPandas(_segmenter(window), SEGMENTS + ", end int"))
    parts, level = [], 1
    while True:
        parts.append(found.filter("words is null").selectExpr("doc_id", "text_hash", "at as start", "end"))
        segments = found.filter("words is not null").drop("end")
        per_anchor = segments.groupBy("anchor").count()
        hot = staged(per_anchor.filter(F.col("count") > hot_segments).select("anchor"))
        if level > window - min(ANCHOR_WORDS, window) or hot.isEmpty():
            parts.append(_parsed(segments, window, block_segments))
            break
        parts.append(_parsed(segments.join(hot, "anchor", "left_anti"), window, block_segments))
        # Equal segments of a hot anchor first: an aggregate and a join that adaptive execution can split.
        crowded = staged(segments.join(hot, "anchor", "left_semi"))
        least = staged(crowded.groupBy("anchor", "words").agg(F.min("doc_id").alias("least")))
        judged = staged(crowded.join(least, ["anchor", "words"]))
        later = judged.filter("doc_id > least")
        length = F.regexp_count(F.col("words").cast("string"), F.lit(" ")) + 1
        parts.append(later.select("doc_id", "text_hash", F.col("at").alias("start"), (F.col("at") + length).cast("int").alias("end")))
        level += 1
        first = judged.filter("doc_id = least").select("anchor", "doc_id", "text_hash", "at", "words")
        found = staged(first.mapInPandas(_finer(level, window), SEGMENTS + ", end int"))
    return reduce(DataFrame.unionByName, parts)


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, starts, ends in zip(batch["text"], batch["starts"], batch["ends"], strict=True):
            words = words_of(text)
            removed = 0
            kept = words
            if starts is not None:
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, np.asarray(starts), 1)
                np.add.at(step, np.asarray(ends), -1)
                covered = np.cumsum(step[:-1]) > 0
                removed = int(covered.sum())
                kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            rows.append((len(words), removed, b" ".join(kept).decode("utf-8", "surrogatepass")))
        frame = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])
        frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
        yield frame


def _hash_texts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([text_hash(t) if t is not None else None for t in batch], dtype="Int64")


def remove_repeats(documents: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_words, n_removed, kept: the other words, joined by one space."""
    found = spans(documents, window, **options).groupBy("doc_id", "text_hash").agg(
        F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")
    )
    docs = documents.select("doc_id", "text", F.pandas_udf(_hash_texts, "long")("text").alias("text_hash"))
    return docs.join(found, ["doc_id", "text_hash"], "left").select("doc_id", "text", "starts", "ends").mapInPandas(_remove, KEPT)


def op8_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = {
    "op8_lempel_ziv": r"""
        with docs as (
            select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
        ), windows as (
            select doc_id, k, array_to_string(words[k:k + 12], ' ') as seq
            from (select doc_id, words, unnest(generate_series(1, len(words) - 12)) as k from docs where len(words) >= 13)
        ), firsts as (
            select seq, min(doc_id) as least from windows group by seq having count(*) > 1
        ), covered as (
            select distinct doc_id, unnest(generate_series(k, k + 12)) as n
            from windows join firsts using (seq) where doc_id > least
        ), words as (
            select doc_id, generate_subscripts(words, 1) as n, unnest(words) as word from docs
        ), kept as (
            select w.doc_id, count(c.n) as n_removed, string_agg(w.word, ' ' order by w.n) filter (c.n is null) as text
            from words w left join covered c on w.doc_id = c.doc_id and w.n = c.n group by w.doc_id
        )
        select doc_id, len(words) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
        from docs left join kept using (doc_id)
    """
}
