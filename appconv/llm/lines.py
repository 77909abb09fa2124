"""Line dedup with a sharded minimal perfect hash.

Distinct line hashes are counted over the corpus and dealt into shards by hash. Each shard gets a minimal perfect hash
function: a cascade of bit arrays in which a hash that is alone in its slot is placed and the others go on to the next array;
the place of a hash is the number of bits set before its own. At that place lie a fingerprint of the hash and the line's
numbers of documents and largest document, in compact arrays. Documents send the hashes of their lines to the shards and
read the arrays there; lines are never joined with lines. A shard whose lines are asked for very often, such as one
with a line that a third of all documents hold, is copied, and the questions are dealt over the copies.

Keys are hashed to 128 bits: 64 choose shard and place, 64 are held as the fingerprint.

Defined cases: a null or empty text is one empty line. A line repeated in one document counts once for it. Rows without
doc_id are not counted as documents and never keep a line for others. Rows that repeat a doc_id count as one document and
each get a result; equal rows get equal results. Other columns are ignored by ``judge``, kept by ``drop_repeated``. An empty
table gives no rows."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appconv.llm.common import LOWER_BYTES, SPACE_BYTES, batches_by_bytes, slices, staged, table

MIN_CHARS = 20
MIN_DOCUMENTS = 3
SHARD_KEYS = 200_000
QUESTIONS = 1_000_000
# Slots for each hash in a bit array; more make fewer levels and a larger function.
SPREAD = 2

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)

LINES = "doc_id long, text_hash long, line int, place_hash long, fingerprint long"
SHARDS = "shard long, sizes binary, bits binary, fingerprints binary, counts binary, largest binary"
ANSWERS = "doc_id long, text_hash long, line int"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def line_keys(text: str, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """Number and key of the lines whose key is long enough."""
    for number, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        key = line.strip(SPACE_BYTES)
        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            yield number, key.translate(LOWER_BYTES)


def hashed_lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each line with a key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts, numbers, hashes = [], [], [], []
            for row, text in enumerate(batch["text"]):
                if not text:
                    continue
                own = _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))
                for number, key in line_keys(text, min_chars):
                    ids.append(row)
                    texts.append(own)
                    numbers.append(number)
                    hashes.append(xxhash.xxh3_128_digest(key))
            pair = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].iloc[ids].astype("Int64").array,
                    "text_hash": np.array(texts, "int64"),
                    "line": np.array(numbers, "int32"),
                    "place_hash": pair[:, 0],
                    "fingerprint": pair[:, 1],
                }
            )

    return documents.select("doc_id", "text").mapInPandas(run, LINES)


def _slots(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (np.uint64(level + 1) * _MIX)) * _MIX2
        mixed ^= mixed >> np.uint64(31)
        mixed *= _MIX
    return ((mixed >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


class PerfectHash:
    """``sizes`` of the levels and their ``bits``, one after the other; each level is a whole number of bytes."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.flags = np.unpackbits(bits, bitorder="little").astype(bool)
        self.before = np.cumsum(self.flags, dtype=np.int64) - self.flags

    @classmethod
    def build(cls, hashes: np.ndarray) -> "PerfectHash":
        sizes, parts, rest = [], [], hashes
        while rest.size:
            size = 8 * -(-max(8, SPREAD * rest.size) // 8)
            slots = _slots(rest, len(sizes), size)
            alone = np.bincount(slots.astype(np.int64), minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            rest = rest[~alone[slots]]
        return cls(np.array(sizes, np.int64), np.concatenate(parts or [np.zeros(0, np.uint8)]))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places; -1 for hashes that are certainly not among those of ``build``."""
        places = np.full(hashes.size, -1, np.int64)
        open_ = np.arange(hashes.size)
        start = 0
        for level, size in enumerate(self.sizes):
            at = start + _slots(hashes[open_], level, int(size)).astype(np.int64)
            hit = self.flags[at]
            places[open_[hit]] = self.before[at[hit]]
            open_ = open_[~hit]
            start += int(size)
        return places


def _build_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.drop_duplicates("place_hash") if rows["place_hash"].duplicated().any() else rows
    hashes = rows["place_hash"].to_numpy(np.int64).view(np.uint64)
    function = PerfectHash.build(hashes)
    places = function.find(hashes)

    def laid(values: np.ndarray, kind: str) -> bytes:
        out = np.zeros(values.size, kind)
        out[places] = values
        return out.tobytes()

    return pd.DataFrame(
        {
            "shard": [key[0]],
            "sizes": [function.sizes.tobytes()],
            "bits": [function.bits.tobytes()],
            "fingerprints": [laid(rows["fingerprint"].to_numpy(), "int64")],
            "counts": [laid(rows["documents"].to_numpy(), "int64")],
            "largest": [laid(rows["largest"].to_numpy(), "int64")],
        }
    )


def build_index(lines: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """Lines -> one row for each shard with the function and its arrays, written; and the number of shards."""
    # Within a text a key counts once; rows that repeat a document are met by the distinct count.
    once = lines.filter("doc_id is not null").groupBy("place_hash", "fingerprint", "doc_id").agg(F.lit(1).alias("one"))
    counted = staged(
        once.groupBy("place_hash", "fingerprint").agg(F.count("*").alias("documents"), F.max("doc_id").alias("largest"))
    )
    shards = slices(counted.count(), shard_keys)
    keyed = counted.withColumn("shard", F.pmod("fingerprint", F.lit(shards)))
    return staged(keyed.groupBy("shard").applyInPandas(_build_shard, SHARDS)), shards


def _asker(min_documents: int):
    def ask(key: tuple, asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(index):
            return asked.iloc[:0][["doc_id", "text_hash", "line"]]
        shard = index.iloc[0]
        array = lambda name: np.frombuffer(shard[name], "int64")
        function = PerfectHash(array("sizes"), np.frombuffer(shard["bits"], np.uint8))
        places = function.find(asked["place_hash"].to_numpy(np.int64).view(np.uint64))
        known = (places >= 0) & (array("fingerprints")[places] == asked["fingerprint"].to_numpy())
        ids = asked["doc_id"].astype("Int64")
        largest = array("largest")[places]
        keeps = (ids == largest).fillna(False).to_numpy(bool)
        dropped = known & (array("counts")[places] >= min_documents) & ~keeps
        return asked.loc[dropped, ["doc_id", "text_hash", "line"]]

    return ask


def dropped_lines(
    documents: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, shard_keys: int = SHARD_KEYS,
    questions: int = QUESTIONS,
) -> DataFrame:
    """doc_id, text_hash and numbers of the lines that go; texts without such lines have no row."""
    lines = staged(hashed_lines(documents, min_chars))
    index, shards = build_index(lines, shard_keys)
    asked = lines.withColumn("shard", F.pmod("fingerprint", F.lit(shards)))
    copies = staged(asked.groupBy("shard").agg(F.ceil(F.count("*") / questions).cast("int").alias("copies")))
    one_of = F.pmod(F.xxhash64("doc_id", "text_hash", "line"), F.col("copies")).cast("int")
    asked = asked.join(copies, "shard").withColumn("copy", one_of).drop("copies")
    index = index.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    answers = (
        asked.groupBy("shard", "copy").cogroup(index.drop("copies").groupBy("shard", "copy")).applyInPandas(_asker(min_documents), ANSWERS)
    )
    return answers.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("dropped"))


def _hash_texts(documents: DataFrame) -> DataFrame:
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(
                [_signed(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))) if t else None for t in batch], dtype="Int64"
            )

    return documents.withColumn("text_hash", F.pandas_udf(run, "long")(F.col("text")))


def _judged(documents: DataFrame, **options) -> DataFrame:
    """documents (doc_id, text, rest) with n_lines, n_dropped and kept."""
    gone = dropped_lines(documents, **options).alias("g")
    docs = _hash_texts(documents).alias("d")
    rows = docs.join(gone, F.expr("d.text_hash = g.text_hash and d.doc_id <=> g.doc_id"), "left").select("d.*", "g.dropped")
    rows = rows.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return rows.select(
        "*",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept"),
    )


def judge(documents: DataFrame, **options) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_lines, n_dropped, kept (the text without its dropped lines)."""
    return _judged(documents.select("doc_id", "text"), **options).select("doc_id", "n_lines", "n_dropped", "kept")


def drop_repeated(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with the texts that are left; a column n_chars is brought up to date."""
    batches_by_bytes(documents.sparkSession)
    others = [c for c in documents.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None)
    rows = _judged(documents.select("doc_id", "text", rest.alias("rest")), **options)

    def column(name: str) -> Column:
        if name == "n_chars":
            return F.length("kept").cast(documents.schema["n_chars"].dataType)
        return {"doc_id": F.col("doc_id"), "text": F.col("kept")}.get(name, F.col("rest").getField(name))

    return rows.select(*[column(c).alias(c) for c in documents.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = {
    "op5_line_dedup": r"""
        with lines as (
            select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n,
                unnest(string_split(coalesce(text, ''), chr(10))) as line
            from documents
        ), keyed as (
            select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from lines
        ), shared as (
            select key, max(doc_id) as largest from keyed where length(key) >= 20
            group by key having count(distinct doc_id) >= 3
        ), judged as (
            select doc_id, n, line, largest is not null and doc_id <> largest as gone
            from keyed left join shared using (key)
        )
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by n) filter (not gone), '')) as kept_sha256
        from judged group by doc_id
    """
}
