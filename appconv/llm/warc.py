"""WARC archives: Spark writes pages as archives that are one gzip stream each; the normaliser inflates such a stream once,
writes every record as its own gzip member and keeps an index of offsets; records are read back by offset.

Defined cases: a null page is an empty payload; payloads of fewer than ``revisit_bytes`` are always responses; of equal
larger payloads the record with the largest page_id is the response, and rows that repeat this page_id are responses too;
rows without page_id revisit a response that has one, and are responses where no equal payload has one. A null url leaves
the target header out, white space and control characters in a url are percent-encoded. Other columns are ignored. An
empty table gives archives without records."""

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appconv.llm.common import staged, table
from appconv.session import checkpoint_dir

REVISIT_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_CHUNK = 1 << 20
_LEVEL = 4

INDEX = "archive string, offset long, length long, record_id string, record_type string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _header(name: str, value: Column) -> Column:
    """One header line, left out where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) -> the text of one WARC record each, without the four closing bytes."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("bytes"))
    shared = (
        rows.filter(F.col("bytes") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("digest", "original")
    )
    # Staged: small lists are then broadcast, and of larger ones adaptive execution splits a payload that very many pages share.
    rows = rows.join(staged(shared), "digest", "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    rows = rows.withColumn("revisit", revisit)
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n")
    )
    block = F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            _header("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
            _header("WARC-Record-ID", _id(F.col("page_id"))),
            _header("WARC-Date", F.lit(DATE)),
            _header("WARC-Target-URI", url),
            _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            _header("WARC-Refers-To", F.when(F.col("revisit"), _id(F.col("original")))),
            _header(
                "WARC-Profile",
                F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ),
            _header("Content-Type", F.lit("application/http;msgtype=response")),
            _header("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"),
            block,
        ).alias("value")
    )


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """One whole-file gzip stream for each task."""
    text = records(pages, revisit_bytes)
    text.write.option("lineSep", _END.decode()).option("compression", "gzip").text(folder)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _inflated(stream) -> Iterator[bytes]:
    """The plain bytes of one or more gzip members, in bounded pieces."""
    inflate = zlib.decompressobj(31)
    while data := stream.read(_CHUNK):
        while data:
            if piece := inflate.decompress(data, _CHUNK):
                yield piece
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate = inflate.unused_data, zlib.decompressobj(31)
    while piece := inflate.decompress(b"", _CHUNK):
        yield piece


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and all bytes of each record; one record is held at a time."""
    held = bytearray()

    def fill(wanted: int) -> bool:
        while len(held) < wanted:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        seen = 0
        while (at := held.find(_END, max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                if held.strip():
                    raise ValueError("archive ends within a record")
                return
        headers = _headers(bytes(held[:at]))
        size = at + 4 + int(headers["content-length"]) + 4
        if not fill(size):
            raise ValueError("archive ends within a record")
        yield headers, bytes(held[:size])
        del held[:size]


def _member(record: bytes) -> bytes:
    deflate = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def _normalise(batches: Iterator[pd.DataFrame], out: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for uri in batch["path"]:
            source, path = _open(uri)
            target, folder = _open(out)
            name = f"{folder}/{path.rsplit('/', 1)[-1].split('.')[0]}.warc.gz"
            # A task that runs twice writes the same bytes; the move makes one of them appear whole.
            own = f"{name}.{uuid.uuid4().hex}"
            rows, offset = [], 0
            with source.open_input_stream(path, compression=None) as stream, target.open_output_stream(own, compression=None) as sink:
                for headers, record in _split_records(_inflated(stream)):
                    member = _member(record)
                    sink.write(member)
                    rows.append((name, offset, len(member), headers["warc-record-id"], headers["warc-type"]))
                    offset += len(member)
            index = pd.DataFrame(rows, columns=["archive", "offset", "length", "record_id", "record_type"])
            with target.open_output_stream(f"{own}.idx", compression=None) as sink:
                sink.write(index.drop(columns="archive").to_csv(sep="\t", index=False).encode())
            target.move(own, name)
            target.move(f"{own}.idx", f"{name}.idx")
            index["archive"] = out.rstrip("/") + "/" + name.rsplit("/", 1)[-1]
            yield index


def normalise(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Rewrite every archive of ``folder`` into ``out`` with a member for each record and a ``.idx`` file beside it. Returns
    the offset index of all archives, which is also written: archive, offset, length, record_id, record_type."""
    target, path = _open(out)
    target.create_dir(path, recursive=True)
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path")
    return staged(paths.mapInPandas(partial(_normalise, out=out), INDEX))


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for uri, part in batch.groupby("archive", sort=False):
            system, path = _open(uri)
            with system.open_input_file(path) as file:
                for offset, length in zip(part["offset"], part["length"], strict=True):
                    file.seek(int(offset))
                    record = zlib.decompress(file.read(int(length)), 31)
                    head, _, block = record[:-4].partition(_END)
                    headers = _headers(head)
                    http, _, payload = block.partition(_END)
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = int(_headers(http)["content-length"])
                    kind = headers["warc-type"]
                    if kind == "response" and (size != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{uri} at {offset}: payload differs from its headers")
                    refers = _page(headers["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((_page(headers["warc-record-id"]), size, digest, kind, refers))
        frame = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        yield frame.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the index, read at its offset; the payload of a response is held against its digest and size."""
    return index.select("archive", "offset", "length").mapInPandas(_read, RECORDS)


def op1_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), f"{run}/streams")
    return read_archives(normalise(spark, f"{run}/streams", f"{run}/members"))


ORACLE = {
    "op1_warc_normalise": """
        with p as (
            select page_id, sha1(coalesce(html, '')) as payload_digest, strlen(coalesce(html, '')) as payload_bytes from pages
        ), r as (
            select payload_digest, max(page_id) as original from p where payload_bytes >= 1000 group by payload_digest
        )
        select page_id, payload_bytes, payload_digest,
            case when original is null or page_id = original then 'response' else 'revisit' end as record_type,
            case when page_id <> original then original end as refers_to
        from p left join r using (payload_digest)
    """
}
