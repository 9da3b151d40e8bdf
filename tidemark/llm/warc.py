"""WARC archives: write captures, read them back, assemble transactions.

Each page becomes three records: request, response (or revisit) and metadata.
Request and metadata name the response in WARC-Concurrent-To; reading joins the
three through it and gives one nested row per capture.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, fresh_path, materialize

#: Payloads of fewer bytes are stored each time.
SMALL = 100
#: Rows in one archive file, which bounds what a reading task holds.
ROWS_A_FILE = 6_000
#: Bytes of records, about, that a reading task gives on at once.
TOGETHER = 16 << 20
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def _record(kind: str, uri: Column, headers: list[Column], block: Column) -> Column:
    """Text of one record; the writer's line end closes it."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), uri), F.lit(f"WARC-Date: {DATE}"), *headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block))
    return F.concat(F.concat_ws(CRLF, *lines, length), F.lit(CRLF * 2), block, F.lit(CRLF))


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))


def _uri(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"<urn:capture:{kind}:"), key, F.lit(">"))


def captures(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(key, page_id, url, html, digest, bytes, original): what is to be written.

    ``original`` is the key of the row with the smallest page id among those
    with the same payload, where that is another page and the payload is not
    small. The key keeps rows apart that repeat an id with other contents.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    base = base.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    key = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit("-"), F.lower(F.hex(F.xxhash64("page_id", "url", "digest"))))
    base = base.withColumn("key", key)
    stored = base.where(F.col("page_id").isNotNull() & (F.col("bytes") >= SMALL))
    first = stored.groupBy("digest").agg(F.min(F.struct("page_id", "key")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first.select(F.col("digest").alias("same"), "first"), "payloads")
    joined = base.join(first, F.col("digest") == F.col("same"), "left")
    return joined.select("key", "page_id", "url", "html", "digest", "bytes", F.when(F.col("first.page_id") < F.col("page_id"), F.col("first.key")).alias("original"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write gzip archives under ``path``, three records for each row.

    Null payloads are empty, null ids and urls are left out of the records.
    """
    c = captures(pages, id_col, url_col, html_col)
    key, url = F.col("key"), F.regexp_replace("url", r"[\x00-\x20]", "%20")
    revisit = F.col("original").isNotNull()
    target = _header("WARC-Target-URI", url)
    to = F.concat(F.lit("WARC-Concurrent-To: "), _uri("response", key))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    http = F.lit("Content-Type: application/http")
    profile = F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    refers = _header("WARC-Refers-To", _uri("response", F.col("original")))
    response = F.when(revisit, _record("revisit", _uri("response", key), [target, http, digest, profile, refers], head)).otherwise(_record("response", _uri("response", key), [target, http, digest], F.concat(head, F.col("html"))))
    path_of = F.regexp_replace(F.coalesce(url, F.lit("/")), r"^[a-z]+://", "")
    request = _record("request", _uri("request", key), [target, http, to], F.concat(F.lit("GET "), path_of, F.lit(" HTTP/1.1\r\n\r\n")))
    note = F.to_json(F.struct(F.col("page_id").cast("string").alias("page_id"), "url"))
    metadata = _record("metadata", _uri("metadata", key), [target, F.lit("Content-Type: application/json"), to], note)
    records = c.select(F.concat(request, F.lit(CRLF), response, F.lit(CRLF), metadata).alias("value"))
    records.write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", ROWS_A_FILE).text(path)


def open_archive(content: bytes) -> BinaryIO:
    """The records of an archive, plain or gzip, in one member or in many."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content[:2] == b"\x1f\x8b" else raw


def parse_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by Content-Length; headers lower-cased,
    the values of one that is repeated on lines of their own.

    A text that looks like a record inside a block is never taken for one, and
    one record is held at a time.
    """
    number = 0
    while version := stream.readline():
        number += 1
        if not version.startswith(b"WARC/"):
            raise ValueError(f"record {number} does not begin like one")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = (x.strip() for x in line.decode("utf-8").partition(":"))
            headers[name.lower()] = f"{headers[name.lower()]}\n{value}" if name.lower() in headers else value
        if not {"content-length", "warc-type", "warc-record-id"} <= set(headers) or not headers["content-length"].isdigit():
            raise ValueError(f"record {number} lacks a header")
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {number} has another length")
        yield headers, block


RECORD = "kind string, record string, concurrent array<string>, target string, payload_bytes long, payload_digest string, refers_to string, block string"
_FAULTS = (ValueError, EOFError, OSError, zlib.error)


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind, size, digest = headers["warc-type"], None, None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if kind == "revisit":
            stated = head.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0].strip()
            size = int(stated) if stated.isdigit() else None
            digest = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
        block = payload if payloads else b""
    concurrent = [x for x in headers.get("warc-concurrent-to", "").split("\n") if x]
    return kind, headers["warc-record-id"], concurrent, headers.get("warc-target-uri"), size, digest, headers.get("warc-refers-to"), block.decode("utf-8", "replace")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``.

    Archives of others read the same: each record may be a gzip member of its
    own, and ``.warc`` files are plain. ``concurrent`` has the ids of all
    records that this one names as made with it. Size and
    digest of a response are taken from its payload; a revisit, which has
    none, states them in its headers. Without ``payloads`` the block of a
    response is left out once they are known. A damaged archive gives the
    records before the damage, then a row of kind "fault" with the file as
    target and what is wrong as block; other archives are not touched by it.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                records = parse_records(open_archive(content))
                while True:
                    try:
                        headers, block = next(records)
                    except StopIteration:
                        break
                    except _FAULTS as fault:
                        rows.append(("fault", None, [], file, None, None, None, f"{type(fault).__name__}: {fault}"))
                        break
                    rows.append(_row(headers, block, payloads))
                    held += len(block) + 500
                    if held > TOGETHER:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("path", "content")
    return files.mapInPandas(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: page, request, response and metadata.

    Requests and metadata join the response that they name as concurrent, or
    that names them; one that is named both ways counts once. Captures
    whose every column repeats share an id; each keeps its row.
    """
    answers = records.where(F.col("kind").isin("response", "revisit"))
    others = records.where(F.col("kind").isin("request", "metadata"))
    rest = F.struct("kind", "target", "block").alias("other")
    naming = others.select(F.explode("concurrent").alias("capture"), "record", rest)
    named = answers.select(F.col("record").alias("capture"), F.explode("concurrent").alias("record")).join(others.select("record", rest), "record").select("capture", "record", "other")
    beside = naming.union(named.dropDuplicates(["capture", "record"]).join(naming.select("capture", "record"), ["capture", "record"], "left_anti").select("capture", "record", "other"))
    whole = answers.select(F.col("record").alias("capture"), F.struct("kind", "target", "payload_bytes", "payload_digest", "refers_to", "block").alias("response"))
    both = whole.select("capture", "response", F.lit(None).cast(beside.schema["other"].dataType).alias("other")).union(beside.select("capture", F.lit(None).cast(whole.schema["response"].dataType), "other"))
    side = lambda kind: F.collect_list(F.when(F.col("other.kind") == kind, F.struct("other.target", "other.block")))
    grouped = both.groupBy("capture").agg(side("request").alias("requests"), F.collect_list("response").alias("responses"), side("metadata").alias("notes"))
    one = grouped.select("capture", F.get("requests", F.lit(0)).alias("request"), F.explode("responses").alias("response"), F.get("notes", F.lit(0)).alias("metadata"))
    page = F.from_json("metadata.block", "page_id string, url string")
    return one.select("capture", page.alias("page"), "request", "response", "metadata")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages, read them back: the contract's columns, a row per page.

    Rows with a null id stay, as responses. Empty tables give no row. The
    archives are removed once they are read.
    """
    spark = pages.sparkSession
    scratch, path = Scratch(spark), fresh_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    records = scratch.table(read_archives(spark, path, payloads=False), "records")
    scratch.paths.append(path)
    rows = assemble(records)
    kind = pages.schema[id_col].dataType
    out = rows.select(
        F.col("page.page_id").cast(kind).alias(id_col),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.regexp_extract("response.refers_to", r"^<urn:capture:response:(.*)-[0-9a-f]+>$", 1).cast(kind).alias("refers_to"),
    )
    return scratch.last(out, "captures")


#: DuckDB SQL of the contract's columns.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {SMALL} AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {SMALL} AND first < page_id THEN first END AS refers_to
FROM f
"""
