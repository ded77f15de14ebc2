"""Web archives and their capture index (operator 4).

``write_archive`` turns pages into WARC 1.1 files: one record per page, by Spark's text writer, so
that any file system Spark knows will do.  Of the records with equal payloads of ``least`` bytes
or more, the one with the largest page id is a response and the others are revisits of it; smaller
payloads are always responses.

``capture_index`` reads the archives back.  Every file gives a run of captures, sorted by URL key
and time.  Ranges of (URL key, time, page id) are dealt to tasks, and each task merges its part of
all runs with a loser tree, which gives capture histories in one global order, never held whole.

Null html counts as empty; null ids and URLs are left out of the record and read back as null;
repeated rows have a record each, and among equal payloads all rows with the largest id are
responses; extra columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truthloom.plans.workspace import Workspace

LEAST = 1000
FILE_RECORDS = 1000
# Fixed values of the format.
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = (
    "url_key string, capture_time string, page_id long, url string, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long, archive string, position long"
)
ORDER = ("url_key", "capture_time", "page_id")


def mark_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null: a response)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    records = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"),
    )
    large = records.where(F.col("payload_bytes") >= least)
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    joined = records.join(groups.where("n > 1").drop("n"), "payload_digest", "left")
    # a null id is never the largest, so it is a revisit where another row has an id
    revisits = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.withColumn("refers_to", F.when(revisits, F.col("keeper"))).drop("keeper")


def _one_line(text: Column) -> Column:
    """A header value: line breaks would end it."""
    return F.replace(F.replace(text, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record_text() -> Column:
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    seconds = F.coalesce(F.col("page_id"), F.lit(0))
    date = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.pmod(seconds, F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def line(name: str, value: Column) -> Column:  # a null value leaves the line out
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    def urn(page: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))

    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(CRLF),
        line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Target-URI", _one_line(F.col("url"))), line("WARC-Date", date),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.when(revisit, PROFILE)),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit(CRLF * 2), http, body,
    )


def write_archive(pages: DataFrame, path: str, least: int = LEAST, file_records: int = FILE_RECORDS) -> None:
    """WARC files (gzip) under ``path``, of at most ``file_records`` records each."""
    records = mark_revisits(pages, least).select(_record_text().alias("value"))
    writer = records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", file_records)
    writer.text(path)


def _headers(block: bytes) -> dict[str, str]:
    pairs = (line.partition(": ") for line in block.decode().split(CRLF)[1:])
    return {name.lower(): value for name, _, value in pairs}


def read_records(content: bytes) -> Iterator[tuple[int, dict[str, str], dict[str, str], bytes]]:
    """Position, WARC headers, HTTP headers and body of every record of one uncompressed file."""
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        warc = _headers(content[at:stop])
        size = int(warc["content-length"])
        block = content[stop + 4 : stop + 4 + size]
        head, _, body = block.partition(b"\r\n\r\n")
        if len(block) != size or content[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"damaged record at {at}")
        yield at, warc, _headers(head), body
        at = stop + 8 + size


def url_key(url: str | None) -> str:
    """Host parts reversed, then port, path and query; no scheme, fragment or leading www."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{name}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _page(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn else None


def captures(archive: str, packed: bytes) -> list[tuple]:
    """The run of one file: its captures, sorted.  Payloads are held against their digests."""
    found = []
    for at, warc, http, body in read_records(gzip.decompress(packed)):
        digest, size = warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
        kind = warc["warc-type"]
        if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
            raise ValueError(f"{archive}: payload at {at} does not match its digest")
        url = warc.get("warc-target-uri")
        found.append((
            url_key(url), warc["warc-date"], _page(warc.get("warc-record-id")), url, size, digest, kind,
            _page(warc.get("warc-refers-to")), archive, at,
        ))
    return sorted(found, key=_rank)


def _rank(row: tuple) -> tuple:
    """Place of a capture: key, time, id (null first), then file and position."""
    return (row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9])


class LoserTree:
    """Merges sorted runs: the inner nodes hold losers, the winner of all runs is on top."""

    def __init__(self, runs: Sequence[Sequence[tuple]], rank: Callable[[tuple], tuple]):
        self.runs, self.rank, self.size = [iter(r) for r in runs], rank, len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.ranks = [None if h is None else rank(h) for h in self.heads]
        self.losers = [-1] * self.size
        for run in range(self.size):
            self._play(run)

    def _beats(self, a: int, b: int) -> bool:
        if self.ranks[a] is None or self.ranks[b] is None:
            return self.ranks[b] is None and (self.ranks[a] is not None or a < b)
        return (self.ranks[a], a) < (self.ranks[b], b)

    def _play(self, run: int) -> None:
        """Carry a run from its leaf up: losers stay, the winner goes on."""
        node = (run + self.size) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # first visit: wait for an opponent
                self.losers[node] = run
                return
            if self._beats(other, run):
                self.losers[node], run = run, other
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple]:
        while self.size and self.heads[top := self.losers[0]] is not None:
            yield self.heads[top]
            self.heads[top] = next(self.runs[top], None)
            self.ranks[top] = None if self.heads[top] is None else self.rank(self.heads[top])
            self._play(top)


_NAMES = [part.split(" ")[0] for part in CAPTURE.split(", ")]
_KINDS = [pa.int64() if part.endswith(" long") else pa.string() for part in CAPTURE.split(", ")]


def _batch(rows: Sequence[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)


def capture_runs(archives: DataFrame) -> DataFrame:
    """Runs of all files (columns path, content)."""

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                yield _batch(captures(path.as_py(), content.as_py()))

    return archives.select("path", "content").mapInArrow(index, CAPTURE)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in global order: ranges are dealt to tasks, each merges its runs."""

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                parts.setdefault(row[8], []).append(row)
        for own in parts.values():
            own.sort(key=_rank)  # linear: a file's rows arrive in order
        held: list[tuple] = []
        for row in LoserTree(list(parts.values()), _rank):
            held.append(row)
            if len(held) == 5000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    return runs.repartitionByRange(*ORDER, "archive", "position").mapInArrow(merge, CAPTURE)


def capture_index(spark, path: str) -> DataFrame:
    """The capture histories of all archives under ``path``, in order."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    runs = Workspace(spark).keep(capture_runs(archives), "runs")
    return merge_runs(runs)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages as archives, read them back, and return their capture histories."""
    spark = pages.sparkSession
    path = f"{Workspace(spark).path}/archive"
    write_archive(pages, path)
    return capture_index(spark, path)


# DuckDB: the same records straight from the table.
WARC_SQL = """
WITH records AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), groups AS (
  SELECT payload_digest, max(page_id) AS keeper FROM records WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM records LEFT JOIN groups USING (payload_digest)
"""
