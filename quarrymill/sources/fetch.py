"""A web that is fetched: one GET for each URL, conditional on what is known of it, polite to hosts."""

from __future__ import annotations

import gzip
import http.client
import time
import urllib.error
import urllib.request
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import robots, urls

LIMIT = 15 * 1024 * 1024
#: Seconds before each further try, after an error that may pass.
WAITS = (2.0, 4.0, 8.0)
PASSING = (408, 429, 500, 502, 503, 504)
COLUMNS = ("url", "final_url", "status", "content_type", "charset", "etag", "last_modified", "x_robots_tag", "body")
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]


def get(url: str, etag: str | None = None, last_modified: str | None = None, agent: str = "quarrymill", limit: int = LIMIT, timeout: float = 30.0, waits: tuple[float, ...] = WAITS) -> tuple:
    """A row of COLUMNS. At most limit + 1 bytes are read, which tells that a body is too large. What can't be fetched at all
    has a null status."""
    asked = urllib.request.Request(url, headers={"User-Agent": agent, "Accept-Encoding": "gzip, deflate"})
    if etag:
        asked.add_header("If-None-Match", etag)
    if last_modified:
        asked.add_header("If-Modified-Since", last_modified)
    for wait in (*waits, None):
        try:
            with urllib.request.urlopen(asked, timeout=timeout) as answer:
                return _row(url, answer, answer.status, _body(answer, limit))
        except urllib.error.HTTPError as e:  # every status but success
            if e.code not in PASSING or wait is None:
                return _row(url, e, e.code, None)
        except (OSError, http.client.HTTPException, ValueError):
            if wait is None:
                return (url, *[None] * 8)
        time.sleep(wait)
    raise AssertionError("the last turn has returned")


def _body(answer, limit: int) -> bytes:
    packed = (answer.headers.get("Content-Encoding") or "").lower()
    if packed == "gzip":
        with gzip.GzipFile(fileobj=answer) as plain:
            return plain.read(limit + 1)
    if packed == "deflate":
        return zlib.decompressobj().decompress(answer.read(limit + 1), limit + 1)
    return answer.read(limit + 1)


def _row(url: str, answer, status: int, body: bytes | None) -> tuple:
    head = answer.headers
    return (url, answer.geturl(), status, head.get_content_type() if head.get("Content-Type") else None, head.get_content_charset(), head.get("ETag"), head.get("Last-Modified"), head.get("X-Robots-Tag"), body)


def fetch(wanted: DataFrame, agent: str = "quarrymill", limit: int = LIMIT, least_delay: float = robots.LEAST_DELAY, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """The rows of a web (see plans/crawl.py) for wanted(url, and, if there: etag, last_modified, delay). A host's URLs are
    fetched in one task, one after the other, with `delay` seconds between them, at least least_delay and at most 30. Null
    URLs are left out; of a URL that occurs twice both are fetched."""
    known = [F.col(c) if c in wanted.columns else F.lit(None).cast("string").alias(c) for c in ("etag", "last_modified", "delay")]
    asked = wanted.filter("url IS NOT NULL").select("url", *known[:2], known[2].cast("double").alias("delay"), urls.host(F.col("url")).alias("host"))

    def run(batches):
        last: dict[str | None, float] = {}
        for batch in batches:
            for url, etag, modified, delay, host in zip(*(c.to_pylist() for c in batch.columns)):
                gap = max(least_delay, min(delay or 0.0, robots.MOST_DELAY))
                time.sleep(max(0.0, last.get(host, 0.0) + gap - time.monotonic()))
                row = get(url, etag, modified, agent, limit, waits=waits)
                last[host] = time.monotonic()
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], names=list(COLUMNS))

    schema = "url string, final_url string, status int, content_type string, charset string, etag string, last_modified string, x_robots_tag string, body binary"
    return asked.repartition("host").mapInArrow(run, schema)
