"""Pages over HTTP: a table of URLs becomes a table of pages.

A ``Session`` keeps a connection open for each host and closes them when it is left; a task has one session for all its
URLs. URLs of one host are brought together, so that a pause between requests to a host holds on the whole cluster,
whether a request is the first or another try; large hosts can be split over ``lanes``, each with its share of the rate.
Every URL gives one row; what fails is a row with its error.
"""

from __future__ import annotations

import http.client
import socket
import time
from collections.abc import Iterator
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .html import MAX_BYTES, decode

# What is worth another try, and the size of a read.
RETRIED = frozenset([429, 500, 502, 503, 504])
CHUNK = 64 * 1024
HEADERS = {"User-Agent": "Mozilla/5.0 (compatible; extractspark)", "Accept": "text/html,*/*;q=0.8"}
SCHEMA = "page_id bigint, url string, html string, status int, error string"


#: Redirects that are followed, and the codes that are one.
HOPS, MOVED = 10, frozenset([301, 302, 303, 307, 308])


class Session:
    """Requests over connections that are kept open. A context manager; one thread at a time."""

    def __init__(self, timeout: float = 30.0, retries: int = 3, backoff: float = 1.0, headers: dict[str, str] | None = None, max_bytes: int = MAX_BYTES, pause: float = 0.0) -> None:
        """pause: least seconds between requests to a host, redirects and further tries included."""
        self.timeout, self.retries, self.backoff, self.max_bytes, self.pause = timeout, retries, backoff, max_bytes, pause
        self.headers = {**HEADERS, **(headers or {})}
        self._open: dict[tuple[str, str], http.client.HTTPConnection] = {}
        self._last: dict[str, float] = {}

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Close all connections; the session can be used again."""
        while self._open:
            self._open.popitem()[1].close()

    def _wait(self, host: str) -> None:
        rest = self._last.get(host, -1e9) + self.pause - time.monotonic()
        if self.pause and rest > 0:
            time.sleep(rest)
        self._last[host] = time.monotonic()

    def _reply(self, url: str) -> tuple[http.client.HTTPResponse, http.client.HTTPConnection]:
        """The reply to one request; a kept connection that the other side has closed is opened once more."""
        parts = urlsplit(url)
        key = (parts.scheme, parts.netloc)
        path = quote(urlunsplit(("", "", parts.path or "/", parts.query, "")), safe="%/:=&?~#+!$,;'@()*[]")
        for known in (key in self._open, False):
            if key not in self._open:
                kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
                self._open[key] = kind(parts.hostname or "", parts.port, timeout=self.timeout)
            connection = self._open[key]
            try:
                self._wait(parts.netloc)
                connection.request("GET", path, headers=self.headers)
                return connection.getresponse(), connection
            except (http.client.HTTPException, ConnectionError):
                self._open.pop(key).close()
                if not known:
                    raise
            except BaseException:
                self._open.pop(key).close()
                raise
        raise ConnectionError("no reply")

    def _body(self, url: str) -> tuple[str | None, int, str | None]:
        for _ in range(HOPS + 1):
            reply, connection = self._reply(url)
            if reply.status in MOVED and reply.headers.get("Location"):
                reply.read(CHUNK)
                if not reply.isclosed():
                    self._drop(connection)
                url = urljoin(url, reply.headers["Location"])
                if urlsplit(url).scheme not in ("http", "https"):
                    return None, reply.status, "ValueError: only http and https"
                continue
            parts, size = [], 0
            too_large = int(reply.headers.get("Content-Length") or 0) > self.max_bytes
            while not too_large and (part := reply.read(CHUNK)):
                size += len(part)
                too_large = size > self.max_bytes
                parts.append(part)
            if too_large:
                self._drop(connection)
                return None, reply.status, "RuntimeError: the page is too large"
            if reply.status >= 400:
                return None, reply.status, f"RuntimeError: HTTP error {reply.status}"
            return decode(b"".join(parts), reply.headers.get_content_charset()), reply.status, None
        return None, 310, "RuntimeError: too many redirects"

    def _drop(self, connection: http.client.HTTPConnection) -> None:
        """Forget a connection of which a reply wasn't read to its end."""
        connection.close()
        self._open = {k: c for k, c in self._open.items() if c is not connection}

    def get(self, url: str) -> tuple[str | None, int | None, str | None]:
        """html, status and error of one URL."""
        if urlsplit(url).scheme not in ("http", "https"):
            return None, None, "ValueError: only http and https"
        status: int | None = None
        error: str | None = None
        for attempt in range(self.retries + 1):
            try:
                page, status, error = self._body(url)
                if error is None or status not in RETRIED:
                    return page, status, error
            except (TimeoutError, socket.timeout):
                error = "TimeoutError: no reply in time"
            except (OSError, http.client.HTTPException, ValueError) as found:
                error = f"ConnectionError: {found}"
            if attempt < self.retries:
                time.sleep(self.backoff * 2**attempt)
        return None, status, error


def fetch_one(url: str, **options: object) -> tuple[str | None, int | None, str | None]:
    """html, status and error of one URL, over a connection of its own."""
    with Session(**options) as session:
        return session.get(url)


def fetch(urls: DataFrame, rate_limit: float = 0.0, lanes: int = 1, partitions: int | None = None, **options: object) -> DataFrame:
    """page_id, url, html, status, error for a table (page_id, url). rate_limit: least seconds between requests to a host."""
    ship(urls.sparkSession)
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    lane = F.pmod(F.xxhash64("url"), F.lit(max(1, lanes))) if rate_limit else F.xxhash64("url")
    keys = [host.alias("host"), lane.alias("lane")]
    spread = urls.select(F.col("page_id").cast("long").alias("page_id"), "url", *keys)
    spread = spread.repartition(partitions, "host", "lane") if partitions else spread.repartition("host", "lane")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Session(pause=rate_limit * max(1, lanes), **options) as session:
            for batch in batches:
                rows = [(page_id, url, *session.get(url or "")) for page_id, url, *_ in batch.itertuples(index=False)]
                yield pd.DataFrame(rows, columns=["page_id", "url", "html", "status", "error"]).astype({"status": "Int32"})

    return spread.mapInPandas(run, SCHEMA)
