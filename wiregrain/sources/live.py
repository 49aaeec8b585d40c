"""A running capture service as a Spark source, in batch and as a stream.

``register(spark)`` makes the format ``capture`` known:

    spark.read.format("capture").option("base_url", url).option("session", id).load()
    spark.readStream.format("capture").option("base_url", url).option("session", id).load()

Rows are in the layout of the ``entries`` table. Ids of the session are cut
into slices, which parallel tasks fetch, in batch and in a stream alike. An
entry that the service no longer has is left out; any other failure is tried
again with growing pauses and then fails the task, so Spark tries it anew and
no offset moves past an entry that was not read.

A stream polls the id list: what is appended is new; if the list shrank or its
known end changed, the list is read from its start (of copies of an entry the
latest delivery counts). ``tail_limit`` > 0 restricts such reads to the end of
the list.

Further tables are read with the option ``what``: sessions; bookmarks (ids of
a session); listed (ids that are selected, bookmarked or highlighted); tls
(events of the option ``connections``); http2 (frames of all streams of the
connections, or of the option ``stream``).
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

ENTRY_SCHEMA = (
    "entry_id string, session_id string, capture_file string, file_no int, url string, http_version string, transaction_type string, "
    "request struct<method:string,path:string,headers:array<array<string>>,body:string>, "
    "response struct<status_code:int,status_text:string,headers:array<array<string>>,body:string>, "
    "timings struct<started_at:bigint,blocked:bigint,wait:bigint,receive:bigint>, process struct<pid:int,name:string>, "
    "tls struct<connection_id:string,tls_version:int,ja3_hash:string,ja4_hashed:string>, http2 struct<connection_id:string,stream_id:int>, ingested_at timestamp"
)
#: schema by what is read
SCHEMAS = {
    "entries": ENTRY_SCHEMA,
    "sessions": "session_id string, name string, entry_ids array<string>",
    "bookmarks": "session_id string, entry_id string",
    "listed": "session_id string, entry_id string",
    "tls": "connection_id string, event_no int, side string, message_type string, message string",
    "http2": "connection_id string, stream_id int, frame_no int, frame_type string, frame string",
}


class SourceError(Exception):
    """The service answered with an error status."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class CaptureClient:
    """The read-only JSON interface of a capture service."""

    # Colours by which listed entries may be selected.
    COLOURS = ("red", "green", "blue", "yellow", "gray", "orange", "pink", "purple", "strikethrough")

    def __init__(self, base_url: str = "http://localhost:7777", timeout: float = 10.0):
        self.base, self.timeout = base_url.rstrip("/"), timeout

    def get(self, *path: str, **query: str) -> object:
        url = self.base + "".join("/" + urllib.parse.quote(p, safe="") for p in path)
        if query:
            url += "?" + urllib.parse.urlencode(query)
        try:
            with urllib.request.urlopen(url, timeout=self.timeout) as response:  # noqa: S310
                return json.load(response)
        except urllib.error.HTTPError as e:
            raw = e.read()
            try:
                message = json.loads(raw)["error"]
            except (ValueError, KeyError, TypeError):
                message = raw.decode("utf-8", "replace")
            raise SourceError(e.code, message) from None

    def sessions(self) -> list[dict]:
        return self.get("sessions")

    def session(self, key: str = "active") -> dict:
        return self.get("sessions", key)

    def bookmarks(self, session: str) -> list[str]:
        return self.get("sessions", session, "bookmarks")

    def entries(self, session: str, selected: bool = False, bookmarked: bool = False, highlighted: tuple[str, ...] = ()) -> list[dict]:
        bad = set(highlighted) - set(self.COLOURS)
        if bad:
            raise ValueError(f"unknown colours: {', '.join(sorted(bad))}")
        query = {k: "" for k, on in (("selected", selected), ("bookmarked", bookmarked)) if on}
        return self.get("sessions", session, "entries", **query, **({"highlighted": ",".join(highlighted)} if highlighted else {}))

    def entry(self, session: str, key: str) -> dict:
        return self.get("sessions", session, "entries", key)

    def websocket(self, session: str, key: str) -> list[dict]:
        return self.get("sessions", session, "entries", key, "websocket")

    def tls(self, connection: str) -> list[dict]:
        return self.get("tls", connection)

    def http2_streams(self, connection: str) -> list[int]:
        return self.get("http2", connection)

    def http2_frames(self, connection: str, stream: int) -> list[dict]:
        return self.get("http2", connection, "streams", str(stream))


def frame_counts(frames: list[dict]) -> dict[str, int]:
    """Frames of an HTTP/2 stream per type."""
    out: dict[str, int] = {}
    for f in frames:
        if f.get("type"):
            out[f["type"]] = out.get(f["type"], 0) + 1
    return out


def tls_summary(events: list[dict]) -> dict[str, str]:
    """Version and cipher suite a handshake agreed on: those of the last ServerHello, else the version of the ClientHello."""
    out = {"tls_version": "", "cipher_suite": ""}
    for e in events:
        shake = (e.get("msg") or {}).get("handshake") or {}
        if shake.get("type") == "server_hello":
            hello = shake.get("server_hello") or shake
            out = {"tls_version": hello["version"]["name"], "cipher_suite": hello["cipher_suite"]["name"]}
        elif shake.get("type") == "client_hello" and not out["tls_version"]:
            out["tls_version"] = (shake.get("client_hello") or shake)["version"]["name"]
    return out


def entry_row(entry: dict, session: str) -> tuple:
    """An entry of the interface in the layout of the ``entries`` table."""

    def part(value: dict | None, *names: str) -> tuple | None:
        return None if value is None else tuple(value.get(n) for n in names)

    tls = entry.get("tls") or {}
    return (
        entry["id"], session, "", 0, entry.get("url"), entry.get("httpVersion"), entry.get("transactionType"),
        part(entry.get("request"), "method", "path", "headers", "body"),
        part(entry.get("response"), "statusCode", "statusText", "headers", "body"),
        part(entry.get("timings"), "startedAt", "blocked", "wait", "receive"),
        part(entry.get("process"), "pid", "name"),
        (tls.get("connectionId"), tls.get("tlsVersion"), (tls.get("ja3") or {}).get("hash"), (tls.get("ja4") or {}).get("hashed")),
        part(entry.get("http2"), "connectionId", "streamId"),
        datetime.now(UTC),
    )


def patient(call: Callable[[], object], retries: int = 4, pause: float = 0.2) -> object | None:
    """The result of a call; nothing where the service has none (404). Other failures are tried again, then raised."""
    for attempt in range(retries + 1):
        try:
            return call()
        except SourceError as e:
            if e.status == 404:
                return None
            if attempt == retries:
                raise
        except (OSError, ValueError):
            if attempt == retries:
                raise
        time.sleep(pause * 2**attempt)
    return None


def fetch(client: CaptureClient, session: str, keys: list[str], workers: int, retries: int = 4) -> Iterator[tuple]:
    """Rows of the entries that the service has, in order."""

    def one(key: str) -> tuple | None:
        found = patient(lambda: client.entry(session, key), retries)
        return None if found is None else entry_row(found, session)

    with ThreadPoolExecutor(workers) as pool:
        yield from filter(None, pool.map(one, keys))


class _Slice(InputPartition):
    def __init__(self, session: str, keys: list[str]):
        self.session, self.keys = session, keys


class _Source:
    """Options and slices common to batch and stream."""

    def __init__(self, options: dict):
        self.options = options
        self.client = CaptureClient(options.get("base_url", "http://localhost:7777"), float(options.get("timeout", 10)))
        self.session = options.get("session", "active")

    def slices(self, session: str, keys: list[str]) -> list[InputPartition]:
        size = int(self.options.get("slice", 1000))
        return [_Slice(session, keys[i : i + size]) for i in range(0, len(keys), size)] or [_Slice(session, [])]

    def rows(self, part: _Slice) -> Iterator[tuple]:
        return fetch(self.client, part.session, part.keys, int(self.options.get("fetch_workers", 16)), int(self.options.get("retries", 4)))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.source = _Source(options)

    def partitions(self) -> list[InputPartition]:
        source, what = self.source, self.source.options.get("what", "entries")
        if what in ("tls", "http2"):
            return [_Slice("", [c]) for c in source.options.get("connections", "").split(",") if c] or [_Slice("", [])]
        if what != "entries":
            return [_Slice("", [])]
        session = source.client.session(source.session)
        return source.slices(session["id"], session.get("entryIds") or [])

    def read(self, partition: _Slice) -> Iterator[tuple]:
        source, client = self.source, self.source.client
        options, what = source.options, source.options.get("what", "entries")
        if what == "entries":
            yield from source.rows(partition)
        elif what == "sessions":
            yield from ((s["id"], s.get("name"), s.get("entryIds")) for s in client.sessions())
        elif what == "bookmarks":
            session = client.session(source.session)["id"]
            yield from ((session, key) for key in client.bookmarks(session))
        elif what == "listed":
            session = client.session(source.session)["id"]
            colours = tuple(c for c in options.get("highlighted", "").split(",") if c)
            found = client.entries(session, options.get("selected") == "true", options.get("bookmarked") == "true", colours)
            yield from ((session, e["id"]) for e in found)
        elif what == "tls":
            for connection in partition.keys:
                for n, event in enumerate(patient(lambda c=connection: client.tls(c)) or []):
                    yield connection, n, event.get("side"), message_type(event), json.dumps(event.get("msg"), ensure_ascii=False)
        else:
            for connection in partition.keys:
                streams = [int(options["stream"])] if options.get("stream") else patient(lambda c=connection: client.http2_streams(c)) or []
                for stream in streams:
                    for n, frame in enumerate(patient(lambda c=connection, s=stream: client.http2_frames(c, s)) or []):
                        yield connection, stream, n, frame.get("type"), json.dumps(frame, ensure_ascii=False)


def message_type(event: dict) -> str | None:
    """The handshake message of a TLS event, else its content type."""
    message = event.get("msg") or {}
    return (message.get("handshake") or {}).get("type") or message.get("type")


def new_keys(keys: list[str], known: int, tail: str, tail_limit: int = 0) -> tuple[list[str], bool]:
    """What to read of an id list, given how long it was and how it ended; and whether it is read anew."""
    if known and (len(keys) < known or keys[known - 1] != tail):
        known = 0
    return (keys[known:], False) if known else (keys[-tail_limit:] if tail_limit > 0 else keys, True)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.source = _Source(options)
        self.tail_limit = int(options.get("tail_limit", 0))

    def initialOffset(self) -> dict:
        return {"known": 0, "tail": ""}

    def latestOffset(self) -> dict:
        keys = self.source.client.session(self.source.session).get("entryIds") or []
        return {"known": len(keys), "tail": keys[-1] if keys else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        session = self.source.client.session(self.source.session)
        keys = (session.get("entryIds") or [])[: end["known"]]
        return self.source.slices(session["id"], new_keys(keys, start["known"], start["tail"], self.tail_limit)[0])

    def read(self, partition: _Slice) -> Iterator[tuple]:
        return self.source.rows(partition)

    def commit(self, end: dict) -> None:
        """The service keeps its entries."""


class CaptureDataSource(DataSource):
    """Format ``capture``: options base_url, session, what, connections, stream, selected, bookmarked, highlighted, slice, fetch_workers, retries, tail_limit, timeout."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        what = self.options.get("what", "entries")
        if what not in SCHEMAS:
            raise ValueError(f"what must be one of {', '.join(SCHEMAS)}")
        return SCHEMAS[what]

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureDataSource)
