"""The engine as one object: a method per tool, resources by address, and a registry for own operators.

Methods return DataFrames (or plain values where a result is one small
record); nothing is collected but pages and graphs whose size a limit bounds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NullType, StructType

from . import hints
from .config import EngineConfig
from .errors import EngineError, from_source, invalid, not_found
from .functions import bodies
from .functions.schemas import SchemaTextError
from .operators import bodyquery, catalog, compare, flow, graphql, infer, meta, search, shapes, validation
from .sources.live import SourceError, register
from .sources.tables import read_table, ship_package

SCHEME = "wiregrain"
MOST_ROWS = 10_000


@dataclass(frozen=True)
class Operator:
    """A registered operator and the schema its results must have."""

    name: str
    run: Callable[..., DataFrame]
    schema: StructType


def _untyped(t: DataType) -> bool:
    if isinstance(t, StructType):
        return any(_untyped(f.dataType) for f in t.fields)
    return isinstance(t, NullType) or (hasattr(t, "elementType") and _untyped(t.elementType))


class Engine:
    """Analytics over the tables of a capture.

    ``tables`` maps names (sessions, entries, tls_client_hellos ...) to
    DataFrames; ``Engine.open`` reads them from a folder, ``Engine.live`` from
    a running service. The configuration comes from the environment where
    none is given.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], config: EngineConfig | None = None):
        self.spark, self.tables, self.config = spark, tables, config or EngineConfig.from_env()
        self.service: dict[str, str] = {}
        self.operators: dict[str, Operator] = {}
        ship_package(spark)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, config: EngineConfig | None = None) -> Engine:
        return cls(spark, {n: read_table(spark, folder, n) for n in ("sessions", "entries", "tls_client_hellos")}, config)

    @classmethod
    def live(cls, spark: SparkSession, base_url: str, session: str = "active", config: EngineConfig | None = None) -> Engine:
        """An engine over one session of a running service; its tables are read when a result is computed."""
        register(spark)
        config = config or EngineConfig.from_env()
        out = cls(spark, {}, config)
        out.service = {"base_url": base_url, "session": session, "timeout": str(config.client_timeout_s), "fetch_workers": str(config.fetch_workers)}
        out.tables |= {"entries": out.from_service("entries"), "sessions": out.from_service("sessions")}
        return out

    def from_service(self, what: str, **options: str) -> DataFrame:
        """A table of the service: entries, sessions, bookmarks, listed, tls or http2; failures in the engine's error codes."""
        if not self.service:
            raise invalid(f"{what}: this engine reads tables, not a service")
        try:
            return self.spark.read.format("capture").options(what=what, **(self.service | options)).load()
        except SourceError as e:
            raise from_source(e) from None

    @property
    def entries(self) -> DataFrame:
        return self.tables["entries"]

    # -- registry -------------------------------------------------------------

    def operator(self, name: str, schema: str | StructType) -> Callable:
        """Decorator that registers an own operator; its result is checked against ``schema`` when it is called."""
        want = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        if not want.fields or _untyped(want):
            raise invalid(f"operator {name} needs a typed, non-empty result schema")
        if name in self.operators:
            raise invalid(f"operator {name} is registered already")

        def wrap(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.operators[name] = Operator(name, run, want)
            return run

        return wrap

    def without(self, name: str) -> None:
        self.operators.pop(name, None)

    def call(self, name: str, *args: Any, **kwargs: Any) -> DataFrame:
        """Run a registered operator with this engine as its first argument."""
        op = self.operators.get(name)
        if op is None:
            raise not_found("operator", name)
        out = op.run(self, *args, **kwargs)
        have = [(f.name, f.dataType.simpleString()) for f in out.schema.fields]
        want = [(f.name, f.dataType.simpleString()) for f in op.schema.fields]
        if have != want:
            raise invalid(f"operator {name} gave {have}, not {want}")
        return out

    # -- sessions and entries -------------------------------------------------

    def sessions_list(self) -> DataFrame:
        return meta.sessions_list(self.tables["sessions"])

    def session_active(self, session_id: str = "") -> str:
        """The given session, else the only one."""
        if session_id:
            return session_id
        rows = self.tables["sessions"].select("session_id", "name").orderBy("session_id").limit(51).collect()
        if len(rows) == 1:
            return rows[0]["session_id"]
        if not rows:
            raise not_found("session", "active")
        listed = ", ".join(f"{r['session_id']} ({r['name']})" if r["name"] else r["session_id"] for r in rows[:50]) + (" and more" if len(rows) > 50 else "")
        raise invalid(f"several sessions are open, name one of them: {listed}")

    def search_entries(self, query: str = "", filters: search.Filters | None = None, limit: int = 0, offset: int = 0, include_details: bool = False, among: DataFrame | None = None) -> DataFrame:
        """Ranked entries; without details the connection, size and process columns are left out.

        ``among`` holds the ``entry_id`` of those to search, such as ``bookmarked()`` or ``listed()``.
        """
        c = self.config
        entries = self.entries if among is None else self.entries.join(among.select("entry_id").distinct(), "entry_id", "left_semi")
        found = search.search(entries, query, filters or search.Filters(), min(limit or c.default_search_limit, c.max_search_results), offset, c.index_body, c.index_body_max_bytes)
        thin = ("tls_connection_id", "ja3", "ja4", "h2_connection_id", "h2_stream_id", "req_body_bytes", "resp_body_bytes", "process_name", "pid")
        return found if include_details else found.drop(*thin)

    def get_entry(self, entry_id: str, body_mode: str = "compact", include_headers: bool = False, max_bytes: int = 0) -> dict:
        """One entry for display."""
        if body_mode not in ("compact", "schema", "full"):
            raise invalid("body_mode must be 'compact', 'schema' or 'full'")
        rows = self.entries.where(F.col("entry_id") == entry_id).orderBy(F.desc("ingested_at")).limit(1).collect()
        if not rows:
            raise not_found("entry", entry_id)
        out = rows[0].asDict(recursive=True)
        for side in ("request", "response"):
            part = out.get(side)
            if part:
                kind = next((h[1] or "" for h in part["headers"] or [] if len(h) > 1 and (h[0] or "").lower() == "content-type"), "")
                part["body"] = self._shown(part["body"], kind, body_mode, max_bytes)
                if not include_headers:
                    part["headers"] = []
        return out

    @staticmethod
    def _shown(encoded: str | None, kind: str, mode: str, max_bytes: int) -> str:
        import base64

        if not encoded:
            return ""
        try:
            return bodies.display(base64.b64decode(encoded, validate=True), kind, mode, max_bytes)
        except ValueError as e:
            return f"[decode error: {e}]"

    def bookmarked(self) -> DataFrame:
        """Ids of the bookmarked entries of the live session."""
        return self.from_service("bookmarks")

    def listed(self, selected: bool = False, bookmarked: bool = False, highlighted: Sequence[str] = ()) -> DataFrame:
        """Ids of the entries that are selected, bookmarked or highlighted in the live session."""
        return self.from_service("listed", selected=str(selected).lower(), bookmarked=str(bookmarked).lower(), highlighted=",".join(highlighted))

    def tls_events(self, *connections: str) -> DataFrame:
        """All events of TLS connections of the live service, in order."""
        return self.from_service("tls", connections=",".join(connections)).orderBy("connection_id", "event_no")

    def http2_frames(self, connection_id: str, stream_id: int = 0) -> DataFrame:
        """All frames of an HTTP/2 connection of the live service, or of one stream, in order."""
        more = {"stream": str(stream_id)} if stream_id else {}
        return self.from_service("http2", connections=connection_id, **more).orderBy("stream_id", "frame_no")

    def get_tls(self, connection_id: str) -> DataFrame:
        """Handshake messages of a connection: its events in a live session, else the stored ClientHellos."""
        if self.service:
            return self.tls_events(connection_id)
        return self.tables["tls_client_hellos"].where(F.col("connection_id") == connection_id).distinct().orderBy("seen_at")

    def get_http2_stream(self, connection_id: str, stream_id: int) -> DataFrame:
        """Entries on one stream of a connection; ``http2_frames`` has its frames."""
        return meta.entries_meta(self.entries).where((F.col("h2_connection_id") == connection_id) & (F.col("h2_stream_id") == stream_id))

    # -- comparison -----------------------------------------------------------

    def fingerprint(self, entry_id: str, max_bytes: int = 1 << 20) -> DataFrame:
        return compare.fingerprints(self.entries.where(F.col("entry_id") == entry_id), max_bytes)

    def diff_entries(self, baseline: str, candidate: str, ignore_headers: Sequence[str] = compare.IGNORED_HEADERS) -> DataFrame:
        """Differences of two entries, with severity and moved headers."""
        pairs = self.spark.createDataFrame([(baseline, candidate)], "baseline_id string, candidate_id string")
        two = self.entries.where(F.col("entry_id").isin(baseline, candidate))
        found = compare.diffs(two, pairs, self.tables.get("tls_client_hellos"), ignore_headers)
        return found.join(compare.header_moves(two, pairs), ["baseline_id", "candidate_id"], "left")

    # -- catalog --------------------------------------------------------------

    def extract_endpoints(self, scope: catalog.Scope | None = None, min_count: int = 0, category: str = "", normalize_ids: bool = True, max_clusters: int = 200, limit: int = 0, offset: int = 0) -> DataFrame:
        found = catalog.endpoint_clusters(self.entries, scope, min_count, category, normalize_ids)
        return catalog.endpoint_page(found, max_clusters, limit or self.config.default_cluster_limit, offset)

    def describe_endpoint(self, cluster_id: str, max_examples: int = 5) -> dict[str, DataFrame]:
        """Headers, authentication, query keys, body shapes and examples of one cluster."""
        inside = lambda df: df.where(F.col("cluster_id") == cluster_id)
        # all deliveries of entries of which some delivery is in the cluster; the latest one decides
        flat = meta.with_meta(self.entries, catalog.KEY)
        near = self.entries.join(flat.where(catalog.cluster_id() == cluster_id).select("entry_id").distinct(), "entry_id", "left_semi")
        return {
            "headers": inside(catalog.header_frequency(near, max_examples)),
            "auth": inside(catalog.auth_signals(near, max_examples)),
            "query_keys": inside(catalog.query_keys(near, max_examples)),
            "request_shape": inside(shapes.body_shapes(near, "request", max_examples)),
            "response_shape": inside(shapes.body_shapes(near, "response", max_examples)),
            "examples": catalog.cluster_members(near, only=cluster_id).where(F.col("place") < max_examples),
        }

    def trace_flow(self, seed: str, window_ms: int = 120_000, same_pid: bool = True, same_host: bool = True, limit: int = 50) -> tuple[DataFrame, DataFrame]:
        if not self.entries.where(F.col("entry_id") == seed).limit(1).collect():
            raise not_found("seed entry", seed)
        return flow.trace(self.entries, seed, window_ms, same_pid, same_host, limit)

    # -- bodies ---------------------------------------------------------------

    def members(self, cluster_id: str = "", entry_ids: Sequence[str] = (), most: int = 0) -> list[str]:
        """At most ``max_query_entries`` ids of a cluster, or the given ones, in order."""
        if not cluster_id and not entry_ids:
            raise invalid("name a cluster or entries")
        most = min(most or self.config.default_query_limit, self.config.max_query_entries)
        if not cluster_id:
            return list(entry_ids)[:most]
        rows = catalog.cluster_members(self.entries, only=cluster_id).where(F.col("place") < most).orderBy("place").collect()
        if not rows:
            raise not_found("cluster", cluster_id)
        return [r["entry_id"] for r in rows]

    def query_body(self, expression: str, cluster_id: str = "", entry_ids: Sequence[str] = (), mode: str = "", target: str = "response", deduplicate: bool = False, max_entries: int = 0) -> DataFrame:
        try:
            found = bodyquery.query_bodies(self.entries, expression, mode, target, self.members(cluster_id, entry_ids, max_entries), self.config.max_query_values)
        except ValueError as e:
            raise invalid(str(e)) from None
        return bodyquery.values_of(found, deduplicate)

    def infer_schema(self, cluster_id: str = "", entry_ids: Sequence[str] = (), target: str = "response", max_entries: int = 0) -> tuple[DataFrame, DataFrame]:
        """Shapes and field statistics of the bodies of a cluster or of entries."""
        chosen = self.entries.where(F.col("entry_id").isin(self.members(cluster_id, entry_ids, max_entries)))
        return shapes.body_shapes(chosen, target, self.config.max_infer_entries), infer.field_stats(chosen, target)

    def validate_schema(self, schema: str, notation: str, cluster_id: str = "", entry_ids: Sequence[str] = (), target: str = "response", max_entries: int = 0) -> DataFrame:
        chosen = self.entries.where(F.col("entry_id").isin(self.members(cluster_id, entry_ids, max_entries)))
        try:
            return validation.validate_bodies(chosen, schema, notation, target)
        except SchemaTextError as e:
            raise invalid(str(e)) from None

    # -- GraphQL --------------------------------------------------------------

    def survey_graphql(self, operation_type: str = "", host: str = "", limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """A page of operations, and the summary of all traffic."""
        ops = graphql.operations(self.entries)
        if host:
            ops = ops.where(search.host_is(host))
        chosen = ops.where(F.col("type") == operation_type) if operation_type else ops
        return graphql.operation_clusters(chosen).orderBy(F.desc("count"), "name").offset(offset).limit(limit), graphql.traffic_summary(ops)

    SECTIONS = ("query", "variables", "response_shape", "errors", "fragment_warnings", "fragment_coverage", "response_variants")

    def inspect_graphql_operation(self, name: str, sections: Sequence[str] = (), max_entries: int = 20) -> dict[str, DataFrame]:
        """The named sections (default all) of an operation's newest entries."""
        unknown = set(sections) - set(self.SECTIONS)
        if unknown:
            raise invalid(f"unknown sections: {', '.join(sorted(unknown))}")
        ops = graphql.operations(self.entries).where(F.col("name") == name)
        newest = graphql.operation_examples(ops, min(max_entries or 20, 100)).select("entry_id").distinct()
        ops = ops.join(newest, "entry_id", "left_semi")
        made: dict[str, Callable[[], DataFrame]] = {
            "query": lambda: ops.orderBy(F.desc("ts_ms"), "entry_id").select("type", "fields", "raw_query").limit(1),
            "variables": lambda: graphql.variable_distributions(ops, top=20),
            "response_shape": lambda: infer.field_stats(self.entries.join(newest, "entry_id", "left_semi")),
            "errors": lambda: graphql.error_summary(ops),
            "fragment_warnings": lambda: graphql.fragment_warnings(ops),
            "fragment_coverage": lambda: graphql.fragment_coverage(ops),
            "response_variants": lambda: graphql.response_variants(ops),
        }
        return {s: made[s]() for s in sections or self.SECTIONS}

    # -- advice ---------------------------------------------------------------

    def search_hint(self, page: DataFrame, total: int, offset: int = 0) -> str:
        """What to do after a page of ``search_entries`` of so many hits."""
        return hints.search(total, page.count(), offset)

    def endpoints_hint(self, page: DataFrame) -> str:
        """What to do after a page of ``extract_endpoints``."""
        rows = page.select("category", "total_count").collect()
        counts: dict[str, int] = {}
        for r in rows:
            counts[r["category"]] = counts.get(r["category"], 0) + 1
        return hints.endpoints(rows[0]["total_count"] if rows else 0, len(rows), counts)

    def query_hint(self, found: DataFrame, mode: str = "") -> str:
        """What to do after ``bodyquery.query_bodies``."""
        rows = {r["status"]: r for r in bodyquery.query_summary(found).collect()}
        n = {k: rows[k]["n_bodies"] if k in rows else 0 for k in ("value", "nothing", "error")}
        return hints.query(rows["value"]["n_values"] if "value" in rows else 0, sum(n.values()), mode, n["error"])

    # -- resources ------------------------------------------------------------

    def resource(self, address: str) -> str:
        """Text of a resource: entry, tls, http2, diff, catalog, flow, or a part of a GraphQL operation."""
        m = re.fullmatch(rf"{SCHEME}://(\w+)/(.+)", address)
        kind, parts = (m.group(1), m.group(2).split("/")) if m else ("", [])
        shape = {"entry": 2, "tls": 1, "http2": 2, "diff": 2, "catalog": 1, "flow": 1, "graphql": 3}
        if shape.get(kind) != len(parts):
            raise invalid(f"no such resource: {address}")
        if kind == "entry":
            return json.dumps(self.get_entry(parts[1], "full", include_headers=True), indent=2, default=str)
        if kind == "tls":
            return self._rows(self.get_tls(parts[0]))
        if kind == "http2":
            return self._rows(self.get_http2_stream(parts[0], int(parts[1])))
        if kind == "diff":
            return self._rows(self.diff_entries(*parts))
        if kind == "catalog":
            if parts[0] != catalog.scope_hash():
                raise not_found("scope", parts[0])
            return self._rows(catalog.endpoint_page(catalog.endpoint_clusters(self.entries), 2000, 2000))
        if kind == "flow":
            nodes, edges = self.trace_flow(parts[0])
            return json.dumps({"nodes": json.loads(self._rows(nodes.select("entry_id", "ts_ms", "host"))), "edges": json.loads(self._rows(edges))}, indent=2)
        sections = {"query": "query", "response-schema": "response_shape", "field-stats": "response_shape", "errors": "errors"}
        if parts[2] not in sections:
            raise invalid(f"no such resource: {address}")
        return self._rows(self.inspect_graphql_operation(parts[1], [sections[parts[2]]])[sections[parts[2]]])

    @staticmethod
    def _rows(df: DataFrame) -> str:
        """Rows of a result as JSON text; a result that is too large for a text is an error."""
        rows = df.limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise invalid(f"more than {MOST_ROWS} rows: query the table instead")
        return json.dumps([r.asDict(recursive=True) for r in rows], indent=2, default=str)


__all__ = ["Engine", "EngineError", "Operator", "SCHEME"]
