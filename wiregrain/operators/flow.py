"""Flow graphs: which entries belong together, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import places, stage
from .meta import entries_meta

_NODE = ("session_id", "ts_ms", "host", "pid", "tls_connection_id", "h2_connection_id", "auth_header", "cookies", "api_keys", "set_cookies")


def flow_nodes(entries: DataFrame) -> DataFrame:
    """The columns of entries that flow analysis reads."""
    return entries_meta(entries, _NODE)


def related(nodes: DataFrame, seed_id: str, window_ms: int = 120_000, same_pid: bool = True, same_host: bool = True) -> DataFrame:
    """Entries related to a seed: on its TLS or HTTP/2 connection, or near in time with its process and host.

    The seed is one row, found by its key; an unknown seed relates to nothing.
    """
    found = nodes.where(F.col("entry_id") == seed_id).limit(1).collect()
    if not found:
        return nodes.limit(0)
    seed = found[0]
    near = F.abs(F.col("ts_ms") - seed["ts_ms"]) <= window_ms // 2
    if same_pid:
        near = near & (F.col("pid") == seed["pid"])
    if same_host:
        near = near & (F.col("host") == seed["host"])
    test = (F.col("entry_id") == seed_id) | near
    for connection in ("tls_connection_id", "h2_connection_id"):
        if seed[connection]:
            test = test | (F.col(connection) == seed[connection])
    return nodes.where(test)


def _keys(scope: Column) -> Column:
    """(reason, key) of everything that ties an entry to others."""

    def one(reason: str, value: Column) -> Column:
        return F.when(value != "", F.array(F.struct(F.lit(reason).alias("reason"), F.concat_ws("\x1f", scope, value).alias("key"))))

    def many(reason: str, named: str) -> Column:
        return F.transform(named, lambda x: F.struct(F.lit(reason).alias("reason"), F.concat_ws("\x1f", scope, F.concat(x["name"], F.lit(":"), F.coalesce(x["value"], F.lit("")))).alias("key")))

    none = F.array().cast("array<struct<reason:string,key:string>>")
    parts = [
        one("same_tls", F.col("tls_connection_id")),
        one("same_h2", F.col("h2_connection_id")),
        one("same_auth", F.col("auth_header")),
        many("same_api_key", "api_keys"),
        many("same_session_cookie", "cookies"),
        F.array(F.struct(F.lit("temporal").alias("reason"), scope.alias("key"))),
    ]
    return F.concat(*[F.coalesce(p, none) for p in parts])


_SALT = 16


def flow_edges(nodes: DataFrame, per_session: bool = False) -> DataFrame:
    """Edges among the nodes: from_id, to_id, reason; each once.

    Neighbours in time of equal TLS or HTTP/2 connection, authorisation, API
    key or session cookie; neighbours in time that share no connection
    (``temporal``); and from the first setter of a session cookie on a host to
    later users of it. Rows are ranked within their key by ranges, so a key
    that ties most entries together is no single task.
    """
    scope = F.col("session_id") if per_session else F.lit("")
    tied = nodes.select("entry_id", "ts_ms", "tls_connection_id", "h2_connection_id", F.explode(_keys(scope)).alias("k")).select(
        "k.*", "entry_id", "ts_ms", "tls_connection_id", "h2_connection_id"
    )
    ranked = stage(places(tied, ["reason", "key"], ["ts_ms", "entry_id"]), "flow-places")
    nxt = ranked.select("reason", "key", (F.col("place") - 1).alias("place"), F.col("entry_id").alias("to_id"), F.col("tls_connection_id").alias("_tls"), F.col("h2_connection_id").alias("_h2"))
    same = ((F.col("tls_connection_id") != "") & (F.col("tls_connection_id") == F.col("_tls"))) | ((F.col("h2_connection_id") != "") & (F.col("h2_connection_id") == F.col("_h2")))
    chained = ranked.join(nxt, ["reason", "key", "place"]).where((F.col("reason") != "temporal") | ~same).select(F.col("entry_id").alias("from_id"), "to_id", "reason")
    return chained.unionByName(cookie_origins(nodes, per_session)).distinct()


def cookie_origins(nodes: DataFrame, per_session: bool = False) -> DataFrame:
    """From the earliest entry that sets a session cookie on a host to later entries that send one of that name."""
    scope = F.col("session_id") if per_session else F.lit("")
    sets = nodes.select(scope.alias("scope"), "host", F.explode("set_cookies").alias("c"), "ts_ms", "entry_id")
    first = sets.groupBy("scope", "host", F.col("c.name").alias("name")).agg(F.min(F.struct("ts_ms", "entry_id")).alias("s"))
    uses = nodes.select(scope.alias("scope"), "host", F.explode("cookies").alias("c"), "ts_ms", "entry_id").select("scope", "host", F.col("c.name").alias("name"), "ts_ms", "entry_id")
    # a hot host's cookie has one setter and most users: these meet it in as many places as there are salts
    uses = uses.withColumn("_salt", F.pmod(F.xxhash64("entry_id"), F.lit(_SALT)).cast("int"))
    first = first.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(_SALT)])))
    return (
        uses.join(first, ["scope", "host", "name", "_salt"])
        .where((F.col("s.ts_ms") < F.col("ts_ms")) & (F.col("s.entry_id") != F.col("entry_id")))
        .select(F.col("s.entry_id").alias("from_id"), F.col("entry_id").alias("to_id"), F.lit("session_cookie_origin").alias("reason"))
        .distinct()
    )


def trace(entries: DataFrame, seed_id: str, window_ms: int = 120_000, same_pid: bool = True, same_host: bool = True, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the flow around a seed; beyond ``limit`` nodes the graph is pruned."""
    nodes = stage(related(flow_nodes(entries), seed_id, window_ms, same_pid, same_host), "flow-nodes")
    edges = stage(flow_edges(nodes), "flow-edges")
    return prune(nodes, edges, seed_id, limit)


def prune(nodes: DataFrame, edges: DataFrame, seed_id: str, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` nodes in breadth-first order from the seed, and the edges among them.

    The result is at most ``limit`` ids, so these are kept on the driver; each
    step is one join of the edges with the frontier. Within a depth nodes go
    by time, then id.
    """
    if len(nodes.select("entry_id").limit(limit + 1).collect()) <= limit:
        return nodes, edges
    both = edges.select("from_id", "to_id").unionByName(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    seen, frontier = [seed_id], [seed_id]
    while frontier and len(seen) < limit:
        found = both.where(F.col("from_id").isin(frontier) & ~F.col("to_id").isin(seen)).select(F.col("to_id").alias("entry_id")).distinct()
        rows = found.join(nodes.select("entry_id", "ts_ms"), "entry_id").orderBy("ts_ms", "entry_id").limit(limit - len(seen)).collect()
        frontier = [r["entry_id"] for r in rows]
        seen += frontier
    return nodes.where(F.col("entry_id").isin(seen)), edges.where(F.col("from_id").isin(seen) & F.col("to_id").isin(seen))


def edge_summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
