"""From spans to a service dependency graph: one lazy plan of a self equi-join and three groupings.

Every function takes `by`, extra grouping columns (such as a window), so that batch discovery is the case of one group.
Parents are looked up only within the same group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import edge_evidence, edge_id, edge_identity, edge_kind, endpoint_id, endpoint_method, endpoint_path, facts
from ..functions.text import round2, strip

PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def duration_ms(start_ns: Column, end_ns: Column) -> Column:
    """Milliseconds at three decimals; null if either end is unknown or they are reversed."""
    return F.when(end_ns >= start_ns, F.round((end_ns - start_ns) / 1e6, 3))


def event_ns(start_ns: Column, end_ns: Column) -> Column:
    return F.coalesce(end_ns, start_ns)


def prepare(spans: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Spans of a known service with what discovery reads; attributes are projected before any shuffle."""
    return spans.where(strip(F.col("service")) != "").select(
        *by, strip(F.col("trace_id")).alias("trace_id"), strip(F.col("span_id")).alias("span_id"), strip(F.col("parent_span_id")).alias("parent_id"),
        strip(F.col("service")).alias("service"), facts(F.col("kind"), F.col("name"), F.col("attributes")).alias("own"), "start_ns", "end_ns", "seq",
    )


def link_parents(spans: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each prepared span with `parent` (service and facts) where there is one. Of repeated (trace, span) ids the last is the parent."""
    index = spans.where("trace_id <> '' and span_id <> ''").groupBy(*by, "trace_id", F.col("span_id").alias("parent_id")).agg(F.max_by(F.struct("service", "own"), "seq").alias("parent"))
    asks = F.col("trace_id") != ""
    return spans.withColumn("parent_id", F.when(asks, F.nullif("parent_id", F.lit("")))).join(index, [*by, "trace_id", "parent_id"], "left")


def services(spans: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, observations, trace_count, first_ns, last_ns) of prepared spans."""
    at = event_ns(F.col("start_ns"), F.col("end_ns"))
    return spans.groupBy(*by, F.col("service").alias("id")).agg(F.count("*").alias("observations"), F.count_distinct(F.nullif("trace_id", F.lit(""))).alias("trace_count"), F.min(at).alias("first_ns"), F.max(at).alias("last_ns"))


def cross_service(linked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each span whose parent is of another service, with the edge that it observes."""
    parent, child = F.col("parent.own"), F.col("own")
    kind = edge_kind(parent, child)
    rows = linked.where("parent is not null and parent.service <> service")
    rows = rows.select(
        *by, F.col("parent.service").alias("from"), F.col("service").alias("to"), kind.alias("kind"), (kind == "sync").alias("blocking"), edge_identity(parent, child).alias("identity"),
        edge_evidence(parent, child).alias("evidence"), "trace_id", duration_ms(F.col("start_ns"), F.col("end_ns")).alias("ms"), event_ns(F.col("start_ns"), F.col("end_ns")).alias("at"),
    )
    return rows.withColumn("id", edge_id(F.col("from"), F.col("to"), F.col("kind"), F.col("blocking"), F.col("identity")))


def edges(linked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, from, to, kind, blocking, identity, observations, trace_count, evidence, p50.., first_ns, last_ns)."""
    ranks = F.expr(f"percentile_disc(array({', '.join(map(str, PERCENTILES))})) within group (order by ms)")
    grouped = cross_service(linked, by).groupBy(*by, "id").agg(
        *[F.first(c).alias(c) for c in ("from", "to", "kind", "blocking", "identity")],
        F.count("*").alias("observations"), F.count_distinct(F.nullif("trace_id", F.lit(""))).alias("trace_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence"), ranks.alias("ranks"), F.min("at").alias("first_ns"), F.max("at").alias("last_ns"),
    )
    return grouped.select("*", *[F.get("ranks", F.lit(i)).alias(f"p{str(p)[2:]:0<2}") for i, p in enumerate(PERCENTILES)]).drop("ranks")


def endpoint_rows(linked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Spans that enter a service at a known method and path: servers, and others unless their parent is of the same service."""
    own = F.col("own")
    rows = linked.select(*by, "service", "trace_id", event_ns(F.col("start_ns"), F.col("end_ns")).alias("at"), endpoint_method(own).alias("method"), endpoint_path(own).alias("path"), own["kind"].alias("kind"), F.coalesce(F.col("parent.service") == F.col("service"), F.lit(False)).alias("inner"))
    return rows.where((F.col("method") != "") & (F.col("path") != "") & ((F.col("kind") == "server") | ~F.col("inner")))


def endpoints(linked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, entry_service, method, path, observations, trace_count, first_ns, last_ns)."""
    rows = endpoint_rows(linked, by).withColumn("id", endpoint_id(F.col("service"), F.col("method"), F.col("path")))
    return rows.groupBy(*by, "id").agg(F.first("service").alias("entry_service"), F.first("method").alias("method"), F.first("path").alias("path"), F.count("*").alias("observations"), F.count_distinct(F.nullif("trace_id", F.lit(""))).alias("trace_count"), F.min("at").alias("first_ns"), F.max("at").alias("last_ns"))


def totals(spans: DataFrame, linked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(spans, traces, linked): all spans counted, those without a service too; traces and pairs of spans that have one."""
    counted = spans.groupBy(*by).agg(F.count("*").alias("spans"), F.count_distinct(F.when(strip(F.col("service")) != "", F.nullif("trace_id", F.lit("")))).alias("traces"))
    pairs = linked.groupBy(*by).agg(F.count_if(F.coalesce(F.col("parent.service") != F.col("service"), F.lit(False))).alias("linked"))
    return counted.join(pairs, list(by), "left") if by else counted.crossJoin(pairs)  # one row each


def entity_counts(linked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(n_services, n_edges, n_endpoints, n_linked, n_traces): distinct ids alone, in one pass and without any statistics."""
    own, parent = F.col("own"), F.col("parent.own")
    crosses = F.coalesce(F.col("parent.service") != F.col("service"), F.lit(False))
    kind = edge_kind(parent, own)
    edge = F.when(crosses, edge_id(F.col("parent.service"), F.col("service"), kind, kind == "sync", edge_identity(parent, own)))
    method, path = endpoint_method(own), endpoint_path(own)
    rows = linked.select(*by, "service", F.nullif("trace_id", F.lit("")).alias("trace"), crosses.alias("crosses"), edge.alias("edge"), method.alias("method"), path.alias("path"), ((own["kind"] == "server") | ~F.coalesce(F.col("parent.service") == F.col("service"), F.lit(False))).alias("enters"))
    endpoint = F.when((F.col("method") != "") & (F.col("path") != "") & F.col("enters"), endpoint_id(F.col("service"), F.col("method"), F.col("path")))
    rows = rows.select(*by, "service", "trace", "crosses", "edge", endpoint.alias("endpoint"))
    return rows.groupBy(*by).agg(
        F.count_distinct("service").alias("n_services"), F.count_distinct("edge").alias("n_edges"), F.count_distinct("endpoint").alias("n_endpoints"), F.count_if("crosses").alias("n_linked"), F.count_distinct("trace").alias("n_traces")
    )


def confidence(n_spans: Column, n_services: Column, n_edges: Column, n_endpoints: Column, n_linked: Column) -> Column:
    """0.35, and 0.2 for several services, 0.15 for any edge, 0.15 for any endpoint, up to 0.15 by the share of linked spans."""
    share = F.when((n_spans > 0) & (n_linked > 0), F.least(F.lit(0.15), n_linked.cast("double") / n_spans.cast("double") * 0.15)).otherwise(0.0)
    score = F.lit(0.35) + F.when(n_services > 1, 0.2).otherwise(0.0) + F.when(n_edges > 0, 0.15).otherwise(0.0) + F.when(n_endpoints > 0, 0.15).otherwise(0.0) + share
    return round2(F.least(F.lit(1.0), score))


def support_minima(services_df: DataFrame, edges_df: DataFrame, endpoints_df: DataFrame) -> DataFrame:
    """The least observations of each kind, 0 where there is none."""
    parts = [df.select(F.lit(k).alias("entity"), "observations") for k, df in (("service", services_df), ("edge", edges_df), ("endpoint", endpoints_df))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(*[F.coalesce(F.min(F.when(F.col("entity") == k, F.col("observations"))), F.lit(0)).alias(f"{k}_support_min") for k in ("service", "edge", "endpoint")])


