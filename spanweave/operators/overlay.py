"""Overlays merged into a graph: patches are grouped by entity in their order and joined once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import edge_id
from ..functions.text import last_wins, map_over, string_set
from ..schemas import PROVENANCE
from ..sources.documents import Graph, Patches, clean_semantics

_ORDER = ["precedence", "item"]


def _order() -> Column:
    return F.struct(*_ORDER)


def last_given(value: Column, given: Column | None = None) -> Column:
    """The value of the last patch that gives one."""
    return F.max_by(value, F.when(value.isNotNull() if given is None else given, _order()))


def _by_order(x: Column, y: Column) -> Column:
    return F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0)


def _ordered(column: str) -> Column:
    """Values of all patches that give one, in order."""
    given = F.collect_list(F.when(F.col(column).isNotNull(), F.struct(_order().alias("o"), F.col(column).alias("v"))))
    return F.transform(F.array_sort(given, _by_order), lambda x: x["v"])


def _maps(column: str) -> Column:
    """Entries of the patches' maps, in order, as one list."""
    return F.flatten(F.transform(_ordered(column), lambda m: F.map_entries(m)))


def _sets(column: str) -> Column:
    return F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(column), F.array().cast("array<string>")))))


def _origin() -> Column:
    each = F.array_sort(F.collect_list(F.struct(_order().alias("o"), F.struct(F.lit("overlay").alias("type"), F.col("overlay").alias("connector"), F.col("ref").alias("ref")).alias("v"))))
    return F.transform(each, lambda x: x["v"]).cast(PROVENANCE)


def _common_aggregates() -> list[Column]:
    return [_maps("labels").alias("_labels"), _maps("attributes").alias("_attributes"), _sets("tags").alias("_tags"), _sets("slo_refs").alias("_slo_refs"), last_given(F.col("reliability")).alias("_reliability"), _origin().alias("_origin")]


def _merge_common(df: DataFrame) -> DataFrame:
    some = lambda m: F.when(F.size(m) > 0, m)
    none = F.array().cast("array<string>")
    return df.withColumns({
        "labels": some(map_over(F.col("labels"), last_wins(F.coalesce("_labels", F.map_entries(F.create_map().cast("map<string,string>")))))),
        "attributes": some(map_over(F.col("attributes"), last_wins(F.coalesce("_attributes", F.map_entries(F.create_map().cast("map<string,string>")))))),
        "tags": string_set(F.concat(F.coalesce("tags", none), F.coalesce("_tags", none))), "slo_refs": string_set(F.concat(F.coalesce("slo_refs", none), F.coalesce("_slo_refs", none))),
        "reliability": F.coalesce("_reliability", "reliability"), "provenance": F.concat(F.coalesce("provenance", F.array().cast(PROVENANCE)), F.coalesce("_origin", F.array().cast(PROVENANCE))),
    })


def _drop_own(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def merge_services(services: DataFrame, patches: DataFrame) -> DataFrame:
    filled = lambda c: F.size(c) > 0
    own = patches.groupBy(F.col("id").alias("_id")).agg(*_common_aggregates(), last_given(F.col("replicas")).alias("_replicas"), last_given(F.col("failure_eligible")).alias("_failure"), last_given(F.col("placements"), filled("placements")).alias("_placements"), last_given(string_set(F.col("shared_resource_refs")), filled("shared_resource_refs")).alias("_shared"))
    df = _merge_common(services.join(own, services["id"] == own["_id"], "left"))
    return _drop_own(df.withColumns({"replicas": F.coalesce("_replicas", "replicas"), "failure_eligible": F.coalesce("_failure", "failure_eligible"), "placements": F.coalesce("_placements", "placements"), "shared_resource_refs": F.coalesce("_shared", "shared_resource_refs")}))


def resolve_edges(edges: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patches with the ids of their edges, and the violations: a patch names an edge's id, or, if none has it, the id
    without identity of the only edge that has that one.
    """
    legacy = edges.select(F.col("id").alias("full"), edge_id(F.col("from"), F.col("to"), F.col("kind"), F.col("blocking")).alias("legacy"))
    found = legacy.groupBy("legacy").agg(F.min("full").alias("only"), F.count("*").alias("n"))
    rows = patches.join(legacy.select(F.col("full").alias("_full")), patches["id"] == F.col("_full"), "left").join(found, patches["id"] == found["legacy"], "left")
    bad = rows.where("_full is null and coalesce(n, 0) <> 1").select(F.when(F.col("n") > 1, "overlay_ambiguous").otherwise("overlay_unknown").alias("rule"), F.lit("edge").alias("entity_kind"), F.col("id").alias("entity_id"), F.concat(F.lit("overlay "), "overlay", F.lit(" refers to an "), F.when(F.col("n") > 1, "ambiguous").otherwise("unknown"), F.lit(" edge")).alias("message"))
    good = rows.where("_full is not null or n = 1").withColumn("id", F.coalesce("_full", "only")).drop("_full", "legacy", "only", "n")
    return good, bad


def merge_edges(edges: DataFrame, patches: DataFrame) -> DataFrame:
    """patches: resolved. Resilience, observed values and policy scope merge field by field; identity fills only a gap."""
    g = lambda path: last_given(F.col(path))
    full = lambda path: last_given(F.col(path), F.coalesce(F.trim(path), F.lit("")) != "")
    r, b, k = "resilience.", "resilience.retry.backoff.", "resilience.circuit_breaker."
    breaker = ("enabled", "max_pending_requests", "max_requests", "max_connections", "consecutive_5xx", "interval_ms", "base_ejection_time_ms")
    own = patches.groupBy(F.col("id").alias("_id")).agg(
        *_common_aggregates(), g("weight").alias("_weight"), F.min_by("identity", F.when(F.col("identity").isNotNull(), _order())).alias("_identity"),
        *[g(r + f).alias(f"_{f}") for f in ("request_timeout_ms", "per_try_timeout_ms")], g("resilience.retry.max_attempts").alias("_max_attempts"), g("resilience.retry.budget_cap").alias("_budget_cap"),
        F.flatten(F.collect_list("resilience.retry.retry_on")).alias("_retry_on"), *[g(b + f).alias(f"_{f}") for f in ("initial_ms", "max_ms", "multiplier", "jitter")], *[g(k + f).alias(f"_cb_{f}") for f in breaker],
        *[g(f"observed.latency_ms.{p}").alias(f"_{p}") for p in ("p50", "p90", "p95", "p99")], g("observed.error_rate").alias("_error_rate"), *[full(f"policy_scope.{f}").alias(f"_ps_{f}") for f in ("source_endpoint_id", "source_route", "method", "operation")],
    )
    df = _merge_common(edges.join(own, edges["id"] == own["_id"], "left"))
    pick = lambda new, old: F.coalesce(F.col(new), F.col(old))

    def struct(**fields: Column) -> Column:
        return F.when(F.coalesce(*[v.cast("string") for v in fields.values()]).isNotNull(), F.struct(*[v.alias(n) for n, v in fields.items()]))

    none = F.array().cast("array<string>")
    retry_on = string_set(F.concat(F.coalesce("resilience.retry.retry_on", none), F.coalesce("_retry_on", none)))
    backoff = struct(**{f: pick(f"_{f}", b + f) for f in ("initial_ms", "max_ms", "multiplier", "jitter")})
    retry = struct(max_attempts=pick("_max_attempts", "resilience.retry.max_attempts"), budget_cap=pick("_budget_cap", "resilience.retry.budget_cap"), retry_on=F.when(F.size(retry_on) > 0, retry_on), backoff=backoff)
    resilience = struct(request_timeout_ms=pick("_request_timeout_ms", r + "request_timeout_ms"), per_try_timeout_ms=pick("_per_try_timeout_ms", r + "per_try_timeout_ms"), retry=retry, circuit_breaker=struct(**{f: pick(f"_cb_{f}", k + f) for f in breaker}))
    latency = struct(**{p: pick(f"_{p}", f"observed.latency_ms.{p}") for p in ("p50", "p90", "p95", "p99")})
    df = df.withColumns({
        "weight": pick("_weight", "weight"), "identity": F.coalesce("identity", "_identity"), "resilience": resilience,
        "observed": struct(latency_ms=latency, error_rate=pick("_error_rate", "observed.error_rate")),
        "policy_scope": struct(**{f: pick(f"_ps_{f}", f"policy_scope.{f}") for f in ("source_endpoint_id", "source_route", "method", "operation")}),
    })
    return _drop_own(df)


def merge_endpoints(endpoints: DataFrame, patches: DataFrame) -> DataFrame:
    """Method, path and predicate replace what is there, the id stays; semantics merge field by field."""
    full = lambda path: last_given(F.col(path), F.coalesce(F.trim(path), F.lit("")) != "")
    some = lambda path: last_given(F.col(path), F.size(path) > 0)
    own = patches.groupBy(F.col("id").alias("_id")).agg(
        *_common_aggregates(), last_given(F.col("weight")).alias("_weight"), *[full(f).alias(f"_{f}") for f in ("predicate_ref", "method", "path")],
        full("semantics.predicate_mode").alias("_mode"), some("semantics.mandatory_targets").alias("_targets"), some("semantics.dependency_modes").alias("_modes"), full("semantics.source").alias("_source"), last_given(F.col("semantics.confidence")).alias("_confidence"),
    )
    df = _merge_common(endpoints.join(own, endpoints["id"] == own["_id"], "left"))
    semantics = F.struct(F.coalesce("_mode", "semantics.predicate_mode").alias("predicate_mode"), F.coalesce("_targets", "semantics.mandatory_targets").alias("mandatory_targets"), F.coalesce("_modes", "semantics.dependency_modes").alias("dependency_modes"), F.coalesce("_source", "semantics.source").alias("source"), F.coalesce("_confidence", "semantics.confidence").alias("confidence"))
    return _drop_own(df.withColumns({"weight": F.coalesce("_weight", "weight"), "predicate_ref": F.coalesce("_predicate_ref", "predicate_ref"), "method": F.coalesce("_method", "method"), "path": F.coalesce("_path", "path"), "semantics": clean_semantics(semantics)}))


def unknown_refs(entities: DataFrame, patches: DataFrame, kind: str) -> DataFrame:
    """Violations: patches of entities that are not there."""
    missing = patches.join(entities.select("id"), "id", "left_anti")
    return missing.select(F.lit("overlay_unknown").alias("rule"), F.lit(kind).alias("entity_kind"), F.col("id").alias("entity_id"), F.concat(F.lit("overlay "), "overlay", F.lit(f" refers to an unknown {kind}")).alias("message"))


def apply(graph: Graph, patches: Patches) -> tuple[Graph, DataFrame]:
    """The merged graph and the violations among the patches, which have no effect."""
    edges, bad = resolve_edges(graph.edges, patches.edges)
    bad = bad.unionByName(unknown_refs(graph.services, patches.services, "service")).unionByName(unknown_refs(graph.endpoints, patches.endpoints, "endpoint"))
    merged = Graph(merge_services(graph.services, patches.services), merge_edges(graph.edges, edges), merge_endpoints(graph.endpoints, patches.endpoints), graph.source_type, graph.source_ref)
    return merged, bad
