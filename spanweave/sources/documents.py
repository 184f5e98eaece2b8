"""Small documents read on the driver (topology, overlays, replica counts, catalogues) and normalised as DataFrames."""

from __future__ import annotations

import json
import posixpath
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.identity import edge_id, endpoint_id
from ..functions.text import document_path, first_filled, first_nonblank, map_text, string_map, string_set, strip

_SERVICE = {"id", "name", "replicas", "support", "first_seen", "last_seen", "labels", "tags", "slo_refs", "attributes", "reliability", "failure_eligible", "placements", "shared_resource_refs"}
_EDGE = {"id", "from", "to", "kind", "blocking", "identity", "weight", "reliability", "resilience", "observed", "policy_scope", "support", "first_seen", "last_seen", "labels", "tags", "slo_refs", "attributes"}
_ENDPOINT = {"id", "entry_service", "method", "path", "predicate_ref", "semantics", "weight", "support", "first_seen", "last_seen", "labels", "tags", "slo_refs", "attributes"}


@dataclass
class Graph:
    """Services, edges and endpoints as one wide DataFrame each (schemas.SERVICES, EDGES, ENDPOINTS)."""

    services: DataFrame
    edges: DataFrame
    endpoints: DataFrame
    source_type: str = ""
    source_ref: str = ""


def load_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def parse(text: str, path: str = "") -> Any:
    """JSON for *.json, else YAML (of which JSON is a part)."""
    if path.lower().endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def _strict(item: dict, allowed: set[str], what: str) -> dict:
    if not isinstance(item, dict):
        raise ValueError(f"{what} is not an object")
    if unknown := set(item) - allowed:
        raise ValueError(f"{what} has unknown fields: {', '.join(sorted(unknown))}")
    return item


def _rows(spark: SparkSession, items: list[dict], schema: str) -> DataFrame:
    """Documents as rows: nested values pass through JSON, so that absent fields are null and types are the schema's."""
    texts = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "item int, doc string")
    return texts.select("item", F.from_json("doc", schema, {"mode": "FAILFAST"}).alias("x")).select("item", "x.*")


_SUPPORT = "support struct<observations: bigint, evidence: array<string>>, "


def _with_support(schema: str) -> str:
    return _SUPPORT + schema.replace("observations bigint, trace_count bigint, evidence array<string>, ", "").replace(f", provenance {schemas.PROVENANCE}", "")


def _common(df: DataFrame) -> DataFrame:
    return df.withColumns({"labels": string_map(F.col("labels")), "tags": string_set(F.col("tags")), "slo_refs": string_set(F.col("slo_refs")), "attributes": string_map(F.col("attributes"))})


def normalize_topology(graph: Graph) -> Graph:
    """Defaults of a topology: name = id, one replica, blocking = sync, derived ids, observations 0 as 1, evidence = the source's type."""
    kind = (graph.source_type or "").strip().lower() or "topology_api"
    ref = (graph.source_ref or "").strip()
    origin = F.array(F.struct(F.lit(kind).alias("type"), F.lit("topology_api").alias("connector"), F.lit(ref).alias("ref"))).cast(schemas.PROVENANCE)

    def support(df: DataFrame) -> DataFrame:
        given = string_set(F.col("support.evidence"))
        return df.withColumns({
            "observations": F.when(F.coalesce("support.observations", F.lit(0)) == 0, 1).otherwise(F.col("support.observations")).cast("bigint"), "trace_count": F.lit(0).cast("bigint"),
            "evidence": F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(kind))), "provenance": origin, "first_seen": strip(F.col("first_seen")), "last_seen": strip(F.col("last_seen")),
        }).drop("support")

    sid = strip(F.col("id"))
    s = _common(support(graph.services)).withColumns({"placements": sorted_placements(F.col("placements")), "id": sid, "name": first_nonblank(F.col("name"), F.col("id")), "replicas": F.coalesce("replicas", F.lit(1)), "shared_resource_refs": string_set(F.col("shared_resource_refs"))})
    e = _common(support(graph.edges)).withColumns({"from": strip(F.col("from")), "to": strip(F.col("to")), "kind": F.lower(strip(F.col("kind"))), "identity": clean_identity(F.col("identity"))})
    e = e.withColumn("blocking", F.coalesce("blocking", F.col("kind") == "sync"))
    e = e.withColumn("id", first_filled(strip(F.col("id")), edge_id(F.col("from"), F.col("to"), F.col("kind"), F.col("blocking"), F.col("identity"))))
    n = _common(support(graph.endpoints)).withColumns({"entry_service": strip(F.col("entry_service")), "method": F.upper(strip(F.col("method"))), "path": document_path(F.col("path"))})
    n = n.withColumn("id", first_filled(strip(F.col("id")), endpoint_id(F.col("entry_service"), F.col("method"), F.col("path"))))
    n = n.withColumns({"predicate_ref": first_nonblank(F.col("predicate_ref"), F.col("id")), "semantics": clean_semantics(F.col("semantics"))})
    return Graph(s, e, n, kind, ref)


def clean_identity(c: Column) -> Column:
    """Trimmed, protocol and span kind in lower case; null if nothing is left."""
    each = {f: strip(c[f]) for f in ("protocol", "operation", "route", "topic", "span_kind")}
    each |= {f: F.lower(each[f]) for f in ("protocol", "span_kind")}
    out = F.struct(*[v.alias(k) for k, v in each.items()])
    return F.when(F.concat(*each.values()) != "", out)


def sorted_placements(c: Column) -> Column:
    """By replicas, then by their labels as sorted text."""
    each = F.transform(c, lambda p: F.named_struct(F.lit("n"), p["replicas"], F.lit("k"), map_text(p["labels"]), F.lit("p"), F.to_json(p)))
    return F.from_json(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(each), lambda x: x["p"]), ","), F.lit("]")), schemas.PLACEMENTS)


def clean_semantics(c: Column) -> Column:
    mode, source = F.lower(strip(c["predicate_mode"])), strip(c["source"])
    targets, modes = string_set(c["mandatory_targets"]), string_set(c["dependency_modes"], lower=True)
    out = F.struct(mode.alias("predicate_mode"), targets.alias("mandatory_targets"), modes.alias("dependency_modes"), source.alias("source"), c["confidence"].alias("confidence"))
    return F.when((F.concat(mode, source) != "") | (F.size(targets) > 0) | (F.size(modes) > 0) | c["confidence"].isNotNull(), out)


def topology(spark: SparkSession, document: dict) -> Graph:
    """A topology document, unknown fields refused, normalised. Validation is operators.validate's."""
    _strict(document, {"source", "services", "edges", "endpoints"}, "the document")
    if not document.get("services"):
        raise ValueError("a topology document has at least one service")
    for key, allowed in (("services", _SERVICE), ("edges", _EDGE), ("endpoints", _ENDPOINT)):
        for i, item in enumerate(document.get(key) or []):
            _strict(item, allowed, f"{key}[{i}]")
    source = document.get("source") or {}
    made = [_rows(spark, document.get(k) or [], _with_support(s)).drop("item") for k, s in (("services", schemas.SERVICES), ("edges", schemas.EDGES), ("endpoints", schemas.ENDPOINTS))]
    return normalize_topology(Graph(*made, source.get("type") or "", source.get("ref") or ""))


def read_topology(spark: SparkSession, path: str) -> Graph:
    return topology(spark, parse(load_text(spark, path), path))


def catalog_document(catalog: dict) -> dict:
    """A service catalogue as a topology document: mode to kind, team and tier to labels, operation from the method."""
    text = lambda x: (x or "").strip()
    route = lambda x: "" if not text(x) else text(x) if text(x).startswith("/") else "/" + text(x)
    drop = lambda d: {k: v for k, v in d.items() if v not in (None, "", {}, [])}
    services, edges, endpoints = [], [], []
    for s in catalog.get("services") or []:
        labels = dict(s.get("labels") or {}) | drop({"team": text(s.get("team")), "tier": text(s.get("tier"))})
        services.append(drop({"id": text(s.get("id")), "replicas": s.get("replicas"), "labels": labels, "placements": s.get("placements"), "shared_resource_refs": s.get("shared_resources")}) | ({"failure_eligible": s["failure_eligible"]} if s.get("failure_eligible") is not None else {}))
    for d in catalog.get("dependencies") or []:
        mode, method = text(d.get("mode")).lower(), text(d.get("method")).upper()
        identity = drop({"protocol": text(d.get("protocol")).lower(), "operation": text(d.get("operation")) or method, "route": route(d.get("route")), "topic": text(d.get("topic"))})
        resilience = drop({"request_timeout_ms": d.get("request_timeout_ms"), "retry": drop({"max_attempts": d.get("retry_max_attempts")}), "circuit_breaker": {"enabled": d["circuit_breaker_enabled"]} if d.get("circuit_breaker_enabled") is not None else None})
        scope = drop({"source_endpoint_id": text(d.get("source_endpoint_id")), "method": method, "source_route": route(d.get("route"))})
        edge = drop({"from": text(d.get("from")), "to": text(d.get("to")), "kind": mode, "weight": d.get("weight"), "identity": identity, "resilience": resilience, "policy_scope": scope})
        edges.append(edge | ({"blocking": d["blocking"]} if d.get("blocking") is not None else {}))
    for e in catalog.get("endpoints") or []:
        endpoints.append(drop({"entry_service": text(e.get("service")), "method": text(e.get("method")).upper(), "path": route(e.get("path")), "predicate_ref": text(e.get("predicate_ref")), "semantics": e.get("semantics"), "weight": e.get("weight")}))
    return {"source": {"type": "topology_api", "ref": text(catalog.get("source_ref"))}, "services": services, "edges": edges, "endpoints": endpoints}


@dataclass
class Patches:
    """Ordered additive changes: schemas.PATCH columns and those of the entity."""

    services: DataFrame
    edges: DataFrame
    endpoints: DataFrame
    names: list[tuple[int, str, str]]


def overlays(spark: SparkSession, files: list[tuple[str, dict]], replicas: dict[str, int] | None = None) -> Patches:
    """Overlay documents in argument order, unknown fields ignored; replica counts are one overlay before all of them."""
    given = [("replicas", "legacy:replicas", {"services": [{"id": k, "replicas": v} for k, v in sorted(replicas.items())]})] if replicas else []
    for path, document in files:
        if path.strip():
            ref = posixpath.normpath(path.strip())
            given.append(((document or {}).get("name", "").strip() or posixpath.splitext(posixpath.basename(ref))[0], ref, document or {}))
    frames: dict[str, list[DataFrame]] = {"services": [], "edges": [], "endpoints": []}
    for k, (name, ref, document) in enumerate(given, 1):
        for key, schema in (("services", schemas.SERVICES), ("edges", schemas.EDGES), ("endpoints", schemas.ENDPOINTS)):
            own = _rows(spark, document.get(key) or [], _with_support(schema)).drop("support", "first_seen", "last_seen")
            frames[key].append(own.select(F.lit(k).alias("precedence"), "item", F.lit(name).alias("overlay"), F.lit(ref).alias("ref"), *[c for c in own.columns if c != "item"]))
    def union(key: str, schema: str) -> DataFrame:
        if not frames[key]:
            return _rows(spark, [], _with_support(schema)).drop("support", "first_seen", "last_seen").select(F.lit(1).alias("precedence"), "item", F.lit("").alias("overlay"), F.lit("").alias("ref"), *[c for c in _rows(spark, [], _with_support(schema)).columns if c not in ("item", "support", "first_seen", "last_seen")])
        out = frames[key][0]
        for df in frames[key][1:]:
            out = out.unionByName(df)
        return out

    s, e, n = union("services", schemas.SERVICES), union("edges", schemas.EDGES), union("endpoints", schemas.ENDPOINTS)
    s = s.withColumn("id", strip(F.col("id")))
    e = e.withColumns({"from": strip(F.col("from")), "to": strip(F.col("to")), "kind": F.lower(strip(F.col("kind"))), "identity": clean_identity(F.col("identity"))})
    e = e.withColumn("id", first_filled(strip(F.col("id")), F.when((F.col("from") != "") & (F.col("to") != "") & (F.col("kind") != ""), edge_id(F.col("from"), F.col("to"), F.col("kind"), F.coalesce("blocking", F.col("kind") == "sync"), F.col("identity"))).otherwise("")))
    n = n.withColumns({"entry_service": strip(F.col("entry_service")), "method": F.upper(strip(F.col("method"))), "path": document_path(F.col("path"))})
    n = n.withColumn("id", first_filled(strip(F.col("id")), F.when((F.col("entry_service") != "") & (F.col("method") != "") & (F.col("path") != ""), endpoint_id(F.col("entry_service"), F.col("method"), F.col("path"))).otherwise("")))
    return Patches(s, e, n, [(k, name, ref) for k, (name, ref, _) in enumerate(given, 1)])


def replica_counts(document: dict) -> dict[str, int]:
    """{replicas: {service: n}} or {service: n}; every n is an integer from 1."""
    inner = document.get("replicas") if isinstance(document.get("replicas"), dict) else document
    out = {}
    for k, v in (inner or {}).items():
        if isinstance(v, bool) or not isinstance(v, int) or v < 1:
            raise ValueError(f"replicas of {k!r} are not an integer from 1")
        out[str(k).strip()] = v
    return out
