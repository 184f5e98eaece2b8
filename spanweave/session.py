"""The façade: discover, validate and replay as Python functions; serve is streaming.live."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from datetime import datetime, timezone
from urllib.parse import quote_plus

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import canon
from .functions.text import rfc3339
from .operators import discover as ops, overlay, quality, validate as rules
from .schemas import EDGES, ENDPOINTS, PROVENANCE, SERVICES
from .sources import documents
from .sources.documents import Graph
from .sources.spans_json import parse_spans, read_files, unreadable_files

def _contract(name: str, version: str, sections: dict[str, str]) -> dict[str, str]:
    """A published contract: its digest is that of its name, version and the fields of each section, so it changes with them."""
    return {"name": name, "version": version, "uri": f"urn:spanweave:schema:{name.split('.')[1]}:v{version}", "digest": "sha256:" + canon.digest({"name": name, "version": version, "sections": sections})}


_SECTIONS = {"services": SERVICES, "edges": EDGES, "endpoints": ENDPOINTS}
_ENVELOPE = {"ingest": "spans bigint, traces bigint, dropped_spans bigint, late_spans bigint", "counts": "services bigint, edges bigint, endpoints bigint"}
#: Contracts of the artifacts by name@version.
CONTRACTS: dict[str, dict[str, str]] = {f"{c['name']}@{c['version']}": c for c in (_contract("spanweave.model", "1.3.0", _SECTIONS), _contract("spanweave.snapshot", "1.3.0", _SECTIONS | _ENVELOPE))}


def lookup_contract(name: str, version: str) -> dict[str, str]:
    """The published contract; KeyError for any other name or version."""
    return CONTRACTS[f"{name}@{version}"]


SOURCE_TYPE = "spanweave"


class InvalidGraph(ValueError):
    """The first violation's message; all of them as `rows`."""

    def __init__(self, rows: list):
        super().__init__("; ".join(f"{r['entity_kind']} {r['entity_id']}: {r['message']}" for r in rows[:1]))
        self.rows = rows


@dataclass
class Result:
    graph: Graph
    model: dict
    details: dict
    coverage: dict
    quality: dict
    span_count: int = 0
    trace_count: int = 0
    sources: list[dict] = field(default_factory=list)


def source_ref(path: str = "", listen: str = "") -> str:
    """Where a model comes from: the input's cleaned path, or the listening address."""
    if listen.strip():
        return f"{SOURCE_TYPE}://serve?listen={quote_plus(listen.strip(), safe='')}"
    clean = os.path.normpath(path.strip()).replace(os.sep, "/") if path.strip() else ""
    return f"{SOURCE_TYPE}://discover" + (f"?input={quote_plus(clean, safe='')}" if clean else "")


def _fill(df: DataFrame, schema: str, values: dict) -> DataFrame:
    """The wide schema's columns: those given, null for the rest."""
    from pyspark.sql.types import _parse_datatype_string

    return df.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in _parse_datatype_string(schema).fields])


def graph_of(spans: DataFrame, ref: str, connector: str = "file", by: tuple[str, ...] = (), seen: bool = False) -> tuple[Graph, DataFrame]:
    """The graph of spans and its totals; with seen, records carry first and last event times."""
    prepared = ops.prepare(spans, by)
    linked = ops.link_parents(prepared, by)
    origin = F.array(F.struct(F.lit("traces").alias("type"), F.lit(connector).alias("connector"), F.lit(ref).alias("ref"))).cast(PROVENANCE)
    at = lambda c: rfc3339(F.timestamp_seconds(F.floor(F.col(c) / 1_000_000_000))) if seen else F.lit(None)
    common = {"observations": F.col("observations"), "trace_count": F.col("trace_count"), "first_seen": at("first_ns"), "last_seen": at("last_ns"), "provenance": origin}
    s = _fill(ops.services(prepared, by), SERVICES, {"id": F.col("id"), "name": F.col("id"), "replicas": F.lit(1), **common})
    latency = F.struct("p50", "p90", "p95", "p99")
    e = _fill(ops.edges(linked, by), EDGES, {**{c: F.col(c) for c in ("id", "from", "to", "kind", "blocking", "evidence")}, "identity": documents.clean_identity(F.col("identity")), "observed": F.when(F.col("p50").isNotNull(), F.struct(latency.alias("latency_ms"), F.lit(None).cast("double").alias("error_rate"))), **common})
    n = _fill(ops.endpoints(linked, by), ENDPOINTS, {**{c: F.col(c) for c in ("id", "entry_service", "method", "path")}, "predicate_ref": F.col("id"), **common})
    return Graph(s, e, n, SOURCE_TYPE, ref), ops.totals(spans, linked, by)


_META = {
    "service": ("labels", "tags", "slo_refs", "reliability", "failure_eligible", "placements", "shared_resource_refs"),
    "edge": ("labels", "tags", "slo_refs", "weight", "reliability"),
    "endpoint": ("labels", "tags", "slo_refs", "weight", "semantics"),
}


def _model_item(kind: str, row: dict) -> dict:
    base = {"service": ("id", "name", "replicas"), "edge": ("id", "from", "to", "kind", "blocking", "identity", "resilience", "observed", "policy_scope"), "endpoint": ("id", "entry_service", "method", "path")}[kind]
    out = {k: row.get(k) for k in base} | {"metadata": {k: row.get(k) for k in _META[kind]}}
    if kind == "endpoint":
        out["success_predicate_ref"] = row.get("predicate_ref")
    return canon.tidy(out)


def _record(kind: str, row: dict) -> dict:
    out = {k: v for k, v in row.items() if k not in ("observations", "trace_count", "evidence", "predicate_ref", *_META[kind], "attributes")}
    out["support"] = {"observations": row["observations"] or 0, "trace_count": row["trace_count"] or 0, "evidence": row.get("evidence")} if kind == "edge" else {"observations": row["observations"] or 0, "trace_count": row["trace_count"] or 0}
    out["metadata"] = {k: row.get(k) for k in (*_META[kind], "attributes")}
    return canon.tidy(out)


def _collect(df: DataFrame) -> list[dict]:
    """Rows of an entity table in id order. The artifact is one JSON document, so it is made on the driver."""
    return [json.loads(r[0]) for r in df.orderBy("id").select(F.to_json(F.struct("*"))).collect()]


def check(graph: Graph) -> None:
    if rows := rules.violations(graph).orderBy("rule", "entity_kind", "entity_id").collect():
        raise InvalidGraph(rows)


def build(graph: Graph, discovered_at: str, confidence: float, source_type: str | None = None, contract: str = "spanweave.model@1.3.0") -> tuple[dict, dict]:
    """The model document and the evidence records of a checked graph."""
    rows = {k: _collect(df) for k, df in (("service", graph.services), ("edge", graph.edges), ("endpoint", graph.endpoints))}
    schema = CONTRACTS[contract]
    model = {
        "services": [_model_item("service", r) for r in rows["service"]], "edges": [_model_item("edge", r) for r in rows["edge"]], "endpoints": [_model_item("endpoint", r) for r in rows["endpoint"]],
        "metadata": {"source_type": source_type or graph.source_type, "source_ref": graph.source_ref, "discovered_at": discovered_at, "confidence": confidence, "schema": {k: v for k, v in schema.items() if v}},
    }
    return model, {f"{k}s": [_record(k, r) for r in v] for k, v in rows.items()}


def quality_report(graph: Graph) -> dict:
    dims, mix = quality.dimensions(graph), quality.source_mix(graph)
    return {"dimensions": [r.asDict(True) for r in dims.orderBy("position").drop("position").collect()], "source_mix": {r["type"]: {"mentions": r["mentions"], "records": r["records"]} for r in mix.collect()}, "warnings": [r[0] for r in quality.warnings(dims, mix).collect()]}


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def discover_spans(spark: SparkSession, spans: DataFrame, ref: str, discovered_at: str | None = None, patches: documents.Patches | None = None, connector: str = "file", seen: bool = False) -> Result:
    """Spans to a checked, overlaid model with coverage."""
    spans = spans.cache()
    try:
        graph, totals = graph_of(spans, ref, connector, seen=seen)
        one = totals.first()
        n_s, n_e, n_n = graph.services.count(), graph.edges.count(), graph.endpoints.count()
        if not n_s:
            raise ValueError("discovery produced no services")
        score = spark.range(1).select(ops.confidence(*[F.lit(int(v)) for v in (one["spans"], n_s, n_e, n_n, one["linked"])])).first()[0]
        return _finish(graph, discovered_at, score, patches, one["spans"], one["traces"], [{"type": "traces", "connector": connector, "ref": ref, "observations": one["spans"]}], SOURCE_TYPE)
    finally:
        spans.unpersist()


def discover_topology(spark: SparkSession, graph: Graph, discovered_at: str | None = None, patches: documents.Patches | None = None) -> Result:
    """A topology is its own evidence: confidence 1, one observation for each entity."""
    n = graph.services.count() + graph.edges.count() + graph.endpoints.count()
    return _finish(graph, discovered_at, 1.0, patches, 0, 0, [{"type": graph.source_type, "connector": "topology_api", "ref": graph.source_ref, "observations": n}], graph.source_type)


def _finish(graph: Graph, discovered_at, score, patches, spans, traces, sources, source_type) -> Result:
    check(graph)
    if patches is not None:
        graph, bad = overlay.apply(graph, patches)
        if rows := bad.orderBy("rule", "entity_kind", "entity_id").collect():
            raise InvalidGraph(rows)
        check(graph)
    minima = ops.support_minima(graph.services, graph.edges, graph.endpoints).first().asDict()
    model, details = build(graph, discovered_at or _now(), score, source_type)
    return Result(graph, model, details, {"confidence": score, **minima}, quality_report(graph), spans, traces, sources)


def load_spans(spark: SparkSession, path: str) -> DataFrame:
    """Spans of a file or folder; ValueError names files that are of no dialect, or says that there is no span."""
    files = read_files(spark, path)
    if bad := [r[0] for r in unreadable_files(files).orderBy("file").collect()]:  # names of files, which fail the whole load
        raise ValueError(f"no trace documents: {', '.join(bad[:20])}" + (f" and {len(bad) - 20} more" if len(bad) > 20 else ""))
    spans = parse_spans(files)
    if spans.isEmpty():
        raise ValueError(f"no spans in {path}")
    return spans


def discover(spark: SparkSession, input: str, out: str | None = None, snapshot_out: str | None = None, quality_out: str | None = None, replicas: str | None = None, discovered_at: str | None = None, overlays: tuple[str, ...] = ()) -> Result:
    """Reads spans, or else a topology, from input; writes the model, its quality sidecar and a snapshot where asked."""
    files = [(p, documents.parse(documents.load_text(spark, p), p) or {}) for p in overlays if p.strip()]
    counts = documents.replica_counts(documents.parse(documents.load_text(spark, replicas), replicas)) if replicas else None
    patches = documents.overlays(spark, files, counts) if files or counts else None
    try:
        spans = load_spans(spark, input)
    except ValueError as e:
        try:
            graph = documents.read_topology(spark, input)
        except Exception as other:
            raise ValueError(f"input as traces: {e}; as topology: {other}") from e
        result = discover_topology(spark, graph, discovered_at, patches)
    else:
        result = discover_spans(spark, spans, source_ref(input), discovered_at, patches)
    if out:
        canon.write_atomic(out, canon.canonical(result.model))
        canon.write_atomic(quality_out or canon.sidecar_path(out), canon.canonical(result.quality))
    if snapshot_out:
        canon.write_atomic(snapshot_out, canon.canonical(snapshot(result)))
        canon.write_atomic(canon.sidecar_path(snapshot_out), canon.canonical(result.quality))
    return result


def snapshot(result: Result, start: str | None = None, end: str | None = None, ingest: dict | None = None, previous: dict | None = None) -> dict:
    """The envelope of one window around a result; a batch's window is the moment of discovery."""
    at = result.model["metadata"]["discovered_at"]
    start, end, version = start or at, end or at, canon.digest(result.model)
    sha = canon.hashlib.sha256(f"{start}|{end}|{version}".encode()).hexdigest()
    parts = ("services", "edges", "endpoints")
    then = previous["discovery"] if previous else {}
    changes = {}
    for k in parts:
        was, now = {r["id"]: r for r in then.get(k, [])}, {r["id"]: r for r in result.details[k]}
        changes |= {f"added_{k}": len(now.keys() - was.keys()), f"removed_{k}": len(was.keys() - now.keys()), f"changed_{k}": sum(was[i] != now[i] for i in was.keys() & now.keys())}
    return {
        "snapshot_id": f"snap-{sha[:24]}", "topology_version": version, "window_start": start, "window_end": end, "ingest": ingest or {"spans": result.span_count, "traces": result.trace_count, "dropped_spans": 0, "late_spans": 0},
        "counts": {k: len(result.model[k]) for k in parts}, "coverage": result.coverage, "sources": result.sources, "diff": changes, "discovery": result.details, "model": result.model, "metadata": {"schema": {k: v for k, v in CONTRACTS["spanweave.snapshot@1.3.0"].items() if v}},
    }


def carry_seen(details: dict, previous: dict | None) -> dict:
    """Evidence records with the first and last times that earlier windows saw, oldest and newest of both."""
    if not previous:
        return details
    out = {}
    for kind, records in details.items():
        was = {r["id"]: r for r in previous["discovery"].get(kind, [])}
        out[kind] = []
        for r in records:
            old = was.get(r["id"], {})
            first = min((x for x in (r.get("first_seen"), old.get("first_seen")) if x), default=None)
            last = max((x for x in (r.get("last_seen"), old.get("last_seen")) if x), default=None)
            out[kind].append(canon.tidy({**r, "first_seen": first, "last_seen": last}))
    return out


def validate(spark: SparkSession, path: str) -> str:
    """Reads a model or snapshot artifact back: known contract, known fields, all rules. Returns the contract's key; else ValueError."""
    doc = json.loads(documents.load_text(spark, path))
    given = (doc.get("metadata") or {}).get("schema") or {}
    key = f"{given.get('name')}@{given.get('version')}"
    if key not in CONTRACTS:
        raise ValueError(f"unknown contract {key}")
    if any(given.get(k, "") != v for k, v in CONTRACTS[key].items()):
        raise ValueError(f"the contract {key} has another uri or digest")
    model = doc["model"] if "snapshot" in given["name"] else doc
    if "snapshot" in given["name"]:
        if any(doc["counts"].get(k) != len(model.get(k, [])) or doc["counts"].get(k) != len(doc["discovery"].get(k, [])) for k in ("services", "edges", "endpoints")):
            raise ValueError("counts differ from the entities")
        if not doc.get("snapshot_id") or any(v < 0 for v in doc["ingest"].values()):
            raise ValueError("a snapshot needs an id and no negative counts")
    meta = model.get("metadata") or {}
    if not meta.get("source_type") or not meta.get("source_ref") or not 0 <= meta.get("confidence", -1) <= 1:
        raise ValueError("metadata needs source_type, source_ref and a confidence within 0 and 1")
    datetime.fromisoformat(meta["discovered_at"].replace("Z", "+00:00"))
    flat = lambda item: {k: v for k, v in item.items() if k not in ("metadata", "success_predicate_ref")} | item.get("metadata", {}) | ({"predicate_ref": item["success_predicate_ref"]} if "success_predicate_ref" in item else {})
    graph = documents.topology(spark, {"source": {}, **{k: [flat(x) for x in model.get(k, [])] for k in ("services", "edges", "endpoints")}})
    check(graph)
    return key
