"""Explicit schemas of everything that is read or kept; nothing is inferred."""

from __future__ import annotations

SPANS = "trace_id string, span_id string, parent_span_id string, service string, name string, kind string, start_ns bigint, end_ns bigint, attributes map<string,string>, seq bigint"
RELIABILITY = "struct<live_probability: double, source: string, confidence: double>"
PLACEMENTS = f"array<struct<replicas: int, labels: map<string,string>, reliability: {RELIABILITY}>>"
IDENTITY = "struct<protocol: string, operation: string, route: string, topic: string, span_kind: string>"
BACKOFF = "struct<initial_ms: int, max_ms: int, multiplier: double, jitter: boolean>"
RETRY = f"struct<max_attempts: int, budget_cap: double, retry_on: array<string>, backoff: {BACKOFF}>"
BREAKER = "struct<enabled: boolean, max_pending_requests: int, max_requests: int, max_connections: int, consecutive_5xx: int, interval_ms: int, base_ejection_time_ms: int>"
RESILIENCE = f"struct<request_timeout_ms: int, per_try_timeout_ms: int, retry: {RETRY}, circuit_breaker: {BREAKER}>"
OBSERVED = "struct<latency_ms: struct<p50: double, p90: double, p95: double, p99: double>, error_rate: double>"
POLICY_SCOPE = "struct<source_endpoint_id: string, source_route: string, method: string, operation: string>"
SEMANTICS = "struct<predicate_mode: string, mandatory_targets: array<string>, dependency_modes: array<string>, source: string, confidence: double>"
PROVENANCE = "array<struct<type: string, connector: string, ref: string>>"

_COMMON = "labels map<string,string>, tags array<string>, slo_refs array<string>, attributes map<string,string>"
_SEEN = f"observations bigint, trace_count bigint, evidence array<string>, first_seen string, last_seen string, provenance {PROVENANCE}"
SERVICES = f"id string, name string, replicas int, {_COMMON}, reliability {RELIABILITY}, failure_eligible boolean, placements {PLACEMENTS}, shared_resource_refs array<string>, {_SEEN}"
EDGES = f"id string, `from` string, `to` string, kind string, blocking boolean, identity {IDENTITY}, {_COMMON}, weight double, reliability {RELIABILITY}, resilience {RESILIENCE}, observed {OBSERVED}, policy_scope {POLICY_SCOPE}, {_SEEN}"
ENDPOINTS = f"id string, entry_service string, method string, path string, predicate_ref string, {_COMMON}, weight double, reliability {RELIABILITY}, semantics {SEMANTICS}, {_SEEN}"

PATCH = "precedence int, item int, overlay string, ref string, "
