"""Validation as queries: every violation is a row (rule, entity_kind, entity_id, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import IDENTITY
from ..sources.documents import Graph

# What enumerated fields may hold.
EDGE_KINDS = ("sync", "async")
PREDICATE_MODES = ("immediate_response", "eventual_completion", "external_predicate")
DEPENDENCY_MODES = ("sync", "async")

_BREAKER = ("max_pending_requests", "max_requests", "max_connections", "consecutive_5xx", "interval_ms", "base_ejection_time_ms")


def violations_of(df: DataFrame, rule: str, kind: str, wrong: Column, message: str) -> DataFrame:
    return df.where(F.coalesce(wrong, F.lit(False))).select(F.lit(rule).alias("rule"), F.lit(kind).alias("entity_kind"), F.coalesce("id", F.lit("")).alias("entity_id"), F.lit(message).alias("message"))


def check_rows(df: DataFrame, kind: str, checks: list[tuple[str, Column, str]]) -> DataFrame:
    """Row-wise checks in one scan: a row's violated checks are exploded."""
    found = F.filter(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(text).alias("message"))) for rule, wrong, text in checks]), lambda x: x.isNotNull())
    rows = df.select(F.coalesce("id", F.lit("")).alias("entity_id"), F.explode(found).alias("v"))
    return rows.select("v.rule", F.lit(kind).alias("entity_kind"), "entity_id", "v.message")


def unique(df: DataFrame, kind: str) -> DataFrame:
    return violations_of(df.groupBy("id").count(), "unique_id", kind, F.col("count") > 1, f"the {kind} id is used more than once")


def refers(df: DataFrame, column: str, services: DataFrame, kind: str, rule: str) -> DataFrame:
    """A column's values must be ids of services."""
    known = services.select(F.col("id").alias("_known"))
    return violations_of(df.join(known, df[column] == F.col("_known"), "left_anti"), rule, kind, F.lit(True), f"{column} is not a known service")


def outside(c: Column) -> Column:
    return (c < 0) | (c > 1)


def reliability_checks(c: Column, name: str = "reliability") -> list[tuple[str, Column, str]]:
    return [
        ("reliability_required", c.isNotNull() & c["live_probability"].isNull(), f"{name} needs live_probability"),
        ("reliability_range", outside(c["live_probability"]), f"{name}.live_probability is not within 0 and 1"),
        ("confidence_range", outside(c["confidence"]), f"{name}.confidence is not within 0 and 1"),
    ]


def services_violations(s: DataFrame) -> DataFrame:
    bad_place = F.exists("placements", lambda p: F.coalesce(p["replicas"] < 1, F.lit(True)))
    bad_reliability = F.exists("placements", lambda p: p["reliability"].isNotNull() & F.coalesce(outside(p["reliability"]["live_probability"]) | outside(F.coalesce(p["reliability"]["confidence"], F.lit(0.0))), F.lit(True)))
    rows = check_rows(s, "service", [
        ("id_required", F.coalesce(F.trim("id"), F.lit("")) == "", "a service needs an id"), ("name_required", F.coalesce(F.trim("name"), F.lit("")) == "", "a service needs a name"),
        ("replicas", F.coalesce("replicas", F.lit(0)) < 1, "replicas are below 1"), ("placements", bad_place, "a placement has replicas below 1"), ("placement_reliability", bad_reliability, "a placement's reliability is out of range"),
        *reliability_checks(F.col("reliability")),
    ])
    return rows.unionByName(unique(s, "service"))


def latency_order(observed: Column) -> Column:
    """True if the given percentiles fall anywhere, absent ones left out."""
    given = F.filter(F.array(*[observed["latency_ms"][p] for p in ("p50", "p90", "p95", "p99")]), lambda x: x.isNotNull())
    return given != F.array_sort(given)


def edges_violations(e: DataFrame, services: DataFrame) -> DataFrame:
    identity, r, o = F.col("identity"), F.col("resilience"), F.col("observed")
    numbers = [r["request_timeout_ms"], r["per_try_timeout_ms"], r["retry"]["max_attempts"], r["retry"]["budget_cap"], r["retry"]["backoff"]["initial_ms"], r["retry"]["backoff"]["max_ms"], r["retry"]["backoff"]["multiplier"], *[r["circuit_breaker"][f] for f in _BREAKER]]
    latencies = [o["latency_ms"][p] for p in ("p50", "p90", "p95", "p99")]
    below = lambda cs: F.exists(F.array(*[c.cast("double") for c in cs]), lambda x: F.coalesce(x < 0, F.lit(False)))
    rows = check_rows(e, "edge", [
        ("id_required", F.coalesce(F.trim("id"), F.lit("")) == "", "an edge needs an id"), ("kind", ~F.coalesce(F.col("kind").isin(*EDGE_KINDS), F.lit(False)), "kind is neither sync nor async"),
        ("identity_pipe", F.exists(F.array(*[identity[f] for f in IDENTITY]), lambda x: F.coalesce(x.contains("|"), F.lit(False))), "an identity field holds |"), ("weight", F.col("weight") < 0, "weight is below 0"), ("resilience", below(numbers), "a resilience number is below 0"),
        ("error_rate", outside(o["error_rate"]), "error_rate is not within 0 and 1"), ("latency", below(latencies), "a latency is below 0"), ("latency_order", latency_order(o), "latency percentiles fall"), *reliability_checks(F.col("reliability")),
    ])
    return rows.unionByName(unique(e, "edge")).unionByName(refers(e, "from", services, "edge", "from_known")).unionByName(refers(e, "to", services, "edge", "to_known"))


def endpoints_violations(n: DataFrame, services: DataFrame) -> DataFrame:
    m = F.col("semantics")
    rows = check_rows(n, "endpoint", [
        ("id_required", F.coalesce(F.trim("id"), F.lit("")) == "", "an endpoint needs an id"), ("predicate", F.coalesce(F.trim("predicate_ref"), F.lit("")) == "", "an endpoint needs a predicate"), ("weight", F.col("weight") < 0, "weight is below 0"),
        ("predicate_mode", (F.coalesce(m["predicate_mode"], F.lit("")) != "") & ~m["predicate_mode"].isin(*PREDICATE_MODES), "predicate_mode is unknown"), ("dependency_modes", F.exists(m["dependency_modes"], lambda x: ~x.isin(*DEPENDENCY_MODES)), "a dependency mode is unknown"),
        ("targets", F.exists(m["mandatory_targets"], lambda x: F.trim(x) == ""), "a mandatory target is empty"), ("confidence_range", outside(m["confidence"]), "semantics.confidence is not within 0 and 1"),
    ])
    targets = n.select("id", F.explode("semantics.mandatory_targets").alias("target"))
    return rows.unionByName(unique(n, "endpoint")).unionByName(refers(n, "entry_service", services, "endpoint", "entry_known")).unionByName(refers(targets, "target", services, "endpoint", "target_known"))


def seen_range(df: DataFrame, kind: str) -> DataFrame:
    at = lambda c: F.try_to_timestamp(F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit("")))
    unread = lambda c: (F.coalesce(F.col(c), F.lit("")) != "") & at(c).isNull()
    return check_rows(df, kind, [("seen_format", unread("first_seen") | unread("last_seen"), "a seen time is not RFC 3339"), ("seen_order", at("first_seen") > at("last_seen"), "first_seen is after last_seen")])


def violations(graph: Graph) -> DataFrame:
    """All violations of a graph; an empty set of services is one too."""
    s, e, n = graph.services, graph.edges, graph.endpoints
    none = s.agg(F.count("*").alias("c")).where("c = 0").select(F.lit("services_required").alias("rule"), F.lit("service").alias("entity_kind"), F.lit("").alias("entity_id"), F.lit("there is no service").alias("message"))
    out = none.unionByName(services_violations(s)).unionByName(edges_violations(e, s)).unionByName(endpoints_violations(n, s))
    for df, kind in ((s, "service"), (e, "edge"), (n, "endpoint")):
        out = out.unionByName(seen_range(df, kind))
    return out
