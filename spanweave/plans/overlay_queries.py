"""Registered queries of overlay merges and validation rules, with deliberate gaps and faults made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import map_text
from ..operators import overlay, validate
from ..schemas import EDGES, ENDPOINTS, SERVICES
from ..session import _fill as fill
from ..sources.documents import Graph, clean_semantics, sorted_placements
from .graph_queries import _P, _S, _patches, _topology
from .queries import register

_RELIABILITY = "struct<live_probability: double, source: string, confidence: double>"
_RANK = "precedence * 100000000 + item"


def _services(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    place = F.array(F.struct(F.col("p_size").alias("replicas"), F.lit(None).cast("map<string,string>").alias("labels"), F.lit(None).cast(_RELIABILITY).alias("reliability")))
    patches = _patches(
        spark, sf_dir, SERVICES, F.concat(F.lit("n"), p % 25), attributes=F.create_map(F.concat(F.lit("a"), F.col("p_size") % 4), F.col("p_brand")), slo_refs=F.array(F.concat(F.lit(" slo"), F.col("p_size") % 6)),
        reliability=F.when(p % 6 == 0, F.struct((F.col("p_retailprice") / 1000).alias("live_probability"), F.col("p_brand").alias("source"), F.when(p % 12 == 0, 0.5).alias("confidence"))),
        placements=F.when(p % 9 == 0, place).when(p % 9 == 1, F.slice(place, 1, 0)), shared_resource_refs=F.when(p % 4 == 0, F.array("p_brand", F.lit(" db "), "p_brand")).when(p % 4 == 1, F.array().cast("array<string>")),
    )
    return overlay.merge_services(_topology(spark, sf_dir).services, patches)


@register(f"""WITH {_P}, l AS (SELECT id, 'a' || (p_size % 4) AS k, arg_max(p_brand, {_RANK}) AS v FROM p GROUP BY ALL)
SELECT s.id, coalesce(string_agg(l.k || '=' || v, '|' ORDER BY l.k), '') AS attributes FROM s LEFT JOIN l ON l.id = s.id GROUP BY s.id""")
def overlay_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _services(spark, sf_dir).select("id", F.coalesce(map_text(F.col("attributes")), F.lit("")).alias("attributes"))


@register(f"WITH {_P} SELECT s.id, coalesce(string_agg(DISTINCT 'slo' || (p_size % 6), ',' ORDER BY 'slo' || (p_size % 6)), '') AS slo_refs FROM s LEFT JOIN p ON p.id = s.id GROUP BY s.id")
def overlay_slo_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _services(spark, sf_dir).select("id", F.array_join("slo_refs", ",").alias("slo_refs"))


@register(f"""WITH {_P}, r AS (SELECT id, arg_max(p_partkey, {_RANK}) AS k FROM p WHERE p_partkey % 6 = 0 GROUP BY id)
SELECT s.id, p_retailprice / 1000 AS live_probability, p_brand AS source, CASE WHEN p_partkey % 12 = 0 THEN 0.5::DOUBLE END AS confidence FROM s LEFT JOIN r ON r.id = s.id LEFT JOIN part ON p_partkey = r.k""")
def overlay_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _services(spark, sf_dir).select("id", "reliability.*")


@register(f"""WITH {_P} SELECT s.id, arg_max(p_size, {_RANK}) FILTER (WHERE p_partkey % 9 = 0) AS placed, arg_max(p_brand || ',db', {_RANK}) FILTER (WHERE p_partkey % 4 = 0) AS shared FROM s LEFT JOIN p ON p.id = s.id GROUP BY s.id""")
def overlay_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _services(spark, sf_dir)
    return merged.select("id", F.get("placements", F.lit(0))["replicas"].alias("placed"), F.array_join("shared_resource_refs", ",").alias("shared"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = F.col("p_partkey"), F.col("n_nationkey")
    edges = fill(spark.read.parquet(f"{sf_dir}/nation.parquet"), EDGES, {"id": F.concat(F.lit("n"), k), "from": F.concat(F.lit("n"), k), "to": F.concat(F.lit("n"), (k + 1) % 25), "kind": F.lit("sync"), "weight": k.cast("double"), "observed": F.when(k % 2 == 0, F.struct(F.struct(*[F.lit(v).cast("double").alias(c) for c, v in (("p50", 1), ("p90", 2), ("p95", None), ("p99", 3))]).alias("latency_ms"), F.lit(0.25).alias("error_rate")))})
    blank = F.lit("  ")
    patches = _patches(
        spark, sf_dir, EDGES, F.concat(F.lit("n"), p % 25), weight=F.when(p % 13 == 0, F.col("p_retailprice")),
        observed=F.struct(F.struct(*[F.when(p % m == 0, F.col("p_size").cast("double")).alias(c) for c, m in (("p50", 50), ("p90", 60), ("p95", 70), ("p99", 80))]).alias("latency_ms"), F.when(p % 40 == 0, F.col("p_size") / 100).alias("error_rate")),
        policy_scope=F.struct(F.when(p % 3 == 0, F.col("p_brand")).otherwise(blank).alias("source_endpoint_id"), F.when(p % 5 == 0, F.col("p_type")).alias("source_route"), F.when(p % 30 == 0, "GET").otherwise("").alias("method"), F.lit(None).cast("string").alias("operation")),
    )
    return overlay.merge_edges(edges, patches)


_EN = "p AS (SELECT 'n' || (p_partkey % 25) AS id, p_size % 3 + 1 AS precedence, p_partkey AS item, * FROM part), n AS (SELECT 'n' || n_nationkey AS id, n_nationkey AS k FROM nation)"


def _last(value: str, given: str) -> str:
    return f"arg_max({value}, {_RANK}) FILTER (WHERE {given})"


@register(f"""WITH {_EN} SELECT n.id, coalesce({_last("p_size::DOUBLE", "p_partkey % 50 = 0")}, CASE WHEN any_value(k) % 2 = 0 THEN 1::DOUBLE END) AS p50, coalesce({_last("p_size::DOUBLE", "p_partkey % 60 = 0")}, CASE WHEN any_value(k) % 2 = 0 THEN 2::DOUBLE END) AS p90,
{_last("p_size::DOUBLE", "p_partkey % 70 = 0")} AS p95, coalesce({_last("p_size::DOUBLE", "p_partkey % 80 = 0")}, CASE WHEN any_value(k) % 2 = 0 THEN 3::DOUBLE END) AS p99, coalesce({_last("p_size / 100::DOUBLE", "p_partkey % 40 = 0")}, CASE WHEN any_value(k) % 2 = 0 THEN 0.25::DOUBLE END) AS error_rate,
coalesce({_last("p_retailprice", "p_partkey % 13 = 0")}, any_value(k)::DOUBLE) AS weight FROM n LEFT JOIN p ON p.id = n.id GROUP BY n.id""")
def overlay_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("id", "observed.latency_ms.*", "observed.error_rate", "weight")


@register(f"""WITH {_EN} SELECT n.id, {_last("p_brand", "p_partkey % 3 = 0")} AS source_endpoint_id, {_last("p_type", "p_partkey % 5 = 0")} AS source_route, {_last("'GET'", "p_partkey % 30 = 0")} AS method, CAST(NULL AS VARCHAR) AS operation FROM n LEFT JOIN p ON p.id = n.id GROUP BY n.id""")
def overlay_policy_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("id", *[F.col(f"policy_scope.{c}").alias(c) for c in ("source_endpoint_id", "source_route", "method", "operation")])


def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = F.col("p_partkey"), F.col("n_nationkey")
    none = F.lit(None).cast("array<string>")

    def semantics(mode, targets, modes, source, confidence):
        return F.struct(mode.alias("predicate_mode"), targets.alias("mandatory_targets"), modes.alias("dependency_modes"), source.alias("source"), confidence.alias("confidence"))

    base = semantics(F.lit("immediate_response"), F.array(F.lit("n1")), none, F.lit("own"), F.lit(0.125))
    rows = fill(spark.read.parquet(f"{sf_dir}/nation.parquet"), ENDPOINTS, {"id": F.concat(F.lit("n"), k), "entry_service": F.concat(F.lit("n"), k), "method": F.lit("GET"), "path": F.concat(F.lit("/"), k), "predicate_ref": F.concat(F.lit("n"), k), "semantics": F.when(k % 3 == 0, base)})
    given = semantics(F.when(p % 40 == 0, " Eventual_Completion ").otherwise(""), F.when(p % 8 == 0, F.array(F.lit("n2"), F.concat(F.lit("n"), F.col("p_size") % 5), F.lit(" "))).otherwise(F.array().cast("array<string>")), F.when(p % 16 == 0, F.array(F.lit("SYNC"), F.lit("async"))), F.when(p % 60 == 0, F.col("p_brand")), F.when(p % 35 == 0, F.col("p_size") / 100))
    patches = _patches(spark, sf_dir, ENDPOINTS, F.concat(F.lit("n"), p % 25), weight=F.when(p % 13 == 0, F.col("p_retailprice")), predicate_ref=F.when(p % 90 == 0, F.col("p_brand")).otherwise(" "), method=F.when(p % 45 == 0, "PUT"), path=F.when(p % 55 == 0, F.concat(F.lit("/"), "p_size")), semantics=given)
    return overlay.merge_endpoints(rows, patches)


@register(f"""WITH {_EN} SELECT n.id, coalesce({_last("p_brand", "p_partkey % 90 = 0")}, n.id) AS predicate_ref, coalesce({_last("'PUT'", "p_partkey % 45 = 0")}, 'GET') AS method, coalesce({_last("'/' || p_size", "p_partkey % 55 = 0")}, '/' || any_value(k)) AS path, {_last("p_retailprice", "p_partkey % 13 = 0")} AS weight FROM n LEFT JOIN p ON p.id = n.id GROUP BY n.id""")
def overlay_endpoint_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _endpoints(spark, sf_dir).select("id", "predicate_ref", "method", "path", "weight")


@register(f"""WITH {_EN}, m AS (SELECT n.id, any_value(k) % 3 = 0 AS own, {_last("'eventual_completion'", "p_partkey % 40 = 0")} AS mode, {_last("p_size % 5", "p_partkey % 8 = 0")} AS target, {_last("'async,sync'", "p_partkey % 16 = 0")} AS modes, {_last("p_brand", "p_partkey % 60 = 0")} AS source, {_last("p_size / 100::DOUBLE", "p_partkey % 35 = 0")} AS confidence FROM n LEFT JOIN p ON p.id = n.id GROUP BY n.id)
SELECT id, coalesce(mode, CASE WHEN own THEN 'immediate_response' ELSE '' END) AS predicate_mode, CASE WHEN target IS NOT NULL THEN array_to_string(list_sort(list_distinct(['n2', 'n' || target])), ',') WHEN own THEN 'n1' ELSE '' END AS mandatory_targets,
coalesce(modes, '') AS dependency_modes, coalesce(source, CASE WHEN own THEN 'own' ELSE '' END) AS source, coalesce(confidence, CASE WHEN own THEN 0.125::DOUBLE END) AS confidence FROM m""")
def overlay_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("semantics")
    text = lambda c: F.coalesce(c, F.lit(""))
    return _endpoints(spark, sf_dir).select("id", text(s["predicate_mode"]).alias("predicate_mode"), text(F.array_join(s["mandatory_targets"], ",")).alias("mandatory_targets"), text(F.array_join(s["dependency_modes"], ",")).alias("dependency_modes"), text(s["source"]).alias("source"), s["confidence"].alias("confidence"))


@register("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE lower(p_brand) END AS mode, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS source FROM part")
def zero_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A struct of blanks counts as absent."""
    blank = F.col("p_size") % 3 == 0
    s = F.struct(F.when(blank, " ").otherwise(F.col("p_brand")).alias("predicate_mode"), F.array(F.lit(" ")).alias("mandatory_targets"), F.lit(None).cast("array<string>").alias("dependency_modes"), F.when(~blank, F.concat(F.lit(" "), "p_type")).alias("source"), F.lit(None).cast("double").alias("confidence"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", clean_semantics(s).alias("s")).select("p_partkey", F.col("s.predicate_mode").alias("mode"), "s.source")


@register("SELECT p_partkey, CASE WHEN p_size < 25 THEN p_size || ',25,25' WHEN p_size = 25 THEN '25,25,25' ELSE '25,25,' || p_size END AS replicas, CASE WHEN p_size < 25 THEN 'zone=z|,zone=a,zone=b' WHEN p_size = 25 THEN 'zone=a,zone=b,zone=z|' ELSE 'zone=a,zone=b,zone=z|' END AS zones FROM part")
def placement_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda n, zone: F.struct(n.cast("int").alias("replicas"), F.create_map(F.lit("zone"), F.lit(zone)).alias("labels"), F.lit(None).cast(_RELIABILITY).alias("reliability"))
    rows = F.array(place(F.lit(25), "b"), place(F.col("p_size"), "z|"), place(F.lit(25), "a"))
    out = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", sorted_placements(rows).alias("s"))
    return out.select("p_partkey", F.array_join(F.transform("s", lambda x: x["replicas"].cast("string")), ",").alias("replicas"), F.array_join(F.transform("s", lambda x: map_text(x["labels"])), ",").alias("zones"))


def _faulty(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts as services, edges and endpoints, each with the fault that its number gives it."""
    p, size = F.col("p_partkey"), F.col("p_size")
    own = spark.read.parquet(f"{sf_dir}/part.parquet")
    reliability = F.when(p % 7 == 0, F.struct(F.when(p % 14 == 0, size / 25.0).alias("live_probability"), F.lit("").alias("source"), F.when(p % 21 == 0, F.lit(-0.5)).alias("confidence")))
    placement = F.struct((size % 2).cast("int").alias("replicas"), F.lit(None).cast("map<string,string>").alias("labels"), reliability.alias("reliability"))
    key = F.concat(F.lit("p"), F.when(p % 50 == 0, p - 1).otherwise(p))  # now and then the id of the part before
    s = fill(own, SERVICES, {"id": F.when(p % 31 == 0, " ").otherwise(key), "name": F.when(p % 37 == 0, "").otherwise(F.col("p_name")), "replicas": F.when(p % 11 == 0, 0).otherwise(size), "reliability": reliability, "placements": F.when(p % 5 == 0, F.array(placement)), "first_seen": F.when(p % 17 == 0, "2024-02-30T00:00:00Z").when(p % 19 == 0, "2024-03-02T00:00:00Z"), "last_seen": F.when(p % 19 == 0, "2024-03-01T00:00:00Z")})
    part = lambda kind, **v: F.struct(*[v.get(f, F.lit(None)).cast(t).alias(f) for f, t in kind])
    retry = F.struct(F.when(p % 9 == 0, -size).cast("int").alias("max_attempts"), F.lit(None).cast("double").alias("budget_cap"), F.array().cast("array<string>").alias("retry_on"), part((("initial_ms", "int"), ("max_ms", "int"), ("multiplier", "double"), ("jitter", "boolean")), multiplier=F.when(p % 23 == 0, -0.5)).alias("backoff"))
    breaker = part((("enabled", "boolean"), ("max_pending_requests", "int"), ("max_requests", "int"), ("max_connections", "int"), ("consecutive_5xx", "int"), ("interval_ms", "int"), ("base_ejection_time_ms", "int")), interval_ms=F.when(p % 29 == 0, -1))
    latency = F.struct(F.when(p % 6 == 0, size.cast("double")).alias("p50"), F.when(p % 12 == 0, 25.0).alias("p90"), F.lit(None).cast("double").alias("p95"), F.when(p % 18 == 0, -1.0).alias("p99"))
    identity = F.when(p % 4 == 0, F.struct(F.lit("http").alias("protocol"), F.concat("p_brand", F.when(p % 8 == 0, "|").otherwise("")).alias("operation"), *[F.lit("").alias(x) for x in ("route", "topic", "span_kind")]))
    e = fill(own, EDGES, {"id": F.concat(F.lit("e"), p), "from": F.concat(F.lit("p"), p), "to": F.concat(F.lit("p"), p + 1), "kind": F.when(p % 13 == 0, "both").otherwise("sync"), "identity": identity, "weight": F.when(p % 15 == 0, -0.5), "reliability": reliability, "resilience": F.struct(F.lit(None).cast("int").alias("request_timeout_ms"), F.lit(None).cast("int").alias("per_try_timeout_ms"), retry.alias("retry"), breaker.alias("circuit_breaker")), "observed": F.struct(latency.alias("latency_ms"), F.when(p % 10 == 0, size / 40.0).alias("error_rate"))})
    semantics = F.struct(F.when(p % 3 == 0, "someday").otherwise("immediate_response").alias("predicate_mode"), F.when(p % 16 == 0, F.array(F.lit(" "), F.lit("nobody"))).alias("mandatory_targets"), F.when(p % 20 == 0, F.array(F.lit("sync"), F.lit("never"))).alias("dependency_modes"), F.lit("").alias("source"), F.when(p % 24 == 0, 1.5).alias("confidence"))
    n = fill(own, ENDPOINTS, {"id": F.concat(F.lit("n"), p), "entry_service": F.when(p % 26 == 0, "nobody").otherwise("p1"), "method": F.lit("GET"), "path": F.lit("/"), "predicate_ref": F.when(p % 28 == 0, " ").otherwise("x"), "weight": F.when(p % 33 == 0, -1.0), "semantics": semantics})
    return Graph(s, e, n)


_REL = "(p_partkey % 7 = 0 AND p_partkey % 14 <> 0) AS r1, (p_partkey % 14 = 0 AND p_size / 25.0::DOUBLE > 1) AS r2, (p_partkey % 21 = 0) AS r3"
_FAULTS = f"""WITH p AS (SELECT *, p_partkey AS k, {_REL}, 'p' || CASE WHEN p_partkey % 50 = 0 THEN p_partkey - 1 ELSE p_partkey END AS key, CASE WHEN p_partkey % 31 = 0 THEN ' ' ELSE 'p' || CASE WHEN p_partkey % 50 = 0 THEN p_partkey - 1 ELSE p_partkey END END AS sid FROM part),
bad(kind, rule, n) AS (
SELECT 'service', 'id_required', count(*) FROM p WHERE k % 31 = 0 UNION ALL SELECT 'service', 'name_required', count(*) FROM p WHERE k % 37 = 0 UNION ALL SELECT 'service', 'replicas', count(*) FROM p WHERE k % 11 = 0
UNION ALL SELECT 'service', 'placements', count(*) FROM p WHERE k % 5 = 0 AND p_size % 2 = 0 UNION ALL SELECT 'service', 'placement_reliability', count(*) FROM p WHERE k % 5 = 0 AND k % 7 = 0 AND (r1 OR r2 OR r3)
UNION ALL SELECT 'service', 'unique_id', count(*) FROM (SELECT sid FROM p GROUP BY sid HAVING count(*) > 1)
UNION ALL SELECT 'service', 'seen_format', count(*) FROM p WHERE k % 17 = 0 UNION ALL SELECT 'service', 'seen_order', count(*) FROM p WHERE k % 19 = 0 AND k % 17 <> 0
UNION ALL SELECT 'edge', 'kind', count(*) FROM p WHERE k % 13 = 0 UNION ALL SELECT 'edge', 'identity_pipe', count(*) FROM p WHERE k % 8 = 0 UNION ALL SELECT 'edge', 'weight', count(*) FROM p WHERE k % 15 = 0
UNION ALL SELECT 'edge', 'resilience', count(*) FROM p WHERE k % 9 = 0 OR k % 23 = 0 OR k % 29 = 0 UNION ALL SELECT 'edge', 'error_rate', count(*) FROM p WHERE k % 10 = 0 AND p_size > 40 UNION ALL SELECT 'edge', 'latency', count(*) FROM p WHERE k % 18 = 0
UNION ALL SELECT 'edge', 'latency_order', count(*) FROM p WHERE (k % 12 = 0 AND p_size > 25) OR k % 18 = 0 UNION ALL SELECT 'edge', 'from_known', count(*) FROM p WHERE 'p' || k NOT IN (SELECT sid FROM p) UNION ALL SELECT 'edge', 'to_known', count(*) FROM p WHERE 'p' || (k + 1) NOT IN (SELECT sid FROM p)
UNION ALL SELECT x.kind, x.rule, count(*) FROM p, (VALUES ('service', 'reliability_required', 1), ('service', 'reliability_range', 2), ('service', 'confidence_range', 3), ('edge', 'reliability_required', 1), ('edge', 'reliability_range', 2), ('edge', 'confidence_range', 3)) x(kind, rule, i) WHERE CASE i WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r3 END GROUP BY ALL
UNION ALL SELECT 'endpoint', 'predicate', count(*) FROM p WHERE k % 28 = 0 UNION ALL SELECT 'endpoint', 'weight', count(*) FROM p WHERE k % 33 = 0 UNION ALL SELECT 'endpoint', 'predicate_mode', count(*) FROM p WHERE k % 3 = 0 UNION ALL SELECT 'endpoint', 'dependency_modes', count(*) FROM p WHERE k % 20 = 0
UNION ALL SELECT 'endpoint', 'targets', count(*) FROM p WHERE k % 16 = 0 UNION ALL SELECT 'endpoint', 'target_known', count(*) * 2 - count(*) FILTER (WHERE EXISTS (SELECT 1 FROM p q WHERE q.sid = ' ')) FROM p WHERE k % 16 = 0 UNION ALL SELECT 'endpoint', 'confidence_range', count(*) FROM p WHERE k % 24 = 0 UNION ALL SELECT 'endpoint', 'entry_known', count(*) FROM p WHERE k % 26 = 0)
SELECT kind AS entity_kind, rule, n FROM bad WHERE n > 0"""


@register(_FAULTS)
def validate_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.violations(_faulty(spark, sf_dir)).groupBy("entity_kind", "rule").agg(F.count("*").alias("n"))
