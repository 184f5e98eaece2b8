"""Registered queries over a topology that the tables stand for: defaults, overlays, validation, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.identity import edge_id
from ..functions.text import map_text
from ..operators import discover, overlay, quality, validate
from ..schemas import EDGES, ENDPOINTS, SERVICES
from ..session import _fill as fill
from ..sources.documents import Graph, normalize_topology
from .queries import _LINK, _linked, _with, register
from . import views


def _raw(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations as services, suppliers as edges between them, parts as endpoints; much is left to the defaults."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    k, s, p = F.col("n_nationkey"), F.col("s_suppkey"), F.col("p_partkey")
    support = lambda n: F.struct(n.cast("bigint").alias("observations"), F.array().cast("array<string>").alias("evidence"))
    with_support = ", support struct<observations: bigint, evidence: array<string>>"
    n = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # region has five rows
    services = fill(n, SERVICES + with_support, {"support": support(F.lit(None)), "id": F.concat(F.lit(" n"), k, F.lit("\t")), "name": F.when(k % 2 == 0, "").otherwise(F.col("n_name")), "replicas": F.when(k % 3 != 0, k % 5 + 1), "labels": F.create_map(F.lit(" region "), F.col("r_name")), "failure_eligible": F.when(k % 4 == 0, True)})
    edges = fill(t("supplier"), EDGES + with_support, {"support": support(s % 4), "from": F.concat(F.lit("n"), "s_nationkey"), "to": F.concat(F.lit("n"), (F.col("s_nationkey") + s) % 25), "kind": F.when(s % 2 == 0, "SYNC").otherwise(" async"), "blocking": F.when(s % 5 == 0, True), "weight": F.when(s % 3 == 0, F.col("s_acctbal"))})
    endpoints = fill(t("part"), ENDPOINTS + with_support, {"support": support(F.lit(None)), "id": F.when(p % 10 == 0, F.concat(F.lit("p"), p)), "entry_service": F.concat(F.lit("n"), p % 25), "method": F.lit(" get"), "path": F.concat(F.lit("part/"), p), "predicate_ref": F.when(p % 7 == 0, "custom")})
    return Graph(services, edges, endpoints, "", "tables")


def _topology(spark: SparkSession, sf_dir: str) -> Graph:
    return normalize_topology(_raw(spark, sf_dir))


_S = "SELECT 'n' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'n' || n_nationkey ELSE n_name END AS name, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey % 5 + 1 ELSE 1 END AS replicas, 'region=' || r_name AS labels, CAST(1 AS BIGINT) AS observations, 'topology_api' AS evidence, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey"
_E = """SELECT f || '|' || t || '|' || kind || '|' || blocking AS id, f, t, kind, blocking, observations, weight, k FROM (SELECT 'n' || s_nationkey AS f, 'n' || ((s_nationkey + s_suppkey) % 25) AS t, CASE WHEN s_suppkey % 2 = 0 THEN 'sync' ELSE 'async' END AS kind,
 CASE WHEN s_suppkey % 5 = 0 THEN true ELSE s_suppkey % 2 = 0 END AS blocking, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE s_suppkey % 4 END AS observations, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS weight, s_suppkey AS k FROM supplier)"""
_N = "SELECT CASE WHEN p_partkey % 10 = 0 THEN 'p' || p_partkey ELSE 'n' || (p_partkey % 25) || ':GET /part/' || p_partkey END AS id, 'n' || (p_partkey % 25) AS entry_service, 'GET' AS method, '/part/' || p_partkey AS path, CASE WHEN p_partkey % 7 = 0 THEN 'custom' ELSE CASE WHEN p_partkey % 10 = 0 THEN 'p' || p_partkey ELSE 'n' || (p_partkey % 25) || ':GET /part/' || p_partkey END END AS predicate_ref FROM part"


@register(f"SELECT id, name, replicas, labels, observations, evidence FROM ({_S})")
def topology_services_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topology(spark, sf_dir).services.select("id", "name", "replicas", map_text(F.col("labels")).alias("labels"), "observations", F.array_join("evidence", ",").alias("evidence"))


@register(f'SELECT id, f AS "from", t AS "to", kind, blocking, CAST(observations AS BIGINT) AS observations, count(*) AS n FROM ({_E}) GROUP BY ALL')
def topology_edges_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topology(spark, sf_dir).edges.groupBy("id", "from", "to", "kind", "blocking", "observations").agg(F.count("*").alias("n"))


@register(_N)
def topology_endpoints_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topology(spark, sf_dir).endpoints.select("id", "entry_service", "method", "path", "predicate_ref")


def _patches(spark: SparkSession, sf_dir: str, schema: str, entity_id, **values) -> DataFrame:
    """Parts as patches in the order (p_size mod 3, p_partkey)."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("_id", entity_id)
    own = fill(p, "precedence int, item int, overlay string, ref string, " + schema, {"precedence": F.col("p_size") % 3 + 1, "item": F.col("p_partkey"), "overlay": F.concat(F.lit("o"), F.col("p_size") % 3 + 1), "ref": F.lit("parts"), "id": F.col("_id"), **values})
    return own


def _service_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return _patches(spark, sf_dir, SERVICES, F.concat(F.lit("n"), p % 25), labels=F.create_map(F.col("p_brand"), F.col("p_type")), tags=F.array("p_brand", F.lit(" ")), replicas=F.when(p % 7 == 0, F.col("p_size")), failure_eligible=F.when(p % 11 == 0, p % 2 == 0))


def _merged_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.merge_services(_topology(spark, sf_dir).services, _service_patches(spark, sf_dir))


_P = "p AS (SELECT 'n' || (p_partkey % 25) AS id, p_size % 3 + 1 AS precedence, p_partkey AS item, * FROM part), s AS (" + _S + ")"


@register(f"""WITH {_P}, l AS (SELECT id, p_brand AS k, arg_max(p_type, precedence * 100000000 + item) AS v FROM p GROUP BY ALL UNION ALL SELECT id, 'region', split_part(labels, '=', 2) FROM s)
SELECT id, string_agg(k || '=' || v, '|' ORDER BY k || '=' || v) AS labels FROM l WHERE id IN (SELECT id FROM s) GROUP BY id""")
def overlay_labels_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_services(spark, sf_dir).select("id", map_text(F.col("labels")).alias("labels"))


@register(f"WITH {_P} SELECT s.id, coalesce(string_agg(DISTINCT p_brand, ',' ORDER BY p_brand), '') AS tags FROM s LEFT JOIN p ON p.id = s.id GROUP BY s.id")
def overlay_tags_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_services(spark, sf_dir).select("id", F.array_join("tags", ",").alias("tags"))


@register(f"""WITH {_P} SELECT s.id, coalesce(arg_max(p_size, precedence * 100000000 + item) FILTER (WHERE p_partkey % 7 = 0), any_value(replicas)) AS replicas,
coalesce(arg_max(p_partkey % 2 = 0, precedence * 100000000 + item) FILTER (WHERE p_partkey % 11 = 0), any_value(CASE WHEN k % 4 = 0 THEN true END)) AS failure_eligible FROM s LEFT JOIN p ON p.id = s.id GROUP BY s.id""")
def overlay_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_services(spark, sf_dir).select("id", "replicas", "failure_eligible")


@register(f"""WITH {_P}, o AS (SELECT id, string_agg('o' || precedence, ',' ORDER BY precedence, item) AS o FROM p GROUP BY id) SELECT s.id, 'topology_api' || coalesce(',' || o, '') AS chain FROM s LEFT JOIN o ON o.id = s.id""")
def provenance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.transform("provenance", lambda p: p["connector"])
    return _merged_services(spark, sf_dir).select("id", F.array_join(name, ",").alias("chain"))


def _edge_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    target = F.concat(F.lit("n"), p % 25, F.lit("|n"), (p + 3) % 25, F.lit("|sync|true"))
    retry = F.struct(F.when(p % 3 == 0, F.col("p_size")).alias("max_attempts"), F.lit(None).cast("double").alias("budget_cap"), F.array("p_brand").alias("retry_on"), F.lit(None).cast("struct<initial_ms: int, max_ms: int, multiplier: double, jitter: boolean>").alias("backoff"))
    resilience = F.struct(F.when(p % 2 == 0, F.col("p_size")).alias("request_timeout_ms"), F.lit(None).cast("int").alias("per_try_timeout_ms"), retry.alias("retry"), F.lit(None).alias("circuit_breaker"))
    latency = F.struct(F.when(p % 5 == 0, F.col("p_retailprice")).alias("p50"), *[F.lit(None).cast("double").alias(x) for x in ("p90", "p95", "p99")])
    identity = F.when(p % 4 == 0, F.struct(F.lit("http").alias("protocol"), F.col("p_brand").alias("operation"), *[F.lit("").alias(x) for x in ("route", "topic", "span_kind")]))
    return _patches(spark, sf_dir, EDGES, target, resilience=resilience, observed=F.struct(latency.alias("latency_ms"), F.lit(None).cast("double").alias("error_rate")), identity=identity)


def _merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey")
    edges = fill(n, EDGES, {"id": F.concat(F.lit("n"), k, F.lit("|n"), (k + 3) % 25, F.lit("|sync|true")), "from": F.concat(F.lit("n"), k), "to": F.concat(F.lit("n"), (k + 3) % 25), "kind": F.lit("sync"), "blocking": F.lit(True), "identity": F.when(k % 5 == 0, F.struct(F.lit("grpc").alias("protocol"), *[F.lit("").alias(x) for x in ("operation", "route", "topic", "span_kind")]))})
    return overlay.merge_edges(edges, _edge_patches(spark, sf_dir))


_EP = "p AS (SELECT p_partkey % 25 AS k, p_size % 3 + 1 AS precedence, p_partkey AS item, * FROM part)"


@register(f"""WITH {_EP} SELECT 'n' || n_nationkey || '|n' || ((n_nationkey + 3) % 25) || '|sync|true' AS id, arg_max(p_size, precedence * 100000000 + item) FILTER (WHERE p_partkey % 2 = 0) AS request_timeout_ms,
arg_max(p_size, precedence * 100000000 + item) FILTER (WHERE p_partkey % 3 = 0) AS max_attempts, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS retry_on, arg_max(p_retailprice, precedence * 100000000 + item) FILTER (WHERE p_partkey % 5 = 0) AS p50
FROM nation LEFT JOIN p ON k = n_nationkey GROUP BY n_nationkey""")
def overlay_policy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_edges(spark, sf_dir).select("id", "resilience.request_timeout_ms", "resilience.retry.max_attempts", F.array_join("resilience.retry.retry_on", ",").alias("retry_on"), "observed.latency_ms.p50")


@register(f"""WITH {_EP} SELECT 'n' || n_nationkey || '|n' || ((n_nationkey + 3) % 25) || '|sync|true' AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'grpc' WHEN count(*) FILTER (WHERE p_partkey % 4 = 0) > 0 THEN 'http' END AS protocol,
CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE arg_min(p_brand, precedence * 100000000 + item) FILTER (WHERE p_partkey % 4 = 0) END AS operation FROM nation LEFT JOIN p ON k = n_nationkey GROUP BY n_nationkey""")
def overlay_identity_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_edges(spark, sf_dir).select("id", "identity.protocol", "identity.operation")


def _legacy(spark: SparkSession, sf_dir: str, view: str = views.V_SPANS) -> tuple[DataFrame, DataFrame]:
    edges = discover.edges(_linked(spark, sf_dir, view)[1])
    named = edges.groupBy("from", "to", "kind", "blocking").agg(F.count("*").alias("n"))
    made = fill(named, "precedence int, item int, overlay string, ref string, " + EDGES, {"precedence": F.lit(1), "item": F.lit(0), "overlay": F.lit("o"), "ref": F.lit("r"), "id": edge_id(F.col("from"), F.col("to"), F.col("kind"), F.col("blocking"))})
    odd = fill(spark.range(2), "precedence int, item int, overlay string, ref string, " + EDGES, {"precedence": F.lit(1), "item": F.lit(1), "overlay": F.lit("o"), "ref": F.lit("r"), "id": F.concat(F.lit("x"), "id", F.lit("|y|sync|true"))})
    return overlay.resolve_edges(edges, made.unionByName(odd))


_OLD = """, d AS (SELECT DISTINCT id, ps || '|' || service || '|' || ek || '|' || (ek = 'sync') AS legacy FROM x), c AS (SELECT legacy, count(*) AS n, min(id) AS id FROM d GROUP BY legacy)"""


@register(_with(views.V_CONV, _LINK) + _OLD + " SELECT id AS edge, legacy FROM c WHERE n = 1")
def overlay_legacy_edge_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _legacy(spark, sf_dir, views.V_CONV)[0]
    return good.select(F.col("id").alias("edge"), F.array_join(F.slice(F.split("id", r"\|"), 1, 4), "|").alias("legacy"))


@register(_with(views.V_SPANS, _LINK) + _OLD + " SELECT 'overlay_ambiguous' AS rule, legacy AS entity_id FROM c WHERE n > 1 UNION ALL SELECT 'overlay_unknown', 'x0|y|sync|true' UNION ALL SELECT 'overlay_unknown', 'x1|y|sync|true'")
def overlay_unknown_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legacy(spark, sf_dir)[1].select("rule", "entity_id")


@register(f"SELECT id, 'unique_id' AS rule FROM ({_E}) GROUP BY id HAVING count(*) > 1")
def validate_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.unique(_topology(spark, sf_dir).edges, "edge").select(F.col("entity_id").alias("id"), "rule")


@register(f"SELECT id, 'to_known' AS rule, count(*) AS n FROM ({_E}) WHERE t IN ('n3', 'n8') GROUP BY id")
def validate_referential(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _topology(spark, sf_dir)
    return validate.refers(g.edges, "to", g.services.where("id not in ('n3', 'n8')"), "edge", "to_known").groupBy(F.col("entity_id").alias("id"), "rule").agg(F.count("*").alias("n"))


@register(f"SELECT id, count(*) AS n FROM ({_E}) WHERE weight < 0 GROUP BY id")
def validate_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _topology(spark, sf_dir)
    return validate.edges_violations(g.edges, g.services).where("rule = 'weight'").groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))


@register("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity > l_tax * 400 OR (l_discount > 0.05 AND l_tax * 400 > 20) GROUP BY ALL")
def validate_latency_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    high = F.when(F.col("l_discount") > 0.05, F.lit(20.0))
    observed = F.struct(F.struct(F.col("l_quantity").alias("p50"), (F.col("l_tax") * 400).alias("p90"), F.lit(None).cast("double").alias("p95"), high.alias("p99")).alias("latency_ms"))
    return rows.select("l_orderkey", "l_linenumber", observed.alias("o")).where(validate.latency_order(F.col("o"))).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


_DIMS = f"""WITH s AS ({_S}), e AS ({_E}), n AS ({_N}),
r AS (SELECT 0 AS position, 'services.failure_eligible' AS dimension, id, k % 4 = 0 AS present FROM s UNION ALL SELECT 1, 'services.placements', id, false FROM s UNION ALL SELECT 2, 'services.shared_resource_refs', id, false FROM s
UNION ALL SELECT 3, 'edges.weight', id, weight IS NOT NULL FROM e UNION ALL SELECT 4, 'edges.request_timeout_ms', id, false FROM e UNION ALL SELECT 5, 'edges.retry_policy', id, false FROM e UNION ALL SELECT 6, 'edges.circuit_breaker', id, false FROM e
UNION ALL SELECT 7, 'edges.observed_latency', id, false FROM e UNION ALL SELECT 8, 'edges.observed_error_rate', id, false FROM e UNION ALL SELECT 9, 'edges.policy_scope', id, false FROM e
UNION ALL SELECT 10, 'endpoints.route', id, true FROM n UNION ALL SELECT 11, 'endpoints.weight', id, false FROM n UNION ALL SELECT 12, 'endpoints.custom_success_predicate', id, predicate_ref <> id FROM n
UNION ALL SELECT p.i, p.d, q.id, p.y FROM (VALUES (13, 'provenance.traces', false), (14, 'provenance.topology_api', true), (15, 'provenance.overlay', false)) p(i, d, y), (SELECT 'service:' || id AS id FROM s UNION ALL SELECT 'edge:' || id FROM e UNION ALL SELECT 'endpoint:' || id FROM n) q),
o AS (SELECT position, dimension, id, bool_or(present) AS present FROM r GROUP BY ALL),
d AS (SELECT position, dimension, count(*) FILTER (WHERE present) AS present, count(*) AS total, list_sort(list(id) FILTER (WHERE NOT present)) AS missing FROM o GROUP BY ALL),
m AS (SELECT position, dimension, CASE WHEN present = total THEN 'complete' WHEN present = 0 THEN 'missing' ELSE 'partial' END AS status, present, total, floor(present::DOUBLE / total::DOUBLE * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS ratio, total - present AS missing_count, coalesce(array_to_string(missing[1:20], ','), '') AS missing FROM d)"""


@register(_DIMS + " SELECT * FROM m")
def quality_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dimensions(_topology(spark, sf_dir)).withColumn("missing", F.array_join("missing", ","))


@register(f"WITH s AS ({_S}), e AS ({_E}), n AS ({_N}) SELECT 'topology_api' AS type, (SELECT count(*) FROM s) + (SELECT count(*) FROM e) + (SELECT count(*) FROM n) AS mentions, (SELECT count(*) FROM s) + (SELECT count(DISTINCT id) FROM e) + (SELECT count(*) FROM n) AS records")
def quality_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.source_mix(_topology(spark, sf_dir))


@register(_DIMS + " SELECT dimension || ' coverage below 50% (' || present || '/' || total || ')' AS warning FROM m WHERE dimension NOT LIKE 'provenance.%' AND ratio < 0.5")
def quality_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _topology(spark, sf_dir)
    return quality.warnings(quality.dimensions(g), quality.source_mix(g))
