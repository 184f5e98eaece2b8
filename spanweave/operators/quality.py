"""Coverage of a graph's typed fields and sources: sixteen dimensions, the source mix, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.documents import Graph

MISSING = 20
_L, _P = "observed.latency_ms.", "policy_scope."


def _filled(*names: str) -> Column:
    return F.coalesce(F.concat_ws("", *[F.trim(n) for n in names]), F.lit("")) != ""


# Dimensions in their order: name, entity, what must be there.
DIMENSIONS: tuple = (
    ("services.failure_eligible", "service", lambda: F.col("failure_eligible").isNotNull()),
    ("services.placements", "service", lambda: F.size("placements") > 0),
    ("services.shared_resource_refs", "service", lambda: F.size("shared_resource_refs") > 0),
    ("edges.weight", "edge", lambda: F.col("weight").isNotNull()),
    ("edges.request_timeout_ms", "edge", lambda: F.col("resilience.request_timeout_ms").isNotNull()),
    ("edges.retry_policy", "edge", lambda: F.col("resilience.retry").isNotNull()),
    ("edges.circuit_breaker", "edge", lambda: F.col("resilience.circuit_breaker").isNotNull()),
    ("edges.observed_latency", "edge", lambda: F.coalesce(_L + "p50", _L + "p90", _L + "p95", _L + "p99").isNotNull()),
    ("edges.observed_error_rate", "edge", lambda: F.col("observed.error_rate").isNotNull()),
    ("edges.policy_scope", "edge", lambda: _filled(_P + "source_endpoint_id", _P + "source_route", _P + "method", _P + "operation")),
    ("endpoints.route", "endpoint", lambda: (F.coalesce(F.trim("method"), F.lit("")) != "") & (F.coalesce(F.trim("path"), F.lit("")) != "")),
    ("endpoints.weight", "endpoint", lambda: F.col("weight").isNotNull()),
    ("endpoints.custom_success_predicate", "endpoint", lambda: (F.coalesce(F.trim("predicate_ref"), F.lit("")) != "") & (F.col("predicate_ref") != F.col("id"))),
    ("provenance.traces", "record", lambda: F.exists("provenance", lambda p: F.trim(p["type"]) == "traces")),
    ("provenance.topology_api", "record", lambda: F.exists("provenance", lambda p: F.trim(p["type"]) == "topology_api")),
    ("provenance.overlay", "record", lambda: F.exists("provenance", lambda p: F.trim(p["type"]) == "overlay")),
)


def presence(graph: Graph) -> DataFrame:
    """(dimension, id, present): each entity once for each dimension of its kind, from one scan of each entity table."""
    out = None
    for kind, df in (("service", graph.services), ("edge", graph.edges), ("endpoint", graph.endpoints)):
        own = [F.struct(F.lit(n).alias("dimension"), F.trim("id").alias("id"), F.coalesce(test(), F.lit(False)).alias("present")) for n, k, test in DIMENSIONS if k == kind]
        own += [F.struct(F.lit(n).alias("dimension"), F.concat(F.lit(kind + ":"), "id").alias("id"), F.coalesce(test(), F.lit(False)).alias("present")) for n, k, test in DIMENSIONS if k == "record"]
        rows = df.select(F.explode(F.array(*own)).alias("x")).select("x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def dimensions(graph: Graph) -> DataFrame:
    """(position, dimension, status, present, total, ratio, missing_count, missing): the report's first MISSING missing ids, sorted.

    Ids are distinct; the list of missing ones is ranked within a dimension, which is over entities, not spans.
    """
    one = presence(graph).groupBy("dimension", "id").agg(F.max("present").alias("present"))
    rank = F.row_number().over(Window.partitionBy("dimension", "present").orderBy("id"))
    one = one.withColumn("rank", rank)
    got = one.groupBy("dimension").agg(F.count("*").alias("total"), F.count_if("present").alias("present"), F.array_sort(F.collect_list(F.when(~F.col("present") & (F.col("rank") <= MISSING), F.col("id")))).alias("missing"))
    names = graph.services.sparkSession.createDataFrame([(i, n) for i, (n, _, _) in enumerate(DIMENSIONS)], "position int, dimension string")
    df = names.join(got, "dimension", "left").fillna(0, ["total", "present"])
    ratio = F.when(F.col("total") > 0, F.floor(F.col("present").cast("double") / F.col("total").cast("double") * 1000.0 + 0.5) / 1000.0).otherwise(0.0)
    status = F.when(F.col("total") == 0, "not_applicable").when(F.col("present") == F.col("total"), "complete").when(F.col("present") == 0, "missing").otherwise("partial")
    return df.select("position", "dimension", status.alias("status"), "present", "total", ratio.alias("ratio"), (F.col("total") - F.col("present")).alias("missing_count"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def source_mix(graph: Graph) -> DataFrame:
    """(type, mentions, records): how often a source type is named in provenance, and by how many records."""
    rows = None
    for kind, df in (("service", graph.services), ("edge", graph.edges), ("endpoint", graph.endpoints)):
        own = df.select(F.concat(F.lit(kind + ":"), "id").alias("record"), F.explode("provenance").alias("p")).select("record", F.trim("p.type").alias("type"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("type").agg(F.count("*").alias("mentions"), F.count_distinct("record").alias("records"))


def warnings(dims: DataFrame, mix: DataFrame) -> DataFrame:
    """Sorted texts: no source beyond traces; any dimension but provenance that has less than half."""
    low = dims.where("dimension not like 'provenance.%' and total > 0 and ratio < 0.5").select(F.concat("dimension", F.lit(" coverage below 50% ("), "present", F.lit("/"), "total", F.lit(")")).alias("warning"))
    records = dims.where("dimension = 'provenance.traces'").select("total")
    other = mix.agg(F.count_if(F.col("type").isin("topology_api", "overlay")).alias("others"))
    none = records.crossJoin(other).where("total > 0 and others = 0").select(F.lit("no topology_api or overlay provenance; typed placement and policy coverage depends on trace-derived evidence only").alias("warning"))  # one row each
    return low.unionByName(none).orderBy("warning")
