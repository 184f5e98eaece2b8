"""Registered queries of the graph operators, and for each the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import first_nonblank, name_method, name_path, query_escape, span_path
from ..operators import discover
from . import views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _with(view: str, body: str) -> str:
    return f"WITH RECURSIVE v AS ({views.duck_sql(view)}),{body}"


#: DuckDB: facts of a span, its parent, and the edge and endpoint that it observes.
_METHODS = "('GET', 'POST', 'PUT', 'PATCH', 'DELETE', 'HEAD', 'OPTIONS')"
_PATH = "CASE WHEN {0} = '' THEN '' WHEN starts_with(regexp_replace({0}, '[?].*$', ''), '/') THEN regexp_replace({0}, '[?].*$', '') ELSE '/' || regexp_replace({0}, '[?].*$', '') END"
_LINK = f"""
f AS (SELECT *, upper(a_method) AS m, CASE WHEN len(string_split(name, ' ')) >= 2 AND upper(split_part(name, ' ', 1)) IN {_METHODS} THEN upper(split_part(name, ' ', 1)) ELSE '' END AS nm FROM v),
g AS (SELECT *, CASE WHEN nm <> '' THEN split_part(name, ' ', 2) ELSE '' END AS np, (kind IN ('producer', 'consumer') OR a_system <> '' OR a_topic <> '') AS is_async,
      list_filter([CASE WHEN kind IN ('producer', 'consumer') THEN 'span.kind=' || kind END, CASE WHEN a_system <> '' THEN 'messaging.system' END, CASE WHEN a_topic <> '' THEN 'messaging.destination' END], lambda x: x IS NOT NULL) AS signals FROM f),
i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, span_id ORDER BY seq DESC) AS rn FROM g WHERE service <> '' AND trace_id <> '' AND span_id <> '') WHERE rn = 1),
l AS (SELECT c.trace_id, c.service, c.m, c.nm, c.np, c.a_route, c.kind, c.start_ns, c.end_ns, coalesce(p.service = c.service, false) AS inner_call, p.service AS ps,
      CASE WHEN p.is_async OR c.is_async THEN 'async' ELSE 'sync' END AS ek,
      CASE WHEN p.is_async THEN list_sort(list_append(p.signals, 'parent_async_signal')) WHEN c.is_async THEN list_sort(list_append(c.signals, 'child_async_signal')) ELSE ['default_sync'] END AS evidence,
      CASE WHEN (c.m <> '' OR c.a_route <> '' OR (c.nm <> '' AND c.np <> '')) OR (p.m <> '' OR p.a_route <> '' OR (p.nm <> '' AND p.np <> '')) THEN 'http' WHEN c.a_system <> '' THEN c.a_system ELSE coalesce(p.a_system, '') END AS protocol,
      CASE WHEN c.m <> '' THEN c.m ELSE c.nm END AS operation,
      CASE WHEN c.a_route <> '' THEN {_PATH.format('c.a_route')} WHEN c.np <> '' THEN {_PATH.format('c.np')} ELSE {_PATH.format("coalesce(p.a_route, '')")} END AS route,
      CASE WHEN c.a_topic <> '' THEN c.a_topic ELSE coalesce(p.a_topic, '') END AS topic,
      CASE WHEN c.end_ns >= c.start_ns THEN round((c.end_ns - c.start_ns) / 1e6, 3) END AS ms
      FROM g c LEFT JOIN i p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id AND c.trace_id <> '' AND c.parent_span_id <> '' WHERE c.service <> ''),
x AS (SELECT *, ps || '|' || service || '|' || ek || '|' || (ek = 'sync') || CASE WHEN protocol <> '' THEN '|protocol=' || url_encode(protocol) ELSE '' END || CASE WHEN operation <> '' THEN '|operation=' || url_encode(operation) ELSE '' END
      || CASE WHEN route <> '' THEN '|route=' || url_encode(route) ELSE '' END || CASE WHEN topic <> '' THEN '|topic=' || url_encode(topic) ELSE '' END || CASE WHEN kind <> '' THEN '|span_kind=' || url_encode(kind) ELSE '' END AS id
      FROM l WHERE ps IS NOT NULL AND ps <> service),
n AS (SELECT *, service || ':' || method || ' ' || path AS id FROM (SELECT *, CASE WHEN m <> '' THEN m ELSE nm END AS method,
      {_PATH.format("CASE WHEN a_route <> '' THEN a_route ELSE np END")} AS path FROM l) WHERE method <> '' AND path <> '' AND (kind = 'server' OR NOT inner_call))"""

_EDGES = """SELECT id, any_value(ps) AS "from", any_value(service) AS "to", any_value(ek) AS kind, count(*) AS observations, count(DISTINCT nullif(trace_id, '')) AS trace_count,
       array_to_string(list_sort(list_distinct(flatten(list(evidence)))), ',') AS evidence, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.9) AS p90, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99,
       min(coalesce(end_ns, start_ns)) AS first_ns, max(coalesce(end_ns, start_ns)) AS last_ns FROM x GROUP BY id"""


def _linked(spark: SparkSession, sf_dir: str, view: str = views.V_SPANS) -> tuple[DataFrame, DataFrame]:
    prepared = discover.prepare(views.spans(spark, sf_dir, view))
    return prepared, discover.link_parents(prepared)


def _edge_columns(df: DataFrame) -> DataFrame:
    return df.select("id", "from", "to", "kind", "observations", "trace_count", F.array_join("evidence", ",").alias("evidence"), "p50", "p90", "p95", "p99", "first_ns", "last_ns")


@register(_with(views.V_SPANS, _LINK) + _EDGES)
def edge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_columns(discover.edges(_linked(spark, sf_dir)[1]))


@register(_with(views.V_CONV, _LINK) + _EDGES)
def conversation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_columns(discover.edges(_linked(spark, sf_dir, views.V_CONV)[1]))


@register(_with(views.V_SPANS, _LINK) + "SELECT service AS id, count(*) AS observations, count(DISTINCT nullif(trace_id, '')) AS trace_count, min(coalesce(end_ns, start_ns)) AS first_ns, max(coalesce(end_ns, start_ns)) AS last_ns FROM l GROUP BY service")
def service_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.services(_linked(spark, sf_dir)[0])


@register(_with(views.V_SPANS, _LINK) + "SELECT id, any_value(service) AS entry_service, any_value(method) AS method, any_value(path) AS path, count(*) AS observations, count(DISTINCT nullif(trace_id, '')) AS trace_count, min(coalesce(end_ns, start_ns)) AS first_ns, max(coalesce(end_ns, start_ns)) AS last_ns FROM n GROUP BY id")
def endpoint_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.endpoints(_linked(spark, sf_dir)[1])


@register(_with(views.V_SPANS, _LINK) + "SELECT ps AS parent_service, service, count(*) AS pairs FROM l WHERE ps IS NOT NULL GROUP BY ALL")
def parent_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)[1].where("parent is not null").groupBy(F.col("parent.service").alias("parent_service"), "service").agg(F.count("*").alias("pairs"))


@register(_with(views.V_SPANS, _LINK) + "SELECT ek AS kind, array_to_string(evidence, ',') AS evidence, count(*) AS n FROM x GROUP BY ALL")
def edge_kind_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = discover.cross_service(_linked(spark, sf_dir)[1])
    return rows.groupBy("kind", F.array_join("evidence", ",").alias("evidence")).agg(F.count("*").alias("n"))


@register(_with(views.V_SPANS, _LINK) + "SELECT protocol, operation, route, topic, kind AS span_kind, id, count(*) AS n FROM x GROUP BY ALL")
def edge_identity_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.cross_service(_linked(spark, sf_dir)[1]).groupBy("identity.protocol", "identity.operation", "identity.route", "identity.topic", "identity.span_kind", "id").agg(F.count("*").alias("n"))


_CONFIDENCE = """, c AS (SELECT (SELECT count(*) FROM v) AS n_spans, (SELECT count(DISTINCT service) FROM l) AS n_services, (SELECT count(DISTINCT id) FROM x) AS n_edges, (SELECT count(DISTINCT id) FROM n) AS n_endpoints,
  (SELECT count(*) FROM x) AS n_linked, (SELECT count(DISTINCT nullif(trace_id, '')) FROM l) AS n_traces)
SELECT *, floor(least(1.0::DOUBLE, 0.35::DOUBLE + CASE WHEN n_services > 1 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN n_edges > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN n_endpoints > 0 THEN 0.15::DOUBLE ELSE 0 END
  + CASE WHEN n_spans > 0 AND n_linked > 0 THEN least(0.15::DOUBLE, n_linked::DOUBLE / n_spans::DOUBLE * 0.15::DOUBLE) ELSE 0 END) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS confidence FROM c"""


@register(_with(views.V_SPANS, _LINK) + _CONFIDENCE)
def discovery_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = _linked(spark, sf_dir)[1]
    one = discover.entity_counts(linked).crossJoin(views.spans(spark, sf_dir).agg(F.count("*").alias("n_spans")))  # one row each
    return one.select("n_spans", "n_services", "n_edges", "n_endpoints", "n_linked", "n_traces", discover.confidence(F.col("n_spans"), F.col("n_services"), F.col("n_edges"), F.col("n_endpoints"), F.col("n_linked")).alias("confidence"))


@register(_with(views.V_SPANS, _LINK) + """SELECT (SELECT coalesce(min(k), 0) FROM (SELECT count(*) AS k FROM l GROUP BY service)) AS service_support_min,
  (SELECT coalesce(min(k), 0) FROM (SELECT count(*) AS k FROM x GROUP BY id)) AS edge_support_min, (SELECT coalesce(min(k), 0) FROM (SELECT count(*) AS k FROM n GROUP BY id)) AS endpoint_support_min""")
def support_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared, linked = _linked(spark, sf_dir)
    return discover.support_minima(discover.services(prepared), discover.edges(linked), discover.endpoints(linked))


@register(_with(views.V_SPANS, """
d AS (SELECT * FROM v UNION ALL SELECT trace_id, span_id, parent_span_id, 'gateway', name, kind, start_ns, end_ns, a_method, a_route, a_system, a_topic, seq + 500 FROM v WHERE service = 'frontend' AND mod(seq, 7000) = 0),
i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, span_id ORDER BY seq DESC) AS rn FROM d) WHERE rn = 1)
SELECT p.service AS parent_service, d.service, count(*) AS pairs FROM d JOIN i p ON d.trace_id = p.trace_id AND d.parent_span_id = p.span_id AND d.parent_span_id <> '' GROUP BY ALL"""))
def duplicate_span_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = views.spans(spark, sf_dir)
    again = spans.where("service = 'frontend' and mod(seq, 7000) = 0").withColumn("service", F.lit("gateway")).withColumn("seq", F.col("seq") + 500)
    linked = discover.link_parents(discover.prepare(spans.unionByName(again)))
    return linked.where("parent is not null").groupBy(F.col("parent.service").alias("parent_service"), "service").agg(F.count("*").alias("pairs"))


@register("""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'get ' || url WHEN 1 THEN 'POST  ' || regexp_replace(url, '^https?://[^/]*', '') WHEN 2 THEN 'fetch ' || url ELSE 'GET' END AS name FROM pages),
p AS (SELECT *, regexp_split_to_array(trim(name), '\\s+') AS w FROM u)
SELECT page_id, name, CASE WHEN len(w) >= 2 AND upper(w[1]) IN ('GET', 'POST', 'PUT', 'PATCH', 'DELETE', 'HEAD', 'OPTIONS') THEN upper(w[1]) ELSE '' END AS method,
  CASE WHEN len(w) >= 2 AND upper(w[1]) IN ('GET', 'POST', 'PUT', 'PATCH', 'DELETE', 'HEAD', 'OPTIONS') THEN w[2] ELSE '' END AS path FROM p""")
def http_span_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    name = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("get "), url)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("POST  "), F.regexp_replace(url, "^https?://[^/]*", ""))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("fetch "), url)).otherwise("GET")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", name.alias("name")).select("page_id", "name", name_method(F.col("name")).alias("method"), name_path(F.col("name")).alias("path"))


@register("""SELECT page_id, CASE WHEN p = '' THEN '/' ELSE url_decode(p) END AS path, url_encode(url) AS escaped
FROM (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(url, '[?].*$', ''), '^https?://[^/]*', ''), '#.*$', '') AS p FROM pages)""")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", span_path(F.col("url")).alias("path"), query_escape(F.col("url")).alias("escaped"))


@register("""SELECT event_id, CASE WHEN mod(event_id, 3) = 0 THEN coalesce(nullif(trim(event_type), ''), 'none') WHEN mod(event_id, 3) = 1 THEN 'second' ELSE '' END AS attr FROM events""")
def first_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id") % 3
    attrs = F.create_map(F.lit("a"), F.when(e == 0, F.concat(F.lit(" "), "event_type", F.lit("\t"))).otherwise("  "), F.lit("b"), F.when(e == 1, "second").otherwise(""))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", attrs.alias("m")).select("event_id", first_nonblank(F.col("m")["a"], F.col("m")["b"], F.col("m")["c"]).alias("attr"))
