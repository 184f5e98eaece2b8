"""Span views over the supplied tables, for the registered queries: each as Spark SQL and as DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Orders as frontend server spans, their lines as child spans of five warehouses. {epoch}(x) is a timestamp in epoch seconds; attributes are
#: columns, which spans() packs into the map.
V_SPANS = """
SELECT 't' || o_orderkey AS trace_id, 'o' || o_orderkey AS span_id, '' AS parent_span_id, 'frontend' AS service, 'order' AS name, 'server' AS kind,
       {epoch}(o_orderdate) * 1000000000 AS start_ns, {epoch}(o_orderdate) * 1000000000 + mod(o_orderkey, 97) * 1000000 AS end_ns,
       'POST' AS a_method, '/orders/' || lower(split_part(o_orderpriority, '-', 1)) AS a_route, '' AS a_system, '' AS a_topic, o_orderkey * 1000 AS seq
FROM orders
UNION ALL
SELECT 't' || l_orderkey, 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || k, 'o' || l_orderkey, 'warehouse-' || mod(l_suppkey, 5),
       CASE WHEN l_returnflag = 'A' THEN 'PUT /stock/' || mod(l_partkey, 3) || '?x=1' ELSE 'pick' END,
       CASE l_returnflag WHEN 'A' THEN 'server' WHEN 'R' THEN 'consumer' ELSE 'client' END,
       {epoch}(l_shipdate) * 1000000000, {epoch}(l_shipdate) * 1000000000 + CAST(l_quantity AS BIGINT) * 1000000 + l_linenumber * 1000,
       '', '', CASE WHEN l_returnflag = 'R' THEN 'kafka' ELSE '' END, CASE WHEN l_returnflag = 'R' THEN 'returns' ELSE '' END, l_orderkey * 1000 + l_linenumber
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_quantity, l_extendedprice, l_shipdate) AS k FROM lineitem) AS l
"""

#: Turns of conversations: the turn before is the parent, the role the service.
V_CONV = """
SELECT 'c' || conv_id AS trace_id, 'c' || conv_id || '-' || turn AS span_id, CASE WHEN turn > 0 THEN 'c' || conv_id || '-' || (turn - 1) ELSE '' END AS parent_span_id,
       coalesce(role, '') AS service, 'say' AS name, 'internal' AS kind, turn * 1000000000 AS start_ns, turn * 1000000000 + length(coalesce(text, '')) * 1000000 AS end_ns,
       '' AS a_method, '' AS a_route, '' AS a_system, '' AS a_topic, conv_id * 1000 + turn AS seq
FROM conversations
"""

#: Events as arrivals; one in ten happened two hours before it arrived.
V_ARRIVALS = """
SELECT event_id AS seq, {epoch}(ts) AS received_s, {epoch}(ts) - CASE WHEN mod(event_id, 10) = 0 THEN 7200 ELSE 0 END AS event_s,
       'u' || mod(user_id, 50) AS trace_id, event_type AS service, 'http' AS source_type, 'c' || mod(event_id, 3) AS connector, value
FROM events
"""

#: The same with every user as a trace of their own.
V_USER_ARRIVALS = V_ARRIVALS.replace("mod(user_id, 50)", "user_id")


def register(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def spark_sql(view: str) -> str:
    return re.sub(r"\{epoch\}\((\w+)\)", r"unix_seconds(cast(\1 AS timestamp))", view)


def duck_sql(view: str) -> str:
    return re.sub(r"\{epoch\}\((\w+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", view)


def spans(spark: SparkSession, sf_dir: str, view: str = V_SPANS) -> DataFrame:
    """A span view in the canonical schema: attributes as a map."""
    register(spark, sf_dir, *(("orders", "lineitem") if view is V_SPANS else ("conversations",)))
    df = spark.sql(spark_sql(view))
    keys = (("http.request.method", "a_method"), ("http.route", "a_route"), ("messaging.system", "a_system"), ("messaging.destination", "a_topic"))
    made = F.map_filter(F.create_map(*[x for k, c in keys for x in (F.lit(k), F.col(c))]), lambda k, v: v != "")
    return df.select("trace_id", "span_id", "parent_span_id", "service", "name", "kind", "start_ns", "end_ns", made.alias("attributes"), "seq")
