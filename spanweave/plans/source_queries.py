"""Registered queries of the sources: tables are written out as documents or payloads of a dialect and read back as spans."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import map_text, rfc3339, string_map
from ..sources import otlp, spans_json
from . import views
from .queries import register

_ATTRIBUTES = {"method": "http.request.method", "route": "http.route", "system": "messaging.system", "topic": "messaging.destination"}


def _shown(spans: DataFrame) -> DataFrame:
    return spans.select("trace_id", "span_id", "parent_span_id", "service", "name", "kind", "start_ns", "end_ns", *[F.coalesce(F.col("attributes")[k], F.lit("")).alias(n) for n, k in _ATTRIBUTES.items()])


_SHOWN = f"SELECT trace_id, span_id, parent_span_id, service, name, kind, start_ns, end_ns, a_method AS method, a_route AS route, a_system AS system, a_topic AS topic FROM ({views.duck_sql(views.V_SPANS)})"


def _nanos(ns: Column) -> Column:
    """RFC 3339 with nine decimals."""
    return F.concat(F.date_format(F.timestamp_seconds(F.floor(ns / 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((ns % 1_000_000_000).cast("string"), 9, "0"), F.lit("Z"))


@register(_SHOWN)
def spans_plain_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain document for each order; every other span uses the other names, text times and top-level attributes."""
    s = views.spans(spark, sf_dir)
    other = F.crc32(F.col("span_id").cast("binary")) % 2 == 1

    def either(value: Column, one: str, two: str) -> list[Column]:
        return [F.when(~other, value).alias(one), F.when(other, value).alias(two)]

    item = F.struct(
        *either(F.col("trace_id"), "trace_id", "traceId"), *either(F.col("span_id"), "span_id", "spanId"), *either(F.col("parent_span_id"), "parent_span_id", "parentSpanId"), *either(F.col("service"), "service", "service.name"),
        F.concat(F.lit(" "), "name").alias("name"), F.upper("kind").alias("kind"), F.when(~other, F.col("start_ns").cast("string")).alias("start_time"), F.when(other, _nanos(F.col("start_ns"))).alias("startTime"), F.col("end_ns").alias("end_time"),
        F.when(~other, F.col("attributes")).alias("attributes"), *[F.when(other, F.col("attributes")[k]).alias(n) for k, n in (("http.request.method", "method"), ("http.route", "route"), ("messaging.system", "messaging.system"), ("messaging.destination", "topic"))],
    )
    files = s.groupBy(F.col("trace_id").alias("file")).agg(F.collect_list(item).alias("spans")).select("file", F.to_json(F.struct("spans")).alias("value"))
    return _shown(spans_json.parse_spans(files))


@register(_SHOWN)
def spans_otlp_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An OTLP JSON document for each order, with a resource for each service; kinds as numbers or enum names, longs as text."""
    s = views.spans(spark, sf_dir)
    number = F.element_at(F.create_map(*[F.lit(x) for n, k in otlp.KINDS.items() for x in (k, str(n))]), F.col("kind"))
    kind = F.when(F.crc32(F.col("span_id").cast("binary")) % 2 == 0, number).otherwise(F.concat(F.lit("SPAN_KIND_"), F.upper("kind")))
    text = lambda key, value: F.struct(key.alias("key"), F.struct(value.alias("stringValue")).alias("value"))
    item = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name", kind.alias("kind"), F.col("start_ns").cast("string").alias("startTimeUnixNano"), F.col("end_ns").cast("string").alias("endTimeUnixNano"),
        F.transform(F.map_entries("attributes"), lambda e: text(e["key"], e["value"])).alias("attributes"),
    )
    scopes = s.groupBy("trace_id", "service").agg(F.array(F.struct(F.collect_list(item).alias("spans"))).alias("scopeSpans"))
    resource = F.struct(F.array(text(F.lit("service.name"), F.col("service"))).alias("attributes")).alias("resource")
    files = scopes.groupBy(F.col("trace_id").alias("file")).agg(F.collect_list(F.struct(resource, "scopeSpans")).alias("resourceSpans")).select("file", F.to_json(F.struct("resourceSpans")).alias("value"))
    return _shown(spans_json.parse_spans(files))


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns to requests: protobuf, protobuf in gzip, JSON and JSON in gzip by conversation; some are cut off."""
    from google.protobuf import json_format

    for batch in batches:
        out = []
        for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            request, n = otlp.request_class()(), len(text or "")
            resource = request.resource_spans.add()
            resource.resource.attributes.add(key="service.name").value.string_value = role or ""
            span = resource.scope_spans.add().spans.add(trace_id=f"c{conv}".encode(), span_id=f"c{conv}-{turn}".encode(), name="say", kind=turn % 6, start_time_unix_nano=1 + turn * 10**9, end_time_unix_nano=1 + turn * 10**9 + n)
            value = lambda key: span.attributes.add(key=key).value
            value("long").int_value = n
            value("half").double_value = n / 2
            value("loud").bool_value = n > 100
            value("raw").bytes_value = (role or "").encode()
            value("list").array_value.values.add().string_value = "a"
            span.attributes[-1].value.array_value.values.add().int_value = turn
            value("map").kvlist_value.values.add(key="turn").value.int_value = turn
            json = conv % 4 >= 2
            body = json_format.MessageToJson(request).encode() if json else request.SerializeToString()
            if conv % 10 == 0:
                body = body[: len(body) // 2] if json else body + b"\x0a\xff"
            out.append((gzip.compress(body) if conv % 2 else body, conv * 1000 + turn, "application/json; charset=utf-8" if json else "application/x-protobuf"))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.binary(), pa.int64(), pa.string()))], names=["content", "seq", "content_type"])


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("int"), "role", "text")
    return turns.mapInArrow(_bodies, "content binary, seq long, content_type string")


@register("""SELECT lower(hex('c' || conv_id)) AS trace_id, lower(hex('c' || conv_id || '-' || turn)) AS span_id, coalesce(role, '') AS service, ['internal', 'internal', 'server', 'client', 'producer', 'consumer'][CAST(turn % 6 AS INTEGER) + 1] AS kind,
1 + turn * 1000000000 AS start_ns, 1 + turn * 1000000000 + n AS end_ns, CAST(n AS VARCHAR) AS long, CASE WHEN n % 2 = 0 THEN CAST(n // 2 AS VARCHAR) ELSE (n // 2) || '.5' END AS half, CAST(n > 100 AS VARCHAR) AS loud, lower(hex(coalesce(role, ''))) AS raw,
'[a ' || turn || ']' AS list, 'map[turn:' || turn || ']' AS map FROM (SELECT *, length(coalesce(text, '')) AS n FROM conversations) WHERE conv_id % 10 <> 0""")
def spans_otlp_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = otlp.read_payloads(_payloads(spark, sf_dir))
    return rows.select("trace_id", "span_id", "service", "kind", "start_ns", "end_ns", *[F.col("attributes")[k].alias(k) for k in ("long", "half", "loud", "raw", "list", "map")])


@register("SELECT conv_id * 1000 + turn AS seq FROM conversations WHERE conv_id % 10 = 0")
def rejected_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return otlp.rejected_payloads(_payloads(spark, sf_dir)).select("seq")


@register("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN s * 1000000000 + event_id WHEN 1 THEN s * 1000000000 WHEN 2 THEN s * 1000000000 + 120000000 WHEN 3 THEN s * 1000000000 - 7200000000000 + 5 END AS ns FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)""")
def time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nanoseconds as a number, RFC 3339 without and with decimals and with an offset; other text and 0 are absent."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    base = F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 6
    text = F.when(k == 0, (F.col("s") * 1_000_000_000 + F.col("event_id")).cast("string")).when(k == 1, F.concat(F.lit(" "), base, F.lit("Z"))).when(k == 2, F.concat(base, F.lit(".12Z"))).when(k == 3, F.concat(base, F.lit(".000000005+02:00"))).when(k == 4, F.concat(base, F.lit(" noon"))).otherwise("0")
    return e.select("event_id", text.alias("t")).select("event_id", spans_json.time_ns(F.col("t")).alias("ns"))


_KIND_TEXTS = ("1", "2", " 3 ", "4", "5", "0", "17", "SPAN_KIND_SERVER", "Client", "weird", "", "unspecified")
_KIND_WANT = ("internal", "server", "client", "producer", "consumer", "internal", "internal", "server", "client", "weird", "internal", "internal")


@register(f"SELECT event_id, {list(_KIND_WANT)}[CAST(event_id % {len(_KIND_WANT)} AS INTEGER) + 1] AS kind FROM events")
def span_kind_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.element_at(F.array(*map(F.lit, _KIND_TEXTS)), (F.col("event_id") % len(_KIND_TEXTS) + 1).cast("int"))
    return e.select("event_id", text.alias("t")).select("event_id", spans_json.span_kind(F.col("t")).alias("kind"))


@register("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'k=' || event_id WHEN 1 THEN 'k=last' WHEN 2 THEN 'k=3|z=' || event_type ELSE 'k=deep' END AS attributes FROM events""")
def otlp_attribute_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of typed values, repeated keys, plain objects and values wrapped three deep, as maps."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.format_string('[{"key":" k ","value":{"intValue":"%d"}},{"key":"","value":{"stringValue":"x"}}]', "event_id")).when(
        k == 1, '[{"key":"k","value":{"stringValue":"first"}},{"key":"k","value":{"stringValue":"last"}}]').when(k == 2, F.format_string('{"k":3,"z":"%s"}', "event_type")).otherwise('[{"key":"k","value":{"value":{"value":{"stringValue":"deep"}}}}]')
    return e.select("event_id", text.alias("t")).select("event_id", map_text(spans_json.otlp_attributes(F.col("t"))).alias("attributes"))


@register("SELECT event_id, strftime(to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def rfc3339_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", rfc3339(F.col("ts").cast("timestamp")).alias("at"))


@register("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE string_agg(k || '=' || v, '|' ORDER BY k || '=' || v) END AS labels FROM (SELECT p_partkey, 'size' AS k, trim(CAST(p_size AS VARCHAR)) AS v FROM part UNION ALL SELECT p_partkey, trim(p_brand), trim(p_type) FROM part) GROUP BY p_partkey")
def string_map_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    none = F.map_from_arrays(F.array(F.lit("  ")), F.array(F.lit("x")))
    some = F.map_from_arrays(F.array(F.lit(" size"), F.concat("p_brand", F.lit("\t")), F.lit("")), F.array(F.concat("p_size", F.lit(" ")), F.concat(F.lit(" "), "p_type"), F.lit("x")))
    return p.select("p_partkey", map_text(string_map(F.when(F.col("p_partkey") % 3 == 0, none).otherwise(some))).alias("labels"))
