"""Edges, endpoints and their ids, derived from a span and its parent."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import first_filled, first_nonblank, name_method, name_path, query_escape, span_path, strip

#: The only attributes that discovery reads; they are taken out of the map before any shuffle.
ATTRIBUTES = (
    "http.request.method", "http.method", "http.route", "url.path", "http.target", "rpc.system", "rpc.method",
    "network.protocol.name", "messaging.system", "messaging.destination", "messaging.destination.name", "messaging.operation",
)
ASYNC_KEYS = ("messaging.system", "messaging.destination", "messaging.operation")
IDENTITY = ("protocol", "operation", "route", "topic", "span_kind")


def facts(kind: Column, name: Column, attributes: Column) -> Column:
    """What discovery needs of one span, as a small struct: half of what an edge is made of."""
    a = lambda *keys: first_nonblank(*[attributes[k] for k in keys])
    k = F.lower(strip(kind))
    method = F.upper(a("http.request.method", "http.method"))
    route = a("http.route", "url.path", "http.target")
    named, path = name_method(name), name_path(name)
    signals = [F.when(k.isin("producer", "consumer"), F.concat(F.lit("span.kind="), k)), *[F.when(F.coalesce(attributes[x], F.lit("")) != "", F.lit(x)) for x in ASYNC_KEYS]]
    return F.struct(
        F.concat_ws(",", *signals).alias("signals"),
        method.alias("method"), named.alias("named"), route.alias("route"), F.when(named != "", path).otherwise("").alias("named_path"),
        a("rpc.system", "network.protocol.name").alias("protocol"), a("rpc.method", "messaging.operation").alias("operation"),
        a("messaging.system").alias("system"), a("messaging.destination", "messaging.destination.name").alias("topic"),
        ((method != "") | (route != "") | ((named != "") & (path != ""))).alias("http"), k.alias("kind"),
    )


def edge_kind(parent: Column, child: Column) -> Column:
    return F.when((parent["signals"] != "") | (child["signals"] != ""), "async").otherwise("sync")


def edge_evidence(parent: Column, child: Column) -> Column:
    """Why the edge is of its kind, as a sorted set."""
    own = F.when(parent["signals"] != "", F.concat_ws(",", F.lit("parent_async_signal"), parent["signals"])).when(child["signals"] != "", F.concat_ws(",", F.lit("child_async_signal"), child["signals"]))
    return F.sort_array(F.split(F.coalesce(own, F.lit("default_sync")), ","))


def edge_identity(parent: Column, child: Column) -> Column:
    protocol = F.lower(first_filled(child["protocol"], F.when(child["http"] | F.coalesce(parent["http"], F.lit(False)), "http").otherwise(""), child["system"], parent["system"]))
    operation = first_filled(child["method"], child["named"], child["operation"], parent["operation"])
    route = first_filled(span_path(child["route"]), span_path(child["named_path"]), span_path(parent["route"]))
    return F.struct(protocol.alias("protocol"), operation.alias("operation"), route.alias("route"), first_filled(child["topic"], parent["topic"]).alias("topic"), child["kind"].alias("span_kind"))


def edge_id(source: Column, target: Column, kind: Column, blocking: Column, identity: Column | None = None) -> Column:
    """from|to|kind|blocking, then |name=value for each non-empty identity field in fixed order, values query-escaped."""
    parts = [source, target, kind, blocking.cast("string")]
    if identity is not None:
        parts += [F.when(F.coalesce(identity[f], F.lit("")) != "", F.concat(F.lit(f + "="), query_escape(identity[f]))) for f in IDENTITY]
    return F.concat_ws("|", *parts)


def endpoint_method(span: Column) -> Column:
    return first_filled(span["method"], span["named"])


def endpoint_path(span: Column) -> Column:
    return span_path(first_filled(span["route"], span["named_path"]))


def endpoint_id(service: Column, method: Column, path: Column) -> Column:
    return F.concat(service, F.lit(":"), method, F.lit(" "), path)
