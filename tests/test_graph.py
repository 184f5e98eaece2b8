import gzip
import json

import pytest
from pyspark.sql import functions as F

from spanweave import canon, session
from spanweave.functions import text
from spanweave.operators import discover, overlay, validate
from spanweave.sources import config, documents, otlp, spans_json

PLAIN = {
    "spans": [
        {"trace_id": "t1", "span_id": "a", "service": " web ", "kind": "SERVER", "name": "GET /cart", "start_time": "2024-01-01T00:00:00.000000001Z", "end_time": "2024-01-01T00:00:00.0305Z"},
        {"traceId": "t1", "spanId": "b", "parentSpanId": "a", "service.name": "cart", "kind": "server", "method": "post", "route": "items?x=1", "startTime": 1_000_000, "endTime": "71000000"},
        {"trace_id": "t1", "span_id": "c", "parent_span_id": "b", "service": "mail", "kind": "consumer", "topic": "orders", "attributes": {"messaging.system": "kafka", "n": 3}},
        {"trace_id": "t1", "span_id": "d", "parent_span_id": "b", "service": "cart", "kind": "internal", "name": "GET /inner"},
        {"trace_id": "t2", "span_id": "e", "parent_span_id": "nowhere", "service": "cart", "kind": "client", "name": "call"},
        {"trace_id": "t2", "span_id": "f", "service": "   "},
    ]
}
OTLP = {
    "resourceSpans": [
        {"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "web"}}, {"key": "n", "value": {"intValue": "7"}}]}, "scopeSpans": [{"spans": [
            {"traceId": "t", "spanId": "1", "name": "GET /x", "kind": 2, "startTimeUnixNano": "1000", "endTimeUnixNano": 2_000_000},
            {"traceId": "t", "spanId": "2", "parentSpanId": "1", "kind": "SPAN_KIND_PRODUCER", "attributes": [{"key": "service.name", "value": {"stringValue": "bus"}}, {"key": "messaging.system", "value": {"value": {"stringValue": "kafka"}}}, {"key": "messaging.system", "value": {"stringValue": "nats"}}]},
        ]}]},
        {"instrumentationLibrarySpans": [{"spans": [{"traceId": "t", "spanId": "3", "service": "old", "kind": "9"}]}]},
    ]
}


def files(spark, *docs):
    return spark.createDataFrame([(f"f{i}", json.dumps(d)) for i, d in enumerate(docs)], "file string, value string")


def test_text_rules(spark):
    rows = [("  a ", "a", "/a"), ("", "", ""), (None, "", ""), ("http://h.org/a%20b?x#y", "http://h.org/a%20b?x#y", "/a b"), ("https://h.org", "https://h.org", "/"), ("?q", "?q", "/"), ("/p?q", "/p?q", "/p")]
    got = spark.createDataFrame(rows, "s string, strip string, path string").select("strip", "path", text.strip(F.col("s")).alias("a"), text.span_path(F.col("s")).alias("b"))
    assert [(r.a, r.b) for r in got.collect()] == [(r[1], r[2]) for r in rows]
    one = spark.range(1).select(text.query_escape(F.lit("a b*~/")), text.map_text(text.string_map(F.create_map(F.lit(" k"), F.lit("1 "), F.lit("k"), F.lit("2"), F.lit(" "), F.lit("3")))), F.array_join(text.string_set(F.array(F.lit("b "), F.lit("a"), F.lit("b"), F.lit(" "))), ","), text.round3(F.lit(1.0005)))
    assert tuple(one.first()) == ("a+b%2A~%2F", "k=2", "a,b", 1.001)


def test_both_dialects(spark):
    spans = {r.span_id: r for r in spans_json.parse_spans(files(spark, PLAIN, OTLP, {"other": 1})).collect()}
    assert len(spans) == 9 and spans["a"].service == "web" and spans["a"].kind == "server"
    day = 1_704_067_200 * 10**9
    assert (spans["a"].start_ns, spans["a"].end_ns) == (day + 1, day + 30_500_000) and (spans["b"].start_ns, spans["b"].end_ns) == (1_000_000, 71_000_000)
    assert spans["b"].attributes == {"http.request.method": "post", "http.route": "items?x=1"} and spans["c"].attributes == {"messaging.destination": "orders", "messaging.system": "kafka", "n": "3"}
    assert spans["1"].service == "web" and spans["1"].kind == "server" and spans["2"].service == "bus" and spans["2"].kind == "producer"
    assert spans["2"].attributes == {"service.name": "bus", "n": "7", "messaging.system": "nats"} and spans["3"].service == "old" and spans["3"].kind == "internal"
    assert [r.file for r in spans_json.unreadable_files(files(spark, PLAIN, {"other": 1})).collect()] == ["f1"]


def test_order_of_many_files(spark):
    """More files than 64 bits have room for at 10**15 a file, of both dialects; a file of the other dialect comes between."""
    value = F.when(F.col("id") % 2 == 0, '{"spans": [{"name": "a"}, null, {"name": "b"}]}').otherwise('{"resourceSpans": [null, {"scopeSpans": [{"spans": [{"name": "a"}]}, {"spans": null}]}, {"resource": {}}, {"scopeSpans": [{"spans": [{"name": "b"}]}]}]}')
    docs = spark.range(10_000).select(F.format_string("f%05d", "id").alias("file"), F.concat(F.format_string('{"n": %d, ', "id"), F.substring(value, 2, 1000)).alias("value"))
    docs = docs.select("file", F.regexp_replace("value", '"name"', F.concat(F.lit('"service": "'), "file", F.lit('", "name"'))).alias("value"))
    got = spans_json.parse_spans(docs).select("service", "name", "seq").collect()
    assert len({r.seq for r in got}) == len(got) == 20_000 and min(r.seq for r in got) >= 0
    assert [(r.service, r.name) for r in sorted(got, key=lambda r: r.seq)] == [(f"f{i:05d}", n) for i in range(10_000) for n in "ab"]


def test_files_are_not_numbered_in_one_place(spark):
    """No broadcast that size does not allow, no task that sees all names; where seq is not read, no join at all."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spans = spans_json.parse_spans(files(spark, PLAIN, OTLP))
        plan = spans._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SinglePartition" not in plan and "SortMergeJoin" in plan
        assert "Join" not in spans.drop("seq")._jdf.queryExecution().executedPlan().toString()
        assert len(spans.collect()) == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_documents_are_parsed_in_one_pass(spark):
    """Both dialects come out of one pass: what makes the documents does not run once for each dialect."""
    plan = spans_json.parse_spans(files(spark, PLAIN, OTLP)).drop("seq")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and "Union" not in plan


def test_discovery(spark):
    result = session.discover_spans(spark, spans_json.parse_spans(files(spark, PLAIN)), "ref", "2024-01-01T00:00:00Z")
    m = json.loads(canon.canonical(result.model))
    assert [s["id"] for s in m["services"]] == ["cart", "mail", "web"]
    assert {e["id"] for e in m["edges"]} == {"web|cart|sync|true|protocol=http|operation=POST|route=%2Fitems|span_kind=server", "cart|mail|async|false|protocol=http|route=%2Fitems|topic=orders|span_kind=consumer"}
    assert next(e for e in m["edges"] if e["to"] == "cart")["observed"]["latency_ms"] == {"p50": 70, "p90": 70, "p95": 70, "p99": 70}
    assert {e["id"] for e in m["endpoints"]} == {"web:GET /cart", "cart:POST /items"}
    assert m["metadata"]["confidence"] == 0.9 and (result.span_count, result.trace_count) == (6, 2)
    evidence = next(e for e in result.details["edges"] if e["to"] == "mail")["support"]["evidence"]
    assert evidence == ["child_async_signal", "messaging.destination", "messaging.system", "span.kind=consumer"]
    assert result.coverage["edge_support_min"] == 1 and any("no topology_api" in w for w in result.quality["warnings"])
    envelope = session.snapshot(result)
    assert envelope["counts"] == {"services": 3, "edges": 2, "endpoints": 2} and envelope["diff"]["added_services"] == 3 and envelope["snapshot_id"].startswith("snap-")
    again = session.snapshot(result, previous=envelope)
    assert again["diff"]["added_services"] == again["diff"]["changed_edges"] == 0


def test_later_duplicate_is_the_parent(spark):
    docs = {"spans": [{"trace_id": "t", "span_id": "p", "service": "old"}, {"trace_id": "t", "span_id": "p", "service": "new"}, {"trace_id": "t", "span_id": "c", "parent_span_id": "p", "service": "x"}]}
    linked = discover.link_parents(discover.prepare(spans_json.parse_spans(files(spark, docs))))
    assert [r["from"] for r in discover.edges(linked).collect()] == ["new"]


def test_percentiles_are_nearest_rank(spark):
    spans = [{"trace_id": "t", "span_id": "p", "service": "a"}] + [{"trace_id": "t", "span_id": f"c{i}", "parent_span_id": "p", "service": "b", "start_time": 1, "end_time": 1 + i * 1_000_000} for i in range(1, 12)]
    e = discover.edges(discover.link_parents(discover.prepare(spans_json.parse_spans(files(spark, {"spans": spans}))))).first()
    assert (e.p50, e.p90, e.p95, e.p99) == (6, 10, 11, 11)


TOPOLOGY = {
    "source": {"type": "topology_api", "ref": "cat"},
    "services": [{"id": "a", "tags": ["x"], "placements": [{"replicas": 2, "labels": {"az": "1"}}, {"replicas": 1}]}, {"id": "b", "replicas": 3}],
    "edges": [{"from": "a", "to": "b", "kind": "sync", "resilience": {"retry": {"retry_on": ["5xx"], "max_attempts": 2}, "request_timeout_ms": 100}, "observed": {"latency_ms": {"p50": 1, "p99": 5}}}],
    "endpoints": [{"entry_service": "a", "method": "get", "path": "x", "semantics": {"predicate_mode": "immediate_response", "mandatory_targets": ["b"]}}],
}


def test_overlays(spark):
    graph = documents.topology(spark, TOPOLOGY)
    files_ = [
        ("one.yaml", {"services": [{"id": "a", "labels": {"k": "1", "l": "1"}, "tags": ["y"]}], "edges": [{"id": "a|b|sync|true", "identity": {"protocol": "HTTP"}, "resilience": {"retry": {"retry_on": ["timeout"], "backoff": {"initial_ms": 5}}}, "observed": {"latency_ms": {"p90": 3}}, "unknown": 1}]}),
        ("two.yaml", {"name": "second", "services": [{"id": "a", "labels": {"k": "2"}, "replicas": 9}], "endpoints": [{"entry_service": "a", "method": "GET", "path": "/x", "predicate_ref": "custom", "weight": 0.5}]}),
    ]
    merged, bad = overlay.apply(graph, documents.overlays(spark, files_, {"a": 4, "b": 5}))
    assert bad.count() == 0
    a = merged.services.where("id = 'a'").first()
    assert a.labels == {"k": "2", "l": "1"} and a.tags == ["x", "y"] and a.replicas == 9 and [p.connector for p in a.provenance] == ["topology_api", "replicas", "one", "second"]
    e = merged.edges.first()
    assert e.id == "a|b|sync|true" and e.identity.protocol == "http" and e.resilience.retry.retry_on == ["5xx", "timeout"] and e.resilience.retry.max_attempts == 2 and e.resilience.retry.backoff.initial_ms == 5 and e.resilience.request_timeout_ms == 100
    assert e.observed.latency_ms.asDict() == {"p50": 1, "p90": 3, "p95": None, "p99": 5}
    n = merged.endpoints.first()
    assert (n.id, n.predicate_ref, n.weight) == ("a:GET /x", "custom", 0.5)
    _, bad = overlay.apply(graph, documents.overlays(spark, [("x.yaml", {"services": [{"id": "zz"}], "edges": [{"id": "q|r|sync|true"}]})]))
    assert {(r.rule, r.entity_id) for r in bad.collect()} == {("overlay_unknown", "zz"), ("overlay_unknown", "q|r|sync|true")}


def test_topology_rules(spark):
    assert [p.replicas for p in documents.topology(spark, TOPOLOGY).services.where("id = 'a'").first().placements] == [1, 2]
    with pytest.raises(ValueError, match="unknown fields: typo"):
        documents.topology(spark, {"services": [{"id": "a", "typo": 1}]})
    with pytest.raises(ValueError):
        documents.topology(spark, {"services": []})
    with pytest.raises(ValueError):
        documents.replica_counts({"replicas": {"a": 0}})
    bad = {
        "services": [{"id": "a", "replicas": 0, "reliability": {"confidence": 2}}, {"id": "a", "placements": [{"replicas": 0}]}, {"id": " "}],
        "edges": [{"from": "a", "to": "gone", "kind": "odd", "weight": -1, "identity": {"topic": "x|y"}, "resilience": {"request_timeout_ms": -1}, "observed": {"error_rate": 2, "latency_ms": {"p50": 5, "p95": 4}}, "first_seen": "2024-02-01T00:00:00Z", "last_seen": "2024-01-01T00:00:00Z"}],
        "endpoints": [{"entry_service": "none", "method": "GET", "path": "/", "weight": -1, "semantics": {"predicate_mode": "odd", "dependency_modes": ["odd"], "mandatory_targets": ["gone"], "confidence": 7}, "first_seen": "yesterday"}],
    }
    rules = {(r.entity_kind, r.rule) for r in validate.violations(documents.topology(spark, bad)).collect()}
    assert rules >= {("service", x) for x in ("replicas", "reliability_required", "confidence_range", "unique_id", "placements", "id_required")}
    assert rules >= {("edge", x) for x in ("to_known", "kind", "weight", "identity_pipe", "resilience", "error_rate", "latency_order", "seen_order")}
    assert rules >= {("endpoint", x) for x in ("entry_known", "weight", "predicate_mode", "dependency_modes", "target_known", "confidence_range", "seen_format")}
    with pytest.raises(session.InvalidGraph):
        session.discover_topology(spark, documents.topology(spark, bad))


def test_catalog(spark):
    doc = documents.catalog_document({"source_ref": "c", "services": [{"id": "a", "team": "t", "tier": "1"}, {"id": "b"}], "dependencies": [{"from": "a", "to": "b", "mode": "Sync", "method": "get", "route": "x", "retry_max_attempts": 3, "circuit_breaker_enabled": False}], "endpoints": [{"service": "a", "method": "get", "path": "y"}]})
    g = documents.topology(spark, doc)
    e = g.edges.first()
    assert e.id == "a|b|sync|true|operation=GET|route=%2Fx" and e.resilience.circuit_breaker.enabled is False and e.policy_scope.method == "GET"
    assert g.services.where("id = 'a'").first().labels == {"team": "t", "tier": "1"} and g.endpoints.first().id == "a:GET /y"


def test_artifacts(spark, tmp_path):
    spans, out, snap = tmp_path / "in.json", tmp_path / "model.json", tmp_path / "snapshot.json"
    spans.write_text(json.dumps(PLAIN))
    session.discover(spark, str(spans), out=str(out), snapshot_out=str(snap), discovered_at="2024-01-01T00:00:00Z")
    assert session.validate(spark, str(out)) == "spanweave.model@1.3.0" and session.validate(spark, str(snap)) == "spanweave.snapshot@1.3.0"
    assert (tmp_path / "model.signal-quality.json").exists() and out.read_text().endswith("}\n")
    model = json.loads(out.read_text())
    for change in ({"services": []}, {"metadata": {**model["metadata"], "confidence": 3}}, {"metadata": {**model["metadata"], "schema": {"name": "x", "version": "1"}}}):
        out.write_text(json.dumps(model | change))
        with pytest.raises(ValueError):
            session.validate(spark, str(out))
    topo = tmp_path / "t.yaml"
    topo.write_text(json.dumps(TOPOLOGY))
    assert session.discover(spark, str(topo)).coverage["confidence"] == 1.0


def test_canonical_json():
    value = canon.tidy({"b": 2.0, "a": {"x": None, "y": ""}, "c": [1.5, "<&>"], "d": {}})
    assert canon.canonical(value) == '{\n  "b": 2,\n  "c": [\n    1.5,\n    "\\u003c\\u0026\\u003e"\n  ]\n}\n'
    assert canon.fingerprint({"services": [], "metadata": 1}) == canon.fingerprint({"services": [], "metadata": 2})


def test_protobuf_payloads(spark):
    cls = otlp.request_class()
    request = cls()
    r = request.resource_spans.add()
    r.resource.attributes.add(key="service.name").value.string_value = "web"
    s = r.scope_spans.add().spans.add(trace_id=b"\x01\xff", span_id=b"\x02", name="GET /", kind=2, start_time_unix_nano=5)
    s.attributes.add(key="n").value.int_value = 4
    s.attributes.add(key="list").value.array_value.values.add().bool_value = True
    body = request.SerializeToString()
    rows = spark.createDataFrame([(body, 1), (gzip.compress(body), 2), (b"\x0a\xff", 3), (None, 4)], "content binary, seq long")
    got = otlp.read_payloads(rows).collect()
    assert [r.seq for r in got] == [1_000_000, 2_000_000] and got[0].trace_id == "01ff" and got[0].kind == "server" and got[0].service == "web"
    assert got[0].attributes == {"service.name": "web", "n": "4", "list": "[true]"} and (got[0].start_ns, got[0].end_ns) == (5, None)
    assert [r.seq for r in otlp.rejected_payloads(rows).collect()] == [3]
    assert otlp.decode_request(body, zero_is_epoch=True)[0]["end_ns"] == 0
    with pytest.raises(ValueError):
        otlp.unpack(gzip.compress(b"0" * 100), 10)


def test_settings():
    c = config.serve_config({"window-size": "1m30s", "reconciliation": {"enabled": True, "half_life": "5m"}, "odd": 1}, flush_interval="150ms")
    assert (c.window_size, c.flush_interval, c.reconciliation_enabled, c.half_life) == (90, 0.15, True, 300)
    assert config.serve_config().reconciler().gap_alpha == pytest.approx(0.034, abs=1e-3) and config.serve_config().reconciler().compact_every == 5
    for bad in ({"late_span_policy": "x"}, {"window_size": "0s"}, {"window_size": "soon"}):
        with pytest.raises(ValueError):
            config.serve_config(bad)
    with pytest.raises(TypeError):
        config.serve_config(nope=1)


def test_json_payloads_and_rejects(spark):
    import base64
    import gzip
    import json

    from spanweave.sources import otlp

    span = {"traceId": base64.b64encode(b"\xaa\xbb").decode(), "spanId": base64.b64encode(b"\x01").decode(), "name": "GET /checkout", "kind": "SPAN_KIND_SERVER", "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1700000000050000000", "traceState": "x", "attributes": [{"key": "http.route", "value": {"stringValue": "/checkout"}}, {"key": "n", "value": {"doubleValue": 1234567.5}}]}
    body = json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "frontend"}}]}, "scopeSpans": [{"spans": [span]}]}]}).encode()
    rows = [(gzip.compress(body), 1, "application/json"), (body, 2, "application/JSON; charset=utf-8"), (body[:40], 3, "application/json"), (b"\x0a\xff", 4, "application/x-protobuf"), (None, 5, None)]
    df = spark.createDataFrame(rows, "content binary, seq long, content_type string")
    got = otlp.read_payloads(df).collect()
    assert [(r.trace_id, r.span_id, r.service, r.kind, r.end_ns - r.start_ns) for r in got] == [("aabb", "01", "frontend", "server", 50_000_000)] * 2
    assert got[0].attributes["http.route"] == "/checkout" and got[0].attributes["n"] == "1234567.5"
    assert sorted(r.seq for r in otlp.rejected_payloads(df).collect()) == [3, 4]
    assert [otlp.number_text(x) for x in (1.0, 0.25, 1e21, 1.5e-7, float("inf"))] == ["1", "0.25", "1e+21", "1.5e-07", "+Inf"]


def test_unreadable_trace_files_fail_the_load(spark, tmp_path):
    import json

    from spanweave import session

    (tmp_path / "a.json").write_text(json.dumps({"spans": [{"trace_id": "t", "span_id": "s", "service": "web", "name": "x"}]}))
    assert session.load_spans(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.JSON").write_text(json.dumps({"other": 1}))
    with pytest.raises(ValueError, match="b.JSON"):
        session.load_spans(spark, str(tmp_path))
    (tmp_path / "b.JSON").write_text(json.dumps({"spans": []}))
    (tmp_path / "a.json").unlink()
    with pytest.raises(ValueError, match="no spans"):
        session.load_spans(spark, str(tmp_path))
    with pytest.raises(ValueError, match="as traces: .*as topology: "):
        session.discover(spark, str(tmp_path / "b.JSON"))


def test_contracts_are_pinned():
    from spanweave import session

    model = session.lookup_contract("spanweave.model", "1.3.0")
    assert model["digest"].startswith("sha256:") and model["uri"] == "urn:spanweave:schema:model:v1.3.0"
    assert session._contract("spanweave.model", "1.3.0", session._SECTIONS | {"edges": session.EDGES + ", more int"})["digest"] != model["digest"]
    with pytest.raises(KeyError):
        session.lookup_contract("spanweave.model", "1.2.0")
