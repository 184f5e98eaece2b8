import json
import uuid

import pytest
from pyspark.sql import functions as F

from spanweave.operators import reconcile, snapshot, windows
from spanweave.operators.reconcile import Config, Globals, telemetry_health
from spanweave.streaming import live, reports

SEEN = "kind string, id string, source string, target string, observations bigint, strength double"


def world(spark, service=8, endpoint=None, strength=0.35):
    rows = [("service", "s", None, None, service, 0.35)] + ([("endpoint", "e", "s", None, endpoint, strength)] if endpoint else [])
    return spark.createDataFrame(rows, SEEN)


def trace(spark, cfg, seen, ingest=(10, 0, 0)):
    """(lifecycle, existence, miss_streak, gap_ema, hard) of the endpoint after each window."""
    state, g, out = reconcile.empty_state(spark), Globals(), []
    for k, w in enumerate(seen):
        stepped, g, health = reconcile.step(state, w, ingest if k else (10, 0, 0), 60 * (k + 1), g, cfg)
        stepped = spark.createDataFrame(stepped.collect(), stepped.schema)
        state = reconcile.state_of(stepped)
        r = stepped.where("id = 'e'").first()
        out.append((r.lifecycle, r.existence, r.miss_streak, r.gap_ema, r.hard))
    return out, state, g, health


EASY = dict(stable_existence=0.5, retire_existence=0.45, soft_multiplier=1.0, hard_multiplier=1.0, soft_least=2, hard_least=3, soft_resistance=0.0, hard_resistance=0.0)


def test_qualified_misses(spark):
    out, state, *_ = trace(spark, Config(**EASY), [world(spark, endpoint=8)] + [world(spark)] * 3)
    assert [o[0] for o in out] == ["active", "active", "stale", "retired"]
    assert [o[1] for o in out] == [0.62, 0.62, 0.517, 0.375]
    assert state.where("id = 'e'").first().retired_at == 240


def test_no_opportunity_changes_nothing(spark):
    out, *_ = trace(spark, Config(stable_existence=0.5), [world(spark, endpoint=8), world(spark, service=1)])
    assert [o[0] for o in out] == ["active", "active"] and out[1][2] == 0


def test_bad_telemetry_freezes_retirement(spark):
    cfg = Config(**EASY | dict(soft_least=1, hard_least=2))
    out, *_, health = trace(spark, cfg, [world(spark, endpoint=8)] + [world(spark)] * 2, (6, 20, 20))
    assert [o[0] for o in out] == ["active", "stale", "stale"] and health.frozen


def test_rare_entities_get_time(spark):
    out, *_ = trace(spark, Config(stable_existence=0.5), [world(spark, endpoint=8)] + [world(spark)] * 4 + [world(spark, endpoint=8), world(spark)])
    assert out[5][3] == pytest.approx(2.4) and out[6][4] == 9 and out[6][0] != "retired"


def test_strong_sources_outlast(spark):
    cfg = Config(stable_existence=0.5, retire_existence=0.45, soft_multiplier=1.0, hard_multiplier=1.0, soft_least=2, hard_least=3)
    weak, *_ = trace(spark, cfg, [world(spark, endpoint=8)] + [world(spark)] * 4)
    strong, state, g, _ = trace(spark, cfg, [world(spark, endpoint=8, strength=1.0)] + [world(spark)] * 4)
    assert weak[-1][1] < strong[-1][1] and strong[-1][0] != "retired"
    assert {r.id for r in reconcile.guardrail_union(state, g.version, cfg).collect()} == {"s", "e"}


def test_edges_by_full_id(spark):
    seen = spark.createDataFrame([("service", "a", None, None, 5, 0.35), ("service", "b", None, None, 5, 0.35), ("edge", "a|b|sync|true|route=x", "a", "b", 5, 0.35)], SEEN)
    alone = spark.createDataFrame([("service", "a", None, None, 5, 0.35)], SEEN)
    stepped, g, _ = reconcile.step(reconcile.empty_state(spark), seen, (10, 0, 0), 60, Globals())
    state = spark.createDataFrame(reconcile.state_of(stepped).collect(), reconcile.STATE_COLUMNS)
    stepped, g, _ = reconcile.step(state, alone, (10, 0, 0), 120, g)
    got = {r.id: (r.observed, r.opportunity, r.miss) for r in stepped.collect()}
    assert got["a|b|sync|true|route=x"] == (False, 5, True) and got["b"] == (False, 5, True) and got["a"] == (True, 10, False)
    core = reconcile.closed(state.where("id <> 'b'"))
    assert [r.id for r in core.collect()] == ["a"]


def test_compaction(spark):
    rows = [("service", f"s{i}", None, None, "retired", 0.1, 0.0, 1, 1, 1, 1, 1, 1.0, 0.3, 1000 - i, 0, "") for i in range(6)]
    state = spark.createDataFrame(rows, reconcile.STATE_COLUMNS)
    cfg = Config(retired_ttl_s=3, retired_per_kind=2, compact_every=1)
    kept, g = reconcile.compact(state, 1000, Globals(version=1), cfg)
    assert sorted(r.id for r in kept.collect()) == ["s0", "s1"] and g.last_compaction == 1
    assert reconcile.compact(state, 1000, g, cfg)[0].count() == 6


def test_health_and_config():
    ema, h = telemetry_health(0.0, 100, 0, 0, Config())
    assert (ema, h.score, h.frozen) == (100.0, 1.0, False)
    ema, h = telemetry_health(100.0, 0, 50, 0, Config())
    assert ema == 70.0 and h.frozen and h.reasons == (reconcile.HEALTH["dropped"], reconcile.HEALTH["volume"], reconcile.HEALTH["frozen"])
    assert telemetry_health(0.0, 0, 0, 0, Config())[1].volume_ratio == 1.0
    assert reconcile.half_life_alpha(600, 30) == pytest.approx(0.0341, abs=1e-4) and reconcile.windows_of(10, 30) == 1
    with pytest.raises(ValueError):
        Config(stable_existence=1.5)


def test_alignment(spark):
    got = spark.createDataFrame([(1_704_067_207,), (0,)], "t bigint").select(windows.window_start(F.col("t"), 420).alias("a"), windows.window_start(F.col("t"), 30).alias("b")).collect()
    shift = windows.seconds_between_epochs()
    assert all((r.a + shift) % 420 == 0 and r.b % 30 == 0 for r in got)


def test_cap_and_late(spark):
    rows = [(i, 10, 10 if i % 4 else -5, f"t{i}", "s", "http", "c") for i in range(20)]
    df = spark.createDataFrame(rows, "seq bigint, received_s bigint, event_s bigint, trace_id string, service string, source_type string, connector string")
    drop = {r.seq: r.kept for r in windows.assign(df, 30, 7).collect()}
    assert [i for i in range(20) if drop[i]] == [1, 2, 3, 5, 6, 7, 9]
    keep = {r.seq: r.kept for r in windows.assign(df, 30, 7, "current_window").collect()}
    assert [i for i in range(20) if keep[i]] == list(range(7))
    assert windows.ingest_counts(windows.assign(df, 30, 7)).first().asDict() == {"window_start": 0, "spans": 7, "traces": 7, "dropped_spans": 13, "late_spans": 5}
    with pytest.raises(ValueError):
        windows.assign(df, 30, 7, "odd")
    assert windows.assign(df.limit(0)).count() == 0


def test_diffs(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, content string")
    after = spark.createDataFrame([("b", "2"), ("c", "1")], "id string, content string")
    assert tuple(snapshot.diff(before, after).first()) == (1, 1, 1)
    bad = spark.createDataFrame([("", 5, 5, 1, 0, 0, (1, 0, 0), [1], [], [])], "snapshot_id string, window_start int, window_end int, spans int, dropped_spans int, late_spans int, counts struct<services: int, edges: int, endpoints: int>, services array<int>, edges array<int>, endpoints array<int>")
    assert {r.rule for r in snapshot.envelope_violations(bad).collect()} == {"snapshot_id", "window_order"}


def test_live_is_replay_and_restarts(spark, tmp_path):
    rows = []
    for i in range(40):
        rows.append((f"t{i // 2}", f"s{i}", f"s{i - 1}" if i % 2 else "", "web" if i % 2 == 0 else "db", "GET /x", "server", i * 10**9, i * 10**9 + 10**6, {}, i, i, i, "otlp", "http"))
    df = spark.createDataFrame(rows, live.ARRIVALS)
    seen = {}
    mark = uuid.uuid4().hex
    files, metrics = reports.output_paths(latest=str(tmp_path / "out" / "latest.json")), reports.Metrics(clock=lambda: 50.0)
    sink = live.Reconciling(spark, name=f"state-{mark}", files=files, metrics=metrics)
    name = f"live-{mark}"
    def both(start, end, spans, counts):
        seen[start] = counts["spans"]
        sink(start, end, spans, counts)

    one = live.Live(spark, both, size=10, name=name)
    landing = tmp_path / "landing"
    df.where("seq < 25").coalesce(1).write.parquet(str(landing))
    one.start(str(landing)).awaitTermination(120)
    assert seen == {0: 10, 10: 10}
    df.where("seq >= 25").coalesce(1).write.mode("append").parquet(str(landing))
    two = live.Live(spark, both, size=10, name=name)  # as after a restart
    two.start(str(landing)).awaitTermination(120)
    two.close()
    assert seen == {0: 10, 10: 10, 20: 10, 30: 10} and sink.globals.version == 4
    again = live.Reconciling(spark, name=f"state-{mark}")
    assert again.globals.version == 4 and {r.id for r in again.state.collect()} >= {"web", "db"}
    assert (sink.globals.stable_version, sink.stable_changed) == (2, False)
    assert again.report() == sink.report() and "Observation version: `4`" in again.summary() and "| `service` | 0 | 2 | 0 | 0 |" in again.summary()
    assert json.loads(open(files["report"]).read())["versions"] == {"observation_version": 4, "stable_core_version": 2, "guardrail_union_version": 1}
    assert open(files["summary"]).read() == sink.summary()
    core = json.loads(open(files["stable_core"]).read())
    assert core["available"] and {x["id"] for x in core["snapshot"]["model"]["services"]} == {"web", "db"} and core["structural_version"] == 2
    text = metrics.text()
    assert 'reconciliation_entities{kind="service",state="active"} 2' in text and "spans_ingested_total 40" in text and "window_lag_seconds 10.0" in text


def test_snapshot_files(spark, tmp_path):

    schema = live.ARRIVALS
    row = lambda t, s, p, service, at: (t, s, p, service, "GET /x", "server", at * 10**9, at * 10**9 + 5, {}, at, at, at, "otlp", "http")
    one = spark.createDataFrame([row("t", "a", "", "web", 1), row("t", "b", "a", "db", 2)], schema)
    two = spark.createDataFrame([row("u", "a", "", "web", 11)], schema)
    sink = live.SnapshotSink(spark, str(tmp_path / "all"), str(tmp_path / "latest.json"))
    sink(0, 10, one, {"spans": 2, "traces": 1, "dropped_spans": 0, "late_spans": 0})
    sink(10, 20, two, {"spans": 1, "traces": 1, "dropped_spans": 0, "late_spans": 0})
    sink(20, 30, two.where("false"), {"spans": 0, "traces": 0, "dropped_spans": 0, "late_spans": 0})
    last = json.loads((tmp_path / "latest.json").read_text())
    assert last["diff"]["removed_services"] == 1 and last["discovery"]["services"][0]["first_seen"] == "1970-01-01T00:00:01Z" and last["discovery"]["services"][0]["last_seen"] == "1970-01-01T00:00:11Z"
    assert len(list((tmp_path / "all").glob("*-snap-*.json"))) == 4


def test_windows_between_and_late_landings(spark):
    row = lambda seq, at, event: (f"t{seq}", f"s{seq}", "", "web", "GET /x", "server", event * 10**9, event * 10**9, {}, seq, at, event, "otlp", "http")
    batch = lambda *rows: spark.createDataFrame(list(rows), live.ARRIVALS)
    got = []
    one = live.Live(spark, lambda start, end, spans, counts: got.append((start, counts["spans"], counts["dropped_spans"], counts["late_spans"])), size=10, name=f"live-{uuid.uuid4().hex}", dense=True)
    one.add(batch(row(1, 1, 1), row(2, 35, 35)), 0)
    assert got == [(0, 1, 0, 0), (10, 0, 0, 0), (20, 0, 0, 0)]
    one.add(batch(row(3, 5, 5)), 1)  # lands when its window is closed
    one.add(batch(row(3, 5, 5)), 1)  # and is run again
    one.close()
    assert got[3:] == [(30, 1, 1, 1)]


def test_output_paths():
    assert reports.output_paths(latest="a/b/latest.json")["report"] == "a/b/reconciliation-report.json"
    assert reports.output_paths(folder="x/snapshots/")["summary"] == "x/reconciliation-summary.md" and reports.output_paths(folder="x/y")["summary"] == "x/y/reconciliation-summary.md"
    assert reports.output_paths(summary="s.md")["summary"] == "s.md" and reports.output_paths()["stable_core"] == "out/latest-stable-core.json"


def test_summary_and_metrics():
    report = {
        "window_start": "a", "window_end": "b", "versions": {"observation_version": 2, "stable_core_version": 1, "guardrail_union_version": 1}, "telemetry_health": {"score": 1, "drop_ratio": 0, "late_ratio": 0, "volume_ratio": 1, "retirement_frozen": False},
        "projections": [], "compaction": {"performed": True, "expired_retired": 1, "trimmed_per_kind": 2, "trimmed_overall": 0}, "transitions": [{"kind": "edge", "id": "x|y", "from": "active", "to": "stale", "reason": "a|b"}],
        "entities": [{"kind": "edge", "id": i, "lifecycle": state, "miss_streak": n, "existence_confidence": 0.5, "activity_confidence": 0, "qualified_miss": n > 0, "reason": "r"} for i, state, n in (("a", "active", 9), ("b", "candidate", 1), ("c", "stale", 2), ("d", "retired", 1), ("e", "active", 0))],
    }
    assert [e["id"] for e in reports.attention(report)] == ["d", "c", "b", "a"]
    text = reports.summary(report)
    assert "- Performed: `true`" in text and "a\\|b" in text and "No window" in reports.summary(None)
    metrics = reports.Metrics(clock=lambda: 100.0)
    metrics.reconciliation(report)
    metrics.snapshot({"counts": {"services": 3, "edges": 1, "endpoints": 0}, "diff": {"added_services": 2}}, 0.2, 90.0)
    text = metrics.text()
    assert "reconciliation_evictions_total 3" in text and "reconciliation_qualified_misses_total 4" in text and 'snapshot_build_duration_seconds_bucket{le="0.25"} 1' in text and "snapshot_age_seconds 10.0" in text and "current_services 3" in text
    assert text.count("# TYPE") == 25
