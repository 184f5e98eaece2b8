"""What a live service tells its operators: the reconciliation report, its summary, projection views, metrics, and where they go."""

from __future__ import annotations

import posixpath
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .. import canon
from ..operators import reconcile

KINDS, LIFECYCLES = ("service", "edge", "endpoint"), ("candidate", "active", "stale", "retired")
# File names beside the latest snapshot.
FILES = {"state": "reconciliation-state.json", "report": "reconciliation-report.json", "summary": "reconciliation-summary.md", "raw_window": "latest-raw-window.json", "stable_core": "latest-stable-core.json", "signal_quality": "latest-signal-quality.json"}
#: Transitions that a summary lists at most.
SHOWN = 20
# Upper bounds of the histogram's buckets, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)


def output_paths(latest: str = "", folder: str = "", **given: str) -> dict[str, str]:
    """Where each file goes: as given, else beside the latest snapshot, else beside (or in) the snapshot folder, else in out/."""
    base = posixpath.dirname(latest.strip())
    if not base and folder.strip():
        clean = posixpath.normpath(folder.strip())
        base = posixpath.dirname(clean) if posixpath.basename(clean) == "snapshots" and posixpath.dirname(clean) else clean
    base = base if base not in ("", ".") else "out"
    return {k: given.get(k, "").strip() or posixpath.join(base, name) for k, name in FILES.items()}


def diff(before: DataFrame, now: DataFrame) -> dict[str, int]:
    """Entities added, removed and changed (their ends) between two projections, by kind."""
    a, b = (df.select("kind", "id", F.struct("source", "target").alias(n)) for df, n in ((before, "was"), (now, "own")))
    rows = a.join(b, ["kind", "id"], "full_outer").groupBy("kind").agg(F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("own").isNull()).alias("removed"), F.count_if(F.col("was") != F.col("own")).alias("changed"))
    got = {r["kind"]: r for r in rows.collect()}  # three rows
    return {f"{what}_{kind}s": got[kind][what] if kind in got else 0 for what in ("added", "removed", "changed") for kind in KINDS}


def counts(rows: DataFrame) -> dict[str, int]:
    got = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    return {f"{kind}s": got.get(kind, 0) for kind in KINDS}


def projection(name: str, before: DataFrame, now: DataFrame, version: int, changed: bool, digest: str) -> dict:
    return {"name": name, "counts": counts(now), "topology_version": digest, "version": version, "changed": changed, "diff": diff(before, now)}


_ENTITY = (
    "kind", "id", "lifecycle", "existence as existence_confidence", "activity as activity_confidence", "observed_windows", "opportunity_windows", "miss_streak", "last_seen as last_seen_window", "gap_ema", "strength as source_strength",
    "observed as observed_current_window", "opportunity as opportunity_current_window", "miss as qualified_miss", "soft as soft_threshold", "hard as hard_threshold", "reason",
)


def build(window: tuple[str, str], globals_: reconcile.Globals, health: reconcile.Health, stepped: DataFrame, projections: list[dict], compaction: dict, warnings: list[str], cfg: reconcile.Config) -> dict:
    """The report of one window as a document; it lists every remembered entity, as the state's file does, so it is made on the driver."""
    rows = stepped.withColumn("opportunity", F.col("opportunity") >= cfg.min_observations).selectExpr(*_ENTITY).orderBy("kind", "id")
    moves = reconcile.transitions(stepped).orderBy("kind", "id")
    return canon.tidy({
        "format_version": 1, "window_start": window[0], "window_end": window[1],
        "versions": {"observation_version": globals_.version, "stable_core_version": globals_.stable_version, "guardrail_union_version": globals_.guardrail_version},
        "telemetry_health": {"score": health.score, "drop_ratio": health.drop_ratio, "late_ratio": health.late_ratio, "volume_ema": globals_.volume_ema, "volume_ratio": health.volume_ratio, "retirement_frozen": health.frozen, "reasons": list(health.reasons)},
        "transitions": [r.asDict() for r in moves.collect()], "projections": projections, "entities": [r.asDict() for r in rows.collect()], "compaction": compaction, "load_warnings": warnings,
    })


def lifecycles(report: dict) -> dict[str, dict[str, int]]:
    out = {kind: dict.fromkeys(LIFECYCLES, 0) for kind in KINDS}
    for e in report.get("entities", []):
        out[e["kind"]][e["lifecycle"]] += 1
    return out


def attention(report: dict, limit: int = 10) -> list[dict]:
    """As reconcile.attention, of a report."""
    own = [e for e in report.get("entities", []) if e["lifecycle"] in ("stale", "retired") or e.get("qualified_miss")]
    return sorted(own, key=lambda e: (-reconcile.ATTENTION[e["lifecycle"]], -e["miss_streak"], e["kind"], e["id"]))[:limit]


def _cell(text: str) -> str:
    return text.strip().replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def _table(heads: list[str], rows: list[list], right: str = "") -> list[str]:
    """right: for each column, r or l."""
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return [line(heads), line(["---:" if c == "r" else "---" for c in right]), *map(line, rows)]


def summary(report: dict | None) -> str:
    """The report as Markdown."""
    if not report:
        return "# Runtime Reconciliation Summary\n\nNo window has closed yet.\n"
    v, h, c = report["versions"], report["telemetry_health"], report["compaction"]
    code = lambda x: f"`{str(x).lower() if isinstance(x, bool) else x}`"
    three = lambda x: f"`{x:.3f}`"
    out = ["# Runtime Reconciliation Summary", "", f"Window: `{report['window_start']}` to `{report['window_end']}`", ""]
    out += [f"Observation version: {code(v['observation_version'])}", f"Stable core version: {code(v['stable_core_version'])}", f"Guardrail union version: {code(v['guardrail_union_version'])}", "", "## Telemetry Health", ""]
    out += [f"- {name}: {three(h[key])}" for name, key in (("Score", "score"), ("Drop ratio", "drop_ratio"), ("Late ratio", "late_ratio"), ("Volume ratio", "volume_ratio"))]
    out += [f"- Retirement frozen: {code(h['retirement_frozen'])}", *([f"- Reasons: {'; '.join(h['reasons'])}"] if h.get("reasons") else []), "", "## Projections", ""]
    changes = lambda d: ", ".join(f"{short} +{d[f'added_{k}s']}/-{d[f'removed_{k}s']}/~{d[f'changed_{k}s']}" for short, k in (("svc", "service"), ("edge", "edge"), ("endpoint", "endpoint")))
    out += _table(["View", "Version", "Changed", "Services", "Edges", "Endpoints", "Diff"], [[code(p["name"]), code(p["version"]), code(p["changed"]), *[p["counts"][f"{k}s"] for k in KINDS], changes(p["diff"])] for p in report["projections"]], "lrlrrrl")
    out += ["", "## Entity Lifecycle", "", *_table(["Kind", "Candidate", "Active", "Stale", "Retired"], [[code(k), *n.values()] for k, n in lifecycles(report).items()], "lrrrr"), "", "## Attention", ""]
    own = attention(report)
    rows = [[code(e["kind"]), code(e["id"]), code(e["lifecycle"]), e["miss_streak"], f"{e['existence_confidence']:.3f}", f"{e['activity_confidence']:.3f}", _cell(e.get("reason", ""))] for e in own]
    out += _table(["Kind", "ID", "Lifecycle", "Miss streak", "Existence", "Activity", "Reason"], rows, "lllrrrl") if own else ["No stale, retired, or qualified-miss entities in this window."]
    moves = report.get("transitions", [])
    out += ["", "## Transitions", "", *(_table(["Kind", "ID", "From", "To", "Reason"], [[code(t["kind"]), code(t["id"]), code(t["from"]), code(t["to"]), _cell(t["reason"])] for t in moves[:SHOWN]], "lllll") if moves else ["No lifecycle transitions in this window."])]
    out += ["", "## Compaction", "", *[f"- {name}: {code(c[key])}" for name, key in (("Performed", "performed"), ("Expired retired", "expired_retired"), ("Trimmed per kind", "trimmed_per_kind"), ("Trimmed overall", "trimmed_overall"))], ""]
    if report.get("load_warnings"):
        out += ["## Load Warnings", "", *[f"- {w}" for w in report["load_warnings"]], ""]
    return "\n".join(out) + "\n"


def view(name: str, observation: int, version: int, rows: DataFrame | None, digest: str = "") -> dict:
    """A projection's view; without rows it says that there is none yet."""
    out = {"name": name, "observation": observation, "structural_version": version, "available": rows is not None}
    if rows is not None:
        got = [r.asDict() for r in rows.select("kind", "id", "source", "target").orderBy("kind", "id").collect()]
        of = lambda kind: [e for e in got if e["kind"] == kind]
        model = {"services": [{"id": e["id"]} for e in of("service")], "edges": [{"id": e["id"], "from": e["source"], "to": e["target"]} for e in of("edge")], "endpoints": [{"id": e["id"], "entry_service": e["source"]} for e in of("endpoint")]}
        out |= {"topology_version": digest, "snapshot": {"counts": {k: len(v) for k, v in model.items()}, "topology_version": digest, "model": model}}
    return out


def write(path: str, document: dict | str) -> None:
    """Whole or not at all; an empty path is nowhere."""
    if path.strip():
        canon.write_atomic(path, document if isinstance(document, str) else canon.canonical(document))


class Metrics:
    """Counters, gauges and a histogram of a live service, in the text exposition format."""

    def __init__(self, clock: Callable[[], float] = time.time):
        self.clock = clock
        self.counters = dict.fromkeys(("spans_ingested_total", "spans_dropped_total", "snapshots_emitted_total", "reconciliation_transitions_total", "reconciliation_qualified_misses_total", "reconciliation_evictions_total"), 0)
        self.gauges: dict[tuple[str, str], float] = {(f"current_{k}s", ""): 0 for k in KINDS} | {(name, ""): 0 for name in ("window_lag_seconds", "last_snapshot_unixtime", "snapshot_age_seconds", "reconciliation_telemetry_health")}
        self.gauges |= {(f"diff_{what}_{k}s", ""): 0 for what in ("added", "removed", "changed") for k in KINDS}
        self.buckets, self.total, self.built = [0] * len(BUCKETS), 0.0, 0

    def window(self, end: float, spans: int, dropped: int) -> None:
        self.counters["spans_ingested_total"] += spans
        self.counters["spans_dropped_total"] += dropped
        self.gauges["window_lag_seconds", ""] = max(0.0, self.clock() - end)

    def snapshot(self, envelope: dict, seconds: float, emitted: float) -> None:
        self.counters["snapshots_emitted_total"] += 1
        self.buckets = [n + (seconds <= b) for n, b in zip(self.buckets, BUCKETS)]
        self.total, self.built = self.total + seconds, self.built + 1
        self.gauges |= {(f"current_{k}", ""): n for k, n in envelope["counts"].items()} | {(f"diff_{k}", ""): n for k, n in envelope["diff"].items()}
        self.gauges |= {("last_snapshot_unixtime", ""): int(emitted), ("snapshot_age_seconds", ""): self.clock() - emitted}

    def reconciliation(self, report: dict) -> None:
        v, c = report["versions"], report["compaction"]
        self.gauges["reconciliation_telemetry_health", ""] = report["telemetry_health"]["score"]
        self.gauges |= {("reconciliation_projection_version", f'{{projection="{k}"}}'): v[f"{k}_version"] for k in ("stable_core", "guardrail_union", "observation")}
        self.gauges |= {("reconciliation_entities", f'{{kind="{k}",state="{s}"}}'): n for k, own in lifecycles(report).items() for s, n in own.items()}
        self.counters["reconciliation_transitions_total"] += len(report.get("transitions", []))
        self.counters["reconciliation_qualified_misses_total"] += sum(bool(e.get("qualified_miss")) for e in report.get("entities", []))
        self.counters["reconciliation_evictions_total"] += c["expired_retired"] + c["trimmed_per_kind"] + c["trimmed_overall"]

    def text(self) -> str:
        lines = [x for name, n in sorted(self.counters.items()) for x in (f"# TYPE {name} counter", f"{name} {n}")]
        for name in sorted({name for name, _ in self.gauges}):
            lines += [f"# TYPE {name} gauge", *[f"{name}{labels} {value}" for (own, labels), value in sorted(self.gauges.items()) if own == name]]
        lines += ["# TYPE snapshot_build_duration_seconds histogram", *[f'snapshot_build_duration_seconds_bucket{{le="{b}"}} {n}' for b, n in zip(BUCKETS, self.buckets)], f'snapshot_build_duration_seconds_bucket{{le="+Inf"}} {self.built}']
        return "\n".join([*lines, f"snapshot_build_duration_seconds_sum {self.total}", f"snapshot_build_duration_seconds_count {self.built}"]) + "\n"
