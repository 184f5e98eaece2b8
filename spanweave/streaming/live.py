"""Live windows: a file-source stream whose batches feed the same functions as a replay."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import canon, session
from ..operators import discover, reconcile, windows
from ..operators.common import shared_dir
from ..schemas import SPANS
from . import reports

ARRIVALS = SPANS + ", received_s bigint, event_s bigint, source_type string, connector string"


class Live:
    """Arrivals are buffered as Parquet by window; a window closes once a later one has begun, and close() closes the rest.

    A batch is buffered once, also if it is run again after a failure. Closed windows are handled in order by
    `sink(window_start, window_end, kept spans, ingest counts)`, with `dense` the empty ones between them too, as
    reconciliation needs them. What is closed is kept beside the buffer, so a restart goes on where it stopped, and leaves
    the buffer. What lands when its window is closed counts as an arrival of the first open window, whose late policy it meets.
    """

    def __init__(self, spark: SparkSession, sink: Callable[[int, int, DataFrame, dict], None], size: int = windows.WINDOW_SECONDS, cap: int = windows.MAX_SPANS, policy: str = "drop", name: str = "live", dense: bool = False):
        self.spark, self.sink, self.size, self.cap, self.policy, self.dense = spark, sink, size, cap, policy, dense
        self.folder = f"{shared_dir(spark)}/{name}"
        self.done = self._done()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _done(self) -> int | None:
        files = self._files()
        if not files.exists(self._path("closed")):
            return None
        found = [int(s.getPath().getName()) for s in files.listStatus(self._path("closed"))]
        return max(found, default=None)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        start, marker = windows.window_start(F.col("received_s"), self.size), self._path(f"buffered/{batch_id}")
        if not self._files().exists(marker):
            rows = batch
            if self.done is not None:
                rows = rows.withColumn("received_s", F.greatest("received_s", F.lit(self.done + self.size).cast("bigint")))
            rows.withColumn("window", start).write.mode("overwrite").partitionBy("window").parquet(f"{self.folder}/buffer/batch={batch_id}")
            self._files().mkdirs(marker)
        newest = batch.agg(F.max(start)).first()[0]
        if newest is not None:
            self._close_before(newest)

    def close(self) -> None:
        self._close_before(None)

    def _close_before(self, newest: int | None) -> None:
        if not self._files().exists(self._path("buffer")):
            return
        rows = self.spark.read.schema(f"{ARRIVALS}, window bigint, batch bigint").parquet(f"{self.folder}/buffer")
        due = rows.where(F.lit(True) if newest is None else F.col("window") < newest).where(F.lit(True) if self.done is None else F.col("window") > self.done)
        starts = [r["window"] for r in due.select("window").distinct().orderBy("window").collect()]  # windows that have just ended
        if self.dense and starts:
            first = starts[0] if self.done is None else self.done + self.size
            starts = list(range(first, starts[-1] + 1 if newest is None else newest, self.size))
        for start in starts:
            assigned = windows.assign(due.where(F.col("window") == start), self.size, self.cap, self.policy).cache()
            try:
                counts = windows.ingest_counts(assigned).first()
                counts = counts.asDict() if counts else {"window_start": start, "spans": 0, "traces": 0, "dropped_spans": 0, "late_spans": 0}
                self.sink(start, start + self.size, assigned.where("kept"), counts)
            finally:
                assigned.unpersist()
            self._files().mkdirs(self._path(f"closed/{start}"))
            self.done = start
            for found in self._files().globStatus(self._path(f"buffer/batch=*/window={start}")):
                self._files().delete(found.getPath(), True)

    def start(self, landing: str, trigger: dict | None = None) -> StreamingQuery:
        """Arrivals from Parquet files that appear in a landing folder."""
        stream = self.spark.readStream.schema(ARRIVALS).parquet(landing)
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def entities(spans: DataFrame) -> DataFrame:
    """What a window shows of each entity, as reconcile.step reads it."""
    prepared = discover.prepare(spans)
    linked = discover.link_parents(prepared)
    none = F.lit(None).cast("string")
    s = discover.services(prepared).select(F.lit("service").alias("kind"), "id", none.alias("source"), none.alias("target"), "observations")
    e = discover.edges(linked).select(F.lit("edge").alias("kind"), "id", F.col("from").alias("source"), F.col("to").alias("target"), "observations")
    n = discover.endpoints(linked).select(F.lit("endpoint").alias("kind"), "id", F.col("entry_service").alias("source"), none.alias("target"), "observations")
    return s.unionByName(e).unionByName(n).withColumn("strength", F.lit(reconcile.TRACES))


class Reconciling:
    """A sink that folds windows into belief states and keeps the state as Parquet, one folder per version.

    Each window's report is kept beside its state, and written with its summary and the projections' views where `files`
    (reports.output_paths) says.
    """

    def __init__(self, spark: SparkSession, cfg: reconcile.Config = reconcile.Config(), name: str = "state", files: dict[str, str] | None = None, metrics: reports.Metrics | None = None):
        self.spark, self.cfg, self.folder = spark, cfg, f"{shared_dir(spark)}/{name}"
        self.files, self.metrics = files or {}, metrics
        self.globals, self.warnings = reconcile.Globals(), []
        self.last_report: dict | None = None
        self.state = self._load()

    def _load(self) -> DataFrame:
        """The last whole state; a missing one starts anew, an unreadable one too, with a warning."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return reconcile.empty_state(self.spark)
        try:
            last = max(int(s.getPath().getName().split("-")[1]) for s in files.listStatus(path) if s.getPath().getName().startswith("globals-"))
            self.globals = reconcile.Globals(**json.loads(self.spark.read.text(f"{self.folder}/globals-{last}").first()[0]))
            self.last_report = json.loads(self.spark.read.text(f"{self.folder}/report-{last}").first()[0])
            return self.spark.read.schema(reconcile.STATE_COLUMNS).parquet(f"{self.folder}/version-{last}")
        except Exception as e:
            self.globals, self.last_report = reconcile.Globals(), None
            self.warnings.append(f"state could not be read, starting anew: {str(e)[:200]}")
            return reconcile.empty_state(self.spark)

    def _keep(self, name: str, document: dict) -> None:
        self.spark.createDataFrame([(json.dumps(document),)], "value string").write.mode("overwrite").text(f"{self.folder}/{name}-{self.globals.version}")

    def __call__(self, start: int, end: int, spans: DataFrame, ingest: dict) -> None:
        counts = (ingest["spans"], ingest["dropped_spans"], ingest["late_spans"])
        seen, before, was = entities(spans), self.state, self.globals
        stepped, self.globals, health = reconcile.step(before, seen, counts, end, was, self.cfg)
        version = self.globals.version
        stepped.write.mode("overwrite").parquet(f"{self.folder}/stepped-{version}")
        stepped = self.spark.read.schema(stepped.schema).parquet(f"{self.folder}/stepped-{version}")
        whole = reconcile.state_of(stepped)
        dropped = reconcile.compaction(whole, end, self.globals, self.cfg)
        state, self.globals = reconcile.compact(whole, end, self.globals, self.cfg)
        state.write.mode("overwrite").parquet(f"{self.folder}/version-{version}")
        state = self.spark.read.schema(reconcile.STATE_COLUMNS).parquet(f"{self.folder}/version-{version}")
        raw = stepped.where("observed").select("kind", "id", "source", "target")
        earlier = self.spark.read.parquet(f"{self.folder}/stepped-{was.version}").where("observed") if was.version else raw.where("false")
        views = [("raw_window", earlier, raw, version, True, reconcile.fingerprint(raw))]
        for name, label, project in (("stable", "stable_core", lambda s, v: reconcile.stable_core(s, self.cfg)), ("guardrail", "guardrail_union", lambda s, v: reconcile.guardrail_union(s, v, self.cfg))):
            now, digest = project(state, version), reconcile.fingerprint(project(state, version))
            self.globals, changed = reconcile.bump(self.globals, name, digest)
            setattr(self, f"{name}_changed", changed)
            views.append((label, project(before, was.version), now, getattr(self.globals, f"{name}_version"), changed, digest))
        projections = [reports.projection(*v) for v in views]
        text = lambda t: datetime.fromtimestamp(t, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.last_report = reports.build((text(start), text(end)), self.globals, health, stepped, projections, dropped, self.warnings, self.cfg)
        self.warnings = []
        self._keep("report", self.last_report)
        self._keep("globals", asdict(self.globals))
        self.state = state
        reports.write(self.files.get("report", ""), self.last_report)
        reports.write(self.files.get("summary", ""), self.summary())
        for name, _, rows, own, _, digest in views:
            if self.files.get(name, ""):
                reports.write(self.files[name], reports.view(name, version, own, rows if own else None, digest))
        if self.metrics:
            self.metrics.window(end, ingest["spans"], ingest["dropped_spans"])
            self.metrics.reconciliation(self.last_report)

    def report(self) -> dict:
        """The report of the last window, also after a restart."""
        return {"available": self.last_report is not None, **(self.last_report or {})}

    def summary(self) -> str:
        """The report as Markdown."""
        return reports.summary(self.last_report)


class SnapshotSink:
    """A sink that writes each window's envelope as a file, the latest one beside it, and their quality sidecars.

    Windows without a service are left out; records carry what earlier windows saw, and differences are against the last one.
    """

    def __init__(self, spark: SparkSession, folder: str, latest: str, ref: str = "", patches=None, metrics: reports.Metrics | None = None):
        self.metrics = metrics
        self.spark, self.folder, self.latest, self.ref, self.patches = spark, folder, latest, ref or session.source_ref(listen="landing"), patches
        self.previous: dict | None = None

    def __call__(self, start: int, end: int, spans: DataFrame, ingest: dict) -> None:
        text = lambda t: datetime.fromtimestamp(t, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        began = time.time()
        try:
            result = session.discover_spans(self.spark, spans, self.ref, text(end), self.patches, "otlp", seen=True)
        except ValueError as e:
            logging.getLogger("spanweave").warning("window %s gives no snapshot: %s", text(start), e)
            return
        result.details = session.carry_seen(result.details, self.previous)
        counts = {k: v for k, v in ingest.items() if k != "window_start"}
        self.previous = session.snapshot(result, text(start), text(end), counts, self.previous)
        name = f"{datetime.fromtimestamp(end, timezone.utc):%Y%m%dT%H%M%SZ}-{canon.file_stamp(self.previous['snapshot_id'])}.json"
        for path in (f"{self.folder}/{name}", self.latest):
            canon.write_atomic(path, canon.canonical(self.previous))
            canon.write_atomic(canon.sidecar_path(path), canon.canonical(result.quality))
        if self.metrics:
            self.metrics.snapshot(self.previous, time.time() - began, end)
