from collections import defaultdict

from pyspark.sql import functions as F

from spanweave.plans import window_queries
from spanweave.plans.window_queries import DAY

SF = "/root/testdata/sf0.001"


def test_every_kept_arrival_reaches_the_fold(spark):
    """Against a plain loop over the events: each pair of a user's successive events of two types, and each user's events."""
    steps, rows = window_queries._world(spark, SF)
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), "user_id", "event_type").orderBy("event_id").collect()
    starts = [s for s, _, _ in steps]
    want, before, kept = defaultdict(int), {}, 0
    for e in events:
        w = max(s for s in starts if s <= e.s)
        if e.s - (7200 if e.event_id % 10 == 0 else 0) < w:
            continue
        kept += 1
        was = before.get((w, e.user_id))
        if was is not None and was != e.event_type:
            want[w, "edge", f"{was}|{e.event_type}"] += 1
        before[w, e.user_id] = e.event_type
        want[w, "service", e.event_type] += 1
        want[w, "endpoint", f"u{e.user_id}"] += 1
    assert kept == sum(ingest[0] for _, _, ingest in steps) and all(end - start == DAY for start, end, _ in steps)
    assert {(r.window_start, r.kind, r.id): r.observations for r in rows.collect()} == want
