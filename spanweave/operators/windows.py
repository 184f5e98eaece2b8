"""Arrival-time tumbling windows with a late policy and a capacity, and what they count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import seconds_between_epochs

#: Defaults of a service: window length in seconds, spans kept per window.
WINDOW_SECONDS, MAX_SPANS = 30, 10_000
POLICIES = ("drop", "current_window")


def window_start(received_s: Column, size: int = WINDOW_SECONDS) -> Column:
    """Start of the window of an arrival, in epoch seconds; windows are aligned to the start of year 1, not to the epoch."""
    shift = seconds_between_epochs() % size
    return F.floor((received_s + F.lit(shift)) / size).cast("bigint") * size - F.lit(shift)


def assign(spans: DataFrame, size: int = WINDOW_SECONDS, cap: int | None = MAX_SPANS, policy: str = "drop") -> DataFrame:
    """Spans (received_s, event_s, seq, ...) with window_start, late, kept.

    A span belongs to the window that it arrives in; it is late if it happened before that window began. Late spans go under
    policy `drop` and stay under `current_window`; of the others the first `cap` by arrival stay. Ranks are taken of survivors;
    the rank needs the window's arrivals in order, which a window of bounded capacity and length keeps small: rows are
    first cut to the cap within each of several ranges of seq, so that one flooded window is ranked in parts. Without a cap
    all that fit stay, and nothing is ranked.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown late policy {policy!r}")
    rows = spans.withColumn("window_start", window_start(F.col("received_s"), size)).withColumn("late", F.coalesce(F.col("event_s") < F.col("window_start"), F.lit(False)))
    fits = ~F.col("late") if policy == "drop" else F.lit(True)
    if cap is None:
        return rows.withColumn("kept", fits)
    rows = rows.withColumn("_fits", fits).withColumn("_part", F.floor(F.col("seq") / cap))
    counts = rows.where("_fits").groupBy("window_start", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("window_start").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("window_start", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("window_start", "_part", "_fits").orderBy("seq"))
    rows = rows.withColumn("_rank", rank).join(starts, ["window_start", "_part"], "left")
    return rows.withColumn("kept", F.col("_fits") & (F.col("_rank") + F.coalesce("_before", F.lit(0)) <= cap)).drop("_fits", "_part", "_rank", "_before")


def ingest_counts(assigned: DataFrame) -> DataFrame:
    """(window_start, spans, traces, dropped_spans, late_spans): kept spans, their distinct trace ids, and what was lost."""
    return assigned.groupBy("window_start").agg(
        F.count_if("kept").alias("spans"), F.count_distinct(F.when(F.col("kept"), F.nullif("trace_id", F.lit("")))).alias("traces"), F.count_if(~F.col("kept")).alias("dropped_spans"), F.count_if("late").alias("late_spans")
    )


def source_observations(assigned: DataFrame) -> DataFrame:
    """(window_start, type, connector, ref, observations): all arrivals count, those that are dropped later too."""
    ref = F.coalesce("source_ref", F.lit("")) if "source_ref" in assigned.columns else F.lit("")
    return assigned.groupBy("window_start", F.col("source_type").alias("type"), "connector", ref.alias("ref")).agg(F.count("*").alias("observations"))


def dense_windows(counts: DataFrame, size: int = WINDOW_SECONDS) -> DataFrame:
    """Every window from the first to the last, empty ones with zero counts, as reconciliation needs them."""
    ends = counts.agg(F.min("window_start").alias("a"), F.max("window_start").alias("b")).where("a is not null")
    every = ends.select(F.explode(F.sequence("a", "b", F.lit(size).cast("bigint"))).alias("window_start"))
    return every.join(counts, "window_start", "left").fillna(0)


def first_last_seen(entities: DataFrame, key: str = "id") -> DataFrame:
    """(window_start, key, first_ns, last_ns) with what earlier windows saw carried forward."""
    sofar = Window.partitionBy(key).orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    return entities.withColumns({"first_ns": F.min("first_ns").over(sofar), "last_ns": F.max("last_ns").over(sofar)})
