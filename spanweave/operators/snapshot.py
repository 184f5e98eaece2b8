"""Snapshots: differences between windows, ids, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def snapshot_id(start: Column, end: Column, version: Column) -> Column:
    """snap- and the first 24 hex digits of SHA-256(start|end|version)."""
    return F.concat(F.lit("snap-"), F.substring(F.sha2(F.concat_ws("|", start, end, version).cast("binary"), 256), 1, 24))


def record_text(df: DataFrame, skip: tuple[str, ...] = ("id",)) -> Column:
    """A record as comparable text: maps in sorted order, all else as JSON."""
    def text(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("map"):
            return F.to_json(F.array_sort(F.map_entries(c)))
        return F.to_json(F.struct(c.alias("v")))

    return F.concat_ws("\x1f", *[F.coalesce(text(n, t), F.lit("")) for n, t in df.dtypes if n not in skip])


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(added, removed, changed) between two tables of id and content."""
    b, a = before.select("id", F.col("content").alias("was")), after.select("id", F.col("content").alias("now"))
    return b.join(a, "id", "full_outer").agg(F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("now").isNull()).alias("removed"), F.count_if(F.col("was") != F.col("now")).alias("changed"))


def window_diffs(entities: DataFrame, size: int) -> DataFrame:
    """(window_start, added, removed, changed) of each window against the one before: entities is (window_start, id, content).

    One pass for all windows: an entity's row meets its own row of the window before by a window function over its id.
    """
    own = Window.partitionBy("id").orderBy("window_start")
    rows = entities.withColumns({"_before": F.lag("window_start").over(own), "_was": F.lag("content").over(own), "_next": F.lead("window_start").over(own)})
    here = rows.select("window_start", F.when(F.coalesce(F.col("_before") != F.col("window_start") - size, F.lit(True)), 1).otherwise(0).alias("added"), F.lit(0).alias("removed"), F.when((F.col("_before") == F.col("window_start") - size) & (F.col("_was") != F.col("content")), 1).otherwise(0).alias("changed"))
    last = entities.agg(F.max("window_start").alias("_last"))
    gone = rows.where(F.coalesce(F.col("_next") != F.col("window_start") + size, F.lit(True))).join(F.broadcast(last), F.col("window_start") < F.col("_last")).select((F.col("window_start") + size).alias("window_start"), F.lit(0).alias("added"), F.lit(1).alias("removed"), F.lit(0).alias("changed"))  # one row
    return here.unionByName(gone).groupBy("window_start").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("added", "removed", "changed")])


def envelope_violations(envelopes: DataFrame) -> DataFrame:
    """Rows of (snapshot_id, window_start, window_end, spans, dropped_spans, late_spans, counts struct, services, edges, endpoints) that break a rule."""
    checks = [("snapshot_id", F.coalesce(F.trim("snapshot_id"), F.lit("")) == ""), ("window_order", F.col("window_start") >= F.col("window_end")), ("ingest", F.least("spans", "dropped_spans", "late_spans") < 0)]
    checks += [(f"count_{k}", F.col(f"counts.{k}") != F.size(k)) for k in ("services", "edges", "endpoints")]
    bad = F.filter(F.array(*[F.when(F.coalesce(w, F.lit(True)), F.lit(n)) for n, w in checks]), lambda x: x.isNotNull())
    return envelopes.select("snapshot_id", F.explode(bad).alias("rule"))
