"""Exact deduplication with a heavy-hitter split; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import ascii_lower, broadcast_if_small, materialize

#: Most candidate heavy digests that the sketch returns, hence the bound on what is broadcast (one row of under 200 bytes each).
HEAVY_CANDIDATES = 1024
#: Counters of the frequent-items (Misra-Gries) sketch.
TRACKED = 16384
#: A candidate is a verified winner if it really has at least so many rows.
MIN_HEAVY = 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_candidates: int = HEAVY_CANDIDATES, tracked: int = TRACKED, min_heavy: int = MIN_HEAVY) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z; of each group the row with the largest id stays.
    1. Digests are written once. 2. approx_top_k, Spark's frequent-items sketch of the Misra-Gries family, names at
    most `heavy_candidates` digests. 3. Their exact counts and winners are computed with map-side combine; those with
    `min_heavy` rows or more are broadcast and mark their copies in the mappers, so no shuffle holds a hot group.
    4. The remaining digests take an ordinary shuffle.

    Null text counts as empty, null ids are smaller than any id; of repeated rows with equal text and id exactly one
    is kept (whichever the written digest table numbered last). An empty table gives an empty result.
    Other columns of docs are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256).alias("text_sha256"))
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "digests")

    best = F.max(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("d"), "rid", "doc_id")).alias("best")
    sketch = rows.agg(F.expr(f"approx_top_k(text_sha256, {int(heavy_candidates)}, {int(tracked)})").alias("top"))
    candidates = sketch.select(F.explode("top.item").alias("text_sha256"))
    winners = (
        rows.join(F.broadcast(candidates), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(best, F.count("*").alias("group_size"))
        .where(F.col("group_size") >= min_heavy)
    )
    winners = materialize(winners, "heavy")  # at most heavy_candidates rows

    def settle(df: DataFrame) -> DataFrame:
        return df.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256")

    heavy = settle(rows.join(F.broadcast(winners), "text_sha256"))
    light = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    group = Window.partitionBy("text_sha256")
    light = settle(light.withColumns({"best": F.max(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("d"), "rid", "doc_id")).over(group), "group_size": F.count("*").over(group)}))
    return heavy.unionByName(light)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops, all columns kept.

    A dropped row is found again by (id, digest); the dropped names alone meet the rows, so where they are few no text is
    shuffled, and otherwise once. Repeated rows with equal id and equal normalised text are one document: one of them stays.
    """
    rows = exact_dedup(docs, id_col, text_col).where("group_size > 1").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha"), "kept")
    kept = F.max(F.col("kept").cast("int")).alias("kept")
    gone = rows.groupBy("gone_id", "gone_sha").agg(kept, F.count("*").alias("n")).where("kept = 0 or n > 1")
    gone = materialize(gone, "dropped")
    digest = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), digest.alias("_sha"))
    named = F.col("_id").eqNullSafe(F.col("gone_id")) & (F.col("_sha") == F.col("gone_sha"))
    out = marked.join(broadcast_if_small(gone, 120), named, "left_anti").select("_row")
    again = gone.where("kept = 1")
    if not again.limit(1).count():
        return out.select("_row.*")
    once = marked.join(broadcast_if_small(again, 120), named, "left_semi").dropDuplicates(["_id", "_sha"]).select("_row")
    return out.unionByName(once).select("_row.*")
