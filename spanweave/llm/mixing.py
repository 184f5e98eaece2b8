"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, materialize

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No source's target exceeds so many times its size.
MAX_REPEATS = 3
#: Names the random offset; any text gives another, equally valid sample.
SEED = "mix-1"
#: Rows that one task should rank at a time; sets how finely the hash ranges split a source.
ROWS_PER_RANGE = 20_000


def _hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): each source's share of the total by its weight, but at
    most max_repeats times its size, the excess reshared by weight until none is above.

    This is water-filling: with the sources sorted by cap / weight, those up to some place are at their cap and the
    rest share what is left by weight. One row per source, so the unpartitioned windows see no more than that.
    """
    total = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long")
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats).withColumn("total", F.sum("source_size").over(total))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
    level = left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    share = ranked.withColumn("level", level).withColumn("open", F.col("cap").cast("double") > F.col("level") * F.col("weight").cast("double"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(total)["level"]
    return share.select("source", "source_size", F.when(F.col("cap").cast("double") > final * F.col("weight").cast("double"), final * F.col("weight").cast("double")).otherwise(F.col("cap").cast("double")).alias("target"))


def systematic_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, carry: bool = False) -> DataFrame:
    """One row per input row: (doc_id, source, size, source_size, target, copies, taken); with carry, (_row, _copies), _row being the whole input row.

    Within a source every document is expected target / source_size times. The documents of a source are put in one
    fixed order (size class from large to small, then a hash of the id), the expected copies are summed up along it, a
    random offset of the source is added, and a document is emitted once for each integer that the sum crosses in it.
    Taking size classes one after the other makes the taken words come near the target as well as the taken documents.

    The prefix sum is rank * copies. Ranks are made without bringing a source together: rows are counted by (source,
    size class, hash range), the counts are summed up, and only the rows of one hash range are numbered in one task.
    A hash range has about ROWS_PER_RANGE rows however many rows a source has. The result does not depend on it.

    Null text has size 0; null is a source of its own and comes last; documents of size 0 take part in the ranks and take
    0 words. Null ids are ranked as empty text. Repeated rows are documents of their own. Empty table, empty result.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    bits = F.length(F.bin(F.col("_size")))
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    rows = (
        docs.select(*own, F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.alias("_size"))
        .withColumn("_class", bits * 16 + F.expr("shiftright(_size, cast(greatest(length(bin(_size)) - 4, 0) as int))"))
        .withColumn("_hash", _hash32(F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    )
    if not carry:
        rows = materialize(rows, "sizes")
    n = docs.count() if carry else rows.count()
    shift = 32 - max(0, (n // ROWS_PER_RANGE).bit_length())
    key = lambda c: F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c))
    rows = rows.withColumn("_key", key(F.col("_source"))).withColumn("_range", F.shiftright("_hash", shift))

    counts = materialize(rows.groupBy("_key", "_source", "_class", "_range").agg(F.count("*").alias("n"), F.sum("_size").alias("words")), "ranges")
    sizes = counts.groupBy("_source").agg(F.sum("words").alias("source_size")).withColumnRenamed("_source", "source")
    targets = source_targets(sizes, weights, max_repeats).withColumn("_key", key(F.col("source")))
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_key")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32)))
    targets = targets.select("_key", "source_size", "target", offset.alias("_offset"), F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)).alias("_each"))

    classes = counts.groupBy("_key", "_class").agg(F.sum("n").alias("n"))
    in_source = Window.partitionBy("_key").orderBy(F.desc("_class")).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("_key", "_class", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("_before"))
    in_class = Window.partitionBy("_key", "_class").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.select("_key", "_class", "_range", F.coalesce(F.sum("n").over(in_class), F.lit(0)).alias("_start"))
    starts = ranges.join(classes, ["_key", "_class"]).select("_key", "_class", "_range", (F.col("_start") + F.col("_before")).alias("_start")).join(targets, "_key")

    inner = Window.partitionBy("_key", "_class", "_range").orderBy("_hash", F.col("_id").asc_nulls_first(), "_size")
    ranked = rows.withColumn("_rank", F.row_number().over(inner)).join(starts, ["_key", "_class", "_range"]).withColumn("_rank", F.col("_rank") + F.col("_start"))
    crossed = F.floor(F.col("_rank") * F.col("_each") + F.col("_offset")) - F.floor((F.col("_rank") - 1) * F.col("_each") + F.col("_offset"))
    if carry:
        return ranked.select("_row", crossed.cast("long").alias("_copies"))
    return ranked.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", crossed.cast("long").alias("copies"), (crossed.cast("long") * F.col("_size")).alias("taken"))


def emit_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as systematic_mix takes it, with the columns of docs."""
    mixed = systematic_mix(docs, carry=True, **options).where(F.col("_copies") > 0)
    return mixed.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")).select("_row.*")
