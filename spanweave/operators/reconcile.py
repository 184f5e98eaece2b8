"""Belief states of services, edges and endpoints, folded over windows: each step is one DataFrame plan."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import round3
from .common import materialize

# How much a source is believed.
BASE_STRENGTH, TRACES, TOPOLOGY, OVERLAY, OTHER = 0.2, 0.35, 0.95, 1.0, 0.5

# Which lifecycle wants attention first.
ATTENTION = {"retired": 4, "stale": 3, "candidate": 2, "active": 1}
# What is wrong with a window's telemetry, as reports say it.
HEALTH = {"dropped": "high dropped span ratio", "late": "high late span ratio", "volume": "ingest volume below recent baseline", "frozen": "retirement frozen"}
# Why an entity is where it is, as reports say it.
REASONS = {
    "observed": "observed in current window",
    "no_opportunity": "no qualified opportunity in current window",
    "retired": "retired after repeated qualified misses",
    "stale": "stale after repeated qualified misses",
    "stale_frozen": "stale after qualified misses; retirement frozen by telemetry health",
    "active": "retained as active",
    "candidate": "insufficient evidence to promote",
}


@dataclass(frozen=True)
class Config:
    stable_existence: float = 0.70
    stable_activity: float = 0.35
    guardrail_existence: float = 0.30
    retire_existence: float = 0.18
    min_observations: int = 2
    existence_boost: float = 0.42
    activity_boost: float = 0.55
    gap_alpha: float = 0.35
    passive_decay: float = 0.04
    miss_activity: float = 0.12
    miss_existence: float = 0.08
    miss_more: float = 0.05
    soft_multiplier: float = 1.5
    hard_multiplier: float = 3.0
    soft_least: int = 2
    hard_least: int = 5
    soft_resistance: float = 2.0
    hard_resistance: float = 4.0
    freeze_below: float = 0.55
    compact_every: int = 5
    retired_ttl_s: int = 86_400
    retired_per_kind: int = 200
    retired_overall: int = 500

    def __post_init__(self):
        for f in fields(self):
            if getattr(self, f.name) < 0:
                raise ValueError(f"{f.name} is negative")
        for name in ("stable_existence", "stable_activity", "guardrail_existence", "retire_existence", "gap_alpha", "freeze_below"):
            if getattr(self, name) > 1:
                raise ValueError(f"{name} is above 1")
        if self.compact_every < 1 or self.hard_least < self.soft_least:
            raise ValueError("compact_every is at least 1, hard_least at least soft_least")


def half_life_alpha(half_life_s: float, window_s: float) -> float:
    """Weight of the newest window so that an old one counts half after half_life_s."""
    return 1 - math.exp(-math.log(2) / (half_life_s / window_s))


def windows_of(interval_s: float, window_s: float) -> int:
    return max(1, int(interval_s / window_s + 0.5))


def clamp(c: Column) -> Column:
    """0 and 1 exactly at the bounds, three decimals between."""
    return F.when(c <= 0, 0.0).when(c >= 1, 1.0).otherwise(round3(c))


def source_strength(types: Column) -> Column:
    """The strongest of a record's source types; 0.2 without any."""
    each = F.transform(types, lambda t: F.when(t == "traces", TRACES).when(t == "topology_api", TOPOLOGY).when(t == "overlay", OVERLAY).otherwise(OTHER))
    return F.greatest(F.lit(BASE_STRENGTH), F.coalesce(F.array_max(each), F.lit(BASE_STRENGTH)))


def thresholds(gap: Column, strength: Column, cfg: Config) -> tuple[Column, Column]:
    """Missed windows from which an entity is stale, and from which it may retire."""
    half = lambda c: F.floor(c + 0.5)
    soft = F.greatest(F.ceil(gap * cfg.soft_multiplier), F.lit(cfg.soft_least)) + half(strength * cfg.soft_resistance)
    hard = F.greatest(F.ceil(gap * cfg.hard_multiplier), F.lit(cfg.hard_least)) + half(strength * cfg.hard_resistance)
    return soft.cast("bigint"), F.greatest(hard, soft).cast("bigint")


@dataclass(frozen=True)
class Globals:
    version: int = 0
    volume_ema: float = 0.0
    last_compaction: int = 0
    stable_version: int = 0
    guardrail_version: int = 0
    stable_hash: str = ""
    guardrail_hash: str = ""


@dataclass(frozen=True)
class Health:
    drop_ratio: float
    late_ratio: float
    volume_ratio: float
    score: float
    frozen: bool
    reasons: tuple[str, ...]


def telemetry_health(ema: float, spans: int, dropped: int, late: int, cfg: Config) -> tuple[float, Health]:
    """The new volume average and the health of one window's telemetry; retirement is frozen below a score."""
    total = max(1, spans + dropped)
    ema = float(spans) if ema == 0 else ema * 0.7 + spans * 0.3
    ratio = spans / ema if ema > 0 else 1.0
    score, reasons = 1 - 0.55 * (dropped / total) - 0.25 * (late / total), []
    if dropped / total > 0.15:
        reasons.append(HEALTH["dropped"])
    if late / total > 0.2:
        reasons.append(HEALTH["late"])
    if ema >= 2 * cfg.min_observations and ratio < 0.35:
        score -= 0.25 * (0.35 - ratio) / 0.35
        reasons.append(HEALTH["volume"])
    three = lambda x: 0.0 if x <= 0 else 1.0 if x >= 1 else math.floor(x * 1000 + 0.5) / 1000
    score = three(score)
    if score < cfg.freeze_below:
        reasons.append(HEALTH["frozen"])
    return ema, Health(three(dropped / total), three(late / total), three(ratio), score, score < cfg.freeze_below, tuple(reasons))


def opportunities(state: DataFrame, seen: DataFrame) -> DataFrame:
    """(kind, id, opportunity): observations in this window that could have shown each known entity.

    seen: kind, id, source (an edge's origin, an endpoint's service), target, observations. A service: its own, its endpoints', those of
    edges from and to it, and for each known edge the observations of the edge's origin. An edge: those of its origin. An
    endpoint: its own, else its service's. All are sums over equi-joins.
    """
    support = seen.where("kind = 'service'").select(F.col("id").alias("sid"), F.col("observations").alias("support"))
    direct = seen.where("kind = 'service'").select("id", "observations").unionByName(seen.where("kind = 'endpoint'").select(F.col("source").alias("id"), "observations"))
    direct = direct.unionByName(seen.where("kind = 'edge'").select(F.col("source").alias("id"), "observations")).unionByName(seen.where("kind = 'edge'").select(F.col("target").alias("id"), "observations"))
    known = state.where("kind = 'edge'").select("source", "target").join(support, F.col("source") == F.col("sid"))
    direct = direct.unionByName(known.select(F.col("source").alias("id"), F.col("support").alias("observations"))).unionByName(known.select(F.col("target").alias("id"), F.col("support").alias("observations")))
    services = direct.groupBy("id").agg(F.sum("observations").alias("opportunity")).select(F.lit("service").alias("kind"), "id", "opportunity")
    others = state.where("kind <> 'service'").select("kind", "id", "source").join(support, F.col("source") == F.col("sid"), "left")
    own = seen.where("kind = 'endpoint'").select(F.col("kind").alias("k"), F.col("id").alias("i"), "observations")
    others = others.join(own, (F.col("kind") == F.col("k")) & (F.col("id") == F.col("i")), "left")
    return services.unionByName(others.select("kind", "id", F.coalesce("observations", "support", F.lit(0)).alias("opportunity")))


STATE_COLUMNS = "kind string, id string, source string, target string, lifecycle string, existence double, activity double, observed_windows bigint, opportunity_windows bigint, miss_streak bigint, last_seen bigint, last_opportunity bigint, gap_ema double, strength double, retired_at bigint, updated_at bigint, reason string"


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_COLUMNS)


def step(state: DataFrame, seen: DataFrame, ingest: tuple[int, int, int], window_end: int, globals_: Globals, cfg: Config = Config()) -> tuple[DataFrame, Globals, Health]:
    """One window: the new state, with before, observed, opportunity and thresholds beside it, the new globals, the health.

    seen: kind, id, source, target, observations, strength; ingest: spans, dropped, late. Rounding happens at every step as
    the fold's order is part of its meaning. Observed entities keep the first retirement's time out of their state.
    """
    version = globals_.version + 1
    ema, health = telemetry_health(globals_.volume_ema, *ingest, cfg)
    now = seen.select(F.col("kind").alias("k"), F.col("id").alias("i"), F.col("source").alias("s"), F.col("target").alias("t"), "observations", F.col("strength").alias("given"))
    both = state.join(now, (F.col("kind") == F.col("k")) & (F.col("id") == F.col("i")), "full_outer")
    both = both.select(
        F.coalesce("kind", "k").alias("kind"), F.coalesce("id", "i").alias("id"), F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"), F.coalesce("lifecycle", F.lit("candidate")).alias("before"), F.col("lifecycle").isNull().alias("new"),
        F.coalesce("existence", F.lit(0.25)).alias("ex"), F.coalesce("activity", F.lit(0.2)).alias("ac"), F.coalesce("observed_windows", F.lit(0)).alias("ow"), F.coalesce("opportunity_windows", F.lit(0)).alias("pw"), F.coalesce("miss_streak", F.lit(0)).alias("ms"),
        F.coalesce("last_seen", F.lit(0)).alias("ls"), F.coalesce("last_opportunity", F.lit(0)).alias("lo"), F.coalesce("gap_ema", F.lit(1.0)).alias("ge"), F.coalesce("strength", F.lit(0.0)).alias("st"), "retired_at", "updated_at", "reason", "observations", "given", F.col("k").isNotNull().alias("observed"),
    )
    chance = opportunities(both, seen).withColumnRenamed("kind", "ck").withColumnRenamed("id", "ci")
    rows = both.join(chance, (F.col("kind") == F.col("ck")) & (F.col("id") == F.col("ci")), "left").drop("ck", "ci").withColumn("opportunity", F.coalesce("opportunity", F.lit(0)).cast("bigint"))

    seen_now, missed = F.col("observed"), ~F.col("observed") & (F.col("opportunity") >= cfg.min_observations)
    rows = rows.withColumn("miss", missed).withColumns({
        "strength": F.when(seen_now, clamp(F.greatest("st", "given"))).otherwise(F.col("st")),
        "gap_ema": F.when(seen_now & (F.col("ls") > 0), F.greatest(F.lit(1.0), F.col("ge") * (1 - cfg.gap_alpha) + (F.lit(float(version)) - F.col("ls")) * cfg.gap_alpha)).when(seen_now, 1.0).otherwise(F.col("ge")),
        "miss_streak": F.when(seen_now, 0).when(missed, F.col("ms") + 1).otherwise(F.col("ms")),
    })
    soft, hard = thresholds(F.col("gap_ema"), F.col("strength"), cfg)
    rows = rows.withColumns({"soft": soft, "hard": hard})
    more = F.greatest(F.lit(0.0), (F.col("miss_streak") - F.col("soft") + 1).cast("double"))
    resist = 1 - F.least(F.lit(0.8), F.col("strength") * 0.6)
    frozen = 0.35 if health.frozen else 1.0
    support = clamp(F.col("observations").cast("double") / 10)
    miss = F.col("miss")
    rows = rows.withColumns({
        "existence": F.when(seen_now, clamp(F.col("ex") + cfg.existence_boost * (0.4 + 0.6 * support))).when(miss & (F.col("miss_streak") >= F.col("soft")), clamp(F.col("ex") - (cfg.miss_existence + cfg.miss_more * more) * resist * frozen)).otherwise(F.col("ex")),
        "activity": F.when(seen_now, clamp(F.col("ac") + cfg.activity_boost)).when(miss, clamp(F.col("ac") - (cfg.miss_activity + cfg.miss_more * more) * resist)).otherwise(clamp(F.col("ac") - cfg.passive_decay)),
    })
    strong = F.col("existence") >= cfg.stable_existence
    retire = (F.col("miss_streak") >= F.col("hard")) & (F.col("existence") <= cfg.retire_existence) if not health.frozen else F.lit(False)
    stale = F.col("miss_streak") >= F.col("soft")
    rows = rows.withColumn("lifecycle", F.when(seen_now, F.when(strong, "active").otherwise("candidate")).when(~miss, F.col("before")).when(retire, "retired").when(stale, "stale").when(strong, "active").otherwise("candidate"))
    why = {k: F.lit(v) for k, v in REASONS.items()}
    rows = rows.withColumns({
        "reason": F.when(seen_now, why["observed"]).when(~miss, why["no_opportunity"]).when(F.col("lifecycle") == "retired", why["retired"]).when(F.col("lifecycle") == "stale", why["stale_frozen" if health.frozen else "stale"]).when(strong, why["active"]).otherwise(why["candidate"]),
        "retired_at": F.when(seen_now, F.lit(None).cast("bigint")).when(miss & (F.col("lifecycle") == "retired"), F.when(F.col("before") == "retired", F.coalesce("retired_at", F.lit(window_end))).otherwise(F.lit(window_end))).otherwise(F.col("retired_at")),
        "updated_at": F.when(seen_now | miss, F.lit(window_end).cast("bigint")).otherwise(F.col("updated_at")),
        "observed_windows": F.col("ow") + seen_now.cast("bigint"), "opportunity_windows": F.col("pw") + miss.cast("bigint"),
        "last_seen": F.when(seen_now, F.lit(version).cast("bigint")).otherwise(F.col("ls")), "last_opportunity": F.when(miss, F.lit(version).cast("bigint")).otherwise(F.col("lo")),
    })
    names = [c.split()[0] for c in STATE_COLUMNS.split(", ")]
    return rows.select(*names, "before", "new", "observed", "opportunity", "miss", "soft", "hard"), replace(globals_, version=version, volume_ema=ema), health


def state_of(stepped: DataFrame) -> DataFrame:
    return stepped.select(*[c.split()[0] for c in STATE_COLUMNS.split(", ")])


def transitions(stepped: DataFrame) -> DataFrame:
    """(kind, id, from, to, reason) of what changed its lifecycle, promotions of observed entities too."""
    return stepped.where("before <> lifecycle").select("kind", "id", F.col("before").alias("from"), F.col("lifecycle").alias("to"), "reason")


def evictions(state: DataFrame, window_end: int, cfg: Config = Config()) -> DataFrame:
    """Retired entities that compaction drops, with why: `expired` beyond the TTL, else `kind` or `overall` beyond that cap.

    The caps are the feature here: they bound what is remembered of retired entities. Ranks are taken of retired rows alone,
    and over all kinds of at most three times the cap of a kind.
    """
    retired = state.where(F.col("lifecycle") == "retired")
    old = F.coalesce(F.lit(window_end) - F.col("retired_at"), F.lit(0)) > cfg.retired_ttl_s
    newest = [F.desc("retired_at"), F.desc("id")]
    fresh = retired.where(~old).withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy(*newest)))
    left = fresh.where(F.col("n") <= cfg.retired_per_kind).withColumn("n", F.row_number().over(Window.orderBy(*newest, "kind")))
    named = lambda df, why: df.select("kind", "id", F.lit(why).alias("why"))
    return named(retired.where(old), "expired").unionByName(named(fresh.where(F.col("n") > cfg.retired_per_kind), "kind")).unionByName(named(left.where(F.col("n") > cfg.retired_overall), "overall"))


def due(globals_: Globals, cfg: Config = Config()) -> bool:
    return globals_.version - globals_.last_compaction >= cfg.compact_every


def compact(state: DataFrame, window_end: int, globals_: Globals, cfg: Config = Config()) -> tuple[DataFrame, Globals]:
    """Every compact_every windows the state without evictions."""
    if not due(globals_, cfg):
        return state, globals_
    return state.join(evictions(state, window_end, cfg).drop("why"), ["kind", "id"], "left_anti").select(*state.columns), replace(globals_, last_compaction=globals_.version)


def compaction(state: DataFrame, window_end: int, globals_: Globals, cfg: Config = Config()) -> dict:
    """What compact drops of a state, counted by why."""
    got = {r["why"]: r["count"] for r in evictions(state, window_end, cfg).groupBy("why").count().collect()} if due(globals_, cfg) else {}
    return {"performed": due(globals_, cfg), "expired_retired": got.get("expired", 0), "trimmed_per_kind": got.get("kind", 0), "trimmed_overall": got.get("overall", 0)}


def stable_core(state: DataFrame, cfg: Config = Config()) -> DataFrame:
    return closed(state.where((F.col("lifecycle") == "active") & (F.col("existence") >= cfg.stable_existence) & (F.col("activity") >= cfg.stable_activity)))


def guardrail_union(state: DataFrame, version: int, cfg: Config = Config()) -> DataFrame:
    return closed(state.where((F.col("lifecycle") != "retired") & ((F.col("last_seen") == version) | (F.col("strength") >= 0.9) | (F.col("existence") >= cfg.guardrail_existence))))


def closed(chosen: DataFrame) -> DataFrame:
    """Without edges and endpoints whose services were not chosen."""
    services = chosen.where("kind = 'service'").select(F.col("id").alias("sid"))
    ends = chosen.where("kind <> 'service'").join(services, F.col("source") == F.col("sid"), "left_semi")
    edges = ends.where("kind = 'edge'").join(services, F.col("target") == F.col("sid"), "left_semi")
    return chosen.where("kind = 'service'").unionByName(edges).unionByName(ends.where("kind = 'endpoint'"))


def fingerprint(chosen: DataFrame) -> str:
    """SHA-256 of what a projection holds, in (kind, id) order; entities, not spans, so one small row."""
    each = F.array_sort(F.collect_list(F.concat_ws("\x1f", "kind", "id", F.coalesce("source", F.lit("")), F.coalesce("target", F.lit("")))))
    return chosen.agg(F.sha2(F.array_join(each, "\n").cast("binary"), 256)).first()[0]


def bump(globals_: Globals, name: str, digest: str) -> tuple[Globals, bool]:
    """The projection's (`stable` or `guardrail`) version goes up if its digest differs from the last one."""
    if getattr(globals_, f"{name}_hash") == digest:
        return globals_, False
    return replace(globals_, **{f"{name}_hash": digest, f"{name}_version": getattr(globals_, f"{name}_version") + 1}), True


def lifecycle_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("kind").pivot("lifecycle", ["candidate", "active", "stale", "retired"]).count().fillna(0)


def attention(stepped: DataFrame, limit: int = 10) -> DataFrame:
    """The report's list of entities that want a look: stale, retired or just missed; by lifecycle, then by misses."""
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in ATTENTION.items() for x in pair]), F.col("lifecycle"))
    return stepped.where("lifecycle in ('stale', 'retired') or miss").orderBy(rank.desc(), F.desc("miss_streak"), "kind", "id").limit(limit)


def replay(spark: SparkSession, windows: list[tuple[int, int, tuple[int, int, int]]], seen: DataFrame, cfg: Config = Config()):
    """Folds step over ordered windows (start, end, ingest); yields (start, stepped, state, globals, health) for each.

    seen: window_start and step's columns, of all windows. Each state is written once, so the plan of a window never holds
    those before it.
    """
    state, globals_ = empty_state(spark), Globals()
    seen = materialize(seen, "seen")
    for start, end, ingest in windows:
        stepped, globals_, health = step(state, seen.where(F.col("window_start") == start).drop("window_start"), ingest, end, globals_, cfg)
        stepped = materialize(stepped, "stepped")
        state, globals_ = compact(state_of(stepped), end, globals_, cfg)
        yield start, stepped, state, globals_, health
