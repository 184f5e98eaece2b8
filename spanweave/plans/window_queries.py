"""Registered queries over arrivals: windows, their differences and what is believed of entities across them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import discover, reconcile, snapshot, windows
from . import views
from .queries import _LINK, register

DAY, CAP = 86_400, 250  # the cap is for the queries of ingest, whose feature it is; all others keep every arrival in time


def _arrivals(spark: SparkSession, sf_dir: str, view: str = views.V_ARRIVALS) -> DataFrame:
    views.register(spark, sf_dir, "events")
    return spark.sql(views.spark_sql(view))


def _assigned(spark: SparkSession, sf_dir: str, policy: str = "drop", cap: int | None = None) -> DataFrame:
    return windows.assign(_arrivals(spark, sf_dir), DAY, cap, policy)


def _sql(body: str, policy: str = "drop", cap: int | None = None) -> str:
    fits = "NOT late" if policy == "drop" else "true"
    kept = f"{fits} AND row_number() OVER (PARTITION BY window_start, {fits} ORDER BY seq) <= {cap}" if cap else fits
    return f"""WITH RECURSIVE v AS ({views.duck_sql(views.V_ARRIVALS)}),
a AS (SELECT *, event_s < window_start AS late FROM (SELECT *, received_s - received_s % {DAY} AS window_start FROM v)),
w AS (SELECT *, {kept} AS kept FROM a){body}"""


_COUNTS = " SELECT window_start, count(*) FILTER (WHERE kept) AS spans, count(DISTINCT CASE WHEN kept THEN trace_id END) AS traces, count(*) FILTER (WHERE NOT kept) AS dropped_spans, count(*) FILTER (WHERE late) AS late_spans FROM w GROUP BY window_start"


@register(_sql(_COUNTS, cap=CAP))
def tumbling_ingest_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.ingest_counts(_assigned(spark, sf_dir, cap=CAP))


@register(_sql(_COUNTS, "current_window", CAP))
def tumbling_ingest_current_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.ingest_counts(_assigned(spark, sf_dir, "current_window", CAP))


@register(_sql(" SELECT window_start, source_type AS type, connector, '' AS ref, count(*) AS observations FROM w GROUP BY ALL"))
def window_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.source_observations(_assigned(spark, sf_dir))


def _services(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _assigned(spark, sf_dir).where("kept")
    return kept.groupBy("window_start", F.col("service").alias("id")).agg(F.count("*").alias("observations"), F.count_distinct("trace_id").alias("trace_count"), F.min("event_s").alias("first_ns"), F.max("event_s").alias("last_ns"))


_SERVICES = ", s AS (SELECT window_start, service AS id, count(*) AS observations, count(DISTINCT trace_id) AS trace_count, min(event_s) AS first_ns, max(event_s) AS last_ns FROM w WHERE kept GROUP BY ALL)"


@register(_sql(_SERVICES + " SELECT * FROM s"))
def window_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _services(spark, sf_dir)


@register(_sql(_SERVICES + " SELECT window_start, id, observations, trace_count, min(first_ns) OVER o AS first_ns, max(last_ns) OVER o AS last_ns FROM s WINDOW o AS (PARTITION BY id ORDER BY window_start)"))
def first_last_seen_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_last_seen(_services(spark, sf_dir))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity for each user, whose content is a coarse activity level, so that windows differ."""
    kept = _assigned(spark, sf_dir).where("kept")
    return kept.groupBy("window_start", F.col("trace_id").alias("id")).agg((F.floor(F.count("*") / 4)).cast("string").alias("content"))


@register(_sql(f""", u AS (SELECT window_start, trace_id AS id, CAST(count(*) // 4 AS VARCHAR) AS content FROM w WHERE kept GROUP BY ALL),
k AS (SELECT DISTINCT window_start FROM u), j AS (SELECT coalesce(a.window_start, b.window_start + {DAY}) AS window_start, a.content AS now, b.content AS was FROM u a FULL JOIN u b ON a.id = b.id AND a.window_start = b.window_start + {DAY})
SELECT window_start, count(*) FILTER (WHERE was IS NULL) AS added, count(*) FILTER (WHERE now IS NULL) AS removed, count(*) FILTER (WHERE now <> was) AS changed FROM j WHERE window_start <= (SELECT max(window_start) FROM k) GROUP BY window_start"""))
def window_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.window_diffs(_users(spark, sf_dir), DAY)


@register(_sql(""", c AS (SELECT window_start, count(*) FILTER (WHERE kept) AS spans FROM w GROUP BY window_start)
SELECT window_start, 'snap-' || substr(sha256(window_start || '|' || (window_start + 86400) || '|' || spans), 1, 24) AS snapshot_id FROM c"""))
def snapshot_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = windows.ingest_counts(_assigned(spark, sf_dir))
    return c.select("window_start", snapshot.snapshot_id(F.col("window_start").cast("string"), (F.col("window_start") + DAY).cast("string"), F.col("spans").cast("string")).alias("snapshot_id"))


@register(_sql(""", c AS (SELECT window_start, row_number() OVER (ORDER BY window_start) AS n, CAST(count(*) FILTER (WHERE kept) AS DOUBLE) AS spans FROM w GROUP BY window_start),
e AS (SELECT n, window_start, spans AS ema FROM c WHERE n = 1 UNION ALL SELECT c.n, c.window_start, CASE WHEN e.ema = 0 THEN c.spans ELSE e.ema * 0.7::DOUBLE + c.spans * 0.3::DOUBLE END FROM e JOIN c ON c.n = e.n + 1)
SELECT window_start, ema FROM e"""))
def volume_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = windows.ingest_counts(_assigned(spark, sf_dir)).select("window_start", F.col("spans").cast("double").alias("spans"))
    sofar = F.collect_list("spans").over(Window.orderBy("window_start"))  # one row per window
    ema = F.aggregate("xs", F.lit(0.0), lambda e, x: F.when(e == 0, x).otherwise(e * 0.7 + x * 0.3))
    return counts.withColumn("xs", sofar).select("window_start", ema.alias("ema"))


@register("""SELECT event_id, greatest(ceil(g * 1.5::DOUBLE), 2) + floor(s * 2 + 0.5) AS soft, greatest(greatest(ceil(g * 3.0::DOUBLE), 5) + floor(s * 4 + 0.5), greatest(ceil(g * 1.5::DOUBLE), 2) + floor(s * 2 + 0.5)) AS hard
FROM (SELECT event_id, 1.0::DOUBLE + (event_id % 40) / 8.0::DOUBLE AS g, (event_id % 9) / 8.0::DOUBLE AS s FROM events)""")
def gap_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    soft, hard = reconcile.thresholds(F.lit(1.0) + (F.col("event_id") % 40) / 8.0, (F.col("event_id") % 9) / 8.0, reconcile.Config())
    return e.select("event_id", soft.cast("double").alias("soft"), hard.cast("double").alias("hard"))


@register("""SELECT 'u' || user_id AS id, greatest(0.2::DOUBLE, max(CASE event_type WHEN 'click' THEN 0.35::DOUBLE WHEN 'view' THEN 0.95::DOUBLE WHEN 'error' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)) AS strength FROM events GROUP BY user_id""")
def source_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "traces").when(F.col("event_type") == "view", "topology_api").when(F.col("event_type") == "error", "overlay").otherwise("other")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.concat(F.lit("u"), "user_id").alias("id")).agg(F.collect_set(kind).alias("types"))
    return rows.select("id", reconcile.source_strength(F.col("types")).alias("strength"))


def _world(spark: SparkSession, sf_dir: str) -> tuple[list, DataFrame]:
    """A graph for each day: event types are services, pairs of a user's successive kept events edges, users endpoints."""
    assigned = windows.assign(_arrivals(spark, sf_dir, views.V_USER_ARRIVALS), DAY, 10_000)
    kept = assigned.where("kept")
    none = F.lit(None).cast("string")
    s = kept.groupBy("window_start", F.col("service").alias("id")).agg(F.count("*").alias("observations")).select("window_start", F.lit("service").alias("kind"), "id", none.alias("source"), none.alias("target"), "observations")
    before = F.lag("service").over(Window.partitionBy("window_start", "trace_id").orderBy("seq"))
    e = kept.withColumn("source", before).where("source <> service").groupBy("window_start", "source", F.col("service").alias("target")).agg(F.count("*").alias("observations"))
    e = e.select("window_start", F.lit("edge").alias("kind"), F.concat_ws("|", "source", "target").alias("id"), "source", "target", "observations")
    n = kept.where("trace_id is not null").groupBy("window_start", "trace_id").agg(F.min("service").alias("source"), F.count("*").alias("observations"))
    n = n.select("window_start", F.lit("endpoint").alias("kind"), F.col("trace_id").alias("id"), "source", none.alias("target"), "observations")
    rows = s.unionByName(e).unionByName(n).withColumn("strength", F.lit(reconcile.TRACES))
    counts = windows.dense_windows(windows.ingest_counts(assigned), DAY).orderBy("window_start").collect()  # one row per window, which the fold takes in order
    return [(r["window_start"], r["window_start"] + DAY, (r["spans"], r["dropped_spans"], r["late_spans"])) for r in counts], rows


def _folded(spark: SparkSession, sf_dir: str):
    steps, rows = _world(spark, sf_dir)
    last = None
    for last in reconcile.replay(spark, steps, rows):
        pass
    return last


def _clamp(x: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN 0.0::DOUBLE WHEN {x} >= 1 THEN 1.0::DOUBLE ELSE floor(({x}) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE END"


def _fold_sql() -> str:
    """The whole fold as one recursive query: each turn takes the state of the window before to that of the next.

    Rows of f: v (window number), the globals on a row of kind '#', and entities after the window; `gone` if compaction drops them.
    """
    c, size = reconcile.Config(), DAY
    d = lambda x: f"{float(x)}::DOUBLE"
    why = {k: f"'{v}'" for k, v in reconcile.REASONS.items()}
    start = f"CAST(floor(received_s / {size}.0) AS BIGINT) * {size}"
    return f"""WITH RECURSIVE x AS ({views.duck_sql(views.V_USER_ARRIVALS)}),
a AS (SELECT *, event_s < w AS late FROM (SELECT *, {start} AS w FROM x)),
k AS (SELECT *, NOT late AND row_number() OVER (PARTITION BY w, late ORDER BY seq) <= 10000 AS kept FROM a),
ends AS (SELECT min(w) AS lo, max(w) AS hi FROM k),
win AS (SELECT row_number() OVER (ORDER BY w) AS v, w, w + {size} AS w_end FROM (SELECT unnest(range(lo, hi + 1, {size})) AS w FROM ends)),
ing AS (SELECT v, win.w, w_end, count(*) FILTER (WHERE kept) AS spans, count(k.w) - count(*) FILTER (WHERE kept) AS dropped, count(*) FILTER (WHERE late) AS late FROM win LEFT JOIN k ON k.w = win.w GROUP BY ALL),
kk AS (SELECT v, service, trace_id, lag(service) OVER (PARTITION BY v, trace_id ORDER BY seq) AS before FROM k JOIN win ON k.w = win.w WHERE kept),
seen AS (SELECT v, 'service' AS kind, service AS id, NULL AS source, NULL AS target, count(*) AS obs FROM kk GROUP BY v, service
  UNION ALL SELECT v, 'edge', before || '|' || service, before, service, count(*) FROM kk WHERE before <> service GROUP BY v, before, service
  UNION ALL SELECT v, 'endpoint', trace_id, min(service), NULL, count(*) FROM kk WHERE trace_id IS NOT NULL GROUP BY v, trace_id),
f AS (
  SELECT 0::BIGINT AS v, '#' AS kind, '' AS id, NULL::VARCHAR AS source, NULL::VARCHAR AS target, '' AS lifecycle, 0.0::DOUBLE AS existence, 0.0::DOUBLE AS activity, 0::BIGINT AS observed_windows, 0::BIGINT AS opportunity_windows, 0::BIGINT AS miss_streak,
    0::BIGINT AS last_seen, 0::BIGINT AS last_opportunity, 0.0::DOUBLE AS gap_ema, 0.0::DOUBLE AS strength, NULL::BIGINT AS retired_at, NULL::BIGINT AS updated_at, '' AS reason, false AS miss, false AS gone
  UNION ALL (
  WITH g0 AS (SELECT f.v + 1 AS v, w_end, spans, dropped, late, CASE WHEN f.existence = 0 THEN spans::DOUBLE ELSE f.existence * 0.7::DOUBLE + spans * 0.3::DOUBLE END AS ema, f.last_seen AS compacted FROM f JOIN ing ON ing.v = f.v + 1 WHERE f.kind = '#'),
  g1 AS (SELECT *, greatest(1, spans + dropped)::DOUBLE AS total, CASE WHEN ema > 0 THEN spans / ema ELSE 1.0::DOUBLE END AS ratio FROM g0),
  g2 AS (SELECT *, 1.0::DOUBLE - 0.55::DOUBLE * (dropped / total) - 0.25::DOUBLE * (late / total) - CASE WHEN ema >= {2 * c.min_observations} AND ratio < 0.35::DOUBLE THEN 0.25::DOUBLE * (0.35::DOUBLE - ratio) / 0.35::DOUBLE ELSE 0.0::DOUBLE END AS raw FROM g1),
  g AS (SELECT *, {_clamp("raw")} < {d(c.freeze_below)} AS frozen, v - compacted >= {c.compact_every} AS due FROM g2),
  now AS (SELECT seen.* FROM seen JOIN g ON seen.v = g.v),
  b AS (SELECT coalesce(o.kind, n.kind) AS kind, coalesce(o.id, n.id) AS id, coalesce(n.source, o.source) AS source, coalesce(n.target, o.target) AS target, coalesce(o.lifecycle, 'candidate') AS was, coalesce(o.existence, 0.25::DOUBLE) AS ex, coalesce(o.activity, 0.2::DOUBLE) AS ac,
      coalesce(o.observed_windows, 0) AS ow, coalesce(o.opportunity_windows, 0) AS pw, coalesce(o.miss_streak, 0) AS ms, coalesce(o.last_seen, 0) AS ls, coalesce(o.last_opportunity, 0) AS lo, coalesce(o.gap_ema, 1.0::DOUBLE) AS ge, coalesce(o.strength, 0.0::DOUBLE) AS st,
      o.retired_at, o.updated_at, o.reason, n.obs, n.id IS NOT NULL AS observed FROM (SELECT * FROM f WHERE kind <> '#' AND NOT gone) o FULL JOIN now n ON o.kind = n.kind AND o.id = n.id),
  sup AS (SELECT id, obs FROM now WHERE kind = 'service'),
  direct AS (SELECT id, obs FROM sup UNION ALL SELECT source, obs FROM now WHERE kind = 'endpoint' UNION ALL SELECT source, obs FROM now WHERE kind = 'edge' UNION ALL SELECT target, obs FROM now WHERE kind = 'edge'
      UNION ALL SELECT b.source, sup.obs FROM b JOIN sup ON b.source = sup.id WHERE b.kind = 'edge' UNION ALL SELECT b.target, sup.obs FROM b JOIN sup ON b.source = sup.id WHERE b.kind = 'edge'),
  so AS (SELECT id, sum(obs)::BIGINT AS opp FROM direct GROUP BY id),
  r0 AS (SELECT b.*, g.v, g.w_end, g.frozen, g.due, coalesce(CASE b.kind WHEN 'service' THEN so.opp WHEN 'endpoint' THEN coalesce(b.obs, sup.obs) ELSE sup.obs END, 0) AS opp
      FROM b CROSS JOIN g LEFT JOIN so ON b.kind = 'service' AND so.id = b.id LEFT JOIN sup ON sup.id = b.source),
  r1 AS (SELECT *, NOT observed AND opp >= {c.min_observations} AS miss FROM r0),
  r2 AS (SELECT *, CASE WHEN observed THEN greatest(st, {d(reconcile.TRACES)}) ELSE st END AS strength, CASE WHEN observed AND ls > 0 THEN greatest(1.0::DOUBLE, ge * {d(1 - c.gap_alpha)} + (v - ls)::DOUBLE * {d(c.gap_alpha)}) WHEN observed THEN 1.0::DOUBLE ELSE ge END AS gap_ema,
      CASE WHEN observed THEN 0 WHEN miss THEN ms + 1 ELSE ms END AS miss_streak FROM r1),
  r3 AS (SELECT *, greatest(ceil(gap_ema * {d(c.soft_multiplier)}), {c.soft_least}) + floor(strength * {d(c.soft_resistance)} + 0.5::DOUBLE) AS soft, greatest(ceil(gap_ema * {d(c.hard_multiplier)}), {c.hard_least}) + floor(strength * {d(c.hard_resistance)} + 0.5::DOUBLE) AS hard0,
      1.0::DOUBLE - least(0.8::DOUBLE, strength * 0.6::DOUBLE) AS resist, {_clamp("obs::DOUBLE / 10.0::DOUBLE")} AS support FROM r2),
  r4 AS (SELECT *, greatest(hard0, soft) AS hard, greatest(0.0::DOUBLE, (miss_streak - soft + 1)::DOUBLE) AS more, CASE WHEN frozen THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END AS soften FROM r3),
  r5 AS (SELECT *, ex + {d(c.existence_boost)} * (0.4::DOUBLE + 0.6::DOUBLE * support) AS ex_up, ex - ({d(c.miss_existence)} + {d(c.miss_more)} * more) * resist * soften AS ex_down, ac + {d(c.activity_boost)} AS ac_up, ac - ({d(c.miss_activity)} + {d(c.miss_more)} * more) * resist AS ac_down, ac - {d(c.passive_decay)} AS ac_idle FROM r4),
  r6 AS (SELECT *, CASE WHEN observed THEN {_clamp("ex_up")} WHEN miss AND miss_streak >= soft THEN {_clamp("ex_down")} ELSE ex END AS existence, CASE WHEN observed THEN {_clamp("ac_up")} WHEN miss THEN {_clamp("ac_down")} ELSE {_clamp("ac_idle")} END AS activity FROM r5),
  r7 AS (SELECT *, CASE WHEN NOT observed AND NOT miss THEN was WHEN NOT observed AND NOT frozen AND miss_streak >= hard AND existence <= {d(c.retire_existence)} THEN 'retired' WHEN NOT observed AND miss_streak >= soft THEN 'stale' WHEN existence >= {d(c.stable_existence)} THEN 'active' ELSE 'candidate' END AS lifecycle FROM r6),
  r8 AS (SELECT *, CASE WHEN observed THEN NULL WHEN miss AND lifecycle = 'retired' THEN CASE WHEN was = 'retired' THEN coalesce(retired_at, w_end) ELSE w_end END ELSE retired_at END AS gone_at,
      CASE WHEN observed THEN {why["observed"]} WHEN NOT miss THEN {why["no_opportunity"]} WHEN lifecycle = 'retired' THEN {why["retired"]} WHEN lifecycle = 'stale' THEN CASE WHEN frozen THEN {why["stale_frozen"]} ELSE {why["stale"]} END WHEN existence >= {d(c.stable_existence)} THEN {why["active"]} ELSE {why["candidate"]} END AS why FROM r7),
  r9 AS (SELECT *, lifecycle = 'retired' AND coalesce(w_end - gone_at, 0) > {c.retired_ttl_s} AS old, row_number() OVER (PARTITION BY kind, lifecycle = 'retired', lifecycle = 'retired' AND coalesce(w_end - gone_at, 0) > {c.retired_ttl_s} ORDER BY gone_at DESC NULLS LAST, id DESC) AS place FROM r8),
  r10 AS (SELECT *, row_number() OVER (PARTITION BY lifecycle = 'retired' AND NOT old AND place <= {c.retired_per_kind} ORDER BY gone_at DESC NULLS LAST, id DESC, kind) AS overall FROM r9)
  SELECT v, kind, id, source, target, lifecycle, existence, activity, (ow + observed::BIGINT)::BIGINT, (pw + miss::BIGINT)::BIGINT, miss_streak::BIGINT, CASE WHEN observed THEN v ELSE ls END::BIGINT, CASE WHEN miss THEN v ELSE lo END::BIGINT, gap_ema, strength, gone_at::BIGINT,
    CASE WHEN observed OR miss THEN w_end ELSE updated_at END::BIGINT, why, miss, due AND lifecycle = 'retired' AND (old OR place > {c.retired_per_kind} OR overall > {c.retired_overall}) FROM r10
  UNION ALL SELECT v, '#', '', NULL, NULL, '', ema, 0, 0, 0, 0, CASE WHEN due THEN v ELSE compacted END, 0, 0, 0, NULL, NULL, '', false, false FROM g)),
last AS (SELECT * FROM f WHERE v = (SELECT max(v) FROM f) AND kind <> '#'), s AS (SELECT * EXCLUDE (v, miss, gone) FROM last WHERE NOT gone)"""


_CLOSED = """, c AS (SELECT * FROM s WHERE {0}), n AS (SELECT id FROM c WHERE kind = 'service')
SELECT * FROM c WHERE kind = 'service' OR source IN (SELECT id FROM n) AND (kind = 'endpoint' OR target IN (SELECT id FROM n))"""


@register(_fold_sql() + " SELECT * FROM s")
def reconcile_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir)[2]


@register(_fold_sql() + _CLOSED.format("lifecycle = 'active' AND existence >= 0.7::DOUBLE AND activity >= 0.35::DOUBLE"))
def stable_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.stable_core(_folded(spark, sf_dir)[2])


@register(_fold_sql() + _CLOSED.format("lifecycle <> 'retired' AND (last_seen = (SELECT max(v) FROM f) OR strength >= 0.9::DOUBLE OR existence >= 0.3::DOUBLE)"))
def guardrail_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, state, globals_, _ = _folded(spark, sf_dir)
    return reconcile.guardrail_union(state, globals_.version)


@register(_fold_sql() + " SELECT kind, " + ", ".join(f"count(*) FILTER (WHERE lifecycle = '{x}') AS {x}" for x in ("candidate", "active", "stale", "retired")) + " FROM s GROUP BY kind")
def lifecycle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.lifecycle_counts(_folded(spark, sf_dir)[2])


@register(_fold_sql() + """ SELECT kind, id, lifecycle, miss_streak, reason FROM last WHERE lifecycle IN ('stale', 'retired') OR miss
ORDER BY CASE lifecycle WHEN 'retired' THEN 4 WHEN 'stale' THEN 3 WHEN 'candidate' THEN 2 ELSE 1 END DESC, miss_streak DESC, kind, id LIMIT 10""")
def attention_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.attention(_folded(spark, sf_dir)[1]).select("kind", "id", "lifecycle", "miss_streak", "reason")


_HEALTH = f""", c AS (SELECT window_start, row_number() OVER (ORDER BY window_start) AS n, count(*) FILTER (WHERE kept) AS spans, count(*) FILTER (WHERE NOT kept) AS dropped, count(*) FILTER (WHERE late) AS late FROM w GROUP BY window_start),
e AS (SELECT n, spans::DOUBLE AS ema FROM c WHERE n = 1 UNION ALL SELECT c.n, CASE WHEN e.ema = 0 THEN c.spans::DOUBLE ELSE e.ema * 0.7::DOUBLE + c.spans * 0.3::DOUBLE END FROM e JOIN c ON c.n = e.n + 1),
h AS (SELECT *, dropped / greatest(1, spans + dropped)::DOUBLE AS d, late / greatest(1, spans + dropped)::DOUBLE AS l, CASE WHEN ema > 0 THEN spans / ema ELSE 1.0::DOUBLE END AS r FROM c JOIN e ON c.n = e.n),
g AS (SELECT *, 1.0::DOUBLE - 0.55::DOUBLE * d - 0.25::DOUBLE * l - CASE WHEN ema >= 4 AND r < 0.35::DOUBLE THEN 0.25::DOUBLE * (0.35::DOUBLE - r) / 0.35::DOUBLE ELSE 0.0::DOUBLE END AS raw FROM h)
SELECT window_start, ema, {_clamp("d")} AS drop_ratio, {_clamp("l")} AS late_ratio, {_clamp("r")} AS volume_ratio, {_clamp("raw")} AS score, {_clamp("raw")} < 0.55::DOUBLE AS frozen FROM g"""


@register(_sql(_HEALTH, cap=CAP))
def telemetry_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = windows.ingest_counts(_assigned(spark, sf_dir, cap=CAP)).orderBy("window_start").collect()  # one row per window, folded in order
    ema, out = 0.0, []
    for r in counts:
        ema, h = reconcile.telemetry_health(ema, r["spans"], r["dropped_spans"], r["late_spans"], reconcile.Config())
        out.append((r["window_start"], ema, h.drop_ratio, h.late_ratio, h.volume_ratio, h.score, h.frozen))
    return spark.createDataFrame(out, "window_start long, ema double, drop_ratio double, late_ratio double, volume_ratio double, score double, frozen boolean")


def _opportunity_sql() -> str:
    """Over the seen of the fold's query: all entities ever seen are known, the last window is what could have shown them."""
    head = _fold_sql()
    return head[: head.index(",\nf AS (")] + """,
known AS (SELECT kind, id, any_value(source) AS source, any_value(target) AS target FROM seen WHERE kind <> 'endpoint' GROUP BY kind, id UNION ALL SELECT kind, id, min(source), NULL FROM seen WHERE kind = 'endpoint' GROUP BY kind, id),
now AS (SELECT * FROM seen WHERE v = (SELECT max(v) FROM seen)), sup AS (SELECT id, obs FROM now WHERE kind = 'service'),
direct AS (SELECT id, obs FROM sup UNION ALL SELECT source, obs FROM now WHERE kind <> 'service' UNION ALL SELECT target, obs FROM now WHERE kind = 'edge'
  UNION ALL SELECT k.source, sup.obs FROM known k JOIN sup ON k.source = sup.id WHERE k.kind = 'edge' UNION ALL SELECT k.target, sup.obs FROM known k JOIN sup ON k.source = sup.id WHERE k.kind = 'edge')
SELECT 'service' AS kind, id, CAST(sum(obs) AS BIGINT) AS opportunity FROM direct GROUP BY id
UNION ALL SELECT k.kind, k.id, coalesce(CASE WHEN k.kind = 'endpoint' THEN n.obs END, sup.obs, 0) FROM known k LEFT JOIN sup ON sup.id = k.source LEFT JOIN now n ON n.kind = k.kind AND n.id = k.id WHERE k.kind <> 'service'"""


@register(_opportunity_sql())
def opportunity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps, rows = _world(spark, sf_dir)
    known = rows.groupBy("kind", "id").agg(F.min("source").alias("source"), F.min("target").alias("target"))
    last = rows.agg(F.max("window_start")).first()[0]
    return reconcile.opportunities(known, rows.where(F.col("window_start") == last)).select("kind", "id", F.col("opportunity").cast("bigint").alias("opportunity"))


MONTH = 30 * DAY
_WINDOW_LINK = _LINK.replace("PARTITION BY trace_id, span_id", "PARTITION BY w, trace_id, span_id").replace("SELECT c.trace_id, c.service", "SELECT c.w, c.trace_id, c.service").replace("ON c.trace_id = p.trace_id", "ON c.w = p.w AND c.trace_id = p.trace_id")
_SHIFT = windows.seconds_between_epochs() % MONTH


@register(f"WITH RECURSIVE v0 AS ({views.duck_sql(views.V_SPANS)}), v AS (SELECT *, CAST(floor((start_ns // 1000000000 + {_SHIFT}) / {MONTH}.0) AS BIGINT) * {MONTH} - {_SHIFT} AS w FROM v0),{_WINDOW_LINK}"
          + ' SELECT w AS window_start, id, any_value(ps) AS "from", any_value(service) AS "to", count(*) AS observations, count(DISTINCT nullif(trace_id, \'\')) AS trace_count, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.99) AS p99 FROM x GROUP BY w, id')
def window_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of each window of thirty days: parents are looked up within the window."""
    spans = views.spans(spark, sf_dir).withColumn("window_start", windows.window_start(F.floor(F.col("start_ns") / 1_000_000_000), MONTH))
    by = ("window_start",)
    edges = discover.edges(discover.link_parents(discover.prepare(spans, by), by), by)
    return edges.select("window_start", "id", "from", "to", "observations", "trace_count", "p50", "p99")


@register(f"""WITH s AS (SELECT CASE WHEN mod(c_custkey, 3) = 0 THEN 'service' WHEN mod(c_custkey, 3) = 1 THEN 'edge' ELSE 'endpoint' END AS kind, 'e' || c_custkey AS id, CASE WHEN mod(c_custkey, 4) = 0 THEN 'active' ELSE 'retired' END AS lifecycle, 1000000 - mod(c_custkey * 37, 997) * 100 AS retired_at FROM customer),
r AS (SELECT * FROM s WHERE lifecycle = 'retired' AND 1000000 - retired_at <= 86400),
k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY retired_at DESC, id DESC) AS n FROM r), o AS (SELECT *, row_number() OVER (ORDER BY retired_at DESC, id DESC, kind) AS m FROM k WHERE n <= 200)
SELECT kind, id, lifecycle FROM s WHERE lifecycle <> 'retired' UNION ALL SELECT kind, id, lifecycle FROM o WHERE m <= 500""")
def retired_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.when(c % 3 == 0, "service").when(c % 3 == 1, "edge").otherwise("endpoint").alias("kind"), F.concat(F.lit("e"), c).alias("id"), F.when(c % 4 == 0, "active").otherwise("retired").alias("lifecycle"), (F.lit(1_000_000) - c * 37 % 997 * 100).alias("retired_at"))
    state, _ = reconcile.compact(rows, 1_000_000, reconcile.Globals(version=5), reconcile.Config())
    return state.select("kind", "id", "lifecycle")
