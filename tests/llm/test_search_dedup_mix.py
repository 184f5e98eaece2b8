import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from spanweave.llm import dedup, mixing, topk

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_top(rows, asked, k):
    """rows: (id, vector); asked: places of the queries among them."""
    out = []
    for q in asked:
        ranked = sorted((-sum(a * b for a, b in zip(rows[q][1], v)), i) for p, (i, v) in enumerate(rows) if p != q and len(v) == len(rows[q][1]))
        out += [(rows[q][0], r + 1, i, -s) for r, (s, i) in enumerate(ranked[:k])]
    return sorted(out)


@pytest.mark.parametrize("regions", [4096, 3])
def test_top_k_over_shards_blocks_and_waves_with_ties(spark, regions, monkeypatch):
    monkeypatch.setattr(topk, "REGIONS", regions)
    monkeypatch.setattr(topk, "SUMMARIES", 4)
    rng = random.Random(1)
    rows = [(i, [rng.randint(-3, 3) for _ in range(4)]) for i in range(300)] + [(i % 30, [rng.randint(-9, 9) for _ in range(4)]) for i in range(40)] + [(500 + i, [rng.randint(-9, 9) for _ in range(3)]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 20, shard_rows=20, block_rows=4)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, [p for p, (i, _) in enumerate(rows) if i % 20 == 0], 20)


def test_top_k_of_queries_from_elsewhere(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randint(-50, 50) for _ in range(3)]) for i in range(100)]
    asked = [(7, [1, 2, 3]), (7, [1, 2, 3]), (8, [0, 0, 0])]
    df, queries = (spark.createDataFrame(x, "vec_id long, vector array<long>") for x in (rows, asked))
    got = sorted(map(tuple, topk.top_k(df, queries, 5, shard_rows=30).collect()))
    assert got == sorted(x for a in asked for x in brute_top([*rows, a], [100], 5))


@pytest.mark.parametrize("size", [2**25, 2**31, 2**45])
def test_top_k_of_large_scores(spark, size):
    rng = random.Random(3)
    rows = [(i, [rng.randint(-size, size) for _ in range(2)]) for i in range(80)] + [(100, [size, size]), (101, [size, size]), (102, [size, size - 1])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, 3, shard_rows=20).collect()))
    cut = lambda x: max(-(2**63 - 1), min(2**63 - 1, x))
    want = []
    for q, v in rows:
        if q % 20 == 0:
            ranked = sorted((-cut(sum(a * b for a, b in zip(v, w))), i) for i, w in rows if i != q)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked[:3])]
    assert got == sorted(want)


def test_top_k_edges(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 0.0]), (6, [-0.5, 0.25]), (None, [1.0, 1.0]), (7, [1.0]), (8, [])]
    df = topk.scaled(spark.createDataFrame(rows, "vec_id long, e array<double>").selectExpr("*", "1 as vector", "'x' as rank"), "vec_id", "e")
    got = sorted(map(tuple, topk.top_k(df, F.lit(True), 5).collect()))
    assert got == [(1, 1, 6, 64 * -32 + 128 * 16), (6, 1, 1, 64 * -32 + 128 * 16)]
    assert topk.top_k(df.limit(0), F.lit(True), 5).count() == 0 and topk.top_k(df, df.limit(0), 5).count() == 0


def test_exact_dedup(spark):
    texts = ["Same Text", "same text", None, "", "Ärger", "ärger", "other", "same text", "x" * 200_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(7, "same text", "clash"), (None, "same TEXT", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_sha256 string")
    for heavy in (2, 100):  # with and without winners of the sketch
        got = dedup.exact_dedup(df, min_heavy=heavy).collect()
        groups = {}
        for d, t, _ in rows:
            groups.setdefault((t or "").translate(LOWER), []).append(d)
        assert len(got) == len(rows)
        for r in got:
            own = next(g for k, g in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
            assert (r.keep_id, r.group_size) == (max(x for x in own if x is not None), len(own))
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = dedup.drop_exact_copies(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert dedup.exact_dedup(df.limit(0)).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return share | {s: most * sizes[s] for s in capped}
        capped |= over


def test_targets_and_mix(spark):
    rng = random.Random(3)
    plan = {"a": 400, "b": 50, "c": 900, "d": 7, None: 30, "": 12}
    rows, i = [], 0
    for s, n in plan.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 900])), s, "clash"))
            i += 1
    rows += [(i, None, "a", "clash"), (None, "one two", "a", "clash"), (0, rows[0][1], "a", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.systematic_mix(df).collect()
    assert len(got) == len(rows) and sorted(got, key=str) == sorted(mixing.systematic_mix(df.repartition(7)).collect(), key=str)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    targets = brute_targets(sizes)
    taken = {s: sum(r.taken for r in got if r.source == s) for s in sizes}
    for r in got:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source] and r.taken == r.copies * r.size <= 3 * r.size
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 0.02 * targets[s] + 1900
    mix = mixing.emit_mix(df)
    assert mix.columns == df.columns and mix.count() == sum(r.copies for r in got)
    assert mixing.systematic_mix(df.limit(0)).count() == 0
    assert [r.taken for r in mixing.systematic_mix(df.where("text is null")).collect()] == [0]


def test_hot_source_is_ranked_in_ranges(spark):
    df = spark.range(60_000).selectExpr("id as doc_id", "'w w' as text", "if(id % 3 = 0, 'hot', concat('s', id % 50)) as source")
    got = mixing.systematic_mix(df).groupBy("source", "target", "source_size").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 2 for r in got)
