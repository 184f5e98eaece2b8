import random

import numpy as np
import pytest

from spanweave.llm import jaccard, substrings


def words(rng, n, v=4000):
    return [f"w{rng.randrange(v)}" for _ in range(n)]


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows, t=0.8):
    s = [sets(x) for _, x, *_ in rows]
    links = {i: {j for j in range(len(rows)) if i != j and s[i] and s[j] and len(s[i] & s[j]) >= t * len(s[i] | s[j]) - 1e-9} for i in range(len(rows))}
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(ids, default=None), len(seen), len(links[i])))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = []
    for k in range(12):
        base = words(rng, rng.choice([3, 12, 60, 300]))
        for _ in range(rng.choice([1, 1, 2, 25])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(500, None), (501, ""), (502, "   "), (503, "Short One"), (504, "short one"), (None, "short one"), (505, " ".join(words(rng, 20_000)))]
    return rows


def test_jaccard_join_is_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 6)  # groups over several blocks
    df = spark.createDataFrame([(*r, "x", 1) for r in corpus], "doc_id long, text string, class_id string, rid int")
    got = jaccard.ngram_jaccard_join(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute_classes(corpus)


def test_chain_of_texts_goes_by_bands(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 6)
    rng = random.Random(8)
    track, at, rows = words(rng, 9000, 10**6), 0, []
    for k in range(400):  # neighbours share 0.78 or, now and then, 0.9 of their shingles, so bands chain all of them
        rows.append((k, " ".join(track[at : at + 100])))
        at += 5 if k % 9 == 0 else 12
    rows += [(1000 + k, " ".join(track[:100] + [f"x{k}"])) for k in range(30)]  # and a group that is alike throughout
    asked = {}
    groups = jaccard.candidate_groups
    monkeypatch.setattr(jaccard, "candidate_groups", lambda *a: asked.setdefault("groups", groups(*a)))
    got = jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_classes(rows)
    asked = asked["groups"].collect()
    assert all(r.by_band for r in asked)
    assert sum(r.blocks for r in asked) < 430 * 72  # what one group of all would ship


def test_drop_near_copies(spark, corpus):
    rows = [*corpus, corpus[0], (corpus[1][0], "quite another text of a repeated id that has nothing to do with it")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component string")
    left = jaccard.drop_near_copies(df)
    assert left.columns == df.columns
    kept = [(r.doc_id, r.text) for r in left.collect()]
    classes = {}
    for r, c in zip(rows, [min((x for x in range(len(rows)) if sets(rows[x][1]) and sets(rows[x][1]) == sets(r[1])), default=None) for r in rows]):
        classes.setdefault(c, []).append(r)
    n = len({(c[1]) for c in brute_classes(corpus) if c[1] is not None})
    assert len(kept) == n + 1 and len(set(kept)) == len(kept)
    assert jaccard.ngram_jaccard_join(df.limit(0)).count() == 0


def test_posterior_bound():
    grid = (np.arange(200_000) + 0.5) / 200_000
    for n, tolerance in ((30, 1e-7), (60, 1e-3)):
        m = jaccard.least_matches(n, 0.8, tolerance)
        for k, enough in ((m, True), (m - 1, False)):
            density = grid**k * (1 - grid) ** (n - k)
            assert (density[grid >= 0.8].sum() / density.sum() >= tolerance) == enough


def test_shared_counts_by_matrix():
    rng = np.random.default_rng(2)
    own = [np.unique(rng.integers(0, 9000, 5000).astype(np.uint64)) for _ in range(20)]
    i, j = np.triu_indices(20, 1)
    assert jaccard._shared_counts(own, own, True, i, j).tolist() == [len(np.intersect1d(own[a], own[b])) for a, b in zip(i, j)]


def brute_drop(rows, w):
    at = {}
    for k, (_, text) in enumerate(rows):
        own = (text or "").split()
        for i in range(len(own) - w + 1):
            at.setdefault(tuple(own[i : i + w]), []).append((k, i))
    gone = [set() for _ in rows]
    for places in at.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + w))
    out = []
    for k, (d, text) in enumerate(rows):
        own = (text or "").split()
        out.append((d, len(own), len(gone[k]), " ".join(x for i, x in enumerate(own) if i not in gone[k])))
    return sorted(out, key=str)


@pytest.mark.parametrize("group_places, limit", [(1, 0), (3, 1 << 30), (4096, 0)])
def test_drop_repeats_is_brute_force(spark, group_places, limit):
    rng = random.Random(11)
    passage = [words(rng, 40, 50) for _ in range(3)]
    rows = []
    for k in range(60):
        own = words(rng, rng.choice([0, 5, 80, 200]), 5000)
        if k % 2:
            p = passage[k % 3]
            a = rng.randrange(0, 15)
            own[10:10] = p[a : a + rng.choice([11, 12, 25])]
        rows.append((k, " ".join(own)))
    rows += [(100, "a " * 300), (101, None), (102, rows[5][1]), (None, rows[7][1]), (103, "Case " * 12), (104, "case " * 12), (105, " ".join(words(rng, 13, 9) * 2))]
    rows += [(106, " ".join(words(rng, 30_000, 3))), (None, " ".join(passage[0])), (None, " ".join(passage[1][:20])), (100, " ".join(passage[0][5:]))]
    rows += [rows[9]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kept string, rid int")
    got = substrings.drop_repeats(df, window=12, group_places=group_places, limit=limit)
    assert sorted(map(tuple, got.collect()), key=str) == brute_drop(rows, 12)


def test_drop_repeats_empty_and_window(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.drop_repeats(df).count() == 0
    with pytest.raises(ValueError):
        substrings.drop_repeats(df, window=8)


def test_groups_stay_whole_over_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(substrings, "PLACES", 10)
    rng, window = np.random.default_rng(2), 12
    text = rng.integers(0, 1 << 60, 12, np.uint64)
    groups = np.sort(rng.integers(0, 40, 900))
    groups[200:330] = groups[200]
    groups.sort()

    def batch(a, b):
        n = b - a
        data = pa.array([(text + np.uint64(g)).tobytes() for g in groups[a:b]], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(groups[a:b]), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, bool)), pa.array(np.arange(a, b)), pa.array(np.full(n, 4, np.int32)), pa.array(np.full(n, 0, np.int32)), data], names=["hash", "salt", "salted", "rid", "place", "lo", "words"])

    out = [x for b in substrings._trees(window)(iter([batch(a, a + 7) for a in range(0, 896, 7)])) for x in b.column(0).to_pylist()]
    many = np.bincount(groups[:896]) > 1
    assert sorted(out) == [i for i in range(896) if many[groups[i]]]


def test_anchors_of_long_texts(monkeypatch):
    h = np.random.default_rng(1).integers(0, 50, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = substrings.anchors(h)
    monkeypatch.setattr(substrings, "STARTS", 64)
    assert (substrings.anchors(h) == whole).all() and len(whole) == 2966


def test_words_split_at_ascii_white_space_only(spark):
    rows = [(1, "a  b\tc\x0bd"), (2, "\u00a0x\u2003y \x1cz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.kept) for r in substrings.drop_repeats(df).collect()}
    assert got == {1: (4, "a b c d"), 2: (2, "\u00a0x\u2003y \x1cz")}
