import math
import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanweave.llm import lm
from spanweave.llm.common import id_crc
from spanweave.llm.queries import tokenizer_files

RANKS, PATTERN = tokenizer_files()
SF = "/root/testdata/sf0.01"


def tiny_model(n=40):
    rng = np.random.default_rng(1)
    model = lm.new_model(rng.integers(0, 50, n).astype(float))
    model.rows[: -lm.CLASSES // lm.DIM] = rng.normal(0, 0.3, (len(model.rows) - lm.CLASSES // lm.DIM, lm.DIM))
    return model


def naive(model, pairs):
    """log10 probability of the first ids and the end, one position at a time, in plain loops."""
    e, p, wq, wk, wv, wo, c, b = [x.astype(float) for x in model.parts()]
    end = model.n_ids
    targets = [*[f for f, _ in pairs], end]
    inputs = [e[f] + e[end + 1 + l] for f, l in [(end, end), *pairs]]
    total = 0.0
    for t in range(len(targets)):
        begin = t // lm.SCORED * lm.SCORED - lm.CONTEXT
        xs = [inputs[i] + p[i - begin] for i in range(max(0, begin), t + 1)]
        q = xs[-1] @ wq / lm.DIM**0.5
        a = np.exp([q @ (x @ wk) for x in xs])
        h = sum(w * (x @ wv) for w, x in zip(a / a.sum(), xs)) @ wo + xs[-1]
        z = h @ c.T + b
        total += (z[model.of[targets[t]]] - math.log(np.exp(z).sum())) / math.log(10) + model.inner[targets[t]]
    return total


def naive_rest(words, word, seg):
    """log10 P(rest of word | its first id) from the training words' counts, in plain loops."""
    kinds = [seg(w) for w in words]
    n_end = len(lm.decoder(RANKS).lengths)
    further = {}
    for s in kinds:
        for y in [*s[1:], n_end]:
            further[y] = further.get(y, 0) + 1
    counts = np.zeros(n_end + 1)
    for y, k in further.items():
        counts[y] = k
    of, size, share = lm.classes(counts, lm.SPELLED)
    pairs = [(x, y) for s in kinds for x, y in zip(s, [*s[1:], n_end])]
    p = 0.0
    ids = seg(word)
    for x, y in zip(ids, [*ids[1:], n_end]):
        own = [b for a, b in pairs if a == x]
        by_class = [of[b] for b in own]
        d = len(set(by_class))
        by = (by_class.count(of[y]) + d * size[of[y]] / size.sum()) / (len(own) + d) if own else size[of[y]] / size.sum()
        by *= share[y]
        p += math.log10((own.count(y) + len(set(own)) * by) / (len(own) + len(set(own))) if own else by)
    c = sum(n for w, n in words.items() if seg(w)[0] == ids[0])
    u = sum(seg(w)[0] == ids[0] for w in words)
    return math.log10((words[word] + u * 10**p) / (c + u)) if word in words else p + math.log10(u / (c + u) if c else 1)


def random_pairs(model, lengths):
    rng = random.Random(4)
    return [[(rng.randrange(model.n_ids), rng.randrange(model.n_ids)) for _ in range(n)] for n in lengths]


def score(model, texts, **options):
    flat = np.array([x for t in texts for x in t], np.int64).reshape(-1, 2)
    return lm.score_sequences(model, flat[:, 0], flat[:, 1], np.cumsum([0, *map(len, texts)]), **options)


def test_batches_score_each_word_once():
    model = tiny_model()
    texts = random_pairs(model, (0, 1, 15, 16, 17, 100))
    assert score(model, texts, at_once=3) == pytest.approx([naive(model, t) for t in texts], rel=1e-4)


def test_probabilities_of_what_comes_first_sum_to_one():
    model = tiny_model()
    e, p, wq, wk, wv, wo, c, b = [x.astype(float) for x in model.parts()]
    x = e[model.n_ids] + e[2 * model.n_ids + 1] + p[lm.CONTEXT]
    z = (x @ wv @ wo + x) @ c.T + b
    z = z - math.log(np.exp(z).sum())
    each = [10 ** (z[model.of[i]] / math.log(10) + model.inner[i]) for i in range(model.n_ids + 1)]
    assert sum(each) == pytest.approx(1) and 10 ** score(model, [[]])[0] == pytest.approx(each[-1], rel=1e-4)


def test_overflow_takes_the_bounded_way():
    model = tiny_model()
    model.rows[-lm.CLASSES - lm.CLASSES // lm.DIM : -lm.CLASSES // lm.DIM] *= 500
    assert np.isfinite(score(model, random_pairs(model, (30,)))).all()


def test_gradient_of_a_step():
    model = tiny_model()
    rng = np.random.default_rng(3)
    (pairs,) = random_pairs(model, (40,))
    first, last = np.array(pairs).T
    inputs, targets, cuts = lm.shifted(model.n_ids, first, last, np.array([0, 40]))
    at, there = lm.positions(*lm.blocks(cuts))

    def loss(m):
        z = lm._forward(m, inputs[at], there)[-1].astype(float)
        own = there[:, lm.CONTEXT :]
        t = m.of[targets[at[:, lm.CONTEXT :]]]
        picked = np.take_along_axis(z, t[:, :, None], 2)[:, :, 0]
        return (np.log(np.exp(z).sum(axis=2)) - picked)[own].mean()

    trainer = lm.Trainer(model, rate=1e-3)
    trainer.square[:] = 1
    before = trainer.model.rows.copy()
    g = {}
    trainer.step(inputs[at], there, targets[at[:, lm.CONTEXT :]])
    scale = np.sqrt(trainer.square)[:, None]
    moved = (before - trainer.model.rows) / 1e-3 * scale
    e = 2 * (model.n_ids + 1)
    for row in [*first[:3], model.n_ids + 1 + last[0], e + lm.CONTEXT, e + lm.SPAN + 2, e + lm.SPAN + lm.DIM + 1, e + lm.SPAN + 2 * lm.DIM, e + lm.SPAN + 3 * lm.DIM + 5, len(model.rows) - 3, int(e + lm.SPAN + 4 * lm.DIM + model.of[targets[0]])]:
        up, down = (replace(model, rows=model.rows.copy()) for _ in range(2))
        up.rows[row, 3] += 1e-2
        down.rows[row, 3] -= 1e-2
        slope = (loss(up) - loss(down)) / 2e-2
        assert moved[row, 3] == pytest.approx(slope, rel=0.08, abs=2e-4), row


def test_every_word_is_a_target_once():
    model = tiny_model()
    texts = random_pairs(model, (0, 3, 500, 16))
    trainer = lm.Trainer(model)
    lm.train_on(trainer, np.array([x for t in texts for x in t]), np.cumsum([0, *map(len, texts)]))
    assert trainer.seen[-1] == sum(map(len, texts)) + len(texts)


def test_lm_score_is_brute_force(spark, monkeypatch):
    kept = {}
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: kept.setdefault("model", train(*a)))
    monkeypatch.setattr(lm, "HOT_WORDS", 40)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60 and n_chars < 1500").select("doc_id", "text", F.lit("x").alias("score"), F.lit(1).alias("n"))
    docs = docs.unionByName(spark.createDataFrame([(900, None, "x", 1), (901, "", "x", 1), (None, "the The", "x", 1), (901, "", "x", 1), (902, "zzzz " * 3000, "x", 1), (903, "w" * 200 + " the " + "w" * 200, "x", 1)], "doc_id long, text string, score string, n int"))
    learn = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    got = lm.lm_score(docs, learn, RANKS, PATTERN, keep=("n",)).collect()
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    counts = {}
    for d, w in rows:
        if d is None or d % 3:
            for x in [*w, None]:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), len(w) + 1, sum(x in counts for x in [*w, None]), n, round(sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in [*w, None]), 4)) for d, w in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want

    seen = {}

    def seg(w):
        if w not in seen:
            seen[w] = lm.encoding(RANKS, PATTERN).encode_ordinary(" " + w.decode())
        return seen[w]

    known = {w: k for w, k in counts.items() if w is not None}
    by_id = {r.doc_id: r.score for r in got}
    for d, w in rows:
        if d in (3, 4, 900, None, 903, 6, 7):
            total = naive(kept["model"], [(seg(x)[0], seg(x)[-1]) for x in w]) + sum(naive_rest(known, x, seg) for x in w)
            assert by_id[d] == pytest.approx(total, rel=1e-3), d


def test_lm_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (None, None, "x")], "doc_id long, text string, score string")
    empty = lm.lm_score(docs, F.lit(False), RANKS, PATTERN).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in empty)
    assert lm.lm_score(docs.limit(0), F.lit(True), RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError):
        lm.lm_score(docs, F.lit(True), RANKS, PATTERN, keep=("score",))


def test_partitions_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_WORDS", 20_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    scores = []
    for n in (1, 8):
        out = lm.lm_score(docs.repartition(n), F.col("doc_id") % 7 != 2, RANKS, PATTERN)
        scores.append({r.doc_id: r.score for r in out.collect()})
    assert scores[0] == pytest.approx(scores[1], rel=1e-6)


def test_held_out_text_scores_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", (id_crc(F.col("doc_id")) % 7 == 2).alias("held_out"))
    sums = lm.lm_score(docs, ~F.col("held_out"), RANKS, PATTERN, keep=("held_out",)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


def test_words_are_split_and_encoded_as_one_by_one():
    """Distinct words of all texts, encoded together, are those of words_of, each encoded after a space; odd white space too."""
    texts = ["A b\x85 c", "\xa0x y  z ", "", " ", None, "\t q\x1c r  Sİ it's 'll a'  b", "x   1 22! é́ 日本 \x00a", "plain words only here " * 400]
    words, distinct, stops = lm.split_words(pa.array(texts))
    distinct = distinct.to_pylist()
    assert len(set(distinct)) == len(distinct)
    assert [[distinct[i].encode() for i in words[a:b]] for a, b in zip(stops[:-1], stops[1:])] == [lm.words_of(t) for t in texts]
    coder = lm.encoding(RANKS, PATTERN)
    for some in (distinct, [w for w in distinct if w.isascii() and len(w.split()) == 1], []):
        ids, cuts = lm.encode_words(coder, some)
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [coder.encode_ordinary(" " + w) for w in some]


class Shared:
    def __init__(self, value):
        self.value = value


def test_words_of_a_batch_are_looked_up_once_and_parts_change_nothing(monkeypatch):
    """Before, every million bytes of a batch looked its words up anew."""
    rng = random.Random(5)
    words = [f"word{i}é" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=n)) for n in (0, 1, 700, 50_000, 40_000, 60_000, 3)] + [None, " tail "]
    assert 1_200_000 < sum(len((t or "").encode()) for t in texts) < lm.LOOKED_UP
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(len(texts)))), pa.array(texts)], names=["id", "text"])
    asked, look_up = [], lm.WordTable.look_up
    monkeypatch.setattr(lm.WordTable, "look_up", lambda table, some: asked.extend(some) or look_up(table, some))
    n = len(lm.decoder(RANKS).lengths)
    model = lm.new_model(np.ones(n + 1))
    spelled = lm.Spelling(np.ones(n + 1), np.ones(n + 1), np.zeros(n + 1, np.int64), np.full(n + 1, -5.0), np.full((n + 1, lm.SPELLED), -2, np.float16), np.zeros(0, np.int64), np.zeros(0, np.float32), np.ones(n + 1))
    hot = {w.encode(): i for i, w in enumerate(words[:100])}, np.append(np.linspace(-4, -3, 100), 0), np.append(np.linspace(-2, -1, 100), 0)

    def both():
        encoded = [r for out in lm._encode(RANKS, PATTERN)(iter([batch])) for r in out.to_pylist()]
        scored = [r for out in lm._score(Shared((model, spelled)), Shared((hot, -3.0, 1)), RANKS, PATTERN, 1)(iter([batch])) for r in out.to_pylist()]
        counts = {r["word"]: r["n"] for r in encoded if r["data"] is None}
        return counts, [r["data"] for r in encoded if r["data"] is not None], scored

    whole = both()
    assert len(asked) == 2 * len({w for t in texts for w in lm.words_of(t)})
    assert whole[0] == {**{w: sum((t or "").split().count(w) for t in texts) for w in [*words, "tail"]}, None: len(texts)}
    monkeypatch.setattr(lm, "LOOKED_UP", 1)
    monkeypatch.setattr(lm, "SCORED_WORDS", 1)
    parts = both()
    assert parts[:2] == whole[:2]
    for one, other in zip(whole[2], parts[2], strict=True):
        order = lambda r: sorted(r["cold"], key=lambda c: c["word"])
        assert order(one) == order(other) and (one["id"], one["n_tokens"], one["hot_known"]) == (other["id"], other["n_tokens"], other["hot_known"])
        assert (one["hot_sum"], one["hot_score"]) == pytest.approx((other["hot_sum"], other["hot_score"]), rel=1e-6)


def test_words_as_bytes_are_encoded_like_text():
    coder = lm.encoding(RANKS, PATTERN)
    for words in (["plain", "wörter", "日本", "it's"], ["a\x85c", "\xa0x", "1\x1c2"]):
        for one, other in zip(lm.encode_words(coder, words), lm.encode_words(coder, [w.encode() for w in words])):
            assert one.tolist() == other.tolist()


def test_a_step_with_large_exponents_has_the_exact_gradient():
    """Logits of a class near 80, which the cut at 60 would change, and beyond what a float holds."""
    model = tiny_model()
    (pairs,) = random_pairs(model, (40,))
    first, last = np.array(pairs).T
    inputs, targets, cuts = lm.shifted(model.n_ids, first, last, np.array([0, 40]))
    at, there = lm.positions(*lm.blocks(cuts))
    own = there[:, lm.CONTEXT :]
    for bias in (80, 200):
        model.rows[-lm.CLASSES // lm.DIM :] = 0
        model.rows[-lm.CLASSES // lm.DIM :].reshape(-1)[:2] = bias, bias - 1
        z = lm._forward(model, inputs[at], there, cut=bias > 88)[-1].astype(float)
        p = np.exp(z - z.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        wanted = np.eye(lm.CLASSES)[model.of[targets[at[:, lm.CONTEXT :]]]]
        slopes = (p - wanted)[own].mean(axis=0)
        trainer = lm.Trainer(model, rate=1)
        trainer.square[:] = 1
        trainer.step(inputs[at], there, targets[at[:, lm.CONTEXT :]])
        moved = (model.rows - trainer.model.rows) * np.sqrt(trainer.square)[:, None]
        assert np.isfinite(trainer.model.rows).all()
        assert moved[-lm.CLASSES // lm.DIM :].reshape(-1) == pytest.approx(slopes, abs=1e-4 if bias < 88 else 1e-3), bias
