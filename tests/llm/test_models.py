import math
import zlib

import pytest

from spanweave.llm import langid
from spanweave.llm.queries import op4_langid

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = op4_langid(spark, SF).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "the end of the story", "en"), (5, "das ende der geschichte", "de"), (6, "x" * 300_000, None), (None, "the end of the story", "en"), (4, "the end of the story", "en")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(df)
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(df, model).collect()]
    assert got[:3] == [(1, "und"), (2, "und"), (3, "und")] and got[3] == (4, "en") and got[4] == (5, "de") and got[6] == (None, "en")
    assert langid.train(df.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0
    one = langid.train(df.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.identify(df, one).collect()} == {"und", "en"}


def naive_features(text):
    """Square-rooted counts of hashed byte 1-, 2- and 3-grams, one at a time, scaled to length one."""
    b = (" " + text.lower() + " ").encode("utf-8", "replace")
    wide = 1 << 32
    counts = {}
    for i in range(len(b)):
        grams = [b[i] * 0x27D4EB2F % wide]
        if i + 1 < len(b):
            grams.append((b[i] * 0x9E3779B1 + b[i + 1] * 0x85EBCA6B) % wide)
        if i + 2 < len(b):
            grams.append((grams[1] + b[i + 2] * 0xC2B2AE35) % wide)
        for g in grams:
            at = (((g ^ (g >> 15)) * 0x2C1B3C6D % wide) >> 12) % langid.DIM
            counts[at] = counts.get(at, 0) + 1
    length = sum(counts.values()) ** 0.5
    return {k: n**0.5 / length for k, n in counts.items()}


def naive_prediction(model, text):
    x = naive_features(text)
    margin = lambda w: sum(v * float(w[k]) for k, v in x.items()) + float(w[-1])
    best = max(range(len(model.families)), key=lambda i: margin(model.family_w[i]))
    family = model.families[best]
    langs = model.langs[family]
    wins, shares = [0] * len(langs), [0.0] * len(langs)
    for i, j, w in model.pairs[family]:
        d = margin(w)
        p = 1 / (1 + math.exp(-4 * d))
        wins[i if d >= 0 else j] += 1
        shares[i] += p
        shares[j] += 1 - p
    k = max(range(len(langs)), key=lambda i: (wins[i], shares[i], -i))
    others = [margin(w) for i, w in enumerate(model.family_w) if i != best]
    sure = 1 / (1 + math.exp(-2 * (margin(model.family_w[best]) - max(others)))) if others else 1.0
    return langs[k], sure * (shares[k] / (len(langs) - 1) if len(langs) > 1 else 1.0)


def test_predictions_are_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 3000")
    model = langid.train(docs.where("doc_id % 4 <> 1"))
    rows = docs.where("doc_id % 40 = 1 and text is not null")
    texts = {r.doc_id: r.text for r in rows.collect()}
    got = langid.identify(rows, model).where("lang_pred <> 'und'").collect()
    assert len(got) > 10
    for r in got:
        lang, score = naive_prediction(model, texts[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-3)


def test_a_third_of_null_ids_and_extra_columns(spark):
    rows = [(None if i % 3 else i, ("the cat sat on the mat %d" if i % 2 else "das haus steht am see %d") % i, "en" if i % 2 else "de", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.train(df, rows=60)
    assert sorted(model.langs) == ["germanic"] and model.langs["germanic"] == ["de", "en"]
    assert {(r.lang, r.lang_pred) for r in langid.identify(df.select("doc_id", "text", "lang"), model, keep=("doc_id", "lang")).collect()} == {("en", "en"), ("de", "de")}
