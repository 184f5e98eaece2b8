import base64

import regex
import tiktoken
from .test_search_dedup_mix import LOWER, brute_targets
from .test_text_joins import brute_classes

import corpus_pipeline
from spanweave.llm import mixing
from spanweave.llm.queries import tokenizer_files


def test_pipeline_is_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [tuple(r) for r in docs] + [(9001, None, "en", "src1", 0), (9002, "12 !", "en", None, 4), (9003, (docs[0].text or "").upper(), "en", None, 1), (9004, docs[1].text + " more", "en", "src1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [r for r in rows if r[1] and regex.search(r"\p{L}", r[1])]
    best = {}
    for r in left:
        key = r[1].translate(LOWER)
        best[key] = max(best.get(key, r), r, key=lambda x: x[0])
    left = sorted(best.values())
    classes = {d: c for d, c, _, _ in brute_classes(left)}
    left = [r for r in left if classes[r[0]] == r[0]]
    df = spark.createDataFrame(left, "doc_id long, text string, lang string, source string, n_chars long")
    copies = {r.doc_id: r.copies for r in mixing.systematic_mix(df).collect()}
    want = sorted(r[0] for r in left for _ in range(copies[r[0]]))
    assert sorted(r.doc_id for r in got) == want

    ranks, pattern = tokenizer_files()
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    texts = {r[0]: r[1] for r in left}
    assert all(r.ids == coder.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip for r in got)
    sizes = {}
    for r in left:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].encode().split())
    assert brute_targets(sizes)


def test_stages_keep_columns_and_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, "", "en", "s", 0), (2, "the cat", "en", "s", 7), (2, "the cat", "en", "s", 7), (None, "das ende", "de", None, 8)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, "").columns == docs.columns, name
            stage(spark, rows, "").count()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, "").count() == rows.count()
    kept = corpus_pipeline.STAGES[0][1](spark, docs, "").collect()
    assert sorted(r.text for r in kept) == ["das ende", "the cat", "the cat"]


def test_stages_take_long_texts_and_clashing_columns(spark):
    long = "many words and more of them " * 20_000
    names = ["rid", "k1", "_row", "_id", "text_sha256", "component", "copies", "_source"]
    rows = [(1, long, "en", "s", 1), (2, long.upper(), "en", "s", 2), (3, "another text of few words", "en", None, 3), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns[5:] == names, name
        kept = docs.collect()
        if name in ("exact_dedup", "ngram_jaccard"):
            assert sorted(r.doc_id for r in kept) == [2, 3]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert all(r.round_trip for r in out) and {r.doc_id for r in out} <= {2, 3}
