import base64

import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from spanweave.llm.bpe import bpe_decode, bpe_encode, codec
from spanweave.llm.queries import tokenizer_files

RANKS, PATTERN = tokenizer_files()


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text):
    ids, ends = codec(RANKS, PATTERN).encode([text])
    return ids.tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'!é’\x1cßa1sAt²_  ́漢"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_as_tiktoken(text):
    with open(RANKS, "rb") as f:
        global _enc
        try:
            _enc
        except NameError:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert ids_of(text) == _enc.encode_ordinary(text)


def test_documents(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    coded = bpe_encode(docs, RANKS, PATTERN, offsets=True, decoded=True)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in coded.collect():
        assert r.ids == reference.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded).decode() == texts[r.doc_id]
        assert len(r.starts) == len(r.ids) and (not r.ids or (r.starts[0] == 0 and r.ends[-1] == len(texts[r.doc_id])))
    for r in bpe_decode(coded, RANKS, PATTERN).collect():
        assert bytes(r.decoded).decode() == texts[r.doc_id]


def test_offsets_of_split_characters():
    coder = codec(RANKS, PATTERN)
    ids, ends = coder.encode(["a漢é", "", "漢"])
    starts, stops = coder.offsets(ids, ends)
    spans = list(zip(starts.tolist(), stops.tolist()))
    first = spans[: ends[1]]
    assert first[0] == (0, 1) and first[-1][1] == 3
    assert all(a < b for a, b in spans) and spans[ends[2]][0] == 0


def test_nulls_empty_and_special(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "<|endoftext|>", "x"), (3, "a" * 300_000, "x"), (3, "b  c", "x")], "doc_id long, text string, ids string")
    out = bpe_encode(rows, RANKS, PATTERN).collect()
    assert [len(r.ids) for r in out][:2] == [0, 0] and 50256 not in out[2].ids
    back = [bytes(r.decoded).decode() for r in bpe_decode(bpe_encode(rows, RANKS, PATTERN), RANKS, PATTERN).collect()]
    assert back == ["", "", "<|endoftext|>", "a" * 300_000, "b  c"]
    assert bpe_encode(rows.limit(0), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("pattern", [r"\p{L}+|\p{N}{1,3}|[^\p{L}\p{N}]", r"(?i:'s|'t)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"])
def test_other_patterns(pattern):
    with open(RANKS, "rb") as f:
        own = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    texts = ["abc 12345", "It's  a\n\ntest, of 1234567 things", "", "élan vital 漢字", "a " * 50]
    ids, ends = codec(RANKS, pattern).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [own.encode_ordinary(t) for t in texts]


def test_the_usual_pattern_is_the_public_one():
    from spanweave.llm import bpe

    assert bpe.PATTERN == PATTERN
