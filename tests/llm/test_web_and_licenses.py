import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spanweave.llm import licenses, warc

T0 = datetime(2024, 1, 1)


def test_canonical_url(spark):
    rows = [("HTTP://WWW.Example.com:80/a/b/?b=2&utm_source=x&a=1#frag", "example.com/a/b?a=1&b=2"), ("https://example.com", "example.com/"), ("https://example.com?REF=1", "example.com/"), ("no url", None), (None, None), ("", None)]
    df = spark.createDataFrame(rows, "u string, want string").select("want", warc.canonical_url(F.col("u")).alias("got"))
    assert [r.got for r in df.collect()] == [w for _, w in rows]


def test_urns_and_names_of_any_case(spark):
    rows = [("<urn:uuid:1>", "response", "http://a.org/x", T0, 200, {"ETag": '"a"', "Content-Type": "text/html", "etag": '"b"'}, "body"), ("<urn:uuid:2>", "revisit", "http://a.org/x", T0 + timedelta(days=1), 304, {"ETAG": 'W/"b"', "Expires": "new", "Set-Cookie": "no"}, None)]
    df = spark.createDataFrame(rows, "record_id string, warc_type string, url string, date timestamp, http_status int, headers map<string,string>, body string")
    got = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    again = got["<urn:uuid:2>"]
    assert (again.status, again.ref_id, again.body) == ("resolved", "<urn:uuid:1>", "body")
    assert again.headers == {"etag": 'W/"b"', "content-type": "text/html", "expires": "new"} and got["<urn:uuid:1>"].headers["etag"] == '"b"'


SCHEMA = "record_id long, warc_type string, url string, date timestamp, http_status int, headers map<string,string>, body string, ref string"


def test_as_of_is_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit", "response404"])
        url = rng.choice(["http://hot.org/", "http://hot.org/?utm_source=z", f"http://x{rng.randrange(6)}.org/p"])
        rows.append((i, "revisit" if kind == "revisit" else "response", url, T0 + timedelta(minutes=rng.randrange(900)), {"revisit": 304, "response": 200}.get(kind, 404), {"etag": f'"{rng.randrange(2)}"'}, f"b{i}", "x"))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    assert len(got) == len(rows)
    host = lambda u: u.split("/")[2]
    for r in rows:
        if r[1] != "revisit":
            assert got[r[0]].status == ("response" if r[4] == 200 else "other")
            continue
        earlier = [(x[3], x[0]) for x in rows if x[1] == "response" and x[4] == 200 and host(x[2]) == host(r[2]) and (x[3], x[0]) < (r[3], r[0])]
        ref = max(earlier)[1] if earlier else None
        assert got[r[0]].ref_id == ref
        want = "orphan" if ref is None else "resolved" if rows[ref][5] == r[5] else "mismatch"
        assert got[r[0]].status == want and got[r[0]].body == (rows[ref][6] if want == "resolved" else None)


def test_validators_headers_and_edges(spark):
    full = {"etag": '"a"', "last-modified": "m", "content-type": "text/html", "content-length": "9", "expires": "old"}
    rows = [
        (1, "response", "http://a.org/x", T0, 200, full, "body", "c"), (2, "revisit", "https://a.org/x", T0 + timedelta(days=9), 304, {"etag": 'W/"a"', "expires": "new", "content-length": "0", "set-cookie": "no"}, None, "c"),
        (3, "revisit", "http://a.org/x", T0, 304, {"last-modified": "m"}, None, "c"), (4, "revisit", "http://a.org/x", T0 + timedelta(1), 304, {"last-modified": "other"}, None, "c"), (5, "revisit", "http://a.org/x", T0 + timedelta(1), 304, None, None, "c"),
        (6, "revisit", None, T0, 304, {}, None, "c"), (7, "revisit", "http://a.org/x", None, 304, {}, None, "c"), (8, "response", "http://a.org/x", None, 200, None, "z" * 100_000, "c"), (9, None, None, None, None, None, None, "c"), (1, "response", "http://a.org/x", T0, 200, full, "body", "c"),
    ]
    got = {}
    for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.record_id, []).append(r)
    status = {k: v[0].status for k, v in got.items()}
    assert status == {1: "response", 2: "resolved", 3: "resolved", 4: "mismatch", 5: "unverified", 6: "orphan", 7: "orphan", 8: "response", 9: "other"} and len(got[1]) == 2
    assert got[2][0].headers == full | {"etag": 'W/"a"', "expires": "new"} and got[2][0].body == "body"
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signature_words_are_sound():
    words = licenses.vocabulary()
    rng = random.Random(2)
    idf = {w: rng.uniform(1, 6) for w in words}
    unit = licenses.weights(licenses.TEMPLATES, idf)
    sign = licenses.signature_words(unit, 0.75)
    for k in range(len(licenses.TEMPLATES)):
        own = {w: x for t, w, x in unit if t == k}
        assert math.isclose(sum(x * x for x in own.values()), 1)
        assert math.sqrt(sum(x * x for w, x in own.items() if w not in sign)) < 0.75


def test_licenses_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Some words.\nReleased under the MIT License."), (2, "a/b/c/file.txt", "plain text"), (3, "a/b/other.txt", "x\nLicensed under the Apache License, Version 2.0.\ny"),
        (4, "a/b/COPYING", licenses.TEMPLATES[5][1].replace(" of ", "\nof ")), (5, "z/file", None), (6, None, "Released under the MIT License."), (7, "ab/file", ""), (8, "root.txt", "word " * 50_000), (9, "a/b/c/d/e", "the license is a word"), (2, "a/b/c/file.txt", "plain text"), (None, "a/top", None),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, path string, text string, license string, rid int")
    out = licenses.scan_licenses(df).collect()
    got = {r.doc_id: (r.own_license, r.license, r.license_path) for r in out}
    assert len(out) == len(rows)
    assert got[1] == ("MIT", "MIT", "a/LICENSE") and got[2] == (None, "GPL-3.0", "a/b/COPYING") and got[3] == ("Apache-2.0", "Apache-2.0", "a/b/other.txt")
    assert got[4][0] == "GPL-3.0" and got[5] == (None, None, None) and got[6] == ("MIT", "MIT", None) and got[7] == (None, None, None) and got[8] == (None, None, None)
    assert got[9] == (None, "GPL-3.0", "a/b/COPYING") and got[None] == (None, "MIT", "a/LICENSE")
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_whole_licences(spark):
    texts = {name: f"Copyright (c) 2020 Somebody Else\n\n{text}" for name, text in licenses.WHOLE}
    rows = [(i, f"p{i}/LICENSE", text) for i, text in enumerate(texts.values())] + [(100, "q/LICENSE", "MIT License\n\n" + licenses.TEMPLATES[1][1]), (101, "r/x.c", "int x;"), (102, "p0/x.c", "int x;")]
    got = {r.doc_id: r.license for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts) and got[100] == "BSD-3-Clause" and got[101] is None and got[102] == "BSD-2-Clause"
