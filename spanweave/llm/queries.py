"""Registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, dedup, jaccard, langid, licenses, lm, mixing, substrings, topk, warc
from .common import id_crc, read


def tokenizer_files() -> tuple[str, str]:
    """Rank file and pattern of the public tokenizer that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.scaled(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(rows, F.col("vec_id") % 20 == 0, 20)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer_files()
    coded = bpe.bpe_encode(read(spark, sf_dir, "documents"), ranks, pattern, decoded=True)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard_join(read(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = id_crc(F.col("doc_id")) % 4 == 2
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.page_captures(read(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return out.select("record_id", "canonical_url", "status", "ref_id", F.array_join(lines, "; ").alias("headers"), F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer_files()
    held_out = id_crc(F.col("doc_id")) % 7 == 2
    docs = read(spark, sf_dir, "documents").withColumn("held_out", held_out)
    return lm.lm_score(docs, ~F.col("held_out"), ranks, pattern, keep=("held_out",))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.drop_repeats(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(licenses.document_files(read(spark, sf_dir, "documents")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.systematic_mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def _licenses_sql() -> str:
    quoted = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(licenses.TEMPLATES))
    return rf"""
        WITH t(template, name, text) AS (VALUES {quoted}),
        f AS (SELECT doc_id, text, coalesce(source, 'none') || '/p' || (doc_id // 500) || CASE WHEN doc_id % 25 = 0 THEN '' ELSE '/m' || ((doc_id // 50) % 10) END || '/'
                     || CASE WHEN doc_id % 25 = 0 THEN 'LICENSE.' || doc_id ELSE 'f' || doc_id || '.txt' END AS path FROM documents),
        tw AS (SELECT template, name, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM t),
        v AS (SELECT DISTINCT word FROM tw),
        total AS (SELECT count(*) AS n FROM documents),
        dw AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM f),
        idf AS (SELECT v.word, ln((1 + (SELECT n FROM total)) / (1 + count(dw.doc_id))) + 1 AS idf FROM v LEFT JOIN dw ON dw.word = v.word GROUP BY v.word),
        tx AS (SELECT template, name, word, count(*) * any_value(idf) AS x FROM tw JOIN idf USING (word) GROUP BY ALL),
        tn AS (SELECT template, name, word, x / sqrt(sum(x * x) OVER (PARTITION BY template)) AS weight FROM tx),
        u AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM f UNION ALL SELECT doc_id, text FROM f WHERE doc_id % 25 = 0)),
        uw AS (SELECT doc_id, line, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS word FROM u),
        ux AS (SELECT doc_id, line, word, count(*) * coalesce(any_value(idf), ln(1 + (SELECT n FROM total)) + 1) AS x FROM uw LEFT JOIN idf USING (word) GROUP BY ALL),
        un AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY doc_id, line)) AS norm FROM ux),
        c AS (SELECT doc_id, line, template, name, round(sum(x * weight) / any_value(norm), 6) AS score FROM un JOIN tn USING (word) GROUP BY ALL),
        o AS (SELECT doc_id, name AS own_license, score AS own_score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name, template) AS k FROM c WHERE score >= {licenses.THRESHOLD}) WHERE k = 1),
        n AS (SELECT f.doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, own_license, own_score FROM f LEFT JOIN o ON o.doc_id = f.doc_id),
        g AS (SELECT dir, path, own_license FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path) AS k FROM n WHERE doc_id % 25 = 0 AND own_license IS NOT NULL) WHERE k = 1),
        i AS (SELECT n.doc_id, max(struct_pack(l := length(g.dir), license := g.own_license, path := g.path)) AS g FROM n JOIN g ON n.dir = g.dir OR starts_with(n.dir, g.dir || '/') GROUP BY n.doc_id)
        SELECT n.doc_id, path, own_license, own_score, coalesce(own_license, i.g.license) AS license, CASE WHEN own_license IS NOT NULL THEN path ELSE i.g.path END AS license_path
        FROM n LEFT JOIN i ON i.doc_id = n.doc_id"""


QUERIES = {f.__name__: f for f in (op1_topk, op2_bpe, op3_jaccard, op4_langid, op5_exact_dedup, op6_warc, op7_lm, op8_substrings, op9_licenses, op10_mixing)}

SQL = {
    "op1_topk": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
                  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM pairs)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 20""",
    "op3_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        class AS (SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS class_id FROM documents)
        SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links FROM class""",
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
               row_number() OVER (PARTITION BY s ORDER BY doc_id DESC) = 1 AS kept, s AS text_sha256 FROM d""",
    "op6_warc": r"""
        WITH p AS (SELECT *, 1700000000 + page_id * 60 AS taken_at, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS etag, 't' || (1700000000 - page_id * 3600) AS modified,
                          (page_id // 2) % 4 AS turn, regexp_replace(url, '#.*$', '') AS bare FROM pages),
        r AS (SELECT page_id * 2 AS record_id, false AS again, url, taken_at AS date, etag, modified, html FROM p
              UNION ALL SELECT page_id * 2 + 1, true, CASE WHEN starts_with(bare, 'https:') THEN regexp_replace(bare, '^https:', 'http:') ELSE regexp_replace(bare, '^http:', 'https:') END
                               || CASE WHEN contains(bare, '?') THEN '&' ELSE '?' END || 'utm_source=again', taken_at + 604800,
                               CASE turn WHEN 0 THEN 'W/' || etag WHEN 3 THEN '"stale"' END, CASE turn WHEN 1 THEN modified END, NULL FROM p WHERE page_id % 2 = 0),
        b AS (SELECT *, regexp_replace(url, '#.*$', '') AS u FROM r),
        c AS (SELECT *, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?]*)([^?]*)\??(.*)$', 1) AS host, regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?]*)([^?]*)\??(.*)$', 2), '/+$', '') AS path,
                     list_sort(list_filter(string_split(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?]*)([^?]*)\??(.*)$', 3), '&'), lambda x: x <> '' AND lower(regexp_replace(x, '=.*$', '')) NOT IN
                       ('fbclid', 'gclid', 'ref', 'sessionid', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'))) AS q FROM b),
        k AS (SELECT *, regexp_replace(regexp_replace(lower(host), '^www[0-9]*\.', ''), ':(80|443)$', '') || CASE WHEN path = '' THEN '/' ELSE path END
                     || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS canonical_url FROM c),
        j AS (SELECT a.*, (SELECT max(struct_pack(d := f.date, i := f.record_id)) FROM k f WHERE NOT f.again AND f.canonical_url = a.canonical_url
                           AND (f.date < a.date OR f.date = a.date AND f.record_id < a.record_id)).i AS ref FROM k a WHERE again),
        s AS (SELECT j.*, f.html AS body, f.etag AS e, f.modified AS m, f.date AS d,
                     CASE WHEN ref IS NULL THEN 'orphan' WHEN j.etag IS NOT NULL THEN CASE WHEN regexp_replace(j.etag, '^W/', '') = f.etag THEN 'resolved' ELSE 'mismatch' END
                          WHEN j.modified IS NOT NULL THEN CASE WHEN j.modified = f.modified THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS status
              FROM j LEFT JOIN k f ON f.record_id = j.ref)
        SELECT record_id, canonical_url, 'response' AS status, CAST(NULL AS BIGINT) AS ref_id,
               'content-length: ' || octet_length(encode(coalesce(html, ''))) || '; content-type: text/html; date: t' || date || '; etag: ' || etag || '; last-modified: ' || modified AS headers,
               sha256(html) AS body_sha256 FROM k WHERE NOT again
        UNION ALL SELECT record_id, canonical_url, status, ref, CASE WHEN status IN ('resolved', 'unverified')
               THEN 'content-length: ' || octet_length(encode(coalesce(body, ''))) || '; content-type: text/html; date: t' || date || '; etag: ' || coalesce(etag, e) || '; expires: t' || (date + 60) || '; last-modified: ' || coalesce(modified, m)
               ELSE 'content-length: 0; date: t' || date || coalesce('; etag: ' || etag, '') || '; expires: t' || (date + 60) || coalesce('; last-modified: ' || modified, '') END,
               CASE WHEN status IN ('resolved', 'unverified') THEN sha256(body) END FROM s""",
    "op8_substrings": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35),
        h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM s),
        r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
        gone AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
        k AS (SELECT w.doc_id, len(w) AS n, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(gone, j)) END AS kept
              FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id)
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op10_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                          CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM documents),
        c AS (SELECT *, length(bin(size)) * 16 + (size >> CAST(greatest(length(bin(size)) - 4, 0) AS INTEGER)) AS class FROM d),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM c GROUP BY source),
        w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight, source_size * 3 AS cap FROM s),
        f AS (SELECT *, (CAST(SUM(source_size) OVER () - coalesce(SUM(cap) OVER o1, 0) AS DOUBLE) / CAST(SUM(weight) OVER o2 AS DOUBLE)) AS level
              FROM w WINDOW o1 AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                            o2 AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        l AS (SELECT level FROM f WHERE CAST(cap AS DOUBLE) > level * CAST(weight AS DOUBLE) ORDER BY cap / weight, source NULLS LAST LIMIT 1),
        t AS (SELECT source, source_size, CASE WHEN CAST(cap AS DOUBLE) > (SELECT level FROM l) * CAST(weight AS DOUBLE)
                     THEN (SELECT level FROM l) * CAST(weight AS DOUBLE) ELSE CAST(cap AS DOUBLE) END AS target,
                     CAST(CAST('0x' || substr(md5('mix-1' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM f),
        r AS (SELECT doc_id, c.source, size, source_size, target, u, coalesce(target / nullif(CAST(source_size AS DOUBLE), 0.0), 0.0) AS each,
                     row_number() OVER (PARTITION BY c.source ORDER BY class DESC, h, doc_id NULLS FIRST, size) AS k
              FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, CAST(floor(k * each + u) - floor((k - 1) * each + u) AS BIGINT) * size AS taken, source,
               CAST(floor(k * each + u) - floor((k - 1) * each + u) AS BIGINT) AS copies FROM r""",
}
SQL["op9_licenses"] = _licenses_sql()
