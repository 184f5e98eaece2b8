"""The corpus pipeline: documents through five of the training-data operators, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as Parquet in
the shared folder and read again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanweave.llm import bpe, dedup, jaccard, langid, mixing
from spanweave.llm.common import materialize, read
from spanweave.llm.queries import tokenizer_files


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (null or letterless texts); `lang` becomes what was predicted, null where unknown."""
    model = langid.train(docs)
    language = langid.language_of(model, spark)(F.col("text"))
    known = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), language["lang_pred"].alias("_lang")).where("_lang <> 'und'")
    return known.select(F.col("_row").withField("lang", F.col("_lang")).alias("_row")).select("_row.*")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the row with the largest doc_id stays."""
    return dedup.drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 or more by five-word shingles, the row with the smallest doc_id stays."""
    return jaccard.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as systematic sampling to the sources' target weights takes it: from never to three times."""
    return mixing.emit_mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and whether the ids decode to the text's bytes."""
    ranks, pattern = tokenizer_files()
    packed = docs.select(F.struct("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha")).alias("_row"), "text")
    back = bpe.bpe_encode(packed, ranks, pattern, id_col="_row", decoded=True)  # one Python worker for both ways
    return back.select("doc_id.doc_id", "doc_id.lang", "doc_id.source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.sha2("decoded", 256) == F.col("doc_id.sha")).alias("round_trip"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: Language ID and BPE are beyond SQL; tests hold the pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
