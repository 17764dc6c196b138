"""Corpus cleaning in five stages, each calling one operator of ``spanloom.llm``.

toxicity -> MinHash near-dedup -> suffix-array dedup -> benchmark
decontamination -> BPE encoding and decoding.  Every stage takes
(spark, docs, sf_dir), works on all rows its predecessor kept, and is written
as Parquet before the next one reads it.  All but the last return the columns
of ``documents``; the last returns a row per document that is left.

Cases: rows with null texts or ids pass the filters (they hold nothing to
reject); document ids are expected to be unique; empty tables stay empty; other columns
of ``documents``, whatever their names, pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, decontam, neardup, suffixdedup, toxicity
from spanloom.llm.common import drop, materialize, settle

#: similarity of 5-word shingles from which documents are near copies; op6 itself has its own
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    scored = toxicity.with_scores(docs, model)
    return scored.where(F.col(scored.columns[-1]) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates, and all others."""
    settle(spark)
    copies = neardup.link_components(docs, NEAR_PERCENT).where("NOT kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that an earlier one holds; ``n_chars`` follows."""
    out = suffixdedup.dedup_spans(docs, as_text=True)
    kept = out.columns[-1]
    text = F.when(F.col("text").isNotNull(), F.col(kept))
    new = {"text": text} | ({"n_chars": F.length(text).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold windows of fewer than two benchmark items."""
    hits = decontam.find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.where(F.size(hits.columns[-1]) < decontam.MIN_ITEMS).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of what is left."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: trained models and iterated joins: beyond SQL; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
            drop(before)  # nothing reads it any more
    return docs
