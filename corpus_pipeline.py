"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a
DataFrame that is written and read again before the next. All but the last return the columns of documents.

Rows are documents whatever their doc_id: a row with a null doc_id is judged by its text alone, and is never a copy of
another; rows of one doc_id go or stay together where a doc_id is what decides. Null and empty texts are kept by every
stage and packed as an end id. An empty table passes as one. Columns beside doc_id and text are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerwright.llm import op2_decontaminate, op4_packing, op6_toxicity, op8_pii, op9_minhash
from ledgerwright.llm.session import drop, durable
from ledgerwright.llm.tokens import vocabulary_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer, fitted on all labels, does not call toxic (score below 0.5). Equal texts go or stay alike;
    without labels of both kinds, or without texts, every document has the share of toxic labels as its score."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return op6_toxicity.drop_toxic(docs, op6_toxicity.fit(docs, labels), least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies: five words, similarity 0.8. Texts
    without words are copies of nothing."""
    return op9_minhash.keep_first(docs, similarity=(80, 100), words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that aligns with half of a benchmark item or more. Items that are null or have no words
    match nothing; of equal items each decides alike."""
    return op2_decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with selected spans replaced by their kind, and n_chars made to fit. Null texts stay null."""
    return op8_pii.redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' byte-level ids in sequences of at most 2048; of no document an id is lost."""
    return op4_packing.pack_documents(docs, vocabulary_path("byte_bpe_50k.json"), end_id=1, limits=op4_packing.Limits(2048, 64, 2048))


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packing),
]

#: SQL has no such models and alignments; tests hold every stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
            if kept is not None:
                drop(kept)  # the stage before; what follows reads the new table alone
            kept = docs
    return docs
