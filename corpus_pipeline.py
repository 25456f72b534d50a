"""The corpus pipeline: documents through quality rules, toxicity, near-dedup, decontamination and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qualframe.llm import bytebpe, hostrules, probminhash, queries, scratch, toxicity, winnow


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules on hosts that are not rejected."""
    return hostrules.quality_rules(docs).filter("kept").select("row.*")


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(spark, docs, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return probminhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return winnow.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)."""
    return bytebpe.encode_documents(docs, queries.multi_tokenizer())


STAGES = [
    ("quality_rules", quality),
    ("toxicity", nontoxic),
    ("near_dedup", distinct),
    ("decontamination", decontaminated),
    ("byte_bpe", tokens),
]

#: A trained classifier decides in the second stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result is written and read back before the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return scratch.store(stage(spark, docs, sf_dir), name)
