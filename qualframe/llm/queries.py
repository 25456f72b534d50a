"""One query for each operator over its whole table: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualframe.llm import (
    bytebpe,
    chat,
    hostrules,
    licenses,
    merkle,
    pcatiles,
    probminhash,
    resample,
    ring,
    scratch,
    spelling,
    tokenfile,
    toxicity,
    winnow,
)

MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"
BPE_JSON = "byte_bpe_50k.json"
SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    chats = chat.format_chats(rows.union(planted))
    line = lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))
    return chats.withColumn("loss", chat.under_mask(F.col("formatted"), F.col("spans"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return resample.resample(docs, good)


def op3_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return probminhash.near_duplicates(docs).drop("text_hash")


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = winnow.overlaps(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def multi_tokenizer() -> str:
    ranks = bytebpe.read_ranks(public_tokenizers.path(MULTI_RANKS))
    return bytebpe.tokenizer_json(ranks, public_tokenizers.PATTERN)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode_documents(table(spark, sf_dir, "documents"), multi_tokenizer(), ids=False)


def remainder():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").filter(remainder() != 1).select("doc_id", "toxic")
    return toxicity.train(docs.select("doc_id", "text", "lang"), labels)


def op6_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity_model(spark, docs, sf_dir)
    scored = toxicity.score_documents(docs, model, ["doc_id", "lang"])
    return scored.select(
        "doc_id",
        (remainder() == 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.COMMON_THRESHOLD).cast("int").alias("predicted"),
        (F.col("score") >= toxicity.threshold_of(model)).alias("over_language_threshold"),
    )


def op7_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")
    )
    placed = ring.shard_rows(docs, "doc_id", ["text_crc32", "size"], SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    confirmed = F.filter("spans", lambda s: s.license.isNotNull())
    differing = F.filter(confirmed, lambda s: F.size(s.differences) > 0)
    wording = F.transform(differing, lambda s: F.concat(s.license, F.lit(": "), F.array_join(s.differences, " ")))
    return found.select(
        "doc_id",
        "n_blocks",
        "n_confirmed",
        "licenses",
        F.array_max(F.transform("spans", lambda s: s.reduction)).alias("best_reduction"),
        F.array_join(F.transform(confirmed, lambda s: F.format_string("%.4f", s.reduction)), ",").alias("reductions"),
        F.array_join(F.array_sort(F.array_distinct(wording)), "; ").alias("differences"),
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(BPE_JSON), encoding="utf-8") as lines:
        description = lines.read()
    folder = scratch.new_path(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), description, folder, specials=True)
    return tokenfile.read_tokens(spark, folder, ids=False)


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = hostrules.measure(docs)
    slim = measured.withColumn("row", F.struct("row.doc_id", "row.source"))
    return hostrules.judge(scratch.store(slim, "measured")).select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    leaf = lambda n_chars: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    rows = docs.select(
        "doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(altered, leaf(F.col("n_chars") + 1)).alias("altered")
    )
    manifest = merkle.build_manifest(rows, "lang", ["doc_id"], "leaf")
    leaves = manifest.leaves.select("g", "rank", "leaf", "row.doc_id", "row.altered")
    proofs = merkle.prove(manifest, leaves).drop("leaf")
    root = manifest.top.roots.select(F.col("digest").alias("root"))
    subroots = manifest.trees.roots.select("g", F.col("digest").alias("subroot"))
    found = leaves.join(proofs, ["g", "rank"]).join(scratch.small(subroots), "g").join(F.broadcast(root))
    folded = merkle.fold(F.coalesce("altered", "leaf"), F.col("proof"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"), drop_every=199)


def op13_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pcatiles.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_importance_resampling,
        op3_probminhash,
        op4_winnowing,
        op5_byte_bpe,
        op6_toxicity_cnn,
        op7_bounded_ring,
        op8_license_scan,
        op9_token_files,
        op10_host_rules,
        op11_merkle_manifest,
        op12_spelling_variants,
        op13_pca_tiles,
    )
}
