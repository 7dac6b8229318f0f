"""The operators' queries over the given tables, with their SQL where SQL can say it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.llm.oracle import ORACLE  # noqa: F401

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_winnowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reqlens.llm.linededup import repeated_runs
    spans = F.array_join(F.transform("deleted", lambda s: F.concat_ws(
        ":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return repeated_runs(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "deleted_lines", "deleted_words", spans.alias("deleted"))


@query
def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reqlens.llm.secrets import KINDS, listed, scan_secrets
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"), "n_live", "n_copied")


@query
def op3_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reqlens.llm.mixing import mix_documents
    return mix_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query
def op4_ngram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reqlens.llm.decontaminate import decontaminate
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op5_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reqlens.llm.quality import quality
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@query
def op6_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reqlens.llm.tokencounts import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"))


@query
def op7_toxic_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reqlens.llm.toxicity import held_out, score, train, training_rows, Toxicity
    docs = table(spark, sf_dir, "documents")
    model = train(training_rows(docs, table(spark, sf_dir, "labels"), Toxicity()))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_spans", "spans")


@query
def op8_pii_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reqlens.llm.pii import Pii, find_pii, labelled_table, train
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, train(labelled_table(docs, Pii())))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op9_minhash_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reqlens.llm.neardup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept")


@query
def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reqlens.llm.tokenbinary import token_shards
    return token_shards(table(spark, sf_dir, "documents"))


@query
def op11_nested_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reqlens.llm.manifest import joined_digest, manifest
    return manifest(table(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", joined_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


@query
def op12_block_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reqlens.llm.whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_switched_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reqlens.llm.langid import held_out, identify, train, training_rows
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(training_rows(docs))).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words", "segments")
