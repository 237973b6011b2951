"""The contract queries opN_<name> and the pipeline: thin wrappers that derive the stated columns from the operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .chat import chat_digests, format_chats
from .common import bound_batches, id_crc, map_arrow, widened
from .decontaminate import items_digest, match_benchmark
from .divergence import divergence_audit
from .fingerprint import compare_with_next
from .langid import fit_languages, predict_languages
from .merkle import document_leaves, merkle_manifest
from .mixing import mix_sources
from .oracle import ORACLE  # noqa: F401
from .neardup import near_duplicates
from .secrets import findings_of, scan_secrets, spans_digest, spans_text, train
from .suffixdedup import remove_repeats
from .tokencount import count_tokens
from .toxicity import fit_toxicity, score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = match_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column("items_sha256", pa.array(items_digest(batch.column("items")), pa.string()))

    digested = map_arrow(matched.drop("text", "spans"), each, widened(matched.drop("text", "spans"), "items_sha256 string"))
    return digested.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    shortened = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return shortened.select("doc_id", "n_bytes", size("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), size("passages").alias("n_passage_words"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.pmod(id_crc(), F.lit(4)) == 2, F.lit(False))
    model = fit_languages(docs, ~held)
    return predict_languages(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_token", "first_block", "first_shard")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = scan_secrets(docs, train(findings_of(docs))).drop("text")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = batch.column("spans").to_pylist()
        counts = [pa.array([sum(s["kind"] == k for s in x) for x in spans], pa.int64()) for k in ("assign", "access", "hex")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(map(spans_digest, spans), pa.string()), pa.array(map(spans_text, spans), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = scanned.schema["doc_id"].dataType.simpleString()
    return map_arrow(scanned, each, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents")).drop("edited_text")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    return chat_digests(format_chats(turns.unionByName(more)))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, percent=85).drop("rkey")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.pmod(id_crc(), F.lit(5)) == 0, F.lit(False))
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held)
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return merkle_manifest(document_leaves(docs, F.coalesce(id_crc() % 3 == 0, F.lit(False))), proofs=False)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return encode_documents(table(spark, sf_dir, "documents"), path, digests=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_suffix_dedup, op3_language_id, op4_token_counts, op5_mixing, op6_secrets, op7_fingerprints, op8_chat, op9_near_dedup, op10_toxicity, op11_divergence, op12_merkle, op13_bpe)}
