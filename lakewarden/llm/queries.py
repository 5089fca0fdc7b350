"""Queries that apply the operators of this subpackage, and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import (
    audit,
    bpe,
    embeddings,
    fingerprint,
    jaccard,
    language,
    lines,
    middle,
    mixing,
    packing,
    personal,
    substring,
    toxicity,
)
from lakewarden.llm.common import Scratch, held_out, table
from lakewarden.llm.oracle import ORACLE  # noqa: F401

TOKENIZER = "word_bpe_49k.json"
PACKED_TOKENIZER = "byte_bpe_50k.json"


def language_model(docs: DataFrame, **options) -> language.LanguageModel:
    return language.learn(docs, F.col("doc_id").isNotNull() & ~held_out(), **options)


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.identify(docs, language_model(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """As many tokens as the corpus has, no source more than four times, 95 % of the entropy of equal weights."""
    mixed = mixing.mix(table(spark, folder, "documents"), evenness=0.95, max_repetition=4.0, budget=1.0)
    return mixed.select(
        "doc_id", "source", "tokens", F.round(F.col("weight") * 1e9).cast("long").alias("weight_ppb"),
        "epoch", "offset", "block", "place",
    )


def op3_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, folder, "documents"))


def op4_substring(spark: SparkSession, folder: str) -> DataFrame:
    out = substring.deduplicate(table(spark, folder, "documents"), texts=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.deduplicate(table(spark, folder, "documents"), ["doc_id"], least_words=1, texts=False).drop("kept")


def op6_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


def op7_personal(spark: SparkSession, folder: str) -> DataFrame:
    found = personal.find(table(spark, folder, "documents"), ["doc_id"])
    base = F.filter("found", lambda s: s["kind"].isin(personal.BASE))
    counts = [personal.number(F.col("found"), kind).alias(f"n_{kind}") for kind in personal.BASE]
    return found.select(
        "doc_id", *counts, F.sha2(personal.joined(base), 256).alias("base_sha256"),
        personal.joined(F.col("found")).alias("spans"),
    )


def op8_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.groups(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), ["doc_id"])


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    usable = F.col("doc_id").isNotNull() & ~held_out()
    guess = language_model(docs, rows_per_language=None)
    # every text is read once for learning and scoring
    encoded = Scratch(spark, "toxicity").keep(toxicity.encode(docs, guess, ["doc_id"]), "encoded")
    model = toxicity.learn_encoded(encoded, table(spark, folder, "labels"), usable)
    found = toxicity.score_encoded(encoded, model, ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of 2048 tokens; the contract sets no limit on their documents or attention cost."""
    packed = packing.pack(table(spark, folder, "documents"), public_tokenizers.path(PACKED_TOKENIZER), ["doc_id"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(spark, f"{folder}/documents.parquet", table(spark, folder, "labels"))


def op13_middle(spark: SparkSession, folder: str) -> DataFrame:
    found = middle.transform(table(spark, folder, "documents"), ["doc_id"], outputs=False)
    return found.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        "output_sha256", "restored_sha256",
    )


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_language": op2_language,
    "op3_fingerprint": op3_fingerprint,
    "op4_substring": op4_substring,
    "op5_lines": op5_lines,
    "op6_embeddings": op6_embeddings,
    "op7_personal": op7_personal,
    "op8_jaccard": op8_jaccard,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_packing": op11_packing,
    "op12_audit": op12_audit,
    "op13_middle": op13_middle,
}
