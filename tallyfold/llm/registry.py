"""Queries of the corpus operators over the tables of a data folder, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import attribution, langid, licenses, media, packing, secrets, sql, toxicity
from tallyfold.llm.decontam import contamination
from tallyfold.llm.neardup import near_duplicates
from tallyfold.llm.shared import Scratch
from tallyfold.llm.tokenfiles import read_token_files, write_token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.learnable(_table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(_table(spark, sf_dir, "documents"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = media.store(_table(spark, sf_dir, "documents"), Scratch(spark, "op5").path("archives"))
    return media.digests(media.read_members(spark, archives))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_table(spark, sf_dir, "documents")).drop("text_hash", "found")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(0))  # a row without id is not held out
    model = langid.fit(docs.where((part != 1) & F.col("lang").isNotNull()))
    return langid.predict(docs, model).select("doc_id", (part == 1).alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "op10").path("files")
    write_token_files(_table(spark, sf_dir, "documents"), folder, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_minhash_neardup": op2_minhash_neardup,
        "op3_decontamination": op3_decontamination,
        "op4_token_counts": op4_token_counts,
        "op5_media": op5_media,
        "op6_secret_scan": op6_secret_scan,
        "op7_language_id": op7_language_id,
        "op8_packing": op8_packing,
        "op9_license_scan": op9_license_scan,
        "op10_token_files": op10_token_files,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash_neardup": sql.NEARDUP,
        "op3_decontamination": sql.DECONTAMINATION,
    }
