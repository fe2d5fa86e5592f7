"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (
    bpe, decontamination, html_text, infill, langid, licences, ngram_join, pii, piece_bpe, quality, substring_dedup, turn_repair, warc,
)
from tillroll.llm.common import table
from tillroll.llm.counterparts import COUNTERPARTS
from tillroll.sources.staging import staging_path


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_text.extract(pages, html_text.learn_from(pages)).select("page_id", "url", "text", "n_chars")


def op2_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan(table(spark, folder, "documents")).select("doc_id", F.explode("licences").alias("hit"))
    return found.select("doc_id", "hit.unit", "hit.licence", "hit.dice")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.measure(table(spark, folder, "documents")).drop("rule")


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words", F.size("runs").alias("n_runs"))


def op5_pii_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, folder, "documents").select("doc_id", "text"))
    kinds = F.transform("found", lambda x: x["kind"])
    return found.select("doc_id", "text", F.size("found").alias("n_found"), *(
        (F.size("found") - F.size(F.array_remove(kinds, kind))).alias(f"n_{kind}") for kind in pii.KINDS))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = staging_path(spark, "warc")
    warc.write(table(spark, folder, "pages"), path)
    return warc.digest_rows(warc.captures(warc.read(spark, path)))


def op9_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicate_components(table(spark, folder, "documents"))


def op10_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    return bpe.decode(encoded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = infill.transform(table(spark, folder, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.report(table(spark, folder, "conversations"))


def op13_sentencepiece_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = piece_bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), path, decoded=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_html_extraction, op2_licence_scan, op3_quality_rules, op4_language_id, op5_pii_pseudonyms, op6_decontamination,
        op7_substring_dedup, op8_warc_round_trip, op9_ngram_jaccard_join, op10_bpe_round_trip,
        op11_fill_in_middle, op12_conversation_repair, op13_sentencepiece_round_trip)
}
ORACLES = dict(COUNTERPARTS)
