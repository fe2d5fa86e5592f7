"""A corpus pipeline: language, near copies, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, folder) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import bpe, decontamination, langid, ngram_join, pii
from tillroll.llm.common import staged, table

#: Documents whose best language gets less probability than this per word are rejected.
LEAST_SCORE = 0.3
KEY = pii.DEMO_KEY
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """docs without those that have no letters or fit no language; an unknown lang is filled in."""
    model = langid.learn(docs)
    rows = langid.identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    kept = rows.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(
        F.coalesce("row.lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """docs with the smallest doc_id of each group of near copies."""
    return ngram_join.keep_first(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """docs without those that contain an item of the benchmark."""
    return decontamination.remove_contaminated(docs, table(spark, folder, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """docs with personal data replaced by pseudonyms of the same format; n_chars follows a changed text."""
    rows = pii.pseudonymise(docs.select(F.struct(*docs.columns).alias("row"), "text"), KEY)
    size = F.when(F.size("found") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": size.alias("n_chars")}
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")) for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): token ids, and whether they decode to the text."""
    rows = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    decoded = bpe.encode(rows, VOCABULARY, decoded=True)
    return decoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_copies", near_copies), ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data), ("tokens", tokens),
]

#: Learned language scores, a keyed permutation and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
