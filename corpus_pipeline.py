"""The corpus pipeline: language identification, near-duplicates, decontamination, secrets, mixing.

Every stage gets what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationwatch.llm import common, decontam, lang_id, mixing, near_dup, secrets

#: Documents whose language is less certain than this are rejected, as are those without a language.
LEAST_LANGUAGE_SCORE = 0.5


def _shielded(docs: DataFrame, names: tuple[str, ...], function: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``function`` keeps of ``docs``, with their own columns, those named like its results too."""
    own = {c: f"_own_{c}" for c in names if c in docs.columns}
    return function(docs.withColumnsRenamed(own)).select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language."""
    sure = (F.col("lang_pred") != lang_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return _shielded(docs, ("held_out", "lang_pred", "score"), lambda rows: lang_id.identify(rows).where(sure))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; of rows with one id, the one whose columns hash lowest.

    Rows without an id all stay.
    """
    gone = near_dup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns), "text"))
    nth = f"{max(docs.columns, key=len)}_"  # no column's name
    once = left.where("doc_id IS NOT NULL").withColumn(nth, first).where(F.col(nth) == 1).drop(nth)
    return once.unionByName(left.where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _shielded(docs, ("items",), lambda rows: decontam.decontaminate(rows, benchmark))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; ``n_chars`` follows the new text where there is one."""
    found = secrets.redact(docs)
    return (found.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else found).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture: ``block``, ``slot`` and ``offset``, in place of own columns of these names."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
]

#: The language model and the network aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = common.stage(function(spark, docs, sf_dir), name)
    return docs
