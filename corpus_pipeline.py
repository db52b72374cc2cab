"""A corpus from documents: quality, language, exact and near duplicates, packing. Part of the subpackage llm.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept and returns a DataFrame; all but the
last return the columns of documents. A stage's result is written as Parquet and read again as the next one's docs, in
small batches of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.llm import exact_dedup, language_id, near_dedup, packing, quality
from isoweave.llm.common import small_reads, table, unused, written
from isoweave.llm.tokenizers import public_path

#: A predicted language needs this score; documents below it, or without a letter, go.
LEAST_LANGUAGE_SCORE = 0.4


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of quality 0.5 and more; those without a word, null texts among them, go.

    Repeated rows are judged alike. An empty table stays empty; without usable labels all documents with a word stay.
    """
    small_reads(spark)
    model, name = quality.train(docs, table(spark, sf_dir, "labels")), unused(docs, "_scores")
    return quality.scored(docs, model, name=name).where(F.col(f"{name}.quality") >= quality.THRESHOLD).drop(name)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with some certainty; null texts and those without a letter go.

    An empty table stays empty; where no row has a language to learn from, all documents go.
    """
    small_reads(spark)
    name = unused(docs, "_lang")
    found = language_id.with_language(docs, language_id.train(docs), name=name)
    return found.where((F.col(f"{name}.pred") != language_id.UNDETERMINED) & (F.col(f"{name}.score") >= LEAST_LANGUAGE_SCORE)).drop(name)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id, of equal ids among them one; a null text is an empty one."""
    small_reads(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the one with the least id.

    Texts without a word, rows without an id stay; an empty table stays empty.
    """
    small_reads(spark)
    return near_dedup.drop_near_duplicates(docs, k=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids; a null or empty text is its end id alone, an empty table gives no pieces."""
    small_reads(spark)
    return packing.pack(docs, public_path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_stage), ("language ID", language_stage), ("exact dedup", exact_stage), ("MinHash near-dedup", near_stage), ("packing", packing_stage)]

#: SQL can express neither the classifiers nor MinHash; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
