"""One query per operator of this subpackage over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, html_extract, language_id, near_dedup, packing, quality, sentencepiece_bpe, token_files, token_rollup
from .common import shared_dir, table, text_batches, written
from .tokenizers import byte_level, public_path, word_level


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), with_ids=False)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.sentencepiece_round_trip(table(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"), digests=True)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))
    return token_files.token_file_digests(spark, manifest)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def _counted(docs: DataFrame, byte_path: str, word_path: str) -> DataFrame:
    """(source, lang, n_words, n_byte, n_word) of every document, counted by whole texts."""
    text_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            byte, word = byte_level(byte_path), word_level(word_path)
            counts = [[len(t.split()) for t in texts], [len(byte(t)) // 4 for t in texts], [len(word(t)) // 4 for t in texts]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts)], ["source", "lang", "n_words", "n_byte", "n_word"])

    return docs.select("source", "lang", "text").mapInArrow(run, "source string, lang string, n_words long, n_byte long, n_word long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after five batches: words on arrival, revised to byte-level counts, then another tokenizer beside them,
    whose counts are deleted and inserted again.

    The third batch is committed twice, as after a lost acknowledgement; the first four are folded into one.
    """
    counts = written(_counted(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")), "token-counts")
    none_s, none_l = F.lit(None).cast("string"), F.lit(None).cast("long")

    def batch(op, version, tokens, old_version=none_s, old_tokens=none_l):
        return counts.select("source", "lang", F.lit(op).alias("op"), F.lit(version).cast("string").alias("version"), (F.col(tokens) if tokens else none_l).alias("tokens"), old_version.alias("old_version"), old_tokens.alias("old_tokens"))

    folder = shared_dir(spark, "token-rollup")
    token_rollup.commit(batch("insert", "words", "n_words"), folder, 0)
    token_rollup.commit(batch("revise", "byte_bpe_50k", "n_byte", F.lit("words"), F.col("n_words")), folder, 1)
    for _ in range(2):
        token_rollup.commit(batch("insert", "word_bpe_49k", "n_word"), folder, 2)
    token_rollup.commit(batch("delete", None, None, F.lit("word_bpe_49k"), F.col("n_word")), folder, 3)
    token_rollup.compact(spark, folder)
    token_rollup.commit(batch("insert", "word_bpe_49k", "n_word"), folder, 4)
    return token_rollup.totals(spark, folder)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_quality(docs.select("doc_id", "text", "source", "lang"), model)
    scores = ("_p", "_host_post", "_path_post", "_quality")
    return scored.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), *(F.col(c).alias(c.strip("_")) for c in scores), (F.col("_quality") >= quality.THRESHOLD).alias("kept"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_sentencepiece, op3_exact_dedup, op4_minhash, op5_token_files, op6_embeddings, op7_token_counts, op8_quality, op9_html, op10_language)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM d""",
}
