"""Stateful streaming exact deduplication over disk-backed keyed state without expiry.

Rows arrive as (digest, bytes, identifier, content locator). A streaming aggregation in a RocksDB state store keeps
for each digest the largest identifier, the locator of that row's content and the number of rows, for ever; rows
are pre-aggregated before they reach a key's state, so a hot digest costs one state row per task. Each micro-batch
writes the groups it changed to a folder of its own number: a batch that is run again replaces its own output.
Digests that were hit are then checked on full bytes against the text at the locator that the state holds.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, shared_dir, unused, written

#: Files of the arrival log that a micro-batch takes.
FILES_PER_BATCH = 256
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    # a store allocates megabytes ahead of its logs and uploads whole tables otherwise, whatever its state's size
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.metricsEnabled": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def _state_settings(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text_col: str = "text"):
    """Null is empty; A-Z in lower case and nothing else changed."""
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def _in_files(docs: DataFrame) -> DataFrame | None:
    """(file, row) of each row, where every row of ``docs`` is a row of its own of some file; else None."""
    plan = docs._jdf.queryExecution().analyzed().toString()
    if any(node in plan for node in ("Generate", "Join", "Union", "Expand", "Aggregate", "Window", "MapIn", "RDD")):
        return None
    try:
        at = docs.metadataColumn("_metadata")
        return docs.select("*", F.struct(at["file_path"].alias("file"), at["row_index"].alias("row")).alias(unused(docs, "_at")))
    except (AnalysisException, PySparkException):
        return None


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, at: file and row of the content, norm); a table whose rows aren't those of files is written first."""
    rows = _in_files(docs)
    if rows is None:
        rows = _in_files(written(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias(text_col)), "located"))
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(rows.columns[-1]).alias("at"), normalised(text_col).alias("norm"))


def track(spark: SparkSession, arrivals_path: str, schema, checkpoint: str, groups_path: str) -> DataFrame:
    """Run the stream over all arrivals there are: (digest, n_bytes, keep: struct(doc_id, at), group_size).

    Called again with the same folders it goes on from its state with the files that came since.
    """
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(arrivals_path)
    state = log.groupBy("digest", "n_bytes").agg(F.max(F.struct("doc_id", "at")).alias("keep"), F.count("*").alias("group_size"))

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{groups_path}/batch={batch}")

    with _state_settings(spark):
        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
        query.awaitTermination()
    changes = spark.read.schema(f"digest binary, n_bytes long, keep struct<doc_id: long, at: struct<file: string, row: long>>, group_size long, batch int").parquet(groups_path)
    latest = F.max(F.struct("group_size", "keep")).alias("s")  # a group only grows
    return changes.groupBy("digest", "n_bytes").agg(latest).select("digest", "n_bytes", "s.keep", "s.group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None) -> DataFrame:
    """One row per row of ``docs``: doc_id, at, keep_id, keep_at, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays, of equal ids the one that lies last (by file and row), so that
    exactly one row of a group is kept. Null texts are empty texts, a null id is less than any other. ``digest``
    replaces the digest of a column in tests; texts that share a digest but differ are told apart by their bytes.
    """
    spark = docs.sparkSession
    digest = digest or (lambda norm: F.unhex(F.sha2(norm, 256)))
    rows = located(docs, id_col, text_col).withColumns({"digest": digest(F.col("norm")), "n_bytes": F.octet_length("norm").cast("long")})
    arrivals = written(rows.select("doc_id", "at", "digest", "n_bytes", F.sha2("norm", 256).alias("text_sha256")), "arrivals")
    groups = written(track(spark, arrivals.written_path, arrivals.schema, shared_dir(spark, "dedup-state"), f"{shared_dir(spark, 'dedup-groups')}"), "groups")
    hits = groups.where("group_size > 1")
    texts = rows.join(hits.select("digest", "n_bytes", F.col("keep.at").alias("keep_at")), ["digest", "n_bytes"]).select("digest", "n_bytes", "doc_id", "at", "keep_at", "norm")
    texts = written(texts, "hits")
    kept = texts.where("at = keep_at").select("digest", "n_bytes", F.col("norm").alias("keep_norm"))
    odd = written(texts.where("at != keep_at").join(kept, ["digest", "n_bytes"]).where("norm != keep_norm").select("digest", "n_bytes"), "collisions")
    out = arrivals.join(groups, ["digest", "n_bytes"])
    cols = ["doc_id", "at", F.col("keep.doc_id").alias("keep_id"), F.col("keep.at").alias("keep_at"), "group_size", F.expr("at = keep.at").alias("kept"), "text_sha256"]
    if odd.isEmpty():
        return out.select(*cols)
    apart = texts.join(odd, ["digest", "n_bytes"], "left_semi")
    by_text = apart.groupBy("norm").agg(F.max(F.struct("doc_id", "at")).alias("keep"), F.count("*").alias("group_size"))
    again = apart.join(by_text, "norm").withColumn("text_sha256", F.sha2("norm", 256))
    return out.join(odd, ["digest", "n_bytes"], "left_anti").select(*cols).unionByName(again.select(*cols))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns.

    Null texts are empty ones; a null id is less than any other; an empty table stays empty. A table whose rows aren't
    those of files (a join's, for instance) is written first.
    """
    if _in_files(docs) is None:
        docs = written(docs, "documents")
    rows = _in_files(docs)
    at, gone_at = rows.columns[-1], unused(rows, "_gone")
    gone = exact_duplicates(docs, id_col, text_col).where("not kept").select(F.col("at").alias(gone_at))
    return rows.join(gone, F.col(at) == F.col(gone_at), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
