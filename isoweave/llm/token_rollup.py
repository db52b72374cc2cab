"""Token counts kept by deltas: signed inserts, deletes and revised counts update additive totals.

A change batch has a number and rows (op, source, lang, version, tokens, old_version, old_tokens); ``op`` is insert,
delete or revise. A rollup folder holds one delta table per batch, made of sums by source, language and tokenizer
version, which gets its name by one rename once it is written: a batch that is committed again is left out, and one
that was lost on the way is not there at all. Totals are the sums over the committed deltas; compact() folds them into
one, which has the number -1 - n for batches up to n, and commit() does so by itself after FOLD_AFTER deltas, so that
totals never read more than that. Batches are committed in order of their numbers: one up to n that comes after the folding
counts as a repeated one and is left out.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "version")
#: Deltas that are kept before they are folded into one.
FOLD_AFTER = 16
_SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """(keys, n_docs, n_tokens) deltas: +1 row for what is new, -1 for what it replaces; null tokens count 0."""
    new = F.struct(F.col("version"), F.lit(1).cast("long").alias("n_docs"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("n_tokens"))
    old = F.struct(F.col("old_version").alias("version"), F.lit(-1).cast("long").alias("n_docs"), (-F.coalesce(F.col("old_tokens"), F.lit(0))).cast("long").alias("n_tokens"))
    parts = F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(old)).when(F.col("op") == "revise", F.array(new, old))
    checked = F.when(F.col("op").isin("insert", "delete", "revise"), parts).otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(F.col("op"), F.lit("null")))))
    return changes.select("source", "lang", F.inline(checked))


def commit(changes: DataFrame, folder: str, batch: int) -> None:
    """Add batch ``batch`` unless it is there; rows are summed on the map side, so hot sources shuffle a row per task.

    An empty batch is committed as an empty delta.
    """
    spark = changes.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    live, _ = _batches(spark, folder)
    if batch in live or live and live[0] < 0 and batch <= -1 - live[0]:
        return
    deltas = signed(changes).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    made = f"{folder}/new-{uuid4().hex}"
    deltas.write.parquet(made)
    if not files.rename(path(made), path(f"{folder}/batch={batch}")):
        raise OSError(f"{made} can't be renamed")
    if len(live) >= FOLD_AFTER:
        compact(spark, folder)


def _batches(spark: SparkSession, folder: str) -> tuple[list[int], list[int]]:
    """Numbers of the batches that count (the last fold first, if there is one), and of those that it replaces."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    numbers = sorted(int(x[6:]) for x in names if x.startswith("batch="))
    upto = -1 - numbers[0] if numbers and numbers[0] < 0 else -1
    live = [b for b in numbers if b > upto or b == -1 - upto < 0]
    return live, [b for b in numbers if b not in live]


def _summed(spark: SparkSession, folder: str, batches: list[int]) -> DataFrame:
    paths = [f"{folder}/batch={b}" for b in batches]
    deltas = spark.read.schema(_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], _SCHEMA)
    summed = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return summed.where("n_docs != 0 or n_tokens != 0")


def compact(spark: SparkSession, folder: str) -> None:
    """Fold all committed deltas into one and delete them; until the fold is written, and if it fails, they count as before."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    live, _ = _batches(spark, folder)
    if live and live[-1] >= 0:
        _summed(spark, folder, live).write.mode("overwrite").parquet(f"{folder}/fold")
        if not files.rename(path(f"{folder}/fold"), path(f"{folder}/batch={-1 - live[-1]}")):
            raise OSError(f"{folder}/fold can't be renamed")
    for b in _batches(spark, folder)[1]:
        files.delete(path(f"{folder}/batch={b}"), True)


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """(source, lang, version, n_docs, n_tokens); keys whose documents are all gone are left out. Null keys are keys.

    Before the first commit, and where all batches were empty, there are no rows.
    """
    return _summed(spark, folder, _batches(spark, folder)[0])
