"""What the operators of this subpackage share: shared storage, written intermediate tables, digests."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that carries whole texts: bounds a Python worker's memory where texts are long.
TEXT_BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Keep Arrow batches small: a batch of the default 10,000 very long texts would not fit a worker.

    Spark reads this setting when a plan runs, so it stays set for the session; a smaller value is left as it is.
    """
    if 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        return
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def small_reads(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Keep the batches of Parquet readers small: 4,096 whole texts fill arrays of tens of MB, for which the heap grows.

    Like text_batches(), this stays set for the session, and a smaller value is left as it is.
    """
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and the master is local (tests) a temporary folder of this machine is chosen.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='isoweave-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and survives the loss of executors."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the table that written() made, once nothing reads it any more."""
    path = getattr(df, "written_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(col):
    """Lower-case A-Z alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grouped(batches, size: int):
    """The batches' rows in batches of at least ``size`` bytes; the last may be smaller."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def arrow_rows(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
