"""Comparison of the rows within buckets, where any bucket may be hot, without one task ever holding a whole one.

A bucket of more than BLOCK rows is dealt into blocks, and each pair of its blocks is a group of its own of bounded
size. Groups stream through a task one after another, so that memory is bounded by two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of a block.
BLOCK = 512


def shared_buckets(rows: DataFrame, what: str) -> DataFrame:
    """Written rows (key, id) of the keys that at least two rows have, with n: their number and first: the least id."""
    counts = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1"), f"{what}-counts")
    return written(rows.join(counts, "key"), what)


def compare_within(rows: DataFrame, compare, schema: str, arrow_schema: pa.Schema, blocks: Column | None = None, main: Column | None = None, main_blocks: Column | None = None) -> DataFrame:
    """Apply ``compare(group: pa.Table, left, right)`` to all pairs within each key of ``rows`` (key, id, n, ...).

    ``left`` and ``right`` are the group's positions whose pairs are asked for: both the same array for the pairs
    within a block, else those of two blocks. Every pair of rows of a key is asked for once. ``blocks``: the number
    of blocks that a key is dealt into, where that isn't n / BLOCK; it is the same in all rows of a key. Rows for which
    ``main`` holds go to ``main_blocks`` blocks of their own and are compared with the other rows alone, so that a key
    with many such rows and few others makes hardly more rows than it has.
    """
    spark = rows.sparkSession
    own = rows.withColumn("_nb", (F.ceil(F.col("n") / BLOCK) if blocks is None else blocks).cast("int"))
    own = own.withColumns({"_main": F.lit(False) if main is None else main, "_nm": (F.lit(0) if main is None else main_blocks).cast("int")})
    digest = F.xxhash64("id")
    own = own.withColumn("_own", F.when(F.col("_main"), F.col("_nb") + F.pmod(digest, F.greatest("_nm", F.lit(1)))).otherwise(F.pmod(digest, F.col("_nb"))).cast("int"))
    other = own.withColumn("_other", F.explode(F.expr("sequence(0, if(_main, _nb, _nb + _nm) - 1)")))
    dealt = other.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")}).drop("_nb", "_nm", "_main", "_other")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "key", "_i", "_j").sortWithinPartitions("key", "_i", "_j", "id")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table, ends: bool):
            cut = np.zeros(table.num_rows, bool)
            for name in ("key", "_i", "_j"):
                v = table.column(name).to_numpy()
                cut[1:] |= v[1:] != v[:-1]
            at = np.flatnonzero(cut).tolist()
            bounds = [0, *at, table.num_rows]
            mine, i, j = (table.column(c).to_numpy() for c in ("_own", "_i", "_j"))
            for a, b in zip(bounds[:-1], bounds[1:] if ends else bounds[1:-1], strict=False):
                if b - a > 1:
                    if i[a] == j[a]:
                        left = right = np.arange(b - a)
                    else:
                        left, right = np.flatnonzero(mine[a:b] == i[a]), np.flatnonzero(mine[a:b] == j[a])
                    if len(left) and len(right) and (out := compare(table.slice(a, b - a), left, right)) is not None:
                        yield out
            return table.slice(bounds[-2]) if not ends else None

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            found = []
            rest = yield from _collected(groups(table, False), found)
            yield from _batches(found, arrow_schema)
        if rest is not None and rest.num_rows:
            found = []
            yield from _collected(groups(rest, True), found)
            yield from _batches(found, arrow_schema)

    return dealt.mapInArrow(run, schema)


def _collected(gen, into: list):
    """Fill ``into`` from ``gen`` and return its value; yields nothing."""
    while True:
        try:
            into.append(next(gen))
        except StopIteration as end:
            return end.value
    yield


def _batches(found: list, schema: pa.Schema):
    if found:
        cols = [np.concatenate(c) for c in zip(*found, strict=True)]
        for a in range(0, len(cols[0]), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 20_000], f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def as_bytes(column: pa.ChunkedArray, longs: int) -> np.ndarray:
    """A column of arrays of so many longs as a matrix of bytes."""
    return column.combine_chunks().flatten().to_numpy().view("u1").reshape(-1, 8 * longs)


def packed(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """A column of binary values of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)
