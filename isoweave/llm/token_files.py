"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read back memory-mapped.

Format of part ``p`` in a folder: ``p.bin`` holds the ids of its documents one after another as little-endian
unsigned integers of 2 bytes, or of 4 where the vocabulary has over 65,536 entries; ``p.idx`` holds one
little-endian signed 64-bit row (document id, offset of its first id within the part) per document and a last row
(number of documents, number of ids). Parts are in ascending document id order, and so are the documents in each.
A part's base, the ids before it, is a prefix sum over the parts; it is in the manifest table, not in the files.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, shared_dir, text_batches, written
from .tokenizers import END_BYTES, byte_level

#: Ids a part holds at most before the next one is begun; a single document may exceed it.
PART_IDS = 32_000_000
_WRITTEN = pa.schema([("task", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _store(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class _Part:
    """One file pair under a name of this attempt alone: a lost task's files are never named in the manifest."""

    def __init__(self, folder: str, width: int):
        self.path, self.width = f"{folder}/{uuid.uuid4().hex}", width
        self.fs, self.at = _store(self.path)
        self.fs.create_dir(os.path.dirname(self.at), recursive=True)
        self.out = self.fs.open_output_stream(f"{self.at}.bin")
        self.rows: list[tuple[int, int]] = []
        self.n_ids = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        self.rows.append((doc_id, self.n_ids))
        self.n_ids += len(ids) // 4
        self.out.write(ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        with self.fs.open_output_stream(f"{self.at}.idx") as f:
            f.write(np.array([*self.rows, (len(self.rows), self.n_ids)], dtype="<i8").tobytes())
        return self.path, len(self.rows), self.n_ids


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append the end id, write the files; the manifest: (path, width, n_docs, n_ids, base).

    Documents are range-partitioned and sorted by id, so only their texts are shuffled, once; a task streams its
    rows into files and holds one batch. Bases are prefix sums over the manifest, of one row per part. Null texts
    count as empty (their end id alone); null ids of documents are refused, since the order needs them; repeated
    ids stay next to each other, ordered by text.
    """
    spark = docs.sparkSession
    text_batches(spark)
    folder = folder or shared_dir(spark, "token-files")
    width = 2 if _vocabulary(tokenizer_path) <= 1 << 16 else 4

    def write(batches):
        from pyspark import TaskContext

        encode, part, seq, task = byte_level(tokenizer_path), None, 0, TaskContext.get().partitionId()
        done: dict[str, list] = {f.name: [] for f in _WRITTEN}

        def end(part, seq):
            for name, value in zip(_WRITTEN.names, (task, seq, *part.close()), strict=True):
                done[name].append(value)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if doc_id is None:
                    raise ValueError("a document without an id has no place in the order of files")
                part = part or _Part(folder, width)
                part.add(doc_id, encode(text or "") + END_BYTES)
                if part.n_ids >= PART_IDS:
                    end(part, seq)
                    part, seq = None, seq + 1
        if part:
            end(part, seq)
        yield arrow_rows(_WRITTEN, done)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    made = written(dealt.mapInArrow(write, "task int, seq int, path string, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("task", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per file, not per document
    return made.select("path", F.lit(width).alias("width"), "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))


def _vocabulary(path: str) -> int:
    return byte_level(path).tok.get_vocab_size()


def read_part(path: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the index, ids), mapped into memory where the store is this machine's."""
    fs, at = _store(path)
    if isinstance(fs, arrow_fs.LocalFileSystem):
        size = os.path.getsize(f"{at}.bin")
        ids = np.memmap(f"{at}.bin", dtype=f"<u{width}", mode="r") if size else np.empty(0, f"<u{width}")
    else:
        with fs.open_input_stream(f"{at}.bin") as f:
            ids = np.frombuffer(f.read(), f"<u{width}")
    with fs.open_input_stream(f"{at}.idx") as f:
        rows = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
    if len(rows) - 1 != rows[-1][0] or len(ids) != rows[-1][1]:
        raise ValueError(f"{path}: index and ids don't fit together")
    return rows, ids


def token_file_digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32 (of its ids as unsigned 32-bit integers)."""

    def read(batches):
        for batch in batches:
            for path, width, base in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows, ids = read_part(path, width)
                for a in range(0, len(rows) - 1, 4096):
                    own = rows[a : a + 4097]
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(own[:-1, 1].tolist(), own[1:, 1].tolist(), strict=True)]
                    yield arrow_rows(_READ, {"doc_id": own[:-1, 0], "start": own[:-1, 1] + base, "n_tokens": np.diff(own[:, 1]), "ids_crc32": crc})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = manifest.select("path", "width", "base").repartition(n, "path")
    return parts.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
