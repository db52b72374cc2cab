"""Lexical retrieval packing: windows are filled with the lexical neighbours of a seed document.

Documents are dealt to shards of bounded token count as they are read. Each shard has its own BM25 inverted index
over token ids. A window begins with the rest of the document that the last window cut, or else with the shard's
next unused document; the index returns that document's best unused neighbours, which fill the window in order of
their score, and the last of them is cut at the window's end. When neighbours run out, the next seed goes on
filling. A shard's last, short window is cut into sequences whose lengths are powers of two, which need no padding.

Shards follow the input's splits, so no text is shuffled and no shard depends on another: memory is bounded by
SHARD_IDS whatever the input's size, hot sources included, and a lost task is simply run again with the same result
as long as its split has the same rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, grouped, text_batches
from .tokenizers import CUT_BYTES, word_level

#: Ids that a sequence has; ids that a shard holds at least (a document is never split between shards).
WINDOW, SHARD_IDS = 4096, 4_000_000
#: BM25's usual constants. A seed's query are all its distinct terms.
K1, B = 1.2, 0.75

#: Weights of a shard that are held as a table (4 bytes each), for terms that one document in DENSE_SHARE has.
DENSE_CELLS, DENSE_SHARE = 16_000_000, 64
#: Terms whose weights are computed, documents whose weights of common terms are summed at once.
CHUNK_TERMS, HELD_AT_ONCE = 4096, 2048
#: Pieces of an Arrow batch: with the ids a few MB.
BATCH_PIECES = 1024
#: Neighbours that are sorted first.
FIRST_NEIGHBOURS = 32

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


class Index:
    """BM25 inverted index of one shard: postings by term, each with its document and its weight."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        lengths = np.fromiter(map(len, docs), np.int64, n)
        # arrays of a shard's ids are reused or freed as soon as they can be: they are what bounds a worker's memory
        keys = np.concatenate(docs, dtype=np.int64)
        keys <<= 32
        keys |= np.repeat(np.arange(n, dtype=np.int32), lengths)
        keys.sort()
        new = np.empty(len(keys), bool)
        new[:1] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        at = np.flatnonzero(new)
        tf = np.diff(at, append=len(keys)).astype(np.int32)
        keys = keys[at]
        del new, at
        self.doc = (keys & 0xFFFFFFFF).astype(np.int32)
        keys >>= 32
        self.terms, first, df = np.unique(keys, return_index=True, return_counts=True)
        self.bounds = np.append(first, len(keys))
        del keys
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(lengths.mean(), 1e-9))
        self.weight = np.empty(len(tf), np.float32)
        for a in range(0, len(self.terms), CHUNK_TERMS):
            own, own_df = slice(self.bounds[a], self.bounds[min(a + CHUNK_TERMS, len(self.terms))]), df[a : a + CHUNK_TERMS]
            self.weight[own] = np.repeat(idf[a : a + CHUNK_TERMS], own_df) * tf[own] * (K1 + 1) / (tf[own] + norm[self.doc[own]])
        del tf
        term_of = np.repeat(np.arange(len(self.terms), dtype=np.int32), df)[np.argsort(self.doc, kind="stable")]
        #: each document's distinct terms, as positions in self.terms
        self.query = np.split(term_of, np.cumsum(np.bincount(self.doc, minlength=n))[:-1])
        self.n = n
        #: documents that still have weights (all at first), and of the commonest terms a row of weights over these
        self.held = np.arange(n)
        often = np.argsort(-df, kind="stable")[: max(1, DENSE_CELLS // max(n, 1))]
        often = often[df[often] * DENSE_SHARE >= n]
        self.row_of = np.full(len(self.terms), -1, np.int32)
        self.row_of[often] = np.arange(len(often), dtype=np.int32)
        self.dense = np.zeros((len(often), n), np.float32)
        for row, term in enumerate(often):
            own = slice(self.bounds[term], self.bounds[term + 1])
            self.dense[row, self.doc[own]] = self.weight[own]

    def _forget(self, unused: np.ndarray) -> None:
        """Drop the postings of used documents, which no query returns again; weights stay."""
        kept = unused[self.doc]
        self.bounds = np.concatenate([[0], np.cumsum(kept)])[self.bounds]
        self.doc, self.weight = self.doc[kept], self.weight[kept]
        kept = np.flatnonzero(unused[self.held])
        self.held = self.held[kept]
        cells, rows, n = self.dense.reshape(-1), len(self.dense), len(self.held)
        for i in range(rows):  # in place: no second table
            cells[i * n : (i + 1) * n] = self.dense[i].take(kept)
        self.dense = cells[: rows * n].reshape(rows, n)

    def neighbours(self, seed: int, unused: np.ndarray):
        """Unused documents that share a term with the seed, best first; ties in order of the shard."""
        left = int(unused.sum())
        if 4 * left < 3 * len(self.held):
            self._forget(unused)
        terms = self.query[seed]
        rows = self.row_of[terms]
        rare = terms[rows < 0]
        first = self.bounds[rare]
        size = self.bounds[rare + 1] - first
        at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        score = np.bincount(self.doc[at], self.weight[at], self.n).astype(np.float32)
        rows = rows[rows >= 0]
        for a in range(0, len(self.held), HELD_AT_ONCE):
            score[self.held[a : a + HELD_AT_ONCE]] += self.dense[rows, a : a + HELD_AT_ONCE].sum(axis=0)
        found = np.flatnonzero((score > 0) & unused)
        most = FIRST_NEIGHBOURS
        while most < len(found):  # a window seldom takes more than a few, so that few are sorted
            least = np.partition(score[found], len(found) - most)[len(found) - most]
            best = found[score[found] > least]
            yield from best[np.argsort(-score[best], kind="stable")]
            found, most = found[score[found] <= least], 8 * most
        yield from found[np.argsort(-score[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard's documents; each document has an id at least."""
    index = Index(docs)
    unused = np.ones(len(docs), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = filled = next_seed = 0

    def put(doc: int) -> bool:
        """Lay all of a document, over several windows if need be; whether a window ended within or after it."""
        nonlocal sequence, filled
        unused[doc] = False
        start, ended = 0, False
        while start < len(docs[doc]):
            length = min(len(docs[doc]) - start, window - filled)
            pieces.append((doc, start, length, sequence, filled))
            start, filled = start + length, filled + length
            if filled == window:
                sequence, filled, ended = sequence + 1, 0, True
        return ended

    seed = 0
    while True:
        if unused[seed]:
            put(seed)
        last = seed
        for doc in index.neighbours(seed, unused):
            last = int(doc)
            if put(last):
                break
        if filled and last != seed and pieces[-1][0] == last and pieces[-1][4] == 0:
            seed = last  # what is left of the document just cut begins the window and is its seed
            continue
        while next_seed < len(docs) and not unused[next_seed]:
            next_seed += 1
        if next_seed == len(docs):
            break
        seed = next_seed
    return _split_last(pieces, sequence, filled) if filled else pieces


def _split_last(pieces, sequence: int, filled: int):
    """Cut the last window's ``filled`` ids at the powers of two that they sum up to."""
    kept = [p for p in pieces if p[3] != sequence]
    ends = np.cumsum([1 << b for b in reversed(range(filled.bit_length())) if filled >> b & 1])
    for doc, start, length, _, offset in (p for p in pieces if p[3] == sequence):
        while length:
            k = int(np.searchsorted(ends, offset, side="right"))
            take = min(length, int(ends[k]) - offset)
            kept.append((doc, start, take, sequence + k, offset - (int(ends[k - 1]) if k else 0)))
            start, offset, length = start + take, offset + take, length - take
    return kept


def pack(docs: DataFrame, tokenizer_path: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most WINDOW ids, one row per piece.

    Columns: doc_id, start (ids of its document before it), length, ids_crc32 (of its ids as little-endian unsigned
    32-bit integers), doc_tokens (ids of its document with the end id), sequence_id, offset, and with ``with_ids``
    the ids themselves. Null texts count as empty: they are their end id alone. Repeated rows are packed each by
    itself, null ids stay null, other columns are ignored, an empty table gives no pieces.
    """
    text_batches(docs.sparkSession)
    schema = _PIECES if with_ids else pa.schema(list(_PIECES)[:-1])

    def run(batches):
        from pyspark import TaskContext

        encode, task = word_level(tokenizer_path).many, TaskContext.get().partitionId()
        ids, texts, held = [], [], 0  # texts: their ids, 4 bytes each
        base = task << 36

        def shard():
            nonlocal base
            pieces = pack_shard(texts)
            for a in range(0, len(pieces), BATCH_PIECES):
                own = pieces[a : a + BATCH_PIECES]
                raw = [texts[d][s : s + n].tobytes() for d, s, n, _, _ in own]
                yield arrow_rows(schema, {"doc_id": [ids[p[0]] for p in own], "start": [p[1] for p in own], "length": [p[2] for p in own], "ids_crc32": [zlib.crc32(x) for x in raw], "doc_tokens": [len(texts[p[0]]) for p in own], "sequence_id": [base + p[3] for p in own], "offset": [p[4] for p in own], "ids": raw})
            base += pieces[-1][3] + 1

        for batch in grouped(batches, CUT_BYTES):
            for doc_id, text in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
                if held >= SHARD_IDS:
                    yield from shard()
                    ids, texts, held = [], [], 0
        if texts:
            yield from shard()

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)
