"""Exact merge-type SentencePiece encoding by backtracking, and its decoding.

A sequence of pieces is what merging by priority yields exactly when every two neighbours, re-merged by
themselves, stay as they are. So encoding tries the longest piece at each position (all matches come from one
Aho-Corasick pass), falls back to the next shorter prefix piece while it is incompatible with its left neighbour,
and marks positions from which no way leads on in a bit field.

Nulls count as empty texts; an empty text is its begin and end ids alone. A character outside the vocabulary
becomes its UTF-8 bytes. U+2581 in a text is the same as a space, as in the library.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, text_batches
from .tokenizers import UnitCache, pack_ids

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*|[^{SPACE}\n]+")
#: Piece types of the model file: these are the format's fixed values.
NORMAL, BYTE = 1, 6


class Codec:
    """Encoder and decoder of one merge-type model with an identity normaliser, a dummy prefix and byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, trained = proto.normalizer_spec, proto.trainer_spec
        if trained.model_type != 2 or not trained.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a merge-type model with byte fallback, a dummy prefix and no other normalisation is needed")
        self.begin, self.end = trained.bos_id, trained.eos_id
        self.pieces = [p.piece for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.out = [p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else " ⁇ ".encode() if p.type == 2 else b"" for p in proto.pieces]
        self._matcher = None
        self._known = {p for p in self.id_of if len(p) == 1}.issuperset
        self._stays: dict[int, bool] = {}
        self._shorter: dict[int, int | None] = {}
        self.raw_units = UnitCache(lambda unit: pack_ids(self._unit(unit)))
        self.units = UnitCache(lambda part: pack_ids(self._unit(part if part[:1] == "\n" else SPACE + part)))

    def _learn(self) -> None:
        """Split of every piece that its own text merges to, and the automaton of those pieces."""
        import ahocorasick

        order = sorted(self.id_of, key=lambda p: (-self.score[p], self.id_of[p]))
        self.rank = [0] * len(self.pieces)
        for r, piece in enumerate(order):
            self.rank[self.id_of[piece]] = r
        self.split = {}
        self._matcher = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                self.split[i] = None
            elif len(parts := self.merged(piece, stop_at=piece)) == 2:
                self.split[i] = tuple(self.id_of[p] for p in parts)
            else:
                continue
            self._matcher.add_word(piece, (len(piece) - 1, i))
        self._matcher.make_automaton()
        self.size = list(map(len, self.pieces))

    def merged(self, text: str, stop_at: str | None = None) -> list[str]:
        """Merge by priority: the best-scored adjacent pair first, the leftmost of equals. ``stop_at``: before this piece is made."""
        parts: list[str | None] = list(text)
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            both = parts[i] + parts[j]
            if (s := self.score.get(both)) is not None:
                heapq.heappush(heap, (-s, i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or len(parts[i]) + len(parts[j]) != len(both):
                continue
            if both == stop_at:
                break
            parts[i], parts[j] = both, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                offer(i, right[j])
            if left[i] >= 0:
                offer(left[i], i)
        return [p for p in parts if p is not None]

    def compatible(self, a: int, b: int) -> bool:
        """Whether two neighbours stay as they are when both are merged anew side by side.

        Undoes their merges latest first. Pieces that meet at the border at some time would merge there if that
        merge comes before the one that takes either of them; of equal merges the left one comes first.
        """
        rank, split = self.rank, self.split
        end_a = end_b = len(rank)
        while True:
            both = self.id_of.get(self.pieces[a] + self.pieces[b])
            if both is not None and rank[both] < end_a and rank[both] <= end_b:
                return False
            made_a, made_b = rank[a] if split[a] else -1, rank[b] if split[b] else -1
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                end_a, a = made_a, split[a][1]
            else:
                end_b, b = made_b, split[b][0]

    def shorter(self, piece: int) -> int | None:
        """The longest usable piece that is a proper prefix."""
        if piece not in self._shorter:
            text = self.pieces[piece]
            self._shorter[piece] = next((i for k in range(len(text) - 1, 0, -1) if (i := self.id_of.get(text[:k])) in self.split), None)
        return self._shorter[piece]

    def backtracked(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary."""
        if self._matcher is None:
            self._learn()
        n = len(text)
        longest = [0] * n
        for last, (more, i) in self._matcher.iter(text):
            longest[last - more] = i  # matches end ever later, so the last one to start here is the longest
        size, pairs = self.size, self._stays
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        pos, previous, piece = 0, -1, longest[0]
        while True:
            end = pos + size[piece]
            fits = not failed[end >> 3] >> (end & 7) & 1
            if fits and previous >= 0 and (fits := pairs.get(key := previous << 20 | piece)) is None:
                if len(pairs) > 500_000:
                    pairs.clear()
                fits = pairs[key] = self.compatible(previous, piece)
            if fits:
                out.append(piece)
                if end == n:
                    return out
                pos, previous, piece = end, piece, longest[end]
            elif (less := self.shorter(piece)) is not None:
                piece = less
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                pos -= size[piece]
                previous = out[-1] if out else -1

    def _unit(self, unit: str) -> list[int]:
        """Ids of spaces and the characters after them, up to the next space or line feed."""
        if self._known(unit):
            return self._pieces(unit)
        ids: list[int] = []
        start = 0
        for i, c in enumerate(unit):
            if c not in self.id_of:
                ids += self._pieces(unit[start:i])
                ids += map(self.byte_id.__getitem__, c.encode())
                start = i + 1
        return ids + self._pieces(unit[start:])

    def _pieces(self, run: str) -> list[int]:
        if run[:2] == SPACE * 2:  # only pieces of several spaces share a score; such a tie falls to the leftmost
            return [self.id_of[p] for p in self.merged(run)]
        return self.backtracked(run) if run else []

    def encode(self, text: str) -> bytes:
        """All ids with begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            body = b""
        elif "  " in text or " \n" in text or text[0] == " " or SPACE in text:
            body = b"".join(map(self.raw_units.__getitem__, _UNITS.findall(SPACE + text.replace(" ", SPACE))))
        else:
            body = b"".join(map(self.units.__getitem__, text.replace("\n", " \n").split(" ")))
        return pack_ids([self.begin]) + body + pack_ids([self.end])

    def decode(self, ids: bytes) -> str:
        """Text of ids: spaces for U+2581 without the dummy prefix; each byte that is no UTF-8 becomes U+FFFD."""
        raw = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "sp_each_byte")
        return text[1:] if text[:1] == " " else text


def _each_byte(error: UnicodeDecodeError):
    return "�", error.start + 1


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    import codecs

    codecs.register_error("sp_each_byte", _each_byte)
    return Codec(path)


_CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def sentencepiece_round_trip(docs: DataFrame, model_path: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode its ids again: (doc_id, n_tokens, ids, decoded).

    ``ids`` are little-endian unsigned 32-bit integers with begin and end ids. With ``digests`` the two values are
    returned as SHA-256 in lowercase hex, so that they never leave the worker. Null texts count as empty, null ids of
    documents stay null, other columns are ignored. No shuffle; a worker holds one small batch of texts.
    """
    text_batches(docs.sparkSession)
    schema = _DIGESTS if digests else _CODED

    def code(batches):
        coder = codec(model_path)
        for batch in batches:
            cols: dict[str, list] = {"doc_id": batch.column(0), "n_tokens": []}
            a, b = (cols.setdefault(f.name, []) for f in list(schema)[2:])
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text or "")
                back = coder.decode(ids)
                cols["n_tokens"].append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest() if digests else ids)
                b.append(hashlib.sha256(back.encode()).hexdigest() if digests else back)
            yield arrow_rows(schema, cols)

    ddl = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(code, ddl)
