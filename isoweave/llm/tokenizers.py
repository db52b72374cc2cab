"""Unit caches over public tokenizers: a text is cut where its tokenizer always cuts, each unit is encoded once.

Every cache maps a unit to its ids as little-endian unsigned 32-bit integers, so that a text's ids are one
``bytes.join``. The caches are bounded, and long units are not kept.
"""

from __future__ import annotations

import functools
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units that a cache holds at most, and the longest unit that it keeps.
CACHE_UNITS, CACHE_CHARS = 500_000, 64

#: Id that ends a document in packed sequences and id files.
END_ID = 2
END_BYTES = END_ID.to_bytes(4, "little")

#: Bytes of texts that WordEncoder.many() cuts at once; a longer text is encoded by itself.
CUT_BYTES = 1 << 21


def public_path(name: str) -> str:
    """Where a public vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_ids(ids) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, dtype="<u4").tobytes()


class UnitCache(dict):
    """unit -> ids; fills itself through encode(). Of two halves the older one goes when the newer is full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.older: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        if (ids := self.older.get(unit)) is None:
            ids = self.encode(unit)
            if len(unit) > CACHE_CHARS:
                return ids
        if len(self) >= CACHE_UNITS // 2:
            self.older = dict(self)
            self.clear()
        self[unit] = ids
        return ids


class _Joined(Exception):
    """White space at a unit's rim: its neighbours take part in how it is cut."""


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True  # strings of special tokens in a text are ordinary text
    return tok


#: The two files' own patterns, and the letters up to which regex and the library agree for certain.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile("[\x00-\x7f\xa1-\u012f\u0132-\u024f\u2010-\u2027]*")


def _alphabet() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies: printable ones for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_ALPHABET = _alphabet()
_KEEPS = re.compile("[!-~]*").fullmatch


class _Encoder:
    """Encodes a unit by its pattern and the library's model, each distinct word once; unusual units go to the library whole."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.tok = _load(path)
        self.tokenize = self.tok.model.tokenize
        self.words = UnitCache(self._word)
        self.word = self.words.__getitem__
        self.cut = regex.compile(pattern).findall
        self.units = UnitCache(self._unit)
        self.join = self.units.__getitem__

    def _library(self, text: str) -> bytes:
        return pack_ids(self.tok.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        shown = word if word.isalpha() and word.isascii() or _KEEPS(word) else word.encode().decode("latin-1").translate(_ALPHABET)
        return pack_ids([t.id for t in self.tokenize(shown)])


class ByteLevelEncoder(_Encoder):
    """Ids of the byte-level vocabulary, as the tokenizers library gives them for the whole text.

    Its pattern gives a single space to the word that follows it and cuts before a line feed, so texts fall apart
    there. Texts with runs of white space, or other white space at a unit's rim, go to the library whole.
    """

    def __init__(self, path: str):
        super().__init__(path, _BYTE_LEVEL)

    def _unit(self, unit: str) -> bytes:
        if unit.isalpha() and _PLAIN.fullmatch(unit):
            return self.word(" " + unit)
        if unit[:-1].isalpha() and unit[-1] in ".,;:!?" and _PLAIN.fullmatch(unit):
            return self.word(" " + unit[:-1]) + self.word(unit[-1])
        line = unit.startswith("\n")
        body = unit[1:] if line else unit
        if body != body.strip() or not (body or line):
            raise _Joined
        whole = unit if line else " " + unit
        return b"".join(map(self.word, self.cut(whole))) if _PLAIN.fullmatch(unit) else self._library(whole)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or "\n\n" in text or " \n" in text:
            return self._library(text)
        first, *units = text.replace("\n", " \n").split(" ")
        if first != first.strip():
            return self._library(text)
        try:
            return (self._library(first) if first else b"") + b"".join(map(self.join, units))
        except _Joined:
            return self._library(text)


#: Kinds of bytes in many(): odd ones are the apostrophe, which may begin a contraction, and those beyond ASCII, but for
#: the letters U+00C0 to U+00FF. These are _LATIN and a second byte (of which two are no letters, those up to _LAST_UPPER
#: upper case).
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_LATIN, _NO_LETTERS, _LAST_UPPER = 0xC3, (0x97, 0xB7), 0x9E
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _kinds() -> np.ndarray:
    import regex

    def kind(char: str) -> int:
        return next((k for k, p in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_DIGIT, r"\p{N}")) if regex.match(p, char)), _OTHER)

    return np.array([_ODD if char == "'" else kind(char) for char in map(chr, range(128))] + [_ODD] * 128, np.uint8)


class WordEncoder(_Encoder):
    """Ids of the word-end vocabulary: white space is dropped and always cuts, so each unit is encoded by itself."""

    def __init__(self, path: str):
        super().__init__(path, _WORD_LEVEL)
        self.kinds = _kinds()

    def _unit(self, unit: str) -> bytes:
        if not unit:
            return b""
        if not _PLAIN.fullmatch(unit):  # what is left has no combining marks, so that it is in normal form
            return self._library(unit)
        low = unit.lower()
        if low.isalpha():
            return self.word(low)
        if low[:-1].isalpha() and low[-1] in ".,;:!?":
            return self.word(low[:-1]) + self.word(low[-1])
        return b"".join(map(self.word, self.cut(low)))

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.join, text.replace("\n", " ").split(" ")))

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text and END_ID after them, the same as by one call per text; nulls count as empty."""
        texts = pc.fill_null(texts, "")
        ends, out = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), []
        while (lo := len(out)) < len(texts):
            most = (int(ends[lo - 1]) if lo else 0) + CUT_BYTES
            if ends[lo] > most:
                out.append(np.frombuffer(self(texts[lo].as_py()) + END_BYTES, "<u4"))
            else:
                out += self._cut_at_once(texts.slice(lo, int(np.searchsorted(ends, most, side="right")) - lo).cast(pa.string()))
        return out

    def _cut_at_once(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Words are found where the kind of byte changes, and each distinct one is looked up once.

        A unit between white space that has an odd byte is a word here, and is encoded as a unit.
        """
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        kind, low = self.kinds[data], _LOWER[data]
        second = np.flatnonzero(data == _LATIN) + 1
        second = second[~np.isin(data[second], _NO_LETTERS)]
        kind[second] = kind[second - 1] = _LETTER
        second = second[data[second] <= _LAST_UPPER]
        low[second] = data[second] + 0x20
        begins = np.zeros(len(data) + 1, bool)
        begins[at] = True
        begins = begins[:-1]
        if some_odd := bool((kind == _ODD).any()):
            gap, new = kind == _SPACE, begins.copy()
            new[1:] |= gap[1:] != gap[:-1]
            unit = np.cumsum(new, dtype=np.int32)
            odd = np.zeros(unit[-1] + 1, bool)
            odd[unit[kind == _ODD]] = True
            odd = odd[unit]
            kind[odd], low[odd] = _ODD, data[odd]
        new = begins | (kind == _DIGIT)
        new[1:] |= kind[1:] != kind[:-1]
        kept = kind != _SPACE
        first = np.flatnonzero(new & kept)
        place = np.cumsum(kept, dtype=np.int32)
        place = np.append(place[first] - 1, place[-1:])
        found = pa.StringArray.from_buffers(len(first), pa.py_buffer(place if len(place) else np.zeros(1, np.int32)), pa.py_buffer(low[kept])).dictionary_encode()
        words, index = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        ids = list(map(self.word, words)) if not some_odd else []
        if some_odd:
            whole = np.zeros(len(words), bool)
            whole[index[kind[first] == _ODD]] = True
            ids = [self.join(w) if odd else self.word(w) for w, odd in zip(words, whole.tolist(), strict=True)]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        length, begin = size[index], (np.cumsum(size) - size)[index]
        before = np.append(0, np.cumsum(length))
        taken = np.repeat(begin - before[:-1], length)
        taken += np.arange(len(taken))
        ends = before[np.searchsorted(first, at[1:])]
        out = np.insert(np.frombuffer(b"".join(ids), "<u4")[taken], ends, END_ID)
        return np.split(out, (ends + np.arange(1, len(ends) + 1))[:-1])


@functools.lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


@functools.lru_cache(maxsize=4)
def word_level(path: str) -> WordEncoder:
    return WordEncoder(path)
