"""Language identification by string kernels, Nystroem landmarks and one-versus-rest kernel ridge regression.

The blended-spectrum presence kernel of two texts counts the character n-grams (1 to MAX_N, within words and with
their borders) that both contain, over the root of the product of their own counts; n-grams that no landmark has are
left out. Ridge regression on the landmarks' kernel columns gives one weight per n-gram and language, so that a
batch is scored by one product of its sparse presence matrix with the dense matrix of those weights.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, text_batches
from .tokenizers import UnitCache

#: Longest n-gram; training rows per language at most (the bound on what is fitted), landmarks per language, ridge.
MAX_N, TRAIN_ROWS, LANDMARKS, RIDGE = 4, 400, 64, 1e-2
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]").search
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def grams(word: str) -> set[str]:
    s = f" {word} "
    return {s[i : i + n] for n in range(1, MAX_N + 1) for i in range(len(s) - n + 1)}


def words(text: str) -> set[str]:
    return set(text.lower().split())


class Presence:
    """Distinct known n-grams of a text as positions; each word's n-grams are looked up once."""

    def __init__(self, known: dict[str, int]):
        self.known, self.flags = known, np.zeros(len(known), bool)
        self.cache = UnitCache(lambda w: np.array([i for g in grams(w) if (i := known.get(g)) is not None], np.int32).tobytes())

    def __call__(self, text: str) -> np.ndarray:
        self.flags[np.frombuffer(b"".join(map(self.cache.__getitem__, words(text))), np.int32)] = True
        found = np.flatnonzero(self.flags)
        self.flags[found] = False
        return found


class Model:
    """known: n-gram -> row of weights (n-grams x languages); beta: steepness of the scores."""

    def __init__(self, langs: list[str], known: dict[str, int], weights: np.ndarray, bias: np.ndarray, beta: float):
        self.langs, self.known, self.weights, self.bias, self.beta = langs, known, weights, bias, beta
        self.presence = None

    def __getstate__(self):
        return self.__dict__ | {"presence": None}

    def margins(self, texts: list[str]) -> np.ndarray:
        self.presence = self.presence or Presence(self.known)
        found = [self.presence(t) for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        out = np.zeros((len(texts), len(self.langs)))
        if counts.any():
            some = np.flatnonzero(counts)
            at = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
            for lo in range(0, len(some), 64):  # blocks bound the gathered rows
                own = some[lo : lo + 64]
                out[own] = np.add.reduceat(self.weights[np.concatenate([found[i] for i in own])], at[lo : lo + 64] - at[lo], axis=0) / np.sqrt(counts[own])[:, None]
        return out + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        z = self.beta * self.margins(texts)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS) -> Model:
    """Fit on the given rows; the first ``landmarks`` of each language are its landmarks."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], {}, np.zeros((0, 0)), np.zeros(0), 1.0)
    y = np.array([langs.index(v) for v in labels])
    chosen = np.concatenate([np.flatnonzero(y == c)[:landmarks] for c in range(len(langs))])
    marks = [set().union(*map(grams, words(texts[i]))) for i in chosen]
    known = {g: i for i, g in enumerate(sorted(set().union(*marks)))}
    presence = Presence(known)

    def phi(text: str) -> tuple[np.ndarray, float]:
        found = presence(text)
        return found, max(len(found), 1) ** -0.5

    columns = np.zeros((len(known), len(chosen)), np.float32)
    for k, i in enumerate(chosen):
        found, scale = phi(texts[i])
        columns[found, k] = scale
    kernel = np.zeros((len(texts), len(chosen)))
    for i, text in enumerate(texts):
        found, scale = phi(text)
        kernel[i] = columns[found].sum(axis=0) * scale
    targets = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    share = np.bincount(y, minlength=len(langs))
    weight = (len(y) / (len(langs) * share))[y][:, None]  # each language counts alike
    bias = (targets * weight).sum(axis=0) / weight.sum()
    alpha = np.linalg.solve(kernel.T @ (kernel * weight) + RIDGE * len(texts) * (kernel[chosen] + 1e-6 * np.eye(len(chosen))), kernel.T @ ((targets - bias) * weight))
    margins = kernel @ alpha + bias

    def loss(beta: float) -> float:
        z = beta * margins
        return float(np.mean(np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) + z.max(axis=1) - z[np.arange(len(y)), y]))

    return Model(langs, known, (columns @ alpha).astype(np.float32), bias, min((1, 2, 3, 4, 6, 8), key=loss))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` rows per language, those of smallest hash among the rows that aren't held out.

    Language counts come from the same usable rows; the hash bound that they give for each language leaves about twice
    the rows that are wanted, of which the driver gets three times ``rows`` a language at most and keeps the first. The
    hash is of id and text, so that rows that share an id are drawn each by itself.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}
    if not counts:
        return fit([], [])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), F.lit(1 << 30))
    bound = F.coalesce(*(F.when(F.col(lang_col) == lang, F.lit(int(min(1.0, 2.5 * rows / n) * (1 << 30)))) for lang, n in counts.items()))
    sample = usable.where(draw < bound).select(draw.alias("draw"), (draw / bound).alias("place"), F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = sample.orderBy("place", "id", "text").limit(3 * rows * len(counts))
    texts, labels, seen = [], [], dict.fromkeys(counts, 0)
    for r in sorted(sample.collect(), key=lambda r: (r.draw, r.id, r.text)):
        if seen[r.lang] < rows:
            seen[r.lang] += 1
            texts.append(r.text)
            labels.append(r.lang)
    return fit(texts, labels)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from its text alone.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. A text without any known
    n-gram gets the languages' prior. Null ids give a null held_out.
    """
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks' n-grams

    def run(batches):
        own = sent.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            asked = [i for i, t in enumerate(texts) if t and own.langs and _LETTER(t)]
            langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if asked:
                p = own.probabilities([texts[i] for i in asked])
                for i, row, k in zip(asked, p.max(axis=1), p.argmax(axis=1), strict=True):
                    langs[i], scores[i] = own.langs[k], float(row)
            yield arrow_rows(_OUT, {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": langs, "score": scores})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, model: Model, text_col: str = "text", name: str = "_lang") -> DataFrame:
    """``docs`` with a struct ``name`` (pred, score) as identify() gives them; its other columns stay on the JVM."""
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        own, values = sent.value, texts.tolist()
        asked = [i for i, t in enumerate(values) if t and own.langs and _LETTER(t)]
        langs, scores = [UNDETERMINED] * len(values), [0.0] * len(values)
        if asked:
            p = own.probabilities([values[i] for i in asked])
            for i, row, k in zip(asked, p.max(axis=1), p.argmax(axis=1), strict=True):
                langs[i], scores[i] = own.langs[k], float(row)
        return pd.DataFrame({"pred": langs, "score": scores})

    return docs.withColumn(name, predict(F.col(text_col)))
