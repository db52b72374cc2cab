"""Quality classification by hierarchical empirical Bayes.

A document classifier (logistic regression over the text's form and its hashed words and word pairs, fitted on a
bounded sample of labelled rows) gives each document's evidence. Grouped aggregation sums the evidence by host and by
path within a host; a host's posterior is a beta mean shrunk toward the global prior, a path's is shrunk toward its
host's, each with a prior strength estimated by moments from how much the groups differ beyond chance. The document's
log odds are then moved by its path's log odds against the global prior, by no more than SITE_WEIGHT times that.
"""

from __future__ import annotations

from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, unused, written

#: Labelled rows that the document classifier is fitted on at most: those of smallest hash.
TRAIN_ROWS = 2000
SITE_WEIGHT, THRESHOLD, RIDGE, GRAM_RIDGE = 0.25, 0.5, 1e-3, 3e-3
#: Buckets that words and word pairs are hashed to (a power of two), words whose hashes a worker keeps.
BUCKETS, WORDS = 1 << 16, 300_000
#: Newton steps for all weights.
GRAM_STEPS = 4
#: Group posteriors up to so many rows (a few tens of bytes each) are broadcast, more are joined by shuffle.
BROADCAST_ROWS = 50_000
#: Strengths between which an estimated prior is held, in rows.
STRENGTH = (10.0, 1e6)


def form(text: str) -> list[float]:
    """What a text looks like, whatever its language; all values lie in about 0 to 1. The text has a word."""
    words = text.split()
    n, chars = len(words), len(text)
    letters = sum(map(str.isalpha, words)) / n
    upper = sum(map(str.isupper, words)) / n
    symbols = sum(map(text.count, "#$%&*")) / chars
    pipes = words.count("|") / n
    shouts = text.count("!") / n
    repeats = sum(map(eq, words, words[1:])) / n
    distinct = len(set(words)) / n
    sentences = (text.count(". ") + text.count(".\n")) / n
    length = min(chars / n / 20, 2.0)
    return [letters, upper, min(symbols * 5, 2.0), min(pipes * 2, 2.0), min(shouts, 2.0), repeats, distinct / (1 + np.log(n) / 10), min(sentences * 5, 2.0), length, min(np.log1p(n) / 8, 1.5)]


class _Buckets(dict):
    """word -> bucket, for as many words as a worker keeps."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = crc32(word.encode("utf-8", "surrogatepass"))
        return value


def ngrams(text: str, known: dict) -> np.ndarray:
    """Distinct hashed words and word pairs of a text that has a word, A-Z and their like in lower case."""
    words = text.lower().split()
    own = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    pairs = (own[:-1] * 0x9E3779B1 ^ own[1:]) * 0x85EBCA77 >> 7
    return np.unique(np.concatenate([own, pairs]) & (BUCKETS - 1))


class Model:
    """Weights of a text's form (the first is the bias) and of its hashed n-grams, which count 1 / sqrt of their number."""

    def __init__(self, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray, prior: float, grams: np.ndarray | None = None):
        self.weights, self.mean, self.scale, self.prior = weights, mean, scale, prior
        self.grams = np.zeros(BUCKETS, np.float32) if grams is None else grams.astype(np.float32)
        self.known = _Buckets()

    def __getstate__(self):
        return self.__dict__ | {"known": _Buckets()}

    def evidence(self, texts) -> np.ndarray:
        """Probability that each text is good; 0 for texts without a word, and the prior where nothing was learned."""
        out = np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if t and not t.isspace()]
        if some:
            x = (np.array([form(texts[i]) for i in some]) - self.mean) / self.scale
            grams = np.array([self.grams[g].sum() / len(g) ** 0.5 for g in (ngrams(texts[i], self.known) for i in some)])
            out[some] = 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0] + grams, -30, 30)))
        return out


def fit(texts: list[str], good: list[int]) -> Model:
    """Logistic regression with ridges: Newton's method for the form alone, then a few steps for all weights by conjugate gradients."""
    rows = [(t, g) for t, g in zip(texts, good, strict=True) if t and not t.isspace()]
    y = np.array([g for _, g in rows], float)
    if not rows or y.min() == y.max():
        prior = float(y.mean()) if rows else 0.5
        k, p = len(form("a")), min(max(prior, 0.01), 0.99)
        return Model(np.append(np.log(p / (1 - p)), np.zeros(k)), np.zeros(k), np.ones(k), p)
    x = np.array([form(t) for t, _ in rows])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    known = _Buckets()
    grams = [ngrams(t, known) for t, _ in rows]
    size = np.array([len(g) for g in grams])
    at, start, each = np.concatenate(grams), np.concatenate([[0], np.cumsum(size)[:-1]]), np.repeat(size**-0.5, size)
    used, at = np.unique(at, return_inverse=True)
    d = z.shape[1]
    ridge = len(x) * np.concatenate([[0], np.full(d - 1, RIDGE), np.full(len(used), GRAM_RIDGE)])
    dot = lambda v: z @ v[:d] + np.add.reduceat(v[d:][at] * each, start)
    turned = lambda u: np.concatenate([z.T @ u, np.bincount(at, np.repeat(u, size) * each, len(used))])
    w = np.zeros(d + len(used))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w[:d], -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge[:d]), z.T @ (y - p) - ridge[:d] * w[:d])
        w[:d] += step
        if np.abs(step).max() < 1e-8:
            break
    for _ in range(GRAM_STEPS):
        p = 1 / (1 + np.exp(-np.clip(dot(w), -30, 30)))
        curve = p * (1 - p) + 1e-9
        slope = turned(y - p) - ridge * w
        scaled = 1 / (ridge + np.concatenate([(z * z * curve[:, None]).sum(axis=0), np.bincount(at, np.repeat(curve, size) * each**2, len(used))]))
        step, rest = np.zeros_like(w), slope
        way = near = scaled * rest
        size_of = rest @ near
        first = size_of
        for _ in range(3 * GRAM_STEPS):
            if size_of <= 1e-6 * first:
                break
            ahead = turned(curve * dot(way)) + ridge * way
            by = size_of / (way @ ahead)
            step, rest = step + by * way, rest - by * ahead
            near = scaled * rest
            way, size_of = near + (rest @ near) / size_of * way, rest @ near
        w = w + step
    out = np.zeros(BUCKETS)
    out[used] = w[d:]
    return Model(w[:d], mean, scale, float(y.mean()), out)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows; labels without a document, null labels and null texts don't count."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = known.withColumn("draw", draw).where(F.col("draw") < int(min(1.0, 1.5 * rows / max(n, 1)) * (1 << 30))).orderBy("draw", "doc_id").limit(rows)
    # at most ``rows`` rows of two numbers are broadcast, so no text is shuffled
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # many rows may share an id: the driver gets ``rows`` rows at most
    sample = texts.join(F.broadcast(chosen), "doc_id").orderBy("draw", "doc_id", "text").limit(rows).collect()
    return fit([r.text for r in sample], [int(r.quality > 0) for r in sample])


def with_evidence(docs: DataFrame, model: Model, text_col: str = "text", name: str = "_p") -> DataFrame:
    """``docs`` with ``name``, the classifier's evidence; other columns stay on the JVM."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series(model.evidence(texts.tolist()))

    return docs.withColumn(name, evidence(F.col(text_col)))


def _logit(p):
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def site_posteriors(scored: DataFrame, host: str, path: str) -> DataFrame:
    """(_host, _path, path_post, host_post, prior) from rows with _p; nulls are a host or path of their own.

    Only sums of each path, pre-aggregated before the shuffle, take part; the moments are single rows.
    """
    paths = scored.groupBy(F.col(host).alias("_host"), F.col(path).alias("_path")).agg(F.count("*").alias("n"), F.sum("_p").alias("s"), F.sum(F.col("_p") * F.col("_p")).alias("q"))
    paths = written(paths, "path-sums")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"))
    total = hosts.agg(F.sum("hn").alias("tn"), F.sum("hs").alias("ts"), F.sum("hq").alias("tq"), F.count("*").alias("nh"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("th"), F.sum(F.col("hn") * F.col("hn")).alias("hn2"))
    inner = paths.agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("tp"), F.count("*").alias("np"), F.sum(F.col("n") * F.col("n")).alias("pn2"))
    one = total.crossJoin(inner).first()  # one row of sums
    if not one.tn:
        return paths.select("_host", "_path", *(F.lit(0.5).alias(c) for c in ("path_post", "host_post", "prior")))
    prior = one.ts / one.tn
    within = max((one.tq - one.tp) / max(one.tn - one.np, 1), 1e-6)
    between_h = (one.th - one.ts * prior - (one.nh - 1) * within) / max(one.tn - one.hn2 / one.tn, 1e-9)
    between_p = (one.tp - one.th - (one.np - one.nh) * within) / max(one.tn - one.pn2 / one.tn, 1e-9)
    k_h = min(max(within / between_h, STRENGTH[0]), STRENGTH[1]) if between_h > 0 else STRENGTH[1]
    k_p = min(max(within / between_p, STRENGTH[0]), STRENGTH[1]) if between_p > 0 else STRENGTH[1]
    posts = hosts.select(F.col("_host").alias("_of"), ((F.lit(k_h * prior) + F.col("hs")) / (F.lit(k_h) + F.col("hn"))).alias("host_post"))
    return paths.join(posts, F.col("_host").eqNullSafe(F.col("_of"))).select("_host", "_path", ((F.lit(k_p) * F.col("host_post") + F.col("s")) / (F.lit(k_p) + F.col("n"))).alias("path_post"), "host_post", F.lit(prior).alias("prior"))


def scored(docs: DataFrame, model: Model, host: str = "source", path: str = "lang", text_col: str = "text", name: str = "_scores") -> DataFrame:
    """``docs`` with a struct ``name`` (p: evidence, host_post, path_post, quality), all doubles from 0 to 1.

    Texts that are null or have no word are of quality 0. The table is read twice, once for the groups' sums; what is
    joined to it is a row per path, broadcast if there are at most BROADCAST_ROWS and shuffled (skew split) beyond.
    Columns of any other name are kept as they are; an empty table stays empty.
    """
    p = unused(docs, "_p")
    seen = with_evidence(docs, model, text_col, p)
    posts = written(site_posteriors(seen.select(F.col(host).alias("_h"), F.col(path).alias("_d"), F.col(p).alias("_p")), "_h", "_d"), "site-posteriors")
    site = unused(seen, "_site")
    side = posts.select(F.struct("*").alias(site))
    side = F.broadcast(side) if posts.count() <= BROADCAST_ROWS else side
    joined = seen.join(side, F.col(host).eqNullSafe(F.col(f"{site}._host")) & F.col(path).eqNullSafe(F.col(f"{site}._path")), "left")
    odds = _logit(F.col(p)) + SITE_WEIGHT * (_logit(F.col(f"{site}.path_post")) - _logit(F.col(f"{site}.prior")))
    value = F.when(F.col(p) > 0, 1 / (1 + F.exp(-odds))).otherwise(0.0)
    out = F.struct(F.col(p).alias("p"), F.col(f"{site}.host_post").alias("host_post"), F.col(f"{site}.path_post").alias("path_post"), value.alias("quality"))
    return joined.withColumn(name, out).drop(p, site)


def with_quality(docs: DataFrame, model: Model, host: str = "source", path: str = "lang", text_col: str = "text") -> DataFrame:
    """``docs`` with _p, _host_post, _path_post and _quality from scored(); columns that have these names are replaced."""
    name = unused(docs, "_scores")
    out = scored(docs, model, host, path, text_col, name)
    return out.withColumns({f"_{c}": F.col(f"{name}.{c}") for c in ("p", "host_post", "path_post", "quality")}).drop(name)
