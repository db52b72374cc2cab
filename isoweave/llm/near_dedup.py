"""MinHash near-duplicate detection with odd sketches.

Each text's distinct word shingles give SAMPLES MinHash values. They are banded for candidates (BANDS of ROWS values,
a link at the threshold is missed with a probability under 2e-6) and folded into a parity bitmap, the odd sketch,
whose XOR population count with another's estimates how much of both sets is shared and rules candidates out. What
is left is confirmed on the full sets. Links make connected components.

Texts with equal sets are one class from the start. Of a band's bucket each member is first confirmed against the
least member, then against the likeliest of PIVOTS rows of its bucket's largest component. What is still apart is
compared in blocks of bounded size, best partners first, and only across components: rows of a bucket's largest
component meet the bucket's other rows alone. So a large group of near copies costs a few comparisons per member, and
yet no link that matters is skipped: at the end the rows that a sketch can't tell from some row of another component
bring their full sets to the blocks, where all pairs across components are confirmed. A block returns links that make
a forest, never all its pairs.
"""

from __future__ import annotations

import hashlib
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import as_bytes, compare_within, shared_buckets
from .common import arrow_rows, text_batches, unused, written
from .graph import components

#: Fixed layout: MinHash values per band, bands, bits of the odd sketch.
ROWS, BANDS, SKETCH_BITS = 6, 44, 512
SAMPLES = ROWS * BANDS
#: Distinct words whose hashes a worker keeps.
WORDS = 300_000
#: Candidate ids up to so many (8 bytes each) are broadcast to pick their texts, more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Rows of a bucket's largest component that its other rows are tried with, rows of a block that brings sketches.
PIVOTS, SKETCH_ROWS = 8, 256
_SIG = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Rows and shingles of a block whose rows bring their full sets, and cells of the matrices that count shared shingles.
SET_ROWS, SET_SHINGLES, CELLS = 1024, 1 << 18, 1 << 22
_LIVE = ("key", "id", "n_shingles", "comp")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, k: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; words end at ASCII white space, A-Z count as a-z."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    size = min(k, n)
    h = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        h = _mixed(h + own[i : n - size + 1 + i])
    return np.unique(h)


_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES least values of each of some sets that aren't empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.empty((len(sets), SAMPLES), np.uint32)
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sets):  # blocks that stay in the processor's cache
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 32_768, side="right")))
        x = (np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32)
        at = ends[lo:hi] - sizes[lo:hi] - (ends[lo - 1] if lo else 0)
        buf = np.empty_like(x)
        for s in range(SAMPLES):
            np.multiply(x, _A[s], out=buf)
            np.add(buf, _B[s], out=buf)
            out[lo:hi, s] = np.minimum.reduceat(buf, at)
        lo = hi
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(mins), BANDS)).copy()
    for r in range(ROWS):
        h = _mixed(h + mins[:, r::ROWS].astype(np.uint64))
    return h.view(np.int64)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Parity bitmaps: each sample flips the bit that its number and value hash to."""
    bit = (_mixed(mins.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flips = np.bincount((np.arange(len(mins))[:, None] * SKETCH_BITS + bit).ravel(), minlength=len(mins) * SKETCH_BITS)
    return np.packbits((flips & 1).astype(bool).reshape(len(mins), SKETCH_BITS), axis=1)


def most_bits(similarity: float, deviations: float = 5.5) -> int:
    """Differing bits that a pair of this similarity has at most, but for chance beyond so many standard deviations."""
    flips = 2 * SAMPLES * (1 - similarity)
    decay = exp(-2 * flips / SKETCH_BITS)
    sd = sqrt((decay * 2 * sqrt(SAMPLES * similarity * (1 - similarity))) ** 2 + SKETCH_BITS / 4 * (1 - decay**2))
    return int(SKETCH_BITS / 2 * (1 - decay) + deviations * sd)


def signatures(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_key: digest of the set, bands, sketch); the last three are null for empty sets."""
    text_batches(docs.sparkSession)

    def run(batches):
        words = _WordHashes()
        for batch in batches:
            sets = [shingles(t, k, words) for t in batch.column(1).to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            cols: dict = {"doc_id": batch.column(0), "n_shingles": list(map(len, sets))}
            cols |= {c: [None] * len(sets) for c in ("class_key", "bands", "sketch")}
            if some:
                mins = minhashes([sets[i] for i in some])
                for i, keys, sketch in zip(some, band_keys(mins), odd_sketches(mins), strict=True):
                    cols["class_key"][i], cols["bands"][i], cols["sketch"][i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), keys, sketch.view(np.int64)
            yield arrow_rows(_SIG, cols)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, class_key binary, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, shingles: array of longs) of rows (id, text)."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        words = _WordHashes()
        for batch in batches:
            yield arrow_rows(schema, {"id": batch.column(0), "shingles": [shingles(t, k, words).view(np.int64) for t in batch.column(1).to_pylist()]})

    return docs.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets share at least ``percent`` of their union."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
    union = F.size("sa").cast("long") + F.size("sb") - F.col("common")
    return both.where(100 * F.col("common") >= percent * union).select("a", "b")


def _possible(group: pa.Table, left: np.ndarray, right: np.ndarray, most: int, percent: int):
    """Slices of ``left`` with the sketches' differing bits to ``right``, and which pairs lie in two components and aren't ruled out."""
    comp, size = (group.column(c).to_numpy() for c in ("comp", "n_shingles"))
    bits = as_bytes(group.column("sketch"), SKETCH_BITS // 64).view("u8")
    for lo in range(0, len(left), 64):
        l = left[lo : lo + 64]
        differ = np.bitwise_count(bits[l][:, None, :] ^ bits[right][None, :, :]).sum(axis=2, dtype=np.int32)
        small, large = np.minimum(size[l][:, None], size[right]), np.maximum(size[l][:, None], size[right])
        yield l, differ, (comp[l][:, None] != comp[right]) & (differ <= most) & (100 * small >= percent * large)


def _live(rows: DataFrame) -> DataFrame:
    """Rows (key, id, n_shingles, comp, ...) of buckets with several components: ``main`` marks those of the bucket's largest, n_main, n_rest, v_main, v_rest count rows and shingles."""
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("v"))
    top = per.groupBy("key").agg(F.max(F.struct("c", "comp", "v")).alias("top"), F.sum("c").alias("n_all"), F.sum("v").alias("v_all"), F.count("*").alias("k")).where("k > 1")
    top = top.select("key", F.col("top.comp").alias("main_comp"), F.col("top.c").alias("n_main"), (F.col("n_all") - F.col("top.c")).alias("n_rest"), F.col("top.v").alias("v_main"), (F.col("v_all") - F.col("top.v")).alias("v_rest"))
    return rows.join(written(top, "apart"), "key").withColumn("main", F.col("comp") == F.col("main_comp")).drop("main_comp")


def _best_pivots(live: DataFrame, most: int, percent: int) -> DataFrame:
    """Pairs (a, b) of each row and the likeliest of the pivots of its buckets, if size and sketch leave one.

    A bucket's pivots are rows of its largest component, the least ones by PIVOTS hashes.
    """
    draws = [F.xxhash64("id", F.lit(i)) for i in range(PIVOTS)]
    main = live.where("main").select("key", "id", "n_shingles", "sketch", F.array(*draws).alias("draws"))
    least = main.groupBy("key").agg(F.array(*(F.min(F.col("draws")[i]) for i in range(PIVOTS))).alias("least"))
    chosen = main.join(least, "key").where(F.exists(F.zip_with("draws", "least", lambda x, y: x == y), lambda x: x))
    chosen = written(chosen, "pivot-rows")  # with no aggregate above it, the join of a hot bucket can be split
    pivots = written(chosen.groupBy("key").agg(F.collect_list(F.struct("id", "n_shingles", "sketch")).alias("pivots")), "pivots")
    differ = lambda p: F.aggregate(F.zip_with("sketch", p["sketch"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = lambda p: 100 * F.least(p["n_shingles"], "n_shingles") >= percent * F.greatest(p["n_shingles"], "n_shingles")
    tried = live.where("not main").select("key", "id", "n_shingles", "sketch").join(pivots, "key")
    best = F.array_min(F.transform(F.filter("pivots", near), lambda p: F.struct(differ(p).alias("differ"), p["id"].alias("pivot"))))
    best = tried.select("id", best.alias("best")).where(F.col("best.differ") <= most).groupBy("id").agg(F.min("best").alias("best"))
    return best.select(F.least("id", "best.pivot").alias("a"), F.greatest("id", "best.pivot").alias("b")).distinct()


def _blocks(rows: int, shingles: int | None = None) -> dict:
    """Block numbers for compare_within over rows of _live()."""
    count = lambda n, v: F.ceil(F.col(n) / rows) if shingles is None else F.greatest(F.ceil(F.col(n) / rows), F.ceil(F.col(v) / shingles))
    return {"blocks": count("n_rest", "v_rest"), "main": F.col("main"), "main_blocks": count("n_main", "v_main")}


def _best_across(rows: DataFrame, most: int, percent: int) -> DataFrame:
    """Each row's best partner (a, b) of another component in a bucket, if size and sketch leave one."""

    def compare(group: pa.Table, left: np.ndarray, right: np.ndarray):
        ids = group.column("id").to_numpy()
        x, y = [], []
        for l, differ, ok in _possible(group, left, right, most, percent):
            differ[~ok] = SKETCH_BITS + 1
            best = differ.argmin(axis=1)
            i = np.flatnonzero(differ[np.arange(len(l)), best] <= SKETCH_BITS)
            x.append(ids[l[i]])
            y.append(ids[right[best[i]]])
        x, y = np.concatenate(x), np.concatenate(y)
        return (np.minimum(x, y), np.maximum(x, y)) if len(x) else None

    return compare_within(rows, compare, "a long, b long", _PAIR, **_blocks(SKETCH_ROWS)).distinct()


def _undecided(rows: DataFrame, most: int, percent: int) -> DataFrame:
    """The rows (of _LIVE) that size and sketch can't tell from some row of another component in their bucket."""

    def compare(group: pa.Table, left: np.ndarray, right: np.ndarray):
        some = np.zeros(group.num_rows, bool)
        for l, _, ok in _possible(group, left, right, most, percent):
            some[l] |= ok.any(axis=1)
            some[right] |= ok.any(axis=0)
        at = np.flatnonzero(some)
        return tuple(group.column(c).to_numpy()[at] for c in _LIVE) if len(at) else None

    schema = pa.schema([(c, pa.int64()) for c in _LIVE])
    return compare_within(rows, compare, ", ".join(f"{c} long" for c in _LIVE), schema, **_blocks(SKETCH_ROWS)).distinct()


def shared_counts(values: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values the sets of each pair of ``left`` and ``right`` share, if it has two sets; ``row``: the set that a value is of."""
    order = np.argsort(values, kind="stable")
    value, row = values[order], row[order]
    new = np.r_[True, value[1:] != value[:-1]]
    often = np.diff(np.r_[np.flatnonzero(new), len(value)]) > 1
    word = np.cumsum(new) - 1
    keep = often[word]
    word, row = (np.cumsum(often) - 1)[word[keep]], row[keep]
    rows = int(max(left.max(), right.max())) + 1
    words = int(often.sum())
    wide = min(words, max(256, CELLS // rows))
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, words, wide or 1):
        a, b = np.searchsorted(word, (lo, lo + wide))
        cells = np.zeros((rows, wide), np.float32)
        cells[row[a:b], word[a:b] - lo] = 1
        out += cells[left] @ cells[right].T
    return out.astype(np.int64)  # counts below 2**24 are exact in single precision


def forest(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Positions of the links between components x and y that join what links before them have left apart."""
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while (w := up.get(v, v)) != v:
            up[v] = up.get(w, w)
            v = w
        return v

    kept = []
    for at, (v, w) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        v, w = root(v), root(w)
        if v != w:
            up[v] = w
            kept.append(at)
    return kept


def _confirmed_within(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) on full sets that join all components which have a link within a bucket of ``rows`` (of _live())."""

    def compare(group: pa.Table, left: np.ndarray, right: np.ndarray):
        ids, comp, size = (group.column(c).to_numpy() for c in ("id", "comp", "n_shingles"))
        if (comp == comp[0]).all():
            return None
        sets = group.column("shingles").combine_chunks()
        shared = shared_counts(sets.flatten().to_numpy(), np.repeat(np.arange(len(ids)), size), left, right)
        ok = (100 * shared >= percent * (size[left][:, None] + size[right] - shared)) & (comp[left][:, None] != comp[right])
        i, j = np.nonzero(ok)
        i, j = left[i], right[j]
        kept = forest(comp[i], comp[j])
        return (np.minimum(ids[i[kept]], ids[j[kept]]), np.maximum(ids[i[kept]], ids[j[kept]])) if kept else None

    return compare_within(rows.join(sets, "id"), compare, "a long, b long", _PAIR, **_blocks(SET_ROWS, SET_SHINGLES)).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Rows with fewer than k words have their whole sequence as one shingle; rows without a word or text have no
    shingle, link with nothing and are kept. Rows that share an id are one node; a null id's row is by itself
    (component_id null) and kept. ``kept``: the row has its component's least id.
    """
    spark = docs.sparkSession
    sigs = written(signatures(docs, k, id_col, text_col), "signatures")
    some = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = written(some.groupBy("class_key").agg(F.min("doc_id").alias("rep")), "classes")
    members = written(some.select("doc_id", "class_key").join(classes, "class_key").select("doc_id", "rep").distinct(), "members")
    reps = some.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "class_key"], "left_semi").dropDuplicates(["doc_id", "class_key"])
    nodes = written(reps.select(F.col("doc_id").alias("id"), "n_shingles", "sketch", "bands", "class_key"), "nodes")
    banded = shared_buckets(nodes.select("id", F.explode("bands").alias("key")), "bands")
    wanted = written(banded.select("id").distinct(), "candidates")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    sets = written(full_sets(texts.join(side, "id", "left_semi"), k), "sets")

    first = banded.where("first < id").groupBy("id").agg(F.min("first").alias("a")).select("a", F.col("id").alias("b"))
    # an id with several texts joins them as one node
    shared = members.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    edges = members.join(shared, "doc_id", "left_semi").where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = written(_confirmed(first, sets, percent).unionByName(edges), "links")
    most = most_bits(percent / 100)
    done = written(first, "tried")
    for turn in ("pivots", "best", "last"):
        comps = written(components(links), "components")
        placed = nodes.select("id", "n_shingles", "sketch").join(comps, F.col("id") == F.col("node"), "left")
        placed = written(placed.select("id", "n_shingles", "sketch", F.coalesce("component", "id").alias("comp")), "placed")
        live = written(_live(banded.select("key", "id").join(placed, "id")), "live")
        if live.isEmpty():
            return _labelled(sigs, members, comps)
        if turn == "last":
            new = written(_confirmed_within(_live(written(_undecided(live, most, percent), "undecided")), sets, percent), "links")
            if new.isEmpty():
                return _labelled(sigs, members, comps)
        else:
            found = (_best_pivots if turn == "pivots" else _best_across)(live, most, percent)
            tried = written(found.join(done, ["a", "b"], "left_anti"), "tried")
            done = done.unionByName(tried)
            new = written(_confirmed(tried, sets, percent), "links")
        links = links.unionByName(new)
    return _labelled(sigs, members, written(components(links), "components"))


def _labelled(sigs: DataFrame, members: DataFrame, comps: DataFrame) -> DataFrame:
    placed = members.join(comps, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    placed = written(placed.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "labels")
    out = sigs.select("doc_id", "n_shingles").join(placed, "doc_id", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component those with its least id.

    Rows without a word, text or id stay; rows that share an id stay or go together; an empty table stays empty.
    """
    name = unused(docs, "_gone")
    gone = near_duplicates(docs, k, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    gone = written(gone, "gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, F.col(id_col) == F.col(name), "left_anti")
