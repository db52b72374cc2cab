"""Embedding near-duplicates by collision-counting projections.

Every vector is projected on many random directions. Two vectors collide in a projection when they lie in one
window of it centred on either; a pair's collisions are counted over PROJECTIONS directions and pairs that reach the
recall-calibrated count are verified by their cosine in double precision. Counting over all pairs would be
quadratic, since far vectors collide in a constant share of projections too. So the counting runs within buckets: in
each of some tables the vectors are sorted by the halves that a few further projections put them in. Bits per bucket
follow the number of vectors and the number of tables follows from the bits, so that the calibrated recall holds.

Equal vectors are one class from the start. Vectors of different lengths never meet.
"""

from __future__ import annotations

from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import compare_within, packed
from .common import arrow_rows, written
from .graph import components

#: Projections whose collisions are counted, the window's half width in units of a projection's spread.
PROJECTIONS, HALF_WINDOW = 48, 0.45
#: Chance to miss a pair at the threshold, by the buckets and by the count.
MISS_BUCKETS, MISS_COUNT = 1e-3, 1e-4
#: Vectors that a bucket is meant to have.
BUCKET = 16
_STEPS = 40  # of a projection's unit, as they are kept in 8 bits
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_CODED = pa.schema([("id", pa.int64()), ("codes", pa.list_(pa.int64())), ("steps", pa.binary())])


def least_count(cosine: float) -> int:
    """Collisions that a pair of this cosine reaches, but with a chance of MISS_COUNT."""
    p = erf((HALF_WINDOW - 1 / _STEPS) / sqrt(2 - 2 * cosine) / sqrt(2))
    below = 0.0
    for k in range(PROJECTIONS + 1):
        below += comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
        if below > MISS_COUNT:
            return k
    return PROJECTIONS


def layout(n: int, cosine: float) -> tuple[int, int]:
    """(bits of a bucket, tables) for n vectors."""
    bits = max(1, min(40, round(log2(max(n, 2) / BUCKET))))
    together = (1 - acos(cosine) / pi) ** bits
    return bits, ceil(log(MISS_BUCKETS) / log(1 - together)) if together < 1 else 1


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([dim, seed]).standard_normal((dim, count))


def valid(vector):
    """Neither null nor empty nor zero, all components finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _coded(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """(id, codes: bucket of each table, steps: its projections in 8 bits) of (id, v)."""

    def run(batches):
        for batch in batches:
            col = batch.column(1)
            sizes = np.asarray(col.value_lengths())
            flat, offsets = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])
            codes, steps = [None] * len(sizes), [None] * len(sizes)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = np.stack([flat[offsets[i] : offsets[i] + dim] for i in at])
                x /= np.abs(x).max(axis=1, keepdims=True)  # huge or tiny components neither overflow nor vanish
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                q = np.clip(np.rint(x @ directions(dim, PROJECTIONS, 1) * _STEPS), -127, 127).astype(np.int8)
                signs = (x @ directions(dim, bits * tables, 2) > 0).reshape(len(at), tables, bits)
                key = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
                key |= (np.arange(tables, dtype=np.int64) << 40) | (int(dim) % 4096 << 50)
                for i, c, s in zip(at, key, q, strict=True):
                    codes[i], steps[i] = c, s.tobytes()
            yield arrow_rows(_CODED, {"id": batch.column(0), "codes": codes, "steps": steps})

    return vectors.select("id", "v").mapInArrow(run, "id long, codes array<long>, steps binary")


def _colliding(coded: DataFrame, cosine: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, that share a bucket and reach the count."""
    need, width = least_count(cosine), round(HALF_WINDOW * _STEPS)

    def compare(group: pa.Table, left: np.ndarray, right: np.ndarray):
        ids, steps = group.column("id").to_numpy(), packed(group.column("steps"), "i1").astype(np.int16)
        codes = np.stack([c.values.to_numpy() for c in group.column("codes")])
        table = (int(group.column("key")[0].as_py()) >> 40) & 1023
        x, y = [], []
        for lo in range(0, len(left), 64):
            l = left[lo : lo + 64]
            ok = (np.abs(steps[l][:, None, :] - steps[right][None, :, :]) <= width).sum(axis=2) >= need
            i, j = np.nonzero(ok if left is not right else ok & (l[:, None] < right))
            i, j = l[i], right[j]
            if table and len(i):  # a pair is told of in the first table alone that has it in one bucket
                new = ~(codes[i, :table] == codes[j, :table]).any(axis=1)
                i, j = i[new], j[new]
            x.append(ids[i])
            y.append(ids[j])
        x, y = np.concatenate(x), np.concatenate(y)
        return (np.minimum(x, y), np.maximum(x, y)) if len(x) else None

    rows = coded.select("id", "steps", "codes", F.explode("codes").alias("key"))
    counts = written(coded.select(F.explode("codes").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    return compare_within(rows.join(counts, "key"), compare, "a long, b long", _PAIR)


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    n_links: other rows whose vectors were found to have at least this cosine, equal ones included. Vectors that are
    null, empty, zero or hold a null or a number that isn't finite link with nothing. Rows with a null id have a null
    component and are kept; rows that share an id are one node of the components.
    """
    rows = written(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")), "vectors")
    good = rows.where(valid(F.col("v")) & F.col("vec_id").isNotNull())
    keyed = good.withColumn("vk", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256))
    classes = written(keyed.groupBy("vk").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")), "vector-classes")
    members = written(keyed.select("vec_id", "vk").join(classes, "vk").select("vec_id", "rep", "size"), "vector-members")
    reps = keyed.join(classes.select("vk", F.col("rep").alias("vec_id"), "size"), ["vk", "vec_id"]).dropDuplicates(["vk"])
    reps = written(reps.select(F.col("vec_id").alias("id"), "v", "size"), "vector-reps")
    bits, tables = layout(reps.count(), cosine)
    coded = written(_coded(reps, bits, tables), "codes")
    pairs = written(_colliding(coded, cosine), "pairs")
    unit = reps.select("id", "size", F.transform("v", lambda x: x / F.array_max(F.transform("v", F.abs))).alias("v"))
    unit = written(unit.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))), "unit-vectors")
    a = unit.select(F.col("id").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na"), F.col("size").alias("size_a"))
    b = unit.select(F.col("id").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb"), F.col("size").alias("size_b"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    links = written(pairs.join(a, "a").join(b, "b").where(dot / (F.col("na") * F.col("nb")) >= cosine).select("a", "b", "size_a", "size_b"), "vector-links")
    both = links.select(F.col("a").alias("rep"), F.col("size_b").alias("s")).unionByName(links.select(F.col("b").alias("rep"), F.col("size_a").alias("s")))
    near = both.groupBy("rep").agg(F.sum("s").alias("near"))
    comps = components(links.select("a", "b"))
    per_rep = classes.join(near, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left")
    per_rep = written(per_rep.select("rep", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")).distinct(), "per-class")
    placed = members.join(per_rep, "rep").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component_id"))
    out = rows.select("vec_id").join(placed, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
