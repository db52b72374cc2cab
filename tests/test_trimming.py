"""Trimming against plain loops over each base, features of every kind, with and without the originals' start rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoweave.operators import trimming as tr

SCHEMA = "f long, position long, depth long, kind string, site int, annotated boolean"


def ratio(x, i, least):
    if i == 0 or i == len(x) - 1:
        return 20.0 if i == 0 else 0.0
    a, b = x[max(0, i - 50) : i], x[i : i + 50]
    r = np.mean(b) / np.mean(a) if sum(a) else 20.0
    told = min(a) > max(b) and r < 1 and np.mean(a) >= least or max(a) < min(b) and r > 1 and np.mean(b) >= least
    return r if told else 1.0


def site_cut(x, site):
    """(first base, last base) that stay, None if the site isn't cut."""
    n, best, found = len(x), 0.0, None
    for c in range(n - 1, 0, -1) if site == 1 else range(n):
        keep, go = (x[c:], x[:c]) if site == 1 else (x[:c], x[c:])
        place = (c, n - 1) if site == 1 else (0, c - 1)
        if not sum(go):
            if len(go) > 1 or site == 1:
                return place
            break
        r = np.mean(keep) / np.mean(go) if keep else 0.0
        if r > best:
            best, found = r, place
    return found if best >= 5 else None


def by_loops(x, kind, site, annotated, samples, exon, intron, compat):
    n, peak = len(x), max(x) / samples
    if kind == "exon" and annotated:
        return [(0, n - 1, sum(x))]
    if kind == "exon" and site and n <= 200:
        cut = site_cut(x, site)
        a, b = cut or (0, n - 1)
        size = b - a + 1
        return [(a, b, sum(x[a : b + 1]))] if size >= (5 if cut else 1) and sum(x[a : b + 1]) / samples >= exon * size else []
    t = max(peak * 0.01, exon) if kind == "exon" else intron
    gap, void = (50 if kind == "exon" and peak <= 5 else 1), (t if kind == "exon" else exon) * samples
    out, begin = [], None
    for i, v in enumerate(x):
        r = ratio(x, i, exon)
        clear = i + gap >= n or max(x[i : i + gap]) <= void
        if i == n - 1 or (v <= t * samples or r < 0.1) and clear:
            if begin is not None and i - begin + 1 >= 5 and sum(x[begin:i]) / samples >= t * (i - begin + 1):
                out.append((begin, i, sum(x[begin:i])))
            begin = None
        elif begin is None and (v > (t if compat else t * samples) if kind == "exon" else r > 10 and v >= t * samples):
            begin = i
    return out


@pytest.mark.parametrize(("exon", "compat"), [(0.0, False), (0.5, False), (0.5, True)])
def test_pieces_by_loops(spark, exon, compat):
    rng = np.random.default_rng(5)
    features = {}
    for f in range(160):
        n = int(rng.choice([1, 2, 4, 7, 40, 130, 199, 201, 260]))
        levels = rng.choice([0, 0, 1, 3, 8, 15, 40, 300, 4000], 6)
        x = [int(levels[i * 6 // n] and levels[i * 6 // n] + rng.integers(0, 3)) for i in range(n)]
        features[f] = (x, "exon" if f % 4 else "intron", f % 3 if f % 4 else 0, f % 13 == 0)
    rows = [(f, 1000 * f + i, v, k, s, a) for f, (x, k, s, a) in features.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in tr.trimmed(df, ["f"], 3, exon, 1.0, compat).collect())
    want = sorted((f, 1000 * f + a, 1000 * f + b, s, a == 0, b == len(x) - 1) for f, (x, k, site, ann) in features.items() for a, b, s in by_loops(x, k, site, ann, 3, exon, 1.0, compat))
    assert got == want and len(want) > 100
    ratios = {(r.f, r.position - 1000 * r.f): r.ratio for r in tr.change_ratio(df, ["f"], exon).collect()}
    assert all(ratios[f, i] == pytest.approx(20.0 if i == 0 else ratio(x, i, exon)) for f, (x, *_) in features.items() for i in range(len(x)))


def test_no_bases_and_one_shuffle(spark):
    assert tr.trimmed(spark.createDataFrame([], SCHEMA), ["f"], 3).collect() == []
    df = spark.range(1000).selectExpr("id % 7 as f", "id as position", "id as depth", "'exon' as kind", "0 as site", "false as annotated")
    plan = tr.trimmed(df, ["f"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_bases_of_features(spark):
    features = spark.createDataFrame([("c", 1, 5, "a"), ("c", 4, 6, "b"), ("d", 1, 2, "z")], "chrom string, low long, high long, name string")
    runs = spark.createDataFrame([("c", 0, 1, 2), ("c", 4, 9, 7)], "chrom string, start long, end long, depth long")
    got = {}
    for r in tr.feature_bases(features, runs, ["name"]).orderBy("position").collect():
        got.setdefault(r["name"], []).append(r.depth)
    assert got == {"a": [2, 0, 0, 7, 7], "b": [7, 7, 7], "z": [0, 0]}


def test_strand_of_pieces(spark):
    x = spark.createDataFrame([("+", "+", True, True), ("+", "-", True, True), ("+", "-", True, False), ("+", "-", False, True), ("+", "+", False, False)], "a string, b string, first boolean, last boolean")
    assert [r[0] for r in x.select(tr.piece_strand(F.col("a"), F.col("b"), F.col("first"), F.col("last"))).collect()] == ["+", "*", "+", "-", "?"]
