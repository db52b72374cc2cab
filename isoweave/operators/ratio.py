"""Isoform ratios of single cells: normalising, filtering, pairing, observed and technical variability.

Long tables throughout: abundances (asm, path, cell, expr), depth (cell, ercc, cellular, other), stages (cell, stage).
The functions repair what the file-based original does by accident; ``compat`` brings those accidents back where they
change results (see the README).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import path_ratio, reported_ratio

STAGES = ("G1", "S", "G2M")
TOP_PATHS, SIGNIFICANT, SIMULATIONS = 10, 0.05, 1000


def scale_factors(depth: DataFrame) -> DataFrame:
    """(cell, total, cell_fraction, ercc_fraction, cell_scale, ercc_scale); scales are median / own."""
    frac = depth.withColumn("total", F.col("ercc") + F.col("cellular") + F.col("other")).withColumns({"cell_fraction": F.expr("cellular / total"), "ercc_fraction": F.expr("ercc / total")})
    mid = frac.agg(F.percentile("cell_fraction", F.lit(0.5)).alias("mc"), F.percentile("ercc_fraction", F.lit(0.5)).alias("me"))  # one row
    return frac.crossJoin(F.broadcast(mid)).select("cell", "total", "cell_fraction", "ercc_fraction", (F.col("mc") / F.col("cell_fraction")).alias("cell_scale"), (F.col("me") / F.col("ercc_fraction")).alias("ercc_scale"))


def normalized(abundance: DataFrame, depth: DataFrame) -> DataFrame:
    """Abundances with ``norm``: expr over the cell's classified reads, times its scale, per billion."""
    scales = scale_factors(depth).select("cell", "cell_scale")
    per = depth.select("cell", (F.col("ercc") + F.col("cellular")).alias("classified")).join(scales, "cell")
    return abundance.join(per, "cell").withColumn("norm", F.col("expr") / F.col("classified") * F.col("cell_scale") * 1e9).drop("classified", "cell_scale")


def expressed(norm: DataFrame, level: float = 10.0, cells: int = 10, compat: bool = False) -> DataFrame:
    """(asm, path, mean) of paths expressed in enough cells and of enough mean; with ``compat`` an ASM's first path needs no mean."""
    per = norm.groupBy("asm", "path").agg(F.count_if(F.col("norm") >= level).alias("n"), F.avg("norm").alias("mean"))
    ok = F.col("mean") >= level
    if compat:
        per = per.withColumn("first", F.min("path").over(Window.partitionBy("asm")))
        ok = ok | (F.col("path") == F.col("first"))
    return per.where((F.col("n") >= cells) & ok).select("asm", "path", "mean")


def pairs(paths: DataFrame, top: int = TOP_PATHS, ascending: bool = True) -> DataFrame:
    """(asm, path_1, path_2) of each ASM's ``top`` paths of least mean (``ascending``, as the original) or largest."""
    key = F.col("mean") if ascending else -F.col("mean")
    ranked = paths.withColumn("rn", F.row_number().over(Window.partitionBy("asm").orderBy(key, "path"))).where(F.col("rn") <= top)
    b = ranked.select("asm", F.col("path").alias("path_2"), F.col("rn").alias("rn_2"))
    return ranked.join(b, "asm").where("rn < rn_2").select("asm", F.col("path").alias("path_1"), "path_2")


def pair_cells(norm: DataFrame, chosen: DataFrame) -> DataFrame:
    """(asm, path_1, path_2, cell, a, b, ratio): abundances rounded to 4 places first, as they are handed over."""
    x = norm.select("asm", F.col("path").alias("path_1"), "cell", F.round("norm", 4).alias("a"))
    y = norm.select("asm", F.col("path").alias("path_2"), "cell", F.round("norm", 4).alias("b"))
    return chosen.join(x, ["asm", "path_1"]).join(y, ["asm", "path_2", "cell"]).withColumn("ratio", path_ratio(F.col("a"), F.col("b")))


def observed(cells: DataFrame, compat: bool = False) -> DataFrame:
    """(asm, path_1, path_2, mean_1, mean_2, observed); ``compat``: without the last cell."""
    if compat:
        last = cells.agg(F.max("cell").alias("_last"))
        cells = cells.crossJoin(F.broadcast(last)).where("cell != _last")
    return cells.groupBy("asm", "path_1", "path_2").agg(F.avg("a").alias("mean_1"), F.avg("b").alias("mean_2"), F.var_samp("ratio").alias("observed"))


def kruskal_wallis(cells: DataFrame, stages: DataFrame) -> DataFrame:
    """(asm, path_1, path_2, h, p) of ratios over the three stages, midranks and tie correction.

    Three groups leave two degrees of freedom, so p = exp(-H / 2); both are null where a stage has no cell or all
    ratios are equal.
    """
    key = ["asm", "path_1", "path_2"]
    rows = cells.join(stages, "cell")
    low = F.rank().over(Window.partitionBy(*key).orderBy("ratio"))
    ties = F.count("*").over(Window.partitionBy(*key, "ratio"))
    ranked = rows.select(*key, "stage", (low + (ties - 1) / 2).alias("r"), ties.cast("double").alias("t"))
    per = ranked.groupBy(*key, "stage").agg(F.count("*").cast("double").alias("n"), F.sum("r").alias("s"), F.sum(F.col("t") * F.col("t") - 1).alias("c"))
    all_ = per.groupBy(*key).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum("c").alias("c"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("c") / (n * n * n - n))
    ok = (F.col("k") == len(STAGES)) & (F.col("c") < n * n * n - n)
    return all_.select(*key, F.when(ok, h).alias("h")).withColumn("p", F.exp(-F.col("h") / 2))


def path_coverage(norm: DataFrame, paths: DataFrame) -> DataFrame:
    """(asm, path, cell, coverage) of expressed paths in ASMs that have two or more of them."""
    enough = paths.groupBy("asm").agg(F.count("*").alias("n")).where("n > 1").select("asm")
    kept = paths.join(enough, "asm", "left_semi")
    return norm.join(kept, ["asm", "path"], "left_semi").select("asm", "path", "cell", F.round("norm", 4).alias("coverage"))


def significant_paths(cells: DataFrame, tests: DataFrame, level: float = SIGNIFICANT) -> DataFrame:
    """(asm, path_1, path_2, cell, ratio) of pairs whose stages differ, by the ratio that is a half without the second path."""
    chosen = tests.where(F.col("p") <= level).select("asm", "path_1", "path_2")
    return cells.join(chosen, ["asm", "path_1", "path_2"]).select("asm", "path_1", "path_2", "cell", reported_ratio(F.col("a"), F.col("b")).alias("ratio"))


def moments(spike: DataFrame) -> DataFrame:
    """(transcript, mean, cv2, zeros, n) of spike-ins (transcript, cell, value)."""
    per = spike.groupBy("transcript").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"), F.count_if(F.col("value") == 0).alias("zeros"), F.count("*").alias("n"))
    return per.select("transcript", "mean", (F.col("var") / (F.col("mean") * F.col("mean"))).alias("cv2"), "zeros", "n")


def fit_noise(spike: DataFrame, cutoff: float = 1000.0) -> dict[str, float | None]:
    """a0, a1 of cv2 = a0 + a1 / mean (gamma, identity link) and b0, b1 of the dropout's logit over ln(mean + 1).

    Transcripts without expression have no part in either. A pair is null where it has not two different means to fit
    on, since no line is determined there.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = moments(spike).where("mean > 0")
    used = (F.col("mean") > cutoff) & (F.col("cv2") > 0)
    usable, all_ = rows.agg(F.count_distinct(F.when(used, 1 / F.col("mean"))), F.count_distinct(F.log(F.col("mean") + 1))).first()
    found: dict[str, float | None] = dict.fromkeys(("a0", "a1", "b0", "b1"))
    one = lambda df, x: VectorAssembler(inputCols=[x], outputCol="x").transform(df)
    if usable > 1:
        gamma = GeneralizedLinearRegression(family="gamma", link="identity", featuresCol="x", labelCol="cv2", maxIter=100)
        noise = gamma.fit(one(rows.where(used).withColumn("inv", 1 / F.col("mean")), "inv"))
        found |= {"a0": noise.intercept, "a1": float(noise.coefficients[0])}
    if all_ > 1:
        logit = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="x", labelCol="share", weightCol="weight", maxIter=100)
        drop = logit.fit(one(rows.withColumns({"l": F.log(F.col("mean") + 1), "share": F.col("zeros") / F.col("n"), "weight": F.col("n").cast("double")}), "l"))
        found |= {"b0": drop.intercept, "b1": float(drop.coefficients[0])}
    return found


def null_variance(observations: DataFrame, noise: dict[str, float], cells: int, simulations: int = SIMULATIONS, seed: int = 1) -> DataFrame:
    """(asm, path_1, path_2, expected, p, skipped): variance of ratios under technical noise alone.

    Each simulation draws a noise level per path from a scaled chi-square, dropouts and gamma abundances of all
    cells. p is the share of simulations whose variance exceeds the observed one. Draws whose gamma has no positive
    variance are left out and counted; nulls where none is left. Seeds come from the pair, so results do not hang on the partitioning.
    """
    a0, a1, b0, b1 = (noise[k] for k in ("a0", "a1", "b0", "b1"))

    def one(key: tuple, m1: float, m2: float, seen: float) -> tuple[float, float, int]:
        rng = np.random.default_rng([abs(hash_of(key)), seed])
        drawn, good = [], np.ones(simulations, bool)
        for mu in (m1, m2):
            p = 1 / (1 + np.exp(-(b0 + b1 * np.log(mu + 1))))
            cv2 = rng.chisquare(cells - 1, simulations) / (cells - 1) * (a1 / mu + a0) if mu > 0 else np.zeros(simulations)
            rest = cv2 * mu * mu * (1 - p) - p * mu * mu
            ok = (rest > 0) & (p < 1) & (mu > 0)
            good &= ok
            shape, scale = np.where(ok, mu * mu / np.where(ok, rest, 1), 1), np.where(ok, rest / max(mu * (1 - p), 1e-300), 1)
            value = rng.gamma(shape[:, None], scale[:, None], (simulations, cells))
            drawn.append(np.where(rng.random((simulations, cells)) < p, 0.0, value))
        total = drawn[0] + drawn[1]
        ratio = np.where(total > 0, drawn[0] / np.where(total > 0, total, 1), 0.5)[good]
        if not len(ratio):
            return float("nan"), float("nan"), simulations
        var = ratio.var(axis=1, ddof=1)
        return float(var.mean()), float((var > seen).mean()), int(simulations - good.sum())

    def hash_of(key: tuple) -> int:
        from zlib import crc32

        return crc32(repr(key).encode())

    def run(batches):
        for pdf in batches:
            found = [one((r.asm, r.path_1, r.path_2), r.mean_1, r.mean_2, r.observed) for r in pdf.itertuples()]
            yield pd.DataFrame({"asm": pdf.asm, "path_1": pdf.path_1, "path_2": pdf.path_2, "expected": [f[0] for f in found], "p": [f[1] for f in found], "skipped": [f[2] for f in found]})

    kinds = dict(observations.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("asm", "path_1", "path_2")) + ", expected double, p double, skipped long"
    return observations.select("asm", "path_1", "path_2", "mean_1", "mean_2", "observed").mapInPandas(run, schema)


def ratio_tests(abundance: DataFrame, depth: DataFrame, stages: DataFrame, noise: dict[str, float], level: float = 10.0, least_cells: int = 10, simulations: int = SIMULATIONS, compat: bool = False) -> DataFrame:
    """The nine columns of the report, one row per pair of expressed paths."""
    norm = normalized(abundance, depth)
    cells = pair_cells(norm, pairs(expressed(norm, level, least_cells, compat)))
    seen = observed(cells, compat)
    n = depth.count() - int(compat)
    tested = null_variance(seen, noise, n, simulations).withColumnRenamed("p", "variance_p")
    kw = kruskal_wallis(cells, stages).select("asm", "path_1", "path_2", F.col("p").alias("group_p"))
    key = ["asm", "path_1", "path_2"]
    return seen.join(tested, key).join(kw, key).select(*key, "mean_1", "mean_2", "expected", "observed", "variance_p", "group_p")
