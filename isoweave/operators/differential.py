"""Differential transcription and expression: divergences, moderated statistics, permutations, false discovery.

Long tables: (asm, path, sample, group, expr, prop) for ASMs, (gene, sample, group, expr) for genes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import MAD_SCALE, jsd_term

#: Floor of the within-group spread of ASMs, cap of that of genes.
S_FLOOR, S_CAP = 1e-3, 2e9 - 1


def group_means(rows: DataFrame, *keys: str, value: str = "expr") -> DataFrame:
    return rows.groupBy(*keys, "group").agg(F.avg(value).alias("mean"))


def major_paths(rows: DataFrame, samples: int) -> DataFrame:
    """(asm, path): a share of 1 % in any sample, or 0.5 % and abundance 5 on average, or abundance 5 in 1 % of samples."""
    per = rows.groupBy("asm", "path").agg(F.max("prop").alias("top"), F.avg("prop").alias("share"), F.avg("expr").alias("mean"), F.count_if(F.col("expr") >= 5).alias("n"))
    return per.where((F.col("top") >= 0.01) | ((F.col("share") >= 0.005) & (F.col("mean") >= 5)) | (F.col("n") >= 0.01 * samples)).select("asm", "path")


def testable_asms(rows: DataFrame, least: float = 5.0) -> DataFrame:
    """ASMs whose total abundance has a mean of at least ``least`` in every group."""
    total = rows.groupBy("asm", "sample", "group").agg(F.sum("expr").alias("expr"))
    return group_means(total, "asm").groupBy("asm").agg(F.min("mean").alias("m")).where(F.col("m") >= least).select("asm")


def testable_genes(rows: DataFrame, least: float = 10.0) -> DataFrame:
    """Genes with a mean of at least ``least`` in any group."""
    return group_means(rows, "gene").groupBy("gene").agg(F.max("mean").alias("m")).where(F.col("m") >= least).select("gene")


def representative_path(rows: DataFrame) -> DataFrame:
    """(asm, path) of the largest population variance of abundance; the least path of equal ones."""
    per = rows.groupBy("asm", "path").agg(F.var_pop("expr").alias("v"))
    return per.groupBy("asm").agg(F.max_by("path", F.struct("v", -F.col("path"))).alias("path"))


def mean_distributions(rows: DataFrame, *by: str) -> DataFrame:
    """(asm, by, path, share): mean proportions made to sum to 1; zeros stay zeros."""
    per = rows.groupBy("asm", *by, "path").agg(F.avg("prop").alias("m"))
    total = F.sum("m").over(Window.partitionBy("asm", *by))
    return per.select("asm", *by, "path", F.coalesce(F.try_divide("m", total), F.lit(0.0)).alias("share"))


def pairwise_jsd(rows: DataFrame) -> DataFrame:
    """(asm, group_1, group_2, jsd) of group mean distributions."""
    d = mean_distributions(rows, "group")
    a = d.select("asm", "path", F.col("group").alias("group_1"), F.col("share").alias("p"))
    b = d.select("asm", "path", F.col("group").alias("group_2"), F.col("share").alias("q"))
    both = a.join(b, ["asm", "path"]).where("group_1 < group_2")
    return both.groupBy("asm", "group_1", "group_2").agg(F.sum(jsd_term(F.col("p"), F.col("q"))).alias("jsd"))


def largest_jsd(pairwise: DataFrame) -> DataFrame:
    return pairwise.groupBy("asm").agg(F.max("jsd").alias("jsd"))


def between(rows: DataFrame) -> DataFrame:
    """(asm, r): group sizes times divergence from the grand mean, over groups less one."""
    g, grand = mean_distributions(rows, "group"), mean_distributions(rows)
    sizes = rows.select("asm", "group", "sample").distinct().groupBy("asm", "group").agg(F.count("*").alias("n"))
    div = g.withColumnRenamed("share", "p").join(grand.withColumnRenamed("share", "q"), ["asm", "path"]).groupBy("asm", "group").agg(F.sum(jsd_term(F.col("p"), F.col("q"))).alias("d"))
    return div.join(sizes, ["asm", "group"]).groupBy("asm").agg(F.try_divide(F.sum(F.col("n") * F.col("d")), F.count("*") - 1).alias("r"))


def sample_divergence(rows: DataFrame) -> DataFrame:
    """(asm, group, sample, jsd) of each sample's distribution from its group's mean."""
    total = F.sum("prop").over(Window.partitionBy("asm", "sample"))
    own = rows.select("asm", "group", "sample", "path", F.coalesce(F.try_divide("prop", total), F.lit(0.0)).alias("p"))
    g = mean_distributions(rows, "group").withColumnRenamed("share", "q")
    return own.join(g, ["asm", "group", "path"]).groupBy("asm", "group", "sample").agg(F.sum(jsd_term(F.col("p"), F.col("q"))).alias("jsd"))


def within(rows: DataFrame) -> DataFrame:
    """(asm, s): divergence of samples from their groups over samples less groups, not under S_FLOOR."""
    per = sample_divergence(rows).groupBy("asm").agg(F.sum("jsd").alias("d"), F.count("*").alias("n"), F.count_distinct("group").alias("g"))
    return per.select("asm", F.greatest(F.coalesce(F.try_divide("d", F.col("n") - F.col("g")), F.lit(S_FLOOR)), F.lit(S_FLOOR)).alias("s"))


def gene_r_s(rows: DataFrame) -> DataFrame:
    """(gene, r, s): between- and within-group mean squares of abundance."""
    per = rows.groupBy("gene", "group").agg(F.count("*").alias("n"), F.avg("expr").alias("m"), F.var_pop("expr").alias("v"))
    grand = per.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("gene")) / F.sum("n").over(Window.partitionBy("gene")))
    out = grand.groupBy("gene").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2.0)).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), F.sum("n").alias("n"), F.count("*").alias("g"))
    return out.select("gene", F.try_divide("b", F.col("g") - 1).alias("r"), F.least(F.coalesce(F.try_divide("w", F.col("n") - F.col("g")), F.lit(S_CAP)), F.lit(S_CAP)).alias("s"))


def moderated(r_s: DataFrame, s0: float) -> DataFrame:
    """``r_s`` with d = r / (s + s0), 1e-15 where the denominator vanishes."""
    low = F.col("s") + s0
    return r_s.withColumn("d", F.when(low < 1e-15, F.lit(1e-15)).otherwise(F.col("r") / low))


def fudge_factor(r_s: DataFrame) -> float:
    """s0: the percentile of s, of 21, that makes the spread of d most even over 100 quantile bins of s.

    Percentiles and bin medians are aggregates; only 21 numbers reach the driver.
    """
    spark = r_s.sparkSession
    cuts = r_s.agg(*(F.percentile("s", F.lit(i / 20)).alias(f"c{i}") for i in range(21)), F.percentile("s", F.array(*(F.lit(i / 100) for i in range(101)))).alias("q")).first()
    if cuts.c0 is None:
        return 0.0
    edges = F.array(*(F.lit(float(x)) for x in cuts.q))
    bins = r_s.where(F.col("s") < float(cuts.q[-1])).withColumn("bin", F.size(F.filter(edges, lambda e: e <= F.col("s"))))
    alphas = spark.createDataFrame([(i / 20, float(cuts[f"c{i}"])) for i in range(21)], "alpha double, s0 double")
    d = bins.crossJoin(F.broadcast(alphas)).withColumn("d", F.col("r") / F.greatest(F.col("s") + F.col("s0"), F.lit(1e-15)))
    mid = d.groupBy("alpha", "s0", "bin").agg(F.percentile("d", F.lit(0.5)).alias("m"))
    mad = d.join(mid, ["alpha", "s0", "bin"]).groupBy("alpha", "s0", "bin").agg((F.percentile(F.abs(F.col("d") - F.col("m")), F.lit(0.5)) / MAD_SCALE).alias("v"))
    cv = mad.groupBy("alpha", "s0").agg(F.try_divide(F.stddev_pop("v") * F.sqrt(F.count("*") / F.lit(100.0)), F.avg("v")).alias("cv"))
    best = cv.where("cv is not null").orderBy("cv", "alpha").first()
    return float(best.s0) if best else 0.0


def expected_order(permuted: DataFrame) -> DataFrame:
    """(rank, expected): mean of each order statistic over permutations (perm, d)."""
    ranked = permuted.withColumn("rank", F.row_number().over(Window.partitionBy("perm").orderBy("d")))
    return ranked.groupBy("rank").agg(F.avg("d").alias("expected"))


def pi0(observed: DataFrame, permuted: DataFrame) -> DataFrame:
    """One row: share of true nulls from statistics between the permuted minimum and median, held in 0.5 to 1."""
    q = permuted.agg(F.min("d").alias("q0"), F.percentile("d", F.lit(0.5)).alias("q50"))
    n = observed.crossJoin(F.broadcast(q)).agg(F.count_if((F.col("d") > F.col("q0")) & (F.col("d") < F.col("q50"))).alias("k"), F.count("*").alias("m"))
    return n.select(F.least(F.greatest(F.coalesce(F.try_divide("k", F.col("m") * 0.5), F.lit(1.0)), F.lit(0.5)), F.lit(1.0)).alias("pi0"))


def fdr_sweep(observed: DataFrame, permuted: DataFrame, share: float, steps: int = 1000, step: float = 0.01) -> DataFrame:
    """(delta, significant, fdr) for delta = 0, step, ...: calls farther than delta from what is expected at their rank.

    observed: (id, d); permuted: (perm, d). A statistic counts for all deltas below its distance, so distances are
    binned once and summed from above; nothing is crossed with the sweep.
    """
    expected = expected_order(permuted)
    cell = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("perm").orderBy("d"))).join(expected, "rank")
    top = F.least(F.ceil(F.round(F.abs(F.col("d") - F.col("expected")) / step, 9)).cast("int"), F.lit(steps + 1))
    obs = cell(observed.withColumn("perm", F.lit(0))).select(top.alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    per = cell(permuted).select("perm", top.alias("k")).groupBy("perm", "k").agg(F.count("*").alias("n"))
    spark = observed.sparkSession
    grid = spark.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    sig = grid.unionByName(spark.range(steps + 1, steps + 2).select(F.col("id").cast("int").alias("k"))).join(obs, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n")).withColumn("significant", F.coalesce(F.sum("n").over(above), F.lit(0)))
    perms = permuted.select("perm").distinct()
    full = perms.crossJoin(F.broadcast(spark.range(steps + 2).select(F.col("id").cast("int").alias("k"))))  # a fixed number of deltas
    own = Window.partitionBy("perm").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    false = full.join(per, ["perm", "k"], "left").withColumn("f", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(own), F.lit(0))).groupBy("k").agg(F.percentile("f", F.lit(0.5)).alias("false"))
    out = sig.where(F.col("k") <= steps).join(false, "k")
    return out.select((F.col("k") * step).alias("delta"), "significant", F.try_divide(F.col("false") * share, F.col("significant")).alias("fdr"))


def fdr_cutoff(sweep: DataFrame, level: float) -> DataFrame:
    """One row: the least delta above zero whose FDR is at most ``level``; null if there is none."""
    return sweep.where((F.col("delta") >= 1e-5) & (F.col("fdr") <= level)).agg(F.min("delta").alias("cutoff"))


def fold_change(rows: DataFrame) -> DataFrame:
    """(gene, fold): the largest ratio of two group means."""
    per = group_means(rows, "gene").groupBy("gene").agg(F.max("mean").alias("hi"), F.min("mean").alias("lo"))
    return per.select("gene", F.try_divide("hi", "lo").alias("fold"))


def distance_ratio(rows: DataFrame) -> DataFrame:
    """(asm, ratio): the least over samples of root divergence to the nearest other group over that to its own."""
    total = F.sum("prop").over(Window.partitionBy("asm", "sample"))
    own = rows.select("asm", "group", "sample", "path", F.coalesce(F.try_divide("prop", total), F.lit(0.0)).alias("p"))
    g = mean_distributions(rows, "group").select("asm", "path", F.col("group").alias("other"), F.col("share").alias("q"))
    div = own.join(g, ["asm", "path"]).groupBy("asm", "group", "sample", "other").agg(F.sqrt(F.greatest(F.sum(jsd_term(F.col("p"), F.col("q"))), F.lit(0.0))).alias("d"))
    per = div.groupBy("asm", "sample").agg(F.max(F.when(F.col("group") == F.col("other"), F.col("d"))).alias("own"), F.min(F.when(F.col("group") != F.col("other"), F.col("d"))).alias("far"))
    return per.groupBy("asm").agg(F.min(F.try_divide("far", "own")).alias("ratio"))


def distant_share(rows: DataFrame, distance: float = 0.3, of_others: float = 0.9) -> DataFrame:
    """(asm, share) of samples that lie at this root divergence or farther from most samples of other groups."""
    total = F.sum("prop").over(Window.partitionBy("asm", "sample"))
    own = rows.select("asm", "group", "sample", "path", F.coalesce(F.try_divide("prop", total), F.lit(0.0)).alias("p"))
    b = own.select("asm", "path", F.col("group").alias("g2"), F.col("sample").alias("s2"), F.col("p").alias("q"))
    pairs = own.join(b, ["asm", "path"]).where("group != g2").groupBy("asm", "sample", "s2").agg(F.sqrt(F.greatest(F.sum(jsd_term(F.col("p"), F.col("q"))), F.lit(0.0))).alias("d"))
    far = pairs.groupBy("asm", "sample").agg(F.avg(F.when(F.col("d") >= distance, 1.0).otherwise(0.0)).alias("f"))
    return far.groupBy("asm").agg(F.avg(F.when(F.col("f") >= of_others, 1.0).otherwise(0.0)).alias("share"))


def upper_quartile_coverage(exons: DataFrame, least: int = 5) -> DataFrame:
    """(gene, coverage): mean over exons at or above the first quartile, for genes of ``least`` exons or more."""
    q = exons.groupBy("gene").agg(F.percentile("coverage", F.lit(0.25)).alias("q"), F.count("*").alias("n")).where(F.col("n") >= least)
    return exons.join(q, "gene").where(F.col("coverage") >= F.col("q")).groupBy("gene").agg(F.avg("coverage").alias("coverage"))


def pair_counts(calls: DataFrame, groups: list[str]) -> DataFrame:
    """Matrix of significant calls (group_1, group_2) by group pair."""
    wide = calls.groupBy("group_1").pivot("group_2", groups).agg(F.count(F.lit(1)))
    return wide.select("group_1", *(F.coalesce(F.col(g), F.lit(0)).cast("long").alias(g) for g in groups))


# -- permutations, pairwise tests, calls


def shuffled_labels(samples: DataFrame, permutations: int = 1000, seed: int = 1) -> DataFrame:
    """(perm, sample, group): the groups' labels dealt anew to the samples, group sizes kept, the same for one seed.

    ``samples`` (sample, group) is the design, a row per sample; the result has a row per permutation and sample.
    """
    spark = samples.sparkSession
    slots = samples.select(F.row_number().over(Window.orderBy("group", "sample")).alias("_rn"), "group")
    grid = spark.range(permutations).withColumnRenamed("id", "perm").crossJoin(F.broadcast(samples.select("sample")))
    order = Window.partitionBy("perm").orderBy(F.xxhash64("perm", "sample", F.lit(seed)), "sample")
    return grid.withColumn("_rn", F.row_number().over(order)).join(F.broadcast(slots), "_rn").select("perm", "sample", "group")


def permuted_genes(rows: DataFrame, labels: DataFrame, s: DataFrame, s0: float) -> DataFrame:
    """(perm, gene, d) with labels (perm, sample, group) in the groups' place; s (gene, s) stays as observed."""
    per = rows.select("gene", "sample", "expr").join(labels, "sample").groupBy("perm", "gene", "group").agg(F.count("*").alias("n"), F.avg("expr").alias("m"))
    grand = rows.groupBy("gene").agg(F.avg("expr").alias("grand"))
    r = per.join(grand, "gene").groupBy("perm", "gene").agg(F.try_divide(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2.0)), F.count("*") - 1).alias("r"))
    return moderated(r.join(s.select("gene", "s"), "gene"), s0).select("perm", "gene", "d").where("d is not null")  # one group has no statistic


def permuted_asms(rows: DataFrame, labels: DataFrame, s: DataFrame, s0: float) -> DataFrame:
    """(perm, asm, d): as permuted_genes(), by divergences of group means from the grand mean."""
    per = rows.select("asm", "path", "sample", "prop").join(labels, "sample").groupBy("perm", "asm", "group", "path").agg(F.avg("prop").alias("m"), F.count_distinct("sample").alias("n"))
    share = per.withColumn("p", F.coalesce(F.try_divide("m", F.sum("m").over(Window.partitionBy("perm", "asm", "group"))), F.lit(0.0)))
    grand = mean_distributions(rows).withColumnRenamed("share", "q")
    div = share.join(grand, ["asm", "path"]).groupBy("perm", "asm", "group").agg(F.sum(jsd_term(F.col("p"), F.col("q"))).alias("v"), F.max("n").alias("n"))
    r = div.groupBy("perm", "asm").agg(F.try_divide(F.sum(F.col("n") * F.col("v")), F.count("*") - 1).alias("r"))
    return moderated(r.join(s.select("asm", "s"), "asm"), s0).select("perm", "asm", "d").where("d is not null")


def pairwise_genes(rows: DataFrame, s: DataFrame, s0: float) -> DataFrame:
    """(gene, group_1, group_2, d): difference of two group means over s + s0, group_1 before group_2."""
    m = group_means(rows, "gene")
    both = m.withColumnsRenamed({"group": "group_1", "mean": "a"}).join(m.withColumnsRenamed({"group": "group_2", "mean": "b"}), "gene").where("group_1 < group_2")
    return both.join(s.select("gene", "s"), "gene").select("gene", "group_1", "group_2", ((F.col("a") - F.col("b")) / (F.col("s") + s0)).alias("d"))


def pairwise_asms(rows: DataFrame, s: DataFrame, s0: float) -> DataFrame:
    """(asm, group_1, group_2, d): root divergence of two group means over root s plus the root of s0 and the low-expression penalty.

    ``s`` may hold ``s_expr``, the penalty; without it there is none.
    """
    low = F.col("s_expr") + s0 if "s_expr" in s.columns else F.lit(s0)
    both = pairwise_jsd(rows).join(s, "asm")
    return both.select("asm", "group_1", "group_2", (F.sqrt(F.greatest("jsd", F.lit(0.0))) / (F.sqrt("s") + F.sqrt(low))).alias("d"))


def low_expression(rows: DataFrame, s: DataFrame) -> DataFrame:
    """``s`` (asm, s) with s_expr: the saturation of an ASM's mean abundance, scaled by 1.3 times the largest s."""
    from ..functions.stats import saturation

    mean = rows.groupBy("asm", "sample").agg(F.sum("expr").alias("e")).groupBy("asm").agg(F.avg("e").alias("e"))
    top = s.agg(F.max("s").alias("top"))  # one row
    return s.join(mean, "asm").crossJoin(F.broadcast(top)).select(*s.columns, (saturation(F.col("e")) * F.col("top") * 1.3).alias("s_expr"))


def with_expected(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """``observed`` (..., d) with rank and expected: the mean statistic of its rank under permutation; a row per gene or module."""
    ranked = observed.where("d is not null").withColumn("rank", F.row_number().over(Window.orderBy("d")))
    return ranked.join(expected, "rank")


def gene_calls(tested: DataFrame, folds: DataFrame, cutoff: float, fold: float = 2.0, least: float = 3.0) -> DataFrame:
    """``tested`` (gene, d, expected) with its fold change and ``significant``: far enough from what is expected, by cutoff and ``least``, and of this fold."""
    far = F.abs(F.col("d") - F.col("expected"))
    return tested.join(folds, "gene").withColumn("significant", F.coalesce((far >= cutoff) & (far >= least) & (F.col("fold") >= fold), F.lit(False)))


def asm_calls(tested: DataFrame, divergence: DataFrame, cutoff: float, root: float = 0.1) -> DataFrame:
    """``tested`` (asm, d, expected) with its largest divergence and ``significant``: beyond the cutoff and of this root divergence."""
    far = F.abs(F.col("d") - F.col("expected"))
    return tested.join(divergence, "asm").withColumn("significant", (far >= cutoff) & (F.sqrt(F.greatest("jsd", F.lit(0.0))) >= root))


def rejected(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Rows of what a filter left out."""
    return rows.join(kept.select(key), key, "left_anti")
