"""Exons and retained introns cut where their coverage ends: change ratios, gaps, alternative sites, as windows over bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_join

# Fixed limits that decide results.
CHANGE_WINDOW, SHARP_CHANGE, SITE_CHANGE = 50, 10.0, 5.0
LEAST_EXON, LEAST_SITE, MOST_SITE = 5, 1, 200
GAP, LOW_GAP, LOW_PEAK = 1, 50, 5.0


def feature_bases(features: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """A row per base of each feature (chrom, low, high, ...) with its ``depth`` from runs (chrom, start, end, depth); 0 where none is.

    ``keys`` name a feature. Rows are summed before they are shuffled, so a base that many runs cover is one row a task.
    """
    own = [c for c in features.columns if c not in ("chrom", "low", "high")]
    none = features.select("chrom", *own, F.explode(F.sequence("low", "high")).alias("position"), F.lit(0).cast("long").alias("depth"))
    pairs = overlap_join(features, runs, "chrom", ("low", "high"), ("start", "end"))
    some = pairs.select("chrom", *own, F.explode(F.sequence(F.greatest("low", "start"), F.least("high", "end"))).alias("position"), F.col("depth").cast("long").alias("depth"))
    rest = [F.first(c).alias(c) for c in own if c not in keys]
    return none.unionByName(some).groupBy("chrom", *(c for c in own if c in keys), "position").agg(F.sum("depth").alias("depth"), *rest)


def change_ratio(bases: DataFrame, keys: list[str], least: float, window: int = CHANGE_WINDOW) -> DataFrame:
    """``bases`` with ``ratio``: mean depth of ``window`` bases from a base on over that of as many before it.

    1 unless every base of one side is above every base of the other and the higher mean reaches ``least``. A feature's
    first base has twice SHARP_CHANGE, and so has one after nothing but zeros when it passes that test; its last has 0.
    """
    own = Window.partitionBy(*keys).orderBy("position")
    left, right = own.rowsBetween(-window, -1), own.rowsBetween(0, window - 1)
    x, most = F.col("depth"), F.lit(2 * SHARP_CHANGE)
    before, after = F.avg(x).over(left), F.avg(x).over(right)
    raw = F.when(before > 0, after / before).otherwise(most)
    falls = (F.min(x).over(left) > F.max(x).over(right)) & (raw < 1) & (before >= least)
    rises = (F.max(x).over(left) < F.min(x).over(right)) & (raw > 1) & (after >= least)
    first, last = F.lag(x).over(own).isNull(), F.lead(x).over(own).isNull()
    return bases.withColumn("ratio", F.when(first, most).when(last, 0.0).when(falls | rises, raw).otherwise(1.0))


def trimmed(bases: DataFrame, keys: list[str], samples: int, exon: float = 0.0, intron: float = 1.0, compat: bool = False) -> DataFrame:
    """Covered pieces of features: (keys, low, high, support, first, last); ``first``, ``last``: the feature's own edge is kept.

    bases: (keys, position, depth over all samples, kind: exon or intron, site: 0 none, 1 and 2 an alternative start or
    end, annotated), without gaps; no column of them is null. ``exon`` and ``intron`` are depths per sample.

    A piece runs from the first base that may start one to the next base that ends one, and is kept if it is long and
    covered enough. A base ends one where it is at most the threshold, or coverage falls sharply, and nothing covered
    follows within the allowed gap; a feature's last base always does. Exons start above the threshold (``compat``: one
    sample's threshold, held against the depth of all), introns at a sharp rise. Alternative sites of MOST_SITE bases or
    less are cut once where the means on both sides differ most, or kept whole. Annotated exons stay whole. Empty: empty.

    All windows and the aggregate share one shuffle by ``keys``; a feature's bases are one sort, its pieces one row each.
    """
    own, whole = Window.partitionBy(*keys).orderBy("position"), Window.partitionBy(*keys)
    x, at, n, per = F.col("depth"), F.col("position"), F.col("_n"), F.lit(float(samples))
    is_exon = F.col("kind") == "exon"
    rows = change_ratio(bases, keys, exon)
    rows = rows.withColumns({"_i": F.row_number().over(own) - 1, "_n": F.count("*").over(whole), "_peak": F.max(x).over(whole) / per, "_total": F.sum(x).over(whole), "_end": F.max(at).over(whole), "_ahead": F.max(x).over(own.rowsBetween(0, LOW_GAP - 1)), "_near": F.max(x).over(own.rowsBetween(0, GAP - 1)), "_p": F.coalesce(F.sum(x).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    rows = rows.withColumns({"_t": F.when(is_exon, F.greatest(F.col("_peak") * 0.01, F.lit(exon))).otherwise(F.lit(intron)), "_short": is_exon & (F.col("site") > 0) & (n <= MOST_SITE) & ~F.col("annotated")})

    t, i, single = F.col("_t"), F.col("_i"), F.col("annotated") & is_exon | F.col("_short")
    void = F.when(is_exon, t).otherwise(F.lit(exon)) * per
    empty = lambda ahead, gap: (i + gap >= n) | (F.col(ahead) <= void)
    gap = F.when(is_exon & (F.col("_peak") <= LOW_PEAK), empty("_ahead", LOW_GAP)).otherwise(empty("_near", GAP))
    rows = rows.withColumn("_stop", ~single & ((((x <= t * per) | (F.col("ratio") < 1 / SHARP_CHANGE)) & gap) | (i == n - 1)))
    start = F.when(is_exon, x > (t if compat else t * per)).otherwise((F.col("ratio") > SHARP_CHANGE) & (x >= t * per))
    part = F.coalesce(F.sum(F.col("_stop").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"_part": part, "_start": ~F.col("_stop") & start})

    # an alternative start keeps what follows its cut, an alternative end what goes before it
    opens = F.col("site") == 1
    order = F.when(opens, i).otherwise(-i)
    gone = F.when(opens, F.col("_p")).otherwise(F.col("_total") - F.col("_p"))
    kept = F.col("_total") - gone
    size_gone, size_kept = F.when(opens, i).otherwise(n - i), F.when(opens, n - i).otherwise(i)
    ratio = F.when(size_kept == 0, 0.0).otherwise(F.try_divide(kept / size_kept, gone / size_gone))
    able = F.col("_short") & ~(opens & (i == 0))
    place = [order.alias("o"), at.alias("at"), kept.alias("kept"), size_gone.alias("gone")]
    groups = rows.groupBy(*keys, "_part").agg(
        F.min(F.when(F.col("_start"), F.struct(at.alias("at"), F.col("_p").alias("p")))).alias("_a"), F.max(F.struct(at.alias("at"), F.col("_p").alias("p"))).alias("_z"),
        F.max(F.when(able & (gone > 0), F.struct(ratio.alias("ratio"), *place))).alias("_best"), F.max(F.when(able & (gone < 1), F.struct(*place))).alias("_dead"),
        F.min(at).alias("_low"), *(F.first(c).alias(c) for c in ("kind", "site", "annotated", "_n", "_total", "_end", "_t", "_short")))
    return _pieces(groups, keys, per, exon)


def _pieces(groups: DataFrame, keys: list[str], per: Column, exon: float) -> DataFrame:
    """The piece of each group of bases, if it has one that is long and covered enough."""
    opens, low, high = F.col("site") == 1, F.col("_low"), F.col("_z.at")
    # an uncovered end of at most GAP bases is tolerated
    sure = F.col("_dead").isNotNull() & F.when(opens, F.col("_dead.gone") >= GAP).otherwise(F.col("_dead.gone") > GAP)
    cut = F.when(sure, F.struct("_dead.at", "_dead.kept")).when(F.col("_best.ratio") >= SITE_CHANGE, F.struct("_best.at", "_best.kept"))
    piece = lambda a, b, s, least, t: F.struct(a.alias("low"), b.alias("high"), s.alias("support"), F.lit(least).alias("least"), t.alias("t"))
    at, total, t = F.col("_cut.at"), F.col("_total"), F.lit(exon)
    whole = piece(low, high, total, LEAST_SITE, t)
    site = F.when(F.col("_cut").isNull(), whole).when(opens, piece(at, high, F.col("_cut.kept"), LEAST_EXON, t)).otherwise(piece(low, at - 1, F.col("_cut.kept"), LEAST_EXON, t))
    run = F.when(F.col("_a").isNotNull(), piece(F.col("_a.at"), high, F.col("_z.p") - F.col("_a.p"), LEAST_EXON, F.col("_t")))
    rows = groups.withColumn("_cut", cut).withColumn("_stays", F.col("annotated") & (F.col("kind") == "exon"))
    rows = rows.withColumn("_piece", F.when(F.col("_stays"), whole).when(F.col("_short"), site).otherwise(run)).where("_piece is not null")
    length = F.col("_piece.high") - F.col("_piece.low") + 1
    fits = F.col("_stays") | (length >= F.col("_piece.least")) & (F.col("_piece.support") / per >= F.col("_piece.t") * length)
    return rows.where(fits).select(*keys, "_piece.low", "_piece.high", "_piece.support", ((F.col("_piece.low") == low) & (F.col("_part") == 0)).alias("first"), (F.col("_piece.high") == F.col("_end")).alias("last"))


def piece_strand(start: Column, end: Column, first: Column, last: Column) -> Column:
    """Strand of a piece of an exon whose sites are on strands ``start`` and ``end``: that of the edges it kept, * if they differ, ? without."""
    return F.when(first & last, F.when(start == end, start).otherwise("*")).when(first, start).when(last, end).otherwise("?")
