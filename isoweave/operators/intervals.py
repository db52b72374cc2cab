"""Interval operators: binned range joins, islands, run-length coverage, segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bases of a bin: positions of a chromosome are dealt to as many tasks as it has bins, and a bin's totals are carried on.
CARRY = 1 << 20


def _carried(rows: DataFrame, keys: list[str], aggregates: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """``rows`` (with _bin) with ``carry``: windows over their key's other bins, each of which is one row of ``aggregates``.

    So a key's rows never meet in one task: they are shuffled by key and bin. Null keys are keys.
    """
    bins = rows.groupBy(*keys, "_bin").agg(*(c.alias(n) for n, c in aggregates.items()))
    named = bins.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_bin"])), *aggregates)
    sides = named.select(*(f"_k{i}" for i in range(len(keys) + 1)), *(c.alias(n) for n, c in carry.items()))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "_bin"])]
    return rows.join(sides, same).drop(*(f"_k{i}" for i in range(len(keys) + 1)))


def _windows(keys: list[str], *order):
    """The window of a key's bins, and that of a bin's rows in ``order``."""
    return Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy(f"_k{len(keys)}"), Window.partitionBy(*keys, "_bin").orderBy(*order)


def _in_bins(rows: DataFrame, at: str, width: int) -> DataFrame:
    return rows.withColumn("_bin", F.floor(F.col(at) / width))


_BEFORE, _UPTO = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)


def _bins(low: Column, high: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(low / width).cast("bigint"), F.floor(high / width).cast("bigint")))


def overlap_join(a: DataFrame, b: DataFrame, key: str, a_range: tuple[str, str], b_range: tuple[str, str], width: int = 1024) -> DataFrame:
    """Pairs with equal ``key`` whose closed ranges overlap, each once; the sides have no other column in common.

    Ranges meet in bins of ``width``, an equi-join that is shuffled on (key, bin), and a pair is kept in the first
    bin that both have. Choose a width about the ranges' usual length.
    """
    (al, ah), (bl, bh) = ((F.col(x), F.col(y)) for x, y in (a_range, b_range))
    left, right = a.withColumn("_bin", _bins(al, ah, width)), b.withColumn("_bin", _bins(bl, bh, width))
    joined = left.join(right, [key, "_bin"])
    first = F.floor(F.greatest(al, bl) / width) == F.col("_bin")
    return joined.where((al <= bh) & (bl <= ah) & first).drop("_bin")


def islands(ranges: DataFrame, key: str, low: str, high: str, gap: int = 1, width: int = CARRY) -> DataFrame:
    """``ranges`` with ``island``: a new one begins where a range starts more than ``gap`` past all before it."""
    binned = _in_bins(ranges, low, width)
    bins, own = _windows([key], low, high)
    reach = _carried(binned, [key], {"_top": F.max(high)}, {"_reach": F.max("_top").over(bins.rowsBetween(*_BEFORE))})
    before = F.greatest("_reach", F.max(high).over(own.rowsBetween(*_BEFORE)))
    marked = reach.withColumn("_before", before).withColumn("_new", F.when(F.col("_before").isNull() | (F.col(low) > F.col("_before") + gap), 1).otherwise(0))
    counted = _carried(marked.drop("_reach", "_before"), [key], {"_n": F.sum("_new")}, {"_base": F.coalesce(F.sum("_n").over(bins.rowsBetween(*_BEFORE)), F.lit(0))})
    return counted.withColumn("island", F.col("_base") + F.sum("_new").over(own.rowsBetween(*_UPTO))).select(*ranges.columns, "island")


def coverage_runs(fragments: DataFrame, keys: list[str], low: str = "start", high: str = "end", n: str = "n", width: int = CARRY) -> DataFrame:
    """(keys, start, end, depth) runs of equal depth above zero, from +n and -n at the ends and no row per base."""
    ends = fragments.select(*keys, F.explode(F.array(F.struct(F.col(low).alias("at"), F.col(n).alias("d")), F.struct((F.col(high) + 1).alias("at"), (-F.col(n)).alias("d")))).alias("e"))
    steps = _in_bins(ends.groupBy(*keys, F.col("e.at").alias("start")).agg(F.sum("e.d").alias("d")).where("d != 0"), "start", width)
    bins, own = _windows(keys, "start")
    carry = {"_base": F.coalesce(F.sum("_sum").over(bins.rowsBetween(*_BEFORE)), F.lit(0)), "_next": F.lead("_first").over(bins)}
    rows = _carried(steps, keys, {"_sum": F.sum("d"), "_first": F.min("start")}, carry)
    depth = F.col("_base") + F.sum("d").over(own.rowsBetween(*_UPTO))
    runs = rows.select(*keys, "start", (F.coalesce(F.lead("start").over(own), "_next") - 1).alias("end"), depth.cast("long").alias("depth"))
    return runs.where("depth > 0")


def mean_coverage(exons: DataFrame, fragments: DataFrame, key: str) -> DataFrame:
    """Bases of fragments within each exon over its length: exons (key, exon, low, high), fragments (key, start, end, n)."""
    pairs = overlap_join(exons, fragments, key, ("low", "high"), ("start", "end"))
    shared = F.least("high", "end") - F.greatest("low", "start") + 1
    sums = pairs.groupBy(key, "exon").agg(F.sum(F.col("n") * shared).alias("bases"))
    return exons.join(sums, [key, "exon"], "left").select(key, "exon", (F.coalesce("bases", F.lit(0)) / (F.col("high") - F.col("low") + 1)).alias("coverage"))


def splice_sites(junctions: DataFrame) -> DataFrame:
    """(chrom, position, direction, n): each junction leaves an exon at its start and enters one at its end."""
    ends = F.array(F.struct(F.col("start").alias("position"), F.lit("out").alias("direction")), F.struct(F.col("end").alias("position"), F.lit("in").alias("direction")))
    return junctions.select("chrom", F.explode(ends).alias("s"), "n").groupBy("chrom", "s.position", "s.direction").agg(F.sum("n").alias("n"))


def segments(sites: DataFrame, width: int = CARRY) -> DataFrame:
    """Exon segments between neighbouring splice sites, with their kind of alternative site.

    in-out: an exon (0), out-out: an alternative donor (1), in-in: an alternative acceptor (2), out-in: -1.
    """
    site = F.struct("position", F.when(F.col("direction") == "in", 0).otherwise(1).alias("turn"), "direction")
    rows = _in_bins(sites.select("chrom", "position", site.alias("site")), "position", width)
    bins, own = _windows(["chrom"], "site")
    rows = _carried(rows, ["chrom"], {"_first": F.min("site")}, {"_next": F.lead("_first").over(bins)})
    nxt = rows.select("chrom", F.col("position").alias("low"), F.col("site.direction").alias("a"), F.coalesce(F.lead("site").over(own), "_next").alias("next"))
    nxt = nxt.select("chrom", "low", "a", F.col("next.position").alias("high"), F.col("next.direction").alias("b")).where("high is not null")
    low = F.col("low") + F.when(F.col("a") == "out", 1).otherwise(0)
    high = F.col("high") - F.when(F.col("b") == "in", 1).otherwise(0)
    kind = F.when((F.col("a") == "in") & (F.col("b") == "out"), 0).when((F.col("a") == "out") & (F.col("b") == "out"), 1).when((F.col("a") == "in") & (F.col("b") == "in"), 2).otherwise(-1)
    return nxt.select("chrom", low.alias("low"), high.alias("high"), kind.alias("kind")).where("low <= high")


def visual_ids(exons: DataFrame, key: str = "chrom", width: int = CARRY) -> DataFrame:
    """Exon numbers that go up by 1 to an adjacent exon and by 2 across a gap."""
    bins, own = _windows([key], "low", "high")
    rows = _carried(_in_bins(exons, "low", width), [key], {"_end": F.max_by("high", F.struct("low", "high"))}, {"_last": F.lag("_end").over(bins)})
    before = F.coalesce(F.lag("high").over(own), "_last")
    rows = rows.withColumn("_before", before)
    rows = rows.withColumn("_s", F.when(F.col("_before").isNull() | (F.col("low") <= F.col("_before") + 1), 1).otherwise(2)).drop("_last", "_before")
    rows = _carried(rows, [key], {"_sum": F.sum("_s")}, {"_base": F.coalesce(F.sum("_sum").over(bins.rowsBetween(*_BEFORE)), F.lit(0))})
    return rows.withColumn("vis_id", F.col("_base") + F.sum("_s").over(own.rowsBetween(*_UPTO))).select(*exons.columns, "vis_id")


def site_in_reference(sites: DataFrame, reference: DataFrame) -> DataFrame:
    """Reference exons at a splice site, boundary before inside: (chrom, position, direction, match).

    reference: (chrom, low, high). boundary: the site is the exon's end on its side.
    """
    at = sites.select("chrom", "position", "direction", F.col("position").alias("p1"))
    pairs = overlap_join(at, reference, "chrom", ("position", "p1"), ("low", "high"))
    edge = F.when(F.col("direction") == "out", F.col("high") == F.col("position")).otherwise(F.col("low") == F.col("position"))
    best = pairs.groupBy("chrom", "position", "direction").agg(F.bool_or(edge).alias("edge"))
    match = F.when(F.col("edge"), "boundary").when(F.col("edge").isNotNull(), "in_exon").otherwise("out_exon")
    return sites.join(best, ["chrom", "position", "direction"], "left").select("chrom", "position", "direction", match.alias("match"))


def adjacent(features: DataFrame, key: str = "chrom") -> DataFrame:
    """Ordered pairs (a, b) of features whose end and start are equal or one apart: three equi-joins in one."""
    ends = features.select(key, F.col("id").alias("a"), F.explode(F.array(F.col("high") - 1, F.col("high"), F.col("high") + 1)).alias("low"))
    return ends.join(features.select(key, F.col("id").alias("b"), "low"), [key, "low"]).where("a != b").select(key, "a", "b")


def complete_junctions(junctions: DataFrame, exons: DataFrame) -> DataFrame:
    """Junctions that leave some exon's end and enter some exon's start."""
    starts, ends = exons.select("chrom", F.col("high").alias("start")), exons.select("chrom", F.col("low").alias("end"))
    return junctions.join(starts, ["chrom", "start"], "left_semi").join(ends, ["chrom", "end"], "left_semi")


def relative_introns(features: DataFrame, width: int = CARRY) -> DataFrame:
    """Introns whose coverage is at least half of the better covered neighbouring exon; ones without an exon go.

    features: (chrom, low, high, kind: exon or intron, coverage). What follows is what precedes in turned order: Spark
    would read all rows after a row anew for a frame that begins there.
    """
    bins, own = _windows(["chrom"], "low", "high")
    later, after = Window.partitionBy("_k0").orderBy(F.desc("_k1")), Window.partitionBy("chrom", "_bin").orderBy(F.desc("low"), F.desc("high"))
    exon = F.when(F.col("kind") == "exon", F.col("coverage"))
    place = F.when(F.col("kind") == "exon", F.struct("low", "high"))
    ends = {"_first": F.min_by(exon, place), "_last": F.max_by(exon, place)}
    carry = {"_left": F.last("_last", True).over(bins.rowsBetween(*_BEFORE)), "_right": F.last("_first", True).over(later.rowsBetween(*_BEFORE))}
    rows = _carried(_in_bins(features, "low", width), ["chrom"], ends, carry)
    prev = F.coalesce(F.last(exon, True).over(own.rowsBetween(*_BEFORE)), "_left")
    nxt = F.coalesce(F.last(exon, True).over(after.rowsBetween(*_BEFORE)), "_right")
    marked = rows.withColumn("_top", F.greatest(prev, nxt))
    return marked.where("kind = 'exon' or (_top is not null and coverage >= _top / 2)").select(*features.columns)


def gene_labels(events: DataFrame, genes: DataFrame, key: str = "chrom") -> DataFrame:
    """Names of genes that share over half of the event or of themselves, comma-joined by gene start; ``na`` if none.

    events: (key, id, e_low, e_high); genes: (key, gene, low, high).
    """
    pairs = overlap_join(events, genes, key, ("e_low", "e_high"), ("low", "high"))
    shared = F.least("high", "e_high") - F.greatest("low", "e_low") + 1
    half = (2 * shared > F.col("e_high") - F.col("e_low") + 1) | (2 * shared > F.col("high") - F.col("low") + 1)
    named = pairs.where(half).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("low", "gene"))), lambda x: x["gene"].cast("string")), ",").alias("genes"))
    return events.join(named, "id", "left").select("id", F.coalesce("genes", F.lit("na")).alias("genes"))
