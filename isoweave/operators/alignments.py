"""Operators on alignments: statistics, filters, duplicates, mates, depth, conversions."""

from __future__ import annotations

import tempfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar

# The format's flag bits.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2, SECONDARY, QC_FAIL, DUPLICATE = (1 << i for i in range(11))


def has(bit: int, col: str = "flag") -> Column:
    return F.col(col).bitwiseAND(bit) != 0


def flagstat(reads: DataFrame) -> DataFrame:
    """Counters by QC result, one pass: total, duplicates, mapped, paired, read1, read2, proper, both, singletons.

    Where the mate's chromosome (rnext) is known, also mates on another one, all and those with mapq 5 or more.
    """
    pair = has(PAIRED)
    both = pair & ~has(UNMAPPED) & ~has(MATE_UNMAPPED)
    counters = {"total": F.lit(True), "duplicates": has(DUPLICATE), "mapped": ~has(UNMAPPED), "paired": pair, "read1": pair & has(READ1), "read2": pair & has(READ2), "proper": pair & has(PROPER) & ~has(UNMAPPED), "both_mapped": both, "singletons": pair & ~has(UNMAPPED) & has(MATE_UNMAPPED)}
    if "rnext" in reads.columns:
        apart = both & (F.col("rnext") != "=") & (F.col("rnext") != F.col("chrom"))
        counters |= {"mate_elsewhere": apart, "mate_elsewhere_mapq5": apart & (F.col("mapq") >= 5)}
    return reads.groupBy(has(QC_FAIL).alias("qc_fail")).agg(*(F.count_if(c).alias(n) for n, c in counters.items()))


def view(reads: DataFrame, min_mapq: int = 0, require: int = 0, exclude: int = 0, library: str | None = None) -> DataFrame:
    keep = (F.col("mapq") >= min_mapq) & (F.col("flag").bitwiseAND(require) == require) & (F.col("flag").bitwiseAND(exclude) == 0)
    return reads.where(keep & (F.col("library") == library) if library else keep)


def subsampled(reads: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """A share of templates by name: the operator is a sampler; mates stay together."""
    return reads.where(F.pmod(F.xxhash64("qname", F.lit(seed)), F.lit(1024)) < int(fraction * 1024))


def idxstats(reads: DataFrame) -> DataFrame:
    return reads.groupBy("chrom").agg(F.count_if(~has(UNMAPPED)).alias("mapped"), F.count_if(has(UNMAPPED)).alias("unmapped"))


def depth(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of depth over aligned bases (deletions and gaps left out), not a row per base."""
    from .intervals import coverage_runs

    blocks = cigar.inlined(reads.where(~has(UNMAPPED)), cigar.exons, *keys).withColumn("n", F.lit(1).cast("long"))
    return coverage_runs(blocks, keys)


def fetch(reads: DataFrame, chrom: str, low: int, high: int) -> DataFrame:
    """Reads that overlap a closed region."""
    return reads.where((F.col("chrom") == chrom) & (F.col("pos") <= high) & (F.col("pos") + cigar.reference_length(F.col("cigar")) - 1 >= low))


def duplicates_single(reads: DataFrame) -> DataFrame:
    """Reads that stay of each library, strand and 5' position: the one of most quality, least name of equal ones."""
    five = F.when(has(REVERSE), F.col("pos") + cigar.reference_length(F.col("cigar"))).otherwise(F.col("pos"))
    order = Window.partitionBy("library", "chrom", has(REVERSE), five).orderBy(F.desc("qual"), "qname")
    return reads.where(~has(UNMAPPED)).withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def duplicates_paired(reads: DataFrame) -> DataFrame:
    """All but duplicate pairs: per library, place and insert size the pair of most quality stays; mates go by name."""
    lead = reads.where(F.col("isize") > 0)
    order = Window.partitionBy("library", "chrom", "pos", "isize").orderBy(F.desc("qual"), "qname")
    gone = lead.withColumn("_rn", F.row_number().over(order)).where("_rn > 1").select("qname")
    return reads.join(gone, "qname", "left_anti")


def sort_key(name: Column) -> Column:
    """Natural order of names: runs of digits count as numbers of up to 18 digits."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]+$"), F.lpad(x, 18, "0")).otherwise(x)), "")


def sorted_by_name(reads: DataFrame) -> DataFrame:
    return reads.orderBy(sort_key(F.col("qname")), F.col("flag").bitwiseAND(READ1 | READ2))


def ranked_by_name(reads: DataFrame) -> DataFrame:
    """Reads with ``rank``, their place 1, 2, ... in natural order."""
    return ranked(sorted_by_name(reads))


def ranked(ordered: DataFrame) -> DataFrame:
    """Rows of a sorted table with ``rank``, their place 1, 2, ...: prefix sums over the sort's range partitions.

    The sorted rows are checkpointed, since a partition sorted anew could have other bounds; where spark.checkpoint.dir
    is absent (tests in local mode) a temporary folder of this machine takes its place.
    """
    spark = ordered.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="isoweave-"))
    at = ordered.withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftrightunsigned("_at", 33)
    own = F.col("_at").bitwiseAND((1 << 33) - 1)
    first, before = 0, []
    for p, n in at.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row per partition
        before.append((p, first))
        first += n
    starts = spark.createDataFrame(before, "_part long, _before long")
    return at.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("rank", F.col("_before") + own + 1).drop("_at", "_part", "_before")


def sorted_by_place(reads: DataFrame) -> DataFrame:
    return reads.orderBy("chrom", "pos", has(REVERSE))


def fixed_mates(reads: DataFrame) -> DataFrame:
    """Mate fields from the other read of the name: mate_pos, mate_reverse, insert size between 5' ends.

    Reads without exactly one mate have nulls and an insert size of 0.
    """
    five = F.when(has(REVERSE), F.col("pos") + cigar.reference_length(F.col("cigar"))).otherwise(F.col("pos"))
    own = reads.withColumn("_five", five)
    mate = own.select(F.col("pair").alias("_pair"), F.col("read_id").alias("_id"), F.col("chrom").alias("mate_chrom"), F.col("pos").alias("mate_pos"), has(REVERSE).alias("mate_reverse"), F.col("_five").alias("_mate_five"))
    size = F.count("*").over(Window.partitionBy("pair"))
    two = own.withColumn("_n", size)
    joined = two.join(mate, (F.col("pair") == F.col("_pair")) & (F.col("read_id") != F.col("_id")) & (F.col("_n") == 2), "left")
    insert = F.when(F.col("mate_chrom") == F.col("chrom"), F.col("_mate_five") - F.col("_five")).otherwise(F.lit(0))
    return joined.select(*reads.columns, "mate_chrom", "mate_pos", "mate_reverse", F.coalesce(insert, F.lit(0)).cast("long").alias("insert"))


def fastq(reads: DataFrame) -> DataFrame:
    """(name, seq, qual) as sequenced: reads of the reverse strand are complemented and turned."""
    seq = F.when(has(REVERSE), F.reverse(F.translate("seq", "ACGTacgt", "TGCAtgca"))).otherwise(F.col("seq"))
    qual = F.when(has(REVERSE), F.reverse("qual")).otherwise(F.col("qual"))
    end = F.when(has(READ1), "/1").when(has(READ2), "/2").otherwise("")
    return reads.select(F.concat("qname", end).alias("name"), seq.alias("seq"), qual.alias("qual"))


def bed(reads: DataFrame) -> DataFrame:
    strand = F.when(has(REVERSE), "-").otherwise("+")
    return reads.where(~has(UNMAPPED)).select("chrom", F.col("pos").alias("start"), (F.col("pos") + cigar.reference_length(F.col("cigar"))).alias("end"), F.col("qname").alias("name"), F.col("mapq").alias("score"), strand.alias("strand"))


def composition(sequences: DataFrame) -> DataFrame:
    """Base counts of (name, seq): length, a, c, g, t, cpg (pairs), other."""
    s = F.upper("seq")
    n = lambda x: (F.length(s) - F.length(F.translate(s, x, ""))).cast("long")
    cpg = F.floor((F.length(s) - F.length(F.replace(s, F.lit("CG"), F.lit("")))) / 2).cast("long")
    return sequences.select("name", F.length(s).cast("long").alias("length"), *(n(x).alias(x.lower()) for x in "ACGT"), cpg.alias("cpg"), (F.length(F.translate(s, "ACGT", ""))).cast("long").alias("other"))


def subsequence(sequences: DataFrame, regions: DataFrame) -> DataFrame:
    """Slices of (name, seq) for 1-based closed regions (name, low, high), clamped to the sequence."""
    low = F.greatest(F.col("low"), F.lit(1))
    return sequences.join(regions, "name").select("name", "low", "high", F.expr("substring(seq, cast(greatest(low, 1) as int), cast(greatest(least(high, length(seq)) - greatest(low, 1) + 1, 0) as int))").alias("seq"))


def in_ranges(reads: DataFrame, ranges: DataFrame) -> DataFrame:
    """Reads that overlap any of the 0-based half-open ranges (chrom, low, high) of a BED set, each as often as it is there.

    A read is kept with its first range alone, the one before which all ranges in order of their starts end before the
    read. A chromosome's ranges are ordered in one task; reads are not.
    """
    from .intervals import overlap_join

    keyed = reads.withColumns({"_low": F.col("pos"), "_high": F.col("pos") + F.greatest(cigar.reference_length(F.col("cigar")), F.lit(1)) - 1})
    bed = ranges.select("chrom", F.col("low").alias("_bl"), (F.col("high") - 1).alias("_bh")).where("_bl <= _bh")
    before = Window.partitionBy("chrom").orderBy("_bl", "_bh").rowsBetween(Window.unboundedPreceding, -1)
    pairs = overlap_join(keyed, bed.withColumn("_before", F.max("_bh").over(before)), "chrom", ("_low", "_high"), ("_bl", "_bh"))
    return pairs.where(F.col("_before").isNull() | (F.col("_before") < F.col("_low"))).select(*reads.columns)


def merged(files: dict[str, DataFrame], region: tuple[str, int, int] | None = None) -> DataFrame:
    """Reads of several files with ``rg``, the file's name, in order of place, strand, file and read; files need one schema."""
    parts = [df.withColumns({"rg": F.lit(name), "_file": F.lit(i)}) for i, (name, df) in enumerate(files.items())]
    both = reduce(DataFrame.unionByName, parts)
    return (fetch(both, *region) if region else both).orderBy("chrom", "pos", has(REVERSE), "_file", "read_id").drop("_file")


def concatenated(files: list[DataFrame]) -> DataFrame:
    """Reads of several files one after another, in no new order."""
    return reduce(DataFrame.unionByName, files)


def renamed_chromosomes(reads: DataFrame, names: DataFrame) -> DataFrame:
    """Reads under a new header: names (chrom, new); chromosomes without a new name keep theirs."""
    return reads.join(names.select("chrom", "new"), "chrom", "left").withColumn("chrom", F.coalesce("new", "chrom")).drop("new").select(*reads.columns)


def pileup(reads: DataFrame, min_mapq: int = 0, min_quality: int = 13, orphans: bool = False) -> DataFrame:
    """(chrom, pos, depth, a, c, g, t, n, forward, quality: sum) of aligned bases, 0-based.

    Unmapped, secondary, QC-failed and duplicate reads are left out, and reads of a pair that isn't proper unless
    ``orphans``. A base counts with the lesser of its own and its read's quality, if its own reaches ``min_quality``.
    Bases are summed on the map side, so that a deep position shuffles a row per task.
    """
    skip = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE
    kept = reads.where((F.col("flag").bitwiseAND(skip) == 0) & (F.col("mapq") >= min_mapq))
    if not orphans:
        kept = kept.where(~has(PAIRED) | has(PROPER))
    blocks = cigar.inlined(kept.withColumn("rev", has(REVERSE)), cigar.aligned_blocks, "chrom", "mapq", "rev", "seq", "qual")
    bases = blocks.select("chrom", "mapq", "rev", "start", "query", "seq", "qual", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    at = lambda c: F.substring(F.col(c), (F.col("query") + F.col("i") + 1).cast("int"), F.lit(1))
    own = F.ascii(at("qual")) - 33
    rows = bases.select("chrom", (F.col("start") + F.col("i")).alias("pos"), F.upper(at("seq")).alias("b"), "rev", own.alias("q"), F.least(own, "mapq").alias("quality")).where((F.col("q") >= min_quality) & (F.col("b") != ""))
    count = lambda c: F.count_if(F.col("b") == c)
    known = F.col("b").isin(*"ACGT")
    return rows.groupBy("chrom", "pos").agg(F.count("*").alias("depth"), *(count(c).alias(c.lower()) for c in "ACGT"), F.count_if(~known).alias("n"), F.count_if(~F.col("rev")).alias("forward"), F.sum("quality").cast("long").alias("quality"))


def position_depth(reads: DataFrame, keys: list[str], min_mapq: int = 0, min_quality: int = 0) -> DataFrame:
    """(keys, pos, depth) of aligned bases of a quality and more, deletions and gaps left out."""
    kept = reads.where(~has(UNMAPPED) & (F.col("mapq") >= min_mapq))
    blocks = cigar.inlined(kept, cigar.aligned_blocks, *keys, "qual")
    bases = blocks.select(*keys, "qual", "start", "query", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    good = F.ascii(F.substring(F.col("qual"), (F.col("query") + F.col("i") + 1).cast("int"), F.lit(1))) - 33 >= min_quality
    return (bases.where(good) if min_quality else bases).groupBy(*keys, (F.col("start") + F.col("i")).alias("pos")).agg(F.count("*").alias("depth"))


def with_differences(reads: DataFrame, sequences: DataFrame) -> DataFrame:
    """Reads with ``nm`` (mismatches, inserted and deleted bases) and ``md`` against their chromosome (name, seq).

    Each read gets the slice of the reference that it spans, cut on the JVM, so that no chromosome reaches a Python worker.
    Unmapped reads, and those of unknown chromosomes, have nulls.
    """
    from ..functions import kernels

    @F.pandas_udf("nm long, md string")
    def differ(seq: pd.Series, ops: pd.Series, ref: pd.Series) -> pd.DataFrame:
        found = [kernels.differences(s, c, r) if isinstance(r, str) and isinstance(s, str) else (None, None) for s, c, r in zip(seq, ops, ref, strict=True)]
        return pd.DataFrame({"nm": pd.array([f[0] for f in found], "Int64"), "md": [f[1] for f in found]})

    ref = sequences.select(F.col("name").alias("chrom"), F.col("seq").alias("_ref"))
    span = cigar.reference_length(F.col("cigar"))
    cut = F.when(~has(UNMAPPED), F.substring(F.col("_ref"), (F.col("pos") + 1).cast("int"), span.cast("int")))
    joined = reads.join(ref, "chrom", "left").withColumn("_ref", cut)
    return joined.withColumn("_d", differ("seq", "cigar", "_ref")).select(*reads.columns, "_d.nm", "_d.md")
