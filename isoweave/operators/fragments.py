"""Reads to exon fragments and junctions, their counts and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar

#: Introns below this many bases are dropped.
MIN_INTRON = 5


def mapped(reads: DataFrame) -> DataFrame:
    return reads.where(F.col("flag").bitwiseAND(4) == 0)


def exon_fragments(reads: DataFrame) -> DataFrame:
    """(sample_id, chrom, start, end) of every aligned block."""
    return cigar.inlined(mapped(reads), cigar.exons, "sample_id", "chrom")


def junction_reads(reads: DataFrame) -> DataFrame:
    """(sample_id, chrom, xs, start, end) of every spliced gap."""
    return cigar.inlined(mapped(reads), cigar.junctions, "sample_id", "chrom", "xs")


def fragment_counts(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("sample_id", "chrom", "start", "end").agg(F.count("*").alias("n"))


def junction_support(junctions: DataFrame) -> DataFrame:
    """(chrom, start, end, sample_id, xs, n): long form, so the number of samples is never a schema's width."""
    return junctions.groupBy("chrom", "start", "end", "sample_id", "xs").agg(F.count("*").alias("n"))


def junction_matrix(support: DataFrame, samples: list[int]) -> DataFrame:
    """A column per sample, s<id>, zero where there is no support."""
    wide = support.groupBy("chrom", "start", "end").pivot("sample_id", samples).agg(F.sum("n"))
    return wide.select("chrom", "start", "end", *(F.coalesce(F.col(f"`{s}`"), F.lit(0)).cast("long").alias(f"s{s}") for s in samples))


def rectified(support: DataFrame) -> DataFrame:
    """Junctions of both strands coalesced: supports added up, the strand is that of more reads, + on a tie."""
    by_strand = support.groupBy("chrom", "start", "end", "xs").agg(F.sum("n").alias("n"))
    best = F.max_by("xs", F.struct("n", F.when(F.col("xs") == "+", 1).otherwise(0)))
    return by_strand.groupBy("chrom", "start", "end").agg(F.sum("n").alias("n"), best.alias("xs"))


def long_introns(junctions: DataFrame, least: int = MIN_INTRON) -> DataFrame:
    return junctions.where(F.col("end") - F.col("start") - 1 >= least)


def kept_by_group(support: DataFrame, samples: DataFrame, threshold: float) -> DataFrame:
    """Junctions whose mean support reaches the threshold in any group; samples without reads count as zero.

    ``samples``: (sample_id, group), a row per sample: its group sizes are a small dimension.
    """
    sizes = samples.groupBy("group").agg(F.count("*").alias("size"))
    dim = samples.join(sizes, "group")
    per = support.join(dim, "sample_id").groupBy("chrom", "start", "end", "group").agg((F.sum("n") / F.first("size")).alias("mean"))
    return per.groupBy("chrom", "start", "end").agg(F.max("mean").alias("best")).where(F.col("best") >= threshold).select("chrom", "start", "end")


def kept_by_samples(support: DataFrame, threshold: int, least: int) -> DataFrame:
    """Junctions with at least this support in at least so many samples."""
    per = support.groupBy("chrom", "start", "end", "sample_id").agg(F.sum("n").alias("n"))
    counted = per.groupBy("chrom", "start", "end").agg(F.count_if(F.col("n") >= threshold).alias("samples"))
    return counted.where(F.col("samples") >= least)


def whitelisted(junctions: DataFrame, annotation: DataFrame, kept: DataFrame) -> DataFrame:
    """Junctions that a filter kept or that are annotated: (chrom, start, end, annotated)."""
    key = ["chrom", "start", "end"]
    known = annotation.select(*key).distinct().withColumn("_known", F.lit(True))
    passed = kept.select(*key).distinct().withColumn("_passed", F.lit(True))
    marked = junctions.join(known, key, "left").join(passed, key, "left")
    return marked.where("_known or _passed").select(*key, F.coalesce("_known", F.lit(False)).alias("annotated"))


def read_stats(reads: DataFrame) -> DataFrame:
    """Per sample and chromosome: all reads, aligned ones, the range that they cover."""
    ok = F.col("flag").bitwiseAND(4) == 0
    end = F.col("pos") + cigar.reference_length(F.col("cigar")) - 1
    return reads.groupBy("sample_id", "chrom").agg(F.count("*").alias("reads"), F.count_if(ok).alias("aligned"), F.min(F.when(ok, F.col("pos"))).alias("min_start"), F.max(F.when(ok, end)).alias("max_end"))


def normalization_ratio(reads: DataFrame) -> DataFrame:
    """Largest sample's reads over each sample's; the maximum is one row."""
    counts = reads.groupBy("sample_id").agg(F.count("*").alias("reads"))
    top = counts.agg(F.max("reads").alias("top"))
    return counts.crossJoin(F.broadcast(top)).select("sample_id", (F.col("top") / F.col("reads")).alias("ratio"))


def chromosomes(reads: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Names of chromosomes that have reads; empty ones, # and * are left out."""
    found = reads.select("chrom").where("chrom is not null and chrom != '' and chrom != '*' and chrom not like '#%'").distinct()
    return found.where(F.col("chrom").isin(allowed)) if allowed else found
