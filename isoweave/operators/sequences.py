"""Operators on sequences (name, seq, qual) and on variants (chrom, pos, ref, alt, qual, gts), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The codes of two bases that differ, by the bases in order.
AMBIGUOUS = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}
TRANSITIONS = ("AG", "GA", "CT", "TC")


def _each(seq: Column, f) -> Column:
    """``seq`` with every letter replaced by f(letter, its place from 1)."""
    at = F.when(F.length(seq) > 0, F.sequence(F.lit(1), F.length(seq))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(at, lambda i: f(F.substring(seq, i, F.lit(1)), i)), "")


def quality_masked(reads: DataFrame, least: int = 20) -> DataFrame:
    """FASTA of FASTQ rows: bases whose quality is below ``least`` in lower case, the others in upper case."""
    low = lambda i: F.ascii(F.substring(F.col("qual"), i, F.lit(1))) - 33 < least
    return reads.select("name", _each(F.upper("seq"), lambda b, i: F.when(low(i), F.lower(b)).otherwise(b)).alias("seq"))


def region_masked(sequences: DataFrame, regions: DataFrame, hard: bool = False, complement: bool = False) -> DataFrame:
    """Sequences with their 0-based half-open regions (name, low, high) in lower case, or as N if ``hard``; ``complement``: all else instead."""
    own = regions.groupBy("name").agg(F.collect_list(F.struct("low", "high")).alias("_r"))
    joined = sequences.join(own, "name", "left")
    none = F.array().cast("array<struct<low: bigint, high: bigint>>")
    inside = lambda i: F.exists(F.coalesce(F.col("_r").cast("array<struct<low: bigint, high: bigint>>"), none), lambda x: (x["low"] < i) & (i <= x["high"]))
    masked = _each(F.col("seq"), lambda b, i: F.when(inside(i) != F.lit(complement), F.lit("N") if hard else F.lower(b)).otherwise(b))
    return joined.select("name", masked.alias("seq"))


def merged_iupac(a: DataFrame, b: DataFrame) -> DataFrame:
    """Letter-wise union of two sequences of a name over the shorter one: equal letters stay, two bases give their code, all else N."""
    both = a.select("name", F.upper("seq").alias("x")).join(b.select("name", F.upper("seq").alias("y")), "name")
    both = both.withColumn("x", F.expr("substring(x, 1, least(length(x), length(y)))"))

    def union(p: Column, i: Column) -> Column:
        q = F.substring(F.col("y"), i, F.lit(1))
        pair = F.concat(F.least(p, q), F.greatest(p, q))
        out = F.when(p == q, p)
        for two, code in AMBIGUOUS.items():
            out = out.when(pair == two, F.lit(code))
        return out.otherwise("N")

    return both.select("name", _each(F.col("x"), union).alias("seq"))


def letter_masked(sequences: DataFrame, masks: DataFrame) -> DataFrame:
    """Sequences with the letters of a mask (name, seq) in place of their own, but where the mask has X."""
    joined = sequences.join(masks.select("name", F.col("seq").alias("_m")), "name")
    return joined.select("name", _each(F.col("seq"), lambda b, i: F.when(F.substring(F.col("_m"), i, F.lit(1)).isin("X", ""), b).otherwise(F.substring(F.col("_m"), i, F.lit(1)))).alias("seq"))


def heterozygous(sequences: DataFrame) -> DataFrame:
    """(name, pos: from 1, code) of every two-base code in a sequence."""
    codes = list(AMBIGUOUS.values())
    letters = sequences.select("name", F.posexplode(F.split(F.upper("seq"), "")).alias("at", "code"))
    return letters.where(F.col("code").isin(codes)).select("name", (F.col("at") + 1).cast("long").alias("pos"), "code")


def heterozygosity(sequences: DataFrame, window: int = 50_000, steps: int = 5) -> DataFrame:
    """(name, start, n, known) in windows that begin every window / steps bases: two-base codes, letters but N."""
    step = window // steps
    letters = sequences.select("name", F.posexplode(F.split(F.upper("seq"), "")).alias("at", "code")).where("code != '' and code != 'N'")
    first = F.greatest(F.floor((F.col("at") - window) / step) + 1, F.lit(0))
    starts = F.explode(F.sequence(first, F.floor(F.col("at") / step)))
    per = letters.select("name", "code", starts.alias("s")).groupBy("name", "s")
    return per.agg(F.count_if(F.col("code").isin(list(AMBIGUOUS.values()))).alias("n"), F.count("*").alias("known")).select("name", (F.col("s") * step).cast("long").alias("start"), "n", "known")


def resolved(sequences: DataFrame, seed: int = 11) -> DataFrame:
    """Two-base codes replaced by one of their bases, drawn by name and place, so that a run gives the same again."""
    def draw(b: Column, i: Column) -> Column:
        first = F.pmod(F.xxhash64(F.col("name"), i, F.lit(seed)), F.lit(2)) == 0
        out = F.when(F.lit(False), b)
        for two, code in AMBIGUOUS.items():
            out = out.when(b == code, F.when(first, F.lit(two[0])).otherwise(F.lit(two[1])))
        return out.otherwise(b)

    return sequences.select("name", _each(F.upper("seq"), draw).alias("seq"))


def mutated(sequences: DataFrame, points: DataFrame) -> DataFrame:
    """Sequences with the bases at points (name, pos: from 1, base) set."""
    own = points.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("int"), "base"))).alias("_p"))
    joined = sequences.join(own, "name", "left")
    return joined.select("name", F.when(F.col("_p").isNull(), F.col("seq")).otherwise(_each(F.col("seq"), lambda b, i: F.coalesce(F.try_element_at("_p", i), b))).alias("seq"))


def cut_at_n(sequences: DataFrame, least: int = 1000) -> DataFrame:
    """(name, low, high, seq): pieces between tracts of ``least`` and more N, 1-based closed; shorter tracts stay within a piece."""
    gap = "[Nn]{%d,}" % least
    tracts = F.regexp_extract_all("seq", F.lit(f"({gap}|(?:(?!{gap}).)+)"), F.lit(1))
    parts = F.aggregate(tracts, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<low: bigint, high: bigint, seq: string>>").alias("out")), lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.when(x.rlike(f"^{gap}$"), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct((acc["at"] + 1).alias("low"), (acc["at"] + F.length(x)).alias("high"), x.alias("seq"))))).alias("out")), lambda acc: acc["out"])
    return sequences.select("name", F.inline(parts))


# -- variants


def _alleles() -> Column:
    return F.filter(F.flatten(F.transform("gts", lambda g: F.split(g, "[/|]"))), lambda x: x.rlike("^[0-9]+$"))


def allele_counts(variants: DataFrame) -> DataFrame:
    """``variants`` with an: called alleles, ac: those that aren't the reference."""
    return variants.withColumns({"an": F.size(_alleles()).cast("long"), "ac": F.size(F.filter(_alleles(), lambda x: x != "0")).cast("long")})


def with_samples(variants: DataFrame, chosen: list[int]) -> DataFrame:
    """Variants with the genotypes of the chosen samples alone, in their order."""
    return variants.withColumn("gts", F.array(*(F.get("gts", i) for i in chosen)))


def quality_statistics(variants: DataFrame, step: int = 10) -> DataFrame:
    """(least, n, ts, tv): substitutions of quality ``least`` and more, transitions and transversions; a row per step that occurs."""
    snv = variants.where((F.length("ref") == 1) & (F.length("alt") == 1))
    ts = F.concat("ref", "alt").isin(*TRANSITIONS)
    per = snv.groupBy((F.floor(F.col("qual") / step) * step).cast("long").alias("least")).agg(F.count("*").alias("n"), F.count_if(ts).alias("ts"))
    from pyspark.sql import Window

    above = Window.orderBy(F.desc("least")).rowsBetween(Window.unboundedPreceding, 0)  # a row per step
    return per.select("least", F.sum("n").over(above).alias("n"), F.sum("ts").over(above).alias("ts")).withColumn("tv", F.col("n") - F.col("ts"))


def indel_statistics(variants: DataFrame) -> DataFrame:
    """(length, n, in_frame) of insertions (above 0) and deletions."""
    length = (F.length("alt") - F.length("ref")).cast("long")
    return variants.select(length.alias("length")).where("length != 0").groupBy("length").agg(F.count("*").alias("n")).withColumn("in_frame", F.col("length") % 3 == 0)


def chunks(chromosomes: DataFrame, size: int) -> DataFrame:
    """(chrom, low, high): 1-based pieces of ``size`` bases of (chrom, length); a rest under a tenth of it joins the last piece."""
    n = F.greatest(F.ceil(F.col("length") / size - F.lit(0.1)), F.lit(1)).cast("long")
    rows = chromosomes.select("chrom", "length", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    return rows.select("chrom", (F.col("i") * size + 1).alias("low"), F.when(F.col("i") == F.col("n") - 1, F.col("length")).otherwise((F.col("i") + 1) * size).cast("long").alias("high"))


def variant_flags(variants: DataFrame, min_depth: int = 2, max_depth: int = 10_000_000, min_quality: int = 10, gap: int = 3) -> DataFrame:
    """``variants`` (with depth) and ``flag``: Q low quality, d or D depth below or above, G a substitution within ``gap`` bases of an indel; empty if none."""
    from .intervals import overlap_join

    indel = F.length("ref") != F.length("alt")
    near = variants.where(indel).select("chrom", (F.col("pos") - gap).alias("_l"), (F.col("pos") + F.length("ref") - 1 + gap).alias("_h"))
    at = variants.where(~indel).select("chrom", "pos", F.col("pos").alias("_p"))
    hit = overlap_join(at, near, "chrom", ("pos", "_p"), ("_l", "_h")).select("chrom", "pos").distinct().withColumn("_g", F.lit(True))
    flag = F.when(F.col("qual") < min_quality, "Q").when(F.col("depth") < min_depth, "d").when(F.col("depth") > max_depth, "D").when(~indel & F.col("_g"), "G").otherwise("")
    return variants.join(hit, ["chrom", "pos"], "left").withColumn("flag", flag).drop("_g")
