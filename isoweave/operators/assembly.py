"""Genes and splice modules as tables and text: labels, strands, exon sets, compositions, nested files, matrices.

Long tables: path rows (asm, path, sample, expr, prop), features (asm, flag, low, high), vertices (id, parent, level, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of modules by their number, kinds of a module's parts.
CATEGORIES = ("combination", "exon_skipping", "mutual_exclusive", "intron_retention", "alter_splice_site", "alter_start", "alter_end", "diff_expression", "nested")
EXON, JUNCTION, NESTED = 0, 1, 2
#: Strands that fit any other.
OPEN_STRANDS = ("?", "*")
#: Limits beyond which a region's paths aren't listed: its junctions, its paths.
MAX_JUNCTIONS, MAX_PATHS = 100, 50


def category_label(code: Column, table: bool = False) -> Column:
    """Name of a category number; ``table``: as in the test tables, where ends are those of transcription."""
    names = [n.replace("alter_st", "alter_trans_st").replace("alter_end", "alter_trans_end") if table else n for n in CATEGORIES]
    return F.when(code.between(0, len(names) - 1), F.element_at(F.array(*map(F.lit, names)), code.cast("int") + 1))


def strand_compatible(a: Column, b: Column) -> Column:
    """Equal strands, or one of them undetermined or mixed."""
    return (a == b) | a.isin(*OPEN_STRANDS) | b.isin(*OPEN_STRANDS)


def exon_strand(a: Column, b: Column) -> Column:
    """Strand of an exon by its two sites: - where one is - and the other is - or undetermined, else +."""
    minus = (a == "-") & b.isin("-", "?") | (b == "-") & a.isin("-", "?")
    return F.when(minus, "-").otherwise("+")


def exon_annotation(start_known: Column, end_known: Column) -> Column:
    """annotated, extension or novel, as both, one or none of an exon's sites are in the reference."""
    return F.when(start_known & end_known, "annotated").when(start_known | end_known, "extension").otherwise("novel")


def log_choose(n: Column, k: Column) -> Column:
    """Natural logarithm of n over k, exact to about 1e-9 relative; null unless 0 <= k <= n."""
    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.least(k, n - k))).otherwise(F.array().cast("array<long>")), F.lit(0.0), lambda s, i: s + F.log((n - i + 1) / i))
    return F.when((k >= 0) & (k <= n), F.when(F.least(k, n - k) > 0, total).otherwise(0.0))


def assisted_sites(sites: DataFrame, boundary: float = 0.05, inside: float = 0.1) -> DataFrame:
    """``sites`` (match, n, exon_expr, kept) with ``passes``: support of a share of the reference exon's expression.

    A site at an exon's boundary needs ``boundary`` of it, one within an exon ``inside``; any other passes as the
    ab-initio filter (``kept``) has it.
    """
    rule = F.when(F.col("match") == "boundary", F.col("n") >= boundary * F.col("exon_expr")).when(F.col("match") == "in_exon", F.col("n") >= inside * F.col("exon_expr")).otherwise(F.col("kept"))
    return sites.withColumn("passes", F.coalesce(rule, F.lit(False)))


def assisted_junctions(junctions: DataFrame, sites: DataFrame) -> DataFrame:
    """Junctions (chrom, start, end) both of whose sites pass."""
    good = sites.where("passes")
    start = good.where("direction = 'out'").select("chrom", F.col("position").alias("start")).distinct()
    end = good.where("direction = 'in'").select("chrom", F.col("position").alias("end")).distinct()
    return junctions.join(start, ["chrom", "start"], "left_semi").join(end, ["chrom", "end"], "left_semi").select("chrom", "start", "end")


def gene_list(vertices: DataFrame) -> DataFrame:
    """Vertices that count as genes: above level 1, not the root, with an exon at least."""
    return vertices.where("level < 1 and not root and exons >= 1")


def merged_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two sets of ``keys`` with ``side``: both, first or second. Each side's rows count once."""
    x, y = a.select(*keys).distinct().withColumn("_x", F.lit(True)), b.select(*keys).distinct().withColumn("_y", F.lit(True))
    side = F.when(F.col("_x") & F.col("_y"), "both").when(F.col("_x"), "first").otherwise("second")
    return x.join(y, keys, "full_outer").select(*keys, side.alias("side"))


def site_union(exons: DataFrame, junctions: DataFrame) -> DataFrame:
    """(chrom, position, direction, strand, is_ref) of all sites, of equal ones the first: exons before junctions.

    exons and junctions: (chrom, low, high, strand, is_ref); an exon is entered at its low and left at its high end,
    a junction the other way round.
    """
    def ends(df, first, low, high):
        at = F.array(F.struct(F.col("low").alias("position"), F.lit(low).alias("direction")), F.struct(F.col("high").alias("position"), F.lit(high).alias("direction")))
        return df.select("chrom", F.explode(at).alias("s"), F.struct(F.lit(first).alias("turn"), "low", "high", "strand", "is_ref").alias("of"))

    both = ends(exons, 0, "in", "out").unionByName(ends(junctions, 1, "out", "in"))
    best = both.groupBy("chrom", "s.position", "s.direction").agg(F.min("of").alias("of"))
    return best.select("chrom", "position", "direction", "of.strand", "of.is_ref")


def compositions(features: DataFrame) -> DataFrame:
    """(asm, n, parts): the parts of each module as flag:low-high in order of their place, comma-joined."""
    text = lambda x: F.concat_ws("", x["flag"].cast("string"), F.lit(":"), x["low"].cast("string"), F.lit("-"), x["high"].cast("string"))
    per = features.groupBy("asm").agg(F.sort_array(F.collect_list(F.struct("low", "high", "flag"))).alias("p"))
    return per.select("asm", F.size("p").cast("long").alias("n"), F.array_join(F.transform("p", text), ",").alias("parts"))


def gene_composition_lines(features: DataFrame) -> DataFrame:
    """Tab-separated lines of a gene's exons (e) and junctions (j) with their support: (gene, flag, low, high, support)."""
    kind = F.when(F.col("flag") == JUNCTION, "j").otherwise("e")
    return features.select(F.concat_ws("\t", F.col("gene").cast("string"), kind, F.col("low").cast("string"), F.col("high").cast("string"), F.col("support").cast("string")).alias("value"))


def not_enumerated(regions: DataFrame) -> DataFrame:
    """Regions (id, junctions, paths) whose paths aren't listed, with ``reason``: decomposition before gtf_generation."""
    reason = F.when(F.col("junctions") > MAX_JUNCTIONS, "decomposition").when(F.col("paths") > MAX_PATHS, "gtf_generation")
    return regions.withColumn("reason", reason).where("reason is not null")


def novel_modules(features: DataFrame, annotated: DataFrame) -> DataFrame:
    """(asm, novel): whether a module has a junction that isn't annotated (chrom, start, end)."""
    known = annotated.select("chrom", F.col("start").alias("low"), F.col("end").alias("high")).distinct().withColumn("_known", F.lit(True))
    marked = features.join(known, ["chrom", "low", "high"], "left")
    return marked.groupBy("asm").agg(F.bool_or((F.col("flag") == JUNCTION) & F.col("_known").isNull()).alias("novel"))


def fragment_counts_up(vertices: DataFrame, levels: int) -> DataFrame:
    """(vertex, kind, support) bottom up: a leaf's is its own, a component's the sum of its children, a region's their mean.

    vertices: (vertex, parent, level, kind: leaf, region or component, support of leaves). One aggregation per level.
    """
    done = vertices.where("kind = 'leaf'").select("vertex", "parent", "level", "kind", F.col("support").cast("double").alias("support"))
    for level in range(levels - 1, -1, -1):
        inner = vertices.where((F.col("level") == level) & (F.col("kind") != "leaf")).select("vertex", "parent", "level", "kind")
        below = done.where(F.col("level") == level + 1).groupBy(F.col("parent").alias("vertex")).agg(F.sum("support").alias("total"), F.avg("support").alias("mean"))
        own = inner.join(below, "vertex", "left").select("vertex", "parent", "level", "kind", F.coalesce(F.when(F.col("kind") == "component", F.col("total")).otherwise(F.col("mean")), F.lit(0.0)).alias("support"))
        done = done.unionByName(own)
    return done.select("vertex", "kind", "support")


def representative_fragments(vertices: DataFrame) -> DataFrame:
    """(parent, support): what stands for a vertex's children: components add up, regions average, leaves give their largest."""
    per = vertices.groupBy("parent", "kind").agg(F.sum("support").alias("s"), F.avg("support").alias("m"), F.max("support").alias("x"))
    return per.select("parent", "kind", F.when(F.col("kind") == "component", F.col("s")).when(F.col("kind") == "region", F.col("m")).otherwise(F.col("x")).alias("support"))


# -- text


def _number(c: Column) -> Column:
    return F.format_string("%.10f", c.cast("double"))


def _values(first: str, second: str) -> Column:
    pairs = F.sort_array(F.collect_list(F.struct("sample", F.concat_ws("\t", _number(F.col(first)), _number(F.col(second))).alias("v"))))
    return F.array_join(F.transform(pairs, lambda x: x["v"]), "\t")


def asm_lines(modules: DataFrame, paths: DataFrame) -> DataFrame:
    """Lines of the nested module file: (asm, place, value), a header (place 0) and a line per path under each module.

    modules: (asm, chrom, low, high, category, sample, expr, mse), a row per sample; paths: (asm, path, low, high,
    sample, expr, prop). Written in order of asm and place, they are the file.
    """
    n = paths.select("asm", "path").distinct().groupBy("asm").agg(F.count("*").alias("n_paths"))
    head = modules.groupBy("asm", "chrom", "low", "high", "category").agg(_values("expr", "mse").alias("v")).join(n, "asm")
    head = head.select("asm", F.lit(0).cast("long").alias("place"), F.concat_ws("\t", F.col("asm").cast("string"), "chrom", F.col("low").cast("string"), F.col("high").cast("string"), F.col("n_paths").cast("string"), F.col("category").cast("string"), "v").alias("value"))
    body = paths.groupBy("asm", "path", "low", "high").agg(_values("expr", "prop").alias("v"))
    name = F.concat(F.col("asm").cast("string"), F.lit(".p"), F.col("path").cast("string"))
    body = body.select("asm", (F.col("path") + 1).cast("long").alias("place"), F.concat_ws("\t", name, F.col("low").cast("string"), F.col("high").cast("string"), "v").alias("value"))
    return head.unionByName(body)


def read_asm_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(modules, paths) of a nested module file, as asm_lines() takes them; samples are numbered from 0.

    A path line belongs to the module in its own name, wherever it stands, so lines are read in parallel.
    """
    c = F.split("value", "\t")
    rows = spark.read.text(path).where("value != ''").withColumn("c", c)
    is_path = F.col("c")[0].rlike(r"\.p\d+$")

    def pairs(first: int, a: str, b: str):
        at = F.sequence(F.lit(0), ((F.size("c") - first) / 2).cast("int") - 1)
        return F.inline(F.transform(at, lambda i: F.struct(i.cast("long").alias("sample"), F.get("c", first + 2 * i).cast("double").alias(a), F.get("c", first + 2 * i + 1).cast("double").alias(b))))

    head = rows.where(~is_path).select(F.col("c")[0].alias("asm"), F.col("c")[1].alias("chrom"), F.col("c")[2].cast("long").alias("low"), F.col("c")[3].cast("long").alias("high"), F.col("c")[5].alias("category"), pairs(6, "expr", "mse"))
    body = rows.where(is_path).select(F.regexp_extract(F.col("c")[0], r"^(.*)\.p\d+$", 1).alias("asm"), F.regexp_extract(F.col("c")[0], r"\.p(\d+)$", 1).cast("long").alias("path"), F.col("c")[1].cast("long").alias("low"), F.col("c")[2].cast("long").alias("high"), pairs(3, "expr", "prop"))
    return head, body


def expression_lines(rows: DataFrame) -> DataFrame:
    """Lines chrom, low, high, all abundances, all proportions of (chrom, low, high, sample, expr, prop)."""
    ordered = F.sort_array(F.collect_list(F.struct("sample", _number(F.col("expr")).alias("e"), _number(F.col("prop")).alias("p"))))
    per = rows.groupBy("chrom", "low", "high").agg(ordered.alias("v"))
    joined = lambda f: F.array_join(F.transform("v", lambda x: x[f]), "\t")
    return per.select(F.concat_ws("\t", F.col("chrom").cast("string"), F.col("low").cast("string"), F.col("high").cast("string"), joined("e"), joined("p")).alias("value"))


def read_expression_lines(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, low, high, sample, expr, prop) of lines as expression_lines() gives them."""
    rows = spark.read.text(path).where("value != ''").select(F.split("value", "\t").alias("c"))
    n = ((F.size("c") - 3) / 2).cast("int")
    cells = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.cast("long").alias("sample"), F.get("c", i + 3).cast("double").alias("expr"), F.get("c", i + 3 + n).cast("double").alias("prop")))
    return rows.where(n > 0).select(F.col("c")[0].alias("chrom"), F.col("c")[1].cast("long").alias("low"), F.col("c")[2].cast("long").alias("high"), F.inline(cells))


def value_matrix(rows: DataFrame, value: str, samples: list, least: float = 15.0) -> DataFrame:
    """(asm, path, s<sample>, ...): a value of the paths whose mean abundance reaches ``least``, a column per listed sample."""
    enough = rows.groupBy("asm", "path").agg(F.avg("expr").alias("m")).where(F.col("m") >= least).select("asm", "path")
    wide = rows.join(enough, ["asm", "path"], "left_semi").groupBy("asm", "path").pivot("sample", samples).agg(F.sum(value))
    return wide.select("asm", "path", *(F.col(f"`{s}`").alias(f"s{s}") for s in samples))


def decomposed_gtf(paths: DataFrame) -> DataFrame:
    """GTF lines of module paths: a transcript line and its exon lines, from (asm, path, chrom, strand, exons: array of low, high)."""
    line = lambda kind, low, high: F.concat_ws("\t", "chrom", F.lit("isoweave"), F.lit(kind), low.cast("string"), high.cast("string"), F.lit("."), "strand", F.lit("."), F.concat(F.lit('gene_id "'), F.col("asm").cast("string"), F.lit('"; transcript_id "'), F.col("asm").cast("string"), F.lit(".p"), F.col("path").cast("string"), F.lit('";')))
    lows, highs = F.array_min(F.transform("exons", lambda x: x["low"])), F.array_max(F.transform("exons", lambda x: x["high"]))
    whole = F.array(line("transcript", lows, highs))
    return paths.select(F.explode(F.concat(whole, F.transform("exons", lambda x: line("exon", x["low"], x["high"])))).alias("value"))
