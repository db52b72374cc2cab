"""More queries beside their SQL: module tables and text, permutations and calls, pileups, sequences, variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import alignments as al
from ..operators import assembly as asm
from ..operators import differential as de
from ..operators import fragments as fr
from ..operators import intervals as iv
from ..operators import sequences as sq
from ..operators import trimming as tr
from . import views
from .catalog import _CTE, _PAIRS, _R, _RATIO, _WITHIN, _asm_rows, _exons, _gene_rows, _junctions, _observed, _paths, _permuted, _r, query

# -- modules and genes as tables and text

_KEPT = "SELECT asm FROM (SELECT asm, grp, avg(x) AS m FROM (SELECT asm, sample, grp, sum(expr) AS x FROM ap GROUP BY ALL) GROUP BY ALL) GROUP BY asm HAVING min(m) >= 300"


@query(f"SELECT DISTINCT asm FROM ap WHERE asm NOT IN ({_KEPT})", "asm_long am ap")
def rejected_asms(s, d):
    rows = _asm_rows(s, d)
    return de.rejected(rows.select("asm").distinct(), de.testable_asms(rows, 300), "asm")


@query("SELECT DISTINCT gene FROM gx WHERE gene NOT IN (SELECT gene FROM (SELECT gene, grp, avg(expr) AS m FROM gx GROUP BY ALL) GROUP BY gene HAVING max(m) >= 2000)", "gx")
def rejected_genes(s, d):
    rows = _gene_rows(s, d)
    return de.rejected(rows.select("gene").distinct(), de.testable_genes(rows, 2000), "gene")


@query("SELECT asm, path, " + ", ".join(f"sum(expr) FILTER (sample = {i}) AS s{i}" for i in range(24)) + " FROM ap GROUP BY ALL HAVING avg(expr) >= 15", "asm_long am ap")
def abundance_matrix(s, d):
    return asm.value_matrix(_asm_rows(s, d), "expr", list(range(24)))


_NUM = "printf('%.10f', {})"
_TINY = 3e-12  # off the halves that engines round differently


@query(f"""SELECT asm, 0 AS place, concat_ws(chr(9), CAST(asm AS VARCHAR), 'chr' || (asm % 3), CAST(asm * 1000 AS VARCHAR), CAST(asm * 1000 + 500 AS VARCHAR), CAST(n AS VARCHAR), CAST(asm % 9 AS VARCHAR), v) AS value
FROM (SELECT asm, string_agg({_NUM.format('e')} || chr(9) || {_NUM.format('CAST(0 AS DOUBLE)')}, chr(9) ORDER BY sample) AS v FROM (SELECT asm, sample, sum(expr) AS e FROM ap GROUP BY ALL) GROUP BY asm) JOIN (SELECT asm, count(DISTINCT path) AS n FROM ap GROUP BY asm) USING (asm)
UNION ALL SELECT asm, path + 1, concat_ws(chr(9), asm || '.p' || path, CAST(asm * 1000 + path * 10 AS VARCHAR), CAST(asm * 1000 + path * 10 + 5 AS VARCHAR), string_agg({_NUM.format('expr')} || chr(9) || {_NUM.format(f'prop + {_TINY}')}, chr(9) ORDER BY sample)) FROM ap GROUP BY asm, path""", "asm_long am ap")
def asm_lines(s, d):
    rows = _asm_rows(s, d).withColumn("prop", F.col("prop") + _TINY)
    modules = rows.groupBy("asm", "sample").agg(F.sum("expr").alias("expr")).selectExpr("asm", "concat('chr', asm % 3) as chrom", "asm * 1000 as low", "asm * 1000 + 500 as high", "asm % 9 as category", "sample", "expr", "0d as mse")
    return asm.asm_lines(modules, rows.selectExpr("asm", "path", "asm * 1000 + path * 10 as low", "asm * 1000 + path * 10 + 5 as high", "sample", "expr", "prop"))


@query(f"""SELECT concat_ws(chr(9), 'chr' || (asm % 3), CAST(asm AS VARCHAR), CAST(path AS VARCHAR), string_agg({_NUM.format('expr')}, chr(9) ORDER BY sample), string_agg({_NUM.format(f'prop + {_TINY}')}, chr(9) ORDER BY sample)) AS value FROM ap GROUP BY asm, path""", "asm_long am ap")
def expression_lines(s, d):
    return asm.expression_lines(_asm_rows(s, d).selectExpr("concat('chr', asm % 3) as chrom", "asm as low", "path as high", "sample", "expr", f"prop + {_TINY}d as prop"))


@query("SELECT asm, count(*) AS n, string_agg(flag || ':' || low || '-' || high, ',' ORDER BY low, high, flag) AS parts FROM (SELECT DISTINCT asm, path % 3 AS flag, path * 10 AS low, path * 10 + 5 + asm AS high FROM ap) GROUP BY asm", "asm_long am ap")
def asm_composition(s, d):
    return asm.compositions(_asm_rows(s, d).selectExpr("asm", "path % 3 as flag", "path * 10 as low", "path * 10 + 5 + asm as high").distinct())


@query("SELECT concat_ws(chr(9), CAST(gene AS VARCHAR), CASE WHEN gene % 2 = 1 THEN 'j' ELSE 'e' END, CAST(low AS VARCHAR), CAST(high AS VARCHAR), CAST(chrom AS VARCHAR)) AS value FROM genes", "genes")
def gene_composition(s, d):
    return asm.gene_composition_lines(views.genes(s, d).selectExpr("gene", "gene % 2 as flag", "low", "high", "chrom as support"))


@query("SELECT * FROM (SELECT id, junctions, paths, CASE WHEN junctions > 100 THEN 'decomposition' WHEN paths > 50 THEN 'gtf_generation' END AS reason FROM (SELECT o_custkey % 25 AS id, count(*) * (o_custkey % 25 + 1) // 10 AS junctions, count(DISTINCT o_orderkey % 97) AS paths FROM orders GROUP BY o_custkey % 25)) WHERE reason IS NOT NULL")
def not_enumerated(s, d):
    r = views.lineitem(s, d, "orders").groupBy(F.expr("o_custkey % 25").alias("id")).agg(F.count("*").alias("n"), F.count_distinct(F.expr("o_orderkey % 97")).alias("paths"))
    return asm.not_enumerated(r.select("id", F.expr("n * (id + 1) div 10").alias("junctions"), "paths"))


_LABELS = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(asm.CATEGORIES))


@query(f"SELECT gene, CASE gene % 11 {_LABELS} END AS label, CASE gene % 11 {_LABELS.replace('alter_start', 'alter_trans_start').replace('alter_end', 'alter_trans_end')} END AS table_label FROM genes", "genes")
def category_labels(s, d):
    code = F.expr("gene % 11")
    return views.genes(s, d).select("gene", asm.category_label(code).alias("label"), asm.category_label(code, True).alias("table_label"))


@query("""SELECT gene, a = b OR a IN ('?', '*') OR b IN ('?', '*') AS fits, CASE WHEN (a = '-' AND b IN ('-', '?')) OR (b = '-' AND a IN ('-', '?')) THEN '-' ELSE '+' END AS strand, CASE WHEN x AND y THEN 'annotated' WHEN x OR y THEN 'extension' ELSE 'novel' END AS kind
FROM (SELECT gene, substring('+-?*', CAST(gene % 4 + 1 AS INTEGER), 1) AS a, substring('+-?*', CAST(low % 4 + 1 AS INTEGER), 1) AS b, gene % 3 = 0 AS x, high % 5 = 0 AS y FROM genes)""", "genes")
def strand_and_class(s, d):
    g = views.genes(s, d).selectExpr("gene", "substring('+-?*', cast(gene % 4 + 1 as int), 1) as a", "substring('+-?*', cast(low % 4 + 1 as int), 1) as b", "gene % 3 = 0 as x", "high % 5 = 0 as y")
    a, b = F.col("a"), F.col("b")
    return g.select("gene", asm.strand_compatible(a, b).alias("fits"), asm.exon_strand(a, b).alias("strand"), asm.exon_annotation(F.col("x"), F.col("y")).alias("kind"))


@query("SELECT gene, CASE WHEN k <= n THEN round(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1), 6) + 0 END AS v FROM (SELECT gene, gene % 61 AS n, low % 17 AS k FROM genes)", "genes")
def log_choose(s, d):
    return views.genes(s, d).select("gene", F.round(asm.log_choose(F.expr("gene % 61"), F.expr("low % 17")), 6).alias("v"))


_MATCH = """SELECT s.chrom, s.position, s.direction, s.n, CASE WHEN bool_or(CASE WHEN s.direction = 'out' THEN r.high = s.position ELSE r.low = s.position END) THEN 'boundary' WHEN count(r.low) > 0 THEN 'in_exon' ELSE 'out_exon' END AS "match"
FROM sites s LEFT JOIN (SELECT * FROM ex WHERE low % 4000 != 0) r ON r.chrom = s.chrom AND r.low <= s.position AND s.position <= r.high GROUP BY ALL"""


_CTE["ok"] = f"SELECT * FROM ({_MATCH}) WHERE CASE \"match\" WHEN 'boundary' THEN n >= CAST(0.05 AS DOUBLE) * (position % 700 * 10) WHEN 'in_exon' THEN n >= CAST(0.1 AS DOUBLE) * (position % 700 * 10) ELSE position % 2 = 0 END"


@query(f"""SELECT chrom, start, "end" FROM jn WHERE (chrom, start, 'out') IN (SELECT chrom, position, direction FROM ok) AND (chrom, "end", 'in') IN (SELECT chrom, position, direction FROM ok)""", "reads j jn sites e ex ok")
def ref_assisted_filter(s, d):
    """Reference exons: those observed whose start isn't a multiple of 4000."""
    j = _junctions(s, d)
    sites = iv.splice_sites(j)
    match = iv.site_in_reference(sites, _exons(s, d).where("low % 4000 != 0"))
    marked = sites.join(match, ["chrom", "position", "direction"]).withColumns({"exon_expr": F.expr("cast(position % 700 * 10 as double)"), "kept": F.expr("position % 2 = 0")})
    return asm.assisted_junctions(j, asm.assisted_sites(marked))


@query("SELECT gene, gene % 3 - 1 AS level, gene % 7 = 0 AS root, high % 2 AS exons FROM genes WHERE gene % 3 - 1 < 1 AND gene % 7 != 0 AND high % 2 >= 1", "genes")
def gene_list(s, d):
    return asm.gene_list(views.genes(s, d).selectExpr("gene", "gene % 3 - 1 as level", "gene % 7 = 0 as root", "high % 2 as exons"))


@query("SELECT chrom, low, high, CASE WHEN low % 2000 = 0 AND high % 3 != 0 THEN 'both' WHEN low % 2000 = 0 THEN 'first' ELSE 'second' END AS side FROM ex WHERE low % 2000 = 0 OR high % 3 != 0", "reads e ex")
def exon_set_merge(s, d):
    x = _exons(s, d)
    return asm.merged_sets(x.where("low % 2000 = 0"), x.where("high % 3 != 0"), ["chrom", "low", "high"])


@query("""SELECT chrom, position, direction, strand, is_ref FROM (SELECT *, row_number() OVER (PARTITION BY chrom, position, direction ORDER BY turn, low, high, strand, is_ref) AS rn FROM (
SELECT chrom, low AS position, 'in' AS direction, 0 AS turn, low, high, CASE WHEN low % 4000 < 2000 THEN '+' ELSE '-' END AS strand, low % 5000 = 0 AS is_ref FROM ex UNION ALL SELECT chrom, high, 'out', 0, low, high, CASE WHEN low % 4000 < 2000 THEN '+' ELSE '-' END, low % 5000 = 0 FROM ex
UNION ALL SELECT chrom, start, 'out', 1, start, "end", '-', n % 2 = 0 FROM jn UNION ALL SELECT chrom, "end", 'in', 1, start, "end", '-', n % 2 = 0 FROM jn)) WHERE rn = 1""", "reads j jn e ex")
def site_union_first(s, d):
    x = _exons(s, d).selectExpr("chrom", "low", "high", "case when low % 4000 < 2000 then '+' else '-' end as strand", "low % 5000 = 0 as is_ref")
    return asm.site_union(x, _junctions(s, d).selectExpr("chrom", "start as low", "`end` as high", "'-' as strand", "n % 2 = 0 as is_ref"))


@query('SELECT start % 20 AS asm, bool_or(NOT start % 10000 < 3000) AS novel FROM jn GROUP BY ALL', "reads j jn")
def novel_modules(s, d):
    j = _junctions(s, d)
    return asm.novel_modules(j.selectExpr("start % 20 as asm", "chrom", "1 as flag", "start as low", "`end` as high"), j.where("start % 10000 < 3000"))


@query("""SELECT 'g' || (gene % 50) AS parent, CASE gene % 3 WHEN 0 THEN 'component' WHEN 1 THEN 'region' ELSE 'leaf' END AS kind, round(CASE gene % 3 WHEN 0 THEN sum(high) WHEN 1 THEN avg(high) ELSE max(high) END, 6) AS support FROM genes GROUP BY gene % 50, gene % 3""", "genes")
def representative_fragment(s, d):
    g = views.genes(s, d).selectExpr("concat('g', gene % 50) as parent", "case gene % 3 when 0 then 'component' when 1 then 'region' else 'leaf' end as kind", "cast(high as double) as support")
    return _r(asm.representative_fragments(g), "support")


@query("""SELECT 'l' || gene AS vertex, 'leaf' AS kind, CAST(high AS DOUBLE) AS support FROM genes UNION ALL SELECT 'c' || (gene % 40), 'component', sum(high) FROM genes GROUP BY gene % 40
UNION ALL SELECT 'r' || (c % 4), 'region', round(avg(x), 6) FROM (SELECT gene % 40 AS c, sum(high) AS x FROM genes GROUP BY 1) GROUP BY c % 4""", "genes")
def bottom_up_counts(s, d):
    g = views.genes(s, d)
    leaves = g.selectExpr("concat('l', gene) as vertex", "concat('c', gene % 40) as parent", "2 as level", "'leaf' as kind", "cast(high as double) as support")
    comps = g.selectExpr("concat('c', gene % 40) as vertex", "concat('r', gene % 40 % 4) as parent", "1 as level", "'component' as kind", "0d as support").distinct()
    regions = g.selectExpr("concat('r', gene % 40 % 4) as vertex", "'root' as parent", "0 as level", "'region' as kind", "0d as support").distinct()
    return _r(asm.fragment_counts_up(leaves.unionByName(comps).unionByName(regions), 2), "support")


# -- trimming


_BASES_OF = """SELECT o_orderkey {div} 150 AS feature, o_orderkey % 150 AS position, CASE WHEN o_orderkey {div} 150 % 4 = 1 THEN 'intron' ELSE 'exon' END AS kind, CASE o_orderkey {div} 150 % 4 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS site, o_orderkey {div} 150 % 11 = 10 AS annotated,
CASE k WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 6 + o_custkey % 3 WHEN 4 THEN 60 + o_custkey % 3 WHEN 5 THEN 70 + o_custkey % 5 WHEN 6 THEN 900 + o_custkey % 9 WHEN 7 THEN 1000 ELSE 12 END AS depth FROM (SELECT *, (o_orderkey {div} 150 * 7 + o_orderkey % 150 {div} 30 * 5) % 9 AS k FROM orders)"""
_CTE["tb"] = _BASES_OF.format(div="//")
_SHARP = """SELECT *, CASE WHEN i = 0 THEN 20.0 WHEN i = n - 1 THEN 0.0 WHEN (lmin > rmax AND r < 1 AND l >= 0.5) OR (lmax < rmin AND r > 1 AND g >= 0.5) THEN r ELSE 1.0 END AS ratio FROM (SELECT *, CASE WHEN l > 0 THEN g / l ELSE 20.0 END AS r FROM (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER f AS n,
avg(depth) OVER b AS l, min(depth) OVER b AS lmin, max(depth) OVER b AS lmax, avg(depth) OVER a AS g, min(depth) OVER a AS rmin, max(depth) OVER a AS rmax, max(depth) OVER f / CAST(4 AS DOUBLE) AS peak, sum(depth) OVER f AS total, max(depth) OVER a AS ahead, coalesce(sum(depth) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p
FROM tb WINDOW f AS (PARTITION BY feature), w AS (PARTITION BY feature ORDER BY position), b AS (PARTITION BY feature ORDER BY position ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY feature ORDER BY position ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)))"""
_CTE["sharp"] = _SHARP


def _bases(s, d):
    return views._sql(s, d, _BASES_OF.format(div="div"), "orders").withColumn("depth", F.col("depth").cast("long"))


@query('SELECT chrom, low, high, position, CAST(sum(n) AS BIGINT) AS depth FROM (SELECT *, unnest(generate_series(low, high)) AS position FROM ex) x JOIN (SELECT chrom, start, "end", count(*) AS n FROM e GROUP BY ALL) f USING (chrom) WHERE position BETWEEN start AND "end" GROUP BY ALL', "reads e ex")
def exon_base_depth(s, d):
    frags = fr.fragment_counts(fr.exon_fragments(views.reads(s, d))).groupBy("chrom", "start", "end").agg(F.sum("n").alias("n"))
    exons = frags.select("chrom", F.col("start").alias("low"), F.col("end").alias("high"), F.struct(F.col("start").alias("low"), F.col("end").alias("high")).alias("exon"))
    x = tr.feature_bases(exons, iv.coverage_runs(frags, ["chrom"]), ["exon"])
    return x.select("chrom", "exon.low", "exon.high", "position", "depth")


@query("SELECT feature, position, round(ratio, 6) AS ratio FROM sharp", "tb sharp")
def change_ratio(s, d):
    return _r(tr.change_ratio(_bases(s, d), ["feature"], 0.5).select("feature", "position", "ratio"), "ratio")


_RUNS = """SELECT feature, low, high, support, t FROM (SELECT feature, min(position) FILTER (starts) AS low, max(position) AS high, arg_max(p, position) - min(p) FILTER (starts) AS support, any_value(t) AS t FROM (
SELECT *, coalesce(sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY feature ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part, NOT stop AND CASE WHEN kind = 'exon' THEN depth > 4 * t ELSE ratio > 10 AND depth >= 4 * t END AS starts FROM (
SELECT *, i = n - 1 OR ((depth <= 4 * t OR ratio < 0.1) AND CASE WHEN kind = 'exon' AND peak <= 5 THEN i + 50 >= n OR ahead <= 4 * t WHEN kind = 'exon' THEN i + 1 >= n OR depth <= 4 * t ELSE i + 1 >= n OR depth <= 2 END) AS stop FROM (
SELECT *, CASE WHEN kind = 'exon' THEN greatest(peak * CAST(0.01 AS DOUBLE), 0.5) ELSE 1.0 END AS t FROM sharp WHERE site = 0 AND NOT (kind = 'exon' AND annotated)))) GROUP BY feature, part) WHERE low IS NOT NULL AND high - low + 1 >= 5 AND support >= 4 * t * (high - low + 1)"""
_SITE = """SELECT feature, low, high, support FROM (SELECT feature, coalesce(low, 0) AS low, coalesce(high, n - 1) AS high, coalesce(support, total) AS support, low IS NOT NULL AS cut FROM (SELECT feature, any_value(n) AS n, any_value(total) AS total, first(low ORDER BY rank DESC, tie DESC) FILTER (rank >= 5) AS low, first(high ORDER BY rank DESC, tie DESC) FILTER (rank >= 5) AS high, first(kept ORDER BY rank DESC, tie DESC) FILTER (rank >= 5) AS support FROM (
SELECT *, CASE WHEN gone < 1 THEN CASE WHEN site = 2 AND n - i <= 1 THEN 0 ELSE 1e9 END WHEN kept_n = 0 THEN 0 ELSE (kept / kept_n) / (gone / gone_n) END AS rank, CASE WHEN site = 1 THEN i ELSE n - i END AS tie FROM (
SELECT *, CASE WHEN site = 1 THEN i ELSE 0 END AS low, CASE WHEN site = 1 THEN n - 1 ELSE i - 1 END AS high, CASE WHEN site = 1 THEN p ELSE total - p END AS gone, CASE WHEN site = 1 THEN total - p ELSE p END AS kept, CASE WHEN site = 1 THEN i ELSE n - i END AS gone_n, CASE WHEN site = 1 THEN n - i ELSE i END AS kept_n FROM sharp WHERE site > 0 AND NOT annotated) WHERE site = 2 OR i > 0) GROUP BY feature)) WHERE high - low + 1 >= CASE WHEN cut THEN 5 ELSE 1 END AND support >= 2 * (high - low + 1)"""


@query(f"""SELECT feature, low, high, CAST(support AS BIGINT) AS support, low = 0 AS "first", high = n - 1 AS "last" FROM (SELECT feature, low, high, support FROM ({_RUNS}) UNION ALL SELECT * FROM ({_SITE})
UNION ALL SELECT feature, 0, max(n) - 1, max(total) FROM sharp WHERE annotated AND kind = 'exon' GROUP BY feature) JOIN (SELECT DISTINCT feature, n FROM sharp) USING (feature)""", "tb sharp")
def trim_exons(s, d):
    return tr.trimmed(_bases(s, d), ["feature"], 4, 0.5, 1.0)


# -- statistics


_CV, _P = "(0.05 + 200.0 / mean)", "(1 / (1 + exp(-(1.0 - 0.5 * ln(mean + 1)))))"
_REST = f"({_CV} * mean * mean * (1 - {_P}) - {_P} * mean * mean)"


@query(f"SELECT asm, path, CASE WHEN {_REST} > 0 THEN round(mean * mean / {_REST}, 6) END AS shape, CASE WHEN {_REST} > 0 THEN round({_REST} / (mean * (1 - {_P})), 2) END AS scale FROM paths", _RATIO)
def gamma_parameters(s, d):
    m = F.col("mean")
    shape, scale = S.gamma_parameters(m, S.cv2_curve(m, 0.05, 200.0), S.dropout_probability(m, 1.0, -0.5))
    return _paths(s, d)[1].select("asm", "path", F.round(shape, 6).alias("shape"), F.round(scale, 2).alias("scale"))


_S = f"SELECT asm, greatest(sum(jsd) / (count(*) - count(DISTINCT grp)), 0.001) AS s FROM ({_WITHIN}) WHERE grp = other GROUP BY asm"
_E = f"SELECT asm, s, CASE WHEN e <= 1 THEN 1.0 ELSE 2 * (1 - 1 / (1 + exp(-e / 3))) END * (SELECT max(s) FROM ({_S})) * 1.3 AS s_expr FROM ({_S}) JOIN (SELECT asm, avg(e) / 100 AS e FROM (SELECT asm, sample, sum(expr) AS e FROM ap GROUP BY ALL) GROUP BY asm) USING (asm)"


def _low(s, d):
    rows = _asm_rows(s, d)
    return rows, de.low_expression(rows.withColumn("expr", F.col("expr") / 100), de.within(rows))


@query(f"SELECT asm, round(s, 6) AS s, round(s_expr, 6) AS s_expr FROM ({_E})", "asm_long am ap gm0 gm")
def low_expression_penalty(s, d):
    return _r(_low(s, d)[1], "s", "s_expr")


@query(f"SELECT asm, group_1, group_2, round(sqrt(greatest(jsd, 0)) / (sqrt(s) + sqrt(s_expr + 0.01)), 5) AS d FROM ({_PAIRS}) JOIN ({_E}) USING (asm)", "asm_long am ap gm0 gm")
def pairwise_asm_d(s, d):
    rows, low = _low(s, d)
    return _r(de.pairwise_asms(rows, low, 0.01), "d", places=5)


_PG = "SELECT x.gene, x.grp AS group_1, y.grp AS group_2, (x.m - y.m) / (rs.s + 1) AS d FROM gp x JOIN gp y ON x.gene = y.gene AND x.grp < y.grp JOIN rs ON rs.gene = x.gene"


@query(f"SELECT gene, group_1, group_2, round(d, 5) AS d FROM ({_PG})", "gx gp gs0 rs")
def pairwise_gene_d(s, d):
    rows = _gene_rows(s, d)
    return _r(de.pairwise_genes(rows, de.gene_r_s(rows), 1.0), "d", places=5)


@query(f"SELECT gene, group_1, group_2, row_number() OVER (ORDER BY round(d, 5) DESC, gene, group_1, group_2) AS place FROM ({_PG})", "gx gp gs0 rs")
def pairs_by_d(s, d):
    rows = _gene_rows(s, d)
    x = de.pairwise_genes(rows, de.gene_r_s(rows), 1.0).withColumn("d", F.round("d", 5))
    return al.ranked(x.orderBy(F.desc("d"), "gene", "group_1", "group_2")).select("gene", "group_1", "group_2", F.col("rank").alias("place"))


@query("SELECT gene, row_number() OVER (ORDER BY round(r / (s + 1), 5), gene) AS place FROM rs", "gx gp gs0 rs")
def genes_by_d(s, d):
    x = de.moderated(de.gene_r_s(_gene_rows(s, d)), 1.0).withColumn("d", F.round("d", 5))
    return al.ranked(x.orderBy("d", "gene")).select("gene", F.col("rank").alias("place"))


@query(f"SELECT asm, row_number() OVER (ORDER BY round(r / (s + 0.01), 5) DESC, asm) AS place FROM ({_R}) a JOIN ({_S}) b USING (asm)", "asm_long am ap gm0 gm gr")
def asms_by_d(s, d):
    rows = _asm_rows(s, d)
    x = de.moderated(de.between(rows).join(de.within(rows), "asm"), 0.01).withColumn("d", F.round("d", 5))
    return al.ranked(x.orderBy(F.desc("d"), "asm")).select("asm", F.col("rank").alias("place"))


_N_PERM = 20
_CTE["lab"] = f"SELECT perm, sample, CASE WHEN rn <= 4 THEN 'A' WHEN rn <= 8 THEN 'B' ELSE 'C' END AS grp FROM (SELECT perm, sample, row_number() OVER (PARTITION BY perm ORDER BY (sample * 7919 + (perm + 3) * (sample + 11) * 104729) % 65537, sample) AS rn FROM (SELECT CAST(unnest(generate_series(0, {_N_PERM - 1})) AS BIGINT) AS perm), (SELECT DISTINCT sample FROM gx))"
_CTE["pgd"] = "SELECT perm, gene, sum(n * (m - g) * (m - g)) / nullif(count(*) - 1, 0) / (any_value(s) + 1) AS d FROM (SELECT l.perm, x.gene, l.grp, count(*) AS n, avg(x.expr) AS m FROM gx x JOIN lab l USING (sample) GROUP BY ALL) JOIN (SELECT gene, avg(expr) AS g FROM gx GROUP BY gene) USING (gene) JOIN rs USING (gene) GROUP BY perm, gene HAVING count(*) > 1"
_CTE["pge"] = "SELECT rk, avg(d) AS expected FROM (SELECT perm, d, row_number() OVER (PARTITION BY perm ORDER BY d) AS rk FROM pgd) GROUP BY rk"


def _fixed_labels(s, rows):
    """Labels dealt by arithmetic instead of hashes, which both engines do alike."""
    from pyspark.sql import Window

    order = Window.partitionBy("perm").orderBy(F.expr("(sample * 7919 + (perm + 3) * (sample + 11) * 104729) % 65537"), "sample")
    grid = s.range(_N_PERM).withColumnRenamed("id", "perm").crossJoin(F.broadcast(rows.select("sample").distinct()))  # 20 x 12 rows
    return grid.withColumn("rn", F.row_number().over(order)).selectExpr("perm", "sample", "case when rn <= 4 then 'A' when rn <= 8 then 'B' else 'C' end as `group`")


def _permuted_genes(s, d):
    rows = _gene_rows(s, d)
    return rows, de.permuted_genes(rows, _fixed_labels(s, rows), de.gene_r_s(rows), 1.0)


@query("SELECT perm, gene, round(d, 5) AS d FROM pgd", "gx gp gs0 rs lab pgd")
def permutation_matrix(s, d):
    return _r(_permuted_genes(s, d)[1], "d", places=5)


@query("SELECT rk AS rank, round(expected, 5) AS expected FROM pge", "gx gp gs0 rs lab pgd pge")
def expected_order(s, d):
    return _r(de.expected_order(_permuted_genes(s, d)[1]), "expected", places=5)


@query("""SELECT gene, round(d, 5) AS d, round(expected, 5) AS expected, round(fold, 5) AS fold, abs(d - expected) >= 1.2 AND abs(d - expected) >= 1 AND fold >= 1.5 AS significant FROM (SELECT gene, r / (s + 1) AS d, row_number() OVER (ORDER BY r / (s + 1)) AS rk FROM rs WHERE r IS NOT NULL) JOIN pge USING (rk) JOIN (SELECT gene, max(m) / min(m) AS fold FROM (SELECT gene, grp, avg(expr) AS m FROM gx GROUP BY ALL) GROUP BY gene) USING (gene)""", "gx gp gs0 rs lab pgd pge")
def gene_calls(s, d):
    rows, permuted = _permuted_genes(s, d)
    tested = de.with_expected(de.moderated(de.gene_r_s(rows), 1.0).select("gene", "d"), de.expected_order(permuted))
    x = de.gene_calls(tested, de.fold_change(rows), 1.2, 1.5, 1.0).select("gene", "d", "expected", "fold", "significant")
    return _r(x, "d", "expected", "fold", places=5)


@query(f"""SELECT asm, round(jsd, 6) AS jsd, d * 10 - rank >= 0.5 OR rank - d * 10 >= 0.5 AS far, (abs(d - rank / 10) >= 0.05) AND sqrt(greatest(jsd, 0)) >= 0.02 AS significant FROM (SELECT asm, r / (s + 0.01) AS d, row_number() OVER (ORDER BY r / (s + 0.01)) AS rank FROM ({_R}) a JOIN ({_S}) b USING (asm)) JOIN (SELECT asm, max(jsd) AS jsd FROM ({_PAIRS}) GROUP BY asm) USING (asm)""", "asm_long am ap gm0 gm gr")
def asm_calls(s, d):
    """Calls against a fixed line of expected statistics, a tenth of the rank."""
    rows = _asm_rows(s, d)
    seen = de.moderated(de.between(rows).join(de.within(rows), "asm"), 0.01).select("asm", "d")
    line = s.range(1, 100_000).select(F.col("id").cast("int").alias("rank"), (F.col("id") / 10).alias("expected"))
    x = de.asm_calls(de.with_expected(seen, line), de.largest_jsd(de.pairwise_jsd(rows)), 0.05, 0.02)
    return x.select("asm", F.round("jsd", 6).alias("jsd"), (F.abs(F.col("d") * 10 - F.col("rank")) >= 0.5).alias("far"), "significant")


@query("SELECT min(delta) AS cutoff FROM (%s) WHERE delta >= 1e-5 AND fdr <= 0.4")
def fdr_cutoff(s, d):
    x = de.fdr_cutoff(de.fdr_sweep(_observed(s, d), _permuted(s, d), 0.8), 0.4)
    return x.select(F.round("cutoff", 4).alias("cutoff"))


def _finish() -> None:
    from .catalog import ORACLES

    ORACLES["fdr_cutoff"] = ORACLES["fdr_cutoff"] % ORACLES["fdr_sweep"]


_finish()


# -- alignments


@query("SELECT read_id, rg, row_number() OVER (ORDER BY chrom, pos, flag & 16 != 0, f, read_id) AS place FROM (SELECT *, sample_id % 3 AS f, 'file' || (sample_id % 3) AS rg FROM reads)", "reads")
def merge_files(s, d):
    r = views.reads(s, d)
    files = {f"file{i}": r.where(f"sample_id % 3 = {i}") for i in range(3)}
    return al.ranked(al.merged(files)).select("read_id", "rg", F.col("rank").alias("place"))


@query("SELECT read_id FROM reads WHERE sample_id % 3 != 1", "reads")
def cat_files(s, d):
    r = views.reads(s, d)
    return al.concatenated([r.where("sample_id % 3 = 0"), r.where("sample_id % 3 = 2")]).select("read_id")


@query("SELECT read_id, CASE chrom WHEN 'chr1' THEN 'one' ELSE chrom END AS chrom FROM reads", "reads")
def reheader(s, d):
    return al.renamed_chromosomes(views.reads(s, d), s.createDataFrame([("chr1", "one"), ("chr9", "nine")], "chrom string, new string")).select("read_id", "chrom")


@query("SELECT read_id FROM reads r WHERE EXISTS (SELECT 1 FROM (SELECT chrom, low, high FROM (VALUES ('chr0', 100, 12050), ('chr1', 30010, 30020), ('chr1', 30000, 31000), ('chr2', 5, 5)) v(chrom, low, high)) b WHERE b.low < b.high AND b.chrom = r.chrom AND r.pos < b.high AND r.pos + 2 * a + gap > b.low)", "reads")
def view_bed(s, d):
    bed = s.createDataFrame([("chr0", 100, 12050), ("chr1", 30010, 30020), ("chr1", 30000, 31000), ("chr2", 5, 5)], "chrom string, low long, high long")
    return al.in_ranges(views.reads(s, d), bed).select("read_id")


_BASES = "substring(repeat(translate(cast(read_id * 7919 as string), '0123456789', '{}'), 20), 1, cast(2 * a as int))"


def _sequenced(s, d):
    return views.reads(s, d).withColumns({"seq": F.expr(_BASES.format("ACGTACGTNC")), "qual": F.expr(_BASES.format("!+5?ABCDEF"))})


_CTE["pb"] = "SELECT sample_id, chrom, mapq, flag, pos + i + CASE WHEN i >= a THEN gap ELSE 0 END AS p, substring(sq, CAST(i + 1 AS INTEGER), 1) AS b, ascii(substring(ql, CAST(i + 1 AS INTEGER), 1)) - 33 AS q FROM (SELECT *, unnest(range(2 * a)) AS i, {} AS sq, {} AS ql FROM reads)".format(*(_BASES.format(x).replace("as string", "as varchar") for x in ("ACGTACGTNC", "!+5?ABCDEF")))


@query("""SELECT chrom, p AS pos, count(*) AS depth, count(*) FILTER (b = 'A') AS a, count(*) FILTER (b = 'C') AS c, count(*) FILTER (b = 'G') AS g, count(*) FILTER (b = 'T') AS t, count(*) FILTER (b = 'N') AS n, count(*) FILTER (flag & 16 = 0) AS forward, CAST(sum(least(q, mapq)) AS BIGINT) AS quality
FROM pb WHERE flag & 1796 = 0 AND mapq >= 3 AND flag & 3 != 1 AND q >= 13 GROUP BY ALL""", "reads pb")
def mpileup(s, d):
    return al.pileup(_sequenced(s, d), 3)


@query("SELECT sample_id, chrom, p AS pos, count(*) AS depth FROM pb WHERE flag & 4 = 0 AND mapq >= 2 AND q >= 20 GROUP BY ALL", "reads pb")
def depth_filtered(s, d):
    return al.position_depth(_sequenced(s, d), ["sample_id", "chrom"], 2, 20)


# -- sequences and variants


_SQ = "SELECT read_id AS name, {} AS seq, {} AS qual, a FROM reads".format(*(_BASES.format(x).replace("as string", "as varchar") for x in ("ACGTRCGTNY", "!+5?ABCDEF")))
_CTE["sq"] = _SQ


def _seq(s, d):
    return views.reads(s, d).select(F.col("read_id").alias("name"), F.expr(_BASES.format("ACGTRCGTNY")).alias("seq"), F.expr(_BASES.format("!+5?ABCDEF")).alias("qual"))


def _letters(expr: str, table: str = "sq") -> str:
    return f"SELECT name, array_to_string(list_transform(generate_series(1, length(seq)), lambda i: {expr.replace('b END', 'substring(seq, i, 1) END').replace('lower(b)', 'lower(substring(seq, i, 1))')}), '') AS seq FROM {table}"


@query(_letters("CASE WHEN ascii(substring(qual, i, 1)) - 33 < 20 THEN lower(b) ELSE b END"), "reads sq")
def fq2fa(s, d):
    return sq.quality_masked(_seq(s, d))


@query(_letters("CASE WHEN name % 3 != 0 AND ((i > 2 AND i <= 9) OR (i > 5 AND i <= 12)) THEN lower(b) ELSE b END"), "reads sq")
def mask_regions(s, d):
    x = _seq(s, d)
    regions = x.where("name % 3 != 0").select("name", F.inline(F.expr("array(struct(2L as low, 9L as high), struct(5L as low, 12L as high))")))
    return sq.region_masked(x, regions)


@query("SELECT name, CAST(i AS BIGINT) AS pos, b AS code FROM (SELECT *, substring(seq, i, 1) AS b FROM (SELECT *, CAST(unnest(generate_series(1, length(seq))) AS INTEGER) AS i FROM sq)) WHERE b IN ('M', 'R', 'W', 'S', 'Y', 'K')", "reads sq")
def listhet(s, d):
    return sq.heterozygous(_seq(s, d))


_VAR = "SELECT o_orderkey AS id, 'chr' || (o_orderkey % 3) AS chrom, o_orderkey % 50000 * 3 AS pos, substring('ACGT', CAST(o_custkey % 4 + 1 AS INTEGER), 1) || CASE WHEN o_orderkey % 11 = 0 THEN 'AC' ELSE '' END AS ref, substring('GTCA', CAST(o_custkey % 4 + 1 AS INTEGER), 1) || CASE WHEN o_orderkey % 13 = 0 THEN 'TTA' ELSE '' END AS alt, o_custkey % 100 AS qual, o_orderkey % 40 AS depth FROM orders"
_CTE["va"] = _VAR


def _variants(s, d):
    o = views.lineitem(s, d, "orders")
    return o.selectExpr("o_orderkey as id", "concat('chr', o_orderkey % 3) as chrom", "o_orderkey % 50000 * 3 as pos", "concat(substring('ACGT', cast(o_custkey % 4 + 1 as int), 1), case when o_orderkey % 11 = 0 then 'AC' else '' end) as ref", "concat(substring('GTCA', cast(o_custkey % 4 + 1 as int), 1), case when o_orderkey % 13 = 0 then 'TTA' else '' end) as alt", "o_custkey % 100 as qual", "o_orderkey % 40 as depth", "transform(sequence(0, 3), i -> element_at(array('0/0', '0/1', '1|1', './.'), cast((o_orderkey + i * o_custkey) % 4 + 1 as int))) as gts")


@query("SELECT id, CAST(sum(CASE k WHEN 3 THEN 0 ELSE 2 END) AS BIGINT) AS an, CAST(sum(CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END) AS BIGINT) AS ac FROM (SELECT o_orderkey AS id, (o_orderkey + i * o_custkey) % 4 AS k FROM orders, (SELECT unnest(range(4)) AS i)) GROUP BY id")
def fill_allele_counts(s, d):
    return sq.allele_counts(_variants(s, d)).select("id", "an", "ac")


@query("""SELECT l AS least, count(*) AS n, count(*) FILTER (ref || alt IN ('AG', 'GA', 'CT', 'TC')) AS ts, count(*) FILTER (ref || alt NOT IN ('AG', 'GA', 'CT', 'TC')) AS tv FROM va JOIN (SELECT DISTINCT qual // 10 * 10 AS l FROM va WHERE length(ref) = 1 AND length(alt) = 1) ON qual >= l WHERE length(ref) = 1 AND length(alt) = 1 GROUP BY l""", "va")
def quality_steps(s, d):
    return sq.quality_statistics(_variants(s, d))


@query("SELECT length, count(*) AS n, length % 3 = 0 AS in_frame FROM (SELECT CAST(length(alt) - length(ref) AS BIGINT) AS length FROM va) WHERE length != 0 GROUP BY length", "va")
def indel_lengths(s, d):
    return sq.indel_statistics(_variants(s, d))


@query("""SELECT id, CASE WHEN qual < 10 THEN 'Q' WHEN depth < 2 THEN 'd' WHEN depth > 35 THEN 'D' WHEN length(ref) = length(alt) AND EXISTS (SELECT 1 FROM va w WHERE length(w.ref) != length(w.alt) AND w.chrom = v.chrom AND v.pos BETWEEN w.pos - 3 AND w.pos + length(w.ref) + 2) THEN 'G' ELSE '' END AS flag FROM va v""", "va")
def variant_filter(s, d):
    return sq.variant_flags(_variants(s, d), 2, 35).select("id", "flag")


@query("""SELECT chrom, i * 30000 + 1 AS low, CASE WHEN i = n - 1 THEN len ELSE (i + 1) * 30000 END AS high FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT chrom, len, greatest(CAST(ceil(len / 30000 - CAST(0.1 AS DOUBLE)) AS BIGINT), 1) AS n FROM (SELECT chrom, max(pos) AS len FROM va GROUP BY chrom)))""", "va")
def split_chromosomes(s, d):
    return sq.chunks(_variants(s, d).groupBy("chrom").agg(F.max("pos").alias("length")), 30000)
