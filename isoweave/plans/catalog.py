"""One query per operator over the driver's tables, each beside the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import stats as S
from ..operators import alignments as al
from ..operators import differential as de
from ..operators import fragments as fr
from ..operators import intervals as iv
from ..operators import ratio as ra
from ..sources import readers as io
from . import views

QUERIES: dict = {}
ORACLES: dict = {}

_CTE = {
    "reads": views.READS_DUCK, "asm_long": views.ASM, "depth": views.DEPTH, "genes": views.GENES,
    "j": "SELECT sample_id, chrom, xs, pos + a - 1 AS start, pos + a + gap AS \"end\" FROM reads WHERE flag & 4 = 0",
    "e": "SELECT sample_id, chrom, pos AS start, pos + a - 1 AS \"end\" FROM reads WHERE flag & 4 = 0 UNION ALL SELECT sample_id, chrom, pos + a + gap, pos + 2 * a + gap - 1 FROM reads WHERE flag & 4 = 0",
    "sup": "SELECT chrom, start, \"end\", sample_id, xs, count(*) AS n FROM j GROUP BY ALL",
    "jn": "SELECT chrom, start, \"end\", count(*) AS n FROM j GROUP BY ALL",
    "ex": "SELECT DISTINCT chrom, start AS low, \"end\" AS high FROM e",
    "sites": "SELECT chrom, position, direction, CAST(sum(n) AS BIGINT) AS n FROM (SELECT chrom, start AS position, 'out' AS direction, n FROM jn UNION ALL SELECT chrom, \"end\", 'in', n FROM jn) GROUP BY ALL",
    "tot": "SELECT *, ercc + cellular + other AS total FROM depth",
    "frac": "SELECT *, cellular / total AS cf, ercc / total AS ef FROM tot",
    "sc": "SELECT cell, CAST(total AS BIGINT) AS total, cf, ef, (SELECT quantile_cont(cf, 0.5) FROM frac) / cf AS cs, (SELECT quantile_cont(ef, 0.5) FROM frac) / ef AS es FROM frac",
    "norm": "SELECT a.asm, a.path, a.cell, a.stage, a.expr / (d.ercc + d.cellular) * s.cs * 1e9 AS norm FROM asm_long a JOIN depth d USING (cell) JOIN sc s USING (cell)",
    "lvl": "SELECT median(m) AS l FROM (SELECT avg(norm) AS m FROM norm GROUP BY asm, path)",
    "paths": "SELECT asm, path, avg(norm) AS mean FROM norm GROUP BY asm, path HAVING avg(norm) >= (SELECT l FROM lvl) AND count(*) FILTER (norm >= (SELECT l FROM lvl)) >= 10",
    "rk": "SELECT *, row_number() OVER (PARTITION BY asm ORDER BY mean, path) AS rn FROM paths",
    "prs": "SELECT x.asm, x.path AS path_1, y.path AS path_2 FROM rk x JOIN rk y ON x.asm = y.asm AND x.rn < y.rn AND y.rn <= 10",
    "pc": "SELECT p.asm, p.path_1, p.path_2, a.cell, a.stage, round(a.norm, 4) AS a, round(b.norm, 4) AS b, CASE WHEN round(a.norm, 4) + round(b.norm, 4) = 0 THEN 0.5 ELSE round(a.norm, 4) / (round(a.norm, 4) + round(b.norm, 4)) END AS ratio FROM prs p JOIN norm a ON a.asm = p.asm AND a.path = p.path_1 JOIN norm b ON b.asm = p.asm AND b.path = p.path_2 AND b.cell = a.cell",
    "kr": "SELECT *, rank() OVER (PARTITION BY asm, path_1, path_2 ORDER BY round(ratio, 12)) + (count(*) OVER (PARTITION BY asm, path_1, path_2, round(ratio, 12)) - 1) / 2 AS r, count(*) OVER (PARTITION BY asm, path_1, path_2, round(ratio, 12)) AS t FROM pc",
    "kg": "SELECT asm, path_1, path_2, stage, count(*) AS n, sum(r) AS s, sum(t * t - 1) AS c FROM kr GROUP BY ALL",
    "kw": "SELECT asm, path_1, path_2, (12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - sum(c) / (sum(n) * sum(n) * sum(n) - sum(n))) AS h FROM kg GROUP BY ALL HAVING count(*) = 3",
    "am": "SELECT asm, path, cell % 24 AS sample, CASE WHEN cell % 24 < 8 THEN 'A' WHEN cell % 24 < 16 THEN 'B' ELSE 'C' END AS grp, sum(expr) AS expr FROM asm_long GROUP BY ALL",
    "ap": "SELECT *, CASE WHEN sum(expr) OVER (PARTITION BY asm, sample) > 0 THEN expr / sum(expr) OVER (PARTITION BY asm, sample) ELSE 0 END AS prop FROM am",
    "gm0": "SELECT asm, grp, path, avg(prop) AS m FROM ap GROUP BY ALL",
    "gm": "SELECT asm, grp, path, m / sum(m) OVER (PARTITION BY asm, grp) AS share FROM gm0",
    "gr": "SELECT asm, path, m / sum(m) OVER (PARTITION BY asm) AS share FROM (SELECT asm, path, avg(prop) AS m FROM ap GROUP BY ALL)",
    "gx": "SELECT o_custkey % 300 AS gene, o_orderkey % 12 AS sample, CASE WHEN o_orderkey % 12 < 4 THEN 'A' WHEN o_orderkey % 12 < 8 THEN 'B' ELSE 'C' END AS grp, sum(o_totalprice) / 1000 AS expr FROM orders GROUP BY ALL",
    "gp": "SELECT gene, grp, count(*) AS n, avg(expr) AS m, var_pop(expr) AS v FROM gx GROUP BY ALL",
    "gs0": "SELECT *, sum(n * m) OVER (PARTITION BY gene) / sum(n) OVER (PARTITION BY gene) AS g FROM gp",
    "rs": "SELECT gene, sum(n * (m - g) * (m - g)) / nullif(count(*) - 1, 0) AS r, least(coalesce(sum(n * v) / nullif(sum(n) - count(*), 0), 1999999999.0), 1999999999.0) AS s FROM gs0 GROUP BY gene",
    "pd": "SELECT o_orderkey % 7 AS perm, o_custkey % 300 AS id, sum(o_totalprice) / 100000 AS d FROM orders GROUP BY ALL",
    "od": "SELECT o_custkey % 300 AS id, sum(o_totalprice) / 600000 AS d FROM orders GROUP BY ALL",
    "isl": "SELECT *, sum(CASE WHEN b IS NULL OR low > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY low, high, gene) AS island FROM (SELECT *, max(high) OVER (PARTITION BY chrom ORDER BY low, high, gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM genes)",
}


def _term(p: str, q: str) -> str:
    kl = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"({kl(p)} + {kl(q)}) / 2"


def query(sql: str | None = None, needs: str = ""):
    """Register a query; ``needs``: the common table expressions of its SQL, in order."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            head = ", ".join(f"{n} AS ({_CTE[n]})" for n in needs.split())
            ORACLES[f.__name__] = (f"WITH {head} " if head else "") + sql  # SQL that begins with a comma goes on with expressions of its own
        return f

    return add


def _r(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Float sums depend on their order, so they are compared rounded."""
    return df.withColumns({c: F.round(c, places) for c in cols})


def _support(s, d):
    return fr.junction_support(fr.junction_reads(views.reads(s, d)))


def _junctions(s, d):
    return _support(s, d).groupBy("chrom", "start", "end").agg(F.sum("n").alias("n"))


def _exons(s, d):
    return fr.exon_fragments(views.reads(s, d)).select("chrom", F.col("start").alias("low"), F.col("end").alias("high")).distinct()


def _samples(s):
    return s.createDataFrame([(i, "A" if i < 4 else "B") for i in range(8)], "sample_id long, `group` string")


# -- fragments


@query('SELECT sample_id, chrom, start, "end" FROM e', "reads e")
def cigar_exons(s, d):
    return fr.exon_fragments(views.reads(s, d))


@query('SELECT * FROM j', "reads j")
def cigar_junctions(s, d):
    return fr.junction_reads(views.reads(s, d))


@query('SELECT sample_id, chrom, start, "end", count(*) AS n FROM e GROUP BY ALL', "reads e")
def fragment_counts(s, d):
    return fr.fragment_counts(fr.exon_fragments(views.reads(s, d)))


@query('SELECT chrom, start, "end", ' + ", ".join(f"CAST(coalesce(sum(n) FILTER (sample_id = {i}), 0) AS BIGINT) AS s{i}" for i in range(8)) + " FROM sup GROUP BY ALL", "reads j sup")
def junction_matrix(s, d):
    return fr.junction_matrix(_support(s, d), list(range(8)))


@query("""SELECT chrom, start, "end", CAST(sum(n) AS BIGINT) AS n, CASE WHEN coalesce(sum(n) FILTER (xs = '+'), 0) >= coalesce(sum(n) FILTER (xs = '-'), 0) THEN '+' ELSE '-' END AS xs FROM sup GROUP BY ALL""", "reads j sup")
def strand_rectify(s, d):
    return fr.rectified(_support(s, d))


@query('SELECT chrom, start, "end", n FROM jn WHERE "end" - start - 1 >= 200', "reads j jn")
def min_intron(s, d):
    return fr.long_introns(_junctions(s, d), 200)


@query("""SELECT chrom, start, "end" FROM (SELECT chrom, start, "end", sample_id < 4 AS g, sum(n) / 4 AS m FROM sup GROUP BY ALL) GROUP BY ALL HAVING max(m) >= 5""", "reads j sup")
def junction_filter_group(s, d):
    return fr.kept_by_group(_support(s, d), _samples(s), 5)


@query("""SELECT chrom, start, "end", count(*) AS samples FROM (SELECT chrom, start, "end", sample_id, sum(n) AS n FROM sup GROUP BY ALL) WHERE n >= 4 GROUP BY ALL HAVING count(*) >= 5""", "reads j sup")
def junction_filter_nogroup(s, d):
    return fr.kept_by_samples(_support(s, d), 4, 5)


@query("""SELECT chrom, start, "end", start % 10000 < 3000 AS annotated FROM jn WHERE start % 10000 < 3000 OR "end" - start - 1 >= 300""", "reads j jn")
def junction_whitelist(s, d):
    j = _junctions(s, d)
    return fr.whitelisted(j, j.where("start % 10000 < 3000"), fr.long_introns(j, 300))


@query("SELECT sample_id, chrom, count(*) AS reads, count(*) FILTER (flag & 4 = 0) AS aligned, min(pos) FILTER (flag & 4 = 0) AS min_start, max(pos + 2 * a + gap - 1) FILTER (flag & 4 = 0) AS max_end FROM reads GROUP BY ALL", "reads")
def read_stats(s, d):
    return fr.read_stats(views.reads(s, d))


@query("SELECT sample_id, round(max(n) OVER () / n, 6) AS ratio FROM (SELECT sample_id, count(*) AS n FROM reads GROUP BY ALL)", "reads")
def norm_ratio(s, d):
    return _r(fr.normalization_ratio(views.reads(s, d)), "ratio")


@query("SELECT DISTINCT chrom FROM reads", "reads")
def chrom_list(s, d):
    return fr.chromosomes(views.reads(s, d))


# -- intervals


@query("SELECT * FROM sites", "reads j jn sites")
def splice_site_union(s, d):
    return iv.splice_sites(_junctions(s, d))


_SEG = """SELECT chrom, position + CASE WHEN direction = 'out' THEN 1 ELSE 0 END AS low, p2 - CASE WHEN d2 = 'in' THEN 1 ELSE 0 END AS high,
CASE WHEN direction = 'in' AND d2 = 'out' THEN 0 WHEN direction = 'out' AND d2 = 'out' THEN 1 WHEN direction = 'in' AND d2 = 'in' THEN 2 ELSE -1 END AS kind
FROM (SELECT *, lead(position) OVER w AS p2, lead(direction) OVER w AS d2 FROM sites WINDOW w AS (PARTITION BY chrom ORDER BY position, direction)) WHERE p2 IS NOT NULL"""


@query(f"SELECT * FROM ({_SEG}) WHERE low <= high", "reads j jn sites")
def exon_segments(s, d):
    return iv.segments(iv.splice_sites(_junctions(s, d)))


@query(f"SELECT kind, count(*) AS n FROM ({_SEG}) WHERE low <= high GROUP BY kind", "reads j jn sites")
def alter_site_class(s, d):
    return iv.segments(iv.splice_sites(_junctions(s, d))).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT chrom, CAST(island AS BIGINT) AS island, min(low) AS low, max(high) AS high, count(*) AS genes FROM isl GROUP BY ALL", "genes isl")
def gene_islands(s, d):
    return iv.islands(views.genes(s, d), "chrom", "low", "high").groupBy("chrom", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("genes"))


@query("SELECT chrom, low, high, CAST(sum(CASE WHEN p IS NULL OR low <= p + 1 THEN 1 ELSE 2 END) OVER (PARTITION BY chrom ORDER BY low, high) AS BIGINT) AS vis_id FROM (SELECT *, lag(high) OVER (PARTITION BY chrom ORDER BY low, high) AS p FROM ex)", "reads e ex")
def vis_exon_ids(s, d):
    return iv.visual_ids(_exons(s, d))


_COV = """SELECT chrom, p AS start, lead(p) OVER w - 1 AS "end", CAST(sum(c) OVER w AS BIGINT) AS depth FROM (SELECT chrom, p, sum(c) AS c FROM (SELECT chrom, start AS p, 1 AS c FROM e UNION ALL SELECT chrom, "end" + 1, -1 FROM e) GROUP BY ALL HAVING sum(c) != 0) WINDOW w AS (PARTITION BY chrom ORDER BY p)"""


@query(f"SELECT * FROM ({_COV}) WHERE depth > 0", "reads e")
def coverage_rle(s, d):
    return iv.coverage_runs(fr.fragment_counts(fr.exon_fragments(views.reads(s, d))), ["chrom"])


@query("""SELECT x.chrom, x.low, x.high, round(coalesce(sum(f.n * (least(x.high, f."end") - greatest(x.low, f.start) + 1)), 0) / (x.high - x.low + 1), 6) AS coverage
FROM ex x LEFT JOIN (SELECT chrom, start, "end", count(*) AS n FROM e GROUP BY ALL) f ON x.chrom = f.chrom AND x.low <= f."end" AND f.start <= x.high GROUP BY x.chrom, x.low, x.high""", "reads e ex")
def exon_mean_coverage(s, d):
    frags = fr.exon_fragments(views.reads(s, d)).groupBy("chrom", "start", "end").agg(F.count("*").alias("n"))
    exons = frags.select("chrom", F.col("start").alias("low"), F.col("end").alias("high"), F.struct(F.col("start").alias("low"), F.col("end").alias("high")).alias("exon"))
    return _r(iv.mean_coverage(exons, frags, "chrom").select("chrom", "exon.low", "exon.high", "coverage"), "coverage")


@query("""SELECT s.chrom, s.position, s.direction, CASE WHEN bool_or(CASE WHEN s.direction = 'out' THEN r.high = s.position ELSE r.low = s.position END) THEN 'boundary' WHEN count(r.low) > 0 THEN 'in_exon' ELSE 'out_exon' END AS "match"
FROM sites s LEFT JOIN (SELECT * FROM ex WHERE low % 3 != 0) r ON r.chrom = s.chrom AND r.low <= s.position AND s.position <= r.high GROUP BY ALL""", "reads j jn sites e ex")
def ref_exon_match(s, d):
    return iv.site_in_reference(iv.splice_sites(_junctions(s, d)), _exons(s, d).where("low % 3 != 0"))


@query("""SELECT chrom, low, high, kind, coverage FROM (SELECT *, greatest(last_value(CASE WHEN kind = 'exon' THEN coverage END IGNORE NULLS) OVER (PARTITION BY chrom ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(CASE WHEN kind = 'exon' THEN coverage END IGNORE NULLS) OVER (PARTITION BY chrom ORDER BY low, high ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS top
FROM (SELECT chrom, low, high, CASE WHEN gene % 3 = 0 THEN 'exon' ELSE 'intron' END AS kind, CAST(gene % 17 AS DOUBLE) AS coverage FROM (SELECT min(gene) AS gene, chrom, low, high FROM genes GROUP BY chrom, low, high))) WHERE kind = 'exon' OR (top IS NOT NULL AND coverage >= top / 2)""", "genes")
def relative_intron_filter(s, d):
    g = views.genes(s, d).groupBy("chrom", "low", "high").agg(F.min("gene").alias("gene"))
    return iv.relative_introns(g.select("chrom", "low", "high", F.expr("case when gene % 3 = 0 then 'exon' else 'intron' end").alias("kind"), F.expr("cast(gene % 17 as double)").alias("coverage")))


@query('SELECT jn.* FROM jn WHERE EXISTS (SELECT 1 FROM ex a WHERE a.low % 3 != 0 AND a.chrom = jn.chrom AND a.high = jn.start) AND EXISTS (SELECT 1 FROM ex b WHERE b.low % 3 != 0 AND b.chrom = jn.chrom AND b.low = jn."end")', "reads j jn e ex")
def incomplete_junction_semi(s, d):
    return iv.complete_junctions(_junctions(s, d), _exons(s, d).where("low % 3 != 0"))


_FEAT = "SELECT chrom, low * 100000 + high AS id, low, high FROM ex UNION ALL SELECT chrom, start * 100000 + \"end\" + 50000, start, \"end\" FROM jn"


def _features(s, d):
    x = _exons(s, d).select("chrom", (F.col("low") * 100000 + F.col("high")).alias("id"), "low", "high")
    return x.unionByName(_junctions(s, d).select("chrom", (F.col("start") * 100000 + F.col("end") + 50000).alias("id"), F.col("start").alias("low"), F.col("end").alias("high")))


@query(f"SELECT x.chrom, x.id AS a, y.id AS b FROM ({_FEAT}) x JOIN ({_FEAT}) y ON x.chrom = y.chrom AND abs(y.low - x.high) <= 1 AND x.id != y.id", "reads j jn e ex")
def adjacency_edges(s, d):
    return iv.adjacent(_features(s, d))


@query(f"""SELECT chrom, low, count(*) AS genes, max(high) AS high FROM (SELECT chrom, min(low) OVER (PARTITION BY chrom, island) AS low, high FROM isl) GROUP BY ALL""", "genes isl")
def connected_components(s, d):
    """Components of overlapping genes by union-find within each island."""
    g = iv.islands(views.genes(s, d), "chrom", "low", "high")

    def label(pdf):
        rows = pdf.sort_values(["low", "high", "gene"])
        reach, edges, last = None, [], None
        for r in rows.itertuples():
            if last is not None and r.low <= reach + 1:
                edges.append((last, r.gene))
            last, reach = r.gene, r.high if reach is None else max(reach, r.high)
        comp = kernels.union_find(rows.gene.tolist(), edges)
        rows["component"] = rows.gene.map(comp)
        return rows[["chrom", "gene", "low", "high", "component"]]

    # many islands in a call: a component never leaves its island
    c = g.groupBy("chrom", F.floor(F.col("island") / 512)).applyInPandas(label, "chrom long, gene long, low long, high long, component long")
    return c.groupBy("chrom", "component").agg(F.min("low").alias("low"), F.count("*").alias("genes"), F.max("high").alias("high")).select("chrom", "low", "genes", "high")


@query("""WITH RECURSIVE ed AS (SELECT n_regionkey * 10 AS a, 100 + n_nationkey AS b FROM nation UNION SELECT 100 + n_nationkey, 200 + n_nationkey % 4 FROM nation),
p(a, b, n) AS (SELECT a, b, 1 FROM ed WHERE a < 100 UNION ALL SELECT p.a, ed.b, n + 1 FROM p JOIN ed ON p.b = ed.a)
SELECT a AS start, b AS stop, CAST(n AS BIGINT) AS length, count(*) AS paths FROM p WHERE b >= 200 GROUP BY ALL""")
def path_enum(s, d):
    """Paths of a layered graph, enumerated per start."""
    n = views.lineitem(s, d, "nation")
    e = n.selectExpr("n_regionkey * 10 as a", "100 + n_nationkey as b").unionByName(n.selectExpr("100 + n_nationkey as a", "200 + n_nationkey % 4 as b")).distinct()
    heads = e.where("a < 100").select(F.col("a").alias("start"), "a", "b")
    own = heads.unionByName(heads.select("start", F.col("b").alias("m")).join(e, F.col("m") == F.col("a")).select("start", "a", "b"))

    def run(key, pdf):
        import pandas as pd

        found = kernels.enumerate_paths(list(zip(pdf.a, pdf.b, strict=True)), [key[0]], {b for b in pdf.b if b >= 200}) or []
        return pd.DataFrame([(key[0], p[-1], len(p) - 1) for p in found], columns=["start", "stop", "length"])

    paths = own.distinct().groupBy("start").applyInPandas(run, "start long, stop long, length long")
    kinds = {k: t for k, t in e.dtypes}
    return paths.groupBy("start", "stop", "length").agg(F.count("*").alias("paths")).select(F.col("start").cast(kinds["a"]).alias("start"), F.col("stop").cast(kinds["b"]).alias("stop"), "length", "paths")


@query("""WITH x AS (SELECT o_custkey % 500 AS gene, o_totalprice AS coverage FROM orders), q AS (SELECT gene, quantile_cont(coverage, 0.25) AS q FROM x GROUP BY gene HAVING count(*) >= 5) SELECT gene, round(avg(coverage) + 0.0003, 2) AS coverage FROM x JOIN q USING (gene) WHERE coverage >= q.q GROUP BY gene""")
def gene_mean_coverage_q25(s, d):
    x = views.lineitem(s, d, "orders").selectExpr("o_custkey % 500 as gene", "o_totalprice as coverage")
    return _r(de.upper_quartile_coverage(x).withColumn("coverage", F.col("coverage") + 0.0003), "coverage", places=2)  # off the halves


@query(""", ev AS (SELECT o_orderkey AS id, o_orderkey % 5 AS chrom, o_orderkey % 50000 * 7 + 3 AS lo, o_orderkey % 50000 * 7 + 20 AS hi FROM orders),
p AS (SELECT id, g.gene, g.low, least(hi, g.high) - greatest(lo, g.low) + 1 AS sh, hi - lo + 1 AS le, g.high - g.low + 1 AS lg FROM ev JOIN genes g ON g.chrom = ev.chrom AND lo <= g.high AND g.low <= hi)
SELECT ev.id, coalesce(x.genes, 'na') AS genes FROM ev LEFT JOIN (SELECT id, string_agg(CAST(gene AS VARCHAR), ',' ORDER BY low, gene) AS genes FROM p WHERE 2 * sh > le OR 2 * sh > lg GROUP BY id) x USING (id)""", "genes")
def gene_overlap_label(s, d):
    ev = views.lineitem(s, d, "orders").selectExpr("o_orderkey as id", "o_orderkey % 5 as chrom", "o_orderkey % 50000 * 7 + 3 as e_low", "o_orderkey % 50000 * 7 + 20 as e_high")
    return iv.gene_labels(ev, views.genes(s, d))


# -- differential statistics


def _by_sample(cells):
    x = cells.selectExpr("asm", "path", "cell % 24 as sample", "case when cell % 24 < 8 then 'A' when cell % 24 < 16 then 'B' else 'C' end as `group`", "expr")
    return x.groupBy("asm", "path", "sample", "group").agg(F.sum("expr").alias("expr"))


def _asm_rows(s, d):
    x = _by_sample(views.asm_long(s, d))
    return x.withColumn("prop", F.coalesce(F.try_divide("expr", F.sum("expr").over(Window.partitionBy("asm", "sample"))), F.lit(0.0)))


def _gene_rows(s, d):
    return views.lineitem(s, d, "orders").selectExpr("o_custkey % 300 as gene", "o_orderkey % 12 as sample", "case when o_orderkey % 12 < 4 then 'A' when o_orderkey % 12 < 8 then 'B' else 'C' end as `group`", "o_totalprice").groupBy("gene", "sample", "group").agg((F.sum("o_totalprice") / 1000).alias("expr"))


@query("SELECT asm, path FROM ap GROUP BY ALL HAVING max(prop) >= 0.01 OR (avg(prop) >= 0.005 AND avg(expr) >= 5) OR count(*) FILTER (expr >= 5) >= 0.24", "asm_long am ap")
def major_paths(s, d):
    return de.major_paths(_asm_rows(s, d), 24)


@query("SELECT asm FROM (SELECT asm, grp, avg(x) AS m FROM (SELECT asm, sample, grp, sum(expr) AS x FROM ap GROUP BY ALL) GROUP BY ALL) GROUP BY asm HAVING min(m) >= 300", "asm_long am ap")
def asm_filter(s, d):
    return de.testable_asms(_asm_rows(s, d), 300)


@query("SELECT gene FROM (SELECT gene, grp, avg(expr) AS m FROM gx GROUP BY ALL) GROUP BY gene HAVING max(m) >= 2000", "gx")
def gene_filter(s, d):
    return de.testable_genes(_gene_rows(s, d), 2000)


@query('SELECT gene, grp AS "group", round(avg(expr), 3) AS mean FROM gx GROUP BY ALL', "gx")
def group_means(s, d):
    return _r(de.group_means(_gene_rows(s, d), "gene"), "mean", places=3)


@query("SELECT asm, path FROM (SELECT asm, path, row_number() OVER (PARTITION BY asm ORDER BY round(var_pop(expr), 6) DESC, path) AS rn FROM ap GROUP BY asm, path) WHERE rn = 1", "asm_long am ap")
def rep_path(s, d):
    return de.representative_path(_asm_rows(s, d))


_PAIRS = f"SELECT x.asm, x.grp AS group_1, y.grp AS group_2, sum({_term('x.share', 'y.share')}) AS jsd FROM gm x JOIN gm y ON x.asm = y.asm AND x.path = y.path AND x.grp < y.grp GROUP BY ALL"


@query(f"SELECT asm, group_1, group_2, round(jsd, 6) AS jsd FROM ({_PAIRS})", "asm_long am ap gm0 gm")
def jsd_pairwise(s, d):
    return _r(de.pairwise_jsd(_asm_rows(s, d)), "jsd")


@query(f"SELECT asm, round(max(jsd), 6) AS jsd FROM ({_PAIRS}) GROUP BY asm", "asm_long am ap gm0 gm")
def max_pair_jsd(s, d):
    return _r(de.largest_jsd(de.pairwise_jsd(_asm_rows(s, d))), "jsd")


_WITHIN = f"SELECT x.asm, x.grp, x.sample, g.grp AS other, sum({_term('x.prop', 'g.share')}) AS jsd FROM ap x JOIN gm g ON x.asm = g.asm AND x.path = g.path GROUP BY ALL"


@query(f"SELECT asm, round(min(far / own), 4) AS ratio FROM (SELECT asm, sample, max(sqrt(greatest(jsd, 0))) FILTER (grp = other) AS own, min(sqrt(greatest(jsd, 0))) FILTER (grp != other) AS far FROM ({_WITHIN}) GROUP BY ALL) WHERE own > 0 GROUP BY asm", "asm_long am ap gm0 gm")
def min_dist_ratio(s, d):
    return _r(de.distance_ratio(_asm_rows(s, d)), "ratio", places=4)


@query(f"SELECT asm, round(avg(CASE WHEN f >= 0.9 THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT asm, sample, avg(CASE WHEN d >= 0.1 THEN 1.0 ELSE 0.0 END) AS f FROM (SELECT x.asm, x.sample, y.sample AS s2, sqrt(greatest(sum({_term('x.prop', 'y.prop')}), 0)) AS d FROM ap x JOIN ap y ON x.asm = y.asm AND x.path = y.path AND x.grp != y.grp GROUP BY ALL) GROUP BY ALL) GROUP BY asm", "asm_long am ap")
def pct_large_dist(s, d):
    return _r(de.distant_share(_asm_rows(s, d), 0.1), "share")


@query(f"SELECT asm, round(greatest(sum(jsd) / (count(*) - count(DISTINCT grp)), 0.001), 6) AS s FROM ({_WITHIN}) WHERE grp = other GROUP BY asm", "asm_long am ap gm0 gm")
def asm_s(s, d):
    return _r(de.within(_asm_rows(s, d)), "s")


_R = f"SELECT asm, sum(n * dv) / (count(*) - 1) AS r FROM (SELECT g.asm, g.grp, sum({_term('g.share', 'h.share')}) AS dv FROM gm g JOIN gr h ON g.asm = h.asm AND g.path = h.path GROUP BY ALL) x JOIN (SELECT asm, grp, count(DISTINCT sample) AS n FROM ap GROUP BY ALL) y USING (asm, grp) GROUP BY asm"


@query(f"SELECT asm, round(r, 6) AS r FROM ({_R})", "asm_long am ap gm0 gm gr")
def asm_r(s, d):
    return _r(de.between(_asm_rows(s, d)), "r")


@query(f"SELECT asm, round(r / (s + 0.01), 5) AS d FROM ({_R}) a JOIN (SELECT asm, greatest(sum(jsd) / (count(*) - count(DISTINCT grp)), 0.001) AS s FROM ({_WITHIN}) WHERE grp = other GROUP BY asm) b USING (asm)", "asm_long am ap gm0 gm gr")
def asm_d(s, d):
    rows = _asm_rows(s, d)
    return _r(de.moderated(de.between(rows).join(de.within(rows), "asm"), 0.01).select("asm", "d"), "d", places=5)


@query("SELECT gene, round(r, 3) AS r, round(s, 3) AS s, round(r / (s + 1), 5) AS d FROM rs", "gx gp gs0 rs")
def gene_f_stat(s, d):
    x = de.moderated(de.gene_r_s(_gene_rows(s, d)), 1.0).select("gene", F.round("r", 3).alias("r"), F.round("s", 3).alias("s"), F.round("d", 5).alias("d"))
    return x


@query("SELECT gene, round(max(m) / min(m), 6) AS fold FROM (SELECT gene, grp, avg(expr) AS m FROM gx GROUP BY ALL) GROUP BY gene", "gx")
def fold_change_max(s, d):
    return _r(de.fold_change(_gene_rows(s, d)), "fold")


@query("WITH x AS (SELECT o_orderstatus AS k, o_totalprice AS v FROM orders), q AS (SELECT k, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.5) AS med FROM x GROUP BY k) SELECT k, round(any_value(p90), 4) AS p90, round(quantile_cont(abs(v - med), 0.5), 4) AS mad, round(stddev_samp(v) / avg(v), 6) AS cv FROM x JOIN q USING (k) GROUP BY k")
def percentiles_mad(s, d):
    x = views.lineitem(s, d, "orders").selectExpr("o_orderstatus as k", "o_totalprice as v")
    q = x.groupBy("k").agg(F.percentile("v", F.lit(0.9)).alias("p90"), F.percentile("v", F.lit(0.5)).alias("med"))
    return x.join(q, "k").groupBy("k").agg(F.round(F.first("p90"), 4).alias("p90"), F.round(F.percentile(F.abs(F.col("v") - F.col("med")), F.lit(0.5)), 4).alias("mad"), F.round(F.stddev_samp("v") / F.avg("v"), 6).alias("cv"))


def _permuted(s, d):
    return views.lineitem(s, d, "orders").selectExpr("o_orderkey % 7 as perm", "o_custkey % 300 as id", "o_totalprice").groupBy("perm", "id").agg((F.sum("o_totalprice") / 100000).alias("d"))


def _observed(s, d):
    return views.lineitem(s, d, "orders").selectExpr("o_custkey % 300 as id", "o_totalprice").groupBy("id").agg((F.sum("o_totalprice") / 600000).alias("d"))


@query("SELECT round(least(greatest(count(*) FILTER (d > (SELECT min(d) FROM pd) AND d < (SELECT quantile_cont(d, 0.5) FROM pd)) / (0.5 * count(*)), 0.5), 1.0), 6) AS pi0 FROM od", "pd od")
def pi0(s, d):
    return _r(de.pi0(_observed(s, d), _permuted(s, d)), "pi0")


@query()
def fdr_sweep(s, d):
    x = de.fdr_sweep(_observed(s, d), _permuted(s, d), 0.8)
    return x.select(F.round("delta", 4).alias("delta"), "significant", F.round("fdr", 6).alias("fdr"))


_STEP = "CAST(ceil(round(abs(d - expected) / 0.01, 9)) AS INTEGER)"
ORACLES["fdr_sweep"] = f"""WITH pd AS ({_CTE['pd']}), od AS ({_CTE['od']}), pr AS (SELECT *, row_number() OVER (PARTITION BY perm ORDER BY d) AS rk FROM pd), ep AS (SELECT rk, avg(d) AS expected FROM pr GROUP BY rk),
pk AS (SELECT perm, {_STEP} AS k FROM pr JOIN ep USING (rk)), ok AS (SELECT {_STEP} AS k FROM (SELECT d, row_number() OVER (ORDER BY d) AS rk FROM od) JOIN ep USING (rk)),
g AS (SELECT CAST(k AS INTEGER) AS k FROM (SELECT unnest(generate_series(0, 1000)) AS k)), sg AS (SELECT g.k, count(ok.k) AS significant FROM g LEFT JOIN ok ON ok.k > g.k GROUP BY g.k),
pn AS (SELECT g.k, p.perm, count(pk.k) AS n FROM g CROSS JOIN (SELECT DISTINCT perm FROM pk) p LEFT JOIN pk ON pk.perm = p.perm AND pk.k > g.k GROUP BY ALL), fl AS (SELECT k, quantile_cont(n, 0.5) AS f FROM pn GROUP BY k)
SELECT round(k * CAST(0.01 AS DOUBLE), 4) AS delta, significant, round(f * 0.8 / nullif(significant, 0), 6) AS fdr FROM sg JOIN fl USING (k)"""


@query("SELECT group_1, " + ", ".join(f"count(*) FILTER (group_2 = '{g}') AS \"{g}\"" for g in "ABC") + f" FROM ({_PAIRS}) WHERE jsd > 0.0001 GROUP BY group_1", "asm_long am ap gm0 gm")
def pairwise_count_matrix(s, d):
    return de.pair_counts(de.pairwise_jsd(_asm_rows(s, d)).where("jsd > 0.0001"), list("ABC"))


@query("SELECT asm, path, 'g' || CAST(sample // 6 AS VARCHAR) AS alias, round(sum(expr), 4) AS expr FROM ap GROUP BY ALL", "asm_long am ap")
def regroup(s, d):
    dim = s.createDataFrame([(i, f"g{i // 6}") for i in range(24)], "sample long, alias string")
    return _asm_rows(s, d).join(F.broadcast(dim), "sample").groupBy("asm", "path", "alias").agg(F.round(F.sum("expr"), 4).alias("expr"))


# -- ratios of single cells


def _stages(s, d):
    return views.asm_long(s, d).select("cell", "stage").distinct()


def _norm(s, d):
    return ra.normalized(views.asm_long(s, d), views.depth(s, d))


def _level(norm):
    return norm.groupBy("asm", "path").agg(F.avg("norm").alias("m")).agg(F.percentile("m", F.lit(0.5))).first()[0]


def _paths(s, d):
    norm = _norm(s, d)
    return norm, ra.expressed(norm, _level(norm))


def _cells(s, d):
    norm, paths = _paths(s, d)
    return ra.pair_cells(norm, ra.pairs(paths))


_RATIO = "asm_long depth tot frac sc norm lvl paths"


@query("SELECT cell, total, round(cf, 9) AS cell_fraction, round(ef, 9) AS ercc_fraction, round(cs, 9) AS cell_scale, round(es, 9) AS ercc_scale FROM sc", "depth tot frac sc")
def scale_factors(s, d):
    return _r(ra.scale_factors(views.depth(s, d)), "cell_fraction", "ercc_fraction", "cell_scale", "ercc_scale", places=9)


@query("SELECT asm, path, cell, round(norm, 2) AS norm FROM norm", "asm_long depth tot frac sc norm")
def coverage_normalize(s, d):
    return _norm(s, d).select("asm", "path", "cell", F.round("norm", 2).alias("norm"))


@query("SELECT asm, path, round(mean, 2) AS mean FROM paths", _RATIO)
def expressed_paths(s, d):
    return _r(_paths(s, d)[1], "mean", places=2)


@query("SELECT * FROM prs", _RATIO + " rk prs")
def path_pairs_top10(s, d):
    return ra.pairs(_paths(s, d)[1])


@query("SELECT asm, path_1, path_2, cell, round(ratio, 6) AS ratio FROM pc", _RATIO + " rk prs pc")
def path_ratio(s, d):
    return _cells(s, d).select("asm", "path_1", "path_2", "cell", F.round("ratio", 6).alias("ratio"))


@query("SELECT asm, path_1, path_2, round(avg(a), 2) AS mean_1, round(avg(b), 2) AS mean_2, round(var_samp(ratio), 8) AS observed FROM pc GROUP BY ALL", _RATIO + " rk prs pc")
def observed_variance(s, d):
    x = ra.observed(_cells(s, d))
    return x.select("asm", "path_1", "path_2", F.round("mean_1", 2).alias("mean_1"), F.round("mean_2", 2).alias("mean_2"), F.round("observed", 8).alias("observed"))


@query("SELECT asm, path_1, path_2, round(h, 6) AS h, round(exp(-h / 2), 6) AS p FROM kw", _RATIO + " rk prs pc kr kg kw")
def kruskal_wallis(s, d):
    cells = _cells(s, d).withColumn("ratio", F.round("ratio", 12))  # the same ties in both engines
    return _r(ra.kruskal_wallis(cells, _stages(s, d)), "h", "p")


@query("SELECT asm, path_1, path_2, cell, round(CASE WHEN b > 0 THEN a / (a + b) ELSE 0.5 END, 6) AS ratio FROM pc JOIN kw USING (asm, path_1, path_2) WHERE exp(-h / 2) <= 0.3", _RATIO + " rk prs pc kr kg kw")
def significant_ratio(s, d):
    cells = _cells(s, d).withColumn("ratio", F.round("ratio", 12))
    return _r(ra.significant_paths(cells, ra.kruskal_wallis(cells, _stages(s, d)), 0.3), "ratio")


@query("SELECT n.asm, n.path, n.cell, round(n.norm, 0) AS coverage FROM norm n JOIN (SELECT asm FROM paths GROUP BY asm HAVING count(*) > 1) USING (asm) JOIN paths p ON p.asm = n.asm AND p.path = n.path", _RATIO)
def path_coverage(s, d):
    norm, paths = _paths(s, d)
    return _r(ra.path_coverage(norm, paths), "coverage", places=0)


def _spike(s, d):
    return views.lineitem(s, d).selectExpr("l_partkey % 60 as transcript", "l_orderkey % 40 as cell", "case when l_partkey * 7 % 11 < 2 then 0 else l_quantity * (1 + l_partkey % 60) end as v").groupBy("transcript", "cell").agg(F.min("v").alias("value"))


_SPIKE = "SELECT transcript, cell, min(v) AS value FROM (SELECT l_partkey % 60 AS transcript, l_orderkey % 40 AS cell, CASE WHEN l_partkey * 7 % 11 < 2 THEN 0 ELSE l_quantity * (1 + l_partkey % 60) END AS v FROM lineitem) GROUP BY ALL"


@query(f"SELECT transcript, round(avg(value), 6) AS mean, count(*) FILTER (value = 0) AS zeros, count(*) AS n, round(count(*) FILTER (value = 0) / count(*), 6) AS rate FROM ({_SPIKE}) GROUP BY transcript")
def dropout_rate(s, d):
    return ra.moments(_spike(s, d)).select("transcript", F.round("mean", 6).alias("mean"), "zeros", "n", F.round(F.col("zeros") / F.col("n"), 6).alias("rate"))


@query(f"SELECT transcript, round(avg(value), 6) AS mean, round(var_samp(value) / (avg(value) * avg(value)), 6) AS cv2 FROM ({_SPIKE}) GROUP BY transcript HAVING avg(value) > 0")
def cv2_mean(s, d):
    return _r(ra.moments(_spike(s, d)).where("mean > 0").select("transcript", "mean", "cv2"), "mean", "cv2")


_NOISE = {"a0": 0.05, "a1": 200.0, "b0": 1.0, "b1": -0.5}


@query("""SELECT asm, path, round(1 / (1 + exp(-(1.0 - 0.5 * ln(mean + 1)))), 8) AS dropout, round(0.05 + 200.0 / mean, 8) AS cv2 FROM paths""", _RATIO)
def noise_curves(s, d):
    m = F.col("mean")
    return _r(_paths(s, d)[1].select("asm", "path", S.dropout_probability(m, 1.0, -0.5).alias("dropout"), S.cv2_curve(m, 0.05, 200.0).alias("cv2")), "dropout", "cv2", places=8)


@query()
def glm_noise_fit(s, d):
    return s.createDataFrame([ra.fit_noise(_spike(s, d), 0.0)], "a0 double, a1 double, b0 double, b1 double")


@query()
def null_variance_test(s, d):
    return ra.null_variance(ra.observed(_cells(s, d)), _NOISE, 80)


@query()
def ratio_tests(s, d):
    return ra.ratio_tests(views.asm_long(s, d), views.depth(s, d), _stages(s, d), _NOISE, _level(_norm(s, d)), 10)


# -- kernels


@query()
def em_abundance(s, d):
    import numpy as np

    def run(key, pdf):
        import pandas as pd

        wide = pdf.pivot_table(index="path", columns="sample", values="expr", fill_value=0.0)
        paths = np.tril(np.ones((len(wide), len(wide))))
        out = []
        for c in wide.columns:
            a, q = kernels.em_abundance(paths, paths.T @ wide[c].to_numpy(), np.full(len(wide), 100.0))
            out += [(key[0], int(p), int(c), float(x), float(y)) for p, x, y in zip(wide.index, a, q, strict=True)]
        return pd.DataFrame(out, columns=["asm", "path", "sample", "abundance", "proportion"])

    return _by_sample(views.asm_long(s, d)).groupBy("asm").applyInPandas(run, "asm long, path long, sample long, abundance double, proportion double")


@query()
def tree(s, d):
    x = _features(s, d).withColumn("kind", F.when(F.col("id") % 100000 >= 50000, "junction").otherwise("exon")).withColumn("chrom_id", F.substring("chrom", 4, 1).cast("long"))
    isl = iv.islands(x.withColumn("start", F.col("low")), "chrom", "low", "high")

    def run(key, pdf):
        import pandas as pd

        t = kernels.build_tree([(int(r.id), int(r.low), int(r.high), r.kind) for r in pdf.itertuples()])
        return pd.DataFrame([(key[0], int(key[1]), v, p if p is not None else -1, k, lo, hi) for v, p, k, lo, hi in t], columns=["chrom", "gene", "vertex", "parent", "kind", "low", "high"])

    return isl.groupBy("chrom", "island").applyInPandas(run, "chrom string, gene long, vertex long, parent long, kind string, low long, high long")


def _depth_by_gene(s, d):
    return views.lineitem(s, d, "orders").selectExpr("o_custkey % 20 as gene", "o_orderkey as at", "o_totalprice + case when o_orderkey % 4000 > 2000 then 200000 else 0 end as v")


@query()
def changepoint(s, d):
    def run(key, pdf):
        import pandas as pd

        v = pdf.sort_values("at").v.to_numpy()
        cuts = kernels.change_points(kernels.wavelet_smooth(v), 5, 10)
        return pd.DataFrame([(key[0], i, c) for i, c in enumerate(cuts)], columns=["gene", "segment", "start"])

    return _depth_by_gene(s, d).groupBy("gene").applyInPandas(run, "gene long, segment long, start long")


# -- lines and alignments


@query("""SELECT concat_ws(chr(9), chrom, CAST(start - 20 AS VARCHAR), CAST("end" + 19 AS VARCHAR), 'JUNC' || start || '_' || "end", CAST(n AS VARCHAR), '+', CAST(start - 20 AS VARCHAR), CAST("end" + 19 AS VARCHAR), '255,0,0', '2', '20,20', '0,' || ("end" - start + 19)) AS value FROM jn""", "reads j jn")
def bed12(s, d):
    return io.bed12_lines(_junctions(s, d).withColumn("strand", F.lit("+")))


@query("""SELECT concat_ws(chr(9), 'chr' || chrom, 'isoweave', 'exon', CAST(low AS VARCHAR), CAST(high AS VARCHAR), '.', '+', '.', 'gene_id "' || gene || '"; transcript_id "' || gene || '";') AS value FROM genes""", "genes")
def gtf_lines(s, d):
    g = views.genes(s, d).select(F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("chrom"), F.lit("exon").alias("feature"), "low", "high", F.lit("+").alias("strand"), "gene", F.col("gene").alias("transcript"))
    return io.gtf_lines(g)


_B = lambda b: f"flag & {b} != 0"


@query(f"""SELECT {_B(512)} AS qc_fail, count(*) AS total, count(*) FILTER ({_B(1024)}) AS duplicates, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER ({_B(1)}) AS paired, count(*) FILTER (flag & 65 = 65) AS read1, count(*) FILTER (flag & 129 = 129) AS read2,
count(*) FILTER (flag & 7 = 3) AS proper, count(*) FILTER (flag & 13 = 1) AS both_mapped, count(*) FILTER (flag & 13 = 9) AS singletons, count(*) FILTER (flag & 13 = 1 AND rnext NOT IN ('=', chrom)) AS mate_elsewhere, count(*) FILTER (flag & 13 = 1 AND rnext NOT IN ('=', chrom) AND mapq >= 5) AS mate_elsewhere_mapq5 FROM reads GROUP BY ALL""", "reads")
def flagstat(s, d):
    return al.flagstat(views.reads(s, d))


@query("SELECT read_id, flag, mapq FROM reads WHERE mapq >= 3 AND flag & 64 = 64 AND flag & 1028 = 0", "reads")
def view_filter(s, d):
    return al.view(views.reads(s, d), 3, 64, 1028).select("read_id", "flag", "mapq")


@query("SELECT chrom, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 != 0) AS unmapped FROM reads GROUP BY ALL", "reads")
def idxstats(s, d):
    return al.idxstats(views.reads(s, d))


@query("""SELECT sample_id, chrom, start, "end", depth FROM (SELECT sample_id, chrom, p AS start, lead(p) OVER w - 1 AS "end", CAST(sum(c) OVER w AS BIGINT) AS depth FROM (SELECT sample_id, chrom, p, sum(c) AS c FROM (SELECT sample_id, chrom, start AS p, 1 AS c FROM e UNION ALL SELECT sample_id, chrom, "end" + 1, -1 FROM e) GROUP BY ALL HAVING sum(c) != 0) WINDOW w AS (PARTITION BY sample_id, chrom ORDER BY p)) WHERE depth > 0""", "reads e")
def depth(s, d):
    return al.depth(views.reads(s, d), ["sample_id", "chrom"])


@query("SELECT read_id FROM reads WHERE chrom = 'chr1' AND pos <= 12100 AND pos + 2 * a + gap - 1 >= 10000", "reads")
def fetch_region(s, d):
    return al.fetch(views.reads(s, d), "chr1", 10000, 12100).select("read_id")


@query("SELECT read_id FROM (SELECT read_id, row_number() OVER (PARTITION BY sample_id, chrom, flag & 16, CASE WHEN flag & 16 != 0 THEN pos + 2 * a + gap ELSE pos END ORDER BY qual DESC, qname) AS rn FROM reads WHERE flag & 4 = 0) WHERE rn = 1", "reads")
def rmdup_se(s, d):
    return al.duplicates_single(views.reads(s, d).withColumnRenamed("sample_id", "library")).select("read_id")


@query("SELECT read_id FROM reads WHERE qname NOT IN (SELECT qname FROM (SELECT qname, row_number() OVER (PARTITION BY sample_id, chrom, pos, isize ORDER BY qual DESC, qname) AS rn FROM reads WHERE isize > 0) WHERE rn > 1)", "reads")
def rmdup_pe(s, d):
    return al.duplicates_paired(views.reads(s, d).withColumnRenamed("sample_id", "library")).select("read_id")


@query("SELECT qname, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS rank FROM (SELECT concat('r', cast(l_orderkey as varchar), '.', cast(l_linenumber as varchar)) AS qname, l_orderkey, l_linenumber FROM lineitem)", "")
def sort_natural(s, d):
    return al.ranked_by_name(views.reads(s, d).select("qname", "flag")).select("qname", "rank")


@query(""", f AS (SELECT *, CASE WHEN flag & 16 != 0 THEN pos + 2 * a + gap ELSE pos END AS five, count(*) OVER (PARTITION BY pair) AS n FROM reads)
SELECT read_id, mate_chrom, mate_pos, mate_reverse, CASE WHEN mate_chrom = chrom THEN mate_five - five ELSE 0 END AS "insert" FROM (SELECT x.*, y.chrom AS mate_chrom, y.pos AS mate_pos, y.flag & 16 != 0 AS mate_reverse, y.five AS mate_five FROM f x LEFT JOIN f y ON x.pair = y.pair AND x.read_id != y.read_id AND x.n = 2)""", "reads")
def fixmate(s, d):
    return al.fixed_mates(views.reads(s, d)).select("read_id", "mate_chrom", "mate_pos", "mate_reverse", "insert")


@query("""SELECT chrom, pos AS start, pos + 2 * a + gap AS "end", qname AS name, mapq AS score, CASE WHEN flag & 16 != 0 THEN '-' ELSE '+' END AS strand FROM reads WHERE flag & 4 = 0""", "reads")
def bam2bed(s, d):
    return al.bed(views.reads(s, d))


def _seqs(s, d):
    return views.reads(s, d).selectExpr("qname", "flag", "translate(concat(cast(read_id * 7919 as string), cast(pos as string)), '0123456789', 'ACGTACGTAC') as seq", "concat(cast(read_id * 7919 as string), cast(pos as string)) as qual")


_SEQS = "SELECT qname, flag, translate(concat(cast(read_id * 7919 as varchar), cast(pos as varchar)), '0123456789', 'ACGTACGTAC') AS seq, concat(cast(read_id * 7919 as varchar), cast(pos as varchar)) AS qual FROM reads"


@query(f"""SELECT qname || CASE WHEN flag & 64 != 0 THEN '/1' ELSE '/2' END AS name, CASE WHEN flag & 16 != 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq, CASE WHEN flag & 16 != 0 THEN reverse(qual) ELSE qual END AS qual FROM ({_SEQS})""", "reads")
def bam2fq(s, d):
    return al.fastq(_seqs(s, d))


@query(f"""SELECT qname AS name, length(seq) AS length, {', '.join(f"length(seq) - length(replace(seq, '{b}', '')) AS {b.lower()}" for b in 'ACGT')}, (length(seq) - length(replace(seq, 'CG', ''))) // 2 AS cpg, length(translate(seq, 'ACGT', '')) AS other FROM ({_SEQS})""", "reads")
def seq_composition(s, d):
    return al.composition(_seqs(s, d).withColumnRenamed("qname", "name"))


@query(f"SELECT qname AS name, CAST(3 AS BIGINT) AS low, CAST(7 AS BIGINT) AS high, substring(seq, 3, 5) AS seq FROM ({_SEQS})", "reads")
def faidx_fetch(s, d):
    x = _seqs(s, d).withColumnRenamed("qname", "name")
    return al.subsequence(x, x.select("name").distinct().select("name", F.lit(3).cast("long").alias("low"), F.lit(7).cast("long").alias("high")))
