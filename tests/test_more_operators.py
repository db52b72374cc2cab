"""Module files, sequences, differences from a reference, permutations and the fudge factor, on small hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoweave.functions import kernels
from isoweave.operators import alignments, assembly, differential, sequences


def names(spark, rows):
    return spark.createDataFrame(rows, "name string, seq string")


def test_differences_of_published_kind():
    assert kernels.differences("ACGTACGT", "8M", "ACGTACGT") == (0, "8")
    assert kernels.differences("ACGTTCGT", "8M", "ACGTACGT") == (1, "4A3")
    assert kernels.differences("ACGTCGT", "4M1D3M", "ACGTACGT") == (1, "4^A3")
    assert kernels.differences("TTACGGTACGT", "2S3M1I5M", "ACGTACGT") == (1, "8")
    assert kernels.differences("AC", "1M3N1M", "AGGGC") == (0, "2")
    assert kernels.differences("=T", "2M", "AC") == (1, "1C0")


def test_reads_with_their_differences(spark):
    reads = spark.createDataFrame([(1, 0, "c", 2, "4M", "GTAC"), (2, 4, "c", 0, "*", "GT"), (3, 0, "x", 0, "2M", "GT"), (4, 0, "c", 0, "2M2D2M", "ACAA")], "read_id long, flag int, chrom string, pos long, cigar string, seq string")
    got = {r.read_id: (r.nm, r.md) for r in alignments.with_differences(reads, names(spark, [("c", "ACGTACGT")])).collect()}
    assert got == {1: (0, "4"), 2: (None, None), 3: (None, None), 4: (3, "2^GT1C0")}


def test_pileup_with_insertions_and_gaps(spark):
    reads = spark.createDataFrame([(0, "c", 10, 40, "2M1I1M1D1M", "ACGTT", "IIIII"), (16, "c", 10, 5, "2S2M", "GGAN", "II!I"), (1024, "c", 10, 40, "2M", "AC", "II")], "flag int, chrom string, pos long, mapq int, cigar string, seq string, qual string")
    got = {r.pos: (r.depth, r.a, r.c, r.g, r.t, r.n, r.forward, r.quality) for r in alignments.pileup(reads).collect()}
    assert got == {10: (1, 1, 0, 0, 0, 0, 1, 40), 11: (2, 0, 1, 0, 0, 1, 1, 45), 12: (1, 0, 0, 0, 1, 0, 1, 40), 14: (1, 0, 0, 0, 1, 0, 1, 40)}


def test_sequence_operators(spark):
    x = names(spark, [("a", "ACGTNNNNACRT"), ("b", ""), ("n", "NNNN")])
    got = lambda df: {r.name: r.seq for r in df.collect()}
    regions = spark.createDataFrame([("a", 1, 3), ("a", 2, 5)], "name string, low long, high long")
    assert got(sequences.region_masked(x, regions)) == {"a": "AcgtnNNNACRT", "b": "", "n": "NNNN"}
    assert got(sequences.region_masked(x, regions, True, True))["a"] == "NCGTNNNNNNNN"
    assert [(r.low, r.high, r.seq) for r in sequences.cut_at_n(x, 3).collect()] == [(1, 4, "ACGT"), (9, 12, "ACRT")]
    assert [(r.low, r.high) for r in sequences.cut_at_n(x, 5).where("name = 'a'").collect()] == [(1, 12)]
    assert got(sequences.merged_iupac(names(spark, [("a", "ACGTA")]), names(spark, [("a", "GCTR")])))["a"] == "RCKN"
    assert got(sequences.letter_masked(names(spark, [("a", "ACGT")]), names(spark, [("a", "XnX")])))["a"] == "AnGT"
    assert [(r.pos, r.code) for r in sequences.heterozygous(x).collect()] == [(11, "R")]
    assert got(sequences.resolved(x))["a"] in ("ACGTNNNNACAT", "ACGTNNNNACGT") and got(sequences.resolved(x)) == got(sequences.resolved(x.repartition(3)))
    assert got(sequences.mutated(x, spark.createDataFrame([("a", 2, "T"), ("a", 12, "G")], "name string, pos long, base string"))) == {"a": "ATGTNNNNACRG", "b": "", "n": "NNNN"}
    assert sorted(tuple(r) for r in sequences.heterozygosity(x.where("name = 'a'"), 4, 2).collect()) == [("a", 0, 0, 4), ("a", 2, 0, 2), ("a", 6, 0, 2), ("a", 8, 1, 4), ("a", 10, 1, 2)]


def test_nested_file_round_trip(spark, tmp_path):
    modules = spark.createDataFrame([("m1", "c", 1, 9, "2", s, float(s), 0.5) for s in range(3)], "asm string, chrom string, low long, high long, category string, sample long, expr double, mse double")
    paths = spark.createDataFrame([("m1", p, 1, 9, s, p + s / 4, 0.25) for p in (0, 2) for s in range(3)], "asm string, path long, low long, high long, sample long, expr double, prop double")
    lines = assembly.asm_lines(modules, paths)
    lines.orderBy("asm", "place").select("value").coalesce(1).write.text(str(tmp_path / "f"))
    back = assembly.read_asm_lines(spark, str(tmp_path / "f"))
    rows = lambda df, cols: sorted(tuple(r) for r in df.select(*cols).collect())
    assert rows(back[0], modules.columns) == rows(modules, modules.columns) and rows(back[1], paths.columns) == rows(paths, paths.columns)
    flat = paths.selectExpr("asm as chrom", "path as low", "high", "sample", "expr", "prop")
    assembly.expression_lines(flat).write.text(str(tmp_path / "e"))
    assert rows(assembly.read_expression_lines(spark, str(tmp_path / "e")), flat.columns) == rows(flat, flat.columns)


def test_gtf_of_paths(spark):
    x = spark.createDataFrame([(1, 0, "c", "+", [(5, 9), (1, 2)])], "asm int, path int, chrom string, strand string, exons array<struct<low: long, high: long>>")
    assert [r.value.split("\t")[2:5] for r in assembly.decomposed_gtf(x).collect()] == [["transcript", "1", "9"], ["exon", "5", "9"], ["exon", "1", "2"]]


def test_labels_keep_group_sizes(spark):
    design = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(9)], "sample long, `group` string")
    got = differential.shuffled_labels(design, 50, 3).collect()
    per = {}
    for r in got:
        per.setdefault(r.perm, {})[r.sample] = r.group
    assert len(per) == 50 and all(sorted(v.values()) == ["a"] * 6 + ["b"] * 3 for v in per.values())
    assert len({tuple(sorted(v.items())) for v in per.values()}) > 25
    assert sorted(map(tuple, differential.shuffled_labels(design.repartition(3), 50, 3).collect())) == sorted(map(tuple, got))


def test_permuted_modules_with_true_labels_are_the_observed_ones(spark):
    rng = np.random.default_rng(1)
    rows = [(a, p, s, "xy"[s // 3], float(v), float(v)) for a in range(4) for s in range(6) for p, v in enumerate(rng.dirichlet([2, 3, 4]))]
    df = spark.createDataFrame(rows, "asm int, path int, sample int, `group` string, expr double, prop double")
    labels = df.select(F.lit(0).alias("perm"), "sample", "group").distinct()
    s = differential.within(df)
    want = {r.asm: r.d for r in differential.moderated(differential.between(df).join(s, "asm"), 0.01).collect()}
    got = {r.asm: r.d for r in differential.permuted_asms(df, labels, s, 0.01).collect()}
    assert got.keys() == want.keys() and all(got[a] == pytest.approx(want[a]) for a in want)


def test_fudge_factor_by_loops(spark):
    rng = np.random.default_rng(2)
    s, r = rng.gamma(2, 1, 700), rng.gamma(1, 2, 700)
    cuts, edges = np.quantile(s, np.arange(21) / 20), np.quantile(s, np.arange(101) / 100)
    inside = s < edges[-1]
    bins = np.searchsorted(edges, s[inside], side="right")
    best = None
    for alpha, s0 in zip(np.arange(21) / 20, cuts, strict=True):
        d = r[inside] / (s[inside] + s0)
        v = np.array([np.median(np.abs(d[bins == b] - np.median(d[bins == b]))) / 0.64 for b in np.unique(bins)])
        cv = v.std() * np.sqrt(len(v) / 100) / v.mean()
        best = min(best or (np.inf, 0, 0), (cv, alpha, s0))
    got = differential.fudge_factor(spark.createDataFrame(list(zip(r.tolist(), s.tolist(), strict=True)), "r double, s double"))
    assert got == pytest.approx(best[2])


@pytest.mark.parametrize("width", [7, 50, 1 << 20])
def test_carried_windows_by_loops(spark, width):
    """Islands, coverage, exon numbers and intron filter over bins of any width, null chromosomes among them."""
    from isoweave.operators import intervals

    rng = np.random.default_rng(width)
    chroms = ["a", "b", None]
    rows = sorted({(chroms[int(c)], int(x), int(x + n)) for c, x, n in zip(rng.integers(0, 3, 90), rng.integers(0, 400, 90), rng.integers(0, 25, 90), strict=True)}, key=lambda r: (str(r[0]), r[1], r[2]))
    df = spark.createDataFrame([(c, lo, hi, 1, "exon" if (lo + hi) % 3 else "intron", float((lo * 7 + hi) % 11)) for c, lo, hi in rows], "chrom string, low long, high long, n long, kind string, coverage double")
    want_island, want_vis, want_intron, want_runs = {}, {}, set(), set()
    for c in chroms:
        own = [(lo, hi) for k, lo, hi in rows if k == c]
        top, island, vis, last = None, 0, 0, None
        for lo, hi in own:
            island += top is None or lo > top + 1
            vis += 1 if last is None or lo <= last + 1 else 2
            top, last = hi if top is None else max(top, hi), hi
            want_island[c, lo, hi], want_vis[c, lo, hi] = island, vis
        cover = np.zeros(500, int)
        for lo, hi in own:
            cover[lo : hi + 1] += 1
        at = [0, *(np.flatnonzero(np.diff(cover)) + 1).tolist(), 500]
        want_runs |= {(c, a, b - 1, int(cover[a])) for a, b in zip(at[:-1], at[1:], strict=True) if cover[a]}
        level = lambda lo, hi: float((lo * 7 + hi) % 11)
        for i, (lo, hi) in enumerate(own):
            exon = lambda part: next((level(*x) for x in part if sum(x) % 3), None)
            near = [x for x in (exon(own[:i][::-1]), exon(own[i + 1 :])) if x is not None]
            if (lo + hi) % 3 or near and level(lo, hi) >= max(near) / 2:
                want_intron.add((c, lo, hi))
    assert {(r.chrom, r.low, r.high): r.island for r in intervals.islands(df, "chrom", "low", "high", width=width).collect()} == want_island
    assert {(r.chrom, r.low, r.high): r.vis_id for r in intervals.visual_ids(df, width=width).collect()} == want_vis
    assert {(r.chrom, r.low, r.high) for r in intervals.relative_introns(df, width=width).collect()} == want_intron
    assert {tuple(r) for r in intervals.coverage_runs(df, ["chrom"], "low", "high", width=width).collect()} == want_runs


def test_equal_reads_in_ranges_all_stay(spark):
    """Before, reads that agree in all columns came out as one."""
    rng = np.random.default_rng(3)
    reads = [(c, int(p), f"{n}M") for c, p, n in zip(rng.choice(["a", "b"], 60), rng.integers(0, 6000, 60), rng.integers(1, 3000, 60), strict=True)] * 2
    bed = [(c, int(x), int(x + n)) for c, x, n in zip(rng.choice(["a", "c"], 12), rng.integers(0, 6000, 12), rng.integers(-1, 2500, 12), strict=True)]
    bed += bed[:2]
    got = alignments.in_ranges(spark.createDataFrame(reads, "chrom string, pos long, cigar string"), spark.createDataFrame(bed, "chrom string, low long, high long"))
    want = [r for r in reads if any(c == r[0] and x < y and r[1] < y and r[1] + int(r[2][:-1]) > x for c, x, y in bed)]
    assert want and len(want) < len(reads) and sorted(map(tuple, got.collect())) == sorted(want)


def test_relative_introns_of_one_dense_bin(spark):
    """Before, each row read all rows that follow in its bin: quadratic in their number."""
    from isoweave.operators import intervals

    n = 600_000
    rows = spark.range(n).selectExpr("'a' as chrom", "id as low", "id as high", "if(id % 1000 = 0, 'exon', 'intron') as kind", "cast(if(id % 1000 = 0, id % 7, 2) as double) as coverage")
    level = np.arange(0, n, 1000) % 7
    kept = np.append(np.maximum(level[:-1], level[1:]) <= 4, level[-1] <= 4)
    assert "FOLLOWING" not in (plan := intervals.relative_introns(rows)._jdf.queryExecution().optimizedPlan().toString().upper()) and "UNBOUNDEDPRECEDING" in plan
    assert intervals.relative_introns(rows).count() == len(level) + 999 * int(kept.sum())


def test_noise_without_expression_is_null(spark):
    """Before, spike-ins without expression, as in larger copies of the tables, were an error."""
    from isoweave.operators import ratio

    rows = lambda *levels: spark.createDataFrame([(t, c, v * ((c + t) % 6 > t % 2) * (1 + c % (2 + t))) for t, v in enumerate(levels) for c in range(6)], "transcript long, cell long, value double")
    nothing = dict.fromkeys(("a0", "a1", "b0", "b1"))
    assert ratio.fit_noise(rows(0.0, 0.0, 0.0), 0.0) == nothing
    assert ratio.fit_noise(rows(0.0, 5.0), 0.0) == nothing
    fitted = ratio.fit_noise(rows(5.0, 8.0, 20.0), 15.0)  # one transcript above the cutoff
    assert fitted["a0"] is fitted["a1"] is None and fitted["b0"] is not None and fitted["b1"] is not None
