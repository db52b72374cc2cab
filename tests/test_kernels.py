import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoweave.functions import cigar, kernels
from isoweave.functions import stats as S
from isoweave.operators import alignments, fragments, intervals, ratio
from isoweave.sources import readers


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_cigar_walk(spark):
    text = F.lit("10M50N5M2D3M1I4S")
    assert [tuple(r) for r in one(spark, cigar.exons(F.lit(100), text))] == [(100, 109), (160, 164), (167, 169)]
    assert [tuple(r) for r in one(spark, cigar.junctions(F.lit(100), text))] == [(109, 160)]
    assert one(spark, cigar.reference_length(text)) == 70
    assert one(spark, cigar.exons(F.lit(1), F.lit("*"))) == []
    assert [tuple(r) for r in one(spark, cigar.exons(F.lit(0), F.lit("2=1X")))] == [(0, 1), (2, 2)]


def test_kruskal_wallis_published_values(spark):
    groups = {"G1": [2.9, 3.0, 2.5, 2.6, 3.2], "S": [3.8, 2.7, 4.0, 2.4], "G2M": [2.8, 3.4, 3.7, 2.2, 2.0]}
    rows = [(i, g, v) for i, (g, v) in enumerate((g, v) for g, vs in groups.items() for v in vs)]
    cells = spark.createDataFrame([(1, 0, 1, i, v) for i, _, v in rows], "asm int, path_1 int, path_2 int, cell int, ratio double")
    r = ratio.kruskal_wallis(cells, spark.createDataFrame([(i, g) for i, g, _ in rows], "cell int, stage string")).first()
    assert abs(r.h - 0.771429) < 1e-6 and abs(r.p - 0.679965) < 1e-6
    two = spark.createDataFrame([(i, g) for i, g, _ in rows if g != "S"], "cell int, stage string")
    assert ratio.kruskal_wallis(cells, two).first().p is None


def test_divergence_bounds(spark):
    d = lambda p, q: one(spark, sum((S.jsd_term(F.lit(a), F.lit(b)) for a, b in zip(p, q)), F.lit(0.0)))
    assert d((1.0, 0.0), (0.0, 1.0)) == 1.0
    assert d((0.5, 0.5), (0.5, 0.5)) == 0.0
    assert d((0.2, 0.8), (0.7, 0.3)) == pytest.approx(d((0.7, 0.3), (0.2, 0.8)))


def test_ratios(spark):
    assert one(spark, S.path_ratio(F.lit(0.0), F.lit(0.0))) == 0.5
    assert one(spark, S.reported_ratio(F.lit(3.0), F.lit(0.0))) == 0.5
    assert one(spark, S.path_ratio(F.lit(3.0), F.lit(1.0))) == 0.75


def test_overlap_join_against_loops(spark):
    rng = np.random.default_rng(1)
    a = [(int(k), int(x), int(x + n)) for k, x, n in zip(rng.integers(0, 2, 80), rng.integers(0, 5000, 80), rng.integers(0, 900, 80))]
    b = [(int(k), int(x), int(x + n)) for k, x, n in zip(rng.integers(0, 2, 80), rng.integers(0, 5000, 80), rng.integers(0, 900, 80))]
    got = intervals.overlap_join(spark.createDataFrame(a, "k int, al long, ah long"), spark.createDataFrame(b, "k int, bl long, bh long"), "k", ("al", "ah"), ("bl", "bh"), 128)
    want = sorted((k, al, ah, bl, bh) for k, al, ah in a for k2, bl, bh in b if k == k2 and al <= bh and bl <= ah)
    assert sorted(map(tuple, got.collect())) == want


def test_coverage_is_conserved(spark):
    f = spark.createDataFrame([("c", 1, 10, 2), ("c", 5, 7, 1), ("c", 20, 20, 3)], "chrom string, start long, end long, n long")
    runs = intervals.coverage_runs(f, ["chrom"]).collect()
    assert sum((r.end - r.start + 1) * r.depth for r in runs) == 2 * 10 + 3 + 3
    assert {(r.start, r.end, r.depth) for r in runs} == {(1, 4, 2), (5, 7, 3), (8, 10, 2), (20, 20, 3)}


def test_tie_of_strands_is_plus(spark):
    s = spark.createDataFrame([("c", 1, 9, 0, "-", 2), ("c", 1, 9, 1, "+", 2)], "chrom string, start long, end long, sample_id long, xs string, n long")
    assert tuple(fragments.rectified(s).first()) == ("c", 1, 9, 4, "+")


def test_em_of_two_paths():
    c, q = kernels.em_abundance(np.array([[1.0, 1, 0], [1, 0, 1]]), np.array([30.0, 20, 10]), np.array([100.0, 100]))
    assert q.sum() == pytest.approx(1) and q[0] == pytest.approx(2 / 3, abs=0.02)
    c, q = kernels.em_abundance(np.eye(2), np.zeros(2), np.ones(2))
    assert c.sum() == 0 and q.sum() == 0
    many = kernels.em_abundance(np.ones((40, 1)), np.array([40.0]), np.ones(40))[1]
    assert np.allclose(many, 1 / 40)


def test_paths_and_limits():
    assert kernels.enumerate_paths([(1, 2), (1, 3), (2, 4), (3, 4)], [1], {4}) == [[1, 2, 4], [1, 3, 4]]
    wide = [(0, i) for i in range(1, 61)] + [(i, 99) for i in range(1, 40)]
    assert kernels.enumerate_paths(wide, [0], {99} | set(range(1, 61))) is None


def test_categories():
    assert kernels.category([(1, 5), (10, 15), (20, 25)], [(1, 5), (20, 25)]) == "exon_skipping"
    assert kernels.category([(1, 5), (20, 25)], [(1, 5), (18, 25)]) == "alter_splice_site"
    assert kernels.category([(1, 5), (7, 9)], [(1, 5), (12, 15)]) == "mutual_exclusive"
    assert kernels.category([(1, 30)], [(1, 5), (20, 30)]) == "intron_retention"


def test_change_points_of_long_values(monkeypatch):
    """As all starts of each segment give them; before, no start was left out: time by the square of the values' number."""

    def plain(x, most, least):
        n = len(x)
        s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
        now, cuts = {0: (0.0, ())}, {}
        for k in range(most):
            ends = {}
            for b in range(least * (k + 1), n + 1):
                a = np.array([i for i in now if i <= b - least])
                if len(a):
                    c = np.array([now[i][0] for i in a]) + q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)
                    i = int(np.argmin(c))
                    ends[b] = (c[i], (*now[int(a[i])][1], int(a[i])))
            now = ends
            cuts[k + 1] = now[n]
        penalty = max(np.var(np.diff(x)) / 2, 1e-9) * 3 * np.log(n)
        return list(cuts[min(cuts, key=lambda k: cuts[k][0] + penalty * (k - 1))][1])

    rng = np.random.default_rng(5)
    wave = lambda n, period: rng.uniform(1e3, 5e5, n) + 2e5 * (np.arange(n) % period > period / 2)
    for x, least in ((wave(900, 90), 10), (rng.integers(0, 3, 800).astype(float), 7), (kernels.wavelet_smooth(wave(700, 300)), 25)):
        assert kernels.change_points(x, 4, least) == plain(x, 4, least)
    kept, prune = [], kernels._undominated
    monkeypatch.setattr(kernels, "_undominated", lambda *args: kept.append(prune(*args)) or kept[-1])
    assert kernels.change_points(kernels.wavelet_smooth(wave(8000, 200)), 5, 10)[0] == 0
    assert kernels.change_points(np.zeros(8000), 5, 10) == [0]
    assert max(map(len, kept)) < 1500


def test_change_points_and_cuts():
    x = np.concatenate([np.full(150, 1.0), np.full(150, 30.0)]) + np.random.default_rng(0).normal(0, 0.1, 300)
    assert kernels.change_points(x, 5, 100) == [0, 150]
    assert kernels.best_cut(x) == 150
    assert np.allclose(kernels.wavelet_smooth(np.full(64, 3.0)), 3.0)
    assert kernels.viterbi_target(np.array([0] * 50 + [9] * 50 + [0] * 50)).sum() == 50


def test_genetics():
    lik = np.array([[1, 0, 0]] * 5 + [[0, 1, 0]] * 10 + [[0, 0, 1]] * 5, float)
    assert kernels.genotype_frequency(lik) == pytest.approx(0.5)
    assert kernels.haplotype_r2(np.array([[10, 0, 0], [0, 20, 0], [0, 0, 10]], float)) == pytest.approx(1, abs=1e-3)


def test_null_variance_is_repeatable(spark):
    rows = [(i, 0, 1, 50.0 + i, 60.0, 0.01) for i in range(20)]
    df = spark.createDataFrame(rows, "asm int, path_1 int, path_2 int, mean_1 double, mean_2 double, observed double")
    noise = {"a0": 0.05, "a1": 2.0, "b0": -3.0, "b1": -0.5}
    a = sorted(ratio.null_variance(df.repartition(1), noise, 30, 100).collect())
    b = sorted(ratio.null_variance(df.repartition(7), noise, 30, 100).collect())
    assert a == b and all(0 <= r.p <= 1 for r in a)
    assert all(r.skipped == 100 and r.p is None for r in ratio.null_variance(df, noise | {"b0": 50.0}, 30, 100).collect())


def test_natural_sort_and_flags(spark):
    names = ["r10", "r2", "a1b10", "a1b9"]
    got = [r.q for r in spark.createDataFrame([(n,) for n in names], "q string").orderBy(alignments.sort_key(F.col("q"))).collect()]
    assert got == ["a1b9", "a1b10", "r2", "r10"]


def _bam(path, reads):
    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 10_000)
    for name, flag, pos, ops, xs in reads:
        raw, seq = name.encode() + b"\0", b"\x12\x48"
        rec = struct.pack("<iiBBHHHiiii", 0, pos, len(raw), 30, 0, len(ops), flag, 4, -1, -1, 0) + raw + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops) + seq + b"\xff" * 4 + b"XSA" + xs.encode()
        body += struct.pack("<i", len(rec)) + rec
    half = len(body) // 2
    path.write_bytes(gzip.compress(body[:half]) + gzip.compress(body[half:]))


def test_bam_source(spark, tmp_path):
    _bam(tmp_path / "x.bam", [("r1", 0, 100, [(4, "M"), (50, "N"), (6, "M")], "-"), ("r2", 4, -1, [], "+")])
    spark.dataSource.register(readers.BamSource)
    rows = spark.read.format("isoweave_bam").option("path1", str(tmp_path / "x.bam")).load().collect()
    assert [(r.qname, r.flag, r.pos, r.cigar, r.seq, r.xs) for r in rows] == [("r1", 0, 100, "4M50N6M", "ACGT", "-"), ("r2", 4, -1, "*", "ACGT", "+")]


def test_text_readers(spark, tmp_path):
    (tmp_path / "m").write_text("# c\nb s1 /x\na s2 /y\nb s3 /z\n")
    assert [(r.sample_id, r.group, r["sample"]) for r in readers.manifest(spark, str(tmp_path / "m")).orderBy("sample_id").collect()] == [(1, "b", "s1"), (2, "b", "s3"), (3, "a", "s2")]
    (tmp_path / "s").write_text("k 3 # x\n")
    assert readers.settings(spark, str(tmp_path / "s"), {"k": "1", "j": "2"}) == {"k": "3", "j": "2"}
    with pytest.raises(ValueError):
        readers.settings(spark, str(tmp_path / "s"), {"j": "2"})
    (tmp_path / "a").write_text("asm1 asm1.p3 chr1:5-9:+ exon 1.5 2 5-7\nasm1 asm1.p1 chr1:5-9:+ exon 0 4 5-9\n")
    assert sorted((r.asm, r.path, r.low, r.cell, r.expr) for r in readers.abundances(spark, str(tmp_path / "a"), ["x", "y"]).collect()) == [("asm1", 1, 5, "x", 0.0), ("asm1", 1, 5, "y", 4.0), ("asm1", 3, 5, "x", 1.5), ("asm1", 3, 5, "y", 2.0)]
    (tmp_path / "d").write_text("Cell,c1,c2\nERCC Reads,1,2\nCell Reads,3,4\nUnclassified Reads,5,6\nTotal Reads,9,12\n")
    assert sorted((r.cell, r.ercc, r.cellular, r.other) for r in readers.read_depth(spark, str(tmp_path / "d")).collect()) == [("c1", 1, 3, 5), ("c2", 2, 4, 6)]
    (tmp_path / "t.sam").write_text("@HD\nr1\t16\tchr1\t11\t30\t5M\t=\t0\t0\tACGTA\tIIIII\tXS:A:-\tNM:i:0\n")
    r = readers.sam(spark, str(tmp_path / "t.sam")).first()
    assert (r.pos, r.xs, r.tags["NM"]) == (10, "-", "0")
    (tmp_path / "t.fa").write_text(">a x\nACG\nT\n>b\nGG\n")
    assert sorted(map(tuple, readers.fasta(spark, str(tmp_path / "t.fa")).collect())) == [("a", "ACGT"), ("b", "GG")]


def test_streaming_counts(spark, tmp_path):
    from isoweave.streaming.reads import streaming_read_counts

    rows = spark.createDataFrame([(1, "c", 0), (1, "c", 4), (2, "c", 0)], "sample_id long, chrom string, flag int")
    rows.write.parquet(str(tmp_path / "in"))
    q = streaming_read_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("read_counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("read_counts").collect())) == [(1, "c", 2, 1), (2, "c", 1, 1)]
