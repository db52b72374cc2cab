"""Jobs over all rows, without a part left out."""

import os

import pytest

from isoweave.operators import alignments
from isoweave.plans import views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_rank_of_all_reads_by_name(spark):
    reads = views.reads(spark, SF).repartition(7)
    ranked = alignments.ranked_by_name(reads.select("qname", "flag"))
    names = sorted((r.qname for r in reads.select("qname").collect()), key=lambda q: tuple(map(int, q[1:].split("."))))
    assert [r.qname for r in sorted(ranked.collect(), key=lambda r: r.rank)] == names
    assert sorted(r.rank for r in ranked.collect()) == list(range(1, len(names) + 1))
    assert "Window" not in ranked._jdf.queryExecution().toString()
    assert alignments.ranked_by_name(reads.select("qname", "flag").limit(0)).count() == 0


def test_em_takes_all_cells(spark):
    import numpy as np

    from isoweave.functions import kernels
    from isoweave.plans import QUERIES

    cells = views.asm_long(spark, SF).toPandas()
    cells["sample"] = cells.cell % 24
    want = {}
    for asm, rows in cells.groupby("asm"):
        wide = rows.groupby(["path", "sample"]).expr.sum().unstack()
        paths = np.tril(np.ones((len(wide), len(wide))))
        for c in wide.columns:
            a, _ = kernels.em_abundance(paths, paths.T @ wide[c].to_numpy(), np.full(len(wide), 100.0))
            want |= {(asm, p, c): v for p, v in zip(wide.index, a, strict=True)}
    got = {(r.asm, r.path, r.sample): r.abundance for r in QUERIES["em_abundance"](spark, SF).collect()}
    assert cells.cell.max() == 79 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 1e-6 * max(1, abs(want[k])) for k in want)


def test_simulations_as_documented(spark):
    from isoweave.operators import ratio
    from isoweave.plans import QUERIES, catalog

    key = lambda r: (r.asm, r.path_1, r.path_2)
    want = {key(r): (r.expected, r.p) for r in ratio.null_variance(ratio.observed(catalog._cells(spark, SF)), catalog._NOISE, 80, 1000).collect()}
    null = {key(r): (r.expected, r.p) for r in QUERIES["null_variance_test"](spark, SF).collect()}
    tests = {key(r): (r.expected, r.variance_p) for r in QUERIES["ratio_tests"](spark, SF).collect()}
    assert want and repr(sorted(null.items())) == repr(sorted(want.items())) and tests.keys() == want.keys()
    assert all(abs(a - b) <= 1e-9 for k in want for a, b in zip(tests[k], want[k], strict=True) if a == a or b == b)
