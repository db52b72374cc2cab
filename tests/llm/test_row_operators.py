"""Deduplication, classification, rollups and the pipeline against brute force, with nulls, ties and clashing columns."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoweave.llm import embedding_dedup, exact_dedup, language_id, near_dedup, quality, token_rollup
from isoweave.llm.common import shared_dir
from isoweave.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(None, 3), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == roots({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


TEXTS = [None, "", "Same text", "same TEXT", "same text", "Ünique", "ünique", "x" * 50_000, "X" * 50_000, None]


@pytest.mark.parametrize("digest", [None, lambda norm: F.substring(F.unhex(F.sha2(F.lit("k"), 256)), 1, 4)])
def test_exact_duplicates(spark, digest):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + [(2, "Same text", "en", "s", 0), (None, "lone", "en", "s", 0)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA), digest=digest).collect()
    groups = defaultdict(list)
    low = lambda t: (t or "").encode().lower()
    for i, t, *_ in rows:
        groups[low(t)].append(i)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    text = {i: t for i, t, *_ in rows}
    for r in got:
        own = groups[low(text[r.doc_id])]
        assert r.keep_id == (max(own) if None not in own else None) and r.group_size == len(own)
        assert r.text_sha256 == hashlib.sha256(low(text[r.doc_id])).hexdigest()


def test_stream_goes_on_from_its_state(spark, tmp_path):
    a, state, groups = str(tmp_path / "log"), str(tmp_path / "state"), str(tmp_path / "groups")
    rows = spark.range(4).select(F.col("id").alias("doc_id"), F.struct(F.lit("f").alias("file"), F.col("id").alias("row")).alias("at"), F.lit(b"d").alias("digest"), F.lit(1).cast("long").alias("n_bytes"))
    for n in (4, 8):
        rows.withColumn("doc_id", F.col("doc_id") + n).write.mode("append").parquet(a)
        got = exact_dedup.track(spark, a, rows.schema, state, groups).collect()
        assert [(r.group_size, r.keep.doc_id) for r in got] == [(n, n + 3)]


def near_truth(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, roots(ids, links)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rng = random.Random(k)
    vocab = ["w%d" % i for i in range(400)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "ONE"), (4, " \n\t"), (5, "a b")]
    for base in range(12):
        words = [rng.choice(vocab) for _ in range(rng.choice([6, 30, 200]))]
        for _ in range(rng.choice([1, 3, 12])):
            w = list(words)
            for _ in range(rng.randrange(0, max(1, len(w) // 12) + 1)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    sizes, comp = near_truth(rows, k)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, rep int")
    got = near_dedup.near_duplicates(df, k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (sizes[i], comp[i], comp[i] == i) for i, _ in rows}


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    words = ["v%d" % rng.randrange(3000) for _ in range(150)]
    rows = []
    for i in range(1300):
        w = list(words)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(150)] = "z%d" % rng.randrange(10_000)
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    _, comp = near_truth(rows, 2)
    assert {r.doc_id: r.component_id for r in got} == comp


def test_two_large_groups_that_share_a_passage(spark, monkeypatch):
    """Two groups of near copies and rows in between, dealt into many small blocks."""
    monkeypatch.setattr(near_dedup, "SKETCH_ROWS", 32)
    monkeypatch.setattr(near_dedup, "SET_ROWS", 32)
    rng = random.Random(8)
    passage = ["p%d" % i for i in range(90)]
    bases = [["%s%d" % (c, i) for i in range(60)] for c in "ab"]
    rows = []
    for i in range(500):
        w = passage + [rng.choice(p) for p in zip(*bases, strict=True)] if i % 10 == 0 else passage + list(bases[i % 2])
        for _ in range(rng.randrange(12)):
            w[rng.randrange(150)] = "z%d" % rng.randrange(10_000)
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    _, comp = near_truth(rows, 2)
    assert len(set(comp.values())) > 20 and {r.doc_id: r.component_id for r in got} == comp


def test_sketch_bound_keeps_links():
    rng = np.random.default_rng(2)
    most, differ = near_dedup.most_bits(0.8), []
    for _ in range(150):
        x = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        a, b = np.sort(x[:850]), np.sort(np.concatenate([x[50 + 44 :], x[:0]]))
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
        s = near_dedup.odd_sketches(near_dedup.minhashes([a, b]))
        differ.append(int(np.bitwise_count(s[0] ^ s[1]).sum()))
    assert max(differ) <= most < near_dedup.SKETCH_BITS / 2


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 64))
    vs = np.concatenate([base] + [base[:20] + rng.standard_normal((20, 64)) * s for s in (0.1, 0.2, 0.3, 0.34)] + [base[:5] * 3.0])
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vs.astype(np.float32))]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [float("nan")] * 64, 1), (n + 3, [1.0, None], 1), (n + 4, [], 1), (n + 5, [1e300, 1e300], 1), (n + 6, [1e-300, 1e-300], 1), (n + 7, rows[0][1], None), (n + 8, rows[0][1], 2)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int")).collect()}
    good = {i: np.array(v) / max(abs(x) for x in v) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95]
    found = sum(r.n_links for r in got.values()) / 2
    assert 0.98 * len(links) <= found <= len(links) and len(got) == len(rows)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(n, n + 5)) and got[n + 6].component_id == n + 5
    comp = roots(list(got), links)
    assert sum(got[i].component_id == comp[i] for i in got) >= 0.98 * len(got)


def test_language(spark):
    words = {"en": "the and that with have this from they".split(), "de": "und der die nicht ein sich auch für".split()}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words[lang], k=8)), lang) for i in range(200) for lang in [rng.choice(["en", "de"])]]
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, "", None), (None, "und der", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language_id.identify(df, language_id.train(df)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:200])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    empty = df.limit(0)
    assert language_id.identify(df, language_id.train(empty)).where("lang_pred != 'und'").count() == 0


def test_quality(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    clean = lambda: ". ".join(" ".join(word() for _ in range(8)) for _ in range(5)) + "."
    junk = lambda: " | ".join(word() for _ in range(30))
    rows = [(i, junk() if i % 4 == 0 else clean(), None if i % 50 == 0 else "en", f"h{i % 3}") for i in range(300)] + [(900, None, "en", None), (901, " ", "en", "h1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 300, 2)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.with_quality(df, quality.train(df, labels)).collect()}
    assert len(got) == len(rows) and all((got[i]._quality >= 0.5) == (i % 4 != 0) for i in range(300))
    assert got[900]._quality == got[901]._quality == 0
    assert quality.with_quality(df.limit(0), quality.train(df.limit(0), labels)).count() == 0


def test_rollup_is_idempotent(spark):
    schema = "op string, source string, lang string, version string, tokens long, old_version string, old_tokens long"
    folder = shared_dir(spark, "rollup-test")
    first = spark.createDataFrame([("insert", "a", "en", "v1", 10, None, None), ("insert", "a", None, "v1", 5, None, None), ("insert", "b", "en", "v1", None, None, None)], schema)
    second = spark.createDataFrame([("revise", "a", "en", "v2", 12, "v1", 10), ("delete", "b", "en", None, None, "v1", 0)], schema)
    for changes, n in ((first, 0), (second, 1), (second, 1), (first, 0)):
        token_rollup.commit(changes, folder, n)
    want = {("a", "en", "v2", 1, 12), ("a", None, "v1", 1, 5)}
    assert {tuple(r) for r in token_rollup.totals(spark, folder).collect()} == want
    with pytest.raises(Exception, match="unknown change"):
        token_rollup.commit(spark.createDataFrame([("x", "a", "en", "v1", 1, None, None)], schema), folder, 2)


def test_pipeline_keeps_one_of_each(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from isoweave.llm.common import table

    sf = "/root/testdata/sf0.001"
    docs, seen = table(spark, sf, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        from isoweave.llm.common import written

        before = {r.doc_id: r.text for r in docs.collect()}
        docs = written(stage(spark, docs, sf), "test-stage")
        if name == "exact dedup":
            last = {}
            for i in sorted(before):
                last[before[i].encode().lower()] = i
            assert {r.doc_id for r in docs.collect()} == set(last.values())
        if name == "MinHash near-dedup":
            _, comp = near_truth(list(before.items()), 5)
            assert {r.doc_id for r in docs.collect()} == {i for i in before if comp[i] == i}
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == set(before)
        seen[name] = len(before)
    assert list(seen) == [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.run(spark, sf).count() > 0


def test_shared_counts_equal_intersections(monkeypatch):
    """Counts over several matrices, also where no word is shared."""
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 900, rng.integers(1, 200))) for _ in range(40)]
    values, row = np.concatenate(sets), np.repeat(np.arange(40), [len(s) for s in sets])
    monkeypatch.setattr(near_dedup, "CELLS", 40)
    for left, right in ((np.arange(40), np.arange(40)), (np.arange(15), np.arange(15, 40))):
        want = np.array([[len(np.intersect1d(sets[a], sets[b])) for b in right] for a in left])
        pair = left[:, None] != right  # what a set shares with itself isn't asked for
        assert (near_dedup.shared_counts(values, row, left, right) == want)[pair].all()
    assert not near_dedup.shared_counts(np.array([1, 2, 3]), np.array([0, 1, 2]), np.arange(3), np.arange(3)).any()


def test_forest_joins_what_all_links_join():
    x, y = np.array([1, 2, 1, 4, 5, 4]), np.array([2, 3, 3, 5, 6, 6])
    assert near_dedup.forest(x, y) == [0, 1, 3, 4]


def test_language_with_few_usable_rows_is_learned(spark, monkeypatch):
    """One row in a hundred of a large language has letters; the fit gets all of these, and no count of rows held out."""
    fitted = []
    monkeypatch.setattr(language_id, "fit", lambda texts, labels: fitted.append((texts, labels)))
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("und der "), F.col("id"))).otherwise(F.when(F.col("id") % 2 == 0, "12")).alias("text"), F.lit("de").alias("lang"))
    language_id.train(df)
    usable = df.where(F.col("text").contains("und") & ~language_id.held_out(F.col("doc_id"))).count()
    assert usable < language_id.TRAIN_ROWS and len(fitted[0][0]) == usable


def test_rollup_folds_its_deltas(spark):
    schema = "op string, source string, lang string, version string, tokens long, old_version string, old_tokens long"
    folder = shared_dir(spark, "rollup-fold-test")
    change = lambda *row: spark.createDataFrame([row], schema)
    first, second = change("insert", "a", "en", "v1", 10, None, None), change("delete", "a", "en", None, None, "v1", 10)
    token_rollup.commit(first, folder, 0)
    token_rollup.commit(change("insert", "b", None, "v1", 7, None, None), folder, 1)
    token_rollup.compact(spark, folder)
    assert len(token_rollup._batches(spark, folder)[0]) == 1 and not token_rollup._batches(spark, folder)[1]
    token_rollup.commit(first, folder, 0)  # repeated after the fold
    assert {tuple(r) for r in token_rollup.totals(spark, folder).collect()} == {("a", "en", "v1", 1, 10), ("b", None, "v1", 1, 7)}
    token_rollup.commit(second, folder, 2)
    for _ in range(2):
        assert {tuple(r) for r in token_rollup.totals(spark, folder).collect()} == {("b", None, "v1", 1, 7)}
        token_rollup.compact(spark, folder)
    assert token_rollup._batches(spark, folder) == ([-3], [])


def test_components_of_ids_near_the_largest(spark):
    top = (1 << 63) - 1
    edges = [(top - i, top - i - 1) for i in range(6)]
    assert {r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {top - 6}


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _gone int, _at int, _p int, prior int, _lang string, _site int, file int, `a.b` int"


def test_stages_with_clashing_and_null_columns(spark):
    """All columns come back as they were, whatever their names, and an empty table stays empty."""
    import corpus_pipeline

    words = "the old house stands near a river and people walk there every day".split()
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words, k=30)) + ".", "en", None if i % 3 else "s", 1, 1, 2, 3, 4, "x", 5, 6, i) for i in range(25)]
    rows += [(100, rows[0][1], "en", "s", None, 1, 2, 3, 4, "x", 5, 6, 100), (100, rows[0][1], "en", "s", None, 1, 2, 3, 4, "x", 5, 6, 100), (101, None, None, None, None, 1, 2, 3, 4, "x", 5, 6, 101)]
    df = spark.createDataFrame(rows, CLASH)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "/root/testdata/sf0.001")
        assert out.columns == df.columns, name
        got = [tuple(r) for r in out.collect()]
        assert set(got) <= set(rows) and (len(got) >= 20 or name == "quality classifier"), name
        if name == "exact dedup":
            assert sorted(r[-1] for r in got) == [*range(1, 25), 100, 101]
        assert stage(spark, df.limit(0), "/root/testdata/sf0.001").count() == 0, name


def test_exact_duplicates_of_a_join_and_of_a_union(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    twice = t.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    for df in (t, t.where("doc_id > 0"), t.unionByName(t), twice, t.join(t.select("doc_id"), "doc_id")):
        assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(df).collect()) == [2, 3]


def test_totals_before_any_batch_and_after_many(spark):
    schema = "op string, source string, lang string, version string, tokens long, old_version string, old_tokens long"
    folder = shared_dir(spark, "rollup-many-test")
    assert token_rollup.totals(spark, folder).count() == 0
    for n in range(token_rollup.FOLD_AFTER + 3):
        for _ in range(2):
            token_rollup.commit(spark.createDataFrame([("insert", "a", "en", "v", n, None, None)], schema), folder, n)
    token_rollup.commit(spark.createDataFrame([], schema), folder, 90)
    n = token_rollup.FOLD_AFTER + 3
    assert {tuple(r) for r in token_rollup.totals(spark, folder).collect()} == {("a", "en", "v", n, n * (n - 1) // 2)}
    assert len(token_rollup._batches(spark, folder)[0]) < n


def test_sample_of_repeated_ids_is_bounded(spark, monkeypatch):
    """Rows that share one id are drawn each by itself, and the driver never gets more than the bound."""
    fitted = []
    monkeypatch.setattr(language_id, "fit", lambda texts, labels: fitted.append(labels))
    monkeypatch.setattr(quality, "fit", lambda texts, good: fitted.append(good))
    one = spark.range(3000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("und "), "id").alias("text"), F.lit("de").alias("lang"))
    assert not one.where(language_id.held_out(F.col("doc_id"))).count()
    language_id.train(one, rows=50)
    quality.train(one, spark.createDataFrame([(3, 1)], "doc_id long, quality int"), rows=50)
    assert [len(x) for x in fitted] == [50, 50]


def test_quality_is_learned_from_words():
    """Texts of one form whose words alone tell good from bad, held out."""
    rng = random.Random(6)
    good, bad = [["%s%d" % (c, i) for i in range(60)] for c in ("ga", "ba")]
    make = lambda own: " ".join(rng.choice(own if rng.random() < 0.3 else ["n%d" % rng.randrange(80)]) for _ in range(60)) + "."
    rows = [(make(good if i % 2 else bad), i % 2) for i in range(400)]
    model = quality.fit([t for t, _ in rows[:300]], [g for _, g in rows[:300]])
    p = model.evidence([t for t, _ in rows[300:]] + ["", " ", None])
    assert np.mean((p[:100] >= 0.5) == [g == 1 for _, g in rows[300:]]) >= 0.95 and list(p[100:]) == [0, 0, 0]


def test_site_posteriors_by_hand(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), rng.random() * (0.4 if i % 3 else 1)) for i in range(200)] + [("rare", "x", 0.9)]
    got = {(r._host, r._path): (r.path_post, r.host_post, r.prior) for r in quality.site_posteriors(spark.createDataFrame(rows, "h string, d string, _p double"), "h", "d").collect()}
    hosts, paths = defaultdict(list), defaultdict(list)
    for h, d, p in rows:
        hosts[h].append(p)
        paths[h, d].append(p)
    n, prior = len(rows), sum(p for *_, p in rows) / len(rows)
    square = lambda groups: sum(sum(v) ** 2 / len(v) for v in groups.values())
    within = max((sum(p * p for *_, p in rows) - square(paths)) / (n - len(paths)), 1e-6)
    spread = lambda a, k, groups: (a - k * within) / (n - sum(len(v) ** 2 for v in groups.values()) / n)
    b_h = spread(square(hosts) - n * prior**2, len(hosts) - 1, hosts)
    b_p = spread(square(paths) - square(hosts), len(paths) - len(hosts), paths)
    lo, hi = quality.STRENGTH
    k_h, k_p = (min(max(within / b, lo), hi) if b > 0 else hi for b in (b_h, b_p))
    post = {h: (k_h * prior + sum(v)) / (k_h + len(v)) for h, v in hosts.items()}
    for (h, d), v in paths.items():
        assert got[h, d] == pytest.approx(((k_p * post[h] + sum(v)) / (k_p + len(v)), post[h], prior))
    assert len(got) == len(paths) and abs(got["rare", "x"][0] - prior) < abs(0.9 - prior)


def test_kernel_landmarks_and_ridge_by_hand():
    """Margins of the weights per n-gram against kernel values between texts and landmarks, one by one."""
    rng = random.Random(9)
    alphabet = {"p": "abcde", "q": "defgh", "r": "hijab"}
    texts, labels = [], []
    for i in range(45):
        labels.append("pqr"[i % 3])
        texts.append(" ".join("".join(rng.choices(alphabet[labels[-1]], k=rng.randrange(1, 7))) for _ in range(rng.randrange(1, 9))))
    model = language_id.fit(texts, labels, landmarks=7)
    grams = lambda t: {f" {w} "[i : i + n] for w in t.lower().split() for n in range(1, 5) for i in range(len(w) + 3 - n)}
    chosen = [i for c in "pqr" for i in [j for j, l in enumerate(labels) if l == c][:7]]
    known = set().union(*(grams(texts[i]) for i in chosen))
    sets = [grams(t) & known for t in texts]
    kernel = np.array([[len(a & sets[i]) / np.sqrt(max(len(a), 1) * max(len(sets[i]), 1)) for i in chosen] for a in sets])
    y = np.array(["pqr".index(l) for l in labels])
    t = np.where(y[:, None] == np.arange(3), 1.0, -1.0)
    bias = t.mean(axis=0)  # the languages have equally many rows
    alpha = np.linalg.solve(kernel.T @ kernel + language_id.RIDGE * 45 * (kernel[chosen] + 1e-6 * np.eye(21)), kernel.T @ (t - bias))
    assert np.abs(model.margins(texts) - (kernel @ alpha + bias)).max() < 1e-3


def test_rollup_query_by_counting(spark):
    pytest.importorskip("public_tokenizers")
    from isoweave.llm import queries
    from isoweave.llm.common import table
    from isoweave.llm.tokenizers import byte_level, public_path, word_level

    sf, want = "/root/testdata/sf0.001", defaultdict(lambda: [0, 0])
    coders = {n: f(public_path(f"{n}.json")) for n, f in (("byte_bpe_50k", byte_level), ("word_bpe_49k", word_level))}
    for r in table(spark, sf, "documents").collect():
        for name, enc in coders.items():
            own = want[r.source, r.lang, name]
            own[0] += 1
            own[1] += len(enc.tok.encode(r.text or "", add_special_tokens=False).ids)
    assert {(r.source, r.lang, r.version): [r.n_docs, r.n_tokens] for r in queries.op7_token_counts(spark, sf).collect()} == dict(want)
