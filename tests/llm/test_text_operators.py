"""Tokenizing, files, packing and extraction against the libraries and brute force, on hard little texts."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from isoweave.llm import html_extract, packing, sentencepiece_bpe, token_files
from isoweave.llm.tokenizers import END_BYTES, byte_level, pack_ids, public_path, word_level

HARD = ["", " ", "  a  b", "a\n\nb", "\n", " \n x", "a\tb \t c\t\td", "漢字 ▁x ▁▁ y", "a ▁", "   ▁  漢", "don't we'll", "x" * 3000, "<s> </s> <0x0A> <|endoftext|>", "é á", "İSTANBUL ΣΑΣ", "a\x1cb c\x1c d", "🙂🙂 a🙂", "aaa\r\n bbb\r\n\r\nccc ", "Ǆ ĳ ﬁ", "a." * 2000]


def texts():
    rng = random.Random(7)
    return HARD + ["".join(rng.choice("  \n\tab  cdeth in ▁é漢.'s12") for _ in range(rng.randint(1, 60))) for _ in range(800)]


@pytest.mark.parametrize(("load", "name"), [(byte_level, "byte_bpe_50k.json"), (word_level, "word_bpe_49k.json")])
def test_cached_encoders_equal_the_library(load, name):
    enc = load(public_path(name))
    for text in texts():
        assert enc(text) == pack_ids(enc.tok.encode(text, add_special_tokens=False).ids), repr(text[:60])


def test_texts_encoded_together_equal_the_library(monkeypatch):
    """Before, there was no many(): each word with its case and marks was looked up by itself."""
    import pyarrow as pa

    from isoweave.llm import tokenizers

    enc, rng = word_level(public_path("word_bpe_49k.json")), random.Random(1)
    many = [None, *texts(), "x's 'tis ...'s é's 1'2 É's", "a×b É×é÷ ÷ ÀÖØÞßàöøþÿ À̀a Ã ã·x", "é Ⱥ ß ¼ ²x", "\x00a\x01 \x1f\x85b\xa0c"]
    many += ["".join(rng.choice("  \n\t\x0b\x1c\r'abXYZ12.,!é漢_-ÉÀÞß÷×øÿ\u0301") for _ in range(rng.randint(0, 80))) for _ in range(1000)]
    want = [pack_ids(enc.tok.encode(t or "", add_special_tokens=False).ids) + END_BYTES for t in many]
    for size in (tokenizers.CUT_BYTES, 50, 7):  # at the least, almost all texts are encoded by themselves
        monkeypatch.setattr(tokenizers, "CUT_BYTES", size)
        for column in (pa.array(many), pa.array(["zz", *many]).slice(1), pa.array(many, pa.large_string())):
            assert [ids.tobytes() for ids in enc.many(column)] == want
    assert enc.many(pa.array([], pa.string())) == []


def test_backtracking_equals_sentencepiece():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    own = sentencepiece_bpe.codec(public_path("piece_bpe_32k.model"))
    for text in texts():
        ids = lib.encode(text, add_bos=True, add_eos=True)
        assert own.encode(text) == pack_ids(ids), repr(text[:60])
        assert own.decode(pack_ids(ids)) == lib.decode(ids), repr(text[:60])


def test_compatibility_equals_re_merging():
    own = sentencepiece_bpe.codec(public_path("piece_bpe_32k.model"))
    own._pieces("▁a")
    rng = random.Random(3)
    usable = [i for i in own.split if "▁▁" not in own.pieces[i]]
    for _ in range(3000):
        a, b = rng.choice(usable), rng.choice(usable)
        text = own.pieces[a] + own.pieces[b]
        if "▁▁" not in text:
            assert own.compatible(a, b) == (own.merged(text) == [own.pieces[a], own.pieces[b]]), text


def docs(spark, values=None):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(values if values is not None else [None, *texts()[:120]])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string, task int")


def test_token_files_round_trip(spark):
    d = docs(spark)
    got = {r.doc_id: r for r in token_files.token_file_digests(spark, token_files.write_token_files(d, public_path("byte_bpe_50k.json"))).collect()}
    enc, at = byte_level(public_path("byte_bpe_50k.json")), 0
    rows = sorted(d.collect())
    assert len(got) == len(rows)
    for r in rows:
        ids = enc(r.text or "") + END_BYTES
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert token_files.token_file_digests(spark, token_files.write_token_files(docs(spark, []), public_path("byte_bpe_50k.json"))).count() == 0


def test_packing_holds_every_id_once(spark):
    values = [None, "", *("w%d " % (i % 7) * (i * 37 % 3000) for i in range(60)), "long " * 20000]
    out = packing.pack(docs(spark, values).coalesce(2), public_path("word_bpe_49k.json")).collect()
    enc = word_level(public_path("word_bpe_49k.json"))
    for i, text in enumerate(values):
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == enc(text or "") + END_BYTES
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
    seq = {}
    for r in out:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seq.values():
        parts.sort()
        assert [p[0] for p in parts] == list(np.cumsum([0, *(p[1] for p in parts)])[:-1])
        total = sum(p[1] for p in parts)
        assert total <= packing.WINDOW and total & (total - 1) == 0


def test_packing_prefers_lexical_neighbours():
    rng = np.random.default_rng(0)
    topics = [rng.integers(t * 1000, t * 1000 + 200, (40, 100)).astype(np.uint32) for t in range(5)]
    order = rng.permutation(200)
    flat = [topics[i % 5][i // 5] for i in order]
    pieces = packing.pack_shard(flat, window=500)
    per = {}
    for doc, _, _, s, _ in pieces:
        per.setdefault(s, []).append(order[doc] % 5)
    pure = np.mean([max(np.bincount(v)) / len(v) for v in per.values()])
    assert pure > 0.9


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li>Menu</li></ul></nav>
<div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One  two<br>three.<p>Fou&#114; &lt;x&gt;</p><aside>Side</aside><form>Name<input></form><!-- no --><p hidden>gone</p><div class="comments"><p>Nice!</p></div></article><div id="cookie-notice">OK</div><footer>&copy; me</footer></body>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "A & B\nOne two three.\nFour <x>"
    assert html_extract.main_text(None) == "" and html_extract.main_text("") == "" and html_extract.main_text("<nav>x</nav>") == ""
    assert html_extract.main_text("a < b <p>c") == "a < b\nc"
    assert html_extract.main_text("<main><p>in</p></main><p>out</p>") == "in"
    assert html_extract.main_text("<div><p>plain</p></div>") == "plain"
    assert html_extract.main_text("<p>" + "x " * 50_000).count("x") == 50_000


def test_template_text_goes_and_copies_stay(spark):
    page = "<article><p>Share this story</p><p>Own text {}</p></article>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(12)] + [(50 + i, f"http://same.example/{i}", page.format(0)) for i in range(12)] + [(99, None, None), (100, "x", page.format(1))]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "Own text 3" and got[3].n_chars == 10
    assert got[55].text == "Share this story\nOwn text 0" and got[99].text == "" and got[100].text.startswith("Share")


def test_template_of_equivalence_classes(spark):
    """Boxes of unlisted names that a page lacks, that come twice or that change places go; text beside the article and text repeated on few pages stay."""
    box = lambda name, text: f'<div class="{name}"><p>{text}</p></div>'
    rows = []
    for i in range(12):
        a, b = box("x1", "Weather today"), box("x2", "Our partners")
        parts = [b, a] if i % 2 else [a, b]
        few = "<p>Seldom said</p>" if i < 3 else ""
        rows.append((i, f"http://h.example/{i}", "".join([*parts, box("q7", "Top stories") if i else "", f"<article><p>Own {i}</p>{few}</article>", box("z", "Twice") * (1 + i % 2), f'<div class="post"><p>Beside {i}</p></div>'])))
    rows += [(20, "http://h.example/e", ""), (21, "http://h.example/f", None), (22, "http://h.example/g", "<html></html>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own {i}\n" + ("Seldom said\n" if i < 3 else "") + f"Beside {i}" for i in range(12)} | {20: "", 21: "", 22: ""}


def test_orders_of_classes():
    known = {t: (c, 2, df) for t, c, df in ((1, 10, 9), (2, 10, 9), (3, 20, 8), (4, 20, 8))}
    assert None not in html_extract.orders([1, 3, 4, 2, 1, 2], known).values()
    assert [c for c, p in html_extract.orders([1, 3, 2, 4], known).items() if p is None] == [20]
    assert [c for c, p in html_extract.orders([1, 1, 2, 2, 3, 4], known).items() if p is None] == [10]


def test_neighbours_by_all_terms_of_a_seed():
    """BM25 by brute force over long documents, also after used documents' postings are gone."""
    rng = np.random.default_rng(4)
    flat = [rng.integers(0, 900, rng.integers(1, 400)).astype(np.uint32) for _ in range(60)]
    n, mean, sets = len(flat), np.mean([len(d) for d in flat]), [set(d.tolist()) for d in flat]
    index, unused = packing.Index(flat), np.ones(n, bool)
    for seed in rng.permutation(n)[:40]:
        unused[seed] = False
        want = {}
        for d in np.flatnonzero(unused):
            shared = sets[seed] & sets[d]
            if shared:
                parts = [(sum(t in s for s in sets), int((flat[d] == t).sum())) for t in shared]
                want[d] = sum(np.log1p((n - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(flat[d]) / mean)) for df, tf in parts)
        got = np.array(list(index.neighbours(int(seed), unused)), int)
        assert set(got.tolist()) == set(want) and all(want[a] >= want[b] - 1e-4 for a, b in zip(got, got[1:]))


def test_pages_of_any_depth_take_linear_time():
    """A page four times as long takes about four times as long, not sixteen times."""
    import time

    hard = [lambda n: "<script " * n, lambda n: "<script " * n + ">", lambda n: "<div>" * n + "x", lambda n: "<div>" * n + "</span>" * n, lambda n: '<a b=">"' * n, lambda n: "<div>" * n + "t" + "</div>" * n]
    began = time.process_time()
    for page in hard:
        html_extract.main_text(page(100_000))
    assert time.process_time() - began < 60
    assert html_extract.main_text("<div>" * 1000 + "x") == "x" and html_extract.main_text('<p title="a>b">x</p>') == "x"


def test_words_of_a_class_alone_are_no_furniture():
    page = '<article><section class="related-work"><p>kept</p></section><p class="social-policy">also</p><div class="related-posts">gone</div><div id="cookie-notice">gone</div></article>'
    assert html_extract.main_text(page) == "kept\nalso"


def test_empty_tables_and_clashing_columns(spark):
    empty = docs(spark, [])
    for out in (packing.pack(empty, public_path("word_bpe_49k.json")), sentencepiece_bpe.sentencepiece_round_trip(empty, public_path("piece_bpe_32k.model"))):
        assert out.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string, token int, host string")
    assert html_extract.extract(pages).count() == 0


def test_round_trip_through_the_table(spark):
    """The DataFrame function's ids and digests against the library."""
    import hashlib

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    d = docs(spark)
    got = {r.doc_id: r for r in sentencepiece_bpe.sentencepiece_round_trip(d, public_path("piece_bpe_32k.model"), digests=True).collect()}
    for r in d.collect():
        ids = lib.encode(r.text or "", add_bos=True, add_eos=True)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(pack_ids(ids)).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_template_of_many_hosts_is_joined(spark, monkeypatch):
    """The shuffled way of sending templates gives what the broadcast way gives."""
    rows = [(h * 100 + i, f"http://h{h}.example/{i}", f"<article><p>Share this {h}</p><p>Own {h} {i}</p></article>") for h in range(3) for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    sent = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    monkeypatch.setattr(html_extract, "BROADCAST_TOKENS", 0)
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == sent == {i: "Own %d %d" % divmod(i, 100) for i, _, _ in rows}


def test_packing_index_holds_no_second_copies():
    """Before, the index of these 300,000 ids took 36 MB at its peak, now 21."""
    import tracemalloc

    from isoweave.llm import packing

    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 40_000, 3000).astype("<u4") for _ in range(100)]
    tracemalloc.start()
    packing.Index(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 26_000_000


def test_packing_keeps_words_without_case_and_marks():
    """Before, 4,000 of the caches' places went to units that differ in case or marks alone."""
    import pyarrow as pa

    from isoweave.llm.tokenizers import WordEncoder

    enc = WordEncoder(public_path("word_bpe_49k.json"))
    words = ["".join(random.Random(i).choices("abcdeé", k=9)) for i in range(1000)]
    enc.many(pa.array([" ".join(f"{w} {w.upper()} {w}. {w}***" for w in words)]))
    assert len(enc.units) == 0 and len(enc.words) <= 1002


def test_stages_read_small_batches(spark):
    """Before, a reader's batch had 4,096 whole texts."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    name = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.unset(name)
    try:
        for _, stage in corpus_pipeline.STAGES[2:]:
            spark.conf.unset(name)
            stage(spark, docs(spark, ["some text"]), "")
            assert int(spark.conf.get(name)) <= 256
    finally:
        spark.conf.unset(name)
