"""Main-text extraction by equivalence classes of tokens over the pages of a host.

A page is a sequence of tokens: its tags, opening and closing, with their place in the tree, and its text blocks. Over
a host's pages each token has an occurrence vector (its number on every page that has text), kept as a fingerprint
that aggregation builds from per-page hashes. Tokens on SUPPORT of the pages and more form classes of equal vectors. A
class is valid if on every page its tokens come in one order, over and over, and if it nests with the others: no class
goes on within an instance of another and beyond it. An invalid class is split by the element that its tokens stand
in, and the parts are checked likewise. The tokens of valid classes are the host's template; what lies between them
are slots, and their text is extracted. Regions that are named as furniture by their element, role, class or id are
left out beside that. A page without a template, or without any slot that holds text, gives its article or main region.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter, defaultdict
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, text_batches, written

#: Pages a host needs for a template, share of them that a class needs; tokens up to so many are sent to all executors, more are joined.
LEAST_PAGES, SUPPORT, BROADCAST_TOKENS = 8, 0.5, 100_000

# Elements of HTML by their role here.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "canvas", "object", "select", "button", "xmp", "noembed", "noframes")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form menu dialog head fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments commentlist respond disqus replies reply widget skip toc tags hidden".split())
HEADERS = frozenset(("header", "site-header", "page-header"))

#: Words that a furniture name may have beside those of NAMES: ``related-posts`` is one, ``related-work`` isn't.
FILLERS = frozenset("site page post posts article articles box block bar wrapper wrap container inner outer list lists link links section area region panel top bottom left right button buttons icon icons form main global primary secondary cta slot unit text header title js".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+>""")
_ENDS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")


def host_of(url: str | None) -> str:
    """Host of a URL in lower case, empty where there is none."""
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def tags(page: str):
    """(start, end, closing, name, attributes) of each tag, in time linear in the page; name is empty for comments and declarations.

    An element of RAW is one tag with all it holds, to the page's end if it isn't closed. A tag ends at its first > outside
    of attribute values; if one value is never closed, this and all later tags end at their first >. A < after the last >
    begins no tag.
    """
    at, last, n, quoted = 0, page.rfind(">"), len(page), True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
            yield start, at, False, "", ""
            continue
        if start > last:
            return
        m = _NAME.match(page, start)
        if not m:
            at = start + 1
            if page[at : at + 1] in ("!", "?", "/"):
                at = page.find(">", at) + 1
                yield start, at, False, "", ""
            continue
        end = _REST.match(page, m.end()) if quoted else None
        quoted = end is not None
        at = end.end() if quoted else page.find(">", m.end()) + 1
        name, raw = m[2].lower(), page[m.end() : at - 1]
        if name in _ENDS and not m[1]:
            close = _ENDS[name].search(page, at)
            at = close.end() if close else n
            name = ""
        yield start, at, bool(m[1]), name, raw


@functools.lru_cache(maxsize=4096)
def _named_furniture(value: str) -> bool:
    """Whether one of an attribute's names is made of words of NAMES, with FILLERS at most besides."""
    for name in value.split():
        words = set(_WORD.findall(name))
        if not NAMES.isdisjoint(words) and words <= NAMES | FILLERS:
            return True
    return value in HEADERS


def _furniture(name: str, raw: str, inside: bool) -> bool:
    """Whether an element is page furniture; ``inside``: within the article, where a plain header is its own."""
    if name in FURNITURE or name == "header" and not inside:
        return True
    if not raw or "=" not in raw and "hidden" not in raw:
        return False
    for key, *values in _ATTR.findall(raw):
        key, value = key.lower(), next(filter(None, values), "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and _named_furniture(value):
            return True
        if key in ("class", "id") and name == "article" and not {"comment", "comments", "reply"}.isdisjoint(_WORD.findall(value)):
            return True
    return False


def _main(name: str, raw: str) -> int:
    """2 for an article, 1 for a main region, else 0."""
    if name == "article":
        return 2
    return int(name == "main" or 'role="main"' in raw or "role='main'" in raw)


@functools.lru_cache(maxsize=4096)
def _label(name: str, raw: str) -> str:
    """An element's name with its classes and id; long numbers in them count as equal."""
    named = [next(filter(None, v), "") for k, *v in _ATTR.findall(raw) if k.lower() in ("class", "id")] if "=" in raw else []
    return ".".join([name, *(re.sub(r"\d{3,}", "#", w) for v in named for w in v.lower().split())])


def _token(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@functools.lru_cache(maxsize=16384)
def _place(above: int, label: str) -> int:
    """An element's path as a fingerprint, so that deep pages need no more memory than flat ones."""
    return _token("place", str(above), label)


def blocks(page: str) -> list[tuple[int, int, str]]:
    """[(region: 2 article, 1 main, 0 body, -1 for a tag; place of the element; text, or a tag's name)] of a page, in order.

    Time and memory are linear in the page's length, whatever its depth.
    """
    out: list[tuple[int, int, str]] = []
    open_: list[tuple[str, bool, int, int]] = []  # name, furniture, region, place
    inside: Counter = Counter()  # open elements by name
    parts: list[str] = []
    skip = region = at = place = 0

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((region, place, text))
            parts.clear()

    def close(name: str) -> None:
        """Close elements up to the last one of this name."""
        nonlocal skip, region, place
        flush()
        last = None
        while last != name:
            last, bad, _, own = open_.pop()
            inside[last] -= 1
            skip -= bad
            out.append((-1, own, "/"))
        region, place = (open_[-1][2], open_[-1][3]) if open_ else (0, 0)

    for start, end, closing, name, raw in tags(page):
        if start > at and not skip:
            parts.append(page[at:start])
        at = end
        if not name:
            if not skip and page[start + 1 : start + 2] not in "!?/":
                parts.append(" ")  # an element without text of its own parts words
            continue
        if closing:
            if inside[name]:
                close(name)
            elif name in BLOCKS:
                flush()
            continue
        if name == "body" and inside["head"]:
            close("head")  # a head that was left open ends here
        if name in BLOCKS:
            flush()
            while open_ and open_[-1][0] == "p":
                close("p")
        elif name in VOID:
            if name == "br" and not skip:
                parts.append(" ")
            continue
        bad = _furniture(name, raw, region == 2)
        main = 0 if bad else _main(name, raw)
        alone = name in VOID or raw.endswith("/") or not (bad or main or name in ("div", "section", "header", "body", "html", "ul", "ol", "table"))
        if alone:  # p and li end by themselves
            if name in BLOCKS:
                out.append((-1, place, _label(name, raw)))
            continue
        flush()
        open_.append((name, bad, max(region, main), _place(place, _label(name, raw))))
        inside[name] += 1
        out.append((-1, open_[-1][3], ""))
        skip += bad
        region, place = open_[-1][2], open_[-1][3]
    if at < len(page) and not skip:
        parts.append(page[at:])
    flush()
    return out


def tokens_of(found: list[tuple[int, int, str]]) -> list[int]:
    return [_token("tag" if r < 0 else "text", str(p), t) for r, p, t in found]


ROOT = _token("root")
_SEEN = pa.schema([("host", pa.string()), ("token", pa.int64()), ("place", pa.int64()), ("vector", pa.int64())])
_ORDER = pa.schema([("host", pa.string()), ("class", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, place: hash of its element, vector: hash of page and number) of each page's distinct tokens; pages without text have none."""

    def run(batches):
        for batch in batches:
            cols: dict[str, list] = {f.name: [] for f in _SEEN}
            for key, url, page in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                host, found = host_of(url), blocks(page or "")
                if all(r < 0 for r, _, _ in found):
                    continue
                seen = Counter([(ROOT, 0), *((t, f[1]) for t, f in zip(tokens_of(found), found, strict=True))])
                vectors = {n: _token(str(key), str(n)) for n in set(seen.values())}
                for (token, place), n in seen.items():
                    for c, v in zip(cols.values(), (host, token, place, vectors[n]), strict=True):
                        c.append(v)
            yield arrow_rows(_SEEN, cols)

    key = F.xxhash64("page_id", "url", "html")
    return pages.select(key.alias("key"), "url", "html").mapInArrow(run, "host string, token long, place long, vector long")


def classes(pages: DataFrame) -> DataFrame:
    """(host, token, df, whole, whole_size, part, part_size): the class of each token with enough pages, and its part of it in the token's element."""
    tokens = occurrences(pages).groupBy("host", "token").agg(F.min("place").alias("place"), F.count("*").alias("df"), F.bit_xor("vector").alias("print"))
    tokens = written(tokens.where(f"df >= {LEAST_PAGES} * {SUPPORT}"), "page-tokens")
    n = tokens.where((F.col("token") == ROOT) & (F.col("df") >= LEAST_PAGES)).select("host", F.col("df").alias("pages"))
    kept = tokens.where(F.col("token") != ROOT).join(n, "host").where(F.col("df") >= F.col("pages") * SUPPORT)
    kept = kept.withColumn("whole", F.xxhash64("df", "print")).withColumn("part", F.xxhash64("df", "print", "place"))
    sizes = [F.count("*").over(Window.partitionBy("host", c)).alias(f"{c}_size") for c in ("whole", "part")]
    return kept.select("host", "token", "df", "whole", sizes[0], "part", sizes[1])


def orders(tokens: list[int], known: dict[int, tuple[int, int, int]]) -> dict[int, int | None]:
    """Class -> period of a page's tokens in it, None where they don't repeat one order or cross a class of more pages; ``known``: token -> (class, size, df)."""
    own: dict[int, list[int]] = defaultdict(list)
    left: dict[int, int] = {}  # tokens that an open instance lacks, outermost class first
    df: dict[int, int] = {}
    crossed = set()
    for t in tokens:
        if t not in known:
            continue
        c, size, pages = known[t]
        own[c].append(t)
        df[c] = pages
        if c in crossed or size == 1:
            continue
        if c not in left:
            left[c] = size - 1
            continue
        while (top := next(reversed(left))) != c:
            worse = top if df[top] <= pages else c
            crossed.add(worse)
            del left[worse]
            if worse == c:
                break
        if c in left:
            left[c] -= 1
            if not left[c]:
                del left[c]
    found: dict[int, int | None] = {}
    for c, seq in own.items():
        k = known[seq[0]][1]
        period = seq[:k]
        good = c not in crossed and len(set(period)) == k and seq == period * (len(seq) // k)
        found[c] = _token(*map(str, period)) if good else None
    return found


def _mapped(rows: DataFrame, known: DataFrame, prepare, use, schema: pa.Schema, ddl: str) -> DataFrame:
    """``use(columns, page_id, url, html, host, prepare(its host's rows of known))`` for all rows; ``known`` is a written table, a host's rows in it are bounded by the tokens of two pages."""
    spark, fields = rows.sparkSession, [c for c in known.columns if c != "host"]
    if known.count() <= BROADCAST_TOKENS:
        held: dict[str, list] = defaultdict(list)
        for r in known.collect():
            held[r.host].append(tuple(r[c] for c in fields))
        sent = spark.sparkContext.broadcast(dict(held))

        def run(batches):
            ready: dict = {}
            for batch in batches:
                cols: dict[str, list] = {f.name: [] for f in schema}
                for page_id, url, page in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    host = host_of(url)
                    if host not in ready:
                        ready[host] = prepare(sent.value.get(host, ()))
                    use(cols, page_id, url, page or "", host, ready[host])
                yield arrow_rows(schema, cols)

        return rows.mapInArrow(run, ddl)

    def run_joined(batches):
        for batch in batches:
            cols: dict[str, list] = {f.name: [] for f in schema}
            for page_id, url, page, own in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                use(cols, page_id, url, page or "", host_of(url), prepare([tuple(x[c] for c in fields) for x in own or ()]))
            yield arrow_rows(schema, cols)

    @F.pandas_udf("string")
    def hosts(urls: pd.Series) -> pd.Series:
        return urls.map(host_of)

    per_host = written(known.groupBy("host").agg(F.collect_list(F.struct(*fields)).alias("own")), "host-tokens")
    joined = rows.withColumn("host", hosts("url")).join(per_host, "host", "left")
    return joined.select("page_id", "url", "html", "own").mapInArrow(run_joined, ddl)


def template(rows: DataFrame) -> DataFrame:
    """(host, token) of the valid classes; of an invalid one those of its valid parts."""
    known = written(classes(rows), "token-classes")

    def prepare(own):
        return {t: (w, n, df) for t, df, w, n, _, _ in own}, {t: (p, n, df) for t, df, _, _, p, n in own}

    def use(cols, page_id, url, page, host, own):
        if not own[0]:
            return
        found = blocks(page)
        if all(r < 0 for r, _, _ in found):
            return
        tokens = tokens_of(found)
        for c, period in {**orders(tokens, own[0]), **orders(tokens, own[1])}.items():
            for col, v in zip(cols.values(), (host, c, period), strict=True):
                col.append(v)

    seen = _mapped(rows, known, prepare, use, _ORDER, "host string, class long, period long")
    valid = seen.groupBy("host", "class").agg(F.count_if(F.col("period").isNull()).alias("bad"), F.min("period").alias("a"), F.max("period").alias("b")).where("bad = 0 and a = b").select("host", "class")
    valid = written(valid, "valid-classes")
    of = [valid.select("host", F.col("class").alias(c), F.lit(True).alias(f"{c}_valid")) for c in ("whole", "part")]
    return known.join(of[0], ["host", "whole"], "left").join(of[1], ["host", "part"], "left").where("whole_valid or part_valid").select("host", "token")


def main_text(page: str | None, template: frozenset | set = frozenset()) -> str:
    """Blocks of a page's slots, one per line; without any, those of the article, else of the main region, else of the body."""
    found = blocks(page or "")
    if template:
        slots = [f[2] for f, token in zip(found, tokens_of(found), strict=True) if f[0] >= 0 and token not in template]
        if slots:
            return "\n".join(slots)
    top = max((r for r, _, _ in found), default=0)
    return "\n".join(t for r, _, t in found if r == top >= 0)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars: code points) of every row of pages (page_id, url, html).

    Null and empty pages have an empty text. Pages whose URL is null or has no host make up one host. A page whose
    blocks are all template text has no slots; it keeps its text. Other columns are ignored.
    """
    text_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    known = written(template(rows), "template-tokens")

    def use(cols, page_id, url, page, host, own):
        text = main_text(page, own)
        for col, v in zip(cols.values(), (page_id, url, text, len(text)), strict=True):
            col.append(v)

    return _mapped(rows, known, lambda own: frozenset(t for t, in own), use, _OUT, "page_id long, url string, text string, n_chars long")
