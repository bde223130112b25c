"""Source divergence, hard negatives and main text of pages: brute force and odd rows."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from firmscope.llm import divergence, hardneg, maintext

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- source divergence

def brute_audit(rows, min_docs=3, top=200):
    """``rows``: (text, lang, source)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        langs[lang].add(source)
        counts[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        v = len(kept)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        q = shares(whole)
        for a in sources:
            pairs = [(-sum((p[a][t] - p[b][t]) ** 2 // p[b][t] for t in kept), b.encode()) for b in sources if b != a]
            out += [(lang, a, "pair", b.decode(), -f, i + 1) for i, (f, b) in enumerate(sorted(pairs))]
            terms = [(-((p[a][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, a][t] and p[a][t] > q[t]]
            out += [(lang, a, "term", t.decode(), -f, i + 1) for i, (f, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def audited(df, **kw):
    got = divergence.audit(df, **kw)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in got.collect())


def test_audit_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 50)
    monkeypatch.setattr(divergence, "ROOM", 40)
    monkeypatch.setattr(divergence, "STEP", 7)
    monkeypatch.setattr(divergence, "DENSE", 12)
    rnd = random.Random(5)
    words = ["a", "The", "THE", "été", "Été", "été-x", "z9z", "don't", "日本", "it", "of", "rare"] + [f"w{c}" for c in "abcdefghijklm"]
    rows = []
    for i in range(160):
        lang, source = rnd.choice(["en", "de", "", None]), rnd.choice(["s1", "s2", "s3", "S1", "", None, "é"])
        some = rnd.sample(words, rnd.randint(2, len(words)))
        text = " ".join(rnd.choice(some) for _ in range(rnd.choice([0, 1, 3, 20, 200])))
        rows.append((rnd.choice([text, text, text, None]), lang, source))
    rows += [rows[0]] * 3 + [("only here", "xx", "a"), (None, "xx", "b"), ("", "yy", "c")]
    df = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], DOCS).repartition(5)
    assert audited(df) == brute_audit(rows)
    assert audited(df, min_docs=1, top_terms=2) == brute_audit(rows, 1, 2)


def test_audit_odd_tables(spark):
    assert audited(spark.createDataFrame([], DOCS)) == []
    # a group without terms has its pairs; a language that keeps no term has pairs of value 0
    rows = [("x x y", "en", "a"), ("x y", "en", "a"), ("x", "en", "b"), ("y", "en", "b"), ("", "en", "c"), ("solo", "fr", "a"), (None, "fr", "b")]
    extra = spark.createDataFrame([(*r, 7, "t", 1.0, [1]) for r in rows], "text string, lang string, source string, n long, term string, value double, p0 array<int>")
    got = audited(extra)
    assert got == brute_audit(rows)
    assert ("fr", "a", "pair", "b", 0, 1) in got and [g[:4] for g in got if g[:2] == ("en", "c")] == [("en", "c", "pair", "a"), ("en", "c", "pair", "b")]


def test_audit_one_group_with_a_third_of_the_rows(spark):
    rnd = random.Random(3)
    rows = [(" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(30)), "en", "hot" if i % 3 == 0 else f"s{i % 40}") for i in range(600)]
    assert audited(spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], DOCS)) == brute_audit(rows)


def test_terms_of_very_long_texts_are_not_cut(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    text = "abc défgh " * 500 + "x" * 100 + " end"
    assert [w for words in divergence.terms(text.encode()) for w in words] == [w.encode() for w in text.split()]
    assert list(divergence.terms(b"")) == []


# ---- hard negatives

def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def brute_negatives(rows, anchors=100):
    """``rows``: (vec_id, embedding, label), without nulls."""
    base = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, whole(v)) for i, v, lab in rows]
    out = []
    for i, lab, v in {(i, lab, tuple(v)) for i, lab, v in base}:
        if i is None or i % anchors:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j if j is not None else math.inf, m) for j, m, w in base if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == lab)[:5]:
            window = sorted(x[:2] for x in scored if x[2] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(window)]
    return sorted(tuple(math.inf if x is None else x for x in r) for r in out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hardneg.op12_rows(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(math.inf if x is None else x for x in r) for r in got.collect())


def test_negatives_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "SHARD", 60)
    monkeypatch.setattr(hardneg, "BLOCK", 3)
    rnd = random.Random(6)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(1200):
        c = rnd.choice(centres)
        v = [x + rnd.gauss(0, 0.05) for x in c] if i % 2 else [rnd.choice([0.0, 0.25, -0.5, rnd.gauss(0, 1)]) for _ in range(6)]
        rows.append((i, v, rnd.randrange(4)))
    rows += [(2000 + i, rows[i][1], rows[i][2]) for i in range(100)]  # ties
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_of_odd_vectors(spark):
    inf = float("inf")
    fine = [(0, [1.0, 2.0], 1), (1, [1.0, 1.0], 2), (2, [2.0, 2.0], 2), (3, [0.5, 0.5], 1), (3, [0.5, 0.5], 1), (4, [0.3, 0.3], 3), (4, [0.3, 0.3], 3),
            (5, [0.1, 0.1], 1), (None, [0.6, 0.6], 2), (6, [1.0], 2), (100, [0.0, 0.0], 2), (200, [-1.0, 0.0], 1), (200, [-1.0, 0.0], 1),
            (300, [1e6, 1.0], 5), (304, [1.2e6, 5.0], 5), (305, [9e5, 7.0], 6), (306, [3e37, 0.0], 3), (301, [2.0, 1.0], 6), (302, [1.0, 3.0], 5), (303, [1.0, 1.0], 5)]
    odd = [(8, None, 1), (9, [1.0, None], 1), (10, [inf, 1.0], 2), (11, [float("nan"), 1.0], 2), (12, [], 1), (13, [1.0, 2.0], None)]
    got = mined(spark, fine + odd)
    assert got == [r for r in brute_negatives(fine)]
    assert {r[0] for r in got} >= {0, 100, 300}
    assert mined(spark, odd) == [] and mined(spark, []) == []


@pytest.mark.parametrize("dim", [1, 2, 64])
def test_bounds_hold_every_score(dim):
    rnd = np.random.default_rng(dim)
    v = np.floor(256 * np.concatenate((rnd.normal(size=(300, dim)), np.zeros((2, dim)), np.ones((2, dim)) * 1e6, rnd.normal(size=(50, dim)) * 1e-2)))
    v = np.concatenate((v, v[:5], -v[:5]))
    refs = hardneg.spread_directions(v[:100], 8)
    rows = hardneg.Rows.__new__(hardneg.Rows)
    rows.vectors, rows.norms = v, np.linalg.norm(v, axis=1)
    rows.angles = np.arccos(np.clip((v @ refs.T) / np.where(rows.norms > 0, rows.norms, 1)[:, None], -1, 1)).T
    rows.slack = 8 * np.sqrt((dim + 8) * 2.0 ** -50)
    every = np.arange(len(v))
    pruned = 0
    for i in range(len(v)):
        low, high = rows.bounds(every, rows.norms[i], rows.angles[:, i])
        exact = v @ v[i]
        assert (low <= exact).all() and (exact <= high).all()
        pruned += (high < rows.norms[i] * rows.norms * 0.9).sum()
    assert dim > 2 or pruned > 0


# ---- main text of pages

def text(body, head=""):
    return maintext.main_text(f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>")


P1 = "The first paragraph is long enough to be taken for an article, with many words in it, and no links at all."
P2 = "A second one goes on for a good while too, so that the density of characters is high in it as well."


@pytest.mark.parametrize("furniture", [
    "<nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav>", "<header>My site, the best site of them all</header>", "<footer>&copy; somebody</footer>",
    "<aside><p>Something quite different that is long, long, long and has no links in it whatever.</p></aside>", '<div class="ad">Buy this now, it is cheap!</div>',
    '<div id="cookie-banner"><p>We use cookies for all kinds of things that we would rather not tell.</p></div>', "<form><p>Your name</p><input><textarea>x</textarea></form>",
    '<div class="commentList comments"><article class="comment"><p>I liked this a lot, and read it all the way through.</p></article></div>',
    "<script>var x = '<p>no</p>';</script>", "<style>p{}</style>", "<!-- <p>no</p> -->", '<div role="navigation">Here or there or anywhere else in the whole wide world</div>',
    "<noscript><p>Turn on scripts to see all of this page as it should be seen by you.</p></noscript>"])
def test_furniture_goes_with_and_without_an_article_element(furniture):
    inner = f"<h1>A title</h1><p>{P1}</p><p>{P2}</p><p>Short.</p>"
    want = f"A title\n{P1}\n{P2}\nShort."
    for box in ("article", "main", "div", "section"):
        assert text(f"{furniture}<{box}>{inner}</{box}>{furniture}") == want
    assert text(f"<article><h1>A title</h1><p>{P1}</p>{furniture}<p>{P2}</p><p>Short.</p></article>") in (want, want if "<header>" not in furniture else want.replace(P2, "My site, the best site of them all\n" + P2))


def test_menus_without_any_hint_have_low_density():
    menu = "<div>" + "".join(f'<a href="/{i}">Page number {i}</a> ' for i in range(12)) + "</div>"
    article = f"<div><p>{P1}</p><p>{P2} <a href=x>A link</a> in it.</p><ul><li>one point<li>another</ul><blockquote>{P1}</blockquote></div>"
    assert text(f"<div>{menu}<div>{article}{menu}</div>{menu}</div>") == f"{P1}\n{P2} A link in it.\none point\nanother\n{P1}"


def test_blocks_references_and_white_space():
    assert text("<p>a &amp; b&nbsp;&lt;c&gt; &eacute;&#233;&#xE9; &am &copy;\n\t x<br>y <b>bo</b>ld</p><p>  </p><div>one<p>two</p>three</div>") \
        == "a & b <c> ééé &am © x y bold\none\ntwo\nthree"
    assert text("<p>&#99999999999999999999; &#0000000000000065; &#x110000; &#xD800;</p>") == "� A � �"
    assert text("<p>&#" + "9" * 5000 + ";</p>") == "�"
    assert text("<table><tr><td>a<td>b<tr><td>c</table><dl><dt>t<dd>d</dl>") == "a\nb\nc\nt\nd"


@pytest.mark.parametrize("html, want", [
    ("", ""), ("plain text only", "plain text only"), ("<", "<"), ("a < b and 1<2", "a < b and 1<2"), ("<p>cut off <b", "cut off"), ("<p>x<!-- open", "x"),
    ("<p><b>one<br><p>two</p>", "one\ntwo"), ("</div></p>x", "x"), ("<HTML><BODY><P>Up</P></BODY></HTML>", "Up"), ("<script>never closed <p>x", ""),
    ("<head><title>t</title><p>no body tag</p>", "no body tag"), ("<p title='a>b'>q</p>", "q"), ("<p>a</p><!--><p>b</p>", "a\nb"),
    ("<div class='page has-sidebar'><p>kept</p></div>", "kept"), ("<form><article><p>in a form</p></article></form>", "in a form")])
def test_malformed_pages(html, want):
    assert maintext.main_text(html) == want


@pytest.mark.parametrize("piece", ["<", "<div>", "<p>", "<a ", '<a x="', "<!--", "&", "<ul><li>", "<table><tr><td>", "</p>", "<b>x", "<p>x<b>"])
def test_time_grows_with_length_only(piece):
    t = time.time()
    maintext.main_text("<body>" + piece * 50_000 + "</div>" * 10_000)
    assert time.time() - t < 10


def test_extract_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", f"<article><p>{P1}</p></article>", "old", "x"), (1, "u", f"<article><p>{P1}</p></article>", "old", "x"), (None, None, None, None, None), (2, None, "é", "a", "b")]
    got = maintext.op13_rows(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, "u", P1, len(P1))] * 2 + [(None, None, "", 0), (2, None, "é", 1)], key=str)
    assert maintext.op13_rows(spark.createDataFrame([], schema)).count() == 0
