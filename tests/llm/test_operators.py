"""The training-data operators against brute force, round trips and held-out labels."""

import base64
import binascii
import collections
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorebase.llm import arrays, bitcodes, blocks, byte_bpe, components, decontaminate, hostgraph, interpolation, jaccard, licences, pathratio, repeats, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def split(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def corpus(n=60, seed=5):
    """Small texts with copies, near copies, shared passages, ties, nulls and odd rows."""
    rng = np.random.default_rng(seed)
    vocab = ["w%d" % i for i in range(40)] + ["The", "of", "É", "日本", "x" * 30]
    texts = [" ".join(rng.choice(vocab, int(rng.integers(1, 70)))) for _ in range(n)]
    passage = " ".join(rng.choice(vocab, 60))
    texts += [texts[3], texts[3], texts[4] + " w1", f"{texts[5]}\n{passage}\n{texts[6]}", f"{passage} {texts[7]}", passage, None, "", " \n\t ", "one", "one two", "ONE two", "a  b c", "tail " * 200]
    for i in range(30):
        near = texts[8].split() * 4
        near[i % len(near)] = f"new{i}"
        texts.append(" ".join(near))
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_agree_with_the_pattern():
    texts = ["", " a bb\tccc\x0b\x0cd ", None, "É x \x1cy", "z" * 10, "A a"]
    got = arrays.words_of(pa.array(texts))
    assert got.counts().tolist() == [len(split(t)) for t in texts]
    spans = [got.data[s:e].tobytes().decode() for s, e in zip(got.starts, got.ends, strict=True)]
    assert spans == [w for t in texts for w in split(t, False)]
    assert got.hashes[0] == got.hashes[-1] == got.hashes[-2] and len(set(got.hashes.tolist())) == len(got.hashes) - 2


def test_words_do_not_depend_on_slices(monkeypatch):
    texts = pa.array([" ".join("word%d" % i for i in range(300)), "y" * 500, "", "a b " * 100])
    whole = arrays.words_of(texts)
    monkeypatch.setattr(arrays, "SLICE", 64)
    cut = arrays.words_of(texts)
    assert (whole.hashes == cut.hashes).all() and (whole.starts == cut.starts).all() and (whole.offsets == cut.offsets).all()


def test_packed_numbers_round_trip():
    for numbers in ([], [0], [0, 0], [1, 255, 256], [1 << 40, 3]):
        assert blocks.unpacked(memoryview(blocks.packed(np.array(numbers, np.int64)))).tolist() == numbers


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    edges = [(i, i + 1) for i in range(1, 20)] + [(50, 40), (60, 60)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 1 for i in range(1, 21)}, 40: 40, 50: 40}


# --- byte-level BPE ---------------------------------------------------------------


def reference_encoding():
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    return p, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_agrees_with_the_library(spark, data):
    p, library = reference_encoding()
    odd = ["aaaaaaaaaaaaa" * 9, "!!!???  \n\n  ", "日本語 😀😀 <|endoftext|>", None, "", "x" * 3000, "ababababab", "it's WE'LL 123 45"]
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", F.lit(1).alias("ids")).union(spark.createDataFrame([(-i - 1, t, 1) for i, t in enumerate(odd)], "doc_id long, text string, ids int"))
    got = {r.doc_id: r for r in byte_bpe.encode(docs, p.path("byte_bpe_50k.tiktoken"), p.PATTERN).collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        mine = got[r.doc_id]
        assert mine.ids == ids and mine.n_tokens == len(ids)
        assert mine.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert mine.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(docs, p.path("byte_bpe_50k.tiktoken"), p.PATTERN), p.path("byte_bpe_50k.tiktoken")).collect()
    assert all(bytes(r.decoded).decode() == (t or "") for r, t in ((r, {d.doc_id: d.text for d in docs.collect()}[r.doc_id]) for r in back))


def test_bpe_replay_of_overlaps_and_late_merges():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"aa": 257, b"aaa": 258, b"bc": 259, b"abc": 260, b"xab": 250 + 11}
    m = byte_bpe.Merges(ranks)
    found = [b"aaaaaaa", b"aabaab", b"abcabc", b"xabab", b"aaab" * 20, b"cba"]
    assert m.replay(found) == [m.one(x) for x in found]


def test_bpe_empty(spark, empty):
    p, _ = reference_encoding()
    assert byte_bpe.encode(empty, p.path("byte_bpe_50k.tiktoken"), p.PATTERN).count() == 0


# --- n-gram Jaccard join -------------------------------------------------------------


def jaccard_brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = split(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard_groups(spark, docs, monkeypatch, k, percent):
    monkeypatch.setattr(jaccard, "SHORT", 3)
    monkeypatch.setattr(jaccard, "PART", 2)
    monkeypatch.setattr(components, "SMALL", 0 if k == 5 else 1000)
    want = jaccard_brute([(r.doc_id, r.text) for r in docs.collect()], k, percent)
    got = jaccard.groups(docs, k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want)


def test_jaccard_edges(spark, empty):
    assert jaccard.groups(empty, 3, 90).count() == 0
    odd = spark.createDataFrame([(None, "a b c d", "", "", 0), (1, "a b c d", "", "", 0), (1, "a b c d", "", "", 0), (2, "z z z z z", "", "", 0), (1, "z z z z z", "", "", 0)], DOCS)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.groups(odd, 3, 90).collect()), key=str)
    assert got == sorted([(None, 2, 1), (1, 2, 1), (1, 2, 1), (2, 1, 1), (1, 1, 1)], key=str)


def test_one_of_each(spark, docs):
    kept = jaccard.one_of_each(docs, 5, 80)
    want = jaccard_brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c) and kept.columns == docs.columns


# --- substring deduplication -----------------------------------------------------------


def repeats_brute(rows, window):
    first, out = {}, {}
    for i, t in rows:
        w = split(t, False)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            g = tuple(w[j : j + window])
            if first.setdefault(g, (i, j)) < (i, j):
                gone[j : j + window] = [True] * window
        out[i] = len(w), sum(gone), " ".join(a for a, b in zip(w, gone, strict=True) if not b)
    return out


@pytest.mark.parametrize("window", [20, 50, 4])
def test_repeats(spark, docs, window):
    want = repeats_brute(sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: x[0]), window)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in repeats.without_repeats(docs, window).collect()}
    assert got == want


@pytest.mark.parametrize("window", [20, 4])
def test_repeats_are_maximal(docs, window):
    rows = {r.doc_id: split(r.text, False) for r in docs.collect()}
    first = {}
    for i in sorted(rows):
        for j in range(len(rows[i]) - window + 1):
            first.setdefault(tuple(rows[i][j : j + window]), (i, j))
    got = repeats.without_repeats(docs, window).collect()
    assert sum(len(r.repeats) for r in got) > 10
    for r in got:
        w, gone = rows[r.doc_id], set()
        for x in r.repeats:
            s, n, t = x.start, x.length, rows[x.source_id]
            assert n >= window and w[s : s + n] == t[x.source_start : x.source_start + n] and (x.source_id, x.source_start) < (r.doc_id, s)
            for j in (s - 1, s + n - window + 1):  # one word further is another source's, or no repeat
                g = tuple(w[j : j + window]) if j >= 0 else ()
                assert len(g) < window or first[g] != (x.source_id, x.source_start + j - s)
            gone |= set(range(s, s + n))
        assert len(gone) == r.n_removed


def test_repeats_cut_keeps_layout(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, f"a  b\n{passage}\nc", "en", "s", 1), (2, f"x  y\n{passage}\n\nz", "de", "t", 1), (3, None, None, None, None), (None, passage, "fr", "u", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.text, r.lang) for r in repeats.without_repeats(df, 20, cut=True, keep=("lang", "source")).collect()}
    assert got == {1: (rows[0][1], "en"), 2: ("x  y\nz", "de"), 3: ("", None)} | {None: ("", "fr")}


def test_repeats_empty(empty):
    assert repeats.without_repeats(empty).count() == 0


# --- decontamination ----------------------------------------------------------------------


def test_decontamination_against_brute_force(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "benchmark"))
    plain = lambda s: re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (s or "").translate(LOWER))
    grams = lambda w: collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])
    tests = {r.item_id: plain(r.text) for r in items.collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    first = rows[0][1].split()
    near = tests[0].copy()
    near[-1] = "other"
    rows += [(10_001, " ".join(first[:40] + tests[0] + first[40:50])), (10_002, " ".join(first[:9] + near)), (10_003, "**" + "** **".join(tests[1]) + "**"), (10_004, None), (10_005, "")]
    want = {}
    for i, t in rows:
        w = plain(t)
        for item, x in tests.items():
            n, g = len(x), grams(x)
            if len(set(w) & set(x)) < 0.5 * len(set(x)):
                continue
            for s in range(len(w) - n + 1):
                c = grams(w[s : s + n])
                both = sum((c & g).values())
                if both / (2 * sum(g.values()) - both) >= 0.8:
                    want[i, item] = max(want.get((i, item), 0), both / (2 * sum(g.values()) - both))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(df, items).collect()}
    assert got == pytest.approx(want) and (10_001, 0) in got and (10_003, 1) in got
    left = {r.doc_id for r in decontaminate.clean(df, items).collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.matches(df, items, slice_items=7).count() == len(want)
    assert decontaminate.matches(df, items.limit(0)).count() == 0 and decontaminate.matches(df.limit(0), items).count() == 0


def test_hamming_index_finds_all_within_its_radius():
    rng = np.random.default_rng(1)
    index = decontaminate.Index([(i, " ".join(f"t{i}x{j}" for j in range(20))) for i in range(30)])
    for _ in range(200):
        i, flips = int(rng.integers(30)), rng.choice(64, int(rng.integers(0, decontaminate.RADIUS + 1)), replace=False)
        value = index.prints[i]
        for b in flips:
            value ^= np.uint64(1) << np.uint64(b)
        assert (0, i) in index.lookup(np.array([value]), np.array([20]))


# --- toxicity ----------------------------------------------------------------------------


def test_marginals_agree_with_enumeration():
    rng = np.random.default_rng(2)
    e, move = rng.normal(size=7), rng.normal(size=(2, 2))
    offsets = np.array([0, 3, 3, 7])
    _, _, p = toxicity.marginals(e, offsets, move)
    want = np.zeros(7)
    for a, b in ((0, 3), (3, 7)):
        total = 0.0
        for state in range(1 << (b - a)):
            y = [(state >> i) & 1 for i in range(b - a)]
            w = math.exp(sum(e[a + i] * v for i, v in enumerate(y)) + sum(move[y[i], y[i + 1]] for i in range(len(y) - 1)))
            total += w
            want[a:b] += np.array(y) * w
        want[a:b] /= total
    assert p == pytest.approx(want)


def test_toxicity_held_out(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{n}.parquet") for n in ("documents", "labels"))
    out = toxicity.judged(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").select("predicted", "toxic", "score").collect()
    found = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    wrong = sum(r.predicted for r in rows if not r.toxic) / sum(1 - r.toxic for r in rows)
    assert found >= 0.75 and wrong <= 0.02 and all(0 <= r.score <= 1 for r in rows)
    assert all((binascii.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in out.select("doc_id", "held_out").limit(50).collect())
    kept = toxicity.without_toxic(docs, labels)
    assert kept.count() == out.where("predicted = 0").count() and kept.columns == docs.columns


def test_toxicity_spans_and_edges(spark, empty):
    rows = [(i, ("Éa lovely day with tea " * 3) + (f"word{i} vile{i % 4} word{i + 1} " if i % 2 else f"word{i} nice word{i + 1} ") + "end", "en", "s", 0) for i in range(120)]
    docs = spark.createDataFrame([*rows, (500, None, "", "", 0), (501, "", "", "", 0)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1), (500, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert got[1].score > 0.7 > got[2].score and got[500].score == got[501].score < 0.5
    start, end = got[1].spans[0]
    assert rows[1][1][start:end] == "vile1" and not got[2].spans
    assert toxicity.fit(docs, labels.limit(0)) is None and toxicity.judged(empty, labels).count() == 0
    assert {r.score for r in toxicity.scored(docs, None).collect()} == {0.0}


# --- URL verdicts ----------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    urls = ["https://A.Example.NET/en/x?q#f", "http://example.net", "ftp://x.net/y", "http://fr.org/fr/", "http://notnet/", "http://a.example.com/de/1", "no scheme", None, "http://h?://net/", "http://xexample.net/en/", "://net/"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = [tuple(r) for r in hostgraph.judge(pages).orderBy("page_id").select("host", "path", "rule").collect()]
    assert got == [
        ("a.example.net", "/en/x", "example.net/en/"), ("example.net", "", None), ("x.net", "/y", "net/"), ("fr.org", "/fr/", "org/fr/"), ("notnet", "/", None), ("a.example.com", "/de/1", "example.com/de/"),
        ("", "", None), ("", "", None), ("h", "", None), ("xexample.net", "/en/", "net/"), ("net", "/", "net/"),
    ]


def test_trust_flows_along_links_and_distrust_against(spark):
    link = lambda *hosts: "".join(f'<a class="x" href="http://{h}/p">t</a>' for h in hosts)
    pages = [(1, "http://good.org/fr/a", link("friend.info")), (2, "http://farm.info/a", link("bad.net", "worse.net")), (3, "http://bad.net/a", link("worse.net")), (4, "http://friend.info/a", ""), (5, "http://worse.net/", ""), (6, "http://lone.info/", link("lone.info")), (7, "http://lone.info/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in hostgraph.judge(df).collect()}
    hosts = ["good.org", "farm.info", "bad.net", "friend.info", "worse.net", "lone.info"]
    edges = {("good.org", "friend.info"): 1, ("farm.info", "bad.net"): 1, ("farm.info", "worse.net"): 1, ("bad.net", "worse.net"): 1}

    def brute(seed, flip):
        mass = dict(seed)
        for _ in range(60):
            new = {h: 0.15 * seed[h] for h in hosts}
            for (a, b), n in edges.items():
                s, t = (b, a) if flip else (a, b)
                total = sum(w for (x, y), w in edges.items() if (y if flip else x) == s)
                new[t] += 0.85 * mass[s] * n / total
            mass = new
        return mass

    trust = brute({h: float(h == "good.org") for h in hosts}, False)
    distrust = brute({h: float(h.endswith(".net")) for h in hosts}, True)
    for r in got.values():
        assert (r.trust, r.distrust) == pytest.approx((trust[r.host], distrust[r.host]), abs=1e-4)
    assert got[2].verdict == "block" and got[4].verdict == got[6].verdict == "allow" and len(got) == 7
    assert hostgraph.judge(df.limit(0)).count() == 0


# --- HTML extraction ---------------------------------------------------------------------------


def test_extraction_cases():
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><a>m</a></nav><div class="ad">Buy.</div><article><h1>Head &amp; more</h1><p><b>Bold, start.<br><p>Second  line\nof <i>text</i>.</p><div class="comments"><p>Nice.</p></div></article><footer>&copy; x</footer>'
    assert pathratio.extract(page) == "Head & more\nBold, start.\nSecond line of text."
    body = "This is a long sentence, with punctuation; and it goes on for a while. " * 3
    plain = f'<div><a href="/">Home</a> <a href="/b">About</a></div><div><p>{body}</p><p>Short.</p><p>{body}</p></div><div class="sidebar">{body}</div><script>var x="<p>no</p>";</script>'
    assert pathratio.extract(plain) == f"{body.strip()}\nShort.\n{body.strip()}"
    assert pathratio.extract(None) == pathratio.extract("") == pathratio.extract("<nav>x</nav>") == ""
    assert pathratio.extract("<article><p>cut off &amp") == "cut off &" and pathratio.extract("<article><p>cut <b") == "cut"


@pytest.mark.parametrize("tag", ["article", "main"])
def test_extraction_of_a_body_beside_a_teaser(tag):
    body = "This is a long sentence, with punctuation; and it goes on for a while. " * 3
    page = f'<nav><a href="/">Home</a></nav><{tag}><p>A teaser.</p></{tag}><div><p>{body}</p><p>{body}</p></div><div><a href="/a">More</a> <a href="/b">links</a></div>'
    assert pathratio.extract(page).endswith(f"{body.strip()}\n{body.strip()}") and "links" not in pathratio.extract(page)


def test_extraction_without_marked_articles(spark, data):
    """The ratios find the same text where nothing marks the article."""
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        plain = re.sub(r"(</?)(?:article|main)\b", r"\1div", r.html)
        assert "<article" not in plain and pathratio.extract(plain) == pathratio.extract(r.html)


def test_tag_path_ratios_against_a_plain_computation():
    html = "<div><p>One, two. <i>three</i></p><p>Four; five!</p></div><ul><li><a href=x>six</a></li><li>seven</li></ul>"
    page = pathratio.Page(html)
    blocks = pathratio.blocks_of(page)
    assert ["".join(b.texts) for b in blocks] == ["One, two. three", "Four; five!", "six", "seven"]
    fused = lambda n, p, c: n / c * (1 + math.log1p(p / c))
    p, i, li = fused(9 + 11, 2 + 2, 2), fused(5, 0, 1), fused(5, 0, 1)
    raw = [(9 * p + 5 * i) / 14, p, 0.0, li]
    kernel = lambda d: math.exp(-d * d / 2)
    want = [sum(raw[j] * kernel(j - x) for j in range(max(0, x - 2), min(4, x + 3))) / sum(kernel(j - x) for j in range(max(0, x - 2), min(4, x + 3))) for x in range(4)]
    assert pathratio.smoothed_ratios(blocks) == pytest.approx(want)


def test_extraction_of_deep_and_long_pages():
    deep = pathratio.extract("<div>text, here. " * 20_000)
    assert deep.count("\n") == 19_999
    long = "<article><p>" + "A sentence, with a stop. " * 100_000 + "</p><p>End of it.</p></article>"
    assert pathratio.extract(long).endswith("End of it.")


def test_extraction_of_whole_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    texts = {" ".join(r.text.split()) for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()}
    got = pathratio.main_text(pages).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) for r in got)
    assert all(" ".join(r.text.split("\n", 1)[-1].split()) in texts for r in got)


LONG = "A sentence of the article, with commas, and a full stop at its end. " * 5


@pytest.mark.parametrize("wrapper", ['div class="content with-sidebar"', 'div id="page" class="no-sidebar"', 'div class="post has-comments"', 'div class="share-holder-report"', 'div class="sidebar"', 'section id="form"'])
def test_classes_of_layout_keep_the_article(wrapper):
    tag = wrapper.split()[0]
    page = f'<html><body><nav>Home</nav><{wrapper}><h1>Title of it</h1><p>{LONG}</p><p>{LONG}</p></{tag}><div class="left-sidebar-2"><p>Other links and more</p></div><div id="site-footer">Imprint here</div></body></html>'
    assert pathratio.extract(page) == f"Title of it\n{LONG.strip()}\n{LONG.strip()}"


@pytest.mark.parametrize("named", ["sidebar", "main-nav", "site_footer", "comments", "comment-list", "post-comments", "cookie-banner", "ad", "ad-slot-3", "newsletter-signup", "widget widget-area", "breadcrumbs"])
def test_named_parts_go(named):
    page = f'<body><div class="x"><p>{LONG}</p><p>{LONG}</p><div class="{named}"><p>Part that goes, with some text, of a kind. {LONG[:60]}</p></div></div></body>'
    assert pathratio.extract(page) == f"{LONG.strip()}\n{LONG.strip()}"


@pytest.mark.parametrize("element", ["<video-player></video-player>", "<svg-icon></svg-icon>", "<svg/>", "<svg viewBox='0 0 1 1' />", "<svg><title>x</title><path d='M0'/></svg>", "<script-like>", "<object-x/>", "<annotation/>"])
def test_raw_elements_are_whole_names_and_may_end_themselves(element):
    page = f"<body>{element}<div><p>{LONG}</p>{element}<p>{LONG}</p></div></body>"
    assert pathratio.extract(page) == f"{LONG.strip()}\n{LONG.strip()}"


def test_formulas_are_text():
    page = f"<body><div><p>{LONG}</p><p>Here <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation encoding='tex'>x+1</annotation></math> is a sum. {LONG}</p></div></body>"
    assert pathratio.extract(page) == f"{LONG.strip()}\nHere x+1 is a sum. {LONG.strip()}"


# --- licences ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("said", "names"),
    [
        ("x\nLicensed under the Apache License, Version 2.0.\ny", ["apache-2.0"]),
        ("Released under the MIT License.", ["mit"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3"]),
        ("Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]),
        ("// SPDX-License-Identifier: BSD-3-Clause", ["bsd-3-clause"]),
        ("Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that: 1. Redistributions of source code must retain the above copyright notice. 2. Redistributions in binary form must reproduce the above copyright notice. Neither name may be used to endorse or promote products derived from this software.", ["bsd-3-clause"]),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. It is distributed in the hope that it will be useful. You should have received a copy of the GNU General Public License.", ["gpl-3-or-later"]),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following holds. Redistributions of source code must retain the above copyright notice. Redistributions in binary form must reproduce the above copyright notice.", ["bsd-2-clause"]),
        ("GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1", ["lgpl-2.1"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy is missing, ask.", ["mpl-2.0"]),
        ("GNU Lesser General Public License, v. 2.1", ["lgpl-2.1"]),
        ("Released under the GNU General Public License. Version 3 of the tool is new.", ["gpl"]),
        ("Licensed under the Boost Software License 1.0.", ["bsl-1.0"]),
        ("Licensed under EUPL-1.2", ["eupl-1.2"]),
        ("SPDX-License-Identifier: Apache-2.0 OR MIT", ["apache-2.0", "mit"]),
        ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", ["ofl-1.1"]),
        ("subject to the terms of the Common Development and Distribution License, ver. 1.0", ["cddl-1.0"]),
        ("Everyone is permitted to copy. The licenses for most software are designed to take away your freedom to share and change it.", ["gpl-2"]),
        ("Do What The Fuck You Want To Public License. 0. You just DO WHAT THE FUCK YOU WANT TO.", ["wtfpl"]),
        ("permission slip, no licence", []),
        ("", []),
        (None, []),
    ],
)
def test_licences(said, names):
    assert list(dict.fromkeys(m.licence for m in licences.licences(pa.array([said], pa.string()))[0][0] if m.licence != "unmatched")) == names


@pytest.mark.parametrize(
    ("said", "names"),
    [
        ("Released under the GNU GPL v2.", ["gpl-2"]),
        ("This module uses GPLv3.", ["gpl-3"]),
        ("Licensed under CC BY-NC 4.0. Its tools use GPLv3.", ["cc-by-nc-4.0", "gpl-3"]),
        ("It is dedicated to the public\ndomain.", ["public-domain"]),
        ("# All rights\n# reserved.", ["all-rights-reserved"]),
        ("Under Creative\nCommons Attribution 4.0.", ["cc-by-4.0"]),
        ("Under CC\nBY 4.0.", ["cc-by-4.0"]),
    ],
)
def test_licences_without_plain_trigger_words(said, names):
    assert list(dict.fromkeys(m.licence for m in licences.licences(pa.array([said], pa.string()))[0][0] if m.licence != "unmatched")) == names


@pytest.mark.parametrize("said", ["Released under GNU GPL v3.", "This code is GPLv3.", "This program is free software.", "Distributed in the hope that it will be useful.", "May not be used to endorse or promote products derived from this software."])
def test_single_sentences_are_recognised(said):
    (found, n), (none, zero) = licences.licences(pa.array([f"É before.\n\n{said} After.", None]))
    assert n >= 1 and zero == 0 and not none
    text = f"É before.\n\n{said} After."
    assert text[found[0].start : found[-1].end].lower() in said.lower()


def test_every_known_sentence_is_recognised_however_it_is_wrapped():
    listed = list(licences.known_sentences())
    for gap in (" ", "\n", "\r\n\t", "\n# ", "\n * ", "\u00a0", " \u201c"):
        said = pa.array([gap.join(["the", *re.sub(r"[.](?= )", "", t).split(), "x"]) for _, t in listed])
        for (name, t), found in zip(listed, licences.recognised(licences.hashed(said)), strict=True):
            assert found, (name, t, gap)


def test_sentences_do_not_run_across_stops_and_rules_reach_as_far_as_needed():
    one = licences.licences(pa.array(["All rights. Reserved seats.", "all rights\n\nreserved", "permission is hereby granted, free of charge, to any person obtaining a copy of this software. " + "Other words stand here. " * 500 + "The above copyright notice and this permission notice shall be included in all copies."]))
    assert [n for _, n in one] == [0, 0, 2] and [m.licence for m in one[2][0]] == ["mit"]


def licence_brute(text):
    """The longest known sentences first, on word lists, sentence by sentence."""
    plain = lambda t: [{"licence": "license", "licenced": "licensed"}.get(w, w) for w in re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", re.sub(licences.MARKS, " ", t).translate(LOWER))]
    table = {tuple(plain(t)): name for name, t in licences.known_sentences()}
    out = []
    for part in re.split(r"(?<=[.!?])(?<![^0-9A-Za-z\x80-\U0010ffff][Vv][.])(?<!^[Vv][.])(?<![^0-9A-Za-z\x80-\U0010ffff][Vv][Ee][Rr][.])[ \t\r\n\x0b\x0c]|\n[ \t\r\x0b\x0c]*\n", text or ""):
        w = plain(part)
        spans = sorted(((j, i) for i in range(len(w)) for j in range(1, min(30, len(w) - i) + 1) if tuple(w[i : i + j]) in table), key=lambda x: (-x[0], x[1]))
        free = [True] * len(w)
        mine = []
        for n, i in spans:
            if all(free[i : i + n]):
                free[i : i + n] = [False] * n
                mine.append((i, table[tuple(w[i : i + n])]))
        out += [name for _, name in sorted(mine)]
    return out


def test_licence_sentences_against_brute_force(spark, data):
    rng = np.random.default_rng(4)
    listed = [t for _, t in licences.known_sentences()]
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(60).collect()]
    texts += ["".join(str(rng.choice([*rng.choice(listed, 3), "word", "the", "license", "all rights"])) + str(rng.choice([" ", ". ", "\n", "\n\n", ", "])) for _ in range(12)) for _ in range(120)]
    got = licences.recognised(licences.hashed(pa.array(texts)))
    assert [[name for _, _, name in x] for x in got] == [licence_brute(t) for t in texts]


def test_licence_scan_keeps_rows(spark, docs, empty):
    more = docs.union(spark.createDataFrame([(900, "a. Released under the MIT License. b", "", "", 0)] * 2, DOCS))
    got = licences.scan(more)
    assert got.count() == more.count() and got.where("doc_id = 900").first().licences == ["mit"] and licences.scan(empty).count() == 0


# --- language model ------------------------------------------------------------------------------


def test_language_model(spark, docs, empty):
    held = F.col("doc_id") % 5 == 1
    got = {r.doc_id: r for r in interpolation.scores(docs, held).collect()}
    rows = [(r.doc_id, split(r.text) + [None]) for r in docs.collect()]
    uni, bi, starts = collections.Counter(), collections.Counter(), 0
    for i, t in rows:
        if i % 5 != 1:
            uni.update(t)
            bi.update(zip(["<s>", *t], t, strict=False))
            starts += 1
    total, types = sum(uni.values()), len(uni)
    for i, t in rows:
        r = got[i]
        base = sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (types + 1))) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(uni[w] > 0 for w in t), total, i % 5 == 1)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)
    assert interpolation.scores(empty, held).count() == 0
    untrained = interpolation.scores(docs, F.lit(True)).where("doc_id = 0").first()
    assert untrained.train_tokens == 0 and untrained.n_known == 0


def test_scores_against_a_plain_model(spark, docs, monkeypatch):
    """The mixture by its definition, with weights that the context's count chooses."""
    weights = np.array([[0.0, 0.7, 0.3]] + [[0.1 + 0.01 * b, 0.6 - 0.01 * b, 0.3] for b in range(1, interpolation.CONTEXTS)])
    monkeypatch.setattr(interpolation, "learn", lambda *_: weights)
    rows = [(r.doc_id, split(r.text) + ["</s>"]) for r in docs.collect()]
    uni, bi, starts = collections.Counter(), collections.Counter(), 0
    for i, t in rows:
        if i % 5 != 1:
            uni.update(t)
            bi.update(zip(["<s>", *t], t, strict=False))
            starts += 1
    total, types = sum(uni.values()), len(uni)
    got = {r.doc_id: r.score for r in interpolation.scores(docs, F.col("doc_id") % 5 == 1).collect()}
    for i, t in rows:
        want = 0.0
        for a, b in zip(["<s>", *t], t, strict=False):
            n = starts if a == "<s>" else uni[a]
            w = weights[0 if n == 0 else min(int(math.log2(n)) + 1, interpolation.CONTEXTS - 1)]
            want += math.log10(w[0] * (bi[a, b] / n if n else 0) + w[1] * uni[b] / total + w[2] / (types + 1))
        assert got[i] == pytest.approx(want)


def test_weights_are_learnt_and_sum_to_one():
    cells = np.array([(1 * interpolation.STEPS + 8) * 64 + 3, (1 * interpolation.STEPS + interpolation.STEPS - 1) * 64 + 3])
    w = interpolation.learn(cells, np.array([900.0, 100.0]), 1000, 50)
    assert w.sum(1) == pytest.approx(np.ones(len(w))) and w[1, 0] > 0.8 and w[0, 0] == 0


# --- nearest neighbours --------------------------------------------------------------------------


def test_neighbours_against_brute_force(spark, data):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 16)))]
    same = [float(x) for x in rng.normal(size=16)]
    vectors += [(1000 + i, same) for i in range(30)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [1.0, 2.0]), (2005, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, rank int")
    asks = df.where("vec_id % 100 = 0")
    got = collections.defaultdict(list)
    for r in bitcodes.nearest(df, asks, 10, chunk=64, block=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r["rank"]))
    usable = {i: np.array(v) for i, v in vectors if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    want = {q: sorted((float(np.linalg.norm(usable[q] - v)), i) for i, v in usable.items() if i != q)[:10] for q in usable if q % 100 == 0}
    assert set(got) == set(want)
    assert np.mean([len({i for _, i in want[q]} & {i for i, _, _ in got[q]}) / 10 for q in want]) >= 0.9
    assert [i for i, _, _ in got[1000]] == list(range(1001, 1011)) and all([x[2] for x in v] == list(range(1, len(v) + 1)) for v in got.values())
    assert bitcodes.nearest(df.limit(0), asks, 10).count() == 0


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    found = collections.defaultdict(set)
    for r in bitcodes.nearest(df, df.where("vec_id % 100 = 0"), 10).collect():
        found[r.query_id].add(r.vec_id)
    recall = []
    for q in ids[ids % 100 == 0]:
        d = np.linalg.norm(x - x[ids == q], axis=1)
        best = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        recall.append(len(found[q] & set(best)) / 10)
    assert np.mean(recall) >= 0.9


# --- pipeline -------------------------------------------------------------------------------------


def test_pipeline_stages(spark, data):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.tables.settle(stage(spark, docs, data))
        assert docs.columns == list(pipeline.COLUMNS), name
        assert 0 < docs.count() <= before
        before = docs.count()
    out = pipeline.run(spark, data)
    assert out.count() == before and {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
