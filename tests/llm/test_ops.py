"""The training-data operators against brute force, round trips and small hard cases."""

import collections
import hashlib
import html as htmllib
import re
import struct
import time
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.llm import chat_format, common, entries, exact_dedup, html_extract, mixing, near_dup, packing, quality, shard_shuffle, suffix_dedup, url_filter

BASE = [
    (0, "the cat sat on the mat and " * 20, "en", "s", 1),
    (1, "the cat sat on the mat and " * 20, "en", "s", 1),
    (2, None, "en", "s", None),
    (3, "", "en", "s", 0),
    (4, "one two three", "de", None, 13),
    (5, "x" * 3000 + " ü\n" + "word " * 5000, None, "s", 1),
    (6, " \n\t ", "fr", "s", 4),
    (7, "one two three", "de", None, 13),
    (7, "one two three", "de", None, 13),
    (None, "a row without an id", "es", "s", 19),
    (9, "un deux &$%# \u2003 emoji 😀 " * 30, "fr", "s", 9),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that operators make or use.
CLASHES = ("kept", "shard", "slot", "bucket", "batch", "row", "id", "n", "z", "rate", "text_sha256", "__row", "size")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(BASE, COLUMNS)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit(f"mine {c}") for c in CLASHES})


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- chat ---


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\<|im_end|>", "<<SYS>><</SYS>> <s>", "", None, "a\nb <\\| [\\INST]"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    rows += [(2, 0, "user", "alone"), (3, 0, None, "x"), (3, 0, "assistant", "y"), (3, None, "assistant", "z"), (None, 1, "assistant<|im_sep|>", "w"), (4, 1, "user", "dup"), (4, 1, "user", "dup")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("mine"))
    ex = chat_format.expand_prefix_targets(df)
    got = {r.conv_id: r for r in chat_format.digest(ex).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = [r for r in ex.collect() if r.conv_id == 1]
    assert len(one) == 4 and sum(r.loss_start is None for r in one) == 1
    for r in one:
        body = r.formatted.replace(chat_format.START, "").replace(chat_format.SEP, "").replace(chat_format.END, "")
        assert not re.search(chat_format.CONTROL, body)
    assert sum(len(r.formatted) for r in one) == got[1].formatted_chars
    assert chat_format.digest(chat_format.expand_prefix_targets(df.limit(0))).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="\\<|[]/sINSTYim_endpu> \n", max_size=30), min_size=1, max_size=8))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"))
    for r in df.withColumn("u", chat_format.unescape(F.col("e"))).collect():
        assert r.u == r.t and not re.search(chat_format.CONTROL, r.e)


# --- near duplicates ---


def shingle_set(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_links(rows):
    sets = [shingle_set(t) for _, t in rows]
    links, parent = collections.Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(len(rows))]


def family(rng, n, size, edits):
    vocabulary = [f"w{i}" for i in range(400)]
    base = list(rng.choice(vocabulary, size))
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(edits):
            t[rng.integers(len(t))] = str(rng.choice(vocabulary))
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("limit", "block", "shingle_block"), [(200, 1024, 2 << 20), (4, 7, 300)])
def test_near_groups_against_brute_force(spark, limit, block, shingle_block):
    rng = np.random.default_rng(3)
    texts = family(rng, 40, 200, 2) + family(rng, 12, 80, 1) + family(rng, 6, 60, 6) + [" ".join(rng.choice(500, 90).astype(str)) for _ in range(60)]
    line = "this very common line stands in many of the texts here"
    texts += [f"{line} " + " ".join(rng.choice(5000, 60).astype(str)) for _ in range(30)] + [texts[0]] * 5 + ["a b c", "a b c", "", None, "tiny"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.id: r for r in near_dup.near_groups(df, limit=limit, block=block, shingle_block=shingle_block).collect()}
    links, root = brute_links(rows)
    assert {i: got[i].n_links for i, _ in rows} == {i: links[i] for i, _ in rows}
    assert {i: got[i].class_id for i, _ in rows} == dict(enumerate(root))
    sizes = collections.Counter(root)
    assert all(got[i].group_size == sizes[root[i]] for i, _ in rows)


def test_near_hard_cases(docs, clashing):
    got = near_dup.near_groups(docs).collect()
    assert len(got) == len(BASE)
    assert {(r.n_links, r.class_id) for r in got if r.id == 7} == {(2, 4)} and {r.n_links for r in got if r.id in (2, 3, 6)} == {0}
    kept = near_dup.keep_one(clashing)
    assert kept.schema.names == clashing.schema.names
    rows = kept.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, x) for x in (0, 2, 3, 4, 5, 6, 9)] + [(True, 0)]
    texts = {x[0]: x[1] for x in BASE}
    assert all(r.text == texts[r.doc_id] for r in rows) and all(r.kept == "mine kept" for r in rows)
    assert near_dup.near_groups(docs.limit(0)).count() == 0


def test_recall_with_every_split():
    """Pairs at the threshold whose buckets are split as often as can be still meet, with the recall that the runs are made for."""
    rng = np.random.default_rng(11)
    runs = near_dup.runs_for(0.999, 0.8)
    factors = near_dup.hash_factors(runs + near_dup.SPLITS)
    agree = []
    for _ in range(1500):
        both = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
        a, b = (near_dup.minimum(np.concatenate([x, both[:80]]), factors) for x in (both[80:90], both[90:100]))  # 80 of 100 shared
        agree.append(a == b)
    agree = np.array(agree)
    assert abs(agree.mean() - 0.8) < 0.01
    met = np.zeros(len(agree), bool)
    for run in range(runs):
        ok = agree[:, run].copy()
        for _ in range(near_dup.DEPTH - 1):
            ok &= agree[:, runs + rng.choice(near_dup.SPLITS, near_dup.PICKS, replace=False)].any(axis=1)
        met |= ok
    assert met.mean() >= 0.997
    assert near_dup.runs_for(0.99999, 0.8) == 8 and near_dup.runs_for(0.99999, 0.3) > 100


def test_chain_of_versions(spark):
    """Each version is near the next, first and last are not: one class, whatever the order of rows."""
    rng = np.random.default_rng(8)
    text, rows = [f"w{x}" for x in rng.integers(0, 5000, 200)], []
    for i in range(300):
        rows.append((i, " ".join(text)))
        text = [*text[8:], *[f"w{x}" for x in rng.integers(0, 5000, 8)]]
    got = near_dup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    links, root = brute_links(rows)
    assert set(root) == {0} and {r.class_id for r in got} == {0} and {r.id: r.n_links for r in got} == {i: links[i] for i, _ in rows}


def test_near_classes_that_share_their_least_id(spark):
    rng = np.random.default_rng(9)
    rows = [(key, t) for keys in ((5, 9), (5, 12), (None, None), (None, None), (None, 3)) for key, t in zip(keys, family(rng, 2, 200, 1), strict=True)]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "5", "5", "None", "None"]
    assert {r.text for r in kept if r.doc_id is not None} == {rows[0][1], rows[2][1], rows[9][1]}
    assert len({r.text for r in kept if r.doc_id is None} & {t for _, t in rows[4:6]}) == 1


def test_word_hashes_in_pieces(monkeypatch):
    raw = (" ".join(f"word{i} x" for i in range(3000)) + " " + "y" * 900).encode()
    whole = near_dup.word_hashes(raw)
    monkeypatch.setattr(near_dup, "PIECE", 500)
    assert (near_dup.word_hashes(raw) == whole).all() and len(whole) == 6001


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 51), (52, 51), (60, 60)] + [(100, i) for i in range(101, 140)]
    got = {r.node: r.label for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in (50, 51, 52)} == {50} and {got[i] for i in range(100, 140)} == {100}


def test_components_of_an_ordered_path(spark, monkeypatch):
    written = []
    monkeypatch.setattr(near_dup, "materialise", lambda df, name: written.append(name) or common.materialise(df, name))
    edges = spark.range(1000).selectExpr("id AS a", "id + 1 AS b").union(spark.range(2001, 2043).selectExpr("id AS a", "id - 1 AS b"))
    got = {r.node: r.label for r in near_dup.components(edges).collect()}
    assert got == {i: 0 for i in range(1001)} | {i: 2000 for i in range(2000, 2043)}
    assert written.count("edges") < 35


# --- html ---

PARA = "It is the text of the article that we want to have, and it has the words that are in the list of the most used ones of the language, so it is good. " * 2


def test_html_furniture():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body>
    <header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">{PARA}</div><!-- x > y -->
    <main><article><h1>Head&amp;line</h1><p>{PARA}<p>Short&nbsp;<b>one</b>.<br><p title="a>b">{PARA}<div class="ad">Buy {PARA}</div><ul class="related-links"><li><a href=x>More of it</a></li></ul>
    <form><label>Mail</label><textarea>{PARA}</textarea></form><p>x &lt; y</p><section id="comments"><p>{PARA}</p></section></article></main>
    <aside><p>{PARA}</p></aside><div class="sidebar">{PARA}</div><footer>&copy; me</footer></body></html>"""
    para = " ".join(PARA.split())
    assert html_extract.main_text(page) == f"Head&line {para} Short one. {para} x < y"


def test_html_without_markup():
    page = f"<div><p>Skip to it</p><p>{PARA}</p><p>Not long.</p><p>{PARA}</p></div><div><a href=a>one</a> <a href=b>two three</a></div><p>zz qq</p>"
    para = " ".join(PARA.split())
    assert html_extract.main_text(page) == f"{para} Not long. {para}"
    for odd in (None, "", "<", "<p", "<!--", "a < b", "<script>", "<p class='x>y", "&bogus; &#0;", "</div></p>"):
        assert isinstance(html_extract.main_text(odd), str)
    assert len(html_extract.main_text("<article>" + "<p>the of and it</p>" * 20000 + "</article>")) == 20000 * 14 - 1


@pytest.mark.parametrize("tag", ["embed", "audio", "canvas", "object", "video", "applet", "datalist", "math", "svg", "select", "template", "noscript", "iframe", "textarea"])
def test_html_elements_without_an_end(tag):
    para = " ".join(PARA.split())
    for page in ("{p}<T src=x>{p}", "{p}<T src=x>{p}<T>out</T>{p}", "{p}<T src=x><T src=y>{p}"):
        if tag in html_extract.PLAIN and page.count("</T>"):
            continue
        n = page.count("{p}")
        got = html_extract.main_text("<article>" + page.replace("T", tag).replace("{p}", f"<p>{PARA}</p>") + "</article>")
        assert got.replace(" out", "" if tag == "embed" else " out") == " ".join([para] * n)


def test_html_elements_with_an_end():
    para = " ".join(PARA.split())
    page = f"<p>{PARA}<object><object>in</object>out</object><svg><script>'<svg>'</script><!-- <svg> -->x</svg><script>var a = '<p>{PARA}'</script><style>p</style>"
    assert html_extract.main_text(f"<article>{page}<p>{PARA}</article>") == f"{para} {para}"
    assert html_extract.main_text(f"<article>{page}<script>{PARA}</article>") == para


def test_html_without_markup_keeps_ends_and_short_paragraphs():
    para = " ".join(PARA.split())
    mid = "This is one of the paragraphs that are not so long, but it is of the text and has to be in it."
    page = "<nav><a href=a>one</a></nav><p>Skip to it</p><h1>Title of <b>it</b></h1>{}<p>The end.</p><footer>me</footer>"
    assert html_extract.main_text(page.format(f"<p>{PARA}</p>")) == f"Title of it {para} The end."
    assert html_extract.main_text(page.format(f"<p>{mid}</p><p>{mid}</p>")) == f"Title of it {mid} {mid} The end."
    assert html_extract.main_text(f"<h2>Links</h2><p><a href=a>{mid}</a></p><p>{PARA}</p><p><a href=a>{mid}</a></p><p>zz</p>") == para


def test_html_link_lists_inside_an_article():
    text = "This is the first part of the story, and it has all that one would want to read in it. " * 4
    links = "".join(f"<li><a href='/{i}'>Another story number {i} of ours</a></li>" for i in range(6))
    page = f"<body><article><h1>The story</h1><p>{text}</p><h2>Related stories</h2><ul>{links}</ul><h2>And then</h2><p>It went on for a while.</p><p>{text}</p></article></body>"
    got = html_extract.main_text(page)
    assert "Another story" not in got and "Related" not in got and got == f"The story {text.strip()} And then It went on for a while. {text.strip()}"


def test_html_pages_of_few_stop_words_without_markup():
    lines = ["Zinc 40 mg, iron 9 mg, copper 2 mg, boron 1 mg, cobalt 3 mg per kilogram dry weight measured"] * 6
    page = "<body>" + "".join(f"<div>{x} sample {i}</div>" for i, x in enumerate(lines)) + "<div>What is in the table is all that was found in it and there is no more to say of this.</div><div><a href=x>next</a> <a href=y>back</a></div></body>"
    got = html_extract.main_text(page)
    assert all(f"sample {i}" in got for i in range(6)) and "next" not in got


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Hi &eacute;</p></article>"), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("__page", F.lit(1))
    got = html_extract.extract(df).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, "Hi é", 4), (2, "", 0), (2, "", 0)] and html_extract.extract(df.limit(0)).count() == 0


def article_of(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(htmllib.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)]
    return " ".join(p for p in parts if p)


def test_html_of_driver_pages(spark):
    pages = common.table(spark, "/root/testdata/sf0.001", "pages")
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == {r.page_id: article_of(r.html) for r in pages.collect()}


def word_f1(a, b):
    a, b = collections.Counter(a.split()), collections.Counter(b.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values())) if a or b else 1.0


def test_html_of_driver_pages_without_their_article_tags(spark):
    """The block rules alone find the article: by words on average 0.99, and hardly a page is missed."""
    pages = [r.html for r in common.table(spark, "/root/testdata/sf0.01", "pages").collect()]
    got = [word_f1(html_extract.main_text(re.sub(r"(</?)(article|main)\b", r"\1div", p)), article_of(p)) for p in pages]
    assert np.mean(got) >= 0.99 and np.mean(np.array(got) >= 0.95) >= 0.98


def test_html_marks_are_evidence_only():
    para = " ".join(PARA.split())
    p = f"<p>{PARA}</p>"
    menu = "<nav><a href=a>one</a> <a href=b>two</a></nav>"
    for page in (f'{menu}<form id="aspnetForm">{p}{p}</form>', f'{menu}<div class="site has-sidebar">{p}{p}</div>', f'{menu}<article class="post comments-open">{p}{p}<div id="comments">{p}</div></article>',
                 f'{menu}<div class="widget-area"><form>{p}{p}</form></div>', f'<div class="page">{p}{p}</div><div class="comments">{p * 9}</div>', f'<div class="notice"><div class="sidebar"><a href=x>{PARA}</a></div>{p}{p}</div>'):
        assert html_extract.main_text(page) == f"{para} {para}"
    # An article mark around teasers, with the text elsewhere, isn't believed.
    teasers = "".join(f"<article><h3><a href=x{i}>Teaser number {i}</a></h3></article>" for i in range(5))
    assert html_extract.main_text(f"{teasers}<div>{p}{p}</div>") == f"{para} {para}"
    # A language without stop words here: the longer blocks without links.
    odd = "qwe rty uio pas dfg hjk lzx cvb nmq wer tyu iop asd fgh jkl zxc vbn mqw ert yui opa " * 3
    assert html_extract.main_text(f"{menu}<p>{odd}</p><p><a href=x>{odd}</a></p>") == odd.strip()


def test_html_first_pass():
    label = lambda text, linked=0: html_extract.first_pass(html_extract.Block(text, linked, (), False, False))
    assert label(PARA) == "good" and label(PARA[:140]) == "near-good" and label("Short one.") == "short" and label(PARA, len(PARA)) == "links"
    assert label("zz yy xx ww " * 20) == "bad" and label("zzzzz yyyyy xxxxx wwwww " * 5) == "short" and label("zz yy xx ww the " * 20) == "near-good"


@pytest.mark.parametrize("page", ["<div></span>" * 170_000, "<div>" * 400_000, "<nav><div class='ad'>x</div>" * 70_000, '<a title="' * 200_000, "<svg>" * 400_000, "<" * 2_000_000, "<div>x</td>" * 180_000])
def test_html_time_follows_the_length(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 5


def test_html_clashing_columns(spark):
    df = spark.createDataFrame([(1, "mine", "<p>Hi</p>", 7)], "page_id long, text string, html string, n_chars long")
    assert [tuple(r) for r in html_extract.extract(df, keep=("page_id", "text", "n_chars")).collect()] == [(1, "Hi", 2)]


# --- url filter ---


def test_url_filter(spark):
    urls = [
        "http://A.Example.COM/en/700?x=1", "https://example.com/en/8", "https://b.example.net/de/81", "http://x.net/de/", "http://y.org/es/1#f", "http://notcom/en/1", "https://www.bad.test/a/",
        "https://bad.test/a.html?utm=1", "https://bad.test/a/b", "noscheme", None, "", "://", "http://evilexample.com/en/7", "a://b://c/d",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"verdict": F.lit("mine"), "block": F.lit(1), "listed": F.lit(True), "w0": F.lit(0)})
    listed = spark.createDataFrame([("bad.test/a",), ("bad.test/a",), ("",), (None,)], "canon string")
    for how in ({}, {"broadcast_bytes": 0}):
        got = {r.page_id: r for r in url_filter.judge(df, listed, entries.RULES, **how).collect()}
        assert len(got) == len(urls) and got[0].host == "a.example.com" and got[0].path == "/en/700"
        assert [got[i].rule for i in range(6)] == ["example.com/en/7", "com/en/", "example.net/de/8", "net/de/", "org/es/", None]
        assert [got[i].verdict for i in range(9)] == ["allow", "block", "block", "allow", "block", "allow", "block", "block", "allow"]
        assert all((got[i].host, got[i].path, got[i].verdict) == ("", "", "allow") for i in (9, 10, 11, 12)) and got[13].rule == "com/en/" and got[14].host == "b:"
    assert {r.verdict for r in url_filter.judge(df.where("page_id = 6"), listed.limit(0), []).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0), listed, entries.RULES).count() == 0


def test_url_list_decides_within_a_host(spark):
    """Listed are single URLs of one host: the Bloom filter alone blocks too much, the join removes it, and without the filter's hits nothing is listed."""
    df = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://one.test/p/"), F.col("id"), F.when(F.col("id") % 2 == 0, "/?a=b").otherwise(".html")).alias("url")).unionAll(spark.createDataFrame([(-1, None)] * 50, "page_id long, url string"))
    keys = spark.range(0, 4000, 7).select(F.concat(F.lit("one.test/p/"), F.col("id")).alias("key"))
    want = {i: "block" if i >= 0 and i % 7 == 0 else "allow" for i in range(-1, 4000)}
    for how in ({}, {"bits_per_key": 1}, {"bits_per_key": 1, "broadcast_bytes": 0}):
        got = {r.page_id: r.verdict for r in url_filter.judge(df, keys, [], key="key", **how).collect()}
        assert got == want
    marked = url_filter.probe(df, keys, 572, 1, 0)
    hits = {r.page_id for r in marked.where("hit").collect()}
    listed = {i for i, v in want.items() if v == "block"}
    assert hits > listed and -1 not in hits and len(hits) < 4000
    assert marked.count() == 4050


def test_bloom_has_no_false_negatives_and_few_hits(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    blocks, n = url_filter.bloom_blocks(keys, "k", 5000)
    probe = spark.range(10000).select(F.col("id"), F.concat(F.lit("k"), F.col("id")).alias("k"))
    j = probe.join(blocks, url_filter._block(F.col("k"), n) == F.col("block"), "left")
    hit = F.lit(True)
    for i, b in enumerate(url_filter._bits(F.col("k"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) == b)
    got = j.groupBy((F.col("id") < 5000).alias("in")).agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("n")).collect()
    n = {r["in"]: r["n"] for r in got}
    assert n[True] == 5000 and n[False] < 150


# --- suffix arrays ---


def brute_repeats(rows):
    order = sorted({i if i is not None else -(1 << 63) for i, _ in rows})
    seen, out = set(), collections.defaultdict(list)
    for ident in order:
        own = set()
        for i, t in rows:
            if (i if i is not None else -(1 << 63)) != ident:
                continue
            b = (t or "").encode()
            gone = np.zeros(len(b), bool)
            for p in range(len(b) - 49):
                s = b[p : p + 50]
                if s in seen:
                    gone[p : p + 50] = True
                own.add(s)
            spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
            kept = bytes(np.frombuffer(b, np.uint8)[~gone])
            out[i].append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        seen |= own
    return out


def repeating_rows():
    rng = np.random.default_rng(5)
    random = lambda n: "".join(rng.choice(list("abcdé 😀"), n))
    passage, edge = random(120), random(50)
    rows = [(i, random(rng.integers(0, 200)) + (passage if i % 3 else "") + random(60) + (edge if i % 4 == 0 else edge[:49]) + random(30)) for i in range(60)]
    rows += [(200, rows[3][1]), (201, rows[3][1][:100] + "#" + rows[3][1][100:]), (150, "z" * 400), (151, "z" * 60), (202, "ab" * 100), (203, "ba" * 90), (204, None), (205, ""), (206, "z" * 49), (None, "z" * 55), (7, passage), (7, passage)]
    rows += [(300 + i, passage[i : i + 60] + "\0" * i + passage[:55]) for i in range(20)] + [(5, "\0" * 70), (400, "\0" * 51 + "a" + "\0" * 50)]
    return rows


def removed(frame):
    got = collections.defaultdict(list)
    for r in frame.collect():
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
        got[r.id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)))
    return {k: sorted(v) for k, v in got.items()}


@pytest.mark.parametrize(("pack", "batch", "how"), [(800_000, 1 << 15, {}), (900, 64, {"ranges": 3, "sift_ranges": 2}), (900, 64, {"ranges": 5, "hot": 4}), (400, 1 << 15, {"hot": 1})])
def test_repeats_against_brute_force(spark, monkeypatch, pack, batch, how):
    monkeypatch.setattr(suffix_dedup, "PACK", pack)
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    rows = repeating_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pack": F.lit("x"), "id": F.lit(1)}).repartition(3)
    want = {k: sorted(v) for k, v in brute_repeats(rows).items()}
    assert removed(suffix_dedup.remove_repeats(df, with_kept=True, **how)) == want


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 6])
def test_batches_meet_stored_levels(spark, monkeypatch, hot):
    """Five batches, in an order that isn't that of ids: after each the results are those of all rows so far, and levels are those of a binary counter."""
    monkeypatch.setattr(suffix_dedup, "PACK", 900)
    rows = repeating_rows()
    index, so_far = suffix_dedup.SuffixIndex(spark, ranges=3, sift_ranges=2, hot=hot), []
    for n, at in enumerate((3, 0, 4, 1, 2), 1):
        so_far += rows[at::5]
        index.add(spark.createDataFrame(rows[at::5], "doc_id long, text string").repartition(2))
        assert [size for size, _ in index.levels] == [1 << b for b in range(3, -1, -1) if n >> b & 1]
        assert removed(index.results(with_kept=True)) == {k: sorted(v) for k, v in brute_repeats(so_far).items()}
    index.drop()


def test_ranges_split_as_they_fill_and_the_index_is_opened_again(spark, monkeypatch, tmp_path):
    """A small first batch, then large ones; each is added by an index that is opened anew, as another program would."""
    monkeypatch.setattr(suffix_dedup, "PACK", 900)
    rows = repeating_rows()
    folder = f"file://{tmp_path}/index"
    suffix_dedup.SuffixIndex(spark, hot=40, folder=folder, range_entries=20, sift_bytes=2000).add(spark.createDataFrame(rows[:3], "doc_id long, text string"))
    cuts, grown = [3, 3 + len(rows) // 3, len(rows)], []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        index = suffix_dedup.SuffixIndex.open(spark, folder)
        index.add(spark.createDataFrame(rows[lo:hi], "doc_id long, text string").repartition(2))
        grown.append((index.splits, index.sift_splits))
        assert removed(suffix_dedup.SuffixIndex.open(spark, folder).results(with_kept=True)) == {k: sorted(v) for k, v in brute_repeats(rows[:hi]).items()}
    assert min(grown[0]) > 1 and grown[1] >= grown[0] and index.batches == 3
    with pytest.raises(LookupError):
        suffix_dedup.SuffixIndex.open(spark, f"{folder}-none")


def test_anchors_in_pieces(monkeypatch):
    data, ends = np.random.default_rng(3).integers(97, 101, 3000, dtype=np.uint8), np.array([700, 730, 2000, 3000])
    windows = lambda a: {(w, at) for f, last, at in zip(*(x.tolist() for x in a[:3]), strict=True) for w in range(f, last + 1)}
    whole = windows(suffix_dedup.anchors(data, ends))
    monkeypatch.setattr(suffix_dedup, "PIECE", 333)
    assert windows(suffix_dedup.anchors(data, ends)) == whole
    assert {w for w, _ in whole} == {w for lo, hi in zip([0, *ends], ends) for w in range(lo, hi - 49)}


def test_repeats_of_nothing(docs):
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(BASE) and {r.n_bytes for r in got if r.id in (2, 3)} == {0}


def test_pack_is_read_as_it_was_made():
    rng = np.random.default_rng(6)
    ids, ends = np.array([5, 3, 9, 3]), np.array([400, 430, 1200, 1500])
    data = np.concatenate([x := rng.integers(97, 100, 400, dtype=np.uint8), x[:30], x, x[:370], x[:300]])
    made = suffix_dedup.Pack(ids, ends, data)
    read = suffix_dedup.Pack(ids, ends, data, made.marks())
    assert all((getattr(made, f) == getattr(read, f)).all() for f in ("first", "n", "x", "id", "leader", "leaders")) and len(made.leaders) < len(made.first)
    assert (made.start(np.arange(len(made.first))) == suffix_dedup.anchors(data, ends)[3]).all()
    made.leader[:] = np.arange(len(made.first))
    made.lead(np.zeros(len(made.first), np.uint64))  # keys that all collide: only equal bytes share a leader
    span = lambda i: (int(made.x[i]), data[made.first[i] : made.first[i] + made.n[i] + 49].tobytes())
    assert all(span(i) == span(made.leader[i]) for i in range(len(made.first)))


def entries_of(rng, n, ident, letters=b"ab"):
    ahead = rng.choice(np.frombuffer(letters, np.uint8), (n, suffix_dedup.L))
    back = rng.choice(np.frombuffer(letters, np.uint8), (n, suffix_dedup.BEFORE))
    x = rng.integers(0, suffix_dedup.BEFORE + 1, n)
    windows = rng.integers(1, x + 2)
    for i in range(n):  # as they are read: nothing beyond the windows
        ahead[i, suffix_dedup.L - (x[i] - windows[i] + 1) :], back[i, x[i] :] = 0, 0
    return suffix_dedup.Entries(ahead, back, windows, x, np.full(n, ident), np.full(n, ident), np.arange(n))


def test_levels_stay_few_and_sorted():
    rng, levels = np.random.default_rng(1), suffix_dedup.Levels([], [])
    for i in range(64):
        levels.add(entries_of(rng, 100, i, bytes(range(256))))
    assert len(levels.levels) <= 8 and sum(len(x) for x in levels.levels) == 6400
    for x in levels.levels:
        whole = [a.tobytes() + b.tobytes() for a, b in zip(x.ahead, x.back)]
        assert whole == sorted(whole)


def test_windows_by_common_prefixes():
    """What the levels say of each window against the windows themselves, with few letters so that much is common."""
    rng = np.random.default_rng(4)
    base = entries_of(rng, 1, 0)
    parts = []
    for i in range(60):
        e = entries_of(rng, 4, 60 - i)
        for j in range(4):
            a, b = rng.integers(15, suffix_dedup.L + 1), rng.integers(0, suffix_dedup.BEFORE + 1)
            e.ahead[j, :a], e.back[j, :b] = np.resize(np.frombuffer(b"xyz", np.uint8), a), np.resize(np.frombuffer(b"uvw", np.uint8), b)
            e.ahead[j, suffix_dedup.L - (e.x[j] - e.n[j] + 1) :], e.back[j, e.x[j] :] = 0, 0
        parts.append(e)
    levels = suffix_dedup.Levels([], [])
    for e in parts:
        levels.add(e)
    got = collections.Counter()
    for pack, ords, mask in levels.verdicts():
        for o, m in zip(np.frombuffer(ords, np.uint32).tolist(), np.frombuffer(mask, np.uint32).tolist()):
            got[pack, o] |= m
    where, windows = collections.defaultdict(list), []
    for e in [base, *parts]:
        for j in range(len(e)):
            whole = e.back[j, : e.x[j]][::-1].tobytes() + e.ahead[j].tobytes()
            for k in range(e.n[j]):
                windows.append((whole[k : k + 50], int(e.x[j]) - k, int(e.id[j]), j, k))
                where[windows[-1][:2]].append(int(e.id[j]))
    want = collections.Counter()
    for w, x, i, j, k in windows[base.n[0] :]:
        if min(where[w, x]) < i:
            want[i, j] |= 1 << k
    assert +got == +want and len(want) > 30


# --- exact dedup ---


def test_exact_groups(docs, clashing):
    got = exact_dedup.exact_groups(clashing).collect()
    assert len(got) == len(BASE)
    by = collections.defaultdict(list)
    for r in BASE:
        by[r[1] or ""].append(r[0])
    for r in got:
        group = by[next(x[1] or "" for x in BASE if x[0] == r.id)]
        assert r.group_size == len(group) and r.keep_id == (max((g for g in group if g is not None), default=None))
    assert sum(r.kept for r in got) == len(by)
    assert {r.text_sha256 for r in got if r.id == 2} == {hashlib.sha256(b"").hexdigest()}
    kept = exact_dedup.drop_copies(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(by) and kept.where("kept <> 'mine kept'").count() == 0
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0 and exact_dedup.drop_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [0, 8 << 20])
def test_repeated_rows_and_one_stays(spark, size):
    rows = [(1, "a", "p"), (5, "a", "q"), (5, "a", "r"), (5, "a", "q"), (None, "b", "x"), (None, "b", "y"), (2, None, "m"), (3, "", "n"), (4, "c", "o")]
    kept = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string, sha string").repartition(3), broadcast_bytes=size).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "b"), (3, ""), (4, "c"), (5, "a")] and {r.sha for r in kept if r.doc_id == 5} <= {"q", "r"}


def test_tables_are_deleted(spark, docs):
    before = set(common._written)
    for made in (near_dup.near_groups(docs), exact_dedup.exact_groups(docs)):
        made.count()
    assert len(set(common._written) - before) == 2


def test_cuts_follow_content():
    rng = np.random.default_rng(2)
    a = rng.integers(97, 123, 60_000, dtype=np.uint8).tobytes()
    for raw in (a, b"", b"x", b"y" * 100_000):
        ends = exact_dedup.cuts(np.frombuffer(raw, np.uint8))
        sizes = np.diff([0, *ends])
        assert sum(sizes) == len(raw) and all(0 < s <= exact_dedup.MOST for s in sizes)
    keys = lambda raw: {k for k, _ in exact_dedup.recipe(raw.decode())[2]}
    assert len(keys(a) & keys(b"inserted" + a)) > 0.8 * len(keys(a))


def test_colliding_keys_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.xxhash, "xxh64_intdigest", lambda part: len(part) % 2)
    rows = [(i, t) for i, t in enumerate(["aa", "bb", "aa", "c", "d", "", "dd" * 4000, "dd" * 4000, "ee" * 4000])]
    recipe = [(i, exact_dedup.recipe(t)) for i, t in rows]
    made = spark.createDataFrame([(i, i, *r) for i, r in recipe], "row long, id long, text_sha256 string, n_bytes long, chunks array<struct<key:bigint,sha:binary>>")
    got = {r.id: tuple(map(tuple, r.ids)) for r in exact_dedup.verified(made).collect()}
    for i, a in rows:
        for j, b in rows:
            assert (got[i] == got[j]) == (a == b)


# --- mixing ---


def test_mixing(spark):
    rng = np.random.default_rng(7)
    vocab = {"a": [f"a{i}" for i in range(50)], "b": [f"b{i}" for i in range(50)], "c": [f"c{i}" for i in range(50)]}
    rows, truth = [], {}
    for i in range(300):
        d = "abc"[0 if i % 6 < 3 else 1 if i % 6 < 5 else 2]
        rows.append((i, " ".join(rng.choice(vocab[d], rng.integers(5, 60)))))
        truth[i] = d
    rows += [(300, None), (301, ""), (302, " ".join(vocab["a"][:20] + vocab["b"][:20])), (None, "a1 a2"), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rate": F.lit("x"), "posterior": F.lit(1)})
    labelled = spark.createDataFrame([(i, truth[i]) for i in range(300) if i // 6 % 2 == 0] + [(7, "other"), (None, "a")], "doc_id long, domain string")
    targets = {"a": 0.2, "b": 0.3, "c": 0.5}
    got = mixing.mix(df, labelled, targets).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and r.doc_id // 6 % 2]
    right = sum(max("abc", key=lambda d: r[f"p_{d}"]) == truth[r.doc_id] for r in held)
    assert right >= 0.98 * len(held)
    assert all(abs(r.p_a + r.p_b + r.p_c - 1) < 1e-9 and r.rate >= 0 for r in got)
    sums = {d: sum(r.n_tokens * r[f"p_{d}"] * r.rate for r in got) for d in "abc"}
    total = sum(sums.values())
    assert all(abs(sums[d] / total - targets[d]) < 1e-4 for d in "abc")
    mixed = next(r for r in got if r.doc_id == 302)
    assert mixed.p_a > 0.01 and mixed.p_b > 0.01
    many = mixing.resample(df, labelled, targets, least=1)
    assert many.columns == df.columns and many.select("doc_id").distinct().count() == len({r[0] for r in rows})
    assert mixing.mix(df.limit(0), labelled, targets).count() == 0
    fixed = mixing.mix(df, labelled, {"a": 1.0, "b": 0.0, "c": 0.0}, total=500.0).collect()
    assert abs(sum(r.n_tokens * r.p_a * r.rate for r in fixed) - 500) < 5


def test_posteriors_by_hand_and_calibrated(spark):
    """Posteriors against numpy from the fitted parts; on held-out documents of domains that overlap, calibration lowers the log-loss."""
    rng = np.random.default_rng(12)
    vocab = [f"w{i}" for i in range(60)]
    shares = {d: rng.dirichlet(np.ones(60) * 2) for d in "ab"}
    rows, truth = [], {}
    for i in range(1200):
        d = "ab"[int(rng.random() < 0.3)]
        # Words come in bursts, so plain Bayes is far too sure.
        rows.append((i, " ".join(np.repeat(rng.choice(vocab, rng.integers(2, 12), p=shares[d]), 6))))
        truth[i] = d
    df = spark.createDataFrame([*rows, (-1, "")], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, truth[i]) for i in range(800)], "doc_id long, domain string")
    features, _, model = mixing.fit(df, labelled, {"a": 0.5, "b": 0.5})
    got = {r["__key"]: r.posterior for r in features.collect()}
    bucket = {w: spark_hash((w, "s")) % mixing.BUCKETS for w in vocab}

    def posterior(text, power, factor):
        at = [bucket[w] for w in words(text)]
        z = model.prior + model.weights[:, at].sum(axis=1) * factor / max(1, len(at)) ** power
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    assert all(np.abs(posterior(t, model.power, model.factor) - got[i]).max() < 1e-9 for i, t in rows)
    assert np.abs(np.exp(model.prior) - got[-1]).max() < 1e-9
    loss = lambda power, factor: -np.mean([np.log(posterior(t, power, factor)["ab".index(truth[i])] + 1e-300) for i, t in rows[800:]])
    assert loss(model.power, model.factor) < 0.5 * loss(0, 1) and model.loss < model.plain
    sure = [max(got[i]) for i in range(800, 1200)]
    right = np.mean([got[i]["ab".index(truth[i])] > 0.5 for i in range(800, 1200)])
    assert abs(np.mean(sure) - right) < 0.05


def test_rates_against_numpy(spark):
    """The fit against a plain projected gradient descent on the same least squares."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.6, 0.6], 40)
    n = rng.integers(1, 50, 40)
    df = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(n, p)], "n_tokens long, posterior array<double>")
    targets = np.array([0.8, 0.2])
    steps = mixing.fit_rates(df, targets, total=900.0)
    got = np.array([r[0] for r in df.select(mixing._rate(steps)).collect()])
    a = (n[:, None] * p).T
    rate = np.ones(40)
    inv = np.linalg.inv((n[:, None] * p).T @ p)
    for _ in range(400):
        rate = np.maximum(0, rate - p @ (inv @ (a @ rate - targets * 900)))
    assert np.abs(a @ got - targets * 900).max() < 1e-2 and np.abs(got - rate).max() < 1e-2


# --- packing ---


def brute_padding(lengths, k):
    distinct = sorted(set(lengths))
    best = {0: {0: 0}}
    cost = lambda i, j: sum(distinct[j - 1] - x for x in lengths if distinct[i] <= x <= distinct[j - 1])
    table = [{0: 0}]
    for _ in range(k):
        table.append({j: min([table[-1][i] + cost(i, j) for i in range(j) if i in table[-1]] + ([table[-1][j]] if j in table[-1] else [])) for j in range(len(distinct) + 1) if j == 0 or any(i in table[-1] for i in range(j))})
    del best
    return table[-1][len(distinct)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40), st.integers(1, 5))
def test_boundaries_are_optimal(lengths, k):
    c = collections.Counter(lengths)
    xs = np.array(sorted(c))
    n = np.array([c[x] for x in xs.tolist()], float)
    bounds = packing.best_boundaries(xs, n, n * xs, k)
    assert len(bounds) <= k and bounds[-1] == max(lengths)
    assert sum(min(b for b in bounds if b >= x) - x for x in lengths) == brute_padding(lengths, k)


def test_packing_of_long_documents_is_optimal(spark):
    lengths = [int(x) for x in np.random.default_rng(4).integers(4096, 4224, 60)] + [8200, 8201, 8203, 16390, 16400]
    got = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long"), "n_tokens", "doc_id", buckets=6).collect()
    assert sum(r.padding for r in got) == brute_padding(lengths, 6)


def test_boundaries_of_many_lengths():
    rng = np.random.default_rng(6)
    xs = np.unique(rng.integers(1, 400_000, 40_000))
    n = rng.integers(1, 50, len(xs)).astype(float)
    bounds = packing.best_boundaries(xs, n, n * xs, 16)
    assert len(bounds) == 16 and bounds[-1] == xs[-1]


def test_packing(spark, docs):
    rng = np.random.default_rng(4)
    lengths = [int(x) for x in rng.integers(0, 400, 500)] + [0, None, 5000, 100_000, 7, 7]
    df = spark.createDataFrame([(i if i != 3 else None, n) for i, n in enumerate(lengths)], "doc_id long, n_tokens long").withColumn("slot", F.lit("mine")).withColumn("__key", F.lit(1))
    got = packing.pack(df, "n_tokens", "doc_id", buckets=4, budget=1000, cell_rows=50).collect()
    assert len(got) == len(lengths)
    batches = collections.defaultdict(list)
    for r in got:
        assert r.boundary >= (r.n_tokens or 0) and r.padding == r.boundary - (r.n_tokens or 0)
        batches[(r.bucket, r.batch)].append(r)
    for rows in batches.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or len(rows) * rows[0].boundary <= 1000
    partial = collections.Counter(b for (b, _), rows in batches.items() if len(rows) < max(1, 1000 // max(1, rows[0].boundary)))
    assert all(n == 1 for n in partial.values())
    assert packing.pack(df.limit(0), "n_tokens", "doc_id").count() == 0


def test_packing_of_a_hot_key(spark):
    """Rows that share key and length are spread over cells, and still get gapless places."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(9).cast("long").alias("n_tokens"))
    got = packing.pack(df, "n_tokens", "doc_id", buckets=3, budget=90, cell_rows=400).collect()
    assert sorted(r.batch * 10 + r.slot for r in got) == list(range(3000))
    marked = df.select(F.xxhash64("doc_id").alias("mark"), F.struct("doc_id").alias("r"))
    hot = marked.groupBy("mark").count().where("count > 100")
    numbers = [r.salt for r in shard_shuffle.salted(marked.repartition(5), hot, False).where("r.doc_id = 7").collect()]
    assert sorted(numbers) == list(range(len(numbers))) and len(numbers) >= 2000


# --- quality ---


def base_by_hand(t):
    w = words(t)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hot = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
    lines, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 50 or 100 * len(hot) > 50 * len(w)
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(hot), failed


def test_quality_base(spark, docs, clashing):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 400))) for _ in range(40)] + ["a\nb\na\n \na", "x\x0by\x0cz\x85w\u2028v", "# * $ % & | < >" * 9, " ".join(map(str, range(900))) + " " + " ".join(map(str, range(700)))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = quality.judge(df, docs.select("doc_id").limit(0)).collect()
    want = collections.Counter((i, *base_by_hand(t)) for i, t in [*enumerate(texts), *((r[0], r[1]) for r in BASE)])
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.score == 0 and r.kept == (not r.base_failed) for r in got)
    kept = quality.keep_good(clashing, docs.select("doc_id").limit(0))
    assert kept.columns == clashing.columns and kept.where("n <> 'mine n'").count() == 0
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in BASE if not base_by_hand(r[1])[-1]}
    assert quality.judge(df.limit(0), df).count() == 0


def test_quality_scores_by_hand(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["the", "of", "house", "tree", "runs"], 60)) for _ in range(20)]
    bad = [" ".join(f"{x}***" for x in rng.choice(["qq", "zz", "vv"], 60)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(10)] + [(None,), (3,)], "doc_id long")
    got = {r.doc_id: r.score for r in quality.judge(df, trusted).collect()}
    grams = lambda t: (lambda k: k + list(zip(k, k[1:])))(re.findall(r"[a-z]+|[^a-z\s]+", t))
    # Without collisions a bucket is an n-gram, so counts by n-gram give the same weights.
    raw, target = collections.Counter(), collections.Counter()
    for i, t in enumerate(good + bad):
        raw.update(grams(t))
        if i < 10:
            target.update(grams(t))
    m, nt, nr = quality.BUCKETS, sum(target.values()), sum(raw.values())
    weight = lambda g: np.log((target[g] + 1) / (nt + m)) - np.log((raw[g] + 1) / (nr + m))
    for i, t in enumerate(good + bad):
        assert abs(got[i] - np.mean([weight(g) for g in grams(t)])) < 0.02
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 40))


# --- sharding ---


def spark_hash(*values):
    """xxhash64 of SQL: each value that is not null is hashed with the hash so far as seed, which is 42 at first."""
    h = 42
    for v, kind in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<q" if kind == "l" else "<i", v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def shards_by_hand(rows, shards, seed, bucket_bytes, bucket_rows):
    """Places of (key, text) by a plain model of scatter and Fisher-Yates."""
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    n = max(1, -(-sum(sizes) // bucket_bytes), -(-len(rows) // bucket_rows))
    seen, buckets = collections.Counter(), collections.defaultdict(list)
    marks = [spark_hash((seed, "i"), (k, "l"), (int(k is None), "i"), (t, "s"), (int(t is None), "i")) for k, t in rows]
    copies = collections.Counter(marks)
    for mark, row in zip(marks, rows, strict=True):
        salt = seen[mark] if copies[mark] > max(1, bucket_rows // 4) else 0
        seen[mark] += 1
        buckets[(spark_hash((mark, "l"), (salt, "l")) if salt else mark) % n].append((mark, str(row), row))
    out, at = [], 0
    for b in sorted(buckets):
        left = [r for _, _, r in sorted(buckets[b])]
        for m in range(len(left), 0, -1):
            j = spark_hash((seed, "i"), (b, "l"), (m, "i")) % m
            left[j], left[m - 1] = left[m - 1], left[j]
            out.append((*left.pop(), at % shards, at // shards))
            at += 1
    return collections.Counter(out)


@pytest.fixture
def settings_of(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    yield lambda *values: [spark.conf.set(n, v) for n, v in zip(names, values, strict=True)]
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


@pytest.mark.parametrize(("parts", "adaptive"), [(4, "true"), (13, "false"), (200, "true"), (3, "false")])
def test_shards_against_a_plain_model(spark, settings_of, parts, adaptive):
    settings_of(parts, adaptive)
    rows = [(i, f"text {i} " * (i % 40)) for i in range(400)] + [(5, "copy")] * 300 + [(None, None)] * 70 + [(None, "x"), (7, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts % 7 + 1)
    how = {"seed": 3, "bucket_bytes": 2000, "bucket_rows": 64}
    got = shard_shuffle.external_shuffle(df.withColumn("extra", F.create_map(F.lit("a"), F.lit(1))), 5, broadcast_bytes=parts % 2 << 20, **how).collect()
    assert collections.Counter((r.doc_id, r.text, r.shard, r.slot) for r in got) == shards_by_hand(rows, 5, **how)


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_shards(docs, clashing, size):
    got = shard_shuffle.external_shuffle(clashing.repartition(3), 4, bucket_bytes=size).collect()
    assert len(got) == len(BASE)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r["size"] == len((r.text or "").encode()) + 1 and r.kept == "mine kept"
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots[i]) for i in range(4)]
    assert max(counts) - min(counts) <= 1
    assert shard_shuffle.external_shuffle(docs.limit(0), 4).count() == 0


def test_offsets_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(shard_shuffle, "BLOCK", 7)
    n = [(i * 3, i % 5) for i in range(100)]
    got = {r.b: r.before for r in shard_shuffle.numbered_before(spark.createDataFrame(n, "bucket long, n long")).collect()}
    assert got == {b: sum(x for _, x in n[:i]) for i, (b, _) in enumerate(n)}


def test_shards_are_shuffled(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = shard_shuffle.external_shuffle(df, 8, bucket_bytes=500).collect()
    at = np.array([r.slot * 8 + r.shard for r in sorted(got, key=lambda r: r.doc_id)])
    assert sorted(at) == list(range(4000)) and abs(np.corrcoef(at, np.arange(4000))[0, 1]) < 0.06
    r = entries.op10_shard_shuffle(spark, "/root/testdata/sf0.001").collect()
    texts = {x.doc_id: x.text or "" for x in common.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert all(x.text_crc32 == zlib.crc32(texts[x.doc_id].encode()) for x in r)


#: Shuffle partitions, adaptive execution, broadcast threshold, and where the rows come from.
PLANS = [("200", "true", "10m", "parquet"), ("100", "true", "-1", "group"), ("4", "false", "-1", "repartition")]


@pytest.fixture
def planned(spark, tmp_path):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]

    def rows(df, *how):
        for n, v in zip(names, how, strict=False):
            spark.conf.set(n, v)
        if how[3] == "parquet":
            df.write.parquet(f"file://{tmp_path}/rows")
            return spark.read.parquet(f"file://{tmp_path}/rows")
        return df.repartition(11) if how[3] == "repartition" else df.groupBy(*df.columns, F.col("id") % 97).count().drop("count", "(id % 97)").select(*df.columns)

    yield rows
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


@pytest.mark.parametrize("how", PLANS)
def test_hot_keys_lose_no_row_in_packing(spark, planned, how):
    df = spark.range(240_000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-(F.col("id") % 3)).alias("doc_id"), F.lit(9).cast("long").alias("n_tokens"))
    got = packing.pack(planned(df, *how), "n_tokens", "doc_id", buckets=3, budget=90, stored=how[3] == "parquet")
    n, ids, places, top = got.agg(F.count("*"), F.count_distinct("id"), F.count_distinct(F.col("batch") * 10 + F.col("slot")), F.max(F.col("batch") * 10 + F.col("slot"))).first()
    assert (n, ids, places, top) == (240_000, 240_000, 240_000, 239_999)


@pytest.mark.parametrize("how", PLANS)
def test_hot_keys_lose_no_row_in_shards(spark, planned, how):
    third = F.col("id") % 3
    df = spark.range(120_000).select("id", F.when(third == 0, F.col("id")).otherwise(-third).alias("doc_id"), F.when(third == 0, F.concat(F.lit("t"), "id")).otherwise("hot").alias("text"))
    got = shard_shuffle.external_shuffle(planned(df, *how), 8, broadcast_bytes=0 if how[3] == "repartition" else 8 << 20)
    n, ids, places, top = got.agg(F.count("*"), F.count_distinct("id"), F.count_distinct(F.col("slot") * 8 + F.col("shard")), F.max(F.col("slot") * 8 + F.col("shard"))).first()
    assert (n, ids, places, top) == (120_000, 120_000, 120_000, 119_999)
