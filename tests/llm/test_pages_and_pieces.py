"""HTML extraction, sampled pieces and the pipeline."""

import re

import numpy as np
import pytest

import corpus_pipeline
from sequoria.llm import contamination, fuzzy_lines, jaccard_join, page_template, repetition, sampled_pieces

PAGE = """<html><head><title>T</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body><nav><ul><li>Home</li></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div><main><article><h1>Title %d</h1><p>First&nbsp;one &amp; <b>bold</b> %d.</p><p>Second line number %d</p></article>
<div class="comments"><p>Nice post</p></div></main><aside>Related</aside><footer>Footer</footer></body></html>"""


def test_articles(spark):
    rows = [(i, f"https://site.org/{i}", PAGE % (i, i, i)) for i in range(6)] + [(90, None, None), (91, "https://other.org", ""), (92, "x", "<p>lonely"), (93, "https://site.org/9", "<div><p>plain</p></div>")]
    got = {r.page_id: r for r in page_template.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i].text == f"Title {i}\nFirst one & bold {i}.\nSecond line number {i}" and got[i].n_chars == len(got[i].text)
    assert (got[90].text, got[91].text, got[92].text, got[93].text) == ("", "", "lonely", "plain")
    assert page_template.extract_articles(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_templates_have_classes_and_a_slot(spark):
    rows = [(i, f"https://site.org/{i}", PAGE % (i, i, i)) for i in range(6)]
    row = page_template.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert row.host == "site.org" and row.n_tokens >= 2 and row.slot.endswith("/article")


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "comments-open", "with-nav", "sidebar"])
def test_names_of_wrappers_drop_no_article(name):
    page = f'<body><div class="{name}"><div class="x"><p>One <a class="nav-link">two</a> three.</p><p>Four five six seven.</p></div></div><div class="related"><p>More</p></div></body>'
    assert page_template.main_text(page, None) == "One two three.\nFour five six seven."
    held = f'<body><div class="{name}"><article><p>One</p></article></div><div class="comments"><p>a comment of many more words</p></div></body>'
    assert page_template.main_text(held, None) == "One"
    assert page_template.main_text('<main><p>One</p></main><div class="comments"><article><p>a comment of many words</p></article></div>', None) == "One"


def test_all_slots_without_the_texts_of_the_template(spark):
    page = """<body><div class="page"><h1>Title %d</h1><div class="lead"><p>Lead of %d</p></div><div class="content"><p>First paragraph %d of a long text, with many words in it that no other page has, number %d.</p>
<div class="box"><p>Read more on our site</p></div><p>Second paragraph %d, which is long enough as well to hold most of the text of the page, number %d.</p></div><div class="end"><p>All rights</p></div></div></body>"""
    rows = [(i, f"https://site.org/{i}", page % ((i,) * 6)) for i in range(6)]
    got = {r.page_id: r.text.split("\n") for r in page_template.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert [x[:19] for x in got[i]] == [f"Title {i}", f"Lead of {i}", f"First paragraph {i} o", f"Second paragraph {i},"]


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p>hello <span class='ad'>x</span> y</p>", "hello y"),
        ("<p>see <em>x</em> this <button>b</button> end", "see x this end"),
        ("<p>a <span class='ad'>x <span>y</span> z</span>b</p><p>c", "a b\nc"),
        ("<p>one <span class='ad'>x</p><p>two", "one\ntwo"),
        ("<div class='ad'><p>all there is</p></div>", "all there is"),
        ("<div class='x1'><a href='/a'>Other story</a><a href='/b'>And more</a></div><div class='x2'><p>A story of <a href='/c'>two</a> worlds.</p><p><a href='/d'>Its source</a></p></div>", "A story of two worlds.\nIts source"),
        ("<article><ul><li><a href='/a'>Only</a></li><li><a href='/b'>links</a></li></ul></article><div><p>no article</p></div>", "Only\nlinks"),
        ("<ul><li><a href='/a'>Only</a><li><a href='/b'>links</a></ul>", "Only\nlinks"),
    ],
)
def test_blocks_stay_whole_and_lists_of_links_go(page, text):
    assert page_template.main_text(f"<body>{page}</body>", None) == text


def test_menus_and_links_under_neutral_names(spark):
    page = "<body><div class='a1'><a href='/%d'>Page %d</a><a href='/x'>Home</a></div><div class='b2'><h1>Story %d</h1><p>Words of story %d, which are its own, and many of them.</p></div><div class='c3'><a href='/z%d'>Another story %d</a></div></body>"
    rows = [(i, f"https://n.org/{i}", page % (i, i, i, i, i, i)) for i in range(5)]
    got = {r.page_id: r.text for r in page_template.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}\nWords of story {i}, which are its own, and many of them." for i in range(5)}


def test_an_article_keeps_a_headline_that_other_pages_have(spark):
    page = "<body><nav>menu</nav><div class='ad'>buy %d</div><article><h1>%s</h1><p>The text of page %d begins here, with %d words.</p></article><footer>end</footer></body>"
    heads = ["The same", "The same", "Another", "The same"]
    rows = [(i, f"https://t.org/{i}", page % (i, h, i, i)) for i, h in enumerate(heads)]
    got = {r.page_id: r.text for r in page_template.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{h}\nThe text of page {i} begins here, with {i} words." for i, h in enumerate(heads)}


def test_classes_nest_and_crossing_ones_are_not_valid(spark):
    t = lambda path, text="": page_template._token(bool(text), path, text)
    page = "<body><div class='a'><p>x</p></div><div class='b'><div class='c'><p>y</p></div><div class='d'><p>z</p></div></div><div class='e'></div></body>"
    outer, inner, a = [t("/body"), t("/body/div.b"), t("/body/div.e")], [t("/body/div.b/div.c"), t("/body/div.b/div.d")], [t("/body/div.a"), t("/body/div.a", "x")]
    got = page_template.nesting(page, {**dict.fromkeys(outer, 1), **dict.fromkeys(inner, 2), **dict.fromkeys(a, 3)})
    assert got[1][1:] == (0, 0) and got[2][1:] == (1, 2) and got[3][1:] == (1, 1) and got[1][0] == outer and got[2][0] == inner
    crossing = page_template.nesting(page, {outer[1]: 1, inner[1]: 1, inner[0]: 2, outer[2]: 2})
    assert sorted(x[-1] for x in crossing.values()) == [-1, 0]
    # twice in one order, and in two orders
    twice = "<body>" + "<div class='a'></div><div class='b'></div>" * 2
    assert page_template.nesting(twice, {t("/body/div.a"): 1, t("/body/div.b"): 1})[1][0]
    assert not page_template.nesting(twice + "<div class='b'></div><div class='a'></div>", {t("/body/div.a"): 1, t("/body/div.b"): 1})[1][0]
    # tokens that change places from page to page form no valid class
    swap = lambda i: "".join(f"<div class='{c}'><p>text {c}</p></div>" for c in ("pq" if i % 2 else "qp"))
    rows = [(i, f"https://s.org/{i}", f"<body><div class='m'><h1>Head {i}</h1><div class='in'><p>long text of page {i} here</p></div></div>{swap(i)}</body>") for i in range(6)]
    row = page_template.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert row.n_tokens == 3 and row.slot == "/body/div.m/div.in"  # body, its container and the one inside it


def test_classes_are_nested_by_one_reading_of_the_pages(spark):
    """What ``_nested`` gives is read from a written table, so pages are not parsed for each of its uses."""
    pages = spark.createDataFrame([("site.org", PAGE % (i, i, i)) for i in range(4)], "host string, html string")
    tokens = {t: 1 for t, is_text, *_ in page_template._tokens(PAGE % (0, 0, 0)) if not is_text}
    nested = page_template._nested(pages, spark.createDataFrame([("site.org", tokens)], "host string, tokens map<long,long>"))
    assert {r.token for r in nested.collect()} <= set(tokens) and nested.count() > 1
    assert "MapInArrow" not in nested._jdf.queryExecution().toString()


def test_nested_markup_takes_linear_time():
    import time

    def seconds(n, one):
        began = time.perf_counter()
        assert page_template.main_text(f"<body>{one * n}text" + "</div>" * n, None) == "text"
        return time.perf_counter() - began

    for one in ("<div>", "<div class='ad'>", "<div class='long name of a box'>"):
        seconds(1000, one)
        assert seconds(80_000, one) < 12 * max(seconds(20_000, one), 0.05)


TEXTS = [None, "", " ", "Hello world, hello!", "é😀 ▁ literal\n\n  two  spaces \t tab", "x" * 3000, "\x00\x7f", "日本語 テキスト"]


def test_pieces_are_lossless_and_reproducible(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, "no key", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    one = sampled_pieces.encode_documents(df).collect()
    two = sampled_pieces.encode_documents(df.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.ids)
    assert sorted(one, key=key) == sorted(two, key=key) and all(r.lossless and r.n_pieces == len(r.ids) for r in one)
    back = {r.doc_id: r.text for r in sampled_pieces.decode_documents(sampled_pieces.encode_documents(df)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    same = [tuple(r.ids) for r in one if r.doc_id == 3]
    assert same[0] == same[1]
    seeds = {tuple(sampled_pieces.encode_documents(df.filter("doc_id = 4"), seed=s).first().ids) for s in range(8)}
    assert len(seeds) > 1
    assert sampled_pieces.encode_documents(df.limit(0)).count() == 0


def test_draws_follow_the_lattice():
    """Frequencies of whole segmentations of a word equal their weights."""
    pieces = sampled_pieces.Pieces(["", "▁", "a", "b", "ab", "▁a", *[""] * 256], [0.0, -1.0, -1.5, -1.2, -0.7, -0.9, *[0.0] * 256], list(range(6, 262)))
    sampler = sampled_pieces.Sampler(pieces)
    n = 20_000
    ids, count = sampler.encode(["ab"] * n, np.arange(n, dtype=np.uint64))
    ends = np.cumsum(count)
    drawn = [tuple(ids[e - c : e].tolist()) for e, c in zip(ends, count)]
    weights = {(1, 2, 3): -3.7, (1, 4): -1.7, (5, 3): -2.1}
    total = sum(np.exp(w) for w in weights.values())
    for path, w in weights.items():
        assert drawn.count(path) / n == pytest.approx(np.exp(w) / total, abs=0.015)
    assert set(drawn) <= set(weights)


def test_pipeline(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "pieces"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, spark.createDataFrame(stage(spark, kept, sf_dir).collect(), docs.schema)
        assert kept.columns == names
        ids = lambda rows: {r.doc_id for r in rows.collect()}
        if name == "quality_rules":
            assert ids(kept) == ids(repetition.repetition_report(before).filter("kept"))
        elif name == "line_dedup":
            report = {r.doc_id: r.text for r in fuzzy_lines.line_report(before).collect()}
            assert {r.doc_id: r.text for r in kept.collect()} == report and all(r.n_chars == len(r.text) for r in kept.collect())
        elif name == "near_duplicates":
            assert ids(kept) == {r.component_id for r in jaccard_join.similar_groups(before).collect()}
        else:
            items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            assert ids(kept) == ids(contamination.contamination_report(before, items).filter("NOT contaminated"))
    out = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert ids(out) == ids(kept) and out.filter("NOT lossless").count() == 0
    assert {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect()} == {(r.doc_id, tuple(r.ids)) for r in out.collect()}


def test_repeated_pages_long_pages_and_cut_pages(spark):
    page = lambda k: f"<html><body><div class='top'>Shop of wonders</div><div class='c{k % 1}'><p>story {k} begins here with words of its own {k * 7}</p><p>and ends {k}</p></div><div>imprint</div></body></html>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(8)] * 2 + [(90, "http://b.example/", "<p>" + "long words " * 40000), (91, None, "<body>one < 3 two <a hre"), (92, "http://b.example/x", "<a \"" * 20000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS slot", "3 AS page", "4 AS token")
    got = [(r.page_id, r.text) for r in page_template.extract_articles(pages).collect()]
    assert len(got) == len(rows)
    for k in range(8):
        assert [t for i, t in got if i == k] == [f"story {k} begins here with words of its own {k * 7}\nand ends {k}"] * 2
    texts = dict(got)
    assert texts[90] == ("long words " * 40000).strip() and texts[91] == "one < 3 two" and len(texts[92]) < 100000


def test_first_characters_and_very_long_units():
    """The table of first characters is the first step of the trie; a unit of more characters than 16 bits count is drawn like others."""
    sampler = sampled_pieces.Sampler(sampled_pieces.load_pieces())
    chars = np.array([*range(0x300), 0x2581, 0x4E2D, 0x1F600, sampled_pieces.LITERAL_SPACE])
    assert (sampler.trie.root[chars] == sampler.trie.step(np.zeros(len(chars), dtype=np.int64), chars)).all()
    texts = ["abc def" * 11000, "x" * 70000, "short \U0001f600▁ one"]
    keys = np.arange(3, dtype=np.uint64)
    ids, count = sampler.encode(texts, keys)
    ends = np.cumsum(count)
    assert [sampler.decode(ids[e - n : e].tolist()) for e, n in zip(ends, count)] == texts
    # what a text gets does not depend on the texts beside it
    assert (sampler.encode(texts[2:], keys[2:])[0] == ids[ends[1] :]).all()


def test_models_whose_pieces_reach_over_cuts_are_refused(monkeypatch):
    monkeypatch.setattr(sampled_pieces, "_INSIDE", re.compile("x"))
    with pytest.raises(ValueError, match="reach over"):
        sampled_pieces.load_pieces()
