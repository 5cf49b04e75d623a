import pytest

from riskspark.llm import dom

PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style><script>var a="<p>no</p>";</script></head><body>'
        '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News &amp; more</a></ul></nav>{before}'
        '<{tag}><h1>A  heading&nbsp;here</h1><p>First <b>paragraph, with <i>several</i> words in it.<br>And\n a line.'
        '<p>Second paragraph &lt;tag&gt; &eacute;&#233; and some more words, too.</p>{inside}'
        '<p>Third paragraph closes the story with a few more words.</p></{close}>{after}<footer>&copy; someone</footer></body></html>')
TEXT = ("A heading here\nFirst paragraph, with several words in it. And a line.\nSecond paragraph <tag> éé and some more words, too.\n"
        "Third paragraph closes the story with a few more words.")


def page(tag="article", before="", inside="", after=""):
    return (PAGE.replace("{tag}", tag).replace("{close}", tag.split()[0]).replace("{before}", before)
            .replace("{inside}", inside).replace("{after}", after))


@pytest.fixture(scope="module")
def trees():
    return dom.fit([page(), page("main"), page(after="<aside><p>Other things to read here</p></aside>")] * 4)


@pytest.mark.parametrize("html", [
    page(), page("main"), page('div class="article-body"'), page('div id="content"'),
    page(after='<section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this very much, thank you.</p></div></section>'),
    page(inside='<div class="ad">Buy now, cheap</div>'), page(before='<div class="cookie-notice">We use cookies, accept them.</div>'),
    page(after="<aside class='sidebar'><p>Related things to read</p></aside>"),
    page(inside="<form><label>Mail</label><input name=m><button>Subscribe</button></form>"),
    page(before="<header><p>Our site, since long ago</p></header>"),
])
def test_main_text_of_usual_pages(trees, html):
    assert dom.main_text(html, trees) == TEXT


def test_odd_pages(trees):
    assert [dom.main_text(x, trees) for x in (None, "", "   ", "<p", "<!-- open", "<script>x", "&amp;" * 3)].count("") >= 6
    deep = "<div>" * 5000 + "<p>x</p>"
    assert isinstance(dom.main_text(deep, trees), str)
    long = page().replace("Second paragraph", "Second " + "word, " * 200_000)
    assert len(dom.main_text(long, trees)) > 1_000_000
    assert dom.main_text(page().replace("</article>", ""), trees).startswith("A heading here\nFirst paragraph")


def test_parser_closes_what_browsers_close():
    p = dom.Page("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table><p>h<div>i</div>j</p><dl><dt>k<dd>l</dl>")
    assert [t for _, t in p.blocks] == list("abcdefghijkl")
    depth = {t: p.depth[n] for n, t in p.blocks}
    assert depth["a"] == depth["b"] == depth["d"] == depth["c"] - 2 and depth["e"] == depth["g"]
    assert [t for _, t in dom.Page("a<SCRIPT>b</scRipt >c<textarea><p>d</textarea>e<!-- > f -->g<a title='>x'>h</a>").blocks] == ["a", "c", "egh"]


def test_head_without_its_end_tag(trees):
    assert dom.main_text(page().replace("</head>", ""), trees) == TEXT
    assert dom.main_text(page().replace("</head><body>", ""), trees) == TEXT
    assert [t for _, t in dom.Page("<head><title>t</title><meta a=b><style>s</style> \n<b>c</b> d<p>e").blocks] == ["c d", "e"]
    assert [t for _, t in dom.Page("<head><title>t</title><script>s</script></head>c").blocks] == ["c"]


def test_text_directly_under_the_root(trees):
    text = "First paragraph, with several words in it. And a line, closing the story with a few more words, too. " * 4
    assert dom.main_text(text.replace("several", "<b>several</b>"), trees) == text.strip()
    p = dom.Page("a <i>b</i><div>c</div>d")
    assert [t for _, t in p.blocks] == ["a b", "c", "d"] and all(node for node, _ in p.blocks) and not p.own[0][0]


def test_decoding_is_consistent():
    import numpy as np
    rng = np.random.default_rng(1)
    p = dom.Page(page(after="<div><div><p>x</p></div><p>y</p></div>"))
    for _ in range(200):
        keep = dom.decode(p, rng.normal(0, 3, len(p.tag)))
        first = {}
        for i in range(1, len(keep)):
            first[i] = "main" if keep[i] else None
        # below a dropped node under a kept one nothing is kept
        cut = [i for i in range(1, len(keep)) if not keep[i] and keep[p.parent[i]]]
        below = set(cut)
        for i in range(1, len(keep)):
            if p.parent[i] in below:
                below.add(i)
        assert not any(keep[i] for i in below)


def test_trees_fit_and_survive_a_dump():
    import numpy as np
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    t = dom.boost(x, y, np.ones(2000))
    assert ((t.raw(x) > 0) == y).mean() > 0.95
    assert np.allclose(dom.Trees.load(t.dump()).raw(x), t.raw(x))


def test_whole_table(spark):
    rows = [(k, f"u{k}", page()) for k in range(30)] + [(30, None, None), (31, "u", ""), (3, "u3", page()), (None, "n", page())]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = dom.extract_main_text(df).collect()
    assert len(out) == len(rows) and sum(r.text == TEXT for r in out) == 32
    assert all(r.n_chars == len(r.text) for r in out) and {r.text for r in out if r.page_id in (30, 31)} == {""}
    assert dom.extract_main_text(df.where("page_id > 99")).collect() == []


def brute_decode(p, odds):
    """The best total over all consistent assignments, and the main sets that reach it."""
    import itertools
    n, allowed = len(p.tag), {0: (0, 1, 2), 1: (1, 2), 2: (2,)}
    best, sets = None, []
    for rest in itertools.product((0, 1, 2), repeat=n - 1):
        state = (0, *rest)
        if any(state[i] not in allowed[state[p.parent[i]]] for i in range(1, n)):
            continue
        total = sum(odds[i] if state[i] == 1 else -odds[i] if state[i] == 2 else -max(odds[i], 0) - 0.1 if p.own[i][0] else 0
                    for i in range(1, n))
        kept = tuple(s == 1 for s in state)
        if best is None or total > best + 1e-9:
            best, sets = total, [kept]
        elif abs(total - best) <= 1e-9:
            sets.append(kept)
    return sets


SMALL = ["<div><p>one two three</p><p>four</p></div><ul><li>menu</li></ul>",
         "<nav><a href=x>home</a></nav><article><h1>Title of it</h1><p>Words of the story, in a line.</p></article>",
         "text <div>inside<div>deeper<p>deepest</p></div></div> after", "<div><div><div><p>x y z</p></div></div></div><footer>end</footer>", "", "plain"]


def test_decoding_is_the_best_of_all_assignments():
    import numpy as np
    rng = np.random.default_rng(4)
    for source in SMALL:
        p = dom.Page(source)
        assert len(p.tag) <= 9
        for _ in range(12):
            odds = rng.normal(0, 2, len(p.tag))
            assert tuple(dom.decode(p, odds)) in brute_decode(p, odds.tolist())


def test_texts_of_a_table_against_all_assignments(trees):
    import numpy as np
    for source, text in zip(SMALL, dom.texts_of(SMALL, trees)):
        p = dom.Page(source)
        odds = np.clip(trees.raw(dom.node_features(p)), -8, 8)
        odds[[i for i in range(len(odds)) if p.hidden[i]]] = -8
        assert text in {"\n".join(t for node, t in p.blocks if kept[node]) for kept in brute_decode(p, odds.tolist())}
