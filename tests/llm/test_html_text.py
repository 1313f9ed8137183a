import re

import pytest

from lodestream.llm.html_text import TABLE, Page, Tree, apply, extract

TREE = Tree(TABLE)


def test_tree_fits_its_table():
    assert all(TREE(x) == bool(y) for x, y in TABLE)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("just words that stand alone here", "just words that stand alone here"), ("<article>cut &amp; of", "cut & of"), ("<article>a<b", "a"), ("<!-- x", ""),
        ("<article><p>x</p><script>var a='<p>no</p>'", "x"), ("<article><p title='a>b'>t</p></article>", "t"), ("<article><p>1 < 2 &lt; 3 &#169; &copy &am</p>", "1 < 2 < 3 © © &am"),
        ("<article><p>a <b>b</b>c<br>d\n\t e<p>f", "a bc d e\n\nf"),
        ("<nav><ul><li>n<article><h1>T</h1><p>p</article><footer>f", "T\n\np"),
        ("<article><p>p<div class='comments-area'><p>first</div><p>q</article>", "p\n\nq"),
        ("<main><p>p<aside>s</aside><form>l <input><button>b</button></form><div class=ad>x</div><div id='cookie-banner'>c</div>q</main>", "p\n\nq"),
        ("<article><p>p</p><section class=comments><article>c</article></section></article>", "p"),
        ("<article><style>p{}</style><noscript>n</noscript><p>p <img src=x> q</p></article>", "p q"),
        ("<title>t</title><header>h</header><article>" + "<div>" * 300 + "deep" + "</div>" * 300, "deep"),
    ],
)
def test_pages(source, text):
    assert extract(source, TREE) == text


def test_density_decides_without_an_article():
    long = "a paragraph of running text with quite a number of words in it to be kept by size"
    source = f"<body><div><a href=1>One</a></div><div><a href=2>Two</a></div><div><a>Three</a></div><div>{long}</div><div>{long}</div>"
    assert extract(source, TREE) == f"{long}\n\n{long}"


def test_features_of_neighbours():
    page = Page("<p>one two</p><p><a>three</a></p><p>four</p>")
    assert page.features()[1][:6] == (1, 1.0, 2, 0.0, 1, 0.0)


def test_query(spark):
    rows = [(1, "u", "<article>é</article>"), (2, None, None), (2, None, None), (None, "v", "<p>" + "word " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text")
    out = apply(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted([(r.page_id, r.url, r.n_chars) for r in out.collect()], key=str)
    assert got == sorted([(1, "u", 1), (2, None, 0), (2, None, 0), (None, "v", 499_999)], key=str)
    assert apply(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<html><head><title>t</title><meta charset=utf-8><body><article><p>p</article>", "p"),
        ("<head><title>t</title><link rel=x href=y><article><h1>T</h1><p>p</article>", "T\n\np"),
        ("<head><noscript><style>x</style><body><article><p>p</article>", "p"),
        ("<head><title>t</title>words of a page without any tags at all", "words of a page without any tags at all"),
        ("<head><script>s</script><noscript>n</noscript><title>t</title></head><body><article><p>p</article>", "p"),
        ("<article><p>p<svg width='5'/><p>q</article>", "p\n\nq"),
        ("<article><p>p</p><svg/><canvas id=c /><math/><p>q</article>", "p\n\nq"),
        ("<article><p>p</p><svg viewBox='0 0 1 1' hidden/><p>q</article>", "p\n\nq"),
        ("<article><p>p</p><svg><path d='m'/><g><p>q</article>", "p\n\nq"),
        ("<article><p>p</p><svg><foreignObject><div>f</div></foreignObject><text>s</text></svg><p>q</article>", "p\n\nq"),
        ("<article><p>p</p><object data=/a/>o</object><p>q</article>", "p\n\nq"),
    ],
)
def test_silence_ends(source, text):
    assert extract(source, TREE) == text


@pytest.mark.parametrize(
    "source",
    [
        "<body class='right-sidebar'><article><p>{p}</p></article>",
        "<body class='single has-comments'><article><p>{p}</p></article>",
        "<form action=x><div><article><p>{p}</p></article></div></form>",
        "<div class='social-page'><article><p>{p}</p></article></div>",
        "<div class='social-page'><p>{p}</p><p>{p}</p></div>",
    ],
)
def test_names_around_an_article_do_not_empty_it(source):
    p = "a paragraph of running text with quite a number of words in it, enough of them to be taken for what a page is about and not for a label, a notice or a button of it, and then a few words more"
    assert extract(source.format(p=p), TREE) == "\n\n".join([p] * source.count("{p}"))


def test_titles_comments_and_link_lists():
    assert extract("<article><header><h1>Title</h1></header><p>text</p></article>", TREE) == "Title\n\ntext"
    assert extract("<article><p>text</p></article><div class='thread'><article><p>a reader wrote this</p></article></div>", TREE) == "text"
    links = "".join(f"<li><a href={i}>Further reading {i}</a></li>" for i in range(5))
    long = "words " * 60
    assert extract(f"<article><p>{long}</p><ul>{links}</ul></article>", TREE) == long.strip()


def test_density_decides():
    """Without link densities, or without neighbours, the verdicts are others."""
    pages = ["<article><p>" + "words " * 60 + "</p>" + "".join(f"<li><a>See {i} too</a></li>" for i in range(4)), "<div><a>One of the menu</a></div><div>Two</div><div><a>Three of the menu</a></div><div>" + "w " * 40 + "</div>"]
    for source in pages:
        found = Page(source).features()
        whole = [TREE(x) for x in found]
        assert whole != [TREE((x[0], 0.0, x[2], 0.0, x[4], 0.0, *x[6:])) for x in found]


def test_nesting_is_read_in_one_pass():
    import time

    began = time.time()
    assert extract("<article>" + "<div>" * 100_000 + "deep" + "</b></div>" * 100_000, TREE) == "deep"
    assert extract("<article><svg>" + "<g>" * 50_000 + "<p>out", TREE) == "out"
    assert time.time() - began < 20


LONG = "a paragraph of running text with quite a number of words in it to be kept by its size " * 4


@pytest.mark.parametrize(
    ("source", "kept"),
    [
        (f"<div><h1>T</h1><p>Short one.</p><p>{LONG}</p><p>By Jane Doe</p></div>", ["T", "Short one.", LONG.strip(), "By Jane Doe"]),
        (f"<article><p>{LONG}</p><p><a>One</a> <a>Two</a> <a>Three</a></p><p><a>Read it all here</a></p><p>{LONG}</p></article>", [LONG.strip(), "One Two Three", "Read it all here", LONG.strip()]),
        (f"<article><p>{LONG}</p><ul class='usercomment-list'><li>A reader</li></ul><div id='postComments2'>Another</div></article>", [LONG.strip()]),
        (f"<article><p>{LONG}</p><div class='adslot'>Buy this</div><div class='ads-top'>Buy it</div><p data-ad='1'>Buy that</p><div data-ad-slot=3>Now</div><div class='sponsored-box'>Or this</div></article>", [LONG.strip()]),
        (f"<article><p>{LONG}</p><div class='address' data-address='x'>12 Road</div><div class='commentary'>A view</div><p class='advice adapted'>Be kind</p></article>", [LONG.strip(), "12 Road", "A view", "Be kind"]),
        (f"<article><p>{LONG}</p><ol><li>First take flour</li><li>Then <a>water</a></li></ol></article>", [LONG.strip(), "First take flour", "Then water"]),
        (f"<ul><li><a>Home</a><li><a>News</a></ul><div>{LONG}</div><ul><li>First take flour</li><li>Then water</li></ul><p>{LONG}</p>", [LONG.strip(), "First take flour", "Then water", LONG.strip()]),
    ],
)
def test_short_and_linked_blocks_stay_and_names_are_read_in_parts(source, kept):
    assert extract(source, TREE).split("\n\n") == kept


def test_pages_stripped_of_their_semantics(spark, sf_dir):
    """With article, menu and footer elements turned into plain boxes and no names, every block of the article is still found, and no menu."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    for source in pages:
        plain = re.sub(r'(<(?:div|p|ul)) class="[^"]*"', r"\1", re.sub(r"<(/?)(?:article|nav|footer|aside|header|main|section)\b[^>]*>", r"<\1div>", source))
        told, bare = Page(source), Page(plain)
        assert [b[0] for b in told.blocks] == [b[0] for b in bare.blocks]
        for x, y in zip(told.features(), bare.features(), strict=True):
            if x[6] == 1 and x[7] == 0:
                assert TREE(y)
            elif y[1] == 1:
                assert not TREE(y)
