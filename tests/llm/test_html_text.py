"""HTML extraction: contract cases, odd input, and pages with known articles."""

import html
import re

from clausegrid.llm.html_text import extract_main_text, main_text, parse

PAGE = """<html><body><header><h1>Site</h1><p>Tag line, with, commas, that is long enough to count as a paragraph.</p></header>
<div class="cookie-notice"><p>We use cookies, to improve, your experience, and more text here, accept.</p></div>
<div class="layout"><div id="content"><h1>Title &amp; more</h1><p>First   para, with <a href=x>link</a> and
 commas, and some more words to be long enough.</p><ul><li>one, item<li>two item</ul><table><tr><td>cell a<td>cell b</table><div class="share">Share this!</div><p>Second para, long enough, to be counted well, with commas.</div>
<div class="sidebar"><p>Related, links, lots, of, commas, in, here, but a sidebar anyway.</p><a href=1>x</a></div></div>
<section id="comments"><p>Great article, thanks, I liked it, a lot, and more, and more, commas, commas, commas.</p></section><form><p>Subscribe</p></form><footer>&copy; 2024</footer></body>"""


def test_article_without_what_surrounds_it():
    assert main_text(PAGE) == "Title & more First para, with link and commas, and some more words to be long enough. one, item two item cell a cell b Second para, long enough, to be counted well, with commas."


def test_odd_input():
    assert [main_text(s) for s in (None, "", "<", "<!-- x", "<script>var a='<p>no</p>'", "just text &amp; more", "<p>a", "<p>a<br>b</p>")] == ["", "", "<", "", "", "just text & more", "a", "a b"]
    deep = "<div>" * 5000 + "<p>deep text, here</p>" + "</div>" * 5000
    assert main_text(deep) == "deep text, here"
    assert len(main_text("<article>" + "<p>word, word</p>" * 20_000 + "</article>").split()) == 40_000
    assert parse("</div></p><b>x").children


def test_pages_table(spark):
    def want(s):
        inside = re.search(r"<article>(.*?)</article>", s, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", inside)]
        return " ".join(p for p in parts if p)

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    assert all(r.text == want(source[r.page_id]) for r in extract_main_text(pages).collect())
    assert extract_main_text(pages.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, None, "x", None)], "page_id long, url string, text string, html string")
    assert [tuple(r) for r in extract_main_text(clash).collect()] == [(1, None, "")]


def test_short_sections_beside_a_long_one_stay():
    long = "".join(f"<p>Paragraph {i}, with commas, and words enough, to be read as a part of an article.</p>" for i in range(30))
    for tag in ("article", "main", "div"):
        short = [f"Section {k} has one ordinary paragraph that is long enough to be read." for k in range(3)]
        inner = f"<section>{long}</section>" + "".join(f"<{t}><p>{s}</p></{t}>" for t, s in zip(("section", "div", "section"), short, strict=True))
        page = f'<body><nav><a href="/">Home</a></nav><{tag}>{inner}</{tag}><div class="sidebar"><p>Other, things, here.</p></div><div><ul><li><a href="/1">One more page</a><li><a href="/2">Another page</a></ul></div></body>'
        text = main_text(page)
        assert all(s in text for s in short) and "Paragraph 29" in text and "Home" not in text and "Other" not in text and "nother page" not in text


def test_sections_in_wrappers_stay():
    part = "<div><section><h2>Part {0}</h2><p>Words of part {0}, read by all.</p></section></div>"
    page = "<body><article>" + "<div><section>" + "<p>One more, long, paragraph, of words.</p>" * 30 + "</section></div>" + "".join(part.format(k) for k in range(3)) + "</article><p><a href=1>More</a></p></body>"
    assert all(f"Words of part {k}" in main_text(page) for k in range(3)) and "More" not in main_text(page)


PROSE = "<p>" + "This is a sentence of the article, with commas, and more words to read here. " * 3 + "</p>"
SECOND = "<p>" + "The second half of the story follows now, as long as the first one, and goes on. " * 3 + "</p>"


def test_layouts_whose_names_or_tags_mislead():
    both = {
        "halves": f"<body><div><div>{PROSE}</div></div><div><div>{SECOND}</div></div></body>",
        "class words around the page": f'<body><div class="nav-page has-sidebar layout"><nav><a href=x>Home</a></nav>{PROSE}{SECOND}</div></body>',
        "an article below a footer's name": f'<div class="page-footer-layout"><article>{PROSE}{SECOND}</article></div>',
        "a form around the page": f"<form><div>{PROSE}{SECOND}</div></form>",
        "a name of notices around the page": f'<main><div class="legal">{PROSE}{SECOND}</div></main>',
        "a section on related work": f'<article>{PROSE}<div class="related-work">{SECOND}</div></article>',
        "deep nesting": "<div>" * 700 + f"<nav>MENU</nav>{PROSE}{SECOND}" + "</div>" * 700,
    }
    want = " ".join(" ".join(re.sub("<[^>]*>", " ", p).split()) for p in (PROSE, SECOND))
    assert {k: main_text(v) for k, v in both.items()} == dict.fromkeys(both, want)


def test_four_blocks_side_by_side_and_what_still_goes():
    four = "".join(f"<div><div>{PROSE.replace('article', f'part{i}')}</div></div>" for i in range(4))
    assert all(f"part{i}" in main_text(f"<body>{four}</body>") for i in range(4))
    one = " ".join(re.sub("<[^>]*>", " ", PROSE).split())
    assert main_text(f'<body><div>{PROSE}</div><div class="comments">{SECOND * 20}</div></body>') == one
    links = "".join('<a href="x">Other story to read</a> ' for _ in range(20))
    assert main_text(f'<article>{PROSE}<div class="related">{links}</div></article>') == one


def test_a_head_that_is_not_closed_ends_where_the_body_begins():
    article = "First words, of the article, that are long enough to be read as a paragraph of it. Second, and more."
    want = "Heading " + article
    for before in ("<html><head><title>T</title><body>", "<html><head><title>T</title>", "<head><meta charset=x><script>var a='<p>'</script><link rel=x>", "<html><head><title>T</title><style>p{}</style></head><body>", "<title>T</title>"):
        for around in ("<article><h1>Heading</h1><p>{}</p></article>", "<h1>Heading</h1><p>{}</p>", "<div><h1>Heading</h1><p>{}</div>"):
            assert main_text(before + around.format(article)) == want, (before, around)
    assert main_text(f"<head><title>T</title>{article}") == article


def test_labels_and_formulas_inside_the_article_stay():
    page = "<body><article><p>We have <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here, and a <label>marked word</label> and <button>a key</button> in a sentence that goes on, and on.</p><xmp>if a < b & c</xmp><button>Share</button><p>The end, of it all, comes after that.</p></article><form><label>Mail</label><button>Send</button></form><div><label>Search</label></div></body>"
    assert main_text(page) == "We have x=2 here, and a marked word and a key in a sentence that goes on, and on. if a < b & c The end, of it all, comes after that."
