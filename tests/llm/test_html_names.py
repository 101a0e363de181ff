"""Names are weak evidence: no article goes for a name, page parts still do; deep and broken pages; a plain walker on small pages."""

import time
import tracemalloc
from html.parser import HTMLParser

import pytest

from netaccess.llm.html_consensus import extract, extract_pages

from .conftest import invented

TEXT = " ".join(invented(3, 60, 1).split())
MORE = " ".join(invented(4, 40, 1).split())


@pytest.mark.parametrize(
    "tag", ["section id='discussion'", "div class='side-effects'", "section id='share-capital'", "div class='search-results'", "div class='alert-system-design'", "section class='ad-hoc-networks'", "div id='comment-on-ruling'", "div class='related-work'", "section class='notice'", "div id='banner'"]
)
def test_sections_of_an_article_stay(tag):
    page = f"<body><nav>menu</nav><article><h1>Head</h1><p>{TEXT}</p><{tag}><h2>Part</h2><p>{MORE}</p></{tag.split()[0]}></article></body>"
    assert extract(page, []) == f"Head\n{TEXT}\nPart\n{MORE}"


@pytest.mark.parametrize("tag", ["h2 id='discussion'", "h2 class='related'", "h3 id='share'"])
def test_headings_stay(tag):
    assert extract(f"<article><p>{TEXT}</p><{tag}>Part</{tag.split()[0]}><p>{MORE}</p></article>", []) == f"{TEXT}\nPart\n{MORE}"


@pytest.mark.parametrize(
    "junk", ["div class='ad'", "div class='ad-banner left'", "div id='cookie-notice'", "section class='comments'", "div class='commentList'", "section id='comments'", "div class='related-posts'", "div class='sidebar-left'", "aside", "div class='share-buttons'", "div id='disqus_thread'", "div class='newsletter-signup'", "footer", "div role='navigation'", "ul class='breadcrumbs'"]
)
def test_page_parts_go(junk):
    name = junk.split()[0]
    for page in (f"<article><p>{TEXT}</p><{junk}><p>gone and gone</p></{name}><p>{MORE}</p></article>", f"<div class='x'><p>{TEXT}</p><{junk}><p>gone and gone</p></{name}><p>{MORE}</p></div>"):
        assert extract(page, []) == f"{TEXT}\n{MORE}"


def test_header_of_an_article_stays_and_the_page_header_goes():
    assert extract(f"<body><header><h1>Site</h1></header><article><header><h1>Head</h1></header><p>{TEXT}</p></article></body>", []) == f"Head\n{TEXT}"


def test_a_weak_name_around_the_whole_text_may_win():
    assert extract(f"<body><div class='ad'><p>buy</p></div><div class='overlay'><p>{TEXT}</p><p>{MORE}</p></div></body>", []) == f"{TEXT}\n{MORE}"


def test_host_votes_overrule_names(spark):
    rows = [(k, f"http://h.example/{k}", f"<body><div class='discussion'><p>{invented(k, 50, 1)}</p></div><div class='footer'><p>x</p></div></body>") for k in range(6)]
    rows.append((9, "http://h.example/9", f"<body><div class='discussion'><p>Short.</p></div><div class='b'><p>{TEXT}</p></div></body>"))
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "Short." and all(got[k] == " ".join(invented(k, 50, 1).split()) for k in range(6))


def test_elements_that_never_end():
    assert extract(f"<article><p>{TEXT}</p><svg><path d='x'/><p>{MORE}</p></article>", []) == f"{TEXT}\n{MORE}"
    assert extract(f"<article><p>{TEXT}</p><script>var x = '<p>{MORE}</p>';", []) == TEXT


def test_deep_pages_take_memory_and_time_as_they_are_long():
    peaks = []
    for n in (10_000, 50_000):
        page = "<div class='a b'>" * n + f"<p>{TEXT}</p>" + "</section>" * n + "</div>" * n
        tracemalloc.start()
        began = time.time()
        assert extract(page, []) == TEXT
        assert time.time() - began < 20
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 7 * peaks[0] and peaks[1] < 200_000_000
    page = "<article>" + "<div>one" * 20_000 + "</article>"
    began = time.time()
    assert extract(page, []) == "\n".join(["one"] * 20_000) and time.time() - began < 20


class Walker(HTMLParser):
    """A plain reading of well-formed pages: blocks inside article, without the parts that the page marks."""

    def __init__(self):
        super().__init__()
        self.out, self.held, self.inside, self.skip = [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        junk = tag in ("nav", "footer", "aside", "script", "style", "form") or dict(attrs).get("class") == "ad"
        self.skip += 1 if junk or self.skip else 0
        self.inside += tag == "article"
        if tag in ("p", "div", "h1", "li", "ul", "article"):
            self.close_block()

    def handle_endtag(self, tag):
        if tag in ("p", "div", "h1", "li", "ul", "article"):
            self.close_block()
        self.skip -= 1 if self.skip else 0
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.held.append(data)

    def close_block(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.out.append(text)


@pytest.mark.parametrize("seed", range(40))
def test_small_pages_equal_a_plain_walker(seed):
    import random

    r = random.Random(seed)

    def element(depth):
        kind = r.choice(["p", "p", "div", "ad", "ul", "aside", "script"] if depth < 3 else ["p"])
        words = lambda: f"{invented(r.randrange(10**6), r.randint(4, 20), 1)} &amp; <b>x</b> &eacute;"
        if kind == "p":
            return f"<p>{words()}</p>"
        if kind == "ad":
            return f'<div class="ad">{words()}</div>'
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{words()}</li>" for _ in range(3)) + "</ul>"
        if kind in ("aside", "script"):
            return f"<{kind}>gone</{kind}>"
        return "<div>" + "".join(element(depth + 1) for _ in range(r.randint(1, 4))) + "</div>"

    page = f"<html><body><nav><p>menu</p></nav><article><h1>Head {seed}</h1><p>{TEXT}</p>{''.join(element(0) for _ in range(6))}</article><footer>end</footer></body></html>"
    plain = Walker()
    plain.feed(page)
    plain.close_block()
    assert extract(page, []) == "\n".join(plain.out)
