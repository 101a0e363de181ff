"""Pages that an attribute misread or a count of links would cut."""

import pytest
from netaccess.llm import html_consensus

from .conftest import invented

BODY = "<p>" + invented(3, 40, 1) + "</p>"
TEXT = " ".join(invented(3, 40, 1).split())


@pytest.mark.parametrize("open_tag", ["<article data-id='ad'>", "<article data-hidden='false'>", '<article title="a hidden gem">', "<article data-class=sidebar aria-label='menu role=navigation'>"])
def test_attributes_by_whole_name(open_tag):
    assert html_consensus.extract(f"<body><nav>x</nav>{open_tag}{BODY}</article></body>", []) == TEXT


@pytest.mark.parametrize("tag", ["<p hidden>", "<p HIDDEN=''>", "<p aria-hidden='true'>", "<p style='display: none'>", "<p role=navigation>", "<p class='x ad'>"])
def test_hidden_paragraphs_go(tag):
    assert html_consensus.extract(f"<article>{BODY}{tag}gone</p></article>", []) == TEXT


@pytest.mark.parametrize("n", [1, 2, 3, 4, 40])
def test_lists_of_links(n):
    links = "<ul>" + "".join(f"<li><a href='/{k}'>source {k}</a></li>" for k in range(n)) + "</ul>"
    listed = "\n".join(f"source {k}" for k in range(n))
    assert html_consensus.extract(f"<article>{BODY}<h2>Sources</h2>{links}</article>", []) == f"{TEXT}\nSources\n{listed}"
    assert html_consensus.extract(f"<div>{links}{BODY}</div>", []) == TEXT


def test_words_in_formulas_and_headings_stay():
    page = f"<article><p class='section-header'>Part</p>{BODY}<p>Area is <math><mi>x</mi></math> units</p></article>"
    assert html_consensus.extract(page, []) == f"Part\n{TEXT}\nArea is x units"


def test_repeated_long_and_clashing_rows(spark):
    long = "<article>" + "".join(f"<p>{invented(k, 30, 1)}</p>" for k in range(800)) + "</article>"
    rows = [(1, "http://a.example/1", long, "t"), (1, "http://a.example/1", long, "t"), (2, "http://a.example/2", f"<article>{BODY}</article>", "t")]
    got = html_consensus.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r["page_id"] for r in got) == [1, 1, 2]
    want = "\n".join(" ".join(invented(k, 30, 1).split()) for k in range(800))
    assert {r["text"] for r in got if r["page_id"] == 1} == {want}
