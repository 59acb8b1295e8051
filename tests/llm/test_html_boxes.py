"""Articles within wrappers that are named after boxes, stray quotes, several articles."""

import pytest

from netloom.llm.html import Page

BODY = "<h1>The title</h1><p>" + "Some words of the article here. " * 10 + "</p>"
TEXT = "The title\n" + ("Some words of the article here. " * 10).strip()


@pytest.mark.parametrize("name", ["site has-sidebar", "no-sidebar", "with-header", "main-nav-layout", "dept-social"])
def test_wrappers_named_after_boxes_keep_the_article(name):
    assert Page(f'<body><div class="{name}">{BODY}<div class="sidebar">Links of the side</div></div></body>').text(None) == TEXT


def test_boxes_and_hidden_parts_go():
    html = f'<body><div>{BODY}<div class="comments"><p>{"a long comment " * 20}</p></div><div class="share">Share this</div><p hidden>secret</p></div><div class="promo-2">Buy</div></body>'
    assert Page(html).text(None) == TEXT
    assert Page('<div><p>Before <span class="share">Tweet</span> and after.</p></div>').text(None) == "Before and after."


def test_headings_and_notes_of_the_article_stay():
    html = f'<body><article><h2 class="section-header">Part one</h2>{BODY}<p class="editor-comment">A note.</p></article></body>'
    assert Page(html).text(None) == f"Part one\n{TEXT}\nA note."


@pytest.mark.parametrize("tag", ["<p data-x=it's>", "<p x='a > b' y=\"c > d\">", "<p 'stray>", '<p title= "two > one">'])
def test_quotes_count_after_an_equals_sign_only(tag):
    assert Page(f"<body><div>{tag}Hello there.</p><p>More.</p></div>").text(None) == "Hello there.\nMore."


def test_an_open_quote_takes_the_rest():
    assert Page('<div>Text<a href="x>gone</div>').text(None) == "Text"
    assert Page("<p " + "a=' " * 50_000).text(None) == ""  # in time linear in the length


def test_two_articles_are_both_kept():
    html = f'<body><article class="a">{BODY}</article><article class="b"><p>{"Another piece. " * 12}</p></article><article class="teaser"><a href="x">{"elsewhere " * 9}</a></article></body>'
    assert Page(html).text(None) == TEXT + "\n" + ("Another piece. " * 12).strip()
