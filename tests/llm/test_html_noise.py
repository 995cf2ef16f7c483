"""Noise inside a line: it leaves the text, and the line stays one."""

import pytest

from lociforge.llm.html_text import ARTICLE, NOISE, NOISE_NAMES, NOISE_ROLES, NOISE_TAGS, BLOCK_TAGS, blocks, html_text

INLINE = [f"{t}" for t in sorted(NOISE_TAGS - BLOCK_TAGS - {"head"})]
INLINE += [f"{t} class={n}" for t in ("span", "a", "b", "em") for n in ("ad", "share", "comments", "newsletter", "share-buttons")]
INLINE += [f"span role={r}" for r in sorted(NOISE_ROLES)] + ["span hidden", "i aria-hidden=true", "a style='display: none'", "span id=cookie-notice"]


def article(page):
    return [t for r, t in blocks(page) if r == ARTICLE]


@pytest.mark.parametrize("start", INLINE)
def test_inline_noise(start):
    tag = start.split()[0]
    assert article(f"<article><p>real <{start}>BUY <i>now</i></{tag}> text</p><p>next</article>") == ["real text", "next"]
    assert article(f"<article><{start}>BUY</{tag}>real<{start}>more</{tag}></article>") == ["real"]
    assert article(f"<article><p>re<{start}>BUY</{tag}>al</p><{start}>only noise</{tag}><p>x</article>") == ["real", "x"]
    assert article(f"<article><p>real <{start}>not closed<p>next</article>")[:1] == ["real"]
    assert [t for r, t in blocks(f"<article><p>real <{start}>BUY</{tag}> text</article>") if r == NOISE] == ["BUY"]


@pytest.mark.parametrize("name", ["related-posts", "share-buttons", "ad-slot", "entry-footer", "article-footer", "comment-form", "user-comments", "newsletter-form", "cookie-policy", "social-media", "post-comments", *sorted(NOISE_NAMES)])
def test_names_of_noise(name):
    assert article(f"<article><p>a</p><div class='{name}'>b</div><p>c</p></article>") == ["a", "c"]


@pytest.mark.parametrize("name", ["article-header", "entry-header", "entry-title", "post", "posts", "policy", "user", "form", "media", "button", "social-studies", "notice-board"])
def test_names_of_text(name):
    assert article(f"<article><p>a</p><div class='{name}'>b</div><p>c</p></article>") == ["a", "b", "c"]


def test_inline_roles_that_are_no_noise():
    assert blocks("<p>x <span itemprop=articleBody>y</span> z") == [(1, "x"), (ARTICLE, "y"), (1, "z")]
    assert article("<article><p>a <b>b <a href=x>c</a></b> d<br>e</p>") == ["a b c d e"]


def test_long_url_and_host(spark):
    rows = [(k, f"http://{'h' * 5000}.example/{'u' * 50_000}", f"<div>menu of all the many pages on this site here</div><div>own {k} {'w' * 9000}</div>") for k in range(3)]
    got = {r.page_id: r.text for r in html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"own {k} {'w' * 9000}" for k in range(3)}
