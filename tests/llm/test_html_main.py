"""Main text of nested, long and loosely marked pages."""

import random
import time

import pytest

from wayfold.llm import html_main

P = "<p>" + "Some text, with commas, of an article, that goes on. " * 6 + "</p>"
NAV = '<nav><a href="/">Home</a></nav>'


def page(body):
    return f"<html><head><title>t</title></head><body>{NAV}{body}<footer>Imprint</footer></body></html>"


def paragraphs(n, word):
    return "".join(f"<p>{word}{k} " + "goes on, and on, and on, " * 12 + "</p>" for k in range(n))


@pytest.mark.parametrize("n", [1, 7, 20, 2000])
@pytest.mark.parametrize("wrap", ["article", "main"])
def test_article_keeps_short_blocks(n, wrap):
    rest = "<ul><li>first</li><li>second</li></ul><table><tr><th>head</th><td>cell</td></tr></table><dl><dt>term</dt><dd>meaning</dd></dl><figure><figcaption>caption</figcaption></figure>"
    got = html_main.extract(page(f"<{wrap}><h1>Title</h1><div>{P * n}</div>{rest}</{wrap}>")).split("\n\n")
    assert got[0] == "Title" and len(got) == n + 8
    assert got[-7:] == ["first", "second", "head", "cell", "term", "meaning", "caption"]


@pytest.mark.parametrize("n", [3, 30, 300])
@pytest.mark.parametrize("wrap", ["article", "main", "div"])
def test_nested_sections(n, wrap):
    body = f"<section><div>{paragraphs(n, 'a')}</div></section><section><div>{paragraphs(2, 'b')}<div class='ad'>Buy</div></div></section><section><div><div>{paragraphs(1, 'c')}</div></div></section>"
    got = html_main.extract(page(f"<{wrap}>{body}</{wrap}>")).split("\n\n")
    assert [x.split()[0] for x in got] == [f"a{k}" for k in range(n)] + ["b0", "b1", "c0"]


def test_main_around_article():
    menu = "<ul><li><a href='/1'>Most read one</a></li><li><a href='/2'>Most read two</a></li></ul>"
    got = html_main.extract(page(f"<main><h1>Title</h1>lead<article><div>{P * 20}</div></article>{menu}<ul><li>short</li></ul></main>")).split("\n\n")
    assert got[:2] == ["Title", "lead"] and got[-1] == "short" and len(got) == 23


def test_without_marks():
    menu = "<div><a href='/1'>Most read one</a> <a href='/2'>Most read two</a></div>"
    got = html_main.extract(page(f"{menu}<div><h1>Title</h1><div><div>{P * 20}</div><ul><li>short</li></ul></div>then {P}</div>")).split("\n\n")
    assert got[0] == "Title" and got[21] == "short" and got[22] == "then" and len(got) == 24


@pytest.mark.parametrize("start, end", [("<html><body>", "</body></html>"), ("", "")])
def test_text_right_in_body(start, end):
    got = html_main.extract(start + "A long line of body text, one, two, three. <hr>" * 30 + "<div><p>A short note, at the end of it.</p></div>" + end)
    assert got.count("A long line") == 30 and got.endswith("A short note, at the end of it.")


BODY = "".join(f"<p>Part {k} goes on, and on, and on, about {k} things that matter here.</p>" for k in range(4))
COMMENT = "<p>" + "I, for one, do not agree with any of this, and I say so at length. " * 8 + "</p>"


@pytest.mark.parametrize(
    "wrap",
    [
        "<div class='content has-sidebar'>{}</div>",
        "<div class='post hentry comments-open'>{}</div>",
        "<section id='no-sidebar'>{}</section>",
        "<div class='content-sidebar-wrap'>{}</div>",
        "<div class='ad-free with-comments'>{}</div>",
        "<form id='aspnetForm' class='page'>{}</form>",
        "<div class='sidebar'><article>{}</article></div>",
        "<div class='widget'><h1>Part head</h1>{}</div>",
        "<div class='entry-header'><h1>Part head</h1></div><div>{}</div>",
    ],
)
def test_theme_names_keep_the_article(wrap):
    got = html_main.extract(page(wrap.format(BODY)))
    assert got.count("goes on") == 4 and "Home" not in got and "Imprint" not in got
    assert ("Part head" in got) == ("Part head" in wrap)


@pytest.mark.parametrize("noise", ["<div class='comments'>{}</div>", "<div id='post-comments'>{}</div>", "<ol class='comment-list'><li><article class='comment-body'>{}</article></li></ol>", "<article class='comment'>{}</article>", "<div class='cookie-banner'>{}</div>", "<div class='newsletter_signup'>{}</div>", "<div class='siteFooter'>{}</div>", "<div role='search'>{}</div>", "<p hidden>x</p><form>{}</form>", "<div style='display: none'>{}</div>"])
@pytest.mark.parametrize("wrap", ["<article>{}</article>{}", "<article>{}{}</article>", "<div>{}</div>{}", "<main><div>{}</div>{}</main>"])
def test_noise_goes_however_long(noise, wrap):
    got = html_main.extract(page(wrap.format(BODY, noise.format(COMMENT * 12))))
    assert got.count("goes on") == 4 and "agree" not in got


def test_short_article_beside_a_long_notice():
    got = html_main.extract(page("<article><p>Short.</p></article><div class='cookie-banner'><p>" + "We use cookies, all of them. " * 9 + "</p></div>"))
    assert got == "Short."


def plain_points(nodes, blocks):
    """Points by walking all ancestors of every paragraph."""
    points, text, link = ({n: 0.0 for n in nodes} for _ in range(3))
    for node, piece in blocks:
        up, share = html_main._receiver(node), 1.0
        while up is not None and (share == 1.0 or up.tag not in ("#root", "html")):
            points[up] += share * html_main.paragraph_points(piece)
            share = html_main.GRANDPARENT if share == 1.0 else share * html_main.FADE
            up = up.parent
        while node is not None:
            text[node] += len(piece)
            node = node.parent
    for n in nodes:
        up = n
        while up is not None:
            link[up] += 0 if n.hidden else own[n]
            up = up.parent
    out = []
    for n in nodes:
        extra = html_main.STRONG.get(n.tag, 0.0) + (10.0 if n.good else 0.0)
        out.append((points[n] + extra if points[n] else 0.0) * (1 - min(1.0, link[n] / max(1, text[n]))))
    return out


own = {}


def test_points_are_those_of_the_plain_form():
    rng = random.Random(5)
    tags = ["div", "p", "a", "b", "section", "li", "ul", "article", "td", "table", "span", "blockquote", "h2"]
    for _ in range(60):
        body = "".join(rng.choice([f"<{t}>", f"</{t}>", "some words, and more ", f"<{t} class='content'>", f"<{t} class='ad'>"]) for t in rng.choices(tags, k=80))
        nodes, blocks = html_main.parse(f"<html><body>{body}</body></html>")
        blocks = html_main.settle(nodes, blocks)
        own.clear()
        own.update({n: n.link for n in nodes})
        html_main.score(nodes, blocks)
        assert [n.points for n in nodes] == pytest.approx(plain_points(nodes, blocks))


@pytest.mark.parametrize("piece", ["<div><a>x", "<i>y</b>", "<b><div><i>z</b>", "<span>q<p>w", "<li><p>v", "<td><ul><a href='#'>u", "<div class='comments'>t", "</p></i></td>"])
def test_markup_without_end_takes_linear_time(piece):
    start = time.monotonic()
    html_main.extract(piece * 60_000)
    assert time.monotonic() - start < 20


def test_long_text_and_odd_letters():
    assert html_main.extract("<p>İ" * 50 + "<script>x</script>after") .endswith("after")
    words = "word " * 400_000
    assert html_main.extract(page(f"<article><p>{words}</p></article>")) == words.strip()
    assert html_main.extract(None) == html_main.extract("") == html_main.extract("<nav>x</nav>") == html_main.extract("<scri") == ""
    assert html_main.extract("<ul><li><p>one<li><p>two</ul>tail") == "one\n\ntwo\n\ntail"
