"""Main text of hand-made and generated pages."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tallygrid.llm.html_extract import extract, main_text

P = "The quick brown fox jumps over the lazy dog, again and again; and so on. "


@pytest.mark.parametrize("page", [None, "", "  ", "<p>", "<script>var a = '</p>';", "<!-- only", "<nav><a href=x>Home</a></nav>"])
def test_nothing(page):
    assert main_text(page) == ""


def test_article_alone():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy, now.</div><div id="cookieNotice">We use cookies.</div>
    <div class="layout"><article><header><h1>Head &amp; line</h1><p>By me</p></header><p><b>{P}<br><p>Short.<ul><li>one<li>two</ul>
    <script>x("<p>no</p>")</script><aside>{P}</aside><div class="share">Tweet</div><p>a &lt; b&nbsp;&eacute; {P * 3}</p></article>
    <section class="comments"><p>{P * 5}</p></section><form><p>{P}</p></form></div><footer>&copy; x</footer>"""
    assert main_text(page).split("\n") == ["Head & line", P.strip(), "Short.", "one", "two", f"a < b é {P * 3}".strip()]


def test_no_article_element():
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><h2>Title here</h2><p>{P * 2}</p><p>Tiny.</p><p>{P}</p></div><div id='footer'>end</div>"
    assert main_text(page) == f"Title here\n{(P * 2).strip()}\nTiny.\n{P.strip()}"


def test_a_wrapper_is_no_furniture():
    page = f"""<body><div class="sidebar-right menu-open"><div id="menu"><a href=1>Home</a></div><div class="post"><p>{P * 4}</p><p>Tiny.</p></div>
    <div class="sidebar">{P}</div><div class="comments"><p>{P * 40}</p></div></div>"""
    assert main_text(page) == f"{(P * 4).strip()}\nTiny."


@pytest.mark.parametrize("page, want", [
    ("<body><div class=post><h1>Title</h1><p>Lede, short.</p><div class=entry>{}</div></div></body>", "Title\nLede, short.\n{}"),
    ("<body><div><p>Intro.</p><blockquote>{}</blockquote><p>End.</p></div></body>", "Intro.\n{}\nEnd."),
    ("<body><div><p>Intro.</p><section>{}</section><p>End.</p></div></body>", "Intro.\n{}\nEnd."),
    ("<body><div><p>Intro.</p><ul>{}</ul><p>End.</p></div></body>", "Intro.\n{}\nEnd."),
    ("<body><div>Links</div><main><h1>Title</h1><article>{}</article></main></body>", "Title\n{}"),
])
def test_neighbours_of_the_root(page, want):
    item = "li" if "<ul>" in page else "p"
    assert main_text(page.replace("{}", f"<{item}>{P * 3}</{item}>" * 12)) == want.replace("{}", "\n".join([(P * 3).strip()] * 12))


def test_broken_markup():
    assert main_text("<article><p>a <p>b</div> c<i>d</p>e").split("\n")[0] == "a"
    assert main_text(f"<article><p>{P}<b>one<p>two</article>") == f"{P}one\ntwo"
    assert main_text("plain text only") == "plain text only"
    assert main_text("<div>" * 2000 + "deep words, here.") == "deep words, here."
    assert main_text("<p a='x>y</p><p>z") != ""


def test_very_long(spark):
    page = "<article>" + f"<p>{P}</p>" * 20_000 + "</article>"
    assert main_text(page).count("\n") == 19_999
    df = spark.createDataFrame([(1, page, "clash"), (2, None, "clash"), (2, None, "clash")], "page_id long, html string, text string")
    rows = df.select("page_id", extract(F.col("html")).alias("out")).collect()
    assert len(rows) == 3 and {r["out"] for r in rows if r["page_id"] == 2} == {""}


def test_tables_hold(spark, sf_dir):
    from tallygrid.llm.queries import op1_html_extract

    rows = op1_html_extract(spark, sf_dir).collect()
    assert len(rows) == 50 and all(r["n_chars"] == len(r["text"]) > 0 and "<" not in r["text"] for r in rows)


@pytest.mark.parametrize("part", [
    '<h2 id="related-work">Related work</h2>', '<h2 id="search">Search</h2>', '<h3 class="sidebar">Sidebar</h3>', '<h2 id="comments">Comments</h2>', '<p class="promo-text">A promoted idea, here.</p>',
    '<p class="related">It is related, too.</p>', '<section id="comments-on-policy"><p>The policy, at length.</p></section>', '<p>See <a id="footer">there</a>, and <span id="menu">here</span>.</p>',
])
def test_article_parts_with_names_of_furniture(part):
    own = " ".join(re.sub(r"<[^>]+>", "", part).split())
    page = f"<body><nav><a href=1>Home</a></nav><article><p>{P}</p>{part}<p>{P}</p></article></body>"
    assert main_text(page) == f"{P.strip()}\n{own}\n{P.strip()}"


@pytest.mark.parametrize("part", ['<p class="ad">Buy, now.</p>', '<div id="comments-section"><p>First, me.</p></div>', '<ul class="share-links"><li>Tweet</li></ul>', '<div class="promo">Buy, now, cheap.</div>', '<div id="related">More, here.</div>'])
def test_furniture_within_an_article(part):
    assert main_text(f"<body><article><p>{P}</p>{part}<p>{P}</p></article></body>") == f"{P.strip()}\n{P.strip()}"


@pytest.mark.parametrize("start", ['<div class="market-share">', '<div class="social-policy">', '<section class="login-problem">', '<blockquote class="comment">', '<div class="notice-period">', '<div class="search-engines">'])
def test_prose_stays_whatever_hints_at_it(start):
    end = "</" + start[1:].split()[0] + ">"
    for inner in (P * 2, f"<p>{P * 2}</p>", f"<p>{P}</p><p>{P}</p>"):
        page = f"<body><nav><a href=1>Home</a></nav><article>{f'<p>{P * 2}</p>' * 3}{start}{inner}{end}<p>{P * 2}</p></article></body>"
        assert main_text(page).replace("\n", " ").count("The quick brown fox") == 10, (start, inner)


@pytest.mark.parametrize("part", ['<div class="related-stories"><a href=1>One</a><a href=2>Two</a></div>', '<div class="share-this">Tweet it</div>', '<div class="newsletter-cta">Join now.</div>', '<p class="promo">Buy, now.</p>',
                                  '<p class="newsletter-signup">Get it, weekly.</p>', '<p class="notice">We moved.</p>'])
def test_short_text_goes_that_a_name_hints_at(part):
    assert main_text(f"<body><article>{f'<p>{P * 2}</p>' * 3}{part}<p>{P}</p></article></body>") == "\n".join([(P * 2).strip()] * 3 + [P.strip()])


def test_headings_after_the_root():
    page = f"<body><div class=post><h1>Title</h1><div class=entry>{f'<p>{P * 3}</p>' * 12}</div><h2>Appendix <i>A</i></h2><p>{P}</p><h2>More to read</h2><ul><li><a href=1>x</a></ul></div></body>"
    assert main_text(page) == "\n".join(["Title", *[(P * 3).strip()] * 12, "Appendix A", P.strip()])


def test_copyright_lines_outside_an_article():
    for line in ("Copyright 2020 The Example Company, Inc. All rights reserved.", "&copy; 2019-2024 Example, all rights reserved.", "(c) Example, 2001."):
        page = f"<body><div><h1>Title</h1>{f'<p>{P * 2}</p>' * 4}</div><div>{line}</div></body>"
        assert main_text(page) == "\n".join(["Title", *[(P * 2).strip()] * 4]), line
    page = f"<body><article><p>{P}</p><p>Copyright is a right, says the law of 1710.</p></article></body>"
    assert main_text(page).endswith("1710.")


def test_wrappers_as_deep_as_they_are():
    for deep in (1, 5, 40):
        page = "<body>" + '<div class="sidebar">' * deep + f"<div><p>{P * 3}</p><p>Tiny.</p></div>" + "</div>" * deep + "<div>x, y</div></body>"
        assert main_text(page).startswith(f"{(P * 3).strip()}\nTiny."), deep


def test_main_is_the_page():
    page = f"<body><main>{f'<p>{P}</p>' * 20}</main><div><p>{P}</p><p>{P}</p><p>{P}</p></div></body>"
    assert main_text(page) == "\n".join([P.strip()] * 20)
    two = f"<body><article><p>{P}</p></article><article><p>{P}</p></article></body>"
    assert main_text(two) == f"{P.strip()}\n{P.strip()}"


def test_time_is_linear():
    n = 20_000
    for page in ("<span>" * n + "<li>x" * n, "<b><div>" + "<span>" * n + "</b>x" * n, "<li><ul>" + "<i>" * n + "<dd>x" * n, "<p>" + "<em>" * n + "<div>x</div>" * n, '<div class="sidebar">x' * n):
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 10


def generated(rng):
    """A page and its main text: an article of many kinds of blocks among furniture."""
    words = "alpha beta gamma, delta epsilon. zeta eta theta; iota kappa".split()

    def sentence(least, most):
        return " ".join(rng.choices(words, k=rng.randint(least, most))) + "."

    def furniture():
        text = sentence(1, 8)
        return rng.choice([
            f"<nav><ul><li><a href=/>{text}</a></li></ul></nav>", f"<aside><p>{text}</p></aside>", f"<div class='ad-slot'>{text}</div>", f"<div id=cookie-banner><p>{text}</p></div>", f"<form>{text}<input></form>",
            f"<script>var a = '<p>{text}</p>';</script>", f"<style>p {{}} /* {text} */</style>", f"<footer><p>{text}</p></footer>", f"<!-- <p>{text}</p> -->", f"<section class='comments'><p>{text} {text}</p></section>", f"<p class='promo'>{text}</p>", f"<p class=newsletter-signup>{text}</p>", f"<div hidden>{text}</div>", f"<div role=navigation>{text}</div>",
        ])

    lines, body = [], []
    for k in range(rng.randint(6, 25)):
        text = sentence(8, 60)
        kind = rng.choice(["p", "p", "p", "h2", "li", "quote", "table", "inline", "br", "entity", "open", "furniture"]) if k else "h1"
        if kind == "furniture":
            body.append(furniture())
            continue
        if kind == "entity":
            lines.append(f"a < b & {text} é")
            body.append(f"<p>a &lt; b &amp; {text} &eacute;</p>")
        elif kind == "table":
            lines += [text, "cell, two"]
            body.append(f"<table><tr><td>{text}<td>cell, two</table>")
        elif kind == "li":
            lines += [text, text]
            body.append(f"<ul><li>{text}<li>{text}</ul>")
        elif kind == "inline":
            lines.append(f"{text} bold and link.")
            body.append(f"<p>{text} <b>bold</b> and\n\t <a href='#x'>link</a>.</p>")
        elif kind == "br":
            lines.append(f"{text} after")
            body.append(f"<p>{text}<br>after</p>")
        else:
            lines.append(text)
            body.append({"p": f"<p>{text}</p>", "open": f"<p>{text}", "quote": f"<blockquote>{text}</blockquote>", "h1": f"<h1>{text}</h1>", "h2": f"<h2 id=search-{k}>{text}</h2>"}[kind])
    article = "".join(body)
    for _ in range(rng.randint(0, 3)):
        article = rng.choice(["<div>{}</div>", "<div class='sidebar-layout'>{}</div>", "<div class=row><div class=col>{}</div></div>"]).format(article)
    article = rng.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class=post><article>{}</article></div>"]).format(article)
    around = [furniture() for _ in range(rng.randint(0, 6))]
    at = rng.randint(0, len(around))
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{''.join(around[:at])}{article}{''.join(around[at:])}</body></html>", "\n".join(lines)


def test_generated_pages():
    rng = random.Random(12)
    for _ in range(400):
        page, want = generated(rng)
        assert main_text(page) == want, page


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, html string")
    assert df.select(extract(F.col("html"))).count() == 0
