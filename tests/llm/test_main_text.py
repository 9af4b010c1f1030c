"""Main text of pages: what decides it, deep and odd pages, and the whole choice against brute force."""

import random
import time
import tracemalloc

import pytest

from gridloom.llm import html_extract

PAGES = "page_id long, url string, html string"


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}


def words(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_story_beside_a_teaser(spark):
    rows = [(i, "http://a.x/", f"<body><nav>m</nav><div id='story'><p>{words(65, f's{i}x')}</p></div><article class='teaser'><p>{words(40, f't{i}x')}</p></article></body>") for i in range(5)]
    rows += [(10, "http://lone.x/", rows[0][2])]
    got = extracted(spark, rows)
    assert all(got[i] == words(65, f"s{i}x") for i in range(5)) and got[10] == words(65, "s0x")


def test_heading_and_two_articles(spark):
    page = "<body><nav>m</nav><h1>Head {0}</h1><article class='a'><p>First {0} with some words.</p></article><article class='b'><p>Second {0} with some more.</p></article><footer>f</footer></body>"
    rows = [(i, "http://a.x/", page.format(i)) for i in range(5)] + [(10, "http://lone.x/", page.format(10))]
    got = extracted(spark, rows)
    assert all(got[i] == f"Head {i}\n\nFirst {i} with some words.\n\nSecond {i} with some more." for i in got) and len(got) == 6


def test_discussion_of_an_article(spark):
    page = "<body><article><h1>T{0}</h1><p>Results {0}.</p><section id='discussion'><p>We discuss {0}.</p></section><section class='comments'><p>nice {0}</p></section></article><div id='discussion'><p>reader {0}</p></div></body>"
    rows = [(i, "http://a.x/", page.format(i)) for i in range(5)] + [(10, "http://lone.x/", page.format(10))]
    got = extracted(spark, rows)
    assert all(t == f"T{i}\n\nResults {i}.\n\nWe discuss {i}." for i, t in got.items())


def test_the_template_decides_beside_articles(spark):
    """Unnamed parts around an article: what all pages have goes, what is a page's own stays; with no template neither is known."""
    page = "<body><div>Welcome to our shop</div><div><p>Own intro {0} of this page.</p></div><article><p>Body {0} text that is longer, by some words at least, than all of the rest together is.</p></article><div>Call us any time</div><div><a>more</a> <a>links {0}</a></div></body>"
    rows = [(i, "http://a.x/", page.format(i)) for i in range(6)] + [(10, "http://lone.x/", page.format(10))]
    got = extracted(spark, rows)
    body = "Body {0} text that is longer, by some words at least, than all of the rest together is."
    assert all(got[i] == f"Own intro {i} of this page.\n\n{body.format(i)}" for i in range(6)) and got[10] == body.format(10)


def test_articles_that_hold_little(spark):
    page = f"<body><div><p>{words(80, 'w')}</p></div><article><p>small aside</p></article></body>"
    assert extracted(spark, [(1, "http://lone.x/", page)])[1] == words(80, "w") + "\n\nsmall aside"


def test_a_main_holds_all(spark):
    page = "<body><h1>Site</h1><main><div><p>One {0}.</p></div><article><p>Two {0}.</p></article></main><p>outside {0}</p></body>"
    got = extracted(spark, [(i, "http://a.x/", page.format(i)) for i in range(5)])
    assert all(t == f"One {i}.\n\nTwo {i}." for i, t in got.items())


def test_drawings_and_controls_are_no_text(spark):
    page = "<body><article><p>Before <svg><title>T</title><text>drawn</text></svg>after <button>press</button>it.</p></article></body>"
    assert extracted(spark, [(1, "http://a.x/", page)])[1] == "Before after it."


@pytest.mark.parametrize(("url", "host"), [("//u:p@Host.x:80/a", "host.x"), ("https://host.x", "host.x"), ("http://host.x:8080?q", "host.x"), (None, ""), ("host.x/a", "")])
def test_hosts(spark, url, host):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(url,)], "u string").select(html_extract.host_of(F.col("u"))).first()[0] == host


def test_deep_pages_take_linear_memory_and_time():
    """100,000 nested elements, and as many end tags of nothing."""
    tracemalloc.start()
    started = time.perf_counter()
    page = html_extract.parse("<div class='n'>" * 100_000 + "deep text" + "</span>" * 100_000 + "</div>" * 100_000)
    row = html_extract.parsed_row("<p>x")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [b[1] for b in page.blocks] == ["deep text"] and len(page.steps) == 100_001 and row[6] == ["x"]
    assert peak < 200 << 20 and time.perf_counter() - started < 60


def test_deep_pages_through_spark(spark):
    deep = "<body>" + "<div>" * 20_000 + "<p>far down</p>"
    rows = [(i, "http://deep.x/", deep + f"<p>own {i}") for i in range(5)]
    assert extracted(spark, rows) == {i: f"far down\n\nown {i}" for i in range(5)}


# the whole choice by brute force: pages as trees, templates by comparing pages pairwise where the layout is regular --------------


def test_the_choice_is_brute_force(spark):
    """Pages of parts in a fixed order, each the template's or a page's own: what has to stay is known from how they are made."""
    rng = random.Random(3)
    rows, want = [], {}
    for host in range(8):
        kind = ("article", "main", "div")[host % 3]
        fixed = [f"Fixed part {host} {k} of the frame." for k in range(3)]
        n = 6 + host
        for i in range(n):
            own = [f"Page {host} {i} part {k}: {words(rng.randint(6, 20), f'v{host}x{i}x{k}x')}" for k in range(rng.randint(1, 3))]
            aside = f"<div class='comments'><p>reader {i}</p></div>" if rng.random() < 0.5 else ""
            inner = "".join(f"<p>{t}</p>" for t in own)
            body = f"<div>{fixed[0]}</div><nav>menu {i}</nav><{kind}>{inner}{aside}</{kind}><div>{fixed[1]}</div><div class='x'>{fixed[2]}</div><footer>end {i}</footer>"
            rows.append((len(rows), f"https://h{host}.x/{i}", f"<html><head><title>t{i}</title></head><body>{body}</body></html>"))
            want[len(rows) - 1] = "\n\n".join(own)
    assert extracted(spark, rows) == want
