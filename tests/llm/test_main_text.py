"""Main text of pages: templates with known texts, minimum cuts against all labellings, awkward rows."""

import itertools
import random

import pytest

from veritrail.llm import main_text

P1 = "The council met on Tuesday to decide about the new bridge, which has been discussed for more than four years."
P2 = "Most members spoke in favour of the shorter route, although the costs are higher than those of the older plan."
P3 = "A final vote is expected in March, when the survey of the river bed has been finished by the engineers."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
MENU = '<div class="main-menu"><a href="/">Home</a> <a href="/a">Sport</a> <a href="/b">Weather</a></div>'
FOOTER = "<footer><p>&copy; 2024 The Daily Example. All rights reserved.</p><a href='/imprint'>Imprint</a></footer>"
COMMENTS = f'<section id="comments"><h2>2 Comments</h2><article class="comment"><p>{P2[::-1]} I do not agree at all with what was said here.</p></article><article class="comment"><p>Great report, thanks.</p></article></section>'
BODY = f"<h1>A new bridge</h1><p>{P1}</p><p>Yes.</p><p>{P2}</p><p>{P3}</p>"
TEXT = f"A new bridge {P1} Yes. {P2} {P3}"

PAGES = {
    "article": (f"<html><head><title>x</title></head><body>{NAV}<article>{BODY}</article>{FOOTER}</body></html>", TEXT),
    "comments": (f"<body>{NAV}<main><article>{BODY}</article>{COMMENTS}</main>{FOOTER}", TEXT),
    "comments within the article": (f"<body>{NAV}<article>{BODY}{COMMENTS}</article>{FOOTER}", TEXT),
    "class names": (f'<body class="has-sidebar">{MENU}<div id="content"><div class="post">{BODY}</div><div class="sidebar"><h3>Popular</h3><p>{P3} {P3}</p></div></div><div class="footer">Imprint and contact</div>', TEXT),
    "no hints": (f'<body><div><a href="/">Home</a></div><div><a href="/n">News</a></div><div>{BODY}</div><div><a href="/i">Imprint</a> <a href="/c">Contact</a></div></body>', TEXT),
    "cookie notice": (f'<body><div>We use cookies to improve your experience. <button>Accept</button></div>{NAV}<main>{BODY}</main>{FOOTER}', TEXT),
    "advert inside": (f'<article><h1>A new bridge</h1><p>{P1}</p><div class="ad">Buy one, get another one for free, today only, in all our shops.</div><p>Yes.</p><p>{P2}</p><aside><p>{P3}</p></aside><p>{P3}</p></article>', TEXT),
    "forms": (f'<form id="page"><header class="site-header"><p>The Daily Example</p></header><main>{BODY}<form action="/s"><label>Your address</label><input><button>Subscribe to our letter</button></form></main></form>', TEXT),
    "header in the article": (f"<body><header><p>The Daily Example</p><p>Independent since 1871, every day but Sunday.</p></header><article><header><h1>A new bridge</h1></header><p>{P1}</p><p>Yes.</p><p>{P2}</p><p>{P3}</p></article>", TEXT),
    "table layout": (f'<table><tr><td><a href="/">Home</a><br><a href="/n">News</a><td>{BODY}<tr><td colspan=2>Copyright 1999</table>', TEXT),
    "hidden": (f'<article>{BODY}<div style="display: none">{P1}</div><p hidden>{P1}</p></article>', TEXT),
    "unclosed": (f"<body><nav><ul><li><a href=/>Home<li><a href=/n>News</ul></nav><article><h1>A new bridge</h1><p><b>{P1}<p>Yes.<p>{P2}<br><p>{P3}</article>", TEXT),
    "script": (f'<script>var t="</p><p>{P1}</p>";</script><style>p{{margin:0}}</style><article>{BODY}<script>if (a<b) t("<p>no</p>")</script></article>', TEXT),
    "references": ("<article><p>Fish &amp; chips &lt;b&gt; &eacute;t&#233; &#x2014; caf&eacute;&nbsp;au  lait,\n\n served all the day in the small houses near the harbour.</p></article>", "Fish & chips <b> été — café au lait, served all the day in the small houses near the harbour."),
    "comment marks": (f"<article><!-- <p>no</p> --><p>{P1}</p><!-- open <p>{P2}</p>", P1),
    "inline": ("<article><p>The <b>quick</b> <i>brown</i><a href=x>fox</a> jumps over the lazy dog and then it runs back home again.</p></article>", "The quick brownfox jumps over the lazy dog and then it runs back home again."),
    "nothing": ("", ""),
    "menus only": (NAV + FOOTER, ""),
    "plain text": (P1 + " " + P2, P1 + " " + P2),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_templates(name):
    page, want = PAGES[name]
    found = main_text.blocks(page)
    keep = main_text.content(found, main_text.prior())
    assert " ".join(b.text for b, k in zip(found, keep) if k) == want


def test_minimum_cut_is_that_of_all_labellings():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randint(1, 8)
        gain = [rng.randint(-5, 5) for _ in range(n)]
        edges = [(i, j, rng.randint(0, 4)) for i in range(n) for j in range(i) if rng.random() < 0.4]

        def cost(side):
            return sum(abs(g) for g, s in zip(gain, side) if g and (g > 0) != s) + sum(w for i, j, w in edges if side[i] != side[j])

        assert cost(main_text.cut_side(gain, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_training_moves_weights_and_keeps_the_prior_without_labels():
    cells = [([0, 0, 0, 0, 0, 0], True, 50), ([7, 0, 0, 0, 0, 0], False, 50)]
    weights = main_text.trained(cells)
    assert weights[0][0] > main_text.PRIOR["words"][0] and weights[0][7] < main_text.PRIOR["words"][7]
    assert weights[0][3] == pytest.approx(main_text.PRIOR["words"][3])
    assert main_text.trained(cells[:1]) == main_text.prior()


def test_rows(spark):
    schema = "page_id bigint, url string, html string, text int, n_chars string"
    page = PAGES["article"][0]
    made = [(1, "a", page, 1, "x"), (1, "a", page, 1, "x"), (None, None, None, None, None), (2, "b", "", 0, ""), (3, None, "<<<>><p", 0, "")]
    got = main_text.extract(spark.createDataFrame(made, schema)).collect()
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got), key=repr)[:2] == [(1, "a", TEXT, len(TEXT))] * 2
    assert len(got) == 5 and {r.n_chars == len(r.text) for r in got} == {True}
    assert main_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_long_pages_take_time_in_proportion():
    """A megabyte of paragraphs, of nested elements, of stray marks and of one script."""
    rng = random.Random(1)
    short = "".join(rng.choice([f"<p>{P1}</p>", "<p>Yes.</p>", "<li><a href=x>Home</a></li>"]) for _ in range(15_000))
    found = main_text.blocks(f"<body><div>{short}</div></body>")
    keep = main_text.content(found, main_text.prior())
    assert len(found) == len(keep) == 15_000
    for page in ("<div>" * 100_000 + P1, "<" * 300_000, '<a "' * 100_001, "<script>" + short, "</p>" * 200_000, "&amp" * 200_000):
        main_text.content(main_text.blocks(page), main_text.prior())
