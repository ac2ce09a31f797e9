"""Pages whose elements have no telling names, or misleading ones: none of these layouts is among the labelled pages of the module."""

from __future__ import annotations

import re

import pytest

from shutterlake.llm import html_extract

L = "Some sentence of an article that goes on for a while, with commas, and ends at last. " * 3
S = "A shorter sentence that still says something of use."
MENU = "<a href=/>Home</a> <a href=/n>News</a> <a href=/m>More</a>"
#: What is in [[ ]] is the text to find; a bar parts blocks.
PAGES = {
    "text with br": f"<div id=x1>{MENU}</div><div id=x2>[[{L}]]<br><br>[[{L}]]</div><div id=x3>{MENU}</div>",
    "text with br, short end": f"<body><div id=x1>{MENU}</div><div id=x2>[[{L}]]<br><br>[[{S}]]</div><div id=x3>Copyright 2020</div>",
    "hashed names": f'<div class="css-1ab"><div class="css-2"><h1>[[Title]]</h1>|<p>[[{L}]]</p>|<p>[[{S}]]</p>|<ul><li>[[One]]</li>|<li>[[Two]]</li></ul></div></div>',
    "hashed names beside lists": f'<div class="a1"><div class="c2"><div class=q9>{MENU}</div><div class=zz><h1>[[Title]]</h1>|<p>[[{S}]]</p>|<p>[[{L}]]</p></div><div class=q7><ul><li><a href=x>Foo</a></li><li><a href=y>Bar</a></li></ul></div></div></div>',
    "a history of adverts": f'<div class="post ad-history"><h1>[[Title]]</h1>|<p>[[{L}]]</p></div>',
    "an advert": f'<div class="post"><h1>[[Title]]</h1>|<p>[[{L}]]</p><div class="ad-slot-3">Buy this thing now, it is cheap and good</div></div>',
    "a linked paragraph": f"<article><h1>[[Title]]</h1>|<p>[[{L}]]</p>|<p><a href=/x>[[Read the whole report of the committee here]]</a></p>|<p>[[{L}]]</p></article>",
    "a linked paragraph without names": f"<div class=css-8><h1>[[Title]]</h1>|<p>[[{L}]]</p>|<p><a href=/x>[[Read the whole report]]</a></p>|<p>[[{L}]]</p></div>",
    "table for layout": f"<table><tr><td width=100><a href=/>Home</a> <a href=/n>News</a></td><td><h1>[[Title]]</h1>|<p>[[{L}]]</p>|<p>[[{S}]]</p></td></tr></table>",
    "table for layout, text with br": f"<body><table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td>[[{L}]]<br>[[{L}]]</td></tr></table>",
    "table of data": f"<article><p>[[{L}]]</p>|<table><tr><td>[[Year]]</td>|<td>[[Count]]</td></tr>|<tr><td>[[2001]]</td>|<td>[[17]]</td></tr></table></article>",
    "responses": f'<article><h1>[[Title]]</h1>|<p>[[{L}]]</p></article><section class="user-responses"><h3>What people say</h3><div><p>{L}</p></div></section>',
    "list of links before": f"<body><ul><li><a href=/>Home</a></li><li><a href=/b>B</a></li></ul><h1>[[Title]]</h1>|<p>[[{L}]]</p></body>",
    "nothing but links": f"<nav>{MENU}</nav><footer>Imprint</footer>",
    "scripts and styles": f"<div class=k1><script>var a = '{S}';</script><style>p {{ color: red }}</style><h1>[[Title]]</h1>|<p>[[{L}]]</p><noscript>{S}</noscript></div>",
}


@pytest.mark.parametrize("name", PAGES)
def test_layout(name):
    page = PAGES[name]
    found = [" ".join(" ".join(re.findall(r"\[\[(.*?)\]\]", block, re.S)).split()) for block in page.split("|")]
    html = page.replace("[[", "").replace("]]", "").replace("|", "")
    assert html_extract.default_model().text(html) == "\n\n".join(b for b in found if b)


def test_densest_part_is_used_only_without_content():
    model = html_extract.default_model()
    page = html_extract.Page("<div class=x><div class=y><h1>T</h1><p>" + L + "</p></div><div class=z>" + MENU + "</div></div>")
    chosen = html_extract.densest(page)
    assert [t[:4] for k, t in page.blocks if chosen[k]] == ["T", "Some"]
    assert not any(html_extract.densest(html_extract.Page(f"<div>{MENU}</div><footer><p>{L}</p></footer>")))
    assert model.text("<p>Hello there</p>") == "Hello there"
