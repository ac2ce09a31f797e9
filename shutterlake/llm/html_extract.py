"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node that is content or not. A node's potential comes from its tag and whether that stands in an
article, the kind of its class and id names, the length of its own text and the share of that text inside links; a
parent-child potential connects it to its parent. Sum-product messages, once up and once down the tree, give each node's
exact marginal; the text of nodes with a marginal above one half is the page's text. Potentials are relative
frequencies, with one added, counted on labelled pages, those of a pair for parts of a page and for pieces of text each: HTML in which data-content="1" or "0" labels an element and what
it holds. Where no text has a marginal above one half, the text is that of the densest part of the page (`densest`).

Pages are independent, so the work is one mapInArrow over the rows, whole pages, nothing shuffled; the model is a
few hundred numbers. Memory is one batch of pages and one page's tree; time is linear in the page, whatever it holds.

Defined results: null or empty html gives an empty text; broken, unclosed or cut markup is read like a browser does
(an open p ends where a block begins, elements left open end with the page, a cut last tag is dropped), but for a quote
that is never closed: its value ends at the next > or space. Elements that HTML does not know do not break a block, nor
do scripts, pictures and controls inside one, whose own text is left out. Repeated rows and null ids each give their own
row; an empty table gives an empty result; other columns are not looked at. White space is any run that str.split knows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: Fixed values of HTML: elements without an end, elements that are blocks, elements whose text is not shown, elements whose
#: content is no markup, and start tags that end an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
BLOCK = CLOSES_P | frozenset("html body li dt dd tr td th thead tbody tfoot caption colgroup legend optgroup frameset".split())
HIDDEN = frozenset("script style noscript template title textarea iframe noembed noframes xmp object audio video canvas svg head select datalist button".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
#: An opening tag that ends an open one of the listed elements, looked for up to a limit element.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ENDS |= dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}))
#: What an end tag or a new paragraph does not reach beyond.
SCOPE = frozenset("table td th caption button object html".split())

#: Word stems in class and id names, by what they say; the first kind that matches counts.
NAMES = (
    ("comment", "comment comments commentlist reply replies response responses disqus discussion respond reactions opinions feedback kommentar kommentare commentaire commentaires comentario comentarios"),
    ("notice", "cookie cookies consent notice notification alert gdpr popup modal overlay toast warning"),
    ("ad", "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner commercial werbung anzeige publicite publicidad"),
    ("form", "form subscribe subscription newsletter signup login search contact"),
    ("nav", "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip"),
    ("side", "sidebar side aside widget related recommended recommendations recent trending popular share sharing social tags complementary"),
    ("footer", "footer foot copyright legal contentinfo colophon"),
    ("header", "header head masthead topbar logo brand"),
    ("content", "content article post entry story main body text"),
)
_KIND = {w: k for k, ws in NAMES for w in ws.split()}
_RANK = {k: n for n, (k, _) in enumerate(NAMES)}
#: Words beside which a short word for an advert means one; beside others (`ad-history`) it does not.
SLOTS = frozenset("area banner block body bottom bottomad box center code col column container content footer frame google header holder inline inner label leaderboard left middle module mpu native outer panel place placeholder placement rail rectangle right section side sidebar sky slot slots space sticky text top unit units widget wrap wrapper zone".split())
_SHORT = frozenset("ad ads adv".split())
#: Kinds that are not content, nor is what they hold.
NEVER = frozenset("comment notice ad form nav side footer header".split())
_GROUP = {t: g for g, ts in {"heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl menu", "item": "li dt dd", "cell": "td th", "table": "table tr tbody thead tfoot caption", "quote": "blockquote pre", "figure": "figure figcaption", "form": "form fieldset legend dialog", "main": "article main"}.items() for t in ts.split()}
_BOXES = frozenset("article aside body center dialog div fieldset footer form header html main nav search section table td th".split())
_OWN = frozenset("nav header footer aside section div p body html".split())

_START = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)\s*(=?)\s*")
_BARE = re.compile(r"[^\s>]*")
_GAP = re.compile(r"[\s/]*")
_COMMENT_END = re.compile(r"--!?>")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_LETTERS = re.compile(r"[a-z]+")
#: Nodes that a tag and a size count for when they were not seen together.
KIN = 200.0
#: Class names that begin so speak of something else on the page.
_ABOUT = ("no-", "has-", "with-", "without-")


def kind_of(names: str) -> str:
    """The kind that class, id and role names tell of."""
    found = set()
    for name in names.split():
        if name.startswith(_ABOUT):
            continue
        words = _LETTERS.findall(_CAMEL.sub(r"\1 \2", name).lower())
        advert = all(w in SLOTS or w in _SHORT or len(w) < 3 or _KIND.get(w) == "ad" for w in words)
        found |= {_KIND[w] for w in words if w in _KIND and (advert or w not in _SHORT)}
    return min(found, key=_RANK.__getitem__) if found else "none"


class Tags:
    """Text and tags of a page in order: (text before, closing, name, attributes); each character is looked at a bounded number of times."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.last = {q: html.rfind(q) for q in "\"'"}

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """(attributes, whether the tag closes itself, where it ends) from behind a tag's name on; the end is -1 if it is cut."""
        html, out = self.html, {}
        while True:
            gap = _GAP.match(html, at).end()
            if gap >= len(html):
                return out, False, -1
            if html[gap] == ">":
                return out, html[gap - 1] == "/" and gap > at, gap + 1
            found = _ATTRIBUTE.match(html, gap)
            name, at, value = found[1].lower(), found.end(), ""
            if found[2]:
                quote = html[at : at + 1]
                if quote in self.last and quote and self.last[quote] > at:
                    end = html.index(quote, at + 1)
                    value, at = html[at + 1 : end], end + 1
                else:
                    value = _BARE.match(html, at)[0]
                    at += len(value)
            out.setdefault(name, value)

    def __iter__(self) -> Iterator[tuple[str, bool, str, dict[str, str], bool]]:
        html, at, text = self.html, 0, 0
        while (at := html.find("<", at)) >= 0:
            start, closing = at, html.startswith("/", at + 1)
            name = _START.match(html, at + 1 + closing)
            if name:
                attributes, itself, end = self.attributes(name.end())
                yield html[text:start], closing, name[0].lower() if end >= 0 else "", attributes, itself
                at = text = end if end >= 0 else len(html)
                tag = name[0].lower()
                if tag in RAW and not closing and end >= 0:
                    shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                    at = text = shut.start() if shut else len(html)
            elif html.startswith("!--", at + 1):
                end = at + 5 if html.startswith(">", at + 4) else at + 6 if html.startswith("->", at + 4) else None
                found = None if end else _COMMENT_END.search(html, at + 4)
                yield html[text:start], False, "", {}, False
                at = text = end or (found.end() if found else len(html))
            elif closing or html[at + 1 : at + 2] in ("!", "?"):
                end = html.find(">", at + 1)
                yield html[text:start], False, "", {}, False
                at = text = end + 1 if end >= 0 else len(html)
            else:
                at += 1
        yield html[text:], False, "", {}, False


class Page:
    """The DOM without inline elements: per node its parent, tag, kind and own pieces of text, and the blocks in order."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.kind, self.label, self.inside = [-1], ["html"], ["none"], [None], [""]
        self.chars, self.linked = [0], [0]
        self.blocks: list[tuple[int, str]] = []  # (node, text)
        self._read(html)

    def _read(self, html: str) -> None:
        stack, pieces, open_ = [0], [], Counter()
        hidden, link = [], 0  # hidden elements that are open (name, depth of blocks); depth at which a link is open

        def flush() -> None:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                self.blocks.append((stack[-1], text))
                self.chars[stack[-1]] += len(text)

        def shut(k: int) -> None:
            nonlocal link
            flush()
            for node in stack[k:]:
                open_[self.tag[node]] -= 1
            del stack[k:]
            while hidden and hidden[-1][1] > k - 1:
                hidden.pop()
            if link > len(stack):
                link = 0

        def shut_up_to(names: set[str], limit: frozenset[str] | set[str]) -> None:
            if any(open_[n] > 0 for n in names):
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] in names:
                        shut(k)
                        return
                    if self.tag[stack[k]] in limit:
                        return

        def push(tag: str, attributes: dict[str, str]) -> None:
            parent = stack[-1]
            self.parent.append(parent)
            self.tag.append(tag)
            self.kind.append(kind_of(f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}") if attributes else "none")
            self.label.append(int(attributes["data-content"]) if "data-content" in attributes else self.label[parent])
            tag_, kind = self.tag[parent], self.kind[parent]
            against = tag_ in ("nav", "footer", "aside", "form") or kind in NEVER and kind != "header" and tag_ not in ("body", "html")
            within = tag_ in ("article", "main") or kind == "content" and tag_ not in ("body", "html")
            self.inside.append("-" if against else "+" if within else self.inside[parent])
            self.chars.append(0)
            self.linked.append(0)
            stack.append(len(self.tag) - 1)
            open_[tag] += 1

        for text, closing, tag, attributes, itself in Tags(html):
            if hidden and hidden[-1][0] == "head" and (tag in BLOCK or text and not text.isspace()):
                hidden.pop()  # the body begins
            if text and not hidden:
                text = unescape(text)
                pieces.append(text)
                if link:
                    self.linked[stack[-1]] += len("".join(text.split()))
            if not tag:
                continue
            if closing:
                if tag == "a":
                    link = 0
                elif tag in BLOCK:
                    shut_up_to({tag}, SCOPE - {tag} if tag not in ("table", "html") else frozenset())
                elif hidden and any(h == tag for h, _ in hidden[-8:]):
                    while hidden.pop()[0] != tag:
                        pass
                continue
            if tag not in BLOCK:
                if tag == "br":
                    pieces.append(" ")
                elif tag == "a":
                    link = len(stack)
                elif tag in HIDDEN or tag not in VOID and attributes and kind_of(attributes.get("class", "")) == "ad":
                    if not itself or tag not in ("svg",):
                        hidden.append((tag, len(stack)))
                elif hidden and hidden[-1][0] == tag:
                    hidden.append((tag, len(stack)))  # the same element within a hidden one
                continue
            if tag in ("html", "body") and (open_[tag] or tag == "html"):
                if tag == "html" and "data-content" in attributes:
                    self.label[0] = int(attributes["data-content"])
                continue
            if tag == "body":
                hidden.clear()
            if tag in CLOSES_P:
                shut_up_to({"p"}, SCOPE)
            if tag in ENDS:
                shut_up_to(*ENDS[tag])
            flush()
            if tag == "hr" or tag in VOID:
                continue
            push(tag, attributes)
        flush()

    def features(self, node: int) -> tuple[str, ...]:
        """tag, with what the element is inside of (+ content, - anything else that tells), and size, which count together; kind; link."""
        tag, n = self.tag[node], self.chars[node]
        group = _GROUP.get(tag) or (tag if tag in _OWN else "other")
        size = "none" if not n else "short" if n <= 25 else "middle" if n <= 100 else "long" if n <= 400 else "huge"
        link = "none" if not n or not self.linked[node] else "some" if 2 * self.linked[node] < n else "most"
        within = self.inside[node]
        # A name says less of an element that holds much text itself.
        return f"tag:{group}{within}", "size:" + size, f"kind:{self.kind[node]}{'!' if n > 100 else ''}", f"link:{link}{within}"

    def is_box(self, node: int) -> bool:
        """Whether the node stands for a part of the page rather than for a piece of text."""
        return self.tag[node] in _BOXES


class TreeModel:
    """Potentials counted on labelled pages; state 1 is content."""

    def __init__(self, pages: Iterable[str]) -> None:
        counts: dict[str | tuple[str, str], list[float]] = {}
        pair, total = [[[1.0, 1.0], [1.0, 1.0]] for _ in range(2)], [1.0, 1.0]
        for html in pages:
            page = Page(html)
            for k, label in enumerate(page.label):
                state = label or 0
                total[state] += 1
                tag, size, *rest = page.features(k)
                for f in (tag, size, (tag, size), *rest):
                    counts.setdefault(f, [0.0, 0.0])[state] += 1
                if k:
                    pair[page.is_box(k)][page.label[page.parent[k]] or 0][state] += 1
        rate = {f: [(c + 1) / n for c, n in zip(counts[f], total, strict=True)] for f in counts}
        # A tag with a size: their joint frequency, drawn towards the product of the two by the weight of KIN nodes.
        joint = {(t, s): tuple((counts.get((t, s), (0, 0))[k] + KIN * rate[t][k] * rate[s][k]) / (total[k] + KIN) for k in (0, 1)) for t in rate if t[:4] == "tag:" for s in rate if s[:5] == "size:"}
        self.emit = {f: tuple(r) for f, r in rate.items() if isinstance(f, str) and f[:4] not in ("tag:", "size")} | joint
        self.pair = [[[x / sum(row) for x in row] for row in table] for table in pair]
        self.prior = [t / sum(total) for t in total]

    def marginals(self, page: Page) -> list[float]:
        """The probability that each node is content, by messages from the leaves up and from the root down."""
        n = len(page.tag)
        own, up = [[1.0, 1.0] for _ in range(n)], [[1.0, 1.0] for _ in range(n)]
        for k in range(n):
            a = b = 1.0
            tag, size, *rest = page.features(k)
            for f in ((tag, size), *rest):
                e = self.emit.get(f)
                if e:
                    a, b = a * e[0], b * e[1]
            own[k] = [a / (a + b), b / (a + b)]
        pairs = [self.pair[page.is_box(k)] for k in range(n)]
        inside = own  # own potential times the messages of the children so far
        for k in range(n - 1, 0, -1):
            (a, b), t = inside[k], pairs[k]
            m0, m1 = t[0][0] * a + t[0][1] * b, t[1][0] * a + t[1][1] * b
            up[k] = [m0 / (m0 + m1), m1 / (m0 + m1)]
            p = inside[page.parent[k]]
            p0, p1 = p[0] * up[k][0], p[1] * up[k][1]
            s = p0 + p1
            p[0], p[1] = max(p0 / s, 1e-300), max(p1 / s, 1e-300)
        belief = [[0.0, 0.0] for _ in range(n)]
        belief[0] = [self.prior[0] * inside[0][0], self.prior[1] * inside[0][1]]
        for k in range(1, n):
            p, t = belief[page.parent[k]], pairs[k]
            c0, c1 = p[0] / up[k][0], p[1] / up[k][1]
            d0, d1 = c0 * t[0][0] + c1 * t[1][0], c0 * t[0][1] + c1 * t[1][1]
            b0, b1 = d0 * inside[k][0], d1 * inside[k][1]
            s = b0 + b1
            belief[k] = [max(b0 / s, 1e-300), max(b1 / s, 1e-300)]
        return [b[1] / (b[0] + b[1]) for b in belief]

    def text(self, html: str) -> str:
        page = Page(html)
        if not page.blocks:
            return ""
        content = self.marginals(page)
        if not any(content[k] > 0.5 for k, _ in page.blocks):
            chosen = densest(page)
            return "\n\n".join(t for k, t in page.blocks if chosen[k])
        return "\n\n".join(t for k, t in page.blocks if content[k] > 0.5)


#: Characters that a piece of text must have beyond its links to speak for the part of the page that it is in.
WORTH = 60


def densest(page: Page) -> list[bool]:
    """Where the model finds no content at all: the nodes of the part of the page that is worth most, each piece of its text being
    worth its characters outside links less WORTH; none if no part is worth anything. Navigation, forms and the like are not in it."""
    n = len(page.tag)
    out = [page.kind[k] in NEVER or page.tag[k] in ("nav", "footer", "aside", "form") for k in range(n)]
    worth = [0] * n
    for k in range(1, n):
        out[k] = out[k] or out[page.parent[k]]
    for k in range(n - 1, -1, -1):
        if page.chars[k] and not out[k]:
            worth[k] += page.chars[k] - 2 * page.linked[k] - WORTH
        if k and worth[k] > -2 * WORTH:  # a heading or a short line does not take from what is around it; a list of links does
            worth[page.parent[k]] += max(worth[k], 0)
        elif k:
            worth[page.parent[k]] += worth[k]
    best = max(range(n), key=lambda k: (worth[k], k))
    if best and not page.is_box(best):  # a piece of text stands for what it is a piece of
        best = page.parent[best]
    inside = [False] * n
    if worth[best] > 0:
        for k in range(n):
            inside[k] = k == best or k > 0 and inside[page.parent[k]]
    return [i and not o and not (page.chars[k] and 2 * page.linked[k] >= page.chars[k]) for k, (i, o) in enumerate(zip(inside, out, strict=True))]


def labelled_pages() -> Iterator[str]:
    """Labelled pages in many layouts, put together from parts: containers of content, and what stands around and in them."""
    word = "lorem"
    texts = {"short": word, "middle": " ".join([word] * 9), "long": " ".join([word] * 40), "huge": " ".join([word] * 130)}
    links = "".join(f'<li><a href="/{k}">{word} {k}</a></li>' for k in range(5))
    around = [
        f"<nav><ul>{links}</ul></nav>", f'<div class="menu"><ul>{links}</ul></div>', f"<header><h1>{word}</h1><p>{texts['middle']}</p></header>", f'<div id="header"><a href="/">{word}</a></div>',
        f"<footer><p>{texts['middle']}</p></footer>", f'<div class="site-footer"><p>{texts["long"]}</p></div>', f"<footer>{texts['short']}</footer>", f"<footer>{texts['middle']} <a href='/'>{word}</a></footer>",
        f"<div><ul>{links}</ul></div>", f'<header class="top"><p>{texts["long"]}</p></header>', f"<nav>{''.join(f'<a href=x>{word}</a> ' for _ in range(4))}</nav>",
    ]
    either = [
        f'<aside><h3>{word}</h3><ul>{links}</ul></aside>', f'<aside><p>{texts["long"]}</p></aside>', f"<aside>{texts['middle']}</aside>", f"<aside>{texts['long']}</aside>",
        f'<div class="sidebar"><h4>{word}</h4><p>{texts["middle"]}</p></div>', f'<section class="related"><h2>{word}</h2><ul>{links}</ul></section>', f'<div class="related"><p>{texts["middle"]}</p></div>',
        f'<div class="ad">{texts["middle"]}</div>', f'<div class="advert"><p>{texts["long"]}</p></div>', f'<section id="sponsored"><p>{texts["middle"]}</p></section>', f'<p class="ad">{texts["middle"]}</p>', f'<div class="ad">{texts["long"]}</div>',
        f'<div class="cookie-notice"><p>{texts["middle"]}</p></div>', f'<div id="notice">{texts["long"]}</div>', f'<section class="alert"><p>{texts["short"]}</p></section>', f'<p class="notice">{texts["long"]}</p>',
        f'<form><p>{texts["middle"]}</p></form>', f'<form>{texts["short"]}</form>', f'<div class="newsletter"><p>{texts["middle"]}</p><form>{word}</form></div>', f'<form><div>{texts["middle"]}</div><p>{texts["long"]}</p></form>',
        f'<div class="comments"><h2>{word}</h2><div class="comment"><p>{texts["long"]}</p></div><div class="comment"><p>{texts["short"]}</p></div></div>',
        f'<section id="comments"><ol><li><p>{texts["long"]}</p></li><li><p>{texts["middle"]}</p></li></ol></section>', f'<ol class="commentlist"><li>{texts["long"]}</li></ol>',
        f"<nav><ul>{links}</ul></nav>", f"<footer><p>{texts['middle']}</p></footer>", f'<div class="share"><a href="/">{word}</a></div>',
    ]
    bodies = [
        "".join(f"<p>{texts[s]}</p>" for s in ("long", "middle", "long", "short", "long", "long")),
        f"<h1>{texts['middle']}</h1><p>{texts['short']}</p><p>{texts['long']}</p><h2>{word}</h2><p>{texts['long']}</p><ul><li>{texts['middle']}</li><li>{texts['short']}</li></ul>",
        f"<h1>{texts['short']}</h1><p>{texts['long']}</p><blockquote><p>{texts['middle']}</p></blockquote><p>{texts['middle']}</p><pre>{texts['middle']}</pre>",
        f"<h1>{texts['middle']}</h1><p>{texts['short']}</p>",
        f"<p>{texts['long']} <a href='/'>{word}</a> {texts['long']}</p><table><tr><td>{texts['short']}</td><td>{texts['middle']}</td></tr></table><figure><figcaption>{texts['middle']}</figcaption></figure>",
        f"<header><h1>{texts['middle']}</h1><p>{texts['short']}</p></header><p>{texts['long']}</p><section><h2>{word}</h2><p>{texts['long']}</p></section>",
        f"<div><p>{texts['long']}</p><div>{texts['long']}</div></div><dl><dt>{word}</dt><dd>{texts['middle']}</dd></dl>",
        texts["long"],
        f"<p>{texts['middle']}</p>",
    ]
    boxes = ["article", "main", 'div class="content"', 'div class="post-body"', 'div id="main-content"', 'section class="entry"', 'div class="article-text"', "div", "section", "article class=post"]
    step = 0
    for box in boxes:
        for body in bodies if box not in ("div", "section") else [b for b in bodies if "<header" not in b]:
            step += 1
            near = [(around + either)[(step * 5 + k * 7) % (len(around) + len(either))] for k in range(6)]
            inner = [_unlabelled(either[(step * 3 + k * 11) % len(either)]) for k in range(3)]
            plain = f'<{box} data-content="1">{body}</{box.split()[0]}>'
            mixed = f'<{box} data-content="1">{inner[0]}{body}{inner[1]}{body if step % 2 else ""}{inner[2] if step % 3 else ""}</{box.split()[0]}>'
            yield f"<html><head><title>x</title></head><body>{''.join(near[:3])}{mixed if step % 3 else plain}{''.join(near[3:])}</body></html>"
            if step % 2:
                yield f"<html><body><div><div>{near[0]}{near[1]}</div>{plain}</div>{near[2]}</body></html>"
            if step % 4 == 0:
                wrapper = ("div id=page", 'div class="wrapper"', 'div class="container"', "div id=main")[step // 4 % 4]
                yield f"<html><body>{near[0]}<{wrapper}>{near[1]}{plain if step % 3 else mixed}{near[2]}{near[5]}</div>{near[3]}</body></html>"
    yield from _nameless(texts, links)
    for k, body in enumerate([*[b for b in bodies if "<header" not in b] * 6, word, f"<p>{word}</p>", word, f"<h1>{word}</h1><p>{word}</p>"]):  # pages without a container, and of nothing else
        yield f'<html data-content="1"><head><title>x</title></head>{body}</html>'
        yield f'<html data-content="1">{body}</html>'
        yield f'<html data-content="1"><body>{body}</body></html>'
        yield f'<html data-content="1"><body>{_unlabelled(around[k % len(around)])}{body}{_unlabelled(either[k % len(either)])}{_unlabelled(around[4 + k % 4])}</body></html>'


def _nameless(texts: dict[str, str], links: str) -> Iterator[str]:
    """Labelled pages whose elements have no telling names: wrappers in wrappers, text with br, tables for layout, paragraphs that are one link."""
    word, line = texts["short"], "".join(f'<a href="/{k}">{texts["short"]}</a> ' for k in range(4))
    link = f'<p><a href="/x">{texts["middle"]}</a></p>'
    bodies = [
        f"{texts['huge']}<br><br>{texts['long']}", f"{texts['long']}<br><br>{texts['long']}", texts["huge"],
        f"<h1>{word}</h1><p>{texts['huge']}</p><p>{texts['middle']}</p><ul><li>{word}</li><li>{texts['middle']}</li></ul>",
        f"<h1>{texts['middle']}</h1><p>{texts['long']}</p>{link}<p>{texts['long']}</p>",
        f"<h1>{word}</h1><p>{texts['middle']}</p><p>{texts['long']}</p><p>{word}</p><p>{texts['huge']}</p>",
        f"<h2>{texts['middle']}</h2><p>{texts['long']}</p><p><a href=y>{word}</a></p><h3>{word}</h3><p>{texts['long']}</p>",
        f"<p>{texts['long']}</p><blockquote>{texts['middle']}</blockquote><p>{texts['long']} <a href=z>{word}</a></p>",
    ]
    beside = [f"<div>{line}</div>", f"<div><ul>{links}</ul></div>", f"<div>{word}</div>", f"<ul>{links}</ul>", f"<div><p>{line}</p></div>", f"<div><div>{line}</div></div>", f"<div>{word} {line}</div>", f"<p>{line}</p>"]
    step = 0
    for body in bodies:
        for wrap in ("{}", "<div>{}</div>", "<div><div>{}</div></div>", "<section>{}</section>", "<article>{}</article>"):
            step += 1
            one, two, three = (beside[(step * 3 + k * 5) % len(beside)] for k in range(3))
            whole = f'<div data-content="1">{wrap.format(body)}</div>'
            yield f"<html><body>{one}{whole}{two}</body></html>"
            yield f"<html><body><div>{one}{whole}{three}</div></body></html>"
            if step % 2:
                yield f'<html data-content="1"><body>{whole}</body></html>'
            else:
                yield f"<html><body><div><div>{one}{two}</div><div>{whole}</div></div><div>{three}</div></body></html>"
        cells = f'<td data-content="0">{line}</td><td data-content="1">{body}</td>', f'<td data-content="0"><ul>{links}</ul></td><td data-content="1">{body}</td>', f'<td data-content="1">{body}</td>'
        for k, row in enumerate(cells):
            top = (f'<tr data-content="0"><td>{word}</td></tr>', "", f'<tr data-content="0"><td>{line}</td></tr>')[k]
            yield f"<html><body><table>{top}<tr>{row}</tr></table></body></html>"
            yield f"<html><body>{beside[k]}<table><tr>{row}</tr></table>{beside[k + 2]}</body></html>"
        yield f'<html><body data-content="1">{_unlabelled(beside[3])}{body}</body></html>'
        yield f'<html><body data-content="1">{_unlabelled(beside[step % len(beside)])}{body}{_unlabelled(beside[(step + 2) % len(beside)])}</body></html>'


def _unlabelled(html: str) -> str:
    return re.sub(r"^<(\w+)", r'<\1 data-content="0"', html)


_model: list[TreeModel] = []


def default_model() -> TreeModel:
    """Trained once per process: the labelled pages are a fixed, small set."""
    if not _model:
        _model.append(TreeModel(labelled_pages()))
    return _model[0]


def _extractor(model: TreeModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extractor(model or default_model()), "page_id long, url string, text string, n_chars long")


def op7(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
