"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is a sequence of leaf blocks (runs of text between borders of block
elements). Each gets the label article or not. A block's score adds up learnt weights of its features (tags,
classes and ids of its ancestors, and the shape of its text); neighbouring labels have weights as well, and
Viterbi's algorithm finds the best sequence. The field is trained by gradient ascent on the
likelihood of labelled pages, in which an attribute ``data-main`` marks the elements of the article.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import map_rows

TRAINING_PAGES = 240
EPOCHS = 25
SEED = 7

# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# their content is no text of the page
SILENT = frozenset("head script style template noscript svg iframe object textarea canvas audio video title".split())
# read up to their end tag, markup included
RAW = frozenset("script style textarea title iframe".split())
# what may stand in a head; any other start tag ends an open one
HEAD_ONLY = frozenset("head base basefont bgsound link meta title script style template noscript noframes".split())
# what is read by rules of its own, also in a head
ENCLOSED = ("template", "noscript")
# what an opening tag closes when it is open: a paragraph by any block, others by their like
CLOSED_BY_LIKE = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
SCOPES = frozenset("table ul ol dl body html div section article aside main nav form".split())
# a quote or a blank ends a value only as the HTML standard has it: quotes count right after the equals sign alone
_VALUE = r"\"[^\"]*\"|'[^']*'|([^\s>\"'][^\s>]*+)|(?=>)"
_INSIDE = rf"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{_VALUE})|(?!\s*+=)))*+"
# the last but two: a tag that never ends takes the rest of the page with it
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)({_INSIDE})>|</?[a-zA-Z].*\Z|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*))")
# in these a slash before the end of a start tag closes the element
FOREIGN = ("svg", "math")
NAME_PART = re.compile(r"[a-z]+")
LEGAL = re.compile("©|copyright|all rights reserved|\\bcookies?\\b", re.I)


@dataclass
class Block:
    text: str
    features: frozenset[str]
    is_main: bool = False


@dataclass
class _Open:
    tag: str
    features: frozenset[str]
    silent: bool
    is_main: bool


def leaf_blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page in order.

    With ``known``, only features in it are kept, so that deep pages stay small. Unclosed and stray tags are taken as
    browsers do in the common cases; a page that breaks off ends there.
    """
    blocks: list[Block] = []
    stack = [_Open("", frozenset(), False, False)]
    open_tags: Counter[str] = Counter()
    said: list[str] = []
    linked = 0
    at = _Open("", frozenset(), False, False)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(said).split())
        if text:
            shape = shape_of(text, linked)
            blocks.append(Block(text, at.features | (shape if known is None else shape & known), at.is_main))
        said.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            gone = stack.pop()
            open_tags[gone.tag] -= 1
            if gone.tag in BLOCKS:
                flush()

    def close(tag: str, scoped: bool) -> None:
        if not open_tags[tag]:
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                pop_to(i)
                return
            if scoped and stack[i].tag in SCOPES:
                return

    pos, end = 0, len(page)
    while pos < end:
        m = TAG.match(page, pos)
        pos = m.end()
        tag = m.group(2)
        if tag is None:
            chunk = m.group()
            if chunk[0] == "<" and len(chunk) > 1:
                continue
            if stack[-1].tag == "head" and chunk.strip():
                close("head", False)
            if not stack[-1].silent:
                chunk = html.unescape(chunk)
                if not said or not any(x.strip() for x in said):
                    at = stack[-1]
                if open_tags["a"]:
                    linked += len(chunk.strip())
                said.append(chunk)
            continue
        tag = tag.lower()
        if open_tags["head"] and not m.group(1) and tag not in HEAD_ONLY and not any(open_tags[t] for t in ENCLOSED):
            close("head", False)
        if m.group(1):
            if tag in BLOCKS:
                flush()
            close(tag, False)
            continue
        if tag in BLOCKS:
            flush()
            if open_tags["p"]:
                close("p", True)
            for like in CLOSED_BY_LIKE.get(tag, ()):
                close(like, True)
        elif tag == "br":
            said.append(" ")
        # a slash closes nothing in HTML itself, nor as the last character of a value
        slash = m.group(3).endswith("/") and m.end(4) != m.end(3)
        if tag in VOID or (slash and (tag in FOREIGN or any(open_tags[t] for t in FOREIGN))):
            continue
        parent = stack[-1]
        own, is_main = {f"in:{tag}"}, parent.is_main
        for name, *values in ATTRIBUTE.findall(m.group(3)):
            name = name.lower()
            if name in ("class", "id", "role"):
                own.update(f"is:{w}" for w in NAME_PART.findall("".join(values).lower()))
            elif name == "data-main":
                is_main = "".join(values) == "1"
        if tag in BLOCKS:
            own.add(f"at:{tag}")
        kept = own if known is None else own & known
        inherited = parent.features
        if tag in BLOCKS:
            inherited = frozenset(f for f in inherited if not f.startswith("at:"))
        stack.append(_Open(tag, inherited | kept, parent.silent or tag in SILENT, is_main))
        open_tags[tag] += 1
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, pos)
            pos = stop.start() if stop else end
    flush()
    return blocks


def shape_of(text: str, linked: int) -> frozenset[str]:
    """Features of a block's text: length, share of links, ending, legal words."""
    n = len(text)
    size = next((k for k, most in enumerate((15, 40, 80, 160, 400)) if n < most), 5)
    share = linked / n
    links = 0 if share < 0.05 else 1 if share < 0.3 else 2 if share < 0.7 else 3
    found = {f"size:{size}", f"links:{links}", f"end:{'stop' if text[-1] in '.!?…\"”»' else 'none'}"}
    if LEGAL.search(text):
        found.add("legal")
    return frozenset(found)


@dataclass
class Field:
    """Weights for the label article against the other, and of neighbouring labels."""

    weights: dict[str, float] = field(default_factory=dict)
    steps: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])

    def scores(self, blocks: list[Block]) -> list[float]:
        w = self.weights
        return [sum(w.get(f, 0.0) for f in b.features) for b in blocks]

    def decode(self, scores: list[float]) -> list[int]:
        """The best labels by Viterbi's algorithm; of equals, not article."""
        if not scores:
            return []
        (aa, ab), (ba, bb) = self.steps
        off, on = 0.0, scores[0]
        back: list[tuple[int, int]] = []
        for s in scores[1:]:
            stay, leave = off + aa, on + ba
            enter, go_on = off + ab, on + bb
            back.append((int(leave > stay), int(go_on >= enter)))
            off, on = max(stay, leave), max(enter, go_on) + s
        label = int(on > off)
        labels = [label]
        for b in reversed(back):
            label = b[label]
            labels.append(label)
        return labels[::-1]


def _log_sum(a: float, b: float) -> float:
    top = max(a, b)
    return top + math.log(math.exp(a - top) + math.exp(b - top))


def _expectations(scores: list[float], steps: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """Probability of the label article per block, and expected numbers of neighbouring labels (forward-backward)."""
    n = len(scores)
    forward = [(0.0, scores[0])]
    for s in scores[1:]:
        a, b = forward[-1]
        forward.append((_log_sum(a + steps[0][0], b + steps[1][0]), _log_sum(a + steps[0][1], b + steps[1][1]) + s))
    backward = [(0.0, 0.0)] * n
    for i in range(n - 2, -1, -1):
        a, b = backward[i + 1]
        b += scores[i + 1]
        backward[i] = (_log_sum(steps[0][0] + a, steps[0][1] + b), _log_sum(steps[1][0] + a, steps[1][1] + b))
    total = _log_sum(*forward[-1])
    on = [math.exp(forward[i][1] + backward[i][1] - total) for i in range(n)]
    pairs = [[0.0, 0.0], [0.0, 0.0]]
    for i in range(n - 1):
        for x in (0, 1):
            for y in (0, 1):
                s = scores[i + 1] if y else 0.0
                pairs[x][y] += math.exp(forward[i][x] + steps[x][y] + s + backward[i + 1][y] - total)
    return on, pairs


def train(pages: list[str], epochs: int = EPOCHS, rate: float = 0.2, ridge: float = 1e-3) -> Field:
    """Fit a field to labelled pages by stochastic gradient ascent with decreasing steps per weight."""
    examples = [b for b in (leaf_blocks(p) for p in pages) if b]
    order = random.Random(SEED)
    found = Field()
    squares: dict[str, float] = {}
    step_squares = [[1e-6, 1e-6], [1e-6, 1e-6]]
    for _ in range(epochs):
        order.shuffle(examples)
        for blocks in examples:
            on, pairs = _expectations(found.scores(blocks), found.steps)
            gradient: dict[str, float] = {}
            for b, p in zip(blocks, on, strict=True):
                for f in b.features:
                    gradient[f] = gradient.get(f, 0.0) + b.is_main - p
            for f, g in gradient.items():
                g -= ridge * found.weights.get(f, 0.0)
                squares[f] = squares.get(f, 1e-6) + g * g
                found.weights[f] = found.weights.get(f, 0.0) + rate * g / math.sqrt(squares[f])
            for first, second in zip(blocks, blocks[1:], strict=False):
                pairs[first.is_main][second.is_main] -= 1
            for x in (0, 1):
                for y in (0, 1):
                    g = -pairs[x][y] - ridge * found.steps[x][y]
                    step_squares[x][y] += g * g
                    found.steps[x][y] += rate * g / math.sqrt(step_squares[x][y])
    return found


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> Iterator[str]:
    """Labelled pages in the usual layouts, built by rule from word shapes: what varies are structure and the shape of texts."""
    r = random.Random(seed)
    syllables = "ta ri mo len ver sa qu onde ist eur al ño ge ch ß é ou pre st un der ka".split()

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() + r.choice(["", "", "", "", ",", "", "***", ""]) for _ in range(r.randint(low, high)))

    def sentence(low: int = 4, high: int = 40) -> str:
        said = words(low, high) + r.choice([".", ".", ".", "!", "?", "", " &amp;"])
        return said.upper() if r.random() < 0.08 else said[:1].upper() + said[1:]

    def text() -> str:
        return " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 6])))

    def links(k: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{words(1, 3)}</a></{tag}>' for _ in range(k))

    def menu() -> str:
        kind = r.randrange(4)
        if kind == 0:
            return f"<nav><ul>{links(r.randint(2, 9))}</ul></nav>"
        if kind == 1:
            return f'<div class="{r.choice(["menu", "navbar", "nav-links", "breadcrumb"])}">{links(r.randint(2, 9), "span")}</div>'
        if kind == 2:
            return f"<header><h1>{words(1, 3)}</h1><p>{words(2, 7)}</p><nav>{links(4, 'div')}</nav></header>"
        return f'<div id="header"><div class="logo"><a href="/">{words(1, 3)}</a></div><ul class="menu">{links(5)}</ul></div>'

    def advert() -> str:
        name = r.choice(["ad", "ads", "advert", "banner", "promo", "sponsored", "ad-slot"])
        return f'<{(t := r.choice(["div", "aside", "section"]))} class="{name}">{sentence(3, 20)}</{t}>'

    def notice() -> str:
        name = r.choice(["cookie-notice", "consent", "notice", "alert", "popup", "newsletter", "subscribe"])
        said = r.choice(["We use cookies. ", "", ""]) + sentence()
        return f'<div class="{name}" id="{name}"><p>{said}</p><button>{words(1, 2)}</button></div>'

    def form() -> str:
        return f'<form action="/{word()}"><label>{words(1, 4)}</label><input type="text"><p>{sentence(2, 9)}</p><button>{words(1, 2)}</button></form>'

    def sidebar() -> str:
        outer = r.choice(['<aside{}>', '<div class="sidebar"{}>', '<div id="sidebar" class="widget"{}>', '<aside class="related"{}>'])
        tag = "aside" if "aside" in outer else "div"
        inner = r.choice([f"<h3>{words(1, 4)}</h3><ul>{links(4)}</ul>", f"<h4>{words(1, 3)}</h4><p>{text()}</p>", f"<p>{sentence()}</p>"])
        return outer.format("") + inner + f"</{tag}>"

    def comments() -> str:
        one = lambda: r.choice([
            f'<div class="comment"><p>{text()}</p><span class="author">{words(1, 2)}</span></div>',
            f'<article class="comment"><header>{words(1, 2)}</header><p>{text()}</p></article>',
            f'<li class="comment reply"><p>{sentence()}</p></li>',
        ])
        outer = r.choice(["comments", "comment-list", "replies", "discussion"])
        return f'<section class="{outer}" id="{outer}"><h3>{words(1, 3)}</h3>' + "".join(one() for _ in range(r.randint(1, 5))) + "</section>"

    def footer() -> str:
        said = r.choice(["&copy; ", "Copyright ", ""]) + words(1, 4) + r.choice([" &middot; ", ". "]) + sentence()
        return r.choice([f"<footer>{said}</footer>", f'<div class="footer">{said}</div>', f'<footer><p>{said}</p><ul>{links(3)}</ul></footer>', f'<div id="footer"><p>{said}</p></div>'])

    def article() -> str:
        parts = [f"<{(h := r.choice(['h1', 'h1', 'h2']))} data-main=\"1\">{words(1, 12)}</{h}>"] if r.random() < 0.85 else []
        if r.random() < 0.3:
            parts.append(f'<div class="{r.choice(["byline", "meta", "post-meta", "date", "share", "social", "tags"])}">{words(2, 6)}</div>')
        for _ in range(r.choice([1, 1, 2, 4, 8, 14])):
            kind = r.random()
            if kind < 0.72:
                bold = r.choice(["{}", "{}", "<b>{}<br>", "<em>{}</em>", "{} <a href='/x'>" + words(1, 3) + "</a> " + words(3, 9)])
                parts.append(f'<p data-main="1">{bold.format(text())}' + r.choice(["</p>", "</p>", ""]))
            elif kind < 0.78:
                parts.append(f'<h3 data-main="1">{words(1, 8)}</h3>')
            elif kind < 0.84:
                parts.append("<ul>" + "".join(f'<li data-main="1">{sentence(2, 15)}</li>' for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.88:
                parts.append(f'<blockquote data-main="1">{text()}</blockquote>')
            elif kind < 0.91:
                parts.append(f'<figure><img src="x.png"><figcaption data-main="1">{sentence(3, 14)}</figcaption></figure>')
            elif kind < 0.93:
                parts.append(f'<pre data-main="1">{words(3, 20)}</pre>')
            elif kind < 0.95:
                parts.append("<table>" + "".join(f'<tr><td data-main="1">{words(1, 4)}</td><td data-main="1">{words(1, 6)}</td></tr>' for _ in range(3)) + "</table>")
            else:
                parts.append(r.choice([advert, notice, sidebar, form])())
        inner = "".join(parts)
        outer = r.randrange(6)
        if outer < 2:
            return f"<article>{inner}</article>"
        if outer == 2:
            return f"<main><article class='post'>{inner}</article></main>"
        if outer == 3:
            return f'<div class="{r.choice(["content", "post", "entry-content", "article-body", "story", "main"])}">{inner}</div>'
        if outer == 4:
            return f'<div id="{r.choice(["content", "main", "article"])}"><div class="text">{inner}</div></div>'
        return f"<main>{inner}</main>" if r.random() < 0.6 else inner

    for _ in range(n):
        before = [menu()] + [f() for f in (advert, notice, form, sidebar) if r.random() < 0.35]
        after = [f() for f in (comments, advert, sidebar, form, notice) if r.random() < 0.35] + [footer()] * (r.random() < 0.9)
        head = f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head><body>"
        yield head + "".join(before) + article() + "".join(after) + r.choice(["</body></html>", ""])


RESULT = T.StructType().add("text", "string").add("n_chars", "long")


def extract_main_text(pages: DataFrame, page: str, trained: Field | None = None) -> DataFrame:
    """``pages`` with ``text`` (the article, blocks joined by an empty line) and ``n_chars`` (its code points).

    Without ``trained``, a field is fitted to ``labelled_pages()``: a fixed number of pages, whatever the size of
    ``pages``. Null and empty pages, and pages without an article, give an empty text. Every page is read whole and by itself:
    repeated rows repeat, an empty table stays empty. Input columns of the added names are replaced. Nothing is shuffled.
    """
    trained = train(list(labelled_pages())) if trained is None else trained
    sent = pages.sparkSession.sparkContext.broadcast((trained.weights, trained.steps))

    def start() -> Callable[..., list[list]]:
        weights, steps = sent.value
        model, known = Field(weights, steps), frozenset(weights)

        def work(given: list) -> list[list]:
            texts = []
            for raw in given:
                blocks = leaf_blocks(raw.decode() if raw else "", known)
                labels = model.decode(model.scores(blocks))
                texts.append("\n\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y))
            return [texts, [len(t) for t in texts]]

        return work

    return map_rows(pages, [page], RESULT, start)
