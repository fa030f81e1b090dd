"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks, the runs of text between block-level tags.  A block's features are its tag, the tags,
classes and ids of its ancestors, and properties of its text (length, share in links, stops, signs).  The field has two
labels, content and other, weights of features by label, and weights of label pairs along the page.  It is trained by
maximum likelihood on labelled pages (training_pages) and decoded by Viterbi.  Training takes seconds, is the same
each time, and is done once a session; executors get the weights, of fixed size.

Defined cases: null or empty html has no text; broken markup is read as browsers do, as far as it matters here; scripts,
styles, comments and the head are no blocks; a page without content blocks gives an empty text; equal rows get equal
texts; an empty table gives an empty one; other columns are carried, those named like a result are replaced.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import others

_BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe label legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th "
    "thead title tr ul video audio object".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("script style template head title iframe object".split())
#: Start tags that end an open element of the kinds named, up to an element that bounds them.
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Start tags that leave an open head open; any other ends it, unless it lies in an element of one of these.
_IN_HEAD = frozenset("title meta link script style base noscript template".split())
_BOUNDS = frozenset("ul ol table dl select menu body html".split())
_NOT_IN_P = _BLOCK - {"button", "label", "option", "select", "textarea", "video", "audio", "object", "canvas", "iframe", "noscript", "template"}
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")


class Blocks(HTMLParser):
    """``blocks``: (text, characters in links, own tag, features of the ancestors)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        #: Of each open element: its nearest block-level tag and the features of all that it lies in, deepest last.
        self.within: list[tuple[str, dict[str, None]]] = []
        self.open: Counter[str] = Counter()
        self.blocks: list[tuple[str, int, str, tuple[str, ...]]] = []
        self.parts: list[str] = []
        self.linked, self.links, self.skipped, self.place = 0, 0, 0, ("", ())

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.blocks.append((text, self.linked, *self.place))
            self.parts, self.linked = [], 0

    def pop(self) -> None:
        tag, _ = self.stack.pop()
        self.within.pop()
        self.open[tag] -= 1
        self.skipped -= tag in _SKIP
        self.links -= tag == "a"

    def end_head(self) -> None:
        """Ends a head left open, unless an element that belongs there is open in it."""
        for depth in range(len(self.stack) - 1, -1, -1):
            open_ = self.stack[depth][0]
            if open_ == "head":
                while len(self.stack) > depth:
                    self.pop()
            if open_ == "head" or open_ in _IN_HEAD or open_ == "body":
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self.flush()
            for ends in (_IMPLIED.get(tag), {"p"} if tag in _NOT_IN_P else None):
                if not ends:
                    continue
                for depth in range(len(self.stack) - 1, -1, -1):
                    open_ = self.stack[depth][0]
                    if open_ in ends:
                        while len(self.stack) > depth:
                            self.pop()
                        break
                    if open_ in _BOUNDS or (ends == {"p"} and open_ in _BLOCK):
                        break
        if self.skipped and tag not in _IN_HEAD:
            self.end_head()
        if tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        names = {n for k, v in attrs if v and k in ("class", "id", "role", "itemprop") for n in _NAME.findall(v.lower())}
        names |= {"hidden" for k, _ in attrs if k == "hidden"}
        self.stack.append((tag, tuple(sorted(names))))
        inner, around = self.within[-1] if self.within else ("", {})
        new = [f for f in (f"<{tag}", *(f".{n}" for n in self.stack[-1][1])) if f not in around]
        self.within.append((tag if tag in _BLOCK else inner, around | dict.fromkeys(new) if new else around))
        self.open[tag] += 1
        self.skipped += tag in _SKIP
        self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        is_open = self.open[tag] > 0
        if tag in _BLOCK and (is_open or tag == "p"):  # an end without a start is nothing, but for a paragraph's
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        if is_open:
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # in HTML a slash ends nothing

    def handle_data(self, data: str) -> None:
        if self.skipped and data.strip():
            self.end_head()  # text ends an open head as well
        if self.skipped or not data:
            return
        if not self.parts:
            inner, around = self.within[-1] if self.within else ("", {})
            self.place = (inner, tuple(around))
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def blocks_of(html: str | None) -> list[tuple[str, int, str, tuple[str, ...]]]:
    reader = Blocks()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks


def features(block: tuple[str, int, str, tuple[str, ...]], at: int) -> list[str]:
    text, linked, tag, around = block
    words = text.count(" ") + 1
    out = [*around, f"tag {tag}", f"words {min(7, int(math.log2(words)))}", "stop" if text[-1] in ".!?:;…\"'»”)" else "no stop", "bias"]
    share = linked / len(text)
    out.append("all links" if share > 0.8 else "links" if share > 0.3 else "few links")
    if "©" in text:
        out.append("copyright")
    if "|" in text or "·" in text or "»" in text:
        out.append("separator")
    if text.count(",") > 2:
        out.append("commas")
    if at == 0:
        out.append("first")
    return out


class Field:
    """Weights of (feature, label) and (label, label); label 1 is content."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, pairs: np.ndarray):
        self.names, self.weights, self.pairs = names, weights, pairs
        self.gain = {n: float(weights[i, 1] - weights[i, 0]) for n, i in names.items()}

    def decode(self, page: list[list[str]]) -> list[int]:
        """Viterbi: the most likely labels of a page's blocks; of equal paths the one with less content."""
        if not page:
            return []
        (p00, p01), (p10, p11) = self.pairs.tolist()
        a, b, back = 0.0, sum(self.gain.get(f, 0.0) for f in page[0]), []
        for block in page[1:]:
            gain = sum(self.gain.get(f, 0.0) for f in block)
            from_a, from_b = b + p10 > a + p00, b + p11 > a + p01
            back.append((int(from_a), int(from_b)))
            a, b = max(a + p00, b + p10), max(a + p01, b + p11) + gain
        label, out = int(b > a), []
        for step in reversed(back):
            out.append(label)
            label = step[label]
        return [*reversed([*out, label])]


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = 150, penalty: float = 0.02, rate: float = 0.3) -> Field:
    """Maximum likelihood by the forward-backward algorithm and Adam steps; ``penalty`` on squared weights."""
    names = {f: i for i, f in enumerate(dict.fromkeys(f for blocks, _ in pages for b in blocks for f in b))}
    longest = max(len(labels) for _, labels in pages)
    n = len(pages)
    rows, columns, where = [], [], np.zeros((n, longest), bool)
    truth = np.zeros((n, longest), np.int64)
    for i, (blocks, labels) in enumerate(pages):
        for j, (block, label) in enumerate(zip(blocks, labels, strict=True)):
            where[i, j], truth[i, j] = True, label
            for f in block:
                rows.append(i * longest + j)
                columns.append(names[f])
    rows, columns = np.array(rows), np.array(columns)
    theta = np.zeros(2 * len(names) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inside = where[:, 1:]
    for step in range(1, steps + 1):
        weights, pairs = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        emit = np.stack([np.bincount(rows, weights[columns, y], n * longest) for y in (0, 1)], 1).reshape(n, longest, 2)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = emit[:, 0]
        for j in range(1, longest):
            ahead = np.logaddexp(alpha[:, j - 1, :1] + pairs[0], alpha[:, j - 1, 1:] + pairs[1]) + emit[:, j]
            alpha[:, j] = np.where(where[:, j, None], ahead, alpha[:, j - 1])
        for j in range(longest - 2, -1, -1):
            behind = emit[:, j + 1] + beta[:, j + 1]
            beta[:, j] = np.where(where[:, j + 1, None], np.logaddexp(pairs[:, 0] + behind[:, :1], pairs[:, 1] + behind[:, 1:]), 0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        single = np.exp(alpha + beta - total[:, None, None]) * where[:, :, None]
        joint = np.exp(alpha[:, :-1, :, None] + pairs + (emit + beta)[:, 1:, None, :] - total[:, None, None, None]) * inside[:, :, None, None]
        own = np.eye(2)[truth] * where[:, :, None]
        off = (own - single).reshape(-1, 2)
        grad_w = np.stack([np.bincount(columns, off[rows, y], len(names)) for y in (0, 1)], 1)
        grad_p = (own[:, :-1, :, None] * own[:, 1:, None, :] * inside[:, :, None, None] - joint).sum((0, 1))
        grad = np.concatenate([grad_w.ravel(), grad_p.ravel()]) - penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate / math.sqrt(1 + step / 30) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Field(names, theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2))


# -- labelled pages

_SOUNDS = "the an er on re at en nd or es is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur é è ü ß ñ ó ä ö".split()


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(_SOUNDS) for _ in range(rng.choice((1, 2, 2, 3, 4)))) for _ in range(n))


def _sentences(rng: random.Random, n: int) -> str:
    noisy = rng.random() < 0.2
    text = " ".join(_words(rng, rng.randint(1, 18)).capitalize() + rng.choice(("., " if rng.random() < 0.1 else ".", ".", "!", "?")) for _ in range(n)).replace("., ", ", ")
    if rng.random() < 0.08:
        return text.replace(" ", rng.choice((" | ", " · ", " » ", " - ")))
    return re.sub(r"(?<=\w) ", lambda _: rng.choice(("$$$ ", "### ", "!! ", " ")), text) if noisy else text


def _attr(rng: random.Random, names: str) -> str:
    name = rng.choice(names.split())
    form = rng.random()
    name = f"{name}-{rng.choice(('box', 'wrap', 'list', 'item', 'area', 'inner', 'block', 'main', 'top'))}" if form < 0.25 else f"{name} {rng.choice(('clearfix', 'wide', 'row', 'col'))}" if form < 0.4 else name
    return f' {rng.choice(("class", "class", "id"))}="{name}"'


def _menu(rng: random.Random) -> str:
    items = [f'<a href="/{i}">{_words(rng, rng.randint(1, 3))}</a>' for i in range(rng.randint(2, 9))]
    body = f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>" if rng.random() < 0.7 else " | ".join(items) if rng.random() < 0.5 else "".join(items)
    if rng.random() < 0.6:
        return f"<nav{_attr(rng, 'nav menu main') if rng.random() < 0.4 else ''}>{body}</nav>"
    return f"<div{_attr(rng, 'nav menu navbar navigation breadcrumb breadcrumbs topbar toc pagination pager tabs')}>{body}</div>"


def _boiler(rng: random.Random, kind: str) -> str:
    some = lambda lo, hi: _sentences(rng, rng.randint(lo, hi))
    if kind == "menu":
        return _menu(rng)
    if kind == "ad":
        inner = some(1, 4) if rng.random() < 0.6 else f'<p>{some(1, 3)}</p><a href="/x">{_words(rng, 3)}</a>'
        tag = rng.choice(("div", "div", "aside", "section", "ins"))
        return f"<{tag}{_attr(rng, 'ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion banner commercial')}>{inner}</{tag}>"
    if kind == "notice":
        tag = rng.choice(("div", "div", "section", "p", "aside"))
        inner = some(1, 4) if tag == "p" else f"<p>{some(1, 4)}</p><button>{_words(rng, 2)}</button>" if rng.random() < 0.6 else some(1, 4)
        return f"<{tag}{_attr(rng, 'cookie cookies consent notice gdpr banner privacy popup modal overlay alert message warning disclaimer paywall')}>{inner}</{tag}>"
    if kind == "form":
        fields = f"<label>{_words(rng, 2)}</label><input name=q><textarea>{_words(rng, 3)}</textarea><select><option>{_words(rng, 1)}<option>{_words(rng, 1)}</select><button>{_words(rng, 1)}</button>"
        inner = fields if rng.random() < 0.6 else f"<p>{some(1, 3)}</p>{fields}"
        form = f"<form{_attr(rng, 'search login newsletter signup subscribe contact') if rng.random() < 0.5 else ''}>{inner}</form>"
        return form if rng.random() < 0.7 else f"<div{_attr(rng, 'newsletter subscribe signup search login')}>{some(1, 2)} {form}</div>"
    if kind == "side":
        inner = "".join(f"<h3>{_words(rng, 2)}</h3>" + (f"<p>{some(1, 4)}</p>" if rng.random() < 0.6 else _menu(rng)) for _ in range(rng.randint(1, 3)))
        return f"<aside{_attr(rng, 'sidebar side widget') if rng.random() < 0.5 else ''}>{inner}</aside>" if rng.random() < 0.5 else f"<div{_attr(rng, 'sidebar side widget related recommended trending popular more share social sharing tags teaser bio rail')}>{inner}</div>"
    if kind == "comments":
        tag = rng.choice(("div", "section", "ul", "ol"))
        item = "li" if tag in ("ul", "ol") else rng.choice(("div", "article", "p"))
        cls = lambda: _attr(rng, "comment reply response") if rng.random() < 0.6 else ""
        inner = "".join(f"<{item}{cls()}>{some(1, 6) if item == 'p' or rng.random() < 0.5 else f'<b>{_words(rng, 1)}</b><p>{some(1, 6)}</p>'}</{item}>" for _ in range(rng.randint(1, 5)))
        head = f"<h{rng.randint(2, 4)}>{_words(rng, rng.randint(1, 3))}</h3>" if rng.random() < 0.5 else ""
        return f"<{tag}{_attr(rng, 'comments comment discussion responses replies disqus feedback reviews')}>{head}{inner}</{tag}>"
    if kind == "header":
        inner = f'<h1><a href="/">{_words(rng, 2)}</a></h1><p>{_words(rng, rng.randint(2, 9))}</p>' if rng.random() < 0.5 else f"<div{_attr(rng, 'logo brand title tagline')}>{_words(rng, rng.randint(1, 6))}</div>" + rng.choice(("", _menu(rng)))
        return f"<header{_attr(rng, 'header masthead top site') if rng.random() < 0.5 else ''}>{inner}</header>" if rng.random() < 0.6 else f"<div{_attr(rng, 'header masthead topbar')}>{inner}</div>"
    if kind == "noscript":
        return f"<noscript>{some(1, 2)}</noscript>"
    text = rng.choice((f"&copy; {_words(rng, 1)}.example.com &middot; {some(1, 3)}", f"<p>&copy; 2020 {_words(rng, 3)}</p><p>{some(1, 4)}</p>", f"<p>{some(1, 3)}</p>{_menu(rng)}", some(1, 5)))
    return f"<footer{_attr(rng, 'footer bottom') if rng.random() < 0.4 else ''}>{text}</footer>" if rng.random() < 0.6 else f"<div{_attr(rng, 'footer bottom copyright legal colophon')}>{text}</div>"


def _article(rng: random.Random) -> list[str]:
    """Pieces of an article's markup; every text in it is content."""
    out = [f"<h1>{_words(rng, rng.randint(1, 12)).capitalize()}</h1>"] if rng.random() < 0.85 else []
    if rng.random() < 0.15:
        out = [f"<header>{out[0]}</header>"] if out else out
    for _ in range(rng.choice((1, 1, 2, 3, 4, 6, 9))):
        text, r = _sentences(rng, rng.randint(1, rng.choice((1, 3, 8)))), rng.random()
        if r < 0.1:
            text = _words(rng, rng.randint(1, 4))
        if rng.random() < 0.15:
            at = text.find(" ") + 1
            text = f'{text[:at]}<a href="/r">{_words(rng, 2)}</a> {text[at:]}'
        form = rng.random()
        if form < 0.55:
            out.append(f"<p>{text}</p>")
        elif form < 0.7:
            out.append(rng.choice((f"<p><b>{text}<br>", f"<p>{text}", f"<p><i>{text}</i><br>{_words(rng, 3)}</p>")))
        elif form < 0.78:
            out.append(f"<h{rng.randint(2, 4)}>{_words(rng, rng.randint(1, 8))}</h2>")
        elif form < 0.86:
            out.append("<ul>" + "".join(f"<li>{_sentences(rng, 1) if rng.random() < 0.6 else _words(rng, rng.randint(1, 6))}" for _ in range(rng.randint(1, 4))) + "</ul>")
        elif form < 0.92:
            out.append(f"<blockquote>{rng.choice((text, f'<p>{text}</p>'))}</blockquote>")
        elif form < 0.95:
            out.append(f"<pre>{_words(rng, 6)}</pre>")
        elif form < 0.98:
            out.append(f"<table><tr><th>{_words(rng, 1)}<th>{_words(rng, 1)}<tr><td>{_words(rng, 2)}<td>{rng.randint(1, 99)}</table>")
        else:
            out.append(f"<figure><img src=x><figcaption>{text}</figcaption></figure>")
    return out


def training_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page and the labels of its blocks: content is marked by a tag of its own, which is taken out again."""
    inside = []
    for part in _article(rng):
        inside.append(f"<x-c>{part}</x-c>")
        if rng.random() < 0.12:
            inside.append(_boiler(rng, rng.choice(("ad", "form", "side", "notice", "menu"))))
    if rng.random() < 0.1:
        inside.append(_boiler(rng, "comments"))
    body, form = "".join(inside), rng.random()
    if form < 0.55:
        body = f"<article{_attr(rng, 'post entry story article') if rng.random() < 0.3 else ''}>{body}</article>"
    elif form < 0.7:
        body = f"<main{_attr(rng, 'content main') if rng.random() < 0.4 else ''}>{body}</main>"
    else:
        body = f"<div{_attr(rng, 'content article post entry story body text page main')}>{body}</div>"
    if rng.random() < 0.3:
        body = f"<div{_attr(rng, 'container wrapper page layout grid')}>{body}</div>"
    before = [_boiler(rng, k) for k in ("header", "menu", "notice", "ad", "form", "side", "noscript") if rng.random() < {"menu": 0.7, "header": 0.5, "ad": 0.4}.get(k, 0.2)]
    after = [_boiler(rng, k) for k in ("side", "ad", "comments", "form", "menu", "footer", "notice") if rng.random() < {"footer": 0.8, "comments": 0.35}.get(k, 0.25)]
    if rng.random() < 0.2:
        rng.shuffle(before)
    html = f'<!DOCTYPE html><html><head><title>{_words(rng, 4)}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{"".join(before)}<!-- x -->{body}{"".join(after)}</body></html>'
    return html, [int("<x-c" in around) for _, _, _, around in blocks_of(html)]


def training_pages(n: int = 500, seed: int = 5) -> list[tuple[str, list[int]]]:
    rng = random.Random(seed)
    return [(html, labels) for html, labels in (training_page(rng) for _ in range(n)) if labels]


def page_features(html: str | None) -> tuple[list[str], list[list[str]]]:
    blocks = blocks_of(html)
    return [b[0] for b in blocks], [[f for f in features(b, i) if f != "<x-c"] for i, b in enumerate(blocks)]


@cache
def field() -> Field:
    return train([(page_features(html)[1], labels) for html, labels in training_pages()])


def main_text(html: str | None, model: Field) -> str:
    texts, blocks = page_features(html)
    return "\n".join(t for t, label in zip(texts, model.decode(blocks), strict=True) if label)


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """``pages`` with text and n_chars got from html."""
    shared = pages.sparkSession.sparkContext.broadcast(model or field())
    kept, at = others(pages, ("text", "n_chars")), [c.lower() for c in pages.columns].index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html, shared.value) for html in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept] + ["text string", "n_chars bigint"])
    return pages.mapInArrow(run, schema)
