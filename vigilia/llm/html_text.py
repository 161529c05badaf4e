"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read once from left to right: a stack of open elements stands for the
tree, and the text between two block borders is a leaf block. A block's
features are its ancestors' tags, roles and words of class and id, and the
shape of its text (length, share of link text, final punctuation). The field
labels the sequence of blocks as article or not, with transitions of their own
for neighbours in one container and for those in two; Viterbi finds the best
labelling. It is trained by stochastic gradients of the conditional likelihood
on labelled pages which `labelled_pages` writes in the layouts that pages use.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilia.llm.common import arrow_map, fresh

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Fixed values of HTML: elements without an end tag, elements inside a line, elements whose text is never shown as text, elements that end an open paragraph's like.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("script style template noscript svg math iframe object canvas audio video select datalist head title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
IMPLIED = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPES = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"]), "option": frozenset(["select"])}
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())  # what may stand in a page's head; anything else ends it
FALLBACK = frozenset("svg math object canvas audio video select datalist template".split())  # hide what they hold, if they are closed at all
PHRASE = frozenset("p h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("nav header footer aside article main section form dialog".split())
TAGS = frozenset("nav header footer aside article main section form table ul ol dl figure figcaption blockquote pre h1 h2 h3 h4 h5 h6 p li td th button label dialog address details summary fieldset legend menu".split())


class Block:
    __slots__ = ("text", "linked", "path")

    def __init__(self, text: str, linked: int, path: tuple):
        self.text, self.linked, self.path = text, linked, path


@functools.lru_cache(maxsize=20_000)
def _frame(tag: str, attributes: str) -> tuple[str, tuple[str, ...], bool]:
    """An open element: its tag, the features of its attributes, and whether it is hidden."""
    words, hidden = [], tag in UNSEEN
    for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            found = [w.lower() for w in _WORDS.findall(value) if not w.isdigit()]
            words += [f"word:{w}" for w in found] + [f"stem:{w[:5]}" for w in found if len(w) >= 5]
        elif name in ("role", "itemprop"):
            words.append(f"{name}:{value.lower()}")
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return tag, tuple(dict.fromkeys(words)), hidden


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks with text, in page order. White space is one space; references are decoded; hidden text is left out.

    A head ends at its end tag or at the first text or element that is none of a
    head's. A video, drawing, list of choices or the like that is never closed hides nothing.
    """
    out: list[Block] = []
    stack: list[tuple] = []
    parts: list[str] = []
    state = [0, 0]  # characters of link text in this block; how many open elements are hidden
    links = at = 0
    lower, never = page.lower() if len(page.lower()) == len(page) else page, set()  # for a few letters lower case is longer

    def close() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(state[0], len(text)), tuple(stack)))
            parts.clear()
        state[0] = 0

    def pop_to(n: int) -> None:
        nonlocal links
        while len(stack) > n:
            tag, _, hidden = stack.pop()
            state[1] -= hidden
            links -= tag == "a"

    def closed(tag: str) -> bool:
        """Whether an end tag follows, before the next start tag of an element that cannot hold itself."""
        if tag in never:
            return False
        end = lower.find(f"</{tag}", at)
        if end < 0:
            never.add(tag)
        return end >= 0 and (tag not in ("audio", "video", "canvas", "select", "datalist") or lower.find(f"<{tag}", at, end) < 0)

    def add(text: str) -> None:
        if stack and stack[-1][0] == "head" and not text.isspace():
            pop_to(len(stack) - 1)
        if text and not state[1]:
            if "&" in text:
                text = html.unescape(text)
            parts.append(text)
            if links:
                state[0] += len(text)

    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        tag = token[2] or token[5]
        if tag is None:
            continue
        tag, ending, attributes = tag.lower(), token[1] or token[4], (token[3] if token[2] else token[6])
        if tag not in INLINE:
            close()
        elif tag == "br":
            add("\n")
        if ending:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == tag:
                    pop_to(n)
                    break
                if tag in INLINE and stack[n][0] not in INLINE:
                    break
            continue
        if tag not in HEAD and stack and stack[-1][0] == "head":
            pop_to(len(stack) - 1)
        if tag in VOID or tag in FALLBACK and not closed(tag):
            continue
        if tag in IMPLIED:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] in IMPLIED[tag]:
                    pop_to(n)
                    break
                if stack[n][0] in SCOPES[tag]:
                    break
        elif tag not in INLINE:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] in PHRASE:
                    pop_to(n)
                    break
                if stack[n][0] not in INLINE:
                    break
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if tag == "textarea" or tag in UNSEEN:
                at = end.end() if end else len(page)
                continue
        if attributes.endswith("/") and tag in ("svg", "math"):
            continue
        frame = _frame(tag, attributes.strip())
        stack.append(frame)
        state[1] += frame[2]
        links += tag == "a"
    close()
    return out


@functools.lru_cache(maxsize=50_000)
def _path_features(path: tuple) -> tuple[str, ...]:
    out, own = [], ""
    tags = [f[0] for f in path if f[0] in TAGS]
    for tag, words, _ in path:
        if tag in TAGS:
            out.append(f"in:{tag}")
        out += words
    blocks = [f[0] for f in path if f[0] not in INLINE]
    own = blocks[-1] if blocks else "none"
    out.append(f"own:{own}")
    if "article" in tags or "main" in tags:
        inner = tags[max(i for i, t in enumerate(tags) if t in ("article", "main")) + 1 :]
        out += ["inside"] + [f"inside:{t}" for t in inner]
    return tuple(dict.fromkeys(out))


@functools.lru_cache(maxsize=50_000)
def _container(path: tuple) -> tuple:
    """The part of a path that says in which section of the page it is."""
    return tuple(f for f in path if f[1] or f[0] in SECTIONS)


SAME, NEW = "~same", "~new"


def page_features(blocks: list[Block]) -> list[list[str]]:
    """The features of each block, the first telling whether the block before is in the same container."""
    out, before = [], None
    for block in blocks:
        here = _container(block.path)
        out.append([SAME if here == before else NEW, *features(block)])
        before = here
    return out


def features(block: Block) -> list[str]:
    text = block.text
    words, share = text.count(" ") + 1, block.linked / len(text)
    size = "1" if words == 1 else "4" if words <= 4 else "10" if words <= 10 else "25" if words <= 25 else "60" if words <= 60 else "more"
    link = "0" if share == 0 else "some" if share < 0.3 else "much" if share < 0.8 else "all"
    out = ["bias", f"size:{size}", f"link:{link}", f"size:{size}+link:{link}"]
    if text[-1] in ".!?…:;\"'”»":
        out.append("stop")
    if "©" in text:
        out.append("copyright")
    out += _path_features(block.path)
    return out


class ChainCRF:
    """Two labels (1: article). Weights are those of label 1 against label 0; `step[k][a][b]` is that of b after a, k being 0 within a container and 1 between two."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.first = [0.0, 0.0]
        self.step = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(2)]

    def _emissions(self, sequence: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in fs) for fs in sequence]

    def decode(self, sequence: list[list[str]]) -> list[int]:
        """Viterbi; of equal labellings the one with fewer article blocks from the end."""
        if not sequence:
            return []
        e = self._emissions(sequence)
        zero, one, back = self.first[0], self.first[1] + e[0], []
        for x, fs in zip(e[1:], sequence[1:]):
            (aa, ab), (ba, bb) = self.step[fs[0] != SAME]
            z = (0, zero + aa) if zero + aa >= one + ba else (1, one + ba)
            o = (0, zero + ab) if zero + ab >= one + bb else (1, one + bb)
            back.append((z[0], o[0]))
            zero, one = z[1], o[1] + x
        label = 1 if one > zero else 0
        out = [label]
        for previous in reversed(back):
            label = previous[label]
            out.append(label)
        return out[::-1]

    def train(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 8, rate: float = 0.3, penalty: float = 1e-4) -> None:
        """AdaGrad on the log-likelihood of the labels, one page at a time; marginals by forward-backward."""
        squares: dict = {}
        random_order = random.Random(1)

        def move(table, key, name, g):
            squares[name] = squares.get(name, 1e-3) + g * g
            table[key] = table.get(key, 0.0) * (1 - penalty) + rate * g / math.sqrt(squares[name]) if isinstance(table, dict) else table[key] + rate * g / math.sqrt(squares[name])

        def add(a, b):
            m = max(a, b)
            return m + math.log(math.exp(a - m) + math.exp(b - m))

        for _ in range(epochs):
            order = list(range(len(pages)))
            random_order.shuffle(order)
            for k in order:
                sequence, labels = pages[k]
                if not sequence:
                    continue
                e, n = self._emissions(sequence), len(sequence)
                kind = [int(fs[0] != SAME) for fs in sequence]
                ahead = [(self.first[0], self.first[1] + e[0])]
                for i in range(1, n):
                    (z, o), s = ahead[-1], self.step[kind[i]]
                    ahead.append((add(z + s[0][0], o + s[1][0]), add(z + s[0][1], o + s[1][1]) + e[i]))
                after = [(0.0, 0.0)]
                for i in range(n - 1, 0, -1):
                    (z, o), s = after[-1], self.step[kind[i]]
                    after.append((add(s[0][0] + z, s[0][1] + e[i] + o), add(s[1][0] + z, s[1][1] + e[i] + o)))
                after.reverse()
                total = add(*ahead[-1])
                gap: dict[str, float] = {}
                for i, fs in enumerate(sequence):
                    g = labels[i] - math.exp(ahead[i][1] + after[i][1] - total)
                    if abs(g) > 1e-4:
                        for f in fs:
                            gap[f] = gap.get(f, 0.0) + g
                moves = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(2)]
                for i in range(1, n):
                    s, m = self.step[kind[i]], moves[kind[i]]
                    for a in (0, 1):
                        for b in (0, 1):
                            m[a][b] -= math.exp(ahead[i - 1][a] + s[a][b] + (e[i] if b else 0) + after[i][b] - total)
                    m[labels[i - 1]][labels[i]] += 1
                for f, g in gap.items():
                    move(self.weights, f, f, g)
                for a in (0, 1):
                    move(self.first, a, ("first", a), (labels[0] == a) - math.exp(ahead[0][a] + after[0][a] - total))
                    for c in (0, 1):
                        for b in (0, 1):
                            move(self.step[c][a], b, (c, a, b), moves[c][a][b])


# Labelled pages: the layouts that pages use, each block marked as article (1) or not (0).

_SYLLABLES = "ba ke li mo nu ra si to ve wi an er on il as te pro con der sch ment tion ing ou é ñ ü".split()


def _text(r: random.Random, low: int, high: int, stop: bool = True) -> str:
    words = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    out = " ".join(words).capitalize()
    return out + r.choice(".!?") if stop and r.random() < 0.9 else out


def _article(r: random.Random) -> Iterator[tuple[str, str, int]]:
    """(before, text, after is implied) pieces of an article: headings, paragraphs, lists, quotes, tables, code, captions."""
    if r.random() < 0.8:
        yield r.choice(["<h1>", "<h1>", "<h1>", "<h2>", "<header><h1>"]), _text(r, 1, 12, r.random() < 0.3), 1
    if r.random() < 0.2:
        yield r.choice(["<p class='byline'>", "<div class='author'>", "<address>", "<p class='dateline'>", "<p><time>", "<div class='meta'>", "<p class='lead'>"]), _text(r, 2, 8, False), 1
    for _ in range(r.choice([1, 2, 3, r.randint(1, 14)])):
        kind = r.random()
        if kind < 0.72:
            yield r.choice(["<p>", "<p>", "<p>", "<p class='text'>", "<p><b>", "<div>"]), _text(r, 2, r.choice([8, 40, 120])), 1
        elif kind < 0.8:
            yield r.choice(["<h2>", "<h3>"]), _text(r, 1, 7, False), 1
        elif kind < 0.87:
            for _ in range(r.randint(2, 5)):
                yield r.choice(["<ul><li>", "<ul><li>", "<ol><li>", "<dl><dt>", "<dl><dd>"]), _text(r, 1, 20), 1
        elif kind < 0.91:
            yield "<blockquote><p>", _text(r, 5, 50), 1
        elif kind < 0.94:
            for _ in range(r.randint(2, 6)):
                yield "<table><tr><td>", _text(r, 1, 4, False), 1
        elif kind < 0.97:
            yield "<pre>", _text(r, 4, 30), 1
        else:
            yield "<figure><figcaption>", _text(r, 3, 15), 1


_BOILER = {
    # Fixed values: (containers, blocks) in which pages keep what is no article.
    "menu": (["<nav>", "<div class='menu'>", "<ul id='main-menu'>", "<div id='nav'>", "<div class='navbar'>", "<header><nav>", "<div role='navigation'>", "<div class='breadcrumbs'>", "<div class='breadcrumb'>", "<nav class='toc'>", "<div class='pagination'>", "<menu>", "<ul class='menu'>"], "links"),
    "header": (["<header>", "<div id='header'>", "<div class='site-header'>", "<div class='masthead'>", "<div role='banner'>", "<div class='topbar'>"], "short"),
    "footer": (["<footer>", "<div id='footer'>", "<div class='site-footer'>", "<div role='contentinfo'>", "<div class='copyright'>", "<div class='bottom'>", "<div class='page-footer'>"], "foot"),
    "sidebar": (["<aside>", "<div class='sidebar'>", "<div id='sidebar'>", "<div class='widget'>", "<div class='related-posts'>", "<div role='complementary'>", "<section class='related'>", "<div class='recommended'>", "<div class='share social'>"], "mixed"),
    "notice": (["<div class='cookie-notice'>", "<div class='consent'>", "<div id='cookie-banner'>", "<div role='alert'>", "<div class='notice'>", "<dialog>", "<div class='popup modal'>", "<div class='gdpr'>", "<div role='dialog'>", "<div class='alert'>", "<div class='site-notice'>", "<div class='announcement'>", "<div class='disclaimer'>", "<div class='privacy-policy-notice'>"], "prose"),
    "advert": (["<div class='ad'>", "<div class='ads'>", "<div class='advert'>", "<div class='sponsored'>", "<div id='ad-slot'>", "<div class='promo'>", "<aside class='advertisement'>", "<div class='banner'>", "<ins class='adsbygoogle'>", "<div class='ad-box'>", "<div class='promo-box'>", "<div class='advertisement'>", "<section class='sponsor'>"], "prose"),
    "form": (["<form>", "<form class='newsletter'>", "<form id='search'>", "<div class='subscribe'><form>", "<form class='login'>", "<fieldset>"], "form"),
    "comments": (["<section class='comments'>", "<div id='comments'>", "<ol class='comment-list'>", "<div class='reader-comments'>", "<div class='comment'>", "<section id='discussion'>", "<div class='replies'>", "<div id='disqus_thread'>", "<div class='responses'>", "<div class='user-comment'>", "<div id='respond'>", "<article class='comment'>", "<div class='comment-body'>", "<section class='reader-reviews'>"], "prose"),
}


def _boiler(r: random.Random, kind: str) -> Iterator[tuple[str, str, int]]:
    containers, style = _BOILER[kind]
    box = r.choice(containers)
    for _ in range(r.randint(1, 8) if style in ("links", "mixed") else r.randint(1, 4)):
        if style == "links" or style == "mixed" and r.random() < 0.5:
            yield box + "<ul><li><a href='/x'>", _text(r, 1, 6, False), 0
        elif style == "short":
            yield box + r.choice(["<div>", "<p>", "<h1>", "<span>", "<a href='/'>"]), _text(r, 1, 6, False), 0
        elif style == "foot":
            yield box + r.choice(["", "<p>", "<small>"]), r.choice(["© ", "© 2020 ", ""]) + _text(r, 2, 25), 0
        elif style == "form":
            yield box + r.choice(["<label>", "<p>", "<button>", "<legend>", "<div>"]), _text(r, 1, 12), 0
        else:
            yield box + r.choice(["", "", "<p>", "<p>", "<div>", "<h3>"]), _text(r, 1, r.choice([6, 15, 60])), 0


#: Openings of single blocks that stand between an article's own and are none of it.
_STRAYS = ["<button>", "<button>", "<p><button>", "<div><button>", "<button class='subscribe'>", "<div class='ad'>", "<div class='share'><a href='/s'>", "<aside>", "<form><label>", "<form><button>", "<div class='promo'><a href='/p'>"]
_BODIES = ["", "", "<article>", "<article>", "<main><article>", "<main>", "<div class='content'>", "<div id='content'>", "<div class='post-body'>", "<div class='entry-content'>", "<div class='article-text'>", "<section class='story'>", "<div role='main'>", "<article class='post'>", "<div>", "<main><div class='body'>", "<div>", "<section>", "<div class='page'><div>", "<div id='wrap'><div class='bd'>", "<table><tr><td>", "<div class='story'>"]
_TAG = re.compile(r"<([a-z0-9]+)")


def labelled_pages(n: int, seed: int = 17) -> Iterator[tuple[str, set[str]]]:
    """(html, the texts of its article blocks) of `n` pages."""
    r = random.Random(seed)
    for _ in range(n):
        body, good = r.choice(_BODIES), set()
        before = [k for k in ("notice", "header", "menu", "advert", "form", "sidebar") if r.random() < 0.45]
        after = [k for k in ("advert", "comments", "sidebar", "form", "notice", "footer") if r.random() < 0.5]
        inner = [k for k in ("advert", "form", "comments", "sidebar", "notice") if r.random() < 0.2]
        if r.random() < 0.3:  # a page of little else than its article
            before, after, inner = before[: r.choice([0, 0, 1])], after[: r.choice([0, 0, 1])], []
        r.shuffle(inner)
        r.shuffle(before)
        out = ["<!DOCTYPE html><html><head><title>x</title></head><body>"]

        def put(pieces, shell=""):
            for opening, text, label in pieces:
                opening = shell + opening
                shape = text.split(" ")
                if label == 1 and r.random() < 0.15 and len(shape) > 4:
                    shape[1] = f"<a href='/y'>{shape[1]}</a>"
                out.append(opening + " ".join(shape) + "".join(f"</{t}>" for t in reversed(_TAG.findall(opening))))
                if label:
                    good.add(" ".join(text.split()))

        for kind in before:
            put(_boiler(r, kind))
        pieces = list(_article(r))
        if r.random() < 0.4:
            for _ in range(r.randint(1, 3)):
                pieces.insert(r.randint(0, len(pieces)), (r.choice(_STRAYS), _text(r, 1, 5, False), 0))
        for kind in inner:
            cut = r.randint(0, len(pieces))
            put(pieces[:cut], body)
            put(_boiler(r, kind), body)
            pieces = pieces[cut:]
        put(pieces, body)
        for kind in after:
            put(_boiler(r, kind))
        out.append("</body></html>")
        yield "".join(out), good


TRAIN_PAGES = 700


def fit_extractor(pages: int = TRAIN_PAGES, seed: int = 17) -> ChainCRF:
    sequences = []
    for page, good in labelled_pages(pages, seed):
        blocks = blocks_of(page)
        sequences.append((page_features(blocks), [int(b.text in good) for b in blocks]))
    model = ChainCRF()
    model.train(sequences)
    return model


def main_text(page: str | None, model: ChainCRF) -> str:
    blocks = blocks_of(page) if page else []
    labels = model.decode(page_features(blocks))
    return "\n\n".join(b.text for b, on in zip(blocks, labels) if on)


def extract(pages: DataFrame, keep: list[str], body: str, model: ChainCRF | None = None) -> DataFrame:
    """The columns `keep` with text and n_chars (code points) of every row.

    Null, empty and textless pages have an empty text; a page that breaks off is
    read as far as it goes; every row stands for itself, also one that repeats.
    Columns that are not kept are ignored; of kept ones named text or n_chars,
    in capitals or not, the result's take the place.
    """
    keep = [c for c in keep if c.lower() not in ("text", "n_chars")]
    schema = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    shared = pages.sparkSession.sparkContext.broadcast(model or fit_extractor())

    def run(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = [main_text(page.as_py(), shared.value) for page in column.slice(lo, 200)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return arrow_map(pages.select(*keep, F.col(body).alias(*fresh(keep, "_body"))), run, f"{schema}text string, n_chars long")
