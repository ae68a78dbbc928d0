"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page is read into its leaf text blocks in order, each with its chain of ancestor tags, the words of
their class, id and role attributes, and figures of its text. The field has two states, main and
other; its weights are learnt on labelled pages by maximum likelihood and a page is decoded by
Viterbi. The labelled pages are laid out here by templates in which every block's label is known;
their words are invented, so only structure and shape can be learnt from them.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element sets of the HTML standard.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
_SECTIONS = frozenset("article aside body dialog footer form header main nav section".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style template noscript iframe svg math object textarea title head datalist canvas audio video".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_CLOSES_P = _BLOCK - frozenset("caption dd dt body html legend li option optgroup tbody td tfoot th thead tr".split())
_IMPLIED = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist"),
}
_IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _IMPLIED.items()}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_TOKEN = re.compile(r"[a-z]+")


@dataclass
class Block:
    """One leaf block: its text, its open elements, and the characters that lie inside links."""

    text: str
    path: tuple[str, ...]
    linked: int = 0


@lru_cache(maxsize=20_000)
def _element(tag: str, attributes: str) -> str:
    """A tag with the words of its naming attributes: ``div side ad``."""
    words: list[str] = []
    for m in _NAMES.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "style":
            words += ["hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else []
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            words.append("hidden")
        elif name != "aria-hidden":
            words += _TOKEN.findall(value)
    return " ".join([tag, *dict.fromkeys(words)])


def blocks(page: str) -> list[Block]:
    """Leaf text blocks of a page in order. Markup that is broken is read as far as it goes."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # tag and element of every open tag
    unseen = links = 0
    texts: list[str] = []
    linked, path = 0, ()

    def flush():
        nonlocal linked
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                out.append(Block(text, path, linked))
            texts.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked, path
        if unseen or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if not texts:
            if text.isspace():
                return
            path = tuple(e for _, e in stack)
        texts.append(text)
        if links:
            linked += len(text)

    def pop_to(i: int):
        nonlocal unseen, links
        for tag, _ in stack[i:]:
            unseen -= tag in _UNSEEN
            links -= tag == "a"
        del stack[i:]

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in _BLOCK:
                flush()
            elif tag == "br":
                add(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag in _BLOCK:
            flush()
        if tag in _VOID:
            if tag == "br":
                add(" ")
            continue
        if tag in _CLOSES_P or tag in _IMPLIED:
            close, within = _IMPLIED.get(tag, (frozenset(("p",)), _CLOSES_P - {"p"}))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in within:
                    break
                if stack[i][0] in close:
                    pop_to(i)
                    if tag not in ("tr", "td", "th"):
                        break
        if tag == "body":  # a head that was never closed
            for i, (t, _) in enumerate(stack):
                if t == "head":
                    pop_to(i)
                    break
        if attributes.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in _RAW:
            close_at = re.compile(rf"</{tag}", re.I).search(page, at)
            at = close_at.start() if close_at else end
        stack.append((tag, _element(tag, attributes)))
        unseen += tag in _UNSEEN
        links += tag == "a"
    flush()
    return out


_SENTENCE = re.compile(r"[.!?…。]['\"”’)]*(?:\s|$)")
_LEGAL = re.compile(r"©|\(c\)|copyright|all rights reserved|privacy|cookie|terms of", re.I)


_PARTS = "comment cookie footer header sidebar advert promo newsletter nav menu article content banner related".split()


@lru_cache(maxsize=50_000)
def _path_features(path: tuple[str, ...]) -> tuple[str, ...]:
    found: dict[str, None] = {}
    for element in path:
        tag, *words = element.split(" ")
        found["in:" + tag] = None
        for w in words:
            found["named:" + w] = None
            # Compound names that carry a telling part.
            for part in _PARTS:
                if part in w and part != w:
                    found["part:" + part] = None
    for element in reversed(path):  # the innermost element that tells what it is for
        tag, *words = element.split(" ")
        if words or tag in _SECTIONS:
            found |= dict.fromkeys(f"near:{w}" for w in (words or [tag]))
            break
    leaf = next((e.split(" ")[0] for e in reversed(path) if e.split(" ")[0] in _BLOCK), "none")
    found["leaf:" + leaf] = None
    return tuple(found)


def _features(block: Block) -> list[str]:
    text, n = block.text, len(block.text)
    words = text.count(" ") + 1
    share = block.linked / n
    out = [
        "bias",
        f"words:{min(7, words.bit_length())}",
        f"links:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
        f"sentences:{min(3, sum(1 for _ in _SENTENCE.finditer(text[:2000])))}",
    ]
    if _LEGAL.search(text[:300]):
        out.append("legal")
    if sum(map(str.isdigit, text[:200])) > 0.3 * min(n, 200):
        out.append("digits")
    return out


class Field:
    """A chain of two states (0 other, 1 main) over blocks."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, step: np.ndarray):
        self.weights, self.start, self.step = weights, start.tolist(), step.tolist()
        self._paths: dict[tuple[str, ...], float] = {}

    def lean(self, block: Block) -> float:
        """Score of main against other for one block."""
        path = self._paths.get(block.path)
        if path is None:
            if len(self._paths) > 50_000:
                self._paths.clear()
            path = self._paths[block.path] = sum(self.weights.get(f, 0.0) for f in _path_features(block.path))
        return path + sum(self.weights.get(f, 0.0) for f in _features(block))

    def decode(self, chain: list[Block]) -> list[int]:
        """Viterbi: the most likely states of a page's blocks."""
        if not chain:
            return []
        (s0, s1), ((t00, t01), (t10, t11)) = self.start, self.step
        back = []
        a, b = s0, s1 + self.lean(chain[0])
        for block in chain[1:]:
            from0, from1 = (a + t00 < b + t10), (a + t01 < b + t11)
            back.append((from0, from1))
            a, b = (b + t10 if from0 else a + t00), (b + t11 if from1 else a + t01) + self.lean(block)
        state = int(b > a)
        states = [state]
        for choice in reversed(back):
            state = int(choice[state])
            states.append(state)
        return states[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], steps: int = 400, rate: float = 0.1, penalty: float = 3e-4) -> Field:
    """Maximum likelihood with a quadratic penalty by full-batch Adam steps; all chains run side by side."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    rows, cols = [], []
    longest, count = max(len(b) for b, _ in pages), len(pages)
    truth, real = np.zeros((count, longest), np.int64), np.zeros((count, longest), bool)
    for i, (chain, labels) in enumerate(pages):
        truth[i, : len(chain)], real[i, : len(chain)] = labels, True
        for t, block in enumerate(chain):
            for f in {*_path_features(block.path), *_features(block)}:
                rows.append(i * longest + t)
                cols.append(names.setdefault(f, len(names)))
    rows, cols = np.array(rows), np.array(cols)
    k = len(names)
    theta = np.zeros(k + 6)
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    at = np.arange(count)
    for step in range(1, steps + 1):
        w, start, move = theta[:k], theta[k : k + 2], theta[k + 2 :].reshape(2, 2)
        lean = np.bincount(rows, w[cols], count * longest).reshape(count, longest)
        node = np.stack([np.zeros_like(lean), lean], axis=2)
        forward = np.zeros((count, longest, 2))
        backward = np.zeros((count, longest, 2))
        forward[:, 0] = start + node[:, 0]
        for t in range(1, longest):
            here = np.logaddexp.reduce(forward[:, t - 1, :, None] + move, axis=1) + node[:, t]
            forward[:, t] = np.where(real[:, t, None], here, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            here = np.logaddexp.reduce(move + (node[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(real[:, t + 1, None], here, 0.0)
        z = np.logaddexp.reduce(forward[:, -1], axis=1)
        p = np.exp(forward + backward - z[:, None, None])
        g = np.zeros_like(theta)
        miss = np.where(real, p[:, :, 1] - truth, 0.0)
        g[:k] = np.bincount(cols, miss.ravel()[rows], k)
        g[k : k + 2] = p[:, 0].sum(axis=0) - np.bincount(truth[:, 0], minlength=2)
        pair = np.exp(forward[:, :-1, :, None] + move + (node + backward)[:, 1:, None, :] - z[:, None, None, None])
        pair *= real[:, 1:, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (truth[:, :-1][real[:, 1:]], truth[:, 1:][real[:, 1:]]), 1)
        g[k + 2 :] = (pair.sum(axis=(0, 1)) - seen).ravel()
        g = g / count + penalty * theta
        moment = 0.9 * moment + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        theta -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Field({f: float(theta[i]) for f, i in names.items()}, theta[k : k + 2], theta[k + 2 :].reshape(2, 2))


# How menus of each tag are named in the labelled pages.
_MENUS = {
    "nav": ("", ' class="navbar"', ' id="menu"', ' role="navigation"', ""),
    "ul": (' class="menu"', ' id="nav"', ' class="breadcrumb"'),
    "div": (' class="nav"', ' id="menu"', ' class="breadcrumbs"', ' class="topbar"', ' class="navigation"'),
    "header": ("", ' class="masthead"'),
}


@dataclass
class _Page:
    """A page under construction; ``main`` marks text that belongs to the article."""

    random: random.Random
    parts: list[str] = field(default_factory=list)

    def words(self, low: int, high: int, stop: str = ".") -> str:
        syllables = ("ba", "den", "ko", "lim", "ra", "tos", "ve", "nur", "pi", "sel", "é", "um", "da", "gor", "lä", "ñi")
        word = lambda: "".join(self.random.choices(syllables, k=self.random.randint(1, 4)))
        out = [word() for _ in range(self.random.randint(low, high))]
        for i in range(7, len(out), self.random.randint(8, 16)):
            out[i] += self.random.choice((".", ",", ".", "!"))
        return " ".join(out).capitalize() + stop

    def main(self, text: str) -> str:
        """Text with a mark that the labels are read from."""
        return "\x02" + text

    def one(self, *options: str) -> str:
        return self.random.choice(options)

    def menu(self) -> str:
        n, tag = self.random.randint(2, 9), self.one("nav", "div", "ul", "div", "header")
        link = lambda: f'<a href="/{self.random.randint(1, 99)}">{self.words(1, 3, "")}</a>'
        if tag == "ul" or self.random.random() < 0.6:
            items = "".join(f"<li>{link()}</li>" for _ in range(n))
            items = items if tag == "ul" else f"<ul>{items}</ul>"
        else:
            items = self.one(" | ", " ", "\n").join(link() for _ in range(n))
        return f"<{tag}{self.one(*_MENUS[tag])}>{items}</{tag}>"

    def boxed(self, tags: str, names: str, inner: str) -> str:
        tag, name, key = self.one(*tags.split()), self.one(*names.split()), self.one("class", "class", "id")
        return f'<{tag} {key}="{name}">{inner}</{tag}>'

    def sentence(self) -> str:
        return self.one("<p>{}</p>", "{}", "<div>{}</div>", "<span>{}</span>").format(self.words(3, 30))

    def several(self) -> str:
        return "".join(self.sentence() for _ in range(self.random.randint(1, 3)))

    def links(self) -> str:
        link = lambda i: f'<li><a href="/{i}">{self.words(2, 8, "")}</a></li>'
        return "<ul>" + "".join(link(i) for i in range(self.random.randint(2, 6))) + "</ul>"

    def heading(self) -> str:
        return self.one(f"<h3>{self.words(1, 3, '')}</h3>", "")

    def form(self) -> str:
        fields = f"<label>{self.words(1, 4, '')}</label><input><button>{self.words(1, 2, '')}</button>"
        bare = f"<form>{self.one('', self.sentence())}{fields}</form>"
        named = "newsletter subscribe signup login search"
        return self.one(bare, self.boxed("div section", named, f"<form>{self.sentence()}{fields}</form>"))

    def comments(self) -> str:
        author = lambda: self.one("", f"<b>{self.words(1, 2, '')}</b> ")
        entry = lambda: self.boxed("div li article p", "comment comment-body reply", author() + self.several())
        inner = self.heading() + "".join(entry() for _ in range(self.random.randint(1, 4)))
        return self.boxed("div section ol", "comments comment-list disqus responses discussion comments-area", inner)

    def aside(self) -> str:
        """One block of any kind that is not the article."""
        kind = self.random.randrange(8)
        if kind == 0:
            names = "ad ads advert advertisement sponsored ad-banner promo banner"
            return self.boxed("div aside section p", names, self.several())
        if kind == 1:
            names = "sidebar side widget related related-posts rail recommended more"
            return self.boxed("div aside aside section", names, self.heading() + self.one(self.links(), self.several()))
        if kind == 2:
            names = "cookie-notice cookie notice consent gdpr cookie-banner alert popup message"
            return self.boxed("div section dialog", names, self.several() + self.one("<button>Ok</button>", ""))
        if kind == 3:
            return self.form()
        if kind == 4:
            return self.comments()
        if kind == 5:
            return f"<aside>{self.one(self.several(), self.links())}</aside>"
        if kind == 6:
            names = "share social tags meta byline author-box pagination toolbar"
            return self.boxed("div ul p", names, self.one(self.links(), self.words(1, 6, "")))
        return self.menu()

    def footer(self) -> str:
        text = self.one(
            f"&copy; {self.words(1, 4, '')} &middot; {self.words(2, 14)}",
            f"Copyright {self.words(2, 8)}",
            self.words(3, 25),
            f'<a href="/p">{self.words(1, 3, "")}</a> {self.words(2, 6)}',
        )
        text = self.one(text, f"<p>{text}</p>", f"<div>{text}</div>")
        return self.one(
            f"<footer>{text}</footer>",
            f"<footer>{text}</footer>",
            f'<div class="footer">{text}</div>',
            f'<div id="footer">{self.menu()}{text}</div>',
            f'<div class="site-footer legal">{text}</div>',
        )

    def article(self) -> str:
        title = self.words(2, 12, self.one("", ".", ""))
        heading = self.one("<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", '<h1 class="title">{}</h1>')
        body = [heading.format(self.main(title))]
        if self.random.random() < 0.3:
            body.append(f"<p><b>{self.main(title)}<br>")
        for _ in range(self.random.randint(1, 12)):
            kind = self.random.random()
            low, high = self.one("1 4", "5 40", "20 120", "40 200").split()
            text = self.main(self.words(int(low), int(high), self.one(".", ".", ".", "", "!", ":", " |", "***")))
            if kind < 0.68:
                if self.random.random() < 0.25:
                    text += f' <a href="/x">{self.words(1, 4, "")}</a> {self.words(3, 20)}'
                body.append(self.one("<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p><b>{}<br>").format(text))
            elif kind < 0.76:
                body.append(f"<h2>{self.main(self.words(1, 7, ''))}</h2>")
            elif kind < 0.83:
                item = lambda: f"<li>{self.main(self.words(1, 25, self.one('', '.')))}</li>"
                items = "".join(item() for _ in range(self.random.randint(1, 5)))
                body.append(self.one("<ul>{}</ul>", "<ol>{}</ol>").format(items))
            elif kind < 0.88:
                body.append(self.one("<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>").format(text))
            elif kind < 0.9:
                cell = lambda: f"<td>{self.main(self.words(1, 4, ''))}</td>"
                rows = "".join(f"<tr>{cell()}{cell()}</tr>" for _ in range(self.random.randint(1, 4)))
                body.append(f"<table>{rows}</table>")
            elif kind < 0.91:
                body.append(f"<figure><img><figcaption>{self.main(self.words(3, 20))}</figcaption></figure>")
            else:
                body.append(self.aside())
        inner = "\n".join(body)
        kind = self.random.random()
        if kind < 0.4:
            return f"<article>{inner}</article>"
        if kind < 0.5:
            return f"<main>{inner}</main>"
        if kind < 0.6:
            return f'<main id="main"><article class="post">{inner}</article></main>'
        if kind < 0.9:
            names = "content article post entry-content main article-body story post-content text body"
            return self.boxed("div div section", names, inner)
        return inner

    def build(self) -> str:
        few = lambda low, high: "".join(self.aside() for _ in range(self.random.randint(low, high)))
        head = f"<html><head><title>{self.words(2, 8, '')}</title><style>p{{}}</style><script>var a=1;</script></head><body>"
        header = self.one(
            "",
            "",
            f"<header><h1>{self.words(1, 3, '')}</h1>{self.menu()}</header>",
            f"<header>{self.words(1, 6, '')}</header>",
            f'<div class="header">{self.words(1, 5, "")}</div>',
        )
        top = header + self.one("", self.menu(), self.menu())
        middle = few(0, 2) + self.article() + few(0, 3)
        if self.random.random() < 0.3:
            middle = self.boxed("div", "wrapper container page wrap site layout", middle)
        return head + top + middle + self.one(self.footer(), self.footer(), self.footer(), "") + "</body></html>"


def labelled_pages(count: int, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Pages laid out by the templates, as blocks with their labels."""
    out = []
    for i in range(count):
        chain = blocks(_Page(random.Random(seed * 1_000_003 + i)).build())
        labels = [int("\x02" in b.text) for b in chain]
        for b in chain:
            b.text = " ".join(b.text.replace("\x02", " ").split())
        kept = [(b, y) for b, y in zip(chain, labels) if b.text]
        out.append(([b for b, _ in kept], [y for _, y in kept]))
    return out


@lru_cache(maxsize=4)
def trained(pages: int = 1000) -> Field:
    """The field fitted on that many labelled pages."""
    return fit(labelled_pages(pages))


def main_text(page: str, model: Field) -> str:
    """The blocks of the article, one a line; white space inside a block is one space."""
    chain = blocks(page)
    return "\n".join(b.text for b, s in zip(chain, model.decode(chain)) if s)


def extracted(
    pages: DataFrame, model: Field, html_col: str = "html", out: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``pages`` (the columns ``keep``, or all) with the main text of every page in the column ``out``.

    Null html is empty; a page without an article has an empty text. All rows stay, repeated ones
    too; a column that is named ``out`` already is replaced. Pages are worked on whole.
    """
    names = [c for c in (pages.columns if keep is None else keep) if c != out]
    weights, start, step = model.weights, np.array(model.start), np.array(model.step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(weights, start, step)
        for batch in batches:
            texts = pa.array([main_text(t.as_py(), field) for t in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*names, out])

    # The html goes in last, under a name of its own.
    given = pages.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(html_col), F.lit("")).alias("_page"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*[F.col(f"`{c}`") for c in names]).schema)
    return given.mapInArrow(run, f"{schema}, `{out}` string" if schema else f"`{out}` string")
