"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Words score positive, tags negative, and a linear
scan finds the contiguous region of the largest sum; its words are the text, but for those
of containers that hold no content, which score zero wherever they stand. All weights come
from labelled pages, which labelled_pages() makes up, pages of several designs whose parts
are known: a tag costs what it tells of a border between content and the rest; a word
counts for what its surroundings tell; and whether a container holds content is a logistic
regression on its tag, the words of its class and id, where it stands, and its text (how
much, how much of it in links or paragraphs, with headings, articles or form controls).
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import rows, with_columns

# Groups of HTML's elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes xmp textarea title".split())
UNSEEN = frozenset("head template object svg math canvas audio video select datalist button dialog".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre li dd dt td th figcaption".split())
CONTROLS = frozenset("input button select textarea label option".split())
UNJUDGED = HEADINGS | frozenset("html body article main p li dt dd td th tr tbody thead tfoot caption figcaption blockquote pre option".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, "") and ("open" or "close", tag, attributes) in page order; comments and raw elements' content are left out.

    An unfinished tag, comment or raw element (script and the like, whose content is no
    markup) takes the rest of the page, as browsers have it.
    """
    at, size, start = 0, len(page), 0
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            break
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            if lt > start:
                yield "text", page[start:lt], ""
            end = page.find("-->", lt + 4) if page.startswith("<!--", lt) else page.find(">", lt)
            if end < 0:
                return
            at = start = end + (3 if page.startswith("<!--", lt) else 1)
        elif after.isalpha() and after.isascii() or after == "/" and page[lt + 2 : lt + 3].isalpha():
            if lt > start:
                yield "text", page[start:lt], ""
            found = TAG.match(page, lt)
            if not found:
                return
            name = found[2].lower()
            at = start = found.end()
            yield ("close" if found[1] else "open"), name, found[3]
            if not found[1] and name in RAW and not found[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if not end:
                    return
                at = start = end.end()
                yield "close", name, ""
        elif after == "" and lt == size - 1 or after == "/" and lt >= size - 2:
            if lt > start:
                yield "text", page[start:lt], ""
            return
        else:
            at = lt + 1
    if start < size:
        yield "text", page[start:], ""


@lru_cache(maxsize=20_000)
def hints(tag: str, attributes: str) -> tuple[str, ...]:
    """What a start tag says of its content: its name, role, and the words of its class and id."""
    out = [f"tag:{tag}"]
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "role" and value.lower() in ROLES:
                out.append(f"role:{value.lower()}")
            elif name in ("class", "id"):
                out += [f"in:{x.lower()}" for x in NAME_PART.findall(value)]
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                out.append("hidden")
    return tuple(dict.fromkeys(out))


class Node:
    """An open container: what holds it, its tag and hints, what its text is like, and whether it holds content."""

    __slots__ = ("holder", "tag", "hint", "inside", "ended", "words", "linked", "prose", "controls", "heads", "articles", "other", "weight", "truth")

    def __init__(self, holder: Node | None, tag: str, hint: tuple[str, ...]):
        self.holder, self.tag, self.hint = holder, tag, hint
        self.inside = holder is not None and (holder.inside or holder.tag in ("article", "main"))
        self.ended = False  # by an end tag of its own
        self.words = self.linked = self.prose = self.controls = self.heads = self.articles = 0
        self.other, self.weight, self.truth = False, 0.0, [0, 0]


@dataclass
class Token:
    kind: str  # text, open, close
    value: str
    words: int
    node: Node | None  # the innermost open container


def tokens(page: str) -> tuple[list[Token], list[Node]]:
    """Words and tags, each with the container around it, and all containers in page order, with counts of what they hold.

    End tags without a start are ignored; a paragraph ends where a block starts. The work
    is linear in the page: a container's counts are added to its holder's once.
    """
    out: list[Token] = []
    nodes: list[Node] = []
    stack: list[Node] = []
    solid: list[int] = []  # places in the stack of what is not inline
    opened: Counter[str] = Counter()

    def shut(at: int) -> None:
        for node in stack[at:]:
            opened[node.tag] -= 1
        del stack[at:]
        while solid and solid[-1] >= at:
            solid.pop()

    for kind, value, attributes in pieces(page):
        node = stack[-1] if stack else None
        if kind == "text":
            text = entities.unescape(value)
            n = len(text.split())
            out.append(Token(kind, text, n, node))
            if node:
                node.words += n
                node.linked += n if opened["a"] else 0
                node.prose += n if solid and stack[solid[-1]].tag in PROSE else 0
            continue
        if kind == "open":
            if value in CLOSES_P and solid and stack[solid[-1]].tag == "p":
                shut(solid[-1])
                node = stack[-1] if stack else None
            if node:
                node.controls += value in CONTROLS and value in VOID
                node.heads += value in HEADINGS
                node.articles += value in ("article", "main")
            if value not in VOID and not attributes.endswith("/"):
                stack.append(Node(node, value, hints(value, attributes)))
                nodes.append(stack[-1])
                opened[value] += 1
                if value not in INLINE:
                    solid.append(len(stack) - 1)
        elif opened[value]:
            at = len(stack) - 1
            while stack[at].tag != value:
                at -= 1
            stack[at].ended = True
            if stack[at].holder:
                stack[at].holder.controls += value in CONTROLS
            shut(at)
        out.append(Token(kind, value, 0, stack[-1] if stack else None))
    for node in reversed(nodes):
        up = node.holder
        if up:
            up.words, up.linked, up.prose = up.words + node.words, up.linked + node.linked, up.prose + node.prose
            up.controls, up.heads, up.articles = up.controls + node.controls, up.heads + node.heads, up.articles + node.articles
    return out, nodes


def judged(node: Node, total: int) -> bool:
    """Whether a container may be told to hold no content.

    One that holds an article, and a nameless one of most of the page's words (total), are judged by their parts.
    """
    if node.tag in ("div", "section", "form", "center") and 2 * node.words > total and not any(h.startswith("in:") for h in node.hint):
        return False
    if node.tag in UNSEEN and not node.ended:
        return False
    if node.tag in INLINE:
        return any(h.startswith("in:") for h in node.hint)
    return node.tag not in UNJUDGED and not node.articles


def traits(node: Node) -> dict[str, float]:
    """Features of a container."""
    n = max(1, node.words)
    out = {
        "one": 1.0,
        "words": min(math.log1p(node.words), 6.0),
        "links": node.linked / n,
        "prose": (node.prose - min(node.prose, node.linked)) / n,
        "much prose": min(math.log1p(node.prose), 6.0) if node.prose > 2 * node.linked else 0.0,
        "controls": min(3.0, math.log1p(20 * node.controls / (n + 5))),
        "heads": float(node.heads > 0),
        "inside": float(node.inside),
        "links inside": node.linked / n * node.inside,
    }
    for h in node.hint:
        out[f"{h} inside" if h == "tag:header" and node.inside else h] = 1.0
    return out


def labelled_pages(n: int = 320, seed: int = 11) -> list[list[tuple[str, bool]]]:
    """Made-up pages of several designs as (markup, whether its text is content)."""
    rng = random.Random(seed)
    # Names under which sites keep what is not content, and what is.
    other = {
        "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar pagination pager",
        "header": "header masthead topbar branding logo",
        "footer": "footer copyright colophon legal",
        "aside": "sidebar aside related recommended widget widgets share social sharing popular trending rail",
        "notice": "cookie cookies consent gdpr notice banner alert popup modal overlay newsletter subscribe subscription signup paywall",
        "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion",
        "form": "form search searchbox login contact",
        "comments": "comment comments commentlist reply replies respond discussion disqus",
    }
    other = {k: v.split() for k, v in other.items()}
    content = "content article post entry story body text main".split()
    both = "section block row col box inner wrapper container module item page site has".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def mark(*names: str) -> str:
        return f" {rng.choice(('class', 'id'))}='{rng.choice('-_ ').join(names)}'"

    def paragraph() -> str:
        inner = words(1, 60)
        if rng.random() < 0.3:
            inner = f"<b>{words(1, 8)}</b> {inner}"
        if rng.random() < 0.2:
            inner += f" <a href='#'>{words(1, 4)}</a>"
        kind = rng.random()
        if kind < 0.6:
            return f"<p>{inner}</p>"
        if kind < 0.7:
            return f"<{(t := rng.choice(('section', 'div', 'div')))}>{rng.choice(('', f'<h3>{words(1, 4)}</h3>'))}<p>{inner}</p></{t}>"
        if kind < 0.8:
            return f"<{(t := rng.choice(('h1', 'h2', 'h2', 'h3', 'h4')))}>{words(1, 6)}</{t}>"
        if kind < 0.86:
            shape = rng.choice(("{}", "{}", "<a href='#'>{}</a>"))
            return "<ul>" + "".join(f"<li>{shape.format(words(1, 12))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote>{inner}</blockquote>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if kind < 0.97:
            return f"<{(t := rng.choice(('div', 'section', 'figure', 'dl', 'details', 'center', 'span')))}>{words(1, 6)}</{t}>"
        return f"<div>{inner}</div>"

    def paragraphs(a: int, b: int) -> str:
        out = "".join(paragraph() for _ in range(rng.randint(a, b)))
        if rng.random() < 0.3:  # a part of its own, under a name that elsewhere may be of something else
            names = [rng.choice(both)] if rng.random() < 0.4 else [rng.choice(rng.choice([other[k] for k in ("aside", "header", "notice", "nav")])), words(1, 1)]
            out += f"<{(t := rng.choice(('div', 'section')))}{mark(*names)}>" + "".join(f"<p>{words(12, 50)}</p>" for _ in range(rng.randint(1, 5))) + f"</{t}>"
        return out

    def links(k: int) -> str:
        return "<ul>" + "".join(f"<li><a href='/{i}'>{words(1, 3)}</a></li>" for i in range(k)) + "</ul>"

    def part(kind: str) -> str:
        names = [rng.choice(other[kind])]
        if rng.random() < 0.3:
            names.insert(rng.randrange(2), rng.choice(both))
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        tag, own = (tag, "") if tag != "div" and rng.random() < 0.5 else (rng.choice(("div", "div", "div", "section")), mark(*names))
        inner = {"nav": links(rng.randint(1, 9)) if rng.random() < 0.6 else words(1, 12), "header": words(1, 5) + links(3), "footer": words(2, 15), "aside": f"<h3>{words(1, 3)}</h3>" * (rng.random() < 0.5) + links(4) + words(0, 20), "form": f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>"}
        prose = "".join(f"<p>{words(1, 40)}</p>" for _ in range(rng.randint(1, 4 if kind == "comments" else 2)))
        return f"<{tag}{own}>{inner.get(kind, prose if rng.random() < 0.6 else words(1, 20))}</{tag}>"

    out = []
    for _ in range(n):
        page = [(part(k), False) for k in ("header", "nav", "notice", "advert", "aside", "form") if rng.random() < 0.6]
        inner = [(f"<h1>{words(1, 12)}</h1>", True)]
        if rng.random() < 0.2:
            inner = [("<header>", True), *inner, (f"<p>{words(2, 20)}</p></header>", True)]
        inner.append((paragraphs(1, 12), True))
        if rng.random() < 0.4:
            inner += [(part(rng.choice(("advert", "aside", "notice"))), False), (paragraphs(1, 6), True)]
        kind = rng.random()
        if kind < 0.45:
            tag, own = rng.choice(("article", "main")), "" if rng.random() < 0.7 else mark(rng.choice(content + both))
        elif kind < 0.8:
            tag, own = rng.choice(("div", "section")), mark(rng.choice(content))
        else:
            tag, own = "div", "" if rng.random() < 0.5 else mark(rng.choice(both))
        page += [(f"<{tag}{own}>", True), *inner, (f"</{tag}>", True)]
        page += [(part(k), False) for k in ("comments", "aside", "advert", "footer") if rng.random() < 0.6]
        if rng.random() < 0.3:  # a page in a container
            tag = rng.choice(("form", "div", "div", "section"))
            page = [(f"<{tag}{mark(rng.choice(both)) if rng.random() < 0.5 else ''}>", False), *page, (f"</{tag}>", False)]
        out.append(page)
    return out


@dataclass(frozen=True)
class Weights:
    container: dict[str, float]  # of a container's traits
    tag: dict[str, float]  # of "open p" and the like: zero or less
    other_tag: float
    word: tuple[float, float, float]  # in an article, in a container of sure content, elsewhere

    def judge(self, nodes: list[Node]) -> None:
        """Mark the containers that hold no content, with all in them, and weigh the others' words."""
        total = sum(node.words for node in nodes if node.holder is None)
        for node in nodes:
            up = node.holder
            unseen = node.tag in UNSEEN and node.ended or any(h == "hidden" or h.startswith("role:") for h in node.hint)
            logit = 0.0
            if judged(node, total):
                logit = sum(self.container.get(k, 0.0) * v for k, v in traits(node).items())
            node.other = up is not None and up.other or unseen or logit < 0
            node.weight = max(logit, up.weight if up else 0.0)

    def of(self, token: Token) -> float:
        node = token.node
        if node is not None and node.other:
            return 0.0
        if token.kind != "text":
            return self.tag.get(f"{token.kind} {token.value}", self.other_tag)
        inside = node is not None and (node.inside or node.tag in ("article", "main"))
        return token.words * (self.word[0] if inside else self.word[1] if node is not None and node.weight > 1 else self.word[2])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 9) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def learned(pages: list[list[tuple[str, bool]]], scale: float = 4.0) -> Weights:
    """Weights from labelled pages."""
    found, labels = [], []
    borders, seen, words = Counter(), Counter(), np.ones((3, 2))
    for page in pages:
        whole, nodes = tokens("".join(markup for markup, _ in page))
        gold = [label for markup, label in page for _ in pieces(markup)]
        for t, label in zip(whole, gold, strict=True):
            node = t.node
            while t.kind == "text" and node is not None:
                node.truth[label] += t.words
                node = node.holder
        total = sum(node.words for node in nodes if node.holder is None)
        for node in nodes:
            if node.holder is not None and (node.holder.other or judged(node.holder, total) and node.holder.truth[1] == 0 < node.holder.truth[0]):
                node.other = True  # with its holder, whatever it is like
            elif sum(node.truth) and judged(node, total):
                found.append(traits(node))
                labels.append(node.truth[1] >= node.truth[0])
        between: list[str] = []
        last = False
        for t, label in zip(whole, gold, strict=True):
            if t.kind != "text":
                between.append(f"{t.kind} {t.value}")
            elif t.words:
                seen.update(between)
                if label != last:
                    borders.update(between)
                between, last = [], label
    often = Counter(k for f in found for k in f)
    names = sorted(k for k, n in often.items() if n >= 3)
    place = {k: i for i, k in enumerate(names)}
    x = np.zeros((len(found), len(names)))
    for i, f in enumerate(found):
        for k, v in f.items():
            if k in place:
                x[i, place[k]] = v
    container = dict(zip(names, logistic(x, np.array(labels, float)).tolist(), strict=True))
    tag = {k: scale * math.log1p(-(borders[k] + 0.01) / (n + 1)) for k, n in seen.items()}
    w = Weights(container, tag, scale * math.log1p(-sum(borders.values()) / sum(seen.values())), (1.0, 1.0, 1.0))
    for page in pages:  # words by their surroundings, where no container tells that they are something else
        whole, nodes = tokens("".join(markup for markup, _ in page))
        w.judge(nodes)
        gold = [label for markup, label in page for _ in pieces(markup)]
        for t, label in zip(whole, gold, strict=True):
            if t.kind == "text" and not (t.node and t.node.other):
                inside = t.node is not None and (t.node.inside or t.node.tag in ("article", "main"))
                words[0 if inside else 1 if t.node is not None and t.node.weight > 1 else 2, int(label)] += t.words
    odds = np.clip(np.log(words[:, 1] / words[:, 0]), 1.0, 4.0)
    return Weights(container, tag, w.other_tag, tuple(odds.tolist()))


@lru_cache(maxsize=1)
def weights() -> Weights:
    return learned(labelled_pages())


def region(scores: list[float]) -> tuple[int, int]:
    """Start and stop of the first contiguous run of the largest positive sum; equal at 0 if there is none."""
    best, at, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, at = run, (start, i + 1)
    return at


def blocks(page: str | None, w: Weights | None = None) -> list[str]:
    """The blocks of a page's main text."""
    if not page:
        return []
    w = w or weights()
    whole, nodes = tokens(page)
    w.judge(nodes)
    a, b = region([w.of(t) for t in whole])
    out, now = [], []
    for t in whole[a:b]:
        if t.kind == "text":
            if t.node is None or not t.node.other:
                now.append(t.value)
        elif t.value == "br":
            now.append(" ")
        elif t.value not in INLINE:
            out.append("".join(now))
            now = []
    out.append("".join(now))
    return [x for x in (SPACE.sub(" ", x).strip() for x in out) if x]


def main_text(page: str | None, w: Weights | None = None) -> str:
    return "\n\n".join(blocks(page, w))


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html and any other columns) with text and n_chars instead of html.

    A null or empty page, and one without content, has the empty text; an empty table gives
    no row. Very long pages are read whole, in time linear in their length. Elements left
    open end with what holds them, and only script-like ones take the rest of the page.
    Repeated rows are extracted each; existing text and n_chars columns are replaced.
    """
    pages = pages.drop("text", "n_chars")
    schema = pages.drop("html").schema
    kept, w = schema.names, weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, w) for (part,) in rows(iter([batch]), "html", step=64) for x in part]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            yield pa.record_batch([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.mapInArrow(run, with_columns(schema, "text string", "n_chars long"))
