"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A block is the text between two block-level tags. Its features are the tags above it, the words of their class and id
attributes, and its own text; neighbouring blocks are tied by transition weights. The field is trained in numpy on a
bounded sample of pages that mark their article themselves (article or main elements, minus navigation, adverts, forms
and comments inside); each is seen twice, once as it is and once with these marks taken away or put around other
blocks, so that the other features carry weight too. Decoding is by Viterbi.

Defined results: null and empty pages have no text; script, style and other unseen content is never a block; pages are
read whole; without a page to learn from fixed weights of the same features take the field's place; equal rows give equal results; an empty
table gives an empty table; input columns that have the name of a new one are replaced.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from postlake.llm.arrow import batch_of, map_slices

#: Pages that the field is fitted to, at most, and the longest of them in bytes.
SAMPLE_PAGES, SAMPLE_PAGE_BYTES = 400, 200_000
EPOCHS, RATE, DECAY = 30, 0.2, 1e-4
_COMMENT, _DECLARED, _PLAIN = re.compile(r"<!--.*?(?:-->|\Z)", re.S), re.compile(r"<[!?][^>]*>"), re.compile(r"[^<]+|<")
#: A tag without < or > in its attributes, which is read up to the next of them only; and how any tag begins.
_SIMPLE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>\"']*(?:\"[^\"<>]*\"[^<>\"']*|'[^'<>]*'[^<>\"']*)*)>")
_OPENS, _STOP = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)"), re.compile(r"[>\"']")
_UNSEEN = {"script", "style", "noscript", "template", "textarea", "svg", "head", "title", "select", "option", "iframe", "object", "canvas", "math"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
_RAW_END = {t: re.compile(f"</{t}", re.I | re.A) for t in _RAW}
#: What may stand in a head; any other start tag, or text, ends one that is still open.
_HEAD = set("html head title base link meta style script noscript template basefont bgsound noframes".split())
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
#: Elements whose standing above a block is looked at; a page may make up any number of others.
_KNOWN = _ENDS_P | _UNSEEN | _HEAD | set("body button caption center col colgroup dd details dialog dir dt fieldset figcaption frame frameset hgroup input legend li menu optgroup summary tbody td tfoot th thead tr video audio picture search output progress meter slot applet article main".split()) - _INLINE
_LISTS = ("table", "ul", "ol", "dl")
_ATTRIBUTE = re.compile(r"(class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Words in names of what is no article, by what they tell.
_ASIDE = {
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner",
    "comment": "comment comments commentlist reply replies discussion disqus respond reader",
    "notice": "cookie cookies consent notice notices gdpr alert alerts popup modal overlay privacy subscribe newsletter signup paywall",
    "side": "sidebar side aside related recommended widget widgets trending popular share sharing social tags teaser",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toolbar skip pagination pager",
    "frame": "header masthead footer foot copyright legal imprint topbar login search form",
}
_ASIDE_OF = {w: kind for kind, words in _ASIDE.items() for w in words.split()}
_ASIDE_TAGS = {"nav": "menu", "menu": "menu", "header": "frame", "footer": "frame", "aside": "side", "form": "frame", "button": "frame", "dialog": "notice", "input": "frame"}
_MAIN_TAGS = {"article", "main"}
_MAIN_NAMES = {"article", "content", "main", "post", "entry", "story", "body", "text", "articlebody"}


#: Words in names that tell anything; others are not carried along.
_TELLING = _MAIN_NAMES | _ASIDE_OF.keys()


class Block(NamedTuple):
    text: str
    own: str                # tag of the innermost block-level element
    tags: frozenset[str]    # known block-level elements that it stands in
    names: frozenset[str]   # telling words in their names
    linked: float           # share of characters inside links


class _Open(NamedTuple):
    """An open element, with what it and all elements above it come to."""

    tag: str
    own_names: frozenset[str]
    own: str
    tags: frozenset[str]
    names: frozenset[str]
    unseen: int


_ROOT = _Open("", frozenset(), "none", frozenset(), frozenset(), 0)


class _Stack:
    """The open elements of a page. Every question is answered without going through them; sets are shared while they stay the same."""

    def __init__(self):
        self.items: list[_Open] = []
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.unseen_places: list[int] = []

    @property
    def top(self) -> _Open:
        return self.items[-1] if self.items else _ROOT

    def last(self, tag: str) -> int:
        """The place of the innermost open ``tag``, or -1."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def push(self, tag: str, names: frozenset[str]) -> None:
        above, inline = self.top, tag in _INLINE
        tags = above.tags if inline or tag not in _KNOWN or tag in above.tags else above.tags | {tag}
        every = above.names if names <= above.names else above.names | names
        self.places.setdefault(tag, []).append(len(self.items))
        if not inline:
            self.block_places.append(len(self.items))
        if tag in _UNSEEN:
            self.unseen_places.append(len(self.items))
        self.items.append(_Open(tag, names, above.own if inline else tag, tags, every, above.unseen + (tag in _UNSEEN)))

    def cut(self, depth: int) -> list[_Open]:
        """Close the element at ``depth`` and all inside it; returns them, outermost first."""
        gone = self.items[depth:]
        del self.items[depth:]
        for item in reversed(gone):
            self.places[item.tag].pop()
        for places in (self.block_places, self.unseen_places):
            while places and places[-1] >= depth:
                places.pop()
        return gone

    def again(self, items: list[_Open]) -> None:
        for item in items:
            self.push(item.tag, item.own_names)


class _Tags:
    """Tags whose attributes hold < or > in quotes, or that never end. All of them together take time in proportion to the page."""

    def __init__(self, page: str):
        self.stops = [m.start() for m in _STOP.finditer(page)]
        self.signs = [page[i] for i in self.stops]
        self.following, later = [-1] * len(self.stops), {}
        for k in range(len(self.stops) - 1, -1, -1):
            self.following[k] = later.get(self.signs[k], -1)
            later[self.signs[k]] = k
        self.failed: set[int] = set()

    def end(self, at: int) -> int:
        """Where a tag ends whose name ends at ``at``, or -1: at the next > that is not in quotes."""
        k, passed = bisect_left(self.stops, at), []
        while k < len(self.stops) and k not in self.failed:
            if self.signs[k] == ">":
                return self.stops[k] + 1
            passed.append(k)
            if self.following[k] < 0:
                break
            k = self.following[k] + 1
        self.failed.update(passed)
        return -1


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order, in time and memory in proportion to the page however it is nested."""
    stack, out, text = _Stack(), [], []
    linked = 0
    last_end, tags, endless = page.rfind(">"), None, set()

    def close() -> None:
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            top = stack.top
            out.append(Block(joined, top.own, top.tags, top.names, min(1.0, linked / len(joined))))
        text.clear()
        linked = 0

    at = 0
    while at < len(page):
        ends, tag, attributes, whole = False, "", "", None
        if page[at] == "<":
            if page.startswith(("<!", "<?"), at):
                m = _COMMENT.match(page, at) if page.startswith("<!--", at) else _DECLARED.match(page, at) if at < last_end else None
                whole = m[0] if m else None
            elif m := _SIMPLE.match(page, at):
                whole, ends, tag, attributes = m[0], bool(m[1]), m[2].lower(), m[3]
            elif at < last_end and (m := _OPENS.match(page, at)):
                tags = tags or _Tags(page)
                if (end := tags.end(m.end())) >= 0:
                    whole, ends, tag, attributes = page[at:end], bool(m[1]), m[2].lower(), page[m.end():end - 1]
        if whole is None:
            whole = _PLAIN.match(page, at)[0]
        at += len(whole)
        hidden = whole.startswith(("<!", "<?")) and len(whole) > 1
        if stack.top.unseen and not ends and (tag not in _HEAD if tag else not hidden and whole.strip()):
            heads = stack.places.get("head")
            if heads and stack.last("template") < heads[0]:
                close()
                stack.cut(heads[0])
        if not tag:
            if not hidden and not stack.top.unseen:
                text.append(whole)
                if stack.last("a") >= 0:
                    linked += len(whole.strip())
            continue
        if ends:
            depth = stack.last(tag)
            if tag not in _INLINE:
                close()
            # An inline end tag does not end the blocks inside it.
            if depth >= 0 and not (tag in _INLINE and stack.block_places and stack.block_places[-1] > depth):
                stack.cut(depth)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in _INLINE:
            close()
            shut = _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
            depth = max((stack.last(t) for t in shut), default=-1)
            if depth >= 0 and (tag == "p" or all(stack.last(t) <= depth for t in _LISTS)):
                stack.again([s for s in stack.cut(depth)[1:] if s.tag in _INLINE])
        if tag in _VOID or attributes.rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        if tag in _RAW:
            end = None if tag in endless else _RAW_END[tag].search(page, at)
            if not end and tag != "title":
                return out  # never closed: the rest is raw
            if not end:
                endless.add(tag)
            shut = page.find(">", end.start() if end else at)
            at = len(page) if shut < 0 else shut + 1
            continue
        names = frozenset(w.lower() for a in _ATTRIBUTE.finditer(attributes) for w in _NAME.findall(a[2])) if attributes else frozenset()
        stack.push(tag, names & _TELLING)
        if tag == "body" and stack.unseen_places:
            stack.again([s for s in stack.cut(stack.unseen_places[0]) if s.tag not in _UNSEEN])
    close()
    return out


def by_rule(block: Block) -> int:
    """1 for what a page itself marks as its article."""
    return int(not block.tags.isdisjoint(_MAIN_TAGS) and block.tags.isdisjoint(_ASIDE_TAGS) and block.names.isdisjoint(_ASIDE_OF))


def _bin(n: float) -> int:
    return int(np.log2(n + 1))


def features(page: list[Block], view: np.ndarray | None = None) -> list[list[str]]:
    """Names of the features that hold, per block. ``view``: 1 drops the marks of an article, 2 adds them and a paragraph's tag."""
    out = []
    for i, b in enumerate(page):
        marks = {t for t in b.tags if t in _MAIN_TAGS} | {"name:" + n for n in b.names if n in _MAIN_NAMES}
        if view is not None and view[i]:
            marks = {"article"} if view[i] == 2 else set()
        aside = {_ASIDE_TAGS[t] for t in b.tags if t in _ASIDE_TAGS} | {_ASIDE_OF[n] for n in b.names if n in _ASIDE_OF}
        own = b.own
        words = b.text.split()
        kinds, own_tag, above = set(aside), own, set(b.tags) - {"html", "body", "div"} - _MAIN_TAGS
        if view is not None:
            # Names and tags of what is no article stand for each other here, so that those never seen count as well.
            kinds, own_tag, above = set(), "p" if view[i] == 2 else "none" if own in _ASIDE_TAGS else own, above - set(_ASIDE_TAGS)
        end = b.text[-1] in ".!?…»”\"'"
        long = _bin(len(words))
        got = ["one", f"own:{own_tag}", f"words:{long}", f"link:{int(b.linked * 4)}", f"end:{end}", f"own:{own_tag}&words:{long > 2}&end:{end}"]
        got += [f"mark:{m}" for m in marks] + [f"aside:{a}" for a in kinds] + [f"above:{t}" for t in above]
        got += ["marked"] * bool(marks) + ["aside"] * bool(aside) + ["marked&aside"] * bool(marks and aside) + ["marked&plain"] * bool(marks and not aside)
        got += ["sign"] * ("©" in b.text or "cookie" in b.text.lower())
        out.append(got)
    return out


class Field(NamedTuple):
    """Weights for label 1 against label 0 of each feature, and of each pair of neighbouring labels."""

    weights: dict[str, float]
    change: np.ndarray


#: For tables without a page to learn from: names, tags, share of links, length and sentence ends, set by hand.
DEFAULT = Field(
    {
        "one": -1.5, "marked": 1.0, "marked&plain": 1.5, "aside": -4.0, "marked&aside": -1.0, "sign": -2.0,
        "link:0": 0.5, "link:1": 0.0, "link:2": -1.5, "link:3": -2.5, "link:4": -3.0, "end:True": 0.6, "end:False": -0.4,
        **{f"words:{n}": min(-1.5 + 0.7 * n, 2.5) for n in range(40)}, **{f"own:{t}": 1.0 for t in ("p", "h1", "h2", "h3", "blockquote", "pre")},
        "own:h1": 1.5, "own:p&words:True&end:True": 0.8,
    },
    np.array([[0.6, -0.6], [-0.6, 0.6]]),
)


def _forward(unary: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each label and expected pairs of labels of one page."""
    n = len(unary)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = unary[0]
    for i in range(1, n):
        ahead[i] = unary[i] + np.logaddexp.reduce(ahead[i - 1][:, None] + change, axis=0)
    for i in range(n - 2, -1, -1):
        back[i] = np.logaddexp.reduce(change + unary[i + 1] + back[i + 1], axis=1)
    total = np.logaddexp.reduce(ahead[-1])
    pairs = np.zeros((2, 2))
    if n > 1:
        pairs = np.exp(ahead[:-1, :, None] + change[None] + (unary[1:] + back[1:])[:, None, :] - total).sum(0)
    return np.exp(ahead + back - total), pairs


def train(pages: list[list[Block]]) -> Field | None:
    """Fit the field by stochastic gradient steps (AdaGrad), page by page, in a fixed order."""
    rng = np.random.default_rng(5)
    number: dict[str, int] = {}
    seen = []
    for page in pages:
        y = np.array([by_rule(b) for b in page], np.int64)
        if not len(y) or not 0 < y.sum():
            continue
        for view in (None, np.where(y == 1, 1, np.where(rng.random(len(y)) < 0.5, 2, 0)), np.where(rng.random(len(y)) < 0.5, 2 * (1 - y), 0)):
            found = features(page, view)
            columns = np.array([number.setdefault(f, len(number)) for fs in found for f in fs])
            seen.append((columns, np.repeat(np.arange(len(found)), [len(f) for f in found]), y))
    if not seen:
        return None
    w, g = np.zeros(len(number)), np.full(len(number), 1e-2)
    change, gc = np.zeros((2, 2)), np.full((2, 2), 1e-2)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(seen)):
            columns, rows, y = seen[k]
            s = np.bincount(rows, w[columns], len(y))
            marginal, pairs = _forward(np.stack([np.zeros(len(y)), s], 1), change)
            grad = np.bincount(columns, (marginal[:, 1] - y)[rows], len(number)) / len(y) + DECAY * w
            g += grad * grad
            w -= RATE * grad / np.sqrt(g)
            real = np.zeros((2, 2))
            np.add.at(real, (y[:-1], y[1:]), 1)
            grad = (pairs - real) / len(y) + DECAY * change
            gc += grad * grad
            change = change - RATE * grad / np.sqrt(gc)
    return Field({f: float(w[i]) for f, i in number.items()}, change)


def decode(field: Field | None, page: list[Block]) -> list[int]:
    """The likeliest labels (Viterbi)."""
    if not page:
        return []
    field = field or DEFAULT
    unary = [sum(field.weights.get(f, 0.0) for f in fs) for fs in features(page)]
    (a, b), (c, d) = field.change.tolist()
    zero, one, back = 0.0, unary[0], []
    for u in unary[1:]:
        from_zero, from_one = (zero + a, one + c), (zero + b, one + d)
        back.append((int(from_zero[1] > from_zero[0]), int(from_one[1] > from_one[0])))
        zero, one = max(from_zero), max(from_one) + u
    labels = [int(one > zero)]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def main_text(field: Field | None, page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, y in zip(found, decode(field, found), strict=True) if y)


def fit(pages: DataFrame, key: str = "page_id", content: str = "html") -> Field | None:
    """A field from at most ``SAMPLE_PAGES`` pages that mark their article, chosen by a hash of their key."""
    marked = pages.filter(F.col(content).rlike("(?i)<(article|main)\\b") & (F.octet_length(content) <= SAMPLE_PAGE_BYTES))
    sample = marked.select(content, F.xxhash64(F.col(key).cast("string"), content).alias("_order")).orderBy("_order", content).limit(SAMPLE_PAGES)
    return train([blocks(p) for p in sample.toArrow().column(content).to_pylist()])


def extract(pages: DataFrame, key: str = "page_id", content: str = "html") -> DataFrame:
    """All columns of ``pages`` but the content, with text and n_chars."""
    field = pages.sparkSession.sparkContext.broadcast(fit(pages, key, content))
    kept = [c for c in pages.columns if c not in (content, "text", "n_chars")]
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make():
        def step(part: pa.RecordBatch):
            texts = [main_text(field.value, p) for p in part.column(content).to_pylist()]
            yield batch_of(schema, {c: part.column(c) for c in kept} | {"text": pa.array(texts, pa.large_string()), "n_chars": [len(t) for t in texts]})

        return step

    return map_slices(pages.select(*kept, content), content, schema, make)
