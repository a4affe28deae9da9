"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks: stretches of text between tags that start or end a block. Each block has features
of its ancestors (tags, words of class, id and role) and of its text (length, links, sentence ends, wording, place).
The field has two labels, main text or not, with weights for features and for label pairs of neighbours. It is
trained by gradient steps on the exact log-likelihood (forward and backward sums) over a bounded sample of pages
of the corpus whose mark-up names the article, and over the hand-labelled pages of ``LABELLED``; copies of both
without the telling tags teach it to rely on text and neighbours too. Viterbi decodes.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplepanel.llm.common import chunks

DIMS = 1 << 13
SAMPLE, STEPS, RATE, RIDGE = 300, 150, 0.1, 1e-3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:script|style|template|noscript|svg|iframe|object|textarea|title)\b(?:[^>]*(?:[\s\"']|\s[^\s=>\"'/]+))?/>"
    r"|<(?P<raw>script|style|template|noscript|svg|iframe|object|textarea|title)\b[^>]*+>.*?(?P<shut></(?P=raw)\s*>|\Z)"
    r"|<!(?:[^>]*+)>|<\?[^>]*+>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)",
    re.S | re.I)
_NAMES = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS = re.compile(r"[a-z]+")
# Tags that start and end a block, tags without content, and tags that a sibling's start closes.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a", "button", "label"))
#: As many open elements of a tag as a path keeps: depths beyond it are one.
DEEP = 4
#: What may start inside a head; anything else, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes".split())
CLOSED_BY = {"p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
             "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")),
             "option": frozenset(("option", "optgroup"))}
CONTAINERS = frozenset("article aside body div footer form header main nav section table td th ul ol dl blockquote".split())


@dataclass
class Block:
    text: str
    linked: int
    tags: tuple[str, ...]
    names: frozenset[str]


class _Open:
    """The open elements, with what a block needs to know of them: no step looks through all of them.

    A path keeps the last DEEP of each tag, which is all that features tell apart.
    """

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.paths: list[tuple[str, ...]] = [()]
        self.names: list[frozenset[str]] = [frozenset()]
        self.at: dict[str, list[int]] = {}
        self.containers: list[int] = []

    def push(self, tag: str, names: frozenset[str]) -> None:
        path = self.paths[-1]
        if path.count(tag) >= DEEP:
            first = path.index(tag)
            path = path[:first] + path[first + 1 :]
        self.paths.append((*path, tag))
        self.names.append(self.names[-1] | names if names - self.names[-1] else self.names[-1])
        self.at.setdefault(tag, []).append(len(self.tags))
        if tag in CONTAINERS:
            self.containers.append(len(self.tags))
        self.tags.append(tag)

    def leave(self, place: int) -> None:
        """Close the element at a place and all within it."""
        while len(self.tags) > place:
            tag = self.tags.pop()
            self.at[tag].pop()
            if tag in CONTAINERS:
                self.containers.pop()
            self.paths.pop()
            self.names.pop()

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    @property
    def container(self) -> int:
        return self.containers[-1] if self.containers else 0


def _tokens(page: str) -> Iterator[tuple[str, re.Match | None]]:
    """Text before each tag, comment or raw element, and that token; at the end the rest of the text and None.

    Behind the last ``>`` only a comment can begin, so that no search for the end of a tag runs through the page in vain.
    """
    stop, at, swallowed = page.rfind(">") + 1, 0, False
    for m in _TOKEN.finditer(page, 0, stop):
        yield page[at : m.start()], m
        at = m.end()
        if at == stop:
            comment = m[0].startswith("<!--") and (len(m[0]) < 7 or not m[0].endswith("-->"))
            swallowed = comment or (bool(m["raw"]) and not m["shut"])
    rest = "" if swallowed else page[at:]
    opened = rest.find("<!--", stop - at)
    yield rest if opened < 0 else rest[:opened], None


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with visible text in page order; scripts, styles, comments, buttons and the head have none.

    Takes time in proportion to the page, whatever is left open in it.
    """
    found: list[Block] = []
    stack = _Open()
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and stack.last("head") < 0:
                found.append(Block(text, linked, stack.paths[-1], stack.names[-1]))
            parts.clear()
        linked = 0

    def leave_head() -> None:
        if stack.last("head") >= 0:
            stack.leave(stack.at["head"][0])

    for piece, m in _tokens(page):
        if piece:
            if not piece.isspace():
                leave_head()
            if stack.last("button") < 0:
                parts.append(piece)
                if stack.last(*INLINE) >= 0:
                    linked += len(piece.strip())
        tag = (m["tag"] or "").lower() if m else ""
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            close()
        if not m["end"] and tag not in IN_HEAD:
            leave_head()
        if m["end"]:
            place = stack.last(tag)
            if place >= 0 and (tag in CONTAINERS or place >= stack.container):
                stack.leave(place)
        elif tag in BLOCKS or tag in INLINE:
            while stack.tags and stack.tags[-1] in INLINE and tag in BLOCKS:
                stack.leave(len(stack.tags) - 1)
            place = stack.last(*(t for t, by in CLOSED_BY.items() if tag in by))
            if place >= 0 and place >= stack.container:
                stack.leave(place)
            if tag not in EMPTY:
                words = _WORDS.findall(" ".join(v for _, v in _NAMES.findall(m["rest"])).lower())
                stack.push(tag, frozenset(words))
    close()
    return found


_SIGNS = {
    "copyright": re.compile(r"©|\(c\)\s*\d{4}|copyright|all rights reserved", re.I),
    "cookies": re.compile(r"cookie|consent|privacy|gdpr", re.I),
    "asks": re.compile(r"subscribe|newsletter|sign up|log ?in|register|share|follow us|click here|read more|advert|sponsor", re.I),
    "reader": re.compile(r"\breply\b|\bcomments?\b|posted by|\bsays:", re.I),
}


#: Longer blocks are told by their form, not by such wording.
WORDED = 400
_STOPS = re.compile(r"[.!?](?:\s|$)")


@lru_cache(maxsize=100_000)
def _slot(said: str) -> int:
    return zlib.crc32(said.encode()) % DIMS


@lru_cache(maxsize=20_000)
def _place_slots(tags: tuple[str, ...], names: frozenset[str], hide: frozenset[str]) -> tuple[int, ...]:
    tags = tuple(t for t in tags if t not in hide)
    said = {f"anc:{t}" for t in tags} | {f"par:{tags[-1] if tags else '-'}", f"deep:{min(len(tags), 4)}"}
    if not hide:
        said |= {f"name:{n}" for n in names}
    return tuple(sorted(map(_slot, said)))


def block_features(blocks: list[Block], hide: frozenset[str] = frozenset()) -> list[list[int]]:
    """Hashed features of each block; ``hide`` leaves out those of the given tags and all names of elements."""
    out = []
    for i, b in enumerate(blocks):
        size, words = len(b.text), b.text.count(" ") + 1
        said = [
            "bias", f"len:{min(size.bit_length(), 11)}", f"words:{min(words, 4)}", f"link:{int(min(b.linked / size, 1) * 3.99)}",
            f"end:{b.text[-1] in '.!?…»”'}", f"stops:{min(len(_STOPS.findall(b.text)), 4)}",
            f"commas:{min(b.text.count(','), 3)}", f"first:{b.text[0].isupper()}", f"place:{int(8 * i / len(blocks))}",
            f"edge:{i == 0}:{i == len(blocks) - 1}"]
        if size <= WORDED:
            said += [f"sign:{k}" for k, p in _SIGNS.items() if p.search(b.text)]
        out.append([*map(_slot, said), *_place_slots(b.tags, b.names, hide)])
    return out


@dataclass(frozen=True)
class Field:
    """Weights of features for main text (the other label has none), of label pairs, and of first and last labels."""

    weights: np.ndarray
    pairs: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def decode(self, features: list[list[int]]) -> list[bool]:
        """The most probable labels of a page's blocks; equal paths prefer main text."""
        if not features:
            return []
        gain = [float(self.weights[f].sum()) for f in features]
        (p00, p01), (p10, p11) = self.pairs.tolist()
        off, on = float(self.first[0]), float(self.first[1]) + gain[0]
        back = []
        for g in gain[1:]:
            from_on = (on + p10 >= off + p00, on + p11 >= off + p01)
            back.append(from_on)
            off, on = max(on + p10, off + p00), max(on + p11, off + p01) + g
        label = on + float(self.last[1]) >= off + float(self.last[0])
        labels = [label]
        for from_on in reversed(back):
            label = from_on[label]
            labels.append(label)
        return labels[::-1]


def fit_field(pages: list[tuple[list[list[int]], list[int]]], steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> Field:
    """Adam steps on the mean log-likelihood of labelled pages, all pages at once, padded to the longest."""
    pages = [p for p in pages if p[0]]
    weights, pairs, ends = np.zeros(DIMS), np.zeros((2, 2)), np.zeros((2, 2))
    if not pages:
        return Field(weights, pairs, ends[0], ends[1])
    n, size = len(pages), max(len(f) for f, _ in pages)
    there = np.zeros((n, size), bool)
    truth = np.zeros((n, size), int)
    row, feature = [], []
    for k, (features, labels) in enumerate(pages):
        there[k, : len(labels)], truth[k, : len(labels)] = True, labels
        for i, f in enumerate(features):
            row += [k * size + i] * len(f)
            feature += f
    row, feature = np.array(row), np.array(feature)
    ending = there.sum(axis=1) - 1
    every, total = np.arange(n), there.sum()
    seen_w = np.bincount(feature, truth.ravel()[row], DIMS)
    both = there[:, 1:]
    seen_p = np.zeros((2, 2))
    np.add.at(seen_p, (truth[:, :-1][both], truth[:, 1:][both]), 1)
    seen_e = np.stack([np.bincount(truth[:, 0], minlength=2), np.bincount(truth[every, ending], minlength=2)]).astype(float)
    values, moments = [weights, pairs, ends], [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, pairs, ends)]
    for step in range(1, steps + 1):
        gain = np.zeros((n, size, 2))
        gain[..., 1] = np.bincount(row, weights[feature], n * size).reshape(n, size)
        ahead, behind = np.zeros((n, size, 2)), np.zeros((n, size, 2))
        ahead[:, 0] = gain[:, 0] + ends[0]
        for i in range(1, size):
            ahead[:, i] = np.logaddexp.reduce(ahead[:, i - 1, :, None] + pairs, axis=1) + gain[:, i]
        behind[every, ending] = ends[1]
        for i in range(size - 2, -1, -1):
            inner = np.logaddexp.reduce(pairs + (gain[:, i + 1] + behind[:, i + 1])[:, None, :], axis=2)
            behind[:, i] = np.where((i < ending)[:, None], inner, behind[:, i])
        whole = np.logaddexp.reduce(ahead[every, ending] + ends[1], axis=1)
        p = np.exp(ahead + behind - whole[:, None, None]) * there[..., None]
        joint = np.exp(ahead[:, :-1, :, None] + pairs + (gain + behind)[:, 1:, None, :] - whole[:, None, None, None]) * both[..., None, None]
        grads = (
            (seen_w - np.bincount(feature, p[..., 1].ravel()[row], DIMS)) / total - ridge * weights,
            (seen_p - joint.sum(axis=(0, 1))) / total - ridge * pairs,
            (seen_e - np.stack([p[:, 0].sum(axis=0), p[every, ending].sum(axis=0)])) / total - ridge * ends)
        for x, g, m in zip(values, grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return Field(weights, pairs, ends[0], ends[1])


#: Hand-labelled pages. ``T`` is a sentence of some main text, ``S`` a stretch of other parts; blocks within <m> are main text.
LABELLED = (
    "<body><div class='cookie-banner notice'><p>We use cookies. S</p></div><header><div class='logo'>S</div><nav><ul><li><a>S</a><li><a>S</a></ul></nav></header>"
    "<div id='content'><m><h1>T</h1><p>T T T</p><p>T T</p><h2>T</h2><p>T T T T</p></m></div><aside class='sidebar'><h3>S</h3><ul><li><a>S</a><li><a>S</a></ul></aside>"
    "<footer><p>© 2020 S</p></footer></body>",
    "<body><div class='header'><a>S</a></div><div class='breadcrumb'><a>S</a> <a>S</a></div><main><m><h1>T</h1><p>T T</p></m><div class='advert ad'><p>S S</p></div><m><p>T T T</p>"
    "<ul><li>T<li>T</ul><blockquote><p>T T</p></blockquote></m></main><section class='comments' id='comments'><h2>Comments</h2><div class='comment'><p>T T</p></div>"
    "<div class='comment'><p>T</p><a>Reply</a></div></section><form><label>S</label><p>Subscribe to our newsletter</p><button>S</button></form><div class='footer'><a>S</a></div></body>",
    "<body><nav><a>S</a><a>S</a></nav><article><header><m><h1>T</h1></m></header><div class='share social'><a>Share</a></div><m><p>T</p><p>T T T T T</p><table><tr><td>T<td>T</table></m>"
    "<div class='related promo'><h3>S</h3><a>S</a></div><m><p>T T</p></m><form class='newsletter'><p>S S</p></form></article><div class='reader-comments'><p>T T</p><p>T</p></div>"
    "<div class='banner sponsor'>S S</div><footer>S</footer></body>",
    "<body><div class='menu'><ul><li><a>S</a><li><a>S</a></ul></div><div class='sidebar widget'><p>T</p></div><div class='post entry'><m><h2>T</h2><p>T T T</p><p>T</p><pre>T</pre></m></div>"
    "<div class='pagination'><a>S</a></div><div id='comments'><p>T</p><p>T T</p></div><div class='popup modal'><p>S</p></div></body>",
    "<body><div><a>S</a> <a>S</a> <a>S</a></div><div><m><h1>T</h1><p>T T T</p><p>T T</p><p>T T T T</p></m></div><div>© S</div></body>",
    "<m>T T T</m>",
    "<body><p><m>T</p><p>T T</m></p></body>",
)
#: Those of them whose labels can be told without names of elements.
PLAIN = (4, 5, 6)
#: A private character that marks main text while a hand-labelled page is made.
MARK = "\ue000"
_STRUCTURE = frozenset("article main nav footer header aside form section menu".split())
_OTHER = frozenset("nav aside footer form".split())
_OTHER_NAMES = frozenset(
    "ad ads advert advertisement comment comments related share social sidebar promo newsletter cookie banner sponsor "
    "breadcrumb pagination popup".split())


def marked_labels(blocks: list[Block]) -> list[int] | None:
    """Labels from mark-up that names the article; None where a page's mark-up does not."""
    inside = [("article" in b.tags or "main" in b.tags or "articlebody" in b.names) for b in blocks]
    if not any(inside) or all(inside):
        return None
    return [int(a and not (_OTHER & set(b.tags)) and not (_OTHER_NAMES & b.names)) for a, b in zip(inside, blocks, strict=True)]


def hand_labelled(sentences: list[str], others: list[str]) -> list[tuple[list[Block], list[int]]]:
    """The pages of ``LABELLED`` with sentences of the corpus put in; main blocks are those within <m>."""
    made = []
    for k, page in enumerate(LABELLED):
        main = re.compile(r"<m>|</m>|T|S(?=[\s<.]|$)")
        state = {"on": False, "t": k, "s": k}

        def put(m: re.Match, state: dict = state) -> str:
            if m[0] in ("<m>", "</m>"):
                state["on"] = m[0] == "<m>"
                return ""
            if m[0] == "T":
                state["t"] += 1
                return (MARK if state["on"] else "") + sentences[state["t"] % len(sentences)]
            if m[0] == "S":
                state["s"] += 1
                return others[state["s"] % len(others)]
            return m[0]

        blocks = leaf_blocks(main.sub(put, page))
        labels = [int(MARK in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(MARK, "")
        made.append((blocks, labels))
    return made


def training_pages(sample: list[str]) -> list[tuple[list[list[int]], list[int]]]:
    """Labelled sample pages, hand-labelled pages, and copies of both without telling tags."""
    known = []
    for page in sample:
        blocks = leaf_blocks(page)
        labels = marked_labels(blocks)
        if labels:
            known.append((blocks, labels))
    main = [b.text for blocks, labels in known for b, y in zip(blocks, labels, strict=True) if y and len(b.text) > 20]
    rest = [b.text for blocks, labels in known for b, y in zip(blocks, labels, strict=True) if not y]
    made = hand_labelled(main[:200] or ["A plain sentence, long enough to be read."], rest[:200] or ["Home"])
    pages = [(block_features(b), y) for b, y in known]
    pages += [(block_features(b, _STRUCTURE), y) for b, y in known[::2]]
    for _ in range(max(1, len(known) // 12)):
        pages += [(block_features(b), y) for b, y in made] + [(block_features(made[k][0], _STRUCTURE), made[k][1]) for k in PLAIN]
    return pages


def fit_pages(pages: DataFrame, sample: int = SAMPLE) -> Field:
    """Learn from at most ``sample`` pages, those with the smallest hash of the address and number."""
    ids = pages.select("page_id", F.xxhash64("page_id").alias("pick")).where(F.col("page_id").isNotNull()).distinct()
    picked = ids.orderBy("pick", "page_id").limit(sample)
    rows = pages.select("page_id", "html").where(F.col("html").isNotNull()).join(
        F.broadcast(picked), "page_id").orderBy("pick", "page_id", "html").limit(sample).collect()
    return fit_field(training_pages([r["html"] for r in rows]))


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    keep = field.decode(block_features(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page, from its whole html (null: empty).

    A page without blocks of main text has an empty text. Repeated rows and nulls in id or address keep a row
    each; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                found = [main_text(h.as_py(), shared.value) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(found, pa.string()),
                     pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")
