"""Operator 5: main text of HTML pages by minimum-cut labelling of text blocks.

A page is cut into text blocks at block-level tags. A linear classifier over a block's text (size in code points and words,
punctuation, link share, cue words), its tags and what its ancestors' tags, roles, class and id words say gives log odds; its
weights are fitted by logistic regression on labelled pages (`html_model`). What an ancestor's names say counts for less the
more of the page's text lies inside, for an element that holds a page's main part is no side matter whatever it is called.
The log odds become the block's capacity to the content terminal (positive) or to the boilerplate terminal (negative).
Smoothness edges join neighbours in page order and blocks of one parent, weaker the farther apart they are in the DOM. The
minimum cut, found by max-flow, separates content from boilerplate. Blocks whose terminal capacity exceeds all their edges
are settled first, which leaves the cut as it is.

Elements nested deeper than `DEPTH` become siblings, as in browsers, so time grows with a page's length alone.

Defined cases: a null or empty page, or one without content, has the empty text; broken markup (tags left open, wrong
nesting, cut off pages, bare `<`) is read as browsers mostly do; `<br>` is white space inside a block; white space is
Unicode's; character references are decoded once; very long pages are read whole; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored unless `extra` names them.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import hold, small_batches

TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?(?=[\s/]|$)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mover mrow ms mspace msqrt msub msubsup msup mtext munder semantics q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg select object audio video canvas annotation annotation-xml".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd tr td th".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

# What tags, roles and words of class and id speak for; how much, the fit says.
TAGS = {"article": "root", "main": "root", "nav": "nav", "menu": "nav", "footer": "footer", "aside": "aside", "header": "header", "form": "form", "fieldset": "form", "dialog": "notice", "button": "control", "label": "control", "legend": "control", "option": "control"}
ROLES = {"main": "root", "article": "root", "navigation": "nav", "menu": "nav", "menubar": "nav", "tablist": "nav", "toolbar": "nav", "contentinfo": "footer", "banner": "header", "complementary": "aside", "search": "form", "form": "form", "dialog": "notice", "alertdialog": "notice", "alert": "notice"}
NAMES = {
    word: kind
    for kind, words in {
        "ad": "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promoted promotion outbrain taboola doubleclick",
        "nav": "nav navbar navigation navi menu menubar submenu breadcrumb breadcrumbs pagination pager sitemap toc skip share sharing social sharebar follow tags tagcloud tools toolbar print",
        "footer": "footer foot colophon copyright legal disclaimer imprint",
        "header": "header masthead topbar banner",
        "aside": "sidebar side sidenav rail widget widgets related recommended recommendations trending popular",
        "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login signin register paywall toast announcement",
        "comment": "comment comments commentlist disqus respond reply replies discussion responses thread threads",
        "box": "box callout teaser card",
        "form": "search searchbox form",
        "good": "article body content entry main post story text",
    }.items()
    for word in words.split()
}
#: Words of adverts, notices and controls.
CUES = re.compile(r"\b(?:buy|shop|sale|discount|offers?|deals?|sponsored|advertisement|order now|sign up|log ?in|subscribe|newsletter|cookies?|privacy|all rights reserved|copyright|share this|reply|click here|read more)\b|©|[$€£]\s?\d|\d\s?%", re.I)
KINDS = ("root", "nav", "footer", "aside", "header", "form", "notice", "control", "ad", "comment", "box", "good")
FEATURES = ("bias", "size", "sentence", "links", "links of short", "p", "heading", "li", "cell", "quote", "cues", "hidden", "outside root", "tag nav", "tag footer", "tag aside", "tag header", *KINDS)
#: Elements deeper than this become siblings.
DEPTH = 512
#: Share of a page's text beyond which what an element's names say starts to count for less, and from which on for nothing.
SHARE = (0.4, 0.6)
#: Most that a block's log odds say.
CLIP = 12.0
#: Capacities of smoothness edges: neighbours in page order of one parent, each step up to the joint ancestor divides it;
#: next block of the same parent that is not the neighbour; least capacity worth an edge; steps up that are looked at. Chosen on
#: labelled pages apart from those that the weights are fitted on (0.25 to 0.5 do best, 2 errs half as often again).
NEXT, SAME_PARENT, LEAST, STEPS = 0.5, 0.25, 0.0125, 6


@lru_cache(maxsize=20_000)
def names_of(tag: str, attrs: str) -> tuple[frozenset[str], bool]:
    """What an element's tag, role, class and id speak for (with "tag " before it where the tag does), and whether it is hidden."""
    said, hidden = set(), False
    if tag in TAGS:
        said |= {TAGS[tag], f"tag {TAGS[tag]}"}
    if attrs.strip() and tag not in ("html", "body"):  # themes put any word on the body
        for m in ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                role = ROLES.get(value.strip().lower())
                said |= {role, f"tag {role}"} if role else set()
            elif name == "style":
                hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif name == "hidden" or name == "aria-hidden":
                hidden = hidden or name == "hidden" or value.lower() == "true"
            else:
                said |= {NAMES[w] for x in WORDS.findall(value) if (w := x.lower()) in NAMES}
    return frozenset(said), hidden


class Node:
    """An open or closed element: its parent, what it speaks for, the text inside, whether a content root is inside."""

    __slots__ = ("depth", "hidden", "holds_root", "inside", "parent", "said", "size", "tag", "told")

    def __init__(self, tag: str, parent: Node | None, said: frozenset[str], hidden: bool):
        self.tag, self.parent, self.said, self.hidden = tag, parent, said, hidden
        self.depth = parent.depth + 1 if parent else 0
        self.inside = bool(parent and (parent.inside or "root" in parent.said))
        self.size, self.holds_root, self.told = 0, False, None


class Block:
    """A text block: its text, link characters, the element around it, and tags nearby."""

    __slots__ = ("links", "node", "tags", "text")

    def __init__(self, text: str, links: int, node: Node, tags: frozenset[str]):
        self.text, self.links, self.node, self.tags = text, links, node, tags


def blocks(page: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    parts: list[str] = []
    links = 0
    stack = [Node("", None, frozenset(), False)]
    open_tags: dict[str, int] = {}
    endless: set[str] = set()  # raw tags that no end tag follows any more

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                k = len(stack) - 1
                while stack[k].tag in INLINE:
                    k -= 1
                out.append(Block(text, links, stack[k], frozenset(x.tag for x in stack[-4:])))
                stack[-1].size += len(text)
            links = 0

    def say(data: str) -> None:
        nonlocal links
        if data:
            if "&" in data:
                data = html.unescape(data)
            parts.append(data)
            if open_tags.get("a"):
                links += len(data.strip())

    def pop_to(i: int) -> None:
        while len(stack) > i:
            x = stack.pop()
            open_tags[x.tag] -= 1
            x.parent.size += x.size
            x.parent.holds_root = x.parent.holds_root or x.holds_root or "tag root" in x.said

    def close_nearest(tags: set[str], stop) -> None:
        """Close the nearest open element of these tags, unless one that `stop` says lies between."""
        if any(open_tags.get(t) for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    pop_to(i)
                    return
                if stop(stack[i].tag):
                    return

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue  # comment, doctype, processing instruction or bogus
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                parts.append(" ")
            elif tag not in INLINE:
                flush()
            # a stray inline end tag does not close blocks
            close_nearest({tag}, (lambda t: t not in INLINE) if tag in INLINE else (lambda t: False))
            continue
        if tag in RAW:
            if m[3].endswith("/") and tag == "svg":
                continue
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if end is None:
                endless.add(tag)
                at = n if tag in ("script", "style", "textarea", "title") else at
            else:
                close = page.find(">", end.end())
                at = n if close < 0 else close + 1
            if tag not in ("svg", "script", "style"):
                parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P:
            close_nearest({"p"}, lambda t: t not in INLINE)
        if tag in SIBLINGS:
            own, stop = SIBLINGS[tag]
            close_nearest(own, stop.__contains__)
        if tag == "a":
            close_nearest({"a"}, lambda t: t not in INLINE)
        if len(stack) > DEPTH:
            flush()
            pop_to(DEPTH)
        stack.append(Node(tag, stack[-1], *(names_of(tag, m[3]) if tag not in INLINE or m[3] else (frozenset(), False))))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    pop_to(1)
    return out


def _told(node: Node, whole: int) -> dict[str, float]:
    """What all elements around say, by kind: each name counts once, by the element in which it counts most."""
    todo = []
    while node is not None and node.told is None:
        todo.append(node)
        node = node.parent
    for x in reversed(todo):
        above = x.parent.told if x.parent else {}
        if not x.said and not x.hidden:
            x.told = above
            continue
        x.told = dict(above)
        share = x.size / whole
        less = min(1.0, max(0.0, (SHARE[1] - share) / (SHARE[1] - SHARE[0])))
        for kind in x.said:
            if kind in ("root", "good", "comment", "tag nav", "tag footer", "tag aside"):
                weight = 0.0 if kind != "root" and kind != "good" and x.holds_root else 1.0
            elif kind == "header" or kind == "tag header":  # the head of an article holds its title
                weight = 0.0 if x.inside or "good" in x.said else less
            else:
                weight = 0.0 if x.holds_root or "root" in x.said else less
            x.told[kind] = max(x.told.get(kind, 0.0), weight)
        if x.hidden:
            x.told["hidden"] = 1.0
    return (todo[0] if todo else node).told


def features(bs: list[Block]) -> np.ndarray:
    """blocks x FEATURES."""
    whole = max(1, sum(len(b.text) for b in bs))
    told = [_told(b.node, whole) for b in bs]
    rooted = any("tag root" in x for x in told)
    out = np.zeros((len(bs), len(FEATURES)))
    for i, (b, said) in enumerate(zip(bs, told, strict=True)):
        text, tags = b.text, b.tags
        wide = sum(1 for c in text if "\u2e80" <= c) if not text.isascii() else 0  # scripts without spaces between words
        words = text.count(" ") + 1 + wide / 2
        share = min(1.0, b.links / len(text))
        row = {
            "bias": 1.0, "size": min(4.0, float(np.log1p(words))), "sentence": text[-1] in ".!?…:;\"'”’»)。！？」』،؟।", "links": share, "links of short": share * (words < 8),
            "p": "p" in tags, "heading": bool(tags & HEADINGS), "li": "li" in tags, "cell": bool(tags & {"td", "th", "dt", "dd"}), "quote": bool(tags & {"blockquote", "pre", "figcaption", "code"}),
            "cues": min(3, sum(1 for _ in CUES.finditer(text[:2000]))) * min(1.0, 40 / words), "outside root": rooted and "tag root" not in said,
        }
        for k, name in enumerate(FEATURES):
            out[i, k] = row[name] if name in row else said.get(name, 0.0)
    return out


def _apart(a: Node, b: Node) -> int:
    """Steps from both elements to just below their joint ancestor; a large number if it is beyond STEPS."""
    up_a = up_b = 0
    while a is not b:
        if up_a + up_b > STEPS:
            return 1 << 30
        if a.depth >= b.depth:
            a, up_a = a.parent, up_a + 1
        else:
            b, up_b = b.parent, up_b + 1
    return max(0, up_a - 1) + max(0, up_b - 1)


def edges(bs: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges (i, j, capacity)."""
    out: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(bs):
        if i:
            cap = NEXT / (1 + _apart(bs[i - 1].node, b.node)) ** 2
            if cap >= LEAST:
                out.append((i - 1, i, cap))
        parent = id(b.node.parent or b.node)
        j = last.get(parent)
        if j is not None and j < i - 1:
            out.append((j, i, SAME_PARENT))
        last[parent] = i
    return out


def min_cut(scores: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the content side of a minimum cut: cutting a node from content costs its positive score, from
    boilerplate its negative one, an edge its capacity if its ends differ. On a tie a node is boilerplate."""
    n = len(scores)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in links:
        if i != j:
            around[i][j] = around[i].get(j, 0.0) + c
            around[j][i] = around[j].get(i, 0.0) + c
    score, label = list(scores), [None] * n
    queue = deque(range(n))
    while queue:  # nodes that no neighbour can sway
        i = queue.popleft()
        if label[i] is None and abs(score[i]) > sum(around[i].values()):
            label[i] = score[i] > 0
            for j, c in around[i].items():
                score[j] += c if label[i] else -c
                del around[j][i]
                queue.append(j)
            around[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, content in zip(left, max_flow([score[i] for i in left], left, around), strict=True):
            label[i] = content
    return label


def max_flow(scores: list[float], names: list[int], around: list[dict[int, float]]) -> list[bool]:
    """Dinic's max-flow between the content terminal n and the boilerplate terminal n + 1; the content side of the cut."""
    n, place = len(scores), {x: k for k, x in enumerate(names)}
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forward: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forward)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for k, s in enumerate(scores):
        edge(n, k, s, 0.0) if s > 0 else edge(k, n + 1, -s, 0.0)
        for x, c in around[names[k]].items():
            if place[x] > k:
                edge(k, place[x], c, c)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[n] = 0
        queue = deque([n])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[n + 1] < 0:
            return [level[k] >= 0 for k in range(n)]
        place_of = [0] * (n + 2)
        path: list[int] = []
        a = n
        while True:  # blocking flow, path by path
            if a == n + 1:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if cap[e] <= eps)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while place_of[a] < len(out[a]):
                e = out[a][place_of[a]]
                if cap[e] > eps and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                place_of[a] += 1
            else:
                if a == n:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]


def main_text(page: str | None, weights: np.ndarray | None = None) -> str:
    """The content blocks of a page, in page order, with two \\n between them. weights: by default those fitted on html_model's pages."""
    if not page:
        return ""
    if weights is None:
        from lattica.llm.html_model import fitted

        weights = fitted()
    bs = blocks(page)
    if not bs:
        return ""
    odds = np.clip(features(bs) @ weights, -CLIP, CLIP).tolist()
    return "\n\n".join(b.text for b, content in zip(bs, min_cut(odds, edges(bs)), strict=True) if content)


def extracted(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", extra: tuple[str, ...] = ("url",), weights: np.ndarray | None = None) -> DataFrame:
    """`id_col`, the columns of `extra`, text and n_chars (code points) of every row. weights: of the classifier, by FEATURES;
    by default those fitted, once on the driver, on html_model's pages."""
    from lattica.llm.html_model import fitted

    own = fitted() if weights is None else weights
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(html_col).cast("string").alias("html_in"), F.col(id_col).alias("id_in"), *(F.col(c).alias(f"own_{c}") for c in extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("html_text", names_of.cache_clear)
        for b in batches:
            texts = [main_text(x.as_py(), own) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*b.schema.names[1:], "new_text", "new_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), "new_text string, new_chars long"])
    return rows.mapInArrow(run, schema).select(F.col("id_in").alias(id_col), *(F.col(f"own_{c}").alias(c) for c in extra), F.col("new_text").alias("text"), F.col("new_chars").alias("n_chars"))
