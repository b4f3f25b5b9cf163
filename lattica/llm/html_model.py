"""The classifier of operator 5: labelled pages, made here by rule, and logistic regression on their text blocks.

A page is a frame (landmark tags, named divisions, plain divisions, one form around all, a page builder's nesting), with a
text of its own and the things around it: menus, heads, notices, adverts, share bars, related links, comments, feet. All
words are invented, so that nothing is learnt of a language but the cue words. The number of pages is bounded by `pages`.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

from lattica.llm.html_text import FEATURES, blocks, features

#: Pages to fit on, and strength of the prior that pulls weights to 0.
PAGES, RIDGE = 600, 1.0
LAYOUT = ["container", "row", "col-md-8", "wrap", "inner", "css-1q2w3", "grid", "section", "block", "page"]


class Maker:
    """Writes one page and keeps what is content."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.content: dict[str, bool] = {}
        self.wide = self.r.random() < 0.12  # a script without spaces

    def words(self, n: int) -> str:
        if self.wide:
            return "".join(chr(self.r.randrange(0x4E00, 0x9000)) for _ in range(2 * n))
        return " ".join("".join(self.r.choice(["ba", "te", "ri", "no", "lu", "sha", "em", "ork", "in", "do"]) for _ in range(self.r.randrange(1, 4))) for _ in range(n))

    def text(self, n: int, content: bool, end: str | None = None, before: str = "") -> str:
        out = before + self.words(n).capitalize() + (end if end is not None else "。" if self.wide else self.r.choice([".", ".", ".", "!", "?"]))
        self.content[out] = content
        return out

    def maybe(self, chance: float, part) -> str:
        return part() if self.r.random() < chance else ""

    def named(self, names: list[str], inner: str, tags: tuple[str, ...] = ("div",)) -> str:
        tag, name = self.r.choice(tags), self.r.choice(names)
        extra = self.r.choice(["", "", f" {self.r.choice(LAYOUT)}"])
        return f'<{tag} {self.r.choice(["class", "class", "id"])}="{name}{extra}">{inner}</{tag}>'

    def links(self, n: int, names: list[str], tags: tuple[str, ...]) -> str:
        items = [f'<a href="/{i}">{self.text(self.r.randrange(1, 5), False, "")}</a>' for i in range(n)]
        inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.6 else "".join(f"<div>{x}</div>" for x in items)
        return self.named(names, inner, tags) if names else f"<{tags[0]}>{inner}</{tags[0]}>"

    def advert(self) -> str:
        cue = self.r.choice(["Buy ", "Shop now: ", "Sponsored: ", "50% off ", "", "Order now "])
        inner = self.text(self.r.randrange(3, 14), False, None, cue)
        return self.named(["ad", "ads-slot", "promo", "sponsored", "box", "box", "advert", "ad-banner"], self.r.choice([inner, f"<p>{inner}</p>", f'<a href="/x">{inner}</a>']), ("div", "div", "aside"))

    def content_part(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.62:
            n = r.choice([4, 6, 9, 15, 30, 60, 90])
            if r.random() < 0.12:  # texts speak of such things, too
                return f"<p>{self.text(r.choice([1, 3, n]), True, None, r.choice(['All rights reserved ', 'Copyright ', 'The offer of 50% ', 'Cookies and $ 5 ', 'Buy ', 'They reply ']))}</p>"
            return r.choice(["<p>{}</p>"] * 8 + ["<div>{}</div>", "<p><b>{}</b></p>"]).format(self.text(n, True))
        if kind < 0.72:
            return f"<h{(k := r.randrange(2, 5))}>{self.text(r.randrange(1, 7), True, '')}</h{k}>"
        if kind < 0.82:
            return "<ul>" + "".join(f"<li>{self.text(r.randrange(2, 14), True, r.choice(['', '.']))}</li>" for _ in range(r.randrange(2, 5))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote><p>{self.text(r.randrange(4, 30), True)}</p></blockquote>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{self.text(2, True, '')}</td><td>{self.text(r.randrange(1, 5), True, '')}</td></tr>" for _ in range(2)) + "</table>"
        return f"<figure><figcaption>{self.text(r.randrange(3, 12), True)}</figcaption></figure>"

    def article(self) -> str:
        parts = [f"<h1>{self.text(self.r.randrange(2, 9), True, '')}</h1>"] if self.r.random() < 0.85 else []
        parts += [self.maybe(0.3, lambda: f'<p class="byline">{self.text(3, True, "")}</p>')]
        for _ in range(self.r.choice([2, 3, 4, 6, 10])):
            parts.append(self.content_part())
            parts.append(self.maybe(0.1, self.advert))
            parts.append(self.maybe(0.04, lambda: self.notice(("div",))))
            parts.append(self.maybe(0.06, self.form))
            parts.append(self.maybe(0.03, self.hidden))
        parts.append(self.maybe(0.3, lambda: self.links(3, ["share", "social-links", "related", "post-tags"], ("div", "ul"))))
        return "".join(parts)

    def notice(self, tags: tuple[str, ...] = ("div", "div", "dialog", "section")) -> str:
        cue = self.r.choice(["We use cookies. ", "Sign up: ", "Subscribe to our newsletter. ", ""])
        inner = f"<p>{self.text(self.r.randrange(4, 25), False, None, cue)}</p>" + self.maybe(0.5, lambda: f"<button>{self.text(1, False, '')}</button>")
        return self.named(["cookie-notice", "consent", "newsletter-signup", "modal", "alert-bar", "gdpr"], inner, tags)

    def form(self) -> str:
        label, button = self.text(self.r.randrange(1, 4), False, ""), self.text(self.r.randrange(1, 3), False, "")
        about = self.maybe(0.3, lambda: f"<p>{self.text(self.r.randrange(3, 9), False)}</p>")
        return f"<form{self.r.choice(['', ' class=search', ' role=search', ' id=signup'])}>{about}<label>{label}</label><input name=q><button>{button}</button></form>"

    def hidden(self) -> str:
        how = self.r.choice(["hidden", 'style="display: none"', 'aria-hidden="true"', 'style="visibility:hidden"'])
        return f"<div {how}><p>{self.text(self.r.randrange(2, 30), False)}</p></div>"

    def comments(self) -> str:
        one = lambda: f'<p>{self.text(self.r.randrange(4, 40), False)}</p>' + self.maybe(0.5, lambda: f'<a href="#">{self.text(1, False, "", "Reply ")}</a>')
        items = [one() for _ in range(self.r.randrange(1, 6))]
        inner = self.maybe(0.6, lambda: f"<h3>{self.text(1, False, '')}</h3>") + ("<ol>" + "".join(f"<li>{x}</li>" for x in items) + "</ol>" if self.r.random() < 0.6 else "".join(f"<div>{x}</div>" for x in items))
        return self.named(["comments", "comment-list", "thread", "disqus", "responses", "discussion"], inner, ("div", "section", "ol"))

    def footer(self, tag: str) -> str:
        return f"{tag}<p>{self.text(self.r.randrange(2, 14), False, None, self.r.choice(['© ', '', 'All rights reserved. ']))}</p>" + self.maybe(0.6, lambda: self.links(3, ["links", "legal"], ("div",)))

    def page(self) -> str:
        r, frame = self.r, self.r.choice(["landmarks", "landmarks", "names", "plain", "form", "builder"])
        head = self.maybe(0.5, lambda: f'<a href="/">{self.text(2, False, "")}</a>')
        if frame in ("landmarks", "form"):
            body, tag = self.article(), r.choice(["article", "main", "article"])
            body += self.maybe(0.3, self.comments) if tag == "main" else ""
            parts = [f"<header>{head}</header>" if head else "", self.links(r.randrange(2, 8), [], ("nav",)), f"<{tag}>{body}</{tag}>", self.maybe(0.3, self.comments), self.maybe(0.4, lambda: f"<aside>{self.links(3, ['list'], ('div',))}<p>{self.text(9, False)}</p></aside>"), f"<footer>{self.footer('')}</footer>"]
            if frame == "form":
                parts[2] = f'<div class="{r.choice(["content", "inner", "wrap"])}">{body}</div>'
        elif frame == "names":
            parts = [self.named(["header", "masthead", "site-header"], head), self.links(r.randrange(2, 8), ["menu", "navbar", "nav"], ("div", "ul")), self.named(["content", "post", "entry-content", "main", "story-body"], self.article()), self.maybe(0.4, self.comments), self.maybe(0.5, lambda: self.named(["sidebar", "right-rail", "widget-area"], f"<p>{self.text(12, False)}</p>" + self.links(3, ["list"], ("div",)))), self.named(["footer", "colophon"], self.footer(""))]
        elif frame == "plain":
            parts = [self.links(r.randrange(2, 6), [], ("div",)), self.named(LAYOUT, self.article()), self.links(r.randrange(1, 4), [], ("div",))]
        else:
            inner = self.named(["elementor-widget post-content", "side-by-side", "legal-text", "page-header-wrap", "widget text", "card"], self.named(LAYOUT, self.article()))
            parts = [self.links(r.randrange(2, 6), ["menu", "nav"], ("div", "nav")), self.named(LAYOUT, inner), self.maybe(0.4, self.comments), self.named(["footer", "bottom"], self.footer(""))]
        body = "".join([self.maybe(0.3, self.notice), self.maybe(0.15, self.form), self.maybe(0.1, self.hidden), *parts[:2], self.maybe(0.3, self.advert), *parts[2:]])
        if frame == "form":
            body = f'<form id="aspnet" action="/">{body}</form>'
        return f"<html><body>{body}</body></html>"


def labelled(seeds: range) -> list[tuple[str, dict[str, bool]]]:
    """Pages with, by a block's text, whether it is content."""
    out = []
    for seed in seeds:
        m = Maker(seed)
        out.append((m.page(), m.content))
    return out


@lru_cache(maxsize=2)
def fitted(pages: int = PAGES, ridge: float = RIDGE) -> np.ndarray:
    """Weights by FEATURES: logistic regression by Newton's method."""
    xs, ys = [], []
    for page, content in labelled(range(pages)):
        known = [b for b in blocks(page)]
        x = features(known)
        hit = [i for i, b in enumerate(known) if b.text in content]
        xs.append(x[hit])
        ys.append(np.array([content[known[i].text] for i in hit], float))
    x, y = np.concatenate(xs), np.concatenate(ys)
    w, prior = np.zeros(len(FEATURES)), ridge * np.eye(len(FEATURES))
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + prior, x.T @ (y - p) - prior @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w
