"""Labelled pages to train on: common page layouts with made-up words, each part marked as main or not.

An element with ``data-main="1"`` or ``"0"`` labels the blocks in it; the innermost mark counts. Pages that a user
has labelled in this way can be used instead of, or along with, the ones made here.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable

from driftline.llm.blocks import TOKEN, Block, leaf_blocks

PAGES = 1200
SYLLABLES = "an be ci do el fa gu ho in ja ke li mo nu or pa qui re so tu ve wi xa ya zo".split()

#: Parts of a page that are not main: elements they are made of, and names that sites give them.
AROUND = {
    "header": (["header", "div", "section"], "header masthead topbar top site-header banner branding logo page-header global-header"),
    "menu": (["nav", "div", "ul"], "nav menu navigation navbar breadcrumb breadcrumbs toolbar main-menu submenu tabs pagination pager toc site-nav links"),
    "notice": (["div", "section", "aside", "p"], "notice cookie-notice cookie-banner consent alert gdpr popup modal announcement disclaimer warning cookies message overlay privacy-notice paywall"),
    "advert": (["div", "aside", "section", "ins"], "ad ads advert advertisement sponsor sponsored promo promotion adsense ad-slot ad-container banner-ad commercial"),
    "sidebar": (["aside", "div", "section", "td"], "sidebar side widget rail right-rail secondary complementary column-right sidebar-widget widgets tags categories archive"),
    "related": (["aside", "div", "section", "ul"], "related recommended more read-next trending popular related-posts suggestions recirculation most-read also"),
    "share": (["div", "ul", "p"], "share social sharing share-buttons follow social-links share-bar"),
    "form": (["form", "div", "section", "fieldset"], "form search newsletter login subscribe contact signup search-form subscription register feedback"),
    "footer": (["footer", "div", "section"], "footer bottom copyright colophon legal site-footer page-footer credits imprint foot"),
    "comments": (["section", "div", "ol", "ul", "aside"], "comments comment-list discussion replies responses disqus reviews comment-section user-comments thread feedback-list"),
    "byline": (["div", "p", "footer"], "author-bio about-author author-box meta-footer post-meta post-footer entry-footer"),
}
MAIN = "content post entry article story post-content article-body entry-content main-content text body page-content main post-body article-content articlebody rich-text prose blog-post single"
#: Names of elements around both, and what a layout has or lacks.
WRAPPERS = "wrapper container page wrap outer layout grid row site"
COLUMNS = "col cols column eight grid md lg span inner center root app shell"
HAVING = "layout-with-sidebar has-comments has-sidebar no-ads with-menu page-with-header no-sidebar has-footer"
COMMENT = "comment reply comment-body review response comment-content user-comment post-reply"

#: Tokens of names that tell a part around an article, by kind; those that articles have too are left out.
KIND_OF = {
    token.lower(): kind
    for kind, names in [*((k, n) for k, (_, n) in AROUND.items()), ("comments", COMMENT)]
    for token in TOKEN.findall(names)
    if token not in TOKEN.findall(f"{MAIN} {WRAPPERS} {COLUMNS}")
}
#: Tokens that tell nothing by themselves.
NEUTRAL = frozenset(token.lower() for token in TOKEN.findall(f"{WRAPPERS} {COLUMNS}")) - frozenset(token.lower() for token in TOKEN.findall(MAIN))
MAIN_TOKENS = frozenset(token.lower() for token in TOKEN.findall(MAIN))


class _Writer:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        self.named = rng.random() > 0.12  # some sites use names that say nothing
        self.bare = rng.random() < 0.3  # and some use neither names nor elements that say what they are
        self.odd = [self.word() for _ in range(12)]

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def words(self, n: int) -> str:
        return " ".join(self.word() + ("," if self.rng.random() < 0.08 else "") for _ in range(n))

    def sentence(self, most: int = 24) -> str:
        if self.rng.random() < 0.12:
            n = self.rng.randint(1, 3)
        else:
            n = self.rng.randint(3, most)
        return (self.words(n).capitalize().rstrip(",")) + self.rng.choice("....!?")

    def prose(self, n: int | None = None) -> str:
        n = n or self.rng.choice([1, 1, 2, 3, 4, 6])
        out = " ".join(self.sentence() for _ in range(n))
        if self.rng.random() < 0.2:
            w = out.split(" ")
            i = self.rng.randrange(len(w))
            w[i] = self.rng.choice(['<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "<code>{}</code>"]).format(w[i])
            out = " ".join(w)
        return out

    def names(self, names: str) -> str:
        if self.bare:
            return ""
        chosen = self.rng.choice(names.split()) if self.named else self.rng.choice(self.odd)
        chosen = self.rng.choice([chosen, chosen, f"{self.rng.choice(self.odd)} {chosen}", f"{chosen}-{self.rng.choice(self.odd)}"])
        return f' {self.rng.choice(["class", "class", "id"])}="{chosen}"'

    def link(self, n: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.words(self.rng.randint(1, n))}</a>'

    def heading(self, level: int | None = None) -> str:
        level = level or self.rng.randint(2, 4)
        return f"<h{level}>{self.words(self.rng.randint(1, 9))}</h{level}>"

    def around(self, kind: str) -> str:
        tags, names = AROUND[kind]
        if self.bare and kind not in ("header", "menu", "related", "share", "footer") and self.rng.random() < 0.85:
            return ""  # prose that nothing tells from that of the article
        if self.bare:
            tags = [t for t in tags if t in ("div", "p", "ul", "ol", "td")] or ["div"]
        tag = self.rng.choice(tags)
        semantic = tag in ("nav", "aside", "footer", "header", "form")
        attributes = "" if semantic and self.rng.random() < 0.5 else self.names(names)
        if kind in ("notice", "menu") and self.rng.random() < 0.15:
            attributes += ' role="alert"' if kind == "notice" else ' role="navigation"'
        r = self.rng.random()
        if kind == "menu" and self.bare and r < 0.5:
            inner = self.rng.choice([" | ", "<br>", " ", " - "]).join(self.link(2) for _ in range(self.rng.randint(2, 8)))
        elif kind in ("menu", "related", "share", "sidebar") and r < 0.7:
            items = [f"<li>{self.link(7 if kind != 'menu' else 2)}</li>" for _ in range(self.rng.randint(2, 8))]
            inner = "".join(items) if tag == "ul" else f"<ul>{''.join(items)}</ul>"
            if kind in ("related", "sidebar") and tag != "ul":
                inner = self.heading() + inner
        elif kind == "comments":
            child = "li" if tag in ("ol", "ul") else self.rng.choice(["div", "div" if self.bare else "article", "div", "li"])
            inner = "" if tag in ("ol", "ul") else self.heading()
            for _ in range(self.rng.randint(1, 6)):
                body = f"<p>{self.prose()}</p>" * self.rng.randint(1, 2) if self.rng.random() < 0.7 else self.prose()
                who = self.rng.choice(["", f"<div>{self.link()}</div>", f"<h4>{self.words(2)}</h4>", f"<span>{self.words(2)}</span> "])
                inner += f"<{child}{self.names(COMMENT) if self.rng.random() < 0.8 else ''}>{who}{body}</{child}>"
        elif kind == "form":
            fields = [f"<label>{self.words(2)}</label><input name=x>", f"<p>{self.sentence()}</p>", f"<div>{self.words(2)} <input></div>", "<button>go</button>", "<select><option>a</option></select>"]
            inner = "".join(self.rng.choice(fields) for _ in range(self.rng.randint(1, 5)))
            if tag != "form" and self.rng.random() < 0.6:
                inner = f"<form>{inner}</form>"
        elif kind == "footer":
            inner = self.rng.choice(["&copy; 2024 {} {}", "<p>&copy; {}</p><p>{}</p>", "<div>{}</div><p>{}</p>", "<p>{} {}</p>"]).format(self.words(3), self.prose(1))
            if self.rng.random() < 0.4:
                inner += f"<ul>{''.join(f'<li>{self.link()}</li>' for _ in range(3))}</ul>"
        elif kind == "header":
            inner = self.rng.choice([f"<h1>{self.link()}</h1>", f"<div>{self.link()}</div>", f"<p>{self.words(4)}</p>", f"<h1>{self.words(2)}</h1><p>{self.words(5)}</p>", self.link()])
        else:
            inner = self.rng.choice([self.prose(1), f"<p>{self.prose()}</p>", f"<p>{self.prose(1)}</p>{self.link()}", self.sentence(), self.heading() + f"<p>{self.prose()}</p>"])
        if tag == "td":
            return f'<table><tr><td data-main="0"{attributes}>{inner}</td></tr></table>'
        return f'<{tag} data-main="0"{attributes}>{inner}</{tag}>'

    def main(self) -> str:
        title = self.heading(1) if self.rng.random() < 0.8 else ""
        if title and self.rng.random() < 0.2:
            title = f"<header>{title}</header>"
        parts = [title]
        loose = self.bare and self.rng.random() < 0.6  # no element around the text
        plain = not loose and self.rng.random() < 0.1
        for _ in range(self.rng.choice([1, 1, 2, 3, 5, 8, 12])):
            r = self.rng.random()
            if plain:
                parts.append(f"{self.prose()}<br><br>")
            elif r < 0.74:
                parts.append(f"<p>{self.prose()}</p>")
            elif r < 0.8:
                parts.append(self.heading())
            elif r < 0.85:
                kind = self.rng.choice(["ul", "ol"])
                parts.append(f"<{kind}>{''.join(f'<li>{self.prose(1)}</li>' for _ in range(self.rng.randint(2, 5)))}</{kind}>")
            elif r < 0.88:
                parts.append(f"<blockquote>{self.rng.choice(['{}', '<p>{}</p>']).format(self.prose())}</blockquote>")
            elif r < 0.9:
                parts.append(f"<pre>{self.words(8)}</pre>")
            elif r < 0.93:
                cells = "".join(f"<tr><td>{self.words(2)}</td><td>{self.words(1)}</td></tr>" for _ in range(2))
                parts.append(f"<table>{cells}</table>")
            elif r < 0.95:
                parts.append(f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>")
            elif r < 0.97:
                parts.append(f"<section>{self.heading()}<p>{self.prose()}</p></section>")
            else:
                parts.append(f"<div>{self.prose()}</div>")
        for kind in ("advert", "related", "share", "form", "menu", "notice", "byline", "footer", "sidebar"):
            if self.rng.random() < 0.18:
                parts.insert(self.rng.randint(1, len(parts)), self.around(kind))
        if self.rng.random() < 0.06:
            parts.append(self.around("comments"))
        if loose:
            return "".join(p if "data-main" in p else re.sub(r"^<(\w+)", r'<\1 data-main="1"', p) for p in parts)
        inner = "".join(parts)
        r = self.rng.random()
        if self.bare:
            r = 0.62 + 0.38 * r if r < 0.6 else 0.96
        names = self.names(MAIN) if self.rng.random() < 0.6 else ""
        if r < 0.35:
            out = f'<article data-main="1"{names}>{inner}</article>'
        elif r < 0.5:
            out = f'<main data-main="1"{names}>{inner}</main>'
        elif r < 0.62:
            out = f'<main><article data-main="1"{names}>{inner}</article></main>'
        elif r < 0.9:
            out = f'<div data-main="1"{self.names(self.rng.choice([MAIN, MAIN, COLUMNS]))}>{inner}</div>'
        elif r < 0.95:
            out = f'<section data-main="1"{names}>{inner}</section>'
        else:
            out = f'<table><tr><td data-main="1"{names}>{inner}</td></tr></table>'
        return out

    def page(self) -> str:
        share = self.rng.choice([0.0, 0.4, 0.8]) if self.bare else 1.0
        some = lambda kind, p: self.around(kind) if self.rng.random() < p * share else ""
        before = [some("header", 0.6), some("menu", 0.8), some("notice", 0.4), some("advert", 0.4), some("menu", 0.2), some("sidebar", 0.2), some("form", 0.15)]
        after = [some("share", 0.2), some("byline", 0.15), some("related", 0.35), some("comments", 0.45), some("sidebar", 0.3), some("form", 0.25), some("advert", 0.2), some("notice", 0.2), some("footer", 0.8)]
        if self.rng.random() < 0.3:
            self.rng.shuffle(before)
        if self.bare and self.rng.random() < 0.4:  # columns of a table
            cell = lambda parts: f"<td>{''.join(parts)}</td>" if any(parts) else ""
            if self.rng.random() < 0.6:
                links = self.rng.choice([" | ", "<br>", " ", "<br><br>"]).join(self.link(2) for _ in range(self.rng.randint(2, 8)))
                before = [f'<div data-main="0">{links}</div>' if self.rng.random() < 0.3 else f'<td data-main="0">{links}</td>']
            wide = before and before[0].startswith("<td")
            body = f"<table><tr>{before[0] if wide else cell(before)}<td>{self.main()}</td>{cell(after)}</tr></table>"
            return f"<html><body>{body}</body></html>"
        body = "".join(before) + self.main() + "".join(after)
        for _ in range(self.rng.choice([0, 0, 1, 2])):
            tag = self.rng.choice(["div", "div", "section"])
            names = self.rng.choice([WRAPPERS, WRAPPERS, COLUMNS, HAVING])
            body = f"<{tag}{self.names(names) if self.rng.random() < 0.7 else ''}>{body}</{tag}>"
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>"


def pages(n: int = PAGES, seed: int = 11) -> list[str]:
    rng = random.Random(seed)
    return [_Writer(rng).page() for _ in range(n)]


def marked(pages: Iterable[str]) -> list[tuple[list[Block], list[bool]]]:
    """Blocks and labels of marked pages; a block without a mark is not main."""
    found = []
    for page in pages:
        blocks = leaf_blocks(page)
        found.append((blocks, [b.main == "1" for b in blocks]))
    return found
