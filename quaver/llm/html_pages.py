"""Labelled pages for the HTML extractor: articles in many layouts, with everything that isn't the article."""

from __future__ import annotations

import numpy as np

_SYLLABLES = "an ber cor da el fi gra hu in jo ka lum mo ner ol pra qui ros sta tu ur ven wil xo ya zen".split()


def _word(rng) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.integers(1, 4)))


def _sentence(rng, low: int, high: int) -> str:
    s = " ".join(_word(rng) for _ in range(rng.integers(low, high)))
    return s.capitalize() + str(rng.choice([".", ".", ".", "!", "?"]))


def _pick(rng, *options: str) -> str:
    return str(options[rng.integers(len(options))])


class _Page:
    def __init__(self, rng, odd: bool):
        self.rng, self.odd, self.content = rng, odd, set()

    def links(self, n: int) -> str:
        r = self.rng
        kind = r.integers(3)
        items = [f'<a href="/{_word(r)}">{" ".join(_word(r) for _ in range(r.integers(1, 4)))}</a>' for _ in range(n)]
        if kind == 0:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return (" | " if kind == 1 else " ").join(items)

    def named(self, tags: str, names: str, inner: str) -> str:
        r = self.rng
        tag, name = _pick(r, *tags.split()), _pick(r, *names.split())
        if tag in ("nav", "aside", "footer", "header", "form") and r.random() < 0.4:
            name = "-"  # the tag alone tells
        elif self.odd and "<ul>" in inner and r.random() < 0.2:
            name = _pick(r, "-", _word(r), f"css-{_word(r)}")  # a name of another language, or none
        if tag == "p":  # holds no blocks
            inner = inner.replace("<p>", "").replace("</p>", " ")
        attribute = "" if name == "-" else f' {_pick(r, "class", "class", "id")}="{name}"'
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def blurb(self, low: int = 4, high: int = 16, n: int = 2) -> str:
        r = self.rng
        parts = [_sentence(r, low, high) for _ in range(r.integers(1, n + 1))]
        return " ".join(parts) if r.random() < 0.5 else "".join(f"<p>{p}</p>" for p in parts)

    def boilerplate(self) -> str:
        r = self.rng
        k = r.integers(12 if self.odd else 11)
        if k == 11:  # a notice that only its button gives away
            text = self.blurb(4, 22, 2)
            control = _pick(r, "<button>{}</button>", "<button type=button>{}</button>", "<p><button>{}</button></p>", "<select><option>{}</select>").format(_word(r).title())
            return f'<div{_pick(r, "", f' id="{_word(r)}"', f' class="{_word(r)}"')}>{text}{control}</div>'
        if k == 9:  # without any name
            tag = _pick(r, "div", "section", "ul")
            return f"<{tag}>{self.links(r.integers(3, 9))}</{tag}>"
        if k == 10:
            return _pick(
                r,
                f'<div style="display:none"><p>{_sentence(r, 4, 20)}</p></div>',
                f"<p hidden>{_sentence(r, 3, 15)}</p>",
                f"<noscript><p>{_sentence(r, 4, 12)}</p></noscript>",
                f"<select><option>{_word(r)}<option>{_word(r)} {_word(r)}</select>",
            )
        if k == 0:
            return self.named("div div aside section p", "ad ads advert advertisement ad-slot sponsored promo banner", self.blurb())
        if k == 1:
            return self.named("aside div aside section", "sidebar side-bar widget widgets right-rail complementary", _pick(r, f"<h3>{_word(r).title()}</h3>", "") + (self.links(r.integers(2, 7)) if r.random() < 0.5 else self.blurb(4, 25, 3)))
        if k == 2:
            return self.named("div section div p", "cookie-notice cookie-consent notice site-notice gdpr-banner alert popup modal", self.blurb(5, 25))
        if k == 3:
            return self.named("form form div", "newsletter subscribe signup search login contact-form", _pick(r, "<label>" + _sentence(r, 2, 6) + "</label>", self.blurb(3, 12)) + '<input type="text"><button>' + _word(r).title() + "</button>")
        if k == 4:
            inner = "".join(self.named("div li article p", "comment comment-body reply user-comment", f"<b>{_word(r).title()}</b> " + self.blurb(4, 40, 2)) for _ in range(r.integers(1, 4)))
            return self.named("section div ol div", "comments comment-list responses discussion disqus_thread", _pick(r, "<h2>Comments</h2>", "<h3>" + _word(r) + "</h3>", "") + inner)
        if k == 5:
            return self.named("div ul div", "share social share-buttons social-links follow-us", self.links(r.integers(2, 5)))
        if k == 6:
            return self.named("div section aside", "related related-posts recommended more-stories popular", f"<h3>{_word(r).title()} {_word(r)}</h3>" + self.links(r.integers(2, 6)))
        if k == 7:
            return self.named("nav div nav", "breadcrumb breadcrumbs pagination pager menu nav navbar", self.links(r.integers(2, 6)))
        return self.named("div div p", "notice ad ads disclaimer-notice sponsor-note", self.blurb(8, 30))

    def own(self, text: str) -> str:
        self.content.add(text)
        return text

    def article(self) -> str:
        r = self.rng
        blocks, n = [], r.random()
        if self.odd and n < 0.1:  # nothing but a sentence or two
            text = " ".join(_sentence(r, 2, 12) for _ in range(r.integers(1, 3)))
            return f"<article><p>{self.own(text)}</p></article>" if r.random() < 0.6 else f"<main><p>{self.own(text)}</p></main>"
        if r.random() < 0.85:
            blocks.append(f"<h1>{self.own(' '.join(_word(r) for _ in range(r.integers(1, 9))).capitalize())}</h1>")
        for _ in range(r.integers(1, 3) if n < 0.25 else r.integers(1, 11) if n < 0.96 else r.integers(20, 80)):
            k = r.random()
            if k < 0.75:
                text = " ".join(_sentence(r, 1, 20) for _ in range(r.integers(1, 7)))
                odd = r.random()
                if odd < 0.12:
                    text = " ".join([_word(r) for _ in range(r.integers(1, 4))] * int(r.integers(1, 6)))
                elif odd < 0.2:
                    text = text.rstrip(".!?") + _pick(r, " |", "***", "$$$", "")
                if self.odd and r.random() < 0.08:
                    blocks.append(f'<p><a href="/x">{self.own(text)}</a></p>')  # a paragraph that is all link
                elif r.random() < 0.12 and " " in text:
                    a, _, b = text.partition(" ")
                    self.own(text)
                    blocks.append(f'<p><a href="/x">{a}</a> {b}</p>')
                elif r.random() < 0.3:
                    blocks.append(f"<p><b>{self.own(text)}<br>")
                else:
                    blocks.append(f"<p>{self.own(text)}</p>")
            elif k < 0.83:
                blocks.append(f"<h2>{self.own(' '.join(_word(r) for _ in range(r.integers(1, 6))).capitalize())}</h2>")
            elif k < 0.89:
                items = "".join(f"<li>{self.own(_sentence(r, 2, 12))}</li>" for _ in range(r.integers(2, 5)))
                blocks.append(f"<ul>{items}</ul>")
            elif self.odd and k < 0.91:
                items = "".join(f"<dt>{self.own(_word(r).capitalize())}{_pick(r, '', '</dt>')}<dd>{self.own(_sentence(r, 3, 20))}{_pick(r, '', '</dd>')}" for _ in range(r.integers(1, 5)))
                blocks.append(f"<dl>{items}</dl>")
            elif self.odd and k < 0.93:
                picture = _pick(r, '<img src="/a.jpg">', "", f'<a href="/big"><img src="/{_word(r)}.png" alt="{_word(r)}"></a>')
                blocks.append(f"<figure>{picture}<figcaption>{self.own(_sentence(r, 3, 14))}</figcaption></figure>")
            elif k < (0.945 if self.odd else 0.93):
                blocks.append(f"<blockquote>{self.own(_sentence(r, 5, 25))}</blockquote>")
            elif k < 0.96:
                blocks.append(f"<p>{self.own(_word(r).capitalize() + '.')}</p>")
            else:
                blocks.append(f"<table><tr><td>{self.own(_sentence(r, 1, 5))}</td><td>{self.own(_sentence(r, 1, 5))}</td></tr></table>")
        for _ in range(r.integers(0, 2)):
            blocks.insert(int(r.integers(len(blocks) + 1)), self.boilerplate())
        if self.odd and blocks[0].startswith("<h1>") and r.random() < 0.15:  # a heading of the article's own
            blocks[0] = f"<header{_pick(r, '', ' class=entry-header')}>{blocks[0]}</header>"
        if self.odd and len(blocks) > 2 and r.random() < 0.15:  # parts
            cut = int(r.integers(1, len(blocks)))
            blocks = ["<section>" + "".join(part) + "</section>" for part in (blocks[:cut], blocks[cut:])]
        inner = "".join(blocks)
        if r.random() < 0.2 and "<p><b>" not in inner:  # paragraphs that aren't called so
            open_, close = ("<div><span>", "</span></div>") if r.random() < 0.5 else ("<div>", "</div>")
            inner = inner.replace("<p>", open_).replace("</p>", close)
        if r.random() < 0.4:
            return self.unnamed(inner)
        k = r.integers(6)
        if k <= 2:
            return f"<article>{inner}</article>"
        if k == 3:
            return self.named("div section main", "content article-body post entry-content main story article", inner)
        if k == 4:
            return f"<main><article>{inner}</article></main>"
        return f"<main>{inner}</main>"


    def unnamed(self, inner: str) -> str:
        """The article in elements whose tags and names don't tell: bare, deep, in a grid or in a table."""
        r = self.rng

        def plain() -> str:
            return _pick(r, "", "", ' class="wrapper"', ' class="container"', ' class="row"', ' class="inner"', f' class="css-{_word(r)}"', f' id="{_word(r)}"')

        k = r.integers(5)
        if k == 0:
            body = inner  # right in the body
        elif k == 1:
            body = f"<table><tr><td>{self.links(r.integers(2, 8))}</td><td>{inner}</td></tr></table>"
        elif k == 2:
            other = f'<div class="{_pick(r, "col-4", "col-3", "col", "right")}">{self.links(r.integers(3, 9)) if r.random() < 0.6 else self.boilerplate()}</div>'
            parts = [f'<div class="{_pick(r, "col-8", "col-9", "col", "left")}">{inner}</div>', other]
            body = f"<div{plain()}>" + "".join(parts if r.random() < 0.5 else parts[::-1]) + "</div>"
        else:
            body = f"<div{plain()}>{inner}</div>"
        for _ in range(r.integers(0, 4) if r.random() < 0.8 else r.integers(4, 40)):
            body = f"<div{plain()}>{body}</div>"
        return f"<article>{body}</article>" if k > 2 and r.random() < 0.2 else body


def labelled_page(rng, odd: bool = False) -> tuple[str, set[str]]:
    """A page and the texts of its article's blocks.

    ``odd`` pages also have names that say nothing, notices without a name, articles of one sentence or in parts, paragraphs
    that are one link, definitions and captions.
    """
    p = _Page(rng, odd)
    parts = []
    if rng.random() < 0.4:
        parts.append(p.named("header div header", "header masthead site-header top", _pick(rng, f"<h1>{_word(rng).title()}</h1>", f"<a href='/'>{_word(rng).title()}</a>", p.blurb(2, 8)) + (f"<nav>{p.links(rng.integers(2, 7))}</nav>" if rng.random() < 0.5 else "")))
    if rng.random() < 0.8:
        parts.append(p.named("nav nav div", "nav menu navbar top-menu", p.links(rng.integers(3, 8))))
    for _ in range(rng.integers(0, 3)):
        parts.append(p.boilerplate())
    body = p.article()
    if rng.random() < 0.3:
        body = p.named("div div section", "wrapper container page row layout -", body + (p.boilerplate() if rng.random() < 0.5 else ""))
    parts.append(body)
    for _ in range(rng.integers(0, 4)):
        parts.append(p.boilerplate())
    if rng.random() < 0.85:
        parts.append(p.named("footer footer div", "footer site-footer copyright", _pick(rng, "&copy; ", "") + _word(rng) + ".example &middot; " + _sentence(rng, 3, 15)))
    head = f"<!DOCTYPE html><html><head><title>{_word(rng)}</title><style>p{{margin:0}}</style><script>var x = '</p>';</script></head><body>"
    return head + "".join(parts) + _pick(rng, "</body></html>", "", "</body>"), p.content
