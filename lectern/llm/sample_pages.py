"""Made-up web pages whose main text is known: what the block labeller of ``html_text`` is trained on."""

from __future__ import annotations

from html import escape

import numpy as np

SYLLABLES = "an on er th in re he ed st ou le la de qui en ment tion que ist und ver sch ein ich ung el los cion ar os ta bo wh ea ti or es".split()
SMALL = "the of and to in is it for with that de la le et un des die der und ist ein el los en que por".split()
NAVIGATION = "Home About Contact News Products Login Register Search Menu Archive Help Blog Shop Accueil Kontakt Inicio Impressum".split()

#: Names of classes and ids, by what the element holds.
CLASSES = {
    "menu": ["nav", "menu", "navbar", "main-nav", "navigation", "topnav", "site-menu", "breadcrumb", "breadcrumbs", "pagination", "tabs", "toc-nav"],
    "header": ["header", "site-header", "masthead", "topbar", "banner", "page-header", "logo", "branding"],
    "footer": ["footer", "site-footer", "page-footer", "copyright", "bottom", "colophon", "footer-links", "legal"],
    "sidebar": ["sidebar", "side-bar", "aside", "widget", "widgets", "secondary", "related", "related-posts", "recommended", "trending", "popular", "tags", "share", "social"],
    "notice": ["notice", "cookie-banner", "cookie-notice", "alert", "consent", "gdpr", "message", "popup", "modal", "warning", "announcement", "paywall"],
    "ad": ["ad", "ads", "advert", "advertisement", "ad-box", "adsbygoogle", "sponsored", "sponsor", "promo", "promotion", "banner-ad", "ad-slot"],
    "share": ["share", "social", "share-buttons", "social-links", "sharing", "tags", "post-tags", "follow", "share-bar", "post-nav"],
    "form": ["search", "search-form", "newsletter", "subscribe", "signup", "login", "contact-form", "form"],
    "comments": ["comments", "comment-list", "commentlist", "discussion", "replies", "comment-section", "responses", "disqus"],
    "main": ["content", "main", "main-content", "post", "entry", "entry-content", "article", "article-body", "story", "text", "post-content", "body", "page"],
    "none": ["c1", "box", "col", "row", "x7", "wrap", "container", "inner", "block", "panel", "section", "grid", "left", "right"],
}


class Writer:
    def __init__(self, rng: np.random.Generator):
        self.rng, self.kept = rng, set()
        self.plain = rng.random() < 0.08  # class names that tell nothing
        self.sloppy = rng.random() < 0.4
        self.noise = str(rng.choice(["", "", "", "&&& ", "### ", "*** "]))

    def pick(self, *xs):
        return xs[int(self.rng.integers(len(xs)))]

    def word(self) -> str:
        if self.rng.random() < 0.3:
            return self.pick(*SMALL)
        return "".join(self.rng.choice(SYLLABLES, int(self.rng.integers(1, 5))))

    def sentence(self, low: int = 2, high: int = 18) -> str:
        words = [self.word() + ("," if self.rng.random() < 0.06 else "") for _ in range(int(self.rng.integers(low, high)))]
        if self.noise and self.rng.random() < 0.7:
            words = [w + self.noise.strip() if self.rng.random() < 0.5 else w for w in words]
        return (" ".join(words).capitalize() + ".").replace(",.", ".")

    def prose(self) -> str:
        x = self.rng.random()
        if x < 0.03:  # one word again and again, or a list on one line
            return " ".join([self.word()] * int(self.rng.integers(5, 120)))
        if x < 0.06:
            return self.pick(" | ", " * ", " ; ").join(self.word() for _ in range(int(self.rng.integers(5, 120))))
        n = 1 if self.rng.random() < 0.25 else int(self.rng.integers(1, 7))
        return " ".join(self.sentence(1 if self.rng.random() < 0.2 else 3) for _ in range(n))

    def attributes(self, kind: str, chance: float = 1.0) -> str:
        if self.rng.random() > chance:
            return ""
        name = self.pick(*CLASSES["none" if self.plain else kind])
        if self.rng.random() < 0.15:
            name += " " + self.pick(*CLASSES["none"])
        return f' {self.pick("class", "class", "class", "id")}="{name}"'

    def inline(self, text: str) -> str:
        """Markup inside a text."""
        words = [escape(w, quote=self.rng.random() < 0.5) for w in text.split(" ")]
        for _ in range(int(self.rng.integers(0, 3))):
            k = int(self.rng.integers(len(words)))
            words[k] = self.pick("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>", "<code>{}</code>", "<strong>{}</strong>").format(words[k])
        return self.pick(" ", " ", " ", "\n  ").join(words)

    def main(self, tag: str, text: str) -> str:
        self.kept.add(" ".join(text.split()))
        if tag == "p" and self.sloppy and self.rng.random() < 0.3:
            return f"<p><b>{escape(text)}<br>" if self.rng.random() < 0.4 else f"<p>{self.inline(text)}"
        return f"<{tag}{self.attributes('none', 0.08)}>{self.inline(text)}</{tag}>"

    def links(self, n: int) -> str:
        items = []
        for _ in range(n):
            name = self.pick(*NAVIGATION) if self.rng.random() < 0.4 else " ".join(self.word() for _ in range(int(self.rng.integers(1, 6))))
            items.append(f'<a href="/{name[:4]}">{name}</a>')
        form = self.rng.random()
        if form < 0.7:
            return "<ul>" + "".join(f"<li>{x}" + ("</li>" if not self.sloppy else "") for x in items) + "</ul>"
        return self.pick(" | ", " ", "<br>").join(items) if form < 0.85 else "".join(f"<div>{x}</div>" for x in items)

    def menu(self) -> str:
        tag = self.pick("nav", "nav", "div", "ul") if not self.plain else self.pick("nav", "div")
        inner = self.links(int(self.rng.integers(2, 9)))
        return f"<{tag}{self.attributes('menu', 0.5 if tag == 'nav' else 1)}>{inner}</{tag}>"

    def header(self) -> str:
        tag = self.pick("header", "header", "div")
        inner = self.pick("<h1>{}</h1>", "<p>{}</p>", "<div>{}</div>", '<a href="/">{}</a>', "{}").format(self.sentence(1, 7))
        inner += f"<p>{self.sentence()}</p>" if self.rng.random() < 0.3 else ""
        return f"<{tag}{self.attributes('header', 0.4 if tag == 'header' else 1)}>{inner}{self.menu() if self.rng.random() < 0.4 else ''}</{tag}>"

    def footer(self) -> str:
        tag = self.pick("footer", "footer", "div")
        start = self.pick("&copy; ", "&copy; 2024 ", "Copyright ", "") if not self.plain else "&copy; "
        inner = start + self.pick("example.com", self.word()) + self.pick(" &middot; ", " - ", " ") + self.prose()
        inner = f"<p>{inner}</p>" if self.rng.random() < 0.4 else inner
        return f"<{tag}{self.attributes('footer', 0.3 if tag == 'footer' else 1)}>{inner}{self.links(3) if self.rng.random() < 0.3 else ''}</{tag}>"

    def sidebar(self) -> str:
        tag = self.pick("aside", "aside", "div")
        inner = (f"<h3>{self.sentence(1, 4)}</h3>" if self.rng.random() < 0.6 else "") + (self.links(4) if self.rng.random() < 0.6 or self.plain else "".join(f"<p>{self.prose()}</p>" for _ in range(int(self.rng.integers(1, 3)))))
        return f"<{tag}{self.attributes('sidebar', 0.4 if tag == 'aside' else 1)}>{inner}</{tag}>"

    def notice(self) -> str:
        text = self.pick("We use cookies. ", "Please accept our terms. ", "", "") + self.prose()
        inner = self.pick("{}", "<p>{}</p>", "<span>{}</span>", "<strong>{}</strong>").format(text) + self.pick("", "<button>Accept</button>", "<button>OK</button>")
        return f"<{self.pick('div', 'section', 'aside', 'p') if not self.plain else 'aside'}{self.attributes('notice')}>{inner}</div>"

    def advert(self) -> str:
        tag = self.pick("div", "div", "aside", "section", "ins")
        inner = self.pick("{}", "<p>{}</p>", '<a href="/ad">{}</a>', "<b>{}</b>").format(self.prose())
        if self.plain:
            inner = f'<a href="/ad">{self.sentence()}</a>'
        return f"<{'div' if tag == 'ins' else tag}{self.attributes('ad')}>{inner}</{'div' if tag == 'ins' else tag}>"

    def share(self) -> str:
        inner = self.pick(" ", " | ", "").join(f'<a href="#">{" ".join(self.word() for _ in range(int(self.rng.integers(1, 4))))}</a>' for _ in range(int(self.rng.integers(1, 6))))
        return f"<div{self.attributes(self.pick('share', 'none'))}>{inner}</div>"

    def form(self) -> str:
        inner = f"<label>{self.sentence(1, 4)}</label><input type=text><button>{self.word()}</button>" + (f"<p>{self.sentence()}</p>" if self.rng.random() < 0.4 else "")
        inner = f"<form{self.attributes('form', 0.5)}>{inner}</form>"
        return f"<div{self.attributes('form')}>{inner}</div>" if self.rng.random() < 0.3 else inner

    def comments(self) -> str:
        def one() -> str:
            name = f"<{(t := self.pick('b', 'h4', 'span', 'cite', 'div'))}>{self.word().capitalize()}</{t}>" if self.rng.random() < 0.6 else ""
            return name + "".join(f"<p>{self.prose()}</p>" for _ in range(int(self.rng.integers(1, 3)))) + self.pick("", "", '<a href="#r">Reply</a>')

        style = self.rng.random()
        n = int(self.rng.integers(1, 6))
        if style < 0.4:
            inner = "<ol>" + "".join(f"<li class=\"comment\">{one()}</li>" for _ in range(n)) + "</ol>"
        elif style < 0.8:
            inner = "".join(f'<{(t := self.pick("div", "div", "article"))} class="{self.pick("comment", "reply", "comment-body")}">{one()}</{t}>' for _ in range(n))
        else:
            inner = "".join(one() for _ in range(n))
        keep, self.plain = self.plain, False
        out = f"<{(t := self.pick('section', 'div', 'div'))}{self.attributes('comments')}>{self.pick('', f'<h3>{self.sentence(1, 3)}</h3>')}{inner}{self.form() if self.rng.random() < 0.2 else ''}</{t}>"
        self.plain = keep
        return out

    def body(self) -> str:
        """The blocks of the main text, with what may stand between them."""
        out = []
        if self.rng.random() < 0.85:
            title = self.main("h1", self.sentence(1, 12))
            out.append(f"<header>{title}</header>" if self.rng.random() < 0.1 else title)
        for _ in range(int(self.rng.integers(1, 14))):
            x = self.rng.random()
            if x < 0.72:
                out.append(self.main("p", self.prose()))
            elif x < 0.8:
                out.append(self.main(self.pick("h2", "h3"), self.sentence(1, 8)))
            elif x < 0.86:
                out.append(f"<{(t := self.pick('ul', 'ol'))}>" + "".join(self.main("li", self.sentence()) for _ in range(int(self.rng.integers(1, 6)))) + f"</{t}>")
            elif x < 0.89:
                out.append(f"<blockquote>{self.main('p', self.prose())}</blockquote>")
            elif x < 0.91:
                out.append(self.main("pre", self.sentence()))
            elif x < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(self.main("td", self.sentence(1, 5)) for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            elif x < 0.95:
                out.append(self.main("div", self.prose()))
            else:
                out.append(self.pick(self.advert, self.advert, self.sidebar, self.notice, self.form, self.share, self.share)())
        return "".join(out)

    def page(self) -> str:
        inner = self.body()
        tag = self.pick("article", "article", "main", "div", "section")
        if tag == "section" or tag == "div":
            inner = f"<{tag}{self.attributes('main')}>{inner}"
        else:
            inner = f"<{tag}{self.attributes('main', 0.4)}>{inner}"
        if self.rng.random() < 0.12:
            inner += self.pick(self.footer, self.sidebar, self.comments)()
        inner += f"</{tag}>"
        if self.rng.random() < 0.3:
            outer = self.pick("main", "div")
            inner = f"<{outer}{self.attributes('none', 0.5)}>{self.advert() if self.rng.random() < 0.2 else ''}{inner}{self.sidebar() if self.rng.random() < 0.3 else ''}{self.comments() if self.rng.random() < 0.2 else ''}</{outer}>"
        before = [f() for f, p in ((self.notice, 0.2), (self.header, 0.4), (self.menu, 0.8), (self.form, 0.15), (self.advert, 0.5), (self.sidebar, 0.15), (self.menu, 0.15)) if self.rng.random() < p]
        after = [f() for f, p in ((self.sidebar, 0.25), (self.comments, 0.3), (self.advert, 0.15), (self.form, 0.15), (self.menu, 0.1), (self.footer, 0.85), (self.notice, 0.15)) if self.rng.random() < p]
        comment = "<!-- ad 3 -->" if self.rng.random() < 0.4 else ""
        head = f"<head><meta charset=utf-8><title>{self.sentence()}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";track(1);</script></head>"
        html = f"<!DOCTYPE html><html>{head if self.rng.random() < 0.9 else ''}<body>{self.pick('', ' ', chr(10)).join([*before, comment, inner, *after])}</body></html>"
        return html[: int(len(html) * (0.4 + 0.6 * self.rng.random()))] if self.rng.random() < 0.08 else html


def sample_page(rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page, and the texts of its main blocks."""
    w = Writer(rng)
    return w.page(), w.kept
