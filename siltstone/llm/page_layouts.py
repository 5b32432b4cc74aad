"""Labelled pages of many layouts, by rule, for the classifier of main text (operator 8).

Words that begin with `z` are boilerplate; the classifier sees no words, only what surrounds them.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

SEED, PAGES = 20, 600
SYLLABLES = "ba ce di fo gu la me ni po ru sa te".split()
HEADER, MENU = "header masthead top-header site-header".split(), "nav menu navbar main-navigation breadcrumbs".split()
NOTICE = "cookie-consent notice alert banner gdpr-notice popup".split()
ADVERT = "ad ads advert sponsored promo advertisement".split()
SIDE, SHARE = "sidebar side-rail widget related recommended".split(), "share social-buttons sharing tags".split()
FOOTER, COMMENTS = "footer copyright legal site-footer".split(), "comments comment-list discussion replies".split()
BODY = "content post-body entry-content story article-body main-text".split()
PLAIN = "x1 col-8 row wrapper box page inner c-17 container".split()
#: Names of containers of main text that sound like boilerplate.
MISNAMED = "social-history header-story banner-image-text legal-essay menu-of-the-day share-price".split()


class Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, low: int, high: int, mark: str = "") -> str:
        # short texts are as common as long ones
        n = round(low * (high / low) ** self.rng.random())
        return " ".join(mark + "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4))) for _ in range(n))

    def maybe(self, share: float, text: str) -> str:
        return text if self.rng.random() < share else ""

    def named(self, tag: str, names: list[str], inner: str) -> str:
        name = self.rng.choice(names)
        tag = tag if tag and self.rng.random() < 0.5 else "div"
        attribute = "" if tag != "div" and self.rng.random() < 0.5 else f' {self.rng.choice(["class", "id"])}="{name}"'
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        tag = self.rng.choice(["li", "li", "span", "div"])
        items = "".join(f'<{tag}><a href="/">{self.words(1, 5, "z")}</a></{tag}>' for _ in range(self.rng.randint(low, high)))
        return f"<ul>{items}</ul>" if tag == "li" else items

    def advert(self) -> str:
        return self.named("", ADVERT, self.rng.choice([self.words(2, 30, "z") + self.rng.choice([".", "!", ""]), f'<a href="/">{self.words(2, 12, "z")}</a>', f'<p>{self.words(3, 30, "z")}.</p>']))

    def paragraph(self) -> str:
        text = self.words(1, 130)
        if self.rng.random() < 0.2:
            text = f'{text} <a href="/">{self.words(1, 6)}</a> {self.words(1, 30)}'
        tag = self.rng.choice(["p"] * 8 + ["div", "blockquote"])
        return f"<{tag}>{text}{self.rng.choice(['.', '.', '.', '?', ''])}</{tag}>"

    def body(self) -> str:
        out = [self.maybe(0.8, f"<h1>{self.words(2, 14)}</h1>"), self.maybe(0.2, f"<p>{self.words(1, 4)}</p>")]
        for _ in range(self.rng.randint(1, 14)):
            out.append(self.paragraph())
            out.append(self.maybe(0.12, f"<h2>{self.words(1, 8)}</h2>"))
            out.append(self.maybe(0.06, "<ul>" + "".join(f"<li>{self.words(2, 20)}</li>" for _ in range(self.rng.randint(2, 6))) + "</ul>"))
            out.append(self.maybe(0.05, self.advert()))
        return "".join(out)

    def main(self) -> str:
        body, pick = self.body(), self.rng.random()
        if pick < 0.4:
            return f"<article>{body}</article>"
        if pick < 0.5:
            return f"<main>{body}</main>"
        if pick < 0.7:
            return self.named("", BODY, body)
        if pick < 0.8:
            return self.named("", MISNAMED, body)
        return self.named("", PLAIN, body) if pick < 0.93 else body

    def page(self) -> str:
        z = lambda low, high: self.words(low, high, "z")
        field = f"<label>{z(1, 4)}</label><input><button>{z(1, 2)}</button>"
        before = [
            self.maybe(0.6, self.named("header", HEADER, f"<h1>{z(1, 5)}</h1><p>{z(2, 12)}</p>")),
            self.maybe(0.8, self.named("nav", MENU, self.links(3, 9))),
            self.maybe(0.3, f"<form>{field}</form>"),
            self.maybe(0.4, self.named("", NOTICE, f"<p>{z(4, 40)}.</p><button>{z(1, 2)}</button>")),
            self.maybe(0.5, self.advert()),
        ]
        after = [
            self.maybe(0.3, self.named("", SHARE, self.links(2, 5))),
            self.maybe(0.4, self.named("aside", SIDE, f"<h3>{z(1, 4)}</h3>{self.links(2, 7)}{self.maybe(0.5, f'<p>{z(4, 40)}.</p>')}")),
            self.maybe(0.3, f"<form><p>{z(4, 25)}.</p>{field}</form>"),
            self.maybe(0.4, self.named("", COMMENTS, "".join(f"<div><b>{z(1, 2)}</b><p>{z(3, 60)}.</p></div>" for _ in range(self.rng.randint(1, 5))))),
            self.maybe(0.3, self.advert()),
            self.maybe(0.8, self.named("footer", FOOTER, f"<p>&copy; {z(2, 25)}.</p>{self.maybe(0.5, self.links(2, 6))}")),
        ]
        self.rng.shuffle(before)
        inner = "".join(before) + self.main() + "".join(after)
        if self.rng.random() < 0.08:  # a form around the whole page
            inner = f'<form action="/">{inner}</form>'
        if self.rng.random() < 0.3:
            inner = f'<div class="{self.rng.choice(PLAIN)}">{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>{z(2, 8)}</title></head><body>{inner}</body></html>"


def labelled_pages(seed: int = SEED, pages: int = PAGES) -> Iterator[tuple[str, Callable[[str], bool]]]:
    """Pages, and for each a function that says of a block's text whether it is main text."""
    writer = Writer(random.Random(seed))
    for _ in range(pages):
        yield writer.page(), is_text


def is_text(block: str) -> bool:
    return not block.lstrip("\u00a9 ").startswith("z")
