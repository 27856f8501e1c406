"""Labelled pages to train the block labeller on, put together by rule from kinds of parts.

A page is a list of parts such as a menu, an advert, a comment or a paragraph of the article. Each
part picks its elements, class names and length from those that such parts often have; some pages
have telling names only, some telling elements only, some neither. Words are made of syllables, so
texts tell little but their length and signs; a few words that parts of pages share are mixed in.
"""

import random

_SYLLABLES = "an be co de en fi ga ho in ka le mo na or pe qu ra si ta un ve wi zo ch er st ou é ü ñ a i o".split()

# Names that elements of a kind carry, and words that their texts may hold.
NAMES = {
    "menu": "nav navbar menu main-menu topnav navigation site-nav breadcrumb breadcrumbs pagination tabs toc skip-links",
    "header": "header site-header masthead banner top-bar branding logo page-header hero-header",
    "footer": "footer site-footer bottom colophon copyright legal page-footer foot-links",
    "aside": "sidebar aside widget related rail right-column left-col secondary recommended more-stories trending tag-cloud",
    "notice": "cookie cookie-banner notice alert gdpr consent popup modal newsletter-popup warning message disclaimer paywall",
    "advert": "ad ads advert advertisement sponsored promo banner-ad ad-slot adsense promotion sponsor commercial",
    "form": "form search-form login subscribe newsletter contact-form signup poll survey",
    "comments": "comments comment comment-list commentlist disqus replies reply discussion user-comments responses comment-body",
    "share": "share social share-buttons social-links sharing follow tools print-links",
    "main": "article content post entry main story article-body post-content entry-content main-content body-text text page-content",
    "none": "row col container wrapper inner box block clearfix grid section x1 c7 left wide l-main module unit item group",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
WORDS = {
    "menu": "Home About Contact Products Next Previous Start Accueil Inicio Startseite".split(),
    "header": "Welcome Login Language Home".split(),
    "footer": "&copy; Copyright 2024 Privacy Terms Imprint All rights reserved &middot;".split(),
    "aside": "Related Popular Tags Archive Recent More Latest".split(),
    "notice": "We use cookies Accept Agree settings privacy consent".split(),
    "advert": "Sponsored Buy now Advertisement Offer Sale %".split(),
    "form": "Name E-mail Subscribe Search Send Password".split(),
    "comments": "Reply says Comments ago Posted by user report".split(),
    "share": "Share Tweet Print E-mail Facebook Follow".split(),
}
_ELEMENTS = {"menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}


VOCABULARY = 5_000


class Maker:
    """Makes pages as (html, [(text of a block, is it part of the article)])."""

    def __init__(self, seed):
        self.draw = random.Random(seed)
        self.words = ["".join(self.draw.choices(_SYLLABLES, k=self.draw.randint(1, 4))) for _ in range(VOCABULARY)]

    def sentence(self, least, most, kind=None):
        words = self.draw.choices(self.words, k=self.draw.randint(least, most))
        if kind and self.draw.random() < 0.6:
            for _ in range(self.draw.randint(1, 3)):
                words.insert(self.draw.randint(0, len(words)), self.draw.choice(WORDS[kind]))
        words[0] = words[0].capitalize()
        for i in range(self.draw.randrange(12), len(words) - 1, 12):
            words[i] += ","
        return " ".join(words)

    def prose(self, least=1, most=7):
        return " ".join(self.sentence(3, 22) + self.draw.choice(("." * 6 + "?!")) for _ in range(self.draw.randint(least, most)))

    def short(self):
        """A few words, now and then with signs between them."""
        words = self.sentence(1, 12).split()
        if self.draw.random() < 0.3:
            sign = self.draw.choice(("|", "***", "###", "&amp;", "%", "-"))
            words = [w + self.draw.choice(("", "", sign, " " + sign)) for w in words]
        return " ".join(words) + self.draw.choice((".", ".", "!", ":", ""))

    def names(self, kind):
        """Attributes of an element of a kind; empty, neutral or telling by the page's habit."""
        chance = self.draw.random()
        found = []
        if chance < self.telling:
            found.append(self.draw.choice(NAMES[kind]))
        if self.draw.random() < 0.35:
            found.insert(self.draw.randint(0, len(found)), self.draw.choice(NAMES["none"]))
        if not found:
            return ""
        key = "id" if self.draw.random() < 0.2 else "class"
        value = " ".join(found)
        if self.draw.random() < 0.15:
            value = value.title().replace("-", "").replace(" ", "-")
        return f' {key}="{value}"'

    def element(self, kind):
        return _ELEMENTS.get(kind, "div") if self.draw.random() < self.semantic else self.draw.choice(("div", "div", "section"))

    def add(self, tag, text, wanted=False, attrs=""):
        if self.draw.random() < 0.1 and " " in text:
            cut = text.index(" ")
            inline = self.draw.choice(("b", "i", "em", "strong", 'a href="/x"', "span"))
            body = f"<{inline}>{text[:cut]}</{inline.split()[0]}>{text[cut:]}"
        else:
            body = text
        end = "" if tag in ("p", "li") and self.draw.random() < 0.05 else f"</{tag}>"
        self.out.append(f"<{tag}{attrs}>{body}{end}")
        self.labels.append(wanted)

    def links(self, kind):
        self.out.append("<ul>")
        for _ in range(self.draw.randint(2, 9)):
            self.out.append("<li>")
            self.add("a", self.sentence(1, 4, kind), attrs=' href="/x"')
            self.out.append("</li>")
        self.out.append("</ul>")

    def part(self, kind):
        tag = self.element(kind)
        self.out.append(f"<{tag}{self.names(kind)}>")
        if kind in ("menu", "share"):
            self.links(kind)
        elif kind == "header":
            self.add(self.draw.choice(("div", "h1", "p", "span")), self.sentence(1, 6, kind))
            if self.draw.random() < 0.4:
                self.links("menu")
        elif kind == "footer":
            for _ in range(self.draw.randint(1, 3)):
                self.add(self.draw.choice(("p", "div")), self.sentence(2, 14, kind) + ".")
            if self.draw.random() < 0.3:
                self.links("menu")
        elif kind == "aside":
            for _ in range(self.draw.randint(1, 3)):
                self.add(self.draw.choice(("h2", "h3", "h4", "div")), self.sentence(1, 4, kind))
                if self.draw.random() < 0.6:
                    self.links(kind)
                else:
                    self.add("p", self.prose(1, 2))
        elif kind in ("notice", "advert"):
            if self.draw.random() < 0.3:
                self.add(self.draw.choice(("h3", "strong", "div")), self.sentence(1, 4, kind))
            self.add(self.draw.choice(("p", "div", "span")), self.sentence(3, 25, kind) + self.draw.choice((".", "!", "")))
        elif kind == "form":
            for _ in range(self.draw.randint(1, 4)):
                self.add(self.draw.choice(("label", "p", "div", "legend")), self.sentence(1, 5, kind))
                self.out.append('<input type="text" name="q">')
            self.out.append("<button>Send</button>")
        elif kind == "comments":
            if self.draw.random() < 0.7:
                self.add(self.draw.choice(("h2", "h3")), self.sentence(1, 3, kind))
            for _ in range(self.draw.randint(1, 6)):
                inner = self.draw.choice(("div", "div", "li", "article"))
                self.out.append(f"<{inner}{self.names('comments')}>")
                if self.draw.random() < 0.7:
                    self.add(self.draw.choice(("span", "b", "div", "cite")), self.sentence(1, 4, kind))
                    self.out.append("<br>")
                self.add(self.draw.choice(("p", "p", "div")), self.prose(1, 4))
                self.out.append(f"</{inner}>")
        self.out.append(f"</{tag}>")

    def article(self):
        choice, depth = self.draw.random(), 0
        tags = []
        if choice < self.semantic:
            tags.append(self.draw.choice(("article", "article", "main")))
        if choice >= self.semantic or self.draw.random() < 0.3:
            tags.append(self.draw.choice(("div", "div", "section", "td")) if choice >= self.semantic else "div")
        for tag in tags:
            self.out.append("<table><tr><td>" if tag == "td" else f"<{tag}{self.names('main')}>")
        if self.draw.random() < 0.8:
            self.add(self.draw.choice(("h1", "h1", "h2")), self.sentence(2, 14), True)
        for _ in range(self.draw.choice((0, 1, 2, 3, 5, 8, 14, 25))):
            kind = self.draw.random()
            if kind < 0.56:
                self.add("p", self.prose(), True)
            elif kind < 0.72:
                self.add("p", self.short(), True)
            elif kind < 0.80:
                self.add(self.draw.choice(("h2", "h3", "h4")), self.sentence(1, 8), True)
            elif kind < 0.85:
                tag = self.draw.choice(("ul", "ol"))
                self.out.append(f"<{tag}>")
                for _ in range(self.draw.randint(2, 6)):
                    self.add("li", self.sentence(2, 16), True)
                self.out.append(f"</{tag}>")
            elif kind < 0.88:
                self.add(self.draw.choice(("blockquote", "pre")), self.prose(1, 3), True)
            elif kind < 0.90:
                self.out.append("<table>")
                for _ in range(self.draw.randint(2, 5)):
                    self.out.append("<tr>")
                    for _ in range(3):
                        self.add("td", self.sentence(1, 4), True)
                    self.out.append("</tr>")
                self.out.append("</table>")
            elif kind < 0.92:
                self.out.append("<p><b>")
                self.labels += [True, True]
                self.out.append(f"{self.prose(1, 2)}<br>{self.prose(1, 2)}")
                self.out.append("</p>" if self.draw.random() < 0.5 else "")
            else:
                self.part(self.draw.choice(("advert", "share", "form", "aside", "notice")))
        else:
            if self.draw.random() < 0.9:
                self.add("p", self.prose(1, 5), True)
        for tag in reversed(tags):
            self.out.append("</td></tr></table>" if tag == "td" else f"</{tag}>")

    def page(self):
        self.out, self.labels = ["<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>"], []
        self.semantic = self.draw.choice((0, 0.3, 0.8, 1))
        self.telling = self.draw.choice((0.3, 0.7, 0.95)) if self.semantic < 0.5 else self.draw.choice((0, 0.5, 0.95))
        if self.draw.random() < 0.04:
            self.out = []
            for _ in range(self.draw.randint(1, 4)):
                self.out.append(self.prose() + "<br>")
                self.labels.append(True)
            return "".join(self.out), self.labels
        before = [k for k in ("notice", "header", "menu", "advert", "form", "aside", "menu") if self.draw.random() < 0.45]
        after = [k for k in ("share", "advert", "aside", "comments", "form", "menu", "notice") if self.draw.random() < 0.4]
        wrapped = self.draw.random() < 0.4
        if self.draw.random() < 0.2:
            self.draw.shuffle(before)
        for kind in before:
            self.part(kind)
        if wrapped:
            self.out.append(f"<div{self.names('none')}>")
        if self.draw.random() < 0.95 or not before + after:
            self.article()
        for kind in after:
            self.part(kind)
        if wrapped:
            self.out.append("</div>")
        if self.draw.random() < 0.75:
            self.part("footer")
        self.out.append("</body></html>")
        if self.draw.random() < 0.1:  # a part of a page
            self.out = self.out[1:-1]
        return "".join(self.out), self.labels
