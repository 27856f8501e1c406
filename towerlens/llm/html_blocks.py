"""Blocks of text of an HTML page, in page order, with the path of tags above each."""

import html
import re

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page.
SILENT = frozenset(
    "script style noscript template head title textarea select option button svg math iframe object "
    "canvas audio video map".split()
)
# Start tags that end an open element of these kinds, up to the given borders.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "body": (("head",), ()),
}
_NO_END_OF_P = INLINE | VOID | {"html", "body", "head", "li", "dt", "dd", "tr", "td", "th"} | SILENT
_HEAD_ONLY = frozenset("html head meta link base title style script noscript template".split())
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LETTERS = re.compile(r"[a-z]{2,}")
# The elements next above a block whose names are features of it.
PATH_DEPTH = 12


# A comment, a tag with its name and attributes, or another declaration. Quoted values may hold ">".
_TOKEN = re.compile(
    r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/<>]*+)((?:(?:[^<>"']++|"[^"]*+"|'[^']*+')*+|[^<>]*+))>|[!?/][^>]*+>)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S+)))?""")
# Elements whose content holds no tags; they last to their end tag, or to that of the page.
_RAW = {t: re.compile(f"</{t}\\b[^>]*>?", re.I) for t in ("script", "style", "title", "textarea", "iframe")}


class Block:
    """``path`` holds (tag, names) of the elements above, ``linked`` the share of text in links."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path, text, linked):
        self.path, self.text, self.linked = path, text, linked


def names_of(attributes):
    """Lower-case words of the class, id and role of an element."""
    out = []
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape("".join(values))
        if key in ("class", "id", "role", "itemprop"):
            out += _LETTERS.findall(_CAMEL.sub(" ", value).lower())
        elif key == "hidden" or (key == "style" and "display:none" in value.replace(" ", "")):
            out.append("hidden")
    return tuple(sorted(set(out)))


def blocks(page, known=None):
    """All blocks of a page; an open element at the end of the page is closed there.

    ``known`` may keep the names of attributes from page to page; it starts anew at 4,096.
    """
    known = {} if known is None else known
    page = page or ""
    # (tag, path to here) of open elements; the path leaves inline elements without names out.
    stack, out = [("", ())], []
    parts, linked, silent, links, paragraphs, heads = [], 0, 0, 0, 0, 0

    def flush():
        nonlocal parts, linked
        raw = "".join(parts)
        text = _SPACE.sub(" ", raw).strip()
        if text:
            out.append(Block(stack[-1][1], text, linked / len(raw)))
        parts, linked = [], 0

    def pop(at):
        nonlocal silent, links, paragraphs, heads
        for tag, _ in stack[at:]:
            silent -= tag in SILENT
            links -= tag == "a"
            paragraphs -= tag == "p"
            heads -= tag == "head"
        del stack[at:]

    def nearest(tags, borders):
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] in tags:
                return at
            if stack[at][0] in borders:
                return None
        return None

    def data(text):
        nonlocal linked
        if silent or not text:
            return
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if links:
            linked += len(text)

    at = 0
    while True:
        found = _TOKEN.search(page, at)
        if found is None:
            data(page[at:])
            flush()
            return out
        data(page[at : found.start()])
        at = found.end()
        end, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if not inline and parts:
            flush()
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                # An inline end tag without a start ends nothing around it.
                if inline and stack[i][0] not in INLINE:
                    break
            continue
        if heads and not inline and tag not in _HEAD_ONLY:
            pop(nearest(("head",), ()))
        if paragraphs and tag not in _NO_END_OF_P:
            i = nearest(("p",), ("div", "article", "section", "td", "li", "table", "body"))
            if i is not None:
                pop(i)
        if tag in _ENDS:
            i = nearest(*_ENDS[tag])
            if i is not None:
                pop(i)
        if tag in _RAW:
            close = _RAW[tag].search(page, at)
            at = close.end() if close else len(page)
        elif tag not in VOID:
            names = known.get(attributes)
            if names is None:
                names = names_of(attributes)
                if len(known) >= 4096:
                    known.clear()
                known[attributes] = names
            path = stack[-1][1]
            if names or not inline:
                path = (*path[1 - PATH_DEPTH :], (tag, names))
            stack.append((tag, path))
            silent += tag in SILENT
            links += tag == "a"
            paragraphs += tag == "p"
            heads += tag == "head"


def plain(text):
    """A text with its character references decoded and its white space made single spaces."""
    return _SPACE.sub(" ", html.unescape(text)).strip()
