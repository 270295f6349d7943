"""A web page as blocks of visible text, each with the part of the page it stands in.

Tags are read leniently: an end tag closes the nearest open element of its name and all inside it, one
without a partner is skipped, and what is never closed ends with the page.  Character references are
decoded, white space inside a block becomes one space, and tags of no known meaning end a block.
"""

from __future__ import annotations

import re
from html import unescape

#: Comments, declarations, and tags with quoted attributes; a ``<`` before anything else is text.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Fixed names of HTML: elements whose content is no text, elements without content, and elements inside a line.
RAW = frozenset("script style noscript template textarea iframe object svg math title select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements, roles, and words in classes and ids that mark what is not part of the article.
APART = frozenset("nav header footer aside form dialog menu button".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu header footer sidebar aside "
    "cookie cookies consent notice notices banner newsletter subscribe comment comments breadcrumb breadcrumbs related share sharing social "
    "widget popup modal login search pagination toolbar".split()
)
#: Before such a word a name says what a container has, not what it is.
_HAVING = frozenset("no has with without".split())

#: Where a block stands: apart from the article, unmarked, in the main part, in an article.
ASIDE, PLAIN, MAIN, ARTICLE = 0, 1, 2, 3


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text else {}


def _named_apart(value: str) -> bool:
    for name in value.split():
        words = [w.lower() for w in _NAME_PART.findall(name)]
        if any(w in NAMES and not (i and words[i - 1] in _HAVING) for i, w in enumerate(words)):
            return True
    return False


def _zone(tag: str, text: str, outer: int) -> int:
    """The part of the page that an element opens inside another part."""
    own = _attributes(text)
    if outer == ASIDE:
        return ASIDE
    if tag in APART or own.get("role", "").lower() in ROLES or "hidden" in own:
        return ASIDE
    if tag not in ("html", "body") and _named_apart(f"{own.get('class', '')} {own.get('id', '')}"):
        # the outermost article is not put apart by its class; comments and teasers are articles in an article
        if not (tag in ("article", "main") and outer != ARTICLE):
            return ASIDE
    if tag == "article" or own.get("itemprop") == "articleBody":
        return ARTICLE
    if tag == "main" or own.get("role", "").lower() == "main":
        return max(outer, MAIN)
    return outer


def blocks(html: str) -> list[tuple[int, str]]:
    """(zone, text) of every block in page order, empty ones left out."""
    found: list[tuple[int, str]] = []
    text: list[str] = []
    open_: list[tuple[str, int]] = []
    zone, at, end = PLAIN, 0, len(html)

    def close() -> None:
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                found.append((zone, line))
            text.clear()

    while at < end:
        mark = _MARKUP.search(html, at)
        if mark is None:
            text.append(html[at:])
            break
        if mark.start() > at:
            text.append(html[at : mark.start()])
        at = mark.end()
        tag = mark[2] or mark[5]
        if tag is None:
            continue  # a comment or declaration
        tag, rest, closes = tag.lower(), mark[3] or mark[6] or "", mark[1] or mark[4]
        if tag in RAW:
            if not closes and not rest.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = stop.end() if stop else end
            continue
        if tag in VOID:
            if tag not in INLINE:
                text.append(" ") if tag == "br" else close()
            continue
        if closes:
            level = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), None)
            if level is None:
                if tag not in INLINE:
                    close()
                continue
            outer = open_[level][1]
            if tag not in INLINE or outer != zone:
                close()
            del open_[level:]
            zone = outer
            continue
        inner = _zone(tag, rest, zone)
        if tag not in INLINE or inner != zone:
            close()
        if rest.endswith("/") and tag not in INLINE and "=" not in rest[-2:]:
            continue  # closed at once
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and open_ and open_[-1][0] == tag:
            zone = open_.pop()[1]  # its end tag may be left out
            inner = _zone(tag, rest, zone)
        open_.append((tag, zone))
        zone = inner
    close()
    return found


def split(html: str) -> tuple[list[str] | None, list[tuple[bool, str]]]:
    """Blocks of the article or else of the main part, None where the page has neither, and all other blocks.

    The others tell whether they are marked as apart from the article.
    """
    found = blocks(html)
    best = max((z for z, _ in found), default=PLAIN)
    if best <= PLAIN:
        return None, [(z == ASIDE, t) for z, t in found]
    return [t for z, t in found if z == best], [(z == ASIDE, t) for z, t in found if z != best]
