"""Raw HTML as a stream of tags and stretches of text, each with what it stands in."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|[^<]+|<",
    re.DOTALL,
)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody tfoot "
    "thead tr ul".split()
)
#: Elements that never hold a page's main text.
ASIDE = frozenset(
    "aside button dialog fieldset footer form head iframe input label legend menu nav noscript object optgroup option "
    "script select style svg template textarea title".split()
)
#: Words of class, id and role values that say the same of any element.
ASIDE_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies dialog disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination popup promo recommended related replies reply respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe toc toolbar widget".split()
)
#: Words that only say where or in what form, beside which such a name still means the same ("nav-left", "comment-list").
PLACE_NAMES = frozenset(
    "area bar body bottom box button buttons center column container content fixed float footer form global group head "
    "header holder home icons inner item items layout left line link links list main mobile module outer page panel "
    "primary right row secondary section site slot sticky sub tab text title top unit wrap wrapper".split()
)
#: Names of what readers have written, also where an element marks it as an article.
READER_NAMES = frozenset("comment comments disqus replies reply respond".split())
MAIN = frozenset(("article", "main"))
#: A start tag of the key ends an open element of these, with no end tag of its own.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Piece(NamedTuple):
    """A tag (``tag`` set, with a slash in front of an end tag) or a stretch of text."""

    tag: str
    text: str
    block: str  # the block element that it stands in
    link: bool  # inside a link
    main: bool  # inside an article or main element
    aside: bool  # inside navigation, a form, an advert, or the like


def _named(attributes: str, words: frozenset[str]) -> bool:
    """Whether a class, id or role is one of the words, alone or with words of place ("site-footer")."""
    for values in _NAMED.findall(attributes):
        for name in "".join(values).split():
            parts = {part.lower() for part in _PART.findall(name)}
            if not words.isdisjoint(parts) and parts <= words | PLACE_NAMES:
                return True
    return False


def _set_aside(name: str, attributes: str, main: bool) -> bool:
    if name in ASIDE or (name == "header" and not main):
        return True
    if "=" not in attributes or name in ("html", "body", "main", "p", "h1"):
        return False
    if name == "article":
        return _named(attributes, READER_NAMES)
    # The head of an article holds its title.
    return _named(attributes, ASIDE_NAMES - {"header"} if main else ASIDE_NAMES)


def pieces(page: str) -> Iterator[Piece]:
    """The tags and texts of a page in order; comments, declarations, scripts and styles have none."""
    open_elements: list[tuple[str, str, bool, bool, bool]] = []
    n_open: Counter[str] = Counter()
    block, link, main, aside = "body", False, False, False
    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.match(page, at)
        at = token.end()
        name = token[2]
        if name is None:
            if page.startswith(("<!", "<?"), token.start()):
                continue
            yield Piece("", html.unescape(token[0]), block, link, main, aside)
            continue
        name = name.lower()
        if token[1]:
            # Without a start it ends nothing; otherwise what is left behind is passed once and gone.
            ends = n_open[name] > 0
            while ends:
                last, block, link, main, aside = open_elements.pop()
                n_open[last] -= 1
                ends = last != name
            yield Piece("/" + name, "", block, link, main, aside)
            continue
        if name in VOID:  # a slash before the end of any other start tag has no meaning
            yield Piece(name, "", block, link, main, aside)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        ended = _ENDS.get(name, ())
        if name in BLOCK and open_elements and open_elements[-1][0] == "p":
            ended = {"p"}
        if open_elements and open_elements[-1][0] in ended:
            last, block, link, main, aside = open_elements.pop()
            n_open[last] -= 1
        yield Piece(name, "", block, link, main, aside)
        open_elements.append((name, block, link, main, aside))
        n_open[name] += 1
        block = name if name in BLOCK else block
        link = link or name == "a"
        aside = aside or _set_aside(name, token[3], main)
        main = main or name in MAIN


def blocks(parts: Iterator[Piece]) -> list[str]:
    """The texts between block tags, white space inside a block made one space, empty blocks left out."""
    out, current = [], []
    for piece in parts:
        if not piece.tag:
            current.append(piece.text)
        elif piece.tag.lstrip("/") in BLOCK:
            out.append(" ".join("".join(current).split()))
            current = []
        elif piece.tag in ("br", "td", "th", "/td", "/th", "img"):
            current.append(" ")
    out.append(" ".join("".join(current).split()))
    return [b for b in out if b]
