"""Blocks of an HTML page: its texts between block-level tags, each with the path of elements that holds it."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

# Quotes count only right after the equals sign of an attribute, and only if they are closed. Nothing is tried twice, so
# a tag is read in one pass.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)>""")
LETTER = re.compile("[a-zA-Z]")
RAW = {t: re.compile(rf"</{t}\s*+>", re.I) for t in "script style noscript template textarea title iframe svg math object".split()}
NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no article text whatever is in them, and words of class, id and role names that say the same.
NOISE_TAGS = frozenset("nav aside footer form menu dialog button select option input label head fieldset".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus discussion dialog footer form header hidden masthead menu modal nav navbar navigation newsletter "
    "notice notices pagination pager popup promo promoted related replies respond search share sharing sidebar skip social "
    "sponsor sponsored subscribe tags toolbar widget alert".split()
)
#: Words that may stand beside a noise word in one class name, as in ``site-footer``; any other word makes it another name.
PLACES = frozenset(
    "site page global main primary secondary top bottom left right inner outer box bar block wrap wrapper container section area list item items "
    "links link post posts articles stories message text content form panel slot unit group row col column col1 col2 id".split()
)
#: Names of looks rather than of content: they say nothing beside a class name that marks content.
LOOKS = frozenset("alert header hidden search share sharing social tags widget".split())
CONTENT_NAMES = frozenset("article content entry main post story".split())
CLOSES = {"p": frozenset("p".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
          "tr": frozenset(["tr"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot tr div section article body td select".split())
ENDS_P = BLOCKS - frozenset("br button option select summary caption html head body".split())


class Block(NamedTuple):
    path: str
    noise: bool
    article: str  # path of the outermost article or main element around it, empty if there is none
    text: str
    named: bool = False  # noise by a name only, not by an element


@lru_cache(1024)
def _is_noise_name(name: str) -> str | None:
    """The noise word of a class, id or role name that is made of noise words and words of places only."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    noise = [w for w in words if w in NOISE_NAMES]
    return noise[0] if noise and all(w in NOISE_NAMES or w in PLACES for w in words) else None


def _noisy(tag: str, rest: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is noise by itself, and by its names."""
    if tag in NOISE_TAGS or tag == "header" and not in_article:
        return True, False
    if tag in ("html", "body", "main") or "=" not in rest:
        return False, False
    return False, _noisy_names(rest) if len(rest) <= 256 else _noisy_names.__wrapped__(rest)


@lru_cache(4096)
def _noisy_names(rest: str) -> bool:
    names = [n for found in NAMES.findall(rest) for n in "".join(found).lower().split()]
    found = {w for w in map(_is_noise_name, names) if w}
    if not CONTENT_NAMES.isdisjoint(names):
        found -= LOOKS
    return bool(found)


def _style(tag: str, rest: str) -> str:
    if "=" not in rest:
        return tag
    return _styled(tag, rest) if len(rest) <= 256 else _styled.__wrapped__(tag, rest)


@lru_cache(4096)
def _styled(tag: str, rest: str) -> str:
    found = NAMES.search(rest)
    return f"{tag}.{'.'.join(''.join(found.groups('')).lower().split())}" if found else tag


def tags(source: str) -> Iterator[tuple[str, str, str, str]]:
    """``(text before, "/" of an end tag, name, rest)`` in one pass; the name is empty where no element begins or ends.

    A tag, comment or raw element that the page does not close takes the rest of the page, as in a browser.
    """
    at = here = 0  # where text begins, where the search goes on
    find, match = source.find, TAG.match
    while (start := find("<", here)) >= 0:
        if m := match(source, start):
            end, tag, rest = m.groups()
            before, at, tag = source[at:start], m.end(), tag.lower()
            if tag in RAW and not end:
                if not (tag in ("svg", "math") and rest.endswith("/")):
                    close = RAW[tag].search(source, at)
                    at = close.end() if close else len(source)
                tag = ""
            yield before, end, tag, rest
            here = at
            continue
        sign = source[start + 1 : start + 2]
        letter = LETTER.match(source, start + (2 if sign == "/" else 1))
        if sign in ("!", "?") or sign == "/" and not letter:
            comment = source.startswith("<!--", start)
            close = find("-->" if comment else ">", start + 2)
            before, at = source[at:start], len(source) if close < 0 else close + (3 if comment else 1)
            yield before, "", "", ""
            here = at
        elif letter:  # a tag that no ">" ends
            yield source[at:start], "", "", ""
            return
        else:
            here = start + 1
    yield source[at:], "", "", ""


def blocks(source: str | None) -> Iterator[Block]:
    """The non-empty blocks in page order. Open elements end with the page; a block's white space is single blanks."""
    if not source:
        return
    stack: list[tuple[str, str, bool, str, bool]] = []  # tag, path, noise, article, noise by a name only
    held: list[str] = []

    def flush() -> Iterator[Block]:
        if held:
            text = SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                _, path, noise, article, named = stack[-1] if stack else ("", "", False, "", False)
                yield Block(path, noise or named, article, text, named and not noise)

    for before, end, tag, rest in tags(source):
        if before:
            held.append(before)
        if not tag:
            continue
        if tag in BLOCKS:
            yield from flush()
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in BLOCKS and any(s[0] in BLOCKS for s in stack[i:]):
                        break
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P or tag in CLOSES:
            closing = CLOSES.get(tag, frozenset()) | (CLOSES["p"] if tag in ENDS_P else frozenset())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closing:
                    del stack[i:]
                    break
                if stack[i][0] in HOLDERS:
                    break
        if rest.endswith("/") and tag not in BLOCKS:
            continue
        _, path, noise, article, named = stack[-1] if stack else ("", "", False, "", False)
        # Inline tags do not tell branches apart.
        path = f"{path}/{_style(tag, rest)}" if tag in BLOCKS else path
        inside = article or (path if tag in ("article", "main") else "")
        by_tag, by_name = _noisy(tag, rest, bool(inside))
        stack.append((tag, path, noise or by_tag, inside, named or by_name))
    yield from flush()
