"""Text runs of a page: what a reader sees, block by block, and which element each stands in.

Markup is read leniently: elements that HTML closes by itself (paragraphs, list items, cells) are closed, stray end tags are passed over, comments, declarations, scripts
and the like leave no run, a tag cut off by the end of the page is dropped. A run's place is known by the path of its block elements with their classes.

Elements say by their tag, role or names what they are. OUT are menus, headers, footers, sidebars, notices, adverts, forms, comments and whatever is not shown; MAIN and
ARTICLE hold the page's own text. Inside OUT nothing counts any more, but for the headings in the header of an article.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from typing import NamedTuple

import xxhash

OUT, NONE, MAIN, ARTICLE = -1, 0, 1, 2
TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAMING = re.compile(r"\b(?:class|id|role|hidden|style|itemprop|aria-hidden)\b", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form head header hgroup hr html label legend li main menu nav "
    "noscript object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul".split()
)
#: What an element closes when it begins, and the elements beyond which it closes nothing.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
CELLS = frozenset("table td th caption button object template".split())
OUT_TAGS = frozenset("aside audio button canvas dialog fieldset footer form head iframe input label legend map math menu nav noscript object search select svg template textarea video".split())
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status tablist toolbar tooltip".split())
#: Last words of names.
OUT_WORDS = frozenset(
    "ad ads advert advertisement advertisements advertising adverts adsense alert announcement aside banner bar breadcrumb breadcrumbs bottombar colophon comment comments commentlist consent cookie cookies copyright discussion disclaimer "
    "disqus feedback flash footer footnotes form forms gdpr header imprint legal links login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promos promotion "
    "promoted rail recommendations recommended registration related replies reply respond reviews search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription survey teaser toast toolbar topbar "
    "trending warning widget widgets".split()
)
#: Words that say so wherever they stand in a name.
OUT_ANYWHERE = frozenset("ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu nav navbar navigation newsletter popup promo related share sidebar social sponsor sponsored subscribe".split())
#: Names of the page's own text are made of these words alone: one of the first or second kind, and any of the third.
ARTICLE_WORDS, MAIN_WORDS = frozenset("article blogpost entry post story".split()), frozenset("content main".split())
BESIDES = frozenset("area blog body center column container copy detail details full inner left news outer page primary right section single site text view wrap wrapper".split())
#: Last words of names of frames around several parts.
FRAMES = frozenset("container frame grid layout outer page row wrap wrapper".split())
#: Words before which a name tells of something else than the element itself.
ABOUT = frozenset("has with no without is hide show".split())


class Run(NamedTuple):
    state: int
    place: str
    text: str


@lru_cache(8192)
def named(name: str, attributes: str) -> tuple[int, str]:
    """What an element's attributes say, and its classes for the path."""
    found = {a.lower(): html.unescape(x or y or z or "") for a, x, y, z in ATTRIBUTE.findall(attributes)}
    classes = sorted(re.sub(r"\d+", "0", found.get("class", "")).split())
    path = name + "".join(f".{c}" for c in classes)
    style = re.sub(r"\s", "", found.get("style", "").lower())
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return OUT, path
    roles = set(found.get("role", "").lower().split())
    if roles & OUT_ROLES:
        return OUT, path
    says = NONE
    for own in [*found.get("class", "").split(), found.get("id", "")]:
        words = [w.lower() for w in WORD.findall(own)]
        if not words or set(words) & ABOUT:
            continue
        comment = bool(set(words) & {"comment", "comments", "commentlist"})
        around = words[-1] in FRAMES and set(words) & MAIN_WORDS
        if comment or name not in ("html", "body", "article", "main") and (words[-1] in OUT_WORDS or set(words) & OUT_ANYWHERE and not around):
            return (OUT if name not in ("html", "body") else NONE), path
        if set(words) <= ARTICLE_WORDS | MAIN_WORDS | BESIDES:
            says = max(says, ARTICLE if set(words) & ARTICLE_WORDS else MAIN if set(words) & MAIN_WORDS else NONE)
    if "article" in roles or found.get("itemprop", "").lower() == "articlebody":
        says = ARTICLE
    elif "main" in roles:
        says = max(says, MAIN)
    return (NONE if name in ("html", "body") else says), path


def runs(page: str) -> list[Run]:
    """The runs of a page in their order: white space is one space, character references are decoded. None of them is empty."""
    out, buffer = [], []
    #: Name, state, path, and the state of headings inside where that differs.
    stack: list[tuple[str, int, str, int | None]] = [("", NONE, "", None)]

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append(Run(stack[-1][1], stack[-1][2], text))

    def close(names: frozenset | set, bounds: frozenset | set) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                flush()
                del stack[k:]
                return
            if stack[k][0] in bounds:
                return

    at = 0
    while m := TAG.search(page, at):
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        block = name in BLOCKS
        if m[1]:
            if name == "br" or name == "p" and not any(e[0] == "p" for e in stack):
                flush()
            for k in range(len(stack) - 1, 0, -1):
                own = stack[k][0]
                if own == name:
                    if block or stack[k][1] != stack[k - 1][1]:
                        flush()
                    del stack[k:]
                    break
                if own in BLOCKS and (not block or own in CELLS and name not in CELLS and name not in ("tr", "tbody", "thead", "tfoot")):
                    break
            continue
        if block:
            flush()
            if name in CLOSES:
                close(*CLOSES[name])
            elif name not in ("br", "label", "option", "button"):
                close({"p"}, CELLS)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        _, state, path, inner = stack[-1]
        says, part = named(name, m[3]) if m[3] and NAMING.search(m[3]) else (NONE, name)
        if state == OUT:
            if inner is not None and name in HEADINGS:
                state, inner = inner, None
        elif name in OUT_TAGS or says == OUT:
            state, inner = OUT, (state if state > NONE and part.rpartition(".")[2].endswith("header") else None)
        elif name == "header":
            state, inner = OUT, state if state > NONE else None
        else:
            state = max(state, ARTICLE if name == "article" else MAIN if name == "main" else NONE, says)
        if not block and state != stack[-1][1]:
            flush()
        stack.append((name, state, f"{path}/{part}" if block else path, inner))
    buffer.append(page[at:])
    flush()
    return out


def level(found: list[Run]) -> int:
    """Where the page's own text stands: in articles, else in its main part, else anywhere."""
    return max((r.state for r in found), default=NONE) if any(r.state > NONE for r in found) else NONE


def token(host: int, run: Run) -> int:
    """A run on a host as a signed 64-bit number."""
    n = xxhash.xxh64_intdigest(f"{run.place}\0{run.text}".encode("utf-8", "surrogatepass"), host & 0xFFFFFFFFFFFFFFFF)
    return n - (1 << 64) if n >> 63 else n
