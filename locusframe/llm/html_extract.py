"""Main-text extraction from web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page, and the lines' text lengths are
summed over a sliding window of lines: a *surge* is where that sum leaves zero, its *dive* is where
it falls to zero again, and the text from the first surge to the last dive is kept. Pages all go this
one way; markup acts through the lengths alone. Elements that are never part of an article (menus,
page headers and footers, side bars, notices, adverts, forms, scripts, styles, reader comments) have no lines;
outside of an article they leave a gap as wide as the window. Where a page marks its article, lines outside of it
have no length: the surest mark on the page counts (``article`` elements, else ``main``, else elements named
like one), so of an article inside ``main`` only the article is kept. Elsewhere lines made mostly of link text have none,
but for paragraphs that have other words.
On a page without any mark some sum has to rise above ``surge``; if none does, only the longest run of lines
with length is kept. Lines without length inside of what is kept go where they are outside of the
article, or nothing but links on a page without a mark (in a named element: links outside of paragraphs).

Names in ``class`` and ``id`` are read part by part: furniture is named alone (``share``), with a word for its box
(``share-buttons``), or, for the plainest names, after any word (``site-footer``); ``share-price`` is none.
Inside ``article`` and ``main`` fewer names count. Attributes are read whole, so that values are not taken for names.
Skipped elements whose end tag may be omitted end at a sibling's or their parent's tag.

Null, empty and text-free pages give an empty string; equal pages equal texts. Of runs of
equal length the first is kept. Whole pages are read, and nothing of a kept segment is cut.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import tidy

# Element names and name parts of the markup vocabulary.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe noembed noframes xmp".split())
NEVER = frozenset("head title nav footer aside form button select svg canvas object menu dialog audio video map math".split())
# Names of furniture: alone, or as the last part of a name (``site-footer``), or first before a part of AROUND (``ad-box``).
STRONG = frozenset("ad ads advert adverts advertisement advertising adbox banner nav navbar navigation menu sidebar breadcrumb breadcrumbs footer masthead pagination pager toolbar popup modal cookies gdpr newsletter comments disqus replies".split())
# The same, but only alone or first before a part of AROUND.
WEAK = frozenset("sponsor sponsored sponsors promo promos promoted promotion cookie consent notice notices subscribe subscription signup login share sharing comment related social".split())
# As WEAK, outside of an article only.
FURNITURE = frozenset("side header overlay recommended recommendation recommendations review reviews widget widgets skip copyright legal disclaimer tags hidden".split())
AROUND = frozenset("area bar block box bottom btn button buttons column container content dialog feed footer form group header holder icons inner item items left link links list menu message overlay panel popup posts right row section skyscraper slot space stories text top unit widget wrap wrapper articles banner tools thread count actions count to".split())
REGION = re.compile(
    r"(?:^|\s)(?:content|main|article|post|entry|story|main-?content|page-?content|article-?(?:body|content|text)|post-?(?:body|content)|entry-?content|story-?body)(?:$|\s)", re.I
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

# Elements whose end tag may be omitted: start tags that end them, and elements inside which those don't count.
_P_ENDS = frozenset(
    "address article aside blockquote center details dialog div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split()
)
OMITTED = {
    "p": (_P_ENDS, frozenset(["button", "object"])),
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    **dict.fromkeys(("dt", "dd"), (frozenset(["dt", "dd"]), frozenset(["dl"]))),
    **dict.fromkeys(("td", "th"), (frozenset(["td", "th", "tr", "tbody", "tfoot"]), frozenset(["table"]))),
    "tr": (frozenset(["tr", "tbody", "tfoot"]), frozenset(["table"])),
}

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[a-zA-Z/][^<>]*(?:>|\Z)",
    re.S,
)
# A whole attribute, so that a value is never read as a name.
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_LETTER = re.compile(r"\w|[^\x00-\x7f]")
_PART = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")


def _attributes(attrs: str) -> list[tuple[str, str]]:
    return [(k.lower(), unescape(v[1:-1] if v[:1] in "\"'" else v)) for k, v in _ATTR.findall(attrs)]


@functools.lru_cache(10_000)
def _names_furniture(names: str, in_article: bool) -> bool:
    """Whether one of the names in a class or id says that the element is no part of an article."""
    for name in names.split():
        parts = [x.lower() for x in _PART.split(name) if x]
        if not parts:
            continue
        first, rest = parts[0], parts[1:]
        if parts[-1] in STRONG:
            return True
        if first in STRONG or first in WEAK or not in_article and first in FURNITURE:
            if all(x in AROUND or x in STRONG or x in WEAK or x.isdigit() for x in rest):
                return True
    return False


def _is_boiler(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in NEVER or (tag == "header" and not in_article):
        return True
    if tag in ("body", "html", "article", "main") or "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for key, value in _attributes(attrs):
        if key in ("class", "id") and _names_furniture(value, in_article):
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def _is_region(tag: str, attrs: str) -> int:
    """3: an element that says it is the article, 2: the page's main part, 1: an element named like one, 0: others."""
    if tag in ("article", "main"):
        return 3 if tag == "article" else 2
    if tag in ("div", "section", "td") and "=" in attrs:
        for key, value in _attributes(attrs):
            if key == "itemprop" and value.lower() == "articlebody":
                return 3
            if key == "role" and value.lower() in ("main", "article"):
                return 3 if value.lower() == "article" else 2
            if key in ("class", "id") and REGION.search(value):
                return 1
    return 0


def page_lines(html: str, gap: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Lines of a page, the share of link text in each (0 in paragraphs with other words), whether it counts as text, and how surely it is inside the article (3 to 0)."""
    lines: list[str] = []
    links: list[float] = []
    plain: list[bool] = []
    inside: list[int] = []
    text: list[str] = []
    linked = 0
    other = False
    anchor = 0
    regions: list[list] = []  # open regions: element, nesting of the same element, certainty
    paragraph = False  # in a paragraph: of a region, its links are text

    def flush() -> None:
        nonlocal linked, other
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                lines.append(line)
                links.append(0.0 if paragraph and other else linked / max(1, len(line)))
                plain.append(other or paragraph and bool(regions))
                inside.append(max((r[2] for r in regions), default=0))
            text.clear()
        linked, other = 0, False

    def blank() -> None:
        if not regions:
            lines.extend([""] * gap)
            links.extend([0.0] * gap)
            plain.extend([False] * gap)
            inside.extend([0] * gap)

    at, end, skip, depth = 0, len(html), "", 0
    within: list[str] = []  # elements open inside a skipped one of OMITTED
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            if not skip:
                text.append(html[at:])
                other = other or not anchor and bool(_LETTER.search(html, at))
            break
        if m.start() > at and not skip:
            text.append(html[at : m.start()])
            if anchor:
                linked += m.start() - at
            elif not other:
                other = bool(_LETTER.search(html, at, m.start()))
        at = m.end()
        close, tag, attrs = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not tag:
            continue
        if tag in RAW and not close:
            if not attrs.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?:[\s/>]|\Z)", re.I).search(html, at)
                at = end if stop is None else max(html.find(">", stop.start()), stop.start()) + 1
                if stop is not None and html.find(">", stop.start()) < 0:
                    at = end
            continue
        if skip:
            if not close and tag in ("article", "main") and skip in ("nav", "header", "aside", "head", "title") or not close and tag == "body":
                skip = ""  # the element was never closed
                blank()
            elif skip in OMITTED:
                starts, scopes = OMITTED[skip]
                if close and tag in within:
                    del within[len(within) - 1 - within[::-1].index(tag) :]
                    continue
                if close and tag == skip:
                    skip = ""
                    blank()
                    continue
                over = tag in BLOCKS and tag not in ("p", "br", "hr") if close else tag in starts and scopes.isdisjoint(within)
                if not over:
                    if not close and tag not in VOID and not attrs.endswith("/"):
                        within.append(tag)
                    continue
                skip = ""  # its end tag was omitted; this tag counts
                blank()
            elif tag == skip and tag not in VOID and not attrs.endswith("/"):
                depth += -1 if close else 1
                if depth == 0:
                    skip = ""
                    blank()
                continue
            else:
                continue
        if tag in BLOCKS:
            flush()
            paragraph = tag == "p" and not close
        if tag == "a":
            anchor = 0 if close else 1
        if not close and tag not in VOID and not attrs.endswith("/"):
            if _is_boiler(tag, attrs, any(r[2] >= 2 for r in regions)):
                flush()
                skip, depth = tag, 1
                within.clear()
            elif sure := _is_region(tag, attrs):
                regions.append([tag, 1, sure])
            elif regions and regions[-1][0] == tag:
                regions[-1][1] += 1
        elif close and regions and regions[-1][0] == tag:
            regions[-1][1] -= 1
            if not regions[-1][1]:
                regions.pop()
    flush()
    return lines, np.array(links), np.array(plain, bool), np.array(inside)


def extract_main(html: str | None, window: int = 3, surge: int = 80, link_share: float = 0.6) -> str:
    """The main text of one page; see the module's text for the method."""
    if not html:
        return ""
    lines, links, plain, inside = page_lines(html, window)
    if not lines:
        return ""
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    sure = int(inside.max())
    may = (length > 0) & (plain | (sure >= 2)) & (inside == sure)
    if not may.any():  # the marked article has no text
        sure, may = 0, (length > 0) & plain
    counted = np.where(may & ((links <= link_share) | (sure > 0)), length, 0)
    if not counted.any():
        return ""
    ends = np.concatenate(([0], np.cumsum(counted)))
    block = ends[np.minimum(np.arange(len(lines)) + window, len(lines))] - ends[:-1]
    # surges and dives: where the windowed sum leaves zero, and where it is zero again
    on = np.concatenate(([False], block > 0, [False]))
    edges = np.flatnonzero(on[1:] != on[:-1])
    segments = list(zip(edges[::2], edges[1::2], strict=True))
    if not sure and block.max() <= surge:
        segments = [max(segments, key=lambda s: ends[s[1]] - ends[s[0]])]
    return " ".join(lines[i] for i in range(segments[0][0], segments[-1][1]) if may[i])


def extract_pages(pages: DataFrame, html: str = "html", **settings: float) -> DataFrame:
    """``pages`` with columns ``text`` and ``n_chars`` (code points of the text) in place of the markup.

    A map over rows: no shuffle, and a task holds one Arrow batch of pages.
    Columns of ``pages`` named ``text`` or ``n_chars`` are replaced.
    """

    @F.pandas_udf("string")
    @tidy
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract_main(x, **settings) for x in batch], dtype=object)

    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    return pages.select(*kept, main_text(F.col(html)).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
