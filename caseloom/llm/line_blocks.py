"""Operator 7, HTML extraction by the distribution of text over lines.

Markup is stripped so that each block of the page is one line. A line's length
counts unless it lies in a part that is never article text (menus, notices,
adverts, forms and so on), whose lines count 0. Lengths are summed over sliding
windows of lines; a surge point is where the sum reaches a threshold, the dive
point after it where the sum falls to 0. The text between is kept, and so are
the counted lines between two kept ones, however short.

Lines inside an element that marks the article weigh several times their length,
so a short one is a surge as well; lines outside count by their length. A page
asks for a window of some length, at most half of its longest window without
these weights, so that a page of short lines keeps its text.

Defined results: null and empty pages give an empty text. Each row is read alone
and whole; repeated rows repeat results. An unclosed paragraph, list item, term,
option, cell or row ends where the next one begins, any other unclosed tag with
its parent; an unclosed comment, script or style runs to the end of the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from caseloom.llm.common import mapped, pick

WINDOW = 3
SURGE = 86
#: How many times its length a line inside an article weighs.
ARTICLE_WEIGHT = 16

# Element names of the HTML standard by their role, and words that
# name parts of a page in class and id attributes.
BLOCKS = frozenset(
    "address article aside blockquote body br canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg".split())
NEVER = frozenset(
    "head nav aside footer form menu dialog button select option label fieldset input textarea noscript template iframe object canvas audio video".split()
)
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar navigation menu menus breadcrumb "
    "breadcrumbs header masthead topbar footer foot sidebar sidebars aside rail widget widgets notice notices cookie cookies consent gdpr alert popup "
    "modal overlay subscribe newsletter signup login form search share sharing social related recommended comment comments discussion disqus reply replies respond "
    "pagination pager toolbar copyright legal skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ARTICLE = frozenset(("article", "main"))
#: Names that tell a part of the page around an article, but not within one, and what follows a name of reading advice.
AROUND = frozenset("legal reply replies respond header footer banner masthead".split())
ADVICE = frozenset("related recommended".split())
ADVISED = frozenset("post posts article articles story stories news content links link items item list box reading pages widget".split())
#: Elements whose start ends an open one of these, unless one of the elements after it stands between.
_PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main "
    "menu nav ol p pre section summary table ul".split()
)
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select datalist".split())), "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "td": (frozenset("td th".split()), frozenset(["table"])), "th": (frozenset("td th".split()), frozenset(["table"])),
    "tr": (frozenset("td th tr".split()), frozenset(["table"])),
    **{tag: (frozenset("td th tr thead tbody tfoot caption colgroup".split()), frozenset(["table"])) for tag in ("thead", "tbody", "tfoot")},
}
#: What a paragraph's implied end does not reach through.
_SCOPES = frozenset("table td th caption button object html body".split())

# A quote opens a value only after an equals sign; elsewhere it is a character like others.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))")


def names_part(value: str, in_article: bool = False) -> bool:
    """Whether a class or id names a part of the page other than its text."""
    for name in value.split():
        name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", re.sub(r"\d+$", "", name)).lower()
        parts = [p for p in re.split(r"[-_:]+", name) if p]
        if not parts or {"with", "has", "no", "without"} & set(parts):
            continue
        if parts[0] in ADVICE and len(parts) > 1 and parts[1] not in ADVISED and parts[-1] not in PARTS:
            continue
        if in_article and set(parts) <= AROUND:
            continue
        if parts[0] in PARTS or parts[-1] in PARTS:
            return True
    return False


def outside_text(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NEVER or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", *ARTICLE) or not attributes.strip():
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        found, name = unescape(a or b or c), name.lower()
        if (name in ("class", "id") and names_part(found, in_article)) or (name == "role" and found.lower() in ROLES):
            return True
        if (name, found.lower()) == ("aria-hidden", "true"):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes))


def lines(page: str) -> tuple[list[tuple[str, bool, bool]], bool]:
    """(text, counts, in article) of each block in page order, and whether an article is marked."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    buffer: list[str] = []
    opened: dict[str, int] = {}  # how many of each element are open
    marked = False
    state = (True, False)

    def end(k: int) -> None:
        """Close the k-th open element and all inside it."""
        nonlocal state
        if stack[k][1:] != state:
            close()
        state = stack[k][1:]
        for name, *_ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    def imply(tag: str) -> None:
        """End the elements that the start of this one ends."""
        if tag in _PARAGRAPH_ENDS and opened.get("p"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    end(k)
                    break
                if stack[k][0] in _SCOPES:
                    break
        ended, scope = IMPLIED.get(tag, ((), ()))
        if any(opened.get(name) for name in ended):
            last = None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in scope:
                    break
                if stack[k][0] in ended:
                    last = k
            if last is not None:
                end(last)

    def close() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            out.append((text, *state))

    at, n = 0, len(page)
    while at < n:
        token = TOKEN.search(page, at)
        if token is None:
            buffer.append(unescape(page[at:]))
            break
        if token.start() > at:
            buffer.append(unescape(page[at : token.start()]))
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS or tag in NEVER:
            close()
        if token[1]:
            if opened.get(tag):
                end(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        imply(tag)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        if tag in VOID or token[3].endswith("/"):
            continue
        counts, inside = state
        new = (counts and not outside_text(tag, token[3], inside), inside or tag in ARTICLE)
        if new != state:
            close()
        marked |= tag in ARTICLE and new[0]
        stack.append((tag, *state))
        opened[tag] = opened.get(tag, 0) + 1
        state = new
    close()
    return out, marked


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of one page."""
    found, _ = lines(page or "")
    lengths = [len(text) if counts else 0 for text, counts, _ in found]
    weights = [n * ARTICLE_WEIGHT if inside else n for n, (_, _, inside) in zip(lengths, found, strict=True)]
    longest = max((sum(lengths[k : k + window]) for k in range(len(lengths))), default=0)
    least = max(1, min(surge, (longest + 1) // 2))
    sums = [sum(weights[k : k + window]) for k in range(len(weights))]
    first = last = None
    k = 0
    while k < len(sums):
        if sums[k] < least:
            k += 1
            continue
        # A surge: its text runs up to the dive, where a whole window is empty.
        first = k if first is None else first
        while k < len(sums) and sums[k] > 0:
            k += 1
        last = k
    kept = [] if first is None else [found[k][0] for k in range(first, last) if lengths[k]]
    return " ".join(kept)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html)."""
    rows = pick(pages, page_id="page_id", url="url", html="html")
    return mapped(rows, _rows, rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))
