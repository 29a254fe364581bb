"""Main text of web pages by line-block distribution.

Markup is stripped to a line for each block, in one pass over the page whose time grows with its length, however broken it is. A line
weighs as many characters as it has, or nothing if it is mostly links. Sums over a sliding window of lines tell where text is: it surges
at the first line from which a window weighs ``SURGE``, and dives after the last line up to which one does; runs are parted where a
whole window weighs nothing. The text between the points is the page's.

Markup is evidence beside it. Elements that are never text (menus, footers, asides) are left out. Forms, and elements whose class or role
says so, are left out, unless all runs of the page stand in such elements: then the one with most text counts. An element that marks
the article gives the borders, unless text outside it weighs more in its densest window than any inside.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import map_rows

#: Lines in a window, and the characters that one must weigh where a text begins and ends.
SPAN, SURGE = 3, 120

#: Elements whose content isn't markup: skipped up to their end tag.
RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in "script style title textarea iframe noembed noframes xmp".split()}
HEAD_END = re.compile(r"</head\s*>|(?=<body\b)", re.I)
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile(r"[>\"']")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article.
FURNITURE = frozenset("nav footer aside button dialog menu template svg object math select canvas audio video".split())
#: Elements that are none either, but for pages that stand in one as a whole.
WRAPPERS = frozenset(("form", "noscript"))
#: Words of class, id or role that say the same, and words that may stand beside them in one name ("comment-list").
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "footer foot masthead topbar toolbar sidebar side aside widget widgets cookie cookies consent gdpr notice popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond "
    "pagination pager skip search copyright contentinfo complementary alert alertdialog tags tag hidden".split()
)
BESIDE = frozenset("list lists box bar wrap wrapper container section area block left right top bottom form inner outer item items links link text site page main global the user users reader readers post posts button buttons slot slots unit".split())
#: Words that say it of an element only outside an article.
OUTER_WORDS = frozenset(("header", "head"))
ARTICLE = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset("main article articlebody article-body post post-body post-content entry entry-content article-content story-body".split())
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|style|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
#: Open inline elements that an end tag is looked for among.
NEAR = 64


@dataclass
class Line:
    text: str
    article: bool
    #: The outermost open element whose words say that it is no text, by number; -1: none.
    doubt: int
    linked: int


def tag_end(page: str, at: int, gone: set[str]) -> tuple[int, bool]:
    """Where the tag that is open at ``at`` ends, and whether it does. Quotes count after an equals sign only, if they are closed.

    ``gone`` remembers which of the characters stand nowhere in the rest, so that no rest is searched twice.
    """
    while True:
        found = STOP.search(page, at) if ">" not in gone else None
        if not found:
            gone.add(">")
            return len(page), False
        at, sign = found.end(), found.group()
        if sign == ">":
            return at, True
        if sign not in gone and page[max(0, at - 40) : at - 1].rstrip().endswith("="):
            close = page.find(sign, at)
            if close < 0:
                gone.add(sign)
            else:
                at = close + 1


def block_lines(page: str) -> list[Line]:
    """A line for each block of the page that has text, but those inside elements that are never text."""
    lines: list[Line] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, never text, article, doubt
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = links = doubts = 0
    never, article, doubt = False, False, -1
    gone: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text and not never:
                lines.append(Line(text, article, doubt, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal never, article, doubt
        for name, *_ in stack[depth:]:
            opened[name] -= 1
        del stack[depth:]
        never, article, doubt = stack[-1][1:] if stack else (False, False, -1)

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        stop = start if start >= 0 else end
        if stop > at:
            parts.append(page[at:stop])
            if links:
                linked += stop - at
        if start < 0:
            break
        ahead = page[start + 1 : start + 2]
        if ahead in ("!", "?"):
            mark = "-->" if page.startswith("<!--", start) else ">"
            over = page.find(mark, start + 1)
            at = over + len(mark) if over >= 0 else end
            continue
        closing = ahead == "/"
        word = NAME.match(page, start + 1 + closing)
        if not word:
            parts.append("<")
            at = start + 1
            continue
        at, whole = tag_end(page, word.end(), gone)
        if not whole:
            break  # a tag that never ends has no text behind it
        name, rest = word.group().lower(), page[word.end() : at - 1]
        if name == "br":
            parts.append("\n")
            continue
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        if closing:
            if name in BLOCK:
                flush()
            if opened.get(name):
                least = 0 if name in BLOCK or name in FURNITURE else max(0, len(stack) - NEAR)
                for i in range(len(stack) - 1, least - 1, -1):
                    if stack[i][0] == name:
                        if name not in BLOCK:
                            flush()
                        close(i)
                        break
                    if least and stack[i][0] in BLOCK:
                        break  # an inline element doesn't close the blocks inside it
            continue
        if name == "head":
            over = None if name in gone else HEAD_END.search(page, at)
            if not over:
                gone.add(name)
            at = over.end() if over else at
            continue
        if name in RAW:
            over = None if name in gone else RAW[name].search(page, at)
            if not over:
                gone.add(name)
            at = over.start() if over else end
            continue
        if name in BLOCK:
            flush()
        if name in VOID or rest.endswith("/"):
            continue
        if name in ("p", "li") and stack and stack[-1][0] == name:
            close(len(stack) - 1)
        if name in ARTICLE and opened.get("nav"):  # no menu holds an article: its end tag is missing
            close(next(i for i, x in enumerate(stack) if x[0] == "nav"))
        names, covered = attributes(rest) if rest else ([], False)
        marks = name in ARTICLE or any(n in ARTICLE_WORDS for n in names)
        says = name in WRAPPERS or name not in ("html", "body") and not marks and any(furnishes(n, article) for n in names)
        hides = covered or name in FURNITURE or name == "header" and not article
        if name in BLOCK or hides or says:
            if name not in BLOCK:
                flush()
            if says and doubt < 0:
                doubt, doubts = doubts, doubts + 1
            never, article = never or hides, article or marks
            stack.append((name, never, article, doubt))
            opened[name] = opened.get(name, 0) + 1
    flush()
    return lines


def attributes(rest: str) -> tuple[list[str], bool]:
    """The names in class, id, role and itemprop, in lower case, and whether the element is hidden."""
    names, covered = [], False
    for key, *values in ATTRIBUTE.findall(rest):
        value, key = next((v for v in values if v), ""), key.lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and UNSEEN.search(value):
            covered = True
        elif key not in ("style", "aria-hidden", "hidden"):
            names += value.lower().split()
    return names, covered


def furnishes(name: str, inside: bool) -> bool:
    """Whether a name says furniture: each of its words does, or stands beside one that does."""
    words = [w for w in re.split(r"[_-]", name) if w]
    known = FURNITURE_WORDS if inside else FURNITURE_WORDS | OUTER_WORDS
    return any(w in known for w in words) and all(w in known or w in BESIDE or w.isdigit() for w in words)


def runs(weight: np.ndarray, span: int, surge: int) -> list[tuple[int, int, int]]:
    """(first, end, most) of each run of lines between a surge and a dive point; ``most`` is what its heaviest window weighs."""
    if not len(weight) or not weight.any():
        return []
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(weight)])
    n, at = len(weight), np.arange(len(weight))
    ahead = sums[np.minimum(at + span, n)] - sums[at]
    behind = sums[at + 1] - sums[np.maximum(at + 1 - span, 0)]
    # Windows that weigh nothing part the runs.
    off = np.flatnonzero(np.concatenate([ahead[: n - span + 1] == 0 if n >= span else np.zeros(0, bool), [True]]))
    least, found, begin = min(surge, int(ahead.max())), [], 0
    for x in off.tolist():
        stop = min(x, n) if x <= n - span else n
        part = slice(begin, stop)
        up, down = np.flatnonzero((ahead[part] >= least) & (weight[part] > 0)), np.flatnonzero((behind[part] >= least) & (weight[part] > 0))
        if len(up) and len(down):
            found.append((begin + int(up[0]), begin + int(down[-1]) + 1, int(ahead[part].max())))
        begin = stop if stop > begin else begin
        while begin < n and weight[begin] == 0:
            begin += 1
        if begin >= n:
            break
    return found


def main_lines(lines: list[Line], span: int = SPAN, surge: int = SURGE) -> list[str]:
    """The lines between surge and dive points of the block distribution."""

    def between(part: list[Line]) -> tuple[list[str], int]:
        weight = np.array([0 if 2 * x.linked > len(x.text) else len(x.text) for x in part], np.int64)
        found = runs(weight, span, surge)
        return [x.text for a, b, _ in found for x in part[a:b]], max((most for *_, most in found), default=0)

    sure = [x for x in lines if x.doubt < 0]
    text, most = between(sure)
    marked, rest = [x for x in sure if x.article], [x for x in sure if not x.article]
    if marked:
        # The mark gives the borders: what stands inside is the text, dense or not.
        if between(marked)[1] >= between(rest)[1]:
            return [x.text for x in marked]
        return text
    doubtful: dict[int, list[Line]] = {}
    for x in lines:
        if x.doubt >= 0:
            doubtful.setdefault(x.doubt, []).append(x)
    if doubtful and most < surge:
        best = max(doubtful.values(), key=lambda part: sum(len(x.text) - x.linked for x in part))
        found, weight = between([x for x in best if x.article] or best)
        if weight >= surge and weight > most:
            return [x.text for x in best if x.article] or found
    return text


def main_text(page: str, span: int = SPAN, surge: int = SURGE) -> str:
    return "\n".join(main_lines(block_lines(page), span, surge))


def extract(pages: DataFrame, span: int = SPAN, surge: int = SURGE) -> DataFrame:
    """(page_id, url, text, n_chars) for each page: its main text, and that text's code points.

    Character references are decoded; white space inside a block becomes one space; blocks are joined by one line feed.
    A null or empty page, or one without main text, has the empty text. Tags, comments and quotes that never end, and elements that are
    never closed, take time in proportion to the page. Repeated rows are kept; other columns are ignored.
    """

    def work():
        def each(batch):
            text = [main_text(x or "", span, surge) for x in batch.column(2).to_pylist()]
            yield {"page_id": batch.column(0), "url": batch.column(1), "text": text, "n_chars": [len(t) for t in text]}

        return each

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return map_rows(narrow, "page_id long, url string, text string, n_chars long", work)
