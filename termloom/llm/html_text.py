"""Main text of web pages: flat text blocks, classified by a decision tree over word counts and link densities.

A page is cut into blocks at block-level tags. Each block has its number of words, its share of words inside links,
the same two figures of the block before and after it, and two marks of its place: inside an element that names itself
furniture (nav, footer, aside, form, or a class, id or role such as "ad" or "comment-list"), and inside article or main.
A tree grown on the labelled pages of html_pages says which blocks are the article. Kept blocks are joined by one \\n.

Names are compared as whole words of a class, id or role: "has-sidebar" and "search-algorithms" name no furniture, nor
do the names of html and body. An article or main inside an element that only its name (or a form) makes furniture is
no furniture, unless the name is of comments, replies or related pages.

Null and empty pages give ''. Scripts, styles, titles, comments of the markup and templates never give text; of these, a
script, style, title, text area, frame or comment that is never closed ends with the page, and others are tags like any
other then. Unclosed and stray end tags are tolerated: an end tag closes the nearest open element of its name and what is
open inside it, and one without a partner is ignored; a link ends with the block it was opened in. A < that begins no
closed tag is text. Quotes begin a value only after =. Line breaks within a block are white space. The scanner passes each
character once, so very long pages take time in proportion. Repeated rows are extracted each by itself; other columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import ship, table, tidy
from .html_pages import labelled_pages
from .trees import grow, predict

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: What follows a tag's name, up to its end.
REST = re.compile(r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
NAMED = re.compile(r"""(?<![^\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements without text, and those of them that an end of page closes.
SILENT = set("script style title noscript template iframe svg textarea select object noembed noframes xmp canvas audio video".split())
TO_THE_END = set("script style title textarea iframe noembed noframes xmp".split())
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = set("nav footer aside button dialog menu search".split())
FURNITURE_NAMES = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu menubar modal nav navbar navigation newsletter notice notices pagination popup privacy promo promoted related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets complementary contentinfo alert".split())
#: Names whose articles are not the page's article.
OTHERS = set("comment comments disqus footer related promoted reply replies respond sponsored".split())
#: Last words of compound names whose first word is furniture: comment-list, ad-slot.
HOLDERS = set("area bar block body box button buttons container content form group holder inner item items links list menu nav outer panel row section slot thread unit wrap wrapper".split())
#: First words of compound names that say what is not there, or what an element has besides.
NEGATING = set("has is no not non with without hide hidden show js".split())
PAGE_HEADER_NAMES = set("header masthead topbar".split())
MAIN_TAGS = {"article", "main"}
#: A p, li, dt, dd, tr, td or th that opens ends an open one of these.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Kinds of furniture: by a name, or whatever stands inside.
SOFT, HARD = 1, 2

_TREE = None


def tree():
    """The tree grown on the labelled pages, once a process."""
    global _TREE
    if _TREE is None:
        pages = labelled_pages()
        rows, labels = np.concatenate([features(blocks(p)) for p, _ in pages]), np.concatenate([y for _, y in pages])
        _TREE = grow(rows, labels.astype(float), depth=6, min_leaf=1)
    return _TREE


def names_furniture(token: str, names: set[str] = FURNITURE_NAMES) -> bool:
    """True if a class, id or role is a furniture name, or a compound of one: site-footer, comment-list."""
    if token in names:
        return True
    words = [w for w in re.split(r"[^a-z0-9]+", token) if w]
    if len(words) < 2 or words[0] in NEGATING:
        return False
    return words[-1] in names or (words[0] in names and words[-1] in HOLDERS)


def _kind(name: str, rest: str, within: int, main: bool) -> int:
    """The kind of furniture that an element is, itself or by the element it stands in."""
    tokens = [t for m in NAMED.finditer(rest) for t in (m[1] or m[2] or m[3] or "").lower().split()]
    if name in FURNITURE_TAGS or any(names_furniture(t, OTHERS) for t in tokens):
        return HARD
    if name in MAIN_TAGS and within < HARD:
        within = 0
    if name == "form" or any(map(names_furniture, tokens)):
        return max(SOFT, within)
    if not main and (name == "header" or any(names_furniture(t, PAGE_HEADER_NAMES) for t in tokens)):
        return max(SOFT, within)
    return within


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, words in links, in furniture, in article or main) of every block with text, in page order."""
    out: list[tuple[str, int, int, bool, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    open_: list[tuple[str, int, bool]] = []  # name, kind of furniture, in article or main
    link = -1  # open elements where the link began; -1 outside links
    absent: set[str] = set()  # silent elements without an end tag from here on

    def close_block() -> None:
        words = html.unescape("".join(parts)).split()
        if words:
            _, kind, main = open_[-1] if open_ else ("", 0, False)
            out.append((" ".join(words), len(words), len(html.unescape(" ".join(linked)).split()), kind > 0, main))
        parts.clear()
        linked.clear()

    def text(a: int, b: int) -> None:
        if a < b:
            parts.append(page[a:b])
            if link >= 0:
                linked.append(page[a:b])

    at = look = 0  # where text begins; where to look for the next tag
    while (lt := page.find("<", look)) >= 0:
        sign = page[lt + 1 : lt + 2]
        ending = sign == "/"
        m = NAME.match(page, lt + 1 + ending)
        if not m or not m[0].isascii():
            if sign not in ("!", "?", "/") or not sign:
                look = lt + 1
                continue
            text(at, lt)
            mark, skip = ("-->", 4) if page.startswith("<!--", lt) else (">", 1)
            end = page.find(mark, lt + (2 if page.startswith("<!-->", lt) else skip))
            at = look = len(page) if end < 0 else end + len(mark)
            continue
        rest = REST.match(page, m.end())
        if not rest:  # no later tag ends either
            break
        text(at, lt)
        at = look = rest.end()
        name = m[0].lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in SILENT:
            if ending or name in absent or (rest[1].endswith("/") and name not in TO_THE_END):
                continue
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if end:
                at = look = end.end()
            elif name in TO_THE_END:
                at = look = len(page)
            else:
                absent.add(name)
            if name not in ("script", "style", "svg"):
                close_block()
            continue
        if name in BLOCK:
            close_block()
        if ending:
            if name == "a":
                link = -1
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
        elif name == "a":
            link = len(open_)
        elif name in BLOCK and name not in VOID and not rest[1].endswith("/"):
            while open_ and open_[-1][0] in ENDS.get(name, ()):
                open_.pop()
            _, kind, main = open_[-1] if open_ else ("", 0, False)
            if name not in ("html", "body"):
                kind = _kind(name, rest[1], kind, main)
            open_.append((name, kind, main or name in MAIN_TAGS))
        if len(open_) < link:
            link = -1
    text(at, len(page))
    close_block()
    return out


def features(found: list[tuple[str, int, int, bool, bool]]) -> np.ndarray:
    words = np.array([0, *(b[1] for b in found), 0], dtype=float)
    density = np.array([0, *(b[2] for b in found), 0]) / np.maximum(words, 1)
    n = len(found)
    marks = np.array([[b[3], b[4]] for b in found], dtype=float).reshape(n, 2)
    return np.column_stack([words[:n], words[1 : n + 1], words[2:], density[:n], density[1 : n + 1], density[2:], marks])


def extract(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = predict(tree(), features(found)) >= 0.5
    return "\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [extract(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    ship(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
