"""A small labelled table of web pages: the blocks of each page in page order, with those of the article marked.

A page is a list of pieces of markup. A piece is (label, markup): label 1 is article text, 0 is not, None is markup
without text. In the markup, {n} stands for n words.
"""

from __future__ import annotations

import re

_LINKS = [(0, "<li><a href=/a>{1}</a></li>"), (0, "<li><a href=/b>{2}</a></li>"), (0, "<li><a href=/c>{1}</a></li>")]
_NAV = [(None, "<nav><ul>"), *_LINKS, (None, "</ul></nav>")]
_BARE_MENU = [(None, "<ul>"), *_LINKS, (None, "</ul>")]
_FOOTER = [(None, "<footer>"), (0, "<p>{12}</p>"), (0, "<p><a href=/x>{2}</a></p>"), (None, "</footer>")]
_COMMENTS = [(None, "<section id=comments>"), (0, "<h3>{2}</h3>"), (0, "<div>{60}</div>"), (0, "<div>{140}</div>"), (0, "<div>{6}</div>"), (None, "</section>")]
_STORY = [(1, "<h1>{7}</h1>"), (1, "<p>{55}</p>"), (1, "<p>{90} <a href=/s>{3}</a></p>"), (1, "<h2>{2}</h2>"), (1, "<p>{8}</p>"), (1, "<ul><li>{5}</li>"), (1, "<li>{3}</li></ul>"), (1, "<p>{120}</p>")]

PAGES = [
    # article with everything around it
    [*_NAV, (0, "<div class=ad>{9}</div>"), (None, "<article>"), *_STORY, (None, "</article>"), *_FOOTER],
    [(0, "<header>{4}</header>"), *_NAV, (None, "<main>"), *_STORY, (1, "<p>{4}</p>"), (None, "</main>"), *_COMMENTS, *_FOOTER],
    [(0, "<div class=cookie-banner>{45}</div>"), *_NAV, (None, "<article>"), *_STORY, (0, "<aside>{110}</aside>"), (1, "<p>{33}</p>"), (0, "<form><label>{3}</label>"), (0, "<button>{1}</button></form>"), (None, "</article>")],
    [(None, "<article>"), (1, "<p>{2}</p>"), (1, "<p><a href=/only>{3}</a></p>"), (1, "<p>{200}</p>"), (1, "<p><a href=/x>{5}</a> {2}</p>"), (None, "</article>"), *_COMMENTS],
    [*_NAV, (None, "<article>"), (1, "<p><a href=/first>{2}</a></p>"), (1, "<p>{70}</p>"), (1, "<div><a href=/p>{1}</a></div>"), (1, "<div>{1}</div>"), (1, "<div><a href=/q>{1}</a></div>"), (None, "</article>"), *_FOOTER],
    [(None, "<main>"), (1, "<p><a href=/first>{30}</a> {2}</p>"), (1, "<p>{9}</p>"), (1, "<ul><li><a href=/1>{2}</a></li>"), (1, "<li><a href=/2>{1}</a></li>"), (1, "<li><a href=/3>{4}</a></li></ul>"), (None, "</main>"), *_NAV],
    # neither article nor main
    [*_NAV, (None, "<div>"), *_STORY, (None, "</div>"), *_FOOTER],
    [*_BARE_MENU, (None, "<div>"), *_STORY, (None, "</div>"), *_BARE_MENU, *_FOOTER],
    [*_BARE_MENU, (1, "<p>{30}</p>"), (1, "<p>{11}</p>"), (1, "<p>{3}</p>")],
    [*_BARE_MENU, (1, "<h1>{1}</h1>"), (1, "<p>{30}</p>"), (1, "<h2>{1}</h2>"), (1, "<p>{11}</p>"), (1, "<p>{1}</p>"), (1, "<p>{1}</p>"), *_FOOTER],
    [(1, "<h1>{1}</h1>"), (1, "<p>{2}</p>"), (1, "<h2>{2}</h2>"), (1, "<p>{40}</p>"), (1, "<p>{1}</p>"), *_BARE_MENU],
    [(1, "<p>{1}</p>")],
    [(1, "<h1>{4}</h1>"), (1, "<p>{60}</p>")],
    [(1, "<div>{50}</div>"), (1, "<div>{50}</div>"), (1, "<div>{50}</div>"), (1, "<div>{50}</div>"), (0, "<div><a href=/n>{4}</a> <a href=/o>{5}</a> {1}</div>")],
    [(1, "<p>{140}</p>"), (0, "<div><a href=/r>{9}</a></div>"), (0, "<div><a href=/r>{12}</a></div>"), (1, "<p>{70} <a href=/i>{20}</a></p>"), *_COMMENTS],
    [(0, "<div id=sidebar>{160}</div>"), (1, "<p>{5}</p>"), (1, "<p>{6} <a href=/i>{2}</a></p>"), (0, "<div class='notice'>{20}</div>"), (1, "<p>{15}</p>"), (0, "<p><a href=/i>{40}</a> {10}</p>"), *_FOOTER],
    # separators and labels between links
    [(0, "<div><a href=/1>{1}</a></div>"), (0, "<div>{1}</div>"), (0, "<div><a href=/2>{1}</a></div>"), (0, "<div>{1}</div>"), (0, "<div><a href=/3>{2}</a></div>"), (1, "<p>{44}</p>"), (1, "<p>{18}</p>"), (0, "<div><a href=/4>{3}</a></div>"), (0, "<div>{2}</div>"), (0, "<div><a href=/5>{3}</a></div>")],
]


def labelled_pages() -> list[tuple[str, list[int]]]:
    """(html, label of each block with text) of every page."""
    out = []
    for page in PAGES:
        words = (f"w{i}" for i in range(10**6))
        html = "".join(re.sub(r"\{(\d+)\}", lambda m, words=words: " ".join(next(words) for _ in range(int(m[1]))), markup) for _, markup in page)
        out.append((f"<html><body>{html}</body></html>", [label for label, _ in page if label is not None]))
    return out
