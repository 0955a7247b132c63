"""Main text of pages without article and main, and of long furniture; odd and very long markup."""

import html
import re
import time

import pytest

from termloom.llm import html_text
from termloom.llm.html_pages import labelled_pages


def words(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


MENU = "<ul class=x><li><a href=/a>one</a></li><li><a href=/b>two</a></li></ul>"


@pytest.mark.parametrize("last", [3, 20, 60])
def test_pages_without_article_keep_every_paragraph(last):
    parts = [words("title", 4), words("first", 40), words("heading", 2), words("short", 12), words("next", 9), words("last", last)]
    tags = ["h1", "p", "h2", "p", "p", "p"]
    body = "".join(f"<{t}>{x}</{t}>" for t, x in zip(tags, parts, strict=True))
    page = f"<body>{MENU}<div>{body}</div>"
    assert html_text.extract(page + "</body>").split("\n") == parts
    assert html_text.extract(page + f"<footer>{words('foot', 5)}</footer></body>").split("\n") == parts


@pytest.mark.parametrize("open_", ["footer", "nav", "aside", "form", "div class=notice", "div id=comments"])
@pytest.mark.parametrize("n", [5, 60, 101, 400])
def test_furniture_of_any_length_goes(open_, n):
    rest = f"<{open_}><p>{words('f', n)}</p><p>{words('g', n)}</p></{open_.split()[0]}>"
    body = f"<h1>A title</h1><p>{words('a', 50)}</p>"
    want = f"A title\n{words('a', 50)}"
    assert html_text.extract(f"<body>{body}{rest}</body>") == want
    assert html_text.extract(f"<body>{rest}{body}</body>") == want
    assert html_text.extract(f"<body><article>{body}{rest}</article></body>") == want


def test_the_tree_knows_the_labelled_pages():
    for page, labels in labelled_pages():
        found = html_text.blocks(page)
        assert len(found) == len(labels)
        assert html_text.extract(page) == "\n".join(b[0] for b, y in zip(found, labels, strict=True) if y)


def test_link_lists_and_their_separators_go_without_any_mark():
    menu = "<div>x</div>".join(f"<div><a href=/{i}>{words('m', 3)}</a></div>" for i in range(4))
    assert html_text.extract(f"{menu}<p>{words('a', 70)}</p><p>{words('b', 9)}</p><div><a href=/z>{words('z', 6)}</a></div>") == f"{words('a', 70)}\n{words('b', 9)}"


P = words("p", 60)


@pytest.mark.parametrize(("page", "want"), [
    (f"<body><h1>A title</h1><p>{P}</p></body>", f"A title\n{P}"),
    (f"<div>{''.join(f'<p>{words(c, 20)}</p>' for c in 'abcd')}</div>", "\n".join(words(c, 20) for c in "abcd")),
    (f'<div class="content has-sidebar"><article><p>{P}</p></article></div>', P),
    (f'<div id="page" class="no-comments"><article><p>{P}</p></article></div>', P),
    (f'<article><section class="search-algorithms"><p>{P}</p></section></article>', P),
    (f"<article><p title=it's>{P}</p></article>", P),
    (f"<article><p><a href=/x>one two<p>{P}</p></article><p>{P}</p>", f"one two\n{P}\n{P}"),
    (f"<form id=aspnet><div class=search><main><p>{P}</p></main></div></form>", P),
    (f"<article><p>{P}</p></article><div class=comment-list><article><p>{P}</p></article></div>", P),
    (f"<body class=search><head><title>t</title><p>{P}</p>", P),
    (f'<p>a &lt;b&gt; &amp; c&nbsp;d &#233;<!-- x --> <b>bold</b>\n\t end if 1 < 2</p><script>"<p>no</p>"</script>', "a <b> & c d é bold end if 1 < 2"),
    (f"<article><svg><text>no</text></svg><p>{P}<!-- never closed <p>x</p>", P),
    (f"<article><select><p>{P}</p>", P),
    ("<article><p>a</p><a ", "a\n<a"),
    (f'<article><p data-x="a > b">{P}</p><p data-y=">{P}</p></article>', f"{P}\n{P}"),
    (None, ""), ("", ""), ("<p></p>", ""), ("plain words alone", "plain words alone"),
])
def test_probes(page, want):
    assert html_text.extract(page) == want


@pytest.mark.parametrize("piece", ["<a ", "<a x=\"", "<a x='<b y=\"", "<!-- ", "<svg>", "<script>", "< ", "</", "<div>", "<p><b>x</b>", "<a href=x>y"])
def test_long_pages_take_time_in_proportion(piece):
    began = time.perf_counter()
    html_text.extract(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 5


def test_pages_of_the_table_give_their_article(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_text.extract_pages(rows).collect()}
    for r in rows.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|h2|ul|li|div)>", article)
        want = [" ".join(html.unescape(re.sub(r"<br>", " ", x).replace("<b>", "").replace("</b>", "")).split()) for x in blocks]
        assert got[r.page_id].text == "\n".join(x for x in want if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_null_and_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "u", "<p>some words</p>", "a"), (1, "u", "<p>some words</p>", "b"), (None, None, None, None), (2, "v", "", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract_pages(pages).collect()) == [(0, "", 0), (1, "some words", 10), (1, "some words", 10), (2, "", 0)]
