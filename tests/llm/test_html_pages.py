"""Pages without an article element, with hints that mislead, and with elements that lack their end."""

import pytest

from fenestra.llm import htmltext

LONG = "This paragraph of the article is long enough to be told from menus, notes and other things on the page by its words."
NAV = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News of today</a></li><li><a href='/c'>About</a></li></ul>"


def used(node):
    return set() if isinstance(node, int) else {node[0]} | used(node[2]) | used(node[3])


def test_neighbours_on_both_sides_decide():
    assert used(htmltext.tree()) >= {0, 1, 4, 6} and used(htmltext.tree()) & {2, 3}


@pytest.mark.parametrize("tag", ["button", "select", "object", "video", "title", "svg", "canvas", "audio", "textarea", "noscript", "iframe", "template", "datalist"])
def test_elements_without_end(tag):
    page = f"<body>{NAV}<div><{tag}>Label<p>{LONG} 1</p><p>{LONG} 2</p></div></body>"
    assert htmltext.extract(page) == f"{LONG} 1\n\n{LONG} 2"
    if tag not in htmltext._VERBATIM:  # begun again later, with an end
        again = f"<body><div><{tag}>Label<p>{LONG} 1</p><{tag}>x</{tag}><p>{LONG} 2</p></div></body>"
        assert htmltext.extract(again) == f"{LONG} 1\n\n{LONG} 2"
    closed = f"<body><div><p>{LONG} 1</p><{tag}>some <i>words</i></{tag}><p>{LONG} 2</p></div></body>"
    assert htmltext.extract(closed) == f"{LONG} 1\n\n{LONG} 2"


def test_nested_elements_end_with_the_outer_one():
    page = f"<body><p>{LONG}</p><object><object>in</object>out</object><svg><svg/><text>t</text></svg><p>{LONG}</p></body>"
    assert htmltext.extract(page) == f"{LONG}\n\n{LONG}"


def test_very_many_elements_without_end():
    page = "<body>" + "<object>" * 20_000 + f"<p>{LONG}</p>" + "<button>" * 20_000
    assert htmltext.extract(page) == LONG


def test_two_short_paragraphs():
    assert htmltext.extract("<body><p>Rain came at noon today.</p><p>It went on until the evening.</p></body>") == "Rain came at noon today.\n\nIt went on until the evening."


def test_paragraph_with_a_class_keeps_the_others():
    page = f"<body>{NAV}<div><p class='text'>{LONG} 1</p><p>{LONG} 2</p></div></body>"
    assert htmltext.extract(page) == f"{LONG} 1\n\n{LONG} 2"


def test_short_ends_of_an_article_beside_menus():
    page = f"<body>{NAV}<div><h1>Rain</h1><p>By our own writer</p><p>{LONG}</p><p>More tomorrow, then.</p></div>{NAV}<p>All rights kept</p>{NAV}</body>"
    assert htmltext.extract(page) == f"Rain\n\nBy our own writer\n\n{LONG}\n\nMore tomorrow, then."


def test_article_in_plain_divs_and_table_cells():
    page = f"<body><table><tr><td>{NAV}</td><td>{LONG} 1<br>{LONG} 2</td></tr></table><div>{LONG} 3</div>{NAV}</body>"
    assert htmltext.extract(page) == f"{LONG} 1 {LONG} 2\n\n{LONG} 3"


def test_a_very_long_page():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(20_000))
    assert htmltext.extract(f"<body>{NAV}{body}</body>").count("\n\n") == 19_999


def test_op7_without_article_elements(spark):
    """The fixture's pages with their article elements turned into plain ones."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    whole = some = 0
    for page in pages:
        want = htmltext.extract(page)
        got = htmltext.extract((page or "").replace("<article>", "<div>").replace("</article>", "</div>"))
        whole += got == want
        kept = set(got.split("\n\n"))
        some += sum(len(x.split()) for x in want.split("\n\n") if x in kept) >= 0.9 * len(want.split())
    assert some >= 0.95 * len(pages), (whole, some, len(pages))
