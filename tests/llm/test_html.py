"""Main text of hostile, odd and unmarked pages."""

import time

import pytest

from loomgraph.llm import html_text

WORDS = "word " * 20


def page(article, mark="article"):
    return f"<html><body><nav><a href=/>Menu</a></nav><{mark}>{article}</{mark}><footer>Foot of the page, long enough to surge by itself, were it text.</footer></body></html>"


def text_of(article, mark="article"):
    return html_text.main_text(page(article, mark)).split("\n")


def test_letters_that_grow_in_lower_case():
    dots = "İ" * 40
    assert text_of(f"<p>{dots}</p><SCRIPT>x</Script><p>Short one.</p><p>Second paragraph</p>") == [dots, "Short one.", "Second paragraph"]


def test_quotes_in_bare_values():
    assert text_of("<p title=it's>This one isn't lost</p><p data-x=a\"b>nor this</p><p title='>' alt=\">\">nor that</p>") == ["This one isn't lost", "nor this", "nor that"]


def test_links_and_short_lines_of_an_article():
    links = "".join(f"<li><a href=/{k}>A linked line {k}</a></li>" for k in range(3))
    got = text_of(f"<p>Kurz.</p><p><a href=x>all linked, first</a></p><p><a href=y>all linked, second</a></p><p>{WORDS}</p><ul>{links}</ul>")
    assert got == ["Kurz.", "all linked, first", "all linked, second", WORDS.strip(), *[f"A linked line {k}" for k in range(3)]]
    assert text_of("<p>A.</p><hr><div></div><p>B.</p>") == ["A.", "B."]


def test_names_of_an_article_own_parts():
    kept = "<section id='related-work'><p>Earlier work.</p></section><div class='search'><p>On search.</p></div><div class=entry-header><p>Head.</p></div><header><h1>Title</h1></header><div class='adverbs'>Adverbs.</div>"
    gone = "<div class='ad'>Buy.</div><aside>Aside.</aside><div class=\"post comments\">x</div><div id=comments-list>I say</div><div class='shareButtons'>Share</div><form>Mail</form><div class=related-posts>More</div><p hidden>h</p>"
    assert text_of(kept + gone + f"<p>{WORDS}</p>") == ["Earlier work.", "On search.", "Head.", "Title", "Adverbs.", WORDS.strip()]


def test_misnested_tags_lose_nothing():
    assert text_of("<b><p>One</b><p>Two<i><div>Three</i></div>Four</b></i><p>Five") == ["One", "Two", "Three", "Four", "Five"]
    assert html_text.main_text(f"<b><article><p>{WORDS}</b><p>Still in it.</article></b><p>{WORDS}") == f"{WORDS.strip()}\nStill in it."
    assert text_of(f"<p><a href=x>one<p>{WORDS}</p><a href=y>two</a> three")[1] == WORDS.strip()


def test_the_curve_decides_where_nothing_is_marked():
    menu = "".join(f"<div><a href=/{k}>Item {k}</a></div>" for k in range(8))
    foot = "<div><a href=/a>Imprint</a></div>" * 4 + "<div>2024</div>"
    bare = f"<html><body>{menu}<div><p>{WORDS}</p><p>Short.</p><p>{WORDS}</p></div>{foot}</body></html>"
    want = f"{WORDS.strip()}\nShort.\n{WORDS.strip()}"
    assert html_text.main_text(bare) == want
    lines = [t for t, _, _, dropped in html_text.lines_of(bare) if not dropped]
    assert len(lines) == 8 + 3 + 5  # without the curve all would stay


@pytest.mark.parametrize("html", [
    "<a " * 350_000, "<b>" * 125_000 + "x</i>" * 125_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<a title=\"" * 100_000,
    "<div>" * 90_000 + "x" + "</div>" * 90_000, "<!--" * 250_000, "<" * 1_000_000, "<p a=b " + "c " * 400_000, "<p>" + "long " * 400_000,
], ids=range(9))
def test_a_megabyte_of_anything_takes_seconds(html):
    html_text.main_text("<p>warm")
    began = time.process_time()
    html_text.main_text(html)
    assert time.process_time() - began < 6  # quadratic reading took minutes


def test_extra_columns_and_nulls(spark):
    rows = [(1, "u", None, "h", 5), (2, None, page(f"<p>{WORDS}"), "h", 5), (2, None, page(f"<p>{WORDS}"), "h", 5), (None, "v", " ", "h", 5)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract_text(d).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (2, None, WORDS.strip(), 99), (2, None, WORDS.strip(), 99), (None, "v", "", 0)], key=repr)
