import pytest
from pulcro.llm.html_text import extract_text, main_text, smoothed, threshold

LONG = "This is a paragraph of the article that is long enough to look like content. " * 3
TEXT = LONG.strip()


def page(article, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>Title</title><style>p{{}}</style></head><body>{before}{article}{after}</body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a &amp; b&nbsp;c &#233; &lt;x&gt; &copy</p>", "a & b c é <x> ©"),
        (page(f"<article><h1>Head</h1><p><b>{LONG}<br><p>Short.</article>"), f"Head\n\n{TEXT}\n\nShort."),
        (page(f"<article><p>{LONG}<p>x<script>var t='</p>';</script><style>p</style></article>"), f"{TEXT}\n\nx"),
        (
            page(
                f"<article><p>{LONG}</p><div class='ad'>Buy now</div><p>End</p><form>Name <input></form></article>",
                "<nav><ul><li><a href='/'>Home</a><li>About</ul></nav><header>Site</header><div class='cookie-notice'>We use</div>",
                "<aside>Related</aside><div id='comments'><article><p>First! " + LONG + "</p></article></div><footer>(c)</footer>",
            ),
            f"{TEXT}\n\nEnd",
        ),
        (page(f"<div class='ad'>Never closed<article><p>{LONG}</p><p>b</p></article>"), f"{TEXT}\n\nb"),
        (page(f"<div class='menu'>Menu</div><div><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></div>"), f"{TEXT}\n\none\n\ntwo\n\na b"),
        (page(f"<article><p>{LONG}</p></div></section><p>after stray ends</p>"), f"{TEXT}\n\nafter stray ends"),
        (page(f"<article><p>in<i>li</i>ne   \n white\tspace</p><!-- <p>no</p> --><p>{LONG}</p><noscript>no</noscript></article>"), f"inline white space\n\n{TEXT}"),
        (page(f"<main><section><h2>A</h2><p>{LONG}</p></section><section><h2>B</h2><p>{LONG}</p></section></main>"), f"A\n\n{TEXT}\n\nB\n\n{TEXT}"),
        ("<article><p>cut off", "cut off"),
        ("<div hidden>x</div><p role='alert'>y</p><p style='display: none'>z</p>", ""),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = extract_text(pages).collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert r["n_chars"] == len(r["text"]) > 0
        assert "<p" not in r["text"] and "&amp;" not in r["text"]


def test_nulls_repeated_rows_and_extra_columns(spark):
    frame = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x", 2), (1, "u", "<p>x", 2)], "page_id long, url string, html string, text int")
    rows = extract_text(frame).collect()
    assert sorted((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in rows) == [(0, None, "", 0), (1, "u", "x", 1), (1, "u", "x", 1)]
    assert extract_text(frame.limit(0)).count() == 0


def test_long_page():
    paragraphs = "".join(f"<p>Paragraph {i} with some more words.</p>" for i in range(20_000))
    assert main_text(page(f"<article>{paragraphs}</article>")).count("\n\n") == 19_999


def test_smoothing_and_threshold():
    assert smoothed([1.0]) == [1.0]
    assert smoothed([0, 9, 0])[1] == max(smoothed([0, 9, 0]))
    assert 1 < threshold([0, 1, 0, 9, 10]) < 9
