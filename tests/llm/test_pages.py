import hashlib
import html
import re
from base64 import b32encode

import pytest

from taxaflow.llm import html_extract, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy this thing now.</div><article><header><h1>Head &amp; line</h1></header><p><b>First  paragraph<br>goes on.<p>Short.</p><div class="ad">Buy</div>
<p>Last&nbsp;one &lt;b&gt; &eacute;</p><div id="comments"><p>A reader wrote this very long comment, which is not part of it at all.</p></div></article>
<aside>Side</aside><form><p>Your mail</p></form><footer>&copy; us</footer><script>var t="</p>";</script></body></html>"""
WANT = "Head & line\n\nFirst paragraph goes on.\n\nShort.\n\nLast one <b> é"


def test_marked_article():
    assert html_extract.main_text(PAGE) == WANT


def test_unmarked_article():
    page = PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>").replace("<header>", "").replace("</header>", "")
    page = page.replace("Short.", "A longer paragraph, so that the windows surge: it has a good hundred characters of plain text in it, or more.</p><p>Short.")
    assert html_extract.main_text(page).split("\n\n")[-3:] == ["A longer paragraph, so that the windows surge: it has a good hundred characters of plain text in it, or more.", "Short.", "Last one <b> é"]
    assert html_extract.main_text(page).startswith("Head & line\n\nFirst")


def test_unmarked_article_with_lists():
    first = [f"Paragraph {i} of the first part, with a good many words of plain text in it, so that windows surge." for i in range(4)]
    last = [f"Paragraph {i} of the last part, which is lighter." for i in range(4)]
    links = [f"Link number {i}" for i in range(4)]
    tags = lambda parts: "".join(f"<p>{x}</p>" for x in parts)
    items = "<ul>" + "".join(f'<li><a href="/{i}">{x}</a></li>' for i, x in enumerate(links)) + "</ul>"
    whole = "\n\n".join([*first, *links, *last])
    menu = '<div id="top"><a href="/">Home</a></div>'
    side = '<div id="side">' + items + "<p>A text beside the article that is not part of it, though it is long enough to surge by itself, alas.</p></div>"
    parts = tags(first) + items + tags(last)
    for body in (parts, f'<div id="text">{parts}</div>{side}', f"<div><section>{tags(first)}</section>{items}<section>{tags(last)}</section></div>", f'<div class="x"><div id="part1">{tags(first)}</div>{items}<div id="part2">{tags(last)}</div></div>{side}'):
        assert html_extract.main_text(f"<html><body>{menu}{body}</body></html>") == whole
    advert = '<div class="ad">' + tags(links) + "</div>"
    assert html_extract.main_text(f"<body><div>{tags(first)}{advert}{tags(last)}</div></body>") == "\n\n".join([*first, *last])


LONG = "A paragraph of the article that is long enough to surge, with many words of plain text in it."
MARKED = [
    ("<article><p data-x=it's>First one.</p><p>It's more text</p><p>Third</p></article>", "First one.\n\nIt's more text\n\nThird"),
    ("<article><p>x<y z</p><p>a < b & c > d</p></article>", "x<y z\n\na < b & c > d"),
    ("<article><p>One</p><math><mi>E</mi></math><object><p>Two</p></object><noscript><p>Three</p></noscript><iframe>Four</iframe></article>", "One\n\nE\n\nTwo\n\nThree\n\nFour"),
    (f'<article><p class="lead search-and-rescue">{LONG}</p><p>End</p></article>', f"{LONG}\n\nEnd"),
    (f"<main><div class=x><p>A teaser beside it.</p></div><article><p>{LONG}</p></article></main>", LONG),
    (f"<main><p>{LONG}</p><article><p>A card.</p></article><p>More {LONG}</p></main>", f"{LONG}\n\nA card.\n\nMore {LONG}"),
    (f"<article><p>{LONG}</p></article><article><p>Another, shorter one.</p></article>", LONG),
    (f"<article><ul>{''.join(f'<li><a href=/{k}>Link {k}</a></li>' for k in range(5))}</ul><p>{LONG}</p><p><a href=/s>The source</a></p><p>{LONG}</p></article>", f"Link 3\n\nLink 4\n\n{LONG}\n\nThe source\n\n{LONG}"),
    ('<article><p title="a > b">One</p><p title=">">Two</p><!-- <p>no</p> --><!--> x --><p>Three</p></article>', "One\n\nTwo\n\nx -->\n\nThree"),
    ('<article><p>One</p><form><p>Name</p></form><select><option>x</select><p>Two</p></article><script>"</article>"</script>', "One\n\nTwo"),
]


@pytest.mark.parametrize(("page", "want"), MARKED)
def test_marked_pages(page, want):
    assert html_extract.main_text(page) == want


def test_hostile_pages_take_linear_time():
    import time

    for piece in ('<a b="', "<a b='", "<a b='x\" ", "<!--", "<![CDATA[", "</", "<p", "<script>", "<div><b>", "</b></i>", "<p class='", "&amp", "<a =", "<a b=c"):
        began = time.time()
        html_extract.main_text(piece * (1_000_000 // len(piece)))
        assert time.time() - began < 5, piece


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<!--", "<script>x", "<article></article>", "<nav>only</nav>"])
def test_nothing(page):
    assert html_extract.main_text(page) in ("", "<", "<p")


def test_long_page():
    page = "<article>" + "<p>word word &amp; word</p>" * 50_000 + "</article>"
    assert len(html_extract.main_text(page)) == 50_000 * len("word word & word") + 2 * 49_999


def test_registered_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages.withColumn("text", html_extract.F.lit(1))).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert html_extract.extract(pages.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, "u", PAGE), (1, "u", PAGE)], "page_id long, url string, html string")
    assert sorted(r.text for r in html_extract.extract(odd).collect()) == ["", WANT, WANT]


ROWS = [
    (5, "http://b.example.com/x", "same"), (9, "https://a.example.com:8080/x?y=z", "same"), (2, None, None), (3, "", ""), (4, "not a url\nat all", "é" * 9000),
    (7, "http://[bad/", "x"), (None, "http://b.example.com/x", "same"), (11, "http://b.example.com/x", "other"), (11, "http://b.example.com/x", "other"),
]


def test_archive(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("refers_to", warc.F.lit("x")).repartition(3)
    root = warc.write_archive(df, f"file://{tmp_path}/w", block_entries=2, range_entries=3, archive_bytes=300)
    got = warc.read_captures(warc.keys_of(df), root, payload=True).collect()
    want = []
    for page, _, text in ROWS:
        data = (text or "").encode()
        last = max(p for p, _, t in ROWS if (t or "") == (text or "") and p is not None)
        want.append((page, len(data), b32encode(hashlib.sha1(data).digest()).decode(), *(("response", None) if page == last else ("revisit", last))))
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert {bytes(r.payload).decode() for r in got if r.page_id in (4, 11)} == {"é" * 9000, "other"}
    reader = warc.Reader(root)
    assert list(reader.find("nobody 1")) == [] and list(reader.find("zz 1")) == [] and list(reader.find("")) == []
    all_large = warc.write_archive(df, f"file://{tmp_path}/v", min_bytes=1000)
    assert {r.record_type for r in warc.read_captures(warc.keys_of(df), all_large).collect()} == {"response"}
    empty = warc.write_archive(df.limit(0), f"file://{tmp_path}/e")
    assert warc.read_captures(warc.keys_of(df.limit(0)), empty).count() == 0
