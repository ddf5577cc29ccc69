"""Operators over pages: main text and WARC archives."""

import gzip
import hashlib
import json
import os

import pytest

from revspark.llm.html_blocks import extract_text, main_text
from revspark.llm.warc import headers, inflated, normalise, read_archives, records, round_trip, split_records, write_archives
from revspark.session import shared_path

LONG = "A sentence of the article that is long enough to be seen as such, with a number of words. " * 2


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{margin:0}}</style></head><body>{body}</body></html>"


CASES = [
    ("", ""),
    ("just text", "just text"),
    (page("<nav><a href=/x>menu</a></nav><article><h1>Head</h1><p>One &amp; two.<br>three<p>  four\n five </article><footer>&copy;</footer>"),
     "Head\n\nOne & two. three\n\nfour five"),
    (page('<article><p><b>Open bold.<br><p>Next</p><div class="ad">Buy</div><p>Be.</p></article><aside>side</aside>'),
     "Open bold.\n\nNext\n\nBe."),
    (page("<article><header><h1>Own head</h1></header><p>Text &lt;b&gt; &eacute;&#233;&#x1F600;</p><footer>by me</footer></article>"),
     "Own head\n\nText <b> éé😀"),
    (page('<script>var t="</p><p>no</p>";</script><article>a<script>x</script>b<!-- c > d --><noscript>n</noscript></article><form>f</form>'),
     "a b"),
    (page('<article><p>kept</p><section id="comments"><p>a reader</p></section><div class="cookie-notice">ok?</div></article>'), "kept"),
    (page("<article><p>cut off <a href='/x'>link</a> and <i>more"), "cut off link and more"),
    (page("<article><p>a &lt; b</p><p>x < y and <3</p></article>"), "a < b\n\nx < y and <3"),
    (page("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><pre>x\n  y</pre></article>"), "one\n\ntwo\n\nc1\n\nc2\n\nx y"),
    (page(f"<div id=menu><a href=1>Home</a> <a href=2>News</a></div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div><a href=3>About us</a></div>"),
     f"{LONG.strip()}\n\nShort.\n\n{LONG.strip()}"),
    (page("<nav>only menu</nav><footer>end</footer>"), ""),
    ("<article>before <!-- never closed <p>gone</article>", "before"),
    ("<script>never closed <p>gone", ""),
    (page('<div class="wrap has-sidebar"><article><div class="entry-header"><h1 class="page-header">H</h1></div><figure><figcaption>cap</figcaption>'
          '</figure><p>x</p><ol class="commentlist"><li>c</ol></article><div class=sidebar><article><p>y</p></article></div></div>'), "H\n\ncap\n\nx\n\ny"),
    (page("<nav><article>no</article></nav><main><p>yes</p></main>"), "yes"),
    (page('<article><p title="a > b" hidden>no</p><p title="a > b">yes</p></article>'), "yes"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_main_text(html, text):
    assert main_text(html) == text


def prose(n, word="word"):
    return " ".join(f"{word}{k} and some more of it." for k in range(n))


ART = f"<h1>Title</h1><p>{prose(3)}</p><p>{prose(2)}</p>"
BODY = f"Title\n\n{prose(3)}\n\n{prose(2)}"


@pytest.mark.parametrize("size", [1, 4, 20, 200])
@pytest.mark.parametrize("other", [
    '<div class="cookie-notice"><p>{}</p><button>Accept</button></div>', '<section id="comments"><p>{}</p><p>{}</p></section>',
    "<form action=/x><p>{}</p><input name=q></form>", '<div class="sidebar"><h3>More</h3><p>{}</p></div>', "<aside><p>{}</p></aside>",
    '<div class="related"><p><a href=/a>{}</a></p></div>', '<div class="ad">{}</div>'])
def test_furniture_of_any_size_on_unmarked_pages(other, size):
    """What is named as furniture stays out however long it is, before or behind the article."""
    other = other.replace("{}", prose(size, "other"))
    for art, body in ((ART, BODY), (ART.replace("h1", "h2"), BODY)):
        for layout in (f"<div>{art}</div>{other}", f"{other}<div>{art}</div>", f"<div id=main><div>{art}</div>{other}</div>", f"{art}{other}"):
            assert main_text(page(layout)) == body


def test_every_block_of_the_body_is_kept():
    links = "".join(f"<p><a href=/{k}>link number {k}</a></p>" for k in range(4))
    named = "\n\n".join(f"link number {k}" for k in range(4))
    want = f"{BODY}\n\n{named}\n\nThat is all for today."
    for layout in ("{}", "<div>{}</div>", "<div><div class=text>{}</div><div><a href=/>About us</a></div></div>"):
        assert main_text(page(layout.format(f"{ART}{links}<p>That is all for today.</p>"))) == want


@pytest.mark.parametrize("wrapper", ['<div class="post-share-enabled">{}</div>', '<div class="search-result-page">{}</div>', "<form>{}</form>",
                                     '<div class="comments-open">{}</div>', '<form><div class="widget">{}</div></form>'])
@pytest.mark.parametrize("n", [4, 30])
def test_wrappers_named_like_furniture(wrapper, n):
    for art in (f"<h1>Title</h1><p>{prose(n)}</p>", f"<p>Title</p><p>{prose(n)}</p>"):
        whole = wrapper.format(f"<nav>menu</nav><div>{art}</div><div class=share><a href=/s>Share</a></div>")
        assert main_text(page(whole + "<div>(c) us</div>")) == f"Title\n\n{prose(n)}"


def test_extraction_of_rows(spark):
    rows = [(k, f"http://h/{k}", h, "x") for k, (h, _) in enumerate(CASES)] + [(None, None, None, None), (1, "u", CASES[2][0], "t")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = [(k, f"http://h/{k}", t, len(t)) for k, (_, t) in enumerate(CASES)] + [(None, None, "", 0), (1, "u", CASES[2][1], len(CASES[2][1]))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_very_long_page():
    body = "".join(f"<p>paragraph {k} &amp; more" for k in range(30_000))
    assert main_text(page(f"<article>{body}</article>")).count("\n\n") == 29_999
    assert main_text("<p " + "a='" * 20_000) == ""  # an attribute that never ends


def test_pages_of_the_tables(spark, sf):
    got = extract_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    import html
    import re
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<(?!/?(?:p|h1)>)[^>]*>", " ", x))).strip()
                  for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# ---- WARC

PAGES = [(3, "http://a/ b\n", "x" * 100), (2, "http://b", "x" * 100), (9, None, "x" * 100), (5, "http://c", "short"), (6, "http://d", "short"),
         (7, "u", None), (8, "u", ""), (2, "u2", "x" * 100), (None, "n", "x" * 100), (10, "é", "é\r\n\r\nWARC/1.1\r\n\r\n" + "y" * 100000),
         (11, "é", "é\r\n\r\nWARC/1.1\r\n\r\n" + "y" * 100000)]


def expected():
    out = []
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h] = min(first.get(h, i), i)
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = len(b) >= 100 and first.get(h) is not None and first[h] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(map(str, out))


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame([(*p, "t") for p in PAGES], "page_id long, url string, html string, record string").repartition(3)


def test_round_trip(pages):
    assert sorted(str(tuple(r)[:5]) for r in round_trip(pages).collect()) == expected()


def test_members_and_index(spark, pages):
    source, target = shared_path(spark, "warc"), shared_path(spark, "warc-normal")
    write_archives(pages, source, file_records=4)
    index = normalise(spark, source, target)
    rows = read_archives(index).collect()
    assert sorted(r["payload"].decode() for r in rows if r["payload"] is not None and r["page_id"] in (5, 10)) == sorted(
        h for i, _, h in PAGES if i == 5 or i == 10)
    entries = index.collect()
    assert len(entries) == len(PAGES)
    for name in {e["archive"] for e in entries}:
        path = name.removeprefix("file:").replace("///", "/")
        data = open(path, "rb").read()
        side = [json.loads(x) for x in open(path + ".idx")]
        assert [x["offset"] for x in side] == sorted(e["at"] for e in entries if e["archive"] == name)
        assert side[-1]["offset"] + side[-1]["length"] == len(data)
        # every member alone is a whole record; all together are the content of the monolithic file
        parts = [gzip.decompress(data[x["offset"]:x["offset"] + x["length"]]) for x in side]
        assert b"".join(parts) == gzip.decompress(data)
        assert all(p.startswith(b"WARC/1.1\r\n") and p.endswith(b"\r\n\r\n") for p in parts)
        assert [headers(p.partition(b"\r\n\r\n")[0])["warc-record-id"] for p in parts] == [x["id"] for x in side]
        assert not [f for f in os.listdir(os.path.dirname(path)) if f.endswith(".tmp")]


def test_streams():
    recs = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, os.urandom(n)) for n in (0, 5, 3_000_000)]
    one, many = gzip.compress(b"".join(recs)), b"".join(map(gzip.compress, recs))
    assert list(split_records(inflated(one))) == recs == list(split_records(inflated(many)))
    with pytest.raises(ValueError):
        list(split_records(inflated(gzip.compress(recs[1][:-3]))))


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert round_trip(none).collect() == [] and extract_text(none).collect() == [] and records(none).collect() == []
