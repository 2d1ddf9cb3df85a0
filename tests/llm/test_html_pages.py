"""Reader and alignment of the HTML extraction: long and broken pages, marks of parts, and template found by differencing."""

import os
import random
import re
import time
import tracemalloc
import zlib
from functools import cache

import pyarrow as pa
import pytest

from cohort.llm import html_extract
from cohort.llm.common import materialise
from cohort.llm.queries import QUERIES


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "x", "<div>" * 1000 + "</p>" * 100_000 + "x", "<p>" * 100_000 + "x", "<ul><li>" * 50_000 + "x",
                                  "<b>" * 50_000 + "</i>" * 50_000 + "x", "<article>" * 50_000 + "<p>x"])
def test_deep_and_broken_pages_take_linear_time(html):
    begun = time.process_time()
    assert [t for t, _ in html_extract.lines_of(html)] == ["x"]
    assert time.process_time() - begun < 5


def lcs_length(a, b):
    @cache
    def best(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + best(i + 1, j + 1) if a[i] == b[j] else max(best(i + 1, j), best(i, j + 1))
    return best(0, 0)


@pytest.mark.parametrize("cells", [1, 6, 1 << 20])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr(html_extract, "CELLS", cells)
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh"[:rng.randint(1, 8)]) for _ in range(rng.randint(0, 30))] for _ in range(2))
        one, two = html_extract.shared_lines(a, b)
        assert [a[k] for k in sorted(one)] == [b[k] for k in sorted(two)]
        assert len(one) == len(two) == lcs_length(tuple(a), tuple(b))


def test_long_pages_are_aligned_in_little_memory():
    n = 50_000
    rng = random.Random(4)
    a = [f"line {rng.randrange(n)}" if k % 3 else "often" for k in range(n)]
    b = a[n // 2:] + [f"other {k}" if k % 2 else a[k] for k in range(n // 2)]
    tracemalloc.start()
    begun = time.process_time()
    one, two = html_extract.shared_lines(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [a[k] for k in sorted(one)] == [b[k] for k in sorted(two)] and len(one) >= n // 2
    assert peak < 500e6 and time.process_time() - begun < 120


def test_marks_of_parts():
    page = "<article><p>text</p><div class='{0}'>other</div></article><div id='{0}'>more</div>"
    for name in ("comment-list", "comments-area", "comments-section", "user-comments", "reader-comments", "ad-container", "ad-slot", "advert-box", "share-buttons",
                 "social-links", "newsletter-box", "related-posts", "cookie-bar", "sidebar-left", "main-nav", "signup-form", "disqus_thread", "site-header", "site-footer"):
        assert html_extract.blocks_of(page.format(name)) == [("text", True)], name
    for name in ("content-box", "main-content", "list-items", "user-story", "text-block", "no-sidebar", "content-sidebar-wrap", "links"):
        assert [t for t, _ in html_extract.blocks_of(page.format(name))] == ["text", "other", "more"], name


def test_menus_and_footers_are_found_by_differencing(spark):
    body = "<nav><ul><li>Home<li>News {0}</ul></nav><article><p>Same opening</p><p>Text {0} &amp; more</p></article><script>x</script><footer>Imprint</footer><div hidden>Home</div>"
    pages = [(k, f"http://h/{k}", body.format(k)) for k in range(3)] + [(9, "http://alone/", body.format(9))]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {k: r["text"] for k, r in got.items()} == {k: f"Same opening\n\nText {k} & more" for k in (0, 1, 2, 9)}
    assert {k: r["n_shared"] for k, r in got.items()} == {0: 2, 1: 2, 2: 2, 9: 0}  # Home and Imprint, not the opening line


def test_template_is_found_on_the_pages_table(spark, small):
    # menus and footers of these pages are drawn at random for each page, so that neighbours share few of them
    rows = QUERIES["op2_html_extraction"](spark, small).collect()
    assert any(r["n_shared"] for r in rows)
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in rows:
        outside = sum(kind != html_extract.MAIN for _, kind in html_extract.lines_of(html[r["page_id"]]))
        assert r["n_shared"] <= outside


def word_pages(n, words=60):
    rng = random.Random(5)
    known = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(300)]
    return [(k, f"http://h{k % 7}/{k}", f"<div>Menu of {k % 7}</div><article>" + "".join(f"<p>{' '.join(rng.choices(known, k=words))} {k}</p>" for _ in range(4)) + "</article>")
            for k in range(n)]


def test_texts_are_kept_and_sent_by_blocks_of_pages(spark, monkeypatch):
    pages = word_pages(600)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)
    kept = []

    def spy(df, name):
        written = materialise(df, name)
        if name == "page-lines":
            kept.extend(os.path.getsize(f.removeprefix("file:").replace("//", "/")) for f in written.inputFiles())
        return written

    monkeypatch.setattr(html_extract, "materialise", spy)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got == {k: "\n\n".join(re.findall("<p>(.*?)</p>", html)) for k, _, html in pages}  # the menu is cut on every page
    # hashes of lines and addresses are in it too, and still it takes less than the texts compressed page by page
    assert 0 < sum(kept) < sum(len(zlib.compress(text.encode(), 6)) for text in got.values())


def test_blocks_of_pages_are_bounded_and_lose_no_line():
    big = "x y " * (html_extract.BLOCK_BYTES // 3)
    htmls = [None, "", "<p>\x00a\x1eb\x85c\n\u2028 d</p>", *[f"<p>{k}</p><p>{big if k % 40 == 0 else k}</p>" for k in range(150)], "<nav>only</nav>"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(htmls))), pa.array([f"u{k}" for k in range(len(htmls))]), pa.array(htmls)],
                                       names=["page_id", "url", "html"])
    rows = [r for b in html_extract._read([batch]) for r in b.to_pylist()]
    assert [k for r in rows for k in r["page_id"]] == list(range(len(htmls)))
    assert max(len(r["page_id"]) for r in rows) <= html_extract.BLOCK_PAGES and len(rows) == 7  # three by number, and four long pages end one each
    cuts = [[{"row": k, "cut": [], "n_shared": 0} for k in reversed(r["page_id"])] for r in rows]
    back = pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows]) for c in ("page_id", "url", "lines")), pa.array(cuts)], names=["page_id", "url", "lines", "cuts"])
    got = [r for b in html_extract._texts([back]) for r in b.to_pylist()]
    assert [r["text"] for r in got] == ["\n\n".join(t for t, _ in html_extract.blocks_of(h)) for h in batch.column(2).to_pylist()]
    assert [r["url"] for r in got] == batch.column(1).to_pylist()
