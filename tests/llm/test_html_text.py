import random
import re

import time

import pytest

from ruleframe.llm import html_text, queries
from ruleframe.llm.common import Scratch

SCHEMA = "page_id long, url string, html string, host string, lines long, n long, part string, text string"


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, u, h, "x", 1, 2, "p", "t") for i, u, h in rows], SCHEMA).repartition(3)
    return {(r["page_id"], r["url"]): r for r in html_text.main_text(df, Scratch(spark, "test"), **options).collect()}


def text_of(spark, source):
    return found(spark, [(1, "http://a.example/x", source)])[(1, "http://a.example/x")]["text"]


@pytest.mark.parametrize(
    "source,text",
    [
        ("<article><p>One  two\n three</p><p>four</p></article>", "One two three four"),
        ("<nav>menu</nav><article>body</article><footer>foot</footer>", "body"),
        ("<article>a &amp; b &#233; &eacute; &lt;tag&gt; &nbsp;x</article>", "a & b é é <tag> x"),
        ("<p>a<br>b</p>", "a b"),
        ("<p>a<b>b</b>c</p>", "abc"),
        ("<article><p>text<script>var t='</p>';</script> more</p><style>p{}</style></article>", "text more"),
        ("<article>x<!-- hidden > --> y</article>", "x y"),
        ("<div class='comments'><p>spam</p></div><article><p>real</p><form>f</form></article>", "real"),
        ("<article>kept<div class=\"ad\">buy</div> end</article>", "kept end"),
        ("<article><p>unclosed <b>bold<p>next", "unclosed bold next"),
        ("<article><h1>Title</h1><ul><li>one<li>two</ul></article>", "Title one two"),
        ("plain text < 5 & more", "plain text < 5 & more"),
        ("", ""), (None, ""), ("<script>never closed", ""),
    ],
)
def test_pages_by_their_own_marks(spark, source, text):
    out = found(spark, [(1, "u", source)])[(1, "u")]
    assert out["text"] == text and out["n_chars"] == len(text)


def page(body, k):
    return f"<html><div>Site name</div><div>Menu one</div><div>Menu two</div>{''.join(f'<p>{x}</p>' for x in body)}<div>All rights</div><div>seen {k} times</div></html>"


def test_lines_shared_with_the_nearest_page_go(spark):
    rows = [(k, f"http://site.example/a/{k}", page([f"own text {k} part {j}" for j in range(3)], 7)) for k in range(6)]
    out = found(spark, rows)
    assert all(out[(i, u)]["text"] == " ".join(f"own text {i} part {j}" for j in range(3)) for i, u, _ in rows)


def test_a_page_alone_on_its_host_keeps_its_lines(spark):
    out = found(spark, [(1, "http://one.example/x", page(["body"], 1)), (2, "http://two.example/x", page(["body"], 2))])
    assert "Site name" in out[(1, "http://one.example/x")]["text"]


def test_an_article_published_twice_stays(spark):
    rows = [(k, f"http://site.example/a/{k}", "<nav>m</nav><article><p>the very same article</p></article>") for k in range(4)]
    assert {r["text"] for r in found(spark, rows).values()} == {"the very same article"}


def test_longest_common_subsequence_against_the_table():
    rng = random.Random(1)

    def length(a, b):
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
        return row[-1][-1]

    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(12))] for _ in range(2))
        shared = html_text.shared_lines(a, b)
        chosen = [x for x, s in zip(a, shared, strict=True) if s]
        it = iter(b)
        assert sum(shared) == length(a, b) and all(x in it for x in chosen)


def test_a_host_with_most_pages_is_spread(spark):
    rows = [(k, f"http://hot.example/p/{k:04d}", page([f"own {k}"], 3)) for k in range(120)]
    out = found(spark, rows, group_pages=16)
    assert all(out[(i, u)]["text"] == f"own {i}" for i, u, _ in rows)


def test_pages_of_a_hot_host_meet_their_nearest_different_neighbours(spark):
    # a line is shared with the next page only, and pages stand in runs of copies, some longer than a range
    rows, wanted, k = [], {}, 0
    for section in range(40):
        for _ in range(40 if section % 7 == 3 else 3):
            rows.append((k, f"http://hot.example/{section:03d}/{k:05d}", f"<p>pair {section // 2}</p><p>own {section}</p>"))
            wanted[k] = f"own {section}"
            k += 1
    out = found(spark, rows, group_pages=16)
    assert {i: r["text"] for (i, _), r in out.items()} == wanted


def test_awkward_rows(spark):
    rows = [(1, None, "<p>x</p>"), (None, None, None), (2, "", "<p>y</p>"), (3, "no-scheme/path", "<p>z</p>"), (4, "http://h/very", "<p>" + "long " * 200_000 + "</p>"), (5, "http://h/deep", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    out = found(spark, rows + rows[:1])
    assert {k for k in out} == {(i, u) for i, u, _ in rows}
    assert out[(4, "http://h/very")]["n_chars"] == 5 * 200_000 - 1 and out[(5, "http://h/deep")]["text"] == "deep"
    assert found(spark, []) == {}


def test_query_over_the_table(spark, small):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    out = queries.QUERIES["op7_html_extraction"](spark, small).collect()
    assert sorted(r["page_id"] for r in out) == sorted(pages)
    for r in out:
        title = re.search(r"<title>(.*?)</title>", pages[r["page_id"]]["html"] or "")
        assert not re.search(r"<p>|track\(\d+\)|&copy;", r["text"])
        assert r["n_chars"] == len(r["text"]) and (title is None or r["text"])


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<p>", "<b>", "<!-- ", "<script>", "</p>"])
def test_time_grows_with_the_page(piece):
    began = time.perf_counter()
    html_text.page_lines(piece * 60_000 + "> end")
    assert time.perf_counter() - began < 10


def test_names_that_only_hold_a_mark_keep_their_text():
    kept = '<div class="post-share-enabled"><p>Body</p></div><div class="entry notice-board">Two</div>'
    assert [x for x, _ in html_text.page_lines(kept)] == ["Body", "Two"]
    gone = '<div class="cookie-banner">a</div><div class="share-buttons">b</div><p class="site-nav">c</p><div id="comments">d</div>'
    assert html_text.page_lines(gone) == []
    assert html_text.page_lines('<a title="a>b" href=x>yes</a> <i title=\'q"\'>z</i> <math><mi>x</mi></math>') == [("yes z x", False)]


def test_alignment_of_many_equal_lines():
    a, b = ["x"] * 3_000 + ["own"], ["y", *["x"] * 2_500]
    assert sum(html_text.shared_lines(a, b)) == 2_500 and not html_text.shared_lines(a, b)[-1]
