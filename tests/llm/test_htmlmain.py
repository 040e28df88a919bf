"""HTML extraction on pages with known articles."""

import pytest

from waymill.llm import htmlmain

SCHEMA = "page_id long, url string, html string, text string, host int"
NAV = '<header><a href="/">Home</a></header><nav class="top"><ul><li><a href=x>One</a></li></ul></nav>'


def page(article, around="", classes="post-12 main"):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{NAV}{around}<div class='{classes}'>{article}</div><footer>&copy; foot</footer></body></html>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>One  two\n three</p><p>x &amp; y &lt;b&gt; &#233;&eacute;</p>", "One two three x & y <b> éé"),
        ("<h1>Title</h1><p>Un<b>bro</b>ken<br>line<p>next", "Title Unbroken line next"),
        ("<p>keep</p><script>var a='<p>no</p>'</script><!-- <p>no</p> --><div class='ad'>no</div><aside>no</aside><form><input value=1>no</form><p>end</p>", "keep end"),
        ("<p>a &amp;amp; b 1 < 2 > 0</p>", "a &amp; b 1 < 2 > 0"),
        ("<p>text</p><section id='comments'><p>a reader's words, and many more of them than the article has</p></section>", "text"),
        ("<p>text</p><div class='cookie-notice'>no</div><div hidden>no</div><div role=navigation>no</div>", "text"),
        ("<table><tr><td>a<td>b</table><ul><li>c<li>d</ul>", "a b c d"),
        ("<div class='has-sidebar with-comments'><p>kept</p></div><div class='left sidebar'>no</div>", "kept"),
        ("<p title='the hidden truth'>a <a href='/p?id=menu'>b</a></p><p data-id='header'>c</p>", "a b c"),
        ("<p title=don't>a</p><p>it's b</p><p title=\"x>c</p><p>d</p>", "a it's b c d"),
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> <svg><title>no</title><path d=x /></svg>b</p>", "a x=1 b"),
        ("<p class='long-form comments-open'>a</p><div class='article-ad-slot'>no</div><a href=/x/>b</a><b><i>c</b>d</i>", "a bcd"),
        ("<p class='social-distancing'>a</p><div class='js-cookie-consent'>no</div><div class='wp-comments'>no</div><div class='comments-enabled'>b</div><div class='social-icons'>no</div>", "a b"),
        ("<p>a</ >b</>c</p></section></b><tr><td>d<tr><td>e", "abc d e"),
        ("<P CLASS=x>Caps</P><![CDATA[<raw>]]>", "Caps <raw>"),
    ],
)
def test_text(html, want):
    assert htmlmain.extract(page(html), htmlmain.path_key("html>body>div.main.post-#")) == want
    assert htmlmain.extract(f"<article>{html}</article>", htmlmain.path_key("html>article")) == want


def test_without_a_path_the_best_container_is_taken():
    long = "<p>" + "word " * 80 + "</p>"
    menu = "<div class=box>" + "<a href=x>link text</a> " * 30 + "</div>"
    assert htmlmain.extract(page(long * 2, menu), None) == ("word " * 160).strip()
    assert htmlmain.extract("", None) == "" and htmlmain.extract("just text", None) == "just text" and htmlmain.extract("<p", None) == ""


@pytest.mark.parametrize("tag", ["<article class='post long-form'>", "<article class=comments>", "<main class='sidebar'>", "<div style='overflow: hidden'>", "<div class='widget'>", "<div id=page class='site-header-container'>", "<div class='layout-sidebar-right'>"])
def test_an_article_outlives_its_marks(tag):
    body = "<h1>Title</h1>" + "<p>article words here</p>" * 20
    want = "Title" + " article words here" * 20
    assert htmlmain.extract(page(f"{tag}{body}</{tag.split()[0][1:]}>", "<div class='cookie-banner'><p>no</p></div>"), None) == want


@pytest.mark.parametrize("html", ["<a " * 350_000, "<div>" * 100_000, "<div><i>" * 50_000 + "</b></section>" * 50_000, "<script>" + "</script " * 100_000, "<p title='" * 100_000, "<!" * 400_000, "<p>" * 100_000, "<a x=\"y' " * 100_000])
def test_time_and_memory_are_in_proportion(html):
    import time
    import tracemalloc

    began = time.process_time()
    htmlmain.candidates(html)
    htmlmain.extract("<p>text</p>" + html, None)
    assert time.process_time() - began < 8
    tracemalloc.start()
    htmlmain.candidates(html)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_every_path_votes(spark):
    """A path far down every page's own ranking wins where the host's pages agree on nothing else."""
    deep = lambda i: "".join(f"<div class='only{chr(97 + i)}{k * 'x'}'>" for k in range(8))
    rows = [(i, f"http://h.example/{i}", f"<body><div class=s>{'same ' * 60}</div>{deep(i)}{'other ' * 100}", None, None) for i in range(9)]
    votes = htmlmain.candidates(rows[0][2])
    key = htmlmain.path_key("html>body>div.s")
    assert sorted(votes.values(), reverse=True).index(votes[key]) > 5
    found = htmlmain.extract_main(spark.createDataFrame([r for r in rows], SCHEMA)).collect()
    assert len(found) == 9 and len({len(r["text"]) > 0 for r in found}) == 1


def test_consensus(spark):
    body = lambda n: "<p>" + "article words here " * n + "</p>"
    side = "<div class=box>" + "<p>" + "noise that is long on one page " * 40 + "</p></div>"
    rows = [(i, f"https://Host.example.com/{i}", page(body(30), classes=f"post-{i} main"), "x", 1) for i in range(6)]
    rows.append((7, "http://host.example.com:80/7", page(body(5), side, classes="main post-99"), "x", 1))  # its own best is the side
    rows += [(8, None, page(body(20)), None, None), (9, "http://host.example.com/9", None, None, None), (None, "http://other/", "", "", 2), (9, "http://host.example.com/9", None, None, None)]
    rows.append((10, "not a url", "<p>" + "y" * 300_000 + "</p>", None, None))
    got = htmlmain.extract_main(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {(r["page_id"], r["url"]): r for r in got.collect()}
    assert got.count() == len(rows)
    assert found[7, "http://host.example.com:80/7"]["text"] == ("article words here " * 5).strip()
    assert found[0, "https://Host.example.com/0"]["n_chars"] == len(("article words here " * 30).strip())
    assert found[8, None]["text"] == ("article words here " * 20).strip()
    assert found[9, "http://host.example.com/9"]["text"] == "" and found[None, "http://other/"]["n_chars"] == 0
    assert found[10, "not a url"]["n_chars"] == 300_000
    assert htmlmain.extract_main(spark.createDataFrame([], SCHEMA)).collect() == []
