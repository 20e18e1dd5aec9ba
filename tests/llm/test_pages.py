from gaugeweave.llm import html_extraction, line_dedup
from gaugeweave.llm.html import blocks

SCHEMA = "page_id long, url string, html string, host string, low string, lines string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "l", "x", "t") for r in rows], SCHEMA)


def article(i, extra=""):
    return (
        f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
        f"<header><h2>Site {i}</h2></header><nav><ul><li><a href='/{i}'>menu {i}</a></li></ul></nav><!-- ad --><div class=\"ad\">buy {i}</div>"
        f"<div id='cookie-notice'>we use cookies {i}</div><article><h1>Head &amp; {i}</h1><p>One  <b>bold</b>\n{i}<p>Two &lt;{i}"
        f"<div class='comments'><p>nice {i}</p></div>{extra}</article><aside>more {i}</aside><form><label>mail</label><button>go</button></form>"
        f"<footer>&copy; {i}</footer></body></html>"
    )


def texts(df, column="text"):
    return {r["page_id"]: r[column] for r in df.collect()}


def test_article_without_its_surroundings(spark):
    rows = [(i, f"https://a.example/{i}", article(i)) for i in range(5)]
    got = texts(html_extraction.extract(pages(spark, rows)))
    assert got == {i: f"Head & {i}\nOne bold {i}\nTwo <{i}" for i in range(5)}


def test_style_tree_finds_what_a_host_repeats(spark):
    """Pages without an article element: only importance tells the plain divs apart."""
    page = lambda i: f"<body><div class=x1>the same everywhere</div><div class=x2><p>own text {i}</p></div>{'<div>extra</div>' * (i % 2)}<div class=x3>tail<br>tail</div>"
    rows = [(i, f"http://B.example:80/{i}", page(i)) for i in range(6)] + [(9, "http://c.example/", page(9))]
    got = texts(html_extraction.extract(pages(spark, rows)))
    assert got[2] == "own text 2"
    assert got[9] == "the same everywhere\nown text 9\nextra\ntail\ntail"  # a site of one page shows no repetition


def test_importance_is_entropy(spark):
    source = [("h", f"<div class=a>{i}</div><div class=b>same</div><div class=c>{i % 2}</div>") for i in range(4)]
    tree = html_extraction.style_tree(spark.createDataFrame(source, "host string, html string"))
    got = {r["path"]: round(r["importance"], 6) for r in tree.collect()}
    assert got["/div.a"] == 1 and got["/div.b"] == 0 and got["/div.c"] == 0.5


def test_tree_judges_branches_inside_the_article(spark):
    page = lambda i: f"<body><article class=post><h1>Head {i}</h1><div class=box>join our list</div><p>own {i}</p></article>"
    got = texts(html_extraction.extract(pages(spark, [(i, "http://a.example/", page(i)) for i in range(8)])))
    assert got == {i: f"Head {i}\nown {i}" for i in range(8)}


def test_comments_in_article_elements_are_not_the_article(spark):
    page = lambda i: (
        f"<body><div class=post><p>own {i}</p></div><section class=comments><article><p>nice {i}</p></article></section>"
        f"<article class=comment><p>bad {i}</p></article>"
    )
    got = texts(html_extraction.extract(pages(spark, [(i, "http://a.example/", page(i)) for i in range(3)])))
    assert got == {i: f"own {i}" for i in range(3)}


def test_boilerplate_of_many_templates_goes(spark):
    """Each of 30 templates is on fewer than a twentieth of the host's pages."""
    page = lambda i: f"<body><div class=t{i % 30}><div class=x>the same in template {i % 30}</div><p>own {i}</p></div>"
    got = texts(html_extraction.extract(pages(spark, [(i, "http://a.example/", page(i)) for i in range(150)])))
    assert got == {i: f"own {i}" for i in range(150)}


def test_copies_of_an_article_stay(spark):
    got = texts(html_extraction.extract(pages(spark, [(i, "http://a.example/", article(1)) for i in range(30)])))
    assert set(got.values()) == {"Head & 1\nOne bold 1\nTwo <1"}


def test_awkward_pages(spark):
    rows = [
        (1, None, None), (2, "", ""), (3, "no address", "plain text"), (4, "http://x", "<p>a<p>b</b></i>"), (5, "http://x", "<article><p>open <b>end"),
        (6, "http://x", "<script>never closed <p>x"), (7, "http://x", "a < b & c &am"), (None, "http://x", "<p>n</p>"), (8, "//y/z", "<div " + "x" * 50_000),
        (9, "http://y", "<p>" + "long " * 30_000), (9, "http://y", "<p>" + "long " * 30_000), (10, "http://z", "<article><!-- <p>no --><p>a b</p></article tail"),
    ]
    out = html_extraction.extract(pages(spark, rows))
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == len(rows)
    got = texts(out)
    assert got[1] == got[2] == got[6] == "" and got[3] == "plain text" and got[4] == "a\nb" and got[5] == "open end"
    assert got[7] == "a < b & c &am" and got[10] == "a b" and len(got[9]) == 149_999
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    lines = line_dedup.drop_frequent_lines(pages(spark, rows))
    assert lines.count() == len(rows) and texts(lines)[4] == "a\nb"
    empty = spark.createDataFrame([], SCHEMA)
    assert html_extraction.extract(empty).count() == 0 and line_dedup.drop_frequent_lines(empty).count() == 0


def test_deep_markup_is_read():
    assert [b.text for b in blocks("<div>" * 3000 + "in" + "</div>" * 3000 + "out")] == ["in", "out"]


def brute_lines(rows, ratio, least):
    from collections import Counter, defaultdict
    from urllib.parse import urlsplit

    sites, own = defaultdict(list), {}
    for page, url, source in rows:
        own[page] = [b.text for b in blocks(source)]
        sites[(urlsplit(url).hostname or "")].append(page)
    out = {}
    for members in sites.values():
        counts = Counter(t for p in members for t in set(own[p]))
        for p in members:
            out[p] = "\n".join(t for t in own[p] if not (counts[t] >= least and counts[t] > ratio * len(members)))
    return out


def test_site_relative_lines_equal_brute_force(spark):
    rows = [(i, f"http://H{i % 3}.example/{i}", f"<p>line {i % 4}</p><p>all</p><p>own {i}</p><p>all</p>" + f"<p>host {i % 3}</p>" * (i % 5 == 0)) for i in range(60)]
    for ratio, least in ((0.1, 3), (0.26, 3), (0.9, 2), (0.0, 61)):
        got = texts(line_dedup.drop_frequent_lines(pages(spark, rows), ratio, least))
        assert got == brute_lines(rows, ratio, least)


def test_markup_of_lines_is_read_once(spark, monkeypatch, tmp_path):
    log = str(tmp_path / "read")

    def counted(source):
        with open(log, "a") as f:
            f.write("x")
        return blocks(source)

    monkeypatch.setattr(line_dedup, "blocks", counted)
    rows = [(i, "http://a.example/", f"<p>all</p><p>own {i}</p>") for i in range(30)] + [(30, None, None)]
    assert texts(line_dedup.drop_frequent_lines(pages(spark, rows))) == {i: f"own {i}" for i in range(30)} | {30: ""}
    assert len(open(log).read()) == 31


def test_query_keeps_whole_articles(spark):
    import html
    import re

    from gaugeweave.llm.queries import op8_html_extraction

    sf = "/root/testdata/sf0.001"
    got = texts(op8_html_extraction(spark, sf))
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split("</?(?:p|h[1-6]|br|li|ul)>", inner))
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)


def plain(source):
    return html_extraction.main_text(source, [])


def test_quotes_count_only_after_an_equals_sign():
    assert plain("<p data-x=it's>Body don't stop.</p><p>next</p>") == "Body don't stop.\nnext"
    assert plain("<p data-x=it's>Body.</p><p>next</p>") == "Body.\nnext"
    assert plain("<p title='a > b'>one</p><p title=\"x'>y\" b>two</p>") == "one\ntwo"
    assert plain("<p title=\"never closed>one</p><p>two</p>") == "one\ntwo"
    assert plain("<a href=x?a='b>it's <b>bold</b></a>") == "it's bold"
    assert plain("<p =x'>one</p><p a = 'q>' />two<svg /><p>three") == "one\ntwo\nthree"


def test_names_are_read_whole():
    for kept in ('<div class="content has-sidebar">text</div>', '<article class="widget story">text</article>', '<p class="no-ads">text</p>',
                 '<p class="hidden-gem">text</p>', '<div id="search-results">text</div>', '<div class="entry-header"><h1>text</h1></div>'):
        assert plain(f"<body>{kept}<div class=sidebar>aside</div></body>") == "text"
    for gone in ("class=ad", "id='cookie-notice'", "class='site-footer'", "class=\"x comment-list\"", "role=navigation", "class=related_posts"):
        assert plain(f"<body><p>text</p><div {gone}>noise</div></body>") == "text"
    assert plain("<body><div class=widget><p>all there is</p></div><nav>menu</nav></body>") == "all there is"


def test_markup_that_never_closes_is_read_once():
    import time

    for source in ("<x " * 330_000, '<a "' * 250_000, "<a b='" * 170_000, '<x a=">" ' * 110_000, "<!-" * 330_000, "</script " * 110_000, "<p =\"" * 200_000):
        start = time.perf_counter()
        list(blocks("<p>text</p>" + source))
        assert time.perf_counter() - start < 5, source[:8]
