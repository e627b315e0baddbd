import html as entities
import re

from treeledger.llm import extraction, urlfilter
from treeledger.llm.extraction import Page

LINKS = extraction.StyleTree().links


def text_of(html):
    page = Page(html)
    return page.text(*page.known(LINKS), set())


def test_supplied_pages(spark, small_dir):
    """Each page's article, cut out by its known layout."""
    pages = spark.read.parquet(f"{small_dir.parent}/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extraction.main_texts(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"<p>|</p>|<h1>|</h1>", body))
        want = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


def test_known_styles():
    assert text_of(
        '<body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=/>x</a></nav><main><article><header><h1>T &amp; t</h1></header><p>One<p>two '
        '<b>x</b>y<ul><li>a<li>b</ul><div class="share-buttons">S</div><section id="comments"><p>c1</article></main><aside>z</aside><footer>f</footer>'
    ) == "T & t\nOne\ntwo xy\na\nb"
    assert text_of(
        '<div id=menu><ul><li><a href=x>Home</a></li></ul></div><div class=c>Text <i>a</i>b<br>c</div><ul><li><a href=1>Link text</a><li>plain</ul>'
        '<form>f<input>g</form>tail < 5 &lt; 6<script>if(a<b){"</p>"}</script>') == "Text ab c\nplain\ntail < 5 < 6"
    assert text_of("") == "" and text_of("<p") == "<p" and text_of("<!-- a <p>b") == "" and text_of("a &nbsp; b<p>\n c") == "a b\nc"


def site(host, n, notice):
    return [(k, f"http://{host}/{k}", f'<div class="x1">{notice}</div><div class="y2">{" ".join(f"word{k * j}" for j in range(1, 9))}</div>') for k in range(n)]


def test_branches_alike_on_every_page_go(spark):
    rows = site("a.net", 12, "Same words everywhere") + [(100 + k, u, h) for k, u, h in site("b.net", 3, "Same words everywhere")]
    rows += [(200, None, None), (201, "x", ""), (202, "http://c.net/", "<p>" + "long text " * 50_000), (0, *site("a.net", 1, "Same words everywhere")[0][1:])]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, low string")
    got = [(r.page_id, r.text) for r in extraction.main_texts(pages).collect()]
    assert len(got) == len(rows)
    for k, text in got:
        if k < 100:
            assert text.startswith("word") and "Same" not in text
        elif k < 200:
            assert text.startswith("Same words everywhere\nword")
    texts = dict(got)
    assert texts[200] == "" and texts[201] == "" and len(texts[202]) == 499_999
    assert extraction.main_texts(pages.limit(0)).count() == 0


def test_host_path_and_longest_rule(spark):
    urls = [
        "http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x", "http://x.com/de/1", "http://x.com/fr/", "http://y.org/", "http://y.org", None, "no scheme",
        "http://notexample.org/es/", "ftp://É.com/de/ä#t", "://", "http://com/de/x",
    ]
    pages = spark.createDataFrame([(k, u, None, 1) for k, u in enumerate(urls)], "page_id long, url string, html string, match_ int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judged(pages).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2][2:] == ("com/de/", "block") and got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("org/", "allow")
    assert got[5] == ("y.org", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8][2:] == ("org/", "allow") and got[9] == ("É.com", "/de/ä", "com/de/", "block") and got[10] == ("", "", None, "allow")
    assert got[11][2:] == ("com/de/", "block")
    assert urlfilter.judged(pages.limit(0)).count() == 0


def test_trust_and_distrust_travel(spark):
    link = '<a href="http://{}/x">l</a><A HREF=//{}/>'
    rows = [
        (1, "http://bad.com/de/1", link.format("deep.net", "deep.net")), (2, "http://friend.net/1", link.format("bad.com", "BAD.com")),
        (3, "http://friend.net/2", None), (4, "http://good.org/1", link.format("liked.net", "liked.net")), (5, "http://liked.net/", link.format("other.net", "x")),
        (6, "http://deep.net/", ""), (7, "http://bad.com/en/1", ""),
    ]
    got = {r.page_id: r for r in urlfilter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k].verdict for k in (1, 2, 3, 4, 6, 7)] == ["block", "block", "block", "allow", "allow", "block"]
    assert got[5].trust > 0 and got[5].distrust == 0 and got[3].distrust > 0 and got[6].distrust == 0
