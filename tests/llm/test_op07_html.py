import html
import re

import pytest
from conftest import SF_SMALL

from casewise.llm import html_extract as H
from casewise.llm.queries import op7_html_extraction

CASES = [
    ("<p>a<p>b &amp; c&nbsp;d<br>e", "a\nb & c d\ne"),
    ("<nav>menu</nav><article><h1>T</h1><p>x <b>y</b>z</p></article><aside>s</aside><footer>f</footer>", "T\nx yz"),
    ("<header>H</header><main><header><h1>T</h1></header><p>1</p><form>go<input></form><script>a<b</script></main>", "T\n1"),
    ("<body><div id=sidebar>s</div><div class='post-content'><p>one</p>two</div><div class='comments'><article><p>c</p></article></div>", "one\ntwo"),
    ("<article><p>a</p><div class=\"ad box\">buy</div><div class='cookie-notice'>n</div><ul><li>i<li>j</ul><table><tr><td>k<td>l</table></article>",
     "a\ni\nj\nk\nl"),
    ("<article class='has-sidebar'><section class='comments'>c</section><p>t &lt;b&gt; &#233;</p><!-- x <p>y</p> --><p>cut <fo", "t <b> é\ncut"),
    ("<title>t</title><style>p{}</style><p hidden>h</p><p title='a>b'>q</p><p>1 < 2</p>", "q\n1 < 2"),
    ("<article><p>5 &lt; 6<p>" + "w " * 50_000 + "</article>", "5 < 6\n" + ("w " * 50_000).strip()),
    ("", ""), (None, ""), ("plain", "plain"), ("<div><div><div>", ""), ("</p></article>x", "x"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_parse_rules(page, want):
    assert H.main_text(page, H.Labels(), {}, set()) == want


BODY = "The body is longer than any teaser."


@pytest.mark.parametrize("page,want", [
    ("<main><p>body</p><section><article><p>teaser</p></article></section></main>", "body\nteaser"),
    (f"<p>{BODY}</p><div class='post'><p>teaser</p></div><article>card</article>", f"{BODY}\nteaser\ncard"),
    (f"<div class=story>{BODY}</div><article>card</article><p>link</p>", f"{BODY}\ncard"),
    (f"<p>{BODY}</p><article class='comment'>{BODY} {BODY}</article>", BODY),
    ("<main>a<article class='user-comment'>no</article><article class='post comments-open'>b</article></main>", "a\nb"),
    ("<article><h1>A</h1>one</article><article>two</article><p>x</p>", "A\none\ntwo"),
])
def test_content_element_by_the_slots_it_holds(page, want):
    assert H.main_text(page, H.Labels(), {}) == want


@pytest.mark.parametrize("page,want", [
    ("<p>a</p><a href=\"x\"\">b</a><p>c</p><a href=\"y\">d</a><p>e</p>", "a\nb\nc\nd\ne"),
    ("<a href=/don't>one</a><p>two <a title='x'>three</a>", "one\ntwo three"),
    ("<a href=/x?q=\">x</a><p>y \"z\"</p>", "x\ny \"z\""),
    ("<p>a</p><a href=\"x>b</a><p>c</p>", "a\nb\nc"),
    ("<p title=\"a>b\" lang = 'c>d'>q</p><div class=\"ad\"\">buy</div><p data-x='1'class=ad>buy</p>t", "q\nt"),
    ("İ" * 9 + "<SCRIPT>var a = '</scripts>';</Script ><p>text</p>", "İ" * 9 + "\ntext"),
    ("<title>t" + "İ" * 50 + "</title><style>p{}</style><p>" + "w " * 9 + "</p>x", ("w " * 9).strip() + "\nx"),
])
def test_malformed_pages(page, want):
    assert H.main_text(page, H.Labels(), {}) == want


def test_malformed_tags_take_linear_time():
    for page in ("<a " + "\"' = " * 200_000, "<a b" + " " * 500_000 + "c", "<a x='" * 100_000, "<a =\"" * 100_001 + ">t"):
        H.main_text(page, H.Labels(), {})


def test_template_is_deduced(spark):
    """Without semantic marks, what all pages of a host share is template and the rest is text."""
    page = "<html><body><div><p>Welcome to our site</p><div><p>News every day</p></div></div><div><p>{}</p><p>{}</p></div><div><p>All rights kept</p></div></body></html>"
    rows = [(i, f"http://Host.example/{i}", page.format(f"body {i}", "shared words" if i < 3 else f"more {i}"), "x", 1) for i in range(12)]
    rows += [(100, "http://lone.example/", page.format("a", "b"), "x", 1), (101, None, page.format("c", "d"), "x", 1),
             (102, "http://host.example/n", None, "x", 1), (103, "http://host.example/o", "<p>other layout</p>", "x", 1)]
    df = spark.createDataFrame(rows + rows[:2], "page_id long, url string, html string, text string, pages int").repartition(4)
    got = H.extract(df).collect()
    assert len(got) == len(rows) + 2
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[i] == f"body {i}\n" + ("shared words" if i < 3 else f"more {i}") for i in range(12))
    assert text[100].startswith("Welcome") and text[101].startswith("Welcome") and text[102] == "" and text[103] == "other layout"


def test_classes_must_be_ordered_and_nested():
    assert H.deduce([1, 2, 9, 3], {7: [1, 2, 3]}) == {1, 2, 3}
    assert H.deduce([2, 1, 3], {7: [1, 2, 3]}) == set()
    outer, inner = [1, 2, 3, 4], [5, 6, 7]
    assert H.deduce([1, 2, 5, 6, 7, 5, 6, 7, 3, 4], {1: outer, 2: inner}) == {*outer, *inner}
    assert H.deduce([1, 5, 2, 6, 3, 7, 4], {1: outer, 2: inner}) == set(outer)


def test_articles_of_the_given_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    for r in op7_html_extraction(spark, SF_SMALL).collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]], re.S)
        blocks = [re.sub(r"<[^>]*(>|$)", "", b) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", body[1] if body else "")]
        blocks = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def _texts(spark, hosts):
    """Texts by (host, number) of pages given as {host: [html]}."""
    rows = [(f"{h}/{i}", f"http://{h}.example/{i}", p) for h, pages in hosts.items() for i, p in enumerate(pages)]
    got = H.extract(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows)
    return {r["page_id"]: r["text"] for r in got}


def test_template_inside_articles(spark):
    """One support rule for all host sizes, also inside content elements; what articles quote stays."""
    page = "<html><body><article><p>Log in to read on</p>{}<p>body {}</p>{}</article></body></html>"
    extra = "<div class='box'><p>Our offer</p><ul><li>Now cheaper</li></ul></div>"
    text = _texts(spark, {f"h{n}": [page.format(extra if i < 0.7 * n else "", i, "<p>quoted</p>" if i % 3 else "") for i in range(n)]
                          for n in (6, 30)})
    for n in (6, 30):
        assert all(text[f"h{n}/{i}"] == f"body {i}" + ("\nquoted" if i % 3 else "") for i in range(n))


def test_copies_of_a_page_are_no_template(spark):
    frame = "<html><body><div><p>Welcome</p></div><div>{}</div></body></html>"
    marked = "<html><body><p>Welcome</p><article><h1>Title</h1><p>one</p><p>two {}</p></article></body></html>"
    text = _texts(spark, {"marked": [marked.format("of the copies")] * 57 + [marked.format(i) for i in range(3)],
                          "plain": [frame.format("<p>one</p><p>two</p><p>three</p>")] * 3 + [frame.format(f"<p>own {i}</p>") for i in range(3)],
                          "same": [frame.format("<p>all alike</p>")] * 5})
    assert all(text[f"marked/{i}"] == ("two of the copies" if i < 57 else f"two {i - 57}") for i in range(60))
    assert all(text[f"plain/{i}"] == ("one\ntwo\nthree" if i < 3 else f"own {i - 3}") for i in range(6))
    assert all(text[f"same/{i}"] == "Welcome\nall alike" for i in range(5))


ARTICLE = "<h1>The long title of article {0}</h1>" + "".join(f"<p>Paragraph {k} of article {{0}} says some ten words more here.</p>" for k in range(5))


def lines(page):
    """Text blocks of a page by the plainest reading: what stands between tags."""
    return "\n".join(x.strip() for x in re.split("<[^>]*>", page) if x.strip())


def test_near_copies_of_an_article_keep_it(spark):
    """Three near copies beside other articles, near copies only, and two of them: the article stays and the frame goes where it can be told."""
    frame = "<html><body><div><p>Welcome</p><p>Menu one</p><p>Menu two</p></div>{}</body></html>"
    body = lambda i, k: f"<article>{ARTICLE.format(i)}<p>updated {k}</p></article>"
    hosts = {"mixed": [body("x", k) for k in range(3)] + [body(i, "never") for i in range(3)],
             "most": [body("x", k) for k in range(9)] + [body(i, "never") for i in range(3)],
             "only": [body("x", k) for k in range(4)], "two": [body("x", k) for k in range(2)]}
    plain = {h + "-plain": [p.replace("article>", "div>") for p in pages] for h, pages in hosts.items()}
    text = _texts(spark, {h: [frame.format(p) for p in pages] for h, pages in (hosts | plain).items()})
    for h, pages in (hosts | plain).items():
        for i, p in enumerate(pages):
            own = lines(p)
            if h in ("mixed", "most", "mixed-plain", "most-plain", "only", "two"):
                assert text[f"{h}/{i}"] == own, h
            else:                                          # near copies only and no mark: nothing tells frame from text, and no text is lost
                assert text[f"{h}/{i}"].endswith(own)


@pytest.mark.parametrize("name,kept", [
    ("notice-period", True), ("share-price", True), ("sharePrice", True), ("login-history", True), ("notice", False), ("share-buttons", False),
    ("cookie-notice", False), ("ad box", False), ("ad_container", False), ("user-comment", False), ("comments list", False), ("top-box", True)])
def test_class_names_inside_content(name, kept):
    page = f"<article><p>one</p><div class='{name}'>two</div><p>three</p></article>"
    assert H.main_text(page, H.Labels(), {}) == ("one\ntwo\nthree" if kept else "one\nthree")


def test_hosts_of_few_pages(spark):
    """Two pages share a menu; single pages of many hosts share a layout."""
    page = "<html><body><div class=top><p>Home of all</p><p>About us</p><p>Write to us</p></div><div class=rest><p>{}</p><p>{}</p></div></body></html>"
    own = lambda i: (f"A first line that only page {i} holds and no other.", f"A second line of page {i}, as long as the first one.")
    hosts = {"two": [page.format(*own("a")), page.format(*own("b"))]} | {f"one{k}": [page.format(*own(k))] for k in range(4)}
    text = _texts(spark, hosts)
    assert text["two/0"] == "\n".join(own("a")) and text["two/1"] == "\n".join(own("b"))
    assert all(text[f"one{k}/0"] == "\n".join(own(k)) for k in range(4))


def slow_template(pages, support=0.5, least=3):
    """Tokens of a host's candidate classes straight from occurrence vectors."""
    found = [tuple(t[0] for t in H.parse(p, H.Labels())) for p in pages]
    found = list(dict.fromkeys(found))
    vectors = {}
    for t in set().union(*found):
        v = tuple(f.count(t) for f in found)
        if sum(map(bool, v)) >= max(2, support * len(found)):
            vectors.setdefault(v, set()).add(t)
    return {frozenset(c) for c in vectors.values() if len(c) >= least}


def test_classes_against_occurrence_vectors(spark):
    """The classes of the given pages' hosts equal those from whole occurrence vectors."""
    from pyspark.sql import functions as F
    from casewise.llm.url_filter import url_parts
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").withColumn("h", url_parts(F.col("url"))[0]).filter("h <> ''")
    hosts = {}
    for r in pages.collect():
        hosts.setdefault(r["h"], []).append(r["html"])
    once = H.page_tokens(pages.select(F.xxhash64("h"), "html"))
    names = {r[1]: r[0] for r in pages.select("h", F.xxhash64("h")).distinct().collect()}
    got = {names[r["host"]]: r["template"] for r in H.templates(once).collect()}
    for h, ps in hosts.items():
        classes = {}
        for t in got.get(h, []):
            classes.setdefault(t["cls"], set()).add(t["token"])
        assert set(map(frozenset, classes.values())) == slow_template(ps), h


def test_a_hundred_thousand_shared_lines(spark):
    """Templates of very long pages take linear time."""
    import time
    shared = "".join(f"<p>line {n}</p>" for n in range(100_000))
    pages = [f"<html><body>{shared}<article><p>{'own words ' * 20_000}{i}</p></article></body></html>" for i in range(4)]
    start = time.time()
    text = _texts(spark, {"long": pages})
    assert time.time() - start < 20
    assert all(text[f"long/{i}"].endswith(f"own words {i}") and "line 5" not in text[f"long/{i}"] for i in range(4))


def test_empty(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
