import pytest
from pyspark.sql import functions as F

from casewise.llm import url_filter as U


@pytest.fixture(scope="module")
def model(spark):
    return U.fit_url_model(spark)


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def rule_of(host, path):
    best = None
    for verdict, rule in U.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best


URLS = [None, "", "no scheme", "http://", "http://Example.ORG/es/1", "https://a.example.org/en/1x?q#f", "https://example.org/en/2",
        "http://x.com/fr/9", "http://x.com/de/9", "http://org", "http://org/", "ftp://ÄB.org:80/a", "http://a.b?x://y/z", "http://notorg/fr/",
        "http://x.net/\nfr/", "http://Xcom/fr/1", "http://h.net" + "/p" * 9000, "http://casino-pills.net/en/3"]


def test_parts_and_rules(spark, model):
    df = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(URLS)], "page_id long, url string, host string, probability double")
    got = {r["page_id"]: r for r in U.filter_urls(df, model).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = parts(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        hit = rule_of(host, path)
        assert got[i]["rule"] == (hit and hit[1])
        assert got[i]["verdict"] == (hit[0] if hit else "block" if got[i]["score"] > 0.5 else "allow")
        assert got[i]["probability"] == 1.0


def test_ngrams(spark):
    got = spark.createDataFrame([("ab",), ("",), (None,)], "s string").select(U.ngrams(F.col("s"), "h^", (3, 5)).alias("g")).collect()
    assert [r["g"] for r in got] == [["h^h^a", "h^^ab", "h^ab$", "h^h^ab$"], [], []]


def test_held_out_urls(spark, model):
    names = {"casino-night": "block", "free-bets-now": "block", "cheap-pills": "block", "spam-mail": "block", "ads-track": "block",
             "town-library": "allow", "science-news": "allow", "garden-blog": "allow", "music-school": "allow", "city-weather": "allow"}
    df = spark.createDataFrame([(f"https://www.{n}.net/en/{i}", v) for n, v in names.items() for i in range(3)], "url string, want string")
    got = U.filter_urls(df, model)
    assert got.filter("verdict = want").count() >= 0.9 * got.count()


def test_empty(spark, model):
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string"), model).count() == 0
