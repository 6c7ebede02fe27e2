"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

``url_parts`` splits a url without parsing it further: the host is what lies
between the first ``://`` and the next ``/``, ``?``, ``#`` or the end (A-Z
lower-cased), the path what follows up to ``?``, ``#`` or the end.  A rule
``host/path`` fits its host and all subdomains if the url's path starts with
the rule's path; the longest rule wins.

Urls without a rule are judged by a classifier: 3- to 5-character n-grams of
host and path, hashed separately, weigh in a logistic regression that is
fitted on a small labelled url table (a parameter).  Feature hashing, fit and
scoring are DataFrame and Spark ML operations.

Edge cases: a url that is null, empty or without ``://`` has an empty host and
path, fits no rule and is judged by the classifier's intercept alone (no
n-grams); very long urls are hashed whole; other columns pass through, those named
like a result column are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import literal_table, packed

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))

GOOD_WORDS = ("library", "news", "blog", "wiki", "school", "science", "garden", "history", "museum", "weather",
              "recipes", "travel", "review", "journal", "forum", "music", "health", "research", "city", "council",
              "books", "language", "teacher", "theatre", "northern", "station")
BAD_WORDS = ("casino", "bets", "pills", "spam", "track", "ads", "lottery", "poker", "jackpot", "viagra", "payday",
             "loans", "adserver", "clicks", "banner", "porn", "xxx", "slots", "winner", "cheap-meds", "free-bet",
             "spam-farm", "popups", "telemetry", "affiliate", "hacked")


def labelled_urls() -> list[dict]:
    """The small labelled table used by default: (url, label), label 1 for a url to block."""
    shapes = ("https://www.{}.test/en/{}.html", "http://{}.test/articles/{}", "https://blog.{}.test/{}/",
              "http://m.{}-online.test/fr/{}?page=2", "https://the{}.test/es/{}#top")
    rows = []
    for label, names in ((0, GOOD_WORDS), (1, BAD_WORDS)):
        for i, name in enumerate(names):
            for j in range(2):
                rows.append({"url": shapes[(i + 2 * j) % len(shapes)].format(name, 37 * i + 11 * j), "label": float(label)})
    return rows


def url_parts(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower, path


def matching_rule(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as struct(rule, verdict), null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    picks = []
    for verdict, rule in ordered:
        rule_host, slash, tail = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + tail))
        picks.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*picks)


def ngrams(part: Column, mark: str, sizes=(3, 4, 5)) -> Column:
    """Character n-grams of ``mark`` + part + ``$``; none for an empty part."""
    whole = F.concat(F.lit(mark), part, F.lit("$"))

    def of(n: int) -> Column:
        last = F.char_length(whole) - (n - 1)
        grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n))))
        return F.when((F.char_length(part) > 0) & (last >= 1), grams).otherwise(F.array().cast("array<string>"))

    return reduce(F.concat, [of(n) for n in sizes])


def _features(df: DataFrame, host: str, path: str, width: int) -> DataFrame:
    grams = F.concat(ngrams(F.col(host), "h^"), ngrams(F.col(path), "p^"))
    return HashingTF(numFeatures=width, binary=True, inputCol="_grams", outputCol="_features").transform(
        df.withColumn("_grams", grams)).drop("_grams")


def fit_url_model(spark: SparkSession, labelled: list[dict] | None = None, width: int = 1 << 15) -> LogisticRegressionModel:
    """Fit on a small driver-side table (rows of url, label)."""
    host, path = url_parts(F.col("url"))
    train = literal_table(spark, labelled or labelled_urls(), "url string, label double").select(
        host.alias("_host"), path.alias("_path"), F.col("label").alias("_label"))
    return LogisticRegression(featuresCol="_features", labelCol="_label", regParam=0.01, maxIter=40,
                              standardization=False).fit(_features(train, "_host", "_path", width))


def filter_urls(df: DataFrame, model: LogisticRegressionModel, url_col: str = "url", rules=RULES) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule``, ``score`` (probability of block) and ``verdict``."""
    df = df.drop("host", "path", "rule", "score", "verdict")
    host, path = url_parts(F.col(url_col))
    parts = df.select(packed(df), host.alias("host"), path.alias("path"))
    scored = model.transform(_features(parts, "host", "path", model.numFeatures))
    hit = matching_rule(F.col("host"), F.col("path"), rules)
    score = vector_to_array("probability")[1]
    return scored.select("_in.*", "host", "path", hit["rule"].alias("rule"), score.alias("score"),
                         F.coalesce(hit["verdict"], F.when(score > 0.5, "block").otherwise("allow")).alias("verdict"))
