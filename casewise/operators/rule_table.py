"""Rule triage with a user's rule table (J1, join form).

The rules are rows (issue, term, weight), any number of them.  A term is a
phrase of words (letters, digits, underscores) with single spaces.  Every text
gives its distinct word sequences of the lengths that occur in the table, and an equi-join
on the phrase finds the hits: no pair of text and rule is formed that does not match.

The table is broadcast only if its counted size is small (``small_bytes``); a larger one is
joined by hash, where adaptive execution splits frequent phrases.

Results: the issue with the largest sum of weights wins, ties go to the first
issue in code point order.  A text that is null, empty or without a hit gets
``NO_RULE_ISSUE`` and score 0; an issue needs a positive score to win.  Repeated
(issue, term) rows add up.  An empty table leaves every text without a hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.phrases import MARK
from ..functions.text import bind, normalize_text

NOT_TERM = r"[^\p{L}\p{N}_ ]"


def phrases(text: Column, lengths: list[int]) -> Column:
    """Distinct sequences of ``lengths`` words of a normalized text; other characters than one space part words."""
    marked = F.regexp_replace(text, NOT_TERM + "+", f" {MARK} ")

    def of(w: Column, n: int) -> Column:
        if n == 1:
            return w
        if n <= 3:
            return F.zip_with(F.slice(of(w, n - 1), F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0))),
                              F.slice(w, F.lit(n), F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(
            F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    all_of = bind(F.filter(F.split(marked, " "), lambda w: w != ""), lambda w: reduce(F.concat, [of(w, n) for n in lengths]))
    return F.array_distinct(F.filter(all_of, lambda x: ~x.contains(MARK)))


def triage_by_table(df: DataFrame, rules: DataFrame, id_col: str, text_col: str, small_bytes: int = 8 << 20) -> DataFrame:
    """One row per id: id, ``core_issue``, ``score``, ``n_matches`` (hits of all issues), ``evidence`` (the issue's terms)."""
    table = rules.select(F.col("issue").alias("_issue"), normalize_text(F.col("term")).alias("_phrase"),
                         F.round(F.col("weight") * 1000).cast("long").alias("_milli")).where("_phrase <> '' AND _issue IS NOT NULL")
    # Distinct lengths are few: the longest phrase bounds them.
    seen = table.agg(F.collect_set(F.size(F.split("_phrase", " "))).alias("lengths"),
                     F.max(F.col("_phrase").rlike(NOT_TERM)).alias("bad"),
                     F.sum(F.octet_length("_phrase") + F.octet_length("_issue") + 32).alias("bytes")).first()
    if seen["bad"]:
        raise ValueError("a rule term may hold letters, digits, underscores and spaces only")
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    blank = texts.select("_id", F.lit(None).cast("string").alias("_issue"), F.lit(None).cast("string").alias("_phrase"),
                         F.lit(0).cast("long").alias("_milli"))
    if seen["lengths"]:
        said = texts.select("_id", F.explode(phrases(normalize_text(F.col("_text")), sorted(seen["lengths"]))).alias("_phrase"))
        hits = said.join(F.broadcast(table) if seen["bytes"] <= small_bytes else table, "_phrase")
        blank = blank.unionByName(hits)
    # Laid by id once: both groupings keep that layout.
    issues = blank.repartition("_id").groupBy("_id", "_issue").agg(
        F.sum("_milli").alias("_score"), F.count("_phrase").alias("_n"), F.sort_array(F.collect_list("_phrase")).alias("_terms"))
    best = issues.groupBy("_id").agg(
        F.min(F.struct((-F.col("_score")).alias("less"), "_issue", "_terms")).alias("_best"), F.sum("_n").alias("n_matches"))
    won = F.col("_best.less") < 0
    return best.select(
        F.col("_id").alias(id_col), F.when(won, F.col("_best._issue")).otherwise(F.lit(L.NO_RULE_ISSUE)).alias("core_issue"),
        F.when(won, -F.col("_best.less") / 1000.0).otherwise(F.lit(0.0)).alias("score"), "n_matches",
        F.when(won, F.col("_best._terms")).otherwise(F.array().cast("array<string>")).alias("evidence"))
