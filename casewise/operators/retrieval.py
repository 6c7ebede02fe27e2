"""C5 retrieval triage: rule baseline + weighted neighbour votes.

For each query complaint the k nearest corpus complaints (``similar``) vote
on issue, department and priority with their rounded similarity as weight.
Each query owns at most k neighbour rows, so the vote is computed on a
bounded per-query array with higher-order functions after one ``groupBy``.
Weights are integer thousandths: sums and ties are exact; ties go to the
value seen first (lowest rank), as in an insertion-ordered dict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.scores import clamp_milli, fmt_fixed, milli_fmt2, milli_to_double, reasoning
from .rules import rule_triage
from .similar import similar_complaints



def _vote(neigh: Column, field: str) -> Column:
    """A14 + W2: weighted arg-max of ``field`` over the neighbour array, first seen wins ties."""
    values = F.array_distinct(F.transform(neigh, lambda x: x[field]))
    scored = F.transform(values, lambda v: F.struct(
        F.aggregate(F.filter(neigh, lambda x: x[field] == v), F.lit(0).cast("long"),
                    lambda acc, x: acc + x["milli"]).alias("w"),
        (-F.array_min(F.transform(F.filter(neigh, lambda x: x[field] == v), lambda x: x["rank"]))).alias("r"),
        v.alias("v")))
    return F.array_max(scored)["v"]


def neighbour_summary(neigh: DataFrame) -> DataFrame:
    """Per query: the ranked neighbour array and the statistics the verdict needs."""
    milli = F.floor(F.col("raw_score") * 1000 + 0.5).cast("long")
    rows = neigh.select("query_id", F.struct(
        F.col("rank"), milli.alias("milli"), F.col("complaint_id"), F.col("complaint_text"), F.col("department"),
        F.col("priority"), F.col("core_issue")).alias("n"))
    g = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("n")).alias("neigh"))   # <= k rows per query
    nb = F.col("neigh")
    return g.select(
        "query_id", "neigh",
        F.size(nb).alias("n_neigh"),
        F.array_max(F.transform(nb, lambda x: x["milli"])).alias("max_milli"),
        F.aggregate(nb, F.lit(0).cast("long"), lambda acc, x: acc + x["milli"]).alias("sum_milli"),
        F.size(F.filter(nb, lambda x: (x["rank"] <= 3) & (x["milli"] >= 600))).alias("strong"),
        _vote(nb, "core_issue").alias("v_issue"),
        _vote(nb, "department").alias("v_department"),
        _vote(nb, "priority").alias("v_priority"),
    )


def retrieval_verdict(baseline: Column, s: dict) -> Column:
    """Assemble the verdict from the rule baseline struct and neighbour summary columns."""
    n = s["n_neigh"]
    has = F.coalesce(n, F.lit(0)) > 0
    bm = F.round(baseline["confidence_score"] * 1000).cast("long")
    num = n * bm * 7 + n * s["max_milli"] * 9 + s["sum_milli"] * 7 + n * s["strong"] * 1500
    milli = clamp_milli(F.floor((num * 2 + n * 28) / (n * 56)))
    issue, dept, prio = s["v_issue"], s["v_department"], s["v_priority"]
    ents = F.array_sort(F.array_distinct(baseline["detected_entities"]))
    task = F.coalesce(F.element_at(F.create_map(*[x for i in L.ISSUE_NAMES for x in (F.lit(i), F.lit(L.ISSUE_TASK[i]))]),
                                   issue), baseline["actionable_task"])
    avg_centi = F.floor((s["sum_milli"] * 2 + n * 10) / (n * 20))
    evidence = F.concat(baseline["supporting_evidence"], F.array(
        F.concat(F.lit("Retrieved "), n.cast("string"), F.lit(" semantically similar complaints via FAISS.")),
        F.concat(F.lit("Top retrieval similarity: "), milli_fmt2(s["max_milli"]), F.lit("; average similarity: "),
                 fmt_fixed(avg_centi, 2), F.lit("."))))
    examples = F.transform(s["neigh"], lambda x: F.struct(
        x["complaint_id"].alias("complaint_id"), x["complaint_text"].alias("complaint_text"),
        x["department"].alias("department"), x["priority"].alias("priority"), x["core_issue"].alias("core_issue"),
        milli_to_double(x["milli"]).alias("similarity")))
    voted = F.struct(
        issue.alias("core_issue"), ents.alias("detected_entities"), dept.alias("department"), prio.alias("priority"),
        task.alias("actionable_task"), milli_to_double(milli).alias("confidence_score"),
        reasoning(issue, dept, prio, ents, "retrieval-augmented").alias("reasoning"),
        F.lit(L.MODE_RETRIEVAL).alias("analysis_mode"), evidence.alias("supporting_evidence"),
        examples.alias("retrieved_examples"))
    fallback = baseline.withField("analysis_mode", F.lit(L.MODE_RETRIEVAL))
    return F.when(has, voted).otherwise(fallback)


def retrieval_triage(queries: DataFrame, corpus: DataFrame, k: int = L.DEFAULT_TOP_K, *,
                     id_col: str = "complaint_id", text_col: str = "complaint_text", out_col: str = "analysis",
                     baseline_col: str | None = None, exclude_self: bool = False,
                     neigh: DataFrame | None = None) -> DataFrame:
    """Add the retrieval verdict ``out_col`` to every query row.

    ``corpus`` needs ``id_col``, ``text_col`` and the three ``true_*`` labels.
    If ``baseline_col`` names an existing rule verdict it is reused; ``neigh`` may bring the
    neighbours along (a saved ``similar_complaints`` result for these queries).
    """
    q = queries
    if baseline_col is None:
        q = rule_triage(q, text_col, out_col="_baseline")
        baseline_col = "_baseline"
    neigh = neigh if neigh is not None else similar_complaints(queries.select(id_col, text_col), corpus, k, id_col=id_col, text_col=text_col,
                               exclude_self=exclude_self)
    summ = neighbour_summary(neigh)
    joined = q.join(summ, q[id_col].cast("long") == summ["query_id"], "left")
    cols = {c: F.col(c) for c in ["neigh", "n_neigh", "max_milli", "sum_milli", "strong",
                                  "v_issue", "v_department", "v_priority"]}
    verdict = retrieval_verdict(F.col(baseline_col), cols)
    keep = [c for c in queries.columns if c != out_col]
    return joined.select(*[q[c] for c in keep], verdict.alias(out_col))


def retrieved_table(df: DataFrame, id_col: str = "complaint_id", verdict_col: str = "analysis") -> DataFrame:
    """One row per retrieved neighbour of each verdict (``inline`` of the example array)."""
    return df.select(F.col(id_col).alias("query_id"),
                     F.posexplode(F.col(verdict_col)["retrieved_examples"]).alias("pos", "ex")) \
             .select("query_id", (F.col("pos") + 1).alias("rank"), "ex.*")


def verdict_json(verdict_col: str = "analysis") -> Column:
    """The verdict as one JSON object per row."""
    return F.to_json(F.col(verdict_col))
