"""A label-free text classifier that SQL can state exactly: naive Bayes over hashed token counts.

Weights are log probabilities in whole thousandths (Laplace smoothing), so
scores are integers and Spark and SQL agree to the last digit.  A fitted model
holds one weight per class and bucket; the classes are the label domain, whose
size is checked.  Scoring is a projection: no join and no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import lexicon as L
from ..functions.scores import milli_to_double
from .similar import hash_tokens

MODEL_NAME = "Naive Bayes"
EVIDENCE = "Naive Bayes over hashed token counts."
TARGETS = {"issue": "true_core_issue", "department": "true_department", "priority": "true_priority"}
MAX_CLASSES = 500


@dataclass
class Classifier:
    labels: list[str]
    priors: list[int]
    weights: list[list[int]]     # class x bucket


def _milli_log(x: float) -> int:
    """round(1000 ln x), halves away from zero as SQL rounds."""
    v = 1000 * math.log(x)
    return int(math.copysign(math.floor(abs(v) + 0.5), v))


def fit_one(train: DataFrame, label_col: str, text_col: str, width: int = L.HASH_WIDTH) -> Classifier:
    rows = train.where(F.col(label_col).isNotNull())
    docs = rows.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(docs) > MAX_CLASSES:
        raise ValueError(f"{label_col} has more than {MAX_CLASSES} classes")
    labels = sorted(r["label"] for r in docs)
    total = sum(r["n"] for r in docs)
    prior = {r["label"]: _milli_log(r["n"] / total) for r in docs}
    cells = (rows.select(F.col(label_col).alias("label"), F.explode(hash_tokens(text_col, width)).alias("b"))
                 .groupBy("label", "b").agg(F.count(F.lit(1)).alias("n")).collect())      # <= classes x width rows
    count = {(r["label"], r["b"]): r["n"] for r in cells}
    weights = []
    for c in labels:
        n = sum(count.get((c, b), 0) for b in range(width))
        weights.append([_milli_log((count.get((c, b), 0) + 1.0) / (n + float(width))) for b in range(width)])
    return Classifier(labels, [prior[c] for c in labels], weights)


def fit(train: DataFrame, text_col: str = "complaint_text") -> dict[str, Classifier]:
    return {name: fit_one(train, col, text_col) for name, col in TARGETS.items()}


def _score(model: Classifier, tokens: Column) -> Column:
    """struct(label, milli): best class (first label on ties) and a confidence from its lead."""
    def one(prior: int, weights: list[int]) -> Column:
        table = F.expr("array(" + ", ".join(f"{w}L" for w in weights) + ")")
        return F.aggregate(tokens, F.lit(prior).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1))

    scores = F.array(*[one(p, w) for p, w in zip(model.priors, model.weights)])
    labels = F.array(*[F.lit(x) for x in model.labels])

    def pick(s: Column) -> Column:
        ranked = F.sort_array(s, asc=False)
        lead = ranked[0] - F.coalesce(F.get(ranked, F.lit(1)), ranked[0] - F.lit(20_000))
        return F.struct(F.element_at(labels, F.array_position(s, ranked[0]).cast("int")).alias("label"),
                        F.least(F.lit(950), F.lit(400) + F.floor(lead / 20)).cast("long").alias("milli"))

    return F.transform(F.array(scores), pick)[0]


def bayes_triage(df: DataFrame, models: dict[str, Classifier], text_col: str = "complaint_text", out_col: str = "ml") -> DataFrame:
    """Add the verdict struct of the three classifiers."""
    x = df.withColumn("_nb_tokens", hash_tokens(text_col))
    x = x.select("*", *[_score(models[t], F.col("_nb_tokens")).alias(f"_nb_{t}") for t in TARGETS])
    issue, dept, prio = (F.col(f"_nb_{t}") for t in TARGETS)
    tasks = F.create_map(*[v for i in L.ISSUE_NAMES for v in (F.lit(i), F.lit(L.ISSUE_TASK[i]))])
    task = F.coalesce(F.element_at(tasks, issue["label"]), F.lit(L.DEPARTMENT_DEFAULT_TASKS["Customer Service"]))
    milli = F.floor((issue["milli"] + dept["milli"] + prio["milli"]) / 3).cast("long")
    verdict = F.struct(
        issue["label"].alias("core_issue"), F.array().cast("array<string>").alias("detected_entities"),
        dept["label"].alias("department"), prio["label"].alias("priority"), task.alias("actionable_task"),
        milli_to_double(milli).alias("confidence_score"), F.lit(EVIDENCE).alias("reasoning"),
        F.lit("naive-bayes").alias("analysis_mode"), F.array(F.lit(EVIDENCE)).alias("supporting_evidence"),
        F.array().cast(schemas.RETRIEVED_EXAMPLES).alias("retrieved_examples"))
    return x.select(*[F.col(c) for c in df.columns], verdict.alias(out_col))
