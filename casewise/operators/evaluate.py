"""Evaluation: grouped hold-out split (M12, J9, J10), metrics (A10-A13), comparison.

Split
    Every row gets ``evaluation_group = template_group(text)``.  Groups are
    ranked by ``md5(seed ':' group)``; the first ``ceil(test_size * G)`` groups
    are the test side.  The cut is found without sorting all groups in one
    task: group keys are counted per 4-hex-digit prefix (at most 65,536 small
    rows reach the driver), the boundary prefix is counted four digits deeper until it
    is small, and only its groups are ordered.  Rows then decide their side with a
    projection (no join back).

Metrics
    Macro precision / recall / F1 over the union of true and predicted labels
    with zero division -> 0; per-class counts are conditional sums of one
    ``groupBy(model, label)``.  Spark's built-in evaluators are weighted, not
    macro, so the formulas are written out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import template_group

PREFIX = 4


def add_groups(df: DataFrame, text_col: str = "complaint_text", seed: int = 42, fixed: bool = False) -> DataFrame:
    g = template_group(F.col(text_col), fixed=fixed)
    return (df.withColumn("evaluation_group", g)
              .withColumn("_split_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("evaluation_group")))))


def split_cut(grouped: DataFrame, test_size: float = 0.25, step: int = PREFIX, bucket_keys: int = 16 ** PREFIX) -> str:
    """The last test key: groups up to it are test ('' if none is, 'g' if all are).

    Keys are counted by prefix, ``step`` hex digits deeper each round inside the boundary prefix,
    until that prefix holds at most ``bucket_keys`` groups; only these are ordered.
    """
    from ..session import materialize
    keys = materialize(grouped.select("_split_key").distinct(), "split_keys")
    need, prefix = math.ceil(test_size * keys.count()), ""
    if need <= 0:
        return ""
    while True:
        depth = len(prefix) + step
        inside = keys.where(F.col("_split_key").startswith(prefix))
        counts = (inside.groupBy(F.substring("_split_key", 1, depth).alias("p"))
                        .agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect())   # <= 16**step rows
        for r in counts:
            if r["n"] >= need:
                break
            need -= r["n"]
        else:
            return "g"
        prefix = r["p"]
        if r["n"] <= bucket_keys:
            return (inside.where(F.col("_split_key").startswith(prefix)).orderBy("_split_key").limit(need)
                          .agg(F.max("_split_key")).first()[0])


def group_split(df: DataFrame, text_col: str = "complaint_text", test_size: float = 0.25, seed: int = 42,
                fixed: bool = False) -> DataFrame:
    """Add ``evaluation_group`` and ``split`` ('train'/'test') to every row.

    The grouped table is written once as Parquet under the shared checkpoint
    folder: the cut needs two small jobs over it and every later consumer
    (both sides, the neighbour search) reads it instead of recomputing the
    text work, and lineage stays short if executors are lost.
    """
    from ..session import materialize
    grouped = materialize(add_groups(df, text_col, seed, fixed), "grouped")
    is_test = F.col("_split_key") <= F.lit(split_cut(grouped, test_size))
    return grouped.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train"))).drop("_split_key")


def train_test(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """The two sides as DataFrames (the split column is a projection, so no join is needed)."""
    s = group_split(df, **kw)
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "test").drop("split")


def leakage(split_df: DataFrame) -> DataFrame:
    """Group counts per side and the number of groups on both sides (expected 0)."""
    per_group = split_df.groupBy("evaluation_group").agg(
        F.max((F.col("split") == "train").cast("int")).alias("in_train"),
        F.max((F.col("split") == "test").cast("int")).alias("in_test"))
    return per_group.agg(F.sum("in_train").cast("long").alias("train_groups"),
                         F.sum("in_test").cast("long").alias("test_groups"),
                         F.sum(F.col("in_train") * F.col("in_test")).cast("long").alias("shared_groups"))


# ---------------------------------------------------------------------------
# Metrics
# ---------------------------------------------------------------------------

def macro_metrics(pred: DataFrame, model_col: str = "model", true_col: str = "true_department",
                  pred_col: str = "predicted_department", conf_col: str | None = "confidence_score") -> DataFrame:
    """A10-A12 per model: accuracy, macro precision / recall / F1, mean confidence (all unrounded doubles).

    One aggregation chain (per model and label, then per model), so the
    predictions, and everything upstream of them, are computed once.
    """
    y, p = F.col(true_col), F.col(pred_col)
    milli = F.round(F.col(conf_col) * 1000).cast("long") if conf_col else F.lit(0).cast("long")
    hit = (y == p).cast("int")
    miss = (y != p).cast("int")
    # Every row contributes once under its true label (tp, fn and the row totals) and
    # once under its predicted label (fp); labels = union of truth and prediction.
    rows = pred.select(F.col(model_col).alias("model"), F.explode(F.array(
        F.struct(y.alias("label"), hit.alias("tp"), F.lit(0).alias("fp"), miss.alias("fn"),
                 F.lit(1).alias("n"), hit.alias("correct"), milli.alias("milli")),
        F.struct(p.alias("label"), F.lit(0).alias("tp"), miss.alias("fp"), F.lit(0).alias("fn"),
                 F.lit(0).alias("n"), F.lit(0).alias("correct"), F.lit(0).cast("long").alias("milli")))).alias("e"))
    per_class = rows.groupBy("model", F.col("e.label").alias("label")).agg(
        *[F.sum(f"e.{c}").alias(c) for c in ["tp", "fp", "fn", "n", "correct", "milli"]])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    has = F.col("label").isNotNull()
    prec = F.when(has, F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0))
    rec = F.when(has, F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0))
    f1 = F.when(has, F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0))
    per_model = per_class.groupBy("model").agg(
        F.sum("n").alias("n"), F.sum("correct").alias("correct"), F.sum("milli").alias("milli_sum"),
        F.avg(prec).alias("precision"), F.avg(rec).alias("recall"), F.avg(f1).alias("f1_score"),
        F.count("label").alias("n_labels"))
    return per_model.select(
        "model", F.col("n").cast("long").alias("n"), (F.col("correct") / F.col("n")).alias("accuracy"),
        "precision", "recall", "f1_score",
        (F.col("milli_sum").cast("double") / (F.col("n") * F.lit(1000.0))).alias("avg_confidence"),
        F.col("n_labels").cast("long").alias("n_labels"))


def round_metrics(metrics: DataFrame, places: int = 4) -> DataFrame:
    """The report form: every metric rounded to ``places`` (as the dashboards show them)."""
    cols = ["accuracy", "precision", "recall", "f1_score", "avg_confidence"]
    return metrics.select(*[F.round(c, places).alias(c) if c in cols else F.col(c) for c in metrics.columns])


def confusion(pred: DataFrame, labels: list[str], models: list[str], model_col: str = "model",
              true_col: str = "true_department", pred_col: str = "predicted_department") -> DataFrame:
    """A13 long form: (model, actual, predicted, count) over the full label grid, zero filled.

    ``labels`` is the sorted label list (a handful of classes) and ``models``
    the model names; the grid is a literal table of |models| x |labels|^2 rows.
    """
    counts = (pred.where(F.col(true_col).isNotNull() & F.col(pred_col).isNotNull())
                  .groupBy(F.col(model_col).alias("model"), F.col(true_col).alias("actual"),
                           F.col(pred_col).alias("predicted"))
                  .agg(F.count(F.lit(1)).alias("count")))
    grid = pred.sparkSession.createDataFrame(
        [(m, a, p) for m in models for a in labels for p in labels], "model string, actual string, predicted string")
    return (F.broadcast(grid).join(counts, ["model", "actual", "predicted"], "left")
                .select("model", "actual", "predicted", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def sorted_labels(df: DataFrame, col: str = "true_department") -> list[str]:
    """Distinct non-null labels, sorted (a class list, bounded by the label domain)."""
    return [r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).collect()]


def confusion_wide(long: DataFrame, labels: list[str]) -> DataFrame:
    """The matrix layout: one row per (model, actual), one column per predicted label."""
    return (long.groupBy("model", "actual").pivot("predicted", labels).agg(F.first("count")).na.fill(0))


def wrong_counts(pred: DataFrame) -> DataFrame:
    """Wrong predictions per model."""
    return pred.groupBy("model").agg(F.count_if(F.col("is_wrong")).alias("wrong"), F.count(F.lit(1)).alias("n"))


def stack_predictions(df: DataFrame, verdict_cols: list[str], names: list[str], id_col: str = "complaint_id",
                      text_col: str = "complaint_text", true_col: str = "true_department") -> DataFrame:
    """U1 + P5: one prediction row per (model, complaint) in one pass (``inline`` of a per-row array).

    ``is_wrong`` is null-safe: a null prediction counts as wrong, as pandas ``!=`` does.
    """
    rows = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c)["department"].alias("predicted_department"),
                              F.col(c)["priority"].alias("predicted_priority"),
                              F.col(c)["core_issue"].alias("predicted_issue"),
                              F.col(c)["confidence_score"].alias("confidence_score"))
                     for c, n in zip(verdict_cols, names)])
    out = df.select(id_col, text_col, true_col, F.inline(rows))
    return out.withColumn("is_wrong", ~F.col(true_col).eqNullSafe(F.col("predicted_department")))


def metrics_long(metrics: DataFrame, value_vars: list[str] | None = None) -> DataFrame:
    """Wide metrics -> (model, metric, score)."""
    value_vars = value_vars or ["accuracy", "precision", "recall", "f1_score", "avg_confidence"]
    return metrics.unpivot(["model"], value_vars, "metric", "score")


def best_model(metrics: DataFrame, by: str = "accuracy") -> DataFrame:
    """The top model by a metric (model name breaks ties)."""
    return metrics.orderBy(F.desc(by), F.asc("model")).limit(1)
