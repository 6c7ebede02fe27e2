"""Registered queries (Spark side) with their oracle SQL.

Names and output columns are the contract with ``__spark_entry__``: each
Spark builder aliases every computed column to the oracle's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import rule_triage
from ..sources.complaints import complaint_view
from . import oracle as O
from .catalog import register


def _c_sql() -> str:
    return f"WITH c AS MATERIALIZED ({O.complaints_sql()})\n"


def _milli(col: str) -> F.Column:
    return F.round(F.col(col) * 1000).cast("long")


# ---------------------------------------------------------------------------
# C1 rule triage
# ---------------------------------------------------------------------------

def _c_rules_sql() -> str:
    """CTEs ``c`` (complaints) and ``r`` (c plus flat rule verdict columns), materialized once."""
    return f"WITH c AS MATERIALIZED ({O.complaints_sql()}),\nr AS MATERIALIZED ({O.rule_rows_sql('c')})\n"


def _rule_summary_sql() -> str:
    return _c_rules_sql() + """
SELECT r_department AS department, r_priority AS priority, count(*) AS n_complaints,
       CAST(sum(r_milli) AS BIGINT) AS confidence_milli_sum,
       CAST(sum(r_milli) AS DOUBLE) / (count(*) * 1000.0) AS avg_confidence
FROM r
GROUP BY r_department, r_priority
"""


@register("rule_triage_summary", "C1 F1 F8 F10 F13 F28 J1 J2 J3 A15 W1 T6 P2 P3 P11 P12 A12",
          _rule_summary_sql, headline=True)
def rule_triage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = complaint_view(spark, sf_dir).select("complaint_id", "complaint_text")
    v = rule_triage(c).select(F.col("analysis.department").alias("department"),
                              F.col("analysis.priority").alias("priority"),
                              _milli("analysis.confidence_score").alias("milli"))
    return (v.groupBy("department", "priority")
             .agg(F.count(F.lit(1)).alias("n_complaints"), F.sum("milli").alias("confidence_milli_sum"))
             .withColumn("avg_confidence",
                         F.col("confidence_milli_sum").cast("double") / (F.col("n_complaints") * F.lit(1000.0))))


def _rule_rows_sql() -> str:
    return _c_sql() + f"""
SELECT complaint_id, r_issue AS core_issue, r_department AS department, r_priority AS priority,
       r_task AS actionable_task, CAST(r_milli AS DOUBLE) / 1000.0 AS confidence_score,
       array_to_string(r_entities, ', ') AS detected_entities,
       array_to_string(r_evidence, ' | ') AS supporting_evidence,
       r_reasoning AS reasoning, CAST(r_matches AS BIGINT) AS rule_matches
FROM ({O.rule_rows_sql('c')}) r
"""


@register("rule_triage_rows", "C1 F9 F8 F13 F28 T6 P14 Q2 Q16 Q18", _rule_rows_sql, headline=True)
def rule_triage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = complaint_view(spark, sf_dir).select("complaint_id", "complaint_text")
    v = rule_triage(c, keep_scores=True)
    return v.select(
        "complaint_id",
        F.col("analysis.core_issue").alias("core_issue"),
        F.col("analysis.department").alias("department"),
        F.col("analysis.priority").alias("priority"),
        F.col("analysis.actionable_task").alias("actionable_task"),
        F.col("analysis.confidence_score").alias("confidence_score"),
        F.array_join("analysis.detected_entities", ", ").alias("detected_entities"),
        F.array_join("analysis.supporting_evidence", " | ").alias("supporting_evidence"),
        F.col("analysis.reasoning").alias("reasoning"),
        F.col("rule_matches").cast("long").alias("rule_matches"),
    )


# ---------------------------------------------------------------------------
# Text cleaning
# ---------------------------------------------------------------------------

from ..functions import text as TX  # noqa: E402
from ..operators import reports as R  # noqa: E402
from ..sources.tables import read_table, read_text_table  # noqa: E402
from ..functions.stopwords import default_stopwords  # noqa: E402
from ..functions.lexicon import PRIORITIES  # noqa: E402


@register("clean_documents", "F1 F2 F3 F4 F5 F6 F7 F21 P1 P7",
          lambda: f"""
SELECT doc_id, {O.preprocess_sql('text')} AS cleaned_text, {O.word_count_sql('text')} AS word_count,
       CAST(length({O.normalize_sql('text')}) AS BIGINT) AS normalized_chars
FROM documents""", headline=True)
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_text_table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.preprocess_text(F.col("text")).alias("cleaned_text"),
                    TX.word_count(F.col("text")).cast("long").alias("word_count"),
                    F.length(TX.normalize_text(F.col("text"))).cast("long").alias("normalized_chars"))


@register("clean_conversations", "F1 F2 F7 F21",
          lambda: f"""
SELECT conv_id, turn, role, {O.clean_sql('text')} AS clean_text, {O.preprocess_sql('text')} AS cleaned_text,
       {O.word_count_sql('text')} AS word_count
FROM conversations""")
def clean_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_text_table(spark, sf_dir, "conversations")
    return d.select("conv_id", "turn", "role", TX.clean_text(F.col("text")).alias("clean_text"),
                    TX.preprocess_text(F.col("text")).alias("cleaned_text"),
                    TX.word_count(F.col("text")).cast("long").alias("word_count"))


@register("complaint_cleaning", "S5 P1 F7 Q12",
          lambda: _c_sql() + f"SELECT complaint_id, {O.preprocess_sql('complaint_text')} AS cleaned_text FROM c")
def complaint_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = complaint_view(spark, sf_dir)
    return c.select("complaint_id", TX.preprocess_text(F.col("complaint_text")).alias("cleaned_text"))


@register("template_groups", "F14 Q1",
          lambda: _c_sql() + f"SELECT complaint_id, {O.template_group_sql('complaint_text')} AS evaluation_group FROM c")
def template_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = complaint_view(spark, sf_dir)
    return c.select("complaint_id", TX.template_group(F.col("complaint_text")).alias("evaluation_group"))


@register("document_entities", "F8",
          lambda: f"SELECT doc_id, array_to_string({O.entities_sql(O.normalize_sql('text'))}, ', ') AS entities "
                  f"FROM documents")
def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_text_table(spark, sf_dir, "documents").select("doc_id", TX.normalize_text(F.col("text")).alias("t"))
    return d.select("doc_id", F.array_join(TX.extract_entities(F.col("t")), ", ").alias("entities"))


@register("merged_texts", "F25",
          lambda: _c_sql() + f"SELECT complaint_id, {O.join_texts_sql('complaint_text', 'image_finding')} AS shared_text FROM c")
def merged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = complaint_view(spark, sf_dir)
    return c.select("complaint_id", TX.join_texts(F.col("complaint_text"), F.col("image_finding")).alias("shared_text"))


# ---------------------------------------------------------------------------
# Reports (A1-A8, T1, T4, T5, C16)
# ---------------------------------------------------------------------------

@register("department_distribution", "A1",
          lambda: _c_sql() + "SELECT true_department AS department, count(*) AS count FROM c "
                             "WHERE true_department IS NOT NULL GROUP BY true_department")
def department_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.value_counts(complaint_view(spark, sf_dir), "true_department", "department")


@register("priority_distribution", "A2",
          lambda: _c_sql() + f"""
SELECT d.ord, d.priority, CAST(coalesce(n.count, 0) AS BIGINT) AS count
FROM (SELECT CAST(i - 1 AS INTEGER) AS ord, {O.arr(PRIORITIES)}[i] AS priority FROM range(1, {len(PRIORITIES) + 1}) t(i)) d
LEFT JOIN (SELECT true_priority, count(*) AS count FROM c GROUP BY true_priority) n ON d.priority = n.true_priority""")
def priority_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.priority_distribution(complaint_view(spark, sf_dir))


def _keyword_sql(src: str, col: str, n: int = 15) -> str:
    sw = O.arr(default_stopwords())
    return f"""
SELECT keyword, count(*) AS count
FROM (SELECT unnest(string_split({O.normalize_sql(col)}, ' ')) AS keyword FROM {src}) w
WHERE length(keyword) >= 4 AND NOT list_contains({sw}, keyword)
GROUP BY keyword ORDER BY count DESC, keyword ASC LIMIT {n}"""


@register("keyword_frequency", "A3 T4", lambda: _c_sql() + _keyword_sql("c", "complaint_text"))
def keyword_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyword_frequency(complaint_view(spark, sf_dir), "complaint_text", 15)


@register("keyword_frequency_documents", "A3 T4", lambda: _keyword_sql("documents", "text"), headline=True)
def keyword_frequency_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyword_frequency(read_text_table(spark, sf_dir, "documents"), "text", 15)


@register("top_issues", "A4 P7 P10 T4",
          lambda: _c_rules_sql() + """
SELECT coalesce(r_issue, 'Unknown') AS issue, count(*) AS count FROM r
GROUP BY 1 ORDER BY count DESC, issue ASC LIMIT 10""")
def top_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = complaint_view(spark, sf_dir).select("complaint_id", "complaint_text")
    v = rule_triage(c).select(F.col("analysis.core_issue").alias("core_issue"))
    return R.top_values(v, "core_issue", 10)


def _hist_sql(src: str, col: str, bins: int) -> str:
    wc = O.word_count_sql(col)
    return f"""
SELECT g.bin,
       CAST(rg.lo AS DOUBLE) + CAST(g.bin AS DOUBLE) * CAST(rg.hi - rg.lo AS DOUBLE) / {float(bins)} AS bin_start,
       CAST(rg.lo AS DOUBLE) + CAST(g.bin + 1 AS DOUBLE) * CAST(rg.hi - rg.lo AS DOUBLE) / {float(bins)} AS bin_end,
       CAST(coalesce(h.count, 0) AS BIGINT) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})) g
CROSS JOIN (SELECT min(wc) AS lo, max(wc) AS hi FROM (SELECT {wc} AS wc FROM {src})) rg
LEFT JOIN (
  SELECT bin, count(*) AS count FROM (
    SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least((wc - lo) * {bins} // (hi - lo), {bins - 1}) END AS INTEGER) AS bin
    FROM (SELECT {wc} AS wc FROM {src}) x CROSS JOIN (SELECT min({wc}) AS lo, max({wc}) AS hi FROM {src}) r
  ) b GROUP BY bin
) h ON g.bin = h.bin"""


@register("length_histogram_documents", "A5 F21", lambda: _hist_sql("documents", "text", 25))
def length_histogram_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.length_histogram(read_text_table(spark, sf_dir, "documents"), "text", 25)


@register("length_histogram_complaints", "A6 F21", lambda: _c_sql() + _hist_sql("c", "complaint_text", 15))
def length_histogram_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.length_histogram(complaint_view(spark, sf_dir), "complaint_text", 15)


@register("length_density_documents", "A7",
          lambda: f"""
WITH v AS (SELECT CAST({O.word_count_sql('text')} AS DOUBLE) AS wc, CAST(count(*) AS DOUBLE) AS cnt FROM documents GROUP BY 1),
m AS (SELECT sum(wc * cnt) / sum(cnt) AS mean, sum(cnt) AS n, min(wc) AS lo, max(wc) AS hi FROM v),
s AS (SELECT m.*, (SELECT sqrt(sum(cnt * (wc - mean) * (wc - mean)) / (sum(cnt) - 1)) FROM v) * pow(n, -0.2) AS h FROM m),
g AS (SELECT s.*, lo + (hi - lo) * range / 199 AS x FROM s CROSS JOIN range(200))
SELECT round(x, 6) AS word_count, round(sum(cnt * exp(-0.5 * pow((x - wc) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density
FROM g CROSS JOIN v GROUP BY x""")
def length_density_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.length_density(read_text_table(spark, sf_dir, "documents"), "text", 200)
    return d.select(F.round("word_count", 6).alias("word_count"), F.round("density", 9).alias("density"))


@register("overview_counts", "C16 A8",
          lambda: _c_sql() + """
SELECT count(*) AS rows, count(DISTINCT true_department) AS distinct_true_department,
       count(DISTINCT true_priority) AS distinct_true_priority, count(DISTINCT product_line) AS distinct_product_line,
       count(DISTINCT country) AS distinct_country FROM c""")
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overview(complaint_view(spark, sf_dir), ["true_department", "true_priority", "product_line", "country"])


SKETCHED = ["complaint_id", "product_line", "country", "true_core_issue"]


@register("overview_sketches", "A8 C16",
          lambda: _c_sql() + " UNION ALL ".join(
              f"SELECT '{g}' AS part, '{c}' AS measured, count(*) AS rows, count(DISTINCT {c}) AS distinct_values, TRUE AS within FROM c"
              for g, c in (("all", c) for c in SKETCHED)) + " UNION ALL " + " UNION ALL ".join(
              f"SELECT region AS part, '{c}' AS measured, count(*) AS rows, count(DISTINCT {c}) AS distinct_values, TRUE AS within FROM c GROUP BY region"
              for c in SKETCHED))
def overview_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches per region and country stored once, merged by region and over all, beside the exact counts: within three standard errors."""
    from ..operators import sketches as SK
    c = complaint_view(spark, sf_dir).select("region", *SKETCHED)
    stored = materialize(SK.sketch_table(c, ["region", "country"], SKETCHED), "sketches")
    named = lambda df: df.select("part", "rows", F.expr(
        f"stack({len(SKETCHED)}, {', '.join(f"'{x}', approx_{x}" for x in SKETCHED)}) AS (measured, approx)"))
    by_region = SK.estimates(SK.merged(stored, ["region"])).withColumnRenamed("region", "part")
    whole = SK.estimates(SK.merged(stored, [])).withColumn("part", F.lit("all"))
    found = named(by_region).unionByName(named(whole))
    exact = c.groupBy("region").agg(*[F.count_distinct(x).alias(x) for x in SKETCHED]).withColumnRenamed("region", "p").unionByName(
        c.agg(*[F.count_distinct(x).alias(x) for x in SKETCHED]).withColumn("p", F.lit("all")))
    exact = exact.unpivot(["p"], SKETCHED, "m", "distinct_values")
    joined = found.join(exact, F.col("part").eqNullSafe(F.col("p")) & (F.col("measured") == F.col("m")))
    error = F.abs(F.col("approx") - F.col("distinct_values"))
    return joined.select("part", "measured", F.col("rows").cast("long").alias("rows"), "distinct_values",
                         (error <= F.greatest(F.lit(0.5), 3 * SK.standard_error() * F.col("distinct_values"))).alias("within"))


@register("first_complaints", "T1",
          lambda: _c_sql() + "SELECT complaint_id, complaint_text FROM c ORDER BY complaint_id LIMIT 12")
def first_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_rows(complaint_view(spark, sf_dir).select("complaint_id", "complaint_text"), 12)


@register("seeded_sample", "T5",
          lambda: _c_sql() + """
SELECT complaint_id, true_department FROM c
ORDER BY md5('42:' || CAST(complaint_id AS VARCHAR)), complaint_id LIMIT 6000""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = complaint_view(spark, sf_dir).select("complaint_id", "true_department")
    return R.seeded_sample(c, 6000, 42)


# ---------------------------------------------------------------------------
# Split (M12, J9, J10), vectors (M1-M3), neighbours (J6, W4, C4), retrieval
# ---------------------------------------------------------------------------

from ..operators import evaluate as EV  # noqa: E402
from ..operators import similar as SIM  # noqa: E402
from ..operators.retrieval import retrieval_triage as _retrieval_triage  # noqa: E402


SPLIT_COLUMNS = ["complaint_id", "complaint_text", "true_department", "true_priority", "true_core_issue",
                 "model_response"]


_SAVED: dict[tuple, object] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Files, sizes and times of the tables behind C: a table that is written anew gives new derived tables."""
    found = []
    for name in ("orders", "customer", "nation", "region"):
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/{name}.parquet")
                      .select("path", "length", F.unix_micros("modificationTime").alias("t")))
        found.append(tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.sum(F.xxhash64("path", "length", "t").cast("decimal(38,0)"))).first()))
    return tuple(found)


def _saved(spark: SparkSession, sf_dir: str, what: str, build):
    """A derived table, written once per application and state of C's source tables and read by every later query."""
    key = (spark.sparkContext.applicationId, sf_dir, what, _state(spark, sf_dir))
    if key not in _SAVED:
        _SAVED[key] = build()
    return _SAVED[key]


def split_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C with ``evaluation_group`` and ``split`` columns (25% of template groups held out, seed 42).

    Only the columns the evaluation queries read are carried (and materialized).
    """
    return _saved(spark, sf_dir, "split", lambda: EV.group_split(
        complaint_view(spark, sf_dir).select(*SPLIT_COLUMNS), "complaint_text", 0.25, 42))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest train complaints of every test complaint, searched once and saved."""
    def build():
        test, train = _test_train(spark, sf_dir)
        return materialize(SIM.similar_complaints(test, train, 5), "neighbours")
    return _saved(spark, sf_dir, "neighbours", build)


def _split_sql_prefix() -> str:
    return _c_sql().rstrip() + "," + O.split_ctes("c") + "\n"


@register("group_split", "M12 J9 F14", lambda: _split_sql_prefix() + "SELECT complaint_id, evaluation_group, split FROM split")
def group_split_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_view(spark, sf_dir).select("complaint_id", "evaluation_group", "split")


@register("split_leakage", "J10 U5",
          lambda: _split_sql_prefix() + """
SELECT CAST(sum(in_train) AS BIGINT) AS train_groups, CAST(sum(in_test) AS BIGINT) AS test_groups,
       CAST(sum(in_train * in_test) AS BIGINT) AS shared_groups
FROM (SELECT evaluation_group, max(CAST(split = 'train' AS INTEGER)) AS in_train,
             max(CAST(split = 'test' AS INTEGER)) AS in_test FROM split GROUP BY evaluation_group)""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.leakage(split_view(spark, sf_dir))


@register("hashed_vectors", "M1 M2 M3",
          lambda: _c_sql().rstrip() + "," + O.vector_ctes("c") + """
SELECT v.id AS complaint_id, CAST(v.bucket AS INTEGER) AS bucket, CAST(v.tf AS BIGINT) AS tf,
       CAST(v.tf AS DOUBLE) / sqrt(CAST(n.n2 AS DOUBLE)) AS weight
FROM vec v JOIN norm n USING (id)""")
def hashed_vectors_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = complaint_view(spark, sf_dir)
    return SIM.hashed_vectors(c, "complaint_id", "complaint_text").select(
        F.col("id").alias("complaint_id"), F.col("bucket").cast("int"), F.col("tf").cast("long"), "weight")


def _nn_sql_prefix(head: str | None = None) -> str:
    return ((head or _split_sql_prefix()).rstrip() + ","
            + O.vector_ctes("c") + ",\n"
            + "qvec AS (SELECT v.* FROM vec v JOIN split s ON v.id = s.complaint_id WHERE s.split = 'test'),\n"
            + "dvec AS (SELECT v.* FROM vec v JOIN split s ON v.id = s.complaint_id WHERE s.split = 'train'),"
            + O.knn_ctes("qvec", "dvec", "norm") + "\n")


def _test_train(spark: SparkSession, sf_dir: str):
    s = split_view(spark, sf_dir)
    return s.where(F.col("split") == "test"), s.where(F.col("split") == "train")


@register("similar_complaints", "J6 W4 C4 M4 F22 J5 P15 T8 Q4",
          lambda: _nn_sql_prefix() + """
SELECT nn.qid AS query_id, CAST(nn.rank AS INTEGER) AS rank, CAST(nn.did AS VARCHAR) AS complaint_id,
       d.true_core_issue AS core_issue, d.true_department AS department,
       CAST(floor(nn.score * 1000 + 0.5) AS DOUBLE) / 1000.0 AS similarity, nn.score AS raw_score
FROM nn JOIN c d ON d.complaint_id = nn.did""", headline=True)
def similar_complaints_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir).select("query_id", F.col("rank").cast("int"), "complaint_id", "core_issue", "department",
                     (F.floor(F.col("raw_score") * 1000 + 0.5).cast("double") / 1000.0).alias("similarity"),
                     "raw_score")


def _retrieval_sql_prefix(head: str | None = None) -> str:
    return (_nn_sql_prefix(head).rstrip() + ",\n"
            + f"qr AS MATERIALIZED ({O.rule_rows_sql('(SELECT c.* FROM c JOIN split s USING (complaint_id) WHERE s.split = ' + chr(39) + 'test' + chr(39) + ')')}),"
            + O.retrieval_ctes("nn", "c", "qr") + "\n")


@register("retrieval_triage", "C5 A14 A16 W2 W7 F26 F23 J4 U2 T7",
          lambda: _retrieval_sql_prefix() + """
SELECT complaint_id, g_issue AS core_issue, g_department AS department, g_priority AS priority,
       g_task AS actionable_task, CAST(g_milli AS DOUBLE) / 1000.0 AS confidence_score,
       array_to_string(g_entities, ', ') AS detected_entities, array_to_string(g_evidence, ' | ') AS supporting_evidence,
       g_reasoning AS reasoning, g_neighbours AS n_neighbours
FROM rag""", headline=True)
def retrieval_triage_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = _test_train(spark, sf_dir)
    out = _retrieval_triage(test.select("complaint_id", "complaint_text"), train, 5, neigh=neighbours(spark, sf_dir))
    a = "analysis."
    return out.select("complaint_id", F.col(a + "core_issue").alias("core_issue"),
                      F.col(a + "department").alias("department"), F.col(a + "priority").alias("priority"),
                      F.col(a + "actionable_task").alias("actionable_task"),
                      F.col(a + "confidence_score").alias("confidence_score"),
                      F.array_join(a + "detected_entities", ", ").alias("detected_entities"),
                      F.array_join(a + "supporting_evidence", " | ").alias("supporting_evidence"),
                      F.col(a + "reasoning").alias("reasoning"),
                      F.size(a + "retrieved_examples").cast("long").alias("n_neighbours"))


# ---------------------------------------------------------------------------
# Consensus
# ---------------------------------------------------------------------------

from ..operators.consensus import consensus as _consensus  # noqa: E402
from ..operators import bayes as NB  # noqa: E402
from ..session import discard, materialize  # noqa: E402
from ..functions import lexicon as LX  # noqa: E402


COMPARED = ["Rule-Based", NB.MODEL_NAME, "RAG + LLM"]


def three_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-split complaints with ``rule``, ``ml`` and ``retrieval`` verdict columns.

    The ``ml`` verdict is naive Bayes fitted on the train side, which SQL can state exactly; ``ml_model_comparison``
    runs the same comparison with logistic regression.
    """
    test, train = _test_train(spark, sf_dir)
    q = test.select("complaint_id", "complaint_text", "true_core_issue", "true_department", "true_priority")
    q = rule_triage(q, out_col="rule")
    q = NB.bayes_triage(q, NB.fit(train))
    return _retrieval_triage(q, train, 5, baseline_col="rule", out_col="retrieval", neigh=neighbours(spark, sf_dir))


_TRAIN_SQL = """SELECT c.complaint_id, c.true_core_issue, c.true_department, c.true_priority
  FROM c JOIN split s USING (complaint_id) WHERE s.split = 'train'"""


def _consensus_sql(head: str | None = None) -> str:
    entries = O.bayes_ctes("qr", "qvec", "dvec", _TRAIN_SQL) + f""",
ent AS (
  SELECT complaint_id, 0 AS ord, 'Rule-Based' AS name, r_issue AS issue, r_department AS dept, r_priority AS prio,
         r_milli AS milli, r_task AS task, r_evidence AS evidence FROM qr
  UNION ALL
  SELECT complaint_id, 1, '{NB.MODEL_NAME}', n_issue, n_dept, n_prio, n_milli, {O.issue_task_sql('n_issue')},
         ['{NB.EVIDENCE}'] FROM nb
  UNION ALL
  SELECT complaint_id, 2, 'RAG + LLM', g_issue, g_department, g_priority, g_milli, g_task, g_evidence FROM rag),"""
    return _retrieval_sql_prefix(head).rstrip() + "," + entries + O.consensus_ctes("ent") + """
SELECT complaint_id, c_issue AS core_issue, c_dept AS department, c_prio AS priority, c_task AS actionable_task,
       CAST(c_milli AS DOUBLE) / 1000.0 AS confidence_score, c_reasoning AS reasoning,
       array_to_string(c_evidence, ' | ') AS supporting_evidence, c_models AS agreeing_models
FROM cons"""


@register("consensus", "C8 C7 A18 A19 W3 F27 F23 P13", _consensus_sql, headline=True)
def consensus_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _consensus(three_verdicts(spark, sf_dir), ["rule", "ml", "retrieval"], COMPARED, "rec")
    return v.select("complaint_id", F.col("rec.core_issue").alias("core_issue"),
                    F.col("rec.department").alias("department"), F.col("rec.priority").alias("priority"),
                    F.col("rec.actionable_task").alias("actionable_task"),
                    F.col("rec.confidence_score").alias("confidence_score"),
                    F.col("rec.reasoning").alias("reasoning"),
                    F.array_join("rec.supporting_evidence", " | ").alias("supporting_evidence"),
                    F.array_join("rec_models", ", ").alias("agreeing_models"))


def _with_findings_sql() -> str:
    """CTEs split (of the texts alone) and c, whose test rows read text and image finding together."""
    return (f"WITH c0 AS MATERIALIZED ({O.complaints_sql()})," + O.split_ctes("c0") + f""",
c AS MATERIALIZED (SELECT c0.* REPLACE (CASE WHEN split.split = 'test' THEN {O.join_texts_sql('complaint_text', 'image_finding')}
     ELSE complaint_text END AS complaint_text) FROM c0 JOIN split USING (complaint_id))""")


@register("triage_all", "C7 J8 F25 C8", lambda: _consensus_sql(_with_findings_sql()))
def triage_all_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All verdicts of the test complaints over text and image finding, and their consensus."""
    from ..operators.triage import triage_all
    test, train = _test_train(spark, sf_dir)
    found = complaint_view(spark, sf_dir).select("complaint_id", "image_finding")
    models = NB.fit(train)
    v = triage_all(test.select("complaint_id", "complaint_text").join(found, "complaint_id"), train, finding_col="image_finding",
                   classify=lambda x, text: NB.bayes_triage(x, models, text_col=text), names=COMPARED)
    return v.select("complaint_id", *[F.col(f"recommended.{f}").alias(f) for f in (
        "core_issue", "department", "priority", "actionable_task", "confidence_score", "reasoning")],
        F.array_join("recommended.supporting_evidence", " | ").alias("supporting_evidence"),
        F.array_join("recommended_models", ", ").alias("agreeing_models"))


# ---------------------------------------------------------------------------
# Model comparison
# ---------------------------------------------------------------------------

def _pred_sql_prefix() -> str:
    """Consensus prefix + pred CTE (model, complaint_id, y, p, milli)."""
    entries_sql = _consensus_sql()
    head = entries_sql[:entries_sql.index(O.consensus_ctes("ent").split(",\ncons_ld")[0])]
    return head + """
pred AS (SELECT e.name AS model, e.complaint_id, q.true_department AS y, e.dept AS p, e.milli
         FROM ent e JOIN qr q USING (complaint_id))
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = three_verdicts(spark, sf_dir)
    return EV.stack_predictions(v, ["rule", "ml", "retrieval"], COMPARED)


def _metrics_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.round_metrics(EV.macro_metrics(predictions(spark, sf_dir)), 4)


@register("model_metrics", "C9 C12 A10 A11 A12 J7 U1", lambda: _pred_sql_prefix() + O.metrics_sql("pred"),
          headline=True)
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics_df(spark, sf_dir)


@register("model_predictions", "U1 P5 J7 P3",
          lambda: _pred_sql_prefix() + """
SELECT model, complaint_id, y AS true_department, p AS predicted_department,
       CAST(milli AS DOUBLE) / 1000.0 AS confidence_score, NOT (y IS NOT DISTINCT FROM p) AS is_wrong FROM pred""")
def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("model", "complaint_id", "true_department", "predicted_department",
                                             "confidence_score", "is_wrong")


@register("confusion_matrix", "A13 A22 C13",
          lambda: _pred_sql_prefix() + """
SELECT g.model, g.actual, g.predicted, CAST(coalesce(c.count, 0) AS BIGINT) AS count
FROM (SELECT m.model, a.label AS actual, b.label AS predicted
      FROM (SELECT DISTINCT model FROM pred) m, (SELECT DISTINCT true_department AS label FROM c WHERE true_department IS NOT NULL) a,
           (SELECT DISTINCT true_department AS label FROM c WHERE true_department IS NOT NULL) b) g
LEFT JOIN (SELECT model, y AS actual, p AS predicted, count(*) AS count FROM pred
           WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY ALL) c USING (model, actual, predicted)""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = EV.sorted_labels(complaint_view(spark, sf_dir), "true_department")
    return EV.confusion(predictions(spark, sf_dir), labels, COMPARED)


@register("error_counts", "A21 C13 P6",
          lambda: _pred_sql_prefix() + """
SELECT model, CAST(count_if(NOT (y IS NOT DISTINCT FROM p)) AS BIGINT) AS wrong, count(*) AS n FROM pred GROUP BY model""")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.wrong_counts(predictions(spark, sf_dir))


@register("metrics_long", "P16 Q9",
          lambda: _pred_sql_prefix().rstrip() + ",\nmet AS (" + O.metrics_sql("pred") + """)
SELECT model, metric, score FROM met
UNPIVOT (score FOR metric IN (accuracy, precision, recall, f1_score, avg_confidence))""")
def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.metrics_long(_metrics_df(spark, sf_dir))


@register("best_model", "T3",
          lambda: _pred_sql_prefix().rstrip() + ",\nmet AS (" + O.metrics_sql("pred") + """)
SELECT * FROM met ORDER BY accuracy DESC, model ASC LIMIT 1""")
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.best_model(_metrics_df(spark, sf_dir))


# ---------------------------------------------------------------------------
# Spark ML: classifiers (C2, C3, M5, M7-M9) and clusters
# ---------------------------------------------------------------------------

from ..operators import ml as ML  # noqa: E402
from ..operators import cluster as CL  # noqa: E402


def _table_model(spark: SparkSession, sf_dir: str):
    """The table classifier of the train side and its term statistics, fitted once and saved."""
    def build():
        train = _test_train(spark, sf_dir)[1]
        return ML.fit_table_models(train)
    return _saved(spark, sf_dir, "table_model", build)


@register("ml_triage", "C3 M8 M9 W5 S17 Q6 Q17")
def ml_triage_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, _ = _test_train(spark, sf_dir)
    model, stats = _table_model(spark, sf_dir)
    v = ML.table_triage(test.select("complaint_id", "complaint_text"), model, stats)
    a = "analysis."
    return v.select("complaint_id", F.col(a + "core_issue").alias("core_issue"),
                    F.col(a + "department").alias("department"), F.col(a + "priority").alias("priority"),
                    F.col(a + "actionable_task").alias("actionable_task"),
                    F.col(a + "confidence_score").alias("confidence_score"),
                    F.array_join(a + "supporting_evidence", " | ").alias("supporting_evidence"))


@register("logistic_certificate", "C2 M5 M7",
          lambda: _split_sql_prefix().rstrip() + """,
tr AS (SELECT c.* FROM c JOIN split USING (complaint_id) WHERE split = 'train'),
l AS (SELECT 'issue' AS target, true_core_issue AS label FROM tr UNION ALL SELECT 'department', true_department FROM tr
      UNION ALL SELECT 'priority', true_priority FROM tr),
n AS (SELECT target, label, count(*) AS class_rows FROM l WHERE label IS NOT NULL GROUP BY ALL)
SELECT target, label, CAST(sum(class_rows) OVER (PARTITION BY target) AS BIGINT) AS n_rows, class_rows,
       round(1.0::DOUBLE / count(*) OVER (PARTITION BY target), 3) AS fitted_share, TRUE AS optimal
FROM n""")
def logistic_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved model's optimality, computed from its coefficient table: balanced classes carry equal shares."""
    from ..operators.logistic import certificate
    _, train = _test_train(spark, sf_dir)
    model, stats = _table_model(spark, sf_dir)
    features, _ = ML.text_features(train, "complaint_id", "complaint_text", stats)
    proof = certificate(features, train.withColumn("id", F.col("complaint_id")), ML.TARGETS, model)
    return proof.select("target", "label", "n_rows", "class_rows", F.round("fitted_share", 3).alias("fitted_share"),
                        (F.col("max_gradient") <= 1.001e-4).alias("optimal"))


@register("saved_classifier", "S10 C2 C3",
          lambda: _split_sql_prefix() + """
SELECT count(*) AS n, count(*) AS equal_verdicts FROM split WHERE split = 'test'""")
def saved_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table classifier saved and loaded again gives every test complaint the verdict it had."""
    from ..operators.logistic import LogisticModel
    test, _ = _test_train(spark, sf_dir)
    model, stats = _table_model(spark, sf_dir)
    path = _new_table(spark, "classifier")
    model.save(path)
    rows = test.select("complaint_id", "complaint_text")
    before = ML.table_triage(rows, model, stats).select("complaint_id", F.to_json("analysis").alias("before"))
    after = ML.table_triage(rows, LogisticModel.load(spark, path), stats).select("complaint_id", F.to_json("analysis").alias("after"))
    return before.join(after, "complaint_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") == F.col("after")).alias("equal_verdicts"))


@register("ml_model_comparison", "C9 C12 M7 A10 A11 A12")
def ml_model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full comparison with the real classifier in the ML slot (rows-only check)."""
    test, train = _test_train(spark, sf_dir)
    model, stats = _table_model(spark, sf_dir)
    q = test.select("complaint_id", "complaint_text", "true_core_issue", "true_department", "true_priority")
    q = rule_triage(q, out_col="rule")
    q = ML.table_triage(q, model, stats, out_col="ml")
    v = _retrieval_triage(q, train, 5, baseline_col="rule", out_col="retrieval", neigh=neighbours(spark, sf_dir))
    pred = EV.stack_predictions(v, ["rule", "ml", "retrieval"], LX.MODEL_ORDER)
    return EV.round_metrics(EV.macro_metrics(pred), 4)


def _clusters(spark: SparkSession, sf_dir: str):
    """Complaints and their fitted clusters (one fit serves all cluster queries)."""
    c = complaint_view(spark, sf_dir).select("complaint_id", "complaint_text")
    return c, _saved(spark, sf_dir, "clusters", lambda: CL.fit_clusters(c, k=6, n_init=20))


@register("cluster_summary", "C14 M6 M10 A9 T2 W6")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, fitted = _clusters(spark, sf_dir)
    return CL.cluster_report(c, k=6, fitted=fitted)[1]


@register("cluster_assignments", "C14")
def cluster_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, fitted = _clusters(spark, sf_dir)
    return CL.cluster_report(c, k=6, fitted=fitted)[0].select("complaint_id", "cluster_id")


@register("cluster_map", "M11 Q8")
def cluster_map_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, fitted = _clusters(spark, sf_dir)
    return CL.cluster_map(c, k=6, sample=700, fitted=fitted)


# ---------------------------------------------------------------------------
# Outside-model answers
# ---------------------------------------------------------------------------

from ..operators import responses as RS  # noqa: E402


@register("response_validation", "F15 F16 U4",
          lambda: _c_sql() + f"""
SELECT complaint_id, v_message = 'valid' AS is_valid, v_message AS message,
       CASE WHEN v_message = 'valid' THEN v_core_issue END AS core_issue,
       CASE WHEN v_message = 'valid' THEN v_department END AS department,
       CASE WHEN v_message = 'valid' THEN v_priority END AS priority,
       CASE WHEN v_message = 'valid' THEN v_confidence END AS confidence_score,
       CASE WHEN v_message = 'valid' THEN array_to_string(v_entities, ', ') END AS detected_entities
FROM (SELECT complaint_id, {O.validate_sql('model_response')} FROM c)""")
def response_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = RS.with_validation(complaint_view(spark, sf_dir).select("complaint_id", "model_response"),
                           "model_response", "v")
    ok = F.col("v.ok")
    return c.select("complaint_id", ok.alias("is_valid"), F.col("v.message").alias("message"),
                    F.when(ok, F.col("v.core_issue")).alias("core_issue"),
                    F.when(ok, F.col("v.department")).alias("department"),
                    F.when(ok, F.col("v.priority")).alias("priority"),
                    F.when(ok, F.col("v.confidence_score")).alias("confidence_score"),
                    F.when(ok, F.array_join("v.detected_entities", ", ")).alias("detected_entities"))


@register("response_merge", "C6 U2 U6 P13 T7",
          lambda: _retrieval_sql_prefix().rstrip() + f""",
vr AS (SELECT complaint_id, {O.validate_sql('model_response')} FROM c)
SELECT r.complaint_id,
       CASE WHEN v_message = 'valid' THEN v_core_issue ELSE g_issue END AS core_issue,
       CASE WHEN v_message = 'valid' THEN v_department ELSE g_department END AS department,
       CASE WHEN v_message = 'valid' THEN v_priority ELSE g_priority END AS priority,
       CASE WHEN v_message = 'valid' THEN v_confidence ELSE CAST(g_milli AS DOUBLE) / 1000.0 END AS confidence_score,
       CASE WHEN v_message = 'valid' THEN 'hybrid-rag-llm' ELSE 'rag-retrieval' END AS analysis_mode,
       array_to_string(CASE WHEN v_message = 'valid' THEN list_sort(list_distinct(list_concat(g_entities, v_entities)))
                            ELSE g_entities END, ', ') AS detected_entities,
       CASE WHEN v_message = 'valid' THEN (CASE WHEN v_reasoning <> '' THEN v_reasoning ELSE g_reasoning END)
            ELSE g_reasoning END AS reasoning,
       array_to_string(CASE WHEN v_message = 'valid' THEN g_evidence
                            ELSE list_concat(g_evidence, ['{RS.FALLBACK_PREFIX}' || v_message]) END, ' | ') AS supporting_evidence
FROM rag r JOIN vr USING (complaint_id)""")
def response_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = _test_train(spark, sf_dir)
    q = _retrieval_triage(test.select("complaint_id", "complaint_text", "model_response"), train, 5,
                          out_col="retrieval", neigh=neighbours(spark, sf_dir))
    m = RS.with_merge(q, "retrieval", "model_response", "m")
    return m.select("complaint_id", F.col("m.core_issue").alias("core_issue"), F.col("m.department").alias("department"),
                    F.col("m.priority").alias("priority"), F.col("m.confidence_score").alias("confidence_score"),
                    F.col("m.analysis_mode").alias("analysis_mode"),
                    F.array_join("m.detected_entities", ", ").alias("detected_entities"),
                    F.col("m.reasoning").alias("reasoning"),
                    F.array_join("m.supporting_evidence", " | ").alias("supporting_evidence"))


def _prompt_sql() -> str:
    fields = ("core_issue := g_issue, detected_entities := g_entities, department := g_department, priority := g_priority, "
              "actionable_task := g_task, confidence_score := CAST(g_milli AS DOUBLE) / 1000.0, reasoning := g_reasoning, "
              f"analysis_mode := '{LX.MODE_RETRIEVAL}', supporting_evidence := g_evidence, retrieved_examples := examples")
    return _retrieval_sql_prefix().rstrip() + f""",
ex AS (SELECT nb.qid, list(struct_pack(complaint_id := CAST(d.complaint_id AS VARCHAR), complaint_text := coalesce(d.complaint_text, ''),
              department := nb.department, priority := nb.priority, core_issue := nb.core_issue,
              similarity := CAST(nb.milli AS DOUBLE) / 1000.0) ORDER BY nb.rank) AS examples
       FROM rag_nb nb JOIN c d ON d.complaint_id = nb.did GROUP BY nb.qid),
p AS (SELECT rag.*, coalesce(ex.examples, []) AS examples, coalesce(qr.complaint_text, '') AS said
      FROM rag JOIN qr USING (complaint_id) LEFT JOIN ex ON ex.qid = rag.complaint_id)
SELECT complaint_id, {O.q(RS.system_prompt())} AS system_prompt,
       'Complaint:' || chr(10) || said || chr(10) || chr(10) || 'Retrieval-informed baseline:' || chr(10)
       || CAST(to_json(struct_pack({fields})) AS VARCHAR) || chr(10) || chr(10) || 'Similar complaints:' || chr(10)
       || CAST(to_json(examples) AS VARCHAR) || chr(10) || chr(10) || 'Return JSON only.' AS prompt
FROM p"""


@register("prompt_rows", "F24 P14", _prompt_sql)
def prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = _test_train(spark, sf_dir)
    c = _retrieval_triage(test.select("complaint_id", "complaint_text"), train, 5, neigh=neighbours(spark, sf_dir))
    return RS.with_prompts(c, "complaint_text", "analysis").select("complaint_id", "system_prompt", "prompt")


# ---------------------------------------------------------------------------
# Generators (S12-S16, S15, F18-F20, J11-J13) and I/O
# ---------------------------------------------------------------------------

from ..schemas import CFPB, WAREHOUSE  # noqa: E402
from ..sources import generate as GEN  # noqa: E402
from ..sources import io as IO  # noqa: E402


@register("generated_warehouse", "S12 S15 F18 F19 F20 J11 J13 Q11",
          lambda: "SELECT " + ", ".join(GEN.warehouse_columns(GEN.DUCK, 42)) +
                  " FROM (SELECT o_orderkey + 1 AS complaint_id FROM orders)")
def generated_warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read_table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("complaint_id"))
    return GEN.generate_warehouse(keys, 42)


@register("generated_validation", "S13 F18 F19",
          lambda: "SELECT " + ", ".join(GEN.validation_columns(GEN.DUCK, 101)) +
                  " FROM (SELECT c_custkey + 1 AS complaint_id FROM customer)")
def generated_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read_table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("complaint_id"))
    return GEN.generate_validation(keys, 101)


@register("generated_cfpb", "S14 J12 F19",
          lambda: "SELECT " + ", ".join(GEN.cfpb_columns(GEN.DUCK, 202)) +
                  " FROM (SELECT p_partkey + 1 AS complaint_id FROM part)")
def generated_cfpb(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read_table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("complaint_id"))
    return GEN.generate_cfpb(keys, 202)


@register("csv_roundtrip", "S1 S2 S6 S17 P4",
          lambda: _c_sql() + "SELECT " + ", ".join(f.name for f in WAREHOUSE.fields) + " FROM c")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C written as warehouse-layout CSV under the checkpoint folder, then read back with the fixed schema."""
    import uuid
    from ..session import ensure_checkpoint_dir
    c = complaint_view(spark, sf_dir)
    cols = [f.name for f in WAREHOUSE.fields]
    out = c.select(*[F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias(n) if n == "created_at" else F.col(n)
                     for n in cols])
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/csv-{uuid.uuid4().hex}"
    IO.save_table(out, path, "csv")
    return IO.read_complaints(spark, path, multi_line=True)      # some texts have line breaks


def _new_table(spark: SparkSession, what: str) -> str:
    import uuid
    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{what}-{uuid.uuid4().hex}"


@register("validation_roundtrip", "S3 S17",
          lambda: _c_sql() + "SELECT 'V' || complaint_id AS complaint_id, complaint_text, true_department, true_priority, true_core_issue FROM c")
def validation_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C in the layout of a validation set, written as CSV and read by the validation reader."""
    c = complaint_view(spark, sf_dir).select(F.concat(F.lit("V"), F.col("complaint_id").cast("string")).alias("complaint_id"),
                                             "complaint_text", "true_department", "true_priority", "true_core_issue")
    return IO.read_validation(spark, IO.save_table(c, _new_table(spark, "validation"), "csv"), multi_line=True)


_CFPB_OF_C = {"complaint_id": "'CFPB-' || complaint_id", "product": "product_line", "issue": "true_core_issue", "complaint_text": "complaint_text",
              "company": "customer_segment", "state": "region", "submitted_via": "channel", "true_department": "true_department",
              "true_priority": "true_priority", "true_core_issue": "true_core_issue"}


@register("cfpb_roundtrip", "S4 S17",
          lambda: _c_sql() + "SELECT " + ", ".join(f"{_CFPB_OF_C.get(f.name, 'CAST(NULL AS VARCHAR)')} AS {f.name}" for f in CFPB.fields) + " FROM c")
def cfpb_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C in some of the CFPB layout's columns, written as CSV and read by the CFPB reader: absent columns are null."""
    c = complaint_view(spark, sf_dir)
    out = c.select(*[F.expr(e.replace("|| complaint_id", "|| CAST(complaint_id AS STRING)")).alias(n) for n, e in _CFPB_OF_C.items()])
    return IO.read_cfpb(spark, IO.save_table(out, _new_table(spark, "cfpb"), "csv"), multi_line=True)


@register("preprocess_roundtrip", "S5 P1 S6",
          lambda: _c_sql() + f"SELECT complaint_id, complaint_text, {O.preprocess_sql('complaint_text')} AS cleaned_text FROM c")
def preprocess_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C as a warehouse CSV: read, checked, cleaned, written and read again by ``preprocess_dataset``."""
    c = complaint_view(spark, sf_dir)
    cols = [F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias(f.name) if f.name == "created_at" else F.col(f.name) for f in WAREHOUSE.fields]
    path = IO.save_table(c.select(*cols), _new_table(spark, "warehouse"), "csv")
    return IO.preprocess_dataset(spark, path, _new_table(spark, "processed"), multi_line=True).select(
        "complaint_id", "complaint_text", "cleaned_text")


@register("named_tables", "S11 C15",
          lambda: _c_sql() + """
SELECT 'departments' AS table_name, true_department AS label, count(*) AS n FROM c GROUP BY ALL
UNION ALL SELECT 'priorities', true_priority, count(*) FROM c GROUP BY ALL
UNION ALL SELECT 'issues', true_core_issue, count(*) FROM c GROUP BY ALL""")
def named_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of named result tables written side by side and read back from the returned paths."""
    c = complaint_view(spark, sf_dir)
    count = lambda col: c.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    paths = IO.write_tables({"departments": count("true_department"), "priorities": count("true_priority"), "issues": count("true_core_issue")},
                            _new_table(spark, "named"))
    parts = [spark.read.parquet(p).select(F.lit(name).alias("table_name"), "label", "n") for name, p in paths.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------------------
# Streaming extension
# ---------------------------------------------------------------------------

@register("stream_rule_triage", "C1 (stream extension, 2.11)", _rule_summary_sql)
def stream_rule_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C lands as Parquet files; a stream triages them (availableNow); the sink is summarized."""
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..streaming.triage_stream import run_to_table, triage_stream
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    c = complaint_view(spark, sf_dir).select("complaint_id", "complaint_text")
    c.write.parquet(f"{base}/in")
    stream = triage_stream(spark, f"{base}/in", c.schema, max_files_per_trigger=4)
    run_to_table(stream, f"{base}/out", f"{base}/ckpt")
    v = spark.read.parquet(f"{base}/out").select("department", "priority",
                                                 F.round(F.col("confidence_score") * 1000).cast("long").alias("milli"))
    return (v.groupBy("department", "priority")
             .agg(F.count(F.lit(1)).alias("n_complaints"), F.sum("milli").alias("confidence_milli_sum"))
             .withColumn("avg_confidence",
                         F.col("confidence_milli_sum").cast("double") / (F.col("n_complaints") * F.lit(1000.0))))


def _arrivals_sql() -> str:
    """CTE ``arr`` (complaint_id, created_at, batch): two years a batch, some rows late, some replayed one batch later."""
    return """
o AS (SELECT complaint_id, complaint_text, created_at, CASE WHEN complaint_id % 50 = 11 THEN 3
             ELSE least(greatest((year(created_at) - 1995) // 2, 0), 3) END AS b FROM c WHERE created_at IS NOT NULL),
arr AS (SELECT complaint_id, complaint_text, created_at, b AS batch FROM o
        UNION ALL SELECT complaint_id, complaint_text, created_at, b + 1 FROM o WHERE complaint_id % 10 = 3 AND b < 3)"""


@register("stream_department_counts", "C1 (stream extension, 2.11)",
          lambda: _c_sql().rstrip() + "," + _arrivals_sql() + """,
wm AS (SELECT j.range AS batch, max(arr.created_at) - INTERVAL 200 DAY AS mark FROM range(4) j LEFT JOIN arr ON arr.batch < j.range GROUP BY 1),
seen AS (SELECT arr.*, coalesce(arr.created_at <= wm.mark, FALSE) AS late FROM arr JOIN wm USING (batch)),
once AS (SELECT complaint_id, any_value(complaint_text) AS complaint_text, any_value(created_at) AS created_at FROM seen WHERE NOT late GROUP BY 1),
rr AS (""" + O.rule_rows_sql("once") + """)
SELECT CAST(year(created_at) AS INTEGER) AS year, r_department AS department, count(*) AS n,
       (SELECT count(*) FROM seen WHERE late) AS late_rows, (SELECT count(*) FROM seen) - (SELECT count(*) FROM seen WHERE late)
       - (SELECT count(*) FROM once) AS replays
FROM rr GROUP BY 1, 2""")
def stream_department_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complaints arrive in four batches with replays and late rows; a stream with a watermark counts each event once.

    A row is late if its time is at most the latest time of all batches before, less 200 days.
    """
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..streaming.triage_stream import accepted, late_rows, run_to_table, triage_stream
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    c = complaint_view(spark, sf_dir).select("complaint_id", "complaint_text", "created_at").where("created_at IS NOT NULL")
    period = F.least(F.greatest(F.floor((F.year("created_at") - 1995) / 2), F.lit(0)), F.lit(3))
    first = c.withColumn("batch", F.when(F.col("complaint_id") % 50 == 11, 3).otherwise(period).cast("int"))
    again = first.where("complaint_id % 10 = 3 AND batch < 3").withColumn("batch", F.col("batch") + 1)
    arrivals = materialize(first.unionByName(again), "arrivals")
    late = 0
    for batch in range(4):
        arrivals.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(f"{base}/in")
        stream = accepted(triage_stream(spark, f"{base}/in", c.schema), delay="200 days")
        late += late_rows(run_to_table(stream, f"{base}/out", f"{base}/ckpt"))
    out = spark.read.parquet(f"{base}/out")
    counts = out.groupBy(F.year("created_at").alias("year"), "department").agg(F.count(F.lit(1)).alias("n"))
    replays = arrivals.count() - late - out.count()
    return counts.select("year", "department", "n", F.lit(late).cast("long").alias("late_rows"), F.lit(replays).cast("long").alias("replays"))


# ---------------------------------------------------------------------------
# Dense vectors (J6 dense, W4, A14, A10)
# ---------------------------------------------------------------------------

_EMB_NN_SQL = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
nn AS (SELECT qid, did, score, rank FROM (
         SELECT a.vec_id AS qid, b.vec_id AS did, list_dot_product(a.v, b.v) AS score,
                row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) AS rank
         FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE rank <= 5)"""


@register("embedding_neighbours", "J6 W4 M4",
          lambda: "WITH" + _EMB_NN_SQL + """
SELECT qid, did, CAST(rank AS INTEGER) AS rank, floor(score * 1000000000 + 0.5) / 1000000000 AS score FROM nn""")
def embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    nn = SIM.dense_neighbours(read_table(spark, sf_dir, "embeddings"), 5)
    return nn.select("qid", "did", F.col("rank").cast("int"),
                     (F.floor(F.col("score") * 1000000000 + 0.5) / 1000000000).alias("score"))


@register("embedding_vote_accuracy", "A14 W2 A10",
          lambda: "WITH" + _EMB_NN_SQL + """,
nb AS (SELECT nn.qid, nn.rank, e.label AS nl,
              CAST(floor(least(greatest(nn.score, 0.0), 1.0) * 1000 + 0.5) AS BIGINT) AS milli
       FROM nn JOIN e ON e.vec_id = nn.did),
vote AS (SELECT qid, nl AS predicted_label FROM (
           SELECT qid, nl, row_number() OVER (PARTITION BY qid ORDER BY sum(milli) DESC, min(rank)) AS rn
           FROM nb GROUP BY qid, nl) WHERE rn = 1)
SELECT e.label, count(*) AS n, CAST(sum(CASE WHEN v.predicted_label = e.label THEN 1 ELSE 0 END) AS BIGINT) AS correct
FROM vote v JOIN e ON e.vec_id = v.qid GROUP BY e.label""")
def embedding_vote_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    nn = SIM.dense_neighbours(emb, 5)
    vote = SIM.weighted_label_vote(nn, emb)
    truth = emb.select(F.col("vec_id").alias("qid"), "label")
    return (vote.join(truth, "qid").groupBy("label")
                .agg(F.count(F.lit(1)).alias("n"),
                     F.sum((F.col("predicted_label") == F.col("label")).cast("long")).alias("correct")))


# ---------------------------------------------------------------------------
# External evaluation (C10, C11, P9): other complaint sets scored by the same models
# ---------------------------------------------------------------------------

def _external_rows(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Validation rows keyed by customer, CFPB-style rows keyed by part; numeric key -> complaint_id."""
    if kind == "validation":
        keys = read_table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("complaint_id"))
        return _with_numeric_key(GEN.generate_validation(keys, 101), kind)
    keys = read_table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("complaint_id"))
    return _with_numeric_key(GEN.generate_cfpb(keys, 202), kind)


def _with_numeric_key(rows: DataFrame, kind: str) -> DataFrame:
    prefix_len = 1 if kind == "validation" else 5     # 'V00001' / 'CFPB-000001'
    return rows.select(F.substring(F.col("complaint_id"), prefix_len + 1, 64).cast("long").alias("complaint_id"),
                       F.col("complaint_id").alias("external_id"),
                       *[c for c in rows.columns if c != "complaint_id"])


def _external_verdicts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    ext = _external_rows(spark, sf_dir, kind)
    c = complaint_view(spark, sf_dir)
    corpus = c if kind == "cfpb" else _test_train(spark, sf_dir)[1]     # CFPB page trains on the full warehouse
    q = ext.select("complaint_id", "complaint_text", "true_core_issue", "true_department", "true_priority")
    q = rule_triage(q, out_col="rule")
    q = NB.bayes_triage(q, NB.fit(corpus))
    return _retrieval_triage(q, corpus, 5, baseline_col="rule", out_col="retrieval")


def _external_sql(kind: str) -> str:
    if kind == "validation":
        cols = GEN.validation_columns(GEN.DUCK, 101)
        src = "(SELECT c_custkey + 1 AS complaint_id FROM customer)"
        corpus_filter = "WHERE s.split = 'train'"
    else:
        cols = GEN.cfpb_columns(GEN.DUCK, 202)
        src = "(SELECT p_partkey + 1 AS complaint_id FROM part)"
        corpus_filter = ""
    ext = f"SELECT {', '.join(cols)} FROM {src}"
    ext_keyed = (f"SELECT CAST(substr(complaint_id, {2 if kind == 'validation' else 6}) AS BIGINT) AS complaint_id, "
                 f"complaint_text, true_department, true_priority, true_core_issue FROM ({ext})")
    head = (_split_sql_prefix().rstrip() + ",\n"
            + f"ext AS MATERIALIZED ({ext_keyed}),"
            + O.vector_ctes("ext", prefix="e") + ","
            + O.vector_ctes("c") + ",\n"
            + f"dvec AS (SELECT v.* FROM vec v JOIN split s ON v.id = s.complaint_id {corpus_filter}),"
            + O.knn_ctes("evec", "dvec", "enorm", dnorm="norm")
            + ",\n" + f"qr AS MATERIALIZED ({O.rule_rows_sql('ext')}),"
            + O.retrieval_ctes("nn", "c", "qr") + ",\n"
            + O.bayes_ctes("qr", "evec", "dvec", _TRAIN_SQL if kind == "validation" else
                           "SELECT complaint_id, true_core_issue, true_department, true_priority FROM c") + ",\n")
    entries = f"""
ent AS (
  SELECT complaint_id, 0 AS ord, 'Rule-Based' AS name, r_department AS dept, r_milli AS milli FROM qr
  UNION ALL SELECT complaint_id, 1, '{NB.MODEL_NAME}', n_dept, n_milli FROM nb
  UNION ALL SELECT complaint_id, 2, 'RAG + LLM', g_department, g_milli FROM rag),
pred AS (SELECT e.name AS model, e.complaint_id, q.true_department AS y, e.dept AS p, e.milli
         FROM ent e JOIN qr q USING (complaint_id))
"""
    return head + entries


@register("external_validation", "C10 P9 A10 A11 A12",
          lambda: _external_sql("validation") + "SELECT m.*, 'handwritten_validation' AS evaluation_set FROM ("
                  + O.metrics_sql("pred") + ") m")
def external_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _external_verdicts(spark, sf_dir, "validation")
    pred = EV.stack_predictions(v, ["rule", "ml", "retrieval"], COMPARED)
    return EV.round_metrics(EV.macro_metrics(pred), 4).withColumn("evaluation_set", F.lit("handwritten_validation"))


@register("cfpb_benchmark", "C11 A10 A11",
          lambda: _external_sql("cfpb") + "SELECT model, accuracy, precision, recall, f1_score FROM ("
                  + O.metrics_sql("pred") + ") m")
def cfpb_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _external_verdicts(spark, sf_dir, "cfpb")
    pred = EV.stack_predictions(v, ["rule", "ml", "retrieval"], COMPARED)
    return EV.round_metrics(EV.macro_metrics(pred), 4).select("model", "accuracy", "precision", "recall", "f1_score")


from ..operators.retrieval import retrieved_table  # noqa: E402


@register("retrieved_examples", "P15 J5 F22",
          lambda: _retrieval_sql_prefix() + """
SELECT nb.qid AS query_id, CAST(nb.rank AS INTEGER) AS rank, CAST(d.complaint_id AS VARCHAR) AS complaint_id,
       coalesce(d.complaint_text, '') AS complaint_text, nb.department, nb.priority, nb.core_issue,
       CAST(nb.milli AS DOUBLE) / 1000.0 AS similarity
FROM rag_nb nb JOIN c d ON d.complaint_id = nb.did""")
def retrieved_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = _test_train(spark, sf_dir)
    out = _retrieval_triage(test.select("complaint_id", "complaint_text"), train, 5, neigh=neighbours(spark, sf_dir))
    return retrieved_table(out).select("query_id", F.col("rank").cast("int"), "complaint_id", "complaint_text",
                                       "department", "priority", "core_issue", "similarity")


# ---------------------------------------------------------------------------
# Term statistics and TF-IDF on documents (A20, M5, M6); wrong rows (P6, C13); verdicts as JSON
# ---------------------------------------------------------------------------

from ..operators import terms as TM  # noqa: E402


def _terms_sql() -> str:
    sw = O.arr(default_stopwords())
    return f"""
WITH w AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                                            lambda x: NOT list_contains({sw}, x)) AS w FROM documents),
tc AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (
         SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w)
       GROUP BY 1, 2),
st AS MATERIALIZED (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total,
         ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1.0 AS idf
       FROM tc GROUP BY 1 HAVING count(*) >= 2)
"""


def _document_terms(spark: SparkSession, sf_dir: str):
    docs = read_text_table(spark, sf_dir, "documents", by_key=True).select("doc_id", "text")
    counts = materialize(TM.term_counts(docs, "doc_id", "text"), "term_counts", "zstd")
    return counts, TM.term_stats(counts, read_table(spark, sf_dir, "documents").count())


@register("term_stats_documents", "A20", lambda: _terms_sql() + "SELECT term, df, total, round(idf, 6) AS idf FROM st")
def term_stats_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stats = _document_terms(spark, sf_dir)
    return stats.select("term", "df", "total", F.round("idf", 6).alias("idf"))


@register("tfidf_documents", "M5 M6 A20",
          lambda: _terms_sql() + """, x AS (SELECT tc.id, term, (1.0 + ln(tf)) * idf AS x FROM tc JOIN st USING (term))
SELECT id AS doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS weight FROM x""")
def tfidf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, stats = _document_terms(spark, sf_dir)
    return TM.staged_tfidf(counts, materialize(stats, "term_stats", "zstd")).select(F.col("id").alias("doc_id"), "term", F.round("weight", 6).alias("weight"))


@register("term_ids_documents", "M5 M6",
          lambda: _terms_sql() + """
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS term_id, df FROM st""")
def term_ids_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TM.term_ids(_document_terms(spark, sf_dir)[1]).select("term", "term_id", "df")


@register("sparse_vectors_documents", "M5 M6",
          lambda: _terms_sql() + """, i AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM st),
x AS (SELECT tc.id, term, (1.0 + ln(tf)) * idf AS x FROM tc JOIN st USING (term)),
n AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM x)
SELECT id AS doc_id, count(*) AS n_terms, CAST(sum(term_id) AS BIGINT) AS index_sum, CAST(max(term_id) AS BIGINT) AS last_index,
       round(sum(weight * weight), 6) AS length, round(max_by(weight, term_id), 6) AS last_weight
FROM n JOIN i USING (term) GROUP BY id""")
def sparse_vectors_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sparse vector per document over the dense term ids, told by its sums and last entry."""
    counts, stats = _document_terms(spark, sf_dir)
    stats = materialize(stats, "term_stats", "zstd")      # the counts' shuffle is gone before the terms are laid in order
    ids = TM.term_ids(stats)
    discard(stats)
    v = TM.sparse_vectors(TM.staged_tfidf(counts, ids), ids)
    total = lambda c, kind: F.aggregate(c, F.lit(0).cast(kind), lambda a, x: a + x)
    return v.select(F.col("id").alias("doc_id"), F.size("indices").cast("long").alias("n_terms"), total("indices", "long").alias("index_sum"),
                    F.element_at("indices", -1).alias("last_index"),
                    F.round(total(F.transform("values", lambda x: x * x), "double"), 6).alias("length"),
                    F.round(F.element_at("values", -1), 6).alias("last_weight"))


@register("wrong_rows", "P6 C13",
          lambda: _pred_sql_prefix() + """
SELECT model, complaint_id, y AS true_department, p AS predicted_department,
       CAST(milli AS DOUBLE) / 1000.0 AS confidence_score FROM pred WHERE NOT (y IS NOT DISTINCT FROM p)""")
def wrong_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).where("is_wrong").select(
        "model", "complaint_id", "true_department", "predicted_department", "confidence_score")


@register("cfpb_predictions", "C11 P3",
          lambda: _external_sql("cfpb") + """
SELECT model, complaint_id, y AS true_department, p AS predicted_department, y IS NOT DISTINCT FROM p AS is_correct FROM pred""")
def cfpb_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _external_verdicts(spark, sf_dir, "cfpb")
    return EV.stack_predictions(v, ["rule", "ml", "retrieval"], COMPARED).select(
        "model", "complaint_id", "true_department", "predicted_department", (~F.col("is_wrong")).alias("is_correct"))


@register("verdict_json", "P14",
          lambda: _c_sql() + f"""
SELECT complaint_id, CAST(to_json(struct_pack(core_issue := r_issue, detected_entities := r_entities, department := r_department,
         priority := r_priority, actionable_task := r_task, confidence_score := CAST(r_milli AS DOUBLE) / 1000.0, reasoning := r_reasoning,
         analysis_mode := '{LX.MODE_RULE}', supporting_evidence := r_evidence, retrieved_examples := CAST([] AS VARCHAR[]))) AS VARCHAR) AS verdict
FROM ({O.rule_rows_sql('c')}) r""")
def verdict_json_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.retrieval import verdict_json
    c = complaint_view(spark, sf_dir).select("complaint_id", "complaint_text")
    return rule_triage(c).select("complaint_id", verdict_json("analysis").alias("verdict"))


# ---------------------------------------------------------------------------
# Loose verdicts (F17), vector store (S7-S9), evaluation and report tables (C12, C15), rules on given texts
# ---------------------------------------------------------------------------

def _normalized_sql() -> str:
    """F17 over ``model_response``: one JSON object's fields coerced to the contract."""
    def text(key):
        return O.py_strip_sql(f"coalesce(json_extract_string(j, '$.{key}'), '')")

    priorities = " ".join(f"WHEN lower({text('priority')}) = '{p.lower()}' THEN '{p}'" for p in LX.PRIORITIES)
    entities = """CASE WHEN json_type(j, '$.detected_entities') = 'ARRAY'
        THEN array_to_string(from_json(json_extract(j, '$.detected_entities'), '["VARCHAR"]'), ',')
        ELSE coalesce(json_extract_string(j, '$.detected_entities'), '') END"""
    item = O.py_strip_sql("x")
    number = f"""CASE WHEN json_type(j, '$.confidence_score') = 'BOOLEAN'
        THEN CASE WHEN json_extract_string(j, '$.confidence_score') = 'true' THEN 1.0 ELSE 0.0 END
        ELSE TRY_CAST({text('confidence_score')} AS DOUBLE) END"""
    return _c_sql() + f"""
, v AS (SELECT complaint_id, CASE WHEN json_valid(model_response) THEN model_response END AS j FROM c),
o AS (SELECT complaint_id, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS j FROM v),
n AS (SELECT *, {number} AS conf FROM o)
SELECT complaint_id, {text('core_issue')} AS core_issue,
       array_to_string(list_filter(list_transform(string_split({entities}, ','), lambda x: {item}), lambda x: x <> ''), ', ')
         AS detected_entities,
       CASE WHEN list_contains({O.arr(LX.DEPARTMENTS)}, {text('department')}) THEN {text('department')}
            ELSE 'Customer Service' END AS department,
       CASE {priorities} ELSE 'Medium' END AS priority, {text('actionable_task')} AS actionable_task,
       CAST(CASE WHEN conf IS NULL OR isnan(conf) OR conf < 0 THEN 0.0 ELSE least(round(conf, 3), 1.0) END AS DOUBLE)
         AS confidence_score,
       {text('reasoning')} AS reasoning
FROM n"""


@register("verdict_normalization", "F17", _normalized_sql)
def verdict_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = complaint_view(spark, sf_dir).select("complaint_id", RS.loose_verdict("model_response").alias("loose"))
    v = c.select("complaint_id", RS.normalize_verdict("loose").alias("v"))
    return v.select("complaint_id", "v.core_issue", F.array_join("v.detected_entities", ", ").alias("detected_entities"),
                    "v.department", "v.priority", "v.actionable_task", "v.confidence_score", "v.reasoning")


@register("vector_store", "S7 S8 S9",
          lambda: _c_sql().rstrip() + "," + O.vector_ctes("c") + """
SELECT id AS complaint_id, CAST(bucket AS INTEGER) AS bucket, CAST(tf AS BIGINT) AS tf FROM vec""")
def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of C written to the store, found again by their fingerprint and read back."""
    import uuid
    from ..session import ensure_checkpoint_dir
    c = complaint_view(spark, sf_dir).select("complaint_id", "complaint_text")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/vectors-{uuid.uuid4().hex}"
    IO.load_or_build_vectors(spark, c, path)
    stored = IO.load_or_build_vectors(spark, c, path)
    return (stored.select("complaint_id", F.explode("vector").alias("b")).groupBy("complaint_id", F.col("b").cast("int").alias("bucket"))
                  .agg(F.count(F.lit(1)).alias("tf")))


@register("vector_store_refresh", "S7 S8 S9",
          lambda: _c_sql().rstrip() + """,
c2 AS (SELECT complaint_id, CASE WHEN complaint_id % 100 = 7 THEN coalesce(complaint_text, '') || ' Updated again.' ELSE complaint_text END
       AS complaint_text FROM c WHERE complaint_id % 100 <> 13),""" + O.vector_ctes("c2") + """
SELECT c2.complaint_id, CAST(coalesce(v.n, 0) AS BIGINT) AS n_tokens, CAST(coalesce(v.s, 0) AS BIGINT) AS bucket_sum,
       c2.complaint_id % 100 = 7 AS recomputed
FROM c2 LEFT JOIN (SELECT id, sum(tf) AS n, sum(tf * bucket) AS s FROM vec GROUP BY id) v ON v.id = c2.complaint_id""")
def vector_store_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of C brought up to date after 1 % of the rows changed and 1 % went: only changed texts are computed."""
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..sources import vector_store as VS
    c = complaint_view(spark, sf_dir).select("complaint_id", "complaint_text")
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/store-{uuid.uuid4().hex}"
    VS.refresh(c, root)
    changed = F.when(F.col("complaint_id") % 100 == 7, F.concat(F.coalesce("complaint_text", F.lit("")), F.lit(" Updated again.")))
    later = c.where("complaint_id % 100 <> 13").withColumn("complaint_text", changed.otherwise(F.col("complaint_text")))
    version = VS.refresh(later, root)
    v = VS.read(spark, root)
    return v.select("complaint_id", F.size("vector").cast("long").alias("n_tokens"),
                    F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x).alias("bucket_sum"),
                    (F.col("part") == version["parts"][-1]).alias("recomputed"))


@register("evaluation_report", "C12 C10",
          lambda: "SELECT m.*, 'grouped_holdout' AS evaluation_set FROM (" + _pred_sql_prefix() + O.metrics_sql("pred") + ") m"
                  " UNION ALL SELECT m.*, 'handwritten_validation' AS evaluation_set FROM ("
                  + _external_sql("validation") + O.metrics_sql("pred") + ") m")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-out and external metrics of every model in one table."""
    held_out = _metrics_df(spark, sf_dir).withColumn("evaluation_set", F.lit("grouped_holdout"))
    return held_out.unionByName(external_validation(spark, sf_dir))


@register("report_rows", "C15 A4 A6 P16",
          lambda: "SELECT 'complaint_length_distribution' AS report, CAST(bin AS VARCHAR) AS label, CAST(count AS DOUBLE) AS value"
                  " FROM (" + _c_sql() + _hist_sql("c", "complaint_text", 15) + ")"
                  " UNION ALL SELECT 'frequent_issues', issue, CAST(count AS DOUBLE) FROM (" + _c_sql() + """
SELECT coalesce(true_core_issue, 'Unknown') AS issue, count(*) AS count FROM c
GROUP BY 1 ORDER BY count DESC, issue ASC LIMIT 10)"""
                  " UNION ALL SELECT 'model_comparison', model || ' ' || metric, score FROM ("
                  + _pred_sql_prefix().rstrip() + ",\nmet AS (" + O.metrics_sql("pred") + """)
SELECT model, metric, score FROM met
UNPIVOT (score FOR metric IN (accuracy, precision, recall, f1_score, avg_confidence)))""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report tables stacked as (report, label, value)."""
    from ..operators.triage import report_tables
    tables = report_tables(complaint_view(spark, sf_dir), {"metrics": _metrics_df(spark, sf_dir)})
    cells = {"complaint_length_distribution": (F.col("bin").cast("string"), F.col("count")),
             "frequent_issues": (F.col("issue"), F.col("count")),
             "model_comparison": (F.concat_ws(" ", "model", "metric"), F.col("score"))}
    parts = [tables[name].select(F.lit(name).alias("report"), label.alias("label"), value.cast("double").alias("value"))
             for name, (label, value) in cells.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _text_rules_sql(table: str, keys: str) -> str:
    return f"""
SELECT {keys}, r_issue AS core_issue, r_department AS department, r_priority AS priority,
       CAST(r_milli AS DOUBLE) / 1000.0 AS confidence_score, array_to_string(r_evidence, ' | ') AS supporting_evidence,
       r_reasoning AS reasoning
FROM ({O.rule_rows_sql(table, 'text')}) r"""


def _text_rules(df: DataFrame, *keys: str) -> DataFrame:
    return rule_triage(df.select(*keys, "text"), "text").select(
        *keys, "analysis.core_issue", "analysis.department", "analysis.priority", "analysis.confidence_score",
        F.array_join("analysis.supporting_evidence", " | ").alias("supporting_evidence"), "analysis.reasoning")


@register("rule_triage_documents", "C1 F13 J1", lambda: _text_rules_sql("documents", "doc_id"))
def rule_triage_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_rules(read_text_table(spark, sf_dir, "documents"), "doc_id")


@register("rule_triage_conversations", "C1 F13 J1", lambda: _text_rules_sql("conversations", "conv_id, turn"))
def rule_triage_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_rules(read_text_table(spark, sf_dir, "conversations"), "conv_id", "turn")


# ---------------------------------------------------------------------------
# Rule table by join (J1), included models (C12), neighbours and clusters of the given documents
# ---------------------------------------------------------------------------

CUSTOM_RULES = ([(t.issue, t.text, t.weight) for t in LX.rule_terms() if t.kind == "keyword"]
                + [("Praise", "thank you", 2.0), ("Order lookup", "order", 0.25), ("Order lookup", "ticket", 0.25)])


def _custom_sql() -> str:
    rules = ", ".join(f"({O.q(i)}, {O.q(t)}, {w})" for i, t, w in CUSTOM_RULES)
    return _c_sql().rstrip() + f""",
t AS (SELECT complaint_id, ' ' || regexp_replace({O.normalize_sql('complaint_text')}, '[^\\p{{L}}\\p{{N}}_ ]+', ' | ', 'g') || ' ' AS t
      FROM c),
rules(issue, term, weight) AS (VALUES {rules}),
hit AS (SELECT complaint_id, issue, sum(weight) AS s, count(*) AS n, array_to_string(list_sort(list(term)), ' | ') AS ev
        FROM t, rules WHERE contains(t, ' ' || term || ' ')
        GROUP BY 1, 2),
best AS (SELECT *, sum(n) OVER (PARTITION BY complaint_id) AS total,
                row_number() OVER (PARTITION BY complaint_id ORDER BY s DESC, issue) AS place FROM hit)
SELECT t.complaint_id, coalesce(issue, {O.q(LX.NO_RULE_ISSUE)}) AS core_issue, CAST(coalesce(s, 0) AS DOUBLE) AS score,
       CAST(coalesce(total, 0) AS BIGINT) AS n_matches, coalesce(ev, '') AS evidence
FROM t LEFT JOIN best ON best.complaint_id = t.complaint_id AND place = 1"""


@register("rule_triage_custom", "J1 C1", _custom_sql)
def rule_triage_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complaints judged by a user's rule table: the built-in keywords and two more issues."""
    from ..operators.rule_table import triage_by_table
    rules = spark.createDataFrame(CUSTOM_RULES, "issue string, term string, weight double")
    c = complaint_view(spark, sf_dir).select("complaint_id", "complaint_text")
    return triage_by_table(c, rules, "complaint_id", "complaint_text").withColumn("evidence", F.array_join("evidence", " | "))


@register("evaluation_without_ml", "C12 C9",
          lambda: _pred_sql_prefix().rstrip() + ",\nincluded AS (SELECT * FROM pred WHERE model IN ('Rule-Based', 'RAG + LLM'))\n"
          + O.metrics_sql("included"))
def evaluation_without_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation with the classifier left out: its model is neither fitted nor scored."""
    from ..operators.triage import compare_models
    return compare_models(complaint_view(spark, sf_dir), include_ml=False)["metrics"]


@register("similar_documents", "J6 M4 W4",
          lambda: "WITH" + O.vector_ctes("documents", "doc_id", "text") + ",\nasked AS (SELECT * FROM vec WHERE id % 100 = 0),"
          + O.knn_ctes("asked", "vec", "norm", exclude_self=True)
          + "\nSELECT qid AS doc_id, CAST(rank AS INTEGER) AS rank, did AS neighbour_id, round(score, 9) AS similarity FROM nn")
def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other documents of every document whose id is divisible by 100, searched among all."""
    from ..operators.similar import distinct_top_k, hash_tokens
    docs = read_text_table(spark, sf_dir, "documents")
    vectors = materialize(docs.select(F.col("doc_id").cast("long").alias("did"), hash_tokens("text").alias("v")), "document_vectors")
    asked = vectors.where("did % 100 = 0").withColumnRenamed("did", "qid")
    near = distinct_top_k(asked, vectors, 5, exclude_self=True)
    return near.select(F.col("qid").alias("doc_id"), F.col("rank").cast("int"), F.col("did").alias("neighbour_id"),
                       F.round("score", 9).alias("similarity"))


@register("cluster_documents", "C14 M6 M10 T2 W6")
def cluster_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and heaviest terms of four clusters over all documents."""
    docs = read_text_table(spark, sf_dir, "documents").select("doc_id", "text")
    return CL.cluster_report(docs, k=4, n_init=5, text_col="text")[1]
