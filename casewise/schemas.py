"""Fixed Spark types of the verdict contract."""

from __future__ import annotations

from pyspark.sql import types as T

RETRIEVED_EXAMPLE = T.StructType([
    T.StructField("complaint_id", T.StringType()),
    T.StructField("complaint_text", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("core_issue", T.StringType()),
    T.StructField("similarity", T.DoubleType()),
])
RETRIEVED_EXAMPLES = T.ArrayType(RETRIEVED_EXAMPLE)

VERDICT = T.StructType([
    T.StructField("core_issue", T.StringType()),
    T.StructField("detected_entities", T.ArrayType(T.StringType())),
    T.StructField("department", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("actionable_task", T.StringType()),
    T.StructField("confidence_score", T.DoubleType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("analysis_mode", T.StringType()),
    T.StructField("supporting_evidence", T.ArrayType(T.StringType())),
    T.StructField("retrieved_examples", RETRIEVED_EXAMPLES),
])

VERDICT_FIELDS = [f.name for f in VERDICT.fields]

WAREHOUSE = T.StructType([
    T.StructField("complaint_id", T.LongType()),
    T.StructField("complaint_text", T.StringType()),
    T.StructField("true_department", T.StringType()),
    T.StructField("true_priority", T.StringType()),
    T.StructField("true_core_issue", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("product_line", T.StringType()),
    T.StructField("customer_segment", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("customer_tenure_months", T.IntegerType()),
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("expected_sla_hours", T.IntegerType()),
    T.StructField("escalation_level", T.IntegerType()),
    T.StructField("case_origin", T.StringType()),
    T.StructField("resolution_complexity", T.StringType()),
    T.StructField("task_signal", T.StringType()),
])

VALIDATION = T.StructType([
    T.StructField("complaint_id", T.StringType()),
    T.StructField("complaint_text", T.StringType()),
    T.StructField("true_department", T.StringType()),
    T.StructField("true_priority", T.StringType()),
    T.StructField("true_core_issue", T.StringType()),
])

CFPB = T.StructType([T.StructField(n, T.StringType()) for n in [
    "complaint_id", "product", "sub_product", "issue", "sub_issue", "consumer_complaint_narrative",
    "complaint_text", "company", "state", "submitted_via", "timely_response", "true_department",
    "true_priority", "true_core_issue"]])
