"""Pipelines (C9/C12/C15), vector store (S9), verdict normalization (F17), I/O."""

import os
import tempfile

from pyspark.sql import functions as F

from casewise.operators import triage as TR
from casewise.operators.responses import normalize_verdict
from casewise.sources import io as IO
from casewise.sources.complaints import complaint_view

from conftest import SF_SMALL


def test_compare_models_without_ml(spark):
    c = complaint_view(spark, SF_SMALL)
    t = TR.compare_models(c, include_ml=False)
    m = {r.model: r for r in t["metrics"].collect()}
    assert set(m) == {"Rule-Based", "RAG + LLM"}
    assert all(0.0 <= r.accuracy <= 1.0 for r in m.values())
    conf = t["confusion"].groupBy("model").agg(F.sum("count").alias("n")).collect()
    assert all(r.n == m[r.model].n for r in conf)
    rep = TR.report_tables(c, t)
    assert rep["complaint_length_distribution"].count() == 15
    out = tempfile.mkdtemp(prefix="casewise-tables-")
    paths = IO.write_tables(rep, out)
    assert all(os.path.isdir(p) for p in paths.values())


def test_vector_store_rebuilds_only_when_content_changes(spark):
    c = complaint_view(spark, SF_SMALL).select("complaint_id", "complaint_text")
    path = os.path.join(tempfile.mkdtemp(prefix="casewise-vec-"), "vectors")
    first = IO.load_or_build_vectors(spark, c, path)
    mtime = os.path.getmtime(path)
    again = IO.load_or_build_vectors(spark, c, path)
    assert os.path.getmtime(path) == mtime and again.count() == first.count()
    changed = c.withColumn("complaint_text", F.concat(F.col("complaint_text"), F.lit(" x")))
    IO.load_or_build_vectors(spark, changed, path)
    assert os.path.getmtime(path) != mtime


def test_normalize_verdict(spark):
    df = spark.createDataFrame([(" Refund ", "billing, , product ", " Sales ", "high", " Do it. ", "0.8264", " ok "),
                                ("x", None, "Billing", "urgent", "t", "abc", None)],
                               "core_issue string, detected_entities string, department string, priority string, "
                               "actionable_task string, confidence_score string, reasoning string")
    a, b = df.select(normalize_verdict(F.struct(*df.columns)).alias("v")).select("v.*").collect()
    assert (a.core_issue, a.detected_entities, a.department, a.priority, a.confidence_score, a.reasoning) == \
        ("Refund", ["billing", "product"], "Customer Service", "High", 0.826, "ok")
    assert (b.department, b.priority, b.confidence_score, b.detected_entities) == ("Billing", "Medium", 0.0, [])


def test_csv_roundtrip_and_missing_files(spark):
    import pytest
    with pytest.raises(FileNotFoundError):
        IO.read_validation(spark, "/nonexistent/path.csv")
    c = complaint_view(spark, SF_SMALL)
    out = tempfile.mkdtemp(prefix="casewise-csv-")
    df = IO.preprocess_dataset(spark, _write_csv(spark, c, out), os.path.join(out, "processed"), multi_line=True)
    assert "cleaned_text" in df.columns and df.count() == c.count()


def _write_csv(spark, c, out):
    from casewise import schemas
    cols = [f.name for f in schemas.WAREHOUSE.fields]
    sel = c.select(*[F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias(n) if n == "created_at" else n
                     for n in cols])
    return IO.save_table(sel, os.path.join(out, "raw"), "csv")


def test_length_density_matches_brute_force(spark):
    import numpy as np
    from casewise.functions.text import word_count
    from casewise.operators.reports import length_density
    from casewise.sources.tables import read_table
    d = read_table(spark, SF_SMALL, "documents")
    out = length_density(d, "text", 25).orderBy("word_count").collect()
    w = np.array([r[0] for r in d.select(word_count(F.col("text"))).collect()], dtype=float)
    h = w.std(ddof=1) * len(w) ** (-0.2)
    for r in out:
        ref = np.exp(-0.5 * ((r.word_count - w) / h) ** 2).sum() / (len(w) * h * np.sqrt(2 * np.pi))
        assert abs(r.density - ref) <= 1e-12 * max(ref, 1e-300)


def test_csv_columns_by_name(spark, tmp_path):
    import pytest
    (tmp_path / "a.csv").write_text('complaint_text,complaint_id\n" late, ""very"" ",1\n"",2\n\\N,3\n')
    rows = IO.read_validation(spark, str(tmp_path / "a.csv")).orderBy("complaint_id").collect()
    assert [(r.complaint_id, r.complaint_text, r.true_department) for r in rows] == [("1", ' late, "very" ', None), ("2", "", None), ("3", None, None)]
    (tmp_path / "b.csv").write_text("complaint_id,body\n1,x\n")
    with pytest.raises(ValueError, match="complaint_text"):
        IO.preprocess_dataset(spark, str(tmp_path / "b.csv"), str(tmp_path / "out"))


def test_json_answers_are_strict(spark):
    from casewise.operators.responses import with_validation
    good = ('{"core_issue": "x", "detected_entities": [], "department": "Billing", "priority": "low", "actionable_task": "t", '
            '"confidence_score": %s, "reasoning": "r"}')
    cases = [(good % "0.5", "valid"), (good % "true", "valid"), (good % '"0.5"', "valid"), (good % '"0.5d"', "confidence_score must be numeric."),
             (good % '"1e-1f"', "confidence_score must be numeric."), (good % '"true"', "confidence_score must be numeric."),
             (good % "0.5" + " trailing", "Invalid JSON."), (good % "0.5" + "]", "Invalid JSON."), (good % "0.5" + ", 1", "Invalid JSON."),
             ((good % "0.5").replace('"', "'"), "Invalid JSON."), ("", "Invalid JSON."), (None, "Invalid JSON."), ("[1]", "JSON root must be an object.")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, r string")
    got = with_validation(df, "r", "v").orderBy("id").select("v.message").collect()
    assert [r.message for r in got] == [m for _, m in cases]
