"""Streaming extension: rule triage on readStream and windowed counts with a watermark."""

import os
import tempfile

from pyspark.sql import functions as F

from casewise.operators.rules import rule_triage
from casewise.sources.complaints import complaint_view
from casewise.streaming.triage_stream import department_counts, run_to_table, triage_stream

from conftest import SF_SMALL


def test_stream_matches_batch_and_windows_count_every_row(spark):
    base = tempfile.mkdtemp(prefix="casewise-stream-")
    c = complaint_view(spark, SF_SMALL).select("complaint_id", "complaint_text", "created_at")
    c.repartition(4).write.parquet(os.path.join(base, "in"))
    stream = triage_stream(spark, os.path.join(base, "in"), c.schema, max_files_per_trigger=1)
    run_to_table(stream, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    got = spark.read.parquet(os.path.join(base, "out"))
    batch = rule_triage(c).select("complaint_id", F.col("analysis.department").alias("department"))
    assert got.count() == c.count()
    assert got.select("complaint_id", "department").exceptAll(batch).count() == 0

    counts = department_counts(triage_stream(spark, os.path.join(base, "in"), c.schema), "created_at", "1 day",
                               "3650 days")
    q = (counts.writeStream.format("memory").queryName("dept_windows").outputMode("complete")
         .option("checkpointLocation", os.path.join(base, "ckpt2")).trigger(availableNow=True).start())
    q.awaitTermination()
    total = spark.sql("SELECT sum(n) AS n FROM dept_windows").first().n
    assert total == c.where(F.col("created_at").isNotNull()).count()
