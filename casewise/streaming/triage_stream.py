"""Rule triage on a stream (extension; the reproduced system is batch only).

Rule triage is a stateless projection, so the batch expression applies to a
``readStream`` DataFrame unchanged.  ``department_counts`` adds an
event-time window with a watermark, the usual way to bound state for late
rows, and ``accepted`` removes replayed events exactly.  Checkpoints go under the session's shared checkpoint folder unless a
location is given, so a restarted query resumes exactly once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rules import rule_triage
from ..session import ensure_checkpoint_dir


def triage_stream(spark: SparkSession, source_dir: str, schema: T.StructType, text_col: str = "complaint_text",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of flat rule verdicts over Parquet files arriving in ``source_dir``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_dir)
    v = rule_triage(src, text_col)
    return v.select(*[c for c in src.columns if c != text_col],
                    F.col("analysis.core_issue").alias("core_issue"),
                    F.col("analysis.department").alias("department"),
                    F.col("analysis.priority").alias("priority"),
                    F.col("analysis.confidence_score").alias("confidence_score"))


def department_counts(verdicts: DataFrame, time_col: str = "created_at", window: str = "1 day",
                      watermark: str = "2 days") -> DataFrame:
    """Windowed counts per department with a watermark (bounded state, late rows dropped after it)."""
    return (verdicts.withWatermark(time_col, watermark)
            .groupBy(F.window(time_col, window).alias("window"), "department")
            .agg(F.count(F.lit(1)).alias("n")))


def accepted(verdicts: DataFrame, id_col: str = "complaint_id", time_col: str = "created_at", delay: str = "2 days") -> DataFrame:
    """Each event once: rows at or before the watermark are late and dropped, replays of an id within ``delay`` too.

    State holds the ids of the last ``delay`` of event time only.  A replay after its state has gone is late by then,
    so nothing is counted twice.
    """
    return verdicts.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def late_rows(query) -> int:
    """Rows that the stateful operators of a finished query dropped because of the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def run_to_table(stream: DataFrame, sink_dir: str, checkpoint: str | None = None, output_mode: str = "append"):
    """Process everything available now into Parquet at ``sink_dir`` and stop."""
    spark = stream.sparkSession
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", ckpt)
         .outputMode(output_mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
