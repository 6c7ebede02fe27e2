"""Incremental vector store: only new texts are computed, versions are swapped whole; mergeable sketches; replayed events."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from casewise.operators import sketches as SK
from casewise.operators.similar import hash_tokens
from casewise.sources import vector_store as VS


def frame(spark, rows):
    return spark.createDataFrame(rows, "complaint_id long, complaint_text string, note string")


def content(df):
    return sorted((repr(r["complaint_id"]), r["complaint_text"] or "", r["note"] or "", r["vector"]) for r in df.collect())


def test_only_new_texts_are_computed(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="casewise-store-"), "s")
    with pytest.raises(FileNotFoundError):
        VS.read(spark, root)
    rows = [(i, f"text number {i % 40} of the corpus", "n") for i in range(100)] + [(None, None, None), (5, "", "twice"), (5, "", "twice")]
    first = VS.refresh(frame(spark, rows), root)
    assert (first["computed"], first["reused"]) == (41, 0)
    assert content(VS.read(spark, root).drop("part")) == content(frame(spark, rows).withColumn("vector", hash_tokens("complaint_text")))
    same = VS.refresh(frame(spark, rows), root)
    assert same["rows"] == first["rows"] and same["computed"] == 0
    later = [r for r in rows if r[0] != 7] + [(200, "an entirely new text", "x"), (201, "text number 3 of the corpus", "y")]
    second = VS.refresh(frame(spark, later), root)
    assert (second["computed"], second["reused"]) == (1, 41) and len(second["parts"]) == 2
    got = VS.read(spark, root)
    assert content(got.drop("part")) == content(frame(spark, later).withColumn("vector", hash_tokens("complaint_text")))
    assert [r["complaint_id"] for r in got.where(F.col("part") == second["parts"][-1]).collect()] == [200]
    # The old version is still whole, and a folder that nobody names changes nothing.
    assert VS.read(spark, root, first).count() == len(rows)
    frame(spark, rows[:3]).write.parquet(f"{root}/rows/abandoned")
    assert VS.current(spark, root)["rows"] == second["rows"]
    assert not [f for f in os.listdir(root) if f.startswith("_CURRENT")]


def test_parts_in_use_are_written_as_one(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="casewise-store-"), "s")
    for n in range(4):
        version = VS.refresh(frame(spark, [(i, f"text {i}", "n") for i in range(n, n + 5)]), root, most_parts=2)
    assert len(version["parts"]) == 2 and (version["computed"], version["reused"]) == (1, 4)
    assert sorted(r["complaint_text"] for r in VS.read(spark, root).collect()) == [f"text {i}" for i in range(3, 8)]
    empty = VS.refresh(frame(spark, []), root)
    assert VS.read(spark, root, empty).count() == 0


def test_sketches_merge_like_their_union(spark):
    df = spark.range(30_000).selectExpr("id % 7 AS g", "CAST(id % 5000 AS STRING) AS a", "IF(id % 3 = 0, NULL, id) AS b")
    parts = SK.sketch_table(df.where("g < 3"), ["g"], ["a", "b"]).unionByName(SK.sketch_table(df.where("g >= 3"), ["g"], ["a", "b"]))
    assert parts.count() == 7
    whole = SK.estimates(SK.merged(parts, [])).first()
    direct = SK.estimates(SK.sketch_table(df, [], ["a", "b"])).first()
    assert whole["rows"] == 30_000 and whole["approx_a"] == direct["approx_a"] and whole["approx_b"] == direct["approx_b"]
    for name, exact in (("approx_a", 5000), ("approx_b", 20_000)):
        assert abs(whole[name] - exact) <= 3 * SK.standard_error() * exact


def test_replays_and_late_rows(spark):
    from casewise.streaming.triage_stream import accepted, late_rows, run_to_table
    base = tempfile.mkdtemp(prefix="casewise-replay-")
    batches = [[(1, "2024-01-01"), (2, "2024-01-03"), (1, "2024-01-01")], [(2, "2024-01-03"), (3, "2024-01-10")],
               [(3, "2024-01-10"), (4, "2024-01-05"), (5, "2024-01-09"), (6, "2024-01-08")]]
    late = 0
    for rows in batches:
        spark.createDataFrame(rows, "complaint_id long, t string").selectExpr(
            "complaint_id", "CAST(t AS TIMESTAMP) AS created_at").write.mode("append").parquet(f"{base}/in")
        stream = accepted(spark.readStream.schema("complaint_id long, created_at timestamp").parquet(f"{base}/in"), delay="2 days")
        late += late_rows(run_to_table(stream, f"{base}/out", f"{base}/ckpt"))
    # Before the third batch the mark is 8 January: rows of the 5th and the 8th are late, the 9th is not.
    assert sorted(r["complaint_id"] for r in spark.read.parquet(f"{base}/out").collect()) == [1, 2, 3, 5]
    assert late == 2
