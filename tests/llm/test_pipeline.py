from collections import Counter

import numpy as np
from conftest import SF_SMALL
from pyspark.sql import functions as F

import corpus_pipeline as P
from casewise.llm import decontaminate, simhash


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").cache()
    rows = {r["doc_id"]: r for r in docs.collect()}

    kept = P.language_id(spark, docs, SF_SMALL).cache()
    assert kept.columns == docs.columns
    gone = set(rows) - {r["doc_id"] for r in kept.collect()}
    assert all(not any(c.isalpha() for c in rows[d]["text"] or "") for d in gone)

    one = P.near_dedup(spark, kept, SF_SMALL).cache()
    have = sorted(r["doc_id"] for r in kept.collect())
    fps = np.array([simhash.simhash(rows[d]["text"]) for d in have], np.int64).view(np.uint64)
    least = list(range(len(have)))
    for _ in range(len(have)):
        before = list(least)
        for i in range(len(have)):
            near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2)
            low = min(least[j] for j in near)
            for j in near:
                least[j] = min(least[j], low)
        if least == before:
            break
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({have[k] for k in least})

    clean = P.decontamination(spark, one, SF_SMALL).cache()
    hits = decontaminate.matches(one, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).select("doc_id").distinct()
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted({r["doc_id"] for r in one.collect()} - {r["doc_id"] for r in hits.collect()})

    mixed = P.source_mixing(spark, clean, SF_SMALL).cache()
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3

    final = P.shards(spark, mixed, SF_SMALL)
    assert Counter(r["doc_id"] for r in final.collect()) == Counter(r["doc_id"] for r in mixed.collect())


def test_run_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9 + 1, "1 2 3", "en", None, 5),
                                 (None, "The only one of its kind in here", None, None, 3)], docs.schema)
    for name, df in (("odd", docs.union(odd).union(docs.limit(3))), ("empty", docs.limit(0))):
        sf = str(tmp_path / name)
        df.write.parquet(f"{sf}/documents.parquet")
        spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
        out = P.run(spark, sf).collect()
        assert (len(out) > 50) == (name == "odd")
        shards = Counter(r["shard"] for r in out)
        assert not out or max(shards.values()) - min(shards.values()) <= 1


def test_input_columns_keep_their_values(spark):
    """Columns named like a helper or a result of a stage come out as they went in."""
    names = ["lang_pred", "score", "size", "source_size", "target", "copies", "held_out", "_text", "_copy", "_in", "col"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumns({n: F.concat(F.lit(n), "doc_id") for n in names}).cache()
    for stage in (P.language_id, P.near_dedup, P.decontamination, P.source_mixing):
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
