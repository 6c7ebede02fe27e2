"""Grouped split (M12, J10) and nearest neighbours."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from casewise.operators import evaluate as EV
from casewise.operators import similar as SIM
from casewise.operators.retrieval import retrieval_triage
from casewise.sources.complaints import complaint_view

from conftest import SF_SMALL


def test_grouped_split_holds_out_whole_groups(spark):
    s = EV.group_split(complaint_view(spark, SF_SMALL))
    leak = EV.leakage(s).first()
    assert leak.shared_groups == 0
    groups = leak.train_groups + leak.test_groups
    assert leak.test_groups == math.ceil(0.25 * groups)


def test_split_cut_by_nested_prefixes_equals_sorting(spark):
    keys = sorted(hashlib.md5(str(i).encode()).hexdigest() for i in range(500))
    df = spark.createDataFrame([(k,) for k in keys], "_split_key string")
    for share in (0.002, 0.25, 0.9, 1.0):
        cut = EV.split_cut(df, share, step=1, bucket_keys=2)
        assert [k for k in keys if k <= cut] == keys[:math.ceil(share * 500)]
    assert EV.split_cut(df, 0.0) == "" and EV.split_cut(df.limit(0), 0.25) == ""


def test_blank_queries_are_dropped(spark):
    corpus = spark.createDataFrame([(1, "late parcel again", "Logistics", "High", "Delay")],
                                   "complaint_id long, complaint_text string, true_department string, true_priority string, true_core_issue string")
    asked = spark.createDataFrame([(5, " \t\n"), (6, None), (7, ""), (8, "parcel late")], "complaint_id long, complaint_text string")
    assert [r.query_id for r in SIM.similar_complaints(asked, corpus, 3).collect()] == [8]


def _brute(qs, ds, k):
    out = {}
    for qi, qv in qs:
        scores = []
        for di, dv in ds:
            dot = float(np.dot(qv, dv))
            if dot > 0:
                scores.append((-(dot / math.sqrt(float(np.dot(qv, qv)) * float(np.dot(dv, dv)))), di))
        out[qi] = [d for _, d in sorted(scores)[:k]]
    return out


def test_sparse_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    qs = [(i, rng.integers(0, 40, size=rng.integers(0, 12)).tolist()) for i in range(60)]
    ds = [(100 + i, rng.integers(0, 40, size=rng.integers(0, 12)).tolist()) for i in range(300)]
    qdf = spark.createDataFrame(qs, "qid long, v array<int>")
    ddf = spark.createDataFrame(ds, "did long, v array<int>")
    got = SIM.top_k_similar(qdf, ddf, 5, width=40, q_block=16, d_block=64)
    res = {}
    for r in got.orderBy("qid", "rank").collect():
        res.setdefault(r.qid, []).append(r.did)

    def dense(b):
        v = np.zeros(40)
        np.add.at(v, np.asarray(b, dtype=int), 1)
        return v
    want = _brute([(i, dense(b)) for i, b in qs], [(i, dense(b)) for i, b in ds], 5)
    assert {q: v for q, v in want.items() if v} == res


def test_retrieval_runs_without_generation(spark):
    c = complaint_view(spark, SF_SMALL)
    corpus = c.orderBy("complaint_id").limit(500)
    q = spark.createDataFrame([(999999, "My order arrived late and damaged.")], "complaint_id long, complaint_text string")
    r = retrieval_triage(q, corpus, 5).select("analysis.*").first()
    assert r.analysis_mode == "rag-retrieval"
    assert len(r.retrieved_examples) > 0
    assert r.supporting_evidence[-2].startswith("Retrieved ")


def test_distinct_search_equals_plain_search(spark):
    """Repeated vectors (in any token order) are searched once and give the same rows."""
    rng = np.random.default_rng(9)
    base = [rng.integers(0, 12, size=rng.integers(0, 5)).tolist() for _ in range(25)]
    rows = [(i, list(rng.permutation(base[int(rng.integers(0, 25))]).astype(int).tolist())) for i in range(200)]
    q = spark.createDataFrame(rows[:90], "qid long, v array<int>")
    d = spark.createDataFrame(rows, "did long, v array<int>")
    for own in (False, True):
        want = SIM.top_k_similar(q, d, 4, width=12, exclude_self=own)
        got = SIM.distinct_top_k(q, d, 4, width=12, exclude_self=own, q_block=16, d_block=16)
        key = lambda df: sorted((r.qid, r.did, round(r.score, 9), r["rank"]) for r in df.collect())
        assert key(got) == key(want)


def test_ties_stay_in_memory():
    import tracemalloc

    import pandas as pd
    fn = SIM._block_fn("sparse", 5, 384, False, True)
    q = pd.DataFrame({"qid": range(4096), "v": [[1, 2, 3, 3, 5]] * 4096})
    d = pd.DataFrame({"did": range(8192), "v": [[1, 2, 3, 3, 5]] * 8192})
    tracemalloc.start()
    out = fn(q, d)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    best = out[out.qid == 17].sort_values(["score", "did"], ascending=[False, True]).head(5)
    assert best.did.tolist() == [0, 1, 2, 3, 4] and (best.score == 1.0).all()
    assert peak < 1 << 30


def test_long_repetitive_texts_score_one():
    import pandas as pd
    fn = SIM._block_fn("sparse", 1, 16, False, True)
    out = fn(pd.DataFrame({"qid": [1], "v": [[3] * 5001]}), pd.DataFrame({"did": [2], "v": [[3] * 5001]}))
    assert out.score.tolist() == [1.0]


def test_workers_need_no_copy_of_the_package(tmp_path):
    """A neighbour query from another folder: only the driver can import the package."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from casewise.session import get_spark
spark = get_spark("local[2]", shuffle_partitions=4)
from casewise.operators.similar import similar_complaints
c = spark.createDataFrame([(1, "late parcel", "a", "b", "c"), (2, "late parcel again", "a", "b", "c")],
                          "complaint_id long, complaint_text string, true_department string, true_priority string, true_core_issue string")
assert similar_complaints(c, c, 1).count() == 2
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
