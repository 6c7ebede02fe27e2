"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in hashed partitions.  The matrix says how many rows of each
partition go to each shard: every row of it is a draw without replacement from
what the shards still lack (a multivariate hypergeometric law), so the column
sums are the exact shard sizes.  Rows are permuted inside their partition, the
first ones go to shard 0, the next to shard 1 and so on; after the exchange
every shard is permuted again.

All of this runs on digests: SHA-256 of the whole row, nulls at any depth
included, and a number among identical rows.  The rows themselves are shuffled
once, to meet their places; identical rows travel as one and are written for each
of their places, in runs of ``RUN``, so that no task writes all copies of one row.
Partitions are a hash of digest and copy number, not of the file split, so a lost executor
or another cluster size gives the same result.  Both permutations rank digests by
hashed cells of about ``rows_per_cell`` rows and number them from the cells'
counts, so no task sorts a whole partition or shard.  The driver holds the
matrix only: ``partitions`` x ``shards`` integers, whatever the size of the table.

Edge cases: rows need no id and may hold nulls; identical rows are dealt like any
others; an empty table gives an empty result; an input column
named like a result column (``shard``, ``slot``) is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .common import literal_table, packed, row_digest, small


#: Copies of one row that a task writes in a row.
RUN = 1 << 10


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` draws without replacement, for totals of any size.

    Inverse transform over the law's support, cut at 40 standard deviations
    (what lies beyond is far below double precision).
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mean = draws * (good / total)
    sd = (mean * (bad / total) * max(total - draws, 1) / max(total - 1, 1)) ** 0.5
    low, high = max(low, int(mean - 40 * sd) - 40), min(high, int(mean + 40 * sd) + 40)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((draws - k) / (bad - draws + k + 1))
    logp = np.concatenate(([0.0], np.cumsum(steps)))
    law = np.cumsum(np.exp(logp - logp.max()))
    return low + int(np.searchsorted(law, rng.random() * law[-1], side="right"))


def communication_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard; shard sizes differ by one at most."""
    rng, total = np.random.default_rng(seed), sum(sizes)
    lacks = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = []
    for n in sizes:
        row, others = [], sum(lacks)
        for k, lack in enumerate(lacks):
            others -= lack
            took = hypergeometric(rng, lack, others, n) if n else 0
            row.append(took)
            n -= took
            lacks[k] -= took
        matrix.append(row)
    return matrix


def _ranked(df: DataFrame, group: str, cells: int, order: list, out: str, groups: int) -> DataFrame:
    """``out``: rank from 0 of each row in its group, ordered by hashed cell (``_cell``), then ``order``."""
    inside = Window.partitionBy(group).orderBy("_cell")
    starts = (df.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
                .withColumn("_start", F.sum("_n").over(inside) - F.col("_n")).drop("_n"))
    place = F.row_number().over(Window.partitionBy(group, "_cell").orderBy(*order)) - 1
    return (df.withColumn("_place", place).join(small(starts, groups * cells, 24), [group, "_cell"])
              .withColumn(out, F.col("_start") + F.col("_place")).drop("_start", "_place"))


def numbered(counts: DataFrame) -> DataFrame:
    """(_h, _copy): every copy of each digest of (_h, _n), numbered from 0, written in runs of ``RUN``."""
    last = (F.col("_n") - 1).cast("long")
    few = counts.filter(F.col("_n") <= RUN).select("_h", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_copy"))
    runs = counts.filter(F.col("_n") > RUN).select("_h", last.alias("_last"), F.explode(
        F.sequence(F.lit(0).cast("long"), last, F.lit(RUN).cast("long"))).alias("_from"))
    spread = runs.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_h", "_from")
    return few.union(spread.select("_h", F.explode(F.sequence("_from", F.least("_last", F.col("_from") + RUN - 1))).alias("_copy")))


def places(copies: DataFrame, total: int, shards: int, seed: int, partitions: int, rows_per_cell: int) -> DataFrame:
    """(_h, _copy, shard, slot): the two permutations and the exchange between them, on digests and copy numbers alone."""
    local, final = (max(1, -(-total // (n * rows_per_cell))) for n in (partitions, shards))
    final = max(final, -(-partitions // shards))
    h = [F.xxhash64(F.lit(seed), F.lit(k), "_h", "_copy") for k in range(5)]
    keyed = copies.select("_h", "_copy", F.pmod(h[0], F.lit(partitions)).cast("int").alias("_part"),
                          F.pmod(h[1], F.lit(local)).cast("long").alias("_cell"), h[2].alias("_k1"), h[3].alias("_k2"), h[4].alias("_k3"))
    sizes = {r["_part"]: r["count"] for r in keyed.groupBy("_part").count().collect()}
    matrix = communication_matrix([sizes.get(p, 0) for p in range(partitions)], shards, seed)
    upto = [{"_part": p, "_upto": np.cumsum(row).tolist()} for p, row in enumerate(matrix)]
    bounds = small(literal_table(copies.sparkSession, upto, "_part int, _upto array<bigint>"), partitions, 8 * shards)
    permuted = _ranked(keyed, "_part", local, ["_k1", "_k2"], "_rank", partitions)
    dealt = (permuted.join(bounds, "_part")
                     .withColumn("shard", F.size(F.filter("_upto", lambda x: x <= F.col("_rank"))).cast("int"))
                     .withColumn("_cell", F.pmod(F.xxhash64("_k3", F.lit(seed)), F.lit(final)).cast("long")))
    placed = _ranked(dealt.select("_h", "_copy", "shard", "_cell", "_k1", "_k2", "_k3"), "shard", final, ["_k3", "_k1", "_k2"], "slot", shards)
    return placed.select("_h", "_copy", "shard", F.col("slot").cast("long").alias("slot"))


def shard_documents(df: DataFrame, shards: int = 24, seed: int = 8, partitions: int = 256, rows_per_cell: int = 1 << 13) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard)."""
    df = df.drop("shard", "slot")
    keyed = df.select(packed(df), row_digest(df).alias("_h"))
    counts = materialize(keyed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")), "shard_digests")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    where = places(numbered(counts), total, shards, seed, partitions, rows_per_cell)
    # The places of a digest, at most RUN in a row; the rows themselves are shuffled once, to meet them.
    runs = materialize(where.groupBy("_h", F.floor(F.col("_copy") / RUN).cast("long").alias("_run"))
                            .agg(F.collect_list(F.struct("shard", "slot")).alias("_to")), "shard_places")
    once = keyed.groupBy("_h").agg(F.first("_in").alias("_in"), F.count(F.lit(1)).alias("_n"))
    few = once.filter(F.col("_n") <= RUN).join(runs.filter("_run = 0").select("_h", "_to"), "_h").select("_in", "_to")
    many = (once.filter(F.col("_n") > RUN).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN))))
                .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_h", "_run")
                .join(runs, ["_h", "_run"]).select("_in", "_to"))
    return few.union(many).select("_in", F.explode("_to").alias("_at")).select("_in.*", "_at.shard", "_at.slot")
