"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and
share all words; a target stops at ``cap`` times its source's words and the
excess is shared again by weight.

A source whose target is r times its words first gives every document
floor(r) certain whole copies.  The rest of the target is drawn: a document's
inclusion probability is the fractional part of r, its rank is the random odds
u / (1 - u) divided by its inclusion odds, and the smallest ranks are taken up
to the words that are lacking (the last document only if that comes nearer).
``preference`` (a positive column, null: 1) multiplies inclusion odds, for
unequal probabilities inside a source.  u is a hash of the document's id and
size, so reruns agree.  Rows that share source, id and size are told apart by a
digest of the whole row and a number among identical rows, so each of them is drawn by
itself; identical rows travel as one and are written in runs.

No source is ever sorted as a whole: words are summed in rank buckets, and
only the bucket in which a source's draw ends is ordered.

Edge cases: a null text has size 0 (taken 0); null sources are one source; null
and repeated ids are drawn row by row; ``targets`` orders one row per source in
one task (sources are few beside rows); an empty table gives an empty result;
clashing input columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .common import packed, row_digest, small
from .sharding import RUN, numbered

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_unit(id_col: Column, size: Column, seed: int, rest: Column | None = None) -> Column:
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), size.cast("string"),
                   *([] if rest is None else [F.lit(":"), rest]))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(rows: DataFrame, cap: int = 3) -> DataFrame:
    """Per source: ``_n`` rows, ``source_size``, ``target`` from rows (``_source``, ``_size``)."""
    one = Window.partitionBy()  # a row per source
    s = rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("source_size"))
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.array(*[F.lit(w) for w in WEIGHTS])[(F.row_number().over(order) - 1) % len(WEIGHTS)]
    s = (s.withColumn("_w", weight.cast("long"))
          .withColumn("_cap", F.col("source_size") * cap).withColumn("_rank", F.row_number().over(order))
          .withColumn("_all", F.sum("source_size").over(one)))
    tight = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = (F.col("_all") - (F.sum("_cap").over(tight) - F.col("_cap"))).cast("double")
    share = left / (F.sum("_w").over(one) - (F.sum("_w").over(tight) - F.col("_w"))).cast("double")
    # Sources in the order in which they fill up: one is full if its share of what is left exceeds its cap.
    s = s.withColumn("_full", share * F.col("_w") > F.col("_cap"))
    level = ((F.col("_all") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(one)).cast("double")
             / F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(one).cast("double"))
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_w") * level)
    return s.select("_source", "_n", "source_size", target.alias("target"))


def _rank(odds: Column, u: Column) -> Column:
    """Pareto rank mapped to 0..1 (q / (1 + q) keeps the order)."""
    q = (u / (1 - u)) / odds
    return q / (1 + q)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        preference: str | None = None, cap: int = 3, seed: int = 9, rows_per_bucket: int = 1 << 14) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target`` and ``copies`` (0 to ``cap``)."""
    df = df.drop("size", "source_size", "target", "copies")
    size = words(F.col(text_col))
    prefer = F.coalesce(F.col(preference).cast("double"), F.lit(1.0)) if preference else F.lit(1.0)
    sized = df.select(packed(df), F.col(id_col).alias("_id"), size.alias("_size"), prefer.alias("_prefer"),
                      F.col(source_col).alias("_source"))
    slim = materialize(sized.drop("_in"), "mixing")
    shared = materialize(slim.groupBy("_source", "_id", "_size").count().filter("count > 1").select(
        F.col("_source").alias("_ts"), F.col("_id").alias("_ti"), F.col("_size").alias("_tz")), "mixing_shared")
    n_shared = shared.count()

    def alone(rows: DataFrame) -> DataFrame:
        """Rows that no other row equals in source, id and size, with their random number."""
        if n_shared:
            rows = rows.join(small(shared, n_shared, 96), _same_key(), "left_anti")
        return rows.withColumns({"_u": random_unit(F.col("_id"), F.col("_size"), seed), "_digest": F.lit(""), "_copy": F.lit(0).cast("long")})

    if n_shared:
        # The others: one row per digest, then one per copy.
        full = (df.select(packed(df), row_digest(df).alias("_h"), F.col(id_col).alias("_id"), size.alias("_size"), prefer.alias("_prefer"),
                          F.col(source_col).alias("_source")).join(small(shared, n_shared, 96), _same_key(), "left_semi"))
        once = full.groupBy("_h").agg(F.first("_in").alias("_in"), F.count(F.lit(1)).alias("_n"))
        kinds = materialize(full.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in (
            "_id", "_size", "_prefer", "_source")]), "mixing_kinds")
        copies = numbered(kinds.select("_h", "_n")).join(kinds.drop("_n"), "_h").withColumn("_digest", F.lower(F.hex("_h")))
        copies = materialize(copies.withColumn("_u", random_unit(F.col("_id"), F.col("_size"), seed, F.concat(
            "_digest", F.lit(":"), F.col("_copy").cast("string")))), "mixing_copies")
        slim = alone(slim).unionByName(copies.drop("_h"))
    else:
        slim = alone(slim)
    plan = materialize(targets(slim, cap), "mixing_targets")
    plan = (plan.withColumn("_certain", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                            .otherwise(F.lit(0)).cast("long"))
                .withColumn("_rest", F.col("target") - F.col("_certain") * F.col("source_size"))
                .withColumn("_p", F.when(F.col("source_size") > 0, F.col("_rest") / F.col("source_size")).otherwise(0.0))
                .withColumn("_odds", F.col("_p") / (1 - F.col("_p"))))
    n_sources = plan.count()
    key = [F.col("_source").eqNullSafe(F.col("_s"))]

    def ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
        """Rows of sources that draw, with their rank ``_v``; others have none."""
        side = small(plan.withColumnRenamed("_source", "_s"), n_sources, 256)
        draws = F.when(F.col("_p") > 0, _rank(F.col("_odds") * F.col("_prefer"), F.col("_u")))
        return rows.join(side, key, "left").withColumn("_v", draws)

    buckets = max(1024, -(-slim.count() // rows_per_bucket))
    bucket = F.floor(F.col("_v") * buckets).cast("long").alias("_bucket")
    per_source = Window.partitionBy("_source").orderBy("_bucket")
    sums = (ranked(slim, plan).filter("_v IS NOT NULL").select("_source", "_rest", "_size", bucket)
            .groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words"), F.first("_rest").alias("_rest"))
            .withColumn("_upto", F.sum("_words").over(per_source)))
    ends = (sums.filter("_upto > _rest").groupBy("_source")
                .agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_words")).alias("_before"))).alias("_e"))
                .select(F.col("_source").alias("_es"), "_e._bucket", "_e._before"))
    plan = plan.join(ends, F.col("_source").eqNullSafe(F.col("_es")), "left").drop("_es")
    plan = materialize(plan, "mixing_ends")
    inside = Window.partitionBy("_source").orderBy("_v", "_id", "_digest", "_copy")
    near = (ranked(slim, plan).filter(F.floor(F.col("_v") * buckets) == F.col("_bucket"))
            .withColumn("_upto", F.col("_before") + F.sum("_size").over(inside))
            .filter(F.col("_upto") - F.col("_size") / 2 <= F.col("_rest"))
            .groupBy("_source").agg(F.max(F.struct("_v", F.col("_id").isNotNull().alias("k"), "_id", "_digest", "_copy")).alias("_cut")).select(F.col("_source").alias("_cs"), "_cut"))
    plan = materialize(plan.join(near, F.col("_source").eqNullSafe(F.col("_cs")), "left").drop("_cs"), "mixing_cuts")
    b, cut = F.floor(F.col("_v") * buckets), F.col("_cut")
    same_id = F.col("_id").eqNullSafe(cut["_id"])
    at_cut = (F.col("_v") < cut["_v"]) | ((F.col("_v") == cut["_v"]) & (
        F.coalesce(F.col("_id") < cut["_id"], F.col("_id").isNull() & cut["k"])
        | (same_id & ((F.col("_digest") < cut["_digest"]) | ((F.col("_digest") == cut["_digest"]) & (F.col("_copy") <= cut["_copy"]))))))
    drawn = F.when(F.col("_bucket").isNull(), F.lit(True)).otherwise(
        (b < F.col("_bucket")) | ((b == F.col("_bucket")) & F.coalesce(at_cut, F.lit(False))))
    n_copies = (F.col("_certain") + F.when(F.col("_v").isNotNull() & drawn, 1).otherwise(0)).cast("int")
    result = [F.col("_size").alias("size"), "source_size", "target", n_copies.alias("copies")]
    mixed = ranked(alone(sized), plan).select("_in.*", *result)
    if not n_shared:
        return mixed
    run = F.floor(F.col("_copy") / RUN).cast("long").alias("_run")
    decided = materialize(ranked(copies, plan).select("_h", run, F.struct(*result).alias("_r")).groupBy("_h", "_run")
                          .agg(F.collect_list("_r").alias("_rs")), "mixing_decided")
    few = once.filter(F.col("_n") <= RUN).join(decided.filter("_run = 0").select("_h", "_rs"), "_h").select("_in", "_rs")
    many = (once.filter(F.col("_n") > RUN).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN))))
                .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_h", "_run")
                .join(decided, ["_h", "_run"]).select("_in", "_rs"))
    return mixed.unionByName(few.union(many).select("_in", F.explode("_rs").alias("_r")).select("_in.*", "_r.*"))


def _same_key() -> Column:
    return F.col("_source").eqNullSafe(F.col("_ts")) & F.col("_id").eqNullSafe(F.col("_ti")) & (F.col("_size") == F.col("_tz"))


ORACLE = r"""
WITH e AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '~') || coalesce(strlen(text) || ':' || text, '~')
                    || coalesce(strlen(lang) || ':' || lang, '~') || coalesce(strlen(source) || ':' || source, '~')
                    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '~')) AS dg FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY dg) - 1 AS copy, count(*) OVER (PARTITION BY source, doc_id, size) > 1 AS shared FROM e),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER () - (sum(cap) OVER t - cap))::DOUBLE / (sum(w) OVER () - (sum(w) OVER t - w))::DOUBLE * w > cap AS is_full,
             sum(source_size) OVER () AS total
      FROM w WINDOW t AS (ORDER BY cap::DOUBLE / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE w::DOUBLE * ((total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::DOUBLE
             / (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::DOUBLE) END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS certain FROM t),
o AS (SELECT *, target - certain * source_size AS rest,
             CASE WHEN source_size > 0 THEN (target - certain * source_size) / source_size ELSE 0.0 END AS pr FROM p),
r AS (SELECT d.doc_id, d.size, d.dg, d.copy, d.shared, o.*, (('0x' || substr(md5('9:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size::VARCHAR
             || CASE WHEN shared THEN ':' || dg || ':' || copy ELSE '' END), 1, 13))::BIGINT + 0.5)
             / 4503599627370496.0 AS u FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source),
v AS (SELECT *, CASE WHEN pr > 0 THEN ((u / (1 - u)) / (pr / (1 - pr))) / (1 + (u / (1 - u)) / (pr / (1 - pr))) END AS v FROM r),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY v, doc_id NULLS FIRST, CASE WHEN shared THEN dg ELSE '' END, copy) AS upto FROM v)
SELECT doc_id, size, source_size, target,
       (size * (certain + CASE WHEN v IS NOT NULL AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
