"""Relevance metrics of rankings against graded judgements."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def relevance(ranked: DataFrame, grades: DataFrame, k: int = 10, by: str = "query") -> DataFrame:
    """ndcg and mrr at ``k`` for each query, from (query, id, rank) and (query, id, grade). Gains are
    ``2 ** grade - 1`` over ``log2(rank + 1)``."""
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    judged = ranked.filter(F.col("rank") <= k).join(grades, [by, "id"], "left").fillna(0, ["grade"])
    found = judged.groupBy(by).agg(F.sum(gain).alias("dcg"), F.coalesce(F.max(F.when(F.col("grade") > 0, 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"))
    best = grades.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("grade"), "id"))).filter(F.col("rank") <= k)
    ideal = best.groupBy(by).agg(F.sum(gain).alias("ideal"))
    return ideal.join(found, by, "left").select(
        by, F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(F.lit(0.0)).alias("ndcg"), F.coalesce("mrr", F.lit(0.0)).alias("mrr")
    )


#: Buckets of an interval in a round, and rows that an interval may hold to be settled at once.
BUCKETS, SETTLED = 1024, 10_000


def nearest_ranks(rows: DataFrame, column: str, fractions: list[float]) -> DataFrame:
    """fraction, n, value: the value of rank ``ceil(fraction * n)`` (1 at least) among the ``n`` values, exact at any size.

    Nothing is sorted: each round counts the values of the intervals that hold a wanted rank in ``BUCKETS`` parts and
    goes on with the part that holds it, until its values are few or all alike. Nulls and NaN are left out.
    """
    spark = rows.sparkSession
    x = F.col(column).cast("double")
    values = rows.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    n, low, high = values.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    schema = "fraction double, n long, value double"
    if not n:
        return spark.createDataFrame([(f, 0, None) for f in fractions], schema)
    found: dict[float, float] = {}
    # rank within its interval, the interval, and the values in it
    open_ = {f: (min(n, max(1, math.ceil(f * n - 1e-9))), low, high, n) for f in dict.fromkeys(fractions)}
    while open_:
        for f in [f for f, (_, lo, hi, _) in open_.items() if lo == hi]:
            found[f] = open_.pop(f)[1]
        few = {f: o for f, o in open_.items() if o[3] <= SETTLED}
        if few:
            parts = F.array(*[F.when(F.col("x").between(lo, hi), F.lit(i)) for i, (_, lo, hi, _) in enumerate(few.values())])
            held = values.select("x", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("i")).groupBy("i", "x").count().collect()
            for i, (f, (rank, *_)) in enumerate(few.items()):
                for v, c in sorted((r["x"], r["count"]) for r in held if r["i"] == i):
                    rank -= c
                    if rank <= 0:
                        found[f] = v
                        break
                open_.pop(f)
        if not open_:
            break
        def part(lo, hi):  # in two steps, so that no difference overflows
            share = (F.col("x") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
            return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        wanted = F.array(*[F.when(F.col("x").between(lo, hi), F.struct(F.lit(i).alias("i"), part(lo, hi).alias("b"))) for i, (_, lo, hi, _) in enumerate(open_.values())])
        each = values.select("x", F.explode(F.filter(wanted, lambda p: p.isNotNull())).alias("p")).groupBy("p.i", "p.b")
        counted = each.agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()  # BUCKETS rows for each fraction at most
        for i, (f, (rank, *_)) in enumerate(list(open_.items())):
            for r in sorted((r for r in counted if r["i"] == i), key=lambda r: r["b"]):
                if rank <= r["c"]:
                    open_[f] = (rank, r["lo"], r["hi"], r["c"])
                    break
                rank -= r["c"]
    return spark.createDataFrame([(f, n, found[f]) for f in fractions], schema)
