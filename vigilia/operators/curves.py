"""Curves of a detector at every score: counts above each threshold, ROC and precision-recall, and the areas under them.

Scores are counted per distinct value and put in order by ranges; each range's
totals are carried to the ranges after it, so no task orders all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigilia.sources.stored import stored


def running_sums(rows: DataFrame, order: Column, sums: dict[str, str]) -> DataFrame:
    """The rows with, for each (column: name), the sum of the column over all rows up to this one in `order`. Rows of equal order are in no order among themselves.

    Rows are dealt by ranges of `order`; a window orders a range alone, and one row a range carries its totals on.
    """
    dealt = stored(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums)))
    ranges = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # as many rows as partitions
    before = totals.select("_range", *(F.coalesce(F.sum(f"_t{i}").over(ranges), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))))
    inside = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(before), "_range").withColumns({name: F.sum(c).over(inside) + F.col(f"_b{i}") for i, (c, name) in enumerate(sums.items())})
    return out.select(*rows.columns, *sums.values())


def score_counts(scored: DataFrame, score: str, positive: str, events: str | None = None) -> DataFrame:
    """(threshold, positives, negatives) per distinct score; where `events` is given, a row stands for that many events, of which `positive` are so; null scores are below all others, at no threshold, and count as -infinity; null labels are negative."""
    value = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    if events is not None:
        return scored.groupBy(value.alias("threshold")).agg(F.sum(positive).alias("positives"), F.sum(F.col(events) - F.col(positive)).alias("negatives"))
    hit = F.coalesce(F.col(positive), F.lit(False))
    return scored.groupBy(value.alias("threshold")).agg(F.count_if(hit).alias("positives"), F.count_if(~hit).alias("negatives"))


def curve(scored: DataFrame, score: str, positive: str, events: str | None = None) -> DataFrame:
    """(threshold, tp, fp, recall, fall_out, precision) at every distinct score, alerts being scores at or over the threshold.

    recall is null where nothing is positive, fall_out where nothing is negative.
    """
    rows = running_sums(score_counts(scored, score, positive, events), F.desc("threshold"), {"positives": "tp", "negatives": "fp"})
    total = rows.agg(F.max("tp").alias("_p"), F.max("fp").alias("_n"))
    out = rows.crossJoin(F.broadcast(total))
    return out.select("threshold", "positives", "negatives", "tp", "fp", F.try_divide("tp", "_p").alias("recall"), F.try_divide("fp", "_n").alias("fall_out"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def areas(points: DataFrame) -> DataFrame:
    """One row: positives, negatives, roc_auc (ties count half) and average_precision of a curve; null where one class is missing."""
    p, n = F.sum("positives"), F.sum("negatives")
    pairs = F.sum(F.col("negatives") * (F.col("tp") - F.col("positives") / 2))  # pairs in which the positive scores higher
    return points.agg(p.alias("positives"), n.alias("negatives"), F.try_divide(pairs, p * n).alias("roc_auc"), F.try_divide(F.sum(F.col("positives") * F.col("precision")), p).alias("average_precision"))
