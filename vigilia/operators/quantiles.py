"""Exact quantiles of very large groups, by selection over counts.

`percentile` keeps every distinct value of a group in one buffer. Here values
are counted first; then the place of each asked rank is narrowed by the digits
of the values' binary form: counts per digit, running totals over at most 2^23
digits, and on with the digit that holds the rank. Values that agree in all
digits are equal, so the last digit names the value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigilia.sources.stored import stored

LEAD_BITS, DIGIT_BITS, DIGITS = 8, 23, 2  # bits of the fraction that go with the exponent, and of each digit after it


def _digits(x: Column) -> list[Column]:
    """Whole numbers whose order, one after another, is that of the doubles. Powers of two scale without rounding."""
    size = F.abs(x)
    exponent = F.when(size > 0, F.greatest(F.floor(F.log2(size)), F.lit(-1000))).otherwise(F.lit(-1001))
    scaled = F.when(size > 0, size * F.pow(F.lit(2.0), -exponent)).otherwise(F.lit(0.0)) * 2**LEAD_BITS  # at most a bit over 2^9
    out = [(exponent + 1002) * 2 ** (LEAD_BITS + 2) + F.floor(scaled)]
    for _ in range(DIGITS):
        scaled = (scaled - F.floor(scaled)) * 2**DIGIT_BITS
        out.append(F.floor(scaled))
    return [F.when(x < 0, -d).otherwise(d).cast("long") for d in out]


def grouped_quantiles(rows: DataFrame, by: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(by, q): for each group an array of its quantiles at `shares`, linear between neighbours, as `percentile` gives them.

    Null values do not count; a group without others has no row. The groups and
    `shares` are few: only the ranks asked for, two a share, are broadcast.
    """
    digits = [f"_d{i}" for i in range(DIGITS + 1)]
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    counts = stored(counts.withColumns(dict(zip(digits, _digits(F.col("_x"))))))  # each digit reads them again
    share = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)))).alias("s")
    places = counts.groupBy("_by").agg(F.sum("_n").alias("_all")).select("_by", "_all", share).select("_by", "s.i", ((F.col("_all") - 1) * F.col("s.p")).alias("_at"))
    ends = F.explode(F.array(F.struct(F.floor("_at").alias("rank"), (1 - (F.col("_at") - F.floor("_at"))).alias("part")), F.struct((F.floor("_at") + 1).alias("rank"), (F.col("_at") - F.floor("_at")).alias("part"))))
    asked, known = places.select("_by", "i", ends.alias("e")).select("_by", "i", "e.*").where("part > 0"), ["_by"]
    for digit in digits:
        within = counts.join(F.broadcast(asked.select(known).distinct()), known, "left_semi")
        table = within.groupBy(*known, digit).agg(F.sum("_n").alias("_n"), F.max("_x").alias("_x"))
        table = table.withColumn("_upto", F.sum("_n").over(W.partitionBy(*known).orderBy(digit).rowsBetween(W.unboundedPreceding, 0)))
        below = F.col("_upto") - F.col("_n")
        asked = table.join(F.broadcast(asked), known).where((F.col("rank") >= below) & (F.col("rank") < F.col("_upto"))).select(*known, digit, "i", "part", (F.col("rank") - below).alias("rank"), "_x")
        known = [*known, digit]
        last = asked
        asked = asked.drop("_x")
    found = last.groupBy("_by", "i").agg(F.sum(F.col("_x") * F.col("part")).alias("q"))
    return found.groupBy("_by").agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("q")).select(F.col("_by").alias(by), F.col("q.q").alias("q"))
