"""Exact quantiles of long groups with bounded buffers.

A mergeable sketch brackets each wanted rank: its rank error is at most 1 / accuracy of a group, so in a group of
some multiples of that the values two such errors to either side enclose the rank for certain. A second pass counts what lies below a bracket and the different
values inside it, combined before the shuffle; the rank is then found in the running counts of a few thousandths of the
group. Nothing holds a group's values, as the exact aggregate does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def place(n: Column, p: float) -> Column:
    """Where a quantile lies among n ordered values from 0; what rounding moved off a rank is put back."""
    at = (n - 1) * p
    return F.when(F.abs(at - F.round(at)) <= 1e-12 + 1e-14 * n, F.round(at)).otherwise(at)


def quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """(by, names of wanted): quantiles linear between neighbouring ranks, nulls left out; groups of nulls only have no row. Keys compare null with null."""
    names, gap = list(wanted), 2.0 / accuracy
    keys = [f"_k{i}" for i in range(len(by))]
    ok = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).cast("double").alias("_v")).where("_v is not null")
    ends = F.array(*(F.lit(min(max(p + side * gap, 0.0), 1.0)) for p in wanted.values() for side in (-1, 1)))
    sketch = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_q"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # a short group is its own bracket; at the very ends the sketch may miss the extremes
    short = F.col("_n") <= 4 * accuracy
    low = [F.when(short | F.lit(p <= 2 * gap), F.col("_min")).otherwise(F.col("_q")[2 * i]) for i, p in enumerate(wanted.values())]
    high = [F.when(short | F.lit(p >= 1 - 2 * gap), F.col("_max")).otherwise(F.col("_q")[2 * i + 1]) for i, p in enumerate(wanted.values())]
    bracket = F.array(*(F.struct(F.lit(i).alias("i"), lo.alias("lo"), hi.alias("hi"), place(F.col("_n"), p).alias("at")) for i, (p, lo, hi) in enumerate(zip(wanted.values(), low, high, strict=True))))
    brackets = sketch.select(*(F.col(k).alias(f"{k}b") for k in keys), bracket.alias("_b"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}b")) for k in keys]
    joined = ok.join(brackets, same) if keys else ok.crossJoin(F.broadcast(brackets))  # one row without keys
    v = F.col("_v")
    marked = F.transform("_b", lambda x: F.struct(x["i"].alias("i"), x["at"].alias("at"), F.when(v >= x["lo"], v).alias("v"), (v <= x["hi"]).alias("in")))
    cells = joined.select(*keys, F.explode(F.filter(marked, lambda x: x["in"])).alias("x")).groupBy(*keys, F.col("x.i").alias("_i"), F.col("x.at").alias("_at"), F.col("x.v").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    # a bracket's cells in order, all brackets of a key in one exchange: the sum before a bracket is what its first cell began with
    w = Window.partitionBy(*keys).orderBy("_i", F.col("_v").asc_nulls_first())
    sums = cells.withColumn("_all", F.sum("_c").over(w))
    before = F.coalesce(F.max("_all").over(Window.partitionBy(*keys).orderBy("_i").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)) if len(names) > 1 else F.lit(0)
    sums = sums.withColumn("_sum", F.col("_all") - before)
    rank, aggregates = F.floor("_at"), []
    for i in range(len(names)):
        own = F.col("_i") == i
        aggregates += [F.min(F.when(own & (F.col("_sum") > rank), F.col("_v"))).alias(f"a{i}"), F.min(F.when(own & (F.col("_sum") > rank + 1), F.col("_v"))).alias(f"b{i}"), F.max(F.when(own, F.col("_at") - rank)).alias(f"t{i}")]
    found = sums.groupBy(*keys).agg(*aggregates)
    at = [F.when(F.col(f"t{i}") > 0, F.col(f"a{i}") * (1 - F.col(f"t{i}")) + F.col(f"b{i}") * F.col(f"t{i}")).otherwise(F.col(f"a{i}")).alias(n) for i, n in enumerate(names)]
    return found.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), *at)


def largest(rows: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """The n rows of the greatest values (not null), ties by order: the cut value is found first, and only its ties are sorted."""
    ok = rows.where(F.col(value).isNotNull())
    total = ok.count()
    if n >= total or n <= 0:
        return ok if n > 0 else ok.limit(0)
    # the n-th greatest value: a quantile that falls on a rank
    at = quantiles(ok, [], value, {"cut": (total - n) / (total - 1)}).first()["cut"]
    above = ok.where(F.col(value) > at)
    return above.unionByName(ok.where(F.col(value) == at).orderBy(order).limit(n - above.count()))
