"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions only.

A source's rows, in an order drawn from a hash of their ids, form blocks; one block runs per slot. With weights a_s
that sum to A, block c of source s (from 0) is released at floor(c*A/a_s) and due by ceil((c+1)*A/a_s). Running, in
each slot, the released block that is due first keeps every source within less than one block of its share a_s/A at
every slot (Baruah et al., 1996). The schedule repeats after A slots, the weights without their common divisor, so one
period is computed, as a SQL aggregate over its slots, and any block's slot follows by arithmetic: nothing walks over
the data. The periods of all sets of sources that can be left are computed side by side.

When a source runs out, the others go on in a new phase, with the same weights among themselves and clocks set anew;
nothing is dropped or repeated. There are at most as many phases as sources; the driver holds only counts by source.

Rows get their places in a source without one task holding it: rows are numbered within hash buckets of a source, and
buckets start where the counts of those before them end. The hash is that of the id and the other columns, so rows of
one id, or of none, are dealt out too.

Defined results: a null source is a source of its own, named `<null>` in weights; weights default to the square roots
of the sources' row counts; sources without a weight and more than MOST_SOURCES sources are refused; a null id is
allowed; rows equal in all columns take places next to each other; new columns' names get underscores in front where
docs has them; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh

#: A mixture names its sources; the driver's plan grows with their number only.
MOST_SOURCES = 2000
NO_SOURCE = "<null>"


def edf_periods(spark: SparkSession, weights: list[int], last: list[int]) -> dict[int, list[int]]:
    """By each value x of `last`: the source that runs in each slot of one period of those whose `last` is x or more.

    The earliest deadline among released blocks runs. Slots gather in pieces of 256, so a step copies a piece at most.
    """
    values = sorted(set(last))
    if not values:
        return {}
    sets = spark.range(0, len(values), 1, len(values)).select(
        F.element_at(F.from_json(F.lit(json.dumps([{"last": x, "g": math.gcd(*(w for w, y in zip(weights, last, strict=True) if y >= x))} for x in values])), "array<struct<last:bigint,g:bigint>>"), (F.col("id") + 1).cast("int")).alias("one"),
        F.from_json(F.lit(json.dumps([{"w": w, "y": y} for w, y in zip(weights, last, strict=True)])), "array<struct<w:bigint,y:bigint>>").alias("every"),
    )
    rows = sets.selectExpr("one.last AS last", "transform(filter(every, e -> e.y >= one.last), e -> e.w div one.g) AS w").selectExpr("last", "w", "aggregate(w, 0L, (a, x) -> a + x) AS total")
    due = "struct(((st.c[i] + 1) * total + x - 1) div x AS due, i AS i, (st.c[i] * total) div x AS released)"
    best = f"array_min(filter(transform(w, (x, i) -> {due}), e -> e.released <= t AND st.c[e.i] < w[e.i])).i"
    full = "size(st.p) = 256"
    step = f"transform(array({best}), j -> named_struct('c', transform(st.c, (n, i) -> n + IF(i = j, 1L, 0L)), 'p', IF({full}, array(j), concat(st.p, array(j))), 'done', IF({full}, concat(st.done, array(st.p)), st.done)))[0]"
    start = "named_struct('c', transform(w, x -> 0L), 'p', cast(array() AS array<int>), 'done', cast(array() AS array<array<int>>))"
    found = rows.selectExpr("last", f"aggregate(sequence(0L, total - 1), {start}, (st, t) -> {step}, st -> flatten(concat(st.done, array(st.p)))) AS runs")
    return {r["last"]: list(r["runs"]) for r in found.collect()}


def phases(spark: SparkSession, blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """Rows (source, first, blocks, slot, period, weight, places): from block `first`, a phase's slots of one source."""
    left = {s: n for s, n in sorted(blocks.items()) if n > 0}
    order = {s: i for i, s in enumerate(sorted(left, key=lambda s: (Fraction(left[s], weights[s]), s)))}
    periods = edf_periods(spark, [weights[s] for s in left], [order[s] for s in left])
    out, slot, done = [], 0, dict.fromkeys(left, 0)
    while left:
        names = list(left)
        first = min(order[s] for s in names)
        if sum(i >= first for i in order.values()) == len(names):
            runs = periods[first]
        else:  # sources that ran out in another order, as their last slots have it
            runs = edf_periods(spark, [weights[s] for s in names], [0] * len(names))[0]
        common = math.gcd(*(weights[s] for s in names))
        period = len(runs)
        places = {s: [t for t, i in enumerate(runs) if i == k] for k, s in enumerate(names)}
        share = {s: weights[s] // common for s in names}
        last = {s: (left[s] - 1) // share[s] * period + places[s][(left[s] - 1) % share[s]] + 1 for s in names}
        end = min(last.values())
        for s in names:
            n = end // period * share[s] + bisect_left(places[s], end % period)
            out.append({"source": s, "first": done[s], "blocks": n, "slot": slot, "period": period, "weight": share[s], "places": places[s]})
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        slot += end
    return out


def tempered(counts: dict[str, int], scale: int = 1000) -> dict[str, int]:
    """Whole weights in proportion to the square roots of the counts, about `scale` in sum."""
    total = sum(math.sqrt(n) for n in counts.values()) or 1.0
    return {s: max(1, round(scale * math.sqrt(n) / total)) for s, n in counts.items()}


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block: int = 64, source: str = "source", doc_id: str = "doc_id", names: tuple[str, str, str] | None = None) -> DataFrame:
    """docs with each row's block in its source, the block's slot in the mixture, and its place, under `names` (block, slot, position): order by the last."""
    spark = docs.sparkSession
    names = names or tuple(fresh(docs, x) for x in ("block", "slot", "position"))
    src, key, tie, wide, bucket, start, begin, rank, plan_ = (fresh(docs, x) for x in ("mix_source", "mix_key", "mix_tie", "mix_range", "mix_bucket", "mix_start", "mix_begin", "mix_rank", "mix_plan"))
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = docs.withColumn(src, F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE))).withColumn(tie, F.xxhash64(*hashed)).withColumn(key, F.xxhash64(F.col(doc_id).cast("string"), F.col(tie)))
    counts = {r[0]: r[1] for r in keyed.groupBy(src).count().limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    weights = tempered(counts) if weights is None else weights
    if missing := sorted(set(counts) - set(weights)):
        raise ValueError(f"sources without a weight: {missing[:5]}")
    plan = phases(spark, {s: -(-n // block) for s, n in counts.items()}, weights)
    schema = "array<struct<source:string,first:bigint,blocks:bigint,slot:bigint,period:bigint,weight:bigint,places:array<bigint>>>"
    slots = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(plan)), schema)).alias(plan_))

    # buckets of about a thousand rows lie in ranges of 1,024 buckets; starts are summed up over ranges, then within them
    buckets = max(64, -(-sum(counts.values()) // 1000))
    keyed = keyed.withColumn(bucket, F.pmod(F.col(key), F.lit(buckets)))
    sizes = keyed.groupBy(src, bucket).count().withColumn(wide, F.floor(F.col(bucket) / 1024))
    within = Window.partitionBy(src, wide).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(src).orderBy(wide).rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy(src, wide).agg(F.sum("count").alias("n")).select(src, wide, F.coalesce(F.sum("n").over(over), F.lit(0)).alias(begin))
    starts = sizes.withColumn(start, F.coalesce(F.sum("count").over(within), F.lit(0))).join(ranges, [src, wide]).select(src, bucket, (F.col(start) + F.col(begin)).alias(start))
    order = Window.partitionBy(src, bucket).orderBy(key, doc_id, tie)
    ranked = keyed.withColumn(rank, F.row_number().over(order) - 1).join(starts, [src, bucket])
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(start))
    at: Column = F.floor(F.col(rank) / block)
    p = F.col(plan_)
    # the plan has at most sources^2 rows and sources * (sum of weights) places
    joined = ranked.join(F.broadcast(slots), (F.col(src) == p["source"]) & (at >= p["first"]) & (at < p["first"] + p["blocks"]))
    i = at - p["first"]
    slot = p["slot"] + F.floor(i / p["weight"]) * p["period"] + F.element_at(p["places"], ((i % p["weight"]) + 1).cast("int"))
    return joined.select(*docs.columns, at.alias(names[0]), slot.alias(names[1]), (slot * block + F.col(rank) % block).alias(names[2]))
