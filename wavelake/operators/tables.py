"""Event, segment, reference, region and graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import naming, scalar
from ..sources import shared
from . import recordings


def merge_segments(rows: DataFrame, by: list[str], gap: int = 0, counted: bool = False) -> DataFrame:
    """Half-open [start, end) ranges, joined where they lie at most `gap` apart; counted: with the number of ranges in each."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("start") > reach + gap) | reach.isNull()
    return rows.where("end > start").withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w)).groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *([F.count(F.lit(1)).alias("n_ranges")] if counted else [])).drop("island")


def complement(merged: DataFrame, by: list[str], total: DataFrame, least: int = 1) -> DataFrame:
    """What merged, disjoint ranges leave of [0, total), of at least `least`; total has a row of by and `total`."""
    edges = merged.select(*by, "start", "end").unionByName(total.select(*by, F.col("total").alias("start"), F.col("total").alias("end")))
    before = F.coalesce(F.lag("end").over(Window.partitionBy(*by).orderBy("start", "end")), F.lit(0))
    return edges.select(*by, before.alias("from"), F.col("start").alias("end")).withColumnRenamed("from", "start").where(F.col("end") - F.col("start") >= max(least, 1))


def clean_segments(bad: DataFrame, by: list[str], total: DataFrame, pad: int = 0, least: int = 1, gap: int = 0) -> DataFrame:
    """(by, start, end) of what bad ranges leave, each widened by `pad` to both sides within the recording and joined over gaps of at most `gap`; pieces shorter than `least` go."""
    wide = bad.join(total, by).select(*by, F.greatest(F.col("start") - pad, F.lit(0)).alias("start"), F.least(F.col("end") + pad, "total").alias("end"))
    return complement(merge_segments(wide, by, gap), by, total, least)


def deduplicate_events(events: DataFrame, by: list[str]) -> DataFrame:
    """Events equal in microseconds and trimmed text count once."""
    return events.select(*by, scalar.micros(F.col("onset")).alias("onset_us"), scalar.micros(F.col("duration")).alias("duration_us"), F.trim("text").alias("text")).distinct()


def clip_events(events: DataFrame, start: float, end: float) -> DataFrame:
    """Events that touch [start, end), cut to it, from its start; points keep no duration."""
    stop = F.col("onset") + F.greatest("duration", F.lit(0.0))
    a, b = F.greatest("onset", F.lit(start)), F.least(stop, F.lit(end))
    touch = (F.col("onset") < end) & ((stop > start) | ((F.col("duration") <= 0) & (F.col("onset") >= start)))
    return events.where(touch).withColumns({"onset": a - start, "duration": b - a})


def text_matches(text: Column, glob: str = "", contains: str = "", regex: str = "", empty: bool = False) -> Column:
    """A regular expression goes before a glob, that before a part; letters' case doesn't matter."""
    low = F.lower(text)
    if regex:
        test = text.rlike(f"(?i){regex}")
    elif glob:
        test = low.like(glob.lower().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_"))
    else:
        test = low.contains(contains.lower())
    return F.coalesce(test & (F.lit(empty) | (F.trim(text) != "")), F.lit(False))


def reference(values: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """(by, mean, std, n) of groups of at least two finite values that differ."""
    return values.where(scalar.finite(F.col("v"))).groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & (F.col("std") > 0))


def reservoir(rows: DataFrame, by: list[str], key: list[str], most: int, seed: int = 1337) -> DataFrame:
    """At most `most` rows of each group, a uniform sample that a seed and the rows' keys fix: those of the least MD5 of seed and key.

    Of a long group only rows below a bound of the hash are ranked, `most` and eight deviations of them to be expected;
    that fewer lie below has a chance of less than 1e-14, and then the sample is smaller. Null keys count as empty.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key))
    hashed = rows.withColumn("_hash", F.md5(text))
    share = F.conv(F.substring("_hash", 1, 12), 16, 10).cast("double") / float(1 << 48)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), ((most + 8 * most**0.5 + 20) / F.col("_n")).alias("_bound"))
    same = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)]
    near = hashed.join(sizes, same).where(share < F.col("_bound"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_hash", *key))
    return near.withColumn("_place", place).where(F.col("_place") <= most).select(*rows.columns)


def robust_reference(values: DataFrame, by: list[str], key: list[str] | None = None, most: int | None = None, seed: int = 1337, least: int = 2) -> DataFrame:
    """(by, mean, std, n) as `reference`, with the median and the robust scale of all finite values of each group; only where a caller gives `most`, of a `reservoir` of so many.

    The values are written to the shared folder once, for the rounds of the quantiles and the counts.
    """
    rows = values.where(scalar.finite(F.col("v")))
    rows = shared.written((rows if most is None else reservoir(rows, by, key or [], most, seed)).select(*by, "v"), "values")
    out = recordings.robust(rows, by, kept=True).join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    return out.where((F.col("n") >= least) & (F.col("scale") > 0)).select(*by, F.col("median").alias("mean"), F.col("scale").alias("std"), "n")


def z_scores(values: DataFrame, reference: DataFrame, on: list[str]) -> DataFrame:
    """values with z against a reference table; null without a row there."""
    return values.join(reference.select(*on, "mean", "std"), on, "left").withColumn("z", (F.col("v") - F.col("mean")) / F.col("std")).drop("mean", "std")


def last_wins(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The row with the greatest ordinal of each key: an aggregate, so that no key is sorted in one task."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*by, "r.*")


def regions(values: DataFrame) -> DataFrame:
    """(group_type, group, n_channels, mean) over all, lobes, hemispheres and both."""
    rows = values.withColumn("lobe", naming.lobe(F.col("channel"))).withColumn("hemi", naming.hemisphere(F.col("channel")))
    sets = rows.groupingSets([[], [F.col("lobe")], [F.col("hemi")], [F.col("lobe"), F.col("hemi")]], "lobe", "hemi")
    out = sets.agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n_channels"), F.avg("v").alias("mean"))
    kind = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "lobe").when(F.col("gid") == 2, "hemisphere").otherwise("lobe_hemi")
    name = F.when(F.col("gid") == 3, "All").when(F.col("gid") == 1, F.col("lobe")).when(F.col("gid") == 2, F.col("hemi")).otherwise(F.concat_ws("_", "lobe", "hemi"))
    return out.select(kind.alias("group_type"), name.alias("group_name"), "n_channels", "mean")


def edges(rows: DataFrame) -> DataFrame:
    """Undirected edges (a, b, w) from rows with an ordinal: loops and weights that aren't finite go, the first of a pair stays."""
    good = rows.where((F.col("a") != F.col("b")) & scalar.finite(F.col("w"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w", "ord")
    return good.groupBy("a", "b").agg(F.min_by("w", "ord").alias("w"))


def nodes(edges: DataFrame) -> DataFrame:
    """(node, degree, strength, mean_weight, max_weight)."""
    both = edges.select(F.col("a").alias("node"), "w").unionByName(edges.select(F.col("b").alias("node"), "w"))
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"), F.avg("w").alias("mean_weight"), F.max("w").alias("max_weight"))


def region_pairs(edges: DataFrame, region: Column | None = None) -> DataFrame:
    """(region_a, region_b, edge_count, sum_weight, mean_weight); region is an expression over a column `node`."""
    of = region if region is not None else F.concat_ws("_", naming.lobe(F.col("node")), naming.hemisphere(F.col("node")))
    named = edges.withColumn("node", F.col("a")).withColumn("ra", of).withColumn("node", F.col("b")).withColumn("rb", of)
    return named.groupBy(F.least("ra", "rb").alias("region_a"), F.greatest("ra", "rb").alias("region_b")).agg(F.count(F.lit(1)).alias("edge_count"), F.sum("w").alias("sum_weight"), F.avg("w").alias("mean_weight"))


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The `top` rows by size of v, then metric, then roi, with their rank: a top-k, then a number on those few rows."""
    order = [F.abs("v").desc(), F.col("metric"), F.col("roi")]
    return rows.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
