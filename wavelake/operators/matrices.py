"""Region-of-interest tables, edge lists and connectivity matrices: reading them long, filtering, reshaping, summing up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar

# The band that a metric's name tells, by the first pattern that it holds; narrow ones stand before broad ones.
BANDS = [("alpha[_ -]?1", "alpha1"), ("alpha[_ -]?2", "alpha2"), ("beta[_ -]?1", "beta1"), ("beta[_ -]?2", "beta2"), ("beta[_ -]?3", "beta3"), ("highbeta|hi_?beta|high_beta", "high_beta"), ("lowbeta|lo_?beta|low_beta", "low_beta"), ("low_?gamma", "low_gamma"), ("high_?gamma", "high_gamma"), ("delta", "delta"), ("theta", "theta"), ("alpha", "alpha"), ("smr", "smr"), ("sigma", "sigma"), ("mu", "mu"), ("beta", "beta"), ("gamma", "gamma")]
# The kind of measure that a metric's name tells.
KINDS = [("lagged|phase|sync|coh|lps|pli|plv", "connectivity"), ("csd|current|density", "current_density"), ("power|amp", "power")]


def first_match(text: Column, table: list[tuple[str, str]], other: Column) -> Column:
    out = other
    for pattern, name in reversed(table):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def latest(value: str, ordinal: str, ties: tuple[str, ...] = ()) -> Column:
    """The value of the greatest ordinal of a group, null values left out; of equal ordinals the first row by `ties` (of a table, its place in the files)."""
    known = F.col(value).isNotNull()
    if not ties:
        return F.max_by(value, F.when(known, F.col(ordinal)))
    return F.min_by(value, F.when(known & F.col(ordinal).isNotNull(), F.struct((-F.col(ordinal)).alias("o"), *ties)))


def pick(df: DataFrame, keep: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The columns `keep`, and the metrics that are included and not excluded; letters' case doesn't matter."""
    want = {x.lower() for x in include or []}
    drop = {x.lower() for x in exclude or []}
    names = [c for c in df.columns if c not in keep and (not want or c.lower() in want) and c.lower() not in drop]
    return df.select(*keep, *names)


def long_metrics(wide: DataFrame, roi: str, ordinal: str) -> DataFrame:
    """(roi, metric, value) of a wide table of one row for each region; a region's last row wins where it has a value."""
    names = [c for c in wide.columns if c not in (roi, ordinal)]
    rows = wide.select(F.trim(roi).alias("roi"), ordinal, *(F.col(c).try_cast("double").alias(c) for c in names)).unpivot(["roi", ordinal], names, "metric", "value").where(F.col("value").isNotNull())
    return rows.groupBy("roi", "metric").agg(F.max_by("value", ordinal).alias("value"))


def keyed_metrics(long: DataFrame, ordinal: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """(roi, metric, value) of rows (roi, metric, [band], value): a band joins its metric's name; the last row of a key wins (see `latest`)."""
    name = F.concat_ws("_", "metric", F.when(F.trim("band") != "", F.trim("band"))) if "band" in long.columns else F.col("metric")
    rows = long.select("roi", name.alias("metric"), F.col("value").try_cast("double").alias("value"), ordinal, *ties)
    return rows.groupBy("roi", "metric").agg(latest("value", ordinal, ties).alias("value"))


def band_of(metric: Column) -> Column:
    return first_match(F.lower(metric), BANDS, F.lit(None).cast("string"))


def kind_of(metric: Column) -> Column:
    return first_match(F.lower(metric), KINDS, F.lit("metric"))


def is_z(metric: Column) -> Column:
    """Whether a metric's name says that it is a z score: `zscore`, or a z that stands alone."""
    return F.lower(F.trim(metric)).rlike(r"zscore|z-score|^z[_-]|_z$|_z_|(^|[^a-z0-9])z([^a-z0-9]|$)")


def filtered_edges(edges: DataFrame, absolute: bool = False, least: float | None = None, most: float | None = None) -> DataFrame:
    """Edges (.., w) by weight, which may lose its sign first."""
    out = edges.withColumn("w", F.abs("w")) if absolute else edges
    out = out.where(F.col("w") >= least) if least is not None else out
    return out.where(F.col("w") <= most) if most is not None else out


def upper_triangle(matrix: DataFrame, row: str = "a") -> DataFrame:
    """(a, b, w) of a square matrix of a labelled row for each node and a column for each: pairs right of the diagonal, in the columns' order."""
    names = [c for c in matrix.columns if c != row]
    place = F.create_map(*(F.lit(x) for i, c in enumerate(names) for x in (c, i)))
    rows = matrix.unpivot([row], names, "b", "w").withColumn("w", F.col("w").try_cast("double"))
    return rows.where((F.try_element_at(place, F.col("b")) > F.try_element_at(place, F.col(row))) & scalar.finite(F.col("w"))).select(F.col(row).alias("a"), "b", "w")


def matrix_cells(edges: DataFrame, ordinal: str, directed: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, w): a matrix's cells from edges, the later one where a cell comes again (see `latest`); undirected edges fill both."""
    rows = edges.select("a", "b", "w", ordinal, *ties)
    if not directed:
        rows = rows.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", ordinal, *ties))
    return rows.groupBy("a", "b").agg(latest("w", ordinal, ties).alias("w"))


def triangle_stats(cells: DataFrame) -> DataFrame:
    """(n, mean, std, min, max) of the finite cells above the diagonal."""
    x = cells.where((F.col("a") < F.col("b")) & scalar.finite(F.col("w")))
    return x.agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean"), F.stddev_pop("w").alias("std"), F.min("w").alias("min_w"), F.max("w").alias("max_w"))


def column_name(text: Column) -> Column:
    """A name that is safe as a column's: other characters than ASCII letters, digits and underscores become underscores, and a digit doesn't lead."""
    out = F.regexp_replace(F.trim(text), "[^A-Za-z0-9_]", "_")
    return F.when(out.rlike("^[0-9]"), F.concat(F.lit("r_"), out)).otherwise(out)
