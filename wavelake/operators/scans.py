"""Scans along long channels in chunks.

What a row needs from the rows before it is found within its chunk of places, and at a chunk's beginning from a summary
of the chunks before: the last value, or the runs at a chunk's edges. Summaries are a row or two a chunk and are composed
by a window over them, so a task holds one chunk of samples or a channel's summaries, never a channel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places (samples, ids) of a chunk; where places are seconds, SECONDS.
PLACES, SECONDS = 1 << 16, 512


def chunk_of(order: str, size: float) -> Column:
    return F.floor(F.col(order) / size).cast("long")


def neighbour(rows: DataFrame, by: list[str], order: str, value: Column | str, name: str, back: bool = True, size: float = PLACES) -> DataFrame:
    """rows with the value of the row before (or after) in order; null at the ends. Places in `order` differ."""
    value = F.col(value) if isinstance(value, str) else value
    rows = rows.withColumn("_chunk", chunk_of(order, size)).withColumn("_value", F.struct(value.alias("v")))
    edge = F.max_by if back else F.min_by
    whole, within = Window.partitionBy(*by).orderBy("_chunk"), Window.partitionBy(*by, "_chunk").orderBy(order)
    step = F.lag if back else F.lead
    edges = rows.groupBy(*by, "_chunk").agg(edge("_value", order).alias("_edge"))
    carried = edges.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), F.col("_chunk").alias("_bc"), step("_edge").over(whole).alias("_carry"))
    inner = rows.withColumn("_near", step("_value").over(within))
    same = [F.col("_chunk") == F.col("_bc"), *(F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by))]
    out = inner.join(carried, same).withColumn(name, F.coalesce("_near", "_carry")["v"])
    return out.drop("_chunk", "_value", "_near", "_carry", "_bc", *(f"_b{i}" for i in range(len(by))))


def forward_filled(rows: DataFrame, by: list[str], order: str, value: str, start: float | None = 0.0, size: float = PLACES) -> DataFrame:
    """Nulls take the last value before them; the first ones `start`."""
    rows = rows.withColumn("_chunk", chunk_of(order, size))
    known = F.col(value).isNotNull()
    edges = rows.groupBy(*by, "_chunk").agg(F.max_by(value, F.when(known, F.col(order))).alias("_last"))
    carry = F.last("_last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    carried = edges.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), F.col("_chunk").alias("_bc"), carry.alias("_carry"))
    within = Window.partitionBy(*by, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col("_chunk") == F.col("_bc"), *(F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by))]
    out = rows.withColumn("_own", F.last(value, ignorenulls=True).over(within)).join(carried, same)
    return out.withColumn(value, F.coalesce("_own", "_carry", F.lit(start))).drop("_chunk", "_own", "_carry", "_bc", *(f"_b{i}" for i in range(len(by))))


def local_runs(rows: DataFrame, by: list[str], order: str, label: str, size: float = PLACES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows with (_chunk, _island), and runs of equal labels within chunks: (by, _chunk, _island, label, first, last, n, run), `run` the first place of the whole run; those at a chunk's edges and those inside apart.

    One order by place gives all of it: a run ends before the row where the next begins. Aggregates by run would hold
    the runs of a task, and a second order by label its rows, once more.
    """
    rows = rows.withColumn("_chunk", chunk_of(order, size))
    a, whole = Window.partitionBy(*by, "_chunk").orderBy(order), Window.partitionBy(*by, "_chunk")
    begins = (F.col("_row") == 1) | ~F.lag(label).over(a).eqNullSafe(F.col(label))
    placed = rows.withColumns({"_row": F.row_number().over(a).cast("long"), "_was": F.lag(order).over(a)}).withColumn("_begins", begins)
    marked = placed.withColumn("_island", F.sum(F.col("_begins").cast("int")).over(a.rowsBetween(Window.unboundedPreceding, 0)))
    heads = marked.withColumns({"_all": F.count(F.lit(1)).over(whole), "_top": F.max(order).over(whole)}).where("_begins")
    heads = heads.withColumns({"_next": F.lead("_row").over(a), "_last": F.lead("_was").over(a)})
    n = F.coalesce("_next", F.col("_all") + 1) - F.col("_row")
    edge = (F.col("_row") == 1) | F.col("_next").isNull()
    local = heads.select(*by, "_chunk", label, "_island", F.col(order).alias("first"), F.coalesce("_last", "_top").alias("last"), n.alias("n"), edge.alias("_edge"))
    # an edge goes on with the one before it if that is the last of the chunk before and has the same label
    w = Window.partitionBy(*by).orderBy("first")
    edges = local.where("_edge").withColumn("_new", ~F.coalesce(F.lag("_chunk").over(w) != F.col("_chunk"), F.lit(False)) | ~F.lag(label).over(w).eqNullSafe(F.col(label)))
    edges = edges.withColumn("run", F.last(F.when(F.col("_new"), F.col("first")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.drop("_row", "_was", "_begins"), edges.drop("_new", "_edge"), local.where("not _edge").withColumn("run", F.col("first")).drop("_edge")


def runs(rows: DataFrame, by: list[str], order: str, label: str, size: float = PLACES) -> DataFrame:
    """(by, label, first, last, n): runs of equal labels at consecutive places."""
    _, edges, inner = local_runs(rows, by, order, label, size)
    joined = edges.groupBy(*by, label, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("run")
    return joined.unionByName(inner.select(*joined.columns))


def with_runs(rows: DataFrame, by: list[str], order: str, label: str, size: float = PLACES) -> DataFrame:
    """rows with `run`, the first place of the run of equal labels that each belongs to."""
    marked, edges, inner = local_runs(rows, by, order, label, size)
    keys = [*by, "_chunk", "_island", label]
    names = edges.unionByName(inner).select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(keys)), "run")
    same = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(keys)]
    return marked.join(names, same).drop("_chunk", "_island", *(f"_b{i}" for i in range(len(keys))))


def overlapped(rows: DataFrame, order: str, reach: float, size: float) -> DataFrame:
    """rows dealt to chunks `_chunk`, those within `reach` before a chunk's beginning also as its history (`_own` false): a trailing window of `reach` is whole in its chunk."""
    size = max(size, reach)
    at, rest = F.floor(F.col(order) / size).cast("long"), F.col(order) - F.floor(F.col(order) / size) * size
    both = F.array(F.struct(at.alias("c"), F.lit(True).alias("o")), F.struct((at + 1).alias("c"), F.lit(False).alias("o")))
    where = F.when(rest >= size - reach, both).otherwise(F.slice(both, 1, 1))
    return rows.withColumn("_x", F.explode(where)).select(*rows.columns, F.col("_x.c").alias("_chunk"), F.col("_x.o").alias("_own"))
