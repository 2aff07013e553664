"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within them, one representative a group.

Vectors are compared only under one (not null) label. Exact copies become one weighted vector first. Each label's
vectors get a home cell by spherical k-means, fitted on a bounded sample. A pair with cosine >= t lies at most
e = sqrt(2 - 2t) apart on the unit sphere, so a vector y at home in b can have a partner at home in a only if it is
within e of the plane between the two centroids: y.(c_b - c_a) <= e |c_b - c_a|. Such y are guests of a. Every vector
then meets all its partners in its home cell, so links are whole and each is counted once from either end. Cells are
cut into blocks; a task multiplies one block of home vectors by one block of the cell's vectors, so a cell of any size
is never in one task. A block product gives each home vector's number of links and a spanning forest, not pairs.

Bounds: the k-means sample has about 32 vectors a cell; up to 128 coarse cells are fitted on a part of it in one task, and
each coarse cell's share of the cells in a task of its own. All labels together have about `most_cells` centroids, which
are what the workers are sent; beyond that cells grow, and blocks with them.

Defined results: a null label, null id, or a vector that is null, empty, zero or holds null or non-finite components
links with nothing and is its own component; vectors of different lengths are not compared; rows that repeat an id are
separate vectors, linked if they are alike (classes of equal vectors have keys of their own then). An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written


def unit(vectors) -> np.ndarray:
    """Rows of unit length, in double precision."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, block: int = 1024) -> np.ndarray:
    """k unit centroids; starts from evenly spaced rows, empty cells keep their centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + block] @ c.T).argmax(1) for i in range(0, len(x), block)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


COARSE = 128


def fit(classes: DataFrame, counts: list, cell_rows: int, most_cells: int) -> dict[tuple, np.ndarray]:
    """Centroids by (label, length), for labels of more than one cell."""
    total = sum(r["n"] for r in counts) or 1
    k = {(r["label"], r["dim"]): max(1, min(-(-r["n"] // cell_rows), int(most_cells * r["n"] / total))) for r in counts}
    size = {(r["label"], r["dim"]): r["n"] for r in counts}
    many = {key: n for key, n in k.items() if n > 1}
    if not many:
        return {}
    spark = classes.sparkSession
    wanted = spark.createDataFrame([(*key, n, min(n, COARSE), min(1.0, 32 * n / size[key]), min(1.0, 32 * min(n, COARSE) / size[key])) for key, n in many.items()], "label long, dim int, k int, k1 int, rate double, rate1 double")
    pick = F.pmod(F.xxhash64("key", F.lit("cells")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample, _ = written(classes.join(F.broadcast(wanted), ["label", "dim"]).where(pick <= F.col("rate")).select("label", "dim", "key", "vec", "k", "k1", (pick <= F.col("rate1")).alias("first")), "sample")

    def coarse(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(pdf.sort_values("key")["vec"])
        c = spherical_kmeans(x, min(int(pdf["k1"].iloc[0]), len(x)))
        return pd.DataFrame({"label": key[0], "dim": key[1], "centroid": list(c)})

    def fine(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(pdf.sort_values("key")["vec"])
        c = spherical_kmeans(x, max(1, min(-(-int(pdf["k"].iloc[0]) // COARSE), len(x))))
        return pd.DataFrame({"label": key[0], "dim": key[1], "centroid": list(c)})

    def gathered(rows: list) -> dict[tuple, np.ndarray]:
        out: dict[tuple, list] = {}
        for r in sorted(rows, key=lambda r: (r["label"], r["dim"], r["centroid"])):
            out.setdefault((r["label"], r["dim"]), []).append(r["centroid"])
        return {key: np.array(c) for key, c in out.items()}

    schema = "label long, dim int, centroid array<double>"
    cells = gathered(sample.where("first").groupBy("label", "dim").applyInPandas(coarse, schema).collect())  # at most COARSE a label
    if max(many.values()) > COARSE:

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for key, pdf in batch.groupby(["label", "dim"]):
                    if key in cells:
                        yield pdf.assign(part=(unit(pdf["vec"]) @ cells[key].T).argmax(1))

        dealt = sample.where(F.col("k") > COARSE).select("label", "dim", "key", "vec", "k").mapInPandas(deal, "label long, dim int, key long, vec array<double>, k int, part int")
        cells |= gathered(dealt.groupBy("label", "dim", "part").applyInPandas(fine, schema).collect())  # about most_cells
    return {key: c for key, c in cells.items() if len(c) > 1}


def dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93, cell_rows: int = 4096, block: int = 1024, most_cells: int = 16384) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vec"), F.col(label).cast("long").alias("label"))
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & whole, F.lit(False)))
    good = rows.where("ok").select("id", "vec", "label")
    classes, _ = written(good.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")).withColumn("dim", F.size("vec")), "vectors")
    # an id may stand on different vectors: then their classes' keys are hashes
    shared = classes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit(True).alias("shared"))
    classes = classes.join(shared, "id", "left").withColumn("key", F.when(F.col("shared"), F.shiftrightunsigned(F.xxhash64("id", "label", "vec"), 1)).otherwise(F.col("id"))).drop("shared") if not shared.isEmpty() else classes.withColumn("key", F.col("id"))
    # labels of many vectors get cells; only they come to the driver, at most all / cell_rows of them
    counts = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows).collect()
    cells = fit(classes, counts, cell_rows, most_cells)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, pdf in batch.groupby(["label", "dim"]):
                c = cells.get(key)
                if c is None:
                    yield pdf.assign(cell=0, home=True)
                    continue
                for low in range(0, len(pdf), 256):
                    some = pdf.iloc[low : low + 256]
                    dots = unit(some["vec"]) @ c.T
                    home = dots.argmax(1)
                    gap = np.sqrt(np.maximum(2 - 2 * c[home] @ c.T, 0))
                    own = np.take_along_axis(dots, home[:, None], 1)
                    r, a = np.nonzero(own - dots <= reach * gap)
                    yield some.iloc[r].assign(cell=a, home=home[r] == a)

    placed = classes.select("label", "dim", "key", "weight", "vec").mapInPandas(assign, "label long, dim int, key long, weight long, vec array<double>, cell int, home boolean")
    sizes = placed.groupBy("label", "dim", "cell").agg((F.floor(F.count(F.lit(1)) / block) + 1).cast("int").alias("na"), (F.floor(F.count_if("home") / block) + 1).cast("int").alias("nh"))
    at = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    placed = placed.join(sizes, ["label", "dim", "cell"])
    columns = ["label", "dim", "cell", "key", "weight", "vec"]
    left = placed.where("home").select(*columns, F.lit(True).alias("own"), at("nh").alias("h"), F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("a"))
    right = placed.select(*columns, F.lit(False).alias("own"), F.explode(F.sequence(F.lit(0), F.col("nh") - 1)).alias("h"), at("na").alias("a"))

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["own"].to_numpy(bool)
        ids, weight, x = pdf["key"].to_numpy(np.int64), pdf["weight"].to_numpy(np.int64), unit(pdf["vec"])
        h, a = np.flatnonzero(own), np.flatnonzero(~own)
        if not len(h) or not len(a):
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        near = (x[h] @ x[a].T >= threshold) & (ids[h][:, None] != ids[a][None, :])
        links = near @ weight[a]
        rows, cols = near.any(1), near.any(0)
        top = np.iinfo(np.int64).max
        hl, al, part = ids[h][rows], ids[a][cols], near[rows][:, cols]
        roots_h, roots_a = hl.copy(), al.copy()
        while part.size:
            new_h = np.minimum(roots_h, np.where(part, roots_a[None, :], top).min(1))
            new_a = np.minimum(roots_a, np.where(part, new_h[:, None], top).min(0))
            if (new_h == roots_h).all() and (new_a == roots_a).all():
                break
            roots_h, roots_a = new_h, new_a
        return pd.DataFrame({"id": np.concatenate([hl, al]), "links": np.concatenate([links[rows], np.zeros(len(al), np.int64)]), "root": np.concatenate([roots_h, roots_a])})

    found, _ = written(left.unionByName(right).groupBy("label", "dim", "cell", "h", "a").applyInPandas(products, "id long, links long, root long"), "links")
    group = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    least = classes.select("key", "id").join(group, "key").groupBy("component").agg(F.min("id").alias("least"))
    group = group.join(least, "component").select("key", "least")
    per = (
        classes.select("label", "vec", "key", "id", "weight")
        .join(found.groupBy(F.col("id").alias("key")).agg(F.sum("links").alias("links")), "key", "left")
        .join(group, "key", "left")
        .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("least", "id").alias("component"))
    )
    linked = good.join(per, ["label", "vec"], "left").select("id", "links", "component")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias("vec_id"),
        F.col("links").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )
