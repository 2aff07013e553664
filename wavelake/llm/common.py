"""Helpers shared by the corpus operators: tables, shared folders, slabs of text, components."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lean(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows and 16 MB from now on in this session, so that a worker holds little at once, however long texts or lists are."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id counts as held out: nothing is learned from it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have yet (names compare without case)."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a local one only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    ctx = spark.sparkContext._jsc.sc()
    if ctx.getCheckpointDir().isDefined():
        return ctx.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="wavelake-")
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Where paths are noted while a caller wants to know them.
NOTED: list[list[str]] = []


@contextlib.contextmanager
def noted() -> Iterator[list[str]]:
    """A list of the paths that scratch gives out meanwhile."""
    NOTED.append([])
    try:
        yield NOTED[-1]
    finally:
        NOTED.pop()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for x in NOTED:
        x.append(path)
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, read again: lineage ends there, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def slabs(texts: Iterable, most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of at most about `most` characters together (null: empty), so that the token lists stay small."""
    run: list[str] = []
    held = 0
    for x in texts:
        x = x or ""
        if run and held + len(x) > most:
            yield run
            run, held = [], 0
        run.append(x)
        held += len(x)
    if run:
        yield run


def parts(text: str, most: int = 1 << 20) -> Iterator[str]:
    """A text in order, cut before a space at about every `most` characters (a longer run without spaces stays whole)."""
    start = 0
    while len(text) - start > most:
        cut = text.find(" ", start + most)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


class Memo(dict):
    """A dict of at most `most` entries, kept by a worker across batches. Words come by frequency, so the first entries are the ones that recur; the rest are computed again."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def keep(self, key, value) -> None:
        if len(self) < self.most:
            self[key] = value


class Lists:
    """A list of numbers for each name. The first `most` names stay known across batches; others are computed for their batch only."""

    def __init__(self, most: int, dtype):
        self.most, self.known = most, {}
        self.pool, self.ends = np.zeros(0, dtype), np.zeros(1, np.int64)

    def joined(self, names: pa.Array, compute: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The lists of all names one after another, and where each ends (with a 0 before). compute gives the same for names not known."""
        coded = names.dictionary_encode()
        each = coded.dictionary.to_pylist()
        at = np.fromiter(map(self.known.get, each, repeat(-1)), np.int64, len(each))
        pool, ends, new = self.pool, self.ends, np.flatnonzero(at < 0)
        if len(new):
            values, cuts = compute([each[i] for i in new])
            at[new] = np.arange(len(ends) - 1, len(ends) - 1 + len(new))
            pool, ends = np.concatenate([pool, values]), np.concatenate([ends, cuts + len(pool)])
            keep = min(len(new), self.most - len(self.known))
            if keep > 0:  # frequent names come first
                self.known.update(zip([each[i] for i in new[:keep]], at[new[:keep]].tolist(), strict=True))
                self.ends = ends[: len(self.known) + 1].copy()
                self.pool = pool[: self.ends[-1]].copy()
        use = at[coded.indices.to_numpy()]
        begin, length = ends[use], ends[use + 1] - ends[use]
        total = np.append(0, np.cumsum(length))
        return pool[np.repeat(begin - total[:-1], length) + np.arange(total[-1])], total


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected link table (a, b), both long: rows (node, component), component the smallest id.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) as joins against each node's least
    neighbour: a hub costs a partial aggregate and a join that AQE may split, never one gathered list. The edge table
    is written to the shared folder after each round. Null ends and loops are ignored; an empty table gives no rows.
    """
    edges = (
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
        .distinct()
    )
    edges, at = written(edges, "edges")
    spark = edges.sparkSession

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = mark(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        # large star: every larger neighbour of u goes to u's least neighbour (or u itself)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt, path = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = mark(nxt)
        remove(spark, at)
        edges, at = nxt, path
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
