"""Similarity join on word shingles (Jaccard) by chosen paths.

Texts become sets of five-word shingles; texts of one set are a class, so copies cost nothing further. A class keeps a
sketch of 64 minima of its set (each the shingle that one random order samples first). From the root of each run, a
class follows every sampled token (i, minimum i) whose hash under the node's own function falls below 1 / (t * 64);
classes that share a chosen token meet in a child node (Christiani and Pagh, 2017; Christiani et al., 2018). Nodes of
at most `small` classes are compared in full. In a larger node every class is compared with one of them, drawn by a hash:
those nearly equal to it leave, as whatever resembles them resembles it too; the others follow tokens again, each with
1.25 times the chance. A pair that shares t * 64 minima is brought together by a run with a probability of 0.63 in a small
root node, and 0.51, 0.45, 0.41, 0.38 in nodes one to four levels below (never less than 0.31): ten runs find it with
0.99 or more down to the fourth level. Classes less alike than 1 / (1.25 * 1.25) lose more children than they have, so
the levels of a large cluster of such shrink.

What is far from the drawn class (`loose` below what could be alike to a class that is linked to it) goes on apart from
what is linked to it, and classes between go on with both. Linked classes are one group from then on, and nodes whose
classes are all of one group are passed over: so a large group of copies is left as soon as nothing that may still join
it is about. A larger node of one group and at most `small` classes beside it ends there: those are compared with all of
the group, which is dealt out in parts of about `small`, each with all of them. Links inside a group are not given
again. One run of little depth goes before the others, whose groups hold for them. A class that is within
1 - `same` of a class that stays is left out of later runs altogether; its links are those of its representative, found
at the looser similarity.

What the walk gives are candidates for grouping, at a looser similarity. Then all pairs inside each group of candidates
are compared exactly, in blocks of classes, so that a group of any size is spread over tasks, and each block gives
numbers of links and a spanning forest, never its pairs. Links below the threshold are thus never reported, and one is
missed only if no run brings its two classes into one group. A node still large after `depth` levels is one group.

Defined results: words are lower-cased runs without white space; a text of fewer than five words is one shingle; a null
text or one without words links with nothing; a null id keeps its row (no links, null class); repeated rows count as
copies. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, remove, written
from .shingles import GOLD, kmers, mix, word_hashes

#: White space as Java's \\s has it, so that both sides agree on which texts have words.
BLANK = " \t\n\x0b\f\r"
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
SIZE = 64
SALTS = mix(np.arange(1, SIZE + 1, dtype=np.uint64) * GOLD) | np.uint64(1)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(kmers(word_hashes(SPACE.split((text or "").lower().strip(BLANK)) if (text or "").strip(BLANK) else []), k))


def set_name(items: np.ndarray) -> bytes:
    """A name that equal sets share."""
    with np.errstate(over="ignore"):
        return np.array([items.sum(), mix(items ^ GOLD).sum(), len(items)], np.uint64).tobytes()


def sketch(items: np.ndarray) -> np.ndarray:
    """The high halves of 64 minima, each under its own multiplier."""
    out = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(items), 2048):
            some = items[i : i + 2048]
            hashed = SALTS[:, None] * some
            hashed ^= some >> np.uint64(29)
            np.minimum(out, hashed.min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def planes(minima: np.ndarray) -> bytes:
    """A sketch's lowest bytes, then the next ones and so on: its first 64 bytes alone will do for a comparison."""
    return minima.view(np.uint8).reshape(SIZE, 4).T.tobytes()


def sketches(column) -> np.ndarray:
    flat = np.frombuffer(b"".join(column), np.uint8).reshape(-1, 4, SIZE)
    return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(np.uint32).reshape(-1, SIZE)


def briefs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, SIZE)


def children(paths: np.ndarray, tokens: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) for every token that the row's node chooses."""
    with np.errstate(over="ignore"):
        named = mix(tokens.astype(np.uint64) + np.arange(SIZE, dtype=np.uint64)[None, :] * GOLD)
        keys = mix(named ^ paths[:, None])
    rows, cols = np.nonzero(keys < np.uint64(int(rate * 2**64)))
    return rows, mix(keys[rows, cols]).view(np.int64)


def runs_for(recall: float, once: float = 0.38) -> int:
    """Runs until a pair at the threshold, met in one run with probability `once` or more, is met with probability `recall`."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def candidates(classes: DataFrame, threshold: float, recall: float, small: int = 512, depth: int = 12, step: float = 1.25, loose: float = 0.2, near: float = 0.9, same: float = 0.95) -> DataFrame:
    """(node, component): classes, given as (cls, sketch), that may be similar to others, by group."""
    rate, total, limit = 1 / (threshold * SIZE), runs_for(recall), threshold - loose
    far = limit - (1 - threshold) - 0.05
    used: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        used.append(path)
        return out

    def roots(batches: Iterator[pd.DataFrame], runs: range) -> Iterator[pd.DataFrame]:
        starts = mix(np.array(runs, np.uint64))
        for batch in batches:
            tokens, cls, grp = sketches(batch["sketch"]), batch["cls"].to_numpy(np.int64), batch["grp"].to_numpy(np.int64)
            for s in starts:
                rows, path = children(np.full(len(cls), s), tokens, rate)
                yield pd.DataFrame({"path": path, "cls": cls[rows], "grp": grp[rows]})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links to a node's drawn class (b is set), and the children of those that go on."""
        for batch in batches:
            own, first = sketches(batch["sketch"]), sketches(batch["first_sketch"])
            grp, cls, lead, path = batch["grp"].to_numpy(np.int64), batch["cls"].to_numpy(np.int64), batch["first"].to_numpy(np.int64), batch["path"].to_numpy(np.int64).view(np.uint64)
            alike = (own == first).mean(1)
            at = np.flatnonzero((alike >= limit) & (grp != batch["first_grp"].to_numpy(np.int64)))
            yield pd.DataFrame({"path": 0, "cls": cls[at], "grp": 0, "b": pd.array(lead[at], "Int64"), "same": alike[at] >= same})
            joined = np.where(alike >= limit, batch["first_grp"].to_numpy(np.int64), grp)
            # a class alike to a linked one is within 1 - threshold of it; the margin is a sketch's error
            for side, go in enumerate((np.flatnonzero((alike < near) & (alike >= far)), np.flatnonzero(alike < limit)), 1):
                rows, child = children(mix(path[go] + np.uint64(side)), own[go], step * rate)
                yield pd.DataFrame({"path": child, "cls": cls[go][rows], "grp": joined[go][rows], "b": pd.array([None] * len(rows), "Int64"), "same": False})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted by path: each class with those after it in its node; a node cut by a batch's end waits for the next."""
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            path = batch["path"].to_numpy(np.int64)
            keep = int(np.searchsorted(path, path[-1], "left")) if len(path) else 0
            rest = batch.iloc[keep:]
            yield pairs(batch.iloc[:keep])
        if rest is not None:
            yield pairs(rest)

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        """A forest of each node's similar pairs that joins its groups, and each class's first nearly equal one that isn't of its group: at most two links a row."""
        n = len(rows)
        if n < 2:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "same": np.zeros(0, bool)})
        path, cls, grp, tokens = rows["path"].to_numpy(np.int64), rows["cls"].to_numpy(np.int64), rows["grp"].to_numpy(np.int64), briefs(rows["brief"])
        order = np.lexsort((grp, path))
        new = np.append(True, (np.diff(path[order]) != 0) | (np.diff(grp[order]) != 0))
        head = np.empty(n, np.int64)  # the first row of the same group in the node
        head[order] = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
        left, right, lead = [np.arange(n)], [head], np.arange(n)
        for d in range(1, n):
            at = np.flatnonzero(path[:-d] == path[d:])
            if not len(at):
                break
            alike = (tokens[at] == tokens[at + d]).mean(1)
            hit = at[alike >= limit]
            left.append(hit)
            right.append(hit + d)
            equal = at[(alike >= same) & (grp[at] != grp[at + d])]
            lead[equal + d] = equal  # rows of a node are sorted by class, so the farthest is the least
        i, j, root = np.concatenate(left), np.concatenate(right), np.arange(n)
        while True:
            new = root.copy()
            np.minimum.at(new, i, root[j])
            np.minimum.at(new, j, root[i])
            new = new[new]
            if (new == root).all():
                break
            root = new
        tied, equal = np.flatnonzero((root != np.arange(n)) & (head == np.arange(n))), np.flatnonzero(lead != np.arange(n))
        return pd.DataFrame({"a": np.concatenate([cls[tied], cls[equal]]), "b": np.concatenate([cls[root[tied]], cls[lead[equal]]]), "same": np.arange(len(tied) + len(equal)) >= len(tied)})

    def dealt(rows: DataFrame) -> DataFrame:
        """Nodes of one group and few classes beside it, as nodes of about `small` classes of the group and all of the others."""
        own = F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int")
        part = F.explode(F.when(F.col("grp") == F.col("top"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("nb") - 1)))
        return rows.select(F.col("path").alias("node"), "cls", "grp", part.alias("part")).select(F.xxhash64("node", "part").alias("path"), "cls", "grp")

    def met(active: DataFrame, runs: range, depth: int, whole: bool) -> list[DataFrame]:
        """The links (a, b, same) of some runs; whole: nodes that are still large in the end are linked too."""
        out, level = [], active.select("cls", "sketch", "grp").mapInPandas(lambda x: roots(x, runs), "path long, cls long, grp long")
        for _ in range(depth):
            rows = kept(level, "paths")
            nodes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("grp").alias("g0"), F.max("grp").alias("g1")).where("g0 <> g1").drop("g0", "g1")
            shared = kept(rows.join(nodes, "path"), "nodes")
            few, many = shared.where(F.col("n") <= small).select("path", "cls", "grp"), shared.where(F.col("n") > small).select("path", "cls", "grp")
            rest = not many.isEmpty()
            if rest:
                most = many.groupBy("path", "grp").agg(F.count(F.lit(1)).alias("m")).groupBy("path").agg(F.sum("m").alias("n"), F.max_by("grp", "m").alias("top"), F.max("m").alias("m"))
                most = most.where(F.col("n") - F.col("m") <= small).select("path", "top", F.ceil(F.col("m") / small).cast("int").alias("nb"))
                marked = kept(many.join(most, "path", "left"), "marked")
                few, many = few.unionByName(dealt(marked.where("nb is not null"))), marked.where("nb is null").select("path", "cls", "grp")
            few = few.join(active.select("cls", F.substring("sketch", 1, SIZE).alias("brief")), "cls")
            # the sort follows the exchange, so the nodes of a partition come one after another; none has more than about twice `small` rows
            out.append(kept(few.repartition("path").sortWithinPartitions("path", "cls").mapInPandas(compare, "a long, b long, same boolean"), "links"))
            if not rest or many.isEmpty():
                return out
            large = kept(many.join(active.select("cls", "sketch"), "cls").select("path", "cls", "grp", "sketch"), "large")
            lead = large.groupBy("path").agg(F.min_by(F.struct(F.col("cls").alias("first"), F.col("grp").alias("first_grp"), F.col("sketch").alias("first_sketch")), F.xxhash64("path", "cls")).alias("l")).select("path", "l.*")
            both = large.join(lead, "path").select("path", "cls", "grp", "first", "first_grp", "sketch", "first_sketch")
            walked = kept(both.mapInPandas(walk, "path long, cls long, grp long, b long, same boolean"), "walked")
            out.append(walked.where("b is not null").select(F.col("cls").alias("a"), "b", "same"))
            level = walked.where("b is null").select("path", "cls", "grp")
        if whole:
            heads = level.groupBy("path").agg(F.min("cls").alias("b"))
            out.append(level.join(heads, "path").select(F.col("cls").alias("a"), "b", F.lit(False).alias("same")))
        return out

    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for x in tables[1:]:
            out = out.unionByName(x)
        return out

    active, links = classes.select("cls", "sketch", F.col("cls").alias("grp")), None
    for runs, deep in ((range(1, 2), 2), (range(2, total + 2), depth)):
        begun = len(used)
        found = union(met(active, runs, deep, deep == depth)).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "same").distinct()
        links = written(found if links is None else found.unionByName(links), "candidates")[0]
        groups = written(components(links), "groups")[0]
        for path in used[begun:]:
            remove(classes.sparkSession, path)
        if deep < depth:
            # a class leaves for one that has itself none to leave for
            equal = links.where("same").select("a", "b")
            gone = equal.join(equal.select(F.col("a").alias("b")).distinct(), "b", "left_anti").select(F.col("a").alias("cls")).distinct()
            active = active.select("cls", "sketch").join(gone, "cls", "left_anti").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
            active = written(active.select("cls", "sketch", F.coalesce("component", "cls").alias("grp")), "active")[0]
    return groups


def intersections(left: list[np.ndarray], right: list[np.ndarray], most: int = 4096) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, as products of 0-1 matrices over `most` shared items at a time."""
    sizes_l, sizes_r = [len(x) for x in left], [len(x) for x in right]
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(flat_l, flat_r)
    out = np.zeros((len(left), len(right)), np.float32)

    def places(flat: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, flat)
        ok = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == flat) if len(shared) else np.zeros(len(flat), bool)
        return np.repeat(np.arange(len(sizes)), sizes)[ok], at[ok]

    (rl, cl), (rr, cr) = places(flat_l, sizes_l), places(flat_r, sizes_r)
    ol, orr = np.argsort(cl, kind="stable"), np.argsort(cr, kind="stable")
    rl, cl, rr, cr = rl[ol], cl[ol], rr[orr], cr[orr]
    for low in range(0, len(shared), most):
        a, b = np.zeros((len(left), most), np.float32), np.zeros((len(right), most), np.float32)
        i, j = np.searchsorted(cl, [low, low + most])
        a[rl[i:j], cl[i:j] - low] = 1
        i, j = np.searchsorted(cr, [low, low + most])
        b[rr[i:j], cr[i:j] - low] = 1
        out += a @ b.T
    return out


def exact(groups: DataFrame, threshold: float) -> DataFrame:
    """From (grp, cls, weight, nb, items): (id, links, root): a class's linked weight in one pair of blocks, and its tree's root there."""
    rows = groups.withColumn("b", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    spread = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "grp", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "b", "cls", "weight", "items"
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("cls")
        bi, bj = pdf["bi"].iloc[0], pdf["bj"].iloc[0]
        cls, weight, items = pdf["cls"].to_numpy(np.int64), pdf["weight"].to_numpy(np.int64), [np.frombuffer(x, np.uint64) for x in pdf["items"]]
        l, r = np.flatnonzero(pdf["b"] == bi), np.flatnonzero(pdf["b"] == bj)
        if not len(l) or not len(r):
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        n = np.array([len(x) for x in items])
        both = intersections([items[i] for i in l], [items[i] for i in r]).astype(np.float64)
        union = n[l][:, None] + n[r][None, :] - both
        near = (both >= threshold * union - 1e-9) & (cls[l][:, None] != cls[r][None, :])
        top = np.iinfo(np.int64).max
        a, b = cls[l].copy(), cls[r].copy()
        while near.any():
            na = np.minimum(a, np.where(near, b[None, :], top).min(1))
            nb = np.minimum(b, np.where(near, na[:, None], top).min(0))
            if (na == a).all() and (nb == b).all():
                break
            a, b = na, nb
        out = [pd.DataFrame({"id": cls[l], "links": near @ weight[r], "root": a})]
        if bi != bj:
            out.append(pd.DataFrame({"id": cls[r], "links": near.T @ weight[l], "root": b}))
        out = pd.concat(out)
        return out[(out["links"] > 0) | (out["root"] != out["id"])]

    return spread.groupBy("grp", "bi", "bj").applyInPandas(run, "id long, links long, root long")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, threshold: float = 0.8, recall: float = 0.99, block: int = 256, block_items: int = 1 << 19) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest id reachable by links), n_links (other rows linked directly), text_hash, and group_key, which rows reachable from each other share."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("t"))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, x, t in zip(batch["id"], batch["text"], batch["t"], strict=True):
                items = shingle_set(x, k)
                if len(items):
                    out.append((i, t, set_name(items), planes(sketch(items)), len(items)))
            yield pd.DataFrame(out, columns=["id", "t", "name", "sketch", "n"])

    marks, _ = written(rows.where("id is not null and text is not null").mapInPandas(mark, "id long, t long, name binary, sketch binary, n long").withColumn("cls", F.xxhash64("name")).drop("name"), "marks")
    classes, _ = written(marks.groupBy("cls").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("sketch").alias("sketch"), F.first("n").alias("n")), "classes")
    groups = candidates(classes, threshold, recall).select(F.col("node").alias("cls"), F.col("component").alias("grp"))
    # blocks hold at most about `block` classes and `block_items` shingles
    sets = groups.join(classes.select("cls", "id", "weight", "n"), "cls")
    blocks = sets.groupBy("grp").agg(F.greatest(F.floor(F.count(F.lit(1)) / block) + 1, F.floor(F.sum("n") / block_items) + 1).cast("int").alias("nb"))
    sets = sets.join(blocks, "grp").drop("n")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            items = [shingle_set(x, k) for x in batch["text"]]
            yield pd.DataFrame({"grp": batch["grp"], "cls": batch["cls"], "weight": batch["weight"], "nb": batch["nb"], "name": [set_name(x) for x in items], "items": [x.tobytes() for x in items]})

    full = rows.drop("t").join(sets, "id").select("grp", "cls", "weight", "nb", "text").mapInPandas(load, "grp long, cls long, weight long, nb int, name binary, items binary")
    full = full.where(F.xxhash64("name") == F.col("cls")).drop("name")  # an id may stand on rows of several texts
    found, _ = written(exact(full, threshold), "links")
    reach = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    per = (
        classes.select("cls", "id", "weight")
        .join(found.groupBy(F.col("id").alias("cls")).agg(F.sum("links").alias("links")), "cls", "left")
        .join(reach, "cls", "left")
        .withColumn("component", F.coalesce("component", "cls"))
    )
    least = per.groupBy("component").agg(F.min("id").alias("class_id"))
    per = per.join(least, "component").select("cls", "component", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = marks.select("id", "t", "cls").join(per, "cls").select(F.col("id").alias(doc_id), "class_id", "n_links", F.col("t").alias("text_hash"), F.col("component").alias("group_key"))
    silent = rows.where(~F.coalesce(F.col("id").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"\S"), F.lit(False)))
    return linked.unionByName(silent.select(F.col("id").alias(doc_id), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("t").alias("text_hash"), F.lit(None).cast("long").alias("group_key")))
