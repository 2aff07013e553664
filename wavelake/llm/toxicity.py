"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all training texts, labels ignored, is the unlabelled set. A
linear classifier over the presence of words minimises the risk pi*E_P[l(f)] + max(0, E_U[l(-f)] - pi*E_P[l(-f)])
(Kiryo et al., 2017) with the logistic loss; where the negative part falls below zero its gradient step is reversed,
as in that paper. The prior pi is the share of toxic rows among the labelled training rows.

The fit reads a sample of at most about `most_positive` and `most_unlabelled` rows, picked by a hash of the id at a
rate set from counts, so its size is bounded whatever the corpus holds; scoring covers every row and every word.

Defined results: null and empty texts score the classifier's value for no words; with no positive training row every
score is 0; equal texts get equal scores; ties in ids only change which rows are sampled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text, and the beginnings of the longer ones (`lostr*`), which inflected forms share."""
    out: set[str] = set()
    for part in parts(text or ""):
        out.update(WORD.findall(part.lower()))
    return out.union(*({w[:n] + "*" for w in out if len(w) > n} for n in (4, 5, 6)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Bags:
    """Word sets as flat arrays of word numbers."""

    def __init__(self, sets: list[list[int]]):
        self.n = len(sets)
        self.flat = np.fromiter((w for s in sets for w in s), np.int64, sum(map(len, sets)))
        self.row = np.repeat(np.arange(self.n), [len(s) for s in sets])

    def margin(self, w: np.ndarray, b: float) -> np.ndarray:
        return b + np.bincount(self.row, w[self.flat], self.n)

    def pull(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.flat, g[self.row], size)


def risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk under the logistic loss: that of positives, and what is left of the unlabelled ones as negatives, which counts from 0 on."""
    return prior * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()


def slopes(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The risk's derivatives by the margins of positives and unlabelled; where the second part is below 0, minus that part's alone."""
    gn_p, gn_u = -prior * sigmoid(fp) / len(fp), sigmoid(fu) / len(fu)
    if risk(fp, fu, prior)[1] >= 0:
        return -prior * sigmoid(-fp) / len(fp) + gn_p, gn_u
    return -gn_p, -gn_u


def train(positive: Bags, unlabelled: Bags, size: int, prior: float, steps: int = 140, rate: float = 0.25, sparse: float = 0.25) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative risk, with a proximal L1 step.

    The L1 weight is `sparse` standard errors of a word's rate among the positives, times the prior: words that differ
    by less than chance keep weight 0, so long texts don't gather noise.
    """
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    shrink = sparse * prior / np.sqrt(positive.n)
    for t in range(1, steps + 1):
        fp, fu = positive.margin(w, b), unlabelled.margin(w, b)
        gp, gu = slopes(fp, fu, prior)
        g = np.append(positive.pull(gp, size) + unlabelled.pull(gu, size), gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        pace = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        step = pace * (m / (1 - 0.9**t))
        w, b = w - step[:-1], b - step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - pace[:-1] * shrink, 0)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most_positive: int = 3000, most_unlabelled: int = 9000, least_df: int = 4) -> dict | None:
    """Weights by word, and the bias under None, from training rows only (the caller has dropped the held-out ones); None without positives."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    all_known, toxic = known.agg(F.count(F.lit(1)), F.sum(F.col("toxic").cast("long"))).first()
    if not toxic:
        return None
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    total = ids.select("doc_id").count()
    pick = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    positives = ids.join(known.where("toxic = 1").where(pick < most_positive / toxic), "doc_id", "left_semi").select("text", F.lit(1).alias("p"))
    sample = ids.where(pick < most_unlabelled / max(total, 1)).select("text", F.lit(0).alias("p"))

    def bag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"words": [sorted(words_of(x)) for x in batch["text"]], "p": batch["p"]})

    rows = positives.unionByName(sample).mapInPandas(bag, "words array<string>, p int")
    names: dict[str, int] = {}
    sets: tuple[list, list] = ([], [])
    for row in rows.toLocalIterator():  # a partition of the bounded sample at a time
        sets[row["p"]].append(np.fromiter((names.setdefault(w, len(names)) for w in row["words"]), np.int32, len(row["words"])))
    if not sets[1] or not sets[0]:
        return None
    df = np.bincount(np.concatenate(sets[0] + sets[1]), minlength=len(names)) if names else np.zeros(0)
    kept = np.flatnonzero(df >= least_df)
    number = np.full(len(names), -1)
    number[kept] = np.arange(len(kept))
    bags = [Bags([number[s][number[s] >= 0] for s in part]) for part in sets]
    w, b = train(bags[1], bags[0], len(kept), toxic / all_known)
    words = np.array(list(names), dtype=object)[kept] if names else []
    return {None: float(b), **{x: float(y) for x, y in zip(words, w, strict=True) if abs(y) > 1e-6}}


def score(text: Column, model: dict | None) -> Column:
    """The probability of toxicity of each whole text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = {k: v for k, v in (model or {}).items() if k is not None}
        bias = model[None] if model else None
        for batch in batches:
            out = np.zeros(len(batch))
            if model:
                known = weights.keys()
                for i, x in enumerate(batch):
                    out[i] = bias + sum(map(weights.__getitem__, words_of(x) & known))
                out = sigmoid(out)
            yield pd.Series(out)

    return F.pandas_udf(run, "double")(text)
