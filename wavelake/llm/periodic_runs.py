"""Maximal periodic runs of words in whole texts.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) that is at least `least` words
and 2 q long and that no neighbouring word extends keeping q. All runs of a batch of documents come from

1. the suffix array of all its words by prefix doubling, where only suffixes that still tie are sorted again; documents
   are told apart in the first words' names, so no match leaves its document. The names of each round are kept: they
   answer longest common extensions of any two places, both ways, in a logarithm of steps for all asked pairs at once;
2. the LCP array. A run repeats at least half of `least` words, so documents whose LCP stays below have none;
3. the longest previous factor of each place: the longer match of its neighbours in suffix order that stand before it;
4. LZ blocks, a block being the longest previous factor at its start, or one word;
5. Main's extensions: a run that touches a block's boundary has a period of at most both blocks together, so for each
   boundary and period the matches to the left and right of the two places one period apart, before and after the
   boundary, give the run. Runs of one range count once, by their least period;
6. bucketed copying: runs strictly inside a block stand likewise in its earlier occurrence; starts are passed in order.

Every document is worked by the task that reads it, with no shuffle. Memory is that of a batch of BATCH_WORDS words, or
of the longest document: its words times the logarithm of its longest repeat.

Defined results: null and empty texts have no words and no runs; the order of rows is kept; other columns are left alone.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH_WORDS = 1 << 18
#: Pairs of a boundary and a period looked at together.
PAIRS = 1 << 21
LEAST = 12
SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Suffixes:
    """Suffix array and common extensions of words of documents that lie one after another."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """codes: a number for each word; starts, ends: those of each word's document."""
        n = len(codes)
        self.starts = starts
        keys = starts * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(keys, kind="stable")
        rank, again = self.grouped(keys[order], order, np.zeros(n, np.int64), np.full(n + 1, -1, np.int32))
        self.levels, step = [rank], 1
        while len(again):
            after = again + step
            base = rank[again].astype(np.int64)
            key = base * (n + 2) + np.where(after < ends[again], rank[np.minimum(after, n)] + 1, 0)
            order = np.argsort(key, kind="stable")
            rank, again = self.grouped(key[order], again[order], base[order], rank)
            self.levels.append(rank)
            step *= 2
        self.sa = np.empty(n, np.int64)
        self.sa[rank[:n]] = np.arange(n)

    @staticmethod
    def grouped(keys: np.ndarray, places: np.ndarray, base: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New ranks of places in order of their keys (a tie has its first's), within the groups that base tells apart; the places that tie."""
        n, at = len(keys), np.arange(len(keys))
        if not n:
            return rank, places
        new, whole = np.append(True, keys[1:] != keys[:-1]), np.append(True, base[1:] != base[:-1])
        first, group = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(whole, at, 0))
        rank = rank.copy()
        rank[places] = base + first - group
        tied = ~(new & np.append(new[1:], True))
        return rank, places[tied]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from places i on are those from j on (i < j)."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i, j, out = i + step, j + step, out + step
        return out

    def behind(self, i: np.ndarray, j: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How many words before places i are those before j (i < j), from start on."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            step = ((a >= start) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])).astype(np.int64) << k
            i, j, out = i - step, j - step, out + step
        return out

    def lcp(self) -> np.ndarray:
        """Of each place, the match with the one before it in suffix order."""
        out = np.zeros(len(self.sa), np.int64)
        near = np.flatnonzero(self.levels[0][self.sa[1:]] == self.levels[0][self.sa[:-1]]) + 1
        a, b = self.sa[near - 1], self.sa[near]
        out[b] = self.ahead(np.minimum(a, b), np.maximum(a, b))
        return out

    def previous(self, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all places, length and place of the longest previous factor; sa: the suffixes of whole documents that are asked."""
        values, stack = sa.tolist(), []
        up, down = [-1] * len(values), [-1] * len(values)
        for r, p in enumerate(values):
            while stack and values[stack[-1]] > p:
                down[stack.pop()] = p
            if stack:
                up[r] = values[stack[-1]]
            stack.append(r)
        length, source = np.zeros(len(self.sa), np.int64), np.full(len(self.sa), -1, np.int64)
        for near in (np.array(up, np.int64), np.array(down, np.int64)):
            has = np.flatnonzero(near >= 0)
            has = has[self.levels[0][near[has]] == self.levels[0][sa[has]]]
            a, b = near[has], sa[has]
            found = self.ahead(a, b)
            more = found > length[b]
            length[b[more]], source[b[more]] = found[more], a[more]
        return length, source


def blocks_of(length: list[int], start: int, end: int) -> list[int]:
    """The starts of a document's LZ blocks, and its end."""
    out = [start]
    while out[-1] < end:
        out.append(out[-1] + (length[out[-1]] or 1))
    return out


def touching(s: Suffixes, bounds: list[list[int]], least: int) -> np.ndarray:
    """Rows (start, end, period) of the runs that touch a boundary of their document's blocks."""
    at = np.concatenate([np.array(b[1:], np.int64) for b in bounds])
    periods = np.concatenate([np.diff(b) + np.append(np.diff(b)[1:], 0) for b in bounds])
    low = np.concatenate([np.full(len(b) - 1, b[0], np.int64) for b in bounds])
    high = np.concatenate([np.full(len(b) - 1, b[-1], np.int64) for b in bounds])
    level = min(max(0, (least // 4).bit_length() - 1), len(s.levels) - 1)  # one side has half of all words that match
    names, span, out = s.levels[level], 1 << level, [np.zeros((0, 3), np.int64)]
    for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(periods) // PAIRS)) + 1):
        pick = np.repeat(some, periods[some])
        ends = np.cumsum(periods[some])
        period = np.arange(len(pick)) - np.repeat(ends - periods[some], periods[some]) + 1
        for i, inside in ((at[pick] - period, at[pick] - period >= low[pick]), (at[pick], at[pick] + period < high[pick])):
            i, p, start = i[inside], period[inside], low[pick][inside]
            left = i - span
            near = (names[i] == names[i + p]) | ((left >= start) & (names[np.maximum(left, 0)] == names[np.maximum(left, 0) + p]))
            i, p, start = i[near], p[near], start[near]
            begin, end = i - s.behind(i, i + p, start), i + p + s.ahead(i, i + p)
            long = end - begin >= np.maximum(least, 2 * p)
            out.append(np.stack([begin[long], end[long], p[long]], 1))
    rows = np.concatenate(out)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))[: len(rows)]]


def with_copies(runs: list[tuple[int, int, int]], bounds: list[int], length: list[int], source: list[int], least: int) -> list[tuple[int, int, int]]:
    """All runs of a document: those that touch a boundary, and those inside blocks, copied from where the block stood before."""
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for begin, end, p in runs:
        buckets[begin].append((end, p))
    order = sorted(buckets)
    for b, e in zip(bounds[:-1], bounds[1:], strict=True):
        if e - b < least + 2 or not length[b]:
            continue
        shift = b - source[b]
        at = bisect_right(order, source[b])
        while at < len(order) and order[at] + shift < e:
            begin = order[at] + shift
            inside = [(end + shift, p) for end, p in buckets[order[at]] if end + shift < e]
            if inside:
                if begin not in buckets:
                    insort(order, begin)
                buckets[begin] += inside
            at += 1
    return sorted((begin, end, p) for begin, ends in buckets.items() for end, p in ends)


def runs_of(documents: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each document, by start, then period."""
    if least < 2:
        raise ValueError("a run has at least two words")
    sizes = np.array(list(map(len, documents)), np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    numbers = defaultdict(count().__next__)
    codes = np.fromiter((c for d in documents for c in map(numbers.__getitem__, d)), np.int64, int(sizes.sum()))
    if not len(codes):
        return out
    owner = np.repeat(np.arange(len(documents)), sizes)
    s = Suffixes(codes, starts[owner], ends[owner])
    repeats = np.zeros(len(documents), np.int64)
    np.maximum.at(repeats, owner, s.lcp())
    some = np.flatnonzero(repeats >= (least + 1) // 2)
    if not len(some):
        return out
    asked = np.zeros(len(documents), bool)
    asked[some] = True
    longest, where = s.previous(s.sa[asked[owner[s.sa]]])
    length, source = longest.tolist(), where.tolist()
    bounds = [blocks_of(length, int(starts[d]), int(ends[d])) for d in some]
    rows = touching(s, bounds, least)
    cuts = np.searchsorted(rows[:, 0], np.append(starts[some], len(codes)))
    for d, b, i, j in zip(some.tolist(), bounds, cuts[:-1], cuts[1:], strict=True):
        if j > i:
            found = with_copies([tuple(x) for x in rows[i:j].tolist()], b, length, source, least)
            out[d] = sorted((begin - b[0], end - begin, p) for begin, end, p in found)
            out[d].sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, one space between, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def batches_of(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """The words of texts (ASCII white space parts them), in runs of about BATCH_WORDS words."""
    run, held = [], 0
    for x in texts:
        words = (x or "").encode().split()
        if run and held + len(words) > BATCH_WORDS:
            yield run
            run, held = [], 0
        run.append(words)
        held += len(words)
    if run:
        yield run


def analysed(text: Column, least: int = LEAST) -> Column:
    """A struct of each whole text: n_words, runs, and the text with repetitions collapsed."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes, cells, texts = [], [], []
            for documents in batches_of(batch.to_pylist()):
                for words, runs in zip(documents, runs_of(documents, least), strict=True):
                    sizes.append(len(words))
                    cells.append(runs)
                    texts.append(collapsed(words, runs).decode())
            flat = [r for runs in cells for r in runs]
            parts = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cells)]), pa.int32()), pa.StructArray.from_arrays(parts, names=["start", "length", "period"]))
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), lists, pa.array(texts, pa.string())], names=["n_words", "runs", "collapsed"])

    return F.arrow_udf(run, SCHEMA)(text)
