"""Language identification with segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of a public sentencepiece vocabulary. A word's probability is the sum
over all its segmentations into pieces, found by a forward pass; a text's is the product over its words. A word is a
run of letters (Unicode's category L), lower-cased, with the marker of a word's start before it; no piece is longer than
the marker's word, so words are independent and their results are kept by each worker. A run of any length is one word:
the forward pass carries its sums on over windows of WINDOW letters.

Training is one pass over all training texts: a forward-backward pass under equal piece probabilities gives every
piece's expected count in every word, and Spark sums them by language. Nothing is sampled; counts of a run of more than
WINDOW letters are taken window by window.

Defined results: a null text, an empty one or one without letters is `und` with score 0; with no training rows every
text is `und`. Rows with a null language are not learned from; equal texts get equal results; extra columns pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, parts, slabs

#: Runs of letters and of what regular expressions take for such besides: numbers that are no decimal digits, as fractions.
RUN = re.compile(r"[^\W\d_]+")
MARK = "▁"
WINDOW = 4096
#: Longer words are not kept by the workers.
KEEP_LETTERS = 64
KEEP_WORDS = 200_000
#: The multiplier of the runs' polynomial hash.
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Nats per UTF-8 byte of its letters below which even the best language explains a text no better than uniform bytes.
FLOOR = -float(np.log(256))


def vocabulary(path: str) -> tuple[list[str], int]:
    """The pieces (text pieces as they are, a byte piece as its byte's name) and the longest piece's length."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) else "" for i in range(sp.get_piece_size())]
    return pieces, max(map(len, pieces))


class Lattice:
    """All places of pieces in words, and the forward and backward sums over them."""

    def __init__(self, path: str):
        pieces, self.longest = vocabulary(path)
        self.size = len(pieces)
        self.ids = {p: i for i, p in enumerate(pieces) if p and not (p.startswith("<0x") and p.endswith(">"))}
        with np.errstate(over="ignore"):
            named = sorted((self.name(p), len(p), i) for p, i in self.ids.items())
        self.names, self.lengths, self.numbers = np.array([x[0] for x in named], np.uint64), np.array([x[1] for x in named]), np.array([x[2] for x in named])
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.names >> np.uint64(44)] = True
        self.bytes = np.full(256, -1)
        for i, p in enumerate(pieces):
            if re.fullmatch(r"<0x[0-9A-F]{2}>", p):
                self.bytes[int(p[3:5], 16)] = i

    @staticmethod
    def name(piece: str) -> int:
        out = 0
        for c in piece:
            out = (out * int(STEP) + ord(c) + 1) % (1 << 64)
        return out

    def places(self, words: list[str]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """For words of one length: (end, length, row numbers, piece ids); a character that is no piece has length 0 and is spelt in bytes.

        Runs of each length are numbered by a polynomial hash of their characters, and looked up in all words at once.
        """
        n = len(words[0])
        codes = np.array(words, f"<U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)
        run, out = np.zeros((len(words), n + 1), np.uint64), []
        with np.errstate(over="ignore"):
            for k in range(1, min(n, self.longest) + 1):
                run = run[:, : n - k + 1] * STEP + codes[:, k - 1 :] + np.uint64(1)
                start, rows = np.nonzero(self.sieve[run >> np.uint64(44)].T)
                name = run[rows, start]
                at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
                ok = (self.names[at] == name) & (self.lengths[at] == k)
                start, rows, ids = start[ok], rows[ok], self.numbers[at[ok]]
                cuts = np.searchsorted(start, np.arange(n - k + 2))
                for i in range(n - k + 1):
                    low, high = cuts[i], cuts[i + 1]
                    if high > low:
                        out.append((i + k, k, rows[low:high], ids[low:high]))
                    if k == 1 and high - low < len(words):
                        out.append((i + 1, 0, np.setdiff1d(np.arange(len(words)), rows[low:high]), None))
        out.sort(key=lambda x: (x[0], x[1]))
        return out

    def spelt(self, words: list[str], end: int, rows: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The probability, by language, of a character in bytes."""
        seen = {c: p[self.bytes[np.frombuffer(c.encode("utf-8", "surrogatepass"), np.uint8)]].prod(0) for c in {words[r][end - 1] for r in rows}}
        return np.array([seen[words[r][end - 1]] for r in rows])

    def forward(self, words: list[str], places: list, p: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Logarithms of the prefix sums [position, word, language]; `before` holds those of the first positions, where a window goes on."""
        n, done = len(words[0]), 0 if before is None else len(before) - 1
        by_end: dict[int, list] = {}
        for end, *place in places:
            by_end.setdefault(end, []).append(place)
        scale = np.zeros((n + 1, len(words), p.shape[1]))
        if before is not None:
            scale[: done + 1] = before
        for end in range(done + 1, n + 1):
            top = np.maximum.reduce(scale[max(0, end - self.longest) : end], axis=0)
            sums = np.zeros((len(words), p.shape[1]))
            for k, rows, ids in by_end.get(end, ()):
                back = end - max(k, 1)
                step = p[ids] if k else self.spelt(words, end, rows, p)
                sums[rows] += np.exp(scale[back, rows] - top[rows]) * step
            scale[end] = top + np.log(np.maximum(sums, 1e-300))
        return scale

    def likelihood(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log P(word) by language for words of any length."""
        out = np.zeros((len(words), p.shape[1]))
        for rows in grouped(words):
            same = [words[r] for r in rows]
            out[rows] = self.forward(same, self.places(same), p)[-1] if len(same[0]) <= WINDOW else [self.carried(w, p) for w in same]
        return out

    def carried(self, word: str, p: np.ndarray) -> np.ndarray:
        """log P(word) of a long word: each window begins with the last sums of the one before it."""
        before, low = np.zeros((1, 1, p.shape[1])), 0
        while True:
            window = [word[low : low + WINDOW]]
            scale = self.forward(window, self.places(window), p, before)
            if low + WINDOW >= len(word):
                return scale[-1, 0]
            low += WINDOW - self.longest
            before = scale[-self.longest - 1 :]

    def expected(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word number, piece id, expected count) under equal piece probabilities, over all segmentations."""
        p = np.full((self.size, 1), 1.0 / self.size)
        for rows in grouped(words):
            same = [words[r] for r in rows]
            places = self.places(same)
            n = len(same[0])
            alpha = self.forward(same, places, p)[:, :, 0]
            beta = np.full((n + 1, len(same)), -np.inf)
            beta[n] = 0
            for end, k, at, _ in reversed(places):  # ends come in order, so all that follow one are done
                back = end - max(k, 1)
                step = np.log(p[0, 0]) if k else np.log(self.spelt(same, end, at, p)[:, 0])
                beta[back, at] = np.logaddexp(beta[back, at], beta[end, at] + step)
            for e, k, at, ids in places:
                if k:
                    w = np.exp(alpha[e - k, at] + np.log(p[0, 0]) + beta[e, at] - alpha[n, at])
                    yield rows[at], ids, w
                else:
                    w = np.exp(alpha[e - 1, at] + np.log(self.spelt(same, e, at, p)[:, 0]) + beta[e, at] - alpha[n, at])
                    for r, x in zip(at, w, strict=True):
                        b = self.bytes[np.frombuffer(same[r][e - 1].encode("utf-8", "surrogatepass"), np.uint8)]
                        yield np.full(len(b), rows[r]), b, np.full(len(b), x)


def grouped(words: list[str], most: int = 4096) -> Iterator[np.ndarray]:
    """Numbers of words of one length, at most `most` at once."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for run in np.split(order, cuts):
        for i in range(0, len(run), most):
            yield run[i : i + most]


def words_of(text: str) -> list[str]:
    """Runs of letters (category L), in lower case."""
    out = []
    for part in parts(text):
        found = RUN.findall(part.lower())
        if not all(map(str.isalpha, found)):
            found = [w for run in found for w in ("".join(c if c.isalpha() else " " for c in run).split() if not run.isalpha() else (run,))]
        out += found
    return out


def fit(docs: DataFrame, vocab_path: str, text: str = "text", lang: str = "lang", smooth: float = 0.05, most_langs: int = 500) -> tuple[list[str], np.ndarray]:
    """(languages, log-free piece probabilities [piece, language]) from all rows of docs with a language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, seen = Lattice(vocab_path), {}
        total: dict[str, np.ndarray] = {}

        def flush() -> None:
            for one, tally in seen.items():
                keys, n = list(tally), np.fromiter(tally.values(), float, len(tally))
                sums = total.setdefault(one, np.zeros(lattice.size))
                for rows, ids, w in lattice.expected([MARK + x for x in keys]):
                    np.add.at(sums, ids, w * n[rows])
            seen.clear()

        for batch in batches:
            for one, x in zip(batch["lang"], batch["text"], strict=True):
                tally = seen.setdefault(one, Counter())
                found = words_of(x or "")
                if found and max(map(len, found)) > WINDOW:
                    found = [w[i : i + WINDOW] for w in found for i in range(0, len(w), WINDOW)]
                tally.update(found)
                if sum(map(len, seen.values())) > KEEP_WORDS:
                    flush()
        flush()
        for one, sums in total.items():
            at = np.flatnonzero(sums)
            yield pd.DataFrame({"lang": one, "piece": at, "n": sums[at]})

    rows = (
        docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
        .where("lang is not null and text is not null")
        .mapInPandas(count, "lang string, piece int, n double")
        .groupBy("lang", "piece")
        .agg(F.sum("n").alias("n"))
    )
    found = rows.toPandas()  # at most languages x vocabulary rows, whatever the corpus holds
    langs = sorted(found["lang"].unique())
    if len(langs) > most_langs:
        raise ValueError(f"{len(langs)} languages; a model holds {most_langs}")
    size = len(vocabulary(vocab_path)[0])
    counts = np.zeros((size, len(langs)))
    counts[found["piece"].to_numpy(np.int64), found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] = found["n"]
    counts += smooth
    return langs, counts / counts.sum(0)


def predict(text: Column, model: tuple[list[str], np.ndarray], vocab_path: str) -> Column:
    """A struct (lang_pred, score, nats_per_letter, nats_per_byte): the likeliest language, its posterior under equal priors, and its log-likelihood per letter and per UTF-8 byte of the letters."""
    langs, p = model

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lattice, known = Lattice(vocab_path), Memo(KEEP_WORDS)
        table = np.zeros((KEEP_WORDS, len(langs)))
        for batch in batches:
            pred, score, nats, by_byte = [], [], [], []
            for slab in slabs(batch):
                lists = [words_of(x) for x in slab]
                new = sorted((w for w in set().union(*lists) if w not in known), key=lambda w: len(w) > KEEP_LETTERS)
                base = len(known)
                fresh = lattice.likelihood([MARK + w for w in new], p) if new and langs else np.zeros((0, len(langs)))
                room = max(0, min(sum(len(w) <= KEEP_LETTERS for w in new), KEEP_WORDS - base)) if langs else 0
                for i, w in enumerate(new[:room]):
                    known[w] = base + i
                table[base : base + room] = fresh[:room]
                rest = {w: KEEP_WORDS + i for i, w in enumerate(new[room:])}
                values = np.concatenate([table, fresh[room:]]) if rest else table
                for words in lists:
                    if not words or not langs:
                        pred.append("und"), score.append(0.0), nats.append(None), by_byte.append(None)
                        continue
                    at = [known[w] if w in known else rest[w] for w in words] if rest else [known[w] for w in words]
                    total = values[at].sum(0)
                    best = int(total.argmax())
                    pred.append(langs[best])
                    score.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
                    nats.append(float(total[best] / sum(map(len, words))))
                    by_byte.append(float(total[best] / len("".join(words).encode("utf-8", "surrogatepass"))))
            yield pd.DataFrame({"lang_pred": pred, "score": score, "nats_per_letter": nats, "nats_per_byte": by_byte})

    return F.pandas_udf(run, "lang_pred string, score double, nats_per_letter double, nats_per_byte double")(text)


def accepted(prediction: Column) -> Column:
    """Texts with letters that the best language explains better than uniform bytes."""
    return (prediction["lang_pred"] != "und") & (prediction["nats_per_byte"] >= FLOOR)
