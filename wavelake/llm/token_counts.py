"""Token counts of whole texts by the whole-token shortcut.

Most pre-tokens of a text are strings of the vocabulary that encode alone as one token. Which strings do is proved
beforehand, once, with the library itself: every vocabulary string is encoded, and those that are one pre-token and come
back as their own id alone are kept (`prove`; at most one entry for each id of the vocabulary, so the table that tasks
carry is bounded by it). A text is then cut into pre-tokens, each known one counts as one token, and only the rest is
merged: a slab's different remaining pre-tokens go through the library together, and lengths of short ones are kept for
later batches (KEEP_PARTS at most).

Pre-tokens come from the pattern below by the `regex` module. It may know letters of a later Unicode version than the
library; texts with a character that Python's own older tables leave unassigned and `regex` takes for a letter or number
are encoded whole. Strings of added tokens are cut out first and count as one each, as the library has it.

The shortcut holds for byte-level vocabularies with their usual splitting (`.json` of the tokenizers library). For other
`.json` files and for `.model` files of sentencepiece whole texts go through the library.

Defined results: null and empty texts have 0 tokens; long texts are cut only where a pre-token begins, so memory is that
of a text and of about a million characters' pre-tokens; rows and other columns are left alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitpack import KEEP_PARTS, Encoder
from .common import slabs

#: Fixed value: how byte-level vocabularies of this kind split a text.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Here a pre-token begins whatever stands before.
SAFE = regex.compile(r" (?=\p{L})")
SLAB = 1 << 20
KEEP_LETTERS = 64


@dataclass(frozen=True)
class Proved:
    """What is known of a vocabulary before any text is read."""

    path: str
    whole: frozenset[str]
    newer: str  # a character class, in ascending order


def newer_letters() -> str:
    """The class of characters that `regex` takes for letters or numbers and Python's Unicode tables leave unassigned."""
    free = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    runs: list[list[int]] = []
    for c in map(ord, regex.findall(r"[\p{L}\p{N}]", free)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs or [[0x10FFFF, 0x10FFFF]]) + "]"


def prove(path: str) -> Proved | None:
    """The strings that encode alone as one token; None where the shortcut doesn't hold."""
    if not path.endswith(".json"):
        return None
    lib = Encoder(path)
    if not lib.by_part:
        return None
    ids = sorted(set(lib.lib.get_vocab(with_added_tokens=True).values()) - set(lib.added.values()))
    strings = lib.lib.decode_batch([[i] for i in ids])
    alone = zip(ids, strings, lib.whole(strings), strict=True)
    return Proved(path, frozenset(s for i, s, got in alone if len(got) == 1 and got[0] == i and PATTERN.findall(s) == [s]), newer_letters())


def pre_tokens(text: str) -> Iterator[list[str]]:
    """A text's pre-tokens in runs of about SLAB characters."""
    start = 0
    while len(text) - start > SLAB and (cut := SAFE.search(text, start + SLAB)):
        yield PATTERN.findall(text[start : cut.start()])
        start = cut.start()
    yield PATTERN.findall(text[start:] if start else text)


class Lengths(dict):
    """The number of tokens of each pre-token that is known; others are noted, and count 0 for now."""

    def __init__(self, proved: Proved):
        super().__init__(dict.fromkeys(proved.whole, 1))
        self.most = len(self) + KEEP_PARTS
        self.noted: list[str] = []

    def __missing__(self, part: str) -> int:
        self.noted.append(part)
        return 0


class TokenCounter:
    def __init__(self, proved: Proved):
        self.lib = Encoder(proved.path)
        self.known = Lengths(proved)
        self.newer = re.compile(proved.newer)
        self.late = re.compile(f"[{proved.newer[1]}-\U0010ffff]")  # most texts have no character this far on

    def count(self, texts: list[str]) -> list[int]:
        """The tokens of each text."""
        out, rest = [], []  # rest: the parts left to merge, and whose they are
        for text in texts:
            n = 0
            pieces = self.lib.special.split(text) if self.lib.special else [text]
            for at, piece in enumerate(pieces):
                if at % 2:  # an added token's string
                    n += 1
                elif not piece.isascii() and self.late.search(piece) and self.newer.search(piece):
                    n += len(self.lib.whole([piece])[0])
                else:
                    for run in pre_tokens(piece):
                        n += sum(map(self.known.__getitem__, run))
            rest += ((part, len(out)) for part in self.known.noted)
            self.known.noted.clear()
            out.append(n)
        new = list(dict.fromkeys(part for part, _ in rest))
        lengths = dict(zip(new, map(len, self.lib.whole(new)), strict=True))
        for part, owner in rest:
            out[owner] += lengths[part]
        room = self.known.most - len(self.known)
        self.known.update([(k, v) for k, v in lengths.items() if len(k) <= KEEP_LETTERS][: max(room, 0)])
        return out


def counter(path: str, proved: Proved | None):
    """A function from texts to their numbers of tokens."""
    if proved:
        return TokenCounter(proved).count
    if path.endswith(".model"):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: list(map(len, lib.encode(texts, num_threads=1)))
    lib = Encoder(path)
    return lambda texts: list(map(len, lib.whole(texts)))


def counts(text: Column, path: str) -> Column:
    """bigint: the number of tokens of each whole text, without begin, end or padding."""
    proved = prove(path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(path, proved)
        for batch in batches:
            yield pa.array([n for slab in slabs(batch.to_pylist(), SLAB) for n in count(slab)], pa.int64())

    return F.arrow_udf(run, "bigint")(text)


def measured(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit; columns of these names are replaced."""
    sized = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": counts(F.col(text), path)})
    return sized.withColumn("over_limit", F.col("n_tokens") > limit)
