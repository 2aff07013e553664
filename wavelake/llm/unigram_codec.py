"""Encoding with a public sentencepiece vocabulary by unigram Viterbi over a double-array trie, and decoding.

Pieces lie as UTF-8 in a double-array trie (arrays base, check, value). A text's spaces become the marker `▁`, one more
stands before the text, and the best segmentation maximises the sum of the pieces' log scores; characters no piece
covers are spelt in byte pieces. Decoding joins pieces and bytes, turns markers into spaces and drops the first. A
marker that no piece covers is the byte piece of a space, a literal `▁` is spelt in bytes: every text comes back as it was.

The public file's stored scores are merge ranks, not logarithms; `log_scores` therefore takes -log(rank + 10), and a
true unigram file's scores as they are. No usable piece has a marker but at its start, so a text falls apart at markers
into units with no piece across them: Viterbi on each unit is Viterbi on the text. A batch's different units, but for
long ones, go through the trie and through Viterbi together, a byte position at a time; workers keep units they know.

Defined results: a null or empty text has no ids and decodes to an empty text; ties take the longest last piece; equal
texts get equal ids; every other column passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import Lists

MARK = "▁"
KEEP_UNITS = 300_000
#: Units of more bytes go through Viterbi alone.
LONG = 256
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def load(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces by id, and their log scores (minus infinity: not for encoding; byte pieces too)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    raw = np.array([sp.get_score(i) for i in range(n)])
    usable = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)) and MARK not in pieces[i][1:] and raw[i] > -1e8 for i in range(n)])
    # multiples of 2^-20 add up exactly, so equal paths have equal scores in whatever order they are summed
    return pieces, np.where(usable, np.round(log_scores(raw) * (1 << 20)) / (1 << 20), -np.inf)


def log_scores(raw: np.ndarray) -> np.ndarray:
    """Stored scores of unigram files; of BPE files, whose scores are minus the merge's rank, -log(rank + 10)."""
    real = raw[raw > -1e8]
    if len(real) and real.min() < -1000 and np.all(real == np.round(real)):
        return -np.log(np.maximum(-raw, 0) + 10)
    return raw


class DoubleArray:
    """A trie over bytes: from state s, byte c leads to t = base[s] + c + 1 if check[t] = s; value[t] is a piece's id or -1."""

    def __init__(self, base: np.ndarray, check: np.ndarray, value: np.ndarray):
        self.base, self.check, self.value = base, check, value

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        used, base, check, value = bytearray(1 << 20), [0] * (1 << 20), [-1] * (1 << 20), [-1] * (1 << 20)
        used[0] = 1
        names = sorted(keys)
        start = 1
        todo = [(0, 0, len(names), 0)]
        while todo:
            state, low, high, depth = todo.pop()
            if len(names[low]) == depth:
                value[state] = keys[names[low]]
                low += 1
            if low == high:
                continue
            cells, starts = [], []
            for i in range(low, high):
                if not cells or names[i][depth] + 1 != cells[-1]:
                    cells.append(names[i][depth] + 1)
                    starts.append(i)
            pos, tried = used.find(0, start + cells[0]), 0
            while True:
                at = pos - cells[0]
                if pos + 520 > len(used):
                    used, base, check, value = used + bytearray(len(used)), base + [0] * len(base), check + [-1] * len(check), value + [-1] * len(value)
                if not any(used[at + c] for c in cells):
                    break
                pos, tried = used.find(0, pos + 1), tried + 1
            if tried > 200:  # the front is nearly full
                start = max(start, at - 1000)
            base[state] = at
            for c, i, j in zip(cells, starts, [*starts[1:], high], strict=True):
                used[at + c] = 1
                check[at + c] = state
                todo.append((at + c, i, j, depth + 1))
        last = used.rfind(1) + 261
        return cls(*(np.array(x[:last], np.int32) for x in (base, check, value)))


class Codec:
    """Viterbi encoding of units and decoding of ids."""

    def __init__(self, pieces: list[str], scores: np.ndarray, trie: DoubleArray):
        self.pieces, self.known, self.trie, self.weights = pieces, Lists(KEEP_UNITS, np.int32), trie, scores
        self.pairs = {p[i : i + 2] for p, x in zip(pieces, scores, strict=True) if x > -np.inf for i in range(len(p) - 1)}
        self.base, self.check, self.value = trie.base.tolist(), trie.check.tolist(), trie.value.tolist()
        self.scores = scores.tolist()
        self.bytes = {int(m[1], 16): i for i, p in enumerate(pieces) if (m := BYTE.fullmatch(p))}
        self.byte_ids = np.array([self.bytes.get(i, -1) for i in range(256)], np.int32)
        self.poor = min(x for x in self.scores if x > -np.inf) - 10.0
        self.raw = pa.array([bytes([int(m[1], 16)]) if (m := BYTE.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces], pa.large_binary())

    @classmethod
    def load(cls, path: str) -> tuple[list[str], np.ndarray, DoubleArray]:
        """What a Codec is made of: built once by the driver, sent to the workers."""
        pieces, scores = load(path)
        return pieces, scores, DoubleArray.build({p.encode(): i for i, p in enumerate(pieces) if scores[i] > -np.inf})

    def viterbi(self, data: bytes, inner: bool) -> list[int]:
        """The best ids of a run: a unit's first, which the marker begins, or an inner one, where a marker is a literal to be spelt in bytes."""
        n, base, check, value, scores = len(data), self.base, self.check, self.value, self.scores
        best, back = [0.0] + [-np.inf] * n, [(-1, -1)] * (n + 1)
        for i in range(n):
            if best[i] == -np.inf or data[i] & 0xC0 == 0x80:
                continue
            here, s, covered = best[i], 0, False
            width = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
            if not ((inner or i) and data[i : i + 3] == b"\xe2\x96\x81"):
                for j in range(i, n):
                    t = base[s] + data[j] + 1
                    if check[t] != s:
                        break
                    s = t
                    v = value[t]
                    if v >= 0:
                        covered |= j + 1 == i + width
                        if here + scores[v] > best[j + 1]:
                            best[j + 1], back[j + 1] = here + scores[v], (i, v)
            end = i + width
            if not covered and here + self.poor > best[end]:
                best[end], back[end] = here + self.poor, (i, -1)
        ids: list[int] = []
        while n > 0:
            i, v = back[n]
            ids += [v] if v >= 0 else [self.bytes[b] for b in reversed(data[i:n] if i or inner else b" ")]
            n = i
        return ids[::-1]

    def unit(self, word: str) -> np.ndarray:
        """Ids of a marker and a word without spaces."""
        text, out, low = MARK + word, [], 0
        # no piece holds two neighbours that are in no piece together: the best path passes between them
        for i in [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.pairs] + [len(text)]:
            out += self.viterbi(text[low:i].encode("utf-8", "replace"), low > 0)
            low = i
        return np.array(out, np.int32)

    def together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units (as UTF-8 with their marker) one after another, and where each unit's end: Viterbi on all at once."""
        data = np.frombuffer(b"\xff".join(words) + b"\xff\xff", np.uint8).astype(np.int64)  # no piece holds the byte between them
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size + 1) - size - 1
        local = np.full(len(data), -1)
        inside = np.ones(len(data), bool)
        inside[np.append(first + size, len(data) - 1)] = False
        local[inside] = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        mark = np.zeros(len(data), bool)
        mark[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        begins = inside & (data & 0xC0 != 0x80)
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        at = np.flatnonzero(begins & ~(mark & (local > 0)))  # a literal marker inside a word begins no piece
        state, starts, ends, ids, reach = np.zeros(len(at), np.int64), [], [], [], 0
        base, check, value = self.trie.base.astype(np.int64), self.trie.check, self.trie.value
        while len(at):
            to = base[state] + data[at + reach] + 1
            ok = check[to] == state
            at, state, reach = at[ok], to[ok], reach + 1
            found = value[state]
            hit = np.flatnonzero(found >= 0)
            starts.append(at[hit])
            ends.append(at[hit] + reach)
            ids.append(found[hit])
        start, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, ids))
        whole = np.zeros(len(data), bool)
        whole[start[end - start == width[start]]] = True
        bare = np.flatnonzero(begins & ~whole)
        start, end, piece = np.concatenate([start, bare]), np.concatenate([end, bare + width[bare]]), np.concatenate([piece, np.full(len(bare), -1)])
        score = np.where(piece >= 0, self.weights[piece], self.poor)
        order = np.argsort(local[start], kind="stable")
        cuts = np.searchsorted(local[start][order], np.arange(size.max() + 1))
        best, back = np.full(len(data), -np.inf), np.full(len(data), -1)
        best[first] = 0.0
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            edge = order[i:j]
            gain = best[start[edge]] + score[edge]
            better = gain > best[end[edge]]  # of equal paths that with the earlier start, which came first, stays
            edge, gain = edge[better], gain[better]
            best[end[edge]], back[end[edge]] = gain, edge
        used, place = [], first + size
        while len(place):
            edge = back[place]
            used.append(edge)
            place = start[edge]
            place = place[local[place] > 0]
        used = np.concatenate(used)
        used = used[np.argsort(start[used])]
        spelt = piece[used] < 0
        opening = spelt & (local[start[used]] == 0)  # the marker itself, as a space
        n = np.where(spelt & ~opening, end[used] - start[used], 1)
        out = np.repeat(piece[used], n).astype(np.int32)
        again = np.repeat(spelt, n)
        offset = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
        out[again] = np.where(np.repeat(opening, n)[again], self.byte_ids[32], self.byte_ids[data[np.repeat(start[used], n)[again] + offset[again]]])
        return out, np.cumsum(np.bincount(np.repeat(np.searchsorted(first, start[used], "right") - 1, n), minlength=len(words)))

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units without their marker, one after another, and where each unit's end."""
        raw = [(MARK + w).encode("utf-8", "replace") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list = [None] * len(raw)
        for i in np.flatnonzero(size > LONG):
            out[i] = self.unit(words[i])
        short = np.flatnonzero(size <= LONG)
        for run in np.split(short, np.flatnonzero(np.diff(np.cumsum(size[short]) >> 16)) + 1):
            if len(run):
                ids, ends = self.together([raw[i] for i in run])
                for i, x in zip(run, np.split(ids, ends[:-1]), strict=True):
                    out[i] = x
        return np.concatenate(out), np.cumsum([len(x) for x in out])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after another, and where each text's end (with a 0 before); a null or empty text has none."""
        texts = texts.cast(pa.large_string())
        has = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        lists = pc.split_pattern(texts.filter(has), " ")
        offsets = lists.offsets.to_numpy()
        ids, total = self.known.joined(lists.values.slice(offsets[0], offsets[-1] - offsets[0]), self.segment)
        lengths = np.zeros(len(texts), np.int64)
        lengths[has.to_numpy(zero_copy_only=False)] = np.diff(total[offsets - offsets[0]])
        return ids, np.append(0, np.cumsum(lengths))

    def encode(self, text: str | None) -> bytes:
        """A text's ids as int32 bytes."""
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()

    def decode_all(self, lists: pa.ListArray) -> list[str | None]:
        """The text of each list of ids (null: null)."""
        offsets = lists.offsets.to_numpy().astype(np.int64)
        taken = self.raw.take(lists.values.slice(offsets[0], offsets[-1] - offsets[0]))
        place = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1][offsets - offsets[0]].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        return [str(data[i + 1 : j], "utf-8", "replace") if ok else None for i, j, ok in zip(place[:-1], place[1:], lists.is_valid().to_pylist(), strict=True)]


#: A worker's codecs, with the units they know, by what they are made of.
CODECS: dict[int, Codec] = {}


def codec_of(parts: tuple) -> Codec:
    key = hash((tuple(parts[0]), parts[1].tobytes()))
    if key not in CODECS:
        CODECS.clear()
        CODECS[key] = Codec(*parts)
    return CODECS[key]


def runs(batch: pa.Array, sizes: np.ndarray, most: int) -> Iterator[pa.Array]:
    """A batch in slices of about `most` bytes or numbers."""
    cuts = np.append(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1, len(batch))
    for i, j in zip(np.append(0, cuts[:-1]), cuts, strict=True):
        if j > i:
            yield batch.slice(i, j - i)


def encoded(text: Column, parts: tuple) -> Column:
    """array<int> of each whole text's piece ids."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(parts)
        for batch in batches:
            ids, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
            for some in runs(batch, pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False), 1 << 22):
                found, cuts = codec.encode_all(some)
                ids.append(found)
                ends.append(ends[-1][-1] + cuts[1:])
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(ids)))

    return F.arrow_udf(run, "array<int>")(text)


def decoded(ids: Column, parts: tuple) -> Column:
    """The text of each list of ids (null: null)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(parts)
        for batch in batches:
            yield pa.array([x for some in runs(batch, pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False), 1 << 20) for x in codec.decode_all(some)], pa.string())

    return F.arrow_udf(run, "string")(ids)
