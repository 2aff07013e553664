"""Fill-in-the-middle transformation over an index of distinct texts.

`index` has one row for each different text: its key (SHA-256 and length in bytes), its number of lines and the ends of
its lines as an Elias-Fano list. A task groups a batch's equal texts by comparing them, computes the list once for each,
and an aggregate by key, combined before its shuffle, merges what the tasks found; no text is shuffled for it. Documents
are joined back by key, the one exchange that carries texts: a key that very many documents share meets a small row, and
AQE may split its side. The joined batch compares texts of one key again, and one that differs from the first would take
its own list. Each document then selects two ends from the list: selecting the k-th end reads a bit list, not the text.

Lines are `[^\\n]*\\n|[^\\n]+`. The cut is seeded by the id: the first four 32-bit numbers h1 to h4 of the SHA-256 of
"seed:id" give the first and second end (h1 and h2 modulo n + 1, sorted), whether the text is transformed (h3 % 100 <
fim_rate) and whether the suffix goes first (h4 % 100 < spm_rate). Texts that are empty or hold a sentinel stay plain.

Defined results: a null text is empty (plain, no lines); a null id has the seed string with nothing after the colon;
repeated rows are transformed each; an empty table gives none; other columns are kept, and those of the result's names
are replaced.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: The sentinels.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
POPULATION = np.array([bin(x).count("1") for x in range(256)], np.int64)


def ef_encode(values: np.ndarray) -> bytes:
    """An Elias-Fano list of ascending numbers: count, low bits' width, then the low bits of each and the high parts in unary."""
    n = len(values)
    if not n:
        return b""
    width = max(0, int(values[-1] // n).bit_length() - 1)
    low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    high = np.zeros(int(values[-1] >> width) + n, np.uint8)
    high[(values >> width) + np.arange(n)] = 1
    return struct.pack("<IB", n, width) + np.packbits(low.ravel(), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def ef_select(data: bytes, k: int) -> int:
    """The k-th number (from 0) of a list."""
    n, width = struct.unpack_from("<IB", data)
    if not 0 <= k < n:
        raise IndexError(k)
    size = (n * width + 7) // 8
    bits = int.from_bytes(data[5 + k * width // 8 : 5 + ((k + 1) * width + 7) // 8], "little") >> (k * width % 8)
    high = np.frombuffer(data, np.uint8, offset=5 + size)
    ones = np.cumsum(POPULATION[high])
    byte = int(np.searchsorted(ones, k, "right"))
    before = int(ones[byte - 1]) if byte else 0
    place = byte * 8 + int(np.flatnonzero(np.unpackbits(high[byte : byte + 1], bitorder="little"))[k - before])
    return (place - k) << width | bits & ((1 << width) - 1)


def line_ends(text: str) -> np.ndarray:
    """Where each line ends, in code points."""
    sizes = np.fromiter(map(len, text.split("\n")), np.int64)
    sizes[:-1] += 1
    return np.cumsum(sizes if sizes[-1] else sizes[:-1])


def key_of(text: Column) -> Column:
    """SHA-256 as bytes, with the length in front."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")), F.unhex(F.sha2(text, 256)))


def index(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, n_lines, ends, n_documents) for each different text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[str, int] = {}
            for x in batch.column(0).to_pylist():
                groups[x] = groups.get(x, 0) + 1
            raw = [x.encode() for x in groups]
            ends = [line_ends(x) for x in groups]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([len(x).to_bytes(8, "big") + hashlib.sha256(x).digest() for x in raw], pa.binary()),
                    pa.array([len(x) for x in ends], pa.int64()),
                    pa.array([ef_encode(x) for x in ends], pa.binary()),
                    pa.array(list(groups.values()), pa.int64()),
                ],
                names=["key", "n_lines", "ends", "n_documents"],
            )

    found = docs.select(F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, "key binary, n_lines long, ends binary, n_documents long")
    return found.groupBy("key").agg(F.any_value("n_lines").alias("n_lines"), F.any_value("ends").alias("ends"), F.sum("n_documents").alias("n_documents"))


def cut(text: Column, key: Column, ends: Column, low: Column, high: Column, form: Column) -> Column:
    """A struct (prefix_chars, middle_chars, output) of each document."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            seen: dict[bytes, str] = {}
            out = []
            for x, k, e, i, j, f in zip(*(c.to_pylist() for c in batch), strict=True):
                if f == "plain":
                    out.append((None, None, x))
                    continue
                if seen.setdefault(k, x) != x:  # one key, two texts
                    e = ef_encode(line_ends(x))
                a, b = (ef_select(e, m - 1) if m else 0 for m in (i, j))
                prefix, middle, suffix = x[:a], x[a:b], x[b:]
                out.append((a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if f == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"))
            cells = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["prefix_chars", "middle_chars", "output"])

    return F.arrow_udf(run, "prefix_chars long, middle_chars long, output string")(text, key, ends, low, high, form)


def transform(docs: DataFrame, seed: int = 7, fim_rate: int = 100, spm_rate: int = 50, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with n (lines), form (plain, psm, spm), prefix_chars, middle_chars and output."""
    key, ends, numbers, low, high, cuts = (fresh(docs, x) for x in ("_key", "_ends", "_numbers", "_low", "_high", "_cuts"))
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    keep = [c for c in docs.columns if c.lower() not in names]
    body = F.coalesce(text, F.lit(""))
    lines = index(docs, text).select(F.col("key").alias(key), F.col("n_lines").alias("n"), F.col("ends").alias(ends))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    joined = docs.select(*keep).withColumn(key, key_of(body)).join(lines, key).withColumn(numbers, F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4))))
    h = [F.col(numbers)[i] for i in range(4)]
    picks = [h[i] % (F.col("n") + 1) for i in range(2)]
    sentinel = F.greatest(*(F.instr(body, F.lit(x)) for x in (PREFIX, SUFFIX, MIDDLE))) > 0
    form = F.when((body == "") | sentinel | (h[2] % 100 >= fim_rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    seeded = joined.withColumns({low: F.least(*picks), high: F.greatest(*picks), "form": form})
    done = seeded.withColumn(cuts, cut(body, *(F.col(x) for x in (key, ends, low, high, "form"))))
    return done.select(*keep, "n", "form", *(F.col(f"{cuts}.{x}").alias(x) for x in names[2:]))


def restored(output: Column, form: Column) -> Column:
    """The text rebuilt from an output and its form."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
