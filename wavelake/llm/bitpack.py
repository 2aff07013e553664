"""Token ids in files of fixed bit width, as a Spark data source `packed_ids`, with random access.

A file holds the documents of one range of ids in ascending order. Layout, little-endian:

    b"BPK2"
    packed ids: blocks of `block` ids, each id in `width` bits, every block starting at a byte (offset in the footer)
    zlib of int64 doc ids and int64 ends (ids of this file up to and with each document)
    JSON footer {width, block, docs, tokens, doc_at, doc_bytes, offsets}, u32 footer length, b"BPK2"

width is the least number of bits that holds the vocabulary's largest id, so an id's place is arithmetic: any block
unpacks with a few numpy operations and any range of ids reads only its blocks. (A width of 16, as for a vocabulary of
50,257, makes a block plain shorts: same bytes, read as such.) Writers stream: a block goes out when it is full, a task
holds 16 bytes a document besides, and a new file begins after `file_tokens` ids.

Rows to write are (doc_id, ids), or (doc_id, text) with options `tokenizer` (a file of the tokenizers library) and
`end_id`; then the writing task encodes. Files are named by job, partition and attempt; the driver's commit, which
alone sees which attempts won, deletes this job's losers and writes the manifest with every file's first id, and readers
plan from the manifest. A lost executor costs its task only. Mode append adds after what a manifest lists; overwrite
replaces it. Reading with option `ids` = `crc32` gives a checksum of each document's ids in place of them.

Defined results: null texts encode as empty; with an end id every document has at least that; documents keep the order
of their rows; rows with a null id come back null; an empty table makes an empty manifest.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import Lists, slabs

MAGIC = b"BPK2"
BLOCK = 4096
FILE_TOKENS = 1 << 26
#: Parts of texts whose ids a worker keeps.
KEEP_PARTS = 300_000
#: A space that may belong to a run of white space: one before white space (or before what a regular expression may take for such), or a text's last.
GLUED = " ($|[\\s\\x1c-\\x1f\\x{85}\\x{180e}\\p{Z}])"
APART = re.compile(r" (?=[^\s\u180e])")
NO_ID = -(1 << 63)


def width_for(vocabulary: int) -> int:
    """The least bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids, each in `width` bits, low bits first, padded to a byte."""
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | np.ndarray, width: int, n: int) -> np.ndarray:
    """The first n ids of a block."""
    if width == 16:
        return np.frombuffer(data, "<u2", n).astype(np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return bits.astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


def pack_blocks(ids: np.ndarray, width: int, block: int = BLOCK) -> tuple[bytes, list[int]]:
    """The packed blocks and each block's first byte."""
    size = (block * width + 7) // 8
    if width == 16:
        data = ids.astype("<u2").tobytes()
    else:
        data = b"".join(pack(ids[i : i + block], width) for i in range(0, len(ids), block))
    return data, list(range(0, len(data), size))


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Encoder:
    """The tokenizers library over texts, with the ids of the parts it has seen kept.

    Byte-level vocabularies with their usual splitting always cut before a space that a non-space follows, so a text is
    the sum of such parts: a batch's different parts are found by Arrow, those not seen yet are encoded together, and
    the ids of all parts are gathered at once. Strings of added tokens are found first, as the library does. Other
    kinds of vocabularies take whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        setup = json.loads(self.lib.to_str())
        split = setup.get("pre_tokenizer") or {}
        added = setup.get("added_tokens") or []
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added if not t["special"])
        self.by_part = not setup.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and plain
        self.added = {t["content"]: t["id"] for t in added}
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        names = self.lib.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(names.values(), default=0) + 1, bool)
        self.spaced[[i for x, i in names.items() if x.startswith("\u0120") and x not in self.added]] = True
        self.known = Lists(KEEP_PARTS, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, new: list[str], simple: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts, each with a space before it, one after another, and where each part's end."""
        out, ends, done = [], [], 0
        for low in range(0, len(new), 256):
            run = new[low : low + 256]
            ids = self.whole([" " + " ".join(run)])[0] if simple else None
            cuts = np.flatnonzero(self.spaced[ids]) if simple else []
            if len(cuts) == len(run):  # each part's first id alone begins with a space
                cuts = np.append(cuts[1:], len(ids))
            else:
                each = self.whole([" " + x for x in run])
                ids, cuts = np.concatenate(each), np.cumsum([len(x) for x in each])
            out.append(ids)
            ends.append(cuts + done)
            done += len(ids)
        return np.concatenate(out), np.concatenate(ends)

    def gathered(self, lists, simple: bool) -> list[np.ndarray]:
        """The ids of texts cut into parts; simple: no part but a text's first has a space in it or begins with white space."""
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets -= offsets[0]
        first = self.whole(flat.take(pa.array(offsets[:-1])).to_pylist())
        rest = np.ones(len(flat), bool)
        rest[offsets[:-1]] = False
        ids, total = self.known.joined(flat.filter(pa.array(rest)), lambda new: self.parts(new, simple))
        cuts = total[offsets - np.arange(len(offsets))]
        return [np.concatenate([f, ids[i:j]]) for f, i, j in zip(first, cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts."""
        if not self.by_part:
            return [ids for run in slabs(texts) for ids in self.whole(run)]
        column = pa.array(texts, pa.large_string())
        glued = pc.match_substring_regex(column, GLUED).to_numpy(zero_copy_only=False)
        named = np.zeros(len(texts), bool)
        for x in self.added:
            named |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        plain = np.flatnonzero(~glued & ~named)
        if len(plain):
            for i, ids in zip(plain, self.gathered(pc.split_pattern(column.take(pa.array(plain)), " "), True), strict=True):
                out[i] = ids
        glued = np.flatnonzero(glued & ~named)
        if len(glued):
            for i, ids in zip(glued, self.gathered(pa.array([APART.split(texts[i]) for i in glued], pa.large_list(pa.large_string())), False), strict=True):
                out[i] = ids
        for i in np.flatnonzero(named):
            pieces = self.special.split(texts[i])
            ids = dict(zip(range(0, len(pieces), 2), self.encode(pieces[::2]), strict=True))
            out[i] = np.concatenate([ids[j] if j in ids else np.array([self.added[x]], np.uint32) for j, x in enumerate(pieces)])
        return out


def encoded(text: Column, path: str, end_id: int | None = None) -> Column:
    """array<int> of each whole text's ids, with end_id after them."""
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lib = Encoder(path)
        for batch in batches:
            found = [np.concatenate([ids, tail]) for slab in slabs(batch.to_pylist(), 1 << 22) for ids in lib.encode(slab)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found or [tail[:0]]).astype(np.int32)))

    return F.arrow_udf(run, "array<int>")(text)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list[dict] = field(default_factory=list)


class PackingFile:
    """One file being written: ids are added, full blocks go out."""

    def __init__(self, fs, path: str, name: str, width: int):
        self.name, self.width = name, width
        self.out = fs.open_output_stream(f"{path}/{name}")
        self.out.write(MAGIC)
        self.tail, self.size, self.offsets, self.tokens = np.zeros(0, np.uint32), len(MAGIC), [], 0
        self.doc_ids: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"an id needs more than {self.width} bits")
        self.doc_ids.append(doc_ids.astype("<i8"))
        self.ends.append(self.tokens + np.cumsum(lengths, dtype="<i8"))
        self.tokens += len(ids)
        self.tail = np.concatenate([self.tail, ids])
        self.flush(len(self.tail) // BLOCK * BLOCK)

    def flush(self, n: int) -> None:
        if n:
            data, offsets = pack_blocks(self.tail[:n], self.width)
            self.offsets += [self.size + x for x in offsets]
            self.out.write(data)
            self.size += len(data)
            self.tail = self.tail[n:]

    def close(self) -> dict:
        self.flush(len(self.tail))
        docs = zlib.compress(b"".join(x.tobytes() for x in self.doc_ids + self.ends), 1)
        n = sum(map(len, self.doc_ids))
        foot = json.dumps({"width": self.width, "block": BLOCK, "docs": n, "tokens": self.tokens, "doc_at": self.size, "doc_bytes": len(docs), "offsets": self.offsets}).encode()
        self.out.write(docs + foot + struct.pack("<I", len(foot)) + MAGIC)
        self.out.close()
        return {"name": self.name, "docs": n, "tokens": self.tokens}


class Packer(DataSourceArrowWriter):
    """Rows come range-partitioned and sorted; a task writes a file, or more of them by size."""

    def __init__(self, path: str, width: int, overwrite: bool, tokenizer: str | None, end_id: int | None, file_tokens: int):
        self.path, self.width, self.overwrite, self.tokenizer, self.end_id, self.file_tokens = path.rstrip("/"), width, overwrite, tokenizer, end_id, file_tokens
        self.job = uuid.uuid4().hex[:12]

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(doc ids, lengths, ids) of a few documents at a time."""
        lib = Encoder(self.tokenizer) if self.tokenizer else None
        tail = np.array([] if self.end_id is None else [self.end_id], np.uint32)
        for batch in batches:
            doc_ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            if lib is None:
                column = batch.column("ids").cast(pa.list_(pa.int32()))
                yield doc_ids, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
                continue
            at = 0
            for run in slabs(batch.column("text").to_pylist(), 1 << 22):
                found = [x for ids in lib.encode(run) for x in (ids, tail)]
                yield doc_ids[at : at + len(run)], np.array([len(x) + len(tail) for x in found[::2]]), np.concatenate(found)
                at += len(run)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, at = filesystem(self.path)
        fs.create_dir(at, recursive=True)
        done, file = Written(ctx.partitionId()), None
        for doc_ids, lengths, ids in self.rows(batches):
            ends, i = np.cumsum(lengths, dtype=np.int64), 0
            while i < len(doc_ids):
                file = file or PackingFile(fs, at, f"part-{self.job}-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{len(done.files):04d}.bpk", self.width)
                low = int(ends[i - 1]) if i else 0
                j = max(i + 1, int(np.searchsorted(ends, low + self.file_tokens - file.tokens, "right")))
                file.add(doc_ids[i:j], lengths[i:j], ids[low : ends[j - 1]])
                if j < len(doc_ids) or file.tokens >= self.file_tokens:
                    done.files.append(file.close())
                    file = None
                i = j
        if file:
            done.files.append(file.close())
        return done

    def mine(self, fs, at: str) -> list:
        from pyarrow import fs as pfs

        return [f for f in fs.get_file_info(pfs.FileSelector(at, allow_not_found=True)) if f.base_name.startswith(f"part-{self.job}-")]

    def commit(self, messages: list) -> None:
        from pyarrow import fs as pfs

        fs, at = filesystem(self.path)
        fs.create_dir(at, recursive=True)
        old = {"files": [], "tokens": 0, "width": self.width}
        if fs.get_file_info(f"{at}/manifest.json").type == pfs.FileType.File:
            with fs.open_input_stream(f"{at}/manifest.json") as f:
                old = json.loads(f.read())
        files, start = ([], 0) if self.overwrite else (old["files"], old["tokens"])
        for m in sorted((m for m in messages if m), key=lambda m: m.partition):
            for f in m.files:
                files.append(f | {"start": start})
                start += f["tokens"]
        kept = {f["name"] for f in files}
        with fs.open_output_stream(f"{at}/manifest.{self.job}") as out:
            out.write(json.dumps({"width": self.width, "tokens": start, "files": files}).encode())
        fs.move(f"{at}/manifest.{self.job}", f"{at}/manifest.json")
        for name in [f.base_name for f in self.mine(fs, at)] + [f["name"] for f in old["files"]]:
            if name not in kept:
                fs.delete_file(f"{at}/{name}")

    def abort(self, messages: list) -> None:
        fs, at = filesystem(self.path)
        for f in self.mine(fs, at):
            fs.delete_file(f.path)


@dataclass
class FilePart(InputPartition):
    name: str
    start: int


class Unpacker(DataSourceReader):
    def __init__(self, path: str, digest: bool):
        self.path, self.digest = path.rstrip("/"), digest

    def manifest(self) -> dict:
        fs, at = filesystem(self.path)
        with fs.open_input_stream(f"{at}/manifest.json") as f:
            return json.loads(f.read())

    def partitions(self) -> list[InputPartition]:
        return [FilePart(f["name"], f["start"]) for f in self.manifest()["files"]] or [FilePart("", 0)]

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        with PackedFile(f"{self.path}/{part.name}") as f:
            doc_ids, ends = f.documents()
            starts = np.append(0, ends[:-1])
            # documents of about a million ids at a time
            cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, max(f.head["tokens"], 1), 1 << 20)), len(doc_ids)))
            for i, j in zip(np.append(0, cuts[:-1])[cuts > 0], cuts[cuts > 0], strict=True):
                ids = f.ids(int(starts[i]), int(ends[j - 1]))
                offsets = np.append(starts[i], ends[i:j]) - starts[i]
                if self.digest:
                    raw = ids.astype("<u4").tobytes()
                    last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[i:j], mask=doc_ids[i:j] == NO_ID), pa.array(part.start + starts[i:j]), pa.array(ends[i:j] - starts[i:j]), last],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if self.digest else "ids"],
                )


class PackedFile:
    """Random access to one file: only the blocks of the asked range are read."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.file = fs.open_input_file(at)
        whole = self.file.size()
        self.file.seek(max(0, whole - 8))
        size, magic = struct.unpack("<I4s", self.file.read(8))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of packed ids")
        self.file.seek(whole - 8 - size)
        self.head = json.loads(self.file.read(size))
        self.block_bytes = (self.head["block"] * self.head["width"] + 7) // 8

    def __enter__(self) -> PackedFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(self.head["doc_at"])
        both = np.frombuffer(zlib.decompress(self.file.read(self.head["doc_bytes"])), "<i8")
        return both[: self.head["docs"]], both[self.head["docs"] :]

    def ids(self, low: int, high: int) -> np.ndarray:
        """The file's ids low .. high - 1."""
        if high <= low:
            return np.zeros(0, np.int64)
        block, width, tokens = self.head["block"], self.head["width"], self.head["tokens"]
        i, j = low // block, -(-high // block)
        first = self.head["offsets"][i]
        self.file.seek(first)
        data = self.file.read(min(self.head["doc_at"], first + (j - i) * self.block_bytes) - first)
        if width == 16:
            return unpack(data, 16, min(tokens, j * block) - i * block)[low - i * block : high - i * block]
        out = [unpack(data[k * self.block_bytes : (k + 1) * self.block_bytes], width, min(block, tokens - (i + k) * block)) for k in range(j - i)]
        return np.concatenate(out)[low - i * block : high - i * block]


class PackedIds(DataSource):
    """df.write.format("packed_ids").option("path", ...).option("vocabulary", n) and spark.read.format("packed_ids").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if self.options.get("ids") == "crc32" else "ids array<int>")

    def reader(self, schema) -> DataSourceReader:
        return Unpacker(self.options["path"], self.options.get("ids") == "crc32")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        end_id = self.options.get("end_id")
        return Packer(self.options["path"], width_for(int(self.options["vocabulary"])), overwrite, self.options.get("tokenizer"), None if end_id is None else int(end_id), int(self.options.get("file_tokens", FILE_TOKENS)))
