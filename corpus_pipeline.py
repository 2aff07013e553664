"""The corpus pipeline: five stages over documents, each by one corpus operator, written as Parquet between them."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm import chaining, chosen_path, langid, mixing, unigram_codec
from wavelake.llm.common import fresh, held_out, lean, noted, remove, table, written

PIECES = public_tokenizers.path("piece_bpe_32k.model")


#: What the last stage's operator left in the shared folder.
LEFT: list[str] = []


def stage(f):
    """A stage that first removes what the stage before it needed: that stage's rows are written by now."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        for path in LEFT:
            if not any(path.removeprefix("file://") in x for x in read):
                remove(spark, path)
        lean(spark)
        with noted() as paths:
            out = f(spark, docs, sf_dir)
        LEFT[:] = paths
        return out

    return run


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters that some learned language explains better than uniform bytes."""
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))), PIECES)
    guess = fresh(docs, "_guess")
    return docs.withColumn(guess, langid.predict(F.col("text"), model, PIECES)).where(langid.accepted(F.col(guess))).select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the smallest id, once (and rows without an id or words)."""
    links = chosen_path.join(docs).where("group_key is not null").select("doc_id", "text_hash", "group_key")
    kept = links.groupBy("group_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.doc_id", "k.text_hash", F.lit(True).alias("kept"))
    rows = links.select("doc_id", "text_hash").distinct()
    doc, name, stays, known = (fresh(docs, x) for x in ("near_id", "near_text", "near_kept", "near_known"))
    marks = rows.join(kept, ["doc_id", "text_hash"], "left").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(name), F.coalesce("kept", F.lit(False)).alias(stays))
    joined = docs.withColumn(known, F.xxhash64("text")).join(marks, (F.col("doc_id") == F.col(doc)) & (F.col(known) == F.col(name)), "left")
    silent, grouped = joined.where(F.col(stays).isNull()), joined.where(F.col(stays))
    # rows that repeat an id and its text are one document; the exchange of the join serves the aggregate
    return grouped.dropDuplicates([doc, name]).select(*docs.columns).unionByName(silent.select(*docs.columns))


@stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of all documents but the first that holds them."""
    found, _ = written(chaining.find(docs), "passages")
    out = chaining.without(docs, found)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the order of the mixture: by files, and by rows in each."""
    names = tuple(fresh(docs, x) for x in ("_block", "_slot", "_position"))
    mixed = mixing.mix(docs, names=names)
    return mixed.repartitionByRange(names[2]).sortWithinPartitions(names[2]).select(*docs.columns)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, piece ids, their number, and the document's place in the mixture (order by it; null where docs is no table of files)."""
    parts = unigram_codec.Codec.load(PIECES)
    return docs.select("doc_id", "source", unigram_codec.encoded(F.col("text"), parts).alias("ids"), place(docs).alias("position")).withColumn("n_tokens", F.size("ids"))


def place(docs: DataFrame) -> Column:
    """A row's place in a table written in order: its file's number (part files are named by partition) and its row in the file."""
    if not docs.inputFiles():
        return F.lit(None).cast("long")
    file = docs.metadataColumn("_metadata")["file_name"]
    part, split = (F.coalesce(F.regexp_extract(file, x, 1).try_cast("long"), F.lit(0)) for x in (r"^part-(\d+)", r"-c(\d+)"))
    return part * (1 << 43) + split * (1 << 33) + docs.metadataColumn("_metadata")["row_index"]


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("substring dedup", passages), ("mixing", mixture), ("sentencepiece", encode)]
#: Learned models, similarity joins and Viterbi have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's input is removed when its output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, f in STAGES:
        out = f(spark, docs, sf_dir)
        if f is encode:
            return out
        docs, path = written(out, name.replace(" ", "-"))
        if before:
            remove(spark, before)
        before = path
    return docs
