"""The corpus operators' queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, chaining, chosen_path, embed_dedup, fill_middle, langid, mixing, periodic_runs, syncmers, token_counts, toxicity, unigram_codec, warc
from .common import held_out, scratch, table

#: The public vocabularies; another folder's files may be named instead.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = toxicity.fit(docs.where("not held_out"), labels)
    scored = docs.select("doc_id", "held_out", toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return syncmers.edited(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = scratch(spark, "warc")
    warc.register(spark)
    warc.planned(table(spark, sf_dir, "pages")).write.format("warc").option("path", path).mode("append").save()
    back = spark.read.format("warc").option("path", path).option("payload", "verify").option("partition_bytes", 16 << 20).load()
    return back.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its source, block, slot and position in a mixture by the square roots of the sources' sizes."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch(spark, "packed")
    spark.dataSource.register(bitpack.PackedIds)
    # rows of one id, or of none, are dealt out by a hash of their text, so they needn't share a task
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    dealt.write.format("packed_ids").options(path=path, vocabulary=50257, tokenizer=BYTES, end_id=2).mode("append").save()
    return spark.read.format("packed_ids").option("ids", "crc32").load(path)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, class_id, n_links (five-word shingles, Jaccard of 0.8 or more)."""
    return chosen_path.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its piece ids, their number, and whether decoding gives back the text."""
    parts = unigram_codec.Codec.load(PIECES)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = docs.withColumn("ids", unigram_codec.encoded(F.col("text"), parts))
    return ids.select("doc_id", "ids", F.size("ids").alias("n_tokens"), (unigram_codec.decoded(F.col("ids"), parts) == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    return embed_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, lang_pred, score, nats_per_letter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = langid.fit(docs.where("not held_out"), PIECES)
    return docs.select("doc_id", "held_out", langid.predict(F.col("text"), model, PIECES).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.nats_per_letter")


def op10_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages: doc_id, ref_id, word and character ranges, identity."""
    return chaining.find(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_bytes, n_tokens, over_limit (1,024 tokens)."""
    return token_counts.measured(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTES, 1024).drop("text")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n, form, prefix_chars, middle_chars, and digests of the output and of the text rebuilt from it."""
    done = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document (every tenth id's text made periodic from some word on): its runs, the longest of them, and digests of all runs and of the collapsed text."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(chosen, words).alias("words"))
    docs = docs.withColumn("a", F.expr("g % size(words)")).withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    edited = F.array_join(F.expr("transform(words, (w, i) -> if(i < a, w, get(words, int(a + (i - a) % p))))"), " ")
    found = docs.select("doc_id", periodic_runs.analysed(F.when(F.col("a").isNull(), F.col("text")).otherwise(edited)).alias("r"))
    best = F.array_max(F.transform("r.runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.array_join(F.transform("r.runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("r.runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("r.collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_syncmers, op3_warc, op4_mixing, op5_bit_packed_ids, op6_ngram_jaccard_join, op7_sentencepiece, op8_embedding_dedup, op9_language_id, op10_chaining, op11_token_counts, op12_fill_middle, op13_periodic_runs)
}
#: DuckDB's forms; the tests hold the other operators against brute force.
ORACLES: dict[str, str] = {}
ORACLES["op8_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0 AND list_max([abs(e) FOR e IN embedding]) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT a AS id, a AS c FROM p UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a AS id, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(m.c, vec_id) AS component_id, vec_id = coalesce(m.c, vec_id) AS kept
FROM embeddings LEFT JOIN m ON m.id = vec_id LEFT JOIN n ON n.id = vec_id"""
ORACLES["op3_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first THEN first END AS refers_to
FROM q"""
ORACLES["op12_fill_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
c AS (SELECT doc_id, x, u, len(u) AS n, [('0x' || substr(h, 1 + 8 * i, 8))::BIGINT FOR i IN range(4)] AS h FROM d),
b AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT doc_id, x, n, form, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM b)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM p"""
