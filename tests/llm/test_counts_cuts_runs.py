"""Token counts, fill-in-the-middle and periodic runs against the library, the rule's own words and brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavelake.llm import fill_middle, periodic_runs, queries, token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", "  two  spaces\n \n x\t y  ", "a <|endoftext|> b<|endoftext|>", "中文 текст ▁literal ▁", "😀 emoji", "x" * 5000, "word " * 3000, "don't 'S 's\u0085᠎  x", "՘\U0002ebf0 new", "a\x00b\x1cc\r\nd", "<P> sentinel", "line\n\nline\n", "é\n" * 7]


def fuzz(rng, n):
    parts = [" ", "  ", "\n", "\t", "'s", "'ll", "'", "ab", "The", "word", "123", "٣", "é", "中", "ǅ", "͸", "Ᲊ", "\U0002ebf0", "_", "...", "<|endoftext|>", "　", "᠎", "\x1f", "😀", "́", "²"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with a documents table of odd, repeated and random rows, and the rows."""
    rng = random.Random(4)
    texts = ODD + ODD + fuzz(rng, 300) + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 120))) + "\n" * (i % 3) for i in range(300)]
    texts += [(" ".join(f"w{rng.randrange(60)}" for _ in range(9)) + "\n") * rng.randrange(1, 5) for _ in range(100)]
    rows = [(i * 3 - 5, x) for i, x in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("rows"))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_proved_strings_encode_alone():
    proved, lib = token_counts.prove(BYTES), Tokenizer.from_file(BYTES)
    assert 49_000 < len(proved.whole) <= 50_256 and "<|endoftext|>" not in proved.whole
    for s in random.Random(0).sample(sorted(proved.whole), 2000):
        assert len(lib.encode(s, add_special_tokens=False).ids) == 1
    assert token_counts.prove(WORDS) is None and token_counts.prove(PIECES) is None


def test_pre_tokens_are_the_librarys():
    """Every code point beside a letter, a number and a sign: the pattern parts them as the library does, or the class of newer letters names them."""
    lib, newer = Tokenizer.from_file(BYTES), re.compile(token_counts.newer_letters())
    for c in [*range(0x3100), *range(0xA000, 0xAC00), *range(0xF900, 0x12000, 7), *range(0x2E000, 0x2F000, 3)]:
        text = f"a{chr(c)} 1{chr(c)} !{chr(c)}"
        want = [text[i:j] for _, (i, j) in lib.pre_tokenizer.pre_tokenize_str(text)]
        assert newer.search(text) or token_counts.PATTERN.findall(text) == want, hex(c)


def test_long_texts_are_cut_where_a_pre_token_begins(monkeypatch):
    monkeypatch.setattr(token_counts, "SLAB", 20)
    for text in [x for x in ODD if x] + fuzz(random.Random(9), 500):
        assert [x for run in token_counts.pre_tokens(text) for x in run] == token_counts.PATTERN.findall(text)


def test_token_counts_query(spark, tables):
    folder, rows = tables
    lib = Tokenizer.from_file(BYTES)
    got = by_id(queries.op11_token_counts(spark, folder))
    assert set(next(iter(got.values()))) == {"doc_id", "n_bytes", "n_tokens", "over_limit"}
    for i, x in rows:
        n = len(lib.encode(x or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((x or "").encode()), n, n > 1024), x


def test_token_counts_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "KEEP_PARTS", 50)
    count = token_counts.TokenCounter(token_counts.prove(BYTES))
    before, lib = len(count.known), Tokenizer.from_file(BYTES)
    texts = fuzz(random.Random(2), 400) + [f" zq{i}xv" for i in range(400)]
    for _ in range(2):
        assert count.count(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert len(count.known) <= before + 50


@pytest.mark.parametrize("path", [WORDS, PIECES])
def test_token_counts_of_other_vocabularies(spark, path):
    import sentencepiece

    texts = ["The quick brown fox", "", None, "中文 ünï", "a b  c\nd"]
    if path.endswith(".model"):
        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([x or "" for x in texts])]
    else:
        want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([x or "" for x in texts], add_special_tokens=False)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", token_counts.counts(F.col("t"), path).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == want


def test_measured_replaces_clashing_columns(spark):
    df = spark.createDataFrame([("a b", 9, "x")], "text string, N_tokens int, over_limit string")
    row = token_counts.measured(df, BYTES, 1).first()
    assert (row["n_tokens"], row["over_limit"], row["n_bytes"]) == (2, True, 3)
    assert token_counts.measured(df.limit(0), BYTES, 1).count() == 0


def test_elias_fano_lists():
    rng = random.Random(5)
    assert fill_middle.ef_encode(np.zeros(0, np.int64)) == b""
    for _ in range(400):
        values = np.cumsum([rng.choice([0, 1, 7, 900, 1 << 20]) for _ in range(rng.randrange(1, 90))])
        data = fill_middle.ef_encode(values)
        assert [fill_middle.ef_select(data, k) for k in range(len(values))] == values.tolist()
        assert len(data) * 8 <= 56 + len(values) * (3 + max(0, int(values[-1] // len(values)).bit_length()))
        with pytest.raises(IndexError):
            fill_middle.ef_select(data, len(values))


def cut_by_words(i, x):
    """The contract in plain Python."""
    x = x or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", x)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(h[k] % (len(units) + 1) for k in range(2))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not x or any(t in x for t in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, x
    spm = h[3] % 100 < 50
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_query_is_the_rule_and_its_sql(spark, tables):
    folder, rows = tables
    got = by_id(queries.op12_fill_middle(spark, folder))
    assert len(got) == len(rows)
    for i, x in rows:
        n, form, p, m, out = cut_by_words(i, x)
        want = {"doc_id": i, "n": n, "form": form, "prefix_chars": p, "middle_chars": m, "output_sha256": hashlib.sha256(out.encode()).hexdigest(), "restored_sha256": hashlib.sha256((x or "").encode()).hexdigest()}
        assert got[i] == want, x
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        cur = db.execute(queries.ORACLES["op12_fill_middle"])
        names = [c[0] for c in cur.description]
        assert {r[0]: dict(zip(names, r, strict=True)) for r in cur.fetchall()} == got


def test_index_has_one_row_for_each_text(spark, tables):
    folder, rows = tables
    found = fill_middle.index(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    texts = [x or "" for _, x in rows]
    assert len(found) == len(set(texts)) and sum(r["n_documents"] for r in found) == len(texts)
    assert sorted(r["n_lines"] for r in found) == sorted(len(re.findall(r"[^\n]*\n|[^\n]+", x)) for x in set(texts))


def test_texts_of_one_key_keep_their_own_cuts(spark):
    """Were two texts to share a key, each is still cut by its own lines."""
    rows = [(0, "one\ntwo\n", 1), (1, "1\n2\n3", 1), (2, "one\ntwo\n", 2)]
    df = spark.createDataFrame(rows, "i int, t string, k long").coalesce(1)
    ends = bytearray(fill_middle.ef_encode(np.array([4, 8])))
    cut = fill_middle.cut(F.col("t"), F.lit(bytearray(b"k")), F.lit(ends), F.col("k"), F.col("k"), F.lit("psm"))
    got = [r["c"]["output"] for r in df.select("i", cut.alias("c")).orderBy("i").collect()]
    assert got == ["<P>one\n<S>two\n<M>", "<P>1\n<S>2\n3<M>", "<P>one\ntwo\n<S><M>"]


def test_fill_middle_rates_nulls_repeats_and_clashes(spark):
    rows = [(None, "a\nb\n", 1, "x"), (5, "a\nb\n", 2, "y"), (5, "a\nb\n", 2, "y"), (6, None, 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N int, ends string")
    got = fill_middle.transform(df).collect()
    assert len(got) == 4 and sorted(r["ends"] for r in got) == ["x", "y", "y", "z"]
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == cut_by_words(r["doc_id"], r["text"])
    assert {r["form"] for r in fill_middle.transform(df, fim_rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fill_middle.transform(df, spm_rate=100).collect()} == {"plain", "spm"}
    assert fill_middle.transform(df.limit(0)).count() == 0
    back = fill_middle.transform(df).select("text", fill_middle.restored(F.col("output"), F.col("form")).alias("b")).collect()
    assert all(r["b"] == (r["text"] or "") for r in back)


def runs_by_force(w, least):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)  # a range's least period comes first
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def sequence(rng):
    n, k = rng.randrange(0, 90), rng.choice([1, 2, 3, 5, 40])
    out = [b"%d" % rng.randrange(k) for _ in range(n)]
    if n > 4 and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(2, 8)
        out = [out[i] if i < a else out[a + (i - a) % p] for i in range(n)]
    return out * rng.choice([1, 1, 1, 2, 3])


@pytest.mark.parametrize("least", [2, 3, 5, 12])
def test_all_runs_are_found(least, monkeypatch):
    rng = random.Random(least)
    found = copies = 0
    inner = periodic_runs.with_copies

    def counted(runs, *rest):
        nonlocal copies
        out = inner(runs, *rest)
        copies += len(out) - len(runs)
        return out

    monkeypatch.setattr(periodic_runs, "with_copies", counted)
    monkeypatch.setattr(periodic_runs, "PAIRS", 50)
    for _ in range(300):
        documents = [sequence(rng) for _ in range(rng.randrange(1, 6))]
        want = [runs_by_force(d, least) for d in documents]
        assert periodic_runs.runs_of(documents, least) == want
        found += sum(map(len, want))
    assert found > 100 and copies > 0


def test_suffix_array_and_previous_factors():
    rng = random.Random(8)
    for _ in range(60):
        d = sequence(rng) or [b"x"]
        codes, n = np.unique(d, return_inverse=True)[1].astype(np.int64), len(d)
        s = periodic_runs.Suffixes(codes, np.zeros(n, np.int64), np.full(n, n))
        order = sorted(range(n), key=lambda i: codes[i:].tolist())
        assert s.sa.tolist() == order
        match = lambda i, j: next((k for k in range(n - j) if codes[i + k] != codes[j + k]), n - j)  # noqa: E731, B023
        assert s.lcp()[order[1:]].tolist() == [match(min(a, b), max(a, b)) for a, b in zip(order, order[1:])]
        length, source = s.previous(s.sa)
        assert length.tolist() == [max((match(i, j) for i in range(j)), default=0) for j in range(n)]
        assert all(match(source[j], j) == length[j] for j in range(n) if length[j])


def test_periodic_runs_query(spark, tables):
    folder, rows = tables
    got = by_id(queries.op13_periodic_runs(spark, folder))
    edits = some = 0
    for i, x in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode())
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, edits = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)], edits + 1
        runs = runs_by_force(w, 12)
        some += bool(runs)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        want = {"doc_id": i, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2] if runs else None}
        want["runs_sha256"] = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        want["collapsed_sha256"] = hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
        assert got[i] == want, x
    assert edits > 40 and some > 60


def test_periodic_runs_of_odd_rows(spark):
    df = spark.createDataFrame([(None, None, "a"), (1, "x " * 30, "b"), (1, "x " * 30, "b"), (2, "", "c")], "doc_id long, text string, runs string")
    got = df.select("doc_id", "runs", periodic_runs.analysed(F.col("text")).alias("r")).collect()
    assert [(r["r"]["n_words"], [tuple(x) for x in r["r"]["runs"]], r["r"]["collapsed"]) for r in got] == [(0, [], ""), (30, [(0, 30, 1)], "x"), (30, [(0, 30, 1)], "x"), (0, [], "")]
    assert df.limit(0).select(periodic_runs.analysed(F.col("text")).alias("r")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.runs_of([[b"a"]], 1)


@pytest.mark.parametrize("name", ["op11_token_counts", "op12_fill_middle", "op13_periodic_runs"])
def test_queries_on_an_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
