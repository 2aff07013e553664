"""The corpus operators against brute force and on odd rows: nulls, empty and long texts, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import unicodedata
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wavelake.llm import bitpack, chaining, chosen_path, embed_dedup, langid, mixing, syncmers, toxicity, unigram_codec, warc
from wavelake.llm.common import components, scratch

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  two  spaces\n \n x\t y  ", "a <|endoftext|> b", "中文 текст ▁literal ▁", "😀 emoji", "x" * 5000, "word " * 3000]
SCHEMA = "doc_id long, text string, lang string, source string, score string, _rank int, slot int"


def docs(spark, rows):
    return spark.createDataFrame([(i, x, "en", "s", "own", 1, 2) for i, x in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def groups(links, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)] + [(None, 3), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups([(a, b) for a, b in links if a is not None and a != b], {x for p in links for x in p if x is not None})
    assert got == {i: c for i, c in want.items() if i in got}
    assert set(got) == {x for a, b in links if a is not None and a != b for x in (a, b)}


def test_toxicity_learns_and_scores(spark):
    rng = random.Random(1)
    rows = [(i, " ".join([*words(rng, 30), "vile"] if i % 5 == 0 else words(rng, 30))) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 300, 2)] + [(0, 1, None)], "doc_id long, quality int, toxic int")
    table = docs(spark, rows + [(1000 + i, x) for i, x in enumerate(ODD)])
    got = table.select("doc_id", toxicity.score(F.col("text"), toxicity.fit(table, labels)).alias("p")).toPandas().set_index("doc_id")["p"]
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(300))
    assert got.between(0, 1).all() and got[1000] == got[1001] < 0.5


def test_toxicity_risk_and_slopes():
    rng = np.random.default_rng(15)
    for prior, shift in ((0.3, 0.0), (0.9, -4.0)):
        fp, fu = rng.normal(size=7), rng.normal(size=11) + shift

        def total(fp, fu):
            loss = lambda z: np.log1p(np.exp(-z))
            plus, minus = prior * loss(fp).mean(), loss(-fu).mean() - prior * loss(-fp).mean()
            assert np.allclose((plus, minus), toxicity.risk(fp, fu, prior))
            return plus + minus if minus >= 0 else -minus

        gp, gu = toxicity.slopes(fp, fu, prior)
        for g, x, at in ((gp, fp, 0), (gu, fu, 1)):
            for i in range(len(x)):
                up, down = [fp.copy(), fu.copy()], [fp.copy(), fu.copy()]
                up[at][i] += 1e-5
                down[at][i] -= 1e-5
                assert abs((total(*up) - total(*down)) / 2e-5 - g[i]) < 1e-6
    assert toxicity.risk(fp, fu, 0.9)[1] < 0  # the second case took the reversed step


def test_toxicity_without_positives(spark):
    table = docs(spark, [(1, "a b")])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(table, labels) is None
    assert [r["p"] for r in table.select(toxicity.score(F.col("text"), None).alias("p")).collect()] == [0.0]
    assert table.limit(0).select(toxicity.score(F.col("text"), None).alias("p")).count() == 0


def test_forward_sums_all_segmentations():
    lattice = langid.Lattice(PIECES)
    p = np.random.default_rng(0).random((lattice.size, 3))
    p /= p.sum(0)

    def brute(w):
        sums = [np.ones(3)] + [np.zeros(3) for _ in w]
        for e in range(1, len(w) + 1):
            for s in range(e):
                if w[s:e] in lattice.ids:
                    sums[e] = sums[e] + sums[s] * p[lattice.ids[w[s:e]]]
            if w[e - 1] not in lattice.ids:
                sums[e] = sums[e] + sums[e - 1] * p[lattice.bytes[np.frombuffer(w[e - 1].encode(), np.uint8)]].prod(0)
        return np.log(sums[-1])

    tested = ["▁the", "▁wörldß", "▁中文字", "▁𐌰𐌱x", "▁internationalisation", "▁a"]
    assert np.allclose(lattice.likelihood(tested, p), [brute(w) for w in tested])
    # a run longer than a window: the sums are carried on
    long = "▁" + "".join(random.Random(1).choice("abehint") for _ in range(2 * langid.WINDOW + 77))
    assert np.allclose(lattice.likelihood([long], p), [lattice.forward([long], lattice.places([long]), p)[-1, 0]])


def test_expected_counts_are_over_all_segmentations():
    lattice = langid.Lattice(PIECES)

    def cuts(w):
        if not w:
            yield []
        for e in range(1, len(w) + 1):
            if w[:e] in lattice.ids:
                yield from ([lattice.ids[w[:e]], *rest] for rest in cuts(w[e:]))
        if w and w[0] not in lattice.ids:
            yield from ([*lattice.bytes[np.frombuffer(w[0].encode(), np.uint8)], *rest] for rest in cuts(w[1:]))

    words = ["▁cat", "▁there", "▁wörld", "▁a", "▁𐌰b"]
    got = np.zeros((len(words), lattice.size))
    for rows, ids, w in lattice.expected(words):
        np.add.at(got, (rows, ids), w)
    for i, word in enumerate(words):
        want, total = np.zeros(lattice.size), 0.0
        for path in cuts(word):
            weight = float(lattice.size) ** -len(path)
            total += weight
            np.add.at(want, path, weight)
        assert np.allclose(got[i], want / total), word


def test_letters_are_category_l():
    assert langid.words_of("½² Ⅷ ٣ 12 _ a½b Ça 中文² ªº") == ["a", "b", "ça", "中文", "ªº"]
    letters = [c for c in map(chr, range(0x110000)) if unicodedata.category(c).startswith("L")]
    assert "".join(langid.words_of(" ".join(letters))) == "".join(c for c in "".join(letters).lower() if c.isalpha())
    assert not langid.words_of(" ".join(c for c in map(chr, range(0x110000)) if not c.isalpha() and not 0xD800 <= ord(c) < 0xE000 and not c.lower().isalpha()))


def test_language_id(spark):
    rng = random.Random(2)
    pool = {"en": "the and of ing tion with that".split(), "de": "der und ung schaft mit nicht zu".split()}
    rows = [(i, " ".join(rng.choice(pool[lang]) for _ in range(40)), lang) for i, lang in enumerate(["en", "de"] * 40)]
    table = spark.createDataFrame([*rows, (900, "the and of", None), (901, None, "en")], "doc_id long, text string, lang string")
    model = langid.fit(table, PIECES)
    assert model[0] == ["de", "en"]
    odd = docs(spark, list(enumerate(ODD)) + [(100, "123 !!")])
    got = table.select("doc_id", langid.predict(F.col("text"), model, PIECES).alias("p")).select("doc_id", "p.*").toPandas().set_index("doc_id")
    assert all(got.lang_pred[i] == lang for i, _, lang in rows) and got.lang_pred[901] == "und" and got.score.between(0, 1).all()
    out = odd.select("doc_id", langid.predict(F.col("text"), model, PIECES).alias("p")).select("doc_id", "p.*").toPandas().set_index("doc_id")
    assert [i for i in out.index if out.lang_pred[i] == "und"] == [0, 1, 2, 100] and out.score[0] == 0
    none = langid.fit(table.limit(0), PIECES)
    assert {r["p"]["lang_pred"] for r in odd.select(langid.predict(F.col("text"), none, PIECES).alias("p")).collect()} == {"und"}


def test_syncmers(spark):
    rng = random.Random(4)
    texts = [" ".join(words(rng, rng.randrange(2, 80))) for _ in range(60)] + ["same text here twice"] * 2 + ["", "a", "😀😀😀 x"]
    rows = list(enumerate(texts))
    got = syncmers.edited(docs(spark, [*rows, (None, "no id")])).toPandas().set_index("doc_id")
    for at, (i, x) in enumerate(rows):
        nxt = rows[at - 1][1]
        half = len(x) // 2
        edited = x[: len(x) - half] + nxt[:half]
        assert got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest() and got.n_chars[i] == len(x)
    assert got.fingerprint[60] == got.fingerprint[61] and got.near_next[61] == 1
    assert got.near_edited.between(0, 1).all() and got.near_edited.loc[:59].mean() > 10 * got.near_next.loc[:59].mean()
    assert syncmers.edited(docs(spark, [])).count() == 0
    assert syncmers.edited(docs(spark, [(1, "a b c d e"), (1, "a b c d e"), (2, None)])).count() == 3


def test_syncmers_are_closed_and_context_free(spark):
    rng = random.Random(14)
    texts = [" ".join(words(rng, 60)), "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(80)), "aB3/" * 3 + "x9Z=" + "q1,w2;e3 r4(t5)"]
    table = spark.createDataFrame([(x,) for x in texts], "text string")
    runs = table.select(syncmers._runs(syncmers.symbols(F.col("text")), syncmers.S).alias("h"), syncmers.positions(F.col("text")).alias("p"), syncmers.anchors(F.col("text")).alias("a")).collect()
    inner = syncmers.K - syncmers.S + 1
    for r in runs:
        h = r["h"]
        want = [i for i in range(len(h) - inner + 1) if min(h[i], h[i + inner - 1]) == min(h[i : i + inner])]
        assert [x["at"] for x in r["p"]] == want and [x["value"] for x in r["p"]] == r["a"]
    # a passage keeps its anchors wherever it stands, in scripts without spaces too, but for those that reach over its ends
    for x in texts[:2]:
        for before in ("", "two words ", "一二三 "):
            got = spark.createDataFrame([(before + x + " end",)], "text string").select(syncmers.anchors(F.col("text"))).first()[0]
            own = next(r["a"] for r, t in zip(runs, texts, strict=True) if t == x)
            assert set(own) <= set(got)
    far = [texts[1][:40] + "一" + texts[1][40:]]
    got = set(spark.createDataFrame([(x,) for x in far], "text string").select(syncmers.anchors(F.col("text"))).first()[0])
    assert len(got & set(runs[1]["a"])) > 0.8 * len(set(runs[1]["a"]))


def test_warc_round_trip(spark):
    warc.register(spark)
    rows = [(1, "http://a", "x" * 100), (2, "http://b", "x" * 100), (3, None, ""), (4, "u\r\nv", None), (5, "http://c", "é" * 70000), (None, "n", "x" * 100), (2, "http://b", "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    path = scratch(spark, "warc")
    warc.planned(pages).write.format("warc").option("path", path).mode("append").save()
    back = spark.read.format("warc").option("path", path).load()
    got = back.select(warc.page_of(F.col("record_id")).alias("p"), "*").toPandas()
    assert len(got) == 7
    kinds = {None if math.isnan(p) else int(p): k for p, k in zip(got.p, got.record_type, strict=True)}
    assert kinds == {1: "revisit", 2: "response", 3: "revisit", 4: "response", 5: "response", None: "revisit"}
    five = got[got.p == 5].iloc[0]
    assert bytes(five.payload).decode() == "é" * 70000 and five.payload_bytes == 140000 and five.payload_digest == warc.digest(("é" * 70000).encode())
    assert got[got.p == 1].payload_bytes.iloc[0] == 100 and got[got.p == 1].refers_to.iloc[0] == "<urn:page:2>"
    one = back.where("record_type = 'revisit'").where(F.col("refers_to").isin("<urn:page:4>"))
    assert [r["record_id"] for r in one.collect()] == ["<urn:page:3>"]
    empty = scratch(spark, "warc")
    warc.planned(pages.limit(0)).write.format("warc").option("path", empty).mode("append").save()
    assert spark.read.format("warc").option("path", empty).load().count() == 0


def test_mixing_follows_brute_force(spark):
    def brute(blocks, weights):
        left, order = {s: n for s, n in sorted(blocks.items()) if n}, []
        done = dict.fromkeys(left, 0)
        while left:
            total, c, t, over = sum(weights[s] for s in left), dict.fromkeys(left, 0), 0, False
            while not over:
                due, _, s = min((-(-(c[s] + 1) * total // weights[s]), i, s) for i, s in enumerate(left) if c[s] * total // weights[s] <= t)
                assert due > t
                order.append((s, done[s] + c[s]))
                c[s] += 1
                t += 1
                assert all(abs(c[x] - weights[x] * t / total) < 1 for x in left)
                over = c[s] == left[s]
            for x in c:
                done[x] += c[x]
                left[x] -= c[x]
            left = {s: n for s, n in left.items() if n}
        return order

    rng = random.Random(5)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None]), 0) for i in range(2000)] + [(5, "a", 0), (None, "b", 0)]
    table = spark.createDataFrame(rows, "doc_id long, source string, slot int")
    for weights in (None, {"a": 3, "b": 17, "c": 5, mixing.NO_SOURCE: 2}):
        got = mixing.mix(table, weights, block=7, names=("block", "at", "position")).toPandas()
        counts = got.source.fillna(mixing.NO_SOURCE).value_counts().to_dict()
        assert len(got) == got.position.nunique() == 2002
        by = got.assign(source=got.source.fillna(mixing.NO_SOURCE)).groupby("at").agg(source=("source", "first"), block=("block", "first"), n=("source", "nunique"))
        assert (by.n == 1).all()
        assert list(zip(by.source, by.block, strict=True)) == brute({s: -(-n // 7) for s, n in counts.items()}, weights or mixing.tempered(counts))
    assert mixing.mix(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(table, {"a": 1})


def test_mixing_keeps_clashing_columns_and_long_periods(spark):
    table = spark.createDataFrame([(i % 50, "ab"[i % 3 == 0], i, i, i, i) for i in range(300)], "doc_id long, source string, block int, _pf int, mix_rank int, position int")
    out = mixing.mix(table, {"a": 20011, "b": 9973}, block=1)
    assert out.columns == [*table.columns, "_block", "slot", "_position"]
    got = out.toPandas()
    assert sorted(got["mix_rank"]) == list(range(300)) and (got["block"] == got["mix_rank"]).all() and sorted(got["_position"]) == list(range(300))
    ahead = got.sort_values("_position")["source"].eq("b").cumsum().to_numpy()[:250] - np.arange(1, 251) * 9973 / 29984
    assert (abs(ahead) < 1).all()
    assert mixing.mix(table, {"a": 2 * 10**9, "b": 10**9}, block=1).count() == 300


@pytest.mark.parametrize("width", [1, 7, 15, 16, 17, 31])
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 10000)
    assert (bitpack.unpack(bitpack.pack(ids, width), width, len(ids)) == ids).all()


def test_packed_files(spark, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)  # untouched: `<|endoftext|>` in a text is its id
    rng = random.Random(6)
    odd = [*ODD, "<|endoftext|>", "<|endoftext|><|endoftext|> x", " lead\t <|endoftext|>  \n trail ", "a\x1c b \x85 c\u00a0 d \u3000e \u2003", "it's  we'll\n\n x,y;z 3.14 ½²"]
    rows = [(i, " ".join(words(rng, 300))) for i in range(40)] + [(100 + i, x) for i, x in enumerate(odd)]
    table = docs(spark, rows).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    spark.dataSource.register(bitpack.PackedIds)
    for vocabulary in (50257, 100000):
        path = f"file://{tmp_path}/{vocabulary}"
        # encoded by the writer, or before it
        source = table.select("doc_id", "text") if vocabulary == 50257 else table.select("doc_id", bitpack.encoded(F.col("text"), BYTES, 2).alias("ids"))
        source.write.format("packed_ids").options(path=path, vocabulary=vocabulary, file_tokens=5000, **({"tokenizer": BYTES, "end_id": 2} if vocabulary == 50257 else {})).mode("append").save()
        crc = spark.read.format("packed_ids").option("ids", "crc32").load(path).select(F.col("start").alias("at"), "ids_crc32")
        got = spark.read.format("packed_ids").load(path).join(crc, F.col("start") == F.col("at")).orderBy("start").toPandas()
        start = 0
        for (i, x), r in zip(sorted(rows), got.itertuples(), strict=True):
            ids = [*lib.encode(x or "", add_special_tokens=False).ids, 2]
            assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (i, start, len(ids), ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)
    files = list(tmp_path.joinpath("100000").glob("*.bpk"))
    assert len(files) > 3  # rolled by size
    with bitpack.PackedFile(f"file://{max(files, key=lambda f: f.stat().st_size)}") as f:
        whole = f.ids(0, f.head["tokens"])
        assert len(whole) > 4500 and (f.ids(4000, 4500) == whole[4000:4500]).all()
    none = f"file://{tmp_path}/none"
    table.limit(0).select("doc_id", "text").write.format("packed_ids").options(path=none, vocabulary=9, tokenizer=BYTES).mode("append").save()
    assert spark.read.format("packed_ids").load(none).count() == 0


def test_packed_files_append_and_overwrite(spark, tmp_path):
    spark.dataSource.register(bitpack.PackedIds)
    path = f"file://{tmp_path}/ids"

    def save(ids, mode):
        table = spark.createDataFrame([(i, [i, 7]) for i in ids], "doc_id long, ids array<int>").coalesce(2)
        table.write.format("packed_ids").options(path=path, vocabulary=1000).mode(mode).save()

    def load():
        return [(r["doc_id"], r["start"], list(r["ids"])) for r in spark.read.format("packed_ids").load(path).orderBy("start").collect()]

    save(range(6), "append")
    save(range(10, 16), "append")
    rows = load()
    assert [r[0] for r in rows] == [*range(6), *range(10, 16)] and [r[1] for r in rows] == list(range(0, 24, 2)) and all(r[2] == [r[0], 7] for r in rows)
    save([None, 5, 5], "overwrite")
    assert sorted(load(), key=str) == sorted([(None, load()[0][1], load()[0][2]), *load()[1:]], key=str) and len(load()) == 3
    assert len(list((tmp_path / "ids").glob("*.bpk"))) <= 2


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_join_finds_all_links(spark):
    rng = random.Random(7)
    base = [words(rng, rng.randrange(3, 150), 3000) for _ in range(80)]
    rows = []
    for i in range(500):
        w = list(base[i % 80] if i % 3 else base[0])
        for _ in range(rng.randrange(0, 4)):
            if w:
                w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, x) for i, x in enumerate(ODD)] + [(3, rows[3][1]), (None, "a b c d e f")]
    got = chosen_path.join(docs(spark, rows)).toPandas()
    assert len(got) == len(rows)
    keep = [(i, x) for i, x in rows if i is not None and x and x.strip()]
    sets = []
    for _, x in keep:
        w = x.lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))})
    links = [(i, j) for i in range(len(keep)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    n = np.zeros(len(keep), int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    classes = groups([(keep[a][0], keep[b][0]) for a, b in links if keep[a][0] != keep[b][0]], {i for i, _ in keep})
    want = sorted((i, classes[i], int(m)) for (i, _), m in zip(keep, n, strict=True))
    quiet = [(int(r.doc_id), int(r.class_id), r.n_links) for r in got.itertuples() if not math.isnan(r.doc_id)]
    assert sorted(x for x in quiet if x[0] in classes) == want
    assert all(x[2] == 0 and x[0] == x[1] for x in quiet if x[0] not in classes)
    assert chosen_path.join(docs(spark, [])).count() == 0


def test_join_in_deep_nodes(spark):
    """Texts made mostly of one frequent passage: large nodes of texts that aren't alike, with alike pairs among them."""
    rng = random.Random(17)
    common = words(rng, 90, 10**6)
    rows, pairs = [], []
    for i in range(0, 1400, 2):
        own = words(rng, 80, 10**6)
        rows.append((i, common + own))
        if i % 20 == 0:
            w = common + own
            for _ in range(2):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((i + 1, w))
            pairs.append((i, i + 1))
    got = {r["doc_id"]: r["class_id"] for r in chosen_path.join(docs(spark, [(i, " ".join(w)) for i, w in rows])).collect()}
    alike = [(a, b) for a, b in pairs if jaccard(*({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (dict(rows)[a], dict(rows)[b]))) >= 0.8]
    assert len(alike) > 60 and sum(got[a] == got[b] for a, b in alike) >= 0.99 * len(alike)
    assert sum(c != i for i, c in got.items()) <= len(pairs)


def test_join_leaves_large_groups_early(spark, monkeypatch):
    """A large group of near copies beside texts that share much with it but aren't alike: the rows of its walk stay few, and no group is missed."""
    rng = random.Random(23)
    base = words(rng, 120, 10**6)
    texts = []
    for i in range(240):
        w = list(base)
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(w)
    apart = [base[:80] + words(rng, 40, 10**6) for _ in range(6)]  # alike to the group by about a half
    texts += apart + [[*w[:-1], "other"] for w in apart]
    sketches = [(i, bytearray(chosen_path.planes(chosen_path.sketch(chosen_path.shingle_set(" ".join(w), 5))))) for i, w in enumerate(texts)]
    made = {}

    def counted(df, name, f=chosen_path.written):
        out = f(df, name)
        made[name] = made.get(name, 0) + out[0].count()
        return out

    monkeypatch.setattr(chosen_path, "written", counted)
    got = {r["node"]: r["component"] for r in chosen_path.candidates(spark.createDataFrame(sketches, "cls long, sketch binary"), 0.8, 0.99, small=16, depth=6).collect()}
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert len(alike) > 1000 and sum(got.get(i) == got.get(j) for i, j in alike) >= 0.99 * len(alike)
    print("rows made", made)
    assert made["links"] <= 16 * len(texts) and made["nodes"] <= 120 * len(texts), made


def test_codec_is_viterbi_and_lossless(spark):
    pieces, scores, trie = unigram_codec.Codec.load(PIECES)
    codec = unigram_codec.Codec(pieces, scores, trie)
    ids = {p: i for i, p in enumerate(pieces) if scores[i] > -np.inf}

    def best(text):
        text = "▁" + text.replace(" ", "▁")
        at = [0.0] + [-np.inf] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(max(0, e - 16), e):
                if (i := ids.get(text[s:e])) is not None:
                    at[e] = max(at[e], at[s] + scores[i])
            if text[e - 1] not in ids:
                at[e] = max(at[e], at[e - 1] + codec.poor)
        return at[-1]

    for x in ["hello world", "internationalisation of the, thing.\nNext", "naïve ñandú 中文 ok", "thethethe andand"]:
        got = np.frombuffer(codec.encode(x), np.int32)
        known = sum(scores[i] for i in got if scores[i] > -np.inf)
        spelt = sum(1 for i in got if (m := unigram_codec.BYTE.fullmatch(pieces[i])) and int(m[1], 16) & 0xC0 != 0x80)
        assert abs(known + spelt * codec.poor - best(x)) < 1e-6
    parts = (pieces, scores, trie)
    table = docs(spark, list(enumerate(ODD)))
    out = table.withColumn("ids", unigram_codec.encoded(F.col("text"), parts)).withColumn("back", unigram_codec.decoded(F.col("ids"), parts)).toPandas()
    assert list(out.back) == [x or "" for x in ODD]
    assert table.limit(0).select(unigram_codec.encoded(F.col("text"), parts).alias("i")).count() == 0


@pytest.mark.parametrize("cell_rows", [4096, 60])
def test_embedding_dedup(spark, cell_rows):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        v = rng.normal(size=8)
        if i % 4 == 0:
            v = np.ones(8) + 0.25 * rng.normal(size=8)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 3)))
    rows += [(500, rows[0][1], 0), (501, rows[0][1], None), (502, None, 1), (503, [0.0] * 8, 1), (504, [float("nan")] * 8, 1), (505, [1.0, None], 1), (506, [], 1), (507, [1.0] * 4, 1)]
    got = embed_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)), cell_rows=cell_rows, block=32).toPandas().set_index("vec_id")
    good = [(i, np.array(v, float), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for i, (a, x, y) in enumerate(good) for b, z, w in good[:i] if y == w and len(x) == len(z) and x @ z / np.sqrt((x @ x) * (z @ z)) >= 0.93]
    n = dict.fromkeys(got.index, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    want = groups(links, list(got.index))
    assert got.n_links.to_dict() == n and got.component_id.to_dict() == want
    assert got.kept.to_dict() == {i: c == i for i, c in want.items()}
    # an id on different vectors: each row is a vector of its own
    x, y = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    again = spark.createDataFrame([(5, x, 1), (5, y, 1), (6, [1.0, 0.01, 0.2], 1), (7, y, 1), (8, y, 1), (8, [0.01, 1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.dedup(again).collect())
    assert got == [(5, 1, 5), (5, 3, 5), (6, 1, 5), (7, 3, 5), (8, 3, 5), (8, 3, 5)]
    assert embed_dedup.dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_chaining_finds_fuzzy_passages(spark):
    rng = random.Random(9)
    passage = words(rng, 60, 5000)
    rows = []
    for i in range(60):
        w = words(rng, 200, 5000)
        if i % 3 == 0:
            p = list(passage)
            if i % 2:
                p[20], p[41] = "zz", "yy"
            w[50:50] = p
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, x) for i, x in enumerate(ODD)]
    table = docs(spark, rows)
    found = chaining.find(table)
    got = found.toPandas()
    assert set(got.doc_id) == set(range(3, 60, 3)) and (got.start == 50).all() and (got.end == 110).all() and (got.ref_id < got.doc_id).all()
    cut = chaining.without(table, found).toPandas().set_index("doc_id")
    assert len(cut) == len(rows) and list(cut.columns) == table.columns[1:]
    for i, x in rows:
        want = x
        if i in set(got.doc_id):
            w = x.split(" ")
            want = " ".join(w[:50]) + " " + " " + " ".join(w[110:])
        assert cut.text[i] == want
    assert chaining.find(table.limit(0)).count() == 0


def test_chaining_finds_passages_of_pieces_seen_earlier(spark):
    rng = random.Random(12)
    rows, copies = [], {}
    for case, n in enumerate((1, 2, 3, 5, 8, 12)):  # pieces of 60, 30, 20, 12, 7 and 5 words, each first in a document of its own
        base, whole = 100 * case, words(rng, 60, 10**6)
        size = 60 // n
        for i in range(n):
            rows.append((base + i, words(rng, 60, 10**6) + whole[i * size : 60 if i == n - 1 else (i + 1) * size] + words(rng, 60, 10**6)))
        for i in range(3):
            rows.append((base + 50 + i, words(rng, 30 + 10 * i, 10**6) + whole + words(rng, 40, 10**6)))
            copies[base + 50 + i] = (30 + 10 * i, 90 + 10 * i)
    # a passage whose last 200 words are common elsewhere is not cut short
    long = words(rng, 260, 10**6)
    rows += [(900, long[60:]), (901, words(rng, 50, 10**6) + long), (902, words(rng, 70, 10**6) + long)]
    copies |= {902: (70, 330)}
    found = chaining.find(docs(spark, [(i, " ".join(w)) for i, w in rows])).toPandas()
    by = dict(rows)
    for i, (start, end) in copies.items():
        mine = found[(found.doc_id == i) & (found.start == start) & (found.end == end)]
        first = i % 100 == 50 and i // 100 > 0  # the first whole copy has no earlier one
        assert len(mine) == (0 if first else 1), (i, found[found.doc_id == i])
    for r in found.itertuples():
        assert r.ref_id < r.doc_id and by[r.doc_id][r.start : r.end] == by[r.ref_id][r.ref_start : r.ref_end]


def test_chaining_covers_exact_runs_and_finds_edited_ones(spark):
    rng = random.Random(16)
    pool = [words(rng, 40 + 15 * i, 10**6) for i in range(8)]  # passages of 40 to 145 words
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += words(rng, rng.randrange(0, 40), 10**6)
            p = rng.choice(pool)
            a, b = sorted((rng.randrange(0, len(p) // 2), rng.randrange(len(p) // 2, len(p) + 1)))
            w += p[a:b] if rng.random() < 0.5 else p
        rows.append((i, w))
    found = chaining.find(docs(spark, [(i, " ".join(w)) for i, w in rows])).toPandas()
    by = dict(rows)
    for r in found.itertuples():  # every row is what it says
        assert r.ref_id < r.doc_id and by[r.doc_id][r.start : r.end][:1] == by[r.ref_id][r.ref_start : r.ref_end][:1]
    covered = {i: np.zeros(len(w), bool) for i, w in rows}
    for r in found.itertuples():
        covered[r.doc_id][r.start : r.end] = True
    seen: set = set()
    for i, w in rows:  # by force: the words of all runs of 50 that an earlier document holds
        runs = [j for j in range(len(w) - 49) if tuple(w[j : j + 50]) in seen]
        need = np.zeros(len(w), bool)
        for j in runs:
            need[j : j + 50] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], need.astype(int), [0]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            assert covered[i][a + 10 : b - 10].all(), (i, a, b)
        seen |= {tuple(w[j : j + 50]) for j in range(len(w) - 49)}
    # passages of 100 words with a share of them changed
    base, recall = words(rng, 100, 10**6), {}
    for share in (0.05, 0.1, 0.15, 0.2):
        rows = [(0, base + words(rng, 50, 10**6))]
        for i in range(1, 61):
            w = [f"x{rng.randrange(10**6)}" if rng.random() < share else x for x in base]
            rows.append((i, words(rng, 30, 10**6) + w + words(rng, 30, 10**6)))
        got = chaining.find(docs(spark, [(i, " ".join(w)) for i, w in rows])).toPandas()
        best = {i: 0 for i in range(1, 61)}
        for r in got.itertuples():
            best[r.doc_id] = max(best[r.doc_id], min(r.end, 130) - max(r.start, 30))
        recall[share] = np.mean([b >= 50 for b in best.values()])
    print("recall by share of words changed", recall)
    assert recall[0.05] == 1 and recall[0.1] > 0.95 and recall[0.15] > 0.7


def test_chaining_reports_every_shift_and_every_reference(spark):
    rng = random.Random(21)
    line, other, tail = words(rng, 12, 10**6), words(rng, 30, 10**6), words(rng, 120, 10**6)
    rows = [(0, words(rng, 60, 10**6) + line * 5 + words(rng, 60, 10**6)), (1, words(rng, 50, 10**6) + line * 9 + words(rng, 50, 10**6))]
    # a copy with a miss or two after every few words agrees by a slowly sinking score, however its slices are cut
    slow = [w if i % 4 else f"y{i}" for i, w in enumerate(tail)]
    rows += [(2, words(rng, 60, 10**6) + other + other[::-1] + tail), (3, words(rng, 70, 10**6) + other + other[::-1] + slow)]
    found = chaining.find(docs(spark, [(i, " ".join(w)) for i, w in rows])).toPandas()
    mine = found[(found.doc_id == 1) & (found.identity == 1)]
    want = {(50 + 12 * i, 50 + 12 * i + min(60, 108 - 12 * i), 60) for i in range(6)}  # the line's copies here against those there
    got = set(zip(mine.start, mine.end, mine.ref_start, strict=True))
    assert want <= got, (sorted(want - got), sorted(got))
    one = found[found.doc_id == 3]
    edges = [(r.start, r.end) for r in one.itertuples()]
    score, top, best, wide = 0, 0, 0, 70 + 60
    for i, (x, y) in enumerate(zip(rows[3][1][wide:], rows[2][1][wide - 10 :], strict=True)):
        score += 1 if x == y else -2
        if score > top:
            top, best = score, i + 1
        if score < top - 6:
            break
    assert edges == [(70, wide + best)], (edges, best)


def test_chaining_reports_the_good_parts_of_a_poor_alignment(spark):
    rng = random.Random(33)

    def edited(w, every):
        return [x if i % every else f"y{rng.randrange(10**6)}" for i, x in enumerate(w)]

    rows, want = [], {}
    for case, gap in enumerate((26, 29)):  # exact runs of 50 words with as many other words between them in both texts
        a, b = words(rng, 50, 10**6), words(rng, 50, 10**6)
        rows += [(10 * case + i, words(rng, 30 + i, 10**6) + a + words(rng, gap, 10**6) + b + words(rng, 30, 10**6)) for i in range(2)]
        want[10 * case + 1] = [(31, 81), (81 + gap, 131 + gap)]
    a, tail = words(rng, 60, 10**6), words(rng, 600, 10**6)  # a run before a long text that is too unlike
    rows += [(30, a + tail), (31, words(rng, 40, 10**6) + a + edited(tail, 4))]
    a, b = words(rng, 45, 10**6), words(rng, 45, 10**6)  # words left out between, with other words
    rows += [(40, a + words(rng, 28, 10**6) + b), (41, words(rng, 9, 10**6) + a + words(rng, 22, 10**6) + b)]
    want[41] = [(9, 54), (76, 121)]
    found = chaining.find(docs(spark, [(i, " ".join(w)) for i, w in rows])).toPandas()
    for i, spans in want.items():
        assert sorted(zip(found[found.doc_id == i].start, found[found.doc_id == i].end, strict=True)) == spans, (i, found[found.doc_id == i])
    assert any(r.start <= 40 and r.end >= 100 for r in found[found.doc_id == 31].itertuples())
    by = dict(rows)
    for r in found.itertuples():
        assert r.identity >= 0.8 and r.end - r.start >= 40
        if r.identity == 1:
            assert by[r.doc_id][r.start : r.end] == by[r.ref_id][r.ref_start : r.ref_end]


def test_chaining_extends_over_words_left_out_and_put_in(spark, monkeypatch):
    rng = random.Random(41)
    rows, want = [], {}
    for case in range(40):  # 22 equal words, and on either side four differences, each a word left out, put in or changed
        w = words(rng, 60, 10**6)
        copy = list(w)
        for at in (56, 52, 48, 44, 17, 13, 9, 5):
            how = rng.randrange(3)
            copy[at : at + (how != 1)] = [] if how == 0 else [f"y{rng.randrange(10**6)}"]
        rows += [(2 * case, words(rng, 30, 10**6) + w + words(rng, 30, 10**6)), (2 * case + 1, words(rng, 40, 10**6) + copy + words(rng, 35, 10**6))]
        want[2 * case + 1] = (40, 40 + len(copy))
    found = chaining.find(docs(spark, [(i, " ".join(w)) for i, w in rows])).toPandas()
    by = dict(rows)
    whole = {r.doc_id for r in found.itertuples() if r.start <= want[r.doc_id][0] + 5 and r.end >= want[r.doc_id][1] - 5}
    assert len(whole) >= 32, len(whole)
    for r in found.itertuples():  # every row's identity is at most what edit distance over its words gives
        a, b = by[r.doc_id][r.start : r.end], by[r.ref_id][r.ref_start : r.ref_end]
        number = {x: i for i, x in enumerate({*a, *b})}
        exact = 1 - chaining.distance([number[x] for x in a], [number[x] for x in b]) / max(len(a), len(b))
        assert 0.8 <= r.identity <= exact + 1e-9
    # the extension against a whole table of scores
    for case in range(400):
        if case == 200:
            monkeypatch.setattr(chaining, "NEAR", 3)  # nearly all words lie beyond those compared one by one
        a = [rng.randrange(4) for _ in range(rng.randrange(18))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = [rng.randrange(4)] * rng.randrange(2)
        best = np.full((len(a) + 1, len(b) + 1), -np.inf)
        best[0, 0] = 0
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if i and j:
                    best[i, j] = best[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -2)
                best[i, j] = max(best[i, j], best[i - 1, j] - 2.5 if i else -np.inf, best[i, j - 1] - 2.5 if j else -np.inf)
        runs, more = chaining.extend(np.array(a, np.uint32), np.array(b, np.uint32), 10**6, (True, True))
        score, p, q = 0.0, 0, 0
        for x, y, z in runs:
            score += sum(1 if u == v else -2 for u, v in zip(a[x:y], b[z : z + y - x], strict=True)) - 2.5 * abs((x - p) - (z - q)) - 2 * min(x - p, z - q)
            assert x >= p and z >= q
            p, q = y, z + y - x
        assert abs(score - best.max()) < 1e-9 and not more


def test_chaining_finds_edited_passages_of_pieces_seen_earlier(spark):
    rng = random.Random(43)
    for size, least in ((10, 0.85), (20, 0.75)):
        rows, copies = [], []
        for _ in range(60):  # pieces first in documents of their own, then the whole, then a copy of it with three words changed
            w = words(rng, 60, 10**6)
            rows += [words(rng, 30, 10**6) + w[i : i + size] + words(rng, 30, 10**6) for i in range(0, 60, size)]
            rows.append(words(rng, 40, 10**6) + w + words(rng, 40, 10**6))
            for i in rng.sample(range(60), 3):
                w[i] = f"y{rng.randrange(10**6)}"
            copies.append(len(rows))
            rows.append(words(rng, 50, 10**6) + w + words(rng, 50, 10**6))
        found = chaining.find(docs(spark, [(i, " ".join(w)) for i, w in enumerate(rows)])).toPandas()
        assert (found.ref_id < found.doc_id).all()
        got = {r.doc_id for r in found.itertuples() if min(r.end, 110) - max(r.start, 50) >= 40}
        assert len(got & set(copies)) / len(copies) >= least, (size, len(got))


def test_chaining_keeps_text_hashes_beside_open_chains(spark):
    rng = random.Random(31)
    passage, part, tail = words(rng, 60, 10**6), words(rng, 90, 10**6), words(rng, 90, 10**6)
    # past the part, the copy agrees beyond its slices and has no seed, so this chain is read again beside one that is done
    slow = [w if i % 4 else f"y{i}" for i, w in enumerate(tail)]
    rows = [(0, words(rng, 40, 10**6) + passage + words(rng, 90, 10**6) + part + tail), (1, words(rng, 50, 10**6) + passage + words(rng, 70, 10**6) + part + slow)]
    table = docs(spark, [(i, " ".join(w)) for i, w in rows])
    found = chaining.find(table)
    hashes = {r["doc_id"]: r["t"] for r in table.select("doc_id", F.xxhash64("text").alias("t")).collect()}
    got = found.collect()
    assert len(got) == 2 and all(r["text_hash"] == hashes[r["doc_id"]] for r in got)
    left = {r["doc_id"]: r["text"] for r in chaining.without(table, found).collect()}
    assert " ".join(passage) in left[0] and " ".join(passage) not in left[1]


def test_chains_are_optimal_on_small_cases():
    rng = random.Random(10)
    for _ in range(60):
        seg = sorted((p, p + 5, q, q + 5) for p, q in ((rng.randrange(60), rng.randrange(60)) for _ in range(7)))
        n, cost = len(seg), 0.25
        best = []
        for i in range(n):
            s = 5.0
            for j in range(n):
                if seg[j][1] <= seg[i][0] and seg[j][3] <= seg[i][2] and j < i:
                    s = max(s, 5 + best[j] - cost * (seg[i][0] - seg[j][1] + seg[i][2] - seg[j][3]))
            best.append(s)
        first = chaining.chains(np.array(seg), cost, 10**6)[0]
        near = chaining.chains(np.array([(0, 200, 0, 200), (260, 265, 260, 265), (270, 290, 270, 290)]), cost, 30)
        assert sorted(near) == [[0], [1, 2]]  # the nearer predecessor, though a farther one scores more
        score = 5 * len(first) - sum(cost * (seg[b][0] - seg[a][1] + seg[b][2] - seg[a][3]) for a, b in zip(first, first[1:], strict=False))
        assert abs(score - max(best)) < 1e-9


def test_pipeline_stages(spark):
    import corpus_pipeline

    rng = random.Random(11)
    rows = [(i, " ".join(words(rng, 120, 4000)), "en", f"s{i % 3}", 0) for i in range(80)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, "%%% 123", "en", "s0", 0), (102, None, "en", None, 0), (103, "", None, "s1", 0)]
    passage = " ".join(words(rng, 70, 4000))
    rows += [(200 + i, passage + " " + " ".join(words(rng, 90, 4000)), "en", "s1", 0) for i in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept, sizes = table, []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, "")
        if stage is not corpus_pipeline.encode:
            assert out.columns == table.columns
            kept = spark.createDataFrame(out.collect(), table.schema)
        sizes.append(out.count())
    assert sizes == [84, 83, 83, 83, 83]
    # an id on two texts: the copy goes, the other stays; rows equal in id and text are one
    near = spark.createDataFrame([(1, rows[0][1], "en", "s", 0), (2, rows[0][1], "en", "s", 0), (2, rows[1][1], "en", "s", 0), (3, rows[2][1], "en", "s", 0), (3, rows[2][1], "en", "s", 0), (None, "x", "en", "s", 0)], table.schema)
    left = corpus_pipeline.near_duplicates(spark, near, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"][:9]) for r in left) == sorted([(0, "x"), (1, rows[0][1][:9]), (2, rows[1][1][:9]), (3, rows[2][1][:9])])
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert passage in texts[200] and passage not in texts[201] and 100 not in texts and 101 not in texts and 102 not in texts


def test_encoding_keeps_the_mixture_order(spark):
    import corpus_pipeline
    from wavelake.llm.common import written

    rows = [(i, "some text", "en", f"s{i % 3 and 1 + i % 2}", 9) for i in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    want = [r["doc_id"] for r in mixing.mix(table).orderBy("position").collect()]
    kept, _ = written(corpus_pipeline.mixture(spark, table, ""), "mixing")
    out = corpus_pipeline.encode(spark, kept, "")
    assert [r["doc_id"] for r in out.repartition(5).orderBy("position").collect()] == want


def test_language_id_keeps_three_byte_scripts(spark):
    rng = random.Random(13)
    rows = [(i, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60)), "zh") for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table, PIECES)
    guess = table.select(langid.predict(F.col("text"), model, PIECES).alias("p"))
    assert guess.where(F.col("p.nats_per_letter") < langid.FLOOR).count() > 70 and guess.where(langid.accepted(F.col("p"))).count() == 80


def test_warc_leaves_negated_predicates_to_spark():
    from pyspark.sql.datasource import EqualTo, Not

    reader = warc.Reader({"path": "/nowhere"})
    negated = Not(EqualTo(("record_type",), "revisit"))
    assert list(reader.pushFilters([negated, EqualTo(("record_type",), "response")])) == [negated]
    assert reader.tests == [("record_type", "in", ("response",))]


def pages_of(spark, rows):
    return warc.planned(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_warc_appends_and_overwrites(spark):
    warc.register(spark)
    path = scratch(spark, "warc")

    def save(ids, mode):
        pages_of(spark, [(i, f"http://{i}", f"page {i}") for i in ids]).repartition(2).write.format("warc").option("path", path).mode(mode).save()
        return sorted(r["p"] for r in spark.read.format("warc").load(path).select(warc.page_of(F.col("record_id")).alias("p")).collect())

    assert save(range(8), "append") == [*range(8)]
    assert save(range(10, 18), "append") == [*range(8), *range(10, 18)]
    assert save([20], "overwrite") == [20]


def test_warc_filters_and_lengths(spark):
    warc.register(spark)
    path = scratch(spark, "warc")
    rows = [(i, None if i % 5 == 0 else f"http://host{i % 3}/{i}", "same" if i % 2 else f"page {i} " * 3000) for i in range(40)]
    pages_of(spark, rows).write.format("warc").option("path", path).mode("append").save()
    whole = spark.read.format("warc").load(path).toPandas()
    for payload in ("all", "verify", "none"):
        back = spark.read.format("warc").option("payload", payload).load(path)
        for where in ("record_type <> 'revisit'", "record_type = 'revisit' or record_id = '<urn:page:4>'", "record_type in ('revisit', 'x')", "target_uri like 'http://host1%'", "target_uri is not null and record_type = 'response'", "target_uri is null", "not (target_uri like 'http://host1%')", "payload_bytes > 100"):
            got = back.where(where).select("record_id", "payload_bytes", "payload_digest").toPandas().sort_values("record_id").values.tolist()
            want = spark.createDataFrame(whole).where(where).select("record_id", "payload_bytes", "payload_digest").toPandas().sort_values("record_id").values.tolist()
            assert got == want and got, (payload, where)


def test_warc_skips_members_unread(tmp_path):
    import io

    records = [warc.record("response", f"<urn:page:{i}>", "http://a", None, bytes(random.Random(i).randbytes(50_000)), "2024-01-01T00:00:00Z") for i in range(6)]
    long = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Type: application/http; msgtype=response\r\n"
    block = b"HTTP/1.1 200 OK\r\nX-Long: " + b"y" * 9000 + b"\r\nContent-Length: 7\r\n\r\n" + b"z" * 123
    records.append(long + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n")
    import gzip

    for name, data in (("a.warc", b"".join(records)), ("b.warc.gz", b"".join(warc.member(x, 1) for x in records)), ("c.warc.gz", b"".join(gzip.compress(x) for x in records)), ("d.warc.gz", gzip.compress(b"".join(records)))):
        (tmp_path / name).write_bytes(data)
        if name[0] in "bc":
            assert gzip.decompress(data) == b"".join(records)
        reader = warc.Reader({"path": str(tmp_path / name), "payload": "none"})
        (part,) = reader.partitions()
        got = [r for batch in reader.read(part) for r in batch.to_pylist()]
        assert [r["record_id"] for r in got] == [f"<urn:page:{i}>" for i in (0, 1, 2, 3, 4, 5, 9)] and [r["payload_bytes"] for r in got] == [50_000] * 6 + [123], name
        file = io.BytesIO(data)
        source, passed = warc.Source(file, name.endswith("gz")), []
        while (head := source.headers()) is not None:
            source.skip(int(head["content-length"]))
            passed.append(head["warc-record-id"])
        assert len(passed) == 7 and (name[0] != "b" or source.produced < 20_000)
