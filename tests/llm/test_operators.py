"""Each operator against brute force or an exact round trip, and its defined edge cases."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleloom.llm import chat_format, decontaminate, language_id, line_dedup, mixing, ngram_join, quality_gam, queries, spool, token_store, topk, toxicity

SF = "/root/testdata/sf0.001"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "no id here at all"), (5, BASE), (6, BASE + "more"), (7, "word " * 30_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", "y", "clash") for i, t in ODD], "doc_id long, text string, lang string, source string, score string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("1 = 0")


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 9), (1, 2), (7, 7), (None, 3)], "a long, b long")
    assert {tuple(r) for r in spool.components(e).collect()} == {(4, 4), (5, 4), (9, 4), (1, 1), (2, 1)}
    assert spool.components(e.where("a > 100")).count() == 0
    # the shuffled way, which larger edge tables take
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)], "a long, b long")
    assert {tuple(r) for r in spool.components(chain, one_task=0).collect()} == {(k, 0) for k in range(61)} | {(k, 100) for k in range(100, 140)}


def test_ngram_join(spark, odd, none):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.ngram_components(odd).collect()}
    assert got[1, 0] == 1 and got[4, 1] == 4 and got[None, 3] is None and got[6, 21] == 5
    assert ngram_join.ngram_components(none).count() == 0


def test_ngram_join_in_pieces(spark):
    """Brute force over texts of many sizes, some in one block far above the bound of a piece, some only with a passage in common."""
    rng = np.random.default_rng(5)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 10**6, k)]
    passage, texts = word(30), []
    for size in (8, 12, 40, 60, 200):
        for _ in range(3):
            base = word(size)
            for _ in range(7):
                t = list(base)
                for _ in range(int(rng.integers(0, 1 + size // 12))):
                    t[int(rng.integers(0, len(t)))] = f"x{rng.integers(0, 10**6)}"
                texts.append(" ".join(t[: len(t) - int(rng.integers(0, 2 + size // 20))] + (passage if rng.integers(0, 2) else [])))
    chain = word(120)
    texts += [" ".join(chain[k : k + 100]) for k in range(20)] + [texts[0], texts[0]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n, percent in ((3, 90), (5, 80)):
        sets = [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in map(str.split, texts)]
        comp = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    lo, hi = sorted((comp[a], comp[b]))
                    comp = [lo if c == hi else c for c in comp]
        assert len(set(comp)) < len(comp) - 20
        for options in ({}, {"piece_elements": 150, "part_values": 500}):
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(d, n, percent, **options).collect()}
            assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, comp))}


def test_ngram_trie_shares_prefixes():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**62, 300, dtype=np.uint64)
    sets = [np.sort(np.append(np.delete(base, k), rng.integers(0, 2**62, 3, dtype=np.uint64))) for k in range(40)]
    ranked = ngram_join.frequent_first(sets)
    tree = ngram_join.Trie([ranked[i] for i in ngram_join.Trie.order(ranked)], np.array([len(s) for s in sets]))
    assert tree.stored < sum(map(len, ranked)) / 2 and len(ngram_join.links_of(list(range(40)), sets, 90)) == 39


def test_ngram_blocks_lose_nothing():
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        sets = []
        for _ in range(6):
            base = rng.integers(0, 2**62, 60, dtype=np.uint64)
            sets += [np.unique(np.concatenate([np.delete(base, rng.integers(0, 60, 6)), rng.integers(0, 2**62, int(rng.integers(0, 8)), dtype=np.uint64)])) for _ in range(8)]
        parent = list(range(len(sets)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(len(sets)):
            for b in range(a):
                i = len(np.intersect1d(sets[a], sets[b]))
                if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                    assert len(np.intersect1d(ngram_join.range_keys(sets[a], percent), ngram_join.range_keys(sets[b], percent)))
                    parent[max(root(a), root(b))] = min(root(a), root(b))
        want = [root(i) for i in range(len(sets))]
        parent = list(range(len(sets)))
        for a, b in ngram_join.links_of(list(range(len(sets))), sets, percent):
            parent[max(root(a), root(b))] = min(root(a), root(b))
        assert [root(i) for i in range(len(sets))] == want


def test_decontaminate(spark, odd, none):
    items = spark.createDataFrame([(1, "Seven, eight: nine ten eleven twelve thirteen!"), (2, None), (3, "a"), (4, "quite another sentence that nobody has here")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, items).collect()}
    assert got == {(5, 1), (6, 1), (4, 3)}
    left = decontaminate.drop_leaked(odd, items)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} == {1, 2, 3, None, 7}
    short = spark.createDataFrame([(1, "secret answer is forty"), (2, "Seventeen"), (3, "seven eight"), (4, "seven nine"), (5, "the secret answer is forty two"), (None, "one")], "item_id long, text string")
    docs = spark.createDataFrame([(1, BASE + "and the secret: answer is FORTY two, really"), (2, "answer is forty"), (3, BASE), (4, "secret answer is forty")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["n_item"]) for r in decontaminate.leaks(docs, short).collect()} == {(1, 1, 1), (4, 1, 1), (1, 2, 1), (3, 2, 1), (1, 3, 1), (3, 3, 1), (1, 5, 2)}
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(odd, items.where("1 = 0")).count() == 0


def test_mixing(spark, odd, none):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2], "xy"[i % 3 == 0]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    cells = mixing.calibrate(d, {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.5, "y": 0.5}}, F.lit("t"), rounds=30).collect()
    for dim, value in (("source", "a"), ("lang", "y")):
        assert sum(c["weight"] for c in cells if c[dim] == value) == pytest.approx(0.5, abs=1e-6)
    assert max(c["p"] for c in cells) == pytest.approx(1)
    assert mixing.sample(odd, queries.TARGETS).columns == odd.columns and mixing.sample(none, queries.TARGETS).count() == 0


def test_mixing_keeps_unlisted_languages(spark):
    rows = [(i, "w " * 5, "ab"[i % 2], ["en", "de", "es", "fr", "it", None, "en", "en", "en", "de"][i % 10]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    share = collections.Counter()
    for c in mixing.calibrate(d, {"lang": queries.TARGETS["lang"]}, F.lit("t"), rounds=30).collect():
        share[c["lang"]] += c["weight"]
    assert [share[x] for x in ("it", "", "en", "de")] == pytest.approx([0.1, 0.1, 0.8 * 0.55, 0.8 * 0.15], abs=1e-6)
    assert {r["lang"] for r in mixing.sample(d, queries.TARGETS).collect()} >= {"it", None}


def test_chat_format(spark):
    t = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 70, "", "late"), (None, 0, "ann", "x"), (2, 0, "system", "only")], "conv_id long, turn long, role string, text string")
    got = chat_format.rotate(t).collect()
    assert {(r["perspective"], r["piece"]) for r in got} == {(p, k) for p in ("ann", "bob", "unknown") for k in (0, 1)}
    one = next(r for r in got if r["perspective"] == "ann" and r["piece"] == 0)
    assert one["text"] == "<|system|>\ns<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n"
    assert [one["text"][s["start"] : s["stop"]] for s in one["segments"] if s["mask"]] == ["hi<|end|>\n"]
    assert chat_format.rotate(t.where("1 = 0")).count() == 0


def test_line_dedup(spark, none, odd):
    base = "The quick brown fox jumps over the lazy dog"
    rows = [(1, base), (2, base + "."), (3, "short\n" + base.replace("quick", "quack") + "\n\nshort"), (4, base.replace("fox", "foxxx")), (5, None), (6, ""), (None, base), (7, "é" * 40), (8, "é" * 39 + "e"), (9, "x" * 5000), (10, "x" * 2400 + "y" + "x" * 2599)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(d, min_chars=20).collect()}
    assert got == {1: base, 2: "", 3: "short\n\nshort", 4: base.replace("fox", "foxxx"), 5: None, 6: "", None: "", 7: "é" * 40, 8: "", 9: "x" * 5000, 10: ""}
    assert line_dedup.dedup_lines(none).count() == 0 and line_dedup.dedup_lines(odd).columns == odd.columns


#: Names that operators use inside, and some that differ in case only.
CLASHES = ("_id", "_kept", "_key", "_p", "_tokens", "_source", "_lang", "_topic", "_bad", "_gone", "_rep", "_all", "_stay", "_lines", "row", "key", "kept", "p", "n_tokens", "topic", "hash", "part", "tag", "score", "items", "grams", "block", "__gone", "__bad")


def test_columns_of_any_name_stay(spark):
    texts = {1: BASE, 2: BASE + "more", 3: None, 4: "", None: "some text", 5: "word " * 300, 6: "secret answer is forty two and more"}
    rows = [(i, t, "en", "s", *(f"{c} of {i}" for c in CLASHES)) for i, t in texts.items()]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    items = spark.createDataFrame([(1, "secret answer is forty")], "item_id long, text string")
    model = quality_gam.train(d, queries.table(spark, SF, "labels").where("1 = 0"))
    everything = ("near", ngram_join.keep_one(d)), ("leaks", decontaminate.drop_leaked(d, items)), ("mix", mixing.sample(d, queries.TARGETS)), ("lines", line_dedup.dedup_lines(d)), ("good", quality_gam.keep_good(d, model))
    for name, out in everything:
        assert out.columns == d.columns, name
        got = {r["doc_id"]: r for r in out.collect()}
        assert all(r[c] == f"{c} of {i}" for i, r in got.items() for c in CLASHES), name
        assert set(got) == {"near": {1, 3, 4, None, 5, 6}, "leaks": {1, 2, 3, 4, None, 5}, "mix": set(got)}.get(name, set(texts)), name


def test_line_dedup_short_lines(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = ["\n".join("".join(rng.choice(list("abcé"), int(rng.integers(0, 7)))) + "xyz" * int(rng.integers(0, 7)) for _ in range(12)) for _ in range(25)] + ["Les.\n \n\t\n\n \nLes.", "Les", "Les.\r"]
    want, lines = {}, []

    def near(a, b):
        a, b = sorted((a, b), key=len)
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return len(b) - len(a) < 2 and (a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :])

    for i, t in enumerate(texts):
        left = []
        for line in t.split("\n"):
            if not line.strip() or not any(near(line, x) for x in lines):
                left.append(line)
            if line.strip():
                lines.append(line)
        want[i] = (len(t.split("\n")) if t else 0, len(left) if t else 0, zlib.crc32("\n".join(left).encode()))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["n_kept"], r["text_crc32"]) for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == want and sum(x[1] for x in want.values()) < sum(x[0] for x in want.values()) - 50


def test_language_id(spark, odd, none):
    d = queries.table(spark, "/root/testdata/sf0.01", "documents")
    m = language_id.train(d)
    r = language_id.predict(d, m).join(d.select("doc_id", "lang"), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    assert r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(odd, m).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[5] != "und"
    assert language_id.train(none).names == [] and language_id.predict(none, m).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd, language_id.train(none)).collect()} == {"und"}


def test_quality(spark, odd, none):
    d, y = (queries.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    m = quality_gam.train(d, y)
    r = quality_gam.score(d, m).join(y, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    assert r.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.9
    assert quality_gam.score(odd, m).where("score between 0 and 1").count() == len(ODD)
    assert quality_gam.keep_good(odd, m).columns == odd.columns and quality_gam.score(none, m).count() == 0
    assert quality_gam.train(odd, y.where("1 = 0")).score(np.zeros((1, len(quality_gam.NAMES)))) == pytest.approx([0.5])


def test_language_and_quality_scores_by_hand(spark):
    """The registered scores against a plain loop over the fitted models, text by text."""
    d, y = (queries.table(spark, SF, t) for t in ("documents", "labels"))
    rows = d.select("doc_id", "text").orderBy("doc_id").limit(60).collect()
    m = language_id.train(d)
    got = {r["doc_id"]: r for r in language_id.predict(d, m).collect()}
    low = [32 if c < 33 else c + 32 if 65 <= c < 91 else c for c in range(256)]
    for r in rows[:20]:
        c, n = [low[b] for b in r["text"].encode()], collections.Counter()
        for k in range(len(c)):
            n[(c[k] * 0x9E3779B1 & 0xFFFFFFFF) >> 19] += 1
            if k + 1 < len(c):
                n[((c[k] * 257 + c[k + 1]) * 0x85EBCA6B & 0xFFFFFFFF) >> 19] += 1
            if k + 2 < len(c):
                n[((c[k] * 66049 + c[k + 1] * 257 + c[k + 2] + (1 << 25)) * 0xC2B2AE35 & 0xFFFFFFFF) >> 19] += 1
        margin = m.bias + sum((v / sum(n.values())) ** 0.5 * m.weights[g].astype(float) for g, v in n.items())
        loss = [float((np.log1p(np.exp(-np.clip(margin, -15, 15) * code)) * m.trust).sum() / m.trust.sum()) for code in m.code]
        p = np.exp(-4 * (np.array(loss) - min(loss)))
        assert got[r["doc_id"]]["lang_pred"] == m.names[int(np.argmin(loss))] and got[r["doc_id"]]["score"] == pytest.approx(p.max() / p.sum(), abs=1e-3)
    g = quality_gam.train(d, y)
    got = {r["doc_id"]: r for r in quality_gam.score(d, g).collect()}
    import pyarrow as pa

    for r in rows:
        x = quality_gam.features(pa.array([r["text"]]))[0]
        at = [sum(v >= e for e in edges.tolist()) for v, edges in zip(x.tolist(), g.edges)]
        z = g.base + sum(float(t[b]) for t, b in zip(g.tables, at)) + sum(float(t[int(g.coarse[i][at[i]]), int(g.coarse[j][at[j]])]) for i, j, t in g.pairs)
        want = 1 / (1 + np.exp(-z))
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-6) and got[r["doc_id"]]["predicted"] == int(want >= 0.3)


def test_line_dedup_of_documents(spark):
    """op10 over whole documents against a comparison of all lines of like length."""

    def near(a, b):
        a, b = sorted((a, b), key=len)
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]

    docs = sorted((r["doc_id"], r["text"]) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect())
    want, seen, by_length = {}, set(), collections.defaultdict(list)
    for i, text in docs:
        lines = text.split("\n") if text else []
        left = []
        for line in lines:
            if not line.strip(" \t\x0b\x0c\r"):
                left.append(line)
            elif line not in seen:
                if not any(near(line, x) for n in (-1, 0, 1) for x in by_length[len(line) + n]):
                    left.append(line)
                seen.add(line)
                by_length[len(line)].append(line)
        want[i] = (len(lines), len(left), zlib.crc32("\n".join(left).encode()))
    got = {r["doc_id"]: (r["n_lines"], r["n_kept"], r["text_crc32"]) for r in queries.op10_line_dedup(spark, SF).collect()}
    assert got == want and sum(x[1] for x in want.values()) < sum(x[0] for x in want.values()) - 100


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert set(ids) <= {i for i, _ in ODD} and len(ids) <= len(ODD), name
        if name == "near_copies":
            assert sorted(ids, key=str) == sorted([1, 2, 3, 4, 4, None, 5, 7], key=str)
        if name in ("leaks", "token_ids"):
            assert len(ids) == len(ODD), name
        if name != "token_ids":
            assert out.columns == odd.columns, name
        assert stage(spark, none, SF).count() == 0, name


def test_toxicity(spark, odd, none):
    d, y = (queries.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    m = toxicity.train(d, y)
    r = toxicity.score(d, m).join(y, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    assert r.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.9
    assert toxicity.restored(["you 1d10t and w0rthle$$"], m.chars) == ["you idiot and worthless"]
    assert toxicity.score(odd, m).where("score between 0 and 1").count() == len(ODD) and toxicity.score(none, m).count() == 0


def test_toxicity_punctuation_and_mostly_signs(spark):
    m = toxicity.char_model(queries.table(spark, "/root/testdata/sf0.01", "documents"))
    for token, word in (("1d10t.", "idiot."), ("1d10t,", "idiot,"), ('"1d10t"', '"idiot"'), ("(1d10t)!", "(idiot)!"), ("1d107", "idiot"), ("57up1d", "stupid"), ("1d1" + "o" * 100 + "t.", "idiot."), ("1d10t/" * 40, "idiot/" * 40)):
        assert toxicity.restored([token], m) == [word]
    assert toxicity.restored(["4th h264 f91f2b873bc89b9c5b86adf32c8523be758, б1д"], m) == ["4th h264 f91f2b873bc89b9c5b86adf32c8523be758, б1д"]
    long = "1d10t" * 400
    assert not set(toxicity.restored([long], m)[0]) & set("10") and len(toxicity.restored([long], m)[0]) == len(long)


#: Kind of spacing, text, what it should be read as, whether it is toxic (None: the model of sf0.01 does not know the plain word either).
SPACED = [
    ("signs set apart", "you 1 d 1 0 t now", "you idiot now", 1), ("signs set apart", "so ! d ! 0 t", "so idiot", 1), ("signs set apart", "the 1 2 3 4 of", "the 1 2 3 4 of", 0),
    ("three letters", "you a s s now", "you ass now", None), ("runs of separators", "you i - d - i - o - t now", "you idiot now", 1), ("runs of separators", "s  t  u  p  i  d", "stupid", None),
    ("within a word", "you id-iot", "you idiot", 1), ("within a word", "you id.iot!", "you idiot!", 1), ("within a word", "st--upid", "stupid", None), ("within a word", "that-there the.of", "that-there the.of", 0),
    ("asterisks", "you id*ot", "you idot idiot", 1), ("asterisks", "a st**id", "a st**id stupid", None), ("ends", '"i d i o t!"', '"idiot!"', 1), ("longer runs part words", "y o u  i d i o t", "you  idiot", 1),
    ("long", "i d i o t  " * 200, ("idiot  " * 200).strip() + "  ", 1), ("not a chain", "well, 7 | 5 of 3 - 4", "well, 7 | 5 of 3 - 4", 0),
]


def test_toxicity_spacing(spark):
    d, y = (queries.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    m = toxicity.train(d, y)
    for kind, text, read, toxic in SPACED:
        assert toxicity.restored([text], m.chars) == [read], kind
        assert m.score([text])[0] == m.score([read])[0] and (toxic is None or (m.score([text])[0] >= 0.3) == toxic), kind


def test_toxicity_obfuscated_copies(spark):
    """Held-out labelled documents with every longer word obfuscated score like the plain ones."""
    d, y = (queries.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    m = toxicity.train(d, y)
    rows = d.join(y, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).orderBy("doc_id").collect()
    toxic, clean = [r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0][:200]
    rng = np.random.default_rng(1)
    leet, look = dict(zip("oieastbg", "01345789")), dict(zip("aeocips", "аеосірѕ"))

    def stretch(w):
        k = int(rng.integers(0, len(w)))
        return w[:k] + w[k] * int(rng.integers(3, 7)) + w[k + 1 :]

    kinds = {"signs": lambda w: "".join(leet.get(c, c) if rng.random() < 0.6 else c for c in w), "look-alikes": lambda w: "".join(look.get(c, c) for c in w), "repetition": stretch}
    share = lambda texts: (m.score(texts) >= 0.3).mean()
    plain = share(toxic)
    assert plain > 0.9 and share(clean) < 0.02
    for kind, change in kinds.items():
        spoil = lambda t, change=change: re.sub(r"[A-Za-z]{3,}", lambda w: change(w[0]), t)
        assert share([spoil(t) for t in toxic]) >= plain - 0.02 and share([spoil(t) for t in clean]) < 0.02, kind
    assert toxicity.restored(["you ѕtupіd, і d і о t", "Привет, мир"], m.chars) == ["you stupid, idiot", "Привет, мир"]


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((0, 1), (1, 1), (5, 5), (3000, 10**6), (700, 700)):
        v = np.sort(rng.integers(0, u, n))
        e, _ = token_store.EliasFano.load(memoryview(token_store.EliasFano.of(v).dump()), 0)
        assert (e.values() == v).all() and [e.select(i) for i in range(n)] == v.tolist()


def test_token_store(spark, odd, none):
    from tokenizers import Tokenizer

    more = [(25, "a, b. c,d e., é, ñandú. x1. 3, ."), (26, "same words, same. same words"), (20, " a"), (21, "a  b"), (22, "a\n \nb <|endoftext|> x"), (23, "don't we'll a. b, c.. 3.5, é, x  y\t z \n k "), (24, "a\n b.\n\n c")]
    d = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = token_store.store(d, queries.tokenizer_file(), 2).orderBy("start").collect()
    tok = Tokenizer.from_file(queries.tokenizer_file())
    want = collections.Counter()
    for i, t in d.collect():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows[:-1]]]).tolist()
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_store.store(none, queries.tokenizer_file(), 2).count() == 0
    blocks = [token_store.Block(r["block"]) for r in token_store.encode(d, queries.tokenizer_file(), 2).orderBy("part", "seq").collect()]
    alone = collections.Counter((i, zlib.crc32(b.document(k).astype("<u4").tobytes())) for b in blocks for k, i in enumerate(b.doc_ids()))
    assert alone == collections.Counter((i, crc) for i, _, crc in want.elements())


def test_topk(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (600, 3)).astype(float)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(900, None), (1000, [1.0, None, 2.0]), (1100, [float("nan")] * 3), (None, [1.0, 1.0, 1.0]), (1200, [0.5])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(d, F.col("vec_id") % 50 == 0, block_rows=128, query_rows=5).collect()}
    v = np.floor(1024 * x).astype(np.int64)
    want = set()
    for q in range(0, 600, 50):
        s = v @ v[q]
        best = sorted((-s[i], i) for i in range(600) if i != q)[:10]
        want |= {(q, k + 1, i, int(-m)) for k, (m, i) in enumerate(best)}
    assert got == want and topk.top_k(d.where("1 = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_prunes_clusters(spark):
    """Clusters far apart: most pairs are never scored, the result is that of brute force, repeated ids and longer ids included."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 40, (12, 6))
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(0, 0.5, (3000, 6))).round(2)
    ids = np.arange(3000)
    ids[2990:] = ids[:10]
    d = spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), ["extra"] * 3000)), "vec_id long, embedding array<double>, query_id string")
    got = {tuple(r) for r in topk.top_k(d, F.col("vec_id") % 60 == 0, block_rows=300, query_rows=8).collect()}
    v = np.floor(1024 * x).astype(np.int64)
    want = set()
    for q in range(0, 2990, 60):
        own = min(v[ids == q].tolist())
        s = v @ np.array(own)
        best = sorted((-int(s[i]), int(ids[i])) for i in range(3000) if ids[i] != q)[:10]
        want |= {(q, k + 1, i, -m) for k, (m, i) in enumerate(best)}
    assert got == want
    asked = np.arange(0, 2990, 60)
    best = topk.search(topk.CoverTree(asked, v[asked], 8), topk.CoverTree(ids, v), 10)
    assert best.scored < 0.35 * len(asked) * 3000
    tree = topk.CoverTree(ids, v)
    again = topk.CoverTree.load(*tree.dump(), 6)
    assert [n[:2] + n[3:] for n in tree.nodes] == [n[:2] + n[3:] for n in again.nodes] and (again.points == tree.points).all()


def test_pipeline(spark):
    import corpus_pipeline

    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = spool.spool(stage(spark, seen, "/root/testdata/sf0.01"), "t")
        if name != "token_ids":
            assert out.columns == docs.columns and 0 < out.count() <= seen.count()
        else:
            assert out.count() == seen.count()
        if name == "near_copies":
            text = {r["doc_id"]: re.findall(r"\S+", (r["text"] or "").lower()) for r in out.collect()}
            sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in text.items() if len(w) > 4}
            many = collections.defaultdict(list)
            for i, s in sets.items():
                for g in s:
                    many[g].append(i)
            pairs = collections.Counter((a, b) for ids in many.values() if len(ids) < 60 for a in ids for b in ids if a < b)
            assert not [1 for (a, b), n in pairs.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
        seen = out
