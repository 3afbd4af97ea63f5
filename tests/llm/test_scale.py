"""What only shows at scale or on tables that the given ones are not: samples, many lines, unlisted values, plain loops."""

import collections
import itertools
import math
import re
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleloom.llm import decontaminate, language_id, line_dedup, mixing, ngram_join, quality_gam, queries, spool, toxicity

SF = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1


def test_samples_do_not_run_empty(spark):
    for n in (10**9, 10**12, 10**15):
        for want in (800, 6_000, 60_000):
            assert spool.draw_limit(want, n) / 2**spool.DRAW_BITS == pytest.approx(want / n, rel=1e-3)
    assert spool.draw_limit(1, 10**20) == 1
    ids = spark.range(2_000_000)
    # a rate of 800 in 1e9 draws about 1.6 of two million; one of 4,000 about 4,000 of a million
    assert ids.where(spool.drawn(F.col("id"), 5, 800, 10**9)).count() < 10
    assert 7_500 < ids.where(spool.drawn(F.col("id"), 5, 4_000, 10**6)).count() < 8_500
    assert ids.where(spool.drawn(F.col("id"), 5, 10, 10)).count() == 2_000_000


def test_many_languages_share_the_sample(spark):
    d = spark.createDataFrame([(i, "wort oder word " * 5, f"l{i % 40}") for i in range(800)], "doc_id long, text string, lang string")
    m = language_id.train(d, None, per_language=20, sample_rows=80)
    assert len(m.names) >= 30  # two of each, by a hash
    # repeated rows and ties: equal texts get equal answers, whichever row they are in
    rows = {(r["lang_pred"], round(r["score"], 6)) for r in language_id.predict(d.unionByName(d.limit(3)), m).collect()}
    assert len(rows) == 1


def test_line_dedup_of_very_many_lines(spark):
    """200,000 lines in one text, and very many rows without an id; each text with its own lines."""
    rng = np.random.default_rng(1)
    line = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 24))
    pool = [line() for _ in range(150_000)]
    text = "\n".join([*pool, *pool[:50_000]])
    rows = [(1, text)] + [(None, "\n".join(f"{line()}" for _ in range(3)) + "\n" + pool[i]) for i in range(2_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.time()
    got = {(r["row"]["doc_id"], r["row"]["text"]): (r["n_lines"], r["n_kept"], r["text"]) for r in line_dedup.decide_lines(d).collect()}
    assert time.time() - began < 150
    assert got[1, text] == (200_000, 150_000, "\n".join(pool))
    assert all(v == (4, 3, t.rsplit("\n", 1)[0]) for (i, t), v in got.items() if i is None)


def odd_languages(spark, path):
    langs = ["en", "de", "it", None, "en", "fr", "es", "xx"]
    rows = [(i, f"w{i} " * (1 + i * 7 % 90) + (" | " if i % 5 == 0 else ""), f"s{i * i % 4}" if i % 9 else None, langs[i % 8]) for i in range(600)] + [(None, "no id", "s1", "it"), (7, None, "s1", None), (7, "", None, "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1)
    d.write.parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_mixing_equals_its_sql_with_unlisted_and_null_values(spark, tmp_path):
    import duckdb

    odd_languages(spark, f"file://{tmp_path}")
    got = queries.op3_mix_sources(spark, f"file://{tmp_path}").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(queries._op3()).fetchall()
    key = lambda rows: sorted(map(repr, (tuple(r) for r in rows)))
    assert key(got) == key(want) and len({r["kept"] for r in got}) == 2


def test_readings_of_short_spans_against_every_reading(spark):
    """The decoder's choice is the cheapest of all ways to read the signs, each a letter or, all of them, as it stands."""
    chars = toxicity.char_model(spark.read.parquet(f"{SF}/documents.parquet"))
    ids = toxicity._ID

    def cost(reading):
        a = b = 0
        total = 0.0
        for ch in reading:
            k = int(ids[ord(ch)]) if ord(ch) < len(ids) else 0
            total += float(chars.cost[a, b, k])
            a, b = b, k
        return total + (float(chars.cost[a, b, 0]) if b else 0.0)

    signs = [s for s in "013457@$" if s in toxicity.SIGNS]
    rng = np.random.default_rng(4)
    tried = 0
    for word in ("idiot", "stupid", "worthless", "those", "general", "people"):
        for _ in range(12):
            back = collections.defaultdict(list)
            for s in signs:
                for letter in toxicity.SIGNS[s]:
                    back[letter].append(s)
            span = "".join(rng.choice(back[c]) if back[c] and rng.random() < 0.5 else c for c in word)
            if span[0] in toxicity.SIGNS or span[-1] in toxicity.SIGNS or not any(c in toxicity.SIGNS for c in span) or any(x == y == z for x, y, z in zip(span, span[1:], span[2:], strict=False)):
                continue
            options = [[(x, toxicity.IMITATES) for x in toxicity.SIGNS[c]] if c in toxicity.SIGNS else [(c, 0.0)] for c in span]
            best = min(sum(f for _, f in way) + cost("".join(x for x, _ in way)) for way in itertools.product(*options))
            read, out = chars._read(span, False, False)
            assert read == pytest.approx(best, abs=1e-3) and read == pytest.approx(sum(toxicity.IMITATES for a, b in zip(span, out, strict=True) if a != b) + cost(out), abs=1e-3)
            tried += 1
    assert tried > 12


def mixed(x):
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & M64
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & M64
    return x ^ (x >> 32)


def test_toxicity_scores_by_hand(spark):
    """Every score of the query's model from plain loops: restored text, words and word starts, weights, logistic function."""
    d, y = (queries.table(spark, SF, t) for t in ("documents", "labels"))
    m = toxicity.train(d, y)
    weight = dict(zip(m.lexicon.tolist(), m.weights.tolist(), strict=True))
    assert len(weight) > 5

    def unit(part, extra):
        total, power = 0, 1
        for ch in part:
            total = (total + mixed(ord(ch) + 99) * power) & M64
            power = power * toxicity._BASE & M64
        return mixed((total + extra) & M64)

    odd = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (10**9 + 2, "word " * 3000), (10**9 + 2, "word " * 3000), (None, "1d10t")], "doc_id long, text string")
    rows = d.select("doc_id", "text").unionByName(odd).collect()
    got = collections.defaultdict(list)
    for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), m).collect():
        got[r["doc_id"]].append((r["score"], r["predicted"]))
    for r in rows:
        text = toxicity.restored([r["text"] or ""], m.chars)[0]
        have = set()
        for word in re.findall("".join(["[", *(f"\\u{c:04x}" for c in range(len(toxicity._ALPHA)) if toxicity._ALPHA[c]), "]+"]), text):
            low = "".join(chr(int(toxicity._LOW[ord(c)])) if ord(c) < len(toxicity._LOW) else c for c in word)
            have |= {unit(low, 1)} | {unit(low[:k], 1 + k) for k in (3, 4, 5, 6) if len(low) >= k}
        s = 1 / (1 + math.exp(-(m.bias + sum(weight.get(u, 0.0) for u in have))))
        assert any(x == pytest.approx(s, abs=1e-9) and p == (x >= 0.3) for x, p in got[r["doc_id"]])


def test_labels_of_one_class(spark):
    d = queries.table(spark, SF, "documents")
    for value in (0, 1):
        y = d.select("doc_id", F.lit(value).alias("quality"), F.lit(value).alias("toxic"))
        for r in (toxicity.score(d, toxicity.train(d, y)), quality_gam.score(d, quality_gam.train(d, y))):
            got = r.agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.count_distinct("predicted").alias("p")).first()
            assert got["n"] == d.count() and 0 <= got["lo"] <= got["hi"] <= 1 and got["p"] == 1
            assert r.first()["predicted"] == value


def shingles(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on its own input, over whole documents: what goes and what stays, by plain loops, and for the mixture by SQL."""
    import corpus_pipeline
    import duckdb
    import tokenizers

    stages = dict(corpus_pipeline.STAGES)
    docs = queries.table(spark, SF, "documents")
    y = queries.table(spark, SF, "labels")
    rows = lambda d: {r["doc_id"]: r for r in d.collect()}

    good = {r["doc_id"] for r in quality_gam.score(docs, quality_gam.train(docs, y)).where("score >= 0.3").collect()}
    kept = spool.spool(stages["quality"](spark, docs, SF), "t")
    assert rows(kept).keys() == good and 0 < len(good) < docs.count()

    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    text = {i: re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(low)) for i, r in rows(kept).items()}
    sets = {i: shingles(w, 5) for i, w in text.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    one = spool.spool(stages["near_copies"](spark, kept, SF), "t")
    assert rows(one).keys() == {i for i in sets if find(i) == i} and len(rows(one)) < len(sets)

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = {r["item_id"]: words(r["text"]) for r in queries.table(spark, SF, "benchmark").collect()}
    leaked = set()
    for i, r in rows(one).items():
        w = words(r["text"])
        for item in items.values():
            k = min(5, len(item))
            if k and 100 * len(shingles(item, k) & ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)})) >= 80 * len(shingles(item, k)):
                leaked.add(i)
    clean = spool.spool(stages["leaks"](spark, one, SF), "t")
    assert rows(clean).keys() == rows(one).keys() - leaked and leaked

    clean.coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    drawn = {i for i, _, _, k in con.sql(queries._op3()).fetchall() if k}
    mixed_ = spool.spool(stages["mixture"](spark, clean, SF), "t")
    assert rows(mixed_).keys() == drawn and 0 < len(drawn) < clean.count()

    tok = tokenizers.Tokenizer.from_file(queries.tokenizer_file())
    at = 0
    ids = {r["doc_id"]: r for r in stages["token_ids"](spark, mixed_, SF).collect()}
    for i, r in sorted(rows(mixed_).items()):
        n = len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        assert (ids[i]["start"], ids[i]["n_tokens"]) == (at, n)
        at += n
    for d in (kept, one, clean, mixed_):
        assert d.columns == docs.columns
