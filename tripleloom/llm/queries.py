"""The thin ``opN_*`` queries over the standard tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, filter_audit, language_id, line_dedup, mixing, ngram_join, quality_gam, repeats, spelling, token_store, topk, toxicity

#: Production targets of the mixture: temperatures, and language shares.
TARGETS: dict = {"source": 0.7, "lang": {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}, "topic": 0.9}
RAKE_ROUNDS = 8
END_ID = 2


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False)).alias("held_out")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = chat_format.rotate(table(spark, sf_dir, "conversations"))
    trained = F.array_join(F.transform(F.filter("segments", lambda s: s["mask"]), lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ",")
    return r.select("conv_id", "perspective", "piece", "n_turns", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"), trained.alias("trained"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.decide(table(spark, sf_dir, "documents"), TARGETS, rounds=RAKE_ROUNDS)
    return d.select("doc_id", "n_tokens", F.round(F.col("p") * 1e6).cast("long").alias("p_ppm"), "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return language_id.predict(d, language_id.train(d)).select("doc_id", held_out(4, 2), "lang_pred", "score", "ambiguous")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return quality_gam.score(d, quality_gam.train(d, table(spark, sf_dir, "labels"))).select("doc_id", held_out(5, 0), "score", "predicted")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store(table(spark, sf_dir, "documents"), tokenizer_file(), END_ID)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return toxicity.score(d, toxicity.train(d, table(spark, sf_dir, "labels"))).select("doc_id", held_out(4, 2), "score", "predicted")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.decide_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("row.doc_id", "n_lines", "n_kept", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = repeats.repeated(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return r.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_chat_format, op2_decontaminate, op3_mix_sources, op4_language_id, op5_exact_topk, op6_quality, op7_ngram_join, op8_token_ids, op9_toxicity, op10_line_dedup, op11_suffix_dedup, op12_filter_audit, op13_spelling_variants, pipeline)
    return {f.__name__: f for f in own}


_OP1 = """
WITH t AS (
  SELECT DISTINCT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(nullif(trim(role), ''), 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
who AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role NOT IN ('system', 'tool')),
s AS (
  SELECT t.conv_id, perspective, coalesce(floor(turn / 64.0)::BIGINT, 0) AS piece, turn, role, text, role = perspective AS mask,
    CASE WHEN role = perspective THEN '<|assistant|>' WHEN role IN ('system', 'tool') THEN '<|' || role || '|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS head,
    text || '<|end|>' || chr(10) AS body
  FROM t JOIN who USING (conv_id)),
o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, piece ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
  FROM s)
SELECT conv_id, perspective, piece, count(*) AS n_turns, sum(length(head) + length(body))::BIGINT AS n_chars,
  md5(string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text)) AS text_md5,
  coalesce(string_agg(CASE WHEN mask THEN (stop - length(body)) || '-' || stop END, ',' ORDER BY turn NULLS FIRST, role, text), '') AS trained
FROM o GROUP BY conv_id, perspective, piece
"""

_OP2 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bs AS (SELECT item_id, least(len(w), 5) AS k, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM i),
ks AS (SELECT DISTINCT k FROM bs),
ds AS (SELECT doc_id, k, unnest(CASE WHEN len(w) >= k THEN list_distinct(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) ELSE [] END) AS s FROM d, ks),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(DISTINCT s) AS n_shared
FROM ds JOIN bs USING (k, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(DISTINCT s) * 100 >= n_item * 80
"""


def _op3() -> str:
    cells = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN length(coalesce(text, '')) < 1000 THEN 'short' WHEN length(text) < 4000 THEN 'medium' ELSE 'long' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM documents),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)"""
    for dim in mixing.DIMS:
        want = TARGETS[dim]
        if isinstance(want, dict):
            case = "CASE " + " ".join(f"WHEN {dim} = '{v}' THEN {w!r}" for v, w in want.items()) + " END"
            left = max(0.0, 1.0 - sum(want.values()))
            others = f"{left!r} * n / (SELECT sum(n) FROM m_{dim} WHERE ({case}) IS NULL)"
            if left <= 1e-9:  # values without a target keep their natural share
                others = f"(SELECT sum({case}) FROM m_{dim}) * n / nullif((SELECT sum(n) FROM m_{dim} WHERE ({case}) IS NOT NULL), 0)"
            share = f"SELECT {dim}, coalesce({case}, {others}) AS w FROM m_{dim}"
        else:
            share = f"SELECT {dim}, pow(n, {float(want)!r}) AS w FROM m_{dim}"
        cells += f",\nm_{dim} AS (SELECT {dim}, sum(n) AS n FROM c GROUP BY {dim}),\ns_{dim} AS ({share}),\nt_{dim} AS (SELECT {dim}, w / (SELECT sum(w) FROM s_{dim}) AS t FROM s_{dim})"
    cells += ",\nw0 AS (SELECT *, n / (SELECT sum(n) FROM c) AS nat, n / (SELECT sum(n) FROM c) AS w FROM c)"
    k = 0
    for _ in range(RAKE_ROUNDS):
        for dim in mixing.DIMS:
            cells += f",\nw{k + 1} AS MATERIALIZED (SELECT w{k}.* EXCLUDE (w), w * t / sum(w) OVER (PARTITION BY {dim}) AS w FROM w{k} JOIN t_{dim} USING ({dim}))"
            k += 1
    return cells + f""",
p AS (SELECT source, lang, topic, w / nat / (SELECT max(w / nat) FROM w{k}) AS p FROM w{k}),
q AS (SELECT d.*, coalesce(p, 1.0) AS p FROM d LEFT JOIN p USING (source, lang, topic))
SELECT doc_id, n_tokens, round(p * 1e6)::BIGINT AS p_ppm, ('0x' || substr(md5(coalesce(doc_id, -1)::VARCHAR || ':mix'), 1, 8))::BIGINT / 4294967296.0 < p AS kept FROM q
"""


_OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM g),
n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 90 * (na.n + nb.n - n_both)),
u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, m.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = n.doc_id
"""


_OP12 = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
m AS MATERIALIZED (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.letter || q.letter || r.letter || s.letter || u.letter AS filter_order FROM x p, x q, x r, x s, x u WHERE p.bit | q.bit | r.bit | s.bit | u.bit = 31),
k AS (SELECT filter_order, step, substr(filter_order, step::INT, 1) AS letter, list_sum(list_transform(string_split(substr(filter_order, 1, step::INT), ''), lambda v: 1 << (ascii(v) - 65)))::INT AS so_far,
    (1 << (ascii(substr(filter_order, step::INT, 1)) - 65))::INT AS bit FROM o, range(1, 6) AS g(step)),
r AS (SELECT part, filter_order, step::INT AS step, letter,
    coalesce(sum(n) FILTER (mask & so_far = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & so_far = bit), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & so_far <> bit), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (mask & so_far = bit AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (mask & so_far = bit AND toxic), 0)::BIGINT AS toxic_lost
  FROM m, k GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""

# CRC-32 has no function here; its table follows from the reflected polynomial 0xEDB88320
_OP13 = f"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) AS g(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda v: ('0x' || v)::BIGINT)),
    lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) AS h FROM per, crc),
a AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n, length(word)::INT AS size FROM a WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
w AS (SELECT word, n, p, substr(word, 1, p::INT - 1) || '_' || substr(word, p::INT + 1) AS wild, substr(word, 1, p::INT - 1) || substr(word, p::INT + 1) AS less FROM v, range(1, 1000) AS g(p) WHERE p <= size),
del AS MATERIALIZED (SELECT DISTINCT word, n, less FROM w),
near AS (SELECT x.word, y.word AS other, y.n FROM w x JOIN w y ON x.wild = y.wild AND x.word <> y.word
  UNION ALL SELECT d.word, v.word, v.n FROM del d JOIN v ON v.word = d.less
  UNION ALL SELECT v.word, d.word, d.n FROM del d JOIN v ON v.word = d.less),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS other, max(n) AS m FROM near GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
path(word, tip) AS (SELECT word, word FROM f UNION ALL SELECT path.word, f.form FROM path JOIN f ON f.word = path.tip WHERE f.form IS NOT NULL)
SELECT f.word, f.form, path.tip AS root, f.n, f.n_near, f.form_n FROM f JOIN path USING (word) JOIN f last ON last.word = path.tip AND last.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": _OP1, "op2_decontaminate": _OP2, "op3_mix_sources": _op3(), "op5_exact_topk": _OP5, "op7_ngram_join": _OP7, "op12_filter_audit": _OP12, "op13_spelling_variants": _OP13}
