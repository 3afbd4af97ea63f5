"""Registered queries over stored indexes and over solutions that leave variables unbound, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal, learn, pattern, search
from ..operators.embedding_store import EmbeddingStore, HashedWords
from ..operators.pattern import Condition, Pattern, Triple
from ..operators.reach_index import ReachIndex
from ..operators.statistics import Statistics
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..sources.lift import V, lifted
from ..sources.store import Store
from ..streaming import memory
from .catalog import _BM25, _KNN, _table, query
from .catalog_more import _NAMES, _SEARCH, _folder
from .sparql import select

# --- SPARQL with unbound variables ----------------------------------------------------------------------

_SUPPLIER = "SELECT 'urn:t:supplier/' || s_suppkey AS s, 'urn:t:nation/' || s_nationkey AS home, s_acctbal::DECIMAL(18,2) AS b FROM supplier"
_REGION = "SELECT 'urn:t:nation/' || n_nationkey AS n, 'urn:t:region/' || n_regionkey AS r FROM nation"


@query(f"""WITH s AS ({_SUPPLIER}), o AS (SELECT s, CASE WHEN b > 5000 THEN home END AS n FROM s), q AS ({_REGION})
  SELECT o.s, q.n, q.r FROM o JOIN q ON o.n IS NULL OR o.n = q.n""")
def sparql_optional_then_join(spark, d):
    """An OPTIONAL leaves ``?n`` unbound for some, which then join with every nation."""
    return select(lifted(spark, d, ("supplier", "nation")), """
        PREFIX v: <urn:v:>
        SELECT ?s ?n ?r WHERE { ?s a v:Supplier . OPTIONAL { ?s v:locatedIn ?n ; v:balance ?b . FILTER(?b > 5000) } ?n v:locatedIn ?r . ?n a v:Nation }""")


@query(f"""WITH s AS ({_SUPPLIER}), o AS (SELECT s, home AS n, NULL AS b FROM s WHERE b < 1000 UNION ALL SELECT s, NULL, b::VARCHAR FROM s WHERE b > 8000), q AS ({_REGION})
  SELECT o.s, q.n, o.b, q.r FROM o JOIN q ON o.n IS NULL OR o.n = q.n""")
def sparql_union_then_join(spark, d):
    """One branch of a UNION binds ``?n`` and the other does not."""
    return select(lifted(spark, d, ("supplier", "nation")), """
        PREFIX v: <urn:v:>
        SELECT ?s ?n ?b ?r WHERE {
          { SELECT ?s ?n WHERE { ?s a v:Supplier ; v:locatedIn ?n ; v:balance ?x . FILTER(?x < 1000) } }
          UNION { ?s a v:Supplier ; v:balance ?b . FILTER(?b > 8000) }
          ?n v:locatedIn ?r . ?n a v:Nation }""")


@query(f"""WITH s AS ({_SUPPLIER}), o AS (SELECT s, home, CASE WHEN b > 5000 THEN home END AS n FROM s), q AS ({_REGION})
  SELECT s, o.n, r FROM o LEFT JOIN q ON (o.n IS NULL OR o.n = q.n) AND r = 'urn:t:region/1' AND q.n <> 'x'""".replace("SELECT s, o.n, r", "SELECT s, coalesce(o.n, q.n) AS n, r"))
def sparql_optional_twice(spark, d):
    """The second OPTIONAL joins on what the first may have left unbound."""
    return select(lifted(spark, d, ("supplier", "nation")), """
        PREFIX v: <urn:v:>
        SELECT ?s ?n ?r WHERE { ?s a v:Supplier . OPTIONAL { ?s v:locatedIn ?n ; v:balance ?b . FILTER(?b > 5000) }
          OPTIONAL { ?n v:locatedIn ?r . ?n a v:Nation . FILTER(?r = <urn:t:region/1>) } }""")


@query("SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def sparql_minus(spark, d):
    return select(lifted(spark, d, ("customer", "orders")), """
        PREFIX v: <urn:v:>
        SELECT ?c WHERE { ?c v:segment ?g . MINUS { ?o v:placedBy ?c ; v:priority ?p . FILTER(?p IN ("1-URGENT", "2-HIGH")) } }""")


@query("""SELECT 'urn:t:order/' || o_orderkey AS o, 'urn:t:customer/' || o_custkey AS x FROM orders WHERE o_totalprice > 300000
  UNION SELECT 'urn:t:order/' || o_orderkey, 'urn:t:part/' || l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 300000""")
def sparql_alternative_path(spark, d):
    return select(lifted(spark, d, ("orders", "lineitem")), """
        PREFIX v: <urn:v:>
        SELECT ?o ?x WHERE { ?o v:placedBy|v:orderContains ?x ; v:totalPrice ?p . FILTER(?p > 300000) }""")


# --- stored full-text index -----------------------------------------------------------------------------


def _indexed(spark, d, halves: bool = False) -> TextIndex:
    docs = _table(spark, d, "documents").select("doc_id", "text")
    index = TextIndex(spark, _folder(spark, "text-index"))
    for some in (docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")) if halves else (docs,):
        index.add(some, "doc_id")
    return index


def _found(r):
    return r.select("id", F.round("score", 6).alias("score"))


@query(_BM25.format(where=""))
def text_index_topk(spark, d):
    return _found(_indexed(spark, d).search("the thin*", 20))


@query(_BM25.format(where=""))
def text_index_merged(spark, d):
    """Two segments, merged; the earlier commit goes on answering as it did."""
    index = _indexed(spark, d, halves=True)
    index.merge()
    return _found(index.search("the thin*", 20))


_TREE = """WITH t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents),
  d AS (SELECT id, len(w) AS len, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'der')) AS b, len(list_filter(w, lambda x: starts_with(x, 'qu'))) AS c,
    len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS p FROM t),
  s AS (SELECT count(*) AS n, avg(len) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (p > 0) AS dp FROM d),
  f AS (SELECT id, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / m))
    + ln(1 + (n - dp + 0.5) / (dp + 0.5)) * p * 2.2 / (p + 1.2 * (0.25 + 0.75 * len / m)) AS score FROM d, s WHERE ((a > 0 AND p > 0) OR b > 0) AND c = 0)
  SELECT id, round(score, 6) AS score FROM f"""


@query(_TREE)
def text_index_tree(spark, d):
    """Nested operators, a phrase by positions, an excluded prefix; every document that answers."""
    return _found(_indexed(spark, d).search('((the AND "of the") OR der) AND NOT qu*', None))


@query(_TREE)
def bm25_tree(spark, d):
    """The same by a scan of the texts."""
    from ..operators.search import bm25

    return _found(bm25(_table(spark, d, "documents"), '((the AND "of the") OR der) AND NOT qu*', "doc_id", "text"))


@query(_SEARCH.format(docs=_NAMES, a="red", b="ring", hit="a > 0 OR b > 0", keep="s IN (SELECT 'urn:t:part/' || p_partkey FROM part WHERE p_type = 'PROMO')", top=20))
def search_indexed(spark, d):
    """Entities of a class by the stored index of the graph's texts."""
    g = lifted(spark, d, ("part",))
    index = TextIndex(spark, _folder(spark, "text-index"))
    search.index_literals(g, index)
    return search.search_text(g, "red ring", "v:Part_PROMO", 20, index=index).select("uri", F.round("score", 6).alias("score"))


# --- stored reachability index --------------------------------------------------------------------------


@query("""SELECT 'urn:t:customer/' || c_custkey AS s, 'urn:t:nation/' || c_nationkey AS o FROM customer UNION SELECT 'urn:t:nation/' || n_nationkey, 'urn:t:region/' || n_regionkey FROM nation
  UNION SELECT 'urn:t:customer/' || c_custkey, 'urn:t:region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def reach_index_closure(spark, d):
    e = lifted(spark, d, ("customer", "nation")).edges([V + "locatedIn"], layers=("data",))
    return ReachIndex.build(e, _folder(spark, "reach-index")).closure()


_RING = "CASE WHEN c_custkey % 8 = 7 THEN c_custkey - 7 ELSE c_custkey + 1 END"


@query(f"""WITH RECURSIVE e AS (SELECT c_custkey AS s, {_RING} AS o FROM customer UNION SELECT c_custkey, c_custkey + 1 FROM customer WHERE c_custkey % 32 IN (7, 15, 23) UNION SELECT c_custkey, c_custkey + 9 FROM customer WHERE c_custkey % 32 = 3),
  c AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON e.s = c.o) SELECT 'c/' || s AS s, 'c/' || o AS o FROM c""")
def reach_index_cycles(spark, d):
    """Rings of eight customers, four in a row, with a shortcut: components, other edges and pairs ``(x, x)``."""
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    ring = c.select("k", F.expr(_RING.replace("c_custkey", "k")).alias("to"))
    on = c.where("k % 32 in (7, 15, 23)").select("k", (F.col("k") + 1).alias("to")).union(c.where("k % 32 = 3").select("k", (F.col("k") + 9).alias("to")))
    name = lambda x: F.concat(F.lit("c/"), F.col(x).cast("string"))
    e = ring.union(on).select(name("k").alias("s"), name("to").alias("o"))
    return ReachIndex.build(e, _folder(spark, "reach-index")).closure()


# --- stored graph by commits ----------------------------------------------------------------------------


@query("""WITH o AS (SELECT 'urn:t:order/' || o_orderkey AS s, o_orderstatus AS st, o_orderpriority AS pr FROM orders)
  SELECT 'before' AS seen, s, st AS o FROM o UNION ALL SELECT 'after', s, st FROM o WHERE st <> 'F' OR pr = '1-URGENT'""")
def store_snapshots(spark, d):
    """Deletions and additions after a load, seen by readers of an earlier and of the last commit; then one batch."""
    g = lifted(spark, d, ("orders",))
    status = g.triples([V + "status"]).drop("ontology", "layer")
    urgent = g.triples([V + "priority"]).where("o = '1-URGENT'").select("s")
    store = Store(spark, _folder(spark, "store"))
    store.load(status, "data", ontology="o")
    at, _ = store.log.read()
    store.retract(status.where("o = 'F'"), "o")
    store.load(status.join(urgent, "s", "left_semi"), "data", ontology="o")
    store.compact("o")
    seen = lambda name, n: store.graph(n).triples(ontology="o").select(F.lit(name).alias("seen"), "s", "o")
    return seen("before", at).unionByName(seen("after", None))


# --- statistics and stars -------------------------------------------------------------------------------


@query("""SELECT p, count(*) AS n, count(DISTINCT s) AS subjects, max(k) AS most FROM (SELECT *, count(*) OVER (PARTITION BY p, s) AS k FROM (
  SELECT 'urn:v:placedBy' AS p, o_orderkey AS s, o_custkey::VARCHAR AS o FROM orders UNION SELECT 'urn:v:orderContains', l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT 'urn:v:orderSuppliedBy', l_orderkey, 's' || l_suppkey FROM lineitem)) GROUP BY p""")
def predicate_statistics(spark, d):
    stats = Statistics.collect(lifted(spark, d, ("orders", "lineitem")), _folder(spark, "statistics"))
    rows = [(p, c.n, c.subjects, c.most) for p, c in sorted(stats.by_predicate.items()) if p in (V + "placedBy", V + "orderContains", V + "orderSuppliedBy")]
    return spark.createDataFrame(rows, "p string, n long, subjects long, most long")


_JOIN4 = """SELECT 'urn:t:order/' || o_orderkey AS o, 'urn:t:region/' || n_regionkey AS r, (o_totalprice::DECIMAL(18,2))::VARCHAR AS price, o_orderpriority AS pr
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice::DECIMAL(18,2) > 300000 AND o_orderstatus = 'F'"""


@query(_JOIN4)
def star_join(spark, d):
    """Four patterns of one order in one exchange, then the rest by estimated size."""
    g = lifted(spark, d, ("orders", "customer", "nation"))
    where = [Triple("?o", "v:placedBy", "?c"), Triple("?c", "v:locatedIn", "?n"), Triple("?n", "v:locatedIn", "?r"), Triple("?o", "v:totalPrice", "?price"), Triple("?o", "v:priority", "?pr"), Triple("?o", "v:status", '"F"')]
    stats = Statistics.collect(g, _folder(spark, "statistics"))
    return pattern.query_pattern(g, Pattern(["?o", "?r", "?price", "?pr"], where, [Condition("?price", ">", 300000)], limit=None), stats=stats)


# --- embeddings and vectors that are stored -------------------------------------------------------------


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(trim(text)), '[\\p{L}\\p{N}]+')) AS w FROM documents WHERE length(trim(text)) >= 3),
  p AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM w), x AS (SELECT doc_id, h // 2 % 32 AS k, sum(1 - 2 * (h % 2)) AS x FROM p GROUP BY ALL),
  d AS (SELECT doc_id, k FROM (SELECT doc_id FROM documents WHERE length(trim(text)) >= 3), range(32) AS g(k))
  SELECT doc_id::VARCHAR AS id, string_agg(coalesce(x, 0)::BIGINT::VARCHAR, ',' ORDER BY k) AS vec FROM d LEFT JOIN x USING (doc_id, k) GROUP BY doc_id""")
def embedding_build(spark, d):
    """Every document through the offline provider, cached by content, read back."""
    store = EmbeddingStore(spark, _folder(spark, "embeddings"))
    store.build_texts(_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), HashedWords(32))
    return store.read().select("id", F.array_join(F.transform("vec", lambda x: x.cast("long").cast("string")), ",").alias("vec"))


@query(_KNN.format(where=""))
def vector_index_knn(spark, d):
    v = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    found, _ = VectorIndex.build(v, _folder(spark, "vector-index")).similar(3, 10)
    return found.select("id", F.round("score", 6).alias("score"))


@query(_KNN.format(where="AND label = 2"))
def vector_index_ontology(spark, d):
    v = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.array(F.concat(F.lit("o"), F.col("label"))).alias("ontologies"))
    found, _ = VectorIndex.build(v, _folder(spark, "vector-index")).similar(3, 10, "o2")
    return found.select("id", F.round("score", 6).alias("score"))


# --- independence tests ---------------------------------------------------------------------------------

_WIDE = {
    "status": "o_orderstatus", "priority": "o_orderpriority", "month": "month(o_orderdate)", "year": "year(o_orderdate)", "price": "cast(floor(o_totalprice / 100000) as int)", "segment": "c_mktsegment",
    "nation": "c_nationkey", "rich": "c_acctbal > 5000", "flag": "l_returnflag", "line": "l_linestatus", "quantity": "cast(floor(l_quantity / 10) as int)", "discount": "cast(floor(l_discount * 100) as int) % 4", "tax": "cast(floor(l_tax * 100) as int) % 3", "ship": "month(l_shipdate)",
    "size": "cast(floor(p_size / 10) as int)", "type": "p_type", "brand": "p_brand", "cheap": "p_retailprice < 1000", "even": "o_orderkey % 2", "third": "c_custkey % 3",
}
_ROWS = f"""SELECT {", ".join(f'{e} AS {v}' for v, e in _WIDE.items())} FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"""


def _wide(spark, d):
    """Twenty variables of an order's lines, the customer and the part."""
    t = {n: _table(spark, d, n) for n in ("orders", "customer", "lineitem", "part")}
    j = t["orders"].join(t["customer"], F.expr("o_custkey = c_custkey")).join(t["lineitem"], F.expr("l_orderkey = o_orderkey")).join(t["part"], F.expr("p_partkey = l_partkey"))
    return j.select(*[F.expr(e).alias(v) for v, e in _WIDE.items()])


def _tests_sql(given: str | None) -> str:
    names = [v for v in _WIDE if v != given]
    pairs = ", ".join(f"('{x}', '{y}')" for i, x in enumerate(names) for y in names[i + 1 :])
    z = f"{given}::VARCHAR" if given else "''"
    return f"""WITH t AS ({_ROWS}), m AS MATERIALIZED (SELECT {z} AS z, map([{", ".join(f"'{v}'" for v in names)}], [{", ".join(f"coalesce({v}::VARCHAR, '')" for v in names)}]) AS m, count(*) AS k FROM t GROUP BY ALL),
  p(x, y) AS (VALUES {pairs}), g AS (SELECT p.x, p.y, z, m[p.x] AS a, m[p.y] AS b, sum(k) AS n FROM m, p GROUP BY ALL),
  e AS (SELECT *, n * n / (sum(n) OVER (PARTITION BY x, y, z, a))::DOUBLE / (sum(n) OVER (PARTITION BY x, y, z, b))::DOUBLE AS q FROM g),
  s AS (SELECT x, y, z, sum(n)::DOUBLE * sum(q) - sum(n) AS stat, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df FROM e GROUP BY ALL)
  SELECT x, y, round(sum(stat), 4) + 0 AS stat, sum(df)::BIGINT AS df FROM s GROUP BY x, y"""


def _tested(spark, d, given: str | None):
    names = [v for v in _WIDE if v != given]
    tests = [(x, y, (given,) if given else ()) for i, x in enumerate(names) for y in names[i + 1 :]]
    r = causal.independence(causal.states_of(_wide(spark, d), list(_WIDE)), tests)
    of = spark.createDataFrame([(i, x, y) for i, (x, y, _) in enumerate(tests)], "test int, x string, y string")  # a row a test
    return r.join(F.broadcast(of), "test").select("x", "y", (F.round("stat", 4) + 0).alias("stat"), "df")


@query(_tests_sql(None))
def independence_tests(spark, d):
    """All pairs of twenty variables in one pass."""
    return _tested(spark, d, None)


@query(_tests_sql("segment"))
def independence_given(spark, d):
    """All pairs of nineteen variables within the strata of the twentieth."""
    return _tested(spark, d, "segment")


_COLLIDER = "SELECT o_custkey % 2 AS a, o_orderkey // 3 % 2 AS b, CASE WHEN o_orderkey % 11 = 0 THEN 1 - least(a, b) ELSE least(a, b) END AS c FROM orders"


def _chi(x: str, y: str) -> str:
    return f"(SELECT sum((n - e) * (n - e) / e) FROM (SELECT n, sum(n) OVER (PARTITION BY {x}) * sum(n) OVER (PARTITION BY {y}) / sum(n) OVER () AS e FROM (SELECT {x}, {y}, count(*) AS n FROM t GROUP BY ALL)))"


@query(f"WITH t AS ({_COLLIDER}) SELECT x, 'c' AS y FROM (VALUES ('a'), ('b')) v(x) WHERE {_chi('a', 'b')} < 6.634897 AND {_chi('a', 'c')} > 6.634897 AND {_chi('b', 'c')} > 6.634897")
def discover_collider(spark, d):
    """Two independent causes of one effect: the test orients both edges."""
    t = _table(spark, d, "orders").select(F.expr("o_custkey % 2").alias("a"), F.expr("o_orderkey div 3 % 2").alias("b"), "o_orderkey")
    t = t.withColumn("c", F.expr("case when o_orderkey % 11 = 0 then 1 - least(a, b) else least(a, b) end"))
    return spark.createDataFrame(causal.discover_dag(t, ["a", "b", "c"])["directed"], "x string, y string")


# --- memory ---------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT 'u' || user_id AS subject, event_type AS predicate, 'v' || (event_id % 7) AS object, date_trunc('millisecond', ts) AS t, CASE WHEN event_type = 'view' THEN 86400 * 3 WHEN event_type = 'error' THEN 3600 END AS ttl, (event_id % 11 = 0)::INT AS f FROM events WHERE user_id IS NOT NULL AND ts <= TIMESTAMP '2024-01-20 00:00:00'),
  n AS (SELECT *, coalesce(epoch_ms(t) - epoch_ms(lag(t) OVER w) > 7200000, true)::INT AS new FROM e WINDOW w AS (PARTITION BY subject ORDER BY t, f, predicate, object)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY subject ORDER BY t, f, predicate, object ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM n),
  l AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY t DESC, f DESC, ttl DESC NULLS LAST, session DESC) AS r FROM s)
  SELECT subject, predicate, object, epoch_ms(t) AS said_at, epoch_ms(t) + 1000 * ttl AS expires, session FROM l WHERE r = 1 AND f = 0 AND (ttl IS NULL OR epoch_ms(t) + 1000 * ttl > epoch_ms(TIMESTAMP '2024-01-20 00:00:00'))""")
def memory_live(spark, d):
    """Facts that are alive at a time, with the session that they were last said in."""
    ttl = F.expr("case when event_type = 'view' then 86400L * 3 when event_type = 'error' then 3600L end")
    op = F.when(F.col("event_id") % 11 == 0, "forget").otherwise("assert")
    e = _table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("subject"), F.col("event_type").alias("predicate"), F.concat(F.lit("v"), F.col("event_id") % 7).alias("object"), F.col("ts").cast("timestamp").alias("at"), ttl.alias("ttl"), op.alias("op"))
    r = memory.live(e, "2024-01-20 00:00:00", "2 hours")
    return r.select("subject", "predicate", "object", F.unix_millis("at").alias("said_at"), F.unix_millis("expires").alias("expires"), "session")


# --- taxonomy from text ---------------------------------------------------------------------------------

_TERMS = ["the", "of", "and", "to", "in", "der", "die", "und", "que", "les", "des", "with", "that", "this", "from", "for", "est", "por"]


@query(f"""WITH s AS (SELECT doc_id, i, trim(x) AS x FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM (SELECT row_number() OVER () AS doc_id, regexp_split_to_array(text, '[.!?\\n]+') AS l FROM documents WHERE text IS NOT NULL))),
  w AS (SELECT doc_id, i, list_filter(regexp_split_to_array(lower(x), '[^\\p{{L}}\\p{{N}}]+'), lambda y: y <> '') AS w FROM s),
  c AS (SELECT doc_id, i, k, list_distinct(list_filter(w[k * 64 + 1:k * 64 + 64], lambda y: y IN ({", ".join(f"'{t}'" for t in _TERMS)}))) AS t FROM (SELECT *, unnest(range(0, (len(w) - 1) // 64 + 1)) AS k FROM w WHERE len(w) > 0)),
  e AS (SELECT doc_id, i, k, unnest(t) AS a FROM c), n AS (SELECT a, count(*) AS n FROM e GROUP BY a), ab AS (SELECT x.a, y.a AS b, count(*) AS n_ab FROM e x JOIN e y USING (doc_id, i, k) WHERE x.a <> y.a GROUP BY ALL),
  p AS (SELECT ab.a AS child, ab.b AS parent, n_ab / na.n AS confidence FROM ab JOIN n na ON na.a = ab.a JOIN n nb ON nb.a = ab.b WHERE nb.n > na.n AND n_ab / na.n >= 0.3)
  SELECT child, parent, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY confidence DESC, parent DESC) AS r FROM p) WHERE r = 1""")
def taxonomy_from_text(spark, d):
    """Words under the word that most of their contexts hold."""
    pairs = learn.cooccurrence(_table(spark, d, "documents"), _TERMS)
    return learn.taxonomy(learn.subsumptions(pairs), least=0.3).select("child", "parent", F.round("confidence", 6).alias("confidence"))
