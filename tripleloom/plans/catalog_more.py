"""More registered queries with their SQL twins: stored graphs, answers, search, vectors, reasoning, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics, report
from ..operators import bayes, causal, entities, populate, schema, search, shacl, traverse, vectors
from ..operators.entities import Filter
from ..operators.graph import COLUMNS, Graph
from ..sources import turtle
from ..sources.lift import V, lifted
from ..sources.store import Store
from . import terms as T
from .catalog import _NET, _table, query, smoking
from .materialise import place
from .sparql import select

_LABEL, _TYPE = T.LABEL, T.TYPE


def _folder(spark, what: str) -> str:
    return place(spark, what)


# --- schema ---------------------------------------------------------------------------------------------


@query("""SELECT 'children' AS field, (SELECT string_agg(DISTINCT 'urn:v:Customer_' || c_mktsegment, ',' ORDER BY 'urn:v:Customer_' || c_mktsegment) FROM customer) AS value
  UNION ALL SELECT 'parents', 'urn:v:Agent' UNION ALL SELECT 'properties', 'urn:v:placed,urn:v:segment' UNION ALL SELECT 'instances_inferred', count(*)::VARCHAR FROM customer""")
def class_detail(spark, d):
    r = schema.class_detail(lifted(spark, d, ("customer",)), "v:Customer")
    text = lambda v: ",".join(v) if isinstance(v, list) else str(v)
    return spark.createDataFrame([(k, text(r[k])) for k in ("children", "parents", "properties", "instances_inferred")], "field string, value string")


@query("""WITH c AS (SELECT 'urn:v:' || unnest(['Place', 'Region', 'Nation', 'Agent', 'Customer', 'Supplier', 'Part', 'Order', 'Event', 'Document']) AS x),
  p AS (SELECT 'urn:v:' || unnest(['locatedIn', 'placedBy', 'placed', 'hasBrand', 'orderContains', 'orderSuppliedBy', 'byUser', 'segment', 'balance', 'size', 'status', 'priority', 'totalPrice', 'eventType', 'text']) AS x)
  SELECT md5('{"classes": [' || (SELECT string_agg('"' || x || '"', ', ' ORDER BY x) FROM c) || '], "properties": [' || (SELECT string_agg('"' || x || '"', ', ' ORDER BY x) FROM p) || ']}') AS hash""")
def schema_hash(spark, d):
    return spark.createDataFrame([(schema.schema_hash(lifted(spark, d, ("region",))),)], "hash string")


@query("""WITH c AS (SELECT unnest(['Place', 'Region', 'Nation', 'Agent', 'Customer', 'Supplier', 'Part', 'Order', 'Event', 'Document']) AS x),
  n AS (SELECT 'Nation' AS x, count(*) AS n FROM nation UNION ALL SELECT 'Region', count(*) FROM region), e(x, y) AS (VALUES ('Region', 'Place'), ('Nation', 'Place'), ('Customer', 'Agent'), ('Supplier', 'Agent'))
  SELECT 'node' AS kind, 'urn:v:' || x AS id, x AS label, NULL AS source, NULL AS target, coalesce(n, 0) AS instances FROM c LEFT JOIN n USING (x)
  UNION ALL SELECT 'edge', 'urn:v:' || x || ' subClassOf urn:v:' || y, 'subClassOf', 'urn:v:' || y, 'urn:v:' || x, NULL FROM e""")
def class_graph(spark, d):
    return schema.class_graph(lifted(spark, d, ("nation", "region")))


@query("""SELECT line, count(*) AS n FROM (SELECT unnest(['- Nation <urn:v:Nation> is a <urn:v:Place> (' || (SELECT count(*) FROM nation) || ')', '- locatedIn <urn:v:locatedIn>: urn:v:Place -> urn:v:Place (transitive)']) AS line) GROUP BY line""")
def schema_prompt(spark, d):
    lines = schema.prompt(lifted(spark, d, ("nation", "region"))).split("\n")
    got = [x.replace("- urn:v:", "- ", 1) for x in lines if "<urn:v:Nation> is a" in x or "<urn:v:locatedIn>:" in x]
    return spark.createDataFrame([(x, 1) for x in got], "line string, n long")


# --- answers --------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT *, 'urn:t:supplier/' || s_suppkey AS uri FROM supplier), p AS (SELECT * FROM s ORDER BY uri LIMIT 30)
  SELECT uri, s_name AS label, unnest(['http://www.w3.org/2000/01/rdf-schema#label', 'urn:v:balance', 'urn:v:locatedIn']) AS predicate, unnest([s_name, (s_acctbal::DECIMAL(18,2))::VARCHAR, 'urn:t:nation/' || s_nationkey]) AS value,
    unnest([NULL, NULL, n_name]) AS value_label, (SELECT count(*) FROM s) > 30 AS has_more FROM p JOIN nation ON s_nationkey = n_nationkey""")
def find_answer(spark, d):
    a = entities.answer(lifted(spark, d, ("supplier", "nation")), "v:Supplier")
    a = a.select("uri", "label", "has_more", F.explode("properties").alias("predicate", "values"))
    return a.select("uri", "label", "has_more", "predicate", F.inline("values"))


@query("SELECT 'urn:t:supplier/' || s_suppkey AS a, 'urn:t:nation/' || s_nationkey AS b, s_name AS a_label, n_name AS b_label FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal::DECIMAL(18,2) > 5000")
def find_related_labels(spark, d):
    g = lifted(spark, d, ("supplier", "nation"))
    return entities.with_labels(g, entities.find_related(g, "v:Supplier", "v:locatedIn", "v:Nation", (Filter("v:balance", ">", 5000),)), ("a", "b"))


@query("""SELECT 'urn:t:nation/' || s_nationkey AS uri, 1 AS depth, n_name AS uri_label FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 2
  UNION ALL SELECT 'urn:t:region/' || n_regionkey, 2, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey = 2""")
def traverse_labels(spark, d):
    g = lifted(spark, d, ("supplier", "nation", "region"))
    return entities.with_labels(g, traverse.traverse(g, "t:supplier/2", "v:locatedIn", 3, "out")[0], ("uri",))


@query("""WITH c AS (SELECT c_custkey, n_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1)
  SELECT 1 AS step, 'urn:t:customer/' || c_custkey AS "from", 'urn:t:nation/' || n_nationkey AS "to", true AS forward FROM c UNION ALL SELECT 2, 'urn:t:nation/' || n_nationkey, 'urn:t:region/' || n_regionkey, true FROM c""")
def find_path(spark, d):
    g = lifted(spark, d, ("customer", "nation", "region"))
    key = _table(spark, d, "customer").where("c_custkey = 1").join(_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    path = traverse.find_path(g, "t:customer/1", f"t:region/{key}")
    return spark.createDataFrame([(i + 1, s["from"], s["to"], s["forward"]) for i, s in enumerate(path)], "step int, from string, to string, forward boolean")


@query("SELECT 'urn:t:customer/' || c_custkey AS uri FROM customer WHERE c_custkey <> 5 AND (c_nationkey, c_mktsegment) = (SELECT (c_nationkey, c_mktsegment) FROM customer WHERE c_custkey = 5)")
def same_as(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    iri = lambda c: F.concat(F.lit("urn:t:customer/"), c)
    e = _table(spark, d, "customer").select(iri(F.col("c_custkey")).alias("s"), iri(F.lead("c_custkey").over(w)).alias("o")).where("o is not null")
    rows = e.select(F.lit(None).cast("string").alias("ontology"), F.lit("data").alias("layer"), "s", F.lit("iri").alias("s_kind"), F.lit(T.SAME).alias("p"), "o", F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
    return traverse.same_as(Graph.of(rows), "urn:t:customer/5")


@query("SELECT 'urn:t:supplier/' || s_suppkey AS s, 'urn:v:locatedIn' AS p, 'urn:t:nation/' || s_nationkey AS o FROM supplier")
def typed_edges(spark, d):
    return entities.typed_edges(lifted(spark, d, ("supplier", "nation")))


@query("SELECT 'urn:t:supplier/' || s_suppkey AS uri, s_name || ' (Supplier). balance: ' || (s_acctbal::DECIMAL(18,2))::VARCHAR || '. locatedIn: ' || n_name || '.' AS chunk FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'urn:t:nation/' || n_nationkey, n_name || ' (Nation). locatedIn: ' || n_regionkey || '.' FROM nation")
def entity_chunks(spark, d):
    return entities.chunks(lifted(spark, d, ("supplier", "nation")))


# --- stored graphs --------------------------------------------------------------------------------------


def _stored(spark, d, parts: dict[str | None, str]) -> Store:
    """A store with the nations that a condition picks, an ontology each."""
    g = lifted(spark, d, ("nation",))
    t = g.triples([_LABEL, V + "locatedIn"], layers=("data",)).drop("ontology", "layer")
    store = Store(spark, _folder(spark, "store"), {"t": "urn:t:", "v": V})
    for name, cond in parts.items():
        store.load(t.where(F.regexp_extract("s", r"(\d+)$", 1).cast("int").between(*map(int, cond.split("-")))), "data", ontology=name)
    return store


@query("""WITH a AS (SELECT * FROM nation WHERE n_nationkey BETWEEN 0 AND 14), b AS (SELECT * FROM nation WHERE n_nationkey BETWEEN 10 AND 24)
  SELECT 'a' AS scope, 2 * count(*) AS triples FROM a UNION ALL SELECT 'b', 2 * count(*) FROM b UNION ALL SELECT 'union', 2 * count(*) FROM (FROM a UNION FROM b)""")
def store_union(spark, d):
    g = _stored(spark, d, {"a": "0-14", "b": "10-24"}).graph()
    one = lambda name, o: g.triples(ontology=o).agg(F.count("*").alias("triples")).select(F.lit(name).alias("scope"), "triples")
    return one("a", "a").unionByName(one("b", "b")).unionByName(one("union", None))


@query("""SELECT 'urn:t:nation/' || n_nationkey AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p, n_name AS o, 'literal' AS o_kind FROM nation
  UNION ALL SELECT 'urn:t:nation/' || n_nationkey, 'urn:v:locatedIn', 'urn:t:region/' || n_regionkey, 'iri' FROM nation""")
def store_dump_load(spark, d):
    store = _stored(spark, d, {None: "0-24"})
    path = _folder(spark, "dump")
    store.dump(path, "data", "ttl")
    again = Store(spark, _folder(spark, "store"))
    again.load(turtle.read_ntriples(spark, path), "data")
    again.load(turtle.read_ntriples(spark, path), "data")  # the same triples once more add nothing
    return again.graph().triples().select("s", "p", "o", "o_kind")


@query("""SELECT 'urn:x:a' AS s, o, k AS o_kind FROM (VALUES ('TODO:fix', 'literal'), ('urn:x:b', 'iri'), ('urn:x:c', 'literal'), ('urn:x:c', 'iri')) t(o, k) WHERE NOT (o = 'urn:x:c' AND k = 'literal')
  UNION ALL SELECT 'urn:t:nation/' || n_nationkey, 'urn:t:region/' || n_regionkey, 'iri' FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'urn:t:nation/' || n_nationkey, n_name, 'literal' FROM nation WHERE n_nationkey < 3""")
def store_writes(spark, d):
    store = _stored(spark, d, {"a": "0-2"})
    store.assert_triples([("urn:x:a", "v:note", "TODO:fix"), ("urn:x:a", "v:note", "urn:x:b", True), ("urn:x:a", "v:note", "urn:x:c"), ("urn:x:a", "v:note", "urn:x:c", True)], "a")
    store.retract_triple("urn:x:a", "v:note", "urn:x:c", ontology="a")
    store.retract_triple("urn:x:a", "v:note", "urn:x:none", True, "a")
    return store.graph().triples(ontology="a").select("s", "o", "o_kind")


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation")
def read_nested_json(spark, d):
    path = _folder(spark, "table") + ".jsonl"
    n = _table(spark, d, "nation")
    n.select(F.col("n_nationkey").alias("key"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("at")).write.json(path)
    return populate.read_table(spark, path).select("key", F.col("`at.name`").alias("name"), F.col("`at.region`").alias("region"))


# --- SPARQL ---------------------------------------------------------------------------------------------


@query("SELECT 'urn:t:customer/' || c_custkey AS c, c_mktsegment AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')")
def sparql_values(spark, d):
    return select(lifted(spark, d, ("customer",)), 'PREFIX v: <urn:v:> SELECT ?c ?s WHERE { VALUES ?s { "BUILDING" "HOUSEHOLD" } ?c v:segment ?s }')


@query("SELECT 'urn:t:nation/' || n_nationkey AS n, 'urn:t:supplier/' || s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal::DECIMAL(18,2) > 9000")
def sparql_optional(spark, d):
    return select(lifted(spark, d, ("nation", "supplier")), """
        PREFIX v: <urn:v:> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
        SELECT ?n ?s WHERE { ?n a v:Nation . OPTIONAL { ?s v:locatedIn ?n ; v:balance ?b . FILTER(?b > 9000) } }""")


@query("SELECT 'urn:t:nation/' || c_nationkey AS n, count(*) AS k, round(sum(c_acctbal::DECIMAL(18,2))::DOUBLE, 4) AS total, round(avg(c_acctbal::DECIMAL(18,2)), 4) AS mean FROM customer GROUP BY c_nationkey HAVING count(*) > 60")
def sparql_having(spark, d):
    r = select(lifted(spark, d, ("customer",)), """
        PREFIX v: <urn:v:>
        SELECT ?n (COUNT(?c) AS ?k) (SUM(?b) AS ?total) (AVG(?b) AS ?mean) WHERE { ?c v:locatedIn ?n ; v:balance ?b } GROUP BY ?n HAVING (COUNT(?c) > 60)""")
    return r.select("n", F.col("k").cast("long").alias("k"), F.round(F.col("total").cast("double"), 4).alias("total"), F.round(F.col("mean").cast("double"), 4).alias("mean"))


@query("SELECT 'urn:t:customer/' || c_custkey AS c, k FROM customer JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def sparql_subselect(spark, d):
    r = select(lifted(spark, d, ("customer", "orders")), """
        PREFIX v: <urn:v:>
        SELECT ?c ?k WHERE { ?c v:segment "BUILDING" . { SELECT ?c (COUNT(?o) AS ?k) WHERE { ?o v:placedBy ?c } GROUP BY ?c } }""")
    return r.select("c", F.col("k").cast("long").alias("k"))


@query("SELECT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 9000) AS ask")
def sparql_ask(spark, d):
    return select(lifted(spark, d, ("supplier",)), "PREFIX v: <urn:v:> ASK { ?s v:balance ?b . FILTER(?b > 9000) }")


# --- full text ------------------------------------------------------------------------------------------

#: BM25 over documents ``t(id, s, text)`` for two words.
_SEARCH = """WITH t AS ({docs}), x AS (SELECT id, s, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM t),
  d AS (SELECT id, s, len(w) AS len, len(list_filter(w, lambda x: x = '{a}')) AS a, len(list_filter(w, lambda x: x = '{b}')) AS b FROM x), n AS (SELECT count(*) AS n, avg(len) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM d),
  z AS (SELECT s, max(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (1 - 0.75 + 0.75 * len / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (1 - 0.75 + 0.75 * len / m))) AS score FROM d, n WHERE {hit} GROUP BY s)
  SELECT s AS uri, round(score, 6) AS score FROM z WHERE {keep} ORDER BY z.score DESC, s LIMIT {top}"""
_NAMES = "SELECT p_partkey AS id, 'urn:t:part/' || p_partkey AS s, p_name AS text FROM part"


def _scores(df: DataFrame) -> DataFrame:
    return df.select("uri", F.round("score", 6).alias("score"))


@query(_SEARCH.format(docs=_NAMES, a="red", b="ring", hit="a > 0 AND b > 0", keep="true", top=50))
def search_and(spark, d):
    return _scores(search.search_text(lifted(spark, d, ("part",)), "red AND ring", "v:Part", 50))


@query(f"""WITH t AS ({_NAMES}), x AS (SELECT s, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM t),
  d AS (SELECT s, len(w) AS len, len(list_filter(range(1, len(w)), lambda i: w[i] = 'red' AND w[i + 1] = 'widget')) AS p FROM x), n AS (SELECT count(*) AS n, avg(len) AS m, count(*) FILTER (p > 0) AS dp FROM d)
  SELECT s AS uri, round(ln(1 + (n - dp + 0.5) / (dp + 0.5)) * p * 2.2 / (p + 1.2 * (0.25 + 0.75 * len / m)), 6) AS score FROM d, n WHERE p > 0 ORDER BY score DESC, s LIMIT 50""")
def search_phrase(spark, d):
    return _scores(search.search_text(lifted(spark, d, ("part",)), '"red widget"', "v:Part", 50))


@query(_SEARCH.format(docs=_NAMES, a="red", b="ring", hit="a > 0 OR b > 0", keep="s IN (SELECT 'urn:t:part/' || p_partkey FROM part WHERE p_type = 'PROMO')", top=20))
def search_class(spark, d):
    return _scores(search.search_text(lifted(spark, d, ("part",)), "red ring", "v:Part_PROMO", 20))


@query(_SEARCH.format(docs=_NAMES + " UNION ALL SELECT -1 - p_partkey, 'urn:t:part/' || p_partkey, p_type FROM part", a="promo", b="red", hit="a > 0 OR b > 0", keep="true", top=100))
def search_all_properties(spark, d):
    return _scores(search.search_text(lifted(spark, d, ("part",)), "promo red", "v:Part", 100, fields="all"))


@query(_SEARCH.format(docs="SELECT p_partkey AS id, 'urn:t:part/' || p_partkey AS s, p_name || chr(10) || p_type AS text FROM part", a="promo", b="red", hit="a > 0 AND b > 0", keep="true", top=100))
def search_node(spark, d):
    return _scores(search.search_text(lifted(spark, d, ("part",)), "promo AND red", "v:Part", 100, fields="node"))


# --- vectors --------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT 'urn:t:part/' || vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT id, e[1:32] AS a, e[33:64] AS b FROM v WHERE id IN (SELECT 'urn:t:part/' || p_partkey FROM part WHERE p_type = 'PROMO') OR id = 'urn:t:part/3'),
  q AS (SELECT a AS qa, b AS qb FROM c WHERE id = 'urn:t:part/3'), s AS (SELECT id, list_cosine_similarity(a, qa) AS sa, list_cosine_similarity(b, qb) AS sb FROM c, q WHERE id <> 'urn:t:part/3'),
  r AS (SELECT id, row_number() OVER (ORDER BY sa DESC, id) AS r FROM s UNION ALL SELECT id, row_number() OVER (ORDER BY sb DESC, id) FROM s)
  SELECT id AS uri, round(sum(1 / (60 + r)), 6) AS score FROM r WHERE r <= 20 GROUP BY id ORDER BY sum(1 / (60 + r)) DESC, uri LIMIT 10""")
def hybrid_search(spark, d):
    v = _table(spark, d, "embeddings").select(F.concat(F.lit("urn:t:part/"), F.col("vec_id")).alias("id"), "embedding")
    half = lambda start: v.select("id", F.slice("embedding", start, 32).alias("vec"))
    return _scores(vectors.hybrid_search(lifted(spark, d, ("part",)), half(1), half(33), "urn:t:part/3", 10, "v:Part_PROMO"))


@query("SELECT vec_id AS id, CASE WHEN vec_id < 300 AND vec_id % 3 = 0 THEN 'b,c' WHEN vec_id % 3 = 0 THEN 'b,c' ELSE 'b' END AS tags FROM embeddings WHERE vec_id >= 200 UNION ALL SELECT vec_id, 'c' FROM embeddings WHERE vec_id < 200 AND vec_id % 3 = 0")
def vector_store(spark, d):
    v = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    t = v.limit(0).withColumn("ontologies", F.array().cast("array<string>"))
    for name, some in (("a", v.where("id < 300")), ("b", v.where("id >= 200")), ("c", v.where("id % 3 = 0"))):
        t = vectors.upsert(t, some, name)
    return vectors.untag(t, "a").select("id", F.array_join("ontologies", ",").alias("tags"))


# --- networks and causes --------------------------------------------------------------------------------


@query(_NET + ", j AS (SELECT pg * ps AS w, pc FROM g JOIN s USING (g) JOIN c USING (g, s) WHERE s = 'no') SELECT unnest(['yes', 'no']) AS state, unnest([round((sum(w * pc) / sum(w))::DOUBLE, 6), round((1 - sum(w * pc) / sum(w))::DOUBLE, 6)]) AS p FROM j")
def bayes_as_triples(spark, d):
    store = Store(spark, _folder(spark, "store"))
    store._put(bayes.to_triples(spark, smoking()).drop("ontology", "layer"), None, "probabilistic")
    net = bayes.from_triples(store.graph().spark.createDataFrame(store.rows().where("layer = 'probabilistic'").collect(), ", ".join(f"{c} string" for c in COLUMNS)))
    return bayes.posterior_frame(spark, net, "Cancer", {"Smoking": "no"}).select("state", F.round("p", 6).alias("p"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus IN ('F', 'O', 'P') GROUP BY ALL")
def observations(spark, d):
    g = lifted(spark, d, ("orders",))
    from ..operators.graph import instances

    rows = bayes.gather_observations(g.triples([V + "status", V + "priority"], layers=("data",)), instances(g, V + "Order"), {"status": V + "status", "priority": V + "priority"}, {"status": ["F", "O", "P"], "priority": ["1-URGENT", "5-LOW"]})
    return rows.groupBy("status", "priority").agg(F.count("*").alias("n"))


@query(_NET + """, p AS (SELECT sum(pg * ps * pc) / sum(pg * ps) AS see FROM g JOIN s USING (g) JOIN c USING (g, s) WHERE s = 'yes'), a AS (SELECT sum(pg * pc) AS act FROM g JOIN c USING (g) WHERE s = 'yes'),
  q(id, kind, want, tol) AS (VALUES ('q1', 'posterior', 0.72, 0.01), ('q2', 'posterior', 0.5, 0.01), ('q3', 'do', 0.6, 0.01), ('q4', 'do', 0.72, 0.1))
  SELECT id, kind, abs(CASE kind WHEN 'do' THEN act ELSE see END - want) <= tol AS passed FROM q, p, a UNION ALL SELECT 'q5', 'identify', true UNION ALL SELECT 'q6', 'nonsense', false""")
def reasoning_goldset(spark, d):
    dag = causal.Dag([("Genotype", "Smoking"), ("Genotype", "Cancer"), ("Smoking", "Cancer")], ["Genotype", "Smoking", "Cancer"])
    q = [report.Question(i, k, "Cancer", expected={"yes": w}, tolerance=t, **{"given" if k == "posterior" else "do": {"Smoking": "yes"}}) for i, k, w, t in (("q1", "posterior", 0.72, 0.01), ("q2", "posterior", 0.5, 0.01), ("q3", "do", 0.6, 0.01), ("q4", "do", 0.72, 0.1))]
    q += [report.Question("q5", "identify", treatment="Smoking", outcome="Cancer", identifiable=True, backdoor=["Genotype"]), report.Question("q6", "nonsense")]
    return report.check_reasoning(spark, q, smoking(), dag).select("id", "kind", "passed")


@query(_NET + """, a AS (SELECT round(sum(pg * pc)::DOUBLE, 6) AS act FROM g JOIN c USING (g) WHERE s = 'yes'), b AS (SELECT round((sum(pg * ps * pc) / sum(pg * ps))::DOUBLE, 6) AS see FROM g JOIN s USING (g) JOIN c USING (g, s) WHERE s = 'yes') SELECT see, act FROM a, b""")
def see_and_do(spark, d):
    see = bayes.posterior(smoking(), ["Cancer"], {"Smoking": "yes"})["Cancer"]["yes"]
    act = causal.do_query(smoking(), {"Smoking": "yes"}, ["Cancer"])["Cancer"]["yes"]
    return spark.createDataFrame([(round(see, 6), round(act, 6))], "see double, act double")


_CHAIN = "SELECT o_custkey % 2 AS a, CASE WHEN o_orderkey % 10 = 0 THEN 1 - o_custkey % 2 ELSE o_custkey % 2 END AS b, CASE WHEN o_orderkey % 7 = 0 THEN 1 - b ELSE b END AS c FROM orders"


def _chi2(x: str, y: str, z: str) -> str:
    """Chi-square of x against y within the strata z."""
    return f"(SELECT sum((n - e) * (n - e) / e) FROM (SELECT n, sum(n) OVER (PARTITION BY {z}, {x}) * sum(n) OVER (PARTITION BY {z}, {y}) / sum(n) OVER (PARTITION BY {z}) AS e FROM (SELECT {x}, {y}, {z} AS {z if z.isalpha() else 'one'}, count(*) AS n FROM t GROUP BY ALL)))"


@query(f"""WITH t AS ({_CHAIN}), one AS (SELECT 1),
  p(x, y, m, k) AS (SELECT 'a', 'b', {_chi2("a", "b", "1")}, {_chi2("a", "b", "c")} UNION ALL SELECT 'a', 'c', {_chi2("a", "c", "1")}, {_chi2("a", "c", "b")} UNION ALL SELECT 'b', 'c', {_chi2("b", "c", "1")}, {_chi2("b", "c", "a")})
  SELECT x, y FROM p WHERE m > 6.634897 AND k > 9.210340""")
def discover_skeleton(spark, d):
    t = _table(spark, d, "orders").select(F.expr("cast(o_custkey % 2 as string)").alias("a"), F.expr("cast(case when o_orderkey % 10 = 0 then 1 - o_custkey % 2 else o_custkey % 2 end as string)").alias("b"), "o_orderkey")
    t = t.select("a", "b", F.expr("case when o_orderkey % 7 = 0 then cast(1 - cast(b as int) as string) else b end").alias("c"))
    return spark.createDataFrame(causal.discover_dag(t, ["a", "b", "c"])["skeleton"], "x string, y string")


# --- constraints ----------------------------------------------------------------------------------------


@query("""SELECT 'urn:t:supplier/' || s_suppkey AS focus, 'urn:v:locatedIn' AS path, 'urn:t:nation/' || s_nationkey AS value, 'class' AS "constraint" FROM supplier
  UNION ALL SELECT 'urn:t:supplier/' || s_suppkey, 'http://www.w3.org/2000/01/rdf-schema#label', s_name, 'pattern' FROM supplier WHERE NOT regexp_matches(s_name, '[0-4]$')
  UNION ALL SELECT 'urn:t:supplier/' || s_suppkey, 'urn:v:balance', (s_acctbal::DECIMAL(18,2))::VARCHAR, 'nodeKind' FROM supplier""")
def shacl_class_pattern_kind(spark, d):
    c = [shacl.Constraint("v:Supplier", "v:locatedIn", of_class="v:Region"), shacl.Constraint("v:Supplier", _LABEL, pattern="[0-4]$"), shacl.Constraint("v:Supplier", "v:balance", node_kind="IRI")]
    return shacl.validate(lifted(spark, d, ("supplier", "nation", "region")), c)


@query("SELECT 'urn:v:size' AS p, count(*) AS n FROM part WHERE p_size <= 40 UNION ALL SELECT 'urn:v:retailPrice', count(*) FROM part")
def keep_valid(spark, d):
    g = lifted(spark, d, ("part",))
    bad = shacl.validate(g, [shacl.Constraint("v:Part", "v:size", max_inclusive=40)])
    return shacl.keep_valid(g.triples([V + "size", V + "retailPrice"], layers=("data",)), bad).groupBy("p").agg(F.count("*").alias("n"))


@query("""WITH p(d, p, r) AS (VALUES ('Place', 'locatedIn', 'Place'), ('Order', 'placedBy', 'Customer'), ('Customer', 'placed', 'Order'), ('Part', 'hasBrand', 'Brand'), ('Order', 'orderContains', 'Part'), ('Order', 'orderSuppliedBy', 'Supplier'), ('Event', 'byUser', 'User')),
  q(d, p, r) AS (VALUES ('Customer', 'segment', 'string'), ('Agent', 'balance', 'decimal'), ('Part', 'size', 'integer'), ('Order', 'status', 'string'), ('Order', 'priority', 'string'), ('Order', 'totalPrice', 'decimal'), ('Event', 'eventType', 'string'), ('Document', 'text', 'string'))
  SELECT 'urn:v:' || d AS target, 'urn:v:' || p AS path, NULL AS datatype, 'urn:v:' || r AS of_class FROM p UNION ALL SELECT 'urn:v:' || d, 'urn:v:' || p, 'http://www.w3.org/2001/XMLSchema#' || r, NULL FROM q""")
def derive_constraints(spark, d):
    return spark.createDataFrame([(c.target, c.path, c.datatype, c.of_class) for c in shacl.derive(lifted(spark, d, ("region",)))], "target string, path string, datatype string, of_class string")


# --- population and memory ------------------------------------------------------------------------------


@query("""WITH l(name, class) AS (VALUES ('red', 'urn:v:Colour'), ('ring', 'urn:v:Thing'), ('widget', 'urn:v:Thing')), f AS (SELECT DISTINCT name, class FROM l JOIN part ON list_contains(string_split(p_name, ' '), name))
  SELECT 'urn:x:' || name AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, class AS o FROM f UNION ALL SELECT 'urn:x:' || name, 'http://www.w3.org/2000/01/rdf-schema#label', name FROM f""")
def populate_text(spark, d):
    lexicon = {"red": V + "Colour", "ring": V + "Thing", "widget": V + "Thing", "small": V + "Unknown"}
    return populate.populate_text(_table(spark, d, "part").select(F.col("p_name").alias("text")), populate.gazetteer(lexicon), [V + "Colour", V + "Thing"], [], "urn:x:").select("s", "p", "o")


@query("SELECT name, CASE WHEN name = 'BUILDING' THEN 'urn:x:1' WHEN name = 'Machinery' THEN 'urn:x:2' ELSE 'urn:n:' || lower(name) END AS uri FROM (SELECT DISTINCT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Machinery' ELSE c_mktsegment END AS name FROM customer)")
def normalise_names(spark, d):
    names = _table(spark, d, "customer").select(F.when(F.col("c_mktsegment") == "MACHINERY", "Machinery").otherwise(F.col("c_mktsegment")).alias("name"))
    aliases = spark.createDataFrame([("BUILDING", "urn:x:1"), ("MACHINERY", "urn:x:2"), ("building", "urn:x:3")], "alias string, uri string")
    return populate.normalise(names, aliases, "urn:n:")


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS entities, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM events")
def memory_stats(spark, d):
    r = populate.memory_stats(_table(spark, d, "events").select(F.col("user_id").alias("s"), F.col("ts").alias("asserted_at")))
    return r.select("n", "entities", F.unix_micros(F.col("first").cast("timestamp")).alias("first"), F.unix_micros(F.col("last").cast("timestamp")).alias("last"))


@query("SELECT 'urn:t:nation/' || n_nationkey AS s, 'urn:t:region/' || n_regionkey AS o FROM nation WHERE n_regionkey <> 2 AND n_nationkey <> 7")
def memory_forget(spark, d):
    t = lifted(spark, d, ("nation",)).triples([V + "locatedIn"], layers=("data",))
    return populate.forget(populate.forget(t, "urn:t:region/2"), "urn:t:nation/7").select("s", "o")


# --- evaluation -----------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN r >= 0.7 AND u >= 0.7 AND (s IS NULL OR s >= 0.7) THEN 'sufficient' WHEN r < 0.3 OR u < 0.3 OR s < 0.3 THEN 'insufficient' ELSE 'ambiguous' END AS verdict FROM (SELECT p_partkey, p_size / 50 AS r, (p_partkey % 11) / 10 AS u, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 7) / 6 END AS s FROM part)")
def answer_verdict(spark, d):
    s = F.expr("case when p_partkey % 2 = 0 then (p_partkey % 7) / 6 end")
    return _table(spark, d, "part").select("p_partkey", populate.judge(F.col("p_size") / 50, F.expr("(p_partkey % 11) / 10"), s).alias("verdict"))


@query("""SELECT p_partkey, len(list_filter(['ring', 'widget', 'red'], lambda x: contains(p_name, x))) / 3 AS used, (contains(p_name, 'red')::INT + contains(p_name, 'small')::INT) / 2 AS covered FROM part""")
def answer_axes(spark, d):
    words = F.split("p_name", " ")
    return _table(spark, d, "part").select("p_partkey", populate.usage(F.col("p_name"), F.array(*map(F.lit, ("ring", "widget", "red", "ab")))).alias("used"), populate.coverage(words, F.array(F.lit("red"), F.lit("small"))).alias("covered"))


def _run(spark, d, shift: int) -> DataFrame:
    """The customers as if they were the questions of a run."""
    c = _table(spark, d, "customer").where(F.col("c_custkey") % 10 != shift)
    return c.select(F.col("c_name").alias("id"), F.col("c_mktsegment").alias("difficulty"), F.col("c_nationkey").cast("string").alias("category"), F.when((F.col("c_custkey") + shift) % 9 == 0, "error").otherwise("ok").alias("status"), ((F.col("c_custkey") + shift) % 3).alias("row_count"))


@query("""WITH a AS (SELECT c_name AS id, c_mktsegment AS d, CASE WHEN (c_custkey + 1) % 9 = 0 THEN NULL ELSE (c_custkey + 1) % 3 END AS n FROM customer WHERE c_custkey % 10 <> 1), b AS (SELECT c_name AS id, c_mktsegment AS d, CASE WHEN (c_custkey + 2) % 9 = 0 THEN NULL ELSE (c_custkey + 2) % 3 END AS n FROM customer WHERE c_custkey % 10 <> 2)
  SELECT coalesce(a.id, b.id) AS id, coalesce(a.d, b.d) AS difficulty, a.n AS n_a, b.n AS n_b, CASE WHEN a.id IS NULL THEN 'only b' WHEN b.id IS NULL THEN 'only a' WHEN a.n = b.n THEN '=' WHEN a.n > b.n THEN '▲' WHEN a.n < b.n THEN '▼' ELSE '' END AS change FROM a FULL JOIN b ON a.id = b.id""")
def report_compare(spark, d):
    return report.side_by_side(_run(spark, d, 1), _run(spark, d, 2))


@query("SELECT c_mktsegment AS difficulty, count(*) FILTER ((c_custkey + 1) % 9 <> 0) AS ok, count(*) FILTER ((c_custkey + 1) % 9 = 0) AS errors, count(*) FILTER ((c_custkey + 1) % 9 <> 0 AND (c_custkey + 1) % 3 = 0) AS empty FROM customer WHERE c_custkey % 10 <> 1 GROUP BY 1")
def report_outcome(spark, d):
    return report.outcome(_run(spark, d, 1))


@query("SELECT c_nationkey::VARCHAR AS category, count(*) AS n FROM customer WHERE c_custkey % 10 <> 1 GROUP BY 1")
def category_counters(spark, d):
    return report.counters(_run(spark, d, 1), "category")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT 'urn:t:customer/' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)) AS inferred, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS used, round((SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') / (SELECT count(*) FROM customer), 6) AS score")
def inference_use(spark, d):
    g = lifted(spark, d, ("customer", "nation"))
    direct = g.edges([V + "locatedIn"], layers=("data",)).where("s like '%customer%'").select("s", "o")
    every = traverse.closure(g.edges([V + "locatedIn"], layers=("data",))).where("s like '%customer%'")
    said = every.join(g.triples([V + "segment"]).where("o = 'BUILDING'").select("s"), "s", "left_semi")
    return metrics.inference_utilisation(every, direct, said).withColumn("score", F.round("score", 6))
