"""Registered queries over the standard tables, with their SQL twins on the relational form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import bayes, causal, entities, graph, pattern, populate, schema, search, shacl, traverse, vectors
from ..operators.entities import Filter
from ..operators.pattern import Condition, Pattern, Triple
from ..sources.lift import V, lifted

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def count_class(spark, d):
    return entities.count_entities(lifted(spark, d, ("customer",)), "v:Customer_BUILDING")


@query("SELECT count(*) AS n FROM customer")
def count_subclass(spark, d):
    return entities.count_entities(lifted(spark, d, ("customer",)), "v:Customer")


@query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n")
def count_superclass(spark, d):
    return entities.count_entities(lifted(spark, d, ("customer", "supplier")), "v:Agent")


def _find(spark, d, tables, cls, *filters):
    return entities.find_entities(lifted(spark, d, tables), cls, filters, limit=None)


@query("SELECT 'urn:t:customer/' || c_custkey AS uri, c_name AS label FROM customer WHERE c_mktsegment = 'MACHINERY'")
def find_eq(spark, d):
    return _find(spark, d, ("customer",), "v:Customer", Filter("v:segment", "=", "MACHINERY"))


@query("SELECT 'urn:t:customer/' || c_custkey AS uri, c_name AS label FROM customer WHERE lower(c_mktsegment) = 'machinery'")
def find_eq_ci(spark, d):
    return _find(spark, d, ("customer",), "v:Customer", Filter("v:segment", "=", "machinery"))


@query("SELECT 'urn:t:customer/' || c_custkey AS uri, c_name AS label FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def find_ne(spark, d):
    return _find(spark, d, ("customer",), "v:Customer", Filter("v:segment", "!=", "MACHINERY"))


@query("SELECT 'urn:t:customer/' || c_custkey AS uri, c_name AS label FROM customer WHERE c_acctbal::DECIMAL(18,2) > 5000")
def find_gt(spark, d):
    return _find(spark, d, ("customer",), "v:Customer", Filter("v:balance", ">", 5000))


@query("SELECT 'urn:t:part/' || p_partkey AS uri, p_name AS label FROM part WHERE p_size >= 40")
def find_gte(spark, d):
    return _find(spark, d, ("part",), "v:Part", Filter("v:size", ">=", 40))


@query("SELECT 'urn:t:supplier/' || s_suppkey AS uri, s_name AS label FROM supplier WHERE s_acctbal::DECIMAL(18,2) < 0.5 OR s_acctbal::DECIMAL(18,2) < 2000")
def find_lt(spark, d):
    return _find(spark, d, ("supplier",), "v:Supplier", Filter("v:balance", "<", 2000))


@query("SELECT 'urn:t:part/' || p_partkey AS uri, p_name AS label FROM part WHERE p_size <= 10 AND p_retailprice::DECIMAL(18,2) <= 1200")
def find_lte_and(spark, d):
    return _find(spark, d, ("part",), "v:Part", Filter("v:size", "<=", 10), Filter("v:retailPrice", "<=", 1200))


@query("SELECT 'urn:t:part/' || p_partkey AS uri, p_name AS label FROM part WHERE contains(p_name, 'red')")
def find_contains(spark, d):
    from .terms import LABEL

    return _find(spark, d, ("part",), "v:Part", Filter(LABEL, "contains", "red"))


@query("SELECT 'urn:t:part/' || p_partkey AS uri, p_name AS label FROM part WHERE starts_with(p_type, 'PRO')")
def find_starts_with(spark, d):
    return _find(spark, d, ("part",), "v:Part", Filter("v:partType", "starts_with", "PRO"))


@query("SELECT 'urn:t:customer/' || c_custkey AS uri, c_name AS label FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal::DECIMAL(18,2) > 0")
def find_two_filters(spark, d):
    return _find(spark, d, ("customer",), "v:Customer", Filter("v:segment", "=", "BUILDING"), Filter("v:balance", ">", 0))


@query("""SELECT uri, predicate, value, value_kind FROM (
  SELECT 'urn:t:supplier/' || s_suppkey AS uri, unnest(['http://www.w3.org/2000/01/rdf-schema#label', 'urn:v:locatedIn', 'urn:v:balance']) AS predicate,
    unnest([s_name, 'urn:t:nation/' || s_nationkey, (s_acctbal::DECIMAL(18,2))::VARCHAR]) AS value, unnest(['literal', 'iri', 'literal']) AS value_kind FROM supplier)""")
def find_properties(spark, d):
    g = lifted(spark, d, ("supplier",))
    return entities.properties(g, entities.find_entities(g, "v:Supplier", limit=None))


@query("SELECT c_mktsegment AS value, count(*)::DOUBLE AS result FROM customer GROUP BY 1")
def agg_count(spark, d):
    return entities.aggregate(lifted(spark, d, ("customer",)), "v:Customer", "v:segment", "count")


_BY_SIZE = "SELECT p_size::VARCHAR AS value, {}::DOUBLE AS result FROM part GROUP BY 1"


@query(_BY_SIZE.format("sum(p_size)"))
def agg_sum(spark, d):
    return entities.aggregate(lifted(spark, d, ("part",)), "v:Part", "v:size", "sum")


@query(_BY_SIZE.format("avg(p_size)"))
def agg_avg(spark, d):
    return entities.aggregate(lifted(spark, d, ("part",)), "v:Part", "v:size", "avg")


@query(_BY_SIZE.format("min(p_size)"))
def agg_min(spark, d):
    return entities.aggregate(lifted(spark, d, ("part",)), "v:Part", "v:size", "min")


@query(_BY_SIZE.format("max(p_size)"))
def agg_max(spark, d):
    return entities.aggregate(lifted(spark, d, ("part",)), "v:Part", "v:size", "max")


@query("SELECT c_mktsegment AS value, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS result FROM customer GROUP BY 1")
def agg_measure(spark, d):
    return entities.aggregate(lifted(spark, d, ("customer",)), "v:Customer", "v:segment", "sum", measure="v:balance")


@query("""SELECT * FROM (
  SELECT unnest(['http://www.w3.org/2000/01/rdf-schema#label', 'urn:v:locatedIn', 'urn:v:segment', 'urn:v:balance', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS predicate,
    unnest([c_name, 'urn:t:nation/' || c_nationkey, c_mktsegment, (c_acctbal::DECIMAL(18,2))::VARCHAR, 'urn:v:Customer_' || c_mktsegment]) AS value,
    unnest(['literal', 'iri', 'literal', 'literal', 'iri']) AS value_kind, false AS inverse FROM customer WHERE c_custkey = 7
  UNION ALL SELECT 'urn:v:placed', 'urn:t:order/' || o_orderkey, 'iri', true FROM orders WHERE o_custkey = 7)""")
def describe_with_inverse(spark, d):
    return entities.describe_entity(lifted(spark, d, ("customer", "orders")), "t:customer/7")


@query("SELECT 'urn:t:customer/' || c_custkey AS a, 'urn:t:nation/' || c_nationkey AS b FROM customer JOIN nation ON c_nationkey = n_nationkey")
def find_related(spark, d):
    return entities.find_related(lifted(spark, d, ("customer", "nation")), "v:Customer", "v:locatedIn", "v:Nation", infer=True)


@query("SELECT 'urn:t:order/' || o_orderkey AS a, 'urn:t:customer/' || o_custkey AS b FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice::DECIMAL(18,2) > 200000 AND c_mktsegment = 'BUILDING'")
def find_related_filtered(spark, d):
    return entities.find_related(lifted(spark, d, ("customer", "orders")), "v:Order", "v:placedBy", "v:Customer", (Filter("v:totalPrice", ">", 200000),), (Filter("v:segment", "=", "BUILDING"),), infer=True)


@query("SELECT 'urn:v:Customer_' || c_mktsegment AS uri, count(*) AS instances FROM customer GROUP BY 1 UNION ALL SELECT 'urn:v:Nation', count(*) FROM nation UNION ALL SELECT 'urn:v:Region', count(*) FROM region")
def schema_counts(spark, d):
    g = lifted(spark, d, ("customer", "nation", "region"))
    return g.triples(["http://www.w3.org/1999/02/22-rdf-syntax-ns#type"], layers=("data",)).groupBy(F.col("o").alias("uri")).agg(F.count_distinct("s").alias("instances"))


@query("SELECT 'urn:v:Nation' AS uri, 'urn:v:Place' AS parent, (SELECT count(*) FROM nation) AS instances UNION ALL SELECT 'urn:v:Region', 'urn:v:Place', (SELECT count(*) FROM region)")
def schema_classes(spark, d):
    return schema.classes(lifted(spark, d, ("nation", "region"))).where("instances > 0").select("uri", "parent", "instances")


@query("SELECT unnest(['urn:v:byUser', 'urn:v:hasBrand', 'urn:v:locatedIn', 'urn:v:orderContains', 'urn:v:orderSuppliedBy', 'urn:v:placed', 'urn:v:placedBy']) AS uri, unnest(['urn:v:Event', 'urn:v:Part', 'urn:v:Place', 'urn:v:Order', 'urn:v:Order', 'urn:v:Customer', 'urn:v:Order']) AS domain, unnest([false, false, true, false, false, false, false]) AS transitive, unnest([NULL, NULL, NULL, NULL, NULL, 'urn:v:placedBy', NULL]) AS inverse")
def schema_properties(spark, d):
    return schema.properties(lifted(spark, d, ("region",))).where("kind like '%ObjectProperty'").select("uri", "domain", "transitive", "inverse")


@query("SELECT (SELECT count(*) FROM region) * 2 + (SELECT count(*) FROM nation) * 3 AS data_triples, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS typed_entities")
def graph_status(spark, d):
    return graph.status(lifted(spark, d, ("region", "nation"))).select("data_triples", "typed_entities")


@query("SELECT 'urn:t:order/' || o_orderkey AS o, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
def pattern_join2(spark, d):
    return pattern.query_pattern(lifted(spark, d, ("orders", "customer")), Pattern(["?o", "?seg"], [Triple("?o", "v:placedBy", "?c"), Triple("?c", "v:segment", "?seg"), Triple("?o", "v:priority", '"1-URGENT"')], limit=None))


@query("""SELECT 'urn:t:order/' || o_orderkey AS o, 'urn:t:region/' || n_regionkey AS r, (o_totalprice::DECIMAL(18,2))::VARCHAR AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice::DECIMAL(18,2) > 300000""")
def pattern_join4(spark, d):
    p = Pattern(["?o", "?r", "?price"], [Triple("?o", "v:placedBy", "?c"), Triple("?c", "v:locatedIn", "?n"), Triple("?n", "v:locatedIn", "?r"), Triple("?o", "v:totalPrice", "?price")], [Condition("?price", ">", 300000)], limit=None)
    return pattern.query_pattern(lifted(spark, d, ("orders", "customer", "nation")), p)


@query("SELECT 'urn:t:supplier/' || s_suppkey AS s, 'urn:t:customer/' || c_custkey AS c FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_mktsegment = 'HOUSEHOLD'")
def pattern_shared_attr(spark, d):
    t = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    p = Pattern(["?s", "?c"], [Triple("?s", "v:locatedIn", "?n"), Triple("?c", "v:locatedIn", "?n"), Triple("?s", t, "v:Supplier"), Triple("?c", "v:segment", '"HOUSEHOLD"')], limit=None)
    return pattern.query_pattern(lifted(spark, d, ("supplier", "customer")), p)


@query("SELECT DISTINCT 'urn:t:nation/' || c_nationkey AS n FROM customer ORDER BY n LIMIT 10 OFFSET 5")
def pattern_distinct_offset(spark, d):
    return pattern.query_pattern(lifted(spark, d, ("customer",)), Pattern(["?n"], [Triple("?c", "v:locatedIn", "?n")], distinct=True, limit=10, offset=5))


@query("""WITH h1 AS (SELECT 'urn:t:part/' || l_partkey AS uri FROM lineitem WHERE l_orderkey = 1 UNION SELECT 'urn:t:supplier/' || l_suppkey FROM lineitem WHERE l_orderkey = 1
    UNION SELECT 'urn:t:customer/' || o_custkey FROM orders WHERE o_orderkey = 1 UNION SELECT 'urn:v:Order_' || o_orderstatus FROM orders WHERE o_orderkey = 1),
  h2 AS (SELECT 'urn:v:Order' AS uri UNION SELECT 'urn:t:nation/' || c_nationkey FROM customer WHERE 'urn:t:customer/' || c_custkey IN (FROM h1) UNION SELECT 'urn:v:Customer_' || c_mktsegment FROM customer WHERE 'urn:t:customer/' || c_custkey IN (FROM h1))
  SELECT uri, 1 AS depth FROM h1 UNION ALL SELECT uri, 2 FROM h2 WHERE uri NOT IN (FROM h1)""")
def traverse_out_2hops(spark, d):
    return traverse.traverse(lifted(spark, d, ("lineitem", "orders", "customer")), "t:order/1", None, 2, "out")[0]


@query("""WITH h1 AS (SELECT 'urn:t:region/' || n_regionkey AS uri FROM nation WHERE n_nationkey = 3 UNION SELECT 'urn:t:supplier/' || s_suppkey FROM supplier WHERE s_nationkey = 3),
  h2 AS (SELECT 'urn:t:nation/' || n_nationkey AS uri FROM nation WHERE n_nationkey <> 3 AND 'urn:t:region/' || n_regionkey IN (FROM h1))
  SELECT uri, 1 AS depth FROM h1 UNION ALL SELECT uri, 2 FROM h2""")
def traverse_both(spark, d):
    return traverse.traverse(lifted(spark, d, ("nation", "supplier")), "t:nation/3", "v:locatedIn", 2, "both")[0]


@query("""WITH RECURSIVE e AS (SELECT 'urn:t:nation/' || n_nationkey AS u, 'urn:t:region/' || n_regionkey AS v FROM nation UNION ALL SELECT 'urn:t:supplier/' || s_suppkey, 'urn:t:nation/' || s_nationkey FROM supplier
    UNION ALL SELECT 'urn:t:customer/' || c_custkey, 'urn:t:nation/' || c_nationkey FROM customer),
  b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), r(uri, depth) AS (SELECT 'urn:t:customer/1', 0 UNION SELECT b.v, r.depth + 1 FROM r JOIN b ON b.u = r.uri WHERE r.depth < 5)
  SELECT uri, min(depth)::INTEGER AS depth FROM r GROUP BY uri""")
def path_distances(spark, d):
    return traverse.distances(lifted(spark, d, ("nation", "supplier", "customer")), "t:customer/1", ("v:locatedIn",), 5)


@query("""SELECT 'urn:t:customer/' || c_custkey AS s, 'urn:t:nation/' || c_nationkey AS o FROM customer UNION SELECT 'urn:t:nation/' || n_nationkey, 'urn:t:region/' || n_regionkey FROM nation
  UNION SELECT 'urn:t:customer/' || c_custkey, 'urn:t:region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def closure_pairs(spark, d):
    return traverse.closure(lifted(spark, d, ("customer", "nation")).edges([V + "locatedIn"], layers=("data",)))


@query("SELECT 'urn:t:nation/' || c_nationkey AS uri FROM customer WHERE c_custkey = 5 UNION SELECT 'urn:t:region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 5")
def closure_instance(spark, d):
    return traverse.reachable(lifted(spark, d, ("customer", "nation")), "v:locatedIn", start_uri="t:customer/5").select("uri")


@query("SELECT 'urn:t:region/' || n_regionkey AS uri, r_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(n_name) = (SELECT lower(n_name) FROM nation WHERE n_nationkey = 4) GROUP BY ALL")
def closure_label(spark, d):
    name = _table(spark, d, "nation").where("n_nationkey = 4").select("n_name").first()[0]
    return traverse.reachable(lifted(spark, d, ("nation", "region")), "v:locatedIn", start_label=name.lower())


@query("SELECT DISTINCT 'urn:t:nation/' || s_nationkey AS uri FROM supplier UNION SELECT DISTINCT 'urn:t:region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def closure_class(spark, d):
    return traverse.reachable(lifted(spark, d, ("supplier", "nation")), "v:locatedIn", start_class="v:Supplier").select("uri")


@query("SELECT 'urn:t:customer/' || c_custkey AS uri, 'urn:t:customer/' || min(c_custkey::VARCHAR) OVER (PARTITION BY c_nationkey, c_mktsegment) AS least FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) > 1")
def sameas_components(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    e = _table(spark, d, "customer").select(F.concat(F.lit("urn:t:customer/"), F.col("c_custkey")).alias("s"), F.concat(F.lit("urn:t:customer/"), F.lead("c_custkey").over(w)).alias("o")).where("o is not null")
    return traverse.identity_classes(e)


@query("SELECT 'urn:t:customer/' || c_custkey AS s FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def not_exists(spark, d):
    g = lifted(spark, d, ("customer", "orders"))
    done = g.triples([V + "status"]).where("o = 'F'").select("s")
    return graph.instances(g, "urn:v:Customer").join(g.edges([V + "placedBy"]).join(done, "s", "left_semi").select(F.col("o").alias("s")), "s", "left_anti")


_BM25 = """WITH t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents {where}),
  d AS (SELECT id, len(w) AS len, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: starts_with(x, 'thin'))) AS b FROM t),
  s AS (SELECT count(*) AS n, avg(len) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM d)
  SELECT id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (1 - 0.75 + 0.75 * len / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (1 - 0.75 + 0.75 * len / m)), 6) AS score
  FROM d, s WHERE a > 0 OR b > 0 ORDER BY score DESC, id LIMIT 20"""


@query(_BM25.format(where=""))
def bm25_topk(spark, d):
    r = search.bm25(_table(spark, d, "documents"), "the thin*", "doc_id", "text").select("id", F.round("score", 6).alias("score"))
    return r.orderBy(F.desc("score"), "id").limit(20)


@query(_BM25.format(where="WHERE lang = 'en'"))
def bm25_filtered(spark, d):
    r = search.bm25(_table(spark, d, "documents").where("lang = 'en'"), "the thin*", "doc_id", "text").select("id", F.round("score", 6).alias("score"))
    return r.orderBy(F.desc("score"), "id").limit(20)


_KNN = """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT e AS qe FROM v WHERE id = 3)
  SELECT id, round(list_cosine_similarity(e, qe), 6) AS score FROM v, q WHERE id <> 3 {where} ORDER BY score DESC, id LIMIT 10"""


def _vectors(spark, d):
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _rounded(df):
    return df.select("id", F.round("score", 6).alias("score"))


@query(_KNN.format(where=""))
def knn_cosine(spark, d):
    return _rounded(vectors.find_similar(_vectors(spark, d), 3, 10))


@query(_KNN.format(where="AND label = 2"))
def knn_label_filtered(spark, d):
    return _rounded(vectors.find_similar(_vectors(spark, d), 3, 10, keep=F.col("label") == 2))


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
  l AS (SELECT a.id, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(a.e, q.e) DESC, a.id) AS r FROM v a JOIN v q ON q.id IN (3, 4) AND a.id <> q.id)
  SELECT id AS uri, round(sum(1 / (60 + r)), 6) AS score FROM l WHERE r <= 20 GROUP BY id ORDER BY score DESC, uri LIMIT 10""")
def rrf_hybrid(spark, d):
    v = _vectors(spark, d)
    h = vectors.hybrid(vectors.find_similar(v, 3, 20), vectors.find_similar(v, 4, 20), 10)
    return h.select("uri", F.round("score", 6).alias("score"))


@query("SELECT count(DISTINCT x) AS nodes FROM (SELECT 'c' || c_custkey AS x FROM customer UNION SELECT 'n' || c_nationkey FROM customer)")
def fastrp_nodes(spark, d):
    e = lifted(spark, d, ("customer",)).edges([V + "locatedIn"], layers=("data",))
    return vectors.fast_rp(e, dim=16).where(F.abs(vectors.dot(F.col("vec"), F.col("vec")) - 1) < 1e-6).agg(F.count("*").alias("nodes"))


_CPT = "WITH n AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT p.o_orderpriority, s.o_orderstatus, coalesce(n, 0) AS n, t FROM (SELECT o_orderpriority, count(*) AS t FROM orders GROUP BY 1) p CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) s LEFT JOIN n ON n.o_orderpriority = p.o_orderpriority AND n.o_orderstatus = s.o_orderstatus)"


@query(_CPT + " SELECT o_orderpriority, o_orderstatus, round(n / t, 6) AS p FROM g")
def learn_cpt_mle(spark, d):
    return bayes.cpt_frame(_table(spark, d, "orders"), "o_orderstatus", ["o_orderpriority"]).withColumn("p", F.round("p", 6))


@query(_CPT + ", k AS (SELECT count(DISTINCT o_orderpriority) AS q, count(DISTINCT o_orderstatus) AS r FROM g) SELECT o_orderpriority, o_orderstatus, round((n + 1.0::DOUBLE / (q * r)) / (t + 1.0::DOUBLE / q), 6) AS p FROM g, k")
def learn_cpt_bdeu(spark, d):
    return bayes.cpt_frame(_table(spark, d, "orders"), "o_orderstatus", ["o_orderpriority"], "bayes").withColumn("p", F.round("p", 6))


def smoking() -> bayes.Network:
    """The textbook network of a hidden common cause: Genotype to Smoking and Cancer, Smoking to Cancer."""
    return bayes.Network(
        {"Genotype": ["risk", "normal"], "Smoking": ["yes", "no"], "Cancer": ["yes", "no"]},
        [bayes.Cpd("Genotype", [[0.5], [0.5]]), bayes.Cpd("Smoking", [[0.8, 0.2], [0.2, 0.8]], ["Genotype"]), bayes.Cpd("Cancer", [[0.8, 0.4, 0.4, 0.0], [0.2, 0.6, 0.6, 1.0]], ["Genotype", "Smoking"])],
    )


_NET = "WITH g(g, pg) AS (VALUES (0, 0.5), (1, 0.5)), s(g, s, ps) AS (VALUES (0, 'yes', 0.8), (0, 'no', 0.2), (1, 'yes', 0.2), (1, 'no', 0.8)), c(g, s, pc) AS (VALUES (0, 'yes', 0.8), (0, 'no', 0.4), (1, 'yes', 0.4), (1, 'no', 0.0))"


@query(_NET + ", j AS (SELECT pg * ps AS w, pc FROM g JOIN s USING (g) JOIN c USING (g, s) WHERE s = 'yes') SELECT unnest(['yes', 'no']) AS state, unnest([round((sum(w * pc) / sum(w))::DOUBLE, 6), round((1 - sum(w * pc) / sum(w))::DOUBLE, 6)]) AS p FROM j")
def bayes_posterior(spark, d):
    return bayes.posterior_frame(spark, smoking(), "Cancer", {"Smoking": "yes"}).select("state", F.round("p", 6).alias("p"))


@query(_NET + " SELECT round(sum(pg * pc)::DOUBLE, 6) AS p FROM g JOIN c USING (g) WHERE s = 'yes'")
def do_adjusted(spark, d):
    p = causal.do_query(smoking(), {"Smoking": "yes"}, ["Cancer"])["Cancer"]["yes"]
    return spark.createDataFrame([(round(p, 6),)], "p double")


@query(_NET + """, j AS (SELECT g, s, 'yes' AS c, pg * ps * pc AS w FROM g JOIN s USING (g) JOIN c USING (g, s) UNION ALL SELECT g, s, 'no', pg * ps * (1 - pc) FROM g JOIN s USING (g) JOIN c USING (g, s)),
  b AS (SELECT * FROM j ORDER BY w DESC LIMIT 1) SELECT 'Cancer' AS variable, c AS state FROM b UNION ALL SELECT 'Genotype', CASE g WHEN 0 THEN 'risk' ELSE 'normal' END FROM b UNION ALL SELECT 'Smoking', s FROM b""")
def bayes_mpe(spark, d):
    return spark.createDataFrame(sorted(bayes.mpe(smoking()).items()), "variable string, state string")


@query(_NET + """, w AS (SELECT g, pg * ps * pc AS w FROM g JOIN s USING (g) JOIN c USING (g, s) WHERE s = 'yes')
  SELECT round((sum(w * pc) / sum(w))::DOUBLE, 6) AS p FROM w JOIN c USING (g) WHERE s = 'no'""")
def counterfactual(spark, d):
    p = causal.counterfactual(smoking(), {"Smoking": "yes", "Cancer": "yes"}, {"Smoking": "no"}, "Cancer")["yes"]
    return spark.createDataFrame([(round(p, 6),)], "p double")


@query("SELECT * FROM (VALUES (true, 'Genotype')) t(identifiable, backdoor)")
def identify_effect(spark, d):
    dag = causal.Dag([("Genotype", "Smoking"), ("Genotype", "Cancer"), ("Smoking", "Cancer")], ["Genotype", "Smoking", "Cancer"])
    r = causal.identify(dag, "Smoking", "Cancer")
    return spark.createDataFrame([(r["identifiable"], ",".join(r["backdoor"]))], "identifiable boolean, backdoor string")


@query("""WITH n AS (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS n FROM orders GROUP BY ALL), g AS (SELECT a.x, b.y, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT x FROM n) a CROSS JOIN (SELECT DISTINCT y FROM n) b LEFT JOIN n ON n.x = a.x AND n.y = b.y),
  e AS (SELECT n, sum(n) OVER (PARTITION BY x) * sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS e FROM g)
  SELECT round(sum((n - e) * (n - e) / e)::DOUBLE, 6) AS chi2, ((SELECT count(DISTINCT x) FROM g) - 1) * ((SELECT count(DISTINCT y) FROM g) - 1) AS df FROM e""")
def chi2_statistic(spark, d):
    import numpy as np

    rows = _table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").count().collect()  # a cell each
    x, y = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    t = np.zeros((len(x), len(y), 1))
    for r in rows:
        t[x.index(r[0]), y.index(r[1]), 0] = r[2]
    stat, df = causal.chi2(t)
    return spark.createDataFrame([(round(stat, 6), df)], "chi2 double, df long")


@query("""SELECT focus, path, value, "constraint" FROM (
  SELECT 'urn:t:part/' || p_partkey AS focus, 'urn:v:size' AS path, p_size::VARCHAR AS value, 'maxInclusive' AS "constraint" FROM part WHERE p_size > 40
  UNION ALL SELECT 'urn:t:part/' || p_partkey, 'urn:v:partType', p_type, 'in' FROM part WHERE p_type NOT IN ('PROMO', 'SMALL')
  UNION ALL SELECT 'urn:t:part/' || p_partkey, 'urn:v:hasBrand', NULL, 'minCount' FROM part WHERE false)""")
def shacl_violations(spark, d):
    c = [shacl.Constraint("v:Part", "v:size", datatype="xsd:integer", max_inclusive=40), shacl.Constraint("v:Part", "v:partType", among=("PROMO", "SMALL")), shacl.Constraint("v:Part", "v:hasBrand", node_kind="IRI", min_count=1, max_count=1)]
    return shacl.validate(lifted(spark, d, ("part",)), c)


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
  SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS shared, count(*) AS either, round((count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL)) / count(*), 6) AS score FROM a FULL JOIN b USING (k)""")
def result_jaccard(spark, d):
    a = _table(spark, d, "customer").select("c_nationkey")
    b = _table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey")
    return metrics.jaccard(a, b).withColumn("score", F.round("score", 6))


@query("""WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS nxt FROM conversations),
  t AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+')), lambda w: w <> '') AS a, list_filter(list_distinct(regexp_split_to_array(lower(nxt), '[^a-zA-Z0-9_]+')), lambda w: w <> '') AS b FROM p WHERE nxt IS NOT NULL)
  SELECT conv_id, turn, round(len(list_filter(a, lambda w: list_contains(b, w))) / nullif(len(a), 0), 6) AS overlap FROM t""")
def citation_overlap(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    t = _table(spark, d, "conversations").withColumn("nxt", F.lead("text").over(w)).where("nxt is not null")
    return t.select("conv_id", "turn", F.round(metrics.citation_overlap(F.col("text"), F.col("nxt")), 6).alias("overlap"))


@query("SELECT count(*) AS claims, count(*) FILTER (k NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)) AS unsupported, round(count(*) FILTER (k NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)) / count(*), 6) AS rate FROM (SELECT DISTINCT c_nationkey AS k FROM customer)")
def hallucination_rate(spark, d):
    claims = _table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    facts = _table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return metrics.hallucination_rate(claims, facts).withColumn("rate", F.round("rate", 6))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY OR ts IS NULL")
def memory_prune(spark, d):
    return populate.prune(_table(spark, d, "events"), "2024-01-31 00:00:00", 1, "ts").select("event_id", "event_type")


def _edges_of_words(pattern: str) -> str:
    """A pattern with ``\\b`` spelled out for letters of any script."""
    ends = r"(?:^|$|[^\p{L}\p{N}_])"
    return pattern.replace(r"\b", ends).replace(r"\s", r"[\s\p{Z}]")


_ROUTE = " ".join(
    f"WHEN regexp_matches(t, '(?i){'|'.join('(?:' + _edges_of_words(p) + ')' for p in patterns)}') THEN 'multi'" for patterns in (populate.REASONING, populate.HOPS)
)


@query(f"SELECT doc_id, CASE {_ROUTE} WHEN contains(lower(t), 'tion')::INT + contains(lower(t), 'der')::INT >= 2 THEN 'multi' WHEN contains(lower(t), 'tion') OR contains(lower(t), 'der') THEN 'single' ELSE 'simple' END AS route FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def router_class(spark, d):
    return _table(spark, d, "documents").select("doc_id", populate.route(F.coalesce("text", F.lit("")), ["Tion", "Der", "Xy"]).alias("route"))


@query("""SELECT 'urn:x/nation/' || n_nationkey AS s, unnest(['urn:v:name', 'urn:v:region', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p, unnest([n_name, n_regionkey::VARCHAR, 'urn:v:Nation']) AS o FROM nation""")
def populate_structured(spark, d):
    m = populate.Mapping("urn:x/nation/", {"n_name": ("urn:v:name", 0.9), "n_regionkey": ("urn:v:region", 0.8), "n_nationkey": ("urn:v:key", 0.2)}, "urn:v:Nation", "n_nationkey")
    return populate.populate(_table(spark, d, "nation"), m).select("s", "p", "o")


@query("SELECT b.bucket, count(*) AS n FROM (SELECT ('0x' || substr(sha256(c_name), 1, 4))::INT % 100 AS bucket FROM customer) b GROUP BY 1")
def hash_buckets(spark, d):
    return _table(spark, d, "customer").select(metrics.bucket(F.col("c_name"))).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS difficulty, count(*) AS n, round(avg(c_acctbal), 6) AS c_acctbal FROM customer GROUP BY 1")
def eval_rollup(spark, d):
    return metrics.rollup(_table(spark, d, "customer").withColumnRenamed("c_mktsegment", "difficulty"), ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("SELECT DISTINCT 'urn:t:region/' || n_regionkey AS r, count(DISTINCT 'urn:t:customer/' || c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING' GROUP BY n_regionkey")
def sparql_group(spark, d):
    from .sparql import select

    return select(lifted(spark, d, ("customer", "nation")), """
        PREFIX v: <urn:v:>
        SELECT ?r (COUNT(DISTINCT ?c) AS ?n) WHERE {
          ?c a/<http://www.w3.org/2000/01/rdf-schema#subClassOf>* v:Customer ; v:locatedIn ?x ; v:segment ?s .
          ?x v:locatedIn ?r . FILTER(?s != "BUILDING")
        } GROUP BY ?r ORDER BY DESC(?n)""")


@query("SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def sparql_union_not_exists(spark, d):
    from .sparql import select

    return select(lifted(spark, d, ("customer", "orders")), """
        PREFIX v: <urn:v:>
        SELECT ?c WHERE { { ?c v:segment "BUILDING" } UNION { ?c v:segment "MACHINERY" } FILTER NOT EXISTS { ?o v:placedBy ?c . ?o v:status "F" } }""")


@query("SELECT 'urn:t:customer/' || c_custkey AS c, 'urn:t:region/' || n_regionkey AS x FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal::DECIMAL(18,2) > 9000 UNION ALL SELECT 'urn:t:customer/' || c_custkey, 'urn:t:nation/' || c_nationkey FROM customer WHERE c_acctbal::DECIMAL(18,2) > 9000")
def sparql_path(spark, d):
    from .sparql import select

    return select(lifted(spark, d, ("customer", "nation")), "PREFIX v: <urn:v:> SELECT ?c ?x WHERE { ?c v:locatedIn+ ?x ; v:balance ?b . FILTER(?b > 9000) }")


from . import catalog_more  # noqa: E402, F401  registers the rest
from . import catalog_indexes  # noqa: E402, F401, I001
