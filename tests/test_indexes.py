"""Stored indexes, the commit log and joins of solutions that leave variables unbound."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleloom.operators import reach_index, search
from tripleloom.operators.graph import Graph
from tripleloom.operators.pattern import Triple, bindings
from tripleloom.operators.reach_index import ReachIndex, strong_components
from tripleloom.operators.statistics import Statistics
from tripleloom.operators.text_index import TextIndex
from tripleloom.operators.traverse import closure
from tripleloom.plans.grid import grid_join
from tripleloom.plans.sparql import Query, select
from tripleloom.sources.commits import Conflict, Log


def test_log_refuses_the_second_writer(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    assert log.read() == (-1, {})
    assert log.commit(-1, {"a": 1}) == 0 and log.commit(0, {"a": 2}) == 1
    with pytest.raises(Conflict):
        log.commit(0, {"a": 3})
    assert log.read() == (1, {"a": 2}) and log.read(0) == (0, {"a": 1}) and log.numbers() == [0, 1]


TEXTS = [(1, "The red widget and the blue widget"), (2, "red blue, widget red-widget"), (3, "green thing"), (4, None), (5, ""), (6, "widget " * 400 + "red"), (7, "Ünïcode réd widget"), (8, "blue blue red widget")]
ASKED = ["red", "red widget", "red AND widget", '"red widget"', '"red widget" OR green', "wid*", "(red OR green) AND NOT blue", "red -blue", "th* AND (blue OR gre*)", "red-widget", '"blue widget" AND red', "réd", "absent", "NOT blue red", "blue blue"]


def test_text_index_scores_as_the_scan(spark, tmp_path):
    d = spark.createDataFrame(TEXTS, "id long, text string")
    index = TextIndex(spark, f"file://{tmp_path}/i")
    index.add(d.where("id < 4"), ranges=3)
    first = index.add(d.where("id >= 4"))
    rows = lambda r: {x["id"]: round(x["score"], 9) for x in r.collect()}
    want = {q: rows(search.bm25(d, q)) for q in ASKED}
    assert {q: rows(index.search(q, None)) for q in ASKED} == want
    assert want["red -blue"].keys() == {6} and want['"red widget"'].keys() == {1, 2, 8} and want["absent"] == {} and want["red-widget"] == want['"red widget"']
    index.merge()
    assert {q: rows(index.search(q, None)) for q in ASKED} == want
    assert rows(index.search("red", None, at=first)) == want["red"]  # an earlier commit answers as it did
    assert [r["id"] for r in index.search("wid*", 2, among=d.where("id in (1, 6)")).collect()] == sorted(want["wid*"].keys() & {1, 6}, key=lambda i: -want["wid*"][i])
    index.drop_unlisted()
    assert rows(index.search("red widget", None)) == want["red widget"]
    for bad in ("", "AND", "-red", "NOT (red OR blue)", '""'):
        with pytest.raises(ValueError):
            search.parse(bad)


def test_text_index_reads_the_ranges_of_its_terms(spark, tmp_path):
    d = spark.createDataFrame([(i, f"{a}{b} common {b}{a}") for i, (a, b) in enumerate(itertools.product("abcdefgh", repeat=2))], "id long, text string")
    index = TextIndex(spark, f"file://{tmp_path}/i")
    index.add(d.repartition(3), ranges=8)
    _, state = index.log.read()
    assert 3 <= len(state["borders"]) <= 8
    rows = index.postings(["aa"], state)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(range" in plan and "PushedFilters: [" in plan and "term" in plan
    assert len(rows.select("range").distinct().collect()) == 1 and len({r["range"] for r in index._rows(state).select("range").distinct().collect()}) > 3


def test_phrases_leave_other_terms_alone(spark):
    d = spark.createDataFrame(TEXTS, "id long, text string")
    alone = {r["id"]: r["score"] for r in search.bm25(d, "green").collect()}
    both = {r["id"]: r["score"] for r in search.bm25(d, 'green OR "red widget"').collect()}
    assert both[3] == alone[3]


def pairs(edges):
    to = {}
    for s, o in edges:
        to.setdefault(s, set()).add(o)
    out = set()
    for s in to:
        seen, todo = set(), list(to[s])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += to.get(x, ())
        out |= {(s, o) for o in seen}
    return out


@pytest.mark.parametrize("kind", ["cycles", "tree", "reversed", "dag", "loop"])
def test_reach_index_equals_the_closure(spark, tmp_path, kind):
    rng = np.random.default_rng(11)
    edges = {
        "cycles": {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 60, (75, 2))},
        "tree": {(f"n{(i - 1) // 3}", f"n{i}") for i in range(1, 60)},
        "reversed": {(f"n{i}", f"n{(i - 1) // 3}") for i in range(1, 60)},
        "dag": {(f"n{min(a, b)}", f"n{max(a, b)}") for a, b in rng.integers(0, 25, (60, 2)) if a != b},
        "loop": {("x", "x"), ("x", "y"), ("z", "z")},
    }[kind]
    e = spark.createDataFrame(sorted(edges), "s string, o string")
    index = ReachIndex.build(e, f"file://{tmp_path}/r")
    want = pairs(edges)
    got = [tuple(r) for r in index.closure().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    if kind == "cycles":
        assert set(got) == {tuple(r) for r in closure(e).collect()}
        comp = {r["node"]: r["comp"] for r in strong_components(e).collect()}
        assert comp == {s: min(o for o in {o for s2, o in want if s2 == s} if (o, s) in want) for s, o in want if s == o}
        start = sorted(edges)[0][0]
        assert {r["uri"] for r in index.reached(start).collect()} == {o for s, o in want if s == start}
        ends = spark.createDataFrame([("n1",), ("n2",)], "o string")
        assert {tuple(r) for r in index.closure(ends=ends).collect()} == {(s, o) for s, o in want if o in ("n1", "n2")}
        plan = index.closure()._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_reach_index_broadcasts_no_table(spark, tmp_path, monkeypatch):
    """Two rings in a row: neither the loops nor the closure send what grows with the edges through the driver."""
    edges = {(f"n{r}{i}", f"n{r}{(i + 1) % 3}") for r in range(2) for i in range(3)} | {("n02", "n10"), ("n12", "t")}
    plans, write = [], reach_index.materialise

    def kept(df, *how, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *how, **more)

    monkeypatch.setattr(reach_index, "materialise", kept)
    closed = ReachIndex.build(spark.createDataFrame(sorted(edges), "s string, o string"), f"file://{tmp_path}/r").closure()
    plans.append(closed._jdf.queryExecution().executedPlan().toString())
    assert {tuple(r) for r in closed.collect()} == pairs(edges)
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_reach_index_without_edges(spark, tmp_path):
    with pytest.raises(ValueError):
        ReachIndex(spark, f"file://{tmp_path}/r").closure()
    assert ReachIndex.build(spark.createDataFrame([], "s string, o string"), f"file://{tmp_path}/r").closure().count() == 0


@pytest.fixture(scope="module")
def small(spark):
    rows = [("s1", "p", "x"), ("s2", "p", "x"), ("s1", "q", "c1"), ("c1", "r", "d1"), ("c2", "r", "d2")]
    return Graph.of(spark.createDataFrame([(None, "data", "urn:" + s, "iri", "urn:" + p, "urn:" + o, "iri", None, None) for s, p, o in rows], "ontology string, layer string, s string, s_kind string, p string, o string, o_kind string, dt string, lang string"))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("?s u:p ?x . OPTIONAL { ?s u:q ?c } ?c u:r ?d", {"s1 x c1 d1", "s2 x c1 d1", "s2 x c2 d2"}),
        ("{ ?s u:q ?c } UNION { ?s u:p ?w } ?c u:r ?d", {"s1 c1 - d1", "s1 c1 x d1", "s1 c2 x d2", "s2 c1 x d1", "s2 c2 x d2"}),
        ("?s u:p ?x MINUS { ?s u:q ?c }", {"s2 x"}),
        ("?s u:p ?x MINUS { ?a u:r ?b }", {"s1 x", "s2 x"}),
        ("?s u:p ?x OPTIONAL { ?s u:q ?c } MINUS { ?c u:r u:d1 }", {"s2 x -"}),
        ("?s u:q/u:r ?d", {"s1 d1"}),
        ("?s u:p|u:q ?o FILTER(?o IN (u:x, u:y))", {"s1 x", "s2 x"}),
        ("?s u:p|u:q ?o FILTER(?o NOT IN (u:x))", {"s1 c1"}),
        ("VALUES (?s ?c) { (u:s1 UNDEF) (UNDEF u:c2) } ?s u:p ?x OPTIONAL { ?s u:q ?c }", {"s1 c1 x", "s1 c2 x", "s2 c2 x"}),
        ("?s u:p ?x OPTIONAL { ?s u:q ?c } FILTER NOT EXISTS { ?c u:r u:d1 }", set()),
        ("?s u:p ?x OPTIONAL { ?s u:q ?c } FILTER EXISTS { ?c u:r u:d2 }", {"s2 x -"}),
    ],
)
def test_sparql_joins_with_unbound_variables(small, text, want):
    got = select(small, "PREFIX u: <urn:> SELECT * WHERE { %s }" % text).collect()
    assert sorted(" ".join("-" if v is None else v[4:] for v in r) for r in got) == sorted(want)


def test_patterns_meet_before_rows_that_leave_a_variable_unbound(spark, monkeypatch):
    """Else each unbound row meets every triple of the first pattern's predicate."""
    edges = [(f"s{i}", "in", f"n{i % 2}") for i in range(40)] + [("n0", "in", "r0"), ("n1", "in", "r0"), ("n0", "is", "N"), ("n1", "is", "N")] + [(f"s{i}", "is", "S") for i in range(40)] + [("s3", "q", "n1")]
    g = Graph.of(spark.createDataFrame([(None, "data", "urn:" + s, "iri", "urn:" + p, "urn:" + o, "iri", None, None) for s, p, o in edges], "ontology string, layer string, s string, s_kind string, p string, o string, o_kind string, dt string, lang string"))
    sizes, compatible = [], Query.compatible
    monkeypatch.setattr(Query, "compatible", staticmethod(lambda a, b, shared, how: sizes.append(b.df.count()) or compatible(a, b, shared, how)))
    got = select(g, "PREFIX u: <urn:> SELECT ?s ?n ?r WHERE { ?s u:is u:S OPTIONAL { ?s u:q ?n } ?n u:in ?r . FILTER(?s != u:s4) ?n u:is u:N }").collect()
    want = {(f"urn:s{i}", f"urn:n{k}", "urn:r0") for i in range(40) for k in range(2) if i != 4} - {("urn:s3", "urn:n0", "urn:r0")}
    assert sizes == [2] and len(got) == len(want) and {tuple(r) for r in got} == want


def test_frequent_values_on_both_sides_are_dealt(spark):
    a = spark.createDataFrame([(i, "k" if i % 5 else f"k{i}") for i in range(60)], "x int, k string")
    b = spark.createDataFrame([(i, "k" if i % 3 else f"k{i}") for i in range(90)] + [(90, None)], "y int, k string")
    want = sorted(map(tuple, a.join(b, "k").collect()))
    for where in (None, F.col("k") == "k"):
        got = grid_join(a, b, ["k"], where)
        assert sorted(map(tuple, got.collect())) == want
    g = Graph.of(spark.createDataFrame([(None, "data", f"urn:{s}", "iri", "urn:" + p, "urn:n", "iri", None, None) for p in "pq" for s in range(50)], "ontology string, layer string, s string, s_kind string, p string, o string, o_kind string, dt string, lang string"))
    shared = bindings(g, [Triple("?a", "urn:p", "?n"), Triple("?b", "urn:q", "?n")])
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert shared.count() == 2500 and "BroadcastHashJoin" not in plan and "_line" in plan  # before: one value, one task


def test_what_selects_comes_before_a_product(spark):
    rows = [(f"{k}{i}", "in", f"n{i % 2}") for k, m in (("s", 12), ("c", 20)) for i in range(m)] + [(f"s{i}", "is", "S") for i in range(12)]
    rows += [(f"c{i}", "seg", "H" if i % 5 == 0 else "B") for i in range(20)] + [("n0", "of", "r0"), ("n1", "of", "r1")]
    g = Graph.of(spark.createDataFrame([(None, "data", "urn:" + s, "iri", "urn:" + p, "urn:" + o, "iri", None, None) for s, p, o in rows], "ontology string, layer string, s string, s_kind string, p string, o string, o_kind string, dt string, lang string"))
    where = lambda *ts: [Triple(*(x if x[0] == "?" else "urn:" + x for x in t.split())) for t in ts]
    near = {(f"urn:s{i}", f"urn:c{k}") for i in range(12) for k in range(0, 20, 5) if i % 2 == k % 2}
    both, far = ("?s in ?n", "?c in ?n", "?s is S", "?c seg H"), {(f"urn:s{i}", f"urn:c{k}") for i in range(12) for k in range(0, 20, 5)}
    for patterns, want, product in ((both, near, "_line"), ((*both, "?n of ?r"), near, "_line"), (("?s is S", "?c in ?m", "?c seg H"), far, "")):
        got = bindings(g, where(*patterns)).select("s", "c")
        plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
        top = next(i for i, line in enumerate(plan) if "Join" in line or "CartesianProduct" in line)
        # before: a product met the segments of its customers, or a nation's pairs were one task's
        assert product in plan[top] and (product or "CartesianProduct" in plan[top] or "NestedLoop" in plan[top])
        assert not any("Exchange" in line for line in plan[:top])
        found = [tuple(r) for r in got.collect()]
        assert set(found) == want and len(found) == len(want)


@pytest.fixture(scope="module")
def shop(spark):
    rng = np.random.default_rng(2)
    rows = set()
    for i in range(80):
        rows |= {(f"o{i}", "by", f"c{rng.integers(0, 12)}"), (f"o{i}", "price", str(rng.integers(1, 50))), (f"o{i}", "status", "FO"[i % 2])} - ({(f"o{i}", "status", "F")} if i % 7 == 0 else set())
        rows |= {(f"o{i}", "has", f"p{x}") for x in rng.integers(0, 9, 3)}
    rows |= {(f"c{i}", "in", f"n{i % 4}") for i in range(12)} | {(f"n{i}", "in", "r") for i in range(4)} | {("hub", "has", f"p{x}") for x in range(200)} | {("hub", "by", "c1"), ("o1", "twin", "o1"), ("o2", "twin", "o3")}
    kind = {"price": "literal", "status": "literal"}
    t = [(None, "data", "urn:" + s, "iri", "urn:" + p, o if p in kind else "urn:" + o, kind.get(p, "iri"), None, None) for s, p, o in sorted(rows)]
    return Graph.of(spark.createDataFrame(t, "ontology string, layer string, s string, s_kind string, p string, o string, o_kind string, dt string, lang string")), rows


def test_statistics(spark, shop, tmp_path):
    g, rows = shop
    stats = Statistics.collect(g, f"file://{tmp_path}/stats")
    assert stats.of("urn:has").most == 200 and stats.of("urn:by").n == 81 == stats.of("urn:by").subjects and stats.of("urn:none").n == 0
    have = {}
    for s, p, _ in rows:
        have.setdefault(s, set()).add(p)
    assert stats.star(["urn:by", "urn:price", "urn:status"]) == sum({"by", "price", "status"} <= x for x in have.values())
    assert Statistics(stats.by_predicate).star(["urn:by", "urn:in"]) == 16  # without sets: the rarest


@pytest.mark.parametrize(
    "where",
    [
        [("?o", "by", "?c"), ("?o", "price", "?v"), ("?o", "status", '"F"'), ("?c", "in", "?n"), ("?n", "in", "?r")],
        [("?o", "by", "c1"), ("?o", "price", "?v")],
        [("?o", "has", "?p"), ("?o", "by", "?c"), ("?o", "price", "?v")],  # a subject with more values than a row gathers
        [("?o", "twin", "?o"), ("?o", "by", "?c")],
        [("?a", "by", "?c"), ("?b", "by", "?c"), ("?a", "status", '"O"'), ("?b", "status", '"F"')],
        [("?a", "in", "?x"), ("?b", "twin", "?y")],
        [("?o", "?p", "?c"), ("?c", "in", "n1"), ("?o", "price", "?v")],
    ],
)
def test_stars_equal_joins(spark, shop, tmp_path, where):
    g, _ = shop
    term = lambda x: x if x[0] in '?"' else "urn:" + x
    triples = [Triple(*map(term, t)) for t in where]
    stats = Statistics.collect(g, f"file://{tmp_path}/stats")
    plain, star = bindings(g, triples), bindings(g, triples, stats=stats)
    row = lambda d: sorted(tuple(sorted(r.asDict().items())) for r in d.collect())
    assert row(plain) == row(star) != []


def test_a_star_is_one_exchange(spark, shop, tmp_path):
    g, _ = shop
    stats = Statistics.collect(g, f"file://{tmp_path}/stats")
    triples = [Triple("?o", "urn:by", "?c"), Triple("?o", "urn:price", "?v"), Triple("?o", "urn:status", '"F"'), Triple("?c", "urn:in", "?n")]
    exchanges = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert 2 * exchanges(bindings(g, triples, stats=stats)) <= exchanges(bindings(g, triples))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_statistics_count_a_graph_in_one_exchange_by_subject(spark):
    from tripleloom.operators import statistics

    rows = [("a", "p", "x"), ("a", "p", "y"), ("a", "p", "y"), ("a", "q", "x"), ("b", "p", "x"), ("b", "q", "z"), ("c", "q", "z")]
    t = [(o, "data", s, "iri", p, x, "iri", None, None) for s, p, x in rows for o in (None, "o")]
    g = Graph.of(spark.createDataFrame(t, "ontology string, layer string, s string, s_kind string, p string, o string, o_kind string, dt string, lang string"))
    for ontology in (None, "o"):
        twice = 0 if ontology is None else 1  # one ontology's parts are held to be sets
        got = {r["p"]: (r["n"], r["subjects"], r["objects"], r["most"]) for r in statistics.predicates(g, ontology).collect()}
        assert got == {"p": (3 + twice, 2, 2, 2 + twice), "q": (3, 3, 2, 1)}
        assert {tuple(r["predicates"]): r["subjects"] for r in statistics.characteristic_sets(g, ontology).collect()} == {("p", "q"): 2, ("q",): 1}
    plan = statistics.profiles(g)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(s") == 1 and plan.count("Exchange ") == 2  # by subject, and the few profiles


def test_postings_are_made_in_bounded_runs_of_words(monkeypatch):
    """A batch of long documents is no more at once than its share of words, and the postings are the same."""
    import pyarrow as pa

    from tripleloom.operators import text_index

    rng = np.random.default_rng(3)
    docs = [[f"w{x}" for x in rng.integers(0, 9, n)] for n in (50, 0, 3, 3, 200, 1, 40, 0, 7)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.list_(pa.string()))], names=["id", "w"])
    want = {(w, i): [k for k, x in enumerate(d) if x == w] for i, d in enumerate(docs) for w in d}
    for most in (1, 60, 10_000):
        monkeypatch.setattr(text_index, "WORDS_AT_ONCE", most)
        runs = [x.column("w") for x in text_index._bounded(most)(batch)]
        assert all(len(w) == 1 or len(w.flatten()) <= most for w in runs)
        got, blocks = {}, 0
        for b in text_index._postings(["w3"])(iter([batch])):
            for r in b.to_pylist():
                blocks += 1
                assert r["range"] == (r["term"] >= "w3") and r["lens"] == [len(docs[i]) for i in r["ids"]]
                for i, start, stop in zip(r["ids"], [0, *r["stops"]], r["stops"], strict=False):
                    got[r["term"], i] = r["positions"][start:stop]
        assert got == want and (blocks <= 9 if most == 10_000 else blocks > 9)
