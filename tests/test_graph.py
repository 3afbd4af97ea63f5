"""Operators on a small hand-made graph."""

import numpy as np
import pytest

from tripleloom.operators import bayes, causal, entities, graph, pattern, populate, shacl, traverse, vectors
from tripleloom.operators.entities import Filter
from tripleloom.operators.pattern import Pattern, Triple
from tripleloom.plans import terms, sparql
from tripleloom.plans.catalog import smoking
from tripleloom.sources import turtle
from tripleloom.sources.commits import Log
from tripleloom.sources.store import Store

TTL = '''
@prefix : <urn:x:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
:A a owl:Class ; rdfs:subClassOf :B . :B a owl:Class ; rdfs:subClassOf :A .   # a cycle; with a ; in it
:childOf owl:inverseOf :parentOf .
'''
DATA = '''
@prefix : <urn:x:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
:a a :A ; rdfs:label "eins"@de, "one"@en, "uno"@es ; :p 1, 5 ; :next :b ; :parentOf :b .
:b a :B ; rdfs:label """two "quoted" \\u00e9""" ; :next :c ; :like [ :p 2.5 ; :q ( "x" "y" ) ; ] .
:c :next :a .
'''


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("g")
    (root / "in").mkdir()
    (root / "in" / "schema.ttl").write_text(TTL)
    (root / "in" / "data.ttl").write_text(DATA)
    s = Store(spark, str(root / "store"))
    out = s.load_directory(str(root / "in"))
    assert [o.error for o in out] == [None, None] and [o.mode for o in out] == ["schema", "data"]
    s.prefixes["x"] = "urn:x:"
    return s


def test_turtle_terms():
    rows = turtle.Turtle(DATA).parse()
    assert ("urn:x:b", "iri", terms.LABEL, 'two "quoted" é', "literal", terms.XSD + "string", None) in rows
    assert ("urn:x:a", "iri", terms.LABEL, "eins", "literal", terms.RDF + "langString", "de") in rows
    assert sum(r[2] == terms.RDF + "first" for r in rows) == 2
    with pytest.raises(ValueError):
        turtle.Turtle(":a :b :c .").parse()


@pytest.mark.parametrize("bad", ["x> <y", "a b", 'u:"', "", "{}", "urn:x:<>", "urn:x:a\n"])
def test_bad_terms(bad):
    with pytest.raises(ValueError):
        terms.iri(bad, {})


def test_entities(store):
    g = store.graph()
    assert entities.count_entities(g, "x:A").first()["n"] == 2  # the class cycle ends
    assert {(r["uri"], r["label"]) for r in entities.find_entities(g, "x:A").collect()} == {("urn:x:a", "one"), ("urn:x:b", 'two "quoted" é')}
    hit = lambda *f: [r["uri"] for r in entities.find_entities(g, "x:A", f).collect()]
    assert hit(Filter("x:p", "=", 5)) == hit(Filter("x:p", ">", 3)) == hit(Filter("x:p", "!=", 1)) == ["urn:x:a"]
    assert hit(Filter("x:p", "=", 1), Filter("x:p", "=", 5)) == ["urn:x:a"] and hit(Filter("x:none", "=", 1)) == []
    assert ("urn:x:childOf", "urn:x:a", True) in {(r["predicate"], r["value"], r["inverse"]) for r in entities.describe_entity(g, "x:b").collect()}


def test_walks(store):
    g = store.graph()
    assert [r["uri"] for r in traverse.reachable(g, "x:next", start_uri="x:a").collect()] == ["urn:x:a", "urn:x:b", "urn:x:c"]
    assert traverse.find_path(g, "x:a", "x:a") == []
    path = traverse.find_path(g, "x:b", "x:c")
    assert [(s["from"], s["to"], s["forward"]) for s in path] == [("urn:x:b", "urn:x:c", True)]


def test_pattern_and_sparql(store):
    g = store.graph()
    q = Pattern(["?x", "?y"], [Triple("?x", "x:next", "?y"), Triple("?y", "x:next", "?z"), Triple("?z", "x:next", "?x")])
    assert pattern.query_pattern(g, q).count() == 3
    assert pattern.query_pattern(g, Pattern(["?p"], [Triple("x:a", "?p", "x:b")], distinct=True)).count() == 2
    with pytest.raises(ValueError):
        Pattern(["?nope"], [Triple("?x", "x:next", "?y")])
    ask = sparql.select(g, "ASK { x:a x:next+ x:a }").first()["ask"]
    assert ask is True
    ends = lambda text: sorted(r["e"] for r in sparql.select(g, text).collect())
    ring = ["urn:x:a", "urn:x:b", "urn:x:c"]
    assert ends("SELECT ?e WHERE { x:b x:next+ ?e }") == ends("SELECT ?e WHERE { ?e x:next+ x:b }") == ends("SELECT ?e WHERE { x:b ^x:next+ ?e }") == ring
    assert ends("SELECT ?e WHERE { x:nowhere x:next* ?e }") == ends("SELECT ?e WHERE { ?e x:next* x:nowhere }") == ["urn:x:nowhere"]
    assert not sparql.select(g, "ASK { x:a x:next+ x:nowhere }").first()["ask"] and sparql.select(g, "ASK { x:a x:next* x:a }").first()["ask"]
    assert {(r["s"], r["o"]) for r in sparql.select(g, "SELECT ?s ?o WHERE { ?s x:next+ ?o }").collect()} == {(a, b) for a in ring for b in ring}
    rows = sparql.select(g, 'SELECT ?l WHERE { x:a <http://www.w3.org/2000/01/rdf-schema#label> ?l . FILTER(LANG(?l) = "en") }').collect()
    assert [r["l"] for r in rows] == ["one"]


def test_writes_and_access(store, spark):
    assert store.assert_triples([("x:z", "x:next", "x:a", True), ("x:z", "x:note", "plain text")], "other") == 2
    g = store.graph()
    assert g.triples(ontology="other").count() == 2
    assert store.retract_triple("x:z", "x:next", "urn:x:none", True, "other") == 0 and store.retract_triple("x:z", "x:next", "urn:x:a", True, "other") == 1
    shut = populate.Policy.parse("default:rw,other:none")
    assert shut.view(store.graph()).triples().where("ontology = 'other'").count() == 0
    with pytest.raises(PermissionError):
        shut.guard("other", "w")
    assert store.clear("data", "other") == {"data": 1}


def test_reasoning():
    net = smoking()
    assert bayes.posterior(net, ["Cancer"], {"Smoking": "yes"})["Cancer"]["yes"] == pytest.approx(0.72)
    assert bayes.posterior(net, ["Cancer"])["Cancer"]["yes"] == pytest.approx(0.43, abs=0.04)
    assert causal.do_query(net, {"Smoking": "yes"}, ["Cancer"])["Cancer"]["yes"] == pytest.approx(0.60)
    assert causal.do_query(net, {"Smoking": "no"}, ["Cancer"])["Cancer"]["yes"] == pytest.approx(0.20)
    line = bayes.Network({"X": ["0", "1"], "Y": ["0", "1"]}, [bayes.Cpd("X", [[0.5], [0.5]]), bayes.Cpd("Y", [[0.8, 0.1], [0.2, 0.9]], ["X"])])
    assert causal.counterfactual(line, {"X": "1", "Y": "1"}, {"X": "0"}, "Y")["1"] == pytest.approx(0.2)
    assert causal.counterfactual(line, {"X": "1", "Y": "1"}, {"X": "1"}, "Y")["1"] == pytest.approx(1.0)
    bare = causal.Dag([("G", "S"), ("G", "C"), ("S", "C")], ["G", "S", "C"], {"G"})
    assert not causal.identify(bare, "S", "C")["identifiable"]
    tar = causal.Dag([("G", "S"), ("G", "C"), ("S", "T"), ("T", "C")], ["G", "S", "C", "T"], {"G"})
    assert causal.identify(tar, "S", "C")["frontdoor"] == [["T"]]
    assert causal.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    with pytest.raises(ValueError):
        bayes.Network({"X": ["0", "1"]}, [bayes.Cpd("X", [[0.5], [0.6]])])


def test_learning(spark):
    rows = [("adv", "win")] * 45 + [("adv", "lose")] * 5 + [("dis", "win")] * 5 + [("dis", "lose")] * 45 + [("even", "win")] * 25 + [("even", "lose")] * 25
    data = spark.createDataFrame(rows, "m string, o string")
    states = {"o": ["win", "lose"], "m": ["adv", "even", "dis"]}
    assert bayes.learn_cpt(data, "o", ["m"], states, "bayes").values[0][0] == pytest.approx((45 + 1 / 6) / (50 + 1 / 3))
    assert bayes.learn_cpt(data, "o", ["m"], states).values[0] == pytest.approx([0.9, 0.5, 0.1])


def test_shacl_and_vectors(store, spark):
    g = store.graph()
    bad = {(r["focus"], r["constraint"]) for r in shacl.validate(g, [shacl.Constraint("x:A", "x:p", min_count=1, max_count=1, max_inclusive=4)]).collect()}
    assert bad == {("urn:x:a", "maxCount"), ("urn:x:a", "maxInclusive"), ("urn:x:b", "minCount")}
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")], "s string, o string")
    v = vectors.fast_rp(e, dim=64)
    s = {r["id"]: r["score"] for r in vectors.find_similar(v, "a", 5).collect()}
    assert s["b"] > s["z"]


def test_status(store):
    r = graph.status(store.graph()).first()
    assert r["schema_triples"] == 5 and r["typed_entities"] == 2


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_terms():
    assert {terms.OWL + f"{k}Property" for k in ("Asymmetric", "Reflexive", "Irreflexive")} <= set(terms.VOCABULARY_TYPES)
    names = terms.name_prefixes(["urn:z:", "urn:a:"], {"x": "urn:x:", "ns0": "urn:0:"})
    assert names == {"x": "urn:x:", "ns0": "urn:0:", "ns1": "urn:a:", "ns2": "urn:z:"}
    assert terms.shorten("urn:a:b", names) == "ns1__b" and terms.expand("ns1__b", names) == "urn:a:b" and terms.shorten("urn:q:b", names) == "urn:q:b"
    for what, value in (("search", 201), ("depth", 0), ("depth", 7), ("similar", 101), ("related", 0), ("pattern", 10_001)):
        with pytest.raises(ValueError):
            terms.limit(what, value)


def test_other_notations():
    ld = '{"@context": {"ex": "urn:x:", "knows": {"@id": "urn:x:knows", "@type": "@id"}}, "@id": "ex:a", "@type": "ex:A", "knows": "urn:x:b", "ex:age": 5}'
    rows, _ = turtle.parse(ld, ".jsonld", "f")
    assert {("urn:x:a", terms.TYPE, "urn:x:A"), ("urn:x:a", "urn:x:knows", "urn:x:b"), ("urn:x:a", "urn:x:age", "5")} <= {(r[0], r[2], r[3]) for r in rows}
    xml = '''<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="urn:x:"><ex:A rdf:about="urn:x:a"><ex:knows rdf:resource="urn:x:b"/><ex:note>text</ex:note></ex:A></rdf:RDF>'''
    rows, _ = turtle.parse(xml, ".rdf", "f")
    assert {("urn:x:a", terms.TYPE, "urn:x:A"), ("urn:x:a", "urn:x:knows", "urn:x:b"), ("urn:x:a", "urn:x:note", "text")} <= {(r[0], r[2], r[3]) for r in rows}


def test_union_is_a_set(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    for name in ("a", "b"):
        assert s.assert_triples([("urn:x:1", "urn:x:p", "TODO:fix"), ("urn:x:1", "urn:x:p", "urn:x:2", True), ("urn:x:1", terms.TYPE, terms.OWL + "AsymmetricProperty", True)], name) == 3
    assert s.assert_triples([("urn:x:1", "urn:x:p", "TODO:fix")], "a") == 1  # once more: nothing new
    g = s.graph()
    assert (g.triples().count(), g.triples(ontology="a").count()) == (3, 3)
    assert {(r["o"], r["o_kind"]) for r in g.triples(["urn:x:p"]).collect()} == {("TODO:fix", "literal"), ("urn:x:2", "iri")}
    assert graph.status(g).first()["typed_entities"] == 0 and graph.status(g).first()["triples"] == 3


def test_manifest_and_dump(spark, tmp_path):
    import json

    (tmp_path / "one.ttl").write_text(DATA)
    (tmp_path / "s.ttl").write_text(TTL)
    (tmp_path / "m.yaml").write_text("ontologies:\n  - id: one\n    schema: ['s.ttl']\n    data: ['one.ttl']\n")
    s = Store(spark, str(tmp_path / "store"))
    try:
        out = s.load_manifest(str(tmp_path / "m.yaml"))
    except ModuleNotFoundError:
        pytest.skip("no YAML reader here")
    assert [(o.ontology, o.mode, o.error) for o in out] == [("one", "schema", None), ("one", "data", None)]
    s.dump(str(tmp_path / "out"), "data", "json", "one")
    rows = [x for f in (tmp_path / "out").glob("part-*") for x in json.loads(f.read_text() or "[]")]
    assert len(rows) == s.graph().triples(ontology="one", layers=("data",)).count() > 10


def test_directory(spark, tmp_path):
    root = tmp_path / "in"
    (root / "one" / "deep er").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "one" / "s.ttl").write_text(TTL)
    (root / "one" / "deep er" / "d.ttl").write_text(DATA)
    (root / "one" / "broken.ttl").write_text("@prefix : <urn:x:> . :a :p ( 1 ")
    (root / "one" / "empty.ttl").write_text("@prefix z: <urn:z:> .")
    (root / "one" / "notes.txt").write_text("no triples")
    (root / "skip.ttl").write_text(DATA)
    (root / ".hidden" / "d.ttl").write_text(DATA)
    (root / "flat.nt").write_text("<urn:x:a> <urn:x:p> <urn:x:b> .\n")
    s, seen = Store(spark, str(tmp_path / "store")), []
    out = s.load_directory(str(root), ignore=("skip*",), on_file=seen.append)
    got = {o.path.rsplit("/", 1)[-1]: (o.ontology, o.mode, o.triples, o.error is None) for o in out}
    assert seen == out and s.prefixes["z"] == "urn:z:"
    n = len(turtle.Turtle(DATA).parse())
    assert got == {"flat.nt": (None, "data", 1, True), "s.ttl": ("one", "schema", len(turtle.Turtle(TTL).parse()), True), "d.ttl": ("one", "data", n, True), "broken.ttl": ("one", "data", 0, False), "empty.ttl": ("one", "data", 0, True)}
    assert s.graph().triples(ontology="one", layers=("data",)).count() == n
    assert [o.path.rsplit("/", 1)[-1] for o in s.load_directory(str(root), recursive=False, ignore=("skip*",))] == ["flat.nt"]
    with pytest.raises(Exception, match="broken"):
        turtle.read_files(spark, [str(root / "one" / "broken.ttl")]).collect()


def test_replacing_survives_a_lost_driver(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "store"))
    s.assert_triples([("urn:x:1", "urn:x:p", "a"), ("urn:x:1", "urn:x:p", "b"), ("urn:x:2", "urn:x:p", "c")], "one")
    s.assert_triples([("urn:x:9", "urn:x:p", "z")], "two")
    held = lambda name: sorted(r["o"] for r in s.rows().where(f"ontology = '{name}'").distinct().collect())

    def lost(self, after, state):  # after the files are written, before the commit that lists them
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Log, "commit", lost)
        with pytest.raises(KeyboardInterrupt):
            s.retract_triple("urn:x:1", "urn:x:p", "a", ontology="one")
    assert held("one") == ["a", "b", "c"]
    s.retract_triple("urn:x:1", "urn:x:p", "a", ontology="one")
    assert held("one") == ["b", "c"] == sorted(r["o"] for r in s.graph().triples(ontology="one").collect())
    assert s.clear("data", "one") == {"data": 2} and held("one") == [] and held("two") == ["z"]


def test_network_as_triples(spark):
    net = smoking()
    again = bayes.from_triples(bayes.to_triples(spark, net))
    assert again.states == net.states and sorted(c.variable for c in again.cpds) == sorted(c.variable for c in net.cpds)
    assert bayes.posterior(again, ["Cancer"], {"Smoking": "yes"})["Cancer"]["yes"] == pytest.approx(0.72)
    assert bayes.from_triples(spark.createDataFrame([], graph.SCHEMA)) is None


def test_reports(spark):
    from tripleloom.functions import report

    a = spark.createDataFrame([("q1", "easy", "x", "ok", 3), ("q2", "hard", "y", "error", 0), ("q3", "hard", "y", "ok", 0)], "id string, difficulty string, category string, status string, row_count int")
    b = spark.createDataFrame([("q1", "easy", "x", "ok", 2), ("q4", "hard", "y", "ok", 1)], a.schema)
    text = report.markdown(a, "Run")
    assert "3 questions, 1 failures" in text and "| hard | 1 | 1 | 1 |" in text and "| y | 2 |" in text and "## Failures" in text
    assert "| q1 | easy | 3 | 2 | ▲ |" in report.compare(a, b, "A", "B") and "| q4 | hard |  | 1 | only b |" in report.compare(a, b, "A", "B")


def test_answer_evidence(spark):
    d = spark.createDataFrame([("Ring and widget", ["ring", "widget", "red", "ab"], ["A"], ["A", "B"]), ("nothing", [], [], [])], "answer string, names array<string>, seen array<string>, asked array<string>")
    r = d.select(populate.usage(d["answer"], d["names"]).alias("use"), populate.coverage(d["seen"], d["asked"]).alias("rel")).collect()
    assert [(round(x["use"], 4), x["rel"]) for x in r] == [(0.6667, 0.5), (0.5, 1.0)]
    v = spark.createDataFrame([(0.8, 0.9, None), (0.8, 0.9, 0.2), (0.8, 0.5, 0.9)], "r double, u double, s double")
    assert [x[0] for x in v.select(populate.judge(v["r"], v["u"], v["s"])).collect()] == ["sufficient", "insufficient", "ambiguous"]
    q = spark.createDataFrame([("Which Move has the probability?",), ("list pokemon and moves",), ("show each Trainer",), ("hello",)], "q string")
    assert [x[0] for x in q.select(populate.route(q["q"], ["Move", "Trainer", "Ty"])).collect()] == ["multi", "multi", "single", "simple"]


def test_identity_classes_need_few_rounds(spark, monkeypatch):
    """Long chains, of names that rise, fall, alternate or are mixed; a ring, a loop; the loops grow with the logarithm of the length."""
    n = 600
    mixed = np.random.default_rng(5).permutation(n)
    chains = {"a": range(n), "b": range(n, 0, -1), "c": [i // 2 if i % 2 else n - i // 2 for i in range(n)], "d": mixed}
    want, edges = {}, [("urn:x", "urn:x"), ("urn:r2", "urn:r1"), ("urn:r1", "urn:r3"), ("urn:r3", "urn:r2")]
    for name, keys in chains.items():
        nodes = [f"urn:{name}{k:04d}" for k in keys]
        edges += zip(nodes, nodes[1:], strict=False)
        want |= dict.fromkeys(nodes, min(nodes))
    want |= {"urn:x": "urn:x", "urn:r1": "urn:r1", "urn:r2": "urn:r1", "urn:r3": "urn:r1"}
    calls, write = [], traverse.materialise
    monkeypatch.setattr(traverse, "materialise", lambda df, **how: calls.append(1) or write(df, **how))
    got = {r["uri"]: r["least"] for r in traverse.identity_classes(spark.createDataFrame(edges, "s string, o string")).collect()}
    assert got == want and len(calls) < 60
    calls.clear()
    g = graph.Graph.of(spark.createDataFrame([(None, "data", s, "iri", terms.SAME, o, "iri", None, None) for s, o in edges], graph.SCHEMA))
    assert [r["uri"] for r in traverse.same_as(g, "urn:a0003").collect()] == sorted(k for k in want if k[:5] == "urn:a" and k != "urn:a0003") and len(calls) < 60
    assert traverse.same_as(g, "urn:absent").isEmpty()


def test_shacl_needs_few_joins(spark):
    """No join for counts; a class, repeated classes and repeated values of one subject."""
    rows = [("a", terms.TYPE, "A", "iri"), ("a", terms.TYPE, "A2", "iri"), ("b", terms.TYPE, "A", "iri"), ("z", terms.TYPE, "Z", "iri"), ("a", "p", "7", "literal"), ("a", "p", "x", "iri"), ("z", "p", "9", "literal"), ("a", "q", "z", "iri"), ("a", "q", "b", "iri")]
    t = [(None, "data", "urn:" + s, "iri", p if p == terms.TYPE else "urn:" + p, o if k == "literal" else "urn:" + o, k, terms.XSD + "integer" if k == "literal" else None, None) for s, p, o, k in rows]
    t += [(None, "schema", "urn:A2", "iri", terms.SUBCLASS, "urn:A", "iri", None, None), t[0], ("o", *t[4][1:])]
    g = graph.Graph.of(spark.createDataFrame(t, graph.SCHEMA))
    c = [shacl.Constraint("urn:A", "urn:p", node_kind="IRI", min_count=1, max_count=1, max_inclusive=5), shacl.Constraint("urn:A", "urn:q", of_class="urn:A", max_count=2), shacl.Constraint("urn:A", "urn:p", pattern="^[0-9]$")]
    bad = shacl.validate(g, c)
    assert {tuple(x[4:] if x else x for x in r[:3]) + (r[3],) for r in [(r["focus"], "...." + r["path"][4:], "...." + r["value"] if r["value"] and r["value"].isdigit() else r["value"], r["constraint"]) for r in bad.collect()]} == {
        ("a", "p", "7", "nodeKind"), ("a", "p", "7", "maxInclusive"), ("a", "p", "x", "maxInclusive"), ("a", "p", "x", "pattern"), ("a", "p", None, "maxCount"), ("b", "p", None, "minCount"), ("a", "q", "z", "class"),
    }
    plan = bad._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 4 and "LeftOuter" not in plan  # a path of values, the class; before: those of each count as well
