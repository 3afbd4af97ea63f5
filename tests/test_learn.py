"""Typing, taxonomy and relations from the proposals of a provider."""

import sys

import pytest
from pyspark import cloudpickle

from tripleloom.operators import learn


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests


def rule(batches):
    """A provider as a model would be: proposals of mixed worth for each text."""
    import pandas as pd

    for b in batches:
        rows = []
        for t in b["text"]:
            for line in (t or "").split(";"):
                part = line.strip().split(" ")
                if len(part) == 4 and part[0] == "is":
                    rows.append(("type", part[1], None, part[2], float(part[3])))
                elif len(part) == 4 and part[0] == "under":
                    rows.append(("parent", part[1], None, part[2], float(part[3])))
                elif len(part) == 5:
                    rows.append(("relation", part[1], part[2], part[3], float(part[4])))
        yield pd.DataFrame(rows, columns=["kind", "subject", "predicate", "object", "confidence"])


@pytest.fixture(scope="module")
def proposals(spark):
    texts = ["is rex Dog 0.9; is rex Cat 0.4; is rex Pet 0.9; is tom Cat 0.8; is x Unknown 1.0", None, "", "is rex Dog 0.95; is bad Dog 7", "under a b 0.9; under b c 0.8; under c a 0.6; under a d 0.5; under e e 1.0; under f Root 0.7; under f a 0.65; under weak Root 0.1", "rel rex chases tom 0.9; rel tom chases rex 0.3; rel rex likes tom 0.8; rel tom chases rex 0.9; rel rex knows tom 0.9; rel rex eats x 0.9"]
    return learn.propose(spark.createDataFrame([(t,) for t in texts], "text string"), rule)


def test_types(proposals):
    got = {(r["term"], r["class"], r["confidence"], r["rank"]) for r in learn.types(proposals, ["Dog", "Cat", "Pet"], top_k=2).collect()}
    assert got == {("rex", "Dog", 0.95, 1), ("rex", "Pet", 0.9, 2), ("tom", "Cat", 0.8, 1)}


def test_taxonomy_has_no_cycle(spark, proposals):
    got = lambda **k: {(r["child"], r["parent"]) for r in learn.taxonomy(proposals, **k).collect()}
    assert got() == {("a", "b"), ("b", "c"), ("f", "Root")}  # of the ring the weakest goes; a child has one parent
    assert got(least=0.65) == {("a", "b"), ("b", "c"), ("f", "Root")} and got(parents=["Root", "d"]) == {("a", "d"), ("f", "Root")}
    tree = spark.createDataFrame([("Root", "f"), ("c", "x"), ("x", "a")], "child string, parent string")
    assert got(tree=tree) == {("a", "b")}  # what is there stays, so all that would close a cycle goes
    assert learn.taxonomy(proposals.where("1 = 0")).count() == 0


def test_relations(spark, proposals):
    predicates = spark.createDataFrame([("chases", "Dog", "Cat"), ("likes", None, "Cat"), ("eats", "Dog", None), ("other", None, None)], "predicate string, domain string, range string")
    got = {(r["subject"], r["predicate"], r["object"]) for r in learn.relations(proposals, predicates, learn.types(proposals, ["Dog", "Cat"])).collect()}
    assert got == {("rex", "chases", "tom"), ("rex", "likes", "tom"), ("rex", "eats", "x")}


def test_cooccurrence_by_contexts(spark):
    d = spark.createDataFrame([("Cat and dog. Dog! cat dog\ncat",), (None,), ("dog " + "x " * 63 + "cat",)], "text string")
    got = {(r["a"], r["b"]): (r["n_a"], r["n_b"], r["n_ab"]) for r in learn.cooccurrence(d, ["cat", "dog", "none"]).collect()}
    assert got == {("cat", "dog"): (4, 4, 2), ("dog", "cat"): (4, 4, 2)}  # words 1 and 65 of a long sentence are in two contexts
