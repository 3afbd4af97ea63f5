"""Embeddings that survive a killed run, and the vector index against the scan."""

import sys
import uuid
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tripleloom.operators import embedding_store, vectors
from tripleloom.operators.embedding_store import EmbeddingStore, HashedWords
from tripleloom.operators.graph import Graph
from tripleloom.operators.vector_index import VectorIndex


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests


@dataclass(frozen=True)
class Noted:
    """Notes each text it is asked for, and each time it is opened; fails for texts with ``bad`` while the file ``broken`` is there."""

    folder: str
    name: str = "noted"
    dim: int = 2

    def open(self):
        Path(self.folder, f"open-{uuid.uuid4().hex}").touch()

        def embed(texts):
            if Path(self.folder, "broken").exists() and any("bad" in t for t in texts):
                raise ConnectionError("no answer")
            if Path(self.folder, "once").exists():
                Path(self.folder, "once").unlink()
                raise ConnectionError("no answer, this once")
            for t in texts:
                Path(self.folder, f"asked-{uuid.uuid4().hex}").write_text(t)
            return [[float(len(t)), 1.0] for t in texts]

        return embed


def asked(folder):
    return sorted(p.read_text() for p in Path(folder).glob("asked-*"))


def test_a_killed_build_goes_on(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    store = EmbeddingStore(spark, f"file://{tmp_path}/store", waves=6, batch=4, pause=0.01, tries=2)
    texts = spark.createDataFrame([(f"id{i}", f"text number {i % 40}" + (" bad" if i == 17 else "")) for i in range(60)] + [("none", None), ("short", "ab"), ("two", "first"), ("two", "second")], "id string, text string")
    (notes / "broken").touch()
    with pytest.raises(Exception, match="no answer"):
        store.build_texts(texts, Noted(str(notes)))
    done = set(asked(notes))
    cached = {r["vec"][0] for r in store._cache(Noted(str(notes))).collect()}
    assert 0 < len(done) and cached and store.log.read() == (-1, {})
    (notes / "broken").unlink()
    (notes / "once").touch()  # one failure is tried again
    assert store.build_texts(texts, Noted(str(notes))) == 61
    every = asked(notes)
    assert set(every) == {f"text number {i}" for i in range(40)} | {"text number 17 bad"} | ({"first", "second"} & set(every)) and len({"first", "second"} & set(every)) == 1
    kept = store._cache(Noted(str(notes))).count()
    assert kept == len(set(every)) and len(every) < 2 * len(set(every))  # what was written before the failure was not asked again
    got = {r["id"]: r["vec"] for r in store.read().collect()}
    assert got["id3"] == got["id43"] == [len("text number 3"), 1.0] and "none" not in got and "short" not in got
    before = len(every)
    store.build_texts(texts.where("id < 'id3'"), Noted(str(notes)))
    assert len(asked(notes)) == before and store.read().count() == texts.where("id < 'id3'").count()
    assert not list(notes.glob("once"))


def test_builds_by_ontology(spark, tmp_path):
    store = EmbeddingStore(spark, f"file://{tmp_path}/store")
    v = lambda *ids: spark.createDataFrame([(i, [float(len(i)), x]) for i, x in ids], "id string, vec array<float>")
    assert store.build("s", v(("a", 1.0), ("b", 1.0)), "one") == 2 and store.build("s", v(("b", 2.0), ("c", 2.0)), "two") == 2
    state = lambda: {r["id"]: (r["vec"][1], r["ontologies"]) for r in store.read("s").collect()}
    assert state() == {"a": (1.0, ["one"]), "b": (2.0, ["one", "two"]), "c": (2.0, ["two"])}
    store.build("s", v(("d", 3.0)), "one")  # what the ontology has no more goes, but for what others name
    assert state() == {"b": (2.0, ["two"]), "c": (2.0, ["two"]), "d": (3.0, ["one"])} and store.read("s", "two").count() == 2
    store.build("s", v(("e", 4.0)))
    assert state() == {"e": (4.0, [])}
    with pytest.raises(KeyError):
        store.read("none")
    with pytest.raises(ValueError):
        store.build("s", v(("e", 4.0)), "not an id")


def test_entity_texts_and_the_offline_provider(spark):
    label, type_ = "http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    rows = [("a", "iri", type_, "urn:C", "iri"), ("a", "iri", label, "zwei", "literal"), ("a", "iri", label, "eins", "literal"), ("b", "iri", label, "untyped", "literal"), ("_:c", "bnode", type_, "urn:C", "iri"), ("_:c", "bnode", label, "blank", "literal")]
    g = Graph.of(spark.createDataFrame([(None, "data", s, k, p, o, ok, None, None) for s, k, p, o, ok in rows], "ontology string, layer string, s string, s_kind string, p string, o string, o_kind string, dt string, lang string"))
    assert [tuple(r) for r in embedding_store.entity_texts(g).collect()] == [("a", "eins\nzwei")]
    embed = HashedWords(16).open()
    x = embed(["One two, one", "two", ""])
    assert x.shape == (3, 16) and abs(x[0]).sum() in (3, 1) and abs(x[1]).sum() == 1 and not x[2].any()


@pytest.mark.parametrize("kind", ["clusters", "sphere"])
def test_vector_index_equals_the_scan(spark, tmp_path, kind):
    rng = np.random.default_rng(9)
    if kind == "clusters":
        centres = rng.normal(size=(12, 8)) * 4
        x = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 0.1
    else:
        x = rng.normal(size=(900, 8))
    x[5] = x[6] = x[7]  # ties
    x[8] = 0
    rows = [(i, v.tolist(), [f"o{i % 3}"] + (["rare"] if i in (40, 41) else [])) for i, v in enumerate(x)] + [(1000, None, ["o1"])]
    d = spark.createDataFrame(rows, "id long, vec array<double>, ontologies array<string>").repartition(3)
    index = VectorIndex.build(d, f"file://{tmp_path}/v", lists=12)
    same = lambda a, b: [(r["id"], round(r["score"], 9)) for r in a.collect()] == [(r["id"], round(r["score"], 9)) for r in b.collect()]
    for key in (0, 6, 8, 100, 1000):
        got, read = index.similar(key, 10)
        want = vectors.find_similar(d.where("vec is not null"), key, 10)
        assert same(got, want)
        if kind == "clusters" and key in (0, 100):
            assert read.vectors < 0.5 * read.of_vectors and read.lists < read.of
            assert "PartitionFilters: [list" in got._jdf.queryExecution().executedPlan().toString().replace("isnotnull(list", "list")
    got, read = index.similar(0, 5, "o2")
    assert same(got, vectors.find_similar(d.where("vec is not null"), 0, 5, keep=F.array_contains("ontologies", "o2")))
    got, read = index.similar(0, 5, "rare")
    assert [r["id"] for r in got.collect()] and read.lists <= 2
    assert index.similar(0, 5, "none")[0].count() == 0
    assert VectorIndex.build(d.where("1 = 0"), f"file://{tmp_path}/w").search([1.0, 0.0])[0].count() == 0


def test_fast_rp_hops_are_means_of_neighbours(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e")] + [("hub", f"n{i}") for i in range(30)]
    e = spark.createDataFrame(edges, "s string, o string")
    dim = 24
    ids = sorted({x for pair in edges for x in pair})
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("k")).select("id", "k", F.pmod(F.xxhash64("id", "k", F.lit(42)), F.lit(6)).alias("h")).collect()
    seed = {i: np.zeros(dim) for i in ids}
    for r in rows:
        seed[r["id"]][r["k"]] = {0: 3**0.5, 1: -(3**0.5)}.get(r["h"], 0.0)
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in ids}
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) > 0 else v
    one = {i: unit(np.mean([seed[n] for n in near[i]], axis=0)) for i in ids}
    two = {i: unit(np.mean([one[n] for n in near[i]], axis=0)) for i in ids}
    got = {r["id"]: r["vec"] for r in vectors.fast_rp(e, dim=dim, weights=(0.0, 1.0, 0.5)).collect()}
    assert got.keys() == set(ids)
    for i in ids:
        assert got[i] == pytest.approx(unit(one[i] + 0.5 * two[i]).tolist(), abs=1e-9)
