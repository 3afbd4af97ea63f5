"""The stored graph's commits: what a write costs, what readers see, what two writers may do."""

from pathlib import Path

import pytest

from tripleloom.sources.commits import Conflict
from tripleloom.sources.store import Store

TRIPLES = "s string, s_kind string, p string, o string, o_kind string, dt string, lang string"


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.load(spark.createDataFrame([(f"urn:x:{i:05d}", "iri", "urn:x:p", f"v{i}", "literal", None, None) for i in range(3000)], TRIPLES), "data")
    return s


def files(store):
    return {p: p.stat().st_size for p in Path(store.path).rglob("*.parquet")}


def objects(store, at=None, s="urn:x:00007"):
    return sorted(r["o"] for r in store.graph(at).triples().where(f"s = '{s}'").collect())


def test_single_writes_touch_nothing_else(store):
    before = files(store)
    assert store.assert_triples([("urn:x:00007", "urn:x:p", "new"), ("urn:x:00007", "urn:x:p", "new")]) == 2
    assert store.retract_triple("urn:x:00007", "urn:x:p", "v7") == 1  # kind and value decide, whatever the datatype
    after = files(store)
    assert before.items() <= after.items() and sum(after.values()) - sum(before.values()) < 20_000


def test_deletions_concern_what_was_there(store):
    first, _ = store.log.read()
    assert store.retract_triple("urn:x:00007", "urn:x:p", "v7") == 1 and store.retract_triple("urn:x:00007", "urn:x:p", "v7") == 0
    assert objects(store) == [] and objects(store, first) == ["v7"] and store.rows().count() == 2999
    gone = store.rows(first).where("s = 'urn:x:00007'").drop("ontology", "layer")
    store.load(gone, "data")
    assert objects(store) == ["v7"] and store.rows().count() == 3000
    store.retract(store.rows().where("s < 'urn:x:00010'").drop("ontology", "layer"))
    assert store.rows().count() == 2990 and objects(store) == []
    store.compact()
    assert len(store._batches()) == 1 and store.rows().count() == 2990 and objects(store, first) == ["v7"]
    assert store.vacuum() == 4 and store.rows().count() == 2990


def test_a_reader_keeps_its_commit_while_a_scope_is_replaced(spark, store):
    seen = store.graph().triples()
    store.load(spark.createDataFrame([("urn:x:a", "iri", "urn:x:p", "b", "iri", None, None)], TRIPLES), "data", replace=True)
    assert seen.count() == 3000 and store.graph().triples().count() == 1
    assert store.clear("data") == {"data": 1} and store.rows().count() == 0 and seen.count() == 3000


def test_two_writers(spark, store):
    other = Store(spark, store.path)
    scope, was = store._own(None, "data")
    other.assert_triples([("urn:x:z", "urn:x:p", "z")])
    with pytest.raises(Conflict):
        store._replace(was, scope, [])
    store.assert_triples([("urn:x:z", "urn:x:p", "y")])
    assert objects(store, s="urn:x:z") == ["y", "z"]
    # other scopes do not stand in the way of each other
    other.assert_triples([("urn:x:z", "urn:x:p", "z")], "o")
    scope, was = store._own(None, "data")
    other.assert_triples([("urn:x:z", "urn:x:p", "q")], "o")
    store._replace(was, scope, [])
    assert store.rows().count() == 2


def test_a_filter_on_a_subject_reaches_the_scan(store):
    plan = store.graph().triples().where("s = 'urn:x:00007'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(s,urn:x:00007)" in plan
