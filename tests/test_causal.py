"""Independence tests and discovery in Spark against plain tables."""

import itertools

import numpy as np
import pytest

from tripleloom.operators import causal, vectors
from tripleloom.plans.catalog import smoking


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = []
    for _ in range(1500):
        a, b, e = (int(x) for x in rng.integers(0, 2, 3))
        c = (a & b) if rng.random() > 0.1 else 1 - (a & b)
        d = c if rng.random() > 0.15 else None  # null is a state
        out.append((a, "xyz"[b + int(rng.integers(0, 2))], c, d, e))
    return out


def by_hand(rows, x, y, given):
    strata = {}
    for r in rows:
        strata.setdefault(tuple(r[g] for g in given), []).append(r)
    xs, ys = (sorted({r[k] for r in rows}, key=str) for k in (x, y))
    t = np.zeros((len(xs), len(ys), len(strata)))
    for k, some in enumerate(strata.values()):
        for r in some:
            t[xs.index(r[x]), ys.index(r[y]), k] += 1
    return causal.chi2(t)


def test_independence_equals_plain_tables(spark, rows, monkeypatch):
    names = list("abcde")
    d = spark.createDataFrame(rows, "a int, b string, c int, d int, e int")
    tests = [(x, y, z) for x, y in itertools.combinations(names, 2) for n in (0, 1, 2) for z in itertools.combinations(sorted(set(names) - {x, y}), n)]
    for at_once in (200_000, 100):
        monkeypatch.setattr(causal, "ROWS_AT_ONCE", at_once)
        got = {r["test"]: (r["stat"], r["df"]) for r in causal.independence(causal.states_of(d, names), tests).collect()}
        for i, (x, y, z) in enumerate(tests):
            stat, df = by_hand(rows, names.index(x), names.index(y), [names.index(v) for v in z])
            assert got[i][1] == df and got[i][0] == pytest.approx(stat, abs=1e-6)


def test_discovery(spark, rows):
    d = spark.createDataFrame(rows, "a int, b string, c int, d int, e int")
    r = causal.discover_dag(d, list("abcde"))
    assert r["skeleton"] == [("a", "c"), ("b", "c"), ("c", "d")] and r["directed"] == [("a", "c"), ("b", "c"), ("c", "d")]
    assert causal.discover_dag(d, ["a", "e"]) == {"skeleton": [], "directed": []}
    assert causal.discover_dag(d.where("1 = 0"), ["a", "e"]) == {"skeleton": [], "directed": []}


def test_text_vectors_are_signed_word_counts(spark):
    d = spark.createDataFrame([("a", "Red red, blue"), ("b", "blue RED red"), ("c", "xy"), ("d", None)], "id string, text string")
    v = {r["id"]: r["vec"] for r in vectors.text_vectors(d, 8).collect()}
    assert v.keys() == {"a", "b"} and v["a"] == v["b"] and sum(abs(x) for x in v["a"]) in (1, 3) and len(v["a"]) == 8


def test_explain_do(spark):
    dag = causal.Dag([("Genotype", "Smoking"), ("Genotype", "Cancer"), ("Smoking", "Cancer")], ["Genotype", "Smoking", "Cancer"])
    out = causal.explain_do(smoking(), dag, {"Smoking": "yes"}, ["Cancer"])
    assert out["distribution"]["Cancer"]["yes"] == pytest.approx(0.60) and out["adjustment"] == {("Smoking", "Cancer"): ["Genotype"]}
    assert out["explanation"] == "setting Smoking and reading Cancer adjusts for Genotype"


def test_states_of_many_variables_are_not_grouped_in_memory(spark):
    d = spark.range(3000).selectExpr("id % 7 as a", "if(id % 5 = 0, null, cast(id % 3 as string)) as b", "id as c")
    few = causal.states_of(d, ["a", "b"])
    got = {tuple(r)[:2]: r["n"] for r in few.groupBy("a", "b").sum("_n").toDF("a", "b", "n").collect()}
    want = {}
    for i in range(3000):
        k = (str(i % 7), "\0" if i % 5 == 0 else str(i % 3))
        want[k] = want.get(k, 0) + 1
    assert got == want and few.count() <= 4 * len(want)
    written = []
    keep = causal.materialise
    causal.materialise = lambda df: written.append(df) or keep(df)
    try:
        assert causal.states_of(d, ["a", "b", "c"]).selectExpr("sum(_n)").first()[0] == 3000
    finally:
        causal.materialise = keep
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan  # before: every row in a hash table
