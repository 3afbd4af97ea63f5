"""Discrete Bayesian networks: factors as DataFrames or, for a network's small tables, as arrays on the driver.

Learning reads data at any size and reduces it to counts; inference runs on the tables, whose size is the network's."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import terms as T
from .graph import SCHEMA


@dataclass
class Cpd:
    """P(variable | evidence): a row per state, a column per evidence combination, the last evidence varying fastest."""

    variable: str
    values: list[list[float]]
    evidence: list[str] = field(default_factory=list)


@dataclass
class Network:
    states: dict[str, list[str]]
    cpds: list[Cpd]

    def __post_init__(self) -> None:
        for v, s in self.states.items():
            if len(set(s)) != len(s) or not s:
                raise ValueError(f"states of {v} must be given and unique")
        seen = set()
        for c in self.cpds:
            if c.variable in seen or c.variable not in self.states or any(e not in self.states for e in c.evidence):
                raise ValueError(f"table of {c.variable} names unknown or repeated variables")
            seen.add(c.variable)
            width = int(np.prod([len(self.states[e]) for e in c.evidence])) if c.evidence else 1
            if len(c.values) != len(self.states[c.variable]) or any(len(r) != width for r in c.values):
                raise ValueError(f"table of {c.variable} has the wrong shape")
            a = np.array(c.values, float)
            if (a < 0).any() or (a > 1).any() or (np.abs(a.sum(0) - 1) > 1e-4).any():
                raise ValueError(f"table of {c.variable} is no distribution")
        if seen != set(self.states):
            raise ValueError(f"no table for {sorted(set(self.states) - seen)}")
        parents = {c.variable: set(c.evidence) for c in self.cpds}
        while free := [v for v, p in parents.items() if not p]:
            for v in free:
                del parents[v]
            for p in parents.values():
                p.difference_update(free)
        if parents:
            raise ValueError("the network has a cycle")

    def check(self, assignment: dict[str, str]) -> None:
        for v, s in assignment.items():
            if v not in self.states or s not in self.states[v]:
                raise ValueError(f"unknown variable or state: {v}={s}")

    def factors(self) -> list[tuple[tuple[str, ...], np.ndarray]]:
        return [((c.variable, *c.evidence), np.array(c.values, float).reshape([len(self.states[v]) for v in (c.variable, *c.evidence)])) for c in self.cpds]


def _times(a, b):
    names = tuple(dict.fromkeys(a[0] + b[0]))
    letter = {n: i for i, n in enumerate(names)}
    return names, np.einsum(a[1], [letter[n] for n in a[0]], b[1], [letter[n] for n in b[0]], [letter[n] for n in names])


def _reduce(factors, net: Network, evidence: dict[str, str]):
    out = []
    for names, t in factors:
        for v in [n for n in names if n in evidence]:
            t = np.take(t, net.states[v].index(evidence[v]), axis=names.index(v))
            names = tuple(n for n in names if n != v)
        out.append((names, t))
    return out


def _eliminate(factors, keep: set[str], fold):
    """Variables outside ``keep`` go one by one, always the one whose joined factor is smallest."""
    factors = list(factors)
    while rest := {n for names, _ in factors for n in names} - keep:
        def cost(v):
            shape = {n: t.shape[i] for names, t in factors if v in names for i, n in enumerate(names)}
            return int(np.prod(list(shape.values()))), v
        v = min(rest, key=cost)
        own = [f for f in factors if v in f[0]]
        joined = own[0]
        for f in own[1:]:
            joined = _times(joined, f)
        factors = [f for f in factors if v not in f[0]] + [(tuple(n for n in joined[0] if n != v), fold(joined[1], joined[0].index(v)))]
    out = ((), np.array(1.0))
    for f in factors:
        out = _times(out, f)
    return out


def joint(net: Network, query: list[str], evidence: dict[str, str] | None = None):
    """Normalised joint of the query variables given the evidence."""
    evidence = evidence or {}
    net.check(evidence)
    if set(query) & set(evidence) or any(q not in net.states for q in query):
        raise ValueError("query variables must be known and apart from the evidence")
    names, t = _eliminate(_reduce(net.factors(), net, evidence), set(query), lambda x, i: x.sum(i))
    if t.sum() <= 0:
        raise ValueError("the evidence has probability 0")
    return names, t / t.sum()


def posterior(net: Network, query: list[str], evidence: dict[str, str] | None = None) -> dict[str, dict[str, float]]:
    """Each query variable's own marginal."""
    out = {}
    for q in query:
        _, t = joint(net, [q], evidence)
        out[q] = {s: float(p) for s, p in zip(net.states[q], t, strict=True)}
    return out


def mpe(net: Network, evidence: dict[str, str] | None = None) -> dict[str, str]:
    """The likeliest joint assignment of all other variables; among equals the first by state names."""
    evidence = dict(evidence or {})
    net.check(evidence)
    for v in sorted(set(net.states) - set(evidence)):
        best = None
        for s in sorted(net.states[v]):
            _, t = _eliminate(_reduce(net.factors(), net, evidence | {v: s}), set(), lambda x, i: x.max(i))
            if best is None or float(t) > best[0] * (1 + 1e-12):
                best = (float(t), s)
        evidence[v] = best[1]
    return {v: s for v, s in evidence.items()}


def factor_frame(spark, net: Network, cpd: Cpd) -> DataFrame:
    """A table as rows: a column per variable and ``p``."""
    names = [cpd.variable, *cpd.evidence]
    t = np.array(cpd.values, float).reshape([len(net.states[v]) for v in names])
    rows = [(*[net.states[v][k] for v, k in zip(names, i, strict=True)], float(t[i])) for i in product(*[range(n) for n in t.shape])]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names) + ", p double")


def posterior_frame(spark, net: Network, query: str, evidence: dict[str, str] | None = None) -> DataFrame:
    """``state, p`` by variable elimination on DataFrames: filter by evidence, join on shared variables, sum out."""
    evidence = evidence or {}
    net.check(evidence)
    factors = []
    for c in net.cpds:
        f = factor_frame(spark, net, c)
        for v in [n for n in f.columns if n in evidence]:
            f = f.where(F.col(v) == evidence[v]).drop(v)
        factors.append(f)

    def times(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns and c != "p"]
        j = a.join(b.withColumnRenamed("p", "p2"), shared) if shared else a.crossJoin(b.withColumnRenamed("p", "p2"))  # factors: as small as the network
        return j.withColumn("p", F.col("p") * F.col("p2")).drop("p2")

    for v in sorted(set(net.states) - set(evidence) - {query}, key=lambda v: sum(v in f.columns for f in factors)):
        own = [f for f in factors if v in f.columns]
        if not own:
            continue
        joined = own[0]
        for f in own[1:]:
            joined = times(joined, f)
        rest = [c for c in joined.columns if c not in (v, "p")]
        factors = [f for f in factors if v not in f.columns] + [joined.groupBy(*rest).agg(F.sum("p").alias("p"))]
    out = factors[0]
    for f in factors[1:]:
        out = times(out, f)
    total = out.agg(F.sum("p").alias("z"))
    return out.crossJoin(F.broadcast(total)).select(F.col(query).alias("state"), (F.col("p") / F.col("z")).alias("p"))  # one row


# The vocabulary of a network as triples.
BN = "urn:bn:"
NETWORK = BN + "network"


def to_triples(spark, net: Network, base: str = "urn:bn:var/") -> DataFrame:
    """A network as triples of the probabilistic layer: a node per variable and per table; lists and tables are JSON literals."""
    rows = [(NETWORK, T.TYPE, BN + "Network", "iri")]
    for v, states in sorted(net.states.items()):
        rows += [(base + v, T.TYPE, BN + "Variable", "iri"), (NETWORK, BN + "hasVariable", base + v, "iri"), (base + v, T.LABEL, v, "literal"), (base + v, BN + "states", json.dumps(states), "literal")]
    for c in net.cpds:
        node = f"{base}{c.variable}/cpd"
        rows += [(node, T.TYPE, BN + "CPD", "iri"), (NETWORK, BN + "hasCPD", node, "iri"), (node, BN + "forVariable", base + c.variable, "iri"), (node, BN + "values", json.dumps(c.values), "literal")]
        rows.append((node, BN + "evidence", json.dumps([base + e for e in c.evidence]), "literal"))
    return spark.createDataFrame([(None, "probabilistic", s, "iri", p, o, k, T.XSD + "string" if k == "literal" else None, None) for s, p, o, k in rows], SCHEMA)


def from_triples(triples: DataFrame) -> Network | None:
    """The network that such triples describe, variables and tables in the order of their IRIs; None without a variable.

    A network has as many triples as variables and tables, so they are collected."""
    said: dict[str, dict[str, str]] = {}
    for r in triples.select("s", "p", "o").distinct().orderBy("s", "p", "o").collect():
        said.setdefault(r["s"], {}).setdefault(r["p"], r["o"])
    names = {s: d[T.LABEL] for s, d in said.items() if d.get(T.TYPE) == BN + "Variable"}
    if not names:
        return None
    tables = [d for _, d in sorted(said.items()) if d.get(T.TYPE) == BN + "CPD"]
    return Network(
        {names[s]: json.loads(said[s][BN + "states"]) for s in sorted(names)},
        [Cpd(names[d[BN + "forVariable"]], json.loads(d[BN + "values"]), [names[e] for e in json.loads(d[BN + "evidence"])]) for d in tables],
    )


def gather_observations(triples: DataFrame, instances: DataFrame, represents: dict[str, str], states: dict[str, list[str]]) -> DataFrame:
    """One row per instance, a column per variable: the least value of its property; rows with an undeclared state go."""
    t = triples.where(F.col("p").isin(*represents.values())).join(instances.select("s"), "s", "left_semi")
    rows = t.groupBy("s").agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(v) for v, p in represents.items()])
    for v, s in states.items():
        rows = rows.where(F.col(v).isin(*s))
    return rows


def learn_cpt(data: DataFrame, variable: str, parents: list[str], states: dict[str, list[str]], estimator: str = "mle", ess: float = 1.0) -> Cpd:
    """``mle`` (relative frequency; uniform where a parent combination is unseen) or ``bayes`` (BDeu)."""
    if estimator not in ("mle", "bayes"):
        raise ValueError(f"unknown estimator {estimator!r}")
    got = data.groupBy(variable, *parents).agg(F.count("*").alias("n")).collect()  # a row per combination of states
    if not got:
        raise ValueError("no observation")
    names = [variable, *parents]
    n = np.zeros([len(states[v]) for v in names])
    for r in got:
        at = tuple(states[v].index(r[v]) if r[v] in states[v] else -1 for v in names)
        if -1 not in at:
            n[at] += r["n"]
    n = n.reshape(len(states[variable]), -1)
    if estimator == "bayes":
        n = n + ess / n.size
    total = n.sum(0, keepdims=True)
    p = np.where(total > 0, n / np.where(total > 0, total, 1), 1 / len(n))
    return Cpd(variable, p.tolist(), list(parents))


def cpt_frame(data: DataFrame, variable: str, parents: list[str], estimator: str = "mle", ess: float = 1.0) -> DataFrame:
    """The same as rows over the states seen: parents, variable, ``p``."""
    n = data.groupBy(*parents, variable).agg(F.count("*").alias("n"))
    var = n.select(variable).distinct()
    par = n.groupBy(*parents).agg(F.sum("n").alias("total"))
    grid = par.crossJoin(F.broadcast(var)).join(n, [*parents, variable], "left").withColumn("n", F.coalesce("n", F.lit(0)))  # states x states
    if estimator == "mle":
        return grid.select(*parents, variable, (F.col("n") / F.col("total")).alias("p"))
    r, q = var.agg(F.count("*").alias("r")), par.agg(F.count("*").alias("q"))
    grid = grid.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(q))  # one row each
    return grid.select(*parents, variable, ((F.col("n") + ess / (F.col("q") * F.col("r"))) / (F.col("total") + ess / F.col("q"))).alias("p"))
