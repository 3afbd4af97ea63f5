"""Causal questions over a network and its DAG: interventions, identification, counterfactuals, discovery.

DAGs are small: the graph algorithms run on the driver; the tests of discovery, of any data, run in Spark."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialise import materialise
from .bayes import Cpd, Network, joint, posterior

MOST_RESPONSES = 2_000_000
#: Rows that a task counts at once.
ROWS_AT_ONCE = 200_000


@dataclass
class Dag:
    edges: list[tuple[str, str]]
    variables: list[str]
    latent: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        for a, b in self.edges:
            if a == b or a not in self.variables or b not in self.variables:
                raise ValueError(f"bad edge {a} -> {b}")
        left = set(self.variables)
        while left:
            free = {v for v in left if not any(b == v and a in left for a, b in self.edges)}
            if not free:
                raise ValueError("the graph has a cycle")
            left -= free

    def parents(self, v: str) -> set[str]:
        return {a for a, b in self.edges if b == v}

    def reach(self, v: str, forward: bool = True) -> set[str]:
        out, todo = set(), [v]
        while todo:
            x = todo.pop()
            for a, b in self.edges:
                n = b if forward and a == x else a if not forward and b == x else None
                if n is not None and n not in out:
                    out.add(n)
                    todo.append(n)
        return out

    def separated(self, x: str, y: str, given: set[str], without: set[tuple[str, str]] = frozenset()) -> bool:
        """d-separation: no active walk from x to y, found over (node, arriving direction)."""
        edges = [e for e in self.edges if e not in without]
        above = set(given)
        todo = list(given)
        while todo:
            v = todo.pop()
            for a, b in edges:
                if b == v and a not in above:
                    above.add(a)
                    todo.append(a)
        seen, todo = set(), [(x, "up")]
        while todo:
            v, way = todo.pop()
            if (v, way) in seen:
                continue
            seen.add((v, way))
            if v == y:
                return False
            if way == "up" and v not in given:
                todo += [(a, "up") for a, b in edges if b == v] + [(b, "down") for a, b in edges if a == v]
            elif way == "down":
                if v not in given:
                    todo += [(b, "down") for a, b in edges if a == v]
                if v in above:
                    todo += [(a, "up") for a, b in edges if b == v]
        return True

    def directed_paths(self, x: str, y: str) -> list[list[str]]:
        out, todo = [], [[x]]
        while todo:
            p = todo.pop()
            for a, b in self.edges:
                if a == p[-1] and b not in p:
                    (out if b == y else todo).append([*p, b])
        return out


def do_query(net: Network, do: dict[str, str], query: list[str], evidence: dict[str, str] | None = None) -> dict[str, dict[str, float]]:
    """Truncated factorisation: the tables of the set variables are replaced by certainty."""
    evidence = evidence or {}
    net.check(do)
    if set(do) & set(query) or set(do) & set(evidence) or set(query) & set(evidence):
        raise ValueError("do, query and evidence must be disjoint")
    cut = [Cpd(c.variable, [[1.0 if s == do[c.variable] else 0.0] for s in net.states[c.variable]]) if c.variable in do else c for c in net.cpds]
    return posterior(Network(net.states, cut), query, evidence)


def backdoor_sets(dag: Dag, x: str, y: str) -> list[list[str]]:
    """Minimal observed sets that close every back-door path, smallest first."""
    pool = sorted(set(dag.variables) - dag.latent - dag.reach(x) - {x, y})
    front = {e for e in dag.edges if e[0] == x}
    found: list[set[str]] = []
    for n in range(len(pool) + 1):
        for z in combinations(pool, n):
            if not any(f <= set(z) for f in found) and dag.separated(x, y, set(z), front):
                found.append(set(z))
    return [sorted(f) for f in found]


def frontdoor_sets(dag: Dag, x: str, y: str) -> list[list[str]]:
    """Minimal observed sets on all directed paths, unconfounded with x, whose own back doors x closes."""
    paths = dag.directed_paths(x, y)
    pool = sorted({v for p in paths for v in p[1:-1]} - dag.latent)
    found: list[set[str]] = []
    for n in range(1, len(pool) + 1):
        for m in combinations(pool, n):
            s = set(m)
            if any(f <= s for f in found) or not all(s & set(p[1:-1]) for p in paths):
                continue
            if all(dag.separated(x, v, set(), {e for e in dag.edges if e[0] == x}) for v in s) and all(dag.separated(v, y, {x} | (s - {v}), {e for e in dag.edges if e[0] == v}) for v in s):
                found.append(s)
    return [sorted(f) for f in found]


def identify(dag: Dag, treatment: str, outcome: str) -> dict:
    """Whether the effect is identifiable by a back or front door, with the sets."""
    if {treatment, outcome} - set(dag.variables):
        raise ValueError("unknown variable")
    if outcome not in dag.reach(treatment):
        return {"identifiable": True, "backdoor": [], "frontdoor": [], "no_effect": True}
    back, front = backdoor_sets(dag, treatment, outcome), frontdoor_sets(dag, treatment, outcome)
    return {"identifiable": bool(back or front), "backdoor": back[0] if back else None, "frontdoor": front, "no_effect": False}


def explain_do(net: Network, dag: Dag, do: dict[str, str], query: list[str]) -> dict:
    """The interventional distribution, the adjustment set of each pair, and a sentence."""
    dist = do_query(net, do, query)
    sets = {(x, y): identify(dag, x, y)["backdoor"] for x in do for y in query}
    said = "; ".join(f"setting {x} and reading {y} adjusts for {', '.join(z) if z else 'nothing'}" for (x, y), z in sets.items())
    return {"distribution": dist, "adjustment": sets, "explanation": said}


def counterfactual(net: Network, observed: dict[str, str], intervention: dict[str, str], query: str) -> dict[str, float]:
    """In the canonical model each variable answers by a response function (a state for each parent combination),
    drawn independently; those that agree with what was observed are run again under the intervention."""
    net.check(observed)
    net.check(intervention)
    if query not in net.states:
        raise ValueError("unknown variable")
    by = {c.variable: c for c in net.cpds}
    order: list[str] = []
    while len(order) < len(by):
        order += [v for v in sorted(by) if v not in order and all(e in order for e in by[v].evidence)]
    responses, size = {}, 1
    for v in order:
        c = by[v]
        n = len(c.values[0])
        some = []
        for f in product(range(len(net.states[v])), repeat=n):
            w = math.prod(c.values[s][k] for k, s in enumerate(f))
            if w > 0:
                some.append((f, w))
        responses[v] = some
        size *= len(some)
        if size > MOST_RESPONSES:
            raise ValueError("too many response functions")

    def answer(f, v, world):
        k = 0
        for e in by[v].evidence:
            k = k * len(net.states[e]) + world[e]
        return f[k]

    out = dict.fromkeys(net.states[query], 0.0)
    total = 0.0
    seen = {v: net.states[v].index(s) for v, s in observed.items()}
    done = {v: net.states[v].index(s) for v, s in intervention.items()}
    todo = [(0, 1.0, {}, {})]
    while todo:  # depth first; worlds that contradict the observation end early
        k, w, fact, other = todo.pop()
        if k == len(order):
            total += w
            out[net.states[query][other[query]]] += w
            continue
        v = order[k]
        merged: dict[tuple[int, int], float] = {}
        for f, p in responses[v]:
            a = answer(f, v, fact)
            if v in seen and a != seen[v]:
                continue
            b = done[v] if v in done else answer(f, v, other)
            merged[a, b] = merged.get((a, b), 0.0) + p
        todo += [(k + 1, w * p, fact | {v: a}, other | {v: b}) for (a, b), p in merged.items()]
    if total <= 0:
        raise ValueError("the observation has probability 0")
    return {s: p / total for s, p in out.items()}


def chi2_tail(x: float, df: int) -> float:
    """P(X >= x) of a chi-square variable: the regularised upper incomplete gamma, by series or continued fraction."""
    if df <= 0 or x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    head = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * head)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return head * h


def chi2(table: np.ndarray) -> tuple[float, int]:
    """Statistic and degrees of freedom of x against y, summed over the strata in the last axis."""
    stat, df = 0.0, 0
    for z in range(table.shape[2]):
        t = table[:, :, z]
        t = t[t.sum(1) > 0][:, t.sum(0) > 0]
        if t.size and min(t.shape) > 1:
            e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
            stat += float(((t - e) ** 2 / e).sum())
            df += (t.shape[0] - 1) * (t.shape[1] - 1)
    return stat, df


Test = tuple[str, str, tuple[str, ...]]


def _combined():
    """Arrow batches to the combinations that occur in ``ROWS_AT_ONCE`` rows or little more, with ``_n``, the rows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def combined() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            names = t.column_names
            t = t.append_column("_n", pa.array(np.ones(len(t), np.int64))).group_by(names, use_threads=False).aggregate([("_n", "sum")])
            yield from t.select([*names, "_n_sum"]).rename_columns([*names, "_n"]).combine_chunks().to_batches()

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= ROWS_AT_ONCE:
                yield from combined()
        if held:
            yield from combined()

    return run  # an inner function, which travels to tasks by value


def states_of(data: DataFrame, variables: list[str]) -> DataFrame:
    """The variables as strings (null is a state) with ``_n``, the rows of combinations that occur; written once for all tests.

    A combination comes once for each bounded run of rows that holds it: of many variables nearly every row is a combination of its own,
    and grouping all of them would hold the table in the tasks' memory to little use."""
    d = data.select(*[F.coalesce(F.col(v).cast("string"), F.lit("\0")).alias(v) for v in variables])
    return materialise(d.mapInArrow(_combined(), ", ".join(f"`{v}` string" for v in variables) + ", _n long"))


def _contingency(sets: list[tuple[str, ...]]):
    """Arrow batches of states with ``_n`` to ``set, states, n``: the cells of each set of variables, summed over many rows before they leave a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        values: dict[str, dict[str, int]] = {}
        held: list[tuple[dict[str, np.ndarray], np.ndarray]] = []

        def cells() -> Iterator[pa.RecordBatch]:
            code = {v: np.concatenate([c[v] for c, _ in held]) for v in names}
            n = np.concatenate([w for _, w in held])
            held.clear()
            for i, some in enumerate(sets):
                size = [len(values[v]) for v in some]
                if math.prod(size) >= 2**62:
                    raise ValueError("too many states")
                at = np.zeros(len(n), np.int64)
                for v, k in zip(some, size, strict=True):
                    at = at * k + code[v]
                if math.prod(size) <= 1 << 20:
                    sums = np.bincount(at, n, math.prod(size))
                    cell = np.flatnonzero(sums)
                    sums = sums[cell]
                else:
                    cell, of = np.unique(at, return_inverse=True)
                    sums = np.bincount(of, n)
                rest, columns = cell, []
                for v, k in zip(some[::-1], size[::-1], strict=True):
                    columns.append(np.array(list(values[v]), object)[rest % k])
                    rest = rest // k
                states = np.stack(columns[::-1], 1).ravel() if len(cell) else np.zeros(0, object)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(states) + 1, len(some), dtype=np.int32)), pa.array(states, pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), i, np.int32)), lists, pa.array(sums.astype(np.int64))], names=["set", "states", "n"])

        for b in batches:
            if not names:
                names = [c for c in b.schema.names if c != "_n"]
                values = {v: {} for v in names}
            coded = {}
            for v in names:
                d = b.column(v).dictionary_encode()
                known = values[v]
                own = np.array([known.setdefault(x, len(known)) for x in d.dictionary.to_pylist()], np.int64)
                coded[v] = own[d.indices.to_numpy()] if len(own) else np.zeros(0, np.int64)
            held.append((coded, b.column("_n").to_numpy().astype(np.float64)))
            if sum(len(w) for _, w in held) >= ROWS_AT_ONCE:
                yield from cells()
        if held:
            yield from cells()

    return count


def independence(joint: DataFrame, tests: list[Test]) -> DataFrame:
    """``test, stat, df``: Pearson's statistic of each test ``(x, y, given)``, summed over the strata of ``given``, by its number in the list.

    Tests over the same variables share one table of cells, and all tables are counted in one pass over the combinations of states.  With
    observed cells n, rows r, columns c and N in a stratum the statistic is the sum of ``n n N / (r c)`` less N, so cells that are not
    there need no row."""
    variables = [c for c in joint.columns if c != "_n"]
    by_set: dict[tuple[str, ...], int] = {}
    rows = []
    for i, (x, y, given) in enumerate(tests):
        own = tuple(v for v in variables if v in {x, y, *given})
        rows.append((by_set.setdefault(own, len(by_set)), i, own.index(x), own.index(y), [own.index(v) for v in sorted(given)]))
    used = [v for v in variables if any(v in s for s in by_set)]
    cells = joint.select(*used, "_n").mapInArrow(_contingency(list(by_set)), "set int, states array<string>, n long").groupBy("set", "states").agg(F.sum("n").alias("n"))
    of = joint.sparkSession.createDataFrame(rows, "set int, test int, ix int, iy int, iz array<int>")  # a row a test
    z = F.concat_ws("\1", F.transform("iz", lambda i: F.get("states", i)))
    cells = cells.join(F.broadcast(of), "set").select("test", F.get("states", "ix").alias("x"), F.get("states", "iy").alias("y"), z.alias("z"), "n")
    total = lambda *by: F.sum("n").over(Window.partitionBy("test", "z", *by))
    cells = cells.withColumns({"r": total("x"), "c": total("y")})
    strata = cells.groupBy("test", "z").agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n") / F.col("r") / F.col("c")).alias("q"), F.count_distinct("x").alias("nx"), F.count_distinct("y").alias("ny"))
    return strata.groupBy("test").agg(F.sum(F.col("N") * F.col("q") - F.col("N")).alias("stat"), F.sum((F.col("nx") - 1) * (F.col("ny") - 1)).alias("df"))


def discover_dag(data: DataFrame, variables: list[str], alpha: float = 0.01, most: int = 3) -> dict:
    """The PC algorithm with chi-square tests: undirected ``skeleton`` and the ``directed`` edges that it can orient.

    A proposal only.  All tests of a level are one aggregation in Spark (see `independence`); a row a test comes back."""
    joint = states_of(data, variables)

    def separated(tests: list[Test]) -> set[Test]:
        if not tests:
            return set()
        found = {r["test"]: chi2_tail(r["stat"], r["df"]) for r in independence(joint, tests).collect()}
        return {t for i, t in enumerate(tests) if found.get(i, 1.0) > alpha}  # without rows nothing speaks against independence

    near = {v: set(variables) - {v} for v in variables}
    apart: dict[frozenset, tuple[str, ...]] = {}
    for n in range(most + 1):
        frozen = {v: set(near[v]) for v in variables}
        asked: dict[tuple[str, str], list[Test]] = {}
        for x, y in combinations(variables, 2):
            if y in near[x]:
                given = dict.fromkeys(z for side in (frozen[x] - {y}, frozen[y] - {x}) for z in combinations(sorted(side), n))
                asked[x, y] = [(x, y, z) for z in given]
        apart_by = separated([t for tests in asked.values() for t in tests])
        for (x, y), tests in asked.items():
            hit = next((t for t in tests if t in apart_by), None)
            if hit is not None:
                near[x].discard(y)
                near[y].discard(x)
                apart[frozenset((x, y))] = hit[2]
    directed: set[tuple[str, str]] = set()
    for z in variables:
        for x, y in combinations(sorted(near[z]), 2):
            if y not in near[x] and z not in apart.get(frozenset((x, y)), ()):
                directed |= {(x, z), (y, z)}
    changed = True
    while changed:
        changed = False
        for x, y in [(a, b) for a in variables for b in near[a]]:
            if (x, y) in directed or (y, x) in directed:
                continue
            if any((w, x) in directed and y not in near[w] and w != y for w in variables) or any((x, w) in directed and (w, y) in directed for w in variables):
                directed.add((x, y))
                changed = True
    return {"skeleton": sorted({tuple(sorted((x, y))) for x in variables for y in near[x]}), "directed": sorted(directed)}


__all__ = ["Dag", "do_query", "identify", "explain_do", "counterfactual", "discover_dag", "independence", "states_of", "chi2", "chi2_tail", "joint"]
