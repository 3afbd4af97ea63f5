"""Triple-pattern queries: a validated list of patterns becomes joins on shared variables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import terms as T
from ..plans.grid import grid_join
from .entities import OPS
from .graph import Graph
from .statistics import Statistics

MAX_LIMIT = 10_000
#: Triples that a subject may have of one predicate for a star to gather them in its row; beyond it the predicate is joined.
STAR_MOST = 64
#: Tasks that the pairs of values frequent on both sides are dealt over.
PRODUCT_TASKS = 256


@dataclass(frozen=True)
class Triple:
    """Each position is a ``?variable``, an IRI or CURIE, or (object only) a literal given as ``"text"``."""

    s: str
    p: str
    o: str


@dataclass(frozen=True)
class Condition:
    var: str
    op: str
    value: str | int | float


@dataclass
class Pattern:
    select: list[str]
    where: list[Triple]
    filters: list[Condition] = field(default_factory=list)
    distinct: bool = False
    limit: int | None = 100
    offset: int = 0

    def __post_init__(self) -> None:
        if not self.where:
            raise ValueError("a pattern needs a triple")
        used = {x for t in self.where for x in (t.s, t.p, t.o) if T.is_variable(x)}
        for v in [*self.select, *(c.var for c in self.filters)]:
            if not T.is_variable(v) or v not in used:
                raise ValueError(f"not a variable of the pattern: {v!r}")
        for c in self.filters:
            if c.op not in OPS:
                raise ValueError(f"unknown operator {c.op!r}")
        if self.limit is not None and not 1 <= self.limit <= MAX_LIMIT or self.offset < 0:
            raise ValueError("limit or offset out of range")


def _literal(term: str) -> str | None:
    return term[1:-1] if len(term) >= 2 and term[0] == term[-1] == '"' else None


def _scan(graph: Graph, t: Triple, ontology: str | None, layers: tuple[str, ...]) -> DataFrame:
    rows = graph.triples(None if T.is_variable(t.p) else [graph.iri(t.p)], ontology, layers)
    columns: dict[str, str] = {}
    for pos, term in (("s", t.s), ("p", t.p), ("o", t.o)):
        if T.is_variable(term):
            if term in columns:  # a variable twice in one pattern
                rows = rows.where(F.col(pos) == F.col(columns[term]))
            else:
                columns[term] = pos
        elif pos == "o" and _literal(term) is not None:
            rows = rows.where((F.col("o") == _literal(term)) & (F.col("o_kind") == "literal"))
        elif pos != "p":
            rows = rows.where(F.col(pos) == graph.iri(term))
    out = [F.col(pos).alias(v[1:]) for v, pos in columns.items()]
    if out and graph.is_set(t.p if T.is_variable(t.p) else graph.iri(t.p), ontology, layers) and not T.is_variable(t.p):
        return rows.select(*out)  # a predicate's pairs are there once
    return rows.select(*out).distinct() if out else rows.limit(1).select(F.lit(1).alias("_one"))


def _star(graph: Graph, star: list[Triple], ontology: str | None, layers: tuple[str, ...]) -> DataFrame:
    """Patterns of one subject in one exchange: its triples are gathered by pattern in its row, then unfolded.

    Each subject has at most ``STAR_MOST`` triples of each predicate, by the statistics."""
    names = sorted({graph.iri(t.p) for t in star})
    rows = graph.scope(names, ontology, layers)[0]
    tests = []
    for t in star:
        test = F.col("p") == graph.iri(t.p)
        if _literal(t.o) is not None:
            test = test & (F.col("o") == _literal(t.o)) & (F.col("o_kind") == "literal")
        elif not T.is_variable(t.o):
            test = test & (F.col("o") == graph.iri(t.o))
        tests.append(test)
    own = rows.groupBy("s").agg(*[F.collect_set(F.when(test, F.col("o"))).alias(f"_o{i}") for i, test in enumerate(tests)])
    own = own.where(" and ".join(f"size(_o{i}) > 0" for i in range(len(star))))
    out = {star[0].s[1:]: F.col("s")}
    for i, t in enumerate(star):
        if T.is_variable(t.o):
            own = own.withColumn(f"_o{i}", F.explode(f"_o{i}"))
            if t.o[1:] in out:  # the subject again, or two patterns with one object
                own = own.where(F.col(f"_o{i}") == out[t.o[1:]])
            else:
                out[t.o[1:]] = F.col(f"_o{i}")
    return own.select(*[c.alias(v) for v, c in out.items()])


def _units(graph: Graph, patterns: list[Triple], stats: Statistics) -> list[list[Triple]]:
    """Stars of two patterns or more with a common subject variable and predicates that a row can gather; the others alone."""
    stars: dict[str, list[Triple]] = {}
    alone = []
    for t in dict.fromkeys(patterns):
        fits = T.is_variable(t.s) and not T.is_variable(t.p) and 0 < stats.of(graph.iri(t.p)).most <= STAR_MOST
        (stars.setdefault(t.s, []) if fits else alone).append(t)
    return [s for s in stars.values() if len(s) > 1] + [[t] for t in alone + [s[0] for s in stars.values() if len(s) == 1]]


def _planned(graph: Graph, patterns: list[Triple], stats: Statistics) -> list[list[Triple]]:
    """Units by estimated size: the smallest first, then always that which shares a variable and leaves the fewest rows."""

    def size(unit: list[Triple]) -> float:
        one = lambda t: stats.triples(None if T.is_variable(t.p) else graph.iri(t.p), not T.is_variable(t.s), not T.is_variable(t.o))
        if len(unit) == 1:
            return one(unit[0])
        names = [graph.iri(t.p) for t in unit]
        subjects = stats.star(names)
        for t, p in zip(unit, names, strict=True):
            subjects *= one(t) / max(1, stats.of(p).subjects)
        return subjects

    def values(unit: list[Triple], v: str) -> float:
        """Distinct values of a variable in a unit."""
        found = [max(1, getattr(stats.of(None if T.is_variable(t.p) else graph.iri(t.p)), "subjects" if t.s == v else "objects")) for t in unit if v in (t.s, t.o)]
        return min(found, default=1)

    variables = lambda unit: {x for t in unit for x in (t.s, t.p, t.o) if T.is_variable(x)}
    left = sorted(_units(graph, patterns, stats), key=size)
    out, seen, rows = [], {}, 1.0
    while left:
        def then(unit: list[Triple]) -> tuple[bool, float]:
            shared = seen.keys() & variables(unit)
            n = rows * size(unit)
            for v in shared:
                n /= max(values(unit, v), seen[v])
            return bool(seen) and not shared, n

        best = min(left, key=then)
        rows = max(1.0, then(best)[1])
        seen |= {v: min(seen.get(v, float("inf")), values(best, v)) for v in variables(best)}
        left.remove(best)
        out.append(best)
    return out


def _variables(patterns: list[Triple]) -> set[str]:
    return {x for t in patterns for x in (t.s, t.p, t.o) if T.is_variable(x)}


def _keyed(patterns: list[Triple], shared: set[str]) -> bool:
    """Whether values of ``shared`` make out a row but for its subjects' several objects: each subject is one of them or is reached from one."""
    reached = set(shared)
    while more := {t.o for t in patterns if t.s in reached and T.is_variable(t.o)} - reached:
        reached |= more
    return all(t.s in reached for t in patterns if T.is_variable(t.s))


def _order(patterns: list[Triple]) -> list[list[Triple]]:
    """Most bound first, then always one whose subject is in what is joined, else one that shares a variable with it.

    Where that would multiply rows (frequent on both sides, or no variable shared), all that hangs on the pattern's other variables is joined
    with it first: what selects among its rows comes before the product, and no product is shuffled for it."""
    bound = lambda t: sum(not T.is_variable(x) for x in (t.s, t.p, t.o)) + (not T.is_variable(t.s)) + (not T.is_variable(t.o))
    left = sorted(patterns, key=lambda t: -bound(t))
    out, done = [], []
    while left:
        seen = _variables(done)
        nxt = next((t for t in left if t.s in seen), None) or next((t for t in left if seen & _variables([t])), left[0])
        unit = [nxt]
        left.remove(nxt)
        shared = seen & _variables(unit)
        if done and nxt.s not in seen and not (shared and _keyed(done, shared)):
            while more := [t for t in left if _variables([t]) & (_variables(unit) - seen)]:
                unit += more
                left = [t for t in left if t not in more]
        out.append(unit)
        done += unit
    return out


def _condition(c: Condition):
    v = F.col(c.var[1:])
    number = isinstance(c.value, (int, float))
    x = v.try_cast("decimal(38,10)") if number else v
    y = F.lit(str(c.value)).cast("decimal(38,10)") if number else F.lit(c.value)
    if c.op == "contains":
        return v.contains(str(c.value))
    if c.op == "starts_with":
        return v.startswith(str(c.value))
    return {"=": x == y, "!=": x != y, ">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[c.op]


def bindings(graph: Graph, patterns: list[Triple], ontology: str | None = None, layers: tuple[str, ...] = ("data",), stats: Statistics | None = None) -> DataFrame:
    """One column a variable; patterns without a shared variable multiply, as their semantics demand.

    With statistics of the graph, patterns of one subject are one exchange and units are joined by estimated size.  Where the variables shared
    may be frequent on both sides, their pairs are dealt over tasks."""
    out, done = None, []
    for unit in _planned(graph, patterns, stats) if stats else _order(patterns):
        if len(unit) == 1:
            rows = _scan(graph, unit[0], ontology, layers)
        else:
            rows = _star(graph, unit, ontology, layers) if stats else bindings(graph, unit, ontology, layers)
        shared = [c for c in rows.columns if out is not None and c in out.columns]
        named = {f"?{c}" for c in shared}
        if out is None:
            out = rows
        elif shared and not _keyed(done, named) and not _keyed(unit, named):
            out = grid_join(out, rows, shared, tasks=PRODUCT_TASKS)
        else:
            out = out.join(rows, shared) if shared else out.crossJoin(rows)
        done += unit
    return out


def query_pattern(graph: Graph, q: Pattern, ontology: str | None = None, layers: tuple[str, ...] = ("data",), stats: Statistics | None = None) -> DataFrame:
    rows = bindings(graph, q.where, ontology, layers, stats)
    for c in q.filters:
        rows = rows.where(_condition(c))
    rows = rows.select(*[v[1:] for v in q.select])
    rows = rows.distinct() if q.distinct else rows
    if q.limit is not None or q.offset:
        rows = rows.orderBy(*rows.columns)
        rows = rows.offset(q.offset) if q.offset else rows
        rows = rows.limit(q.limit) if q.limit is not None else rows
    return rows
