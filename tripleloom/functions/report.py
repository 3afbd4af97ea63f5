"""Evaluation: checks of a reasoning goldset, counters, and reports as Markdown.

Results of a run are rows ``id, difficulty, category, status, row_count``; a goldset has as many as it has questions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bayes, causal


def counters(rows: DataFrame, by: str) -> DataFrame:
    """``<by>, n``, the most frequent first, ties by name."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


@dataclass
class Question:
    """``kind``: posterior, do, counterfactual (``expected`` probabilities of ``query``'s states) or identify."""

    id: str
    kind: str
    query: str | None = None
    given: dict[str, str] = field(default_factory=dict)
    do: dict[str, str] = field(default_factory=dict)
    expected: dict[str, float] = field(default_factory=dict)
    tolerance: float = 0.01
    treatment: str | None = None
    outcome: str | None = None
    identifiable: bool | None = None
    backdoor: list[str] | None = None


def _answer(q: Question, net: bayes.Network) -> dict[str, float]:
    if q.kind == "posterior":
        return bayes.posterior(net, [q.query], q.given)[q.query]
    if q.kind == "do":
        return causal.do_query(net, q.do, [q.query], q.given)[q.query]
    if q.kind == "counterfactual":
        return causal.counterfactual(net, q.given, q.do, q.query)
    raise ValueError(f"unknown kind {q.kind!r}")


def check_reasoning(spark, questions: list[Question], net: bayes.Network, dag: causal.Dag | None = None) -> DataFrame:
    """``id, kind, passed, deviation, error`` per question; a question that fails to run is a failure, not the end."""
    rows = []
    for q in questions:
        passed, off, error = False, None, None
        try:
            if q.kind == "identify":
                r = causal.identify(dag, q.treatment, q.outcome)
                passed = q.identifiable in (None, r["identifiable"]) and (q.backdoor is None or sorted(q.backdoor) == sorted(r["backdoor"]))
            else:
                got = _answer(q, net)
                off = max(abs(got.get(s, 0.0) - p) for s, p in q.expected.items())
                passed = off <= q.tolerance
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        rows.append((q.id, q.kind, passed, off, error))
    return spark.createDataFrame(rows, "id string, kind string, passed boolean, deviation double, error string")


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """``id, difficulty, n_a, n_b, change``: two runs aligned by question; ``=``, ``▲`` or ``▼`` where both have rows, ``only a`` or ``only b``."""
    one = lambda df, n: df.select("id", F.col("difficulty").alias(f"d_{n}"), F.when(F.col("status") != "error", F.col("row_count")).alias(f"n_{n}"), F.lit(True).alias(f"in_{n}"))
    j = one(a, "a").join(one(b, "b"), "id", "full_outer")
    change = F.when(F.col("in_a").isNull(), "only b").when(F.col("in_b").isNull(), "only a").when(F.col("n_a") == F.col("n_b"), "=").when(F.col("n_a") > F.col("n_b"), "▲").when(F.col("n_a") < F.col("n_b"), "▼").otherwise("")
    return j.select("id", F.coalesce("d_a", "d_b").alias("difficulty"), "n_a", "n_b", change.alias("change"))


def outcome(results: DataFrame, by: str = "difficulty") -> DataFrame:
    """``<by>, ok, errors, empty`` of a run."""
    ok = F.col("status") == "ok"
    return results.groupBy(by).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("errors"), F.count_if(ok & (F.col("row_count") == 0)).alias("empty"))


def _grid(df: DataFrame) -> list[str]:
    cell = lambda v: "" if v is None else str(v)
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return head + ["| " + " | ".join(cell(v) for v in r) + " |" for r in df.collect()]  # a row per question or group


def markdown(results: DataFrame, title: str) -> str:
    """The report of one run: totals, outcome per difficulty, categories, failures."""
    n = results.agg(F.count("*").alias("n"), F.count_if(F.col("status") != "ok").alias("bad")).first()
    parts = [f"# {title}", "", f"{n['n']} questions, {n['bad']} failures", "", "## Difficulty", "", *_grid(outcome(results).orderBy("difficulty")), "", "## Category", "", *_grid(counters(results, "category"))]
    if n["bad"]:
        parts += ["", "## Failures", "", *_grid(results.where("status <> 'ok'").orderBy("id"))]
    return "\n".join(parts) + "\n"


def compare(a: DataFrame, b: DataFrame, name_a: str, name_b: str) -> str:
    """Two runs side by side as Markdown."""
    rows = side_by_side(a, b).orderBy("id")
    both = [f"# {name_a} and {name_b}", "", f"## {name_a}", "", *_grid(outcome(a).orderBy("difficulty")), "", f"## {name_b}", "", *_grid(outcome(b).orderBy("difficulty")), "", "## Questions", ""]
    return "\n".join([*both, *_grid(rows)]) + "\n"
