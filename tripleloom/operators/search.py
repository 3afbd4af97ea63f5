"""Full-text ranking by BM25 over literals, by a scan of the texts; `text_index` answers the same from stored postings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import terms as T
from ..plans.materialise import materialise
from .graph import Graph, instances

K1, B = 1.2, 0.75
SPLIT = r"[^\p{L}\p{N}]+"
_LEX = re.compile(r'"([^"]*)"|([()])|([^\s()"]+)')


@dataclass
class Asked:
    """A query's leaves (a word, ``prefix*`` or a phrase as words joined by spaces) and which of them a document must hold.

    ``tree``: a leaf's number, or ``(and | or | not, subtrees)``.  Leaves under a ``not`` do not score."""

    leaves: list[str] = field(default_factory=list)
    tree: int | tuple | None = None
    scoring: set[int] = field(default_factory=set)

    def holds(self, tf: list[Column]) -> Column:
        def test(t) -> Column:
            if isinstance(t, int):
                return tf[t] > 0
            if t[0] == "not":
                return ~test(t[1][0])
            out = test(t[1][0])
            for x in t[1][1:]:
                out = out & test(x) if t[0] == "and" else out | test(x)
            return out

        return test(self.tree)


def parse(query: str) -> Asked:
    """Words, ``prefix*``, quoted phrases; AND before OR, which is the default; NOT or ``-`` before an operand; parentheses.

    A word with other signs in it is the phrase of its parts.  A query of exclusions only has no documents to rank and raises, like an empty one."""
    query = re.sub(r"[\x00-\x1f]", " ", query)
    lexed = [m for m in _LEX.finditer(query)]
    out, at = Asked(), 0

    def leaf(text: str, star: bool, minus: bool):
        words = re.findall(r"[^\W_]+", text.lower())
        if not words:
            return None
        name = " ".join(words) + ("*" if star and len(words) == 1 else "")
        if name not in out.leaves:
            out.leaves.append(name)
        i = out.leaves.index(name)
        if not minus:
            out.scoring.add(i)
        return i

    def word() -> str | None:
        return lexed[at][0] if at < len(lexed) else None

    def operand(minus: bool):
        nonlocal at
        m = lexed[at]
        at += 1
        if m[2] == "(":
            t = either(minus)
            at += at < len(lexed)
            return t
        if m[3] and m[3].startswith("-") and len(m[3]) > 1:
            t = leaf(m[3][1:], m[3].endswith("*"), not minus)
            return None if t is None else ("not", [t])
        if m[3] == "NOT":
            t = operand(not minus) if word() not in (None, ")") else None
            return None if t is None else ("not", [t])
        return leaf(m[1], False, minus) if m[1] is not None else leaf(m[3], m[3].endswith("*"), minus)

    def both(minus: bool):
        nonlocal at
        found = [operand(minus)]
        while word() == "AND":
            at += 1
            if word() not in (None, ")"):
                found.append(operand(minus))
        found = [x for x in found if x is not None]
        return ("and", found) if len(found) > 1 else found[0] if found else None

    def either(minus: bool = False):
        nonlocal at
        found = []
        while word() not in (None, ")"):
            if word() in ("OR", "AND"):
                at += 1
                continue
            found.append(both(minus))
        found = [x for x in found if x is not None]
        # an exclusion among alternatives takes from all of them
        plain = [x for x in found if not (isinstance(x, tuple) and x[0] == "not")]
        if plain and len(plain) < len(found):
            rest = [x for x in found if x not in plain]
            return ("and", [("or", plain) if len(plain) > 1 else plain[0], *rest])
        return ("or", found) if len(found) > 1 else found[0] if found else None

    while at < len(lexed):
        t = either()
        out.tree = t if out.tree is None else out.tree if t is None else ("or", [out.tree, t])
        at += at < len(lexed)  # a parenthesis that closes nothing
    if not out.scoring:
        raise ValueError("the query has no term")
    return out


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def frequency(words: Column, leaf: str) -> Column:
    """How often a leaf stands in the words of a text."""
    if leaf.endswith("*"):
        return F.size(F.filter(words, lambda x: x.startswith(leaf[:-1])))
    phrase = leaf.split(" ")
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda x: x == leaf))
    starts = F.filter(F.transform(words, lambda x, i: F.when(x == phrase[0], i)), lambda i: i.isNotNull())
    here = F.size(F.filter(starts, lambda i: F.slice(words, i + 1, len(phrase)) == F.array(*map(F.lit, phrase))))
    return F.when(F.array_contains(words, phrase[0]), here).otherwise(0)


def scored(asked: Asked, tf: list[Column], length: Column, n: Column, mean: Column, df: list[Column]) -> Column:
    """The sum over scoring leaves of ``ln(1 + (N - df + 0.5) / (df + 0.5)) * tf (k1 + 1) / (tf + k1 (1 - b + b len / avg))``."""
    total = F.lit(0.0)
    for i in sorted(asked.scoring):
        idf = F.log(1 + (n - df[i] + 0.5) / (df[i] + 0.5))
        total = total + idf * tf[i] * (K1 + 1) / (tf[i] + K1 * (1 - B + B * length / mean))
    return total


def bm25(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, score`` of the documents that answer the query, by one scan.

    A prefix counts as one term, and so does a phrase, with its own frequency; lengths and other terms do not depend on it.  Terms are
    counted inside each document's own row, so no token leaves it; only one row of statistics comes from the corpus."""
    asked = parse(query)
    names = range(len(asked.leaves))
    d = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    # written once, narrow: the statistics and the scores both read it, the texts are read once
    d = materialise(d.select("id", F.size("w").alias("len"), *[frequency(F.col("w"), t).alias(f"tf{i}") for i, t in enumerate(asked.leaves)]))
    stats = d.agg(F.count("*").alias("N"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in names])
    tf = [F.col(f"tf{i}") for i in names]
    score = scored(asked, tf, F.col("len"), F.col("N"), F.col("avg"), [F.col(f"df{i}") for i in names])
    return d.where(asked.holds(tf)).crossJoin(F.broadcast(stats)).select("id", score.alias("score"))  # one row of statistics


def literals(graph: Graph, fields: str = "text", ontology: str | None = None) -> DataFrame:
    """Documents ``id(s, p, o), text``.  ``text``: each literal of the text properties; ``all``: each string literal of any
    property; ``node``: all string literals of a node as one text, in the order of predicate and value."""
    if fields not in ("text", "all", "node"):
        raise ValueError(f"unknown fields {fields!r}")
    strings = (F.col("o_kind") == "literal") & (F.col("lang").isNotNull() | F.col("dt").isNull() | F.col("dt").isin(T.XSD + "string", T.RDF + "langString"))
    lit = graph.triples(list(T.TEXT_PROPERTIES) if fields == "text" else None, ontology, ("schema", "data") if fields == "text" else ("data",)).where(F.col("o_kind") == "literal" if fields == "text" else strings)
    lit = lit.select("s", "p", "o").distinct()
    if fields == "node":
        lit = lit.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("p", "o"))).alias("all"))
        lit = lit.select("s", F.lit(None).cast("string").alias("p"), F.array_join(F.transform("all", lambda x: x["o"]), "\n").alias("o"))
    return lit.select(F.struct("s", "p", "o").alias("id"), F.col("o").alias("text"))


def index_literals(graph: Graph, index, ontology: str | None = None, fields: str = "text") -> int:
    """Add the graph's documents (see ``literals``) to a `text_index.TextIndex`, for `search_text` with ``index``; returns the commit."""
    d = literals(graph, fields, ontology).select(F.concat_ws(" ", "id.s", F.hex(F.xxhash64("id.p", "id.o"))).alias("id"), "text")
    return index.add(d)


def search_text(graph: Graph, query: str, class_uri: str | None = None, limit: int = 10, ontology: str | None = None, fields: str = "text", index=None) -> DataFrame:
    """``uri, score``: an entity has the score of its best document (see ``literals``), from an ``index`` of these where given, else by a scan.

    Only typed entities; with a class only its instances, descendants included, and filtered before the top is taken."""
    T.limit("search", limit)
    if index is None:
        scored = bm25(literals(graph, fields, ontology), query).select(F.col("id.s").alias("s"), "score")
    else:
        scored = index.search(query, None).select(F.substring_index("id", " ", 1).alias("s"), "score")
    typed = graph.triples([T.TYPE], ontology).where(~F.col("o").isin(*T.VOCABULARY_TYPES)).select("s").distinct() if class_uri is None else instances(graph, graph.iri(class_uri), ontology)
    best = scored.join(typed, "s", "left_semi").groupBy(F.col("s").alias("uri")).agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "uri").limit(limit)


def rrf(lists: list[DataFrame], limit: int, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of bounded lists ``uri, score``: the sum of ``1 / (k + rank)``."""
    ranked = [x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "uri"))) for x in lists]
    every = ranked[0]
    for r in ranked[1:]:
        every = every.unionByName(r)
    return every.groupBy("uri").agg(F.sum(1 / (k + F.col("rank"))).alias("score")).orderBy(F.desc("score"), "uri").limit(limit)
