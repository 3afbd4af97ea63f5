"""A SPARQL 1.1 subset compiled to DataFrames.

SELECT [DISTINCT] and ASK; triples with ``;`` and ``,``; paths ``p+``, ``p*``, ``p/q``, ``^p``, ``p|q``; FILTER with comparisons, ``&&``, ``||``,
``!``, IN, STR, LCASE, LANG, CONTAINS, STRSTARTS, NOT EXISTS and EXISTS; OPTIONAL; UNION; MINUS; VALUES; sub-SELECT; COUNT, SUM, AVG, MIN,
MAX, SAMPLE with GROUP BY and HAVING; ``(expr AS ?v)``; ORDER BY, LIMIT, OFFSET.  A term is its lexical form.

An unbound variable is null and joins with anything.  Which variables may be unbound follows from the text, so joins of others stay plain
equi-joins; where one may be, both sides are keyed by which variables are bound on either (`Query.compatible`)."""

from __future__ import annotations

import re
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..operators.traverse import closure, reach
from . import terms as T
from .grid import grid_join
from .materialise import materialise

_TOKEN = re.compile(
    r"""(?P<skip>(?:\s+|\#[^\n]*)+)|(?P<iri><[^<>\s]*>)|(?P<var>[?$]\w+)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<tag>@[A-Za-z-]+)
    |(?P<number>[+-]?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]?[\w-]*:[\w.%-]*[\w%-]|[A-Za-z_]?[\w-]*:)|(?P<word>[A-Za-z]\w*)|(?P<mark>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!*/+^|-])""",
    re.X,
)
#: Columns that are no variables.
_OWN = ("_unit", "_lang_")
_AGGS = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE"}


class Rows(NamedTuple):
    """Solutions, one column a variable, and the variables that some of them may leave unbound."""

    df: DataFrame
    loose: frozenset[str] = frozenset()


class Query:
    def __init__(self, graph: Graph, text: str, ontology: str | None = None, layers: tuple[str, ...] = ("schema", "data")):
        self.graph, self.ontology, self.layers = graph, ontology, layers
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"SPARQL: unexpected {text[at:at + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at, self.fresh = 0, 0
        self.prefixes = dict(graph.prefixes)

    # --- tokens
    def peek(self) -> str:
        return self.tokens[self.at][1].upper() if self.tokens[self.at][0] == "word" else self.tokens[self.at][1]

    def take(self, *want: str) -> str:
        s = self.peek()
        if want and s not in want:
            raise ValueError(f"SPARQL: expected {' or '.join(want)}, got {s!r}")
        self.at += 1
        return s

    def maybe(self, *want: str) -> bool:
        if self.peek() in want:
            self.at += 1
            return True
        return False

    def hidden(self) -> str:
        self.fresh += 1
        return f"_h{self.fresh}"

    # --- query forms
    def run(self) -> DataFrame:
        while self.maybe("PREFIX"):
            name = self.tokens[self.at][1][:-1]
            self.at += 1
            self.prefixes[name] = self.tokens[self.at][1][1:-1]
            self.at += 1
        if self.maybe("ASK"):
            self.maybe("WHERE")
            rows = self.group().df
            return rows.limit(1).agg((F.count("*") > 0).alias("ask"))
        out = self.select()
        if self.peek():
            raise ValueError(f"SPARQL: unexpected {self.peek()!r}")
        return out.df

    def select(self) -> Rows:
        self.take("SELECT")
        distinct = self.maybe("DISTINCT", "REDUCED")
        items: list[tuple[str, int | None]] = []
        star = self.maybe("*")
        while not star and self.peek() not in ("WHERE", "{"):
            if self.maybe("("):
                start = self.at
                self.skip_expression()
                self.take("AS")
                items.append((self.variable(), start))
                self.take(")")
            else:
                items.append((self.variable(), None))
        self.maybe("WHERE")
        rows, loose = self.group()
        groups: list[str] = []
        if self.maybe("GROUP"):
            self.take("BY")
            while self.tokens[self.at][0] == "var":
                groups.append(self.variable())
        having = None
        if self.maybe("HAVING"):
            having = self.at
            self.take("(")
            self.skip_expression()
            self.take(")")
        orders: list[tuple[int, bool]] = []
        if self.maybe("ORDER"):
            self.take("BY")
            while self.peek() in ("DESC", "ASC", "(") or self.tokens[self.at][0] == "var":
                down = self.peek() == "DESC"
                wrapped = self.maybe("DESC", "ASC")
                orders.append((self.at, down))
                if wrapped or self.peek() == "(":
                    self.take("(")
                    self.skip_expression()
                    self.take(")")
                else:
                    self.at += 1
        limit = offset = None
        while self.peek() in ("LIMIT", "OFFSET"):
            if self.take() == "LIMIT":
                limit = int(self.take())
            else:
                offset = int(self.take())
        end = self.at
        folds: list[Column] = []

        def compiled(start: int) -> Column:
            self.at = start
            return self.expression(folds)

        outs = {v: compiled(s) for v, s in items if s is not None}
        test = compiled(having) if having is not None else None
        grouped = bool(folds or groups)
        if grouped:
            rows = rows.groupBy(*groups).agg(*folds) if folds else rows.select(*groups).distinct()
        if test is not None:
            rows = rows.where(test)
        for v, e in outs.items():
            rows = rows.withColumn(v, e)
        if orders:
            # numbers by value, then everything by its form
            keys = [c for s, down in orders for e in [compiled(s)] for c in ([self.number(e).desc_nulls_last(), e.desc()] if down else [self.number(e).asc_nulls_last(), e.asc()])]
            rows = rows.orderBy(*keys)
        names = [v for v, _ in items] if not star else [c for c in rows.columns if not c.startswith("_")]
        rows = rows.select(*names)
        rows = rows.distinct() if distinct else rows
        rows = rows.offset(offset) if offset else rows
        rows = rows.limit(limit) if limit is not None else rows
        self.at = end
        return Rows(rows, frozenset(c for c in names if c in loose or c in outs))

    def variable(self) -> str:
        kind, s = self.tokens[self.at]
        if kind != "var":
            raise ValueError(f"SPARQL: {s!r} is no variable")
        self.at += 1
        return s[1:]

    def skip_expression(self) -> None:
        depth = 0
        while depth or self.peek() not in (")", "AS"):
            depth += {"(": 1, ")": -1}.get(self.peek(), 0)
            self.at += 1

    # --- patterns
    def group(self) -> Rows:
        self.take("{")
        rows: Rows | None = None
        filters: list[int] = []
        block: list[Rows] = []  # triple patterns since the last other element
        if self.peek() == "SELECT":
            rows = self.select()
            self.take("}")
            return rows
        while not self.maybe("}"):
            if self.maybe("FILTER"):
                filters.append(self.at)
                self.skip_filter()
                self.maybe(".")
                continue
            if self.peek() in ("OPTIONAL", "MINUS", "VALUES", "BIND", "{"):
                rows, block = self.block(rows, block), []
            if self.maybe("OPTIONAL"):
                rows = self.join(rows or self.unit(), self.group(), "left")
            elif self.maybe("MINUS"):
                rows = self.join(rows or self.unit(), self.group(), "minus")
            elif self.maybe("VALUES"):
                rows = self.join(rows, self.values())
            elif self.maybe("BIND"):
                self.take("(")
                e = self.expression(None)
                self.take("AS")
                v = self.variable()
                rows = Rows(rows.df.withColumn(v, e), rows.loose | {v})
                self.take(")")
            elif self.peek() == "{":
                one = self.group()
                while self.maybe("UNION"):
                    two = self.group()
                    one = Rows(one.df.unionByName(two.df, allowMissingColumns=True), one.loose | two.loose | frozenset(one.df.columns) ^ frozenset(two.df.columns))
                rows = self.join(rows, one)
            else:
                block += self.triples()
            self.maybe(".")
        rows = self.block(rows, block)
        end = self.at
        for f in filters:
            self.at = f
            rows = self.filter(rows)
        self.at = end
        return rows or self.unit()

    @classmethod
    def block(cls, rows: Rows | None, patterns: list[Rows]) -> Rows | None:
        """Patterns joined to what came before them.

        A row that leaves a variable unbound meets every row that binds it, so where there may be such rows the patterns that share a
        variable are joined with each other first."""
        if rows is not None and any(c in rows.loose for t in patterns for c in t.df.columns):
            pieces: list[Rows] = []
            for t in patterns:
                near = lambda x, t=t: bool(set(x.df.columns) & {c for c in t.df.columns if not c.startswith(_OWN)})
                met = [x for x in pieces if near(x)]
                pieces = [x for x in pieces if not near(x)]
                for x in met[1:]:
                    met[0] = cls.join(met[0], x)
                pieces.append(cls.join(met[0], t) if met else t)
            patterns = sorted(pieces, key=lambda x: any(c in rows.loose for c in x.df.columns))
        for t in patterns:
            rows = cls.join(rows, t)
        return rows

    def unit(self) -> Rows:
        """One solution that binds nothing."""
        return Rows(self.graph.spark.range(1).select(F.lit(1).alias("_unit")))

    def skip_filter(self) -> None:
        while self.peek() in ("NOT", "EXISTS"):
            self.at += 1
        if self.tokens[self.at][0] == "word":
            self.at += 1
        opening, closing = ("{", "}") if self.peek() == "{" else ("(", ")")
        depth = 0
        while True:
            depth += {opening: 1, closing: -1}.get(self.peek(), 0)
            self.at += 1
            if not depth:
                return

    def filter(self, rows: Rows) -> Rows:
        negate = self.maybe("NOT")
        if self.maybe("EXISTS"):
            return self.join(rows, self.group(), "anti" if negate else "semi")
        return Rows(rows.df.where(self.expression(None)), rows.loose)

    @classmethod
    def join(cls, a: Rows | None, b: Rows, how: str = "inner") -> Rows:
        """Solutions that agree wherever both bind a variable; ``how``: inner, left, semi, anti or minus."""
        if a is None:
            return b
        shared = [c for c in a.df.columns if c in b.df.columns and not c.startswith(_OWN)]
        keeps_b = how in ("inner", "left")
        bd = b.df.drop(*[c for c in b.df.columns if c in a.df.columns and c.startswith(_OWN)]) if keeps_b else b.df.select(*shared).distinct()
        if how == "minus" and not shared:
            return a
        loose = a.loose
        if how == "inner":
            loose = (a.loose & b.loose) | (a.loose - set(shared)) | (b.loose - set(shared))
        elif how == "left":
            loose = a.loose | (frozenset(bd.columns) - set(shared))
        if any(c in a.loose or c in b.loose for c in shared):
            return Rows(cls.compatible(a, Rows(bd, b.loose), shared, how), loose)
        how = {"semi": "left_semi", "anti": "left_anti", "minus": "left_anti"}.get(how, how)
        if shared:
            return Rows(a.df.join(bd, shared, how), loose)
        return Rows(a.df.crossJoin(bd) if how == "inner" else a.df.join(bd, F.lit(True), how), loose)  # SPARQL's product of unrelated patterns

    @staticmethod
    def compatible(a: Rows, b: Rows, shared: list[str], how: str) -> DataFrame:
        """One equi-join on the masks of bound variables and the values that both sides bind.

        A row comes once for each mask that the other side may have, at most ``2 ** n`` times for ``n`` variables that may be unbound; a
        pair of rows has one pair of masks, so it meets once."""
        free = [c for c in shared if c in a.loose or c in b.loose]
        bit = {c: 1 << i for i, c in enumerate(free)}

        def masks(loose: frozenset[str]) -> list[int]:
            return [sum(m) for m in product(*[(0, bit[c]) if c in loose else (bit[c],) for c in free])]

        def keyed(rows: Rows, other: frozenset[str], own: str, others: str) -> DataFrame:
            bound = sum((F.when(F.col(c).isNotNull(), F.lit(bit[c])).otherwise(F.lit(0)) for c in free), F.lit(0))
            d = rows.df.withColumn(own, bound).withColumn(others, F.explode(F.array(*map(F.lit, masks(other)))))
            both = F.col(own).bitwiseAND(F.col(others))
            d = d.withColumn("_both", both)
            return d.withColumns({f"_k{i}": F.when(both.bitwiseAND(F.lit(bit[c])) > 0, F.col(c)).otherwise(F.lit("")) if c in bit else F.col(c) for i, c in enumerate(shared)})

        left = a
        if how != "inner":
            left = Rows(materialise(a.df.withColumn("_row", F.monotonically_increasing_id())), a.loose)
        y = keyed(b, a.loose, "_mb", "_ma").drop("_both").withColumnsRenamed({c: f"_b_{c}" for c in shared})
        x = keyed(left, b.loose, "_ma", "_mb")
        # rows that do not bind a variable on both sides have one key
        met = grid_join(x, y, ["_ma", "_mb", *(f"_k{i}" for i in range(len(shared)))], F.col("_ma").bitwiseAND(F.col("_mb")) < sum(bit.values()))
        if how == "minus" and len(free) == len(shared):
            met = met.where("_both > 0")  # solutions that bind no variable in common do not take each other away
        if how in ("semi", "anti", "minus"):
            return left.df.join(met.select("_row").distinct(), "_row", "left_semi" if how == "semi" else "left_anti").drop("_row")
        own, more = a.df.columns, [c for c in b.df.columns if c not in shared]
        out = met.select(*([] if how == "inner" else ["_row"]), *[F.coalesce(c, f"_b_{c}").alias(c) if c in shared else F.col(c) for c in own], *more)
        if how == "inner":
            return out
        out = materialise(out)
        alone = left.df.join(out.select("_row").distinct(), "_row", "left_anti")
        return out.drop("_row").unionByName(alone.drop("_row"), allowMissingColumns=True)

    def values(self) -> Rows:
        names, rows = [], []
        if self.maybe("("):
            while not self.maybe(")"):
                names.append(self.variable())
        else:
            names.append(self.variable())
        self.take("{")
        while not self.maybe("}"):
            if self.maybe("("):
                row = []
                while not self.maybe(")"):
                    row.append(None if self.maybe("UNDEF") else self.term()[1])
                rows.append(tuple(row))
            else:
                rows.append((self.term()[1],))
        open_ = frozenset(n for i, n in enumerate(names) if any(r[i] is None for r in rows))
        return Rows(self.graph.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)), open_)

    def term(self) -> tuple[str, str]:
        """``(kind, value)``: var, iri or literal."""
        kind, s = self.tokens[self.at]
        self.at += 1
        if kind == "var":
            return "var", s[1:]
        if kind == "iri":
            return "iri", s[1:-1]
        if kind == "name":
            p, _, local = s.partition(":")
            if p not in self.prefixes and p not in T.PREFIXES:
                raise ValueError(f"SPARQL: unknown prefix {p!r}")
            return "iri", (self.prefixes.get(p) or T.PREFIXES[p]) + local
        if kind == "number":
            return "literal", s
        if kind == "text":
            value = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), s[1:-1])
            if self.tokens[self.at][0] == "tag":
                self.at += 1
            elif self.maybe("^^"):
                self.at += 1
            return "literal", value
        if s in ("true", "false"):
            return "literal", s
        if s == "[" and self.maybe("]"):
            return "var", self.hidden()
        raise ValueError(f"SPARQL: {s!r} is no term")

    def triples(self) -> list[Rows]:
        subject, out = self.term(), []
        while True:
            path = self.path()
            while True:
                out.append(Rows(self.scan(subject, path, self.term())))
                if not self.maybe(","):
                    break
            if not self.maybe(";") or self.peek() in (".", "}"):
                return out

    def path(self) -> list[tuple[list[tuple[str, str]], str, bool]]:
        """Steps ``(alternative predicates, '' or + or *, inverse)``."""
        steps = []
        while True:
            inverse = self.maybe("^")
            wrapped = self.maybe("(")
            p = [self.predicate()]
            while self.maybe("|"):
                p.append(self.predicate())
            if wrapped:
                self.take(")")
            mod = self.take() if self.peek() in ("+", "*") else ""
            steps.append((p, mod, inverse))
            if not self.maybe("/"):
                return steps

    def predicate(self) -> tuple[str, str]:
        if self.tokens[self.at] == ("word", "a"):
            self.at += 1
            return "iri", T.TYPE
        return self.term()

    def scan(self, s: tuple[str, str], steps: list, o: tuple[str, str]) -> DataFrame:
        at, rows = s, None
        for k, (p, mod, inverse) in enumerate(steps):
            to = o if k == len(steps) - 1 else ("var", self.hidden())
            a, b = (to, at) if inverse else (at, to)
            step = Rows(self.edge(a, p, mod, b))
            rows = self.join(rows, step)
            at = to
        rows = rows.df
        hidden = [c for c in rows.columns if c.startswith("_h")]
        return rows.drop(*hidden).distinct() if len(steps) > 1 else rows

    def repeated(self, t: DataFrame, s: tuple[str, str], o: tuple[str, str], zero: bool) -> DataFrame:
        """Pairs ``s, o`` a step or more apart (or none, with ``zero``): the search starts at a given end, and only where none is given are all pairs made."""
        e = t.where("o_kind <> 'literal'").select("s", "o")
        given = next((x[1] for x in (s, o) if x[0] == "iri"), None)
        if given is None:
            out = closure(e)
            nodes = t.select(F.col("s").alias("n")).unionByName(e.select(F.col("o").alias("n"))).distinct()
        else:
            nodes = self.graph.spark.createDataFrame([(given,)], "n string")  # its own end at no step, though no triple names it
            forward = s[0] == "iri"
            found = reach(e if forward else e.select(F.col("o").alias("s"), F.col("s").alias("o")), nodes.select(F.col("n").alias("s")))
            ends = (F.lit(given), F.col("uri")) if forward else (F.col("uri"), F.lit(given))
            out = found.select(ends[0].alias("s"), ends[1].alias("o"))
        return out.unionByName(nodes.select(F.col("n").alias("s"), F.col("n").alias("o"))).distinct() if zero else out

    def edge(self, s: tuple[str, str], ps: list[tuple[str, str]], mod: str, o: tuple[str, str]) -> DataFrame:
        if len(ps) > 1 and any(p[0] != "iri" for p in ps):
            raise ValueError("SPARQL: alternatives in a path are IRIs")
        p = ps[0]
        t = self.graph.triples([x[1] for x in ps] if p[0] == "iri" else None, self.ontology, self.layers)
        if mod:
            t = self.repeated(t, s, o, zero=mod == "*")
        out, names = [], {}
        for pos, term in (("s", s), ("p", p), ("o", o)):
            if pos == "p" and mod:
                continue
            if term[0] == "var":
                if term[1] in names:
                    t = t.where(F.col(pos) == F.col(names[term[1]]))
                else:
                    names[term[1]] = pos
                    out.append(F.col(pos).alias(term[1]))
            elif pos != "p":
                t = t.where(F.col(pos) == term[1])
                if pos == "o" and not mod:
                    t = t.where(F.col("o_kind") == "literal" if term[0] == "literal" else F.col("o_kind") != "literal")
        t = t.withColumn("lang", F.col("lang")) if "lang" in t.columns else t
        if o[0] == "var" and "lang" in t.columns and self.tokens and any(x[1].upper() == "LANG" for x in self.tokens if x[0] == "word"):
            out.append(F.coalesce("lang", F.lit("")).alias(f"_lang_{o[1]}"))
        return t.select(*out).distinct() if out else t.limit(1).select(F.lit(1).alias("_unit"))

    # --- expressions
    @staticmethod
    def number(e: Column) -> Column:
        return e.cast("string").try_cast("decimal(38,10)")

    def expression(self, folds: list[Column] | None) -> Column:
        left = self.conjunction(folds)
        while self.maybe("||"):
            left = left | self.conjunction(folds)
        return left

    def conjunction(self, folds) -> Column:
        left = self.relation(folds)
        while self.maybe("&&"):
            left = left & self.relation(folds)
        return left

    def relation(self, folds) -> Column:
        a = self.additive(folds)
        if self.peek() in ("=", "!=", "<", "<=", ">", ">="):
            op = self.take()
            b = self.additive(folds)
            x, y = self.number(a), self.number(b)
            both = x.isNotNull() & y.isNotNull()
            cmp = {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}[op]
            return F.when(both, cmp(x, y)).otherwise(cmp(a.cast("string"), b.cast("string")))
        negate = self.peek() == "NOT" and self.tokens[self.at + 1][1].upper() == "IN"
        self.at += negate
        if self.maybe("IN"):
            self.take("(")
            among = F.lit(False)
            while not self.maybe(")"):
                b = self.additive(folds)
                x, y = self.number(a), self.number(b)
                among = among | F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a.cast("string") == b.cast("string"))
                self.maybe(",")
            return ~among if negate else among
        return a

    def additive(self, folds) -> Column:
        left = self.unary(folds)
        while self.peek() in ("+", "-", "*", "/"):
            op = self.take()
            a, b = self.number(left), self.number(self.unary(folds))
            left = {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[op]
        return left

    def unary(self, folds) -> Column:
        if self.maybe("!"):
            return ~self.unary(folds)
        if self.maybe("("):
            e = self.expression(folds)
            self.take(")")
            return e
        word = self.peek()
        if self.tokens[self.at][0] == "word" and self.tokens[self.at + 1][1] == "(":
            self.at += 2
            if word in _AGGS:
                return self.fold(word, folds)
            if word == "LANG":
                v = self.variable()
                self.take(")")
                return F.col(f"_lang_{v}")
            if word == "BOUND":
                v = self.variable()
                self.take(")")
                return F.col(v).isNotNull()
            args = []
            while not self.maybe(")"):
                args.append(self.expression(folds))
                self.maybe(",")
            fs = {
                "STR": lambda x: x, "LCASE": F.lower, "UCASE": F.upper, "STRLEN": F.length, "CONTAINS": lambda x, y: x.contains(y), "STRSTARTS": lambda x, y: x.startswith(y),
                "STRENDS": lambda x, y: x.endswith(y), "REGEX": lambda x, y, f=None: F.regexp_like(x, F.concat(F.lit("(?i)"), y) if f is not None else y), "ABS": lambda x: F.abs(self.number(x)), "IF": lambda c, x, y: F.when(c, x).otherwise(y), "COALESCE": F.coalesce,
                "LANGMATCHES": lambda x, y: F.lower(x).startswith(F.lower(y)), "ISLITERAL": lambda x: ~x.rlike("^(_:|[a-z]+:)"), "ISIRI": lambda x: x.rlike("^[a-z]+:"),
            }
            if word not in fs:
                raise ValueError(f"SPARQL: unknown function {word}")
            return fs[word](*args)
        kind, value = self.term()
        return F.col(value) if kind == "var" else F.lit(value)

    def fold(self, word: str, folds: list[Column] | None) -> Column:
        if folds is None:
            raise ValueError(f"SPARQL: {word} has no place here")
        distinct = self.maybe("DISTINCT")
        e = F.lit(1) if self.maybe("*") else self.expression(None)
        self.take(")")
        x = e if word in ("COUNT", "SAMPLE") else self.number(e)
        f = {"COUNT": F.count_distinct if distinct else F.count, "SUM": F.sum_distinct if distinct else F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "SAMPLE": F.min}[word](x)
        name = f"_f{len(folds)}"
        folds.append(f.alias(name))
        return F.col(name)


def select(graph: Graph, text: str, ontology: str | None = None, layers: tuple[str, ...] = ("schema", "data")) -> DataFrame:
    """The result of a SELECT, or one row ``ask`` of an ASK."""
    return Query(graph, text, ontology, layers).run()
