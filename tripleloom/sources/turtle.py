"""Turtle and N-Triples, JSON-LD subset.  Turtle files are parsed one a task; N-Triples line by line in built-in functions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import terms as T

Row = tuple[str, str, str, str, str, str | None, str | None]

_TOKEN = re.compile(
    r"""(?P<skip>(?:\s+|\#[^\n]*)+)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*(?:\\u[0-9A-Fa-f]{4}[^<>"{}|^`\\\x00-\x20]*)*>)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<tag>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<blank>_:[\w][\w.-]*)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[^\W\d_][\w.-]*)?:(?:[\w:%-]|\\.|\.(?=[\w:%-]))*)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def unescape(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), s)


class Turtle:
    """One document.  Blank nodes get the document's own prefix, so files never share them."""

    def __init__(self, text: str, base: str = "", scope: str = "b"):
        self.tokens = self._lex(text)
        self.at, self.base, self.scope, self.fresh = 0, base, scope, 0
        self.prefixes: dict[str, str] = {}
        self.rows: list[Row] = []

    @staticmethod
    def _lex(text: str) -> list[tuple[str, str]]:
        out, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"Turtle: unexpected {text[at:at + 20]!r} in line {text.count(chr(10), 0, at) + 1}")
            if m.lastgroup != "skip":
                out.append((m.lastgroup, m[0]))
            at = m.end()
        return [*out, ("end", "")]

    def _next(self, want: str | None = None) -> tuple[str, str]:
        kind, s = self.tokens[self.at]
        if want is not None and s != want:
            raise ValueError(f"Turtle: expected {want!r}, got {s!r}")
        self.at += 1
        return kind, s

    def _peek(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def _blank(self) -> tuple[str, str]:
        self.fresh += 1
        return f"_:{self.scope}.{self.fresh}", "bnode"

    def parse(self) -> list[Row]:
        while self._peek()[0] != "end":
            kind, s = self._peek()
            word = s.lower().lstrip("@")
            if kind in ("tag", "word") and word in ("prefix", "base"):
                self._next()
                if word == "prefix":
                    name = self._next()[1][:-1]
                    self.prefixes[name] = self._iri(self._next()[1])
                else:
                    self.base = self._iri(self._next()[1])
                if s.startswith("@"):
                    self._next(".")
                continue
            if s == "[":
                subject = self._node()
                if self._peek()[1] != ".":
                    self._predicates(subject)
            else:
                subject = self._node()
                self._predicates(subject)
            self._next(".")
        return self.rows

    def _iri(self, s: str) -> str:
        s = unescape(s[1:-1])
        return urljoin(self.base, s) if self.base and not re.match(r"[A-Za-z][\w+.-]*:", s) else s

    def _name(self, s: str) -> str:
        prefix, _, local = s.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"Turtle: unknown prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def _predicates(self, subject: tuple[str, str]) -> None:
        while True:
            kind, s = self._next()
            p = T.TYPE if (kind, s) == ("word", "a") else self._iri(s) if kind == "iri" else self._name(s) if kind == "name" else None
            if p is None:
                raise ValueError(f"Turtle: {s!r} is no predicate")
            while True:
                self._emit(subject, p, self._object())
                if self._peek()[1] != ",":
                    break
                self._next()
            if self._peek()[1] != ";":
                return
            while self._peek()[1] == ";":
                self._next()
            if self._peek()[1] in (".", "]"):
                return

    def _emit(self, s: tuple[str, str], p: str, o: tuple) -> None:
        self.rows.append((s[0], s[1], p, o[0], o[1], *(o[2:] if len(o) > 2 else (None, None))))

    def _node(self) -> tuple[str, str]:
        kind, s = self._next()
        if kind == "iri":
            return self._iri(s), "iri"
        if kind == "name":
            return self._name(s), "iri"
        if kind == "blank":
            return f"_:{self.scope}.n{s[2:]}", "bnode"
        if s == "[":
            node = self._blank()
            if self._peek()[1] != "]":
                self._predicates(node)
            self._next("]")
            return node
        if s == "(":
            items = []
            while self._peek()[1] != ")":
                items.append(self._object())
            self._next()
            tail: tuple = (T.RDF + "nil", "iri")
            for o in reversed(items):
                cell = self._blank()
                self._emit(cell, T.RDF + "first", o)
                self._emit(cell, T.RDF + "rest", tail)
                tail = cell
            return tail
        raise ValueError(f"Turtle: {s!r} is no node")

    def _object(self) -> tuple:
        kind, s = self._peek()
        if kind in ("text", "long"):
            self._next()
            value = unescape(s[3:-3] if kind == "long" else s[1:-1])
            kind, t = self._peek()
            if kind == "tag":
                self._next()
                return value, "literal", T.RDF + "langString", t[1:]
            if kind == "type":
                self._next()
                kind, t = self._next()
                return value, "literal", self._iri(t) if kind == "iri" else self._name(t), None
            return value, "literal", T.XSD + "string", None
        if kind == "number":
            self._next()
            dt = "double" if "e" in s.lower() else "decimal" if "." in s else "integer"
            return s, "literal", T.XSD + dt, None
        if kind == "word" and s in ("true", "false"):
            self._next()
            return s, "literal", T.XSD + "boolean", None
        return self._node()


def jsonld(text: str, scope: str = "b") -> tuple[list[Row], dict[str, str]]:
    """A subset of JSON-LD: an inline ``@context`` of prefixes and terms, ``@id``, ``@type``, ``@value``, ``@graph``, nesting."""
    data = json.loads(text)
    context: dict = {}
    rows: list[Row] = []
    count = 0

    def name(x: str) -> str:
        c = context.get(x)
        c = c.get("@id") if isinstance(c, dict) else c
        if c:
            return name(c) if c != x and ":" in c and not c.startswith(("http", "urn")) else c
        p, sep, local = x.partition(":")
        return context[p] + local if sep and isinstance(context.get(p), str) and not local.startswith("//") else x if sep else context.get("@vocab", "") + x

    def node(d: dict) -> tuple[str, str]:
        nonlocal count
        i = d.get("@id")
        if i is None or i.startswith("_:"):
            count += 1
            me = (f"_:{scope}.{'n' + i[2:] if i else count}", "bnode")
        else:
            me = (name(i) if not i.startswith("http") else i, "iri")
        for t in d.get("@type", []) if isinstance(d.get("@type", []), list) else [d["@type"]]:
            rows.append((*me, T.TYPE, name(t), "iri", None, None))
        for k, values in d.items():
            if k.startswith("@"):
                continue
            for v in values if isinstance(values, list) else [values]:
                kind = context.get(k, {}).get("@type") if isinstance(context.get(k), dict) else None
                if isinstance(v, dict) and "@value" in v:
                    lang = v.get("@language")
                    rows.append((*me, name(k), str(v["@value"]), "literal", T.RDF + "langString" if lang else name(v.get("@type", T.XSD + "string")), lang))
                elif isinstance(v, dict):
                    rows.append((*me, name(k), *node(v), None, None))
                elif isinstance(v, bool):
                    rows.append((*me, name(k), str(v).lower(), "literal", T.XSD + "boolean", None))
                elif isinstance(v, int):
                    rows.append((*me, name(k), str(v), "literal", T.XSD + "integer", None))
                elif isinstance(v, float):
                    rows.append((*me, name(k), repr(v), "literal", T.XSD + "double", None))
                elif kind == "@id":
                    rows.append((*me, name(k), name(v), "iri", None, None))
                elif v is not None:
                    rows.append((*me, name(k), v, "literal", name(kind) if kind else T.XSD + "string", None))
        return me

    for doc in data if isinstance(data, list) else [data]:
        context |= doc.get("@context", {}) if isinstance(doc.get("@context", {}), dict) else {}
        for d in doc.get("@graph", [doc]):
            node(d)
    return rows, {k: v for k, v in context.items() if isinstance(v, str) and not k.startswith("@")}


def rdfxml(text: str, scope: str = "b") -> tuple[list[Row], dict[str, str]]:
    """The common form of RDF/XML: node elements with property elements, attributes for ids, types and languages."""
    from xml.etree import ElementTree

    rows: list[Row] = []
    count = 0
    r, xml = f"{{{T.RDF}}}", "{http://www.w3.org/XML/1998/namespace}"
    full = lambda tag: tag[1:].replace("}", "", 1)

    def node(e) -> tuple[str, str]:
        nonlocal count
        if (about := e.get(r + "about")) is not None:
            me = (about, "iri")
        else:
            count += 1
            me = (f"_:{scope}.{e.get(r + 'nodeID') or count}", "bnode")
        if e.tag != r + "Description":
            rows.append((*me, T.TYPE, full(e.tag), "iri", None, None))
        for k, v in e.attrib.items():
            if not k.startswith((r, xml)) and k.startswith("{"):
                rows.append((*me, full(k), v, "literal", T.XSD + "string", None))
        for p in e:
            if (to := p.get(r + "resource")) is not None:
                rows.append((*me, full(p.tag), to, "iri", None, None))
            elif len(p):
                for child in p:
                    rows.append((*me, full(p.tag), *node(child), None, None))
            else:
                lang = p.get(xml + "lang")
                rows.append((*me, full(p.tag), p.text or "", "literal", T.RDF + "langString" if lang else p.get(r + "datatype", T.XSD + "string"), lang))
        return me

    for e in ElementTree.fromstring(text):
        node(e)
    return rows, {}


def parse(text: str, suffix: str, scope: str) -> tuple[list[Row], dict[str, str]]:
    """Rows ``s, s_kind, p, o, o_kind, dt, lang`` and the document's prefixes."""
    if suffix in (".ttl", ".n3", ".nt"):
        t = Turtle(text, scope=scope)
        return t.parse(), t.prefixes
    if suffix in (".jsonld", ".json"):
        return jsonld(text, scope)
    if suffix in (".rdf", ".owl", ".xml"):
        return rdfxml(text, scope)
    raise ValueError(f"unknown format {suffix!r}")


SUFFIXES = (".ttl", ".jsonld", ".rdf", ".owl", ".n3", ".nt")
ROWS = "s string, s_kind string, p string, o string, o_kind string, dt string, lang string"


DOCUMENTS = f"path string, what string, {ROWS}"


def documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """What files hold, by any path that Spark reads; a file is one document, parsed in a task.

    ``what``: a ``triple``; a ``prefix`` (in s, its name in o); a ``file`` that was parsed; or an ``error``, its message in o,
    in place of all of these."""

    def run(batches) -> Iterator:
        import hashlib

        import pandas as pd

        names = [c.split()[0] for c in DOCUMENTS.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                blank = [None] * 4
                try:
                    rows, prefixes = parse(bytes(content).decode("utf-8"), "." + path.rsplit(".", 1)[-1].lower(), hashlib.md5(path.encode()).hexdigest()[:8])
                    out = [(path, "file", *[None] * 7), *((path, "prefix", k, None, None, v, *blank[:3]) for k, v in prefixes.items()), *((path, "triple", *r) for r in rows)]
                except Exception as e:  # reported with its file; the others go on
                    out = [(path, "error", None, None, None, str(e) or type(e).__name__, *blank[:3])]
                yield pd.DataFrame(out, columns=names)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, DOCUMENTS)


def triples_of(docs: DataFrame) -> DataFrame:
    """The triples of ``documents``, equal ones as one."""
    return docs.where("what = 'triple'").select(*[c.split()[0] for c in ROWS.split(", ")]).distinct()


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Triples of files; a file that cannot be parsed fails the read."""
    sound = F.when(F.col("what") == "error", F.raise_error(F.concat_ws(": ", "path", "o"))).otherwise(F.col("what"))
    return triples_of(documents(spark, paths).withColumn("what", sound))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples of any size, split by lines, in built-in functions."""
    line = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    m = lambda k: F.regexp_extract("value", r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([\w-]+)|\^\^<([^>]*)>)?)\s*\.\s*$', k)
    g = line.select(*[m(k).alias(f"g{k}") for k in range(1, 8)], F.col("value").rlike(r'(?:"|@[\w-]+|\^\^<[^>]*>)\s*\.\s*$').alias("is_lit"))
    # escapes: the backslash itself is parked on a private character meanwhile
    text = F.regexp_replace("g5", r"\\\\", "\ue000")
    for a, b in ((r"\\n", "\n"), (r"\\t", "\t"), (r"\\r", "\r"), (r'\\"', '"')):
        text = F.regexp_replace(text, a, b)
    text = F.replace(text, F.lit("\ue000"), F.lit("\\"))
    blank = F.col("g1").startswith("_:")
    return g.select(
        F.when(blank, F.col("g1")).otherwise(F.expr("substring(g1, 2, length(g1) - 2)")).alias("s"), F.when(blank, "bnode").otherwise("iri").alias("s_kind"), F.col("g2").alias("p"),
        F.when(F.col("is_lit"), text).when(F.col("g4") != "", F.col("g4")).otherwise(F.col("g3")).alias("o"),
        F.when(F.col("is_lit"), "literal").when(F.col("g4") != "", "bnode").otherwise("iri").alias("o_kind"),
        F.when(F.col("is_lit"), F.when(F.col("g6") != "", T.RDF + "langString").when(F.col("g7") != "", F.col("g7")).otherwise(T.XSD + "string")).alias("dt"),
        F.when(F.col("g6") != "", F.col("g6")).alias("lang"),
    ).distinct()


def marks_schema() -> Column:
    """Whether a triple defines vocabulary rather than data."""
    types = [*T.CLASSES, *T.PROPERTIES, T.OWL + "Ontology"]
    marks = [T.SUBCLASS, T.RDFS + "subPropertyOf", T.DOMAIN, T.RANGE, T.OWL + "equivalentClass", T.OWL + "disjointWith"]
    return (F.col("p") == T.TYPE) & F.col("o").isin(*types) | F.col("p").isin(*marks)


def is_schema_frame(triples: DataFrame) -> bool:
    return not triples.where(marks_schema()).isEmpty()
