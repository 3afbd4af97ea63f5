"""Rows to triples by a column mapping; entity normalising; memory lifecycle; access; routing."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..plans import terms as T
from .graph import COLUMNS, Graph


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV (blank rows skipped), JSON (an object or a list) or JSON lines; nested objects become dotted columns."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        df = spark.read.option("header", True).csv(path)
        return df.where(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in df.columns]).isNotNull())
    df = spark.read.option("multiLine", kind == "json").json(path)
    return flatten(df)


def flatten(df: DataFrame) -> DataFrame:
    def leaves(t: ST.StructType, path: tuple[str, ...] = ()):
        for f in t:
            if isinstance(f.dataType, ST.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return df.select(*[F.col(".".join(f"`{x}`" for x in p)).alias(".".join(p)) for p in leaves(df.schema)])


@dataclass
class Mapping:
    """``columns``: column to (predicate, confidence)."""

    namespace: str
    columns: dict[str, tuple[str, float]]
    class_uri: str | None = None
    id_column: str | None = None
    least: float = 0.5


def uuid5(name: Column, space: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """A version-5 UUID by built-in functions."""
    h = F.sha1(F.concat(F.unhex(F.lit(space.hex)), name.cast("binary")))
    var = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(var, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def populate(rows: DataFrame, m: Mapping) -> DataFrame:
    """Triples of the mapped columns; null and blank cells and columns under the confidence are left out; rows get their type."""
    base = m.namespace.rstrip("/") + "/"
    if m.id_column:
        key = F.nullif(F.trim(F.col(f"`{m.id_column}`").cast("string")), F.lit(""))
        s = F.concat(F.lit(base), F.replace(F.url_encode(key), F.lit("+"), F.lit("%20")))
    else:
        s = F.concat(F.lit(base), uuid5(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns]))))
    cells = [F.struct(F.lit(p).alias("p"), F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias("o"), F.lit("literal").alias("o_kind"), F.lit(T.XSD + "string").alias("dt")) for c, (p, conf) in m.columns.items() if conf >= m.least]
    if m.class_uri:
        cells.append(F.struct(F.lit(T.TYPE).alias("p"), F.lit(m.class_uri).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("dt")))
    t = rows.select(s.alias("s"), F.explode(F.array(*cells)).alias("c")).where("s is not null and c.o is not null")
    return t.select(F.lit(None).cast("string").alias("ontology"), F.lit("data").alias("layer"), "s", F.lit("iri").alias("s_kind"), "c.p", "c.o", "c.o_kind", "c.dt", F.lit(None).cast("string").alias("lang")).select(*COLUMNS).distinct()


def normalise(names: DataFrame, aliases: DataFrame, namespace: str) -> DataFrame:
    """``name, uri``: by exact alias, else by alias without case, else a slug under the namespace.  ``aliases(alias, uri)`` is a registry."""
    exact = aliases.groupBy(F.col("alias").alias("name")).agg(F.min("uri").alias("u1"))
    lower = aliases.groupBy(F.lower("alias").alias("low")).agg(F.min("uri").alias("u2"))
    slug = mint(F.col("name"), namespace)
    d = names.select("name").distinct().withColumn("low", F.lower("name"))
    return d.join(exact, "name", "left").join(lower, "low", "left").select("name", F.coalesce("u1", "u2", slug).alias("uri"))


def prune(assertions: DataFrame, now: str, months: int, time_col: str = "asserted_at") -> DataFrame:
    """Assertions younger than ``months`` of 30 days; those without a readable time stay."""
    edge = F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {30 * months} DAYS")
    return assertions.where(F.coalesce(F.col(time_col).cast("timestamp") >= edge, F.lit(True)))


def forget(triples: DataFrame, entity: str) -> DataFrame:
    """Triples without those that have the entity as subject or object."""
    return triples.where((F.col("s") != entity) & (F.col("o") != entity))


def memory_stats(assertions: DataFrame, time_col: str = "asserted_at") -> DataFrame:
    return assertions.agg(F.count("*").alias("n"), F.count_distinct("s").alias("entities"), F.min(time_col).alias("first"), F.max(time_col).alias("last"))


@dataclass
class Policy:
    """``id:perm`` rules with ``r``, ``w``, ``rw`` or ``none``; ``default`` stands for the default graph; open without rules."""

    rules: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Policy:
        rules = {}
        for rule in filter(None, (x.strip() for x in text.split(","))):
            name, sep, perm = rule.partition(":")
            if not sep or perm not in ("r", "w", "rw", "none"):
                raise ValueError(f"not a rule: {rule!r}")
            rules[name if name == "default" else T.ontology_id(name)] = perm
        return cls(rules)

    def may(self, ontology: str | None, what: str) -> bool:
        return not self.rules or what in self.rules.get(ontology or "default", "none").replace("none", "")

    def guard(self, ontology: str | None, what: str) -> None:
        if not self.may(ontology, what):
            raise PermissionError(f"{what} on {ontology or 'default'} is not allowed")

    def view(self, graph: Graph) -> Graph:
        """The graph with unreadable ontologies out of every read, the union's too."""
        if not self.rules:
            return graph
        seen = frozenset(None if k == "default" else k for k, v in self.rules.items() if "r" in v)
        return Graph(graph.spark, graph.parts, graph.prefixes, seen)


# Patterns that tell a question of several hops, and one that asks for probability, cause or a counterfactual.
HOPS = (
    r"\band\b", r"first .{1,30} then", r"compared? (?:to|with)", r"top \d+", r"chain", r"path", r"vs\.?",
    r"그리고", r"먼저 .{1,30} 다음", r"이후", r"비교", r"대비", r"상위 \d+", r"경로",
    r"타입별|유형별|종류별|지역별|클래스별", r"각각", r"\d+\s*(?:이상|이하|초과|미만)", r"(?:과|와)\s*같은",
    r"가장\s*(?:많은|적은|흔한|큰|작은|높은|낮은|긴|짧은|빠른|느린|강한|약한)", r"모두\s*(?:알려|보여|찾|나열)",
    r"한\s*\S{1,3}\s*라도|하나라도", r"역방향|반대로|반대\s*방향", r"포함", r"(?:이고|이며)[\s,]+그\s*\S", r"출신",
)
REASONING = (
    r"if .{1,40} (?:then|would)", r"만약", r"\b다면", r"probability", r"확률", r"가능성", r"cause(?:d|s)?", r"\b원인", r"because", r"때문",
    r"intervene", r"개입", r"counterfactual", r"반사실", r"posterior", r"prior probability", r"do\(",
)
#: Class names under this length match too much by chance.
NAME_CHARS = 3


def route(question: Column, class_names: list[str]) -> Column:
    """``multi``, ``single`` or ``simple``: reasoning patterns, then two classes or a hop pattern, then one class."""
    says = lambda patterns: question.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))
    n = F.lit(0)
    for c in dict.fromkeys(c.lower() for c in class_names if len(c) >= NAME_CHARS):
        n = n + F.lower(question).contains(c).cast("int")
    return F.when(says(REASONING), "multi").when((n >= 2) | says(HOPS), "multi").when(n == 1, "single").otherwise("simple")


def coverage(named: Column, asked: Column) -> Column:
    """Relevance: the share of the asked classes that the evidence names; 1 if none was asked for."""
    return F.when(F.size(asked) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_distinct(asked), named)) / F.size(F.array_distinct(asked)))


def usage(answer: Column, evidence: Column, enough: int = 5) -> Column:
    """Use: how many of the evidence's names (3 characters and more) the answer cites, ``enough`` at most asked for; 0.5 without any."""
    names = F.array_distinct(F.filter(evidence, lambda x: F.length(x) >= NAME_CHARS))
    cited = F.size(F.filter(names, lambda x: F.lower(answer).contains(F.lower(x))))
    return F.when(F.size(names) == 0, 0.5).otherwise(F.least(F.lit(1.0), cited / F.least(F.lit(enough), F.size(names))))


def judge(relevance: Column, use: Column, support: Column | None = None, high: float = 0.7, low: float = 0.3) -> Column:
    """``sufficient`` if every axis that is there reaches ``high``, ``insufficient`` if any is under ``low``, else ``ambiguous``."""
    axes = [relevance, use, *([support] if support is not None else [])]
    best = F.lit(True)
    weak = F.lit(False)
    for a in axes:
        best = best & F.coalesce(a >= high, F.lit(True))
        weak = weak | F.coalesce(a < low, F.lit(False))
    return F.when(best, "sufficient").when(weak, "insufficient").otherwise("ambiguous")


def mint(name: Column, namespace: str) -> Column:
    """A resource's IRI from its name: the namespace and a slug."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return F.concat(F.lit(namespace), slug)


FOUND = "name string, class_uri string, predicate string, object string, object_is_entity boolean, confidence double"


def gazetteer(lexicon: dict[str, str]):
    """An extractor that needs no model: names of a lexicon (name to class) found in the texts as whole words."""
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(n) for n in sorted(lexicon, key=len, reverse=True)) + r")(?!\w)")

    def extract(batches):
        import pandas as pd

        for b in batches:
            found = [(n, lexicon[n], None, None, None, 1.0) for t in b["text"] for n in (sorted(set(pattern.findall(t))) if t else ())]
            yield pd.DataFrame(found, columns=[c.split()[0] for c in FOUND.split(", ")])

    return extract


def populate_text(texts: DataFrame, extract, classes: list[str], predicates: list[str], namespace: str, least: float = 0.5) -> DataFrame:
    """Triples of what ``extract`` finds in ``texts(text)``.

    ``extract`` maps batches of texts to rows of ``FOUND`` (a model or a rule, run on the executors).  Findings under the confidence,
    of unknown classes or with unknown predicates are dropped; names become IRIs of the namespace."""
    f = texts.select("text").mapInPandas(extract, FOUND).where((F.col("confidence") >= least) & (F.trim("name") != ""))
    s = mint(F.col("name"), namespace)
    known = F.col("class_uri").isin(*classes) if classes else F.lit(False)
    row = lambda p, o, kind, dt: F.struct(p.alias("p"), o.alias("o"), kind.alias("o_kind"), dt.alias("dt"))
    none = F.lit(None).cast("string")
    string = F.lit(T.XSD + "string")
    cells = [
        F.when(known, row(F.lit(T.TYPE), F.col("class_uri"), F.lit("iri"), none)), F.when(known, row(F.lit(T.LABEL), F.trim("name"), F.lit("literal"), string)),
        F.when(F.col("predicate").isin(*predicates) if predicates else F.lit(False), row(F.col("predicate"), F.when(F.col("object_is_entity"), mint(F.col("object"), namespace)).otherwise(F.col("object")), F.when(F.col("object_is_entity"), "iri").otherwise("literal"), F.when(~F.coalesce("object_is_entity", F.lit(False)), string))),
    ]
    t = f.select(s.alias("s"), F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).where("c.o is not null")
    return t.select(F.lit(None).cast("string").alias("ontology"), F.lit("data").alias("layer"), "s", F.lit("iri").alias("s_kind"), "c.p", "c.o", "c.o_kind", "c.dt", none.alias("lang")).select(*COLUMNS).distinct()


def mentions(text: str, names: list[str]) -> list[str]:
    return [n for n in names if re.search(re.escape(n), text, re.I)]
