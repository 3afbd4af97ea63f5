"""A stored graph: batches of triples as Parquet by (ontology, layer), with load, clear, dump and single writes.

A commit of the log lists the batches that count.  Every write is a new batch, of triples or of deletions, and one commit, so it costs what
it writes, and readers see one commit's state.  Additions and deletions of several writers all count, in the order of their commits; a replacing write
of one that others have changed meanwhile is refused.  `compact` makes one batch of many, `vacuum` deletes what no commit needs."""

from __future__ import annotations

import fnmatch
import uuid
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import COLUMNS, LAYERS, SCHEMA, Graph, Part
from ..plans import terms as T
from ..plans.materialise import materialise
from . import turtle
from .commits import Conflict, Log

DEFAULT = "__default__"
#: Deleted triples that are broadcast to a read at most; beyond it the read's join is shuffled.
BROADCAST_DELETIONS = 500_000


def _files(spark: SparkSession, root: str, recursive: bool) -> list[tuple[str, str]]:
    """Paths of the files under a folder of any file system, whole and relative to it; names only, nothing is read; none if it is not there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    base = fs.makeQualified(folder).toString().rstrip("/") + "/"
    found, out = fs.listFiles(folder, recursive), []
    while found.hasNext():
        path = found.next().getPath().toString()
        out.append((path, path[len(base) :]))
    return sorted(out)


@dataclass
class Outcome:
    path: str
    ontology: str | None
    mode: str
    triples: int = 0
    error: str | None = None


@dataclass
class Store:
    """``None`` as an ontology means the union for reads and the default graph for writes."""

    spark: SparkSession
    path: str
    prefixes: dict[str, str] = field(default_factory=dict)

    @property
    def log(self) -> Log:
        return Log(self.spark, f"{self.path}/_log")

    def _scope(self, ontology: str | None) -> str:
        return T.ontology_id(ontology) or DEFAULT

    def _batches(self, at: int | None = None) -> list[dict]:
        """The live batches of a commit, oldest first: ``path, scope, kind`` (add or del) and ``n``, the triples written."""
        return self.log.read(at)[1].get("batches", [])

    def _read(self, batches: list[dict]) -> DataFrame:
        """The triples that the batches state, each batch read from its own folder; batches may repeat each other's."""
        order = {b["path"]: i for i, b in enumerate(batches)}
        adds, dels = ([b for b in batches if b["kind"] == kind] for kind in ("add", "del"))
        if not adds:
            return self.spark.createDataFrame([], SCHEMA)

        def of(some: list[dict]) -> DataFrame:
            schema = f"{SCHEMA}, batch string"
            t = self.spark.read.schema(schema).option("basePath", self.path).parquet(*(f"{self.path}/{b['path']}" for b in some))
            return t.withColumn("ontology", F.when(F.col("ontology") != DEFAULT, F.col("ontology")))

        # a deletion concerns what was there before it
        last = {b["scope"]: order[b["path"]] for b in dels}
        open_to = [b for b in adds if last.get(b["scope"], -1) > order[b["path"]]]
        rest = [b for b in adds if b not in open_to]
        out = of(rest).select(*COLUMNS) if rest else None
        if open_to:
            when = self.spark.createDataFrame([(b["path"].rsplit("batch=", 1)[1], order[b["path"]]) for b in batches], "batch string, seq int")  # a row a batch
            dated = lambda some: of(some).join(F.broadcast(when), "batch")
            key = [F.coalesce(c, F.lit("\0")).alias(f"k_{c}") for c in COLUMNS]
            gone = dated(dels).select(F.col("seq").alias("gone_at"), *key)
            gone = F.broadcast(gone) if sum(b["n"] for b in dels) <= BROADCAST_DELETIONS else gone
            old = dated(open_to).select("seq", *COLUMNS, *key)
            same = (F.col("seq") < F.col("gone_at")) & reduce(and_, (old[f"k_{c}"] == gone[f"k_{c}"] for c in COLUMNS))
            old = old.join(gone, same, "left_anti").select(*COLUMNS)
            out = old if out is None else out.unionByName(old)
        return out

    def rows(self, at: int | None = None) -> DataFrame:
        """All triples, each once for an ontology, as of a commit (the last one by default)."""
        return self._read(self._batches(at)).distinct()

    def graph(self, at: int | None = None) -> Graph:
        """The graph as of a commit; a part of it reads the folders of its own layer only."""
        batches = self._batches(at)
        parts = [Part(self._read([b for b in batches if b["scope"].endswith(f"/layer={layer}")]), None, layer) for layer in ("schema", "data")]
        # batches of one scope may repeat each other's triples
        return Graph(self.spark, parts, dict(self.prefixes), overlap=len({b["scope"] for b in batches}) < len(batches))

    def _write(self, rows: DataFrame, kind: str, ontology: str | None, layer: str) -> dict:
        """A new folder that no commit lists yet, ordered by subject, so that a filter on one reads few row groups."""
        scope = f"ontology={self._scope(ontology)}/layer={layer}"
        path = f"{scope}/batch={uuid.uuid4().hex}"
        columns = [c for c in COLUMNS if c not in ("ontology", "layer")]
        # one exchange for both: equal triples are in one range
        rows.select(*columns).repartitionByRange("s", "p", "o").distinct().sortWithinPartitions("s", "p", "o").write.parquet(f"{self.path}/{path}")
        n = self.spark.read.schema(", ".join(f"{c} string" for c in columns)).parquet(f"{self.path}/{path}").count()
        return {"path": path, "scope": scope, "kind": kind, "n": n}

    def _commit(self, change) -> int:
        """Commit ``change(batches)``, again on the newer state if another writer was first."""
        for _ in range(100):
            number, state = self.log.read()
            try:
                return self.log.commit(number, {"batches": change(state.get("batches", []))})
            except Conflict:
                continue
        raise Conflict(f"{self.path}: too many writers")

    def _replace(self, was: list[dict], scope: str, new: list[dict]) -> None:
        """Put ``new`` in the place of a scope's batches; `Conflict` if these are others than ``was``."""

        def change(now: list[dict]) -> list[dict]:
            if [b for b in now if b["scope"] == scope] != was:
                raise ValueError(f"{scope}: written meanwhile")
            return [b for b in now if b["scope"] != scope] + new

        try:
            self._commit(change)
        except ValueError as e:
            raise Conflict(str(e)) from e

    def _own(self, ontology: str | None, layer: str) -> tuple[str, list[dict]]:
        scope = f"ontology={self._scope(ontology)}/layer={layer}"
        return scope, [b for b in self._batches() if b["scope"] == scope]

    def _put(self, rows: DataFrame, ontology: str | None, layer: str) -> None:
        """Replace one (ontology, layer) by one commit: readers see the old triples or the new ones, never both."""
        scope, was = self._own(ontology, layer)
        batch = self._write(rows, "add", ontology, layer)
        self._replace(was, scope, [batch] if batch["n"] else [])

    def _append(self, rows: DataFrame, ontology: str | None, layer: str, kind: str = "add") -> None:
        """One more batch; nothing that is there is read."""
        batch = self._write(rows, kind, ontology, layer)
        if batch["n"]:
            self._commit(lambda now: [*now, batch])

    def _get(self, ontology: str | None, layer: str) -> DataFrame:
        return self._read(self._own(ontology, layer)[1]).distinct()

    def compact(self, ontology: str | None = None, layer: str = "data") -> None:
        """One (ontology, layer) as one batch without deletions; `Conflict` if it is written meanwhile."""
        scope, was = self._own(ontology, layer)
        if len(was) > 1:
            batch = self._write(self._read(was), "add", ontology, layer)
            self._replace(was, scope, [batch] if batch["n"] else [])

    def vacuum(self) -> int:
        """Delete batches that only earlier commits list; their readers fail afterwards.  Returns how many."""
        live = {b["path"] for b in self._batches()}
        old = {b["path"] for n in self.log.numbers()[:-1] for b in self._batches(n)} - live
        self.log.delete(*(f"{self.path}/{path}" for path in sorted(old)))
        return len(old)

    def load(self, triples: DataFrame, mode: str | None = None, replace: bool = False, ontology: str | None = None) -> int:
        """Schema replaces its layer, data adds (or replaces); equal triples are one.  Returns the triples given."""
        t = materialise(triples.distinct())
        layer = LAYERS[mode] if mode else "schema" if turtle.is_schema_frame(t) else "data"
        if replace or layer == "schema":
            self._put(t, ontology, layer)
        else:
            self._append(t, ontology, layer)
        return t.count()

    def load_rdf(self, path: str, mode: str | None = None, replace: bool = False, ontology: str | None = None) -> int:
        suffix = "." + path.rsplit(".", 1)[-1].lower()
        t = turtle.read_ntriples(self.spark, path) if suffix == ".nt" else turtle.read_files(self.spark, [path])
        if suffix == ".ttl":
            head = self.spark.read.text(path).where(F.col("value").rlike(r"(?i)^\s*@?prefix\s"))
            for r in head.collect():  # the file's prefix lines
                p = turtle._TOKEN.findall(r["value"])
                found = [x for x in p if x[8] or x[1]]
                if len(found) >= 2:
                    self.prefixes[found[0][8][:-1]] = found[1][1][1:-1]
        return self.load(t, mode, replace, ontology)

    def _object(self, o: str, object_is_uri: bool) -> tuple[str, str, str | None]:
        """Object, kind and datatype: a checked IRI or a plain string."""
        return (T.iri(o, self.prefixes), "iri", None) if object_is_uri else (o, "literal", T.XSD + "string")

    def assert_triples(self, triples: list[tuple], ontology: str | None = None) -> int:
        """Add data triples ``(s, p, o)`` or ``(s, p, o, object_is_uri)``; without the flag the object is a plain string.

        They are written as one more batch; one that is there already is still one to readers.  Returns the triples given."""
        rows = []
        for s, p, o, *flag in triples:
            o, kind, dt = self._object(o, bool(flag and flag[0]))
            rows.append((T.iri(s, self.prefixes), "iri", T.iri(p, self.prefixes), o, kind, dt, None))
        if rows:
            self._append(self.spark.createDataFrame(rows, turtle.ROWS).distinct(), ontology, "data")
        return len(rows)

    def retract_triple(self, s: str, p: str, o: str, object_is_uri: bool = False, ontology: str | None = None) -> int:
        """Remove a data triple, the resource or the literal as the flag says; 0 if it is not there.

        A deletion is a batch of the triples that go, and a read leaves them out; `compact` applies it to the files."""
        o, kind, _ = self._object(o, object_is_uri)
        hit = (F.col("s") == T.iri(s, self.prefixes)) & (F.col("p") == T.iri(p, self.prefixes)) & (F.col("o") == o) & (F.col("o_kind") == kind)
        # filters on the subject reach the scan, which skips the row groups of others
        gone = materialise(self._read(self._own(ontology, "data")[1]).where(hit).distinct())
        n = gone.count()
        if n:
            self._append(gone, ontology, "data", "del")
        return n

    def retract(self, triples: DataFrame, ontology: str | None = None) -> None:
        """Remove every given data triple that is there, all by one commit; nothing of the layer is read or rewritten."""
        self._append(triples, ontology, "data", "del")

    def clear(self, target: str = "all", ontology: str | None = None) -> dict[str, int]:
        out = {}
        for layer in ("schema", "data") if target == "all" else (LAYERS[target],):
            own = self._get(ontology, layer)
            out[layer] = own.count()
            scope, was = self._own(ontology, layer)
            if was:
                self._replace(was, scope, [])
        return out

    def dump(self, path: str, target: str = "data", fmt: str = "jsonl", ontology: str | None = None) -> None:
        """``jsonl``: objects of s, p, o; ``json``: one array of them a file; ``ttl``: N-Triples lines, which are Turtle; ``csv``: one sheet a graph."""
        t = self._get(ontology, LAYERS[target])
        if fmt == "json":
            # a file a task: its rows fold into one array
            array = lambda batches: (pd.DataFrame({"value": ["[" + ",\n".join(v for b in batches for v in b["value"]) + "]"]}) for _ in (0,))
            t.select(F.to_json(F.struct("s", "p", "o")).alias("value")).mapInPandas(array, "value string").write.mode("overwrite").text(path)
        elif fmt == "jsonl":
            t.select(F.to_json(F.struct("s", "p", "o")).alias("value")).write.mode("overwrite").text(path)
        elif fmt == "csv":
            t.select("s", "p", "o").write.mode("overwrite").option("header", True).csv(path)
        elif fmt == "ttl":
            ref = lambda c, k: F.when(F.col(k) == "bnode", F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
            text = F.col("o")
            for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
                text = F.replace(text, F.lit(a), F.lit(b))
            tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang"))).when(F.col("dt").isNotNull() & (F.col("dt") != T.XSD + "string"), F.concat(F.lit("^^<"), F.col("dt"), F.lit(">"))).otherwise("")
            lit = F.concat(F.lit('"'), text, F.lit('"'), tail)
            t.select(F.concat_ws(" ", ref("s", "s_kind"), F.concat(F.lit("<"), F.col("p"), F.lit(">")), F.when(F.col("o_kind") == "literal", lit).otherwise(ref("o", "o_kind")), F.lit(".")).alias("value")).write.mode("overwrite").text(path)
        else:
            raise ValueError(f"unknown format {fmt!r}")

    def load_directory(self, root: str, ontology: str | None = None, replace: bool = False, recursive: bool = True, ignore: tuple[str, ...] = (), on_file=None) -> list[Outcome]:
        """Load the files under ``root``: a sub-folder's name is its ontology id, schema before data in each scope.

        A failed file is reported and the rest goes on; after a failed schema the scope's data is left out."""
        plan = []
        for path, rel in _files(self.spark, root, recursive):
            parts = rel.split("/")
            if not path.lower().endswith(turtle.SUFFIXES) or any(x.startswith(".") for x in parts):
                continue
            if not any(fnmatch.fnmatch(rel, g) or any(fnmatch.fnmatch(x, g) for x in parts) for g in ignore):
                plan.append((ontology or (parts[0] if len(parts) > 1 else None), None, path))
        return self._run(plan, replace, on_file)

    def _run(self, plan: list[tuple[str | None, str | None, str]], replace: bool, on_file) -> list[Outcome]:
        """Load files ``(scope, mode, path)``, without a mode as their content says: parsed once, in tasks, written once a scope and layer."""
        if not plan:
            return []
        docs = materialise(turtle.documents(self.spark, sorted({path for _, _, path in plan})))
        of = lambda what: F.col("what") == what
        head = docs.groupBy("path").agg(
            F.max(F.when(of("error"), F.col("o"))).alias("error"), F.count_if(of("triple")).alias("n"), F.max(of("triple") & turtle.marks_schema()).alias("schema"), F.collect_list(F.when(of("prefix"), F.struct("s", "o"))).alias("prefixes")
        )
        about = {r["path"]: r for r in head.collect()}  # a row a file
        groups: dict[tuple, list[Outcome]] = {}
        for scope, mode, path in sorted(plan, key=lambda x: x[2]):
            r = about[path]
            self.prefixes |= {p["s"]: p["o"] for p in r["prefixes"]}
            one = Outcome(path, scope, mode or ("schema" if r["schema"] else "data"), r["n"], r["error"])
            groups.setdefault((scope or "", one.mode != "schema", one.mode), []).append(one)
        out, broken = [], set()
        for (scope, _, mode), files in sorted(groups.items(), key=lambda x: x[0]):
            if mode != "schema" and scope in broken:
                for o in files:
                    o.error = o.error or "schema of the scope failed"
            good = [o for o in files if not o.error]
            if good:
                try:
                    names = self.spark.createDataFrame([(o.path,) for o in good], "path string")  # a row a file
                    self.load(turtle.triples_of(docs.join(names, "path", "left_semi")), mode, replace, scope or None)
                except Exception as e:
                    for o in good:
                        o.error = str(e)
            if mode == "schema" and any(o.error for o in files):
                broken.add(scope)
            for o in files:
                o.triples = 0 if o.error else o.triples
                if on_file:
                    on_file(o)
            out += files
        return out

    def load_manifest(self, path: str, replace: bool = False) -> list[Outcome]:
        """YAML: ``ontologies: [{id, schema: [globs], data: [globs]}]`` and ``ignore``; a glob without a file is an error."""
        import yaml

        spec = yaml.safe_load(Path(path).read_text("utf-8")) or {}
        base, plan = Path(path).parent, []
        for o in spec.get("ontologies", []):
            T.ontology_id(o["id"])
            for mode in ("schema", "data"):
                for glob in o.get(mode, []) or []:
                    files = sorted(p for p in base.glob(glob) if not any(fnmatch.fnmatch(p.name, g) for g in spec.get("ignore", [])))
                    if not files:
                        raise FileNotFoundError(f"{o['id']}: nothing matches {glob}")
                    plan += [(o["id"], mode, f"file:{f.resolve()}") for f in files]
        return self._run(plan, replace, None)
