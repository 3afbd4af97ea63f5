"""A stored vector index for cosine neighbours: inverted lists with radii, and lists skipped only where no result can be in them.

Centres come from a bounded sample (a layout, not a result); every vector goes to its nearest centre's list.  A list knows its
radius, the largest angle between its centre and a member, and the ontologies of its members.  By the triangle inequality for angles no member is
nearer to a query than the angle to the centre less the radius.  A search reads the nearest lists, and then the lists whose
bound the worst of the best ``top_k`` does not exclude, so it equals a scan; how much it read is reported."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import terms as T
from ..sources.commits import Log
from .vectors import cosine

#: Vectors that centres are fitted on at most, rounds of fitting, and lists at most.
SAMPLED, ROUNDS, LISTS = 20_000, 6, 1024
#: Room for rounding in angles of single-precision sums.
SLACK = 1e-5


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _centres(x: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means from evenly spaced starts."""
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, _unit(sums), c)
    return np.unique(c, axis=0)


def _dense(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


@dataclass
class Reading:
    """What a search read of the index."""

    lists: int
    of: int
    vectors: int
    of_vectors: int


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str

    @property
    def log(self) -> Log:
        return Log(self.spark, f"{self.path}/log")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None) -> VectorIndex:
        """Index ``vectors(id, vec[, ontologies])``; null vectors and zero ones, which have no angle, are left out."""
        index = cls(vectors.sparkSession, path)
        number, _ = index.log.read()
        tags = F.col("ontologies") if "ontologies" in vectors.columns else F.array().cast("array<string>")
        v = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"), tags.alias("ontologies")).where("vec is not null and exists(vec, x -> x <> 0)")
        kind = dict(v.dtypes)["id"]
        n = v.count()
        some = v.select("vec").where(F.rand(3) < min(1.0, 2 * SAMPLED / max(1, n))).limit(SAMPLED).toArrow()
        lists = lists or min(LISTS, max(1, int(math.sqrt(n))))
        x = _unit(_dense(some.column("vec").combine_chunks())) if len(some) else np.zeros((0, 1))
        centres = _centres(x[np.lexsort(x.T)], lists) if len(x) else np.zeros((1, 1))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cos = _unit(_dense(b.column("vec"))) @ centres.T
                own = cos.argmax(1)
                angle = np.arccos(np.clip(cos[np.arange(len(own)), own], -1, 1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), b.column("ontologies"), pa.array(angle), pa.array(own.astype(np.int32))], names=["id", "vec", "ontologies", "angle", "list"])

        name = f"build-{uuid.uuid4().hex}"
        schema = f"id {kind}, vec array<double>, ontologies array<string>, angle double, list int"
        v.mapInArrow(assign, schema).hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/{name}")
        rows = index.spark.read.schema(schema).parquet(f"{path}/{name}")
        by = rows.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
        of = rows.select("list", F.explode("ontologies").alias("o")).groupBy("list").agg(F.sort_array(F.collect_set("o")).alias("ontologies"))
        held = by.join(of, "list", "left").orderBy("list").collect()  # a row a list
        described = [{"list": r["list"], "centre": centres[r["list"]].tolist(), "radius": r["radius"], "n": r["n"], "ontologies": r["ontologies"] or []} for r in held]
        index.log.commit(number, {"name": name, "id": kind, "lists": described})
        return index

    def search(self, vec: list[float], top_k: int = 10, ontology: str | None = None, exclude=None) -> tuple[DataFrame, Reading]:
        """``id, score`` as a scan gives them, ties to the smaller id, and what was read; ``exclude``: an id that is not asked for."""
        T.limit("similar", top_k)
        _, state = self.log.read()
        if not state:
            raise ValueError("no index here")
        schema = f"id {state['id']}, vec array<double>, ontologies array<string>, angle double, list int"
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{state['name']}") if state["lists"] else self.spark.createDataFrame([], schema)
        lists = [x for x in state["lists"] if ontology is None or ontology in x["ontologies"]]
        q = np.asarray(vec, np.float64)
        size = float(np.linalg.norm(q))
        total = sum(x["n"] for x in state["lists"])
        if not lists or not size > 0:
            return rows.limit(0).select("id", F.lit(0.0).alias("score")), Reading(0, len(state["lists"]), 0, total)
        angle = np.arccos(np.clip(np.array([x["centre"] for x in lists]) @ q / size, -1, 1))
        nearest = np.maximum(0.0, angle - np.array([x["radius"] for x in lists]) - SLACK)

        def best(some: list[int]) -> DataFrame:
            r = rows.where(F.col("list").isin([lists[i]["list"] for i in some]))
            r = r.where(F.array_contains("ontologies", ontology)) if ontology is not None else r
            r = r.where(F.col("id") != exclude) if exclude is not None else r
            return r.select("id", cosine(F.col("vec"), F.array(*[F.lit(float(y)) for y in q])).alias("score")).where("score is not null").orderBy(F.desc("score"), "id").limit(top_k)

        # lists by their bounds until they hold enough, then all that could still matter
        order = np.lexsort((angle, nearest))
        first, held = [], 0
        for i in order:
            first.append(int(i))
            held += lists[i]["n"]
            if held >= 4 * top_k:
                break
        found = best(first).collect()  # top_k rows
        worst = found[-1]["score"] if len(found) == top_k else -2.0
        rest = [int(i) for i in order[len(first) :] if math.cos(nearest[i]) >= worst - SLACK]
        read = first + rest
        return best(read), Reading(len(read), len(state["lists"]), sum(lists[i]["n"] for i in read), total)

    def similar(self, key, top_k: int = 10, ontology: str | None = None) -> tuple[DataFrame, Reading]:
        """The neighbours of a stored vector, itself left out; none if it has none."""
        _, state = self.log.read()
        schema = f"id {state['id']}, vec array<double>, ontologies array<string>, angle double, list int"
        one = self.spark.read.schema(schema).parquet(f"{self.path}/{state['name']}").where(F.col("id") == key).select("vec").first() if state.get("lists") else None
        if one is None:
            return self.search([0.0], top_k)
        return self.search(one["vec"], top_k, ontology, key)
