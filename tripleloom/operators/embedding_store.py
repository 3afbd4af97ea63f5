"""Embeddings built by a provider and stored: what is embedded stays embedded, whatever becomes of the run.

Vectors are cached by a hash of (provider, text), in waves that each end with a write.  A run that is killed, or whose provider
gives up, has lost its last wave at most; the same call again asks the provider for what is missing only.  A collection of
``id, vec, ontologies`` is then a join of ids with the cache and becomes visible with one commit.

A text is embedded once however many ids have it; texts under ``least`` characters, nulls among them, have no vector; an id with
several texts takes the greatest.  A build for an ontology replaces that ontology's tags and leaves the vectors of others, one for none replaces
the collection."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import terms as T
from ..plans.materialise import materialise
from ..sources.commits import Log
from .graph import Graph
from .vectors import untag, upsert

WAVES, BATCH, TRIES, PAUSE = 8, 256, 4, 0.5
TEXTS = "id string, vec array<float>, ontologies array<string>"


class Provider(Protocol):
    """``name`` says which vectors these are (model and version); ``open`` is called once a worker and returns what embeds a list of texts."""

    name: str
    dim: int

    def open(self): ...


@dataclass(frozen=True)
class HashedWords:
    """An offline provider: signed counts of words by the first eight hexadecimal digits of their MD5."""

    dim: int = 256

    @property
    def name(self) -> str:
        return f"hashed-words-{self.dim}"

    def open(self):
        places: dict[str, tuple[int, int]] = {}

        def place(w: str) -> tuple[int, int]:
            if w not in places:
                if len(places) > 500_000:
                    places.clear()
                h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                places[w] = (h // 2 % self.dim, 1 - 2 * (h % 2))
            return places[w]

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), self.dim), np.float32)
            for i, t in enumerate(texts):
                for w, n in Counter(re.findall(r"[^\W_]+", t.lower())).items():
                    k, sign = place(w)
                    out[i, k] += sign * n
            return out

        return embed


_opened: dict[str, object] = {}


def _embedded(provider: Provider, batch: int, tries: int, pause: float):
    """Arrow batches ``hash, text`` to ``hash, vec``; the provider is opened once a worker and asked again after a failure."""

    def ask(texts: list[str]):
        for n in range(tries):
            try:
                if provider.name not in _opened:
                    _opened[provider.name] = provider.open()
                got = _opened[provider.name](texts)
                if len(got) != len(texts):
                    raise ValueError(f"{provider.name}: {len(got)} vectors for {len(texts)} texts")
                return got
            except Exception:
                _opened.pop(provider.name, None)
                if n + 1 == tries:
                    raise
                time.sleep(pause * 2**n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                some = b.slice(at, batch)
                vec = np.asarray(ask(some.column("text").to_pylist()), np.float32)
                if vec.shape[1:] != (provider.dim,):
                    raise ValueError(f"{provider.name}: vectors of {vec.shape[1:]}, not {provider.dim}")
                flat = pa.array(vec.ravel())
                yield pa.RecordBatch.from_arrays([some.column("hash"), pa.ListArray.from_arrays(pa.array(np.arange(0, vec.size + 1, provider.dim, dtype=np.int32)), flat)], names=["hash", "vec"])

    return run


def entity_texts(graph: Graph, ontology: str | None = None) -> DataFrame:
    """``id, text`` of typed entities that are no blank nodes: their texts in the order of property and value, one a line."""
    typed = graph.triples([T.TYPE], ontology).where(~F.col("o").isin(*T.VOCABULARY_TYPES) & (F.col("s_kind") != "bnode")).select("s").distinct()
    lit = graph.triples(list(T.TEXT_PROPERTIES), ontology).where("o_kind = 'literal'").select("s", "p", "o").distinct()
    all_ = lit.join(typed, "s", "left_semi").groupBy("s").agg(F.array_sort(F.collect_set(F.struct("p", "o"))).alias("t"))
    return all_.select(F.col("s").alias("id"), F.array_join(F.transform("t", lambda x: x["o"]), "\n").alias("text"))


@dataclass
class EmbeddingStore:
    spark: SparkSession
    path: str
    waves: int = WAVES
    batch: int = BATCH
    tries: int = TRIES
    pause: float = PAUSE

    @property
    def log(self) -> Log:
        return Log(self.spark, f"{self.path}/log")

    def _cache(self, provider: Provider) -> DataFrame | None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/cache/{provider.name}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return None
        done = [f.getPath().toString() for f in fs.listStatus(folder) if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return self.spark.read.schema("hash string, vec array<float>").parquet(*sorted(done)) if done else None

    def embed(self, texts: DataFrame, provider: Provider, least: int = 3) -> DataFrame:
        """``id, vec`` of ``texts(id, text)``; asks the provider for texts that the cache has not."""
        t = texts.select(F.col("id").cast("string").alias("id"), F.trim(F.col("text").cast("string")).alias("text")).where(F.length("text") >= least)
        t = t.withColumn("hash", F.sha2(F.concat(F.lit(provider.name + "\n"), "text"), 256))
        named = materialise(t.groupBy("id").agg(F.max("hash").alias("hash")))
        missing = named.groupBy("hash").agg(F.min("id").alias("id"))
        cache = self._cache(provider)
        missing = materialise(missing.join(cache, "hash", "left_anti") if cache is not None else missing)
        # the first characters of a hash are even: a wave is one range of them
        border = [f"{(k << 16) // self.waves:04x}" for k in range(self.waves)] + ["g"]
        for low, high in zip(border, border[1:], strict=False):
            some = missing.where((F.col("hash") >= low) & (F.col("hash") < high))
            if some.isEmpty():
                continue
            rows = t.join(some, ["id", "hash"], "left_semi").dropDuplicates(["hash"]).select("hash", "text")
            rows.mapInArrow(_embedded(provider, self.batch, self.tries, self.pause), "hash string, vec array<float>").write.parquet(f"{self.path}/cache/{provider.name}/wave-{uuid.uuid4().hex}")
        cache = self._cache(provider)
        if cache is None:
            return named.limit(0).select("id", F.lit(None).cast("array<float>").alias("vec"))
        # two runs at once may have embedded the same text: any one of its vectors will do
        return named.join(cache.dropDuplicates(["hash"]), "hash").select("id", "vec")

    def build(self, collection: str, vectors: DataFrame, ontology: str | None = None) -> int:
        """Put ``vectors(id, vec)`` in a collection by one commit; returns how many."""
        T.ontology_id(ontology)
        number, state = self.log.read()
        none = F.array().cast("array<string>")
        new = materialise(vectors.select("id", "vec"))
        table = new.withColumn("ontologies", none)
        if ontology is not None:
            held = self.read(collection) if collection in state else self.spark.createDataFrame([], TEXTS)
            # vectors of no ontology stay too: they are not this one's to remove
            free, tagged = held.where(F.size("ontologies") == 0), untag(held.where(F.size("ontologies") > 0), ontology)
            table = upsert(free.unionByName(tagged), new, ontology)
        name = f"{collection}-{uuid.uuid4().hex}"
        table.write.parquet(f"{self.path}/{name}")
        self.log.commit(number, state | {collection: name})
        return new.count()

    def build_texts(self, texts: DataFrame, provider: Provider, ontology: str | None = None, collection: str = "text") -> int:
        return self.build(collection, self.embed(texts, provider), ontology)

    def read(self, collection: str = "text", ontology: str | None = None) -> DataFrame:
        """``id, vec, ontologies``, of one ontology where given."""
        _, state = self.log.read()
        if collection not in state:
            raise KeyError(collection)
        rows = self.spark.read.schema(TEXTS).parquet(f"{self.path}/{state[collection]}")
        return rows if ontology is None else rows.where(F.array_contains("ontologies", ontology))
