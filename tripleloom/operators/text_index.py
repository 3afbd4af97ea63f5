"""A stored inverted index: postings with positions, in partitions that are ranges of terms, in segments that merge.

A segment is one Parquet table of blocks ``term, ids, lens, stops, positions`` partitioned by term range; a block holds a term's
postings of some documents.  The ranges part the postings of the
first segment evenly, so a query reads the directories of its terms' ranges and, within them, the row groups of its terms; a
term that a great part of the documents hold is one range, in many files.  Additions write a segment each and read nothing; `merge`
rewrites them as one.  A commit lists the live segments with their documents and lengths, so a search reads one state and needs no
statistics of its own beyond its terms' postings.

A document is added once: a repeated id counts as one more document.  Rows with a null id are left out."""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import Log
from .search import parse, scored, tokens

#: Ranges of a new index, and sampled postings that their borders follow from.
RANGES, SAMPLED = 64, 100_000
#: Words that a task turns into blocks at once (a single document may have more).
WORDS_AT_ONCE = 1_000_000


def _bounded(most: int):
    """A batch in runs of rows with at most so many words, or one row, however long the documents are.  (Inner functions travel to tasks by value.)"""

    def runs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        upto = np.cumsum(pc.list_value_length(b.column("w")).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
            yield b.slice(at, to - at)
            at = to

    return runs


def _postings(borders: list[str]):
    """Arrow batches ``id, w`` to blocks: of a term the batch's documents with it, their lengths, and the places in all of them,
    those of a document up to its stop."""

    bounded = _bounded(WORDS_AT_ONCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (some for batch in batches for some in bounded(batch)):
            words = b.column("w")
            size = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            total = int(size.sum())
            if not total:
                continue
            coded = words.flatten().dictionary_encode()
            doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
            place = np.arange(total, dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
            key = coded.indices.to_numpy().astype(np.int64) * len(size) + doc
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))  # of a posting
            stop = np.append(first[1:], total)
            term, owner = key[first] // len(size), key[first] % len(size)
            block = np.flatnonzero(np.diff(term, prepend=-1))  # of a term
            ends = np.append(block, len(first)).astype(np.int32)
            begin = np.repeat(first[block], np.diff(ends))
            ranges = np.array([bisect_right(borders, t) for t in coded.dictionary.to_pylist()], np.int32)
            lists = lambda values, at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
            columns = [lists(b.column("id").take(pa.array(owner)), ends), lists(pa.array(size[owner].astype(np.int32)), ends), lists(pa.array((stop - begin).astype(np.int32)), ends)]
            places = lists(pa.array(place[order]), np.append(first[block], total))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term[block])), *columns, places, pa.array(ranges[term[block]])], names=["term", "ids", "lens", "stops", "positions", "range"])

    return run


def _blocks(kind: str) -> str:
    return f"term string, ids array<{kind}>, lens array<int>, stops array<int>, positions array<int>, range int"


def _less(k: int):
    return lambda place: place - k


@dataclass
class TextIndex:
    spark: SparkSession
    path: str

    @property
    def log(self) -> Log:
        return Log(self.spark, f"{self.path}/log")

    def _write(self, postings: DataFrame) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        # a range that is large goes to several tasks and files: rebalanced partitions are split by size
        postings.hint("rebalance", "range").sortWithinPartitions("range", "term").write.partitionBy("range").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def add(self, docs: DataFrame, id_col: str = "id", text_col: str = "text", ranges: int = RANGES) -> int:
        """Index ``docs`` as one more segment; returns the commit's number."""
        number, state = self.log.read()
        d = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col).cast("string")).alias("w")).where("id is not null")
        kind = dict(d.dtypes)["id"]
        if not state:
            # borders of even ranges, from a bounded sample of the terms: a layout, not a result
            some = d.select(F.explode("w").alias("term")).where(F.rand(7) < 0.05).limit(SAMPLED).groupBy("term").count().orderBy("term").collect()
            total, so_far, borders = sum(r["count"] for r in some), 0, []
            for r in some:
                if so_far * ranges // max(1, total) < (so_far + r["count"]) * ranges // max(1, total) and so_far:
                    borders.append(r["term"])
                so_far += r["count"]
            state = {"id": kind, "borders": borders, "segments": []}
        if kind != state["id"]:
            raise ValueError(f"ids are {state['id']}, not {kind}")
        name = self._write(d.mapInArrow(_postings(state["borders"]), _blocks(kind)))
        size = d.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("words")).first()
        return self.log.commit(number, state | {"segments": [*state["segments"], {"name": name, "docs": size["n"], "words": size["words"]}]})

    def merge(self) -> int:
        """All segments as one.  The old ones stay for readers of earlier commits until `drop_unlisted`."""
        number, state = self.log.read()
        if len(state.get("segments", ())) < 2:
            return number
        name = self._write(self._rows(state))
        one = {"name": name, "docs": sum(s["docs"] for s in state["segments"]), "words": sum(s["words"] for s in state["segments"])}
        return self.log.commit(number, state | {"segments": [one]})

    def drop_unlisted(self) -> None:
        """Delete the segments that the last commit does not list."""
        numbers = self.log.numbers()
        live = {s["name"] for s in self.log.read()[1].get("segments", ())}
        old = {s["name"] for n in numbers[:-1] for s in self.log.read(n)[1]["segments"]} - live
        self.log.delete(*(f"{self.path}/{name}" for name in sorted(old)))

    def _rows(self, state: dict) -> DataFrame:
        schema = _blocks(state["id"])
        out = None
        for s in state["segments"]:
            t = self.spark.read.schema(schema).parquet(f"{self.path}/{s['name']}")
            out = t if out is None else out.unionByName(t)
        return out

    def postings(self, leaves: list[str], state: dict) -> DataFrame:
        """``range, term, id, len, positions`` of the leaves' terms: filters on the partitions and on the terms, both seen by the scan."""
        borders = state["borders"]
        ranges: set[int] = set()
        want = F.lit(False)
        words = sorted({w for leaf in leaves if not leaf.endswith("*") for w in leaf.split(" ")})
        if words:
            want = F.col("term").isin(words)
            ranges |= {bisect_right(borders, w) for w in words}
        for p in sorted({leaf[:-1] for leaf in leaves if leaf.endswith("*")}):
            want = want | F.col("term").startswith(p)
            ranges |= set(range(bisect_right(borders, p), bisect_left(borders, p + "\U0010ffff") + 1))
        blocks = self._rows(state).where(F.col("range").isin(sorted(ranges)) & want)

        def one(i):
            start = F.when(i > 0, F.get("stops", i - 1)).otherwise(0)
            return F.struct(F.get("ids", i).alias("id"), F.get("lens", i).alias("len"), F.slice("positions", start + 1, F.get("stops", i) - start).alias("positions"))

        return blocks.select("range", "term", F.inline(F.transform(F.sequence(F.lit(0), F.size("ids") - 1), one)))

    def search(self, query: str, limit: int | None = 10, at: int | None = None, among: DataFrame | None = None) -> DataFrame:
        """``id, score``, best first with a limit; the scores of `bm25` over all documents of commit ``at`` (the last by default).

        ``among(id)`` keeps some documents before the best are taken; statistics stay those of the whole index."""
        asked = parse(query)
        _, state = self.log.read(at)
        if not state:
            raise ValueError("the index is empty")
        names = range(len(asked.leaves))
        of = {w: F.col("term") == w for leaf in asked.leaves if not leaf.endswith("*") for w in leaf.split(" ")}
        here = {w: F.first(F.when(c, F.col("positions")), True) for w, c in of.items()}
        columns = []
        for i, leaf in enumerate(asked.leaves):
            if leaf.endswith("*"):
                count = F.sum(F.when(F.col("term").startswith(leaf[:-1]), F.size("positions")).otherwise(0))
            elif " " not in leaf:
                count = F.sum(F.when(of[leaf], F.size("positions")).otherwise(0))
            else:
                both = None  # where the phrase starts: the words' places, each less its number, in common
                for k, w in enumerate(leaf.split(" ")):
                    starts = F.transform(here[w], _less(k))
                    both = starts if both is None else F.array_intersect(both, starts)
                count = F.coalesce(F.size(both), F.lit(0))
            columns.append(F.greatest(count, F.lit(0)).alias(f"tf{i}"))
        found = self.postings(asked.leaves, state).groupBy("id").agg(F.max("len").alias("len"), *columns)
        tf, df = [F.col(f"tf{i}") for i in names], [F.col(f"df{i}") for i in names]
        stats = found.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in names])
        n, words = (sum(s[k] for s in state["segments"]) for k in ("docs", "words"))
        score = scored(asked, tf, F.col("len"), F.lit(n), F.lit(words / max(1, n)), df)
        rows = found.where(asked.holds(tf))
        rows = rows.join(among.select("id").distinct(), "id", "left_semi") if among is not None else rows
        out = rows.crossJoin(F.broadcast(stats)).select("id", score.alias("score"))  # one row of statistics
        return out.orderBy(F.desc("score"), "id").limit(limit) if limit is not None else out
