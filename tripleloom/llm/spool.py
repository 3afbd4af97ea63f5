"""Materialised intermediates, size-checked broadcasts and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most this many narrow rows.
BROADCAST_ROWS = 2_000_000
#: A counted edge table of at most this many rows (16 bytes each) is worked on in one task, without exchanges.
ONE_TASK_EDGES = 1_000_000
#: Bytes of a row group, which a writing task holds in memory.
ROW_GROUP = 32 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests on one machine) a temporary folder is set instead."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="tripleloom-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def folder_for(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted with the spooled tables."""
    path = f"{shared_dir(spark)}/spool-{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def spool(df: DataFrame, what: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation."""
    path = folder_for(df.sparkSession, what)
    writer = df.write.option("parquet.block.size", ROW_GROUP)
    (writer.option("compression", codec) if codec else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*spooled: DataFrame) -> None:
    """Delete spooled tables that nothing reads any more."""
    for df in spooled:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        gone = [w for w in _written if any(f.endswith(w[1].split(":", 1)[-1].lstrip("/")) for f in folders)]
        _written[:] = [w for w in _written if w not in gone]
        _delete(gone)


def _delete(some: list[tuple[SparkSession, str]]) -> None:
    while some:
        spark, path = some.pop()
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes what was spooled inside at the end; results must be written elsewhere by then."""
    start = len(_written)
    try:
        yield
    finally:
        inside, _written[start:] = _written[start:], []
        _delete(inside)


@atexit.register
def sweep() -> None:
    """Delete the spooled tables of this process; results that read them are void afterwards."""
    try:
        _delete(_written)
    except Exception:  # the session may be gone already
        return


def free_name(name: str, taken: Iterable[str]) -> str:
    """A column name that no column in ``taken`` has, in any case of letters."""
    taken = {t.lower() for t in taken}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bits of the numbers that samples are drawn by.
DRAW_BITS = 62


def drawn(key: Column, seed: int, want: int, n: int) -> Column:
    """Whether a row is among about ``want`` of ``n``, by a hash of its key; all are where there are no more.

    The threshold is exact to 2^-62, so a sample does not run empty however many rows there are."""
    number = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) * F.lit(1 << DRAW_BITS - 20) + F.pmod(F.xxhash64(key, F.lit(seed + 1000)), F.lit(1 << DRAW_BITS - 20))
    return number < F.lit(draw_limit(want, n))


def draw_limit(want: int, n: int) -> int:
    return (1 << DRAW_BITS) if n <= want else max(1, (want << DRAW_BITS) // n)


def maybe_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast when the counted rows stay under the bound, else leave the join to Catalyst."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: rows ``(id, component)``, component the least id.

    Alternates large-star and small-star steps until the edges stop changing; each step is an
    aggregation and a join on the node, so a node with very many edges is pre-aggregated before
    the shuffle and its join side can be split.  Up to ``one_task`` edges (counted) stay in one partition, where the same
    steps need no exchange.  Isolated nodes have no row."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = spool(e, "edges")
    before = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    few = before[0] <= one_task
    while before[0]:
        e = e.coalesce(1) if few else e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node points at the least of its smaller neighbours, which it links with the others
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = spool(small, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
