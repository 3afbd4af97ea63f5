"""A stored reachability index: what a node reaches is a few ranges of numbers, so a closure is a range join without loops.

Built in Spark once a graph, by rounds of joins:

1. *Condensation.*  Nodes are numbered at random; those without a way in or out are trimmed round by round.  Of what is left each learns the least
   node that reaches it and the least that it reaches: where both are one, the component is found; edges between nodes that differ in either
   are cut, so what lies before and behind a component goes on apart and few phases follow.
2. *Forest.*  Each component keeps one edge to a parent, on that side of the edges where fewer are left out.  A component's number and
   its subtree's last number follow from subtree sizes, by level; children of one parent are numbered in parts, so no parent is one task.
3. *Other edges* hand their target's range to all that reach them, unless it lies in a range that is already there.

Reading a closure back is one equi-join on blocks of numbers.  A pair ``(x, x)`` is in it if x lies on a cycle, as in `traverse.closure`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.materialise import materialise
from ..sources.commits import Log

#: Numbers of a block that ranges meet in, and parts that the children of one parent are numbered in.
BLOCK, PARTS = 1024, 64


def _cut(df: DataFrame) -> DataFrame:
    """A table of a loop, which grows with the input: written, and met by shuffle."""
    return materialise(df, by_shuffle=True)


def _names(edges: DataFrame) -> DataFrame:
    """``node, id`` of the ends of ``edges(s, o)``: numbers in the order of hashes, so that a least number is a random node and not the first of a chain."""
    nodes = edges.select(F.col("s").alias("node")).union(edges.select("o")).distinct()
    return _cut(nodes.sortWithinPartitions(F.xxhash64("node")).select("node", F.monotonically_increasing_id().alias("id")))


def _by_number(edges: DataFrame, names: DataFrame) -> DataFrame:
    return _cut(edges.join(names.toDF("s", "si"), "s").join(names.toDF("o", "oi"), "o").select(F.col("si").alias("s"), F.col("oi").alias("o")))


def _trim(edges: DataFrame) -> DataFrame:
    """``edges(s, o)`` between nodes that have a way in and a way out; all cycles are in it."""
    n = edges.count()
    while n:
        kept = edges.join(edges.select(F.col("o").alias("s")).distinct(), "s", "left_semi").join(edges.select(F.col("s").alias("o")).distinct(), "o", "left_semi")
        edges, before = _cut(kept.select("s", "o")), n
        n = edges.count()
        if n == before:
            break
    return edges


def _least(edges: DataFrame) -> DataFrame:
    """``node, f, b``: the least node that reaches it and the least that it reaches, itself counted.

    Both at once, over arcs between 2 x and 2 x' along the edges and between 2 x + 1 and 2 x' + 1 against them."""
    out = edges.select((2 * F.col("s")).alias("u"), (2 * F.col("o")).alias("v"))
    arcs = _cut(out.union(edges.select((2 * F.col("o") + 1).alias("u"), (2 * F.col("s") + 1).alias("v"))))
    at = _cut(arcs.select("u").union(arcs.select("v")).distinct().select("u", F.shiftright("u", 1).alias("c"), F.lit(True).alias("moved")))
    while True:
        # only what the last round changed is passed on
        passed = arcs.join(at.where("moved").select("u", "c"), "u").select(F.col("v").alias("u"), "c", F.lit(None).cast("long").alias("own"))
        step = at.select("u", "c", F.col("c").alias("own")).union(passed).groupBy("u").agg(F.min("c").alias("c"), F.max("own").alias("own"))
        at = _cut(step.select("u", "c", (F.col("c") < F.col("own")).alias("moved")))
        if at.where("moved").isEmpty():
            break
    side = lambda k: F.max(F.when(F.col("u") % 2 == k, F.col("c")))
    return _cut(at.groupBy(F.shiftright("u", 1).alias("node")).agg(side(0).alias("f"), side(1).alias("b")))


def _components(edges: DataFrame) -> DataFrame:
    """``node, comp`` of every node on a cycle of numbered ``edges(s, o)``; ``comp`` is the component's least number."""
    left, found = _trim(edges), []
    while not left.isEmpty():
        least = _least(left)
        # what a node reaches and is reached by is its component, whole, for all of it has the same two
        seen = least.where("f = b").select("node", F.col("f").alias("comp"))
        # a component of one node is on a cycle only by an edge to itself
        many = seen.groupBy("comp").agg(F.count("*").alias("n")).where("n > 1").select("comp")
        loops = left.where("s = o").select(F.col("s").alias("comp"))
        found.append(_cut(seen.join(_cut(many.union(loops).distinct()), "comp", "left_semi").select("node", "comp")))
        # ends of an edge with different ones are in different components
        rest = left.join(least.toDF("s", "f", "b"), "s").join(least.toDF("o", "fo", "bo"), "o").where("f = fo and b = bo and f <> b")
        left = _trim(_cut(rest.select("s", "o")))
    if not found:
        return edges.sparkSession.createDataFrame([], "node long, comp long")
    out = found[0]
    for some in found[1:]:
        out = out.union(some)
    return _cut(out)


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, comp`` of every node on a cycle of ``edges(s, o)``; ``comp`` is the component's least node."""
    e = _cut(edges.select("s", "o").where("s is not null and o is not null").distinct())
    names = _names(e)
    named = _cut(_components(_by_number(e, names)).toDF("id", "c").join(names, "id").select("node", "c"))
    return _cut(named.join(_cut(named.groupBy("c").agg(F.min("node").alias("comp"))), "c").select("node", "comp"))


def _numbered(parents: DataFrame) -> DataFrame:
    """``comp, lo, hi`` of the forest ``parents(comp, parent)`` (null parent: a root): a subtree is the numbers from lo to hi, lo the node's own."""
    levels = [_cut(parents.where("parent is null").select("comp", "parent"))]
    while True:
        below = _cut(parents.join(levels[-1].select(F.col("comp").alias("parent")), "parent", "left_semi").select("comp", "parent"))
        if below.isEmpty():
            break
        levels.append(below)
    sizes = [_cut(levels[-1].withColumn("size", F.lit(1).cast("long")))]
    for level in levels[-2::-1]:
        under = sizes[-1].groupBy(F.col("parent").alias("comp")).agg(F.sum("size").alias("n"))
        sizes.append(_cut(level.join(under, "comp", "left").select("comp", "parent", (F.coalesce("n", F.lit(0)) + 1).alias("size"))))
    out, above = None, None
    for level in sizes[::-1]:
        # siblings in parts by hash: sums by part, running sums inside a part
        level = level.withColumn("part", F.pmod(F.xxhash64("comp"), F.lit(PARTS if above is not None else 16 * PARTS)))
        order = Window.partitionBy("parent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = level.groupBy("parent", "part").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
        inside = Window.partitionBy("parent", "part").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1)
        placed = level.withColumn("mine", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        same = placed["parent"].eqNullSafe(sums["parent"]) & (placed["part"] == sums["part"])
        placed = placed.join(sums, same).select("comp", placed["parent"], "size", (F.col("before") + F.col("mine")).alias("at"))
        if above is not None:
            placed = placed.join(above.select(F.col("comp").alias("parent"), F.col("lo").alias("base")), "parent").withColumn("at", F.col("base") + 1 + F.col("at"))
        above = _cut(placed.select("comp", F.col("at").alias("lo"), (F.col("at") + F.col("size") - 1).alias("hi")))
        out = above if out is None else out.union(above)
    return _cut(out)


@dataclass
class ReachIndex:
    """``forward``: a node's ranges hold what it reaches; else what reaches it."""

    spark: SparkSession
    path: str

    @property
    def log(self) -> Log:
        return Log(self.spark, f"{self.path}/log")

    @classmethod
    def build(cls, edges: DataFrame, path: str) -> ReachIndex:
        """Index ``edges(s, o)`` at ``path``; a later build there is one more commit and readers go on with theirs."""
        index = cls(edges.sparkSession, path)
        number, _ = index.log.read()
        e = _cut(edges.select("s", "o").where("s is not null and o is not null").distinct())
        names = _names(e)
        e = _by_number(e, names)
        comps = _components(e)
        of = lambda c, to: F.coalesce(F.col(to), F.col(c))
        d = e.join(comps.toDF("s", "cs"), "s", "left").join(comps.toDF("o", "co"), "o", "left")
        dag = _cut(d.select(of("s", "cs").alias("s"), of("o", "co").alias("o")).where("s <> o").distinct())
        nodes = _cut(names.join(comps.toDF("id", "comp"), "id", "left").select("node", F.coalesce("comp", "id").alias("comp"), F.col("comp").isNotNull().alias("cyclic")))
        n = dag.agg(F.count_distinct("s").alias("s"), F.count_distinct("o").alias("o")).first()
        forward = n["o"] >= n["s"]  # one edge a node stays in the forest: on the side that has more of them
        down = dag if forward else dag.select(F.col("o").alias("s"), F.col("s").alias("o"))
        comp = nodes.select("comp").distinct()
        tree = down.groupBy(F.col("o").alias("comp")).agg(F.min("s").alias("parent"))
        own = _numbered(_cut(comp.join(tree, "comp", "left")))
        ranges = own.select("comp", "lo", "hi")
        more = _cut(down.join(tree.select(F.col("comp").alias("o"), "parent"), "o").where("s <> parent").select(F.col("s").alias("comp"), "o"))
        new = _cut(more.join(own.toDF("o", "lo", "hi"), "o").select("comp", "lo", "hi").distinct())
        while not new.isEmpty():
            # what lies in a range of the node itself is known
            known = ranges.toDF("comp", "a", "b")
            new = _cut(new.join(known, (new["comp"] == known["comp"]) & (F.col("a") <= F.col("lo")) & (F.col("hi") <= F.col("b")), "left_anti"))
            ranges = _cut(ranges.union(new))
            new = _cut(down.join(new.withColumnRenamed("comp", "o"), "o").select(F.col("s").alias("comp"), "lo", "hi").distinct())
        # ranges of subtrees are nested or apart: only the outer ones of a node stay
        before = Window.partitionBy("comp").orderBy("lo", F.desc("hi")).rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.withColumn("reached", F.max("hi").over(before)).where("reached is null or reached < hi").select("comp", "lo", "hi")
        name = f"build-{number + 1:06d}"
        named = nodes.join(own.select("comp", F.col("lo").alias("num")), "comp").select("node", "num", "cyclic")
        named.repartitionByRange("num").sortWithinPartitions("num").write.mode("overwrite").parquet(f"{path}/{name}/nodes")
        ranges.join(own.select("comp", F.col("lo").alias("num")), "comp").select("num", "lo", "hi").write.mode("overwrite").parquet(f"{path}/{name}/ranges")
        index.log.commit(number, {"name": name, "forward": forward})
        return index

    def _tables(self) -> tuple[DataFrame, DataFrame, bool]:
        number, state = self.log.read()
        if number < 0:
            raise ValueError("no index here")
        read = lambda t, schema: self.spark.read.schema(schema).parquet(f"{self.path}/{state['name']}/{t}")
        return read("nodes", "node string, num long, cyclic boolean"), read("ranges", "num long, lo long, hi long"), state["forward"]

    def closure(self, starts: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
        """``s, o``: every pair a step or more apart; from ``starts(s)`` and to ``ends(o)`` where given."""
        nodes, ranges, forward = self._tables()
        roots, leaves = (starts, ends) if forward else (ends, starts)
        # whole tables meet by shuffle: the size of their files says little of what a broadcast of them would hold
        pick = lambda some: nodes.hint("merge") if some is None else nodes.join(some.toDF("node").distinct(), "node", "left_semi")
        a = pick(roots).join(ranges, "num").select(F.col("node").alias("x"), F.col("num").alias("xn"), F.col("cyclic").alias("loop"), "lo", "hi")
        a = a.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK))))
        b = pick(leaves).select(F.col("node").alias("y"), F.col("num").alias("yn"), F.floor(F.col("num") / BLOCK).alias("block"))
        met = a.join(b, "block").where("yn between lo and hi and (yn <> xn or loop)")
        return met.select(F.col("x").alias("s"), F.col("y").alias("o")) if forward else met.select(F.col("y").alias("s"), F.col("x").alias("o"))

    def reached(self, start: str) -> DataFrame:
        """``uri`` of all that a node reaches, by its ranges (forward), or by the ranges that hold its number."""
        nodes, _, _ = self._tables()
        return self.closure(starts=nodes.where(F.col("node") == start).select("node")).select(F.col("o").alias("uri"))
