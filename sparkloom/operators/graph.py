"""Call graphs: projection to modules, levels, order."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def module_edges(calls: DataFrame, modules: DataFrame) -> DataFrame:
    """Calls (src, dst) between functions as distinct edges between their modules (function, module); none to itself."""
    a, b = modules.toDF("src", "from_module"), modules.toDF("dst", "to_module")
    return calls.join(a, "src").join(b, "dst").filter("from_module <> to_module").select("from_module", "to_module").distinct()


def waves(nodes: DataFrame, edges: DataFrame, node: str, src: str, dst: str) -> DataFrame:
    """(node, wave): nodes that no remaining node points to go first; what cycles hold back forms one last wave.

    A wave is one anti-join of the remaining nodes with the remaining edges' ends; what remains is written between
    rounds (checkpoint), so that plans do not grow with the number of waves.
    """
    left, links = nodes.select(node), edges.select(F.col(src).alias("__s"), F.col(dst).alias("__d"))
    done, wave = [], 0
    while True:
        free = left.join(links.select(F.col("__d").alias(node)).distinct(), node, "left_anti").checkpoint()
        if free.isEmpty():
            break
        done.append(free.withColumn("wave", F.lit(wave)))
        left = left.join(free, node, "left_anti").checkpoint()
        links = links.join(free, links["__s"] == free[node], "left_anti").checkpoint()
        wave += 1
    done.append(left.withColumn("wave", F.lit(wave)))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def in_order(levels: DataFrame, node: str) -> DataFrame:
    """(node, place) of (node, wave): wave by wave, within a wave by node. What cycles hold back comes last, by node.

    A wave's nodes are counted from the number of nodes in waves before it, so that no task sorts all of them.
    """
    sizes = levels.groupBy("wave").agg(F.count(F.lit(1)).alias("__n"))  # a row for each wave
    before = F.coalesce(F.sum("__n").over(Window.orderBy("wave").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = levels.withColumn("__r", F.row_number().over(Window.partitionBy("wave").orderBy(node)))
    first = F.broadcast(sizes.select("wave", before.alias("__b")))
    return ranked.join(first, "wave").select(node, (F.col("__b") + F.col("__r") - 1).alias("place"))


def topological_order(edges: list[tuple[str, str]]) -> list[str]:
    """Callers before callees, first come first served, nodes that become free together by name; a cycle gives all by name.

    For graphs that fit the driver: the order of a queue is a matter of one sequence.
    """
    follow: dict[str, set[str]] = {}
    waits: dict[str, int] = {}
    for a, b in set(edges):
        follow.setdefault(a, set()).add(b)
        waits.setdefault(a, 0)
        waits[b] = waits.get(b, 0) + 1
    queue, out = deque(sorted(n for n, w in waits.items() if not w)), []
    while queue:
        out.append(at := queue.popleft())
        freed = []
        for b in follow.get(at, ()):
            waits[b] -= 1
            if not waits[b]:
                freed.append(b)
        queue.extend(sorted(freed))
    return out if len(out) == len(waits) else sorted(waits)


def dependencies_of(edges: DataFrame, src: str, name: str) -> DataFrame:
    return edges.filter(F.col(src) == name)


def order_frame(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "place int, name string")
