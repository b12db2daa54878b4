"""Connected components by alternating star contraction.

Each round rewires the edge list: *large-star* links every larger neighbour of
a node to the smallest node of its neighbourhood, *small-star* does the same
for the smaller neighbours and the node itself.  Both keep the components and
end in stars round the smallest node; the number of rounds grows with the
square of the logarithm of the nodes at worst, whatever the order of the ids
along a chain, so there is no cap on rounds.  Minima combine map-side and hubs
are joined, not gathered; the links of one hub go through one task, a row at a
time (AQE does not split a join with an aggregate on its own shuffle).  Every round is written with a reliable ``checkpoint()``.
The rounds run on numbers of the nodes, given once (and written, so that they
stay), for ids may be long; a component's label is found by id at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

LAST_RUN: dict = {}


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # every node keeps its link to the smallest; larger neighbours move to it
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, label) for every node of ``edges``: label is the smallest node
    of its component.  Self links count as nodes of their own.  Null ends are
    ignored.  The rounds taken are kept in ``LAST_RUN``."""
    checkpoint_dir(edges.sparkSession)
    raw = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").checkpoint()
    nodes = (raw.select(F.explode(F.array("a", "b")).alias("node")).distinct()
             .withColumn("n", F.monotonically_increasing_id()).checkpoint())
    links = raw.where("a != b").distinct()
    for end in "ab":
        links = links.join(nodes.select(F.col("node").alias(end), F.col("n").alias(f"n{end}")), end).drop(end)
    now = links.select(F.greatest("na", "nb").alias("u"), F.least("na", "nb").alias("v")).distinct().checkpoint()
    before, rounds = _state(now), 0
    while before[0]:
        now = _small_star(_large_star(now)).checkpoint()
        rounds += 1
        after = _state(now)
        if after == before:
            break
        before = after
    LAST_RUN["rounds"] = rounds
    # nodes without a link to another are roots of their own
    rooted = (nodes.join(now.select(F.col("u").alias("n"), F.col("v").alias("root")), "n", "left")
              .select("node", F.coalesce("root", "n").alias("root")))
    least = rooted.groupBy("root").agg(F.min("node").alias("label"))
    return rooted.join(least, "root").select("node", "label")
