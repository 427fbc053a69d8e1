"""Connected components of a distributed list of links.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond").  Every round is one or two joins on a
node with its smallest neighbour; the smallest neighbour is found by a partial
aggregation, and a hub's links are split by adaptive execution, so no task
holds the links of a node.  Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._storage import discard, materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node that has a link to another node.

    ``links`` has two long columns; order, repeats and self-links do not matter,
    null ends are ignored.  ``component`` is the smallest node that can be reached.
    """
    a, b = links.columns[:2]
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    edges, mark = _kept(edges)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        after, new_mark = _kept(_small_star(_large_star(edges)))
        discard(edges)
        edges = after
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    table = materialize(edges, "links")
    row = table.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return table, (row["n"], row["h"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.min("u")).alias("m"))
    # each larger neighbour of u is linked to the smallest node around u
    return (
        both.where(F.col("v") > F.col("u"))
        .join(least, F.col("u") == F.col("n"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    edges = edges.distinct()
    least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    linked = edges.join(least, F.col("u") == F.col("n"))
    to_least = linked.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
