"""Connected components by alternating star contraction, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.session import use_shared_dir

#: Parts of a node's neighbours.  A hub's edges are dealt to as many tasks.
SALTS = 256


def _with_least(edges: DataFrame) -> DataFrame:
    """edges(u, v) and m, the least v of each u.

    A node's edges are never dealt by the node alone: the least of each part of them is found first, then the least of
    the parts, which goes back to every part; so the work for a hub is spread, and other nodes have a part or a few.
    """
    dealt = edges.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("part"))
    parts = dealt.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"))
    known = parts.select("u", "part").join(least, "u")
    return dealt.join(known, ["u", "part"]).select("u", "v", "m")


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge up at most, and then none down."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(F.col("up") + F.col("down") > 1).where(F.col("up") > 0).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges(u, v): the least node of each component is the root and has no row.

    Each round is checkpointed to the shared folder; the number of rounds grows with the logarithm of the longest path,
    and edges that are stars around their least nodes need none.
    """
    use_shared_dir(edges.sparkSession)
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    now = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct().checkpoint()
    while not _stars(now):
        # large star: a node's higher neighbours go to the least around it
        near = _with_least(now.union(now.select(v.alias("u"), u.alias("v"))))
        high = near.where(v > u).select(v.alias("u"), F.least(u, m).alias("v")).where(u != v).distinct().checkpoint()
        # small star: a node and its lower neighbours go to the least of them
        low = _with_least(high).select(F.explode(F.array(F.struct(v.alias("a"), m.alias("b")), F.struct(u.alias("a"), m.alias("b")))).alias("e"))
        now = low.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).where(u != v).distinct().checkpoint()
    return now.select(u.alias("node"), v.alias("root"))
