"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpoint

#: Steps double the reach of labels; so many are enough for chains far beyond any real input.
MAX_STEPS = 64
#: Links of a partition, roughly: few links are kept in few partitions, whatever the session's number.
LINKS_A_PART = 250_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of a link and the least node it reaches, itself included.

    Links may repeat, point either way or at themselves; nulls are left out. No node's
    neighbours are ever gathered: a step takes a minimum for each node (combined before the
    shuffle) and joins it back, and the join splits nodes with very many links.
    """
    edges = (
        links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .distinct()
    )
    edges = checkpoint(edges)
    state = _state(edges)
    parts = max(1, -(-state[0] // LINKS_A_PART))
    for _ in range(MAX_STEPS):
        far = _large_star(edges.coalesce(parts)).coalesce(parts)
        edges = checkpoint(_small_star(far).coalesce(parts))
        if (now := _state(edges)) == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
    tops = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return roots.unionByName(tops).groupBy("node").agg(F.min("root").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours now point at its least neighbour (or at itself)."""
    both = edges.where("hi <> lo").select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    far = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    alone = edges.where("hi = lo")
    return far.unionByName(alone)  # the next step makes them distinct


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours now point at the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    near = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return near.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
