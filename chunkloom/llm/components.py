"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._shared import written


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): v is a neighbour of u. Links each v, and u, to the least of them all.

    The minimum is aggregated before it meets the pairs, and the join is an equi-join that Spark
    can split, so a centre with very many neighbours does not end in one task.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _star(down)
    to_least = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return to_least.where("u <> v").distinct()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) edges of longs -> (u, v): every node but each component's least, with that least node.

    Stops when a round changes nothing; the tables between rounds are written, so a lost executor
    costs one task and lineage stays short. Raises if max_rounds do not suffice (rounds grow with
    the logarithm of the longest path).
    """
    now = written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now
        before = state
        now = written(_small(_large(now)), "stars")
    raise RuntimeError("components did not settle")
