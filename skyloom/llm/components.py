"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_salted, written


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges (a, b) with the smallest node that it reaches, as a table.

    Each round is a pair of joins on pre-aggregated minima and is written to the shared folder, so a long run neither
    recomputes nor gathers anything in one place. A node with very many neighbours is dealt over several tasks. The
    number of edges never grows. Loops are ignored.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        lowest = lowest.filter("n > 0").select("u", F.least("u", "m").alias("m"), "n")
        large = join_salted(both.filter("v > u"), lowest, ["u"], "n", ["v"], total=state[0])
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        new = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges", state[0])
        new_state = _state(new)
        discard(now)
        now = new
        if new_state == state:
            break
        state = new_state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out = written(roots, "roots", 2 * state[0])
    discard(now)
    return out
