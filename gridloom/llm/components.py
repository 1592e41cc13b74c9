"""Connected components of an edge table by min-label stars, all in Spark.

Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond"): every edge set stays linear in the input, hot nodes are pre-aggregated by partial
minima and never dealt as a whole to one task (``with_least``), and the number of rounds is
logarithmic in the size of a component. Every round is written to the shared folder, so lineage
stays short and lost executors cost one round at most.

Results for odd input: an edge of a node with itself makes no node; repeated edges count once; an
edge with a null end is left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, with_least

def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an edge; root is the smallest node of its component."""
    now = materialize(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    while True:  # each round that is not the last one lowers some label, so this ends
        # large star: each larger neighbour of u points to the smallest of u and its neighbours
        both = materialize(now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
        low = with_least(both, "u", "v", "m").withColumn("m", F.least("m", "u"))
        large = materialize(low.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        # small star: u and its smaller neighbours point to the smallest of them
        low = with_least(large, "u", "v", "m")
        small = low.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = materialize(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        # stars only: every node has one edge, and no root is the child of another
        left = after.groupBy("u").agg(F.count("*").alias("n"))
        open_ = left.where(F.col("n") > 1).select("u").unionByName(after.select(F.col("v").alias("u")).distinct().join(left.select("u"), "u", "left_semi")).limit(1).count()
        for done in (now, both, large):
            release(done)
        now = after
        if not open_:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
