"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import free, materialize, materialize_counted

#: Rows of one key that a task may take without being split.
HOT_DEGREE = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id that occurs in ``edges(a long, b long)``; the component is its smallest id.

    Each round rewires every edge towards the smallest neighbour; rounds grow
    with the logarithm of a component's size. Nulls and loops are left out.

    A hub may have a third of all edges: the smallest neighbours are combined
    before they are shuffled and written, so both sides of the join with them
    are plain shuffles, which Spark splits at a hot key. The same is done for
    the second star where a node has over ``HOT_DEGREE`` smaller neighbours.
    Counts, checksum and greatest degree are taken while tables are written.
    """
    now, count, digest = materialize_counted(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while count:
        both = now.union(now.select("b", "a"))
        degrees = Observation()
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") < F.col("a")).alias("smaller"))
        least = materialize(least.observe(degrees, F.max("smaller").alias("most")).select("a", F.least("a", "m").alias("m")), "least")
        hot = (degrees.get.get("most") or 0) > HOT_DEGREE
        split = (lambda df, tag: materialize(df, tag)) if hot else (lambda df, tag: df)
        large = split(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-stars")
        root = split(large.groupBy("a").agg(F.min("b").alias("m")), "roots")
        small = large.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new, new_count, new_digest = materialize_counted(small.union(root.select("a", F.col("m").alias("b"))).distinct(), "edges")
        for done in (now, least, large, root):
            free(done)
        settled = (new_count, new_digest) == (count, digest)
        now, count, digest = new, new_count, new_digest
        if settled:
            break
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", F.col("id").alias("component")))
