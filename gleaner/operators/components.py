"""Connected components of an edge table, as class labels (the smallest vertex of the component).

Labels spread by alternating two steps on the edge table itself, large-star and small-star (Kiveris et al., Connected
Components in MapReduce and Beyond, 2014), until nothing changes, however many rounds that takes. The number of rounds grows with the logarithm of the
longest path, a vertex never gathers its neighbours into one task (only minima are aggregated), and lineage is cut with
a reliable checkpoint after each round.

Defined results: edges with a null end are ignored, self-loops give a component of one vertex, an empty table gives an
empty result, repeated edges change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.tables import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``vertex, component`` for every vertex of ``edges``; the component is its smallest vertex."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    vertices = both.select(F.col("u").alias("vertex")).union(both.select("v")).distinct()
    links = cut_lineage(both.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    known = None
    while True:
        # large-star: every larger neighbour of a vertex is linked to the smallest vertex of its neighbourhood
        sym = links.union(links.select("v", "u").toDF("u", "v"))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: every smaller neighbour, and the vertex itself, is linked to the smallest neighbour
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).select("col.*")
        links = cut_lineage(small.filter("u <> v").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == known:
            break
        known = state
    labels = links.groupBy("u").agg(F.min("v").alias("component"))
    return vertices.join(labels, vertices["vertex"] == labels["u"], "left").select("vertex", F.coalesce("component", "vertex").alias("component"))
