"""Connected components of edge tables, by parent hooking and pointer jumping.

Every vertex points to a parent with a label no larger than its own. A round lets each vertex, and its parent, take the
smallest grandparent that a neighbour offers, and shortens each pointer to the grandparent; chains of any length close in
a logarithmic number of rounds in practice. Each round is written to the shared folder, and the one before goes then, so
lineage stays short and a lost executor costs one round at most. All sums are combined before the shuffle and all joins are on vertices, with skewed ones left
to adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.joins import shuffled
from orrery.sources.scratch import dropped, written

#: Up to so many links Spark may broadcast what it takes for small: in files, labels take far less than as rows, and each
#: broadcast table of structs holds a memory page of up to 64 MB, several in each round.
SMALL = 10_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(vertex, component) of every vertex in ``edges``; a component's label is its smallest vertex.

    Vertices may have any orderable type (a struct of group key and vertex, to label many graphs at once). Edges are
    undirected; loops, repeated edges and edges with a null end (which are left out) do no harm.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    links = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
    dealt = shuffled if links.count() > SMALL else lambda table: table
    labels = written(links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("f")).withColumnRenamed("a", "v"), "cc-labels")
    for _ in range(max_rounds):
        held, labels = labels, labels.select("v", "f")
        parents = labels.select(F.col("v").alias("p"), F.col("f").alias("g"))
        known = labels.join(dealt(parents), F.col("f") == F.col("p")).select("v", "f", "g")
        offers = links.join(dealt(known.select(F.col("v").alias("b"), "g")), "b").groupBy("a").agg(F.min("g").alias("m"))
        met = known.join(dealt(offers), F.col("v") == F.col("a"), "left").select("v", "f", F.least("f", "g", "m").alias("m"))
        votes = met.select("v", "f", "m").unionByName(met.select(F.col("f").alias("v"), F.lit(None).cast(labels.schema["f"].dataType).alias("f"), "m"))
        after = written(votes.groupBy("v").agg(F.min("m").alias("f"), F.max("f").alias("before")), "cc-labels")
        done = after.filter(F.col("f") != F.col("before")).isEmpty()
        dropped(held)
        labels = after
        if done:
            dropped(links)
            return labels.select(F.col("v").alias("vertex"), F.col("f").alias("component"))
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
