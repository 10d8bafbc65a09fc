"""Connected components of a link table, as rounds of joins and minima.

Each round hooks the label of every linked pair to the smaller one and then halves the paths, so
the number of rounds follows the logarithm of the longest chain.  Every round is a written table;
minima are pre-aggregated before their shuffle, and joins leave hot labels to Spark's skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmill.llm.common import written


def smallest_labels(links: DataFrame, label: str = "component") -> DataFrame:
    """``node`` and the smallest node it is linked with, for all nodes of ``links`` (a, b).

    Nodes are any orderable type; rows with a null end are ignored; repeated, reversed and
    self links do not matter; an empty table gives an empty result.
    """
    both = links.where("a IS NOT NULL AND b IS NOT NULL")
    # Edges between labels, larger to smaller.  Large-star and small-star rounds keep components.
    edges = written(
        both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct(),
        "links",
    )
    last = None
    while True:
        # Large star: the larger neighbours of a node go to its smallest neighbour.
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("node"), F.least("u", "m").alias("m")
        )
        large = (
            sides.where("v > u")
            .join(least, F.col("u") == F.col("node"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # Small star: a node and its smaller neighbours go to the smallest of them.
        tops = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(tops, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = tops.select("u", F.col("m").alias("v"))
        edges = written(small.unionByName(own).distinct(), "links")
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == last:
            break
        last = state
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias(label))
    roots = leaves.select(F.col(label).alias("node"), label).distinct()
    return leaves.unionByName(roots)
