"""Connected components of a graph kept as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.tables import durable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every end of a link the smallest id it is connected with.

    Each round links every id and its neighbours to the smallest id among them
    (alternately for the larger and for the smaller neighbours), until nothing
    changes; a chain of n links takes in the order of log n rounds. Both steps
    are plain group-bys, so a hub is aggregated on the map side first and its
    neighbours never meet in one task. Links with a null end and links of an id
    to itself are ignored; repeated links count once; no links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
    edges = durable(edges.where("x is not null and y is not null and u <> v").select("u", "v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = durable(small.where("u <> v").distinct())
        if edges.exceptAll(new).isEmpty() and new.exceptAll(edges).isEmpty():
            break
        edges = new
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
