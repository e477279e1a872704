"""Connected components by random contraction, wholly distributed.

Each round maps every vertex to the neighbour (itself included) of the smallest hash under the
round's seed, and rewrites the links between the images. The hash is new each round, so long chains
shrink by a constant factor on average. Rounds end up as small tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import dropped, staged


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b of one type, in any order, repeats and loops allowed.

    Gives vertex, component (one of its vertices) for every vertex that has a link to another. No
    links give no rows; links with a null end are ignored.
    """
    edges, path = staged(links.select("a", "b").where("a <> b").distinct(), "links")
    maps = []
    while not edges.isEmpty():
        seed = F.lit(len(maps) + 1)
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, seed).alias("h"), F.col(c).alias("v"))
        image, _ = staged(
            both.groupBy(F.col("a").alias("vertex")).agg(F.min(rank("b")).alias("m")).select(
                "vertex", F.least("m", rank("vertex"))["v"].alias("image")
            ),
            "images",
        )
        maps.append(image)
        moved = edges.join(image.withColumnRenamed("image", "x"), F.col("a") == F.col("vertex")).drop("vertex")
        moved = moved.join(image.withColumnRenamed("image", "y"), F.col("b") == F.col("vertex"))
        before = path
        edges, path = staged(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        dropped(edges.sparkSession, before)
    if not maps:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    found = maps[0].withColumnRenamed("image", "component")
    for image in maps[1:]:
        step = image.select(F.col("vertex").alias("_v"), "image")
        found = found.join(step, F.col("component") == F.col("_v"), "left").select("vertex", F.coalesce("image", "component").alias("component"))
    return found
