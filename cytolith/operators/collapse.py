"""UMI collapse: noise UMIs join a parent one substitution away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fuzzy import nearest_parent

SHARE, LEAST, MOST = 0.1, 2.0, 5.0


def collapse_umis(molecules: DataFrame, distance: int = 1) -> DataFrame:
    """cell, gene, umi, depth after the collapse within each (cell, gene).

    UMIs deeper than a tenth of the deepest one (2 at least, 5 at most) are parents; each other UMI goes to the parent
    within the distance with the highest depth (ties: first umi), if there is one. Noise is expanded to its neighbours
    and joined on (cell, gene, umi), so even a dominant (cell, gene) is dealt by UMI.
    """
    keys = ["cell", "gene"]
    deepest = molecules.groupBy(*keys).agg(F.max("depth").alias("_deepest"))
    limit = F.greatest(F.least(F.col("_deepest") * F.lit(SHARE), F.lit(MOST)), F.lit(LEAST))
    marked = molecules.join(deepest, keys).withColumn("_parent", F.col("depth") > limit).drop("_deepest")
    parents = marked.filter("_parent").drop("_parent")
    noise = nearest_parent(marked.filter("NOT _parent").drop("_parent"), parents, keys, distance)
    every = parents.select(*keys, "umi", "depth").unionByName(noise.select(*keys, F.coalesce("parent", "umi").alias("umi"), "depth"))
    return every.groupBy(*keys, "umi").agg(F.sum("depth").alias("depth"))
