"""Error-tolerant barcode joins.

A Hamming join is rewritten as an equality join: the known side is expanded to all strings within the distance. The
expanded table is small (25 strings for a barcode of 6 at distance 1) and goes through Spark's own size check for a
broadcast; a large one is shuffled on the string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import hamming, neighbours


def dictionary(barcodes: DataFrame, distance: int = 1, column: str = "barcode") -> DataFrame:
    """(query, candidates): each string within the distance of a known barcode and the barcodes it may stand for.

    A known barcode stands for itself only. Distances above 1 list only the queries there are, by as many expansions.
    """
    known = barcodes.select(F.col(column).alias("target")).filter(F.col("target").isNotNull()).distinct()
    expanded = known.select("target", F.explode(neighbours(F.col("target"), distance)).alias("query"))
    foreign = expanded.join(known.select(F.col("target").alias("query")), "query", "left_anti")
    own = known.select("target", F.col("target").alias("query"))
    return own.unionByName(foreign).groupBy("query").agg(F.sort_array(F.collect_set("target")).alias("candidates"))


def unique_map(barcodes: DataFrame, distance: int = 1, column: str = "barcode") -> DataFrame:
    """(query, target) where only one known barcode is near."""
    return dictionary(barcodes, distance, column).filter(F.size("candidates") == 1).select("query", F.col("candidates")[0].alias("target"))


def correct(df: DataFrame, column: str, barcodes: DataFrame, distance: int = 1, out: str = "corrected") -> DataFrame:
    """df with the unique known barcode near the column, or null."""
    pairs = unique_map(barcodes, distance, barcodes.columns[0]).withColumnsRenamed({"query": "__query", "target": out})
    return df.join(pairs, df[column] == pairs["__query"], "left").drop("__query")


def correct_components(df: DataFrame, column: str, dictionaries: list[DataFrame | None], distance: int = 1, out: str = "corrected") -> DataFrame:
    """df with its composite barcode corrected component by component; null if a component with a dictionary can't be.

    A missing dictionary (None, or fewer dictionaries than components) passes its component through.
    """
    parts = []
    for k, known in enumerate(dictionaries):
        df = df.withColumn(f"__part{k}", F.get(F.split(column, "-"), F.lit(k)))
        if known is not None:
            df = correct(df, f"__part{k}", known, distance, f"__fixed{k}").drop(f"__part{k}").withColumnRenamed(f"__fixed{k}", f"__part{k}")
        parts.append(f"__part{k}")
    rest = F.slice(F.split(column, "-"), len(dictionaries) + 1, 100)
    whole = F.array_join(F.concat(F.array(*parts), rest), "-")
    missing = reduce(lambda a, b: a | b, [F.col(p).isNull() for p in parts], F.lit(False))
    return df.withColumn(out, F.when(~missing, whole)).drop(*parts)


def component_index(composites: DataFrame, column: str = "barcode") -> DataFrame:
    """(position, component, composites): which whole barcodes hold a component."""
    return composites.select(column, F.posexplode(F.split(column, "-")).alias("position", "component")).groupBy("position", "component").agg(F.sort_array(F.collect_set(column)).alias("composites"))


def correct_constrained(df: DataFrame, column: str, composites: DataFrame, distance: int = 1, out: str = "corrected") -> DataFrame:
    """df with each component of its composite barcode corrected to a known one; null if one can't be.

    If several candidates are near, the one in the known composite that is nearest to the whole barcode wins, if it is
    the only one at that distance. Work is done on distinct barcodes.
    """
    known = composites.select(F.col(composites.columns[0]).alias("composite")).distinct()
    queries = df.select(F.col(column).alias("whole")).filter(F.col("whole").isNotNull()).distinct()
    known_parts = known.select("composite", F.posexplode(F.split("composite", "-")).alias("position", "target"))
    members = known_parts.select("position", "target").distinct()
    expanded = members.select("position", "target", F.explode(neighbours(F.col("target"), distance)).alias("component"))
    foreign = expanded.join(members.select("position", F.col("target").alias("component")), ["position", "component"], "left_anti")
    table = members.withColumn("component", F.col("target")).unionByName(foreign)
    asked = queries.select("whole", F.posexplode(F.split("whole", "-")).alias("position", "component"))
    near = asked.join(table, ["position", "component"]).withColumn("n", F.count("*").over(Window.partitionBy("whole", "position")))
    tied = near.filter("n > 1").join(known_parts, ["position", "target"]).groupBy("whole", "position", "target").agg(F.min(hamming(F.col("whole"), F.col("composite"))).alias("d"))
    best = tied.withColumn("r", F.rank().over(Window.partitionBy("whole", "position").orderBy("d"))).filter("r = 1").groupBy("whole", "position").agg(F.count("*").alias("n"), F.min("target").alias("target")).filter("n = 1")
    fixed = near.filter("n = 1").select("whole", "position", "target").unionByName(best.select("whole", "position", "target"))
    whole = fixed.groupBy("whole").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "target"))), lambda x: x["target"]), "-").alias(out), F.count("*").alias("parts"))
    whole = whole.filter(F.col("parts") == F.size(F.split("whole", "-"))).drop("parts").withColumnRenamed("whole", "__whole")
    return df.join(whole, df[column] == whole["__whole"], "left").drop("__whole")


def merge_primers(pairs: DataFrame, reverse: bool = False) -> DataFrame:
    """(query, target) from (dt, random): the random-hexamer barcode stands for the oligo-dT one of its well; unique ones only.

    Reversed, an oligo-dT barcode stands for itself and the random one, so only wells whose two are the same are unique.
    """
    if reverse:
        table = pairs.select(F.col("dt").alias("query"), F.col("dt").alias("target")).union(pairs.select(F.col("dt").alias("query"), F.col("random").alias("target")))
    else:
        table = pairs.select(F.col("dt").alias("query"), F.col("dt").alias("target")).union(pairs.select(F.col("random").alias("query"), F.col("dt").alias("target")))
    return table.groupBy("query").agg(F.collect_set("target").alias("t")).filter(F.size("t") == 1).select("query", F.col("t")[0].alias("target"))


def near_pairs(barcodes: DataFrame, distance: int = 1, column: str = "barcode") -> DataFrame:
    """(a, b) with a < b: pairs of distinct barcodes of one length within the distance, by joining expansions."""
    known = barcodes.select(F.col(column).alias("a")).distinct()
    expanded = known.select("a", F.explode(neighbours(F.col("a"), distance)).alias("b"))
    return expanded.filter(F.col("a") < F.col("b")).join(known.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")


def nearest_parent(noise: DataFrame, parents: DataFrame, keys: list[str], distance: int = 1) -> DataFrame:
    """noise with parent: the parent of the same keys, within the distance, with the highest depth (ties: first umi)."""
    asked = noise.select(*keys, "umi").distinct().select(*keys, "umi", F.explode(neighbours(F.col("umi"), distance)).alias("p_umi"))
    found = asked.join(parents.select(*keys, F.col("umi").alias("p_umi"), F.col("depth").alias("p_depth")), [*keys, "p_umi"])
    best = found.groupBy(*keys, "umi").agg(F.min(F.struct((-F.col("p_depth")).alias("d"), "p_umi"))["p_umi"].alias("parent"))
    return noise.join(best, [*keys, "umi"], "left")


def lookup(df: DataFrame, column: str, table: DataFrame, key: str, value: str) -> DataFrame:
    """df with the value of its column in a table, or null (the gene map)."""
    side = table.select(F.col(key).alias("__key"), F.col(value))
    return df.join(side, df[column] == side["__key"], "left").drop("__key")


def hamming_of(a: str, b: str) -> Column:
    return hamming(F.col(a), F.col(b))
