"""Gene networks (gene, neighbour, weight): filters by weight and by differential expression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import benjamini_hochberg, moderated_t_of


def top_edges(edges: DataFrame, least: int = 5, most: int = 50) -> DataFrame:
    """Each gene's strongest edges (ties by neighbour), of genes with enough of them."""
    w = Window.partitionBy("gene")
    ranked = edges.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("weight"), "neighbour")), "_n": F.count("*").over(w)})
    return ranked.filter((F.col("_n") >= least) & (F.col("_r") <= most)).drop("_r", "_n")


def filter_by_weight(edges: DataFrame, weights: DataFrame, min_weight: float = 0.8, min_strength: float = 0.4, least: int = 5, most: int = 50, remove_self: bool = True) -> DataFrame:
    """Edges that are strong enough, to expressed neighbours (gene, weight), the strongest of each gene."""
    kept = edges.filter(F.col("weight") >= min_strength)
    if remove_self:
        kept = kept.filter(F.col("gene") != F.col("neighbour"))
    expressed = weights.filter(F.col("weight") >= min_weight).select(F.col("gene").alias("neighbour"))
    return top_edges(kept.join(expressed, "neighbour", "left_semi").select("gene", "neighbour", "weight"), least, most)


def adjust(tests: DataFrame, by: list[str]) -> DataFrame:
    """tests with q: p adjusted by Benjamini and Hochberg within by; null stays null."""
    known = tests.filter(F.col("p").isNotNull())
    own = Window.partitionBy(*by)
    scaled = known.withColumns({"_r": F.row_number().over(own.orderBy("p")), "_n": F.count("*").over(own)}).withColumn("_s", F.col("p") * F.col("_n") / F.col("_r"))
    q = F.least(F.lit(1.0), F.min("_s").over(own.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)))
    return scaled.withColumn("q", q).drop("_r", "_n", "_s").unionByName(tests.filter(F.col("p").isNull()).withColumn("q", F.lit(None).cast("double")))


def edge_tests(edges: DataFrame, expr: DataFrame, mutations: DataFrame) -> DataFrame:
    """gene, neighbour, weight, n1, n0 (samples with the gene mutated, others), difference of means, s2 (pooled variance), from sums over the samples in which all of a gene's neighbours have a value."""
    samples = expr.select("sample").distinct()
    hit = mutations.select("sample", F.col("hgnc_symbol").alias("gene")).distinct().join(samples, "sample", "left_semi").withColumn("mut", F.lit(True))
    net = edges.join(expr.select(F.col("gene").alias("neighbour")).distinct(), "neighbour", "left_semi").select("gene", "neighbour", "weight")
    values = net.join(expr.filter(F.col("value").isNotNull()).withColumnRenamed("gene", "neighbour"), "neighbour")
    whole = values.groupBy("gene", "sample").agg(F.countDistinct("neighbour").alias("n")).join(net.groupBy("gene").agg(F.countDistinct("neighbour").alias("all")), "gene").filter(F.col("n") == F.col("all")).select("gene", "sample")
    marked = values.join(whole, ["gene", "sample"]).join(hit, ["sample", "gene"], "left").withColumn("mut", F.coalesce("mut", F.lit(False)))
    side = lambda f, mut: f(F.when(F.col("mut") == F.lit(mut), F.col("value")))
    sums = marked.groupBy("gene", "neighbour").agg(F.max("weight").alias("weight"), F.count_if("mut").alias("n1"), F.count_if(~F.col("mut")).alias("n0"), side(F.avg, True).alias("m1"), side(F.avg, False).alias("m0"), side(F.var_pop, True).alias("v1"), side(F.var_pop, False).alias("v0"))
    scatter = F.coalesce(F.col("v1") * F.col("n1"), F.lit(0.0)) + F.coalesce(F.col("v0") * F.col("n0"), F.lit(0.0))
    return sums.select("gene", "neighbour", "weight", "n1", "n0", (F.col("m1") - F.col("m0")).alias("difference"), (scatter / F.nullif(F.col("n1") + F.col("n0") - 2, F.lit(0))).alias("s2"))


def differential_edges(edges: DataFrame, expr: DataFrame, mutations: DataFrame, least_mutated: int = 2) -> DataFrame:
    """gene, neighbour, weight, p, q: moderated t-test of each neighbour between samples with the gene mutated and others.

    The sums are native; a gene's neighbours, a row each, share the moderated variance. A gene with too few mutated samples
    has null p.
    """
    least = max(2, least_mutated)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("neighbour")
        n1, n0 = int(pdf["n1"].iloc[0]), int(pdf["n0"].iloc[0])
        p = moderated_t_of(pdf["difference"].to_numpy(float), pdf["s2"].to_numpy(float), n1, n0) if n1 >= least and n0 >= 1 and n1 + n0 > 2 else np.full(len(pdf), np.nan)
        return pd.DataFrame({"gene": pdf["gene"], "neighbour": pdf["neighbour"], "weight": pdf["weight"], "p": p, "q": benjamini_hochberg(p)})

    return edge_tests(edges, expr, mutations).groupBy("gene").applyInPandas(run, "gene string, neighbour string, weight double, p double, q double")


def filter_by_expression(edges: DataFrame, expr: DataFrame, mutations: DataFrame, limit: float = 0.05, least: int = 5, most: int = 50) -> DataFrame:
    """Edges to neighbours that differ with the gene's mutations, at strength 1; genes with too few of them keep their own edges."""
    tested = differential_edges(edges, expr, mutations)
    good = tested.filter(F.col("q") <= limit).select("gene", "neighbour", F.lit(1.0).alias("weight"), F.col("p"))
    enough = good.groupBy("gene").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("gene")
    ranked = good.join(enough, "gene", "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy("gene").orderBy("p", "neighbour"))).filter(F.col("_r") <= most)
    rest = top_edges(edges.join(enough, "gene", "left_anti"), 0, most)
    return ranked.select("gene", "neighbour", "weight").unionByName(rest.select("gene", "neighbour", "weight"))


def expand(mutated: DataFrame, edges: DataFrame, expressed: DataFrame) -> DataFrame:
    """gene, neighbour, weight: neighbours, with expression, of mutated genes."""
    genes = expressed.select(F.col("gene").alias("neighbour")).distinct()
    return edges.join(mutated.select("gene").distinct(), "gene", "left_semi").filter(F.col("gene") != F.col("neighbour")).join(genes, "neighbour", "left_semi").select("gene", "neighbour", "weight")
