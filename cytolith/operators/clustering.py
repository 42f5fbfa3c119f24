"""Cells to clusters, differential genes, and choice among models.

Normalisation, gene choice, components, neighbours, communities, tests and silhouettes are distributed. Communities are
found by local moves in rounds, not one node after the other, so clusters differ in detail from other tools of the kind.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.dna import MITO_RIBO
from .graph import MOST_LEVELS, MOST_ROUNDS, communities, nearest, shared_neighbours
from .markers import annotate_clusters, assign_clusters, average_auc, cluster_auc, marker_scores
from .matrix import axis
from .ranks import below
from ..session import checkpointed


def normalise(counts: DataFrame, scale: float = 1e4, tpm: bool = False) -> DataFrame:
    """cell, gene, value: log1p of counts by ``scale`` of the cell's, or of the values as they are."""
    if tpm:
        return counts.select("cell", "gene", F.log1p(F.col("count").cast("double")).alias("value"))
    total = F.sum("count").over(Window.partitionBy("cell"))
    return counts.select("cell", "gene", F.log1p(F.col("count") / total * scale).alias("value"))


def expressed(counts: DataFrame, min_cells: int = 3, min_genes: int = 1) -> DataFrame:
    """Counts of genes seen in enough cells and cells with enough genes."""
    seen = counts.filter("count > 0")
    genes = seen.groupBy("gene").agg(F.count("*").alias("n")).filter(F.col("n") >= min_cells)
    cells = seen.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") >= min_genes)
    return counts.join(genes.select("gene"), "gene", "left_semi").join(cells.select("cell"), "cell", "left_semi")


def variable_genes(values: DataFrame, low: float = 0.0125, high: float = 3.0, dispersion: float = 0.5, bins: int = 20) -> DataFrame:
    """gene, mean, z: genes of middling log mean whose log dispersion stands out in its bin of means. Absent cells are zeros."""
    n = values.select("cell").distinct().count()
    plain = F.expm1("value")
    stats = values.groupBy("gene").agg((F.sum(plain) / n).alias("m"), (F.sum(plain * plain) / n).alias("m2"))
    var = (F.col("m2") - F.col("m") * F.col("m")) * n / max(n - 1, 1)
    shaped = stats.filter("m > 0").select("gene", F.log1p("m").alias("mean"), F.log(F.greatest(var / F.col("m"), F.lit(1e-12))).alias("d"))
    top = shaped.agg(F.max("mean").alias("top"))
    binned = shaped.join(F.broadcast(top)).withColumn("bin", F.floor(F.col("mean") / F.greatest("top", F.lit(1e-9)) * bins))
    by_bin = binned.groupBy("bin").agg(F.avg("d").alias("a"), F.stddev_samp("d").alias("s"))
    z = (F.col("d") - F.col("a")) / F.nullif(F.col("s"), F.lit(0.0))
    return binned.join(by_bin, "bin").select("gene", "mean", F.coalesce(z, F.lit(0.0)).alias("z")).filter((F.col("mean") > low) & (F.col("mean") < high) & (F.col("z") > dispersion))


def components(values: DataFrame, genes: DataFrame, n_pc: int = 50, rounds: int = 6, extra: int = 10, seed: int = 0) -> DataFrame:
    """cell, pc (vector) from scaled values of all these genes.

    The leading components by subspace iteration: the cells' rows stay sparse and where they are, each round multiplies
    them with a matrix of genes x (n_pc + extra) and back, and only matrices of that size are summed up and come to the
    driver. There is no matrix of genes x genes, and genes are as many as an annotation has.
    """
    index = axis(genes, "gene", "k").select("gene", (F.col("k") - 1).cast("int").alias("k"))
    used = values.join(index, "gene")
    n = values.select("cell").distinct().count()
    stats = used.groupBy("k").agg((F.sum("value") / n).alias("m"), (F.sum(F.col("value") * F.col("value")) / n).alias("m2"))
    spread = F.sqrt(F.greatest((F.col("m2") - F.col("m") * F.col("m")) * n / max(n - 1, 1), F.lit(1e-12)))
    scaled = checkpointed(stats.select("k", "m", spread.alias("s")))
    width = index.count()
    mean = np.zeros(max(width, 1))
    for r in scaled.select("k", (F.col("m") / F.col("s")).alias("m")).collect():  # a number for each gene
        mean[r["k"]] = r["m"]
    rows = checkpointed(used.join(scaled.select("k", "s"), "k").groupBy("cell").agg(F.collect_list("k").alias("k"), F.collect_list(F.col("value") / F.col("s")).alias("v")))
    size = max(1, min(n_pc, width))
    wide = min(size + extra, max(width, 1))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((max(width, 1), wide)))[0]

    def product(batch: pa.RecordBatch, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Genes and values of a batch's entries, the row of each, and the centred rows times q."""
        k, v = batch.column(0), batch.column(1)
        sizes = np.diff(k.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        gene, value = k.flatten().to_numpy(), v.flatten().to_numpy()
        out = np.zeros((len(sizes), q.shape[1]))
        for j in range(q.shape[1]):
            out[:, j] = np.bincount(row, value * q[gene, j], len(sizes))
        return gene, value, row, out - mean @ q

    def back(q: np.ndarray):
        def run(batches):
            total, held = np.zeros((len(mean), q.shape[1])), np.zeros(q.shape[1])
            for batch in batches:
                gene, value, row, y = product(batch, q)
                for j in range(q.shape[1]):
                    total[:, j] += np.bincount(gene, value * y[row, j], len(mean))
                held += y.sum(0)
            total -= np.outer(mean, held)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mean))), pa.array(total.tolist(), pa.list_(pa.float64()))], ["k", "z"])

        return run

    for _ in range(rounds):
        sums = rows.select("k", "v").mapInArrow(back(basis), "k long, z array<double>").groupBy("k").agg(*(F.sum(F.col("z")[j]).alias(f"z{j}") for j in range(basis.shape[1])))
        z = np.zeros_like(basis)
        for r in sums.collect():
            z[r["k"]] = r[1:]
        basis, strength, turn = np.linalg.svd(z, full_matrices=False)
    # the sign of a component is free: its largest weight is positive
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1, 1)
    axes = basis[:, :size]

    def project(batches):
        for batch in batches:
            # not centred: the bisection starts from small moves in proportion to a mean, which must not be 0
            y = product(batch.select([1, 2]), axes)[3] + mean @ axes
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y.tolist(), pa.list_(pa.float64()))], ["cell", "pc"])

    return rows.select("cell", "k", "v").mapInArrow(project, "cell string, pc array<double>").select("cell", array_to_vector("pc").alias("pc"))


def cluster_cells(counts: DataFrame, resolution: float = 1.0, n_pc: int = 50, variable: bool = False, species: str = "human", tpm: bool = False, min_cells: int = 3, min_genes: int = 1, seed: int = 0, neighbours: int = 30, method: str = "graph", rounds: int = MOST_ROUNDS, levels: int = MOST_LEVELS) -> DataFrame:
    """cell, cluster (string), pc. method: graph (communities of the graph of shared neighbours) or kmeans (ten clusters per unit of resolution).

    Clusters of the graph are numbered by falling size; a cell without a like neighbour is one of its own.
    """
    if method not in ("graph", "kmeans"):
        raise ValueError(f"unknown method {method!r}")
    values = normalise(expressed(counts, min_cells, min_genes), tpm=tpm)
    genes = variable_genes(values) if variable else values.select("gene").distinct().filter(~F.col("gene").rlike(MITO_RIBO[species]))
    points = checkpointed(components(values, genes, n_pc))
    if method == "kmeans":
        model = BisectingKMeans(k=max(2, round(10 * resolution)), featuresCol="pc", predictionCol="c", seed=seed, minDivisibleClusterSize=2.0).fit(points)
        return model.transform(points).select("cell", F.col("c").cast("string").alias("cluster"), "pc")
    found = communities(shared_neighbours(checkpointed(nearest(points, neighbours))), resolution, rounds, levels)
    placed = points.join(found.select(F.col("node").alias("cell"), "community"), "cell", "left").withColumn("community", F.coalesce("community", "cell"))
    sizes = placed.groupBy("community").agg(F.count("*").alias("n")).withColumn("cluster", (F.row_number().over(Window.orderBy(F.desc("n"), "community")) - 1).cast("string"))  # a row for each cluster
    return placed.join(sizes, "community").select("cell", "cluster", "pc")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """cluster, n."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("n"))


def silhouette(clustered: DataFrame) -> float:
    """Mean silhouette (squared Euclidean distance) of pc by cluster."""
    rows = clustered.withColumn("c", F.col("cluster").cast("double"))
    return float(ClusteringEvaluator(featuresCol="pc", predictionCol="c").evaluate(rows))


@F.pandas_udf(DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))


def rank_sum_tests(values: DataFrame, clusters: DataFrame, min_share: float = 0.25, min_log_change: float = 0.25) -> DataFrame:
    """cluster, gene, z, p_val, p_val_adj, avg_change, pct_1, pct_2, pos: each cluster against the rest.

    Wilcoxon rank sums with tie correction and normal tails; absent values are zeros and rank below all others. Counts by
    gene, value and cluster are made first, so ranking sees distinct values only, by ranges. The result has a row for each
    gene and cluster, and so has the grid of cells without a value.
    """
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n1"))
    n = clusters.count()
    seen = values.filter("value > 0").join(clusters, "cell")
    genes = seen.select("gene").distinct()
    present = seen.groupBy("gene", "value", "cluster").agg(F.count("*").alias("c"))
    zeros = genes.crossJoin(sizes).join(present.groupBy("gene", "cluster").agg(F.sum("c").alias("s")), ["gene", "cluster"], "left").select("gene", F.lit(0.0).alias("value"), "cluster", (F.col("n1") - F.coalesce("s", F.lit(0))).alias("c"))
    every = present.unionByName(zeros)
    tied = every.groupBy("gene", "value").agg(F.sum("c").alias("t"))
    ranked = below(tied, ["gene"], "value", ["t"]).select("gene", "value", "t", (F.col("_below_t") + (F.col("t") + 1) / 2).alias("rank"))
    tie = ranked.groupBy("gene").agg(F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("tie"))
    change = F.expm1("value") * F.col("c")
    by = every.join(ranked.drop("t"), ["gene", "value"]).groupBy("gene", "cluster").agg(F.sum(F.col("rank") * F.col("c")).alias("r"), F.sum(F.when(F.col("value") > 0, F.col("c")).otherwise(0)).alias("k"), F.sum(change).alias("e"))
    whole = by.groupBy("gene").agg(F.sum("k").alias("k_all"), F.sum("e").alias("e_all"))
    rows = by.join(whole, "gene").join(tie, "gene").join(sizes, "cluster").withColumn("n2", n - F.col("n1")).filter("n2 > 0")
    u = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2 - F.col("n1") * F.col("n2") / 2
    var = F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("tie") / (n * max(n - 1, 1)))
    scored = rows.select("cluster", "gene", F.coalesce(u / F.sqrt(F.nullif(var, F.lit(0.0))), F.lit(0.0)).alias("z"), (F.log1p(F.col("e") / F.col("n1")) - F.log1p((F.col("e_all") - F.col("e")) / F.col("n2"))).alias("avg_change"), (F.col("k") / F.col("n1")).alias("pct_1"), ((F.col("k_all") - F.col("k")) / F.col("n2")).alias("pct_2"))
    kept = scored.filter((F.greatest("pct_1", "pct_2") >= min_share) & (F.col("avg_change") >= min_log_change)).withColumn("p_val", _two_sided("z"))
    n_genes = genes.count()
    order = Window.partitionBy("cluster").orderBy("p_val", F.desc("avg_change"), "gene")
    return kept.select("*", F.least(F.lit(1.0), F.col("p_val") * n_genes).alias("p_val_adj"), F.row_number().over(order).alias("pos"))


def extract_best(rows: list[dict], least: int = 3, most: int = 20) -> tuple[int, int]:
    """(by silhouette, by average AUC): positions of the best models, among those with a fitting number of clusters if any has."""
    fits = [k for k, r in enumerate(rows) if least <= r["n"] <= most] or list(range(len(rows)))
    return max(fits, key=lambda k: (rows[k]["silhouette"], -k)), max(fits, key=lambda k: (rows[k]["auc"], -k))


def select_model(counts: DataFrame, markers: DataFrame, neighbours=(15, 30), resolutions=(0.8, 1.0, 1.2, 1.5), n_pcs=(20, 30, 50, 100), variable=(True, False), least: int = 3, most: int = 20, **options) -> dict:
    """The best of a grid of models: the better, by annotation, of that with the best silhouette and that with the best AUC.

    The grid is a loop on the driver over a few dozen models; each model's work is distributed.
    """
    rows: list[dict] = []
    scores = checkpointed(marker_scores(counts, markers))
    for k, r, n_pc, v in product(neighbours, resolutions, n_pcs, variable):
        clustered = checkpointed(cluster_cells(counts, r, n_pc, v, neighbours=k, **options))
        n = clustered.select("cluster").distinct().count()
        row = {"neighbours": k, "resolution": r, "n_pc": n_pc, "variable": v, "n": n, "silhouette": -1.0, "auc": 0.0, "clusters": clustered.select("cell", "cluster")}
        if least <= n <= most:
            row["silhouette"] = silhouette(clustered)
            row["auc"] = average_auc(assign_clusters(cluster_auc(scores, row["clusters"]))).first()["score"] or 0.0
        rows.append(row)
    best = [rows[k] for k in extract_best(rows, least, most)]
    gains = []
    for row in best:
        auc, row["labels"] = annotate_clusters(counts, row["clusters"], markers)
        values = [x["auc"] for x in auc.collect()]
        gains.append(sum(values) - 0.5 * len(values))
    return best[0] if gains[0] > gains[1] else best[1]
