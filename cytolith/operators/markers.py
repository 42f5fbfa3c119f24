"""Marker-gene scores of cells, rank AUC of clusters and their annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import IGNORED, MITO_RIBO, gene_short_name
from ..session import checkpointed
from .ranks import below

UNASSIGNED = 0.65
GOOD, SEPARABLE = 0.9, 0.55


def reset_gene_names(genes: DataFrame) -> DataFrame:
    """pos, gene, name: the text after the first _; the second gene of a name and later ones keep the full id."""
    short = gene_short_name(F.col("gene"))
    n = F.row_number().over(Window.partitionBy(short).orderBy("pos"))
    return genes.select("pos", "gene", F.when(n > 1, F.col("gene")).otherwise(short).alias("name"))


def split_markers(markers: DataFrame) -> DataFrame:
    """cell_type, gene, sign from marker strings GENE+ and GENE-; a gene that is both is negative."""
    parts = markers.select("cell_type", F.expr("left(marker, length(marker) - 1)").alias("gene"), F.when(F.col("marker").endswith("-"), "-").otherwise("+").alias("sign")).distinct()
    negative = parts.filter("sign = '-'")
    return parts.filter("sign = '+'").join(negative.select("cell_type", "gene"), ["cell_type", "gene"], "left_anti").select("cell_type", "gene", "sign").unionByName(negative)


def marker_scores(counts: DataFrame, markers: DataFrame) -> DataFrame:
    """cell, cell_type, score for every cell and type: log1p of positive less negative counts by 10,000 of the cell's.

    Types with negative markers only score by how far a cell is below the largest sum. Types none of whose markers occur
    in the matrix have no row. Markers are a table of cell types: a few rows a type.
    """
    totals = counts.groupBy("cell").agg(F.sum("count").alias("total"))
    genes = counts.select("gene").distinct()
    used = markers.join(genes, "gene", "left_semi")
    kinds = used.groupBy("cell_type").agg(F.count_if(F.col("sign") == "+").alias("n_pos"))
    signed = used.select("cell_type", "gene", "sign")
    sums = counts.join(signed, "gene").groupBy("cell", "cell_type").agg(F.sum(F.when(F.col("sign") == "+", F.col("count")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("sign") == "-", F.col("count")).otherwise(0)).alias("neg"))
    grid = totals.crossJoin(kinds).join(sums, ["cell", "cell_type"], "left").na.fill(0, ["pos", "neg"])
    most = sums.groupBy("cell_type").agg(F.max("neg").alias("most"))
    raw = F.when(F.col("n_pos") > 0, F.col("pos") - F.col("neg")).otherwise(F.col("most") - F.col("neg"))
    return grid.join(most, "cell_type", "left").select("cell", "cell_type", F.log1p(F.greatest(F.lit(0.0), raw.cast("double") / F.col("total") * 10000)).alias("score"))


def rank_auc(scored: DataFrame, groups: list[str]) -> DataFrame:
    """groups, auc of score against label (boolean): area under the ROC curve, 0.5 if all labels are the same.

    Distinct scores are counted before they are ranked, so ties cost nothing; the ranking is by ranges of scores.
    """
    tied = scored.groupBy(*groups, "score").agg(F.count("*").alias("n"), F.count_if("label").alias("n1"))
    ranked = below(tied, groups, "score", ["n"]).withColumn("rank", F.col("_below_n") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*groups).agg(F.sum(F.col("rank") * F.col("n1")).alias("r1"), F.sum("n1").alias("a"), F.sum("n").alias("all"))
    b = F.col("all") - F.col("a")
    area = (F.col("r1") - F.col("a") * (F.col("a") + 1) / 2) / (F.col("a") * b)
    return sums.select(*groups, F.when((F.col("a") == 0) | (b == 0), 0.5).otherwise(area).alias("auc"))


def cluster_auc(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """cell_type, cluster, auc: each cluster against all others. Counts by score and cluster are ranked once a type."""
    joined = scores.join(clusters, "cell")
    tied = joined.groupBy("cell_type", "score", "cluster").agg(F.count("*").alias("n1"))
    totals = tied.groupBy("cell_type", "score").agg(F.sum("n1").alias("n"))
    ranked = below(totals, ["cell_type"], "score", ["n"]).select("cell_type", "score", (F.col("_below_n") + (F.col("n") + 1) / 2).alias("rank"))
    sums = tied.join(ranked, ["cell_type", "score"]).groupBy("cell_type", "cluster").agg(F.sum(F.col("rank") * F.col("n1")).alias("r1"), F.sum("n1").alias("a"))
    everyone = tied.groupBy("cell_type").agg(F.sum("n1").alias("all"))
    b = F.col("all") - F.col("a")
    area = (F.col("r1") - F.col("a") * (F.col("a") + 1) / 2) / (F.col("a") * b)
    return sums.join(everyone, "cell_type").select("cell_type", "cluster", F.when((F.col("a") == 0) | (b == 0), 0.5).otherwise(area).alias("auc"))


def assign_clusters(auc: DataFrame) -> DataFrame:
    """cluster, cell_type, auc: each cluster's best type (of equal ones the first by name)."""
    best = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("auc"), "cell_type"))
    return auc.withColumn("_r", best).filter("_r = 1").select("cluster", "cell_type", "auc")


class PairAuc:
    """AUCs of any set of clusters against any other, by type, from one query: for each type and two clusters, how many pairs of their cells are in order.

    What the driver holds is types x clusters x clusters numbers.
    """

    def __init__(self, scores: DataFrame, clusters: DataFrame):
        self.names = sorted(r[0] for r in clusters.select("cluster").distinct().collect() if r[0] is not None)
        held = [f"n{k}" for k in range(len(self.names))]
        tied = scores.join(clusters, "cell").groupBy("cell_type", "score").agg(*(F.count_if(F.col("cluster") == name).alias(n) for name, n in zip(self.names, held, strict=True)))
        ranked = below(tied, ["cell_type"], "score", held)
        # of a cell with this score: cells below it twice, and cells level with it, of each cluster
        twice = [2 * F.col(f"_below_{n}") + F.col(n) for n in held]
        rows = ranked.select("cell_type", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(n).alias("n")) for k, n in enumerate(held)])).alias("own"), *(x.alias(f"b{k}") for k, x in enumerate(twice))) if held else None
        found = rows.filter("own.n > 0").groupBy("cell_type", "own.k").agg(F.sum("own.n").alias("n"), *(F.sum(F.col("own.n") * F.col(f"b{k}")).alias(f"u{k}") for k in range(len(held)))).collect() if held else []
        self.size = {(r["cell_type"], self.names[r["k"]]): r["n"] for r in found}
        self.pairs = {(r["cell_type"], self.names[r["k"]], self.names[j]): r[f"u{j}"] / 2 for r in found for j in range(len(held))}
        self.types = sorted({t for t, _ in self.size})

    def auc(self, cell_type: str, positive: set[str], among: set[str]) -> float:
        """Of the positive clusters against the others among these; 0.5 if either side is empty."""
        mine, rest = positive & among, among - positive
        n, m = (sum(self.size.get((cell_type, c), 0) for c in side) for side in (mine, rest))
        return sum(self.pairs.get((cell_type, c, d), 0.0) for c in mine for d in rest) / (n * m) if n and m else 0.5


def reassign_clusters(pairs: PairAuc, table: dict[tuple[str, str], float], assigned: dict[str, str]) -> dict[tuple[str, str], float]:
    """The AUC table (type, cluster) after one pass.

    Each cluster whose best AUC is not good is scored anew for each assigned type, leaving out that type's other clusters;
    not if it is the only cluster of its own type and that type sets it apart from the other type's clusters. The table is
    types by clusters, small, and all AUCs come from the pairs.
    """
    types = list(dict.fromkeys(assigned.values()))
    table = {k: v for k, v in table.items() if k[0] in types}
    names = set(assigned)
    for cluster in assigned:
        fresh: dict[str, float] = {}
        if max(table[t, cluster] for t in types) > GOOD:
            continue
        own = assigned[cluster]
        for t in types:
            rivals = {c for c, x in assigned.items() if x == t}
            if list(assigned.values()).count(own) == 1:
                apart = 0.5 if own == t else pairs.auc(own, {cluster}, rivals | {cluster})
                if apart > SEPARABLE:
                    continue
            fresh[t] = pairs.auc(t, {cluster}, names - (rivals - {cluster}))
        table.update({(t, cluster): v for t, v in fresh.items()})
    return table


def _best(table: dict[tuple[str, str], float], clusters: list[str]) -> dict[str, str]:
    types = sorted({t for t, _ in table})
    return {c: max(types, key=lambda t: (table[t, c], [-ord(x) for x in t])) for c in clusters}


def annotate_clusters(counts: DataFrame, clusters: DataFrame, markers: DataFrame, merge: bool = True, threshold: float = UNASSIGNED, passes: int = 5) -> tuple[DataFrame, DataFrame]:
    """((cell_type, auc), (cell, cluster, label)) of clusters by their markers.

    Assignments are revised until they are stable (five more passes at most); clusters whose best AUC is below the
    threshold are Unassigned; the AUC of a type is that of its merged clusters.
    """
    spark = counts.sparkSession
    pairs = PairAuc(checkpointed(marker_scores(counts, markers)), clusters)
    names, every = sorted({c for _, c in pairs.size}), set(pairs.names)
    table = {(t, c): pairs.auc(t, {c}, every) for t, c in pairs.size}
    assigned = _best(table, names)
    if merge and names:
        table = reassign_clusters(pairs, table, assigned)
        for _ in range(passes):
            new = _best(table, names)
            if new == assigned:
                break
            assigned = new
            table = reassign_clusters(pairs, table, assigned)
        assigned = _best(table, names)
    unsure = {c for c in names if max(v for (_, x), v in table.items() if x == c) < threshold}
    label = {c: "Unassigned" if c in unsure else t for c, t in assigned.items()}
    auc = {t: pairs.auc(t, {c for c, x in label.items() if x == t}, every) for t in dict.fromkeys(label.values()) if t != "Unassigned"}
    if unsure:
        auc["Unassigned"] = sum(table[assigned[c], c] for c in unsure) / len(unsure)
    names_of = spark.createDataFrame(list(label.items()) or [("", "")], "cluster string, label string")
    return spark.createDataFrame(list(auc.items()), "cell_type string, auc double"), clusters.join(F.broadcast(names_of), "cluster", "left").select("cell", "cluster", "label")


def merged_auc(scores: DataFrame, clusters: DataFrame, assigned: DataFrame) -> DataFrame:
    """cell_type, auc of each type's clusters together against the rest."""
    owner = assigned.select("cluster", F.col("cell_type").alias("owner"))
    rows = scores.join(clusters, "cell").join(owner, "cluster").select("cell_type", "score", (F.col("owner") == F.col("cell_type")).alias("label"))
    return rank_auc(rows.join(assigned.select("cell_type").distinct(), "cell_type", "left_semi"), ["cell_type"])


def average_auc(assigned: DataFrame) -> DataFrame:
    """One row, score: sum over types of mean AUC less 0.7; 0 if there are twice as many clusters as types or more."""
    by_type = assigned.groupBy("cell_type").agg(F.avg("auc").alias("mean"), F.count("*").alias("n"))
    return by_type.agg(F.when(F.sum("n") >= 2 * F.count("*"), 0.0).otherwise(F.sum(F.col("mean") - 0.7)).alias("score"))


def top_marker_clusters(tests: DataFrame, removed: str | None = None, ignored: str | None = None, n: int = 15, ratio: float = 0.7, least: float = 0.25, most: float = 1.0, species: str = "human") -> DataFrame:
    """cluster, ratio of clusters with enough good markers among their first n.

    tests: pos (order), cluster, gene, p_val_adj, pct_1, pct_2. Genes that match ``ignored`` are skipped before the first
    n are taken, those that match ``removed`` after.
    """
    removed, ignored = removed or MITO_RIBO[species], ignored or IGNORED[species]
    usable = tests.filter((F.col("p_val_adj") <= 0.01) & ~F.col("gene").rlike(ignored) & (F.col("pct_2") <= most))
    first = usable.withColumn("_r", F.row_number().over(Window.partitionBy("cluster").orderBy("pos"))).filter(F.col("_r") <= n)
    good = first.filter(~F.col("gene").rlike(removed) & (F.col("pct_1") > least)).groupBy("cluster").agg((F.count("*").cast("double") / n).alias("ratio"))
    return good.filter(F.col("ratio") > ratio)
