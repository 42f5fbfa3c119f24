"""Expression matrices in long form (sample, gene, value): normalisation, imputation, fitted distributions, weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import boxplot_fences, gauss_log_density, leaf_order, minimise, student_log_density
from ..session import checkpointed
from .matrix import axis
from .mixture import fit, fit_expression

#: Variant types that count as strong (fixed values); NONSTOP only if asked for.
STRONG = ("HOMD", "HLAMP", "NONSENSE", "FRAMESHIFT", "NOSTOP", "SPLICE", "STARTGAINED", "CNV", "FUSION")
COPY_NUMBER = ("HOMD", "HLAMP", "CNV")
DISTRIBUTION = "gene string, sample string, p_down double, p_neutral double, p_up double, share array<double>, mu array<double>, sigma array<double>, nu double, aic double, bic double"


def drop_missing(df: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Without genes, then samples, of whose values this share or more is missing (null)."""
    for axis in ("gene", "sample"):
        lost = df.groupBy(axis).agg((F.count_if(F.col("value").isNull()) >= ratio * F.count("*")).alias("_lost")).filter("_lost")
        df = df.join(lost.select(axis), axis, "left_anti")
    return df


def missing_share(df: DataFrame) -> DataFrame:
    """gene, n_missing, n."""
    return df.groupBy("gene").agg(F.count_if(F.col("value").isNull()).alias("n_missing"), F.count("*").alias("n"))


def quantile_normalise(df: DataFrame) -> DataFrame:
    """Each sample's values replaced by the mean, over samples, of the values of their rank; ties get the mean of theirs."""
    order = Window.partitionBy("sample").orderBy("value", "gene")
    ranked = df.withColumn("_r", F.row_number().over(order))
    means = ranked.groupBy("_r").agg(F.avg("value").alias("_m"))
    placed = ranked.join(means, "_r")
    return placed.select("sample", "gene", F.avg("_m").over(Window.partitionBy("sample", "value")).alias("value"))


def ideal_fourths(df: DataFrame, by: str, column: str = "value") -> DataFrame:
    """by, n, ql, qu: machine quartiles, from ranks (no group is collected)."""
    w = Window.partitionBy(by)
    x = df.filter(F.col(column).isNotNull()).select(by, F.col(column).alias("x"), F.row_number().over(w.orderBy(column)).alias("r"), F.count("*").over(w).alias("n"))
    at = F.col("n") / 4 + F.lit(5).cast("double") / 12
    x = x.withColumn("j", F.floor(at)).withColumn("g", at - F.col("j"))
    pick = lambda k: F.max(F.when(F.col("r") == k, F.col("x")))
    j, k = F.greatest("j", F.lit(1)), F.least(F.col("n") - F.col("j") + 1, F.col("n"))
    row = x.groupBy(by).agg(F.max("n").alias("n"), F.max("g").alias("g"), pick(j).alias("a"), pick(F.least(F.col("j") + 1, F.col("n"))).alias("b"), pick(k).alias("c"), pick(F.greatest(F.col("n") - F.col("j"), F.lit(1))).alias("d"))
    return row.select(by, "n", ((1 - F.col("g")) * F.col("a") + F.col("g") * F.col("b")).alias("ql"), ((1 - F.col("g")) * F.col("c") + F.col("g") * F.col("d")).alias("qu"))


def boxplot_outliers(df: DataFrame, by: str, column: str = "value") -> DataFrame:
    """Rows beyond 1.5 times the range of the machine quartiles."""
    q = ideal_fourths(df, by, column).select(F.col(by).alias("_by"), "ql", "qu")
    reach = 1.5 * (F.col("qu") - F.col("ql"))
    return df.join(q, F.col(by) == F.col("_by")).filter((F.col(column) < F.col("ql") - reach) | (F.col(column) > F.col("qu") + reach)).drop("_by", "ql", "qu")


def impute_knn(df: DataFrame, k: int = 10, ratio: float = 0.5, block: int = 1024) -> DataFrame:
    """Missing values of a gene filled with the mean of that sample in its k nearest genes (ties by name).

    Distances are root mean squares over samples that both genes have. Genes are dealt into blocks of about so many; the
    genes with missing values are compared with all genes block by block, and the nearest of all blocks are taken, so the
    block's size changes nothing in the result. A sample that no near gene has gets its mean.
    """
    usable = checkpointed(drop_missing(df, ratio).filter(F.col("value").isNotNull()))
    samples = axis(usable, "sample", "_s")
    n_samples, n_genes = samples.count(), usable.select("gene").distinct().count()
    blocks = max(1, -(-n_genes // block))
    vectors = usable.join(samples, "sample").groupBy("gene").agg(F.collect_list(F.struct(F.col("_s").cast("int").alias("s"), "value")).alias("v"))
    vectors = checkpointed(vectors.withColumn("b", F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int")))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    asked = vectors.filter(F.size("v") < n_samples).select("gene", "v", F.col("b").alias("q"), F.explode(every).alias("t"))
    known = vectors.select("gene", "v", F.col("b").alias("t"), F.explode(every).alias("q"))

    def dense(pdf: pd.DataFrame) -> np.ndarray:
        x = np.full((len(pdf), n_samples), np.nan)
        for i, v in enumerate(pdf["v"]):
            for e in v:
                x[i, e["s"] - 1] = e["value"]
        return x

    def nearest(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        others = others.sort_values("gene")
        names, x, y = others["gene"].to_numpy(), dense(mine), dense(others)
        has, rows = ~np.isnan(y), []
        for gene, row in zip(mine["gene"], x, strict=True):
            own = ~np.isnan(row)
            both = has & own
            n = both.sum(1)
            d = np.where(both, y - row, 0.0)
            with np.errstate(invalid="ignore", divide="ignore"):
                distance = np.sqrt((d * d).sum(1) / n)
            order = [g for g in np.argsort(distance, kind="stable") if n[g] and names[g] != gene]
            for j in np.flatnonzero(~own):
                rows += [(gene, j + 1, float(distance[g]), names[g], float(y[g, j])) for g in [g for g in order if has[g, j]][:k]]
        return pd.DataFrame(rows, columns=["gene", "_s", "distance", "near", "value"])

    found = asked.groupBy("q", "t").cogroup(known.groupBy("q", "t")).applyInPandas(nearest, "gene string, _s long, distance double, near string, value double")
    first = F.row_number().over(Window.partitionBy("gene", "_s").orderBy("distance", "near"))
    filled = found.withColumn("_r", first).filter(F.col("_r") <= k).groupBy("gene", "_s").agg(F.avg("value").alias("_near"))
    means = usable.groupBy("sample").agg(F.avg("value").alias("_mean"))
    holes = asked.filter("t = 0").select("gene", F.explode(F.array_except(F.sequence(F.lit(1), F.lit(max(n_samples, 1))), F.transform("v", lambda e: e["s"]))).alias("_s")).withColumn("_s", F.col("_s").cast("long"))
    late = holes.join(filled, ["gene", "_s"], "left").join(samples, "_s").join(means, "sample").select("sample", "gene", F.coalesce("_near", "_mean").alias("value"))
    return usable.select("sample", "gene", "value").unionByName(late)


def strong_mutations(mutations: DataFrame, samples: DataFrame, nonstop: bool = False) -> DataFrame:
    """Mutations (sample, hgnc_symbol, variant_type) of strong types in samples with expression."""
    kinds = [*STRONG, "NONSTOP"] if nonstop else list(STRONG)
    return mutations.filter(F.col("variant_type").isin(*kinds)).join(samples.select("sample").distinct(), "sample", "left_semi")


def recode_complex(mutations: DataFrame) -> DataFrame:
    """Other than copy-number changes, mutations of one gene in one sample that are several become COMPLEX."""
    is_cna = F.col("variant_type").isin("HOMD", "HLAMP")
    several = F.count("*").over(Window.partitionBy("sample", "hgnc_symbol")) > 1
    point = mutations.filter(~is_cna).withColumn("variant_type", F.when(several, "COMPLEX").otherwise(F.col("variant_type")))
    return point.unionByName(mutations.filter(is_cna))


def distributions(expr: DataFrame, mutations: DataFrame | None = None, kind: str = "student") -> DataFrame:
    """DISTRIBUTION of each gene and sample: densities under the gene's down, neutral and up parts, and its parameters.

    A gene mutated in more than 0.7 of the mutated samples is fitted without its mutations.
    """
    if kind not in ("gauss", "student"):
        raise ValueError(f"unknown distribution {kind!r}")
    rows = expr.filter((F.col("gene") != "") & F.col("value").isNotNull())
    if mutations is None:
        marked = rows.withColumn("mut", F.lit(None).cast("double"))
    else:
        strong = strong_mutations(mutations, expr)
        samples = strong.select("sample").distinct()
        hits = strong.select("sample", F.col("hgnc_symbol").alias("gene")).distinct()
        often = hits.groupBy("gene").agg(F.count("*").alias("_n")).join(F.broadcast(samples.agg(F.count("*").alias("_all")))).filter(F.col("_n") > 0.7 * F.col("_all")).select("gene")  # one row
        hits = hits.join(often, "gene", "left_anti").withColumn("_hit", F.lit(1.0))
        marked = rows.join(samples.withColumn("_known", F.lit(0.0)), "sample", "left").join(hits, ["sample", "gene"], "left").withColumn("mut", F.coalesce("_hit", "_known")).drop("_hit", "_known")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        x, mut = pdf["value"].to_numpy(float), pdf["mut"].to_numpy(float)
        m = fit_expression(x, None if np.isnan(mut).all() else mut, kind == "student")
        p = np.exp(student_log_density(x, m.mu, m.sigma, m.nu) if kind == "student" else gauss_log_density(x, m.mu, m.sigma))
        n = len(pdf)
        return pd.DataFrame({"gene": pdf["gene"], "sample": pdf["sample"], "p_down": p[:, 0], "p_neutral": p[:, 1], "p_up": p[:, 2], "share": [m.share.tolist()] * n, "mu": [m.mu.tolist()] * n, "sigma": [m.sigma.tolist()] * n, "nu": float(m.nu[0]) if m.nu is not None else None, "aic": m.aic, "bic": m.bic})

    return marked.select("gene", "sample", "value", "mut").groupBy("gene").applyInPandas(run, DISTRIBUTION)


def expression_weights(expr: DataFrame) -> DataFrame:
    """gene, weight: how likely a gene is expressed at all, from the mixture of the genes' 90 % quantiles.

    Genes without values weigh 0, high outliers 1, low ones 0; other outliers have no row. One row a gene goes to the fit.
    """
    q = expr.groupBy("gene").agg(F.percentile("value", F.lit(0.9)).alias("q"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("q")
        x = pdf["q"].to_numpy(float)
        low, high = boxplot_fences(x)
        inside = (x >= low) & (x <= high)
        y = x[inside]
        th = np.quantile(y, 0.3)
        parts = (y[y <= th], y[y > th])
        sd = [p.std(ddof=1) if len(p) > 1 and p.std(ddof=1) > 0 else y.std(ddof=1) or 1.0 for p in parts]
        m = fit(y, [0.3, 0.7], [p.mean() for p in parts], sd, 2)
        weight = np.full(len(x), np.nan)
        weight[inside] = m.posterior[:, 1]
        weight[~inside & (x > m.mu[1])] = 1.0
        weight[~inside & (x < m.mu[0])] = 0.0
        return pd.DataFrame({"gene": pdf["gene"], "weight": weight}).dropna()

    fitted = q.filter(F.col("q").isNotNull()).groupBy().applyInPandas(run, "gene string, weight double")
    return fitted.unionByName(q.filter(F.col("q").isNull()).select("gene", F.lit(0.0).alias("weight")))


def _gaussian_process_residual(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Residuals of a Gaussian-process regression with a squared-exponential kernel; width and noise by marginal likelihood."""
    scale = x.std() or 1.0
    xs, mean = (x - x.mean()) / scale, y.mean()
    c = y - mean
    spread = c.var() or 1.0
    d2 = (xs[:, None] - xs) ** 2

    def solve(width: float, noise: float) -> tuple[float, np.ndarray, np.ndarray]:
        k = spread * np.exp(-0.5 * d2 / width**2)
        chol = np.linalg.cholesky(k + (noise * spread + 1e-8) * np.eye(len(x)))
        a = np.linalg.solve(chol.T, np.linalg.solve(chol, c))
        return 0.5 * c @ a + np.log(np.diag(chol)).sum(), k, a

    width, noise = 1.0, 0.5
    for _ in range(3):
        width = float(np.exp(minimise(lambda v: solve(float(np.exp(v)), noise)[0], -2.0, 3.0, 1e-2)))
        noise = float(np.exp(minimise(lambda v: solve(width, float(np.exp(v)))[0], -6.0, 2.0, 1e-2)))
    _, k, a = solve(width, noise)
    return c - k @ a


def _support_vector_residual(x: np.ndarray, y: np.ndarray, cost: float = 1.0, tube: float = 0.1, width: float = 1.0, tolerance: float = 1e-3) -> np.ndarray:
    """Residuals of a support-vector regression with a radial kernel, on standardised values.

    Of the dual's coefficients (between -cost and cost, with sum 0) the pair that breaks optimality most is moved, until
    none does by more than the tolerance.
    """
    sd = y.std(ddof=1) or 1.0
    xs, ys = (x - x.mean()) / (x.std(ddof=1) or 1.0), (y - y.mean()) / sd
    k = np.exp(-width * (xs[:, None] - xs) ** 2)
    beta, gradient = np.zeros(len(x)), -ys
    for _ in range(1000 * len(x)):
        rise = np.where(beta < cost, gradient + np.where(beta >= 0, tube, -tube), np.inf)
        fall = np.where(beta > -cost, gradient + np.where(beta <= 0, -tube, tube), -np.inf)
        i, j = int(rise.argmin()), int(fall.argmax())
        if fall[j] - rise[i] <= tolerance:
            break
        curve = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        # no step goes past a bound, or past 0, where the tube's slope turns
        step = min((fall[j] - rise[i]) / curve, -beta[i] if beta[i] < 0 else cost - beta[i], beta[j] if beta[j] > 0 else beta[j] + cost)
        beta[i] += step
        beta[j] -= step
        gradient += step * (k[:, i] - k[:, j])
    offset = -(rise.min() + fall.max()) / 2
    return y - (y.mean() + sd * (k @ beta + offset))


def remove_copy_number(expr: DataFrame, cna: DataFrame, kind: str = "gp") -> DataFrame:
    """sample, gene, value: residuals of each gene's expression on its copy number (sample, gene, value).

    Where the median absolute copy number is 0, the median is taken off instead. Hyper-parameters are fitted here, so
    residuals differ in detail from other implementations.
    """
    if kind not in ("gp", "svm"):
        raise ValueError(f"unknown regression {kind!r}")
    both = expr.join(cna.withColumnRenamed("value", "cna"), ["sample", "gene"]).dropna(subset=["value", "cna"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        x, y = pdf["cna"].to_numpy(float), pdf["value"].to_numpy(float)
        flat = np.median(np.abs(x)) == 0
        out = y - np.median(y) if flat else (_gaussian_process_residual if kind == "gp" else _support_vector_residual)(x, y)
        return pd.DataFrame({"sample": pdf["sample"], "gene": pdf["gene"], "value": out})

    return both.groupBy("gene").applyInPandas(run, "sample string, gene string, value double")


def heatmap_order(values: DataFrame) -> DataFrame:
    """axis, name, position of a heatmap's genes and samples, by clustering trees. A heatmap is a picture: its matrix is one task's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="gene", columns="sample", values="value").fillna(0.0)
        out = [("gene", wide.index[i], k) for k, i in enumerate(leaf_order(wide.to_numpy()))]
        out += [("sample", wide.columns[i], k) for k, i in enumerate(leaf_order(wide.to_numpy().T))]
        return pd.DataFrame(out, columns=["axis", "name", "position"])

    return values.select("gene", "sample", "value").groupBy().applyInPandas(run, "axis string, name string, position long")


def heatmap_data(dist: DataFrame) -> DataFrame:
    """gene, sample, value: the larger of up and down, signed: what a regulation heatmap draws."""
    share = [F.col(p) * F.col("share")[k] for k, p in enumerate(("p_down", "p_neutral", "p_up"))]
    total = share[0] + share[1] + share[2]
    down, up = share[0] / total, share[2] / total
    return dist.select("gene", "sample", (F.signum(up - down) * F.greatest(up, down)).alias("value"))


def z_scores(df: DataFrame, by: str, clip: float | None = None) -> DataFrame:
    """Rows or columns (by) brought to mean 0 and deviation 1, clipped if asked."""
    w = Window.partitionBy(by)
    z = (F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_samp("value").over(w), F.lit(0.0))
    z = F.coalesce(z, F.lit(0.0))
    return df.withColumn("value", F.greatest(F.lit(-clip), F.least(F.lit(clip), z)) if clip else z)
