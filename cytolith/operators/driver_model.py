"""A hierarchical model of how mutations change expression over a gene network.

Each gene has D (does it drive expression), each of its mutations F (does this one have an effect), each neighbour H (is
it down- or up-regulated), and each (mutation, neighbour) G (down, neutral, up), seen through expression densities. Genes
share the tables p_d, p_df and p_fg. Given the tables genes are independent, so the exact inference runs by gene in
grouped pandas, and only sums of the tables' size come back to the driver in each round.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import dirichlet, log_sum_exp
from ..session import checkpointed

EVIDENCE = "gene string, sample string, neighbour string, p_down double, p_neutral double, p_up double, h double"
E_STEP = "gene string, loglik double, p_driver double, stat_d array<double>, stat_df array<double>, stat_fg array<double>, samples array<string>, p_effect array<double>, neighbours array<string>, p_up_neighbour array<double>, p_g array<double>"
MOST_COUNT, SHARE = 200.0, 0.1
TINY = 1e-300


@dataclass(frozen=True)
class Tables:
    """Shared conditional tables and their pseudo-counts. Rows of p_fg: no effect, effect if down, effect if up."""

    p_d: np.ndarray
    p_df: np.ndarray
    p_fg: np.ndarray
    beta_d: np.ndarray
    beta_df: np.ndarray
    beta_fg: np.ndarray
    baseline: float
    direction: bool = True
    equal_fg: bool = False


def set_priors(dist: DataFrame, mutations: DataFrame, edges: DataFrame | None, direction: bool = True, cis: bool = True, mut_type: str = "loss") -> Tables:
    """Starting tables from the fitted shares, and pseudo-counts worth a tenth of the data.

    cis with a mutation type other than loss or gain uses the table without directions.
    """
    per_gene = dist.groupBy("gene").agg(F.first("share").alias("s"))
    row = per_gene.agg(*(F.avg(F.col("s")[k]).alias(f"m{k}") for k in range(3)), *(F.coalesce(F.stddev_samp(F.col("s")[k]), F.lit(0.0)).alias(f"d{k}") for k in range(3))).first()
    mean, sd = np.array([row[f"m{k}"] for k in range(3)]), np.array([row[f"d{k}"] for k in range(3)])
    samples = dist.select("sample").distinct()
    unique = mutations.select("sample", F.col("hgnc_symbol").alias("gene")).distinct().join(samples, "sample", "left_semi")
    counts = unique.groupBy("gene").agg(F.count("*").alias("n")).agg(F.median("n").alias("m"), F.count("*").alias("g")).first()
    n_genes, n_mut = int(counts["g"] or 0), float(counts["m"] or 0)
    n_conn = 1.0
    if not cis and edges is not None:
        n_conn = float(edges.groupBy("gene").agg(F.count("*").alias("n")).agg(F.median("n")).first()[0] or 0)
    normal = lambda v: v / v.sum()
    none = normal(mean + sd * np.array([0, 1, 0]))
    if cis and mut_type not in ("loss", "gain"):
        direction = False
    if not direction:
        p_fg = np.stack([none, normal(mean + 5 * sd * np.array([1, 0, 1]))])
    else:
        effect = normal(mean + 5 * sd * np.array([1, 0, 1]))
        down = np.array([max(effect[0], effect[2]), effect[1], min(effect[0], effect[2])])
        down[1:] = (1 - down[0]) / 2
        up = down[::-1].copy()
        p_fg = np.stack([none, down, up]) if not cis or mut_type == "loss" else np.stack([none, up, down])
    p_d, p_df = np.array([0.95, 0.05]), np.array([[0.9, 0.1], [0.1, 0.9]])
    beta_d = np.ceil(p_d * n_genes * SHARE)
    if beta_d[1] == 1:
        beta_d += 1
    if beta_d.max() > MOST_COUNT:
        beta_d = np.minimum(beta_d, MOST_COUNT)
        p_d = beta_d / beta_d.sum()
    beta_df = np.ceil(p_df * p_d[:, None] * n_genes * n_mut * SHARE)
    beta_df += (beta_df == 1).any()
    by_row = p_df.T @ p_d if p_fg.shape[0] == 2 else np.array([p_df[:, 0] @ p_d, p_df[:, 1] @ p_d / 2, p_df[:, 1] @ p_d / 2])
    beta_fg = np.ceil(p_fg * by_row[:, None] * n_genes * n_mut * n_conn * SHARE)
    beta_fg += (beta_fg == 1).any()
    return Tables(p_d, p_df, p_fg, np.maximum(beta_d, 1), np.maximum(beta_df, 1), np.maximum(beta_fg, 1), float(mean[1]), direction)


def evidence(dist: DataFrame, expr: DataFrame, mutations: DataFrame, edges: DataFrame | None, cis: bool = False) -> DataFrame:
    """EVIDENCE: densities of every mutated sample's neighbours, weighed, with each neighbour's prior of being down.

    cis: a gene's only neighbour is itself. A sample weighs by how neutral it is on the whole; a neighbour of a gene with
    more than three mutated samples by how clear its direction is, times its edge.
    """
    share = [F.col(p) * F.col("share")[k] for k, p in enumerate(("p_down", "p_neutral", "p_up"))]
    sample_weight = dist.groupBy("sample").agg(F.avg(share[1] / (share[0] + share[1] + share[2])).alias("sw"))
    hits = mutations.select("sample", F.col("hgnc_symbol").alias("gene")).distinct().join(sample_weight, "sample")
    if cis:
        net = hits.select("gene").distinct().select("gene", F.col("gene").alias("neighbour"), F.lit(1.0).alias("weight"))
    else:
        net = edges.filter(F.col("gene") != F.col("neighbour"))
    values = dist.select("sample", F.col("gene").alias("neighbour"), "p_down", "p_neutral", "p_up", F.col("mu")[1].alias("centre")).join(expr.select("sample", F.col("gene").alias("neighbour"), "value"), ["sample", "neighbour"])
    rows = hits.join(net, "gene").join(values, ["sample", "neighbour"])
    down = F.col("p_down") / F.greatest(F.col("p_down") + F.col("p_up"), F.lit(TINY))
    sides = rows.groupBy("gene", "neighbour").agg(F.median(down).alias("q"), F.avg((F.col("value") < F.col("centre")).cast("double")).alias("below"), F.count("*").alias("n"), F.max("weight").alias("weight"))
    unlike = ((F.col("q") > 0.5) & (F.col("below") < 0.5)) | ((F.col("q") < 0.5) & (F.col("below") > 0.5))
    if cis:
        sides = sides.select("gene", "neighbour", F.lit(1.0).alias("w"), F.lit(1 - 2.0**-52).alias("h"))
    else:
        few = F.col("n") <= 3
        sides = sides.select("gene", "neighbour", F.when(few, 0.5).otherwise(F.greatest("q", 1 - F.col("q")) * F.col("weight")).alias("w"), F.when(few | unlike, 0.5).otherwise(F.col("q")).alias("h"))
    power = lambda p: F.pow(F.greatest(F.col(p), F.lit(TINY)), F.col("w") * F.col("sw")).alias(p)
    return rows.drop("weight").join(sides, ["gene", "neighbour"]).select("gene", "sample", "neighbour", power("p_down"), power("p_neutral"), power("p_up"), "h")


def infer_gene(p_gy: np.ndarray, h: np.ndarray, t: Tables) -> dict:
    """Exact inference of one gene: p_gy samples x neighbours x 3, h by neighbour."""
    h = np.clip(h, 2.0**-52, 1 - 2.0**-52)
    m, n, _ = p_gy.shape
    log_gy, log_fg = np.log(np.maximum(p_gy, TINY)), np.log(np.maximum(t.p_fg, TINY))
    # terms by row of p_fg, with the neighbour's direction weighed in
    terms = [log_fg[0] + log_gy]
    if t.direction:
        terms += [log_fg[1] + np.log(h)[None, :, None] + log_gy, log_fg[2] + np.log1p(-h)[None, :, None] + log_gy]
        effect = np.logaddexp(log_sum_exp(terms[1], 2), log_sum_exp(terms[2], 2))
    else:
        terms.append(log_fg[1] + log_gy)
        effect = log_sum_exp(terms[1], 2)
    by_pair = np.stack([log_sum_exp(terms[0], 2), effect], 2)
    by_sample = by_pair.sum(1)
    log_d, log_df = np.log(t.p_d), np.log(t.p_df)
    s = log_sum_exp(log_df[None] + by_sample[:, None, :], 2)
    total = s.sum(0) + log_d
    loglik = float(log_sum_exp(total))
    potential = total[None] - s
    down = log_sum_exp(log_df[None] + potential[:, :, None], 1)
    p_effect = np.exp(down[:, 1] + by_sample[:, 1] - log_sum_exp(down + by_sample, 1))
    df = np.exp(log_df[None] + by_sample[:, None, :] + potential[:, :, None] - loglik).sum(0)
    fg = np.stack([np.exp(x + (by_sample[:, f] + down[:, f])[:, None, None] - by_pair[:, :, f][:, :, None] - loglik) for x, f in zip(terms, (0, 1, 1), strict=False)])
    p_g = fg.sum(0)
    p_up = np.full(n, np.nan)
    if t.direction:
        sides = np.stack([log_sum_exp(x, 2).sum(0) for x in terms[1:]])
        p_up = np.exp(sides[1] - log_sum_exp(sides, 0))
    return {"loglik": loglik, "p_d": np.exp(total - loglik), "df": df, "fg": fg.sum((1, 2)), "p_effect": p_effect, "p_up": p_up, "p_g": p_g}


def infer(data: DataFrame, t: Tables) -> DataFrame:
    """E_STEP of every gene: posteriors and the sums that the next tables are made of."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        samples, neighbours = np.unique(pdf["sample"]), np.unique(pdf["neighbour"])
        i, j = np.searchsorted(samples, pdf["sample"]), np.searchsorted(neighbours, pdf["neighbour"])
        p = np.ones((len(samples), len(neighbours), 3))
        p[i, j] = pdf[["p_down", "p_neutral", "p_up"]].to_numpy(float)
        h = np.full(len(neighbours), 0.5)
        h[j] = pdf["h"].to_numpy(float)
        r = infer_gene(p, h, t)
        return pd.DataFrame([{"gene": pdf["gene"].iloc[0], "loglik": r["loglik"], "p_driver": r["p_d"][1], "stat_d": r["p_d"].tolist(), "stat_df": r["df"].ravel().tolist(), "stat_fg": r["fg"].ravel().tolist(), "samples": samples.tolist(), "p_effect": r["p_effect"].tolist(), "neighbours": neighbours.tolist(), "p_up_neighbour": r["p_up"].tolist(), "p_g": r["p_g"].ravel().tolist()}])

    return data.groupBy("gene").applyInPandas(run, E_STEP)


def maximise(t: Tables, d: np.ndarray, df: np.ndarray, fg: np.ndarray, cis: bool = False) -> Tables:
    """New tables from expected counts, with guards that keep the states' meanings."""
    normal = lambda v: v / v.sum(-1, keepdims=True)
    p_d = normal(d + t.beta_d - 1)
    p_df = normal(df + t.beta_df - 1)
    for k in range(2):
        if p_df[k, k] <= p_df[k, 1 - k] + 0.1:
            p_df[k] = t.p_df[k]
    p_fg = fg + t.beta_fg - 1
    if t.equal_fg:
        if t.direction:
            p_fg[1] = p_fg[1] + p_fg[2][::-1]
            p_fg[2] = p_fg[1][::-1]
        else:
            p_fg[1, [0, 2]] = p_fg[1, [0, 2]].mean()
    p_fg = normal(np.maximum(p_fg, TINY))
    low = 0.2 if cis else 0.4
    for k, row in enumerate(p_fg):
        bad = row[1] <= t.baseline if k == 0 else row[1] >= t.baseline or row[1] <= low
        middle = t.p_fg[k, 1] if bad else row[1]
        sides = row[[0, 2]] / row[[0, 2]].sum() * (1 - middle)
        p_fg[k] = [sides[0], middle, sides[1]]
    return replace(t, p_d=p_d, p_df=p_df, p_fg=p_fg)


def log_prior(t: Tables) -> float:
    """Dirichlet terms of the tables."""
    return float(sum(((b - 1) * np.log(np.maximum(p, TINY))).sum() for p, b in ((t.p_d, t.beta_d), (t.p_df, t.beta_df), (t.p_fg, t.beta_fg))))


def _sums(found: DataFrame, n_fg: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    parts = [("stat_d", 2), ("stat_df", 4), ("stat_fg", n_fg)]
    row = found.agg(F.sum("loglik"), *(F.sum(F.col(c)[k]) for c, n in parts for k in range(n))).first()
    values = np.array([v or 0.0 for v in row], float)
    return values[0], values[1:3], values[3:7].reshape(2, 2), values[7:].reshape(-1, 3)


def learn(data: DataFrame, t: Tables, rounds: int = 20, threshold: float = 1e-5, cis: bool = False) -> tuple[Tables, list[float]]:
    """Tables after EM and the trace of the log posterior. The evidence is cut from its lineage once."""
    if t.equal_fg:
        p_fg = t.p_fg.copy()
        p_fg[0, [0, 2]] = p_fg[0, [0, 2]].mean()
        if not t.direction:
            p_fg[1, [0, 2]] = p_fg[1, [0, 2]].mean()
        t = replace(t, p_fg=p_fg)
    data = checkpointed(data)
    trace: list[float] = []
    for k in range(rounds):
        loglik, d, df, fg = _sums(infer(data, t), t.p_fg.size)
        now = loglik + log_prior(t)
        if trace and (now < trace[-1] or abs((now - trace[-1]) / trace[-1]) < threshold):
            trace.append(now)
            break
        trace.append(now)
        t = maximise(t, d, df, fg, cis and k > 0)
    return t, trace


def posterior_table(found: DataFrame) -> DataFrame:
    """sample, hgnc_symbol, p_effect, p_driver of each mutation, most likely drivers first."""
    pairs = found.select(F.col("gene").alias("hgnc_symbol"), "p_driver", F.explode(F.arrays_zip("samples", "p_effect")).alias("x"))
    return pairs.select(F.col("x.samples").alias("sample"), "hgnc_symbol", F.col("x.p_effect").alias("p_effect"), "p_driver").orderBy(F.desc("p_driver"), "hgnc_symbol", F.desc("p_effect"), "sample")



def integrated_prior(priors: DataFrame) -> DataFrame:
    """gene, log_p0, log_p1 from the pseudo-counts (gene, b0, b1) of each gene's own table: the log of the table's expectation, its parameter integrated out."""
    total = F.col("b0") + F.col("b1")
    return priors.select("gene", F.log(F.col("b0") / total).alias("log_p0"), F.log(F.col("b1") / total).alias("log_p1"))


def replicated(table: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """A shared table's rows once for each name: what gives every gene, or every mutation, a table of its own. One side is a table of a few rows."""
    return table.crossJoin(names.select(F.col(name).alias("name")).distinct())


def dirichlet_draws(names: DataFrame, alpha: list[float], seed: int = 0, name: str = "name") -> DataFrame:
    """name, share (array) drawn from a Dirichlet distribution for each name; a name's draw depends on it and the seed alone."""

    def run(parts):
        for pdf in parts:
            yield pd.DataFrame({"name": pdf["name"], "share": [dirichlet(np.random.default_rng([seed, h]), np.array(alpha)).tolist() for h in pdf["h"]]})

    keyed = names.select(F.col(name).cast("string").alias("name"), F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(1 << 62)).alias("h"))
    return keyed.mapInPandas(run, "name string, share array<double>")
