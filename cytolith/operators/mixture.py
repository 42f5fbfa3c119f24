"""Finite mixtures by penalised EM: Gaussian and Student-t components with Dirichlet, normal and inverse-gamma priors."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.stats import boxplot_fences, gauss_log_density, log_sum_exp, minimise, student_log_density, weighted_deviation, weighted_quantile

STOP, LEAST_SHARE, MOST_ROUNDS = 1e-5, 1e-5, 1000


@dataclass
class Prior:
    """lambda's Dirichlet weights, the means' centres and strength, the variances' scales and degrees of freedom."""

    alpha: np.ndarray
    mu: np.ndarray
    sigma: np.ndarray
    kapp: float = 0.0
    dof: float = 3.0


@dataclass
class Mixture:
    share: np.ndarray
    mu: np.ndarray
    sigma: np.ndarray
    nu: np.ndarray | None
    posterior: np.ndarray
    loglik: float
    #: Twice the log-likelihood less a penalty: higher is better.
    aic: float = 0.0
    bic: float = 0.0
    trace: list[float] = field(default_factory=list)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return gauss_log_density(x, self.mu, self.sigma) if self.nu is None else student_log_density(x, self.mu, self.sigma, self.nu)

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        joint = np.log(self.share) + self.log_density(x)
        return np.exp(joint - log_sum_exp(joint, 1)[:, None])


def kmeans_start(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares, means and deviations of k clusters, from equal stretches of the sorted values on."""
    x = np.sort(x)
    centres = np.array([c.mean() for c in np.array_split(x, k)])
    for _ in range(100):
        label = np.abs(x[:, None] - centres).argmin(1)
        new = np.array([x[label == j].mean() if (label == j).any() else centres[j] for j in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    sd = np.array([x[label == j].std(ddof=1) if (label == j).sum() > 1 else x.std(ddof=1) for j in range(k)])
    return np.bincount(label, minlength=k) / len(x), centres, np.where(sd > 0, sd, x.std(ddof=1))


def _log_prior(share, mu, sigma, prior: Prior, equal: bool) -> float:
    k = len(share)
    out = float(((prior.alpha - 1) * np.log(share)).sum())
    pull = prior.kapp * (mu - prior.mu) ** 2
    if equal:
        return out - (prior.dof + 2 + k) * math.log(sigma[0]) - (prior.sigma[0] ** 2 + pull.sum()) / (2 * sigma[0] ** 2)
    return out + float((-(prior.dof + 3) * np.log(sigma) - (prior.sigma**2 + pull) / (2 * sigma**2)).sum())


def fit(x: np.ndarray, share=None, mu=None, sigma=None, k: int = 3, prior: Prior | None = None, student: bool = False, equal_sigma: bool = False, nu_max: float = 50.0, most_rounds: int = MOST_ROUNDS, weight: np.ndarray | None = None) -> Mixture:
    """Fit k components to x, of which each value stands for weight values. Student components share their degrees of freedom, found in [0.1, nu_max] in each round."""
    x = np.asarray(x, float)
    c = np.ones(len(x)) if weight is None else np.asarray(weight, float)
    n = c.sum()
    if share is None or mu is None or sigma is None:
        s0, m0, d0 = kmeans_start(x, k)
        share, mu, sigma = (v if v is not None else w for v, w in ((share, s0), (mu, m0), (sigma, d0)))
    share, mu, sigma = (np.array(v, float) for v in (share, mu, sigma))
    prior = prior or Prior(np.full(k, 2.0), mu.copy(), sigma.copy())
    nu = np.full(k, nu_max) if student else None
    best = Mixture(share, mu, sigma, nu, np.zeros((len(x), k)), -math.inf)

    def expect(m: Mixture) -> tuple[np.ndarray, float]:
        joint = np.log(m.share) + m.log_density(x)
        rows = log_sum_exp(joint, 1)
        return np.exp(joint - rows[:, None]), float(c @ rows) + _log_prior(m.share, m.mu, m.sigma, prior, equal_sigma)

    tau, loglik = expect(best)
    best.posterior, best.loglik, best.trace = tau, loglik, [loglik]
    for _ in range(most_rounds):
        counted = tau * c[:, None]
        r = counted.sum(0)
        residual = (x[:, None] - best.mu) ** 2
        w = counted * ((best.nu + 1) / (best.nu + residual / best.sigma**2)) if student else counted
        mass = w.sum(0)
        mean = (w * x[:, None]).sum(0) / mass
        scatter = (w * residual).sum(0)
        share = (r + prior.alpha - 1) / (n + prior.alpha.sum() - k)
        mu = (mass * mean + prior.kapp * prior.mu) / (mass + prior.kapp)
        weight = mass if equal_sigma else r
        pull = prior.kapp * weight / (prior.kapp + weight) * (mean - prior.mu) ** 2
        if equal_sigma:
            sigma = np.full(k, math.sqrt((prior.sigma[0] ** 2 + (scatter + pull).sum()) / (prior.dof + n + k + 2)))
        else:
            sigma = np.sqrt((prior.sigma**2 + scatter + pull) / (prior.dof + r + 3))
        nu = None
        if student:
            cost = lambda v, s=share, m=mu, d=sigma: -float(c @ log_sum_exp(np.log(s) + student_log_density(x, m, d, np.full(k, v)), 1))
            nu = np.full(k, minimise(cost, 0.1, nu_max, 1e-3))
        if (share < LEAST_SHARE).any() or not np.isfinite(sigma).all():
            break
        new = Mixture(share, mu, sigma, nu, tau, loglik, trace=best.trace)
        tau, now = expect(new)
        new.posterior, new.loglik = tau, now
        gain = now - loglik
        if gain < 0 and abs(gain) > 1e-9 * abs(loglik):
            break
        best, loglik = new, now
        best.trace.append(now)
        if abs(gain) < STOP * abs(now):
            break
    parameters = (k - 1) + k + (1 if equal_sigma else k) + (1 if student else 0)
    plain = float(c @ log_sum_exp(np.log(best.share) + best.log_density(x), 1))
    best.aic, best.bic = 2 * plain - 2 * parameters, 2 * plain - parameters * math.log(n)
    return best


def three_part_start(x: np.ndarray, mutated: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares, means and deviations of down, neutral and up.

    x without missing values; mutated: 1, 0, or NaN where unknown, or None. The smallest and largest value are set aside
    and start the outer parts; values of mutated samples beyond a deviation of the others join them, or without usable
    mutations the box plot's outliers.
    """
    n = len(x)
    if n < 20:
        raise ValueError(f"{n} samples are too few to fit an expression distribution")
    low, high = int(np.argmin(x)), int(np.argmax(x))
    inner = np.ones(n, bool)
    inner[[low, high]] = False
    rest = x[inner]
    known = ~np.isnan(mutated[inner]) if mutated is not None else np.zeros(len(rest), bool)
    hit = known & (mutated[inner] > 0) if mutated is not None else known
    if 0 < hit.sum() < known.sum() - 2:
        neutral, changed = rest[known & ~hit], rest[hit]
        m, s = neutral.mean(), neutral.std(ddof=1)
        up, down = changed[changed >= m + s], changed[changed <= m - s]
    else:
        floor, ceiling = boxplot_fences(rest)
        outside = (rest < floor) | (rest > ceiling)
        up, down, neutral = (rest[:0], rest[:0], rest) if outside.sum() > len(rest) / 2 else (rest[rest > ceiling], rest[rest < floor], rest[~outside])
    up, down = np.append(up, x[high]), np.append(down, x[low])
    parts = (down, neutral, up)
    mu = np.array([p.mean() for p in parts])
    share = np.array([len(p) for p in parts], float)
    share /= share.sum()
    whole = x.std(ddof=1)
    if whole == 0:
        raise ValueError("the gene has the same expression in all samples")
    if mu[1] - mu[0] < whole:
        share[0] = 0.01
    if mu[2] - mu[1] < whole:
        share[2] = 0.01
    deviation = lambda p: p.std(ddof=1) if len(p) > 1 else 0.0
    middle = whole if len(neutral) < 5 or deviation(neutral) == 0 else deviation(neutral)
    sigma = np.array([middle if len(down) < 5 else deviation(down), middle, middle if len(up) < 5 else deviation(up)])
    return share / share.sum(), mu, np.where(sigma > 0, sigma, middle)


def fit_expression(x: np.ndarray, mutated: np.ndarray | None = None, student: bool = True) -> Mixture:
    """Three-part mixture of one gene's expression over samples."""
    share, mu, sigma = three_part_start(x, mutated)
    alpha = np.ceil(len(x) / 5 * share)
    if (alpha <= 1).any():
        alpha = alpha * 2
    widest = np.full(3, sigma.max())
    return fit(x, share, mu, widest, 3, Prior(alpha, mu, widest, 0.1, max(len(x) * 0.05, 3)), student, True, 20.0)


def fit_totals(x: np.ndarray, ratio: float = 0.1, weight: np.ndarray | None = None) -> tuple[Mixture, float]:
    """Two-part Student mixture of (log) cell totals, and the cut below which a cell is of the low part.

    x sorted; with weight, each value stands for so many cells. The cut is the end of the first run of grid points at
    which the low part is likelier.
    """
    x = np.asarray(x, float)
    weight = np.ones(len(x)) if weight is None else np.asarray(weight, float)
    low = x <= weighted_quantile(x, weight, ratio)
    if weight[low].sum() < 2 or weight[~low].sum() < 2:
        raise ValueError("too few cells for a mixture")
    parts = [(x[side], weight[side]) for side in (low, ~low)]
    mu = np.array([np.average(v, weights=w) for v, w in parts])
    sigma = np.array([weighted_deviation(v, w) for v, w in parts])
    sigma = np.where(sigma > 0, sigma, weighted_deviation(x, weight) or 1.0)
    share = np.array([ratio, 1 - ratio])
    model = fit(x, share, mu, sigma, 2, Prior(np.full(2, 5.0), mu, sigma, 0.2, 3.0), True, False, weight=weight)
    grid = np.linspace(x.min(), x.max(), 1001)
    post = model.responsibilities(grid)
    at = np.flatnonzero(post[:, 0] > post[:, 1])
    if not len(at):
        return model, float(x.min())
    breaks = np.flatnonzero(np.diff(at) > 1)
    return model, float(grid[at[breaks[0]] if len(breaks) else at[-1]])


def posteriors(df: DataFrame, model: dict[str, list[float]], column: str = "value") -> DataFrame:
    """df with posterior (array): the probability of each component of a mixture (share, mu, sigma, and nu for Student components) for a column; null for null."""
    m = Mixture(*(np.array(model[k], float) for k in ("share", "mu", "sigma")), np.array(model["nu"], float) if "nu" in model else None, np.zeros((0, len(model["share"]))), 0.0)

    def run(batches):
        for batch in batches:
            x = batch.column(batch.schema.get_field_index(column))
            values = x.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
            post = m.responsibilities(values)
            rows = [p if ok else None for p, ok in zip(post.tolist(), x.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], [*batch.schema.names, "posterior"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("posterior", T.ArrayType(T.DoubleType()))]))
