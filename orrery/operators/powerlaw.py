"""Power-law fits of a degree histogram (Clauset, Shalizi and Newman 2009)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import running_total
from ..session import cut


def alpha_ks(histogram: DataFrame, value: str = "degree", count: str = "n", least_tail: int = 10) -> DataFrame:
    """(xmin, tail, alpha, ks) for every xmin whose tail has ``least_tail`` rows or more.

    alpha = 1 + n / sum ln(x / (xmin - 1/2)); ks compares the tail's CCDF with
    (x - 1/2) / (xmin - 1/2) to the power 1 - alpha.  Tails and their sums of logarithms are running
    totals of the histogram, which has a row per distinct value; only ks meets every
    value with those above it.
    """
    h = histogram.select(F.col(value).cast("double").alias("x"), F.col(count).cast("double").alias("c")).where("x >= 1")
    down = [F.col("x").desc()]
    tails = running_total(running_total(h.withColumn("l", F.col("c") * F.ln("x")), down, "c", "tail"), down, "l", "s")
    tails = cut(tails.select("x", "tail", "s"))
    fit = tails.where(F.col("tail") >= least_tail).select(F.col("x").alias("xmin"), "tail", (1 + F.col("tail") / (F.col("s") - F.col("tail") * F.ln(F.col("x") - 0.5))).alias("alpha"))
    gap = fit.join(tails.select("x", F.col("tail").alias("above")), F.col("x") >= F.col("xmin"))
    model = F.pow((F.col("x") - 0.5) / (F.col("xmin") - 0.5), 1 - F.col("alpha"))
    return gap.groupBy("xmin", "tail", "alpha").agg(F.max(F.abs(F.col("above") / F.col("tail") - model)).alias("ks"))


def best_fit(fits: DataFrame) -> DataFrame:
    return fits.orderBy("ks", "xmin").limit(1)


def hurwitz(s: float, q: float, terms: int = 50) -> float:
    """Zeta(s, q) by Euler-Maclaurin summation."""
    k = np.arange(terms)
    head = float(((q + k) ** -s).sum())
    n = q + terms
    return head + n ** (1 - s) / (s - 1) + 0.5 * n**-s + s * n ** (-s - 1) / 12 - s * (s + 1) * (s + 2) * n ** (-s - 3) / 720


def against_lognormal(histogram: DataFrame, xmin: float, value: str = "degree", count: str = "n") -> tuple[float, float]:
    """(R, p): normalised log-likelihood ratio of the discrete power law and a lognormal on
    the tail, and its two-sided p (Vuong 1989).  R < 0 favours the lognormal.

    The driver holds the tail's histogram, a row for every distinct degree.
    """
    rows = histogram.where(F.col(value) >= xmin).select(F.col(value).cast("double"), F.col(count).cast("double")).collect()
    x, c = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    n = c.sum()
    grid = np.linspace(1.2, 6.0, 481)
    logs = (c * np.log(x)).sum()
    fit = [-a * logs - n * math.log(hurwitz(a, xmin)) for a in grid]
    alpha = grid[int(np.argmax(fit))]
    power = -alpha * np.log(x) - math.log(hurwitz(alpha, xmin))
    upper = lambda t, mu, sd: 0.5 * np.vectorize(math.erfc)((np.log(t) - mu) / (sd * math.sqrt(2)))

    def lognormal(mu: float, sd: float) -> np.ndarray:
        mass = upper(x - 0.5, mu, sd) - upper(x + 0.5, mu, sd)
        return np.log(np.maximum(mass, 1e-300)) - math.log(max(float(upper(xmin - 0.5, mu, sd)), 1e-300))

    mu, sd = float((c * np.log(x)).sum() / n), max(0.1, float(np.sqrt((c * np.log(x) ** 2).sum() / n - ((c * np.log(x)).sum() / n) ** 2)))
    step = 1.0
    best = float((c * lognormal(mu, sd)).sum())
    while step > 1e-3:
        tries = [(mu + a * step, sd * math.exp(b * step)) for a in (-1, 0, 1) for b in (-0.5, 0, 0.5)]
        values = [float((c * lognormal(*t)).sum()) for t in tries]
        k = int(np.argmax(values))
        if values[k] > best + 1e-9:
            best, (mu, sd) = values[k], tries[k]
        else:
            step /= 2
    gap = power - lognormal(mu, sd)
    mean = float((c * gap).sum() / n)
    spread = math.sqrt(max(float((c * (gap - mean) ** 2).sum() / n), 1e-300))
    r = mean * math.sqrt(n) / spread
    return r, math.erfc(abs(r) / math.sqrt(2))
