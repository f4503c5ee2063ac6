"""Statistics over clusters: robust regression, equivalence tests, binned lack of fit, exact ranks and quantiles."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The normal quantile of a two-sided interval of 90 %, and the fewest clusters that a fit needs.
Z90, LEAST_CLUSTERS = 1.6448536269514722, 30
#: Ranges of values that are ranked as tasks of their own.
CUTS = 64


@dataclass(frozen=True)
class Fit:
    """Coefficients, their CR1 standard errors, rows and clusters; reason is set instead where data do not suffice."""

    value: list[float]
    se: list[float]
    n: int
    clusters: int
    reason: str | None = None
    inverse: np.ndarray = field(default_factory=lambda: np.empty((0, 0)), repr=False, compare=False)

    def interval(self, k: int) -> tuple[float, float]:
        return self.value[k] - Z90 * self.se[k], self.value[k] + Z90 * self.se[k]

    def within(self, k: int, margin: float) -> bool:
        """Whether the whole interval of coefficient k lies inside the margin, its ends included."""
        low, high = self.interval(k)
        return -margin <= low and high <= margin


def correction(n: int, clusters: int, k: int) -> float:
    """The small-sample factor of CR1."""
    return clusters / (clusters - 1) * (n - 1) / (n - k)


def ols_by(df: DataFrame, by: list[str], y: str, x: list[str], cluster: str) -> tuple[dict[tuple, Fit], DataFrame]:
    """Least squares with an intercept and CR1 cluster-robust errors for each group, of which there are few; and the rows with residual ``e``.

    Two aggregations: the sums of X'X and X'y, then each cluster's score sums at the fitted coefficients, of which the products are
    summed. The driver sees k by k numbers for each group. Groups without a fit have no rows in the second result.
    """
    names = ["_1", *x]
    k, keys = len(names), [F.col(c) for c in by]
    rows = df.withColumn("_1", F.lit(1.0))
    cell = lambda a, b: F.sum(F.col(a).cast("double") * F.col(b).cast("double"))
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(cluster)).alias("g"),
        *(cell(a, b).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j), *(cell(a, y).alias(f"t{i}") for i, a in enumerate(names)),
    )
    betas, found, parts = [], {}, {}
    for r in sums.collect():  # a row for each group
        key = tuple(r[c] for c in by)
        xx = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float) if r.n else np.zeros((k, k))
        if r.g < LEAST_CLUSTERS or r.n <= k or np.linalg.matrix_rank(xx) < k:
            found[key] = Fit([], [], r.n, r.g, "insufficient_data")
            continue
        beta = np.linalg.solve(xx, [r[f"t{i}"] for i in range(k)])
        parts[key] = beta, np.linalg.inv(xx), r.n, r.g
        betas.append((*key, *map(float, beta)))
    schema = ", ".join([*(f"`{c}` {dict(df.dtypes)[c]}" for c in by), *(f"b{i} double" for i in range(k))])
    small = df.sparkSession.createDataFrame(betas, schema)
    joined = rows.join(F.broadcast(small), by) if by else rows.withColumns({f"b{i}": F.lit(betas[0][i] if betas else None).cast("double") for i in range(k)}).where(F.lit(bool(betas)))
    fitted = joined.withColumn("e", F.col(y).cast("double") - sum((F.col(f"b{i}") * F.col(a) for i, a in enumerate(names)), F.lit(0.0)))
    scores = fitted.groupBy(*keys, F.col(cluster)).agg(*(F.sum(F.col(a) * F.col("e")).alias(f"u{i}") for i, a in enumerate(names)))
    meat = scores.groupBy(*keys).agg(*(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)))
    for r in meat.collect() if parts else []:
        key = tuple(r[c] for c in by)
        beta, inverse, n, g = parts[key]
        m = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        cov = inverse @ m @ inverse * correction(n, g, k)
        found[key] = Fit(beta.tolist(), np.sqrt(np.maximum(np.diag(cov), 0)).tolist(), n, g, inverse=inverse)
    return found, fitted.drop(*(f"b{i}" for i in range(k)))


def ols_cluster(df: DataFrame, y: str, x: list[str], cluster: str) -> Fit:
    """One fit of the whole table (see ols_by)."""
    found, _ = ols_by(df.select(cluster, y, *x), [], y, x, cluster)
    return found.get((), Fit([], [], 0, 0, "insufficient_data"))


def cluster_mean(df: DataFrame, value: str, cluster: str, by: list[str]) -> DataFrame:
    """Mean and cluster-robust error of each group, all in aggregations: n, n_clusters, mean, se."""
    c = df.groupBy(*by, cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    total = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    c = c.withColumn("_mean", F.sum("_s").over(total) / F.sum("_n").over(total))
    out = c.groupBy(*by).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_clusters"), F.first("_mean").alias("mean"), F.sum((F.col("_s") - F.col("_n") * F.col("_mean")) ** 2).alias("_m"))
    g, n = F.col("n_clusters"), F.col("n")
    return out.withColumn("se", F.when(g > 1, F.sqrt(F.col("_m") * g / (g - 1)) / n)).drop("_m")


def running_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The distinct values of each group: by, value, n, before (rows with a smaller value) and total (rows of the group). Nulls are left out.

    Values are dealt into ranges by a few cuts, so that a group of any size is many tasks; sums of the ranges carry over from one to the next.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    cuts = sorted(set(counts.select(F.col(value).cast("double")).approxQuantile(value, [k / CUTS for k in range(1, CUTS)], 0.01)))
    part = sum((F.when(F.col(value) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    x = counts.withColumn("_part", part)
    up = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sums = x.groupBy(*by, "_part").agg(F.sum("n").alias("_n"))  # a row for each group and range
    sums = sums.select(*by, "_part", F.coalesce(F.sum("_n").over(up.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_n").over(up).alias("total"))
    inside = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(sums, [*by, "_part"])
    return x.select(*by, value, "n", (F.col("_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"), "total")


def ranked_bins(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """df with bin: lowest rank of ties * bins // rows of the group."""
    counts = running_counts(df, value, by or [])
    return df.join(counts.select(*(by or []), value, F.floor(F.col("before") * bins / F.col("total")).cast("int").alias("bin")), [*(by or []), value])


def quantiles(df: DataFrame, value: str, by: list[str], at: dict[str, float], linear: bool = True) -> DataFrame:
    """Exact quantiles of each group by name: between neighbours in proportion, or (linear=False) the nearest rank, the smallest value with that share."""
    c = running_counts(df, value, by)
    n = F.col("total")
    out = []
    for name, q in at.items():
        spot = (n - 1) * q if linear else F.greatest(F.ceil(n * q), F.lit(1)) - 1
        low = F.floor(spot)
        here = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n"))
        a, b = F.max(F.when(here(low), F.col(value))), F.max(F.when(here(F.least(low + 1, n - 1)), F.col(value)))
        share = F.max(spot - low)
        out.append((a + (b - a) * share if linear else a).alias(name))
    return c.groupBy(*by).agg(*out)


def matched(df: DataFrame, event: str, buffer: str, buffers: int, by: list[str] | None = None) -> DataFrame:
    """Rows of events that are present at every buffer."""
    keys = [*(by or []), event]
    full = df.groupBy(*keys).agg(F.count_distinct(buffer).alias("_b")).where(F.col("_b") == buffers).select(*keys)
    return df.join(full, keys, "left_semi")


def dispersion(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Sample deviation and linear quantiles of each group."""
    sd = df.groupBy(*by).agg(F.stddev_samp(value).alias("sd"))
    return sd.join(quantiles(df, value, by, {f"q{q:02d}": q / 100 for q in (5, 25, 50, 75, 95)}), by)


def drift_bound(df: DataFrame, group: str, weight: str, basis: str, margin: str) -> DataFrame:
    """Sum over groups of margin * |sum of weight * basis|."""
    g = df.groupBy(group).agg(F.abs(F.sum(F.col(weight) * F.col(basis))).alias("_s"), F.max(margin).alias("_m"))
    return g.agg(F.sum(F.col("_s") * F.col("_m")).alias("bound"))


def probability(c: Column) -> Column:
    """Whether a value is a probability: there, finite, from 0 to 1."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1), F.lit(False))
