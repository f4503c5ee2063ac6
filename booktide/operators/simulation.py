"""Simulated reference series with faults, and how often check 1 sees them: replicates are rows, so they spread over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .calibration import MARGINS, RADIUS
from .stats import LEAST_CLUSTERS, Z90, correction

#: Planning assumptions of the series where nothing has been measured.
INCREMENT_SD, XVENUE_SD, XVENUE_SLOPE, OVERROUND = (0.03, 0.02, 0.01, 0.01), 0.01, 0.03, 0.045
PRICES, PRICE_LIMITS, SHARE_LIMITS = (0.30, 0.70), (0.02, 0.98), (0.01, 0.99)
#: Faults by name: the drifts are each as large as their margin.
FAULTS = {"correct": {}, "level_drift": {"level": MARGINS["intercept"]}, "curvature_drift": {"curvature": MARGINS["curvature"]}, "close_flip": {"close_flip": True}, "ref_flip": {"ref_flip": True}}


def series(draw: np.random.Generator, n: int, increments: tuple[float, ...] = INCREMENT_SD, start: np.ndarray | None = None, level: float = 0.0, slope: float = 0.0, curvature: float = 0.0, band: tuple[float, float, float] | None = None, close_flip: bool = False, ref_flip: bool = False, entry_flip: bool = False, radius: float = RADIUS) -> dict[str, np.ndarray]:
    """n events as a pipeline would see them: prices (offset by event, the earliest first), close, q (the entry venue's own share), and a random side's prices.

    True prices are a martingale with the given steps, the last into the close, where drifts are added; flips change what is seen only.
    """
    price = draw.uniform(*PRICES, n) if start is None else draw.choice(start, n)
    path = [price]
    for sd in increments[:-1]:
        path.append(np.clip(path[-1] + draw.normal(0, sd, n), *PRICE_LIMITS))
    last = path[-1]
    curve = ((last - 0.5) / radius) ** 2
    drift = level + slope * (last - 0.5) + curvature * (curve - curve.mean())
    if band is not None:
        drift = drift + band[2] * ((last >= band[0]) & (last < band[1]))
    close = np.clip(last + draw.normal(0, increments[-1], n) + drift, *PRICE_LIMITS)
    seen = (lambda x: 1 - x) if ref_flip else (lambda x: x)
    told = 1 - seen(close) if close_flip else seen(close)
    third, second = path[min(2, len(path) - 1)], path[min(1, len(path) - 1)]
    fair = np.clip(third + XVENUE_SLOPE * (third - 0.5) + draw.normal(0, XVENUE_SD, n), *SHARE_LIMITS)
    implied = np.stack((fair, 1 - fair)) * (1 + OVERROUND)
    q = implied[0] / implied.sum(axis=0)
    home = draw.random(n) < 0.5
    side = lambda x: np.where(home, x, 1 - x)
    return {"prices": np.stack([seen(p) for p in path]), "close": told, "q": 1 - q if entry_flip else q, "q_ref": seen(third), "side_entry": side(seen(second)), "side_close": side(told)}


def check1_passes(entry: np.ndarray, close: np.ndarray, radius: float = RADIUS) -> bool | None:
    """Whether all three terms lie within their margins, with one row for each event; None where there are too few events or too little variation."""
    n = len(entry)
    x, q = entry - 0.5, ((entry - 0.5) / radius) ** 2
    design = np.column_stack((np.ones(n), x - x.mean(), q - q.mean()))
    if n < LEAST_CLUSTERS or np.linalg.matrix_rank(design) < 3:
        return None
    inverse = np.linalg.inv(design.T @ design)
    beta = inverse @ (design.T @ (close - entry))
    scores = design * (close - entry - design @ beta)[:, None]
    se = np.sqrt(np.maximum(np.diag(inverse @ (scores.T @ scores) @ inverse) * correction(n, n, 3), 0))
    return all(abs(b) + Z90 * s <= m for b, s, m in zip(beta, se, MARGINS.values(), strict=True))


def replicates(spark: SparkSession, n: int, counts: list[int], increments: tuple[float, ...] = INCREMENT_SD, start: list[float] | None = None, faults: tuple[str, ...] = ("correct", "level_drift", "curvature_drift"), seed: int = 20261014, radius: float = RADIUS) -> DataFrame:
    """fault, replicate, passed (null where no fit is possible): n simulated samples for each fault.

    counts: events kept at each offset, drawn from those simulated. Each replicate has its own seed, so results do not depend on how rows
    are dealt out.
    """
    prices = None if start is None else np.asarray(start, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for fault, k in zip(pdf.fault, pdf.replicate, strict=True):
                draw = np.random.default_rng([seed, list(FAULTS).index(fault), int(k)])
                got = series(draw, max(counts), increments, prices, radius=radius, **FAULTS[fault])
                passed: bool | None = True
                for row, c in zip(got["prices"], counts, strict=True):
                    keep = np.sort(draw.choice(max(counts), c, replace=False))
                    one = check1_passes(row[keep], got["close"][keep], radius)
                    passed = None if one is None or passed is None else passed and one
                out.append((fault, int(k), passed))
            yield pd.DataFrame(out, columns=["fault", "replicate", "passed"])

    names = F.array(*map(F.lit, faults))
    todo = spark.range(n).select(F.col("id").alias("replicate"), F.explode(names).alias("fault")).repartition("replicate")
    return todo.mapInPandas(run, "fault string, replicate long, passed boolean")


def operating_characteristics(runs: DataFrame) -> DataFrame:
    """How often check 1 passes or fails for each fault: fault, n, passes, fails (shares); null where a replicate had no fit."""
    p = F.col("passed").cast("int")
    ok = F.count(F.lit(1)) == F.count("passed")
    return runs.groupBy("fault").agg(F.count(F.lit(1)).alias("n"), F.when(ok, F.avg(p)).alias("passes"), F.when(ok, 1 - F.avg(p)).alias("fails"))
