"""Seeded Monte Carlo sampling: one generator, realisation by realisation, so a seed gives the same study anywhere."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Limits after the draw.
CLAMPS = {"E": (0.7, 1.3), "thickness": (0.8, 1.2), "lean": (-0.01, 0.01), "dead": (0.6, 1.5)}


def draw(rng: np.random.Generator, dist: str, mean: float, spread: float, clamp: tuple[float, float]) -> float:
    """A normal draw by mean and std, or a lognormal one by mean and cov, then clipped."""
    if dist == "lognormal":
        s2 = math.log(1 + spread * spread)
        x = rng.lognormal(math.log(mean) - s2 / 2, math.sqrt(s2))
    else:
        x = rng.normal(mean, spread)
    return float(min(max(x, clamp[0]), clamp[1]))


def realisations(spark: SparkSession, n: int, sections: list[str], storeys: int, seed: int, block: int = 1000) -> DataFrame:
    """``(id, variable, value)``: thickness by section, E, the lean of every storey in two directions, and dead load.

    Every realisation has its own child of the seed, so blocks are drawn in parallel and in any order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i in b["id"]:
                rng = np.random.default_rng([seed, int(i)])
                rows += [(i, f"thickness:{s}", draw(rng, "normal", 1.0, 0.03, CLAMPS["thickness"])) for s in sections]
                rows.append((i, "E", draw(rng, "lognormal", 1.0, 0.045, CLAMPS["E"])))
                rows += [(i, f"lean:{k}:{a}", draw(rng, "normal", 0.0, 0.0015, CLAMPS["lean"])) for k in range(storeys) for a in "xy"]
                rows.append((i, "dead", draw(rng, "normal", 1.05, 0.1, CLAMPS["dead"])))
            yield pd.DataFrame(rows, columns=["id", "variable", "value"])

    return spark.range(n, numPartitions=max(1, -(-n // block))).mapInPandas(run, "id long, variable string, value double")
