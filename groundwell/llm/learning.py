"""What the learned operators share: held-out splits and bounded training samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(mod: int) -> Column:
    """crc32 of the doc_id's decimal text, modulo ``mod``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)).cast("int")


def sample_classes(rows: DataFrame, label: str, per_class: int, seed: int) -> DataFrame:
    """About ``per_class`` rows of each non-null label (all, if there are fewer).

    The sample is drawn by a hash of the id, so it is the same at every run and
    for every partitioning.  ``label`` should have few values: one count of each
    goes to the driver.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not counts:
        return rows.where(F.lit(False))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.lit(False)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        wanted = wanted | ((F.col(label) == F.lit(value)) & (unit < F.lit(min(1.0, per_class / n))))
    return rows.where(wanted)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Adam:
    """Adam steps on a dictionary of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            scale = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
            self.params[k] -= self.rate * scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)
