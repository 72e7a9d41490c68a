"""Training of the candidate model: weighted, L2-regularised logistic regression by Newton steps on distributed sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.operators.rules import FEATURES, Model, features
from spotlake.operators.scale import stored


def train(labelled: DataFrame, regularization: float = 1.0, min_per_class: int = 5, accept: float = 0.75, reject: float = 0.25, max_steps: int = 100, tolerance: float = 1e-8) -> Model:
    """A model of rows (features, ``label`` target or artifact); rows without whole features are dropped first.

    Classes weigh equally. Each step is one pass that sums gradient and Hessian (11 numbers and 11 x 11); steps are halved
    while the objective does not fall. The intercept is not regularised.
    """
    rows = stored(labelled.where("label in ('target', 'artifact')").select(features().alias("x"), (F.col("label") == "target").cast("double").alias("y")).where("x is not null"))
    k = len(FEATURES)
    stats = rows.agg(
        F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("ones"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(k)],
    ).first()
    ones, zeros = int(stats.ones), int(stats.n - stats.ones)
    if min(ones, zeros) < min_per_class:
        raise ValueError(f"{ones} targets and {zeros} artifacts; {min_per_class} of each are needed")
    means = np.array([stats[f"m{i}"] for i in range(k)])
    scales = np.array([stats[f"s{i}"] if stats[f"s{i}"] > 1e-12 else 1.0 for i in range(k)])
    weight = {1.0: stats.n / (2 * ones), 0.0: stats.n / (2 * zeros)}
    ridge = np.append(np.full(k, regularization), 0.0)

    def sums(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(frames):
            for f in frames:
                x = np.column_stack([(np.stack(f["x"].to_numpy()) - means) / scales, np.ones(len(f))])
                y = f["y"].to_numpy()
                w = np.where(y == 1, weight[1.0], weight[0.0])
                z = x @ beta
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                loss = float((w * (np.logaddexp(0, z) - y * z)).sum())
                h = (x * (w * p * (1 - p))[:, None]).T @ x
                yield pd.DataFrame({"i": np.arange(1 + (k + 1) + (k + 1) ** 2), "v": np.concatenate([[loss], x.T @ (w * (p - y)), h.ravel()])})

        got = rows.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(1 + (k + 1) + (k + 1) ** 2)
        for r in got:
            v[r.i] = r.v
        return v[0] + float(ridge @ beta**2) / 2, v[1 : k + 2] + ridge * beta, v[k + 2 :].reshape(k + 1, k + 1) + np.diag(ridge + 1e-9)

    beta = np.zeros(k + 1)
    loss, gradient, hessian = sums(beta)
    for _ in range(max_steps):
        step, scale = np.linalg.solve(hessian, gradient), 1.0
        while True:
            trial = beta - scale * step
            found = sums(trial)
            if found[0] <= loss or scale <= 1 / 1024:
                break
            scale /= 2
        moved = np.abs(trial - beta).max()
        beta, (loss, gradient, hessian) = trial, found
        if moved < tolerance:
            break
    return Model(tuple(means.tolist()), tuple(scales.tolist()), tuple(beta[:-1].tolist()), float(beta[-1]), accept, reject).checked()
