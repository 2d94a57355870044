"""Principal components of standardised columns: population deviations, and signs by the largest loading."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(df: DataFrame, columns: Sequence[str], k: int) -> dict:
    """mean, sd (0 becomes 1), loadings (a row for each component) and the share of variance each explains. One pass: the
    sums go to the driver, a matrix of the columns' number squared."""
    d = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).dropna()
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    r = d.agg(F.count("*").alias("n"), *(F.avg(f"c{i}").alias(f"m{i}") for i in range(p)), *(F.covar_pop(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i, j in pairs)).first()
    if r.n < 3:
        raise ValueError("principal components need three complete rows")
    cov = np.zeros((p, p))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = r[f"v{i}_{j}"]
    sd = np.sqrt(np.diag(cov))
    sd[sd == 0] = 1.0
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    order = np.argsort(-values)[:k]
    loadings = vectors[:, order].T
    loadings *= np.sign(loadings[np.arange(len(loadings)), np.abs(loadings).argmax(1)])[:, None]
    return {"columns": list(columns), "mean": [r[f"m{i}"] for i in range(p)], "sd": sd.tolist(), "loadings": loadings, "explained": (values[order] / (values.sum() or 1.0)).tolist()}


def scores(df: DataFrame, model: dict, prefix: str = "pc") -> DataFrame:
    """Adds pc1, pc2, ...; null where a column is."""
    z = [(F.col(c).cast("double") - m) / s for c, m, s in zip(model["columns"], model["mean"], model["sd"], strict=True)]
    return df.withColumns({f"{prefix}{i + 1}": sum((x * float(w) for x, w in zip(z, row, strict=True)), F.lit(0.0)) for i, row in enumerate(model["loadings"])})
