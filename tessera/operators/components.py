"""Principal components by truncated factorisations of batches that merge: no pass holds more than a batch and a few rows of
`keep` directions, and the order and number of the batches only matter where directions are dropped."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import table

SUMMARY = "part long, n long, mean array<double>, scaled array<array<double>>, lost double"


@dataclass
class Factors:
    """`n` rows with their mean; `scaled` holds singular values times directions, largest first. The rows' scatter matrix
    exceeds scaled.T @ scaled by a matrix without negative eigenvalues whose largest one is at most `lost`."""

    n: int
    mean: np.ndarray
    scaled: np.ndarray
    lost: float = 0.0

    def cut(self, keep: int) -> Factors:
        """The factorisation of the rows in `scaled` that keeps `keep` directions, and what is lost by it."""
        _, s, v = np.linalg.svd(self.scaled, full_matrices=False)
        gone = float(s[keep] ** 2) if len(s) > keep else 0.0
        return Factors(self.n, self.mean, s[:keep, None] * v[:keep], self.lost + gone)

    @staticmethod
    def of(x: np.ndarray, keep: int) -> Factors:
        mean = x.mean(axis=0)
        return Factors(len(x), mean, x - mean).cut(keep)

    def merged(self, other: Factors, keep: int) -> Factors:
        n, step = self.n + other.n, other.mean - self.mean
        between = np.sqrt(self.n * other.n / n) * step
        rows = np.vstack([self.scaled, other.scaled, between[None]])
        return Factors(n, self.mean + step * (other.n / n), rows, self.lost + other.lost).cut(keep)

    @property
    def values(self) -> np.ndarray:
        """Eigenvalues of the scatter matrix, each at most `lost` below the true one and never above it."""
        return (self.scaled**2).sum(axis=1)

    def directions(self, k: int) -> np.ndarray:
        """The first k directions, the entry of largest size of each positive. Directions without variance are zero."""
        size = np.sqrt(self.values[:k])
        v = np.divide(self.scaled[:k], size[:, None], out=np.zeros_like(self.scaled[:k]), where=size[:, None] > 0)
        signs = np.sign(np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1)) if v.size else np.ones((len(v), 1))
        return v * np.where(signs == 0, 1, signs)

    def frame(self, part: int) -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "n": [self.n], "mean": [self.mean.tolist()], "scaled": [[r.tolist() for r in self.scaled]], "lost": [self.lost]})

    @staticmethod
    def read(row) -> Factors:
        mean = np.array(row["mean"], "f8")
        return Factors(int(row["n"]), mean, np.array([list(r) for r in row["scaled"]], "f8").reshape(-1, len(mean)), float(row["lost"]))


def fit_components(rows: DataFrame, vector: str, keep: int, batch: int = 4096, fan: int = 16) -> Factors | None:
    """The factorisation of all vectors of a column; None where there are none.

    Each task folds batches of `batch` rows into its own factors; those merge `fan` at a time over tasks, in rounds that are
    written to the shared folder, until one is left: a row of `keep` directions, whatever the input's size. Vectors that are
    null or hold a null or non-finite component take no part; vectors of different lengths are an error. With `keep` at the
    vectors' length nothing is lost and the result is that of one batch."""

    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, part = None, 0
        for f in frames:
            for at in range(0, len(f), batch):
                some = f.iloc[at : at + batch]
                x = np.array(some["v"].tolist(), "f8")
                if state is not None and x.shape[1] != len(state.mean):
                    raise ValueError(f"vectors of {len(state.mean)} and of {x.shape[1]} components")
                state, part = (Factors.of(x, keep) if state is None else state.merged(Factors.of(x, keep), keep)), int(some["part"].iloc[0])
        if state is not None:
            yield state.frame(part)

    def joined(frames: pd.DataFrame) -> pd.DataFrame:
        state = None
        for row in frames.sort_values("part").to_dict("records"):
            one = Factors.read(row)
            state = one if state is None else state.merged(one, keep)
        return state.frame(int(frames["part"].min()) // fan)

    v = rows.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = v.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad).select(F.spark_partition_id().cast("long").alias("part"), "v")
    now = table(usable.mapInPandas(folded, SUMMARY))
    left = now.count()
    while left > 1:
        now = table(now.groupBy(F.floor(F.col("part") / fan).alias("g")).applyInPandas(joined, SUMMARY))
        left = now.count()
    first = now.first()
    return None if first is None else Factors.read(first)


def project(rows: DataFrame, vector: str, factors: Factors, k: int, name: str = "p") -> DataFrame:
    """`rows` with the vectors' places along the first k directions; null where the vector took no part in the fit."""
    mean, v = factors.mean, factors.directions(k)

    @F.pandas_udf("array<double>")
    def placed(x: pd.Series) -> pd.Series:
        def one(row):
            if row is None or len(row) != len(mean) or any(c is None for c in row):
                return None
            a = np.asarray(row, "f8")
            return ((a - mean) @ v.T).tolist() if np.isfinite(a).all() else None

        return x.map(one)

    return rows.withColumn(name, placed(F.col(f"`{vector}`").cast("array<double>")))
