"""Spectra and spectral splits of small graphs: one dense matrix in one task, refused beyond MOST vertices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.representation import vertices, weighted
from knotwork.shipping import ship

MOST = 3000


def dense(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and the weight matrix of grouped rows (src, dst, w); rows without dst are vertices only."""
    ids = np.unique(np.r_[rows["src"].to_numpy(), rows["dst"].dropna().to_numpy()].astype("int64"))
    a = np.zeros((len(ids), len(ids)))
    own = rows.dropna(subset=["dst"])
    np.add.at(a, (np.searchsorted(ids, own["src"].to_numpy()), np.searchsorted(ids, own["dst"].to_numpy().astype("int64"))), own["w"].to_numpy(float))
    return ids, a


def laplacian(a: np.ndarray) -> np.ndarray:
    return np.diag(a.sum(0)) - a


def _on_matrix(e: DataFrame, f: Callable[[np.ndarray, np.ndarray], pd.DataFrame], schema: str, most: int = MOST) -> DataFrame:
    n = vertices(e).count()
    if n > most:
        raise ValueError(f"{n} vertices are beyond {most} for a dense matrix")
    ship(e.sparkSession)
    own = weighted(e).select("src", "dst", F.col("w").cast("double").alias("w"))
    return own.groupBy(F.lit(0).alias("g")).applyInPandas(lambda rows: f(*dense(rows)), schema)


def spectrum(e: DataFrame) -> DataFrame:
    """(k, value): the Laplacian's eigenvalues, largest first."""
    def run(ids: np.ndarray, a: np.ndarray) -> pd.DataFrame:
        x = np.sort(np.linalg.eigvals(laplacian(a)).real)[::-1]
        return pd.DataFrame({"k": np.arange(len(x)), "value": x})

    return _on_matrix(e, run, "k long, value double")


def algebraic_connectivity(e: DataFrame) -> DataFrame:
    s = spectrum(e)
    n = s.agg(F.max("k").alias("n"))
    return s.crossJoin(F.broadcast(n)).where(F.col("k") == F.col("n") - 1).select(F.col("value").alias("connectivity"))


def fiedler(ids: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The eigenvector of the second least eigenvalue, its first entry that is not zero made positive."""
    value, vector = np.linalg.eigh((laplacian(a) + laplacian(a).T) / 2)
    x = vector[:, np.argsort(value, kind="stable")[1]] if len(ids) > 1 else np.zeros(len(ids))
    first = np.flatnonzero(np.abs(x) > 1e-9)
    return -x if len(first) and x[first[0]] < 0 else x


def fiedler_vector(e: DataFrame) -> DataFrame:
    return _on_matrix(e, lambda ids, a: pd.DataFrame({"v": ids, "x": fiedler(ids, a)}), "v long, x double")


def energy(e: DataFrame) -> DataFrame:
    """The sum of the sizes of the adjacency's eigenvalues."""
    return _on_matrix(e, lambda ids, a: pd.DataFrame({"energy": [float(np.abs(np.linalg.eigvals(a).real).sum())]}), "energy double")


def spectral_parts(e: DataFrame, k: int | None = None, sizes: list[int] | None = None) -> DataFrame:
    """(v, part) in order of the Fiedler vector: by sign, in k even groups, or in groups of the given sizes."""
    def run(ids: np.ndarray, a: np.ndarray) -> pd.DataFrame:
        x = fiedler(ids, a)
        if k is None and sizes is None:
            return pd.DataFrame({"v": ids, "part": (x > 0).astype("int32")})
        by = np.lexsort((ids, x))
        own = sizes or [len(ids) // k + (i < len(ids) % k) for i in range(k)]
        part = np.empty(len(ids), "int32")
        part[by] = np.repeat(np.arange(len(own)), own)[: len(ids)]
        return pd.DataFrame({"v": ids, "part": part})

    return _on_matrix(e, run, "v long, part int")
