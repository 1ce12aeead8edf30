"""Which vectors take part, and their shape inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(embedding: str = "embedding") -> Column:
    """True for a vector that is not null, not empty and holds finite numbers only."""
    limit = F.lit(float("inf"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == limit)
    return F.coalesce((F.size(embedding) > 0) & ~F.exists(embedding, bad), F.lit(False))


def matrix(column, dim: int) -> np.ndarray:
    """Rows of equal length from a column of float64 bytes."""
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same on every executor."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))
