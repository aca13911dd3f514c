"""Vectors of a column as numpy matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd


def unit(rows: pd.Series) -> np.ndarray:
    """Rows scaled to length 1 in double precision; zeros stay."""
    m = np.stack([np.asarray(x, dtype=np.float64) for x in rows])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)
